"""Differences of two snapshots, their callers, traces, and what retention keeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The outcomes of a test.
OUTCOMES = ("pass", "fail", "expected_fail", "unexpected_pass", "timeout", "infrastructure_error", "not_run", "unknown")


def structural_diff(before: DataFrame, after: DataFrame, key: list[str], fields: list[str], id: str) -> DataFrame:
    """(key, change, correspondence, before_id, after_id, fields) of what differs; keys have no nulls.

    A key of one row on each side is one definition (unique_structural_key): modified if a field differs, with the names of
    those fields in the given order. Otherwise each row before is removed and each row after added; their correspondence
    is ambiguous if a side has several rows of the key, else unmatched. The counts of a key are aggregated before rows
    meet, so no key's rows lie in one task.
    """
    rows = {"b": before.select(*key, *fields, F.col(id).alias("row_id")), "a": after.select(*key, *fields, F.col(id).alias("row_id"))}
    sides = [df.select(*key, F.lit(int(s == "b")).alias("b"), F.lit(int(s == "a")).alias("a")) for s, df in rows.items()]
    counts = sides[0].unionByName(sides[1]).groupBy(*key).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    one = (F.col("b") == 1) & (F.col("a") == 1)
    state = F.when(one, "unique_structural_key").when((F.col("b") > 1) | (F.col("a") > 1), "ambiguous").otherwise("unmatched")
    known = counts.select(*key, state.alias("correspondence"))
    unique = known.where("correspondence = 'unique_structural_key'")
    old, new = (rows[s].select(*key, *(F.col(c).alias(f"{s}_{c}") for c in (*fields, "row_id"))) for s in "ba")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"b_{f}").eqNullSafe(F.col(f"a_{f}")), F.lit(f)) for f in fields]))
    both = unique.join(old, key).join(new, key).withColumn("changed", changed).where(F.size("changed") > 0)
    out = both.select(*key, F.lit("modified").alias("change"), "correspondence", F.col("b_row_id").alias("before_id"), F.col("a_row_id").alias("after_id"), F.array_join("changed", ",").alias("fields"))
    none = F.lit(None).cast(before.schema[id].dataType)
    for side, change in (("b", "removed"), ("a", "added")):
        alone = rows[side].join(known.where("correspondence <> 'unique_structural_key'"), key)
        ids = {"before_id": F.col("row_id") if side == "b" else none, "after_id": F.col("row_id") if side == "a" else none}
        out = out.unionByName(alone.select(*key, F.lit(change).alias("change"), "correspondence", *(c.alias(n) for n, c in ids.items()), F.lit("").alias("fields")))
    return out


def impact(changes: DataFrame, key: str, relations: DataFrame, per_definition: int = 201) -> DataFrame:
    """(caller, changed) direct callers of added and modified definitions: distinct callers and of how many of them."""
    touched = changes.where(F.col("change").isin("added", "modified")).select(F.col(key).alias("target_id"))
    sites = relations.where("kind = 'calls'").join(touched, "target_id").select("target_id", "source_id", "id")
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("source_id", "id"))
    return sites.withColumn("rank", rank).where(F.col("rank") <= per_definition).groupBy(F.col("source_id").alias("caller")).agg(F.countDistinct("target_id").alias("changed"))


def changed_files(before: DataFrame, after: DataFrame, id: str, content: Column) -> DataFrame:
    """The rows of after whose content hash is new for their id: what an incremental run has to read again."""
    old = before.select(F.col(id), F.sha2(content, 256).alias("hash")).distinct()
    return after.withColumn("hash", F.sha2(content, 256)).join(old, [id, "hash"], "left_anti")


def align_traces(streams: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row for each pair (before, after) of streams: the anchor, what matches from there and the first divergence.

    streams: stream_id, pos, kind, correlation_id, loss. The anchor is the correlation that each side has exactly once,
    of the least position before, then after, then value. From the anchor on, events are compared position by position.
    A side's loss is the sum over its whole stream, whether or not there is an anchor, as a decimal string.
    """
    pairs = pairs.select("before", "after")
    # A stream may stand on either side of many pairs; uniqueness is found once a stream.
    once = streams.where("correlation_id is not null").groupBy("stream_id", "correlation_id").agg(F.count("*").alias("n"), F.min("pos").alias("pos")).where("n = 1")
    b = once.select(F.col("stream_id").alias("before"), "correlation_id", F.col("pos").alias("b_pos"))
    a = once.select(F.col("stream_id").alias("after"), "correlation_id", F.col("pos").alias("a_pos"))
    anchors = pairs.join(b, "before").join(a, ["after", "correlation_id"]).groupBy("before", "after").agg(F.min(F.struct("b_pos", "a_pos", "correlation_id")).alias("x"))
    anchors = anchors.select("before", "after", "x.*")

    def side(stream: str, at: str, name: str) -> DataFrame:
        rows = anchors.select("before", "after", F.col(stream).alias("stream_id"), F.col(at).alias("at")).join(streams, "stream_id").where("pos >= at")
        return rows.select("before", "after", (F.col("pos") - F.col("at")).alias("i"), *[F.col(c).alias(f"{name}_{c}") for c in ("kind", "correlation_id")])

    both = side("before", "b_pos", "b").join(side("after", "a_pos", "a"), ["before", "after", "i"], "full_outer")
    reason = (
        F.when(F.col("b_kind").isNull() | F.col("a_kind").isNull(), "selected_window_event_count")
        .when(F.col("b_kind") != F.col("a_kind"), "event_kind")
        .when(~F.col("b_correlation_id").eqNullSafe(F.col("a_correlation_id")), "semantic_anchor")
    )
    found = both.withColumn("reason", reason).groupBy("before", "after").agg(
        F.min(F.when(F.col("reason").isNotNull(), F.struct("i", "reason"))).alias("d"), F.count("*").alias("compared"),
    )
    lost = streams.groupBy("stream_id").agg(F.coalesce(F.sum(F.col("loss").cast("decimal(20,0)")), F.lit(0)).cast("string").alias("loss"))
    for side in ("before", "after"):
        pairs = pairs.join(lost.select(F.col("stream_id").alias(side), F.col("loss").alias(f"{side}_loss")), side, "left").fillna("0", [f"{side}_loss"])
    out = pairs.join(anchors, ["before", "after"], "left").join(found, ["before", "after"], "left")
    return out.select("before", "after", F.col("correlation_id").alias("anchor"), "b_pos", "a_pos", F.coalesce("d.i", "compared", F.lit(0)).alias("matching"), F.col("d.reason").alias("reason"), "before_loss", "after_loss")


def order_violations(streams: DataFrame) -> DataFrame:
    """Events whose sequence isn't greater than the one before in their stream."""
    last = F.lag("sequence").over(Window.partitionBy("stream_id").orderBy("pos"))
    return streams.withColumn("last", last).where("sequence <= last").select("stream_id", "pos", "sequence", "last")


def page(rows: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from an offset in an order, numbered from the offset; sorted in parallel and cut, not collected."""
    return rows.orderBy(*order).offset(offset).limit(limit)


def newest(snapshots: DataFrame, k: int) -> DataFrame:
    """The newest k snapshots of each repository and context."""
    rank = F.row_number().over(Window.partitionBy("repository_id", "context_id").orderBy(F.desc("sequence"), F.desc("published_at")))
    return snapshots.withColumn("rank", rank).where(F.col("rank") <= k)


def retention_plan(snapshots: DataFrame, pins: DataFrame, keep_recent: int, cutoff: Column) -> DataFrame:
    """(snapshot_id, bytes, removable, reasons) of each snapshot: a root is pinned, recent or in grace."""
    rank = F.row_number().over(Window.partitionBy("repository_id", "context_id").orderBy(F.desc("sequence"), F.desc("published_at")))
    rows = snapshots.withColumn("rank", rank).join(pins.select("snapshot_id", F.lit(True).alias("pinned")), "snapshot_id", "left")
    reasons = F.array_compact(F.array(F.when(F.col("rank") == 1, F.lit("head")), F.when(F.col("pinned"), F.lit("pin")), F.when(F.col("rank") <= keep_recent, F.lit("recent")), F.when(F.col("published_at") >= cutoff, F.lit("grace"))))
    return rows.select("snapshot_id", "bytes", (F.size(reasons) == 0).alias("removable"), F.array_join(reasons, ",").alias("reasons"))


def outcome(ran: Column, passed: Column, failure_expected: Column) -> Column:
    """The outcome of a test that ran to its end or not at all; unknown where it isn't known what it did or should do."""
    known = passed.isNotNull() & failure_expected.isNotNull()
    expected = F.when(passed, "unexpected_pass").otherwise("expected_fail")
    return F.when(~ran, "not_run").when(~known, "unknown").when(failure_expected, expected).when(passed, "pass").otherwise("fail")


def outcome_counts(tests: DataFrame) -> DataFrame:
    """(outcome, tests): how many tests have each outcome; a value that is none of OUTCOMES is an error."""
    valid = F.when(F.col("outcome").isin(*OUTCOMES), F.col("outcome")).otherwise(F.raise_error(F.concat(F.lit("no outcome: "), F.coalesce("outcome", F.lit("null")))))
    return tests.select(valid.alias("outcome")).groupBy("outcome").agg(F.count("*").alias("tests"))
