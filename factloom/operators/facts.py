"""Lookups, adjacency, metrics and distributions over definitions and relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graphs import _cut


def search(definitions: DataFrame, prefix: str, after: tuple[str, str] | None = None, limit: int = 50) -> DataFrame:
    """Definitions whose lower-cased name starts with a prefix, by (name_key, id), after a key if one is given.

    The prefix is trimmed and lower-cased; an empty one finds all. Where name_key is a stored column the predicates reach the scan;
    over a view that makes it from names they filter behind the scan.
    """
    if not 1 <= limit <= 200:
        raise ValueError("limit must lie in 1..200")
    found = definitions.where(F.col("name_key").startswith(prefix.strip().lower()))
    if after:
        found = found.where((F.col("name_key") > after[0]) | ((F.col("name_key") == after[0]) & (F.col("id") > after[1])))
    return found.orderBy("name_key", "id").limit(limit)


def adjacency(relations: DataFrame, ids: list[str], direction: str, limit: int = 500) -> DataFrame:
    """Calls into or out of some definitions, at most ``limit`` for each; direction: incoming, outgoing or both."""
    calls = relations.where((F.col("kind") == "calls"))
    into, out = calls.where(F.col("target_id").isin(ids)), calls.where(F.col("source_id").isin(ids))
    if direction == "incoming":
        rows, order = into.withColumn("of", F.col("target_id")), ["source_id", "id"]
    elif direction == "outgoing":
        rows, order = out.withColumn("of", F.col("source_id")), [F.asc_nulls_first("target_id"), "id"]
    elif direction == "both":
        rows, order = into.withColumn("of", F.col("target_id")).unionByName(out.withColumn("of", F.col("source_id"))).distinct(), ["id"]
    else:
        raise ValueError(direction)
    rank = F.row_number().over(Window.partitionBy("of").orderBy(*order))
    return rows.withColumn("rank", rank).where(F.col("rank") <= limit)


def definition_evidence(relations: DataFrame, source: str, limit: int = 200) -> DataFrame:
    """The evidence of a definition's relations: the smallest ids, each once, with how many relations cite it."""
    return relations.where(F.col("source_id") == source).groupBy("evidence_id").agg(F.count("*").alias("relations")).orderBy("evidence_id").limit(limit)


def fan_metrics(nodes: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct callers and callees and call sites of every definition; a definition without calls has zeros.

    A site is unknown if its target isn't named or isn't among the nodes. Two pre-aggregated shuffles, one by source
    and one by target.
    """
    calls = relations.where("kind = 'calls'")
    known = nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("selected"))
    sites = calls.join(known, "target_id", "left")
    out = sites.groupBy(F.col("source_id").alias("id")).agg(
        F.countDistinct(F.when(F.col("selected"), F.col("target_id"))).alias("distinct_callees"),
        F.count("*").alias("outgoing_call_sites"),
        F.count_if(F.col("selected").isNull()).alias("unknown_call_sites"),
    )
    chosen = nodes.select(F.col("id").alias("source_id"))
    into = calls.where("target_id is not null").join(chosen, "source_id", "left_semi").groupBy(F.col("target_id").alias("id")).agg(F.countDistinct("source_id").alias("distinct_callers"), F.count("*").alias("incoming_call_sites"))
    counts = ["distinct_callers", "distinct_callees", "incoming_call_sites", "outgoing_call_sites", "unknown_call_sites"]
    rows = nodes.join(into, "id", "left").join(out, "id", "left").fillna(0, counts)
    return rows.select("id", *counts, "source_lines", "unsafe_blocks", (F.col("visibility") == "pub").alias("declared_public"))


def distributions(metrics: DataFrame, columns: tuple[str, ...] = ("source_lines", "distinct_callers", "distinct_callees", "unsafe_blocks")) -> DataFrame:
    """Least, lower median, nearest-rank 95th percentile and greatest of each metric; no rows for an empty input.

    Values are counted before they are sorted, so a metric's task holds its distinct values only; nulls don't count.
    """
    long = metrics.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("long").alias("value")) for c in columns])).alias("m")).select("m.*")
    counts = long.where("value is not null").groupBy("metric", "value").agg(F.count("*").alias("c"))
    every = Window.partitionBy("metric")
    counts = counts.withColumns({"upto": F.sum("c").over(every.orderBy("value")), "n": F.sum("c").over(every)})
    return counts.groupBy("metric").agg(
        F.min("value").alias("least"),
        F.min(F.when(2 * F.col("upto") >= F.col("n"), F.col("value"))).alias("median"),
        F.min(F.when(100 * F.col("upto") >= 95 * F.col("n"), F.col("value"))).alias("p95"),
        F.max("value").alias("greatest"),
    )


def unknown_reasons(relations: DataFrame) -> DataFrame:
    """Unresolved relations by reason."""
    return relations.where("target_id is null").groupBy("reason").agg(F.count("*").alias("n"))


def largest_fan_out(relations: DataFrame, k: int = 10) -> DataFrame:
    """The k sources of most call sites; ties go to the smaller id."""
    return relations.where("kind = 'calls'").groupBy("source_id").agg(F.count("*").alias("sites")).orderBy(F.desc("sites"), "source_id").limit(k)


#: Why something isn't known, in the order of answers.
REASONS = (
    "missing_dependency", "cfg_unknown", "macro_unavailable", "indirect_target_unknown", "external_boundary",
    "unsupported_construct", "budget_exhausted", "analysis_failed", "artifact_mismatch", "syntax_only",
)


def merge_coverage(parts: DataFrame, ceiling: int = 4_294_967_295) -> DataFrame:
    """(reason, n, ordinal): counts by reason, saturated at a ceiling; ordinal is the reason's place in answers, null for none of REASONS."""
    place = F.array_position(F.array(*map(F.lit, REASONS)), F.col("reason")) - 1
    counts = parts.groupBy("reason").agg(F.least(F.sum("n"), F.lit(ceiling)).alias("n"))
    return counts.withColumn("ordinal", F.when(place >= 0, place))


def merge_limitations(parts: DataFrame) -> DataFrame:
    """(limitation, first): each limitation once, by the place where it is first told; parts: place, limitation."""
    return parts.groupBy("limitation").agg(F.min("place").alias("first"))


def ownership(definitions: DataFrame) -> DataFrame:
    """(id, root, steps, state) of each definition: state is rooted, missing_owner or cyclic; the latter has no root and no steps.

    Pointers double: a round joins each open chain to what its next owner knows already, so chains of any depth end after
    about log2(depth) rounds. What is open once chains are longer than there are definitions, runs in a cycle.
    """
    rows = _cut(definitions.select("id", F.col("id").alias("root"), F.col("owner_id").alias("next"), F.lit(0).cast("long").alias("steps"), F.lit("rooted").alias("state")))
    longest, most = 1, rows.count()
    while longest <= 2 * most and not rows.where("next is not null").isEmpty():
        known = rows.select(*(F.col(c).alias(f"_{c}") for c in rows.columns))
        there, more = F.col("_id").isNotNull(), F.col("next").isNotNull()
        rows = _cut(rows.join(known, rows.next == known._id, "left").select(
            "id", F.coalesce("_root", "root").alias("root"), F.col("_next").alias("next"),
            (F.col("steps") + F.when(there, F.col("_steps") + 1).otherwise(0)).alias("steps"),
            F.when(more, F.when(there, F.col("_state")).otherwise("missing_owner")).otherwise(F.col("state")).alias("state"),
        ))
        longest *= 2
    cyclic = F.col("next").isNotNull()
    return rows.select("id", F.when(~cyclic, F.col("root")).alias("root"), F.when(~cyclic, F.col("steps")).alias("steps"), F.when(cyclic, "cyclic").otherwise(F.col("state")).alias("state"))


def violations(definitions: DataFrame, relations: DataFrame) -> DataFrame:
    """Broken rules of a batch of facts: duplicate ids, missing sources, targets and owners, with their number."""
    known = definitions.select("id")
    checks = [
        ("duplicate_definition", definitions.groupBy("id").count().where("count > 1").select("id")),
        ("duplicate_relation", relations.groupBy("id").count().where("count > 1").select("id")),
        ("missing_source", relations.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_anti").select("id")),
        ("missing_target", relations.where("target_id is not null").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_anti").select("id")),
        ("missing_owner", definitions.where("owner_id is not null").join(known.withColumnRenamed("id", "owner_id"), "owner_id", "left_anti").select("id")),
        ("target_and_reason", relations.where("(target_id is null) = (reason is null)").select("id")),
    ]
    rows = checks[0][1].select(F.lit(checks[0][0]).alias("rule"), "id")
    for rule, ids in checks[1:]:
        rows = rows.unionByName(ids.select(F.lit(rule).alias("rule"), "id"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
