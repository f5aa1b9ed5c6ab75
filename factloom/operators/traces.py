"""Windows of trace streams compared from a common anchor on, many pairs of streams at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import unsigned64
from factloom.operators.graphs import _cut

#: The most events of a window, and the most different correlations of one that may be aligned.
MAX_EVENTS, MAX_ANCHORS = 2000, 2000
_PAIR = ["before", "after"]


def compare_windows(streams: DataFrame, pairs: DataFrame, max_events: int = MAX_EVENTS, max_anchors: int = MAX_ANCHORS) -> DataFrame:
    """One row for each (before, after, before_offset, after_offset) of pairs, a pair of streams being asked for once.

    streams: stream_id, pos, sequence, timestamp, kind, correlation_id, loss (decimal texts or numbers). A window is ``max_events``
    events from the offset. The anchor is the correlation that both windows have exactly once, of the least position before, then after,
    then value; no anchor is taken if a window has more than ``max_anchors`` correlations. From the anchor on, events are compared
    position by position up to the first that differs: in kind, else in correlation, else because a window has ended.

    state: compared, no_anchor, out_of_range (an offset beyond its stream) or invalid (a number that isn't one of 64 bits). matching:
    events up to there; an interval is the time over those of one side, null if its clock goes back there; loss counts the
    whole window. ambiguous: correlations that a window repeats, ``max_anchors`` at most. truncated: events of a stream weren't in its
    window, or there were too many correlations.
    """
    if not (1 <= max_events <= MAX_EVENTS and 1 <= max_anchors <= MAX_ANCHORS):
        raise ValueError(f"1..{MAX_EVENTS} events, 1..{MAX_ANCHORS} anchors")
    pairs = _cut(pairs.select(*_PAIR, F.col("before_offset").cast("long"), F.col("after_offset").cast("long")))
    sizes = streams.groupBy("stream_id").agg(F.count("*").alias("size"))
    number = lambda c: unsigned64(F.col(c).cast("string"))
    broken = number("sequence").isNull() | number("timestamp").isNull() | (F.col("loss").isNotNull() & number("loss").isNull())
    events = streams.select("stream_id", "pos", F.col("sequence").cast("string").alias("sequence"), number("timestamp").alias("timestamp"), "kind", "correlation_id", F.coalesce(number("loss"), F.lit(0)).alias("loss"), broken.alias("broken"))
    windows, known, lost = {}, pairs, {}
    for x, side in (("b", "before"), ("a", "after")):
        rows = pairs.select(*_PAIR, F.col(side).alias("stream_id"), F.col(f"{side}_offset").alias("offset")).join(events, "stream_id")
        rows = rows.where((F.col("pos") >= F.col("offset")) & (F.col("pos") < F.col("offset") + max_events))
        windows[x] = _cut(rows.select(*_PAIR, (F.col("pos") - F.col("offset")).alias("i"), "sequence", "timestamp", "kind", "correlation_id", "loss", "broken"))
        known = known.join(sizes.select(F.col("stream_id").alias(side), F.col("size").alias(f"{x}_size")), side, "left")
        lost[x] = windows[x].groupBy(*_PAIR).agg(F.sum("loss").alias(f"{x}_loss"), F.bool_or("broken").alias(f"{x}_broken"))
    seen = {x: w.where("correlation_id is not null").groupBy(*_PAIR, "correlation_id").agg(F.count("*").alias("n"), F.min("i").alias("i")) for x, w in windows.items()}
    many = {x: s.groupBy(*_PAIR).agg(F.count("*").alias(f"{x}_many")) for x, s in seen.items()}
    twice = seen["b"].where("n > 1").select(*_PAIR, "correlation_id").unionByName(seen["a"].where("n > 1").select(*_PAIR, "correlation_id")).groupBy(*_PAIR).agg(F.slice(F.array_sort(F.collect_set("correlation_id")), 1, max_anchors).alias("ambiguous"))
    for extra in (*lost.values(), *many.values(), twice):
        known = known.join(extra, _PAIR, "left")
    over = (F.coalesce("b_many", F.lit(0)) > max_anchors) | (F.coalesce("a_many", F.lit(0)) > max_anchors)
    outside = (F.col("before_offset") > F.coalesce("b_size", F.lit(0))) | (F.col("after_offset") > F.coalesce("a_size", F.lit(0)))
    bad = F.coalesce("b_broken", F.lit(False)) | F.coalesce("a_broken", F.lit(False))
    clipped = (F.col("before_offset") != 0) | (F.col("after_offset") != 0) | (F.col("b_size") > max_events) | (F.col("a_size") > max_events)
    known = _cut(known.withColumns({"over": over, "outside": outside, "bad": bad, "truncated": F.coalesce(clipped, F.lit(False)) | over}))
    b, a = (seen[x].where("n = 1").select(*_PAIR, "correlation_id", F.col("i").alias(f"{x}_at")) for x in "ba")
    usable = known.where("not over and not outside and not bad").select(*_PAIR)
    anchors = b.join(a, [*_PAIR, "correlation_id"]).join(usable, _PAIR, "left_semi").groupBy(*_PAIR).agg(F.min(F.struct("b_at", "a_at", "correlation_id")).alias("x")).select(*_PAIR, "x.*")
    anchors = _cut(anchors.withColumnRenamed("correlation_id", "anchor"))

    def aligned(x: str) -> DataFrame:
        rows = windows[x].join(anchors.select(*_PAIR, F.col(f"{x}_at").alias("at")), _PAIR).where("i >= at")
        return rows.select(*_PAIR, (F.col("i") - F.col("at")).alias("i"), *(F.col(c).alias(f"{x}_{c}") for c in ("sequence", "timestamp", "kind", "correlation_id")))

    both = aligned("b").join(aligned("a"), [*_PAIR, "i"], "full_outer")
    reason = (
        F.when(F.col("b_sequence").isNull() | F.col("a_sequence").isNull(), "selected_window_event_count").when(F.col("b_kind") != F.col("a_kind"), "event_kind")
        .when(~F.col("b_correlation_id").eqNullSafe(F.col("a_correlation_id")), "semantic_anchor")
    )
    back = [F.coalesce(F.col(f"{x}_timestamp") < F.lag(f"{x}_timestamp").over(Window.partitionBy(*_PAIR).orderBy("i")), F.lit(False)).alias(f"{x}_back") for x in "ba"]
    both = _cut(both.select("*", reason.alias("reason"), *back))
    where = F.struct("i", "reason", "b_sequence", "a_sequence", "b_kind", "a_kind")
    first = both.groupBy(*_PAIR).agg(F.min(F.when(F.col("reason").isNotNull(), where)).alias("d"), F.count("*").alias("every"))
    first = first.select(*_PAIR, "d", F.coalesce("d.i", "every").alias("matching"), F.coalesce(F.col("d.i") + 1, F.col("every")).alias("compared"))
    alike = both.join(first.select(*_PAIR, "matching"), _PAIR).where("i < matching")
    spans = alike.groupBy(*_PAIR).agg(*(F.when(~F.bool_or(f"{x}_back"), F.max_by(f"{x}_timestamp", "i") - F.min_by(f"{x}_timestamp", "i")).cast("decimal(20,0)").cast("string").alias(f"{side}_interval") for x, side in (("b", "before"), ("a", "after"))))
    out = known.join(anchors, _PAIR, "left").join(first, _PAIR, "left").join(spans, _PAIR, "left")
    state = F.when(F.col("outside"), "out_of_range").when(F.col("bad"), "invalid").when(F.col("anchor").isNull(), "no_anchor").otherwise("compared")
    zero = F.lit(0).cast("long")
    return out.select(
        *_PAIR, state.alias("state"), "anchor", F.coalesce("compared", zero).alias("compared"), F.coalesce("matching", zero).alias("matching"), F.col("d.reason").alias("reason"),
        *(F.col(f"d.{x}_{c}").alias(f"{side}_{c}") for c in ("sequence", "kind") for x, side in (("b", "before"), ("a", "after"))),
        *(F.coalesce(F.col(f"{x}_loss").cast("string"), F.lit("0")).alias(f"{side}_loss") for x, side in (("b", "before"), ("a", "after"))),
        "before_interval", "after_interval", F.coalesce("ambiguous", F.array().cast("array<string>")).alias("ambiguous"), "truncated",
    )
