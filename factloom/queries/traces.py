"""Trace windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import traces
from factloom.registry import _query
from factloom.sources.tables import read


@_query("""
WITH s AS (SELECT stream_id, pos, sequence, CASE WHEN pos % 9 = 8 THEN sequence - 5 ELSE sequence * 3 END AS t, kind, concat('c', sequence % 8) AS c, CASE WHEN sequence % 11 = 0 THEN 18446744073709551615 ELSE 0 END::HUGEINT AS loss FROM v_streams),
sizes AS (SELECT stream_id, count(*) AS n FROM s GROUP BY stream_id),
pairs AS (SELECT b.stream_id AS before, a.stream_id AS after, b.stream_id % 3 AS bo, CASE WHEN b.stream_id % 13 = 0 THEN 100000 ELSE 0 END AS ao, b.n AS bn, a.n AS an FROM sizes AS b JOIN sizes AS a ON a.stream_id = b.stream_id + 1),
w AS (SELECT before, after, 0 AS side, pos - bo AS i, sequence, t, kind, c, loss FROM pairs JOIN s ON stream_id = before AND pos >= bo AND pos < bo + 12
  UNION ALL SELECT before, after, 1, pos - ao, sequence, t, kind, c, loss FROM pairs JOIN s ON stream_id = after AND pos >= ao AND pos < ao + 12),
k AS (SELECT before, after, side, c, count(*) AS n, min(i) AS i FROM w GROUP BY before, after, side, c),
many AS (SELECT before, after, max(m) AS m FROM (SELECT before, after, side, count(*) AS m FROM k GROUP BY before, after, side) GROUP BY before, after),
x AS (SELECT before, after, min((b.i, a.i, b.c)) AS x FROM k AS b JOIN k AS a USING (before, after) JOIN many USING (before, after) JOIN pairs USING (before, after)
  WHERE b.side = 0 AND a.side = 1 AND b.c = a.c AND b.n = 1 AND a.n = 1 AND m <= 7 AND bo <= bn AND ao <= an GROUP BY before, after),
z AS (SELECT coalesce(b.before, a.before) AS before, coalesce(b.after, a.after) AS after, coalesce(b.i, a.i) AS i, b.sequence AS bs, a.sequence AS sa, b.t AS bt, a.t AS ta, b.kind AS bk, a.kind AS ak,
    CASE WHEN b.sequence IS NULL OR a.sequence IS NULL THEN 'selected_window_event_count' WHEN b.kind <> a.kind THEN 'event_kind' WHEN b.c IS DISTINCT FROM a.c THEN 'semantic_anchor' END AS reason
  FROM (SELECT w.before, w.after, i - x[1] AS i, sequence, t, kind, c FROM w JOIN x USING (before, after) WHERE side = 0 AND i >= x[1]) AS b
  FULL JOIN (SELECT w.before, w.after, i - x[2] AS i, sequence, t, kind, c FROM w JOIN x USING (before, after) WHERE side = 1 AND i >= x[2]) AS a ON a.before = b.before AND a.after = b.after AND a.i = b.i),
d AS (SELECT before, after, min(i) FILTER (reason IS NOT NULL) AS i, count(*) AS every FROM z GROUP BY before, after),
p AS (SELECT z.before, z.after, z.i, bt, ta, lag(bt) OVER v AS lb, lag(ta) OVER v AS la FROM z JOIN d ON d.before = z.before AND d.after = z.after AND z.i < coalesce(d.i, every) WINDOW v AS (PARTITION BY z.before, z.after ORDER BY z.i)),
span AS (SELECT before, after, CASE WHEN NOT bool_or(coalesce(bt < lb, false)) THEN arg_max(bt, i) - arg_min(bt, i) END AS bi, CASE WHEN NOT bool_or(coalesce(ta < la, false)) THEN arg_max(ta, i) - arg_min(ta, i) END AS ai FROM p GROUP BY before, after)
SELECT q.before, q.after, CASE WHEN bo > bn OR ao > an THEN 'out_of_range' WHEN x IS NULL THEN 'no_anchor' ELSE 'compared' END AS state, x[3] AS anchor, CAST(coalesce(d.i + 1, every, 0) AS BIGINT) AS compared, CAST(coalesce(d.i, every, 0) AS BIGINT) AS matching,
  z.reason, CAST(bs AS STRING) AS before_sequence, CAST(sa AS STRING) AS after_sequence, bk AS before_kind, ak AS after_kind,
  CAST(coalesce((SELECT sum(loss) FROM w WHERE w.before = q.before AND w.after = q.after AND side = 0), 0)::HUGEINT AS STRING) AS before_loss, CAST(coalesce((SELECT sum(loss) FROM w WHERE w.before = q.before AND w.after = q.after AND side = 1), 0)::HUGEINT AS STRING) AS after_loss,
  CAST(bi AS STRING) AS before_interval, CAST(ai AS STRING) AS after_interval,
  coalesce((SELECT array_to_string(list_sort(list(DISTINCT c))[1:7], ',') FROM k WHERE k.before = q.before AND k.after = q.after AND n > 1), '') AS ambiguous, bo <> 0 OR ao <> 0 OR bn > 12 OR an > 12 OR coalesce(m > 7, false) AS truncated
FROM pairs AS q LEFT JOIN many USING (before, after) LEFT JOIN x USING (before, after) LEFT JOIN d USING (before, after) LEFT JOIN span USING (before, after) LEFT JOIN z ON z.before = q.before AND z.after = q.after AND z.i = d.i""")
def trace_windows(spark, d):
    streams = read(spark, d, "v_streams")
    streams = streams.select(
        "stream_id", "pos", "sequence", F.when(F.col("pos") % 9 == 8, F.col("sequence") - 5).otherwise(F.col("sequence") * 3).alias("timestamp"), "kind", F.concat(F.lit("c"), F.col("sequence") % 8).alias("correlation_id"),
        F.when(F.col("sequence") % 11 == 0, "18446744073709551615").alias("loss"))
    ids = streams.select(F.col("stream_id").alias("before")).distinct()
    pairs = ids.withColumn("after", F.col("before") + 1).join(ids.select(F.col("before").alias("after")), "after", "left_semi")
    pairs = pairs.withColumn("before_offset", F.col("before") % 3).withColumn("after_offset", F.when(F.col("before") % 13 == 0, 100_000).otherwise(0))
    found = traces.compare_windows(streams, pairs, 12, 7)
    return found.withColumn("ambiguous", F.array_join("ambiguous", ","))
