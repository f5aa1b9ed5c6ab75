"""Dataflow of compiler bodies."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import dataflow
from factloom.registry import _query
from factloom.sources.tables import read

_INPUTS = ("v_flow_bodies", "v_flow_locals", "v_flow_blocks", "v_flow_effects", "v_flow_unknowns", "v_successors", "v_flow_returns")

#: Facts at the start of blocks (kind, x, y: the place of a definition; kind -1: none; local -1: an unknown effect came before) as one recursion.
_FLOW = """
WITH RECURSIVE runs AS (SELECT DISTINCT body_id, block, target, kind = 'normal' AS normal, kind IN ('resume', 'coroutine_drop') AS suspends FROM v_successors WHERE kind <> 'imaginary'),
seen AS (SELECT body_id, block FROM v_flow_blocks WHERE block = 0 UNION SELECT e.body_id, e.target FROM seen JOIN runs AS e ON e.body_id = seen.body_id AND e.block = seen.block),
terms AS (SELECT b.* FROM v_flow_blocks AS b JOIN seen USING (body_id, block)),
taints AS (SELECT DISTINCT t.body_id, t.block, step, effect, statements FROM terms AS t JOIN (
    SELECT * FROM v_flow_unknowns UNION SELECT body_id, block, statements, 'external_state' FROM terms AS s WHERE term_kind = 'yield' OR EXISTS (SELECT 1 FROM runs AS e WHERE e.body_id = s.body_id AND e.block = s.block AND suspends)) AS u USING (body_id, block)),
acts AS (SELECT e.body_id, e.block, e.step, e.local, t.statements, CASE WHEN e.step < t.statements THEN 1 ELSE 2 END AS kind, CASE WHEN e.step < t.statements THEN e.step ELSE 0 END AS y,
  bool_or(action IN ('use', 'move')) AS reads, bool_or(action = 'def') AS defines, bool_or(action <> 'use') AS touches FROM v_flow_effects AS e JOIN terms AS t USING (body_id, block) GROUP BY ALL),
latest AS (SELECT * FROM acts AS a WHERE touches AND NOT EXISTS (SELECT 1 FROM acts AS z WHERE z.body_id = a.body_id AND z.block = a.block AND z.local = a.local AND z.touches AND z.step > a.step)),
gone AS (SELECT body_id, block, local, CASE WHEN defines THEN kind ELSE -1 END AS kind, CASE WHEN defines THEN block ELSE 0 END AS x, CASE WHEN defines THEN y ELSE 0 END AS y FROM latest
  UNION SELECT body_id, block, -1, -1, 0, 0 FROM taints),
given AS (SELECT r.* FROM v_flow_returns AS r JOIN seen USING (body_id, block)),
returned AS (SELECT g.body_id, e.target AS block, g.local, 3 AS kind, g.block AS x, e.target AS y FROM given AS g JOIN runs AS e ON e.body_id = g.body_id AND e.block = g.block AND e.normal),
entry AS (SELECT l.body_id, CAST(0 AS BIGINT) AS block, l.local, CASE WHEN l.local BETWEEN 1 AND b.arguments THEN 0 ELSE -1 END AS kind, CAST(0 AS BIGINT) AS x, CAST(0 AS BIGINT) AS y
  FROM v_flow_locals AS l JOIN v_flow_bodies AS b USING (body_id) JOIN seen AS s ON s.body_id = l.body_id AND s.block = 0),
facts AS (
  SELECT * FROM (SELECT * FROM entry UNION SELECT * FROM returned
    UNION SELECT g.body_id, e.target, g.local, g.kind, g.x, g.y FROM gone AS g JOIN runs AS e ON e.body_id = g.body_id AND e.block = g.block
    WHERE NOT (e.normal AND EXISTS (SELECT 1 FROM given AS r WHERE r.body_id = g.body_id AND r.block = g.block AND r.local = g.local)))
  UNION
  SELECT f.body_id, e.target, f.local, f.kind, f.x, f.y FROM facts AS f JOIN runs AS e ON e.body_id = f.body_id AND e.block = f.block
  WHERE NOT EXISTS (SELECT 1 FROM latest AS l WHERE l.body_id = f.body_id AND l.block = f.block AND l.local = f.local)
    AND NOT (e.normal AND EXISTS (SELECT 1 FROM given AS r WHERE r.body_id = f.body_id AND r.block = f.block AND r.local = f.local))),
named AS (SELECT *, CASE kind WHEN 0 THEN 'entry' WHEN 1 THEN concat('statement ', x, ':', y) WHEN 2 THEN concat('terminator ', x) WHEN 3 THEN concat('normal_return ', x, ':', y) END AS point FROM facts),
reads AS (SELECT a.*, CASE kind WHEN 1 THEN concat('statement ', block, ':', step) ELSE concat('terminator ', block) END AS point,
  (SELECT max(step) FROM acts AS z WHERE z.body_id = a.body_id AND z.block = a.block AND z.local = a.local AND z.touches AND z.step < a.step) AS prior,
  EXISTS (SELECT 1 FROM facts AS f WHERE f.body_id = a.body_id AND f.block = a.block AND f.local = -1) OR EXISTS (SELECT 1 FROM taints AS t WHERE t.body_id = a.body_id AND t.block = a.block AND t.step <= a.step) AS changed
  FROM acts AS a WHERE reads)"""


def flow(spark, d) -> dataflow.Dataflow:
    return dataflow.reaching_definitions(*(read(spark, d, name) for name in _INPUTS))


@_query(_FLOW + """
SELECT r.body_id, r.local, r.point, coalesce(CASE WHEN prior IS NULL THEN (SELECT string_agg(n.point, ', ' ORDER BY n.kind, n.x, n.y) FROM named AS n WHERE n.body_id = r.body_id AND n.block = r.block AND n.local = r.local AND n.kind >= 0)
    WHEN p.defines THEN CASE p.kind WHEN 1 THEN concat('statement ', p.block, ':', p.step) ELSE concat('terminator ', p.block) END END, '') AS reaching,
  CASE WHEN prior IS NULL THEN EXISTS (SELECT 1 FROM facts AS n WHERE n.body_id = r.body_id AND n.block = r.block AND n.local = r.local AND n.kind = -1) ELSE NOT p.defines END AS may_be_uninitialized, changed AS possibly_changed_by_unknown_memory
FROM reads AS r LEFT JOIN acts AS p ON p.body_id = r.body_id AND p.block = r.block AND p.local = r.local AND p.step = r.prior""")
def dataflow_uses(spark, d):
    uses = flow(spark, d).uses
    return uses.withColumn("reaching", F.array_join("reaching", ", "))


@_query(_FLOW + """
SELECT body_id, local, CASE kind WHEN 1 THEN concat('statement ', block, ':', step) ELSE concat('terminator ', block) END AS point FROM acts WHERE defines
UNION SELECT body_id, local, concat('normal_return ', x, ':', y) FROM returned UNION SELECT body_id, local, 'entry' FROM entry WHERE kind = 0""")
def dataflow_definitions(spark, d):
    return flow(spark, d).definitions


@_query(_FLOW + """
SELECT body_id, CASE WHEN step < statements THEN concat('statement ', block, ':', step) ELSE concat('terminator ', block) END AS point, string_agg(DISTINCT effect, ', ' ORDER BY effect) AS effects FROM taints GROUP BY body_id, block, step, statements""")
def dataflow_unknown_effects(spark, d):
    return flow(spark, d).unknown_effects.withColumn("effects", F.array_join("effects", ", "))


@_query(_FLOW + """
SELECT b.body_id, (SELECT count(*) FROM v_successors AS e WHERE e.body_id = b.body_id AND e.kind = 'imaginary') AS imaginary, false AS truncated,
CASE WHEN EXISTS (SELECT 1 FROM v_successors AS e WHERE e.body_id = b.body_id AND e.kind = 'imaginary') OR EXISTS (SELECT 1 FROM taints AS t WHERE t.body_id = b.body_id) THEN 'partial' ELSE 'complete' END AS coverage FROM v_flow_bodies AS b""")
def dataflow_coverage(spark, d):
    return flow(spark, d).bodies


@_query("""
WITH few AS (SELECT * FROM v_flow_locals WHERE local < 5 AND (local > 1 OR body_id % 3 <> 0)), early AS (SELECT * FROM v_flow_blocks WHERE block % 5 <> 4),
bad AS (
  SELECT b.body_id, 'missing_argument_or_return_local' AS rule FROM v_flow_bodies AS b JOIN v_flow_locals AS l ON l.body_id = b.body_id AND l.local <= b.arguments WHERE (l.body_id, l.local) NOT IN (SELECT (body_id, local) FROM few)
  UNION ALL SELECT body_id, 'effect_of_missing_local' FROM v_flow_effects WHERE (body_id, local) NOT IN (SELECT (body_id, local) FROM few)
  UNION ALL SELECT body_id, 'return_to_missing_local' FROM v_flow_returns WHERE (body_id, local) NOT IN (SELECT (body_id, local) FROM few)
  UNION ALL SELECT body_id, 'effect_outside_the_block' FROM v_flow_effects AS e LEFT JOIN early AS b USING (body_id, block) WHERE statements IS NULL OR step > statements
  UNION ALL SELECT body_id, 'missing_successor' FROM v_successors WHERE (body_id, target) NOT IN (SELECT (body_id, block) FROM early))
SELECT body_id, rule, count(*) AS n FROM bad GROUP BY body_id, rule""")
def dataflow_violations(spark, d):
    bodies, locals_, blocks, effects, _, edges, returns = (read(spark, d, name) for name in _INPUTS)
    few = locals_.where("local < 5 and (local > 1 or body_id % 3 <> 0)")
    return dataflow.violations(bodies, few, blocks.where("block % 5 <> 4"), effects, edges, returns)
