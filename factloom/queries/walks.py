"""Neighbourhoods under budgets and paths with their outcome."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import walks
from factloom.registry import _query
from factloom.sources.tables import branches, read


def bounded_sql(roots: str, definitions: str, calls: str, direction: str, depth: int, max_nodes: int, max_edges: int) -> str:
    """The walk level by level: n<k> and e<k> hold a level's new nodes and edges, s<k> what a root has so far."""
    of, other = {"outgoing": ("source_id", "target_id"), "incoming": ("target_id", "source_id")}[direction]
    order = "target_id NULLS FIRST, id" if direction == "outgoing" else "source_id, id"
    ctes = [
        f"roots AS ({roots})", f"calls AS ({calls})",
        f"near AS (SELECT * FROM (SELECT *, {of} AS of, {other} AS other, row_number() OVER (PARTITION BY {of} ORDER BY {order}) AS rank FROM calls WHERE {of} IS NOT NULL) WHERE rank <= {max_edges + 1})",
        f"s0 AS (SELECT root, root IN (SELECT id FROM {definitions}) AS found, false AS truncated, false AS over FROM roots)",
        "n0 AS (SELECT root, root AS id, 0 AS level, CAST(1 AS BIGINT) AS place FROM s0 WHERE found)",
    ]
    for k in range(1, depth + 1):
        nodes, edges = (" UNION ALL ".join(f"SELECT root, id FROM {x}{i}" for i in range(y, k)) for x, y in (("n", 0), ("e", 1)))
        skip = f"AND (n.root, r.id) NOT IN ({edges})" if k > 1 else ""
        held = f"(SELECT count(*) FROM ({edges}) AS e WHERE e.root = x.root)" if k > 1 else "0"
        ctes += [
            f"""a{k} AS (SELECT * FROM (SELECT n.root, n.place, r.rank, r.id, r.source_id, r.target_id, r.reason, r.other, row_number() OVER (PARTITION BY n.root, r.id ORDER BY n.place, r.rank) AS once
FROM n{k - 1} AS n JOIN near AS r ON r.of = n.id WHERE n.root IN (SELECT root FROM s{k - 1} WHERE NOT over) {skip}) WHERE once = 1)""",
            f"""b{k} AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY place, rank) AS spot, other IS NOT NULL AND (root, other) NOT IN ({nodes}) AS fresh FROM a{k})""",
            f"""c{k} AS (SELECT *, CASE WHEN fresh THEN min(spot) OVER (PARTITION BY root, fresh, other) END AS first FROM b{k})""",
            f"""d{k} AS (SELECT *, NOT fresh OR (SELECT count(*) FROM ({nodes}) AS n WHERE n.root = x.root) + dense_rank() OVER (PARTITION BY root, fresh ORDER BY first) <= {max_nodes} AS fits, {held} AS held FROM c{k} AS x)""",
            f"""f{k} AS (SELECT *, held + coalesce(sum(CAST(fits AS INT)) OVER (PARTITION BY root ORDER BY spot ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= {max_edges} AS over FROM d{k})""",
            f"""e{k} AS (SELECT root, id, source_id, target_id, reason, {k} AS level, other, fresh, spot FROM f{k} WHERE fits AND NOT over)""",
            f"""n{k} AS (SELECT root, other AS id, {k} AS level, min(spot) AS place FROM e{k} WHERE fresh GROUP BY root, other)""",
            f"""s{k} AS (SELECT s.root, s.found, bool_or(s.truncated OR coalesce(f.over OR NOT f.fits, false)) AS truncated, bool_or(s.over OR coalesce(f.over, false)) AS over
FROM s{k - 1} AS s LEFT JOIN f{k} AS f ON f.root = s.root GROUP BY s.root, s.found)""",
        ]
    every = lambda x, y: " UNION ALL ".join(f"SELECT root, id, {'source_id, target_id, reason, ' if x == 'e' else ''}level FROM {x}{i}" for i in range(y, depth + 1))
    ctes += [f"nodes AS ({every('n', 0)})", f"edges AS ({every('e', 1)})"]
    return "WITH " + ", ".join(ctes)


_ROOTS = "SELECT concat('supplier:', CAST(s_suppkey AS STRING)) AS root FROM supplier UNION ALL SELECT concat('nation:', CAST(n_nationkey AS STRING)) FROM nation UNION ALL SELECT 'nowhere'"
_CALLS = "SELECT id, source_id, target_id, reason FROM v_call_graph"
_STATUS = """SELECT s.root, found, (SELECT count(*) FROM nodes AS n WHERE n.root = s.root) AS nodes, (SELECT count(*) FROM edges AS e WHERE e.root = s.root) AS edges,
(SELECT count(*) FROM edges AS e WHERE e.root = s.root AND target_id IS NULL) AS unknown_edges, truncated,
CASE WHEN found THEN CASE WHEN truncated OR EXISTS (SELECT 1 FROM edges AS e WHERE e.root = s.root AND target_id IS NULL) THEN 'partial' ELSE 'complete' END END AS coverage """


def _of(spark, d, direction: str, depth: int, max_nodes: int, max_edges: int) -> walks.Neighbourhoods:
    suppliers = read(spark, d, "supplier").select(F.concat(F.lit("supplier:"), F.col("s_suppkey").cast("string")).alias("root"))
    nations = read(spark, d, "nation").select(F.concat(F.lit("nation:"), F.col("n_nationkey").cast("string")).alias("root"))
    roots = suppliers.unionByName(nations).unionByName(spark.range(1).select(F.lit("nowhere").alias("root")))
    ends = ("part:", "supplier:"), ("supplier:", "customer:"), ("customer:", "part:")
    calls = [walks.Calls(c, *e) for c, e in zip(branches(spark, d, "v_call_graph"), ends, strict=True)]
    return walks.neighbourhoods(read(spark, d, "v_definitions"), calls, roots, direction, depth, max_nodes, max_edges)


@_query(bounded_sql(_ROOTS, "v_definitions", _CALLS, "outgoing", 2, 30, 60) + " SELECT root, id, source_id, target_id, reason, level FROM edges")
def bounded_neighbourhood_edges(spark, d):
    return _of(spark, d, "outgoing", 2, 30, 60).edges


@_query(bounded_sql(_ROOTS, "v_definitions", _CALLS, "outgoing", 2, 30, 60) + " SELECT root, id, level FROM nodes")
def bounded_neighbourhood_nodes(spark, d):
    return _of(spark, d, "outgoing", 2, 30, 60).nodes.select("root", "id", "level")


@_query(bounded_sql(_ROOTS, "v_definitions", _CALLS, "incoming", 3, 40, 200) + _STATUS + "FROM s3 AS s")
def bounded_neighbourhood_status(spark, d):
    return _of(spark, d, "incoming", 3, 40, 200).status


# A path over all definitions but the regions, so some calls have an unknown or unselected end.

_START = "part:1"
_SITES = """
picked AS (SELECT id FROM v_definitions WHERE kind <> 'module'),
steps AS (SELECT source_id AS a, target_id AS b, min(id) AS relation_id FROM v_call_graph WHERE target_id IN (SELECT id FROM picked) AND source_id IN (SELECT id FROM picked) GROUP BY source_id, target_id)"""


def _found_sql(depth: int, visits: int) -> str:
    """Visits in order: a node's number is its rank by (number of its first parent, id) in its level."""
    ctes = [_SITES, f"p0 AS (SELECT '{_START}' AS id, CAST(1 AS BIGINT) AS place, CAST(NULL AS STRING) AS relation_id, 0 AS level)"]
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id, place FROM p{i}" for i in range(k))
        ctes.append(f"q{k} AS (SELECT b AS id, min((p.place, steps.relation_id)) AS m FROM p{k - 1} AS p JOIN steps ON a = p.id WHERE b NOT IN (SELECT id FROM ({seen})) GROUP BY b)")
        ctes.append(f"p{k} AS (SELECT * FROM (SELECT id, row_number() OVER (ORDER BY m[1], id) + (SELECT max(place) FROM ({seen})) AS place, m[2] AS relation_id, {k} AS level FROM q{k}) WHERE place <= {visits})")
    return "WITH " + ", ".join(ctes) + ", visited AS (" + " UNION ALL ".join(f"SELECT * FROM p{k}" for k in range(depth + 1)) + ")"


def _path(spark, d, target=None, depth: int = 8, visits: int = 1000) -> walks.Path:
    return walks.find_path(read(spark, d, "v_definitions").where("kind <> 'module'"), read(spark, d, "v_call_graph"), _START, target, depth, visits)


@_query(_found_sql(3, 120) + " SELECT CAST(place AS INT) AS place, id, level FROM visited")
def path_visits(spark, d):
    return _path(spark, d, None, 3, 120).visited


@_query(_found_sql(3, 120) + """, unknown AS (
SELECT source_id, id AS relation_id, target_id, CASE WHEN target_id IS NULL THEN reason ELSE 'external_boundary' END AS reason FROM v_call_graph
WHERE source_id IN (SELECT id FROM picked) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM picked)))
SELECT source_id, relation_id, target_id, reason FROM unknown WHERE source_id IN (SELECT id FROM visited)""")
def path_frontier(spark, d):
    return _path(spark, d, None, 3, 120).frontier


@_query("WITH RECURSIVE " + _found_sql(5, 100_000).removeprefix("WITH ") + """, goal AS (SELECT * FROM visited WHERE id = 'customer:7'),
parents AS (SELECT v.id, v.level, s.a AS parent, v.relation_id FROM visited AS v JOIN visited AS p ON p.level = v.level - 1 JOIN steps AS s ON s.a = p.id AND s.b = v.id AND s.relation_id = v.relation_id),
back AS (SELECT id, level, relation_id FROM goal UNION ALL SELECT v.id, v.level, v.relation_id FROM back AS b JOIN parents AS p ON p.id = b.id JOIN visited AS v ON v.id = p.parent)
SELECT level + 1 AS place, id, relation_id FROM back""")
def path_to_target(spark, d):
    return _path(spark, d, "customer:7", 5, 100_000).steps
