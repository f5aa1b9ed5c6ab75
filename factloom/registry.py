"""Queries over the driver tables and the SQL that they are checked against.

``QUERIES`` holds for each name the DataFrame form and, where SQL expresses it, the oracle's SQL over the same views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import facts, flow, graphs, history, mapping
from factloom.sources.tables import read, with_views

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def _query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = (f, sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for name, (_, sql) in QUERIES.items() if sql}


# Lookups and adjacency


@_query("SELECT id, name FROM v_definitions WHERE starts_with(name_key, 'customer') ORDER BY name_key, id LIMIT 50")
def prefix_search(spark, d):
    return facts.search(read(spark, d, "v_definitions"), " Customer ").select("id", "name")


@_query("SELECT id, name FROM v_definitions WHERE (name_key, id) > ('m', 'part:5') ORDER BY name_key, id LIMIT 200")
def keyset_search(spark, d):
    return facts.search(read(spark, d, "v_definitions"), "", ("m", "part:5"), 200).select("id", "name")


@_query("SELECT source_id, target_id, id FROM v_relations WHERE kind = 'calls' AND target_id IN ('supplier:1', 'supplier:2', 'supplier:3')")
def adjacency_incoming(spark, d):
    return facts.adjacency(read(spark, d, "v_relations"), ["supplier:1", "supplier:2", "supplier:3"], "incoming", 1 << 30).select("source_id", "target_id", "id")


@_query("""
SELECT source_id, target_id, id, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY source_id ORDER BY target_id NULLS FIRST, id) AS INT) AS rank FROM v_relations
  WHERE kind = 'calls' AND source_id IN ('part:1', 'part:2', 'part:3', 'part:5', 'part:8')) WHERE rank <= 20""")
def adjacency_outgoing(spark, d):
    return facts.adjacency(read(spark, d, "v_relations"), [f"part:{i}" for i in (1, 2, 3, 5, 8)], "outgoing", 20).select("source_id", "target_id", "id", "rank")


@_query("""
SELECT id, source_id, target_id FROM v_relations WHERE kind = 'calls' AND target_id = 'supplier:4'
UNION SELECT id, source_id, target_id FROM v_relations WHERE kind = 'calls' AND source_id = 'supplier:4'""")
def adjacency_both(spark, d):
    return facts.adjacency(read(spark, d, "v_relations"), ["supplier:4"], "both", 1 << 30).select("id", "source_id", "target_id")


@_query("SELECT evidence_id, count(*) AS relations FROM v_relations WHERE source_id = 'part:7' GROUP BY evidence_id ORDER BY evidence_id LIMIT 200")
def definition_evidence(spark, d):
    return facts.definition_evidence(read(spark, d, "v_relations"), "part:7")


# Metrics

_FAN = """
WITH calls AS (SELECT r.*, t.id IS NOT NULL AS selected FROM v_relations AS r LEFT JOIN v_definitions AS t ON t.id = r.target_id WHERE r.kind = 'calls'),
o AS (SELECT source_id AS id, count(DISTINCT CASE WHEN selected THEN target_id END) AS distinct_callees, count(*) AS outgoing_call_sites,
             count(*) FILTER (NOT selected) AS unknown_call_sites FROM calls GROUP BY source_id),
i AS (SELECT target_id AS id, count(DISTINCT source_id) AS distinct_callers, count(*) AS incoming_call_sites FROM calls
      WHERE target_id IS NOT NULL AND source_id IN (SELECT id FROM v_definitions) GROUP BY target_id),
fan AS (SELECT n.id, coalesce(distinct_callers, 0) AS distinct_callers, coalesce(distinct_callees, 0) AS distinct_callees,
       coalesce(incoming_call_sites, 0) AS incoming_call_sites, coalesce(outgoing_call_sites, 0) AS outgoing_call_sites,
       coalesce(unknown_call_sites, 0) AS unknown_call_sites, source_lines, unsafe_blocks, visibility = 'pub' AS declared_public
FROM v_definitions AS n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id) """


@_query(_FAN + "SELECT * FROM fan")
def fan_metrics(spark, d):
    return facts.fan_metrics(read(spark, d, "v_definitions"), read(spark, d, "v_relations"))


@_query(_FAN + " UNION ALL ".join(
    f"SELECT '{c}' AS metric, min({c}) AS least, CAST(quantile_disc({c}, 0.5) AS BIGINT) AS median, CAST(quantile_disc({c}, 0.95) AS BIGINT) AS p95, max({c}) AS greatest FROM fan"
    for c in ("source_lines", "distinct_callers", "distinct_callees", "unsafe_blocks")))
def distributions(spark, d):
    return facts.distributions(fan_metrics(spark, d))


@_query("SELECT reason, count(*) AS n FROM v_relations WHERE target_id IS NULL GROUP BY reason")
def unknown_reasons(spark, d):
    return facts.unknown_reasons(read(spark, d, "v_relations"))


@_query("SELECT source_id, count(*) AS sites FROM v_relations WHERE kind = 'calls' GROUP BY source_id ORDER BY sites DESC, source_id LIMIT 10")
def largest_fan_out(spark, d):
    return facts.largest_fan_out(read(spark, d, "v_relations"))


@_query("SELECT kind, cfg_status, visibility, count(*) AS n FROM v_definitions GROUP BY kind, cfg_status, visibility")
def definition_counts(spark, d):
    return read(spark, d, "v_definitions").groupBy("kind", "cfg_status", "visibility").agg(F.count("*").alias("n"))


@_query("""
SELECT reason, CAST(least(sum(n), 4294967295) AS BIGINT) AS n, CASE reason WHEN 'indirect_target_unknown' THEN CAST(3 AS BIGINT) WHEN 'external_boundary' THEN 4 END AS ordinal FROM (
  SELECT reason, CAST(l.span_start AS BIGINT) * 100000 AS n FROM v_relations AS l WHERE reason IS NOT NULL) GROUP BY reason""")
def merged_coverage(spark, d):
    parts = read(spark, d, "v_relations").where("reason is not null").select("reason", (F.col("span_start") * 100000).alias("n"))
    return facts.merge_coverage(parts)


@_query("""
WITH RECURSIVE up AS (
  SELECT id, id AS root, owner_id AS nxt, 0 AS steps FROM v_definitions
  UNION ALL SELECT up.id, o.id, o.owner_id, up.steps + 1 FROM up JOIN v_definitions AS o ON o.id = up.nxt),
top AS (SELECT id, max(steps) AS steps FROM up GROUP BY id)
SELECT up.id, up.root, CAST(up.steps AS BIGINT) AS steps, CASE WHEN nxt IS NULL THEN 'rooted' ELSE 'missing_owner' END AS state
FROM up JOIN top ON up.id = top.id AND up.steps = top.steps""")
def ownership(spark, d):
    return facts.ownership(read(spark, d, "v_definitions"))


@_query("""
WITH bad AS (
  SELECT 'duplicate_definition' AS rule, id FROM v_definitions GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'duplicate_relation', id FROM v_relations GROUP BY id HAVING count(*) > 1
  UNION ALL SELECT 'missing_source', id FROM v_relations WHERE source_id NOT IN (SELECT id FROM v_definitions)
  UNION ALL SELECT 'missing_target', id FROM v_relations WHERE target_id NOT IN (SELECT id FROM v_definitions)
  UNION ALL SELECT 'missing_owner', id FROM v_definitions WHERE owner_id NOT IN (SELECT id FROM v_definitions)
  UNION ALL SELECT 'target_and_reason', id FROM v_relations WHERE (target_id IS NULL) = (reason IS NULL))
SELECT rule, count(*) AS n, min(id) AS first_id FROM bad GROUP BY rule""")
def integrity_violations(spark, d):
    definitions = read(spark, d, "v_definitions").where("id <> 'supplier:3' and id <> 'nation:2'")
    return facts.violations(definitions, read(spark, d, "v_relations"))


# The oracle looks at the same facts without two definitions.
_f, _sql = QUERIES["integrity_violations"]
QUERIES["integrity_violations"] = (_f, _sql.replace("WITH bad", "WITH facts AS (SELECT * FROM v_definitions WHERE id NOT IN ('supplier:3', 'nation:2')), bad").replace("FROM v_definitions GROUP", "FROM facts GROUP").replace("SELECT id FROM v_definitions)", "SELECT id FROM facts)").replace("id FROM v_definitions WHERE owner", "id FROM facts WHERE owner"))


# Graphs


def _walk(root: str, step: str, depth: int) -> str:
    return f"""
WITH RECURSIVE {step},
walk AS (SELECT '{root}' AS id, 0 AS level UNION SELECT b, level + 1 FROM walk JOIN steps ON a = walk.id WHERE level < {depth})
SELECT id, CAST(min(level) AS INT) AS level FROM walk GROUP BY id"""


_OUT = "SELECT source_id AS a, target_id AS b FROM v_call_graph WHERE target_id IS NOT NULL"
_INTO = "SELECT target_id AS a, source_id AS b FROM v_call_graph WHERE target_id IS NOT NULL"


@_query(_walk("part:1", f"steps AS (SELECT DISTINCT * FROM ({_OUT}))", 3))
def neighbourhood_outgoing(spark, d):
    return graphs.neighbourhood(read(spark, d, "v_call_graph"), "part:1", "outgoing", 3)


@_query(_walk("customer:4", f"steps AS (SELECT DISTINCT * FROM ({_INTO}))", 2))
def neighbourhood_incoming(spark, d):
    return graphs.neighbourhood(read(spark, d, "v_call_graph"), "customer:4", "incoming", 2)


@_query(_walk("supplier:5", f"steps AS ({_OUT} UNION {_INTO})", 2))
def neighbourhood_both(spark, d):
    return graphs.neighbourhood(read(spark, d, "v_call_graph"), "supplier:5", "both", 2)


def _levels(root: str, depth: int) -> str:
    """The search level by level: a node's place is its rank by (place of its first parent, id) after all of the levels before."""
    ctes = ["steps AS (SELECT source_id AS a, target_id AS b, min(id) AS relation_id FROM v_call_graph WHERE target_id IS NOT NULL GROUP BY source_id, target_id)"]
    ctes.append(f"p0 AS (SELECT '{root}' AS id, CAST(1 AS BIGINT) AS place, 0 AS level, CAST(NULL AS STRING) AS parent, CAST(NULL AS STRING) AS relation_id, '{root}' AS path)")
    for k in range(1, depth + 1):
        seen = " UNION ALL ".join(f"SELECT id, place FROM p{i}" for i in range(k))
        ctes.append(f"q{k} AS (SELECT b AS id, min((p.place, steps.relation_id)) AS m FROM p{k - 1} AS p JOIN steps ON a = p.id WHERE b NOT IN (SELECT id FROM ({seen})) GROUP BY b)")
        ctes.append(f"""p{k} AS (SELECT q.id, row_number() OVER (ORDER BY m[1], q.id) + (SELECT max(place) FROM ({seen})) AS place, {k} AS level, p.id AS parent, m[2] AS relation_id, concat(p.path, '>', q.id) AS path
FROM q{k} AS q JOIN p{k - 1} AS p ON p.place = m[1])""")
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(depth + 1))
    return f"WITH {', '.join(ctes)} SELECT id, CAST(level AS INT) AS level, parent, relation_id, path FROM ({every})"


@_query(_levels("part:1", 4))
def shortest_paths(spark, d):
    found = graphs.shortest_paths(read(spark, d, "v_call_graph"), "part:1", 4)
    return found.withColumn("path", F.array_join("path", ">"))


_SCC = """
WITH RECURSIVE closure AS (
  SELECT source_id AS a, target_id AS b FROM v_flow_graph UNION SELECT c.a, g.target_id FROM closure AS c JOIN v_flow_graph AS g ON g.source_id = c.b),
nodes AS (SELECT source_id AS id FROM v_flow_graph UNION SELECT target_id FROM v_flow_graph),
same AS (SELECT id, id AS other FROM nodes UNION SELECT x.a, x.b FROM closure AS x JOIN closure AS y ON x.a = y.b AND x.b = y.a),
named AS (SELECT id, min(other) AS component, count(*) AS size FROM same GROUP BY id) """


@_query(_SCC + """
SELECT id, component, size, size > 1 OR EXISTS (SELECT 1 FROM v_flow_graph AS g WHERE g.source_id = named.id AND g.target_id = named.id) AS recursive FROM named""")
def strong_components(spark, d):
    return graphs.components(read(spark, d, "v_flow_graph"))


@_query(_SCC + """
SELECT x.component AS from_component, y.component AS to_component, count(*) AS relations
FROM v_flow_graph AS g JOIN named AS x ON x.id = g.source_id JOIN named AS y ON y.id = g.target_id WHERE x.component <> y.component GROUP BY 1, 2""")
def component_links(spark, d):
    edges = read(spark, d, "v_flow_graph")
    return graphs.component_links(edges, graphs.components(edges))


# Differences


_FIELDS = ("signature", "body", "visibility", "cfg_status", "source_span")


def _diff_sql(key: str) -> str:
    keys = key.split(", ")
    fields = [f for f in _FIELDS if f not in keys]
    changed = ", ".join(f"CASE WHEN b.{f} IS DISTINCT FROM a.{f} THEN '{f}' END" for f in fields)
    plain = ", ".join(f"b.{k}" for k in keys)
    out = f"{plain}, 'modified' AS change, 'unique_structural_key' AS correspondence, b.k AS before_id, a.k AS after_id, concat_ws(',', {changed}) AS fields"

    def alone(mine: str, other: str, change: str, ids: str) -> str:
        return f"""SELECT {key}, '{change}' AS change, CASE WHEN n > 1 OR m > 1 THEN 'ambiguous' ELSE 'unmatched' END AS correspondence, {ids}, '' AS fields
FROM (SELECT x.*, count(*) OVER (PARTITION BY {key}) AS n, (SELECT count(*) FROM {other} AS y WHERE {" AND ".join(f"y.{k} = x.{k}" for k in keys)}) AS m FROM {mine} AS x) AS z WHERE n <> 1 OR m <> 1"""

    return f"""
WITH ones AS (SELECT {key} FROM (SELECT {key} FROM v_before GROUP BY {key} HAVING count(*) = 1) INTERSECT SELECT {key} FROM (SELECT {key} FROM v_after GROUP BY {key} HAVING count(*) = 1))
SELECT * FROM (SELECT {out} FROM ones JOIN v_before AS b USING ({key}) JOIN v_after AS a USING ({key})) AS m WHERE fields <> ''
UNION ALL {alone("v_before", "v_after", "removed", "k AS before_id, NULL AS after_id")}
UNION ALL {alone("v_after", "v_before", "added", "NULL AS before_id, k AS after_id")}"""


@_query(_diff_sql("k"))
def structural_diff(spark, d):
    return history.structural_diff(read(spark, d, "v_before"), read(spark, d, "v_after"), ["k"], list(_FIELDS), "k")


@_query(_diff_sql("name, signature"))
def ambiguous_diff(spark, d):
    return history.structural_diff(read(spark, d, "v_before"), read(spark, d, "v_after"), ["name", "signature"], [f for f in _FIELDS if f != "signature"], "k")


@_query("""
WITH touched AS (SELECT concat('part:', CAST(a.k AS STRING)) AS id FROM v_after AS a LEFT JOIN v_before AS b ON a.k = b.k
                 WHERE b.k IS NULL OR (a.signature, a.body, a.visibility, a.cfg_status, a.source_span) IS DISTINCT FROM (b.signature, b.body, b.visibility, b.cfg_status, b.source_span)),
calls AS (SELECT concat('supplier:', CAST(l_suppkey AS STRING)) AS source_id, concat('part:', CAST(l_partkey AS STRING)) AS target_id,
                 concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS id FROM lineitem),
sites AS (SELECT source_id, target_id, row_number() OVER (PARTITION BY target_id ORDER BY source_id, calls.id) AS r FROM calls JOIN touched ON touched.id = calls.target_id)
SELECT source_id AS caller, count(DISTINCT target_id) AS changed FROM sites WHERE r <= 201 GROUP BY source_id""")
def diff_impact(spark, d):
    changes = structural_diff(spark, d).withColumn("id", F.concat(F.lit("part:"), F.col("k").cast("string")))
    calls = read(spark, d, "lineitem").select(
        F.concat(F.lit("supplier:"), F.col("l_suppkey").cast("string")).alias("source_id"), F.concat(F.lit("part:"), F.col("l_partkey").cast("string")).alias("target_id"),
        F.lit("calls").alias("kind"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"))
    return history.impact(changes, "id", calls)


@_query("SELECT k AS id FROM v_after WHERE (k, body) NOT IN (SELECT (k, body) FROM v_before)")
def changed_files(spark, d):
    found = history.changed_files(read(spark, d, "v_before"), read(spark, d, "v_after"), "k", F.col("body"))
    return found.select(F.col("k").alias("id"))


# Traces


@_query("""
WITH pairs AS (SELECT DISTINCT stream_id AS before, stream_id + 1 AS after FROM v_streams WHERE stream_id + 1 IN (SELECT stream_id FROM v_streams)),
once AS (SELECT stream_id, correlation_id, min(pos) AS pos FROM v_streams WHERE correlation_id IS NOT NULL GROUP BY stream_id, correlation_id HAVING count(*) = 1),
c AS (SELECT before, after, b.pos AS b_pos, a.pos AS a_pos, b.correlation_id,
             row_number() OVER (PARTITION BY before, after ORDER BY b.pos, a.pos, b.correlation_id) AS r
      FROM pairs JOIN once AS b ON b.stream_id = before JOIN once AS a ON a.stream_id = after AND a.correlation_id = b.correlation_id),
x AS (SELECT * FROM c WHERE r = 1),
bs AS (SELECT x.before, x.after, s.pos - b_pos AS i, s.kind, s.correlation_id FROM x JOIN v_streams AS s ON s.stream_id = x.before AND s.pos >= b_pos),
aa AS (SELECT x.before, x.after, s.pos - a_pos AS i, s.kind, s.correlation_id FROM x JOIN v_streams AS s ON s.stream_id = x.after AND s.pos >= a_pos),
z AS (SELECT coalesce(bs.before, aa.before) AS before, coalesce(bs.after, aa.after) AS after, coalesce(bs.i, aa.i) AS i,
             CASE WHEN bs.kind IS NULL OR aa.kind IS NULL THEN 'selected_window_event_count' WHEN bs.kind <> aa.kind THEN 'event_kind'
                  WHEN bs.correlation_id IS DISTINCT FROM aa.correlation_id THEN 'semantic_anchor' END AS reason
      FROM bs FULL OUTER JOIN aa ON bs.before = aa.before AND bs.after = aa.after AND bs.i = aa.i),
g AS (SELECT before, after, count(*) AS compared, min(CASE WHEN reason IS NOT NULL THEN i END) AS i FROM z GROUP BY before, after),
lost AS (SELECT stream_id, CAST(coalesce(sum(loss), 0) AS STRING) AS loss FROM v_streams GROUP BY stream_id)
SELECT p.before, p.after, x.correlation_id AS anchor, x.b_pos, x.a_pos, CAST(coalesce(g.i, g.compared, 0) AS BIGINT) AS matching, z.reason, lb.loss AS before_loss, la.loss AS after_loss
FROM pairs AS p JOIN lost AS lb ON lb.stream_id = p.before JOIN lost AS la ON la.stream_id = p.after LEFT JOIN x ON p.before = x.before AND p.after = x.after LEFT JOIN g ON p.before = g.before AND p.after = g.after
LEFT JOIN z ON z.before = g.before AND z.after = g.after AND z.i = g.i""")
def trace_alignment(spark, d):
    streams = read(spark, d, "v_streams")
    ids = streams.select(F.col("stream_id").alias("before")).distinct()
    pairs = ids.withColumn("after", F.col("before") + 1).join(ids.select(F.col("before").alias("after")), "after", "left_semi")
    return history.align_traces(streams, pairs)


@_query("""
SELECT stream_id, pos, sequence, last FROM (
  SELECT stream_id, pos, seq AS sequence, lag(seq) OVER (PARTITION BY stream_id ORDER BY pos) AS last FROM (SELECT stream_id, pos, sequence % 1000 AS seq FROM v_streams))
WHERE sequence <= last""")
def order_violations(spark, d):
    return history.order_violations(read(spark, d, "v_streams").withColumn("sequence", F.col("sequence") % 1000))


@_query("SELECT stream_id, pos, sequence, kind FROM v_streams ORDER BY stream_id, pos LIMIT 100 OFFSET 250")
def trace_page(spark, d):
    return history.page(read(spark, d, "v_streams").select("stream_id", "pos", "sequence", "kind"), ["stream_id", "pos"], 250, 100)


@_query("SELECT stream_id, count(*) AS events, count(DISTINCT kind) AS kinds, CAST(sum(loss) AS BIGINT) AS loss, min(sequence) AS first_sequence, max(sequence) AS last_sequence FROM v_streams GROUP BY stream_id")
def observation_summary(spark, d):
    return read(spark, d, "v_streams").groupBy("stream_id").agg(
        F.count("*").alias("events"), F.countDistinct("kind").alias("kinds"), F.sum("loss").alias("loss"), F.min("sequence").alias("first_sequence"), F.max("sequence").alias("last_sequence"))


# Bodies

@_query("""
WITH RECURSIVE runs AS (
  SELECT e.body_id, e.block, e.target FROM v_successors AS e JOIN v_terminators AS t ON t.body_id = e.body_id AND t.block = e.block
  WHERE e.kind <> 'imaginary' AND (e.kind <> 'unwind' OR t.term_kind <> 'false_unwind')),
seen AS (SELECT body_id, block FROM v_terminators WHERE block = 0 UNION SELECT e.body_id, e.target FROM seen JOIN runs AS e ON e.body_id = seen.body_id AND e.block = seen.block),
sites AS (SELECT t.body_id, t.block, (t.term_kind <> 'false_unwind' AND coalesce(t.unwind IN ('continue', 'terminate'), false))
                 OR NOT EXISTS (SELECT 1 FROM runs AS e WHERE e.body_id = t.body_id AND e.block = t.block) AS leaves
          FROM v_terminators AS t JOIN seen ON seen.body_id = t.body_id AND seen.block = t.block),
n AS (SELECT body_id, count(*) + 1 AS nodes, count(*) FILTER (leaves) AS exits FROM sites GROUP BY body_id),
r AS (SELECT e.body_id, count(*) AS runtime FROM runs AS e JOIN seen ON seen.body_id = e.body_id AND seen.block = e.block GROUP BY e.body_id)
SELECT n.body_id, nodes, coalesce(runtime, 0) + exits AS edges, exits, CASE WHEN exits > 0 THEN coalesce(runtime, 0) + exits - nodes + 2 END AS cyclomatic FROM n LEFT JOIN r USING (body_id)""")
def cyclomatic_complexity(spark, d):
    return flow.cyclomatic(read(spark, d, "v_terminators"), read(spark, d, "v_successors"))


@_query("""
WITH c AS (
  SELECT t.body_id, t.block, t.term_kind, t.unwind, t.unwind_target, count(e.kind) AS n, count(*) FILTER (e.kind = 'normal') AS normal, count(*) FILTER (e.kind = 'otherwise') AS other, count(*) FILTER (e.kind = 'switch_value') AS switches,
         count(*) FILTER (e.kind = 'unwind') AS unwinds, count(*) FILTER (e.kind = 'imaginary') AS imaginary, count(DISTINCT e.switch_value) AS switch_values, min(e.target) FILTER (e.kind = 'unwind') AS unwinds_to,
         count(*) FILTER (e.switch_value IS NOT NULL AND NOT regexp_full_match(e.switch_value, '0|[1-9][0-9]{0,37}')) AS bad
  FROM v_terminators AS t LEFT JOIN v_successors AS e ON e.body_id = t.body_id AND e.block = t.block GROUP BY ALL),
x AS (SELECT *, CASE term_kind WHEN 'goto' THEN normal = 1 AND n = 1 AND unwind IS NULL WHEN 'switch_int' THEN other = 1 AND n = switches + 1 AND unwind IS NULL WHEN 'return' THEN n = 0 AND unwind IS NULL
                     WHEN 'false_edge' THEN normal = 1 AND imaginary = 1 AND n = 2 AND unwind IS NULL WHEN 'call' THEN normal <= 1 AND unwinds <= 1 AND n = normal + unwinds AND unwind IS NOT NULL END AS fits FROM c)
SELECT * FROM (SELECT body_id, block, term_kind, concat_ws(',', CASE WHEN bad > 0 OR switch_values < switches THEN 'switch_values' END,
         CASE WHEN coalesce(unwind, '') = 'cleanup' THEN CASE WHEN unwinds <> 1 OR unwinds_to <> unwind_target THEN 'unwind_edge' END WHEN unwinds > 0 THEN 'unwind_edge' END, CASE WHEN NOT fits THEN 'shape' END) AS rules FROM x)
WHERE rules <> ''""")
def terminator_shapes(spark, d):
    return flow.shape_violations(read(spark, d, "v_terminators"), read(spark, d, "v_successors"))


@_query("""
WITH RECURSIVE seen AS (
  SELECT body_id, block FROM v_blocks WHERE block = 0 UNION SELECT e.body_id, e.target FROM seen JOIN v_edges AS e ON e.body_id = seen.body_id AND e.block = seen.block),
reach AS (
  SELECT e.body_id, e.target AS block, b.defines AS local, b.block AS defined_in FROM v_blocks AS b JOIN seen ON seen.body_id = b.body_id AND seen.block = b.block JOIN v_edges AS e ON e.body_id = b.body_id AND e.block = b.block
  UNION SELECT e.body_id, e.target, r.local, r.defined_in FROM reach AS r JOIN v_blocks AS b ON b.body_id = r.body_id AND b.block = r.block AND b.defines <> r.local
        JOIN v_edges AS e ON e.body_id = r.body_id AND e.block = r.block)
SELECT r.body_id, r.block, r.local, r.defined_in FROM reach AS r JOIN v_blocks AS b ON b.body_id = r.body_id AND b.block = r.block AND b.uses = r.local""")
def reaching_definitions(spark, d):
    return flow.reaching_definitions(read(spark, d, "v_blocks"), read(spark, d, "v_edges"))


# Texts and scalars


@_query("""
WITH l AS (SELECT file_id, coalesce(text, '') AS t, string_split(coalesce(text, ''), chr(10)) AS x FROM v_files),
w AS (SELECT *, array_to_string(x[2:4], chr(10)) || CASE WHEN len(x) > 4 THEN chr(10) ELSE '' END AS "window" FROM l WHERE len(x) >= 2)
SELECT file_id, CAST(len(x) AS BIGINT) AS total_lines, CAST(strlen(x[1]) + 1 AS BIGINT) AS start_byte, "window", "window" <> t AS truncated FROM w""")
def source_windows(spark, d):
    return scalars.source_windows(read(spark, d, "v_files"), 2, 3)


@_query("""
WITH l AS (SELECT file_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM v_files)
SELECT file_id, i + 1 AS line, CAST(coalesce(sum(strlen(content) + 1) OVER (PARTITION BY file_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte, sha256(content) AS line_sha256 FROM l""")
def line_table(spark, d):
    return scalars.lines(read(spark, d, "v_files")).select("file_id", "line", "start_byte", F.sha2("content", 256).alias("line_sha256"))


@_query("""
SELECT file_id, CAST(len(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^ \\t\\r]'))) AS BIGINT) AS code_lines,
       CAST(len(regexp_extract_all(coalesce(text, ''), '[\\p{L}\\p{N}_]+|[^\\s\\p{L}\\p{N}_]')) AS BIGINT) AS tokens, CAST(strlen(coalesce(text, '')) AS BIGINT) AS bytes FROM v_files""")
def text_metrics(spark, d):
    return scalars.text_metrics(read(spark, d, "v_files"))


@_query("SELECT file_id, path, sha256(coalesce(text, '')) AS content_hash FROM v_files")
def file_hashes(spark, d):
    return read(spark, d, "v_files").select("file_id", "path", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"))


@_query("SELECT page_id, substr(trim(regexp_replace(html, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')), 1, 100) AS label FROM pages")
def short_labels(spark, d):
    return read(spark, d, "pages").select("page_id", scalars.short_label(F.col("html")).alias("label"))


@_query("""
SELECT p_partkey, CASE WHEN a IS NULL OR b IS NULL THEN CASE WHEN a = false OR b = false THEN 'inactive' ELSE 'unknown' END WHEN a AND b THEN 'active' ELSE 'inactive' END AS all_status,
       CASE WHEN a OR b THEN 'active' WHEN a = false AND b = false THEN 'inactive' ELSE 'unknown' END AS any_status
FROM (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM part)""")
def configuration_status(spark, d):
    status = lambda c: F.when(c % 3 == 0, "active").when(c % 3 == 1, "inactive").otherwise("unknown")
    parts = [status(F.col("p_partkey")), status(F.col("p_size"))]
    return read(spark, d, "part").select("p_partkey", scalars.status_all(parts).alias("all_status"), scalars.status_any(parts).alias("any_status"))


@_query("""
SELECT event_id, CAST(n AS STRING) AS number FROM (
  SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE TRY_CAST(concat('000', CAST(event_id AS STRING), '999999999999') AS DECIMAL(38,0)) END AS n FROM events)""")
def unsigned_numbers(spark, d):
    events = read(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit("-"), F.col("event_id").cast("string"))).otherwise(F.concat(F.lit("000"), F.col("event_id").cast("string"), F.lit("999999999999")))
    return events.select("event_id", scalars.unsigned64(text).cast("string").alias("number"))


# Retention


@_query("""
SELECT repository_id, context_id, snapshot_id, CAST(rank AS INT) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY repository_id, context_id ORDER BY sequence DESC, published_at DESC) AS rank FROM v_snapshots) WHERE rank <= 3""")
def newest_snapshots(spark, d):
    return history.newest(read(spark, d, "v_snapshots"), 3).select("repository_id", "context_id", "snapshot_id", "rank")


_PLAN = """
WITH r AS (SELECT *, row_number() OVER (PARTITION BY repository_id, context_id ORDER BY sequence DESC, published_at DESC) AS rank FROM v_snapshots),
plan AS (SELECT snapshot_id, bytes, concat_ws(',', CASE WHEN rank = 1 THEN 'head' END, CASE WHEN snapshot_id % 101 = 0 THEN 'pin' END, CASE WHEN rank <= 5 THEN 'recent' END,
                CASE WHEN published_at >= TIMESTAMP '1998-01-01' THEN 'grace' END) AS reasons FROM r) """


@_query(_PLAN + "SELECT snapshot_id, bytes, reasons = '' AS removable, reasons FROM plan")
def retention_plan(spark, d):
    snapshots = read(spark, d, "v_snapshots")
    return history.retention_plan(snapshots, snapshots.where("snapshot_id % 101 = 0").select("snapshot_id"), 5, F.lit("1998-01-01").cast("timestamp"))


@_query(_PLAN + "SELECT reasons, count(*) AS n, CAST(sum(bytes) AS BIGINT) AS bytes FROM plan GROUP BY reasons")
def retention_bytes(spark, d):
    return retention_plan(spark, d).groupBy("reasons").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))


# Mapping and frontier


@_query("""
WITH c AS (SELECT b.body_id, d.id, d.stop - d.start AS width FROM v_bodies AS b JOIN v_spans AS d ON b.file_id = d.file_id AND d.start <= b.start AND d.stop >= b.stop WHERE d.cfg_status <> 'inactive'
      AND CASE b.kind WHEN 'closure_or_coroutine' THEN d.kind = 'closure' WHEN 'constant' THEN false ELSE d.kind IN ('function', 'method') END),
least AS (SELECT body_id, id, width, rank() OVER (PARTITION BY body_id ORDER BY width) AS r FROM c),
best AS (SELECT body_id, count(*) AS n, min(id) AS id FROM least WHERE r = 1 GROUP BY body_id)
SELECT b.body_id, CASE WHEN n = 1 THEN best.id END AS definition_id, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'mapped' ELSE 'ambiguous' END AS state
FROM v_bodies AS b LEFT JOIN best ON best.body_id = b.body_id""")
def body_mapping(spark, d):
    return mapping.map_bodies(read(spark, d, "v_bodies"), read(spark, d, "v_spans"))


@_query("""
WITH chosen AS (SELECT id FROM v_definitions WHERE kind = 'function' ORDER BY id LIMIT 150),
r AS (SELECT *, source_id IN (SELECT id FROM chosen) AS f, coalesce(target_id IN (SELECT id FROM chosen), false) AS t FROM v_relations WHERE kind = 'calls')
SELECT source_id, id AS relation_id, CASE WHEN f AND target_id IS NULL THEN reason ELSE 'external_boundary' END AS reason FROM r WHERE (f AND target_id IS NULL) OR f <> t""")
def unknown_frontier(spark, d):
    return mapping.frontier(read(spark, d, "v_definitions").where("kind = 'function'"), read(spark, d, "v_relations"), 150)


@_query("""
WITH s AS (SELECT stream_id, pos, sequence + CASE WHEN stream_id % 4 = 0 AND pos % 5 = 0 THEN -1000000 ELSE 0 END AS t FROM v_streams),
l AS (SELECT *, lag(t) OVER (PARTITION BY stream_id ORDER BY pos) AS b FROM s)
SELECT stream_id, CASE WHEN NOT bool_or(coalesce(t < b, false)) THEN arg_max(t, pos) - arg_min(t, pos) END AS "interval" FROM l GROUP BY stream_id""")
def trace_intervals(spark, d):
    streams = read(spark, d, "v_streams")
    late = F.when((F.col("stream_id") % 4 == 0) & (F.col("pos") % 5 == 0), -1_000_000).otherwise(0)
    return mapping.matching_intervals(streams.withColumn("timestamp", F.col("sequence") + late))


@_query("""
SELECT CASE WHEN l.doc_id IS NULL THEN 'not_run' WHEN toxic IS NULL OR quality IS NULL THEN 'unknown' WHEN toxic = 1 AND quality = 0 THEN 'expected_fail' WHEN toxic = 1 THEN 'unexpected_pass'
            WHEN quality = 0 THEN 'fail' ELSE 'pass' END AS outcome, count(*) AS tests
FROM documents AS d LEFT JOIN labels AS l ON l.doc_id = d.doc_id GROUP BY 1""")
def test_outcomes(spark, d):
    rows = read(spark, d, "documents").select("doc_id").join(read(spark, d, "labels").withColumn("ran", F.lit(True)), "doc_id", "left")
    passed = F.col("quality") == 1
    return history.outcome_counts(rows.select(history.outcome(F.coalesce("ran", F.lit(False)), passed, F.col("toxic") == 1).alias("outcome")))


# Queries by subject; each module adds its own.
from factloom.queries import bodies, bundles, settings, source, traces, walks  # noqa: E402, F401
