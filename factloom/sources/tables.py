"""Readers of the driver tables and the views of code facts over them.

A view is one SELECT that Spark and the oracle run alike; the operators above it are DataFrame code, the oracles SQL.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

VIEWS = {
    "v_definitions": """
SELECT concat('part:', CAST(p_partkey AS STRING)) AS id, 'function' AS kind, p_name AS name, lower(p_name) AS name_key,
       CAST(NULL AS STRING) AS owner_id, CAST(p_size AS BIGINT) AS source_lines, CAST(p_partkey % 4 AS BIGINT) AS unsafe_blocks,
       CASE WHEN p_partkey % 3 = 0 THEN 'pub' ELSE 'private' END AS visibility,
       CASE WHEN p_partkey % 11 = 0 THEN 'inactive' WHEN p_partkey % 13 = 0 THEN 'unknown' ELSE 'active' END AS cfg_status FROM part
UNION ALL
SELECT concat('supplier:', CAST(s_suppkey AS STRING)), 'function', s_name, lower(s_name), concat('nation:', CAST(s_nationkey AS STRING)),
       CAST(s_suppkey % 97 AS BIGINT), CAST(s_suppkey % 2 AS BIGINT), 'pub', 'active' FROM supplier
UNION ALL
SELECT concat('customer:', CAST(c_custkey AS STRING)), 'struct', c_name, lower(c_name), concat('nation:', CAST(c_nationkey AS STRING)),
       CAST(c_custkey % 31 AS BIGINT), CAST(0 AS BIGINT), 'private', 'active' FROM customer
UNION ALL
SELECT concat('nation:', CAST(n_nationkey AS STRING)), 'module', n_name, lower(n_name), concat('region:', CAST(n_regionkey AS STRING)),
       CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'pub', 'active' FROM nation
UNION ALL
SELECT concat('region:', CAST(r_regionkey AS STRING)), 'module', r_name, lower(r_name), CAST(NULL AS STRING),
       CAST(1 AS BIGINT), CAST(0 AS BIGINT), 'pub', 'active' FROM region""",
    "v_relations": """
SELECT concat(CAST(l_orderkey AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING), ':', CAST(l_linenumber AS STRING)) AS id,
       concat('part:', CAST(l_partkey AS STRING)) AS source_id,
       CASE WHEN l_linenumber = 7 OR l_quantity > 49 THEN NULL ELSE concat('supplier:', CAST(l_suppkey AS STRING)) END AS target_id,
       CASE WHEN l_linenumber = 7 THEN 'external_boundary' WHEN l_quantity > 49 THEN 'indirect_target_unknown' END AS reason,
       CASE WHEN l_returnflag = 'R' THEN 'macro_invocation' ELSE 'calls' END AS kind,
       concat('evidence:', CAST(l_suppkey % 50 AS STRING)) AS evidence_id, l_orderkey AS span_start FROM lineitem""",
    "v_before": "SELECT p_partkey AS k, p_name AS name, p_brand AS signature, p_type AS body, CASE WHEN p_partkey % 3 = 0 THEN 'pub' ELSE 'private' END AS visibility, 'active' AS cfg_status, CAST(p_size AS STRING) AS source_span FROM part WHERE p_partkey % 17 <> 0",
    "v_after": """
SELECT p_partkey AS k, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN concat(p_brand, '+') ELSE p_brand END AS signature,
       CASE WHEN p_partkey % 7 = 0 THEN concat(p_type, '+') ELSE p_type END AS body,
       CASE WHEN p_partkey % 3 = 0 OR p_partkey % 23 = 0 THEN 'pub' ELSE 'private' END AS visibility, CASE WHEN p_partkey % 29 = 0 THEN 'inactive' ELSE 'active' END AS cfg_status,
       CAST(CASE WHEN p_partkey % 13 = 0 THEN p_size + 1 ELSE p_size END AS STRING) AS source_span FROM part WHERE p_partkey % 19 <> 0""",
    "v_streams": """
SELECT user_id AS stream_id, event_id AS sequence, event_type AS kind, props AS correlation_id, CAST(floor(value) AS BIGINT) AS loss,
       row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos FROM events""",
    "v_files": "SELECT doc_id AS file_id, concat(source, '/', CAST(doc_id AS STRING), '.rs') AS path, text FROM documents",
    "v_blocks": """
SELECT conv_id AS body_id, turn AS block, CASE WHEN role = 'user' THEN 'switch_int' ELSE 'goto' END AS term_kind,
       CAST(length(text) % 5 AS BIGINT) AS defines, CAST(length(text) % 3 AS BIGINT) AS uses FROM conversations""",
    "v_edges": """
SELECT c.conv_id AS body_id, c.turn AS block, n.turn AS target FROM conversations AS c JOIN conversations AS n ON c.conv_id = n.conv_id
WHERE n.turn = c.turn + 1 OR (c.role = 'user' AND n.turn = c.turn + 2) OR (c.role = 'assistant' AND length(c.text) % 4 = 0 AND n.turn = c.turn - 1)""",
    "v_spans": """
SELECT concat('part:', CAST(p_partkey AS STRING)) AS id, CAST(floor(p_partkey / 40) AS BIGINT) AS file_id, (p_partkey * 37) % 1000 AS start,
       (p_partkey * 37) % 1000 + p_size * 10 AS stop, CASE WHEN p_partkey % 11 = 0 THEN 'inactive' ELSE 'active' END AS cfg_status,
       CASE p_partkey % 6 WHEN 0 THEN 'struct' WHEN 1 THEN 'closure' WHEN 2 THEN 'method' ELSE 'function' END AS kind FROM part""",
    "v_bodies": """
SELECT c_custkey AS body_id, CAST(floor(c_custkey / 30) AS BIGINT) AS file_id, (c_custkey * 13) % 1000 AS start, (c_custkey * 13) % 1000 + c_custkey % 40 AS stop,
       CASE c_custkey % 5 WHEN 0 THEN 'closure_or_coroutine' WHEN 1 THEN 'associated_function' WHEN 2 THEN 'constant' ELSE 'function' END AS kind FROM customer""",
    "v_snapshots": """
SELECT o_orderkey AS snapshot_id, o_custkey % 20 AS repository_id, o_orderpriority AS context_id, o_orderkey AS sequence,
       o_orderdate AS published_at, CAST(floor(o_totalprice) AS BIGINT) AS bytes, o_orderstatus AS status FROM orders""",
    "v_call_graph": """
SELECT id, source_id, target_id, reason FROM v_relations
UNION ALL SELECT concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), '>'), concat('supplier:', CAST(l_suppkey AS STRING)), concat('customer:', CAST(o_custkey AS STRING)), NULL
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
UNION ALL SELECT concat(CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), '<'), concat('customer:', CAST(o_custkey AS STRING)), concat('part:', CAST(l_partkey AS STRING)), NULL
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1""",
    "v_flow_graph": """
SELECT concat(CAST(body_id AS STRING), ':', CAST(block AS STRING), '>', CAST(target AS STRING)) AS id, concat(CAST(body_id AS STRING), ':', CAST(block AS STRING)) AS source_id,
       concat(CAST(body_id AS STRING), ':', CAST(target AS STRING)) AS target_id FROM v_edges""",
    "v_terminators": """
SELECT conv_id AS body_id, turn AS block,
       CASE WHEN role = 'user' THEN 'switch_int' WHEN length(text) % 8 = 0 THEN 'false_edge' WHEN length(text) % 4 = 1 THEN 'goto' WHEN length(text) % 4 = 3 THEN 'return' ELSE 'call' END AS term_kind,
       CASE WHEN role = 'user' OR length(text) % 8 = 0 OR length(text) % 4 IN (1, 3) THEN NULL WHEN length(text) % 8 = 4 THEN 'cleanup' WHEN length(text) % 3 = 0 THEN 'continue' WHEN length(text) % 3 = 1 THEN 'terminate' END AS unwind,
       CASE WHEN role <> 'user' AND length(text) % 8 = 4 THEN turn - 1 END AS unwind_target FROM conversations""",
    "v_successors": """
SELECT c.conv_id AS body_id, c.turn AS block, n.turn AS target,
       CASE WHEN n.turn = c.turn + 1 THEN CASE WHEN c.role = 'user' THEN 'otherwise' ELSE 'normal' END WHEN n.turn = c.turn + 2 THEN 'switch_value' WHEN length(c.text) % 8 = 0 THEN 'imaginary' ELSE 'unwind' END AS kind,
       CASE WHEN n.turn = c.turn + 2 THEN CASE WHEN length(c.text) % 7 = 0 THEN '01' ELSE CAST(length(c.text) AS STRING) END END AS switch_value
FROM conversations AS c JOIN conversations AS n ON c.conv_id = n.conv_id
WHERE n.turn = c.turn + 1 OR (c.role = 'user' AND n.turn = c.turn + 2) OR (c.role <> 'user' AND length(c.text) % 4 = 0 AND n.turn = c.turn - 1)""",
    "v_flow_bodies": "SELECT conv_id AS body_id, CAST(2 AS BIGINT) AS arguments FROM conversations GROUP BY conv_id",
    "v_flow_locals": " UNION ALL ".join(f"SELECT body_id, CAST({k} AS BIGINT) AS local FROM v_flow_bodies" for k in range(6)),
    "v_flow_blocks": "SELECT conv_id AS body_id, turn AS block, CAST(length(text) % 4 AS BIGINT) AS statements, CASE WHEN length(text) % 13 = 0 THEN 'yield' WHEN role = 'user' THEN 'switch_int' ELSE 'call' END AS term_kind FROM conversations",
    "v_flow_effects": " UNION ALL ".join(
        f"SELECT conv_id AS body_id, turn AS block, CAST({i} AS BIGINT) AS step, '{action}' AS action, CAST(({local}) % 6 AS BIGINT) AS local FROM conversations WHERE length(text) % 4 >= {i} AND {when}"
        for i in range(4)
        for action, local, when in (
            ("def", f"length(text) + {7 * i} + turn", f"(length(text) + {i}) % 3 <> 0"), ("use", f"length(text) * 3 + {i}", "true"), ("use", f"turn + {i}", f"length(text) % 2 = {i % 2}"),
            ("move", f"turn * 5 + {i}", f"(length(text) + turn + {i}) % 5 = 0"), ("storage_dead", f"length(text) + {i}", f"(length(text) + {2 * i}) % 7 = 0"), ("storage_live", f"turn + {3 * i}", f"(length(text) + {i}) % 8 = 0"),
        )),
    "v_flow_unknowns": """
SELECT conv_id AS body_id, turn AS block, CAST(0 AS BIGINT) AS step, 'pointer_aliasing' AS effect FROM conversations WHERE length(text) % 23 = 0
UNION ALL SELECT conv_id, turn, CAST(length(text) % 4 AS BIGINT), 'call' FROM conversations WHERE role <> 'user' AND length(text) % 9 = 0""",
    "v_cfg": """
SELECT p_partkey AS id, p_partkey % 3 AS context, CASE p_partkey % 4 WHEN 0 THEN concat('all(', a, ', ', b, ')') WHEN 1 THEN concat('any(', a, ',not( ', b, ' ))') WHEN 2 THEN concat('not(all(', a, ', any(', b, ', ', c, '),))') ELSE a END AS predicate
FROM (SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'unix' WHEN 1 THEN 'windows' WHEN 2 THEN 'test' WHEN 3 THEN 'feature = "std"' ELSE 'target_os="linux"' END AS a,
        CASE p_size % 3 WHEN 0 THEN 'unix' WHEN 1 THEN 'any()' ELSE 'feature = "std"' END AS b, CASE p_size % 2 WHEN 0 THEN 'test' ELSE 'windows' END AS c FROM part) AS atoms""",
    "v_features": """
SELECT p_size % 7 AS package, concat('f', CAST(p_partkey AS STRING)) AS feature, concat('f', CAST(CAST(floor(p_partkey / 3) AS BIGINT) AS STRING)) AS enables FROM part
UNION ALL SELECT p_size % 7, concat('f', CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 2 = 0 THEN 'dep:other' ELSE concat('f', CAST(p_partkey + 21 AS STRING)) END FROM part WHERE p_partkey % 19 = 0""",
    "v_bundle_tests": """
SELECT doc_id % 40 AS bundle_id, row_number() OVER (PARTITION BY doc_id % 40 ORDER BY doc_id) - 1 AS ordinal, CASE WHEN doc_id % 61 = 0 THEN '' ELSE concat('test_', CAST(doc_id AS STRING)) END AS name,
  CASE WHEN doc_id % 13 = 0 THEN 'timeout' WHEN doc_id % 37 = 0 THEN 'passed' WHEN quality = 1 THEN 'pass' ELSE 'fail' END AS outcome, CASE WHEN doc_id % 29 = 0 THEN '1e9' ELSE CAST(doc_id AS STRING) END AS elapsed_ns,
  CASE WHEN doc_id % 2 = 0 THEN '5000' END AS timeout_ns, CAST(NULL AS STRING) AS reason, concat('part:', CAST(doc_id % 300 AS STRING)) AS definition FROM labels""",
    "v_bundle_streams": """
SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY user_id) - 1 AS stream_pos, user_id, concat('s', CAST(CASE WHEN user_id % 31 = 0 THEN 0 ELSE user_id END AS STRING)) AS stream_id,
  'p' AS process_or_device, 't' AS thread_or_hart, CASE WHEN user_id % 17 = 0 THEN '' ELSE concat('clock', CAST(user_id % 3 AS STRING)) END AS clock_domain, 'us' AS timestamp_unit
FROM (SELECT DISTINCT user_id % 40 AS bundle_id, user_id FROM events) AS u""",
    "v_bundle_events": """
SELECT s.bundle_id, s.stream_pos, row_number() OVER (PARTITION BY s.bundle_id, s.stream_pos ORDER BY e.event_id) - 1 AS event_pos, CAST(CASE WHEN e.event_id % 101 = 0 THEN 1 ELSE e.event_id END AS STRING) AS sequence,
  CAST(e.event_id * 7 AS STRING) AS timestamp, e.event_type AS kind, CASE WHEN e.event_id % 3 = 0 THEN concat('part:', CAST(e.event_id % 220 AS STRING)) END AS definition_id, e.props AS correlation_id,
  CASE WHEN e.event_id % 89 = 0 THEN '-1' END AS loss_count FROM events AS e JOIN v_bundle_streams AS s ON s.user_id = e.user_id""",
    "v_rust": """
SELECT p_partkey AS file_id, concat('// ', p_name, ' { (', chr(10), 'pub fn f', CAST(p_partkey AS STRING), '(a: u32) {', chr(10),
  CASE WHEN p_partkey % 2 = 0 THEN concat('  if a > 0 { unsafe { call(a); } }', chr(13), chr(10)) ELSE '' END,
  CASE p_partkey % 3 WHEN 0 THEN concat('  for x in a.iter() { while x { loop { break; } } } /* { if', chr(10), ' a */', chr(10)) WHEN 1 THEN concat('  let c = |y| match y { _ => go(1.5, 0x1F, b::d) };', chr(10), chr(10))
    ELSE concat('  let s = r#"if { unsafe {', chr(10), '  ', chr(10), ' // "#;', chr(10)) END,
  CASE WHEN p_partkey % 5 = 0 THEN concat('  log!("{}", if a { run() });', chr(10)) ELSE '' END, CASE WHEN p_partkey % 7 = 0 THEN concat('  return a.b().await?;', chr(10)) ELSE '' END, '}', chr(10),
  CASE WHEN p_partkey % 4 = 0 THEN concat('unsafe fn g(p: unsafe fn()) { fn h() { if a {} else if b {} } }', chr(10)) ELSE '' END) AS text FROM part""",
    "v_states": """
SELECT p_partkey AS file_id, concat('fn step(mut state: State, n: u8) { ', CASE WHEN p_partkey % 5 = 0 THEN 'log!(n); ' ELSE '' END, 'match state { State::S', CAST(p_partkey % 7 AS STRING), CASE WHEN p_partkey % 3 = 0 THEN ' if n > 2' ELSE '' END,
  ' => state = State::S', CAST((p_partkey + 1) % 7 AS STRING), ', State::S', CAST((p_partkey + 2) % 7 AS STRING), ' => { state = State::T; } ', CASE WHEN p_partkey % 4 = 0 THEN 'State::X(y) => state = State::T, ' ELSE '' END, '_ => {} } }') AS text FROM part""",
    "v_flow_returns": "SELECT conv_id AS body_id, turn AS block, CAST((length(text) + turn) % 6 AS BIGINT) AS local FROM conversations WHERE role <> 'user'",
}


def _deps(sql: str) -> list[str]:
    return [n for n in (*TABLES, *VIEWS) if re.search(rf"\b(FROM|JOIN) {n}\b", sql)]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table, or a view over driver tables."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _select(spark, sf_dir, VIEWS[name])


def branches(spark: SparkSession, sf_dir: str, name: str) -> list[DataFrame]:
    """The tables that a view of the form SELECT UNION ALL SELECT is the union of, each with the columns of the view."""
    schema = read(spark, sf_dir, name).schema
    tables = [_select(spark, sf_dir, sql).toDF(*schema.names) for sql in re.split(r"\bUNION ALL\b", VIEWS[name])]
    return [t.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema]) for t in tables]


def _select(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    deps = _deps(sql)
    sql = sql.replace("{", "{{").replace("}", "}}")
    for d in deps:
        sql = re.sub(rf"\b(FROM|JOIN) {d}\b", rf"\1 {{{d}}}", sql)
    return spark.sql(sql, **{d: read(spark, sf_dir, d) for d in deps})


def with_views(sql: str) -> str:
    """SQL for the oracle: the views that it names as common table expressions before its own."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", sql)]
    recursive = re.match(r"\s*WITH RECURSIVE\b", sql)
    own = re.sub(r"^\s*WITH (RECURSIVE )?", "", sql) if re.match(r"\s*WITH\b", sql) else None
    for n in used:  # views of views come first
        used = [x for x in _deps(VIEWS[n]) if x in VIEWS and x not in used] + used
    ctes = ", ".join(f"{n} AS ({VIEWS[n]})" for n in sorted(used, key=list(VIEWS).index))
    if not used:
        return sql
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}" + (f", {own}" if own else f" {sql}")
