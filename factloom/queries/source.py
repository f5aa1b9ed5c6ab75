"""Tokens, items, calls and metrics of source text.

The SQL takes tokens by one pattern (the texts of the view have no nested comments) and knows the syntax of a text from how the view
builds it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.functions import lexer
from factloom.operators import syntax, transitions
from factloom.registry import _query
from factloom.sources.tables import read

_PATTERN = r"""//[^\n]*|/\*[^*]*\*/|r#"[^"]*"#|"[^"]*"|[0-9][0-9A-Za-z_]*(?:\.[0-9]+)?|[A-Za-z_]\w*|\s+|."""
_LIST = "regexp_extract_all({}, '" + _PATTERN + "')"
_CODE = "x NOT LIKE '//%' AND x NOT LIKE '/*%' AND regexp_matches(x, '\\S')"
#: The functions of each text and where they begin; f's text ends before g's.
_FUNCTIONS = """
texts AS (SELECT file_id, text, instr(text, 'pub fn f') AS f_at, CASE WHEN file_id % 4 = 0 THEN instr(text, 'unsafe fn g(') END AS g_at FROM v_rust),
functions AS (
  SELECT file_id, concat('f', file_id) AS name, f_at - 1 AS start, substr(text, f_at, coalesce(g_at, length(text) + 1) - f_at - 1) AS own,
    greatest(CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END, CASE file_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 0 END) AS max_nesting, CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END AS unsafe_boundaries FROM texts
  UNION ALL SELECT file_id, 'g', g_at - 1, 'unsafe fn g(p: unsafe fn()) { fn h() { if a {} else if b {} } }', 3, 2 FROM texts WHERE g_at IS NOT NULL
  UNION ALL SELECT file_id, 'h', g_at - 1 + 30, 'fn h() { if a {} else if b {} }', 2, 0 FROM texts WHERE g_at IS NOT NULL)"""


def _syntax(spark, d):
    return syntax.brackets(lexer.tokens(read(spark, d, "v_rust")))


@_query(f"""
WITH found AS (SELECT file_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM (SELECT file_id, {_LIST.format("text")} AS l FROM v_rust)),
placed AS (SELECT *, sum(strlen(x)) OVER (PARTITION BY file_id ORDER BY i) AS stop FROM found)
SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY i) - 1 AS seq, CASE WHEN x LIKE 'r#"%' OR x LIKE '"%' THEN 'string' WHEN regexp_matches(x, '^[0-9]') THEN 'number' WHEN regexp_matches(x, '^\\w') THEN 'ident' ELSE 'punct' END AS kind,
  CASE WHEN x LIKE 'r#"%' OR x LIKE '"%' OR regexp_matches(x, '^[0-9]') THEN NULL ELSE x END AS word, CAST(stop - strlen(x) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop
FROM placed WHERE {_CODE}""")
def source_tokens(spark, d):
    return lexer.tokens(read(spark, d, "v_rust")).select("file_id", "seq", "kind", "word", "start", "stop")


@_query(f"""
WITH {_FUNCTIONS.strip()}
SELECT file_id, name, CAST(start AS BIGINT) AS start, CAST(start + strlen(own) AS BIGINT) AS stop,
  CAST(len(list_filter(string_split(regexp_replace(own, '/\\*[^*]*\\*/', chr(10), 'g'), chr(10)), lambda x: regexp_matches(x, '\\S'))) AS BIGINT) AS code_lines,
  CAST(len(list_filter({_LIST.format("own")}, lambda x: {_CODE})) AS BIGINT) AS tokens, CAST(max_nesting AS BIGINT) AS max_nesting, CAST(unsafe_boundaries AS BIGINT) AS unsafe_boundaries, 'partial' AS status FROM functions""")
def lexical_metrics(spark, d):
    return syntax.metrics(_syntax(spark, d)).drop("first")


@_query("""
WITH made AS (
  SELECT file_id, 'calls' AS kind, 'call' AS name, concat('f', file_id) AS holder FROM v_rust WHERE file_id % 2 = 0
  UNION ALL SELECT file_id, 'calls', CASE file_id % 3 WHEN 0 THEN 'iter' ELSE 'go' END, concat('f', file_id) FROM v_rust WHERE file_id % 3 < 2
  UNION ALL SELECT file_id, 'calls', 'b', concat('f', file_id) FROM v_rust WHERE file_id % 7 = 0
  UNION ALL SELECT file_id, 'macro_invocation', 'log', concat('f', file_id) FROM v_rust WHERE file_id % 5 = 0)
SELECT file_id, kind, name, holder, 'syntax_only' AS reason FROM made""")
def syntax_calls(spark, d):
    rows = _syntax(spark, d)
    functions = syntax.items(rows).where("kind = 'function' and body is not null")
    held = syntax.held_by(syntax.calls(rows), functions)
    owners = functions.select("file_id", F.col("first").alias("holder"), F.col("name").alias("owner"))
    return held.join(owners, ["file_id", "holder"], "left").select("file_id", "kind", "name", F.col("owner").alias("holder"), F.lit("syntax_only").alias("reason"))


@_query(f"""
WITH {_FUNCTIONS.strip()}
SELECT file_id, 'function' AS kind, name, CASE WHEN name = 'h' THEN 'g' END AS parent FROM functions""")
def syntax_items(spark, d):
    found = syntax.items(_syntax(spark, d))
    outer = found.select("file_id", F.col("first").alias("parent"), F.col("name").alias("owner"))
    return found.join(outer, ["file_id", "parent"], "left").select("file_id", "kind", "name", F.col("owner").alias("parent"))


@_query(f"""
WITH {_FUNCTIONS.strip()}
SELECT file_id, name, CAST(length(own) - length(replace(own, chr(10), '')) + 1 AS BIGINT) AS lines,
  CAST(CASE name WHEN 'g' THEN 0 WHEN 'h' THEN 2 ELSE CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END + CASE WHEN file_id % 3 = 0 THEN 3 ELSE 0 END END AS BIGINT) AS branches,
  CAST(name LIKE 'f%' AND file_id % 7 = 0 AS BIGINT) AS returns, CAST(name LIKE 'f%' AND file_id % 7 = 0 AS BIGINT) AS awaits, CAST(name LIKE 'f%' AND file_id % 2 = 0 AS BIGINT) AS unsafe_blocks FROM functions
UNION ALL SELECT file_id, NULL, 1, 1, 0, 0, 0 FROM v_rust WHERE file_id % 3 = 1""")
def function_counters(spark, d):
    return syntax.counters(_syntax(spark, d)).select("file_id", "name", "lines", "branches", "returns", "awaits", "unsafe_blocks")


@_query(f"""
WITH {_FUNCTIONS.strip()}, points AS (
  SELECT file_id, 'entry' AS kind, 1 AS n FROM functions UNION ALL SELECT file_id, 'entry', 1 FROM texts WHERE file_id % 3 = 1
  UNION ALL SELECT file_id, 'branch', CASE WHEN file_id % 2 = 0 THEN 1 ELSE 0 END + CASE file_id % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE WHEN file_id % 4 = 0 THEN 2 ELSE 0 END FROM texts
  UNION ALL SELECT file_id, 'unsafe', 1 FROM texts WHERE file_id % 2 = 0 UNION ALL SELECT file_id, 'break', 1 FROM texts WHERE file_id % 3 = 0
  UNION ALL SELECT file_id, unnest(['return', 'await', 'error_propagation']), 1 FROM texts WHERE file_id % 7 = 0)
SELECT file_id, kind, CAST(sum(n) AS BIGINT) AS points FROM points GROUP BY file_id, kind HAVING sum(n) > 0""")
def flow_points(spark, d):
    return syntax.flow_points(_syntax(spark, d)).groupBy("file_id", "kind").agg(F.count("*").alias("points"))


def _transitions(spark, d):
    files = read(spark, d, "v_states")
    selections = files.select(F.col("file_id").alias("selection"), "file_id", F.lit("step").alias("function"), F.lit("State").alias("enum"), F.lit("state").alias("state"))
    return transitions.transitions(syntax.brackets(lexer.tokens(files)), selections)


@_query("""
SELECT p_partkey AS selection, concat('S', p_partkey % 7) AS from_variant, concat('S', (p_partkey + 1) % 7) AS to_variant, p_partkey % 3 = 0 AS guarded FROM part WHERE p_partkey % 5 <> 0
UNION ALL SELECT p_partkey, concat('S', (p_partkey + 2) % 7), 'T', false FROM part WHERE p_partkey % 5 <> 0""")
def state_transitions(spark, d):
    return _transitions(spark, d).candidates.select("selection", "from_variant", "to_variant", F.col("guard").isNotNull().alias("guarded"))


@_query("""
SELECT p_partkey AS selection, 'macro' AS reason, CAST(1 AS BIGINT) AS n FROM part WHERE p_partkey % 5 = 0
UNION ALL SELECT p_partkey, 'unsupported_arm', CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 1 END FROM part WHERE p_partkey % 5 <> 0""")
def state_unknowns(spark, d):
    return _transitions(spark, d).unknowns.groupBy("selection", "reason").agg(F.count("*").alias("n"))
