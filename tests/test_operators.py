"""Operators on small fixtures with known answers."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import facts, flow, graphs, history, mapping


def _edges(spark, pairs):
    return spark.createDataFrame([(str(i), a, b, "calls") for i, (a, b) in enumerate(pairs)], "id string, source_id string, target_id string, kind string")


def test_components_of_a_small_graph(spark):
    rows = graphs.components(_edges(spark, [("a", "b"), ("b", "a"), ("b", "c"), ("d", "d")])).collect()
    assert {(r.id, r.component, r.recursive) for r in rows} == {("a", "a", True), ("b", "a", True), ("c", "c", False), ("d", "d", True)}


def test_components_equal_mutual_reachability(spark):
    rng = random.Random(4)
    pairs = [(f"{g}{rng.randrange(6)}", f"{g}{rng.randrange(6)}") for g in "abcdef" for _ in range(8)]
    reach = set(pairs)
    while more := {(a, d) for a, b in reach for c, d in reach if b == c} - reach:
        reach |= more
    nodes = set(itertools.chain(*pairs))
    expected = {n: min([n, *(m for m in nodes if (n, m) in reach and (m, n) in reach)]) for n in nodes}
    assert {r.id: r.component for r in graphs.components(_edges(spark, pairs)).collect()} == expected


def test_rounds_of_components_follow_the_logarithm_of_a_path(spark, monkeypatch):
    """Before, a path of n components took n rounds of n joins."""
    cuts = []
    monkeypatch.setattr(graphs, "_cut", lambda df, f=graphs._cut: cuts.append(1) or f(df))
    pairs = [(i, i + 1) for i in range(40)] + [(i + 1, i) for i in range(0, 40, 5)] + [(i, i + 100) for i in range(3)]
    edges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "id long, source_id long, target_id long")
    found = {r.id: (r.component, r.size) for r in graphs.components(edges).collect()}
    expected = {i: (i // 5 * 5, 2) if i % 5 < 2 else (i, 1) for i in range(40)} | {40: (40, 1)} | {i: (i, 1) for i in range(100, 103)}
    assert found == expected and len(cuts) < 16


def test_parts_that_no_task_searches_whole_give_the_same_components(spark, monkeypatch):
    pairs = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("e", "d"), ("x", "y"), ("y", "x"), ("z", "z")]
    for size in (3, 0):
        monkeypatch.setattr(graphs, "PART", size)
        found = {r.id: r.component for r in graphs.components(_edges(spark, pairs)).collect()}
        assert found == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "d", "x": "x", "y": "x", "z": "z"}


def test_no_edges_have_no_components(spark):
    assert graphs.components(_edges(spark, [])).count() == 0


def test_shortest_paths_take_the_parent_visited_first(spark):
    rows = graphs.shortest_paths(_edges(spark, [("r", "b"), ("r", "c"), ("b", "z"), ("c", "y"), ("y", "t"), ("z", "t"), ("z", "t"), ("t", None)]), "r").collect()
    assert {(r.id, r.level, r.parent) for r in rows} == {("r", 0, None), ("b", 1, "r"), ("c", 1, "r"), ("z", 2, "b"), ("y", 2, "c"), ("t", 3, "z")}
    assert {r.id: (r.path, r.relation_id) for r in rows}["t"] == (["r", "b", "z", "t"], "5")


def test_fan_metrics_count_unknown_sites(spark):
    nodes = spark.createDataFrame([("a", 5, 0, "pub"), ("b", 5, 1, "private")], "id string, source_lines long, unsafe_blocks long, visibility string")
    rows = {r.id: r for r in facts.fan_metrics(nodes, _edges(spark, [("a", "b"), ("a", "b"), ("a", None)])).collect()}
    assert (rows["a"].distinct_callees, rows["a"].outgoing_call_sites, rows["a"].unknown_call_sites) == (1, 3, 1)
    assert (rows["b"].distinct_callers, rows["b"].incoming_call_sites, rows["b"].outgoing_call_sites) == (1, 2, 0)


def test_distributions_of_nothing_are_no_rows(spark):
    empty = spark.createDataFrame([], "source_lines long, distinct_callers long, distinct_callees long, unsafe_blocks long")
    assert facts.distributions(empty).count() == 0


def test_ownership_tells_cycles_and_missing_owners(spark):
    rows = spark.createDataFrame([("r", None), ("a", "r"), ("b", "a"), ("c", "gone"), ("x", "y"), ("y", "x")], "id string, owner_id string")
    found = {r.id: (r.root, r.state) for r in facts.ownership(rows).collect()}
    assert found["b"] == ("r", "rooted") and found["c"] == ("c", "missing_owner") and found["x"] == (None, "cyclic")


def test_ownership_of_a_deep_chain_is_no_cycle(spark):
    rows = [("0", None)] + [(str(i), str(i - 1)) for i in range(1, 40)] + [("loop", "loop"), ("tail", "loop")]
    found = {r.id: (r.root, r.steps, r.state) for r in facts.ownership(spark.createDataFrame(rows, "id string, owner_id string")).collect()}
    assert all(found[str(i)] == ("0", i, "rooted") for i in range(40))
    assert found["loop"] == found["tail"] == (None, None, "cyclic")


def test_unreachable_blocks_define_nothing(spark):
    blocks = spark.createDataFrame([(1, 0, 5, 9), (1, 1, 6, 5), (1, 2, 7, 9), (1, 3, 8, 7)], "body_id long, block long, defines long, uses long")
    edges = spark.createDataFrame([(1, 0, 1), (1, 2, 3), (1, 1, 3)], "body_id long, block long, target long")
    rows = flow.reaching_definitions(blocks, edges).collect()
    assert {(r.block, r.local, r.defined_in) for r in rows} == {(1, 5, 0)}


def test_outcomes(spark):
    rows = spark.createDataFrame([(False, None, None), (True, None, True), (True, True, False), (True, False, False), (True, True, True), (True, False, True)], "ran boolean, passed boolean, expected boolean")
    named = rows.select(history.outcome(F.col("ran"), F.col("passed"), F.col("expected")).alias("outcome"))
    assert [r.outcome for r in named.collect()] == ["not_run", "unknown", "pass", "fail", "unexpected_pass", "expected_fail"]
    assert {tuple(r) for r in history.outcome_counts(named.where("outcome = 'pass'")).collect()} == {("pass", 1)}
    with pytest.raises(Exception, match="no outcome"):
        history.outcome_counts(spark.createDataFrame([("passed",)], "outcome string")).collect()


@pytest.mark.parametrize(
    "edges, expected",
    [
        ([(0, 1)], (3, 2, 1, 1)),
        ([(0, 1), (0, 2)], (4, 4, 2, 2)),
        ([(0, 1), (0, 1), (0, 1), (1, 2)], (4, 5, 1, 3)),
        ([(0, 1), (1, 0)], (3, 2, 0, None)),
    ],
)
def test_cyclomatic(spark, edges, expected):
    blocks = spark.createDataFrame([(1, b) for b in sorted(set(itertools.chain(*edges)))], "body_id long, block long")
    row = flow.cyclomatic(
        blocks.selectExpr("*", "'goto' AS term_kind", "CAST(NULL AS STRING) AS unwind"), spark.createDataFrame([(1, a, b, "normal") for a, b in edges], "body_id long, block long, target long, kind string")
    ).first()
    assert (row.nodes, row.edges, row.exits, row.cyclomatic) == expected


def _streams(spark, *sides):
    rows = [(s, i, i, k, c, 0) for s, side in enumerate(sides) for i, (k, c) in enumerate(side)]
    return spark.createDataFrame(rows, "stream_id long, pos long, sequence long, kind string, correlation_id string, loss long")


@pytest.mark.parametrize(
    "before, after, expected",
    [
        ([("p", None), ("c", "17"), ("q", None), ("x", None)], [("c", "17"), ("e", None), ("x", None)], ("17", 1, "event_kind")),
        ([("s", "0"), ("c", "a"), ("c", "b")], [("s", "0"), ("c", "b"), ("c", "a")], ("0", 1, "semantic_anchor")),
        ([("s", "0"), ("c", "a")], [("s", "0")], ("0", 1, "selected_window_event_count")),
        ([("c", "r"), ("c", "r")], [("c", "r"), ("c", "r")], (None, 0, None)),
        ([("s", "0"), ("t", None)], [("s", "0"), ("t", None)], ("0", 2, None)),
    ],
)
def test_traces(spark, before, after, expected):
    pairs = spark.createDataFrame([(0, 1)], "before long, after long")
    row = history.align_traces(_streams(spark, before, after), pairs).first()
    assert (row.anchor, row.matching, row.reason) == expected


def test_loss_is_that_of_the_whole_stream(spark):
    rows = [(0, 0, "p", None, 3), (0, 1, "c", "17", None), (1, 0, "c", "18", 1), (1, 1, "c", "19", 9007199254740993)]
    streams = spark.createDataFrame(rows, "stream_id long, pos long, kind string, correlation_id string, loss long")
    row = history.align_traces(streams, spark.createDataFrame([(0, 1)], "before long, after long")).first()
    assert (row.anchor, row.before_loss, row.after_loss) == (None, "3", "9007199254740994")


def test_diff_of_repeated_keys_is_ambiguous(spark):
    a = spark.createDataFrame([(1, "x", "o1"), (2, "y", "o2"), (2, "z", "o3"), (4, None, "o4"), (5, "q", "o5")], "k int, body string, id string")
    b = spark.createDataFrame([(1, "w", "n1"), (2, "y", "n2"), (3, "n", "n3"), (4, None, "n4")], "k int, body string, id string")
    found = {tuple(r) for r in history.structural_diff(a, b, ["k"], ["body"], "id").select("k", "change", "correspondence", "before_id", "after_id", "fields").collect()}
    assert found == {
        (1, "modified", "unique_structural_key", "o1", "n1", "body"), (2, "removed", "ambiguous", "o2", None, ""), (2, "removed", "ambiguous", "o3", None, ""),
        (2, "added", "ambiguous", None, "n2", ""), (3, "added", "unmatched", None, "n3", ""), (5, "removed", "unmatched", "o5", None, ""),
    }


def test_unsigned_numbers(spark):
    texts = ["18446744073709551615", "18446744073709551616", "-1", "1e9", "", "007", None]
    found = spark.createDataFrame([(t,) for t in texts], "t string").select(scalars.unsigned64(F.col("t")).cast("string").alias("n")).collect()
    assert [r.n for r in found] == ["18446744073709551615", None, None, None, None, "7", None]


def test_lines_count_bytes(spark):
    files = spark.createDataFrame([(1, "é\nb\n"), (2, None)], "file_id int, text string")
    assert [tuple(r) for r in scalars.lines(files).orderBy("file_id", "line").collect()] == [(1, 1, 0, "é"), (1, 2, 3, "b"), (1, 3, 5, ""), (2, 1, 0, "")]


def test_search_limits(spark):
    with pytest.raises(ValueError):
        facts.search(spark.createDataFrame([], "id string, name_key string"), "a", limit=201)


def test_a_body_meets_definitions_of_all_stretches(spark):
    definitions = [("file", 1, 0, 9000, "active"), ("f", 1, 2000, 4000, "active"), ("g", 1, 2000, 2000, "active"), ("off", 1, 2990, 3100, "inactive"), ("other", 2, 0, 9000, "active"), ("h", 1, 5000, 6000, "active"), ("i", 1, 5000, 6000, "active")]
    definitions = [(*d, "function") for d in definitions] + [("type", 1, 2999, 3051, "active", "struct"), ("inner", 1, 7000, 7100, "active", "closure"), ("m", 1, 6900, 7200, "active", "method")]
    definitions = spark.createDataFrame(definitions, "id string, file_id int, start int, stop int, cfg_status string, kind string")
    bodies = [(1, 1, 3000, 3050, "function"), (2, 1, 3900, 4100, "function"), (3, 1, 5100, 5200, "function"), (4, 3, 0, 1, "function"), (5, 1, 8999, 9001, "function")]
    bodies += [(6, 1, 7010, 7020, "closure_or_coroutine"), (7, 1, 7010, 7020, "associated_function"), (8, 1, 7010, 7020, "constant"), (9, 1, 3000, 3050, "closure_or_coroutine")]
    rows = {r.body_id: (r.definition_id, r.state) for r in mapping.map_bodies(spark.createDataFrame(bodies, "body_id int, file_id int, start int, stop int, kind string"), definitions).collect()}
    assert rows == {1: ("f", "mapped"), 2: ("file", "mapped"), 3: (None, "ambiguous"), 4: (None, "none"), 5: (None, "none"), 6: ("inner", "mapped"), 7: ("m", "mapped"), 8: (None, "none"), 9: (None, "none")}


def test_shapes_of_all_terminators(spark):
    blocks, edges = [], []

    def block(kind, *successors, unwind=None, to=None):
        blocks.append((0, len(blocks), kind, unwind, to))
        edges.extend((0, len(blocks) - 1, *(x if isinstance(x, tuple) else (x, 9, None))) for x in successors)

    block("goto", "normal"), block("switch_int", "otherwise", ("switch_value", 3, "0"), ("switch_value", 3, str(2**128 - 1))), block("return"), block("unwind_terminate", unwind="terminate")
    block("drop", "normal", "coroutine_drop", "unwind", unwind="cleanup", to=9), block("call", unwind="continue"), block("assert", "normal", unwind="unreachable"), block("yield", "resume")
    block("false_edge", "normal", "imaginary"), block("inline_asm", "normal", "normal", "normal", unwind="continue"), block("false_unwind", "normal", "unwind", unwind="cleanup", to=9)
    right = len(blocks)
    block("goto"), block("goto", "normal", unwind="continue"), block("return", "normal"), block("unwind_terminate"), block("call", "normal"), block("yield", "normal"), block("novel")
    block("call", "normal", "unwind", unwind="cleanup", to=8), block("call", "unwind", unwind="continue"), block("switch_int", "otherwise", ("switch_value", 1, "1"), ("switch_value", 2, "1"))
    block("switch_int", "otherwise", ("switch_value", 1, "007")), block("switch_int", "otherwise", ("switch_value", 1, str(2**128))), block("goto", ("normal", 1, "4")), block(None)
    found = flow.shape_violations(
        spark.createDataFrame(blocks, "body_id int, block int, term_kind string, unwind string, unwind_target int"), spark.createDataFrame(edges, "body_id int, block int, kind string, target int, switch_value string")
    )
    rules = {r.block - right: r.rules for r in found.collect()}
    assert rules == {**dict.fromkeys(range(7), "shape"), 7: "unwind_edge", 8: "unwind_edge", 9: "switch_values", 10: "switch_values", 11: "switch_values", 12: "switch_values", 13: "shape"}


def test_exits_by_unwinding_and_edges_that_never_run(spark):
    blocks = [(0, 0, "call", "continue"), (0, 1, "return", None), (0, 2, "return", None), (1, 0, "false_edge", None), (1, 1, "goto", None), (2, 0, "false_unwind", "continue"), (2, 1, "return", None)]
    edges = [(0, 0, 1, "normal"), (1, 0, 1, "normal"), (1, 0, 0, "imaginary"), (1, 1, 0, "normal"), (2, 0, 1, "normal"), (2, 0, 0, "unwind")]
    found = flow.cyclomatic(spark.createDataFrame(blocks, "body_id int, block int, term_kind string, unwind string"), spark.createDataFrame(edges, "body_id int, block int, target int, kind string"))
    assert {r.body_id: (r.nodes, r.edges, r.exits, r.cyclomatic) for r in found.collect()} == {0: (3, 3, 2, 2), 1: (3, 2, 0, None), 2: (3, 2, 1, 1)}


def test_source_windows_by_line_and_offset(spark):
    texts = ["a\nbé\n😀😀\nd", "", "one", "é\n", "x\n\n\ny", None]
    cases = [(i, t, byte) for i, t in enumerate(texts) for byte in range(-1, len((t or "").encode()) + 2)]
    files = spark.createDataFrame([(100 * i + byte + 1, t, byte) for i, t, byte in cases], "file_id int, text string, byte int")
    for most in (4, 5, 6, 7, 100):
        expected = {}
        for i, t, byte in cases:
            data = (t or "").encode()
            if not 0 <= byte <= len(data) or (byte < len(data) and data[byte] & 0xC0 == 0x80):
                continue
            line = data[:byte].count(b"\n") + 1
            parts = (t or "").splitlines(keepends=True) if t and not t.endswith("\n") else (t or "").splitlines(keepends=True) + [""]
            start = len("".join(parts[: line - 1]).encode())
            window = "".join(parts[line - 1 : line + 1]).encode()[:most].decode(errors="ignore")
            expected[100 * i + byte + 1] = (len(parts), start, window, window != (t or ""))
        found = scalars.source_windows(files, scalars.line_at(F.col("text"), F.col("byte")), 2, most=most).collect()
        assert {r.file_id: (r.total_lines, r.start_byte, r.window, r.truncated) for r in found} == expected


def test_merged_coverage_keeps_the_order_of_reasons(spark):
    parts = [("cfg_unknown", 4_294_967_294), ("syntax_only", 2), ("syntax_only", 3), ("cfg_unknown", 9), ("syntax_only", 4), ("missing_dependency", 7), ("other", 1)]
    found = facts.merge_coverage(spark.createDataFrame(parts, "reason string, n long")).orderBy(F.asc_nulls_last("ordinal")).collect()
    assert [(r.reason, r.n, r.ordinal) for r in found] == [("missing_dependency", 7, 0), ("cfg_unknown", 4_294_967_295, 1), ("syntax_only", 9, 9), ("other", 1, None)]
    said = spark.createDataFrame([(0, "shared"), (1, "shared"), (2, "shared"), (3, "after")], "place long, limitation string")
    assert [r.limitation for r in facts.merge_limitations(said).orderBy("first").collect()] == ["shared", "after"]
