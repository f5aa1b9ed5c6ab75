"""Tokens and syntax of Rust text against counted fixtures."""

import time

import pytest

from factloom.functions import lexer
from factloom.operators import syntax

SIMPLE = "fn event() {\n  // ignored\n  let x = 1;\n\n  /* ignored\n     too */\n  if x > 0 {\n    unsafe { call(); }\n  }\n}"
CASES = {
    "simple": SIMPLE,
    "one more line": SIMPLE.replace("  let x = 1;", "  let x = 1;\n  let y = 2;"),
    "deeper": SIMPLE.replace("unsafe { call(); }", "if ready { unsafe { call(); } }"),
    "compound": "fn event(){a::b();}",
    "raw": 'fn event() {\r\n let text = r#"first\r\n // not a comment\r\n   \r\n /* still literal */\r\n last"#;\r\n}',
    "literals": 'fn event() { let text = "unsafe { if value {} }"; /* unsafe { } */ }',
    "nesting": "fn event() { if a { while b { for x in y { match x { _ => loop { break; } } } } } else if c {} let c = || if d {}; let a = async { if e {} }; fn nested() { if f {} } }",
    "blocks": "fn event() { { unsafe { const { if a {} } } } }",
    "unsafe": "unsafe fn event() { let p: unsafe fn() = value; unsafe { unsafe { call(); } } unsafe fn nested() {} }",
    "attribute": "#[unsafe(no_mangle)] unsafe fn event() {}",
    "macros": "fn event() { macro_rules! make { () => { unsafe { if a {} } } } make!(); }",
    "broken": "fn event() { (] }",
    "unclosed": "fn event() { /* }",
    "bounds": "impl<T> A for B where for<'a> F: Fn(&'a u8) { fn event(&self) -> u8 { self.x | self.y } }",
    "closures": "fn event() { v.iter().map(|x| x + 1).fold(0, |a, b| { if a > b { a } else { b } }); let f = move |z: u8| match z { 0 => 1, _ => 2 }; }",
}


@pytest.fixture(scope="module")
def parsed(spark):
    files = spark.createDataFrame([(n, "// prefix: café\r\n" + t) for n, t in CASES.items()], "file_id string, text string")
    rows = syntax.brackets(lexer.tokens(files)).cache()
    return rows


def _words(text):
    return [text.encode()[a:b].decode() for kind, a, b in lexer.scan(text.encode()) if kind not in ("space", "comment")]


def test_tokens():
    assert _words("a::b<'x>('y', b'\\'', '\\u{1F600}', r##\"a\"#b\"##, 1..2, 1.5e-3f64, 0xFFu8, x.0.1, r#fn, \"\\\"\", 'é')") == [
        "a", ":", ":", "b", "<", "'x", ">", "(", "'y'", ",", "b'\\''", ",", "'\\u{1F600}'", ",", 'r##"a"#b"##', ",", "1", ".", ".", "2", ",", "1.5e-3f64", ",", "0xFFu8", ",", "x", ".", "0.1", ",", "r#fn", ",", '"\\""', ",", "'é'", ")"]
    assert _words("/* a /* b */ c */ d // e\nf") == ["d", "f"]
    assert [k for k, _, _ in lexer.scan(b"a /* /* */")] == ["ident", "space", "error"]
    text = "fn f() { 1.max(2) } // é\n".encode()
    assert b"".join(text[a:b] for _, a, b in lexer.scan(text)) == text


def test_long_texts_take_linear_time():
    for part in ("/* ", "'", "r#\"", "\"\\", "1.", "/**/", "((", "a!{"):
        began = time.time()
        sum(1 for _ in lexer.scan((part * 300_000).encode()))
        assert time.time() - began < 10, part


def test_metrics_of_counted_functions(parsed):
    found = {(r.file_id, r.name): (r.code_lines, r.tokens, r.max_nesting, r.unsafe_boundaries) for r in syntax.metrics(parsed).collect()}
    assert found["simple", "event"] == (6, 24, 1, 1)
    assert found["one more line", "event"] == (7, 29, 1, 1)
    assert found["deeper", "event"][2] == 2
    assert found["compound", "event"] == (1, 13, 0, 0)
    assert found["raw", "event"] == (6, 11, 0, 0)
    assert found["literals", "event"][2:] == (0, 0)
    assert found["nesting", "event"][2] == 5 and found["nesting", "nested"][2] == 1
    assert found["blocks", "event"][2] == 1
    assert found["unsafe", "event"][3] == 5 and found["unsafe", "nested"][3] == 1
    assert found["attribute", "event"][3] == 2
    assert found["macros", "event"][2:] == (0, 0) and found["macros", "event"][1] > 10
    assert found["bounds", "event"][2] == 0
    assert found["closures", "event"][2] == 2
    assert found["broken", "event"] == (None,) * 4


def test_nesting_sites_in_order(parsed):
    sites = syntax.enclosing(syntax.nesting_sites(parsed)).where("file_id = 'nesting'").orderBy("first").collect()
    assert [(s.kind, s.level - 1) for s in sites if s.level > 1] == [
        ("if", 1), ("while", 2), ("for", 3), ("match", 4), ("loop", 5), ("if", 2), ("closure", 1), ("if", 2), ("async_block", 1), ("if", 2), ("nested_function", 1), ("if", 2)]


def test_unsafe_boundaries_and_what_is_around_them(parsed):
    sites = syntax.enclosing(syntax.unsafe_sites(parsed)).where("file_id = 'unsafe'").orderBy("first").collect()
    assert [s.kind for s in sites] == ["function", "function_pointer_type", "block", "block", "function"]
    assert sites[0].parent is None and sites[2].parent == sites[0].first and sites[3].parent == sites[2].first
    assert [s.kind for s in syntax.unsafe_sites(parsed).where("file_id = 'attribute'").orderBy("first").collect()] == ["attribute", "function"]


def test_items_and_calls(spark):
    text = "mod m { pub struct A(u8); impl A { #[inline] pub fn go(&self) { self.run(x); helper::<u8>(); println!(\"{}\", f(1)); } } } trait T { fn need(&self); } enum E { X(u8), Y }"
    rows = syntax.brackets(lexer.tokens(spark.createDataFrame([(1, text)], "file_id long, text string")))
    found = {(r.kind, r.name): r for r in syntax.items(rows).collect()}
    assert set(found) == {("mod", "m"), ("struct", "A"), ("impl", None), ("function", "go"), ("trait", "T"), ("function", "need"), ("enum", "E")}
    assert found["function", "go"].parent == found["impl", None].first and found["impl", None].parent == found["mod", "m"].first
    assert found["function", "need"].body is None and found["struct", "A"].parent == found["mod", "m"].first
    made = {(r.name, r.kind) for r in syntax.calls(rows).collect()}
    assert ("run", "calls") in made and ("println", "macro_invocation") in made and ("f", "calls") not in made and ("go", "calls") not in made
    spans = syntax.items(rows).where("kind = 'function'")
    holders = {r.name: r.holder for r in syntax.held_by(syntax.calls(rows), spans).collect()}
    assert holders["run"] == found["function", "go"].first and holders["X"] is None


def test_flow_points_belong_to_the_innermost_body(spark):
    text = "fn f(a: Option<u8>) -> R { let g = |x: &dyn T| { if x { return 1; } x? }; for i in a { while b { continue; } } loop { break; } unsafe { h().await?; } fn inner() { match q { _ => return } } log!(if z { return }); }"
    rows = syntax.brackets(lexer.tokens(spark.createDataFrame([(1, text)], "file_id long, text string")))
    names = {r.first: r.name or "closure" for r in syntax.counters(rows).collect()}
    found = {}
    for r in syntax.flow_points(rows).orderBy("start", "kind").collect():
        found.setdefault(names[r.holder], []).append(r.kind)
    assert found == {
        "f": ["entry", "branch", "branch", "continue", "branch", "break", "unsafe", "await", "error_propagation"],
        "closure": ["entry", "branch", "return", "error_propagation"], "inner": ["entry", "branch", "return"],
    }
    counts = {r.name or "closure": tuple(r)[3:] for r in syntax.counters(rows).collect()}
    assert counts == {"f": (1, 3, 0, 1, 1), "closure": (1, 1, 1, 0, 0), "inner": (1, 1, 1, 0, 0)}


def test_files_of_one_split_are_dealt_and_batches_hold_whole_order(spark, monkeypatch):
    monkeypatch.setattr(lexer, "BATCH", 7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        files = spark.range(64, numPartitions=1).selectExpr("id AS file_id", "repeat('a(b); ', CAST(id % 3 AS INT)) AS text")
        found = lexer.tokens(files).selectExpr("*", "spark_partition_id() AS p").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len({r.p for r in found}) > 1
    for k in range(64):
        own = [r for r in found if r.file_id == k]
        assert [r.seq for r in own] == list(range(5 * (k % 3))) and "".join(r.word for r in own) == "a(b);" * (k % 3)


def test_tokens_are_read_once_and_joined_with_nothing(parsed):
    for found in (syntax.items(parsed), syntax.nesting_sites(parsed, functions=syntax.items(parsed).limit(0)), syntax.unsafe_sites(parsed), syntax.held_by(syntax.calls(parsed), syntax.items(parsed).limit(0))):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("InMemoryRelation") <= 2, plan
