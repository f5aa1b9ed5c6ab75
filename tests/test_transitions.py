"""State transitions: supported arms, and all that withholds them."""

from factloom.functions import lexer
from factloom.operators import syntax, transitions

SIMPLE = "fn event(mut state: State) { match state { State::Idle => state = State::Ready, State::Ready => { state = State::Done; }, _ => {} } }"
ARMS = [
    "State::Idle | State::Ready => state = State::Done", "State::Idle(value) => state = State::Done", "State::Idle { value } => state = State::Done", "State::Idle => { action(); state = State::Done; }",
    "State::Idle => { state = State::Ready; state = State::Done; }", "State::Idle => { if true { state = State::Done; } }", "State::Idle => state += State::Done", "State::Idle => self.state = State::Done", "State::Idle => *state = State::Done",
    "State::Idle => state = State::Done(value)", "State::Idle if check() => state = State::Done", "State::Idle if { state = State::Ready; true } => state = State::Done", "#[cfg(any())] State::Idle => state = State::Done",
]
WITHHELD = [SIMPLE.replace("{ match state", "{ %s match state" % x, 1) for x in ("let state = State::Done;", "{ let state = State::Done; }", "let alias = state;", "let alias = &mut state;", "change_state!();", "fn nested(state: State) {}")]
WITHHELD += [SIMPLE.replace("mut state: State", x) for x in ("state: &mut State", "ref mut state: State", "other: State", '#[cfg(feature = "x")] mut state: State')]
WITHHELD += ["#[rewrite_body]\n" + SIMPLE, "fn event(mut state: State) { match state { State::Idle => state = } ", 'fn event(mut state: State) { let text = "match state { State::Idle => state = State::Done }"; /* state = State::Done */ fn inner() { match state { State::Idle => state = State::Done, _ => {} } } }']
CASES = {
    "simple": SIMPLE, "guard": "// snow: 雪\r\nfn event(mut r#state: State, ready: bool) {\r\n match r#state { State::Idle if ready && true => { r#state = State::Ready; }, _ => {} }\r\n}",
    "local": "fn event() { let mut state = State::Idle; match state { State::Idle => state = State::Ready, _ => {} }; if true { match state { State::Ready => state = State::Done, _ => {} } } }",
    "compared": "fn event(mut state: State, n: u8) { match state { State::Idle if n == 1 || n <= 4 => state = State::Ready, State::Ready if n = 2 => state = State::Done } }",
    "other": SIMPLE.replace("state = State::Ready", "other = State::Ready"), "wrong": SIMPLE.replace("state = State::Ready", "state = Other::Ready"),
} | {f"withheld {i}": t for i, t in enumerate(WITHHELD)} | {f"arm {i}": f"fn event(mut state: State) {{ match state {{ {arm}, _ => {{}} }} }}" for i, arm in enumerate(ARMS)}


def test_transitions(spark):
    files = spark.createDataFrame(list(CASES.items()), "file_id string, text string")
    selections = spark.createDataFrame([(n, n, "event", "State", "state") for n in CASES], "selection string, file_id string, function string, enum string, state string")
    found = transitions.transitions(syntax.brackets(lexer.tokens(files)), selections)
    pairs, unknown = {}, {}
    for r in found.candidates.orderBy("first").collect():
        pairs.setdefault(r.selection, []).append((r.from_variant, r.to_variant, r.guard))
    for r in found.unknowns.collect():
        unknown.setdefault(r.selection, set()).add(r.reason)
    assert pairs == {
        "simple": [("Idle", "Ready", None), ("Ready", "Done", None)], "guard": [("Idle", "Ready", "if ready & & true")], "local": [("Idle", "Ready", None)], "compared": [("Idle", "Ready", 'if n = = " | | n < = "')],
        "other": [("Ready", "Done", None)], "wrong": [("Ready", "Done", None)],
    }
    assert unknown["simple"] == {"unsupported_arm"} and "nested_match" in unknown["local"]
    assert all(unknown.get(n) for n in CASES if n.startswith(("withheld 0", "withheld 1", "withheld 2", "withheld 3", "withheld 4", "withheld 5", "withheld 6", "withheld 7", "withheld 8", "withheld 9", "arm")) and n not in ("withheld 11",))


def test_functions_held_by_functions(spark):
    """Tokens of an inner chosen function are its own, and of two choices of one function each has its arms."""
    inner = SIMPLE.replace("fn event", "fn inner").replace("Done", "Last")
    outer = SIMPLE[:-1] + inner + " match state { State::Done => state = State::Idle } }"
    files = spark.createDataFrame([(1, outer)], "file_id long, text string")
    selections = spark.createDataFrame([("a", 1, "event", "State", "state"), ("b", 1, "inner", "State", "state"), ("c", 1, "inner", "State", "state")], "selection string, file_id long, function string, enum string, state string")
    rows = syntax.brackets(lexer.tokens(files))
    found = transitions.transitions(rows, selections).candidates
    pairs = sorted((r.selection, r.from_variant, r.to_variant) for r in found.collect())
    of = lambda name, last: [(name, "Idle", "Ready"), (name, "Ready", last)]
    assert pairs == sorted([*of("a", "Done"), ("a", "Done", "Idle"), *of("b", "Last"), *of("c", "Last")])
    known = syntax.items(rows).where("kind = 'function' and body is not null").select("file_id", "name", "first", "last", "body")
    assert sorted(known.collect()) == sorted(syntax.functions(rows).collect())
