"""Reaching definitions: hand-made bodies, and random ones against every path and a plain worklist."""

import random

import pytest

from factloom.operators import dataflow as D


class Body:
    """A body of five locals; blocks: lists of steps (dicts of action -> locals, and unknown), the last is the terminator."""

    def __init__(self, blocks, edges, arguments=1, returns=(), kinds=None):
        self.blocks, self.edges, self.arguments, self.returns, self.kinds = blocks, edges, arguments, list(returns), kinds or {}

    def rows(self, i):
        yield "bodies", (i, self.arguments)
        for local in range(5):
            yield "locals", (i, local)
        for b, steps in enumerate(self.blocks):
            yield "blocks", (i, b, len(steps) - 1, self.kinds.get(b, "goto"))
            for s, step in enumerate(steps):
                for action, held in step.items():
                    for x in held:
                        yield ("unknowns", (i, b, s, x)) if action == "unknown" else ("effects", (i, b, s, action, x))
        for b, t, kind in self.edges:
            yield "edges", (i, b, t, kind)
        for b, local in self.returns:
            yield "returns", (i, b, local)


SCHEMAS = {
    "bodies": "body_id long, arguments long", "locals": "body_id long, local long", "blocks": "body_id long, block long, statements long, term_kind string", "effects": "body_id long, block long, step long, action string, local long",
    "unknowns": "body_id long, block long, step long, effect string", "edges": "body_id long, block long, target long, kind string", "returns": "body_id long, block long, local long",
}


def frames(spark, bodies):
    rows = {name: [] for name in SCHEMAS}
    for i, body in enumerate(bodies):
        for name, row in body.rows(i):
            rows[name].append(row)
    return [spark.createDataFrame(rows[name], schema) for name, schema in SCHEMAS.items()]


def solve(body):
    """{(point, local): (reaching, bare, changed)} by a worklist over whole states."""
    name = lambda b, s: f"statement {b}:{s}" if s < len(body.blocks[b]) - 1 else f"terminator {b}"
    suspends = {b for b, _, kind in body.edges if kind in ("resume", "coroutine_drop")} | {b for b, kind in body.kinds.items() if kind == "yield"}
    start = {(local, "entry" if 1 <= local <= body.arguments else None) for local in range(5)}
    states, todo, uses, defined, effects = {0: (start, False)}, [0], {}, set(), {}

    def run(b, record=False):
        facts, tainted = set(states[b][0]), states[b][1]
        for s, step in enumerate(body.blocks[b]):
            unknown = set(step.get("unknown", [])) | ({"external_state"} if b in suspends and s == len(body.blocks[b]) - 1 else set())
            if record:
                for local in {*step.get("use", []), *step.get("move", [])}:
                    found = {p for x, p in facts if x == local}
                    uses[name(b, s), local] = ({p for p in found if p}, None in found, tainted or bool(unknown))
                if unknown:
                    effects[name(b, s)] = sorted(unknown)
                defined.update((local, name(b, s)) for local in step.get("def", []))
            for local in [*step.get("move", []), *step.get("storage_live", []), *step.get("storage_dead", [])]:
                facts = {f for f in facts if f[0] != local} | {(local, None)}
            for local in step.get("def", []):
                facts = {f for f in facts if f[0] != local} | {(local, name(b, s))}
            tainted |= bool(unknown)
        return facts, tainted

    while todo:
        b = todo.pop()
        facts, tainted = run(b)
        for x, t, kind in body.edges:
            if x != b or kind == "imaginary":
                continue
            out = set(facts)
            for y, local in body.returns:
                if y == b and kind == "normal":
                    out = {f for f in out if f[0] != local} | {(local, f"normal_return {b}:{t}")}
            old = states.get(t, (set(), False))
            new = (old[0] | out, old[1] | tainted)
            if new != old or t not in states:
                states[t] = new
                todo.append(t)
    for b in states:
        run(b, True)
    defined |= {(local, "entry") for local in range(1, body.arguments + 1)}
    defined |= {(local, f"normal_return {b}:{t}") for b, t, kind in body.edges for y, local in body.returns if y == b and kind == "normal" and b in states}
    return uses, defined, effects, set(states)


def found(spark, bodies, **limits):
    flow = D.reaching_definitions(*frames(spark, bodies), **limits)
    out = [({}, set(), {}, set()) for _ in bodies]
    for r in flow.uses.collect():
        assert (r.point, r.local) not in out[r.body_id][0]
        out[r.body_id][0][r.point, r.local] = (set(r.reaching), r.may_be_uninitialized, r.possibly_changed_by_unknown_memory)
    for r in flow.definitions.collect():
        out[r.body_id][1].add((r.local, r.point))
    for r in flow.unknown_effects.collect():
        out[r.body_id][2][r.point] = r.effects
    for r in flow.reachable.collect():
        out[r.body_id][3].add(r.block)
    return out, {r.body_id: r for r in flow.bodies.collect()}


def use(*locals_):
    return {"use": list(locals_)}


CASES = {
    "reads come before assignments": Body([[{"def": [1], "use": [1]}, {"def": [1], "use": [1]}, {"def": [0], "use": [1]}, use(0)]], []),
    "diamond": Body([[use(1)], [{"def": [2, 3]}, {}], [{"def": [2]}, {}], [use(2, 3)]], [(0, 1, "switch_value"), (0, 2, "otherwise"), (1, 3, "normal"), (2, 3, "normal")]),
    "loop": Body([[use(1), {}], [{"def": [1], "use": [1]}, {}], [use(1)]], [(0, 1, "normal"), (1, 0, "switch_value"), (1, 2, "otherwise")]),
    "call": Body([[{"use": [1], "unknown": ["call"]}], [use(1)], [use(1)]], [(0, 1, "normal"), (0, 2, "unwind")], returns=[(0, 1)]),
    "suspension": Body([[use(1)], [use(1)], [use(1)]], [(0, 1, "resume"), (0, 2, "coroutine_drop")], kinds={0: "yield"}),
    "moves and storage": Body([[{"def": [2], "use": [1], "move": [1]}, use(1, 2), {"storage_live": [2]}, {"def": [3], "use": [2]}, {"storage_dead": [3]}, use(3)]], []),
    "unknown memory": Body([[use(1), {}], [{"use": [1], "unknown": ["pointer_aliasing", "partial_write"]}, {}], [{}], [{"def": [1]}, use(1)]], [(0, 1, "switch_value"), (0, 2, "otherwise"), (1, 3, "normal"), (2, 3, "normal")]),
    "imaginary": Body([[use(1)], [{"def": [1], "use": [4], "unknown": ["inline_assembly"]}, use(1)]], [(0, 1, "imaginary")]),
}


def test_hand_made_bodies(spark):
    names = list(CASES)
    out, status = found(spark, list(CASES.values()))
    for body, got in zip(CASES.values(), out, strict=True):
        assert got == solve(body)
    of = {n: got[0] for n, got in zip(names, out, strict=True)}
    assert of["reads come before assignments"]["terminator 0", 0][0] == {"statement 0:2"}
    assert of["diamond"]["terminator 3", 2] == ({"statement 1:0", "statement 2:0"}, False, False)
    assert of["diamond"]["terminator 3", 3] == ({"statement 1:0"}, True, False)
    assert of["loop"]["statement 0:0", 1][0] == {"entry", "statement 1:0"}
    assert of["call"]["terminator 1", 1] == ({"normal_return 0:1"}, False, True) and of["call"]["terminator 2", 1] == ({"entry"}, False, True)
    assert all(of["suspension"][f"terminator {b}", 1] == ({"entry"}, False, True) for b in range(3))
    moved = of["moves and storage"]
    assert moved["statement 0:1", 1] == (set(), True, False) and not moved["statement 0:1", 2][1] and moved["statement 0:3", 2][1] and moved["terminator 0", 3][1]
    assert of["unknown memory"]["terminator 3", 1] == ({"statement 3:0"}, False, True) and not of["unknown memory"]["statement 0:0", 1][2]
    assert out[names.index("imaginary")][3] == {0} and len(of["imaginary"]) == 1
    assert {names[i]: r.coverage for i, r in status.items() if r.coverage == "complete"}.keys() == {"reads come before assignments", "diamond", "loop", "moves and storage"}


def _random(rng, loops):
    n = rng.randrange(2, 7)
    pick = lambda p: [x for x in range(5) if rng.random() < p]
    blocks = [[{"def": pick(0.25), "use": pick(0.3), "move": pick(0.1), "storage_live": pick(0.08), "storage_dead": pick(0.08), "unknown": ["call"] * (rng.random() < 0.08)} for _ in range(rng.randrange(1, 4))] for _ in range(n)]
    edges = {(b, rng.randrange(n) if loops else rng.randrange(b + 1, n), rng.choice(D.EDGES)) for b in range(n) for _ in range(rng.randrange(3)) if loops or b + 1 < n}
    return Body(blocks, sorted(edges), rng.randrange(3), [(b, rng.randrange(5)) for b in range(n) if rng.random() < 0.3], {b: "yield" for b in range(n) if rng.random() < 0.1})


@pytest.mark.parametrize("loops", [False, True])
def test_random_bodies_equal_a_worklist(spark, loops):
    rng = random.Random(loops)
    bodies = [_random(rng, loops) for _ in range(60)]
    assert found(spark, bodies)[0] == [solve(b) for b in bodies]


def test_limits_claim_nothing(spark):
    out, status = found(spark, [CASES["call"], CASES["reads come before assignments"]], max_blocks=2)
    assert out[0] == ({}, set(), {}, set()) and status[0].truncated and status[0].coverage == "partial"
    assert out[1][0] and not status[1].truncated
    assert not any(o[0] for o in found(spark, [CASES["call"]], max_locals=1)[0])


def test_broken_bodies_are_named(spark):
    good, bad = CASES["diamond"], Body([[{"use": [9]}]], [(0, 7, "sideways")], arguments=6, returns=[(0, 8)])
    rows = frames(spark, [good, bad])
    bodies, locals_, blocks, effects, _, edges, returns = rows
    blocks = blocks.where("body_id = 0 OR block <> 0").unionByName(spark.createDataFrame([(1, 3, 0, "goto"), (1, 3, 0, "goto")], blocks.schema))
    rules = {(r.body_id, r.rule): r.n for r in D.violations(bodies, locals_, blocks, effects, edges, returns).collect()}
    assert set(rules) == {(1, r) for r in ("no_entry_block", "duplicate_block", "missing_argument_or_return_local", "effect_of_missing_local", "return_to_missing_local", "effect_outside_the_block", "unknown_edge_kind", "missing_successor")}
    assert rules[1, "missing_argument_or_return_local"] == 2
