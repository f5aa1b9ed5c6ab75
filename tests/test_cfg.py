"""Configuration predicates against a recursive reader in plain Python, and feature closures."""

import random

import pytest

from factloom.functions import cfg

CFG, FEATURES = {"unix": None, "target_os": "linux", "panic": "abort", "debug": None}, ["std", "extra"]


def _all(values, any_):
    if (True if any_ else False) in values:
        return any_
    return None if None in values else not any_


def _truth(p, unknown):
    op, *rest = p
    if op == "call":
        name, args = rest
        values = [_truth(a, unknown) for a in args]
        if name in ("all", "any"):
            return _all(values, name == "any")
        return (None if values[0] is None else not values[0]) if name == "not" and len(values) == 1 else None
    if op == "pair":
        key, value = rest
        if key == "feature":
            return None if unknown else value in FEATURES
        return CFG[key] == value if key in CFG else None
    if rest[0] in ("true", "false"):
        return rest[0] == "true"
    return CFG[rest[0]] is None if rest[0] in CFG else False if rest[0] == "test" else None


def _text(p, rng):
    gap = lambda: rng.choice(["", " ", "\n "])
    if p[0] == "call":
        return p[1] + gap() + "(" + (gap() + "," + gap()).join(_text(a, rng) for a in p[2]) + ("," if p[2] and rng.random() < 0.3 else "") + ")"
    return f'{p[1]}{gap()}={gap()}"{p[2]}"' if p[0] == "pair" else p[1]


def _random(rng, depth=3):
    if depth and rng.random() < 0.6:
        return ("call", rng.choice(["all", "any", "not", "not", "wild"]), [_random(rng, depth - 1) for _ in range(rng.randrange(4))])
    if rng.random() < 0.5:
        return ("pair", rng.choice(["feature", "target_os", "panic", "unix", "nope"]), rng.choice(["std", "linux", "abort", "other"]))
    return ("atom", rng.choice(["unix", "debug", "test", "windows", "true", "false", "panic"]))


def _evaluated(spark, texts, unknown=False):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "i int, predicate string")
    steps = cfg.parsed(rows)
    settings = F.create_map(*[x for k, v in CFG.items() for x in (F.lit(k), F.lit(v))]), F.array(*map(F.lit, FEATURES)), F.lit(unknown)
    found = rows.join(steps, "predicate", "left").withColumn("status", cfg.evaluate(F.col("steps"), *settings))
    return {r.i: r.status for r in found.collect()}


@pytest.mark.parametrize("unknown", [False, True])
def test_random_predicates(spark, unknown):
    rng = random.Random(unknown)
    made = [_random(rng) for _ in range(400)]
    found = _evaluated(spark, [_text(p, rng) for p in made], unknown)
    names = {True: "active", False: "inactive", None: "unknown"}
    for i, p in enumerate(made):
        assert found[i] == names[_truth(p, unknown)], p


def test_edges_of_the_rules(spark):
    cases = {
        "all()": "active", "any()": "inactive", "not()": "unknown", "not(unix, debug)": "unknown", "not(not(unix))": "active", "test": "inactive", "not(test)": "active", "windows": "unknown", "target_os": "inactive",
        'target_os = "linux"': "active", 'unix = "x"': "inactive", 'feature = "std"': "active", 'feature = "none"': "inactive", "any(windows, unix)": "active", "all(windows, test)": "inactive", "all(windows, unix)": "unknown",
        "wild(unix)": "unknown", "true": "active", "not(false)": "active", "all(unix": "unknown", "all(unix))": "unknown", "unix debug": "unknown", "": "unknown", "all(,)": "unknown", "feature = std": "unknown", "unix,": "unknown", 'target_os = "li\\"nux"': "inactive",
    }
    found = _evaluated(spark, list(cases))
    assert {t: found[i] for i, t in enumerate(cases)} == cases
    assert _evaluated(spark, [None]) == {0: "unknown"}


def test_features_enable_others(spark):
    declared = spark.createDataFrame([("a", "default", "std"), ("a", "std", "alloc"), ("a", "alloc", "std"), ("a", "extra", "dep:x"), ("b", "default", "more"), ("b", "more", None)], "package string, feature string, enables string")
    requested = spark.createDataFrame([("a", "default"), ("b", "default"), ("c", "left/right"), ("c", "own")], "package string, feature string")
    found = {tuple(r) for r in cfg.feature_closure(requested, declared).collect()}
    assert found == {("a", "default", True), ("a", "std", True), ("a", "alloc", True), ("b", "default", False), ("b", "more", False), ("c", "own", False)}


def test_feature_rounds_send_nothing_to_the_driver(spark, monkeypatch):
    from factloom.operators import graphs

    plans, cut = [], graphs._cut
    monkeypatch.setattr(graphs, "_cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    declared = spark.createDataFrame([("p", f"f{i}", f"f{i + 1}") for i in range(3)] + [("p", "f2", "dep:x")], "package string, feature string, enables string")
    found = cfg.feature_closure(spark.createDataFrame([("p", "f0")], "package string, feature string"), declared)
    assert sorted(tuple(r) for r in found.collect()) == [("p", f"f{i}", False) for i in range(4)]
    assert len(plans) > 2 and not any("Broadcast" in p for p in plans)
