"""Observation bundles from JSON, their rules and pages; prefixes under budgets."""

import json
import random

import pytest
from pyspark.sql import functions as F

from factloom.operators import budgets, observations


def _bundle(tests=2, streams=(2, 0, 3), **change):
    made = {
        "schema_version": 1, "snapshot_id": "s", "artifact": {"sha256": "0" * 64, "source_id": "a", "context_id": "c", "producer": "p"}, "limitations": [],
        "tests": [{"name": f"t{i}", "outcome": "pass", "elapsed_ns": "5", "timeout_ns": None, "reason": None, "definition_ids": ["d1"]} for i in range(tests)],
        "streams": [{"id": f"s{k}", "process_or_device": "p", "thread_or_hart": "t", "clock_domain": f"c{k % 2}", "timestamp_unit": "ns",
                     "events": [{"sequence": str(2**53 + i), "timestamp": str(2**54 + 7 * i), "kind": "k", "definition_id": None, "correlation_id": None, "loss_count": None} for i in range(n)]} for k, n in enumerate(streams)],
    }
    return made | change


def _unpacked(spark, *bundles):
    return observations.unpack(spark.createDataFrame([(json.dumps(b),) for b in bundles], "value string"))


def test_pages_run_over_tests_then_streams(spark):
    found = _unpacked(spark, _bundle(), _bundle())  # equal texts are one bundle
    assert found.bundles.count() == 1
    page = lambda offset, limit: ([(r.section, r.stream_pos, r.position) for r in observations.page(found.tests, found.events, offset, limit)[0].orderBy("index").collect()], observations.page(found.tests, found.events, offset, limit)[1].first())
    rows, status = page(1, 3)
    assert rows == [("tests", None, 1), ("events", 0, 0), ("events", 0, 1)] and status.next_offset == 4 and status.truncated
    rows, status = page(4, 200)
    assert rows == [("events", 2, 0), ("events", 2, 1), ("events", 2, 2)] and status.next_offset is None and not status.truncated
    assert page(7, 1)[0] == [] and page(7, 1)[1].state == "page"
    assert page(8, 1)[0] == [] and page(8, 1)[1].state == "out_of_range"
    for offset, limit in ((0, 0), (0, 201), (-1, 5)):
        with pytest.raises(ValueError):
            observations.page(found.tests, found.events, offset, limit)
    summary = observations.summary(found.tests, found.streams, found.events).first()
    assert (summary.tests, summary.events, summary.clock_domains, len(summary.limitations)) == (2, 5, ["c0", "c1"], 2)


def test_each_rule_is_named(spark):
    event = _bundle()["streams"][0]["events"][0]
    stream = lambda **c: _bundle()["streams"][0] | c
    test = lambda **c: _bundle()["tests"][0] | c
    cases = {
        "test_without_name": _bundle(tests=0) | {"tests": [test(name="")]}, "unknown_outcome": _bundle() | {"tests": [test(outcome="passed")]}, "test_number": _bundle() | {"tests": [test(elapsed_ns="1e9")]},
        "timeout_without_cap": _bundle() | {"tests": [test(outcome="timeout")]}, "test_of_missing_definition": _bundle() | {"tests": [test(definition_ids=["d1", "other"])]}, "test_beyond_budget": _bundle() | {"tests": [test(name="x" * 257)]},
        "too_many_tests": _bundle(tests=1001), "too_many_streams": _bundle(streams=(0,) * 65), "duplicate_stream": _bundle() | {"streams": [stream(), stream()]}, "stream_without_name": _bundle() | {"streams": [stream(id="")]},
        "stream_without_clock": _bundle() | {"streams": [stream(clock_domain="")]}, "stream_beyond_budget": _bundle() | {"streams": [stream(thread_or_hart="é" * 65)]},
        "event_number": _bundle() | {"streams": [stream(events=[event | {"timestamp": str(2**64)}])]}, "sequence_not_increasing": _bundle() | {"streams": [stream(events=[event, event])]},
        "event_of_missing_definition": _bundle() | {"streams": [stream(events=[event | {"definition_id": "other"}])]}, "event_without_kind": _bundle() | {"streams": [stream(events=[event | {"kind": ""}])]}, "event_beyond_budget": _bundle() | {"streams": [stream(events=[event | {"correlation_id": "x" * 129}])]},
        "": _bundle() | {"tests": [test(outcome="timeout", timeout_ns=str(2**64 - 1))]},
    }
    texts = {f"observation:{__import__('hashlib').sha256(json.dumps(b).encode()).hexdigest()}": rule for rule, b in cases.items()}
    found = _unpacked(spark, *cases.values())
    known = spark.createDataFrame([("d1",)], "id string")
    rules = {}
    for r in observations.violations(found.tests, found.streams, found.events, known).collect():
        rules.setdefault(texts[r.bundle_id], set()).add(r.rule)
    assert rules == {rule: {rule} for rule in cases if rule}


def test_a_broken_text_is_an_error(spark):
    with pytest.raises(Exception, match="MALFORMED|malformed"):
        observations.unpack(spark.createDataFrame([('{"tests": [',)], "value string")).tests.collect()


def test_chosen_streams(spark):
    found = _unpacked(spark, _bundle() | {"streams": [*_bundle()["streams"], _bundle()["streams"][0]]})
    bundle = found.bundles.first().bundle_id
    ids = spark.createDataFrame([(bundle, "s0"), (bundle, "s1"), (bundle, "zz")], "bundle_id string, stream_id string")
    assert {r.stream_id: (r.state, r.stream_pos) for r in observations.chosen_streams(found.streams, found.events, ids).collect()} == {"s0": ("ambiguous", None), "s1": ("one", 1), "zz": ("missing", None)}


def test_prefixes_equal_a_running_sum(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(400), "x" * rng.randrange(30)) for _ in range(1000)]
    df = spark.createDataFrame(rows, "k long, t string").repartition(7)
    ordered = sorted(rows)
    sums, total = [], 0
    for _, t in ordered:
        total += len(t)
        sums.append(total)
    every = budgets.running(df, ["k", "t"], F.length("t").cast("long")).orderBy("place").collect()
    assert [(r.k, r.t, r.place, r.bytes) for r in every] == [(*r, i + 1, s) for i, (r, s) in enumerate(zip(ordered, sums, strict=True))]
    for most_rows, most_bytes in ((50, None), (None, 700), (50, 300), (5000, 10**9), (0, None), (None, 0)):
        found = budgets.prefix(df, ["k", "t"], most_rows, most_bytes, F.length("t").cast("long"))
        kept = sum((most_rows is None or i < most_rows) and (most_bytes is None or s <= most_bytes) for i, s in enumerate(sums))
        assert found.rows.count() == kept and found.truncated == (kept < len(rows))
    with pytest.raises(budgets.OverBudget):
        budgets.prefix(df, ["k", "t"], 10, strict=True)
    assert budgets.prefix(df, ["k", "t"], 1000, strict=True).rows.count() == 1000
    assert budgets.prefix(df.limit(0), ["k"], 5, 5).rows.count() == 0
