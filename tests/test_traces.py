"""Trace windows: anchors, divergences, intervals, losses; and the scalar rules that they rest on."""

import pytest
from pyspark.sql import functions as F

from factloom.functions import scalars
from factloom.operators import traces

EVENT = "stream_id string, pos long, sequence string, timestamp string, kind string, correlation_id string, loss string"


def _stream(name, events, step=7):
    """events: (kind, correlation) or (kind, correlation, loss, timestamp)."""
    return [(name, i, str(2**53 + i), e[3] if len(e) > 3 else str(2**54 + step * i), e[0], e[1], e[2] if len(e) > 2 else None) for i, e in enumerate(events)]


def _compare(spark, before, after, offsets=(0, 0), **limits):
    rows = spark.createDataFrame(_stream("b", before) + _stream("a", after, 70), EVENT)
    pairs = spark.createDataFrame([("b", "a", *offsets)], "before string, after string, before_offset long, after_offset long")
    found = traces.compare_windows(rows, pairs, **limits).collect()
    assert len(found) == 1
    return found[0]


def test_the_first_divergence_after_the_anchor(spark):
    r = _compare(spark, [("prefix", None), ("checkpoint", "packet:17"), ("queue_switch", None), ("exit", None)], [("checkpoint", "packet:17"), ("external_effect", None), ("exit", None)])
    assert (r.anchor, r.matching, r.compared, r.reason, r.before_sequence, r.before_kind, r.after_kind) == ("packet:17", 1, 2, "event_kind", str(2**53 + 2), "queue_switch", "external_effect")


def test_intervals_are_each_streams_own(spark):
    r = _compare(spark, [("k", "x"), ("k", None)], [("k", "x"), ("k", None)])
    assert (r.before_interval, r.after_interval, r.reason, r.matching, r.state, r.truncated) == ("7", "70", None, 2, "compared", False)


def test_a_clock_that_goes_back_within_the_prefix_has_no_interval(spark):
    late = [("k", "x", None, "50"), ("k", None, None, "40"), ("other", None, None, "60")]
    r = _compare(spark, late, [("k", "x"), ("k", None), ("k", None)])
    assert r.before_interval is None and r.after_interval == "70" and r.matching == 2
    after = [("k", "x", None, "50"), ("k", None, None, "60"), ("other", None, None, "1")]  # back after the prefix only
    assert _compare(spark, after, [("k", "x"), ("k", None), ("k", None)]).before_interval == "10"


def test_repeated_anchors_are_ambiguous(spark):
    r = _compare(spark, [("k", "repeat"), ("k", "repeat")], [("k", "repeat")])
    assert (r.anchor, r.ambiguous, r.compared, r.state, r.reason) == (None, ["repeat"], 0, "no_anchor", None)


def test_other_reasons(spark):
    assert _compare(spark, [("k", "s"), ("k", "a"), ("k", "b")], [("k", "s"), ("k", "b"), ("k", "a")]).reason == "semantic_anchor"
    r = _compare(spark, [("k", "s"), ("k", None)], [("k", "s")])
    assert r.reason == "selected_window_event_count" and r.after_sequence is None and r.before_sequence == str(2**53 + 1)


def test_windows_offsets_and_budgets(spark):
    events = [("k", f"c{i}") for i in range(6)]
    r = _compare(spark, events, events, max_events=3)
    assert r.truncated and r.matching == 3
    r = _compare(spark, events, events, (2, 2))
    assert r.truncated and r.anchor == "c2" and r.matching == 4
    assert _compare(spark, events, events, (7, 0)).state == "out_of_range" and _compare(spark, events, events, (6, 0)).state == "no_anchor"
    r = _compare(spark, events, events, max_anchors=5)
    assert r.anchor is None and r.truncated
    with pytest.raises(ValueError):
        _compare(spark, events, events, max_events=2001)


def test_losses_and_invalid_numbers(spark):
    most = str(2**64 - 1)
    assert _compare(spark, [("k", "x", most), ("k", None, most)], [("k", "x")]).before_loss == str(2 * (2**64 - 1))
    for bad in ("-1", "1e9", "", str(2**64), "12\n"):
        assert _compare(spark, [("k", "x", None, bad)], [("k", "x")]).state == "invalid", repr(bad)


def test_scalar_rules_of_line_ends_and_unicode(spark):
    rows = spark.createDataFrame([("12\n",), ("12",), ("\n12",), ("１２",)], "t string").select(scalars.unsigned64(F.col("t")).cast("string")).collect()
    assert [r[0] for r in rows] == [None, "12", None, None]
    label = spark.createDataFrame([("  a  b　",), ("x" * 120,)], "t string").select(scalars.short_label(F.col("t")).alias("t")).collect()
    assert label[0].t == "a b" and label[1].t == "x" * 100
    unknown = scalars.status_not([F.lit("active"), F.lit("active")])
    one = spark.range(1).select(scalars.status_not([F.lit("active")]).alias("a"), scalars.status_not([F.lit("unknown")]).alias("b"), unknown.alias("c")).first()
    assert tuple(one) == ("inactive", "unknown", "unknown")
