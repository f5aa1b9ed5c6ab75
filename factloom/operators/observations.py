"""Bundles of observations: tests and trace streams of a run, validated, summed up and read by pages.

Rows: tests (bundle_id, ordinal, name, outcome, elapsed_ns, timeout_ns, reason, definition_ids), streams (bundle_id,
stream_pos, stream_id, process_or_device, thread_or_hart, clock_domain, timestamp_unit) and events (bundle_id, stream_pos,
event_pos, sequence, timestamp, kind, definition_id, correlation_id, loss_count). Positions count from 0. Numbers are decimal texts.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.functions.scalars import unsigned64
from factloom.operators.history import OUTCOMES

#: Budgets of a bundle.
MAX_TESTS, MAX_STREAMS, MAX_EVENTS, MAX_LINKS, MAX_PAGE = 1000, 64, 10_000, 100, 200
NAME_BYTES, REASON_BYTES, TEXT_BYTES = 256, 1024, 128
#: What no bundle can tell.
LIMITATIONS = ("Imported run observations are not exhaustive behavior or static call-resolution evidence.", "Cross-stream clock order and causal links are not inferred.")
_EVENT = "struct<sequence:string,timestamp:string,kind:string,definition_id:string,correlation_id:string,loss_count:string>"
_TEST = "struct<name:string,outcome:string,elapsed_ns:string,timeout_ns:string,reason:string,definition_ids:array<string>>"
_STREAM = f"struct<id:string,process_or_device:string,thread_or_hart:string,clock_domain:string,timestamp_unit:string,events:array<{_EVENT}>>"
BUNDLE = f"struct<schema_version:int,snapshot_id:string,artifact:struct<sha256:string,source_id:string,context_id:string,producer:string>,limitations:array<string>,tests:array<{_TEST}>,streams:array<{_STREAM}>>"


class Bundles(NamedTuple):
    bundles: DataFrame
    tests: DataFrame
    streams: DataFrame
    events: DataFrame


def unpack(texts: DataFrame, text: str = "value") -> Bundles:
    """Bundles out of JSON texts, one each; bundle_id is the digest of the text, so equal texts are one bundle.

    A text that isn't a bundle is an error of the job: nothing of a broken file is taken.
    """
    rows = texts.select(F.concat(F.lit("observation:"), F.sha2(text, 256)).alias("bundle_id"), F.from_json(text, BUNDLE, {"mode": "FAILFAST"}).alias("b")).dropDuplicates(["bundle_id"])
    tests = rows.select("bundle_id", F.posexplode("b.tests").alias("ordinal", "t")).select("bundle_id", "ordinal", "t.*")
    streams = rows.select("bundle_id", F.posexplode("b.streams").alias("stream_pos", "s"))
    events = streams.select("bundle_id", "stream_pos", F.posexplode("s.events").alias("event_pos", "e")).select("bundle_id", "stream_pos", "event_pos", "e.*")
    streams = streams.select("bundle_id", "stream_pos", F.col("s.id").alias("stream_id"), *(f"s.{c}" for c in ("process_or_device", "thread_or_hart", "clock_domain", "timestamp_unit")))
    return Bundles(rows.select("bundle_id", "b.schema_version", "b.snapshot_id", "b.artifact", "b.limitations"), tests, streams, events)


def _long(c: str, most: int) -> Column:
    return F.coalesce(F.octet_length(c) > most, F.lit(False))


def _bare(c: str) -> Column:
    return F.coalesce(F.col(c) == "", F.lit(True))


def _number(c: str) -> Column:
    return F.col(c).isNotNull() & unsigned64(F.col(c)).isNull()


def violations(tests: DataFrame, streams: DataFrame, events: DataFrame, definitions: DataFrame) -> DataFrame:
    """(bundle_id, rule, n) of the rules that a bundle breaks; definitions: id, of the bundle's snapshot."""
    known = definitions.select(F.col("id").alias("definition_id")).distinct()
    linked = tests.select("bundle_id", F.explode("definition_ids").alias("definition_id"))
    last = F.lag(unsigned64(F.col("sequence"))).over(Window.partitionBy("bundle_id", "stream_pos").orderBy("event_pos"))
    over = lambda df, most: df.groupBy("bundle_id").agg(F.count("*").alias("c")).where(F.col("c") > most)
    checks = [
        ("too_many_tests", over(tests, MAX_TESTS)),
        ("too_many_streams", over(streams, MAX_STREAMS)),
        ("too_many_events", over(events, MAX_EVENTS)),
        ("test_without_name", tests.where(_bare("name"))),
        ("test_beyond_budget", tests.where(_long("name", NAME_BYTES) | _long("reason", REASON_BYTES) | F.coalesce(F.size("definition_ids") > MAX_LINKS, F.lit(False)))),
        ("unknown_outcome", tests.where(~F.coalesce(F.col("outcome").isin(*OUTCOMES), F.lit(False)))),
        ("test_number", tests.where(_number("elapsed_ns") | _number("timeout_ns"))),
        ("timeout_without_cap", tests.where("outcome = 'timeout' and timeout_ns is null")),
        ("test_of_missing_definition", linked.join(known, "definition_id", "left_anti")),
        ("stream_beyond_budget", streams.where(_long("stream_id", TEXT_BYTES) | _long("process_or_device", TEXT_BYTES) | _long("thread_or_hart", TEXT_BYTES) | _long("clock_domain", TEXT_BYTES) | _long("timestamp_unit", TEXT_BYTES))),
        ("stream_without_name", streams.where(_bare("stream_id"))),
        ("duplicate_stream", streams.groupBy("bundle_id", "stream_id").agg(F.count("*").alias("c")).where("c > 1")),
        ("stream_without_clock", streams.where(_bare("clock_domain") | _bare("timestamp_unit"))),
        ("event_number", events.where(F.col("sequence").isNull() | F.col("timestamp").isNull() | _number("sequence") | _number("timestamp") | _number("loss_count"))),
        ("sequence_not_increasing", events.withColumn("last", last).where(unsigned64(F.col("sequence")) <= F.col("last"))),
        ("event_of_missing_definition", events.where("definition_id is not null").join(known, "definition_id", "left_anti")),
        ("event_without_kind", events.where(_bare("kind"))),
        ("event_beyond_budget", events.where(_long("kind", TEXT_BYTES) | _long("correlation_id", TEXT_BYTES))),
    ]
    rows = checks[0][1].select("bundle_id", F.lit(checks[0][0]).alias("rule"))
    for rule, df in checks[1:]:
        rows = rows.unionByName(df.select("bundle_id", F.lit(rule).alias("rule")))
    return rows.groupBy("bundle_id", "rule").agg(F.count("*").alias("n"))


def totals(tests: DataFrame, events: DataFrame) -> DataFrame:
    """(bundle_id, tests, events) of every bundle that has any."""
    counts = tests.groupBy("bundle_id").agg(F.count("*").alias("tests"), F.lit(0).cast("long").alias("events"))
    more = events.groupBy("bundle_id").agg(F.lit(0).cast("long").alias("tests"), F.count("*").alias("events"))
    return counts.unionByName(more).groupBy("bundle_id").agg(F.sum("tests").alias("tests"), F.sum("events").alias("events"))


def indexed(tests: DataFrame, events: DataFrame) -> DataFrame:
    """(bundle_id, index, section, stream_pos, position): one index over a bundle's tests, then the events of its streams in order.

    An index is what comes before the row's section and stream, of which there are counts, plus its position there; so no window
    runs over tests or events, however many there are.
    """
    per = events.groupBy("bundle_id", "stream_pos").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("bundle_id").orderBy("stream_pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = tests.groupBy("bundle_id").agg(F.count("*").alias("tests"))
    start = per.withColumn("before", before).join(many, "bundle_id", "left").select("bundle_id", "stream_pos", (F.col("before") + F.coalesce("tests", F.lit(0))).alias("start"))
    first = tests.select("bundle_id", F.col("ordinal").cast("long").alias("index"), F.lit("tests").alias("section"), F.lit(None).cast("long").alias("stream_pos"), F.col("ordinal").cast("long").alias("position"))
    rest = events.join(start, ["bundle_id", "stream_pos"]).select("bundle_id", (F.col("start") + F.col("event_pos")).alias("index"), F.lit("events").alias("section"), F.col("stream_pos").cast("long"), F.col("event_pos").cast("long").alias("position"))
    return first.unionByName(rest)


def page(tests: DataFrame, events: DataFrame, offset: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows ``offset`` to ``offset + limit`` of the index of every bundle, and (bundle_id, total, state, next_offset, truncated) of each.

    state is out_of_range for a bundle of fewer rows than the offset, which gives no rows; an offset at the end is an empty page.
    """
    if not 1 <= limit <= MAX_PAGE or offset < 0:
        raise ValueError(f"a page has 1..{MAX_PAGE} rows and begins at 0 or later")
    rows = indexed(tests, events).where((F.col("index") >= offset) & (F.col("index") < offset + limit))
    end, total = F.least(F.lit(offset + limit).cast("long"), F.col("tests") + F.col("events")), F.col("tests") + F.col("events")
    more = (total >= offset) & (end < total)
    status = totals(tests, events).select("bundle_id", total.alias("total"), F.when(total < offset, "out_of_range").otherwise("page").alias("state"), F.when(more, end).alias("next_offset"), more.alias("truncated"))
    return rows, status


def summary(tests: DataFrame, streams: DataFrame, events: DataFrame) -> DataFrame:
    """(bundle_id, tests, events, clock_domains, limitations) of each bundle; clocks of different domains aren't compared."""
    clocks = streams.groupBy("bundle_id").agg(F.array_sort(F.collect_set("clock_domain")).alias("clock_domains"))
    rows = totals(tests, events).join(clocks, "bundle_id", "full_outer").fillna(0, ["tests", "events"])
    none = F.array().cast("array<string>")
    return rows.select("bundle_id", "tests", "events", F.coalesce("clock_domains", none).alias("clock_domains"), F.array(*map(F.lit, LIMITATIONS)).alias("limitations"))


def chosen_streams(streams: DataFrame, events: DataFrame, ids: DataFrame) -> DataFrame:
    """(bundle_id, stream_id, state, stream_pos): of each asked (bundle_id, stream_id) whether it is one stream of a bundle within the
    budgets of streams and events: one, missing, ambiguous or over_budget."""
    counts = streams.groupBy("bundle_id", "stream_id").agg(F.count("*").alias("n"), F.min("stream_pos").alias("stream_pos"))
    sizes = streams.groupBy("bundle_id").agg(F.count("*").alias("streams")).join(events.groupBy("bundle_id").agg(F.count("*").alias("events")), "bundle_id", "left")
    rows = ids.join(counts, ["bundle_id", "stream_id"], "left").join(sizes, "bundle_id", "left")
    over = (F.coalesce("streams", F.lit(0)) > MAX_STREAMS) | (F.coalesce("events", F.lit(0)) > MAX_EVENTS)
    state = F.when(over, "over_budget").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("one")
    return rows.select("bundle_id", "stream_id", state.alias("state"), F.when(state == "one", F.col("stream_pos")).alias("stream_pos"))
