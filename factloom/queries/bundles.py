"""Observation bundles, and prefixes under budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from factloom.operators import budgets, observations
from factloom.registry import _query
from factloom.sources.tables import read


def _bundles(spark, d):
    tests = read(spark, d, "v_bundle_tests").withColumn("definition_ids", F.array("definition"))
    return tests, read(spark, d, "v_bundle_streams"), read(spark, d, "v_bundle_events")


@_query("""
WITH known AS (SELECT id FROM v_definitions), seen AS (SELECT *, lag(CAST(sequence AS BIGINT)) OVER (PARTITION BY bundle_id, stream_pos ORDER BY event_pos) AS last FROM v_bundle_events),
bad AS (
  SELECT bundle_id, 'test_without_name' AS rule FROM v_bundle_tests WHERE name = ''
  UNION ALL SELECT bundle_id, 'unknown_outcome' FROM v_bundle_tests WHERE outcome NOT IN ('pass', 'fail', 'timeout')
  UNION ALL SELECT bundle_id, 'test_number' FROM v_bundle_tests WHERE elapsed_ns LIKE '%e%'
  UNION ALL SELECT bundle_id, 'timeout_without_cap' FROM v_bundle_tests WHERE outcome = 'timeout' AND timeout_ns IS NULL
  UNION ALL SELECT bundle_id, 'test_of_missing_definition' FROM v_bundle_tests WHERE definition NOT IN (SELECT id FROM known)
  UNION ALL SELECT bundle_id, 'duplicate_stream' FROM v_bundle_streams GROUP BY bundle_id, stream_id HAVING count(*) > 1
  UNION ALL SELECT bundle_id, 'stream_without_clock' FROM v_bundle_streams WHERE clock_domain = ''
  UNION ALL SELECT bundle_id, 'too_many_streams' FROM v_bundle_streams GROUP BY bundle_id HAVING count(*) > 64
  UNION ALL SELECT bundle_id, 'too_many_tests' FROM v_bundle_tests GROUP BY bundle_id HAVING count(*) > 1000
  UNION ALL SELECT bundle_id, 'too_many_events' FROM v_bundle_events GROUP BY bundle_id HAVING count(*) > 10000
  UNION ALL SELECT bundle_id, 'event_number' FROM v_bundle_events WHERE loss_count = '-1'
  UNION ALL SELECT bundle_id, 'sequence_not_increasing' FROM seen WHERE CAST(sequence AS BIGINT) <= last
  UNION ALL SELECT bundle_id, 'event_of_missing_definition' FROM v_bundle_events WHERE definition_id NOT IN (SELECT id FROM known)
  UNION ALL SELECT bundle_id, 'event_beyond_budget' FROM v_bundle_events WHERE strlen(correlation_id) > 128)
SELECT bundle_id, rule, count(*) AS n FROM bad GROUP BY bundle_id, rule""")
def observation_violations(spark, d):
    return observations.violations(*_bundles(spark, d), read(spark, d, "v_definitions"))


_INDEX = """
WITH flat AS (
  SELECT bundle_id, 0 AS part, CAST(NULL AS BIGINT) AS stream_pos, ordinal AS position FROM v_bundle_tests UNION ALL SELECT bundle_id, 1, stream_pos, event_pos FROM v_bundle_events),
placed AS (SELECT *, row_number() OVER (PARTITION BY bundle_id ORDER BY part, stream_pos, position) - 1 AS index FROM flat)"""


@_query(_INDEX + """
SELECT bundle_id, index, CASE part WHEN 0 THEN 'tests' ELSE 'events' END AS section, stream_pos, position FROM placed WHERE index >= 5 AND index < 55""")
def observation_page(spark, d):
    tests, _, events = _bundles(spark, d)
    return observations.page(tests, events, 5, 50)[0].select("bundle_id", "index", "section", "stream_pos", "position")


@_query(_INDEX + """, sums AS (SELECT bundle_id, count(*) AS total FROM placed GROUP BY bundle_id)
SELECT bundle_id, total, CASE WHEN total < 30 THEN 'out_of_range' ELSE 'page' END AS state, CASE WHEN total > 40 THEN CAST(40 AS BIGINT) END AS next_offset, total > 40 AS truncated FROM sums""")
def observation_page_status(spark, d):
    tests, _, events = _bundles(spark, d)
    return observations.page(tests, events, 30, 10)[1]


@_query("""
WITH ids AS (SELECT bundle_id FROM v_bundle_tests UNION SELECT bundle_id FROM v_bundle_events)
SELECT bundle_id, (SELECT count(*) FROM v_bundle_tests AS t WHERE t.bundle_id = i.bundle_id) AS tests, (SELECT count(*) FROM v_bundle_events AS e WHERE e.bundle_id = i.bundle_id) AS events,
coalesce((SELECT string_agg(DISTINCT clock_domain, ',' ORDER BY clock_domain) FROM v_bundle_streams AS s WHERE s.bundle_id = i.bundle_id), '') AS clock_domains FROM ids AS i""")
def bundle_summary(spark, d):
    found = observations.summary(*_bundles(spark, d))
    return found.select("bundle_id", "tests", "events", F.array_join("clock_domains", ",").alias("clock_domains"))


@_query("""
WITH sized AS (SELECT id, kind, name, owner_id, strlen(to_json({'id': id, 'kind': kind, 'name': name, 'owner_id': owner_id})) AS size FROM v_definitions),
summed AS (SELECT id, row_number() OVER (ORDER BY id) AS place, CAST(sum(size) OVER (ORDER BY id) AS BIGINT) AS bytes FROM sized)
SELECT id, place, bytes FROM summed WHERE place <= 1500 AND bytes <= 60000""")
def definitions_bounded(spark, d):
    rows = read(spark, d, "v_definitions").select("id", "kind", "name", "owner_id")
    return budgets.prefix(rows, ["id"], 1500, 60_000).rows.select("id", "place", "bytes")


@_query("""SELECT id, place, bytes FROM (SELECT id, row_number() OVER w AS place, CAST(sum(strlen(id) + coalesce(strlen(target_id), 0)) OVER (w ROWS UNBOUNDED PRECEDING) AS BIGINT) AS bytes
FROM v_relations WINDOW w AS (ORDER BY id, target_id NULLS FIRST))""")
def relations_running_bytes(spark, d):
    size = (F.octet_length("id") + F.coalesce(F.octet_length("target_id"), F.lit(0))).cast("long")
    return budgets.running(read(spark, d, "v_relations").select("id", "target_id"), ["id", "target_id"], size).select("id", "place", "bytes")
