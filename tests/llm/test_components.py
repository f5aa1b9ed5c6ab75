"""Components of few edges take one task; both ways give the same."""

import random

from factloom.llm import components


def test_few_edges_take_few_jobs_and_give_what_rounds_give(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1) for i in range(0, 60)] + [(rng.randrange(100, 300), rng.randrange(100, 300)) for _ in range(90)] + [(5, 5), (-7, 400), (None, 3), (1 << 62, -(1 << 62))]
    frame = spark.createDataFrame(edges, "a long, b long")
    spark.sparkContext.setJobGroup("few", "few")
    found = sorted(map(tuple, components.components(frame).collect()))
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few"))
    monkeypatch.setattr(components, "FEW_EDGES", -1)
    spark.sparkContext.setJobGroup("rounds", "rounds")
    assert found == sorted(map(tuple, components.components(frame).collect()))
    assert jobs <= 8 < len(spark.sparkContext.statusTracker().getJobIdsForGroup("rounds"))


def test_no_edges(spark):
    assert components.components(spark.createDataFrame([], "a long, b long")).collect() == []
