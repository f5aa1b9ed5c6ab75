"""Hard negatives against every anchor with every row, in plain Python."""

import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

from factloom.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows):
    kept = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in vector]))
    for i, (anchor, label, v) in enumerate(kept):
        if anchor % 50:
            continue
        scores = [(-sum(a * b for a, b in zip(v, w)), other, m == label) for j, (other, m, w) in enumerate(kept) if j != i]
        for positive, pid, _ in sorted(s for s in scores if s[2])[:5]:
            fits = sorted(s for s in scores if not s[2] and -50 * positive <= -100 * s[0] <= -95 * positive)
            for rank, (score, nid, _) in enumerate(fits[:3]):
                yield anchor, pid, rank + 1, nid, -positive, -score


def _found(spark, path, rows, parts=3):
    spark.createDataFrame(rows, SCHEMA).repartition(parts).write.parquet(f"{path}/embeddings.parquet")
    return Counter(tuple(r) for r in H.query(spark, str(path)).collect())


def _rows(n, dims, rng, spread=0.3):
    heads = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(10)]
    return [(i, [h + rng.gauss(0, spread) for h in heads[rng.randrange(10) if rng.random() < 0.3 else i % 10]], i % 10) for i in range(n)]


@pytest.mark.parametrize("bucket, group", [(64, 128), (2048, 8192)])
def test_equal_to_all_pairs(spark, tmp_path, monkeypatch, bucket, group):
    rng = random.Random(3)
    monkeypatch.setattr(H, "BUCKET", bucket)
    monkeypatch.setattr(H, "GROUP_ROWS", group)
    rows = _rows(1200, 12, rng)
    assert _found(spark, tmp_path, rows) == Counter(brute(rows))


def test_ties_repeats_nulls_and_vectors_of_other_lengths(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, [rng.randrange(-2, 3) / 2 for _ in range(4)], rng.randrange(3)) for i in range(400)]
    rows += [(50, rows[50][1], rows[50][2])] * 3 + [(100, rows[101][1], 2)] * 2  # repeated rows and ids
    rows += [(None, [1.0] * 4, 1), (450, None, 1), (500, [1.0, None, 1.0, 1.0], 1), (550, [float("nan"), 1.0, 1.0, 1.0], 1), (600, [float("inf"), 0.0, 0.0, 1.0], 1), (650, [1.0] * 4, None)]
    rows += [(700, [], 1), (750, [1.0], 1), (800, [1.0, 0.5], 2), (850, [0.0] * 4, 0)]
    expected = Counter(brute(rows))
    assert expected and _found(spark, tmp_path, rows) == expected


def test_empty_tables_and_no_anchors(spark, tmp_path):
    assert not _found(spark, tmp_path / "a", [])
    assert not _found(spark, tmp_path / "b", [(i, [1.0, 2.0], 1) for i in range(1, 50)])
    assert not _found(spark, tmp_path / "c", [(50, None, 1)])


def test_other_columns_dont_matter(spark, tmp_path):
    rows = _rows(300, 6, random.Random(5))
    extra = spark.createDataFrame(rows, SCHEMA)
    for name in ("id", "vector", "anchor", "row", "key", "bucket", "length", "score"):
        extra = extra.selectExpr("*", f"'clash' AS `{name}`")
    extra.write.parquet(f"{tmp_path}/embeddings.parquet")
    assert Counter(tuple(r) for r in H.query(spark, str(tmp_path)).collect()) == Counter(brute(rows))


def test_scores_beyond_doubles_are_exact():
    rng = np.random.default_rng(1)
    a, b = (rng.integers(-H.LARGEST, H.LARGEST, (5, 40)).astype(np.int32) for _ in range(2))
    assert H.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(v, w)) for w in b] for v in a]


def test_pruning_keeps_every_row_of_the_least_score():
    """Sorted lists cut rows away, and never one that scores enough."""
    rng = np.random.default_rng(2)
    rows = (rng.normal(0, 60, (2000, 10)) + np.repeat(rng.normal(0, 200, (20, 10)), 100, axis=0)).astype(np.int32)
    bucket = H.Bucket(np.arange(2000), np.zeros(2000, np.int64), rows)
    anchors = rows[::50]
    lengths, every = np.sqrt((anchors.astype(float) ** 2).sum(axis=1)), H.products(anchors, rows)
    least = np.sort(every, axis=1)[:, -8]
    found = [set() for _ in anchors]
    for a, r, score in H.scored(anchors, lengths, least, bucket):
        assert (every[a, r] == score).all()
        for i, j in zip(a, r):
            found[i].add(int(j))
    for i, row in enumerate(every):
        assert found[i] >= set(np.flatnonzero(row >= least[i]).tolist())
    assert sum(map(len, found)) < every.size / 8  # far fewer than all


def test_equal_to_sql(spark):
    sf = "/root/testdata/sf0.001"
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    result = connection.execute(H.SQL)
    names = [c[0] for c in result.description]
    found = H.query(spark, sf)
    expected = Counter(tuple(r[names.index(c)] for c in found.columns) for r in result.fetchall())
    assert expected and Counter(map(tuple, found.collect())) == expected
