"""Snapshots, their export, incremental capture and envelopes."""

import json

import pytest

from factloom.plans.envelope import bounded, of_unknowns
from factloom.sources import snapshots
from factloom.streaming.watch import watch


def _facts(spark, *rows):
    return spark.createDataFrame(rows, "id string, text string, n long")


def test_publish_load_export_import(spark, tmp_path):
    base, facts = str(tmp_path / "store"), _facts(spark, ("a", "é", 1), ("b", None, None))
    name = snapshots.publish(facts, base, "r", None)
    assert snapshots.publish(facts.orderBy("id", ascending=False), base, "r", None) == name == snapshots.head(spark, base, "r")
    with pytest.raises(snapshots.Conflict):
        snapshots.publish(_facts(spark, ("c", "x", 1)), base, "r", "other")
    later = snapshots.publish(_facts(spark, ("c", "x", 1)), base, "r", name)
    assert snapshots.head(spark, base, "r") == later and snapshots.load(spark, base, name).count() == 2
    snapshots.export(spark, base, name, str(tmp_path / "out"))
    assert snapshots.import_(spark, str(tmp_path / "out"), str(tmp_path / "other"), "r", None) == name


def test_a_damaged_snapshot_is_found(spark, tmp_path):
    name = snapshots.publish(_facts(spark, ("a", "x", 1)), str(tmp_path), "r", None)
    _facts(spark, ("b", "y", 2)).write.mode("append").parquet(f"{tmp_path}/snapshots/{name}")
    with pytest.raises(ValueError):
        snapshots.load(spark, str(tmp_path), name)


def test_a_watch_writes_only_what_changed(spark, tmp_path):
    source, store = tmp_path / "in", str(tmp_path / "store")
    source.mkdir()

    def put(name, *rows):
        (source / name).write_text("\n".join(json.dumps(dict(zip(("path", "text", "version"), r, strict=True))) for r in rows))
        watch(spark, str(source), store, str(tmp_path / "checkpoint")).awaitTermination(60)
        return sorted((r.path, r.version) for r in spark.read.parquet(store).collect())

    assert put("1.json", ("a", "x", 1), ("b", "y", 1)) == [("a", 1), ("b", 1)]
    assert put("2.json", ("a", "x", 2), ("b", "z", 2), ("c", None, 2)) == [("a", 1), ("b", 1), ("b", 2), ("c", 2)]


def test_envelopes(spark):
    rows, said = bounded(spark.range(5).orderBy("id"), 3)
    assert rows.count() == 3 and said.truncated and said.coverage == "complete"
    assert not bounded(spark.range(3).orderBy("id"), 3)[1].truncated
    counts = spark.createDataFrame([("syntax_only", 4), ("missing_dependency", 2)], "reason string, n long")
    assert of_unknowns(counts).reasons == [("missing_dependency", 2), ("syntax_only", 4)]
    assert of_unknowns(counts.limit(0)).coverage == "complete"


def test_a_digest_tells_nulls_and_columns_apart(spark):
    rows = lambda a, b: spark.createDataFrame([(1, a, b)], "i int, a string, b string")
    found = [snapshots.digest(rows(*x)) for x in (("x", None), (None, "x"), ("x", ""), ("", "x"), (None, None), ("-", None))]
    assert len(set(found)) == len(found)
