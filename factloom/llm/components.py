"""Connected components of an edge table by alternating large-star and small-star rounds.

Each round rewires every node to the smallest neighbour it knows of, so chains shrink by a factor a round.
Minima are aggregated before the shuffle and hub nodes meet their minimum in an equality join that adaptive
execution can split; edges stay in the cluster and each round is cut with a checkpoint in the shared folder.

A graph of FEW_EDGES at most, which is a few megabytes whatever the input, takes one task instead of some forty small jobs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm.tables import BROADCAST_IDS, cut

#: Edges that one task may hold: as many numbers as may be sent to all tasks.
FEW_EDGES = BROADCAST_IDS


def _star(pairs: DataFrame) -> DataFrame:
    """Adds m, the smallest of u and its neighbours v, to each (u, v)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("_u"), F.least("m", "u").alias("m"))
    return pairs.join(least, pairs.u == least._u).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    stars = _star(down)
    moved = stars.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(stars.select("u", F.col("m").alias("v")))
    return moved.where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def least_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node of each one's component) of edges: roots hook onto smaller ones, then all point to roots."""
    nodes, of = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = np.split(of, 2)
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def _in_one_task(edges: DataFrame) -> DataFrame:
    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(part.column(0).to_numpy(), part.column(1).to_numpy()) for part in parts]
        if held:
            nodes, roots = least_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["node", "root"])

    return cut(edges.coalesce(1).mapInArrow(batches, "node bigint, root bigint"))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): each node that has an edge with the smallest node of its component.

    Null ends and loops are no edges; an empty table gives an empty result.
    """
    edges = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    edges = cut(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if {kind for _, kind in edges.dtypes} == {"bigint"} and edges.count() <= FEW_EDGES:
        return _in_one_task(edges)
    before = None
    while (now := _mark(edges)) != before and now[0]:
        before = now
        edges = cut(_small(_large(edges)))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
