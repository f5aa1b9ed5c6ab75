"""Bounded neighbourhoods, shortest paths and strongly connected components as rounds of joins."""

from __future__ import annotations

import math
import tempfile
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: Spark's setting by which a query's shuffle files are removed when it has ended.
_DROPS_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _folder(df: DataFrame) -> str:
    """The folder of spark.checkpoint.dir, which executors share; a local session may do without."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir()


def _cut(df: DataFrame) -> DataFrame:
    """Ends the lineage of a round in the shared folder."""
    _folder(df)
    return df.checkpoint()


def _stored(df: DataFrame) -> DataFrame:
    """As ``_cut``, for many rows: written as a table they are computed once, not to be counted and again to be written, and
    readers get only their columns. A checkpoint is begun and read faster, so rounds of few rows keep to it. What was shuffled for
    the table leaves the disks with the end of the write, not when the driver happens to collect garbage."""
    path, conf = f"{_folder(df)}/table-{uuid.uuid4().hex}", df.sparkSession.conf
    before = conf.get(_DROPS_SHUFFLES, None)
    conf.set(_DROPS_SHUFFLES, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_DROPS_SHUFFLES, before) if before is not None else conf.unset(_DROPS_SHUFFLES)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def neighbourhood(edges: DataFrame, root, direction: str = "outgoing", depth: int = 2) -> DataFrame:
    """(id, level) of nodes within ``depth`` steps of a root; direction: outgoing, incoming or both."""
    if not 0 <= depth <= 4:
        raise ValueError("depth must lie in 0..4")
    out = edges.where("target_id is not null").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"))
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b"))
    # A level's few nodes meet the relations as they are; only what they lead to is made distinct, so no level shuffles the graph.
    steps = {"outgoing": out, "incoming": back, "both": out.unionByName(back)}[direction]
    seen = edges.sparkSession.range(1).select(F.lit(root).cast(edges.schema["source_id"].dataType).alias("id"), F.lit(0).alias("level"))
    front = seen
    for level in range(1, depth + 1):
        found = front.join(steps, front.id == steps.a).select(F.col("b").alias("id")).distinct()
        front = _cut(found.join(seen, "id", "left_anti").withColumn("level", F.lit(level)))
        seen = seen.unionByName(front)
    return seen


def shortest_paths(edges: DataFrame, root, max_depth: int = 8) -> DataFrame:
    """(id, level, parent, relation_id, path) of the nodes that a root reaches by the paths of a breadth-first search.

    A search visits the nodes of a level by the order of their parents, then by id, and a node's parent is the first one
    visited. So of the shortest paths to a node the least one, compared id by id, is its path; relation_id is the least
    relation from the parent. A path has max_depth + 1 ids at most.
    """
    steps = edges.where("target_id is not null").select(F.col("source_id").alias("a"), F.col("target_id").alias("b"), F.col("id").alias("relation_id"))
    kind, relation = edges.schema["source_id"].dataType, edges.schema["id"].dataType
    one = F.lit(root).cast(kind)
    seen = edges.sparkSession.range(1).select(one.alias("id"), F.lit(0).alias("level"), F.lit(None).cast(kind).alias("parent"), F.lit(None).cast(relation).alias("relation_id"), F.array(one).alias("path"))
    front = seen
    for level in range(1, max_depth + 1):
        best = F.min(F.struct("path", F.col("a").alias("parent"), steps.relation_id)).alias("m")
        found = front.select("id", "path").join(steps, front.id == steps.a).groupBy(F.col("b").alias("id")).agg(best)
        fresh = found.join(seen.select("id"), "id", "left_anti")
        front = _cut(fresh.select("id", F.lit(level).alias("level"), "m.parent", "m.relation_id", F.array_append("m.path", F.col("id")).alias("path")))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """Hangs what each node u is joined to under the least of them: its greater neighbours (large), or itself and the lesser ones."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).select(F.col("u").alias("_u"), "m")
    met = both.join(least, both.u == least._u)
    moved = met.where("v > u") if large else met
    moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v"))
    return (moved if large else moved.unionByName(met.select("u", F.col("m").alias("v")))).where("u > v").distinct()


def _parts(steps: DataFrame) -> DataFrame:
    """(id, part) of the ends of steps (a, b): weakly connected parts, named by their least node, in rounds of large and small stars."""
    edges = _cut(steps.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while (now := tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())) != before and now[0]:
        before = now
        edges = _cut(_stars(_stars(edges, True), False))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("part")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("part")).distinct())


def _tarjan(a: np.ndarray, b: np.ndarray, n: int) -> list[int]:
    """The least node of the strongly connected component of each of the nodes 0 to n - 1, by Tarjan's search."""
    order = np.argsort(a, kind="stable")
    into, first = b[order].tolist(), np.searchsorted(a[order], np.arange(n + 1)).tolist()
    seen, low, at, found, held, visits = [0] * n, [0] * n, first[:-1], [-1] * n, [], 0
    for root in range(n):
        path = [] if seen[root] else [root]
        while path:
            x = path[-1]
            if not seen[x]:
                visits += 1
                seen[x] = low[x] = visits
                held.append(x)
            if at[x] < first[x + 1]:
                y = into[at[x]]
                at[x] += 1
                if not seen[y]:
                    path.append(y)
                elif found[y] < 0:
                    low[x] = min(low[x], seen[y])
                continue
            path.pop()
            if path:
                low[path[-1]] = min(low[path[-1]], low[x])
            if low[x] == seen[x]:
                own = [held.pop()]
                while own[-1] != x:
                    own.append(held.pop())
                least = min(own)
                for y in own:
                    found[y] = least
    return found


def _coloured(live: DataFrame) -> DataFrame:
    """(id, colour) of the ends of steps (a, b), by rounds of joins: the smallest label spreads along the steps until nothing
    changes; the nodes that reach their colour's own node backwards within the colour are its component and leave the graph."""
    rest, done = _cut(live.select(F.col("a").alias("id")).unionByName(live.select(F.col("b").alias("id"))).distinct()), None
    while not rest.isEmpty():
        colour = rest.select("id", F.col("id").alias("colour"))
        while True:
            pushed = live.join(colour, live.a == colour.id).groupBy(F.col("b").alias("into")).agg(F.min("colour").alias("least"))
            after = _cut(colour.join(pushed, colour.id == pushed.into, "left").select("id", F.least("colour", F.coalesce("least", "colour")).alias("colour"), (F.col("least") < F.col("colour")).alias("moved")))
            moved = after.where("moved").isEmpty()
            colour = after.select("id", "colour")
            if moved:
                break
        of_a, of_b = colour.select(F.col("id").alias("a"), F.col("colour").alias("ca")), colour.select(F.col("id").alias("b"), F.col("colour").alias("cb"))
        inside = _cut(live.join(of_a, "a").join(of_b, "b").where("ca = cb").select("a", "b"))
        member = _cut(colour.where("id = colour"))
        front = member
        while not front.isEmpty():
            found = inside.join(front, inside.b == front.id).select(F.col("a").alias("id"), "colour").distinct()
            front = _cut(found.join(member.select("id"), "id", "left_anti"))
            member = _cut(member.unionByName(front))
        done = member if done is None else done.unionByName(member)
        rest = _cut(rest.join(member.select("id"), "id", "left_anti"))
        live = _cut(live.join(rest.select(F.col("id").alias("a")), "a", "left_semi").join(rest.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b"))
    return done


#: Steps of a weakly connected part that a task searches in memory at most, and of the parts dealt to one task on average.
PART, DEALT = 500_000, 100_000


def components(edges: DataFrame) -> DataFrame:
    """(id, component, size, recursive) of each node: strongly connected components, named by their smallest node.

    A component lies in one weakly connected part. Parts of PART steps at most are dealt to tasks, which search them; the
    others go by rounds of colouring, whose number grows with the paths of a part.
    """
    steps = edges.where("target_id is not null").select(F.col("source_id").alias("a"), F.col("target_id").alias("b")).distinct()
    loops = steps.where("a = b").select(F.col("a").alias("id")).distinct().withColumn("loop", F.lit(True))
    nodes = steps.select(F.col("a").alias("id")).unionByName(steps.select(F.col("b").alias("id"))).distinct()
    live, kind = _cut(steps.where("a <> b")), steps.schema["a"].dataType.simpleString()
    parts = _parts(live)
    dealt = live.join(parts, live.a == parts.id).select("part", "a", "b")
    many = _cut(dealt.groupBy("part").count().where(F.col("count") > PART).select("part"))
    tasks = F.lit(max(1, math.ceil(live.count() / DEALT)))

    def search(part: pa.Table) -> pa.Table:
        codes, names = pd.factorize(np.concatenate([part["a"].to_numpy(), part["b"].to_numpy()]), sort=True)
        found = _tarjan(*np.split(codes, 2), len(names))
        return pa.table({"id": pa.array(names), "colour": pa.array(names[found])}).cast(pa.schema([("id", part["a"].type), ("colour", part["a"].type)]))

    few = dealt.join(many, "part", "left_anti").select(F.pmod(F.xxhash64("part"), tasks).alias("task"), "a", "b")
    done = few.groupBy("task").applyInArrow(search, f"id {kind}, colour {kind}")
    if not many.isEmpty():
        done = done.unionByName(_coloured(_cut(dealt.join(many, "part", "left_semi").select("a", "b"))))
    done = _cut(nodes.join(done, "id", "left").select("id", F.coalesce("colour", "id").alias("colour")))
    sizes = done.groupBy("colour").agg(F.count("*").alias("size"))
    rows = done.join(sizes, "colour").join(loops, "id", "left")
    return rows.select("id", F.col("colour").alias("component"), "size", ((F.col("size") > 1) | F.coalesce("loop", F.lit(False))).alias("recursive"))


def component_links(edges: DataFrame, found: DataFrame) -> DataFrame:
    """(from_component, to_component, relations) between different components."""
    a = found.select(F.col("id").alias("source_id"), F.col("component").alias("from_component"))
    b = found.select(F.col("id").alias("target_id"), F.col("component").alias("to_component"))
    return edges.join(a, "source_id").join(b, "target_id").where("from_component <> to_component").groupBy("from_component", "to_component").agg(F.count("*").alias("relations"))
