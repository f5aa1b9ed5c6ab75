"""Hard negatives by coordinate pruning: rows of another label that score close under an anchor's positives.

1. Components become integers. Rows are sorted by length over the whole table and packed into buckets of BUCKET rows; a bucket
   keeps, for each coordinate, its rows in the order of the normalised coordinate (sorted lists).
2. An anchor needs a least score t: that of its last positive found so far, or the lower end of its windows. In a bucket of a
   greatest length p, rows of that score lie within an angle of acos(t / (|q| p)) of the anchor, so in each coordinate in a
   feasible range around the anchor's own. The ranges of the anchor's FOCUS largest coordinates are found in the sorted lists
   by binary search; the rows of the narrowest one that lie in all others are candidates, and their scores are computed exactly. A
   bucket too short for t is skipped, as are all after it. Where ranges hold over a DENSE-th of a bucket, which happens for low
   scores, one matrix product gives the same scores.
3. Groups of buckets meet groups of anchors; both are bounded, so is a task's memory. A task sends the best rows of each anchor
   only; they are ranked once more over all groups. First the positives are found, then the negatives in their windows.

A stated set of anchors meets all rows in blocks: the work is anchors times rows at worst, without pruning. No group, label or
anchor is gathered anywhere, nothing is broadcast, no candidate is dropped.

Defined results: rows with a null id, label or vector, a null or non-finite component, or a component of LARGEST or more in
magnitude as an integer (its scores don't fit 64 bits) take no part. A vector that is shorter than another counts as having
zeros there; an empty one scores 0. Vectors have MOST_DIMS components at most, else ValueError. Repeated rows are rows of their
own: an equal row is another row, and each gives its own results. Equal scores go to the smaller id. Labels, ids and vectors of
any other column's name don't clash: other columns are ignored. Empty tables, tables without anchors, anchors without positives
and windows without rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.tables import cut, table

BUCKET, FOCUS, DENSE = 2048, 3, 16
#: Rows and anchors of a group: what a task holds at once.
GROUP_ROWS, GROUP_ANCHORS = 8192, 8192
LARGEST, MOST_DIMS = 1 << 26, 2047
NONE = np.iinfo(np.int64).min
_BUCKET = "dims int, rows int, long double, ids binary, labels binary, anchors binary, vectors binary"
_ANCHOR = "bucket bigint, at int, id bigint, label bigint, vector binary, floor bigint"


def units(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as double; null for a vector that takes no part."""
    inside = lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(F.floor(F.lit(scale) * x.cast("double")).cast("double")) < LARGEST), F.lit(False))
    return F.when(F.forall(vector, inside), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("int")))


class Bucket:
    """Rows of one length bucket with their sorted coordinate lists, which are made when they are first asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray):
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.lengths = np.sqrt((vectors.astype(np.float64) ** 2).sum(axis=1))
        self.long = float(self.lengths.max(initial=0))
        self.lists = None

    def sorted_lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each coordinate the values in order, the rows in order and each row's place."""
        if self.lists is None:
            unit = (self.vectors / np.maximum(self.lengths, 1e-300)[:, None]).T
            order = np.argsort(unit, axis=1, kind="stable")
            place = np.empty_like(order)
            np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
            self.lists = np.take_along_axis(unit, order, axis=1), order, place
        return self.lists


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of all rows of a and b, as 64-bit integers."""
    d = min(a.shape[1], b.shape[1])
    a, b = a[:, :d], b[:, :d]
    most = np.abs(a).max(initial=0).astype(float) * np.abs(b).max(initial=0).astype(float) * max(d, 1)
    if most < 2**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def ranges(anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray, bucket: Bucket) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(focus, first, end) of each anchor: its focus coordinates and the feasible places in their sorted lists."""
    d = min(anchors.shape[1], bucket.vectors.shape[1])
    unit = anchors[:, :d] / np.maximum(lengths, 1e-300)[:, None]
    k = min(FOCUS, d)
    focus = np.argpartition(-np.abs(unit), k - 1, axis=1)[:, :k] if k else np.zeros((len(anchors), 0), int)
    bound = least / np.maximum(lengths * bucket.long, 1e-300)
    wide = np.arccos(np.clip(np.where((least <= 0) | (lengths * bucket.long == 0), -1.0, bound), -1.0, 1.0))[:, None]
    own = np.arccos(np.clip(np.take_along_axis(unit, focus, axis=1), -1.0, 1.0))
    low, high = np.cos(np.minimum(np.pi, own + wide)) - 1e-9, np.cos(np.maximum(0.0, own - wide)) + 1e-9
    values = bucket.sorted_lists()[0]
    first, end = np.zeros_like(focus), np.zeros_like(focus)
    for f in np.unique(focus):
        at = focus == f
        first[at], end[at] = np.searchsorted(values[f], low[at], "left"), np.searchsorted(values[f], high[at], "right")
    return focus, first, end


def scored(anchors: np.ndarray, lengths: np.ndarray, least: np.ndarray, bucket: Bucket) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(anchor, row, score) of all rows of a bucket that score ``least`` or more with an anchor, and some others."""
    alive = np.flatnonzero(lengths * bucket.long * (1 + 1e-9) >= least)
    if not len(alive) or not len(bucket.ids):
        return
    n = len(bucket.ids)
    focus, first, end = ranges(anchors[alive], lengths[alive], least[alive].astype(np.float64), bucket)
    size = (end - first) if focus.shape[1] else np.full((len(alive), 1), n)
    narrow, count = size.argmin(axis=1), size.min(axis=1)
    dense = count * DENSE > n
    for at in range(0, int(dense.sum()), 1024):
        some = alive[dense][at : at + 1024]
        found = products(anchors[some], bucket.vectors)
        a, r = np.nonzero(found >= least[some][:, None])
        yield some[a], r, found[a, r]
    _, order, place = bucket.sorted_lists()
    sparse = np.flatnonzero(~dense & (count > 0))
    for at in range(0, len(sparse), 4096):
        s = sparse[at : at + 4096]
        a = np.repeat(s, count[s])
        inner = np.arange(len(a)) - np.repeat(np.cumsum(count[s]) - count[s], count[s])
        r = order[focus[a, narrow[a]], first[a, narrow[a]] + inner]
        keep = np.ones(len(a), bool)
        for k in range(focus.shape[1]):
            where = place[focus[a, k], r]
            keep &= (where >= first[a, k]) & (where < end[a, k])
        a, r = a[keep], r[keep]
        d = min(anchors.shape[1], bucket.vectors.shape[1])
        yield alive[a], r, (anchors[alive[a], :d].astype(np.int64) * bucket.vectors[r, :d]).sum(axis=1)


class Best:
    """The best k (score, id) of each of some slots: higher scores first, then smaller ids."""

    def __init__(self, slots: int, k: int):
        self.score, self.id, self.k = np.full((slots, k), NONE), np.zeros((slots, k), np.int64), k

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, id: np.ndarray) -> None:
        keep = score >= self.score[slot, -1]
        slot, score, id = slot[keep], score[keep], id[keep]
        if not len(slot):
            return
        touched = np.unique(slot)
        slot = np.concatenate([np.repeat(touched, self.k), slot])
        score, id = np.concatenate([self.score[touched].ravel(), score]), np.concatenate([self.id[touched].ravel(), id])
        held = score != NONE
        slot, score, id = slot[held], score[held], id[held]
        order = np.lexsort((id, -score, slot))
        slot, score, id = slot[order], score[order], id[order]
        start = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.append(start, len(slot))))
        few = rank < self.k
        self.score[slot[few], rank[few]], self.id[slot[few], rank[few]] = score[few], id[few]


def _bucket(row) -> Bucket:
    vectors = np.frombuffer(row.vectors, np.int32).reshape(row.rows, row.dims)
    return Bucket(np.frombuffer(row.ids, np.int64), np.frombuffer(row.labels, np.int64), vectors)


def _pack(size: int):
    """Buckets of ``size`` consecutive rows of a task, the longest first."""

    def columns_of(part: pa.Table) -> pa.RecordBatch:
        vector = part["vector"].combine_chunks()
        sizes = vector.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        dims = int(sizes.max(initial=0))
        if dims > MOST_DIMS:
            raise ValueError(f"a vector has more than {MOST_DIMS} components")
        vectors = np.zeros((len(part), dims), np.int32)
        vectors[np.arange(dims) < sizes[:, None]] = vector.flatten().to_numpy()
        column = lambda name, kind: pa.array([part[name].to_numpy().astype(kind).tobytes()], pa.binary())
        return pa.RecordBatch.from_pydict({
            "dims": pa.array([dims], pa.int32()), "rows": pa.array([len(part)], pa.int32()), "long": [float(np.sqrt((vectors[:1].astype(np.float64) ** 2).sum()))],
            "ids": column("id", np.int64), "labels": column("label", np.int64), "anchors": column("anchor", bool), "vectors": pa.array([vectors.tobytes()], pa.binary()),
        })

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for part in parts:
            held.append(part)
            if sum(map(len, held)) >= size:
                rows = pa.Table.from_batches(held)
                whole = len(rows) // size * size
                for at in range(0, whole, size):
                    yield columns_of(rows.slice(at, size))
                held = rows.slice(whole).to_batches()
        if sum(map(len, held)):
            yield columns_of(pa.Table.from_batches(held))

    return run


def _anchors_of(positives: int):
    """Anchor rows of buckets; floor is the score of the last positive in the anchor's own bucket, or NONE."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                chosen = np.flatnonzero(np.frombuffer(row.anchors, bool))
                if not len(chosen):
                    continue
                bucket = _bucket(row)
                best = Best(len(chosen), positives)
                found = products(bucket.vectors[chosen], bucket.vectors)
                a, r = np.nonzero((bucket.labels[chosen][:, None] == bucket.labels) & (chosen[:, None] != np.arange(row.rows)))
                best.add(a, found[a, r], bucket.ids[r])
                yield pd.DataFrame({"bucket": row.bucket, "at": chosen.astype(np.int32), "id": bucket.ids[chosen], "label": bucket.labels[chosen], "vector": [v.tobytes() for v in bucket.vectors[chosen]], "floor": best.least()})

    return run


def _matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Vectors in one matrix, filled with zeros, and their lengths."""
    rows = [np.frombuffer(v, np.int32) for v in vectors]
    out = np.zeros((len(rows), max(map(len, rows), default=0)), np.int32)
    for o, v in zip(out, rows, strict=True):
        o[: len(v)] = v
    return out, np.sqrt((out.astype(np.float64) ** 2).sum(axis=1))


def _longest_first(rows: pd.DataFrame) -> Iterator[tuple[int, Bucket]]:
    for row in rows.sort_values(["long", "bucket"], ascending=[False, True]).itertuples():
        yield row.bucket, _bucket(row)


def _find_positives(k: int):
    def run(buckets: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        vectors, lengths = _matrix(anchors["vector"])
        labels, home, at, floor = (anchors[c].to_numpy() for c in ("label", "bucket", "at", "floor"))
        best = Best(len(anchors), k)
        for number, bucket in _longest_first(buckets):
            least = np.maximum(floor, best.least())
            for a, r, score in scored(vectors, lengths, least, bucket):
                keep = (labels[a] == bucket.labels[r]) & (score >= least[a]) & ~((home[a] == number) & (at[a] == r))
                best.add(a[keep], score[keep], bucket.ids[r[keep]])
        a, j = np.nonzero(best.score != NONE)
        return pd.DataFrame({"key": anchors["key"].to_numpy()[a], "positive_id": best.id[a, j], "score": best.score[a, j]})

    return run


def _find_negatives(k: int, low: int, high: int):
    def run(buckets: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        vectors, lengths = _matrix(anchors["vector"])
        labels = anchors["label"].to_numpy()
        count = anchors["scores"].map(len).to_numpy()
        of, start = np.repeat(np.arange(len(anchors)), count), np.cumsum(count) - count
        known = np.concatenate([np.asarray(s, np.int64) for s in anchors["scores"]])
        ids = np.concatenate([np.asarray(s, np.int64) for s in anchors["ids"]])
        bottom, top = -((-low * known) // 100), high * known // 100
        best = Best(len(known), k)
        for _, bucket in _longest_first(buckets):
            need = np.where(bottom > top, np.iinfo(np.int64).max, np.maximum(bottom, best.least()))
            least = np.full(len(anchors), np.iinfo(np.int64).max)
            np.minimum.at(least, of, need)
            for a, r, score in scored(vectors, lengths, least, bucket):
                other = labels[a] != bucket.labels[r]
                a, r, score = a[other], r[other], score[other]
                for j in range(int(count.max(initial=0))):
                    has = count[a] > j
                    slot = start[a[has]] + j
                    fits = (score[has] >= need[slot]) & (score[has] <= top[slot])
                    best.add(slot[fits], score[has][fits], bucket.ids[r[has][fits]])
        slot, j = np.nonzero(best.score != NONE)
        a = of[slot]
        return pd.DataFrame({"key": anchors["key"].to_numpy()[a], "turn": (slot - start[a]).astype(np.int32), "anchor_id": anchors["id"].to_numpy()[a], "positive_id": ids[slot], "positive_score": known[slot], "negative_id": best.id[slot, j], "negative_score": best.score[slot, j]})

    return run


def _meet(buckets: DataFrame, anchors: DataFrame, groups: int, agroups: int, f, schema: str) -> DataFrame:
    """Runs f on each pair of a group of buckets and a group of anchors."""
    left = buckets.withColumn("g", F.pmod(F.xxhash64("bucket"), F.lit(groups)).cast("int")).withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(agroups - 1))))
    right = anchors.withColumn("h", F.pmod(F.xxhash64("key"), F.lit(agroups)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    none = {c.split()[0]: np.zeros(0, np.int64) for c in schema.split(", ")}
    return left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(lambda a, b: f(a, b) if len(a) and len(b) else pd.DataFrame(none), schema)


def mine(df: DataFrame, id: str, label: str, vector: str, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows for which ``anchor`` holds.

    Positives are the best ``positives`` rows of the anchor's label; a negative has another label and a score from ``low`` to ``high``
    hundredths of the positive's.
    """
    rows = df.select(F.col(id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), units(F.col(vector)).alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("id is not null and label is not null and vector is not null")
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x).alias("length")
    rows = rows.select("*", length, F.monotonically_increasing_id().alias("row"))  # equal rows needn't share a task
    sorted_ = rows.repartitionByRange(F.desc("length"), "id", "row").sortWithinPartitions(F.desc("length"), "id", "row")
    buckets = cut(sorted_.select("id", "label", "anchor", "vector").mapInArrow(_pack(BUCKET), _BUCKET)).withColumn("bucket", F.monotonically_increasing_id())
    buckets = cut(buckets)
    anchors = cut(buckets.mapInPandas(_anchors_of(positives), _ANCHOR).withColumn("key", F.monotonically_increasing_id()))
    total, many = buckets.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0], anchors.count()
    groups, agroups = max(1, math.ceil(total / GROUP_ROWS)), max(1, math.ceil(many / GROUP_ANCHORS))
    held = buckets.drop("anchors")
    found = _meet(held, anchors, groups, agroups, _find_positives(positives), "key bigint, positive_id bigint, score bigint")
    best = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("score"), "positive_id"))
    found = found.withColumn("turn", best).where(F.col("turn") <= positives)
    lists = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("turn", "positive_id", "score"))).alias("p"))
    lists = lists.select(F.col("key").alias("_key"), F.col("p.positive_id").alias("ids"), F.col("p.score").alias("scores"))
    known = cut(anchors.join(lists, anchors.key == lists._key).select("key", "id", "label", "vector", "ids", "scores"))
    out = "key bigint, turn int, anchor_id bigint, positive_id bigint, positive_score bigint, negative_id bigint, negative_score bigint"
    found = _meet(held, known, groups, agroups, _find_negatives(negatives, low, high), out)
    rank = F.row_number().over(Window.partitionBy("key", "turn").orderBy(F.desc("negative_score"), "negative_id"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", label), "vec_id", "label", "embedding", F.col("vec_id") % 50 == 0)


#: Every anchor against every row; vectors of one length.
SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.r AS a, a.vec_id AS anchor_id, v.vec_id AS id, a.label = v.label AS same, CAST(list_inner_product(a.e, v.e) AS BIGINT) AS score FROM v AS a JOIN v ON a.vec_id % 50 = 0 AND a.r <> v.r),
p AS (SELECT a, anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY a ORDER BY score DESC, id) AS turn FROM s WHERE same),
n AS (SELECT p.*, s.id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.a, turn ORDER BY s.score DESC, s.id) AS INT) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score WHERE turn <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3"""
