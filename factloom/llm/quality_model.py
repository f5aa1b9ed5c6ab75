"""A text quality classifier: random-indexing word vectors, pooled per document, and a two-layer numpy network.

1. Word vectors (random indexing): a token's bucket has a sparse random index vector of +1 and -1; a bucket's vector is
   the sum of the index vectors of all its left and right neighbours in the corpus, plus its own. Tasks sum over all texts,
   the table is BUCKETS x WIDTH whatever the corpus.
2. A document is the mean and the spread of its tokens' vectors, the mean product of neighbours and two lengths.
3. The network is trained on the driver on a bounded sample (MAX_LABELLED rows, the smallest hashes of the id) of the
   labelled texts; a fifth of it sets the temperature that divides the logit (least log loss).
4. Every text is scored in a scan of its own; the vectors and weights, of fixed size, go with the tasks.

Tokens are runs of letters and digits (case kept) and runs of other characters between white space.

Defined results: an empty or null text has all features zero and gets a score like any other; without labels of both kinds
every score is the share of label 1 (0.5 without any label). A label is the row's greatest if an id has several.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import blocks as B
from factloom.llm.tables import table

BUCKETS, WIDTH, MARKS = 1 << 13, 32, 2
"""Token buckets, length of a vector, nonzero places of an index vector."""
#: Labelled texts that the network may learn from.
MAX_LABELLED = 12_000
HIDDEN, EPOCHS, STEP, DECAY = 24, 40, 0.02, 1e-3
CHUNK = 1 << 17

_WORD = np.zeros(256, bool)
_WORD[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD[ord(_a) : ord(_b) + 1] = True
_OTHER = ~_WORD & ~B.IS_SPACE


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the tokens of all rows and the offsets of each row's."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kind = _WORD[data] + 2 * _OTHER[data].astype(np.int8)
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    change = edge[: len(data)].copy()
    change[1:] |= kind[1:] != kind[:-1]
    bounds = np.append(np.flatnonzero(change), len(data))
    token = kind[bounds[:-1]] > 0
    starts, ends = bounds[:-1][token], bounds[1:][token]
    return (B.span_hashes(data, starts, ends) % np.uint64(BUCKETS)).astype(np.int64), np.searchsorted(starts, offsets)


def index_vectors(seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Places (buckets, 2 * MARKS) and signs: the first MARKS are for a left neighbour, the rest for a right one."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, WIDTH, (BUCKETS, 2 * MARKS)), rng.choice([-1.0, 1.0], (BUCKETS, 2 * MARKS))


def word_vectors(df: DataFrame, text: str = "text", seed: int = 7) -> np.ndarray:
    """(BUCKETS, WIDTH) unit vectors from the neighbours of all tokens of all texts."""
    places, signs = index_vectors(seed)

    def add(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * WIDTH)
        for part in parts:
            for _, _, data, offsets in B.text_blocks(part.column(0)):
                ids, rows = _tokens(data, offsets)
                if len(ids) < 2:
                    continue
                inside = np.ones(len(ids) - 1, bool)
                ends = rows[1:-1]
                inside[ends[(ends > 0) & (ends < len(ids))] - 1] = False
                left, right = ids[:-1][inside], ids[1:][inside]
                for m in range(MARKS):
                    total += np.bincount(right * WIDTH + places[left, m], signs[left, m], len(total))
                    total += np.bincount(left * WIDTH + places[right, MARKS + m], signs[right, MARKS + m], len(total))
        rows = total.reshape(-1, 64 * WIDTH).astype(np.int64)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(list(rows[used]), pa.list_(pa.int64()))], names=["strip", "sums"])

    strips = df.select(F.col(text).cast("string").alias("t")).where("t is not null").mapInArrow(add, "strip int, sums array<bigint>")
    cells = strips.select("strip", F.posexplode("sums").alias("at", "n")).groupBy("strip", "at").agg(F.sum("n").alias("n")).where("n <> 0")
    strips = cells.groupBy("strip").agg(F.collect_list("at").alias("at"), F.collect_list("n").alias("n"))
    vectors = np.zeros((BUCKETS // 64, 64 * WIDTH))
    for strip, at, n in strips.collect():  # BUCKETS x WIDTH numbers at most
        vectors[strip, at] = n
    vectors = _unit(vectors.reshape(BUCKETS, WIDTH))
    for m in range(2 * MARKS):
        np.add.at(vectors, (np.arange(BUCKETS), places[:, m]), signs[:, m] * 0.5)
    return _unit(vectors).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)


def pool(texts: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """(rows, 2 * WIDTH + 3) features."""
    out = np.zeros((len(texts), 2 * WIDTH + 3), np.float32)
    for row, end, data, offsets in B.text_blocks(texts):
        ids, rows = _tokens(data, offsets)
        n = np.diff(rows)
        sums, alike = np.zeros((end - row, 2 * WIDTH)), np.zeros(end - row)
        of = np.repeat(np.arange(end - row), n)
        for at in range(0, len(ids), CHUNK):
            v, docs = vectors[ids[at : at + CHUNK]], of[at : at + CHUNK]
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            sums[docs[first], :WIDTH] += np.add.reduceat(v, first, axis=0)
            sums[docs[first], WIDTH:] += np.add.reduceat(v * v, first, axis=0)
            after = vectors[ids[at + 1 : at + CHUNK + 1]]
            near = np.einsum("ij,ij->i", v[: len(after)], after)
            alike += np.bincount(docs[: len(near)], near * (of[at + 1 : at + CHUNK + 1] == docs[: len(near)]), end - row)
        means = sums / np.maximum(n, 1)[:, None]
        means[:, WIDTH:] = np.sqrt(np.maximum(means[:, WIDTH:] - means[:, :WIDTH] ** 2, 0))
        out[row:end, :-3] = means
        out[row:end, -3] = alike / np.maximum(n - 1, 1)
        out[row:end, -2] = np.log1p(n)
        out[row:end, -1] = np.log1p(np.diff(offsets))
    return out


class Network:
    """One hidden layer of tanh units, standardised inputs and a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, held: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.temperature = 1.0
        z, t = self._inputs(x[~held]), y[~held].astype(np.float64)
        shapes = [(z.shape[1], HIDDEN), (HIDDEN,), (HIDDEN,), ()]
        self.w = [rng.normal(0, s[0] ** -0.5, s) if len(s) and i != 1 else np.zeros(s) for i, s in enumerate(shapes)]
        first, second = [np.zeros(s) for s in shapes], [np.zeros(s) for s in shapes]
        step = 0
        for _ in range(EPOCHS):  # Adam over shuffled batches
            order = rng.permutation(len(z))
            for at in range(0, len(z), 256):
                i = order[at : at + 256]
                hidden = np.tanh(z[i] @ self.w[0] + self.w[1])
                error = (_sigmoid(hidden @ self.w[2] + self.w[3]) - t[i]) / len(i)
                back = error[:, None] * self.w[2] * (1 - hidden**2)
                grads = [z[i].T @ back + DECAY * self.w[0], back.sum(axis=0), hidden.T @ error + DECAY * self.w[2], error.sum()]
                step += 1
                for k, g in enumerate(grads):
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.999 * second[k] + 0.001 * g * g
                    self.w[k] = self.w[k] - STEP * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
        if held.any():
            logit, t = self.logits(x[held]), y[held]
            loss = lambda h: -np.mean(np.log(np.where(t == 1, _sigmoid(logit / h), _sigmoid(-logit / h)) + 1e-12))
            self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)

    def _inputs(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(self._inputs(x) @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def _featured(df: DataFrame, vectors: np.ndarray) -> DataFrame:
    """(hash, label, x) of rows (hash, label, text)."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = pool(part.column("text"), vectors)
            yield pa.RecordBatch.from_arrays([part.column("hash"), part.column("label"), pa.array([r.tobytes() for r in x], pa.binary())], names=["hash", "label", "x"])

    return df.select("hash", "label", "text").mapInArrow(run, "hash bigint, label int, x binary")


def fit(df: DataFrame, labels: DataFrame, vectors: np.ndarray, id: str = "doc_id", text: str = "text", label: str = "quality", limit: int = MAX_LABELLED):
    """A scoring function of features, learned from at most ``limit`` labelled texts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.withColumn("hash", F.xxhash64(F.lit(5), "_id")).orderBy("hash", "_id").limit(limit)
    texts = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # limit rows at most
    found = _featured(texts, vectors).orderBy("hash", "x").limit(limit).toPandas()
    if not len(found) or found["label"].nunique() < 2:
        share = float(found["label"].mean()) if len(found) else 0.5
        return lambda x: np.full(len(x), share)
    x = np.array([np.frombuffer(r, np.float32) for r in found["x"]], np.float64)
    held = found["hash"].to_numpy() % 5 == 0
    held &= ~held.all()
    return Network(x, found["label"].to_numpy(), held).scores


def score(df: DataFrame, vectors: np.ndarray, scores, text: str = "text", name: str = "score") -> DataFrame:
    """The table without its text and with a score of it."""
    names = [c for c in df.columns if c != text]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = scores(pool(part.column(text), vectors))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found.astype(np.float64))], names=[*names, name])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{name}` double"])
    return df.mapInArrow(run, schema)


def held_out(id: str, parts: int = 5, rest: int = 0) -> Column:
    """Whether an id is kept from learning; a null id is."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts == rest, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    vectors = word_vectors(docs)
    scores = fit(docs, labels, vectors)
    out = score(docs, vectors, scores)
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
