"""Toxicity by a factorization machine over hashed terms.

1. Terms of a text: its words (runs of letters and digits, A-Z lower-cased) and the beginnings of longer words, BEGINNINGS bytes
   long, as 64-bit hashes; a text has a term or hasn't.
2. The model learns from at most MAX_LABELLED labelled texts, those of the smallest hashes of the id. Tasks count in how many
   of them each term occurs by label; of the terms in LEAST texts or more, half of the TERMS places go to those whose
   counts differ most between labels, the rest to the most frequent ones, which only pairs may give a meaning.
3. A score is sigmoid(b + sum w_i + sum over pairs of <v_i, v_j>): a pair of terms, as an insult and a group, may weigh what
   neither does alone. The sum over pairs is half of |sum v_i|^2 - sum |v_i|^2. Adam minimises the log loss on the driver, over
   TERMS bits a text at most, and weights that the loss doesn't hold shrink to zero; a fifth of the texts sets the temperature that divides the logit.
4. Every whole text is scored in a scan; the table of terms, of fixed size, goes with the tasks.

Defined results: a null or empty text, or one without known terms, gets the score of the bias alone, like any other. Without labels of
both kinds every score is the share of label 1 (0.5 without any label). A label is the row's greatest if an id has several; a
label that isn't 0 or 1 doesn't count. A null id is held out, and its row is scored. Repeated rows are scored each; a text of
any length is read whole, block by block; an empty table gives no rows; other columns, whatever their names, come along in
``score`` but for one of the name of the score (ValueError) and never matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import blocks as B
from factloom.llm.tables import table

#: Labelled texts that the model may learn from.
MAX_LABELLED = 12_000
TERMS, FREQUENT, LEAST, APART, FACTORS = 1 << 14, 64, 4, 7.0, 8
BEGINNINGS = (4, 6)
EPOCHS, BATCH, STEP, SHRINK, DECAY = 30, 64, 0.01, 0.05, 0.1
#: Partial counts that a task holds before it sends them.
HELD = 1 << 20

_WORD = np.zeros(256, bool)
_LOWER = np.arange(256, dtype=np.uint8)
_WORD[0x80:] = True
for _a, _b in (("0", "9"), ("A", "Z"), ("a", "z")):
    _WORD[ord(_a) : ord(_b) + 1] = True
_LOWER[ord("A") : ord("Z") + 1] += 32


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all terms of all rows, repeats included."""
    data = _LOWER[data]
    starts, ends = B.runs(_WORD[data], offsets)
    rows = np.searchsorted(offsets, starts, "right") - 1
    of, found = [rows], [B.span_hashes(data, starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts > n
        of.append(rows[long])
        found.append(B.mix(B.span_hashes(data, starts[long], starts[long] + n) ^ np.uint64(n)))
    return np.concatenate(of), np.concatenate(found)


def _distinct(rows: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, rows))
    rows, hashes = rows[order], hashes[order]
    first = np.ones(len(rows), bool)
    first[1:] = (rows[1:] != rows[:-1]) | (hashes[1:] != hashes[:-1])
    return rows[first], hashes[first]


def _counts(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, n0, n1): in how many texts of each label a term occurs; partial sums."""
    held, size = [], 0

    def out() -> pa.RecordBatch:
        of, labels = np.concatenate([h for h, _ in held]), np.concatenate([y for _, y in held])
        found, at = np.unique(of, return_inverse=True)
        n1 = np.bincount(at, labels, len(found)).astype(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(np.bincount(at, minlength=len(found)) - n1), pa.array(n1)], names=["term", "n0", "n1"])

    for part in parts:
        labels = part.column("label").to_numpy(zero_copy_only=False)
        for row, _, data, offsets in B.text_blocks(part.column("text")):
            rows, hashes = _distinct(*terms(data, offsets))
            held.append((hashes, labels[row + rows]))
            size += len(rows)
            if size >= HELD:
                yield out()
                held, size = [], 0
    if held:
        yield out()


def vocabulary(texts: DataFrame) -> np.ndarray:
    """The sorted hashes of the chosen terms of (label, text) rows, TERMS at most."""
    counts = texts.select("label", "text").mapInArrow(_counts, "term bigint, n0 bigint, n1 bigint").groupBy("term").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counts = counts.withColumn("n", F.col("n0") + F.col("n1")).where(F.col("n") >= LEAST)
    n0, n1 = texts.agg(F.count_if(F.col("label") == 0), F.count_if(F.col("label") == 1)).first()
    share = F.lit((n1 or 0) / max(1, (n0 or 0) + (n1 or 0)))
    part = lambda seen, expected: F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)
    apart = part(F.col("n1"), F.col("n") * share) + part(F.col("n0"), F.col("n") * (1 - share))
    counts = counts.withColumn("apart", apart)
    strong = counts.where(F.col("apart") >= APART).orderBy(F.desc("apart"), "term").limit(TERMS - FREQUENT).select("term")
    often = counts.where(F.col("apart") < APART).orderBy(F.desc("n"), "term").limit(FREQUENT).select("term")
    return np.sort(strong.unionByName(often).toPandas()["term"].to_numpy(np.int64).view(np.uint64))


class Terms:
    """Finds known terms in texts; a filter by the upper bits spares most searches."""

    def __init__(self, hashes: np.ndarray):
        self.hashes = hashes
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, number) of the known terms of each row, each once."""
        rows, hashes = terms(data, offsets)
        some = self.maybe[(hashes >> np.uint64(44)).astype(np.int64)]
        rows, hashes = rows[some], hashes[some]
        at = np.minimum(np.searchsorted(self.hashes, hashes), max(len(self.hashes) - 1, 0))
        known = self.hashes[at] == hashes if len(self.hashes) else np.zeros(len(hashes), bool)
        pairs = np.unique(rows[known] * np.int64(TERMS) + at[known])
        return pairs // TERMS, pairs % TERMS


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Machine:
    """b, w and v of a factorization machine over bits."""

    def __init__(self, size: int, bias: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.b, self.w, self.v, self.temperature = np.array(bias), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS)), 1.0

    def logits(self, rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        """Of n texts given by their (row, number) pairs, in the order of rows."""
        out = np.full(n, float(self.b))
        if not len(rows):
            return out
        first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
        v = self.v[numbers]
        total = np.add.reduceat(v, first, axis=0)
        out[rows[first]] += np.add.reduceat(self.w[numbers], first) + 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((v**2).sum(axis=1), first))
        return out

    def fit(self, bits: np.ndarray, labels: np.ndarray, seed: int = 12) -> None:
        """Adam over shuffled batches; bits: packed, a row a text."""
        rng, size = np.random.default_rng(seed), len(self.w)
        state = [[np.zeros_like(p), np.zeros_like(p)] for p in (self.b, self.w, self.v)]
        step, batches = 0, max(1, len(bits) // BATCH)
        for epoch in range(EPOCHS):
            for some in np.array_split(rng.permutation(len(bits)), batches):
                x = np.unpackbits(bits[some], axis=1, count=size).astype(np.float32)
                total = x @ self.v.astype(np.float32)
                logit = self.b + x @ self.w + 0.5 * ((total**2).sum(axis=1) - x @ (self.v**2).sum(axis=1))
                error = (_sigmoid(logit) - labels[some]) / len(some)
                seen = x.T @ np.column_stack([error, error[:, None] * total]).astype(np.float32)
                step += 1
                rate = STEP * (1 - 0.7 * epoch / EPOCHS)
                for p, g, (m, s) in zip((self.b, self.w, self.v), (error.sum(), seen[:, 0], seen[:, 1:] - seen[:, :1] * self.v), state, strict=True):
                    m *= 0.9
                    m += 0.1 * g
                    s *= 0.999
                    s += 0.001 * g * g
                    p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
                self.w[:] = np.sign(self.w) * np.maximum(np.abs(self.w) - rate * SHRINK, 0)
                self.v *= 1 - rate * DECAY

    def scores(self, rows: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
        return _sigmoid(self.logits(rows, numbers, n) / self.temperature)


def _bits(known: Terms):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, end, data, offsets in B.text_blocks(part.column("text")):
                rows, numbers = known.of(data, offsets)
                cuts = np.searchsorted(rows, np.arange(end - row + 1))
                packed = []
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    bits = np.zeros(max(len(known.hashes), 1), bool)
                    bits[numbers[a:b]] = True
                    packed.append(np.packbits(bits).tobytes())
                yield pa.RecordBatch.from_arrays([*(part.column(c).slice(row, end - row) for c in ("hash", "label")), pa.array(packed, pa.binary())], names=["hash", "label", "bits"])

    return run


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = MAX_LABELLED):
    """(terms, scores): what finds the terms of texts and what scores them, learned from at most ``limit`` labelled texts."""
    known = labels.where(F.col(label).isin(0, 1) & F.col(id).isNotNull()).groupBy(F.col(id).alias("_id")).agg(F.max(label).cast("int").alias("label"))
    chosen = known.withColumn("hash", F.xxhash64(F.lit(9), "_id")).orderBy("hash", "_id").limit(limit)
    texts = df.select(F.col(id).alias("_id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "_id")  # limit rows at most
    held_terms = Terms(vocabulary(texts))
    found = texts.select("hash", "label", "text").mapInArrow(_bits(held_terms), "hash bigint, label int, bits binary").orderBy("hash", "bits").limit(limit).toPandas()
    y = found["label"].to_numpy(np.float64) if len(found) else np.zeros(0)
    if not 0 < y.sum() < len(y):
        share = float(y.mean()) if len(y) else 0.5
        return held_terms, lambda rows, numbers, n: np.full(n, share)
    size = max(len(held_terms.hashes), 1)
    bits = np.frombuffer(b"".join(found["bits"]), np.uint8).reshape(len(found), -1)
    held = found["hash"].to_numpy() % 5 == 0
    if not 0 < y[~held].sum() < (~held).sum():
        held[:] = False
    share = y[~held].mean()
    machine = Machine(size, float(np.log(share / (1 - share))))
    machine.fit(bits[~held], y[~held])
    if held.any():
        rows, numbers = np.nonzero(np.unpackbits(bits[held], axis=1, count=size))
        logit, t = machine.logits(rows, numbers, int(held.sum())), y[held]
        loss = lambda h: -np.mean(np.log(np.where(t == 1, _sigmoid(logit / h), _sigmoid(-logit / h)) + 1e-12))
        machine.temperature = float(min(np.geomspace(0.5, 8, 41), key=loss))
    return held_terms, machine.scores


def score(df: DataFrame, known: Terms, scores, text: str = "text", name: str = "score") -> DataFrame:
    """The table without its text and with a score of it."""
    names = [c for c in df.columns if c != text]
    if name in names:
        raise ValueError(f"{name} is a column already; give the score another name")

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            found = np.zeros(part.num_rows)
            for row, end, data, offsets in B.text_blocks(part.column(text)):
                found[row:end] = scores(*known.of(data, offsets), end - row)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(found)], names=[*names, name])

    schema = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names] + [f"`{name}` double"])
    return df.mapInArrow(run, schema)


def held_out(id: str, parts: int = 3, rest: int = 1) -> Column:
    """Whether an id is kept from learning; a null id is."""
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts == rest, F.lit(True))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    labels = table(spark, sf_dir, "labels").where(~held_out("doc_id"))
    out = score(docs, *fit(docs, labels))
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
