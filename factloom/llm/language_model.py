"""Scoring of texts by a causal self-attention model over subword ids, next to a word-count baseline.

Tokens are lower-cased (A-Z) words and an end; the model reads the words' byte-level BPE ids, each word after one space,
and an end id. A token's probability is the product of its ids' probabilities, and each of them is
P(class | classes before) * P(id | class, ids before it in its word):

* the class of the next id comes from one head of causal self-attention over the classes before it, in numpy: queries,
  keys and values are tables by class, a bias by distance, x / (1 + |x|) and two softmaxes, one over groups of classes and
  one within the group. Each partition of the training documents trains it in steps over all its windows; the tables of
  all partitions are averaged, by their windows, after each pass;
* P(id | class, ids before it in its word) comes from the counts of words over all training documents. Contexts shorten
  from all ids before it to the last one to none; the shorter one has the weight of Witten and Bell.

No part of a token's probability goes around the attention.

A text is cut into windows of WINDOW ids that overlap by WINDOW - STRIDE; each id is scored once, in the window in which
it has most before it, in batches of masked attention.

Texts are read once, in blocks. A block sends its distinct words with their counts by hash range and keeps the places of
its words; a range encodes each of its words once and sends the ids back. What follows reads ids only.

Defined results: a null or empty text is its end alone; repeated rows count and are scored each; without training
documents all counts are zero and ids are equally likely in their class; a null id is never in training.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import blocks as B
from factloom.llm.bpe import TOKENIZER, _gather, codec
from factloom.llm.quality_model import held_out
from factloom.llm.substring_dedup import LAST, _join, _ranges, block_count
from factloom.llm.tables import checkpoint_dir, table

GROUPS, MEMBERS, WIDTH, KEYS = 10, 10, 32, 16
"""Groups of classes, classes of a group, width of values and of queries and keys."""
CLASSES = GROUPS * MEMBERS
WINDOW, STRIDE = 32, 24
#: Passes over the training documents; after each the partitions' tables are averaged.
PASSES, BATCH, RATE = 1, 64, 0.01
#: Steps after which the rate has halved, windows that lie in memory at a time, and steps over which tables are averaged.
HALVED, CHUNK, STEADY = 2000, 8192, 50
#: Length of the two random vectors that stand for the ids before and after.
NEAR = 24
#: Bytes of text of a block, and hash ranges of words at most.
BLOCK_BYTES, MOST_RANGES = 6 << 20, 512
#: The end of a text among word hashes.
END_HASH = np.uint64(0)


_LN10 = math.log(10)


class Words:
    """The words of a block: hashes of all words in order, the distinct ones sorted, and their BPE ids."""

    def __init__(self, texts: pa.Array):
        hashes, counts, spans = [], [np.zeros(0, np.int64)], []
        for _, _, data, offsets in B.text_blocks(texts):
            starts, ends, rows = B.words(data, offsets)
            upper = (data >= 0x41) & (data <= 0x5A)
            low = np.where(upper, data + np.uint8(0x20), data).astype(np.uint8)
            h = B.span_hashes(low, starts, ends)
            h[h == END_HASH] = 1
            keys, first = np.unique(h, return_index=True)
            hashes.append(h)
            counts.append(np.diff(rows))
            spans.append((keys, [low[a:b].tobytes() for a, b in zip(starts[first], ends[first], strict=True)]))
        self.counts = np.concatenate(counts)
        """Words of each row."""
        flat = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.keys, self.of = np.unique(flat, return_inverse=True)
        """Distinct hashes, and the place of each word among them."""
        texts_of: list[bytes] = [b""] * len(self.keys)
        for keys, raw in spans:
            for at, word in zip(np.searchsorted(self.keys, keys).tolist(), raw, strict=True):
                texts_of[at] = word
        self.texts = texts_of


def encode_words(words: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, number of ids of each word); a word has one space before it."""
    c = codec(path)
    split = [c.split(" " + w.decode()) for w in words]
    if len(c.place) > 200_000:
        c.forget()
    if new := set().union(*split).difference(c.place):
        c.learn(list(new))
    ends = np.array(c.ends)
    at = np.array([c.place[p] for parts in split for p in parts], np.int64)
    size = ends[at + 1] - ends[at]
    bounds = np.append(0, np.cumsum(size))[np.cumsum([0, *map(len, split)])]
    return c.ids[_gather(ends[at], size)].astype(np.int64), np.diff(bounds)


class Model:
    """Tables of the network and log10 probabilities of ids in their classes."""

    def __init__(self, classes: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.classes = classes
        n = CLASSES + 1  # the last stands for the start of a text
        shapes = {"q": (n, KEYS), "k": (n, KEYS), "v": (n, WIDTH), "p": (n, WIDTH), "d": (WINDOW,), "w": (WIDTH, GROUPS + CLASSES), "b": (GROUPS + CLASSES,)}
        self.t = {k: rng.normal(0, 0.0 if k in "db" else 0.3, s).astype(np.float32) for k, s in shapes.items()}
        gap = np.arange(WINDOW)[:, None] - np.arange(WINDOW)
        self.causal, self.gap = gap >= 0, np.maximum(gap, 0)
        self.steps = 0
        self.fill(self.flat())
        self.first, self.second = np.zeros_like(self.all), np.zeros_like(self.all)

    def flat(self) -> np.ndarray:
        return np.concatenate([t.ravel() for t in self.t.values()])

    def fill(self, flat: np.ndarray) -> None:
        """Takes the tables from one array; they stay parts of it. ``mean`` follows them through the steps, some STEADY of them behind."""
        self.all = flat.astype(np.float32)
        self.mean = self.all.copy()
        ends = np.cumsum([t.size for t in self.t.values()])
        self.t = {k: x.reshape(t.shape) for (k, t), x in zip(self.t.items(), np.split(self.all, ends[:-1]), strict=True)}

    def train(self, x: np.ndarray, y: np.ndarray, rate: float = RATE) -> None:
        """Steps over windows in a random order; further calls go on from there. x, y: (windows, WINDOW) classes before and to tell; y -1: nothing to tell."""
        order = np.random.default_rng(9 + self.steps).permutation(len(x))
        for at in range(0, len(x), BATCH):
            self.steps += 1
            i = order[at : at + BATCH]
            now = rate / (1 + self.steps / HALVED) / (1 - 0.9**self.steps)
            g = self._gradients(x[i], y[i])
            g = np.concatenate([g[k].ravel() for k in self.t], dtype=np.float32)
            self.first += np.float32(0.1) * (g - self.first)
            self.second += np.float32(0.01) * (g * g - self.second)
            self.all -= np.float32(now) * self.first / (np.sqrt(self.second * np.float32(1 / (1 - 0.99**self.steps))) + np.float32(1e-8))
            self.mean += (self.all - self.mean) * np.float32(1 / STEADY)

    def _pull(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of attention before they are divided by their sum: by two classes, and by two places."""
        table = self.t["q"] @ self.t["k"].T / np.float32(math.sqrt(KEYS))
        pull = np.exp(table - table.max(axis=1, keepdims=True))
        return pull, np.where(self.causal, np.exp(self.t["d"] - self.t["d"].max())[self.gap], np.float32(0))

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        t, n = self.t, CLASSES + 1
        pull, fade = self._pull()
        of = (x * n)[:, :, None] + x[:, None, :]
        a = pull.ravel().take(of)
        a *= fade
        a /= (a @ np.ones(x.shape[1], np.float32))[:, :, None]
        v = t["v"][x]
        mean = a @ v
        h = mean + t["p"][x]
        r = np.abs(h)
        r += 1
        np.divide(1, r, out=r)
        h *= r
        y = y.ravel()
        told = np.flatnonzero(y >= 0)
        told = told[np.argsort((y[told] // MEMBERS).astype(np.uint8), kind="stable")]  # by group: each has its own outputs
        group, member = y[told] // MEMBERS, y[told] % MEMBERS
        parts = _parts(group)
        w, b, h = t["w"], t["b"], h.reshape(-1, WIDTH)[told]
        gw, gb = np.zeros_like(w), np.zeros_like(b)

        def wrong(z: np.ndarray, right: np.ndarray) -> np.ndarray:
            z -= z.max(axis=0)
            np.exp(z, out=z)
            z /= np.float32(max(1, len(told))) * z.sum(axis=0)
            z[right, np.arange(len(right))] -= np.float32(1 / max(1, len(told)))
            return z

        outer = wrong(w[:, :GROUPS].T @ h.T + b[:GROUPS, None], group)
        gw[:, :GROUPS], gb[:GROUPS] = (outer @ h).T, outer.sum(axis=1)
        back_told = outer.T @ w[:, :GROUPS].T
        inner = np.empty((MEMBERS, len(told)), np.float32)
        for own, s in parts:
            inner[:, s] = w[:, own].T @ h[s].T + b[own, None]
        inner = wrong(inner, member)
        for own, s in parts:
            gw[:, own], gb[own] = (inner[:, s] @ h[s]).T, inner[:, s].sum(axis=1)
            back_told[s] += inner[:, s].T @ w[:, own].T
        back = np.zeros((x.size, WIDTH), np.float32)
        back[told] = back_told
        back = back.reshape(mean.shape)
        r *= r
        back *= r
        ds = back @ v.transpose(0, 2, 1)
        ds -= np.einsum("bij,bij->bi", back, mean)[:, :, None]
        ds *= a
        pairs = np.bincount(of.ravel(), ds.ravel(), n * n).reshape(n, n).astype(np.float32) / np.float32(math.sqrt(KEYS))
        both = np.concatenate([back, a.transpose(0, 2, 1) @ back], axis=2).reshape(x.size, -1)
        order = np.argsort(x.ravel().astype(np.uint8), kind="stable")
        ordered = x.ravel()[order]
        starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        sums = np.zeros((n, 2 * WIDTH), np.float32)
        sums[ordered[starts]] = np.add.reduceat(both[order], starts, axis=0)
        far = np.bincount(self.gap[self.causal], ds.sum(axis=0)[self.causal], WINDOW).astype(np.float32)
        return {"w": gw, "b": gb, "p": sums[:, :WIDTH], "v": sums[:, WIDTH:], "q": pairs @ t["k"], "k": pairs.T @ t["q"], "d": far}

    def ready(self, counts: np.ndarray) -> None:
        """Sets log10 P(id | class) from the counts of ids, and single-precision tables for scoring."""
        total = np.bincount(self.classes, counts + 0.1, CLASSES)
        self.inside = np.log10((counts + 0.1) / total[self.classes])
        self.pull, self.fade = self._pull()
        self.f = {k: np.ascontiguousarray(self.t[k], np.float32) for k in "pwb"}
        self.f["v"] = np.append(self.t["v"], np.ones((len(self.t["v"]), 1)), axis=1).astype(np.float32)  # the last column adds up the weights

    def begin(self, counts: np.ndarray) -> None:
        """Lets the outputs begin near how often training has each class."""
        often = np.maximum(np.bincount(self.classes, counts + 0.1, CLASSES), 0.1).reshape(GROUPS, MEMBERS)  # a class may have no ids
        self.t["b"][:] = np.log(np.append(often.sum(axis=1) / often.sum(), often / often.sum(axis=1, keepdims=True)))
        self.t["w"][:] *= 0.1

    def window_scores(self, x: np.ndarray, y: np.ndarray, first: int = 0) -> np.ndarray:
        """log10 P(class y | x before) of each place of windows of classes, from the place ``first`` on."""
        y = y[:, first:]
        a = self.pull.ravel().take((x[:, first:] * self.pull.shape[1])[:, :, None] + x[:, None, :])
        a *= self.fade[first:]
        h = a @ self.f["v"][x]
        h = h[:, :, :WIDTH] / h[:, :, WIDTH:]
        h += self.f["p"][x[:, first:]]
        r = np.abs(h)
        r += 1
        h /= r
        order = np.argsort((y.ravel() // MEMBERS).astype(np.uint8), kind="stable")
        told = y.ravel()[order]
        group, member, rows = told // MEMBERS, told % MEMBERS, np.arange(len(told))
        h = h.reshape(-1, WIDTH)[order]
        w, b = self.f["w"], self.f["b"]
        outer, inner = w[:, :GROUPS].T @ h.T + b[:GROUPS, None], np.empty((MEMBERS, len(told)), np.float32)
        for own, s in _parts(group):
            inner[:, s] = w[:, own].T @ h[s].T + b[own, None]
        right = outer[group, rows] + inner[member, rows]
        total = np.exp(outer, out=outer).sum(axis=0) * np.exp(inner, out=inner).sum(axis=0)  # h and the weights keep both small
        out = np.empty(len(told), np.float32)
        out[order] = (right - np.log(total)) / np.float32(_LN10)
        return out.reshape(y.shape)

    def class_scores(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log10 probability of each id's class; ids: flat, each row's end with its end id; rows: offsets (no row is empty)."""
        c = self.classes[ids]
        before = np.append(CLASSES, c[:-1])
        before[rows[:-1]] = CLASSES
        sizes = np.diff(rows)
        windows = 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE))
        begin = np.repeat(rows[:-1], windows)
        at = begin + STRIDE * _gather(np.zeros(len(sizes), np.int64), windows)
        end = np.repeat(rows[1:], windows)
        out = np.empty(len(ids))
        for fresh, chosen in ((0, at == begin), (WINDOW - STRIDE, at != begin)):
            firsts, ends = at[chosen], end[chosen]
            for i in range(0, len(firsts), BATCH):
                place = firsts[i : i + BATCH, None] + np.arange(WINDOW)
                told = (place < ends[i : i + BATCH, None])[:, fresh:]
                within = np.minimum(place, len(ids) - 1)
                out[place[:, fresh:][told]] = self.window_scores(before[within], c[within], fresh)[told]
        return out

    def score(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """log10 probability of each id, if nothing but its class is known of the ids before it in its word."""
        return self.class_scores(ids, rows) + self.inside[ids]


def _parts(group: np.ndarray) -> list[tuple[slice, slice]]:
    """(outputs of a group, its places) of each group that sorted groups hold."""
    ends = np.searchsorted(group, np.arange(GROUPS + 1)).tolist()
    return [(slice(GROUPS + g * MEMBERS, GROUPS + (g + 1) * MEMBERS), slice(i, j)) for g, (i, j) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if j > i]


def neighbours(ids: np.ndarray, rows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(counts, sums): how often each id occurs, and the summed random vectors of the ids before and after it."""
    sign = np.random.default_rng(4).choice([-1.0, 1.0], (size, NEAR)).astype(np.float32)
    inside = np.ones(max(0, len(ids) - 1), bool)
    inside[rows[1:-1] - 1] = False
    near = np.zeros((size, 2 * NEAR), np.float32)
    left, right = ids[:-1][inside].astype(np.uint64), ids[1:][inside].astype(np.uint64)
    for at, of, other in ((0, right, left), (NEAR, left, right)):
        pairs = np.sort(of << np.uint64(32) | other)
        if len(pairs):
            new = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            times = np.diff(np.append(new, len(pairs))).astype(np.float32)
            of, other = (pairs[new] >> np.uint64(32)).astype(np.int64), (pairs[new] & np.uint64(0xFFFFFFFF)).astype(np.int64)
            firsts = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
            near[of[firsts], at : at + NEAR] = np.add.reduceat(sign[other] * times[:, None], firsts, axis=0)
    return np.bincount(ids, minlength=size), near


def group_ids(counts: np.ndarray, near: np.ndarray, end: int) -> np.ndarray:
    """The class of each id: frequent ids have one each, the others are clustered by what stands before and after them."""
    size = len(counts)
    order = np.argsort(-counts, kind="stable")
    own = CLASSES // 3
    classes = np.full(size, -1)
    classes[order[: own - 1]] = np.arange(own - 1)
    classes[end] = own - 1
    near = near / np.maximum(np.linalg.norm(near, axis=1, keepdims=True), 1e-6)
    rest = np.flatnonzero(classes < 0)
    seen = rest[counts[rest] > 0]
    k = CLASSES - own
    if len(seen) >= k:
        centres = near[seen[np.argsort(-counts[seen], kind="stable")[:k]]]
        for _ in range(8):
            of = np.argmax(near[seen] @ centres.T, axis=1)
            sums = np.zeros_like(centres)
            np.add.at(sums, of, near[seen] * np.sqrt(counts[seen])[:, None])
            centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-6)
        classes[seen] = own + np.argmax(near[seen] @ centres.T, axis=1)
    unseen = classes < 0
    classes[unseen] = own + np.arange(size)[unseen] % k
    return classes


def windows_of(ids: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Windows of classes before and to tell, for training, CHUNK at a time."""
    c = classes[ids]
    before = np.append(CLASSES, c[:-1])
    before[rows[:-1]] = CLASSES
    windows = -(-np.diff(rows) // WINDOW)
    first = np.repeat(rows[:-1], windows) + WINDOW * _gather(np.zeros(len(windows), np.int64), windows)
    end = np.repeat(rows[1:], windows)
    for at in range(0, len(first), CHUNK):
        place = first[at : at + CHUNK, None] + np.arange(WINDOW)
        inside = place < end[at : at + CHUNK, None]
        place = np.minimum(place, len(ids) - 1)
        yield np.where(inside, before[place], CLASSES), np.where(inside, c[place], -1)


def _pack(x: np.ndarray) -> bytes:
    """The length and the compressed bytes of numbers, all first bytes first: high bytes are mostly alike."""
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _length(raw: bytes) -> int:
    return int.from_bytes(raw[:8], "little")


def _unpack(raw: bytes, kind) -> np.ndarray:
    n, width = _length(raw), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw[8:], n * width, codec="zstd", asbytes=True), np.uint8) if n else np.zeros(0, np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)


def _unpacked(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(_unpack(x, kind) for x in column)])


def _seen(part: dict) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids, offsets) of the training rows of a block."""
    ids, rows, training = _unpack(part["seq"], np.uint16), np.frombuffer(part["rows"], np.int64), np.frombuffer(part["training"], bool)
    sizes = np.diff(rows)
    return ids[np.repeat(training, sizes)].astype(np.int64), np.append(0, np.cumsum(sizes[training]))


def _dicts(parts: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for part in parts:
        for i in range(len(part)):
            yield part.slice(i, 1).to_pylist()[0]


def fit(spelled: DataFrame, size: int, end: int) -> Model:
    """The attention and the counts of ids, learned from the ids of all training rows. spelled: (seq, rows, training) of blocks.

    To the driver come sums by id of the vocabulary and by element of the tables, whatever the size of the input.
    """

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(size, np.int64), np.zeros((size, 2 * NEAR), np.float32)
        for part in _dicts(parts):
            more, near_by = neighbours(*_seen(part), size)
            counts += more
            sums += near_by
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (seen, counts[seen], *sums[seen].T)], names=["i", "n", *columns])

    columns = [f"s{j}" for j in range(2 * NEAR)]
    found = spelled.mapInArrow(near, "i bigint, n bigint, " + ", ".join(f"{c} float" for c in columns))
    found = found.groupBy("i").agg(F.sum("n").alias("n"), *(F.sum(c).cast("float").alias(c) for c in columns)).toPandas()  # a row for each id of the vocabulary at most
    counts, sums = np.zeros(size, np.int64), np.zeros((size, 2 * NEAR), np.float32)
    counts[found["i"]], sums[found["i"]] = found["n"], found[columns]
    if not len(found):
        model = Model(np.arange(size) % CLASSES)
        model.ready(counts)
        return model
    model = Model(group_ids(counts, sums, end))
    model.begin(counts)

    def learner(flat: np.ndarray, rate: float):
        def learn(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, seen = Model(model.classes), 0
            own.fill(flat)
            for part in _dicts(parts):
                for x, y in windows_of(*_seen(part), own.classes):
                    own.train(x, y, rate)
                    seen += len(x)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(own.mean.astype(float) * seen), pa.array(np.full(len(flat), float(seen)))], names=["at", "value", "weight"])

        return learn

    for turn in range(PASSES):
        total = spelled.mapInArrow(learner(model.flat(), RATE / 2**turn), "at int, value double, weight double").groupBy("at").agg((F.sum("value") / F.sum("weight")).alias("value"))
        model.fill(total.orderBy("at").toPandas()["value"].to_numpy())
    model.ready(counts)
    return model


def spelled_weight(kinds: np.ndarray | int, tokens: np.ndarray | int) -> np.ndarray | float:
    """The weight of the shorter context where a context has ``tokens`` ids of ``kinds`` kinds (Witten and Bell); all of it without any."""
    return np.where(np.equal(tokens, 0), 1.0, kinds / np.maximum(1, np.add(tokens, kinds)))


def _narrowed(context: np.ndarray, ids: np.ndarray, n: np.ndarray, classes: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """P(id | its class, context) of distinct (context, id) with their counts; lower: the same for the shorter context."""
    _, of = np.unique(B.mix(context ^ B.mix(classes[ids].astype(np.uint64) + np.uint64(1))), return_inverse=True)
    tokens, kinds = np.bincount(of, n)[of], np.bincount(of, n > 0)[of]
    rest = spelled_weight(kinds, tokens)
    return (1 - rest) * n / np.maximum(1, tokens) + rest * lower


def told(full: np.ndarray, last: np.ndarray, ids: np.ndarray, n: np.ndarray, model: Model) -> np.ndarray:
    """log10 P(id | its class, the ids before it in its word) of each entry.

    full: a hash of all ids before it; last: the one before it, -1 at the start; n: its count. Entries of one pair add up.
    """
    last = (last + 1).astype(np.uint64)
    pairs, first, of = np.unique(last << np.uint64(16) | ids.astype(np.uint64), return_index=True, return_inverse=True)
    near = _narrowed(last[first], ids[first], np.bincount(of, n), model.classes, 10 ** model.inside[ids[first]])[of]
    _, first, of = np.unique(B.mix(full ^ B.mix(ids.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True)
    return np.log10(_narrowed(full[first], ids[first], np.bincount(of, n), model.classes, near[first]))[of]


def contexts(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a hash of all ids before it in its word, the one before it or -1) of each id of words."""
    starts = np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = np.arange(len(flat)) - starts
    return B.gram_hashes(flat.astype(np.uint64) + np.uint64(1), starts, at), np.where(at == 0, -1, np.append(0, flat)[:-1])


def _told_words(vocabulary: DataFrame, model: Model, ranges: int) -> DataFrame:
    """(range, told): the summed log10 P(id | its class, the ids before) of each of the words of each range, in their order.

    A range's entries go to parts by the id before; the parts send back a number for each.
    """

    def spread(flat: np.ndarray, sizes: np.ndarray):
        """Each distinct entry, sorted by part, the first place and the entry of each id, and the ends of parts."""
        full, last = contexts(flat, sizes)
        _, first, of = np.unique(B.mix(full ^ B.mix(flat.astype(np.uint64) + np.uint64(1))), return_index=True, return_inverse=True)
        part = (B.mix(last[first].astype(np.uint64)) % np.uint64(ranges)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return full, last, first[order], place[of], np.searchsorted(part[order], np.arange(ranges + 1))

    def words_of(row) -> tuple[np.ndarray, np.ndarray]:
        return _unpack(row["ids"], np.uint16).astype(np.int64), _unpack(row["sizes"], np.uint32).astype(np.int64)

    def send(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _dicts(parts):
            flat, sizes = words_of(row)
            full, last, first, of, ends = spread(flat, sizes)
            n = np.bincount(of, np.repeat(_unpack(row["counts"], np.int64), sizes), len(first)).astype(np.int64)
            columns = (full[first], last[first].astype(np.int32), flat[first].astype(np.uint16), n)
            rows = [(i, row["range"], *(_pack(x[a:b]) for x in columns)) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], names=["part", "range", "full", "last", "id", "n"])

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        full, last, ids, n = (_unpacked(rows[c], k) for c, k in (("full", np.uint64), ("last", np.int32), ("id", np.uint16), ("n", np.int64)))
        found = told(full, last.astype(np.int64), ids.astype(np.int64), n, model).astype(np.float32)
        ends = np.cumsum([0, *map(_length, rows["full"])])
        return pd.DataFrame({"range": rows["range"], "part": rows["part"], "found": [_pack(found[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]})

    def add(words: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        flat, sizes = words_of(words.iloc[0])
        each = np.append(0.0, np.cumsum(_unpacked(found.sort_values("part")["found"], np.float32)[spread(flat, sizes)[3]], dtype=float))
        ends = np.append(0, np.cumsum(sizes))
        return pd.DataFrame({"range": words["range"], "told": [_pack((each[ends[1:]] - each[ends[:-1]]).astype(np.float32))]})

    sent = vocabulary.mapInArrow(send, "part int, range int, full binary, last binary, id binary, n binary")
    found = sent.groupBy("part").applyInPandas(answer, "range int, part int, found binary")
    return vocabulary.groupBy("range").cogroup(found.groupBy("range")).applyInPandas(add, "range int, told binary")


def _kept(df: DataFrame) -> DataFrame:
    """df, written once into the shared checkpoint folder as a table, of which a reader takes the columns that it needs.

    A row holds a block's megabytes, so few rows make a group of the file, which is what tasks are dealt.
    """
    path = f"{checkpoint_dir(df.sparkSession)}/words-{uuid.uuid4().hex}"
    df.write.options(**{"compression": "zstd", "parquet.block.size": str(4 << 20), "parquet.block.size.row.check.min": "1"}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def score(df: DataFrame, training, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, training, n_tokens, n_known, train_tokens, base_score, score, known_score) of each row.

    training: a condition for the rows to learn from. known_score: the part of score of tokens that training saw.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    size, end = len(codec(path).text_of), codec(path).special["<|endoftext|>"]
    ranges = min(MOST_RANGES, block_count(df, text))
    texts = df.select(F.coalesce(F.col(id).cast("long"), F.lit(LAST)).alias("id"), training.alias("training"), F.col(text).cast("string").alias("text"))

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each block with its rows and the places of their words, and one for each hash range of its distinct words."""
        held: list[pa.RecordBatch] = []
        name = uuid.uuid4().hex

        def block() -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(held)
            held.clear()
            words = Words(rows.column("text").combine_chunks().cast(pa.large_string()))
            train = rows.column("training").to_numpy(zero_copy_only=False).astype(bool)
            counts = np.bincount(words.of, np.repeat(train, words.counts), len(words.keys)).astype(np.int64)
            ends = _ranges(words.keys, ranges).tolist()
            of, ids = _pack(words.of.astype(np.uint32)), rows.column("id").to_numpy().tobytes()
            found = [(name, -1, int(train.sum()), None, None, None, ids, train.tobytes(), words.counts.tobytes(), of)]
            found += [(name, i, 0, _pack(words.keys[a:b]), _pack(counts[a:b]), b" ".join(words.texts[a:b]), *[None] * 4) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.string(), pa.int32(), pa.int64(), *[pa.binary()] * 7), strict=True)], names=names)

        bytes_held = 0
        for part in parts:
            for a, b, data, _ in B.text_blocks(part.column("text")):
                held.append(part.slice(a, b - a))
                bytes_held += len(data)
                if bytes_held >= BLOCK_BYTES:
                    yield from block()
                    bytes_held, name = 0, uuid.uuid4().hex
        if held:
            yield from block()

    names = ["block", "range", "ends", "keys", "counts", "words", "ids", "training", "sizes", "of"]
    sent = _kept(texts.mapInArrow(split, "block string, range int, ends bigint, keys binary, counts binary, words binary, ids binary, training binary, sizes binary, of binary"))
    heads = sent.where("range = -1").select("block", "ids", "training", "sizes", "of")
    ends = int(sent.agg(F.sum("ends")).first()[0] or 0)

    def total(part: pd.DataFrame) -> pd.DataFrame:
        """The range's distinct words, and for each block the places of its words among them."""
        keys, counts = _unpacked(part["keys"], np.uint64), _unpacked(part["counts"], np.int64)
        distinct, first, of = np.unique(keys, return_index=True, return_inverse=True)
        sums = np.bincount(of, counts, len(distinct)).astype(np.int64)
        spelled = [w for x in part["words"] for w in x.split(b" ")]
        flat, sizes = encode_words([spelled[i] for i in first], path)
        flat, sizes, starts = flat.astype(np.uint16), sizes.astype(np.uint32), np.cumsum(sizes) - sizes
        number = int(part["range"].iloc[0])
        rows, at = [(None, number, _pack(sums), _pack(sizes), _pack(flat), None, int((sums > 0).sum()), int(sums.sum()))], 0
        for block, k in zip(part["block"], part["keys"], strict=True):
            own = of[at : at + _length(k)]
            rows.append((block, number, _pack(sums[own]), _pack(sizes[own]), _pack(flat[_gather(starts[own], sizes[own].astype(np.int64))]), _pack(own.astype(np.uint32)), 0, 0))
            at += len(own)
        return pd.DataFrame(rows, columns=["block", "range", "counts", "sizes", "ids", "place", "distinct", "words"])

    back = sent.where("range >= 0").select("block", "range", "keys", "counts", "words").groupBy("range")
    back = _kept(back.applyInPandas(total, "block string, range int, counts binary, sizes binary, ids binary, place binary, distinct bigint, words bigint"))
    vocabulary, known = back.where("block is null"), back.where("block is not null")
    distinct, tokens = vocabulary.agg(F.sum("distinct"), F.sum("words")).first()
    train_tokens = (tokens or 0) + ends
    per_token = math.log10(train_tokens + (distinct or 0) + (ends > 0) + 1)

    def spell(head: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        """The ids of all rows of a block, whether training saw their words, and what the counts of words say."""
        head, parts = head.iloc[0], parts.sort_values("range")
        of, counts = _unpack(head["of"], np.uint32).astype(np.int64), np.frombuffer(head["sizes"], np.int64)
        known, sizes, flat = _unpacked(parts["counts"], np.int64), _unpacked(parts["sizes"], np.uint32), _unpacked(parts["ids"], np.uint16)
        sizes, offsets = np.append(sizes, 1).astype(np.int64), np.append(0, np.cumsum(np.append(sizes, 1)))
        stops = np.append(0, np.cumsum(counts))
        each = lambda x: np.diff(np.append(0, np.cumsum(x))[stops])
        at = np.insert(of, stops[1:], len(sizes) - 1)  # the end after each row's words
        size = sizes[at]
        tokens = np.append(0, np.cumsum(size))
        found = each(known[of] > 0) + (ends > 0)
        base = each(np.log10(known + 1)[of]) + math.log10(ends + 1) - (counts + 1) * per_token
        seq, seen = np.append(flat, np.uint16(end))[_gather(offsets[at], size)], np.repeat(np.append(known > 0, ends > 0)[at], size)
        named = (head["ids"], head["training"], (counts + 1).tobytes(), found.astype(np.int64).tobytes(), base.tobytes(), _pack(seq), tokens[stops + np.arange(len(stops))].tobytes(), _pack(np.packbits(seen)))
        return pd.DataFrame({"block": [head["block"]]} | {n: [x] for n, x in zip((*figures, "seq", "rows", "seen"), named, strict=True)})

    figures = ["id", "training", "n_tokens", "n_known", "base"]
    columns = ", ".join(f"{n} binary" for n in (*figures, "seq", "rows", "seen"))
    spelled = heads.groupBy("block").cogroup(known.select("block", "range", "counts", "sizes", "ids").groupBy("block")).applyInPandas(spell, f"block string, {columns}")
    spelled = _kept(spelled)
    model = fit(spelled.select("seq", "rows", "training"), size, end)
    told_words = _told_words(vocabulary.select("range", "counts", "sizes", "ids"), model, ranges)

    def pick(words: pd.DataFrame, places: pd.DataFrame) -> pd.DataFrame:
        found = _unpack(words["told"].iloc[0], np.float32)
        return places.assign(told=[_pack(found[_unpack(x, np.uint32)]) for x in places["place"]])[["block", "range", "counts", "told"]]

    picked = told_words.groupBy("range").cogroup(known.select("block", "range", "counts", "place").groupBy("range")).applyInPandas(pick, "block string, range int, counts binary, told binary")

    def add_words(head: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
        """The sums over the words of each row, and over those that training saw."""
        head, parts = head.iloc[0], parts.sort_values("range")
        words, seen = _unpacked(parts["told"], np.float32).astype(float), _unpacked(parts["counts"], np.int64) > 0
        of, stops = _unpack(head["of"], np.uint32), np.append(0, np.cumsum(np.frombuffer(head["sizes"], np.int64)))
        sums = (np.diff(np.append(0.0, np.cumsum(x[of]))[stops]).tobytes() for x in (words, np.where(seen, words, 0.0)))
        return pd.DataFrame([(head["block"], *sums)], columns=["block", "words", "seen_words"])

    words = heads.select("block", "sizes", "of").groupBy("block").cogroup(picked.groupBy("block")).applyInPandas(add_words, "block string, words binary, seen_words binary")

    def attend(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sums over the classes of the ids of each row, and over those of words that training saw."""
        for part in _dicts(parts):
            seq, rows = _unpack(part["seq"], np.uint16).astype(np.int64), np.frombuffer(part["rows"], np.int64)
            each, seen = model.class_scores(seq, rows), np.unpackbits(_unpack(part["seen"], np.uint8), count=len(seq))
            own = model.inside[end]
            sums = (np.diff(np.append(0.0, np.cumsum(x))[rows]) + e for x, e in ((each, own), (each * seen, own * (ends > 0))))
            yield pa.RecordBatch.from_arrays([pa.array([part["block"]], pa.string()), *(pa.array([x], pa.binary()) for x in (*(part[n] for n in figures), *(x.tobytes() for x in sums)))], names=["block", *figures, "classes", "seen_classes"])

    attended = spelled.mapInArrow(attend, "block string, " + ", ".join(f"{n} binary" for n in (*figures, "classes", "seen_classes")))

    def rows_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _dicts(parts):
            of = lambda n, kind=np.float64: np.frombuffer(part[n], kind)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of("id", np.int64), of("training", bool), of("n_tokens", np.int64), of("n_known", np.int64), of("base"), of("classes") + of("words"), of("seen_classes") + of("seen_words"))], names=names_out)

    names_out = ["id", "training", "n_tokens", "n_known", "base_score", "score", "known_score"]
    out = attended.join(words, "block").mapInArrow(rows_of, "id bigint, training boolean, n_tokens bigint, n_known bigint, base_score double, score double, known_score double")
    return out.select(F.when(F.col("id") != LAST, F.col("id")).alias(id), "training", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "known_score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, ~held_out("doc_id", 7, 2))
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "known_score")
