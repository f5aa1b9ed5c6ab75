"""Byte-pair encoding and decoding of whole texts by batched numpy merge rounds.

The vocabulary file's merges become a sorted array of pair keys (left id, right id) with their ranks. The words of a
batch that aren't known yet lie as symbols in one flat array; a round looks up every adjacent pair by binary search,
takes each word's lowest rank and merges its occurrences from left to right. Words without a pair leave the array.
Decoding gathers the bytes of all ids of a batch from one flat table.

Defined results: a null or empty text has no ids and decodes to the empty text; the string of a special token in a
text is that token, as the library takes it. Repeated rows give equal rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tables import table

TOKENIZER = "byte_bpe_50k.json"
#: Words that a task remembers before it starts anew, and bytes of text that it handles at a time.
REMEMBERED = 400_000
BATCH = 1 << 20
_FAR = np.iinfo(np.int64).max


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones as they are, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """A byte-level BPE vocabulary: ``encode`` gives ids of texts, ``decode`` the bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.of_byte = np.zeros(256, np.int64)
        for letter, byte in letters.items():
            self.of_byte[byte] = vocab[letter]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        size = max([*vocab.values(), *self.special.values()]) + 1
        spelled = [b""] * size
        for token, i in vocab.items():
            spelled[i] = bytes(letters[c] for c in token)
        for token, i in self.special.items():
            spelled[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)
        self.at = np.cumsum([0, *map(len, spelled)])
        self.text_of = [str(i) for i in range(size)]
        self.forget()

    def forget(self) -> None:
        """Known words: word -> place; places' ids lie in one growing array."""
        self.place: dict[str, int] = {}
        self.written: list[str] = []
        self.ids, self.ends, self.used = np.zeros(1 << 16, np.uint16), [0], 0
        for token, i in self.special.items():
            self._keep([token], np.array([i]), np.array([1]))

    def _keep(self, words: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + len(flat)] = flat
        ends = self.used + np.cumsum(counts)
        self.used += len(flat)
        shown, at = [self.text_of[i] for i in flat.tolist()], 0
        for word, n in zip(words, counts.tolist(), strict=True):
            self.place[word] = len(self.written)
            self.written.append(",".join(shown[at : at + n]))
            at += n
        self.ends.extend(ends.tolist())

    def merge(self, symbols: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and their number for each word, from the ids of its bytes."""
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        names = np.arange(len(counts))
        while len(counts):
            starts = np.cumsum(counts) - counts
            word = np.repeat(np.arange(len(counts)), counts)
            pair = (symbols[:-1] << 32) | symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            inside = (word[1:] == word[:-1]) & (self.keys[at] == pair)
            rank = np.full(len(symbols), _FAR)  # of the pair that begins at each symbol
            rank[:-1][inside] = self.ranks[at[inside]]
            least = np.minimum.reduceat(rank, starts)
            ended = least == _FAR
            if ended.any():
                out = ended[word]
                done.append((names[ended], counts[ended], symbols[out]))
                symbols, rank, least, counts, names = symbols[~out], rank[~out], least[~ended], counts[~ended], names[~ended]
                at = np.append(at, 0)[~out]
                word = np.repeat(np.arange(len(counts)), counts)
                if not len(counts):
                    break
            else:
                at = np.append(at, 0)
            first = rank == least[word]
            if (first[1:] & first[:-1]).any():  # a symbol pair with itself: every other one of a run from its left
                i = np.arange(len(first))
                begin = np.maximum.accumulate(np.where(first & ~np.append(False, first[:-1]), i, 0))
                first &= (i - begin) % 2 == 0
            symbols = np.where(first, self.made[at], symbols)
            second = np.append(False, first[:-1])
            counts = counts - np.bincount(word[first], minlength=len(counts))
            symbols = symbols[~second]
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        names, counts, flat = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(names, kind="stable")
        starts = np.cumsum(counts) - counts
        return flat[_gather(starts[order], counts[order])], counts[order]

    def learn(self, words: list[str]) -> None:
        raw = [w.encode() for w in words]
        counts = np.fromiter(map(len, raw), np.int64, len(raw))
        self._keep(words, *self.merge(self.of_byte[np.frombuffer(b"".join(raw), np.uint8)], counts))

    def split(self, text: str) -> list[str]:
        """The words that merges don't cross, special tokens among them."""
        if self.cut and any(t in text for t in self.special):
            return [w for part in self.cut.split(text) if part for w in ([part] if part in self.special else self.pattern.findall(part))]
        return self.pattern.findall(text)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[str]]:
        """For each text its ids and the ids written in decimal with commas."""
        split = [self.split(t) for t in texts]
        if len(self.place) > REMEMBERED:
            self.forget()
        if new := set().union(*split).difference(self.place):
            self.learn(list(new))
        ends, ids, shown = np.array(self.ends), [], []
        for words in split:
            at = [self.place[w] for w in words]
            shown.append(",".join([self.written[i] for i in at]))
            at = np.array(at, np.int64)
            ids.append(self.ids[_gather(ends[at], ends[at + 1] - ends[at])])
        return ids, shown

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The text of each list of ids in UTF-8; bytes that aren't UTF-8 become U+FFFD."""
        flat = np.concatenate([np.zeros(0, np.uint16), *ids]).astype(np.int64)
        sizes = self.at[flat + 1] - self.at[flat]
        raw = self.bytes[_gather(self.at[flat], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.cumsum([0, *map(len, ids)])].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _gather(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each stretch, one after the other."""
    total = int(counts.sum())
    shift = np.repeat(starts - (np.cumsum(counts) - counts), counts)
    return np.arange(total) + shift


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def _batches(part: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    row = 0
    while row < len(part):
        texts, size = [], 0
        while row + len(texts) < len(part) and (not texts or size < BATCH):
            texts.append(part.column(1)[row + len(texts)].as_py() or "")
            size += len(texts[-1])
        yield row, texts
        row += len(texts)


def encode(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, ids array<int>) of each whole text."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, texts in _batches(part):
                ids, _ = codec(path).encode(texts)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(row, len(texts)), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=[id, "ids"])

    return df.select(id, F.col(text).cast("string")).mapInArrow(run, f"`{id}` {df.schema[id].dataType.simpleString()}, ids array<int>")


def decode(df: DataFrame, id: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """(id, text) of lists of ids; null is the empty list."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists = [np.array(x.as_py() or [], np.uint16) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([x.decode() for x in codec(path).decode(lists)], pa.string())], names=[id, "text"])

    return df.select(id, ids).mapInArrow(run, f"`{id}` {df.schema[id].dataType.simpleString()}, text string")


def digests(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): both directions in one pass, so that ids needn't leave the task."""
    path = path or public_tokenizers.path(TOKENIZER)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for row, texts in _batches(part):
                ids, shown = codec(path).encode(texts)
                columns = [
                    part.column(0).slice(row, len(texts)),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.encode()).hexdigest() for x in shown], pa.string()),
                    pa.array([hashlib.sha256(x).hexdigest() for x in codec(path).decode(ids)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(id, F.col(text).cast("string")).mapInArrow(run, f"`{id}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))
