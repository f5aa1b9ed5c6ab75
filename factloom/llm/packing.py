"""Packing of token ids into sequences of a fixed capacity by first-fit decreasing with a tournament tree.

1. Tasks encode whole texts; an id marks the end of each document. Words are encoded once per task and looked up.
2. Documents are dealt into randomised groups by a hash of their id; a group is a few thousand documents, fewer if they are
   long, so a tournament tree of bin capacities (the root holds the most room; descend to the first bin with
   enough) packs it in O(n log n).
3. Pieces as long as the capacity are sequences of their own; the rest is packed in decreasing order. Then the emptiest
   bins are dissolved: their pieces are cut to fill the gaps of the others, so a group has one partly filled
   sequence at most.

Defined results: a null or empty text is the end id alone; repeated rows are packed one by one; an empty table gives
no rows; a document longer than the capacity is cut at multiples of it.
"""

from __future__ import annotations

import gc
import math
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.tables import table

CAPACITY = 4096
END = 2
TOKENIZER = "word_bpe_49k.json"
#: Documents and bytes of text of a group at most on average; the number of groups follows the input.
GROUP_DOCS, GROUP_BYTES = 2048, 16 << 20
#: Words that a task remembers before it starts anew.
REMEMBERED = 200_000
WORDS_A_CALL = 32


_CUT = re.compile(r"[^\S\x1c-\x1f]+")
#: A word of Latin letters whose lower case has as many letters, and the ASCII punctuation after it; or any other word.
_LETTERS = re.compile(r"(?m)^(?:([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)$|.*$)")


class WordEncoder:
    """Ids of white-space separated words by a tokenizers file that drops white space; each word is encoded once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocab.values()) + 1, bool)
        self.last[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.tails: dict[str, bytes] = {"": b""}
        self.known: dict[str, bytes] = {}
        self.late: list[str] = []

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint16) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> None:
        """Words of letters: several in one call, cut after the tokens that end a word."""
        parts = [words[at : at + WORDS_A_CALL] for at in range(0, len(words), WORDS_A_CALL)]
        for part, ids in zip(parts, self._encode([" ".join(p) for p in parts]), strict=True):
            ends = (2 * np.flatnonzero(self.last[ids]) + 2).tolist()
            if len(ends) != len(part):  # a letter that isn't one any more in lower case
                self.known.update((w, x.tobytes()) for w, x in zip(part, self._encode(part), strict=True))
                continue
            raw = ids.tobytes()
            self.known.update((w, raw[i:j]) for w, i, j in zip(part, [0, *ends], ends, strict=False))

    def _learn(self, words: list[str]) -> None:
        """Letters and the ASCII punctuation after them are words of their own to the tokenizer."""
        known, tails, odd = self.known, self.tails, []
        cut = _LETTERS.findall("\n".join(words))  # one for each word, empty if it is of another form
        low = "\n".join([core for core, _ in cut]).lower().split("\n")
        tails.update((tail, self._encode([tail])[0].tobytes()) for tail in {t for _, t in cut}.difference(tails) if len(tails) < 1000)
        cores = set(low).difference(known)
        cores.discard("")
        self._letters(list(cores))
        self.late += cores if self.late else ()
        for word, core, (_, tail) in zip(words, low, cut, strict=True):
            if core and tail in tails:
                known[word] = known[core] + tails[tail]
            else:
                odd.append(word)
        known.update((w, x.tobytes()) for w, x in zip(odd, self._encode(odd), strict=True))

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as unsigned 16-bit numbers."""
        was = gc.isenabled()
        gc.disable()  # a block makes no cycles; the collector would walk its lists and tuples of words again and again
        try:
            return self._ids(texts)
        finally:
            if was:
                gc.enable()

    def _ids(self, texts: list[str]) -> list[bytes]:
        # str.split() takes Unicode white space for a border, which the tokenizer drops, and four control characters, which it doesn't.
        split = [_CUT.split(t) if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split() for t in texts]
        known = self.known
        if new := list(set().union(*split).difference(known)):
            if len(known) > REMEMBERED:  # the first words stay, they are the frequent ones; rare ones come and go
                self.late += new
            self._learn(new)
        found = known.__getitem__
        ids = [b"".join(map(found, ws)) for ws in split]
        if len(self.late) > REMEMBERED // 2:
            for word in self.late:
                known.pop(word, None)
            self.late = []
        return ids


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for each Python process, which outlives a task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # cores are the tasks'
    return WordEncoder(path)


def encode(df: DataFrame, id: str, text: str, path: str, end: int = END) -> DataFrame:
    """(id, ids): unsigned 16-bit ids in little-endian order of each whole text, then the end id."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = word_encoder(path), np.array([end], np.uint16).tobytes()
        for part in parts:
            row = 0
            while row < len(part):
                size, stop = 0, row
                texts = []
                while stop < len(part) and (size < 1 << 20 or stop == row):
                    texts.append(part.column(1)[stop].as_py() or "")
                    size += len(texts[-1])
                    stop += 1
                ids = [x + last for x in encoder.ids(texts)]
                yield pa.RecordBatch.from_arrays([part.column(0).slice(row, stop - row), pa.array(ids, pa.binary())], names=["id", "ids"])
                row = stop

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(batches, f"id {kind}, ids binary")


class Tournament:
    """First bin with enough room: a complete binary tree whose inner nodes hold the most room below them."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.leaves)

    def put(self, size: int) -> int:
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        room[node] -= size
        found = node - self.leaves
        while node > 1:
            node //= 2
            left, right = room[2 * node], room[2 * node + 1]
            room[node] = left if left >= right else right
        return found


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """(item, start, length, bin, offset) of the pieces of items of the given lengths: every unit once, in few bins."""
    pieces, rest = [], []
    bins = 0
    for item, n in enumerate(lengths.tolist()):
        for start in range(0, n - capacity + 1, capacity):
            pieces.append((item, start, capacity, bins, 0))
            bins += 1
        if n % capacity:
            rest.append((n % capacity, item, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    tree, content = Tournament(len(rest), capacity), []
    for n, item, start in rest:
        at = tree.put(n)
        if at == len(content):
            content.append([])
        content[at].append((item, start, n))
    fill = [sum(p[2] for p in c) for c in content]
    order = sorted(range(len(content)), key=lambda b: -fill[b])  # the fullest bins first
    low, high = 0, len(order) - 1
    while low < high:
        to, of = content[order[low]], content[order[high]]
        room = capacity - fill[order[low]]
        if not room:
            low += 1
            continue
        if not of:
            high -= 1
            continue
        item, start, n = of.pop()
        moved = min(room, n)
        to.append((item, start, moved))
        fill[order[low]] += moved
        fill[order[high]] -= moved
        if moved < n:
            of.append((item, start + moved, n - moved))
    for c in filter(None, content):
        offset = 0
        for item, start, n in c:
            pieces.append((item, start, n, bins, offset))
            offset += n
        bins += 1
    return pieces


def pack_documents(df: DataFrame, id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """Pieces (id, start, length, ids as 16-bit numbers, doc_tokens, sequence_id, offset) of all documents.

    A sequence is padded from the end of its last piece. sequence_id holds the group in its upper bits.
    """
    path = path or public_tokenizers.path(TOKENIZER)
    rows, size = df.agg(F.count("*"), F.sum(F.octet_length(F.col(text).cast("string")))).first()
    groups = max(1, math.ceil(rows / GROUP_DOCS), math.ceil((size or 0) / GROUP_BYTES))
    ids = encode(df, id, text, path, end)
    # As text: pandas would make floats of ids that are null here and there.
    # Rows count in the deal too, so that equal rows, or rows without an id, are spread.
    dealt = ids.withColumn("id", F.col("id").cast("string")).withColumn("group", F.pmod(F.xxhash64("id", F.monotonically_increasing_id(), F.lit(11)), F.lit(groups)))

    def apply(group: pd.DataFrame) -> pd.DataFrame:
        held = [np.frombuffer(x, np.uint16) for x in group["ids"]]
        base = int(group["group"].iloc[0]) << 32
        names = group["id"].array
        out = [
            (names[item], start, n, held[item][start : start + n].tobytes(), len(held[item]), base + b, offset)
            for item, start, n, b, offset in pack(np.fromiter(map(len, held), np.int64, len(held)), capacity)
        ]
        return pd.DataFrame(out, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    kind = df.schema[id].dataType.simpleString()
    out = dealt.groupBy("group").applyInPandas(apply, "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnRenamed("id", id)


def digests(pieces: DataFrame, id: str = "doc_id") -> DataFrame:
    """The pieces with the CRC-32 of their ids as unsigned 32-bit little-endian numbers instead of the ids."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            names = part.schema.names
            sums = [zlib.crc32(np.frombuffer(x.as_buffer(), np.uint16).astype("<u4").tobytes()) for x in part.column("ids")]
            columns = [pa.array(sums, pa.int64()) if c == "ids" else part.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=["ids_crc32" if c == "ids" else c for c in names])

    schema = ", ".join(f"{'ids_crc32 long' if f.name == 'ids' else f'`{f.name}` {f.dataType.simpleString()}'}" for f in pieces.schema)
    return pieces.mapInArrow(batches, schema).select(id, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(pack_documents(table(spark, sf_dir, "documents")))
