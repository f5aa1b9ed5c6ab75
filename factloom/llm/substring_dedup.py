"""Removal of passages that also start in a document with a smaller id, found through difference-cover anchors.

A window is SPAN consecutive words. Windows of ANCHOR = SPAN - PERIOD + 1 words are hashed only at positions whose
remainder modulo PERIOD lies in COVER. COVER is a difference cover: for any two positions some shift below PERIOD
brings both onto it, so two equal windows share an anchor at the same place inside them.

1. Texts are dealt once into blocks by a hash of their id. The later steps read that exchange again.
2. Each block sends its distinct anchors, as sorted arrays cut by hash range. What two documents share goes back.
3. Each block extends: windows around a shared anchor are hashed whole and sent with the smallest id they start at.
4. Windows that start at a smaller id elsewhere go back; the block marks the words that they cover.

A block has one entry for each distinct anchor or window however many of its documents hold it, so a passage
that a third of all documents share is a row for each block, not for each document. Windows are compared by
128 bits: a range and 64 bits of one hash and 64 bits of another.

Defined results: a null or empty text has no words; texts of fewer than SPAN words lose nothing; rows with equal
ids are one document's, so they don't remove each other's words; a row without an id comes after all others.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import blocks as B
from factloom.llm.tables import table

SPAN, PERIOD, COVER = 13, 7, (1, 2, 4)
ANCHOR = SPAN - PERIOD + 1
#: Text of a block, and with as many hash ranges as blocks also the order of what a range gets.
BLOCK_BYTES = 12 << 20
LAST = np.iinfo(np.int64).max
"""Stands for a null id."""


def _words(texts: pa.Array):
    """(first row, bytes, starts, ends, word offsets, word hashes) of consecutive rows."""
    for row, _, data, offsets in B.text_blocks(texts):
        starts, ends, rows = B.words(data, offsets)
        yield row, data, starts, ends, rows, B.span_hashes(data, starts, ends)


def _on_cover(starts: np.ndarray, rows: np.ndarray) -> np.ndarray:
    own = starts - np.repeat(rows[:-1], np.diff(rows))[starts]
    return starts[np.isin(own % PERIOD, COVER)]


def _anchors(hashes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (words of the block) and hashes of the anchors."""
    at = _on_cover(B.gram_starts(rows, ANCHOR), rows)
    return at, B.gram_hashes(hashes, at, ANCHOR)


def _ranges(sorted_hashes: np.ndarray, n: int) -> np.ndarray:
    """Ends of n equal ranges of 64-bit hashes within a sorted array."""
    bounds = np.array([(i << 64) // n for i in range(1, n)], np.uint64)
    return np.concatenate(([0], np.searchsorted(sorted_hashes, bounds), [len(sorted_hashes)])).astype(np.int64)


def _cut(block: int, n: int, keys: np.ndarray, *more: np.ndarray) -> pd.DataFrame:
    """One row for each hash range of arrays sorted by keys."""
    ends = _ranges(keys, n)
    rows = [(block, i, *(x[a:b].tobytes() for x in (keys, *more))) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
    return pd.DataFrame(rows, columns=["block", "range", "keys", *(f"x{i}" for i in range(len(more)))])


def _ids(column: pd.Series) -> np.ndarray:
    return column.to_numpy(np.int64)


def _join(column: pd.Series, kind) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *(np.frombuffer(x, kind) for x in column)])


def _spans(texts: pa.Array, ids: np.ndarray, shared: np.ndarray):
    """(first row, bytes, starts, ends, word offsets, starts of the windows that hold a shared anchor, their two hashes)."""
    for row, data, starts, ends, rows, hashes in _words(texts):
        at, found = _anchors(hashes, rows)
        place = np.searchsorted(shared, found)
        hit = at[shared[np.minimum(place, len(shared) - 1)] == found] if len(shared) else at[:0]
        windows = B.gram_starts(rows, SPAN)
        near = np.zeros(len(hashes) + PERIOD, bool)
        for back in range(PERIOD):
            near[np.maximum(hit - back, 0)] = True
        windows = windows[near[windows]]
        yield row, data, starts, ends, rows, windows, B.gram_hashes(hashes, windows, SPAN), B.gram_hashes(B.mix(hashes), windows, SPAN)


def _distinct_sorted(*arrays: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(arrays[::-1])
    return [x[order] for x in arrays]


def _arrow(column: pd.Series) -> pa.Array:
    return pa.array(column, pa.large_string())


def spans_removed(df: DataFrame, id: str, text: str, carry: tuple[str, ...], blocks: int) -> tuple[DataFrame, DataFrame]:
    """(the texts dealt into blocks, the shared anchors and the windows that start elsewhere too for each block)."""
    ranges = blocks
    key = F.coalesce(F.col(id).cast("long"), F.lit(LAST))
    # The text is hashed too: rows of one id, or without one, needn't be few.
    block = F.pmod(F.xxhash64(key, F.col(text), F.lit(7)), F.lit(blocks)).cast("int")
    dealt = df.select(block.alias("block"), key.alias("id"), F.col(text).cast("string").alias("text"), *carry)

    def send_anchors(block: pd.DataFrame) -> pd.DataFrame:
        ids, found, of = _ids(block["id"]), [], []
        for row, _, _, _, rows, hashes in _words(_arrow(block["text"])):
            at, h = _anchors(hashes, rows)
            found.append(h)
            of.append(ids[row + np.searchsorted(rows, at, "right") - 1])
        keys, docs = _distinct_sorted(np.concatenate(found), np.concatenate(of)) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        first = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
        many = np.zeros(len(keys), bool)
        many[:-1] = (keys[1:] == keys[:-1]) & (docs[1:] != docs[:-1])
        group = np.cumsum(first) - 1
        several = np.bincount(group, many, len(keys))[: int(first.sum())] > 0 if len(keys) else many
        return _cut(int(block["block"].iloc[0]), ranges, keys[first], several)

    def share_anchors(part: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(x, np.uint64) for x in part["keys"]]
        several = np.concatenate([np.frombuffer(x, bool) for x in part["x0"]])
        every = np.concatenate(keys)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        twin = np.zeros(len(every), bool)
        twin[1:] |= ordered[1:] == ordered[:-1]
        twin[:-1] |= ordered[1:] == ordered[:-1]
        shared = np.zeros(len(every), bool)
        shared[order] = twin
        shared |= several
        at = np.cumsum([0, *map(len, keys)])
        rows = [(b, k[s].tobytes()) for b, k, s in zip(part["block"], keys, (shared[i:j] for i, j in zip(at[:-1], at[1:], strict=True)), strict=True) if s.any()]
        return pd.DataFrame(rows, columns=["block", "keys"])

    def send_windows(block: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(back):
            return pd.DataFrame(columns=["block", "range", "keys", "x0", "x1"])
        ids, shared, parts = _ids(block["id"]), np.sort(_join(back["keys"], np.uint64)), []
        for row, _, _, _, rows, windows, one, two in _spans(_arrow(block["text"]), ids, shared):
            parts.append((one, two, ids[row + np.searchsorted(rows, windows, "right") - 1]))
        one, two, docs = _distinct_sorted(*(np.concatenate(x) for x in zip(*parts, strict=True)))
        first = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
        return _cut(int(block["block"].iloc[0]), ranges, one[first], two[first], docs[first])

    def least_windows(part: pd.DataFrame) -> pd.DataFrame:
        """For each block which of the windows that it sent start at a smaller id elsewhere, and at which."""
        one, two, docs = _join(part["keys"], np.uint64), _join(part["x0"], np.uint64), _join(part["x1"], np.int64)
        order = np.lexsort((docs, two, one))
        a, b, d = one[order], two[order], docs[order]
        first = np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
        least = np.empty(len(one), np.int64)
        least[order] = d[first][np.cumsum(first) - 1]
        rows, at = [], 0
        for block, keys in zip(part["block"], part["keys"], strict=True):
            n = len(keys) // 8
            elsewhere = np.flatnonzero(least[at : at + n] < docs[at : at + n])
            rows.append((block, elsewhere.astype(np.uint32).tobytes(), least[at : at + n][elsewhere].tobytes(), int(part["range"].iloc[0]) + 1))
            at += n
        return pd.DataFrame([r for r in rows if r[1]], columns=["block", "keys", "ids", "kind"])

    sent = dealt.groupBy("block").applyInPandas(send_anchors, "block int, range int, keys binary, x0 binary")
    shared = sent.groupBy("range").applyInPandas(share_anchors, "block int, keys binary")
    windows = dealt.groupBy("block").cogroup(shared.groupBy("block")).applyInPandas(send_windows, "block int, range int, keys binary, x0 binary, x1 binary")
    gone = windows.groupBy("range").applyInPandas(least_windows, "block int, keys binary, ids binary, kind int")
    anchors = shared.select("block", "keys", F.lit(None).cast("binary").alias("ids"), F.lit(0).alias("kind"))
    return dealt, gone.unionByName(anchors)


def _covered(block: pd.DataFrame, back: pd.DataFrame, ranges: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts, ends, word offsets, words to remove) of consecutive rows of a block.

    The block's texts are read twice, so that only the windows around shared anchors are held.
    """
    ids, texts = _ids(block["id"]), _arrow(block["text"])
    shared = _join(back.loc[back["kind"] == 0, "keys"], np.uint64) if len(back) else np.zeros(0, np.uint64)
    shared.sort()
    known: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]]
    for row, _, _, _, rows, windows, one, two in _spans(texts, ids, shared):
        for have, x in zip(known, (one, two, ids[row + np.searchsorted(rows, windows, "right") - 1]), strict=True):
            have.append(x)
    one, two, docs = _distinct_sorted(*map(np.concatenate, known))
    first = np.append(True, (one[1:] != one[:-1]) | (two[1:] != two[:-1]))[: len(one)]
    one, two, docs = one[first], two[first], docs[first]
    at = _ranges(one, ranges)  # the order in which the block sent them
    for kind, places, least in back.loc[back["kind"] > 0, ["kind", "keys", "ids"]].itertuples(index=False) if len(back) else ():
        docs[at[kind - 1] + np.frombuffer(places, np.uint32)] = np.frombuffer(least, np.int64)
    for row, data, starts, ends, rows, windows, a, b in _spans(texts, ids, shared):
        at = np.searchsorted(one, a)
        for i in np.flatnonzero(two[at] != b):  # windows of which one of the two hashes is equal: hardly ever any
            while two[at[i]] != b[i]:
                at[i] += 1
        gone = windows[docs[at] < ids[row + np.searchsorted(rows, windows, "right") - 1]]
        step = np.zeros(len(starts) + 1, np.int64)
        step[gone] += 1  # positions are distinct
        step[gone + SPAN] -= 1
        yield row, data, starts, ends, rows, np.cumsum(step[:-1]) > 0


def block_count(df: DataFrame, text: str) -> int:
    """Blocks of about BLOCK_BYTES of text; at least 12, so that a small input is spread too."""
    return max(12, math.ceil((df.agg(F.sum(F.octet_length(text))).first()[0] or 0) / BLOCK_BYTES))


def mark(df: DataFrame, finish, columns: str, id: str = "doc_id", text: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Applies ``finish(rows, bytes, starts, ends, word offsets, removed) -> DataFrame`` to stretches of each block.

    rows: the columns id and carry of the stretch. columns: the schema of what finish makes.
    """
    blocks = block_count(df, text)
    dealt, back = spans_removed(df, id, text, carry, blocks)

    def apply(block: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=[c.split()[0] for c in columns.split(", ")])
        found = [finish(block.iloc[row : row + len(rows) - 1], data, starts, ends, rows, gone) for row, data, starts, ends, rows, gone in _covered(block, back, blocks)]
        return pd.concat(found, ignore_index=True)

    return dealt.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(apply, columns)


def _named(id: str):
    return F.when(F.col("id") != LAST, F.col("id")).alias(id)


def digests(df: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) of each row."""

    def finish(part: pd.DataFrame, data, starts, ends, rows, gone) -> pd.DataFrame:
        out = []
        for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
            own = data[starts[a] : ends[b - 1]].tobytes().split() if b > a else []
            lost = int(gone[a:b].sum())
            if lost:
                own = itertools.compress(own, (~gone[a:b]).tolist())
            out.append((part["id"].iat[i], b - a, lost, hashlib.sha256(b" ".join(own)).hexdigest()))
        return pd.DataFrame(out, columns=["id", "n_words", "n_removed", "kept_sha256"])

    return mark(df, finish, "id bigint, n_words bigint, n_removed bigint, kept_sha256 string", id, text).select(_named(id), "n_words", "n_removed", "kept_sha256")


def remove(df: DataFrame, id: str = "doc_id", text: str = "text", removed: str = "n_removed") -> DataFrame:
    """The table with repeated passages cut out of its texts; a text that loses nothing stays as it is, white space too.

    The column ``removed`` says how many words went and replaces one of that name; where words stand between cuts, the white
    space before the first stays.
    """
    columns_in = [c for c in df.columns if c != removed or c in (id, text)]
    names = {c: f"_c{i}" for i, c in enumerate(columns_in) if c not in (id, text)}  # no name that the blocks use
    df = df.select(F.col(id).alias("_id"), F.col(text).alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    carry = tuple(names.values())

    def finish(part: pd.DataFrame, data, starts, ends, rows, gone) -> pd.DataFrame:
        texts, lost = [], []
        old = part["text"].to_numpy()
        for i, (a, b) in enumerate(zip(rows[:-1], rows[1:], strict=True)):
            lost.append(int(gone[a:b].sum()))
            if not lost[-1]:
                texts.append(old[i])
                continue
            kept = np.flatnonzero(np.diff(np.concatenate(([True], gone[a:b], [True])).astype(np.int8)))
            texts.append(b"".join(_piece(data, starts, ends, a, a + x, a + y) for x, y in kept.reshape(-1, 2)).decode())
        out = part.drop(columns=["block"]).assign(text=texts, n_removed=np.array(lost, np.int64))
        return out

    types = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    columns = "id bigint, text string" + (f", {types}" if types else "") + ", n_removed bigint"
    found = mark(df, finish, columns, "_id", "_text", carry)
    return found.select(*(_named(id) if c == id else F.col("text").alias(text) if c == text else F.col(names[c]).alias(c) for c in columns_in), F.col("n_removed").alias(removed))


def _piece(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: int, a: int, b: int) -> bytes:
    """The words a to b with the white space before them (none at the start of a text)."""
    return data[(starts[a] if a == first else ends[a - 1]) : ends[b - 1]].tobytes()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"))


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, doc_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
grams AS (SELECT r, doc_id, i, string_agg(word, ' ') OVER x AS g, count(*) OVER x AS n FROM words
          WINDOW x AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {SPAN - 1} FOLLOWING)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY g) AS least FROM grams WHERE n = {SPAN}) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, i + k AS i FROM late, range({SPAN}) AS x(k)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (r, i) GROUP BY r),
lost AS (SELECT r, count(*) AS n FROM gone GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN lost USING (r)
"""
