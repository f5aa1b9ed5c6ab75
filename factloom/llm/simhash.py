"""SimHash near-duplicates by deletion-variant signatures.

1. ``fingerprints``: 64-bit SimHash of the word shingles of each whole text, next to the text's scan task.
2. ``links``: a fingerprint is cut into SEGMENTS = radius // 2 + 1 segments. Of two fingerprints within the
   radius one segment differs by at most one bit, so they share a variant of that segment in which one bit is
   deleted (position kept). Variants are the join key; pairs are verified by their bit distance.
   Only distinct fingerprints take part, so copies cost nothing.
3. A key that more than CROWD fingerprints share isn't expanded into pairs. Its members are linked through the
   points at distance radius / 2 of each of them instead: two fingerprints are within an even radius exactly if
   some point is that near to both. A point has 65 members at most, so this is linear, exact and even.
4. ``classes``: components of the links, then each document gets the smallest document id of its class.

Defined results: a null or empty text has fingerprint zero and is linked like any other; a text of fewer words
than a shingle is one shingle; repeated rows stay rows of one class; an empty table gives no rows. A null id
stays a row; it names a class only if no document of the class has an id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.components import components
from factloom.llm.tables import cut, table

BITS = 64
CROWD = 64


def simhash(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The fingerprint of one text in UTF-8: a bit is set if more than half of the shingle hashes set it."""
    words = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    if n < 2:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = (ends[:n] - np.diff(ends, prepend=0)[:n]).tolist()
        one = xxhash.xxh64_intdigest
        hashes = [one(joined[a : b - 1], seed) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]
    counts = np.zeros(BITS, np.int64)
    hashes = np.array(hashes, np.uint64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(df: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            texts = part.column(1).cast(pa.large_binary())
            out = np.fromiter((simhash(t.as_py() or b"", shingle, seed) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    kind = df.schema[id].dataType.simpleString()
    return df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text")).mapInArrow(batches, f"id {kind}, fp bigint")


def variants(radius: int) -> Column:
    """The one-deletion variants of each segment as (segment, deleted bit, what is left)."""
    segments = radius // 2 + 1
    keys = []
    for s in range(segments):
        low, high = BITS * s // segments, BITS * (s + 1) // segments
        for bit in range(low, high):
            mask = ((1 << high) - 1) & ~((1 << low) - 1) & ~(1 << bit)
            mask -= (mask >> 63) << 64  # as a signed number
            keys.append(F.struct(F.lit(bit).cast("byte").alias("bit"), F.col("fp").bitwiseAND(F.lit(mask)).alias("rest")))
    return F.explode(F.array(*keys))


def links(distinct: DataFrame, radius: int = 2, crowd: int = CROWD) -> DataFrame:
    """(a, b): pairs of different fingerprints whose links give the classes of all pairs within the radius.

    distinct: column fp without repeats. radius: 2, or another where no key is crowded; an error else.
    """
    keyed = distinct.select("fp", variants(radius).alias("k")).select("fp", "k.bit", "k.rest")
    shared = keyed.groupBy("bit", "rest").agg(F.count("*").alias("n")).where("n > 1")
    members = cut(keyed.join(shared, ["bit", "rest"]))
    few = members.where(F.col("n") <= crowd)
    left, right = few.select("bit", "rest", F.col("fp").alias("a")), few.select("bit", "rest", F.col("fp").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    pairs = left.join(right, ["bit", "rest"]).where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()
    if radius != 2:
        if not members.where(F.col("n") > crowd).isEmpty():
            raise ValueError(f"keys of more than {crowd} fingerprints are linked at radius 2 only, not at {radius}")
        return pairs
    many = members.where(F.col("n") > crowd).select("fp").distinct()
    points = [F.col("fp")] + [F.col("fp").bitwiseXOR(F.lit((1 << bit) - ((bit == 63) << 64))) for bit in range(BITS)]
    near = many.select("fp", F.explode(F.array(*points)).alias("point")).groupBy("point").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    hubs = near.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.unionByName(hubs).distinct()


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", radius: int = 2, shingle: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp, component): each row with the smallest id of the documents linked to it, directly or not."""
    prints = cut(fingerprints(df, id, text, shingle, seed))
    heads = cut(prints.groupBy("fp").agg(F.min("id").alias("head")))
    roots = components(links(heads.select("fp"), radius))
    named = heads.join(roots, heads.fp == roots.node, "left").select("fp", "head", F.coalesce("root", "fp").alias("root"))
    least = named.groupBy("root").agg(F.min("head").alias("component"))
    of = named.join(least, "root").select(F.col("fp").alias("_fp"), "component")
    return prints.join(of, prints.fp == of._fp).select("id", "fp", "component")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )
