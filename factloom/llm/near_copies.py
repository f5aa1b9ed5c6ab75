"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

1. Each text's set of 64-bit shingle hashes is named by a hash of the whole set. Texts with one set are one node.
2. SimHash comes first: nodes whose fingerprints ``simhash.links`` links (64 bits of three-word shingles, 2 of them differing)
   are compared, and the similar ones are in one class from then on. Most similar sets differ by more bits than that, so
   the other steps find what is still apart.
3. Two sets of 0.8 or more share one of the first (1 - 0.8) * size + 1 shingles of each, in any order of shingles that all
   sets keep. Frequent shingles come last, so these prefixes are rare shingles. They are the keys; a task packs its keys by
   hash range, and a range hands on those that two nodes have.
4. A key of FEW nodes at most is paired in full. The nodes of others are compared with one of them in each round, its head.
   Heads are chosen by one order of all nodes, so nodes that share many keys meet once; keys with the same nodes are one
   key. Components of the found pairs are classes; keys within one class are done.
5. Of a key that is apart after ROUNDS rounds, nodes outside its largest class, or those that another key of more nodes
   lacks, meet its nodes in tiles, where numpy bounds the pairs.

Candidates pass a bound from 64 small counters a set before the sets themselves decide, so no pair is missed or taken wrongly.

Defined results: null and empty texts have one set, the empty one, and are copies; a text of fewer words than a shingle is
one shingle; repeated rows are copies; rows without an id stay; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import blocks as B
from factloom.llm import simhash
from factloom.llm.components import components
from factloom.llm.tables import BROADCAST_IDS, cut, without

#: Similar texts: the least Jaccard similarity of their sets of shingles, and the words of a shingle.
ALIKE, SHINGLE = 0.8, 5
#: The nodes of a key with more than FEW are compared with one of them first, in so many rounds.
FEW, ROUNDS = 32, 3
#: Shingles found SEEN times or more in one of SHARE texts come last in the order of shingles; at most FREQUENT of them.
SHARE, SEEN, FREQUENT = 8, 3, 200_000
#: Packed keys of a hash range, of ENTRY bytes each.
RANGE_BYTES, ENTRY = 8 << 20, 24
#: Nodes of a key that meet as many in one task: their counters are some megabytes.
TILE = 2048
#: Bytes of text that a task hashes at a time; a byte takes some forty in its worker.
TEXT = 1 << 18
#: Counters of a set's sketch.
COUNTERS = 64


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> Iterator[np.ndarray]:
    """The sorted 64-bit hashes of the different shingles of each text; a text of fewer words than a shingle is one shingle."""
    for _, _, data, offsets in B.text_blocks(texts, TEXT):
        upper = (data >= 0x41) & (data <= 0x5A)
        low = np.where(upper, data + np.uint8(0x20), data).astype(np.uint8)
        starts, ends, rows = B.words(low, offsets)
        hashes = B.span_hashes(low, starts, ends)
        at = B.gram_starts(rows, shingle)
        grams, bounds = B.gram_hashes(hashes, at, shingle), np.searchsorted(at, rows)
        for a, b, i, j in zip(rows[:-1].tolist(), rows[1:].tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield np.unique(grams[i:j]) if b - a >= shingle or a == b else B.gram_hashes(hashes[a:b], np.zeros(1, np.int64), b - a)


class Order:
    """An order of shingles that all sets share: that of their hashes, and frequent ones last, the rarest of them first."""

    def __init__(self, frequent: np.ndarray):
        self.frequent, self.rank = frequent, np.argsort(frequent)
        self.sorted = frequent[self.rank]

    def places(self, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether each shingle is frequent, its place among the frequent ones)"""
        if not len(self.sorted):
            return np.zeros(len(found), bool), np.zeros(len(found), np.int64)
        at = np.minimum(np.searchsorted(self.sorted, found), len(self.sorted) - 1)
        return self.sorted[at] == found, self.rank[at]

    def prefix(self, found: np.ndarray, alike: float = ALIKE) -> np.ndarray:
        """The first shingles of a sorted set, so many that two sets of ``alike`` or more share one of them."""
        late, at = self.places(found)
        if late.any():
            found = np.concatenate([found[~late], self.frequent[np.sort(at[late])]])
        return found[: len(found) - math.ceil(alike * len(found) - 1e-9) + 1]


def _name(found: np.ndarray) -> int:
    """The node of a set: a signed 64-bit hash."""
    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes())).astype(np.int64))


def _sketch(found: np.ndarray) -> bytes:
    """How many shingles fall to each of COUNTERS counters. Two sets share the sum of the lesser counts at most."""
    return np.bincount((found >> np.uint64(7)).astype(np.int64) % COUNTERS, minlength=COUNTERS).astype(np.uint16 if len(found) < 65_536 else np.uint32).tobytes()


def _counts(sketch: bytes | pa.Buffer) -> np.ndarray:
    found = np.frombuffer(sketch, np.uint16)
    return (found if len(found) == COUNTERS else found.view(np.uint32)).astype(np.int64)


def _each(df: DataFrame, columns: list[str], make, schema: str) -> DataFrame:
    """make(set) gives the values of the row of one text, next to the given columns; the text is the column ``text``."""
    names = [f.split()[0] for f in schema.split(", ")]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = [make(s) for s in shingle_sets(part.column("text").cast(pa.large_binary()))]
            own = [pa.array(column) for column in zip(*rows, strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), *own], names=names)

    return df.select(*columns, "text").mapInArrow(batches, schema)


def _frequent(single: DataFrame) -> np.ndarray:
    """The shingles that are found most often in one of SHARE texts, the rarest first; FREQUENT at most.

    Whatever isn't among them is no hotter than FREQUENT others, so it is no large share of any range.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            held, size = [], 0
            for s in shingle_sets(part.column("text").cast(pa.large_binary())):
                held.append(s)
                size += len(s)
                if size > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["key"])
                    held, size = [], 0
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(held).view(np.int64))], names=["key"])

    each = single.where(F.pmod(F.xxhash64("row"), F.lit(SHARE)) == 0).select("text").mapInArrow(batches, "key bigint")
    often = each.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") >= SEEN).orderBy(F.desc("n"), "key").limit(FREQUENT)
    return np.array([r.key for r in often.collect()][::-1], np.int64).view(np.uint64)


def _keys(single: DataFrame, order: Order, alike: float, ranges: int) -> DataFrame:
    """(key, node, size, at) of the keys that two nodes or more have, and of all frequent ones."""
    bounds = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def pack(found: list[np.ndarray]) -> pa.RecordBatch:
        keys = np.concatenate(found)
        counts = np.array([len(f) for f in found])
        nodes = np.repeat(np.array(names, np.int64), counts)
        lengths, places = np.repeat(np.array(sizes, np.uint32), counts), np.concatenate([np.arange(n, dtype=np.uint32) for n in counts])
        # A frequent key goes to a range by its node too: it needn't meet its like there.
        deal = np.where(order.places(keys)[0], B.mix(keys ^ nodes.view(np.uint64)), keys)
        by = np.argsort(deal)
        ends = np.concatenate(([0], np.searchsorted(deal[by], bounds), [len(keys)]))
        rows = [(i, *(x[by[a:b]].tobytes() for x in (keys, nodes, lengths, places))) for i, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["range", "keys", "nodes", "sizes", "places"])

    names: list[int] = []
    sizes: list[int] = []

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        held = 0
        for part in parts:
            for s in shingle_sets(part.column("text").cast(pa.large_binary())):
                if len(s) < alike * (len(s) + 1):  # no other set is that similar
                    continue
                found.append(order.prefix(s, alike))
                names.append(_name(s))
                sizes.append(len(s))
                held += len(found[-1])
                if held > 200_000:
                    yield pack(found)
                    found, held = [], 0
                    names.clear()
                    sizes.clear()
        if found:
            yield pack(found)
            names.clear()
            sizes.clear()

    def shared(part: pa.Table) -> pa.Table:
        flat = lambda c, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in part[c]])
        keys = flat("keys", np.uint64)
        by = np.argsort(keys, kind="stable")
        ordered = keys[by]
        twin = np.zeros(len(keys) + 1, bool)
        twin[1:-1] = ordered[1:] == ordered[:-1]
        by = by[twin[1:] | twin[:-1] | order.places(ordered)[0]]
        return pa.table({"key": keys[by].view(np.int64), "node": flat("nodes", np.int64)[by], "size": flat("sizes", np.uint32)[by].astype(np.int32), "at": flat("places", np.uint32)[by].astype(np.int32)})

    packed = single.select("text").mapInArrow(batches, "range bigint, keys binary, nodes binary, sizes binary, places binary")
    return packed.groupBy("range").applyInArrow(shared, "key bigint, node bigint, size int, at int")


def _within(rest: DataFrame, nodes: DataFrame, alike: float) -> DataFrame:
    """(a, b) of each key whose sizes, places and sketches leave open that they are similar, and whose classes differ.

    Some nodes of a key ask, all of them answer. Two ways say who has to ask: those outside the key's largest class, or,
    where the key has an upper key of more nodes, those that aren't nodes of it: two nodes that share the upper key meet
    there. The way of fewer nodes is taken. Askers and answerers are dealt into parts of about TILE, and each two parts
    meet in a task of their own, so no task holds a whole key and no pair is a row before its bound is known.
    """
    classes = rest.groupBy("key", "root").agg(F.count("*").alias("c"), F.min("node").alias("node"))
    keys = cut(classes.groupBy("key").agg(F.sum("c").alias("n"), F.max(F.struct("c", "root"))["root"].alias("main"), F.min("node").alias("node")))
    # The upper key of a key is the largest one of its least node; the order of (n, key) has no cycles.
    top = rest.select("key", "node").join(keys.select("key", "n"), "key").groupBy("node").agg(F.max(F.struct("n", "key"))["key"].alias("upper"))
    keys = keys.join(top, "node").select("key", "n", "main", F.when(F.col("upper") != F.col("key"), F.col("upper")).alias("upper"))
    # In an upper key nodes meet that have an earlier shingle in common, so their places there bound nothing.
    uppers = keys.where("upper is not null").select(F.col("upper").alias("key"), F.lit(0).alias("first")).distinct()
    keys = keys.join(uppers, "key", "left")
    there = rest.select(F.col("key").alias("upper"), "node", F.lit(True).alias("there"))
    rows = rest.join(keys, "key").join(there, ["upper", "node"], "left")
    rows = cut(rows.select("key", "node", "size", F.coalesce("first", "at").alias("at"), "root", "n", F.col("there").isNull().alias("lone"), (F.col("root") != F.col("main")).alias("minor")))
    ways = rows.groupBy("key").agg(F.count_if("lone").alias("lones"), F.count_if("minor").alias("minors"))
    rows = rows.join(ways, "key").withColumn("asks", F.when(F.col("lones") <= F.col("minors"), F.col("lone")).otherwise(F.col("minor")))
    rows = rows.withColumns({"askers": F.ceil(F.least("lones", "minors") / TILE).cast("int"), "parts": F.ceil(F.col("n") / TILE).cast("int")}).where("askers > 0")
    rows = rows.join(nodes.select("node", "sketch"), "node")

    def dealt(part: DataFrame, asking: bool) -> DataFrame:
        own, other = ("asker", "part") if asking else ("part", "asker")
        of = {"part": F.col("parts"), "asker": F.col("askers")}
        each = F.explode(F.sequence(F.lit(0), of[other] - 1)).alias(other)
        part = part.withColumn(own, F.pmod(F.xxhash64("node"), of[own]).cast("int"))
        return part.select("key", "node", "size", "at", "root", "sketch", "lone", "asks", own, each).withColumn("asking", F.lit(asking)).select("key", "node", "size", "at", "root", "sketch", "lone", "asks", "asker", "part", "asking")

    def pairs(tile: pa.Table) -> pa.Table:
        x, y = tile.filter(tile["asking"]), tile.filter(pc.invert(tile["asking"]))
        counts = [np.array([_counts(c.as_buffer()) for c in side["sketch"]], np.int64).reshape(-1, COUNTERS) for side in (x, y)]
        of = lambda side, c: side[c].to_numpy().astype(np.int64)
        size, at, root, node, lone, asks = (of(y, c) for c in ("size", "at", "root", "node", "lone", "asks"))
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for i, (x_size, x_at, x_root, x_node, x_lone) in enumerate(zip(*(of(x, c).tolist() for c in ("size", "at", "root", "node", "lone")), strict=True)):
            need = _enough(alike, x_size, size)
            near = (np.minimum(x_size - x_at, size - at) >= need) & (root != x_root) & ((lone | x_lone) > 0)
            j = np.flatnonzero(near & ((asks == 0) | (node > x_node)))  # of two askers one asks
            j = j[np.minimum(counts[0][i], counts[1][j]).sum(axis=1) >= need[j]]
            found.append((np.full(len(j), x_node), node[j]))
        a, b = (np.concatenate([np.zeros(0, np.int64), *c]) for c in (zip(*found, strict=True) if found else ((), ())))
        return pa.table({"a": a, "b": b})

    met = dealt(rows.where("asks"), True).unionByName(dealt(rows, False))
    return met.groupBy("key", "asker", "part").applyInArrow(pairs, "a bigint, b bigint")


def _enough(alike: float, nx: np.ndarray, ny: np.ndarray) -> np.ndarray:
    """The least number of common shingles of similar sets of these sizes."""
    return alike / (1 + alike) * (nx + ny) - 1e-6


def _sketched(pairs: DataFrame, nodes: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) that may be similar by the sketches of their sets."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x, y = (np.array([_counts(s.as_buffer()) for s in part.column(c)]).reshape(-1, COUNTERS) for c in ("x", "y"))
            near = np.minimum(x, y).sum(axis=1) >= _enough(alike, x.sum(axis=1), y.sum(axis=1))
            yield pa.RecordBatch.from_arrays([part.column(c).filter(pa.array(near)) for c in ("a", "b")], names=["a", "b"])

    x, y = (nodes.select(F.col("node").alias(n), F.col("sketch").alias(s)) for n, s in ("ax", "by"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(batches, "a bigint, b bigint")


def _verified(pairs: DataFrame, sets: DataFrame, alike: float) -> DataFrame:
    """The pairs (a, b) whose sets have a Jaccard similarity of ``alike`` or more; sets: (node, shingles)."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            near = []
            for x, y in zip(part.column("x"), part.column("y"), strict=True):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                near.append(same >= alike * (len(x) + len(y) - same) - 1e-9)
            near = pa.array(near, pa.bool_())
            yield pa.RecordBatch.from_arrays([part.column(c).filter(near) for c in ("a", "b")], names=["a", "b"])

    x, y = (sets.select(F.col("node").alias(n), F.col("shingles").alias(s)) for n, s in ("ax", "by"))
    return pairs.join(y, "b").join(x, "a").select("a", "b", "x", "y").mapInArrow(batches, "a bigint, b bigint")


def _ends(pairs: DataFrame) -> DataFrame:
    """The nodes of pairs (a, b)."""
    return pairs.select(F.explode(F.array("a", "b")).alias("node"))


def _few(rows: DataFrame) -> DataFrame:
    """Rows of one or two 64-bit numbers, to be joined: few of them are sent to all tasks."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_IDS else rows


def _linked(single: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b): nodes that SimHash links. One node stands for all of a fingerprint."""
    prints = simhash.fingerprints(single, "row").withColumnRenamed("id", "row")
    prints = cut(prints.join(nodes.select("row", "node"), "row").select("node", "fp").distinct())
    heads = cut(prints.groupBy("fp").agg(F.min("node").alias("head")))
    same = prints.join(heads, "fp").where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    a, b = (heads.select(F.col("fp").alias(c), F.col("head").alias(f"{c}_node")) for c in "ab")
    return same.unionByName(simhash.links(heads.select("fp")).join(a, "a").join(b, "b").select(F.col("a_node").alias("a"), F.col("b_node").alias("b")))


def _sized(alike: float) -> Column:
    """Whether two sets can be similar whose first common shingle stands at these places: none before it is common."""
    most = F.least(F.col("a_size") - F.col("a_at"), F.col("b_size") - F.col("b_at"))
    return most * (1 + alike) >= (F.col("a_size") + F.col("b_size")) * F.lit(alike) - 1e-6


def _row_of(id: str, text: str) -> Column:
    """Names a row by its id and text."""
    return F.xxhash64(F.col(id), F.col(text).cast("string"))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", alike: float = ALIKE) -> DataFrame:
    """(id, component): classes of texts linked by a Jaccard similarity of ``alike`` or more; the smallest id names a class."""
    return _classes(df, id, text, alike).select("id", "component")


def _classes(df: DataFrame, id: str, text: str, alike: float) -> DataFrame:
    """(id, row, component, first) of each row: first is the row that stands for the class, of the smallest id, then row."""
    if not 0.5 < alike <= 1:
        raise ValueError("a similarity lies above 0.5, up to 1")
    docs = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"), _row_of(id, text).alias("row"))
    kind = df.schema[id].dataType.simpleString()
    found = cut(_each(docs, ["id", "row"], lambda s: (_name(s), len(s), _sketch(s)), f"id {kind}, row bigint, node bigint, size bigint, sketch binary"))
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")
    nodes = cut(found.groupBy("node").agg(least, F.first("sketch").alias("sketch")).select("node", F.col("m.id").alias("head"), F.col("m.row").alias("row"), "sketch"))
    copies = found.select("row").distinct().join(nodes.select("row"), "row", "left_anti")
    single = without(docs, copies, "row")
    shingles = found.agg(F.sum("size")).first()[0] or 0
    order = Order(_frequent(single))
    ranges = max(12, math.ceil(shingles * (1 - alike) * ENTRY / RANGE_BYTES))
    members = cut(_keys(single, order, alike, ranges))
    linked = cut(_linked(single, nodes))
    # The sets of all nodes that are ever compared are kept, so no round reads or shuffles the texts again.
    asked = members.select("node").unionByName(_ends(linked)).distinct()
    rows_of = _few(nodes.join(asked, "node").select(F.col("row").alias("_row"), "node"))
    sets = cut(_each(docs.join(rows_of, docs.row == rows_of._row).select("node", "text"), ["node"], lambda s: (s.tobytes(),), "node bigint, shingles binary"))

    def compare(pairs: DataFrame) -> DataFrame:
        pairs = cut(_sketched(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), nodes, alike))
        whole = sets.join(_few(_ends(pairs).distinct()), "node", "left_semi").dropDuplicates(["node"])
        return cut(_verified(pairs, whole, alike))

    def side(rows: DataFrame, x: str) -> DataFrame:
        return rows.select("key", *(F.col(c).alias(x if c == "node" else f"{x}_{c}") for c in ("node", "size", "at", "root")))

    def pairs_of(rows: DataFrame) -> DataFrame:
        pairs = side(rows, "a").join(side(rows, "b"), "key").where(F.col("a") < F.col("b"))
        return pairs.where((F.col("a_root") != F.col("b_root")) & _sized(alike))

    def rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
        roots = roots.select(F.col("node").alias("_node"), "root")
        return rows.drop("root").join(roots, F.col("node") == F.col("_node"), "left").drop("_node").withColumn("root", F.coalesce("root", "node"))

    def spread(rows: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Pairs keys of few nodes, and compares heads of others; (the rows of keys that hold several classes still, roots)."""
        counts = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("node")).alias("same"), F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
        # Of keys with the same nodes one stays, where each node has its first place: near copies share most of their keys.
        one = counts.groupBy("same", "n").agg(F.min("key").alias("one"))
        rows = rows.join(counts.join(one, ["same", "n"]).select("key", "one", "n"), "key").drop("key")
        rows = rows.groupBy(F.col("one").alias("key"), "node").agg(*(F.min(c).alias(c) for c in ("at", "size", "root", "n")))
        rows = cut(rows)
        roots = more(roots, pairs_of(rows.where(F.col("n") <= FEW)))
        rows = rows.where(F.col("n") > FEW).drop("n")
        for turn in range(ROUNDS + 1):
            rows = rooted(rows, roots)
            first = F.min(F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "at", "root")).alias("e")
            apart = cut(rows.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most"), first).where("least < most").select("key", "e"))
            rows = cut(rows.join(apart.select("key"), "key"))
            if turn == ROUNDS or rows.isEmpty():
                break
            pairs = side(rows, "b").join(apart.select("key", F.col("e.node").alias("a"), F.col("e.size").alias("a_size"), F.col("e.at").alias("a_at"), F.col("e.root").alias("a_root")), "key")
            roots = more(roots, pairs.where((F.col("a_root") != F.col("b_root")) & _sized(alike)))
        return rows, roots

    def more(roots: DataFrame, pairs: DataFrame) -> DataFrame:
        """(node, root) of the nodes that are similar to others, with these pairs as well: a class goes on as its star."""
        near = compare(pairs)
        return roots if near.isEmpty() else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(near))

    roots = components(compare(linked))
    rest, roots = spread(rooted(members, roots), roots)
    if not rest.isEmpty():
        roots = more(roots, _within(rest, nodes, alike))
    named = rooted(nodes.select("node", "head", "row"), roots)
    least = named.groupBy("root").agg(F.min(F.struct(F.col("head").isNull().alias("none"), "head", "row")).alias("m"))
    of = named.join(least, "root").select(F.col("node").alias("_node"), F.col("m.head").alias("component"), F.col("m.row").alias("first"))
    return found.join(of, found.node == of._node).select("id", "row", "component", "first")


def deduplicate(df: DataFrame, id: str = "doc_id", text: str = "text", alike: float = ALIKE) -> DataFrame:
    """The rows of df of which each class keeps one, that of the smallest id; rows without an id stay.

    Rows go, not ids: of several texts of one id only those that are copies go. Of rows of one id and text one stays,
    whatever their other columns hold.
    """
    classes = cut(_classes(df, id, text, alike).where("id is not null"))
    tag = "_" * (max(map(len, df.columns)) + 1) + "row"  # a name that no column has
    tagged = df.withColumn(tag, _row_of(id, text))
    kept = without(tagged, classes.where("row <> first").select("row"), tag)
    again = cut(classes.where("row = first").groupBy("row").count().where("count > 1").select("row"))
    if not again.isEmpty():
        same = tagged.join(again.withColumnRenamed("row", tag), tag, "left_semi")
        one = same.groupBy(tag).agg(F.first(F.struct(*df.columns)).alias("_one")).select("_one.*")
        return without(kept, again, tag).select(*df.columns).unionByName(one)
    return kept.select(*df.columns)
