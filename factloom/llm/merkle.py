"""A Merkle manifest of a dataset: digests of rows, a tree of each group, a tree of the groups, and a proof for each row.

The tree isn't kept whole. ``build`` stores the digests of every LEVELS-th level only: the rows, the nodes above each aligned
subtree of FAN ** LEVELS rows, and so on up to the root. ``proofs`` goes from the root down: each stored node meets its stored
descendants again (one subtree is one row, of FAN ** LEVELS digests at most), makes the levels between them anew, gives each
descendant its siblings there and drops them.

* H is the lower-case hex sha256 of its inputs, one after another; digests enter as hex text.
* A leaf is H of its fields: ``-`` for a null, else the count of UTF-8 bytes, a colon and the value.
* In a group, leaves ascend by id. While several nodes remain, every FAN consecutive ones (the last run: fewer, even one) become
  their H. What remains is the group's root; the roots of all groups, a null group first, then by their bytes, likewise become
  the root of the dataset.
* A step of a proof is what stands left and right of a node in its run; an audit hashes from a leaf through the steps to a root.

Order: rows are sorted by range over the whole table and numbered from the first row of their group in each partition, so a group
of any size is spread over tasks. No group, level or proof goes through the driver; the root, one digest, does.

Defined results: a null group is a group of its own; null ids come first; rows of equal ids ascend by their leaf, and equal rows
are leaves next to each other; null and empty values differ; a text of any length is one value; an empty table gives no rows
and has no root; other columns, whatever their names, neither matter nor come along.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factloom.llm.tables import cut, table

FAN, LEVELS = 8, 3
WIDTH = FAN**LEVELS
"""Rows of an aligned subtree between two stored levels."""
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value as a leaf takes it."""
    value = value.cast("string")
    return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(values: list[Column]) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def _numbered(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos, from 0 in the group, and n, the rows of the group; stored, for a new run could draw other ranges.

    Only counts of (partition, group) are summed up, at most one for each partition and group.
    """
    spread = rows.withColumn("_row", F.monotonically_increasing_id())  # equal rows needn't share a task
    sorted_ = spread.repartitionByRange(group, *order, "_row").sortWithinPartitions(group, *order, "_row")
    kept = cut(sorted_.drop("_row").withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.spark_partition_id()))
    counts = kept.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    of = Window.partitionBy(group)
    earlier = F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_group"), F.col("_part").alias("_of"), (earlier - F.col("_first")).alias("_shift"), F.sum("_n").over(of).alias("n"))
    found = kept.join(counts, kept[group].eqNullSafe(counts._group) & (kept._part == counts._of))
    return found.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_group", "_of", "_shift")


def _runs(digests: Column) -> Column:
    """The level above an array of digests."""
    starts = F.sequence(F.lit(1), F.size(digests), F.lit(FAN))
    return F.transform(starts, lambda i: F.sha2(F.array_join(F.slice(digests, i, F.lit(FAN)), ""), 256))


def _levels(rows: DataFrame) -> DataFrame:
    """Subtrees with all their levels: l0 stored digests, l1.. made from them; a group of fewer rows has fewer levels."""
    for k in range(1, LEVELS + 1):
        under = F.col(f"l{k - 1}")
        rows = rows.withColumn(f"l{k}", F.when(F.col("n") > FAN ** (k - 1), _runs(under)).otherwise(under))
    return rows


def _subtrees(nodes: DataFrame) -> DataFrame:
    """(key, n, pos, items) of aligned subtrees: up to WIDTH nodes of a group each, in order."""
    item = F.struct("pos", *(c for c in nodes.columns if c not in ("key", "n", "pos")))
    trees = nodes.groupBy("key", "n", F.expr(f"pos div {WIDTH}").alias("up")).agg(F.sort_array(F.collect_list(item)).alias("items"))
    return trees.select("key", "n", F.col("up").alias("pos"), "items").withColumn("l0", F.col("items.digest"))


def _climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """(key, digest) of each group's root, and the stored levels from the lowest up; nodes: key, n, pos, digest."""
    stored = []
    while True:
        stored.append(nodes)
        trees = _levels(_subtrees(nodes.select("key", "n", "pos", "digest")))
        above = trees.select("key", F.ceil(F.col("n") / WIDTH).alias("n"), "pos", F.element_at(f"l{LEVELS}", 1).alias("digest"))
        nodes = cut(above)
        if nodes.where("n > 1").isEmpty():
            return nodes.select("key", "digest"), stored


def _descend(parents: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes with their steps to the root: those within their subtree, made anew, before those of its top node."""
    above = parents.select(F.col("key").alias("_key"), F.col("pos").alias("_pos"), F.col("steps").alias("_steps"), "subroot")
    trees = _subtrees(nodes)
    trees = _levels(trees.join(above, (trees.key == above._key) & (trees.pos == above._pos)).drop("_key", "_pos"))
    rows = trees.select("key", "pos", "n", "subroot", "_steps", *(f"l{k}" for k in range(LEVELS)), F.posexplode("items").alias("_i", "item"))
    steps = F.array()
    for k in range(LEVELS):
        at = F.expr(f"_i div {FAN**k}")
        first = at - at % FAN
        level = F.col(f"l{k}")
        left, right = F.slice(level, (first + 1).cast("int"), (at - first).cast("int")), F.slice(level, (at + 2).cast("int"), (first + FAN - 1 - at).cast("int"))
        step = F.array(F.struct(F.array_join(left, "").alias("left"), F.array_join(right, "").alias("right")))
        steps = F.concat(steps, F.when(F.col("n") > FAN**k, step).otherwise(F.array().cast("array<struct<left:string,right:string>>")))
    return rows.select("key", "subroot", F.concat(steps, F.col("_steps")).alias("steps"), "item.*")


@dataclass
class Manifest:
    """root: a digest or None. subroots: key, digest, pos and n of the groups' roots. levels: stored nodes of all groups, lowest first;
    upper: those of the tree of the groups."""

    root: str | None
    subroots: DataFrame
    levels: list[DataFrame]
    upper: list[DataFrame]


def build(leaves: DataFrame, group: str = "group", digest: str = "leaf", order: tuple[str, ...] = ("id",)) -> Manifest:
    """Stores every LEVELS-th level of the trees; leaves keep their columns at the lowest level."""
    rows = leaves.withColumn("key", field(F.col(group))).withColumnRenamed(digest, "digest")
    low = cut(_numbered(rows, group, [*order, "digest"]))
    tops, levels = _climb(low)
    names = low.select("key", F.col(group).alias("name")).distinct()
    tops = tops.join(names, "key")
    upper = _numbered(tops.withColumn("all", F.lit("all")), "all", ["name"]).withColumn("subroot_of", F.col("key")).drop("key").withColumnRenamed("all", "key")
    upper = cut(upper.drop("name"))
    root, above = _climb(upper)
    found = root.select("digest").first()
    return Manifest(found and found[0], upper, levels, above)


def proofs(manifest: Manifest) -> DataFrame:
    """Each leaf row with its subroot and its steps, array<struct<left, right>>, from the leaf to the root."""
    empty = F.array().cast("array<struct<left:string,right:string>>")
    upper = manifest.upper[-1].where("pos = 0").select("key", F.lit(0).cast("long").alias("pos"), empty.alias("steps"), F.lit(None).cast("string").alias("subroot"))
    for nodes in reversed(manifest.upper):
        upper = _descend(upper, nodes)
    found = upper.select(F.col("subroot_of").alias("key"), F.lit(0).cast("long").alias("pos"), "steps", F.col("digest").alias("subroot"))
    for nodes in reversed(manifest.levels):
        found = _descend(found, nodes)
    return found


def fold(digest: Column, steps: Column) -> Column:
    """The root that a digest and its steps give."""
    return F.aggregate(steps, digest, lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    others = [F.col(c) for c in FIELDS[:-1]]
    leaves = docs.select("doc_id", "lang", leaf([*others, F.col("text")]).alias("leaf"), leaf([*others, tampered]).alias("tampered"))
    manifest = build(leaves, "lang", "leaf", ("doc_id",))
    siblings = F.array_join(F.transform("steps", lambda s: F.concat(s["left"], s["right"])), "")
    rows = proofs(manifest).select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(manifest.root).alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), fold(F.col("tampered"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


#: Levels of the tree as rounds of a recursion; crc32 bit by bit, for DuckDB has none.
SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, lang, text, CASE WHEN doc_id IS NULL THEN '-' ELSE length(CAST(doc_id AS VARCHAR)) || ':' || doc_id END
      || CASE WHEN source IS NULL THEN '-' ELSE strlen(source) || ':' || source END || CASE WHEN lang IS NULL THEN '-' ELSE strlen(lang) || ':' || lang END
      || CASE WHEN n_chars IS NULL THEN '-' ELSE length(CAST(n_chars AS VARCHAR)) || ':' || n_chars END AS head,
    list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
      lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)), CAST(4294967295 AS BIGINT)) AS crc
  FROM documents),
low AS (
  SELECT doc_id, lang, sha256(head || CASE WHEN text IS NULL THEN '-' ELSE strlen(text) || ':' || text END) AS leaf,
    sha256(head || CASE WHEN text IS NULL THEN '-' WHEN xor(crc, 4294967295) % 3 = 0 THEN strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE strlen(text) || ':' || text END) AS tampered
  FROM docs),
leaves AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM low),
tree AS (
  SELECT lang, 0 AS level, pos, leaf AS digest, count(*) OVER (PARTITION BY lang) AS n FROM leaves
  UNION ALL
  SELECT lang, max(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 7) // 8) FROM tree WHERE n > 1 GROUP BY lang, pos // 8),
tops AS (SELECT lang, digest AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos FROM tree WHERE n = 1),
upper_tree AS (
  SELECT 0 AS level, pos, subroot AS digest, count(*) OVER () AS n FROM tops
  UNION ALL SELECT max(level) + 1, pos // 8, sha256(string_agg(digest, '' ORDER BY pos)), max((n + 7) // 8) FROM upper_tree WHERE n > 1 GROUP BY pos // 8),
walk AS (
  SELECT doc_id, leaf, lang, 0 AS level, pos, tampered AS folded, '' AS siblings FROM leaves
  UNION ALL
  SELECT w.doc_id, w.leaf, w.lang, w.level + 1, w.pos // 8,
    sha256(coalesce((SELECT string_agg(digest, '' ORDER BY t.pos) FROM tree AS t WHERE t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos // 8 = w.pos // 8 AND t.pos < w.pos), '') || folded
      || coalesce((SELECT string_agg(digest, '' ORDER BY t.pos) FROM tree AS t WHERE t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos // 8 = w.pos // 8 AND t.pos > w.pos), '')),
    siblings || coalesce((SELECT string_agg(digest, '' ORDER BY t.pos) FROM tree AS t WHERE t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.pos // 8 = w.pos // 8 AND t.pos <> w.pos), '')
  FROM walk AS w WHERE EXISTS (SELECT 1 FROM tree AS t WHERE t.lang IS NOT DISTINCT FROM w.lang AND t.level = w.level AND t.n > 1)),
grown AS (SELECT w.*, t.subroot, t.pos AS up FROM walk AS w JOIN tree AS h ON h.n = 1 AND h.lang IS NOT DISTINCT FROM w.lang AND h.level = w.level JOIN tops AS t ON t.lang IS NOT DISTINCT FROM w.lang),
rise AS (
  SELECT doc_id, leaf, subroot, 0 AS level, up AS pos, folded, siblings FROM grown
  UNION ALL
  SELECT w.doc_id, w.leaf, w.subroot, w.level + 1, w.pos // 8,
    sha256(coalesce((SELECT string_agg(digest, '' ORDER BY t.pos) FROM upper_tree AS t WHERE t.level = w.level AND t.pos // 8 = w.pos // 8 AND t.pos < w.pos), '') || folded
      || coalesce((SELECT string_agg(digest, '' ORDER BY t.pos) FROM upper_tree AS t WHERE t.level = w.level AND t.pos // 8 = w.pos // 8 AND t.pos > w.pos), '')),
    siblings || coalesce((SELECT string_agg(digest, '' ORDER BY t.pos) FROM upper_tree AS t WHERE t.level = w.level AND t.pos // 8 = w.pos // 8 AND t.pos <> w.pos), '')
  FROM rise AS w WHERE EXISTS (SELECT 1 FROM upper_tree AS t WHERE t.level = w.level AND t.n > 1)),
peak AS (SELECT level, digest FROM upper_tree WHERE n = 1)
SELECT doc_id, leaf, subroot, digest AS root, sha256(siblings) AS proof_sha256, folded AS folded_root, folded = digest AS verified FROM rise JOIN peak USING (level)"""
