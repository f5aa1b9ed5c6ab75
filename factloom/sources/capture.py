"""Source folders as tables: a listing under limits, then the texts, then a listing again that must be the same."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.operators.graphs import _cut

#: Files that are manifests, folders that are left out, and the greatest depth of folders.
MANIFESTS = ("Cargo.toml", "Cargo.lock", "rust-toolchain.toml", "rust-toolchain")
SKIPPED = (".git", "target", "node_modules")
MAX_DEPTH = 128


class LimitExceeded(ValueError):
    """A folder has more, larger or deeper files than it may."""


class SourceChanged(RuntimeError):
    """Files changed while they were read."""


class Captured(NamedTuple):
    """files: path, content_hash, text, bytes of Rust sources. manifests: the same of manifests. rejected: path, reason."""

    files: DataFrame
    manifests: DataFrame
    rejected: DataFrame


def _listed(spark: SparkSession, root: str, content: bool) -> DataFrame:
    """path (relative), bytes, modified and perhaps content of the files that a capture takes; without content only names are listed."""
    every = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{*.rs," + ",".join(MANIFESTS) + "}").load(root)
    base = re.sub("^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).rstrip("/") + "/"
    plain = F.regexp_replace("path", "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    decoded = F.url_decode(F.replace(plain, F.lit("+"), F.lit("%2B")))
    path = F.expr(f"substring(p, {len(base) + 1})")
    rows = every.withColumn("p", decoded).withColumn("path", path)
    folders = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    rows = rows.where(~F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED)))).withColumn("depth", F.size(folders))
    return rows.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "depth", *(["content"] if content else []))


def is_manifest(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1).isin(*MANIFESTS)


def capture(spark: SparkSession, root: str, max_files: int = 20_000, max_file_bytes: int = 4 << 20, max_total_bytes: int = 256 << 20) -> Captured:
    """The Rust sources and manifests below a folder of any file system that Spark reads.

    Limits hold for the listing, so nothing is read of a folder beyond them (LimitExceeded). The texts are stored once; if the files
    listed afterwards differ in path, size or time, SourceChanged is raised: two equal listings aren't a transaction. Files that
    aren't UTF-8 are rejected rows. Spark's listing leaves out empty files and names that begin with
    a dot or an underscore, and follows links.
    """
    before = _cut(_listed(spark, root, False))
    seen = before.agg(F.count("*").alias("n"), F.max("bytes").alias("most"), F.sum("bytes").alias("total"), F.max("depth").alias("depth"), F.max_by("path", "bytes").alias("largest")).first()
    if seen.n > max_files:
        raise LimitExceeded(f"{seen.n} files, {max_files} at most")
    if (seen.most or 0) > max_file_bytes:
        raise LimitExceeded(f"{seen.largest} has {seen.most} bytes, {max_file_bytes} at most")
    if (seen.total or 0) > max_total_bytes:
        raise LimitExceeded(f"{seen.total} bytes, {max_total_bytes} at most")
    if (seen.depth or 0) > MAX_DEPTH:
        raise LimitExceeded(f"folders {seen.depth} deep, {MAX_DEPTH} at most")
    rows = _listed(spark, root, True).withColumn("valid", F.expr("is_valid_utf8(cast(content AS string))"))
    kept = _cut(rows.select("path", "bytes", "modified", "valid", F.sha2("content", 256).alias("content_hash"), F.when(F.col("valid"), F.col("content").cast("string")).alias("text")))
    names = ["path", "bytes", "modified"]
    after = _listed(spark, root, False).select(*names)
    for other in (after, kept.select(*names)):
        if not before.select(*names).exceptAll(other).isEmpty() or not other.exceptAll(before.select(*names)).isEmpty():
            raise SourceChanged("files changed while they were read")
    texts = kept.where("valid").select("path", "content_hash", "text", "bytes")
    manifest = is_manifest(F.col("path"))
    return Captured(texts.where(~manifest), texts.where(manifest), kept.where("not valid").select("path", F.lit("not_utf8").alias("reason")))
