"""A training-corpus pipeline over ``documents``: five stages, each one operator of factloom.llm.

Each stage takes (spark, docs, sf_dir) and returns all rows that it keeps; all but the last keep the columns of
documents. The caller writes each result and reads it again as the next stage's input; ``run`` does so in the shared
checkpoint folder.

1. quality_rules: documents that fail the base rule or break a threshold go.
2. language_id: documents without letters, in none of the languages or with a confidence under a half go.
3. near_dedup: of each class of near copies (similarity of 0.8 or more on five-word shingles) the smallest doc_id stays.
4. substring_dedup: 13-word passages that start in a document with a smaller doc_id too are cut out of the texts; a
   document that loses all its words goes. Other texts stay as they are.
5. packing: pieces of token ids in sequences of 4096.

Defined results: null and empty texts fail the base rule and go; of repeated rows, of rows with equal texts and of near
copies one stays, that of the smallest id, and a row without an id stays; rows of one id with other texts are documents of their own; documents without an id are cut after all others;
an empty table gives no rows; more columns, whatever their names, come along through all stages but the last.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import language_id, near_copies, packing, quality_rules, substring_dedup
from factloom.llm.tables import checkpoint_dir, table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    whole = docs.select(F.struct(*docs.columns).alias("document"), "text")
    return quality_rules.apply_rules(whole).where("kept").select("document.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    tag = "_" * (max(map(len, docs.columns)) + 1) + "row"  # a name that no column has
    # Rows that are equal in what the decision reads have one decision; the texts needn't travel with it.
    tagged = docs.withColumn(tag, F.xxhash64("doc_id", "text", "lang", "source"))
    found = language_id.identify(tagged.select(tag, "text", "lang", "source"), language_id.fit(docs), "text", F.col("lang"), F.lit(None).cast("string"), F.col("source"))
    rejected = found.where((F.col("lang_id") == language_id.UND) | (F.col("confidence") < 0.5))
    return without(tagged, rejected.select(tag), tag).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.deduplicate(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    lost = "_" * max(map(len, docs.columns)) + "lost"  # a name that no column has
    cut = substring_dedup.remove(docs, removed=lost)
    cut = cut.where((F.col(lost) == 0) | (F.col("text") != ""))
    n_chars = F.when(F.col(lost) > 0, F.length("text")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n_chars.cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality),
    ("language_id", language),
    ("near_dedup", near_dedup),
    ("substring_dedup", substrings),
    ("packing", pack),
]

#: SQL can express neither the trained language model nor the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
