"""Inputs and session settings that the operators of this subpackage share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of an Arrow batch: a row is a whole text here, of some kilobytes, and a batch lies in memory twice.
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the corpus. A session that leaves the size of Arrow batches at its default gets smaller ones."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "1000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a local session that sets none gets its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if named is None and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="factloom-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Computes df once into the shared checkpoint folder: later readers and lost executors don't recompute it."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Ids that may be broadcast: 64-bit numbers, so some megabytes at most. Beyond that both sides are shuffled.
BROADCAST_IDS = 200_000


def without(df: DataFrame, gone: DataFrame, id: str) -> DataFrame:
    """The rows whose id isn't in the one column of ``gone``; a null id stays."""
    gone = cut(gone.toDF("_gone").distinct())
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    return df.join(gone, df[id] == gone._gone, "left_anti")
