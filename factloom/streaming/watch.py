"""Incremental capture of files as a stream: only what changed since the last batch is written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

FILES = "path string, text string, version long"


def changes(batch: DataFrame, store: DataFrame) -> DataFrame:
    """The newest version of each path of a batch, with its content hash, unless the store's newest is the same."""
    newest = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version")))
    rows = batch.withColumn("rank", newest).where("rank = 1").drop("rank").withColumn("hash", F.sha2(F.coalesce("text", F.lit("")), 256))
    held = store.groupBy("path").agg(F.max_by("hash", "version").alias("held"))
    return rows.join(held, "path", "left").where(~F.col("hash").eqNullSafe(F.col("held"))).select("path", "text", "version", "hash")


def watch(spark: SparkSession, source: str, store: str, checkpoint: str, available_now: bool = True, interval: str = "1 second") -> StreamingQuery:
    """Reads JSON lines of files that appear in ``source`` and appends changed ones to the Parquet folder ``store``.

    A batch that is run again after a failure finds its rows in the store and writes nothing.
    """
    schema = f"{FILES}, hash string"
    spark.createDataFrame([], schema).write.mode("append").parquet(store)

    def apply(batch: DataFrame, number: int) -> None:
        changes(batch, spark.read.schema(schema).parquet(store)).write.mode("append").parquet(store)

    writer = spark.readStream.schema(FILES).json(source).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
