"""Prefixes of an order under budgets of rows and bytes."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from factloom.operators.graphs import _cut


class OverBudget(ValueError):
    """A table has more rows or bytes than it may."""


class Prefix(NamedTuple):
    """rows: the prefix with place (from 1) and bytes (of all rows up to here); truncated: whether rows were left out."""

    rows: DataFrame
    truncated: bool


def json_size(columns: list[str]) -> Column:
    """Bytes of a row as JSON, nulls written out."""
    return F.octet_length(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})).cast("long")


def running(df: DataFrame, order: list[str], size: Column) -> DataFrame:
    """Adds place and bytes: how many rows, and how many bytes of them, stand up to a row in an order of the whole table.

    Rows are sorted by range; a partition's sums are added up over the partitions before it, so only sums of partitions are in one place
    (one row for each) and no task sees the table. Rows that are equal in the order stand in any order, kept once it is stored.
    """
    rows = df.withColumn("_size", size).withColumn("_row", F.monotonically_increasing_id())
    kept = _cut(rows.repartitionByRange(*order, "_row").sortWithinPartitions(*order, "_row").drop("_row").withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sums = kept.groupBy("_part").agg(F.count("*").alias("_n"), F.sum("_size").alias("_b"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    starts = sums.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"))
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = kept.withColumn("_k", F.row_number().over(within)).withColumn("_s", F.sum("_size").over(within)).join(F.broadcast(starts), "_part")
    return rows.withColumn("place", F.col("_n0") + F.col("_k")).withColumn("bytes", F.col("_b0") + F.col("_s")).drop("_part", "_at", "_k", "_s", "_n0", "_b0", "_size")


def prefix(df: DataFrame, order: list[str], max_rows: int | None = None, max_bytes: int | None = None, size: Column | None = None, strict: bool = False) -> Prefix:
    """The longest prefix within both budgets, in an order; ``strict`` raises OverBudget instead of leaving rows out.

    size: bytes of a row, its JSON if not given. The row budget alone needs no sums: it is a plain limit of the order.
    """
    if (max_rows is not None and max_rows < 0) or (max_bytes is not None and max_bytes < 0):
        raise ValueError("budgets are 0 or more")
    clash = {"place", "bytes"} & set(df.columns)
    if clash:
        raise ValueError(f"columns of the prefix are taken: {sorted(clash)}")
    size = json_size(df.columns) if size is None else size
    # One more row than may stay shows whether any is left out.
    few = df if max_rows is None else df.orderBy(*order).limit(max_rows + 1)
    summed = running(few, order, size)
    fits = F.lit(True)
    if max_rows is not None:
        fits &= F.col("place") <= max_rows
    if max_bytes is not None:
        fits &= F.col("bytes") <= max_bytes
    truncated = not summed.where(~fits).isEmpty()
    if truncated and strict:
        raise OverBudget(f"more than {max_rows} rows or {max_bytes} bytes")
    return Prefix(summed.where(fits), truncated)
