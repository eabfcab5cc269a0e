"""Numbering of rows in an order, without one task for a key.

Rows are dealt over partitions by ranges of key and order, counted by key and partition, and numbered
within each partition after what lies in the partitions before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut


def placed(rows: DataFrame, keys: list[str], order: list[Column], name: str = "position") -> DataFrame:
    """`rows` with the place of each within its keys, from 1. The order has to be total within a key; a key may hold all rows."""
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # which rows a partition holds comes from a sample, so it is written down
    dealt = cut(rows.repartitionByRange(parts, *keys, *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(*[F.col(k).alias(f"_key_{k}") for k in keys], F.col("_part").alias("_of"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*keys, "_part").orderBy(*order)
    # a key may be null
    met = [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in keys] + [F.col("_part") == F.col("_of")]
    rows = dealt.withColumn("_at", F.row_number().over(within)).join(before, met)
    return rows.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_at", "_before", "_of", *[f"_key_{k}" for k in keys])


def top(rows: DataFrame, keys: list[str], order: list[Column], limit: int, start: int = 0, name: str = "place") -> DataFrame:
    """The first `limit` rows of each key after `start`, with their places from 1. Spark cuts each task's rows to that many of a key before it shuffles them."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(name, at).where(F.col(name) <= start + limit).where(F.col(name) > start)
