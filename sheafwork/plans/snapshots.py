"""Snapshots of a log, so that a fold does not read all of it.

A fold that takes the last row of a key needs no other row of that key. A snapshot at a number holds these
rows; the log since it is its rows and what came later. The next snapshot is made from that, not from the
whole log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ("case_id", "piece_id", "field")


def last_rows(log: DataFrame, keys: tuple[str, ...] = KEYS) -> DataFrame:
    """Of a log (seq, keys, and others) the last row of each key."""
    rest = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*rest), "seq").alias("_l")).select(*keys, "_l.*").select(*log.columns)


def stored(spark: SparkSession, path: str) -> list[int]:
    """The numbers at which there are snapshots, ascending."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not system.exists(where):
        return []
    names = [f.getPath() for f in system.listStatus(where)]
    whole = [f.getName() for f in names if system.exists(spark._jvm.org.apache.hadoop.fs.Path(f, "_SUCCESS"))]
    return sorted(int(n.partition("=")[2]) for n in whole if n.startswith("upto="))


def since(log: DataFrame, path: str, at: int | None = None) -> DataFrame:
    """A log that folds like `log` up to number `at`: the newest snapshot not beyond it, and the rows after that one. Without a snapshot it is the log itself.

    For folds that take the last row of the snapshots' keys, or of keys that these divide: states, final values,
    tags, links, settings, groups, switches. Histories and lists of changes need the whole log. The test on
    `seq` reaches the scan, so files of a log that is written in order are skipped.
    """
    spark = log.sparkSession
    usable = [n for n in stored(spark, path) if at is None or n <= at]
    later = log if at is None else log.where(F.col("seq") <= at)
    if not usable:
        return later
    return spark.read.parquet(f"{path}/upto={usable[-1]}").select(*log.columns).unionByName(later.where(F.col("seq") > usable[-1]))


def take(log: DataFrame, path: str, at: int, keys: tuple[str, ...] = KEYS) -> None:
    """Writes the snapshot at a number, from the one before it and what came since. One that is written again replaces itself."""
    spark = log.sparkSession
    before = [n for n in stored(spark, path) if n < at]
    fresh = log.where(F.col("seq") <= at)
    if before:
        fresh = spark.read.parquet(f"{path}/upto={before[-1]}").select(*log.columns).unionByName(fresh.where(F.col("seq") > before[-1]))
    last_rows(fresh, keys).write.mode("overwrite").parquet(f"{path}/upto={at}")
