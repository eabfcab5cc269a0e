"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


#: A table of fewer bytes than this for each core is dealt out over all cores before Python works on it.
SMALL_SPLIT = 16 << 20


def partitions(spark: SparkSession) -> int:
    """How many partitions a shuffle gets whose rows grow afterwards: those of other shuffles, and one for each core at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data directory. A small one (`SMALL_SPLIT` bytes a core, by the plan's own estimate) may have few splits and is dealt out over all cores; others are read as they are."""
    df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
    return df.repartition(cores) if plan_bytes(df) < cores * SMALL_SPLIT else df


def plan_bytes(df: DataFrame) -> int:
    """The size of a table as the optimiser estimates it, without running anything."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Where nothing is set a temporary folder becomes the checkpoint folder, with a local master only:
    executors elsewhere could not see it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not sc.getCheckpointDir():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sheafwork-"))
    return named or sc.getCheckpointDir()


_scratch: list[str] = []


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate table, in the shared folder; `sweep` takes it away."""
    _scratch.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _scratch[-1]


def sweep(spark: SparkSession) -> None:
    """Takes away the intermediate tables made so far. For callers that have written down all that reads them."""
    while _scratch:
        remove(spark, _scratch.pop())


def remove(spark: SparkSession, path: str) -> None:
    """A folder of intermediate results taken away, wherever it is."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder, so that later steps neither recompute it nor depend on executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def remainder(id_column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`; null for a null id."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % F.lit(parts)


def held_out(id_column: str, parts: int, which: int) -> Column:
    """Whether a row is kept from training. A null id counts as held out, as no label can name it."""
    return F.coalesce(remainder(id_column, parts) == which, F.lit(True))
