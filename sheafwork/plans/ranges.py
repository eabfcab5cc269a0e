"""Range joins by interval bins.

A range of whole numbers is the union of a few aligned blocks, each of a power of two numbers: at most two
of each size, so a range of n numbers takes some 2 log n rows. A number lies in one block of each size, so
ranges and numbers meet by equality of size and block. Numbers take a row for each size that ranges use.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sizes up to 2**LEVELS numbers; longer ranges take more blocks of the largest size.
LEVELS = 40


def blocks(first: Column, last: Column) -> Column:
    """The blocks of a range as an array of structs (level, block); none where an end is null or the range is empty. Numbers are not below 0."""

    def at(k: Column) -> Column:
        low = F.ceil(first / F.pow(F.lit(2.0), k)).cast("long")
        high = F.floor((last + 1) / F.pow(F.lit(2.0), k)).cast("long")
        one = lambda b: F.struct(k.alias("level"), b.cast("long").alias("block"))
        left = F.when((low < high) & (low % 2 == 1), one(low))
        right = F.when((low < high) & (high % 2 == 1), one(high - 1))
        return F.array(left, right)

    top = F.least(F.lit(LEVELS), F.floor(F.log2((last - first + 1).cast("double"))) + 1).cast("int")
    found = F.flatten(F.transform(F.sequence(F.lit(0), top), at))
    return F.when(first.isNotNull() & (last >= first), F.array_distinct(F.filter(found, lambda x: x.isNotNull()))).otherwise(F.array().cast("array<struct<level:int,block:bigint>>"))


def spread(ranges: DataFrame, first: str, last: str) -> DataFrame:
    """`ranges` with a row for each of their blocks (`_level`, `_block`)."""
    return ranges.withColumn("_b", F.explode(blocks(F.col(first).cast("long"), F.col(last).cast("long")))).withColumns({"_level": F.col("_b.level"), "_block": F.col("_b.block")}).drop("_b")


def inside(ranges: DataFrame, points: DataFrame, keys: list[str], first: str, last: str, point: str, how: str = "inner") -> DataFrame:
    """Points joined with the ranges that hold them, on `keys` (an `inner` join), or the points in some range (`left_semi`) or in none (`left_anti`). Ends are included; ranges and points below 0 meet nothing."""
    dealt = spread(ranges, first, last)
    # at most LEVELS sizes, and few where ranges are short
    used = sorted(r[0] for r in dealt.select("_level").distinct().collect())
    if how == "left_anti":
        if not used:
            return points
        return points.join(inside(ranges, points.select(*keys, point).distinct(), keys, first, last, point, "left_semi"), [*keys, point], "left_anti")
    level = F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>"))
    many = points.withColumn("_level", level).withColumn("_block", F.floor(F.col(point) / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    if how == "left_semi":
        return many.join(dealt.select(*keys, "_level", "_block"), [*keys, "_level", "_block"], "left_semi").drop("_level", "_block").distinct()
    return many.join(dealt, [*keys, "_level", "_block"]).drop("_level", "_block")


def totals(ranges: DataFrame, points: DataFrame, keys: list[str], first: str, last: str, point: str) -> DataFrame:
    """Of the points in each range their number and sum: the ranges' columns, `n` and `total` (long). Ranges that hold no point have no row, and equal rows of ranges count as one.

    Points are summed by block first, and a range takes the sums of its blocks, so there are some 2 log n rows
    for a range of n numbers, however many points it holds.
    """
    dealt = spread(ranges, first, last)
    used = sorted(r[0] for r in dealt.select("_level").distinct().collect())
    level = F.explode(F.array(*[F.lit(k) for k in used]).cast("array<int>"))
    many = points.select(*keys, F.col(point).alias("_p"), level.alias("_level")).withColumn("_block", F.floor(F.col("_p") / F.pow(F.lit(2.0), F.col("_level"))).cast("long"))
    summed = many.groupBy(*keys, "_level", "_block").agg(F.count("*").alias("_n"), F.sum("_p").alias("_t"))
    return dealt.join(summed, [*keys, "_level", "_block"]).groupBy(*ranges.columns).agg(F.sum("_n").alias("n"), F.sum("_t").alias("total"))
