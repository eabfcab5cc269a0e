"""Mixing sources to target weights.

Every document gets a hash-random key of its id and text. Within its source, documents are ordered by that
key, the running sum of their sizes is taken in two levels (sums of key ranges first, then within a range),
and the source is cut at its budget. Ranges before the cut are taken whole and those behind it not at all,
so only the range that holds the cut is sorted. A budget above the size of a source repeats it in whole
epochs and cuts the last one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, read_table

#: Key ranges of a source: as many at least, and more where they would hold more rows than this. The key is uniform, so rows fall evenly into ranges.
RANGES, RANGE_ROWS = 1024, 20_000
#: Hex digits of the key that ranges are told by.
DIGITS = 8
WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
#: The plan of sources and ranges is broadcast up to so many rows, and else joined by a shuffle.
PLAN_ROWS = 100_000
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """Per source: its size and its share of the total (`_src`, `_source_size`, `_target`).

    Sources weigh `weights` in turn, by code point, null last. No share exceeds `max_epochs` times the
    source; what is over goes to the others by weight until none is above, so shares are
    min(cap, weight * level) with the one level at which they add up to the total. In order of
    cap/weight the capped sources come first, so the level is found from running sums. Works on one row
    for each source.
    """
    everything = Window.partitionBy()
    per_source = sized.groupBy("_src").agg(F.sum("_size").alias("_source_size"))
    ranked = per_source.withColumn("_rank", F.row_number().over(Window.orderBy("_src"))).withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_rank") - 1) % len(weights) + 1).cast("int")).cast("long")
    )
    capped = ranked.withColumn("_cap", F.col("_source_size") * max_epochs)
    order = Window.orderBy(F.col("_cap") / F.col("_weight"), "_rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    level = capped.withColumn(
        "_level",
        (F.sum("_source_size").over(everything) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        / (F.sum("_weight").over(everything) - F.coalesce(F.sum("_weight").over(before), F.lit(0))),
    ).withColumn("_at", F.row_number().over(order))
    found = F.min(F.when(F.col("_cap") >= F.col("_level") * F.col("_weight"), F.struct("_at", "_level"))).over(everything)
    return level.withColumn("_found", found).select(
        "_src", "_source_size",
        F.least(F.col("_cap").cast("double"), F.coalesce(F.col("_found._level"), F.lit(float("inf"))) * F.col("_weight")).alias("_target"),
    )


def mix(docs: DataFrame, *, carry: tuple[str, ...] = (), ranges: int | None = None, seed: str = SEED) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, and the columns in `carry`.

    `taken` is the number of words the mix takes: whole epochs of the document's size, and in the last
    epoch what lies before the cut, so that a source yields exactly floor(target) words and at most one
    of its documents is taken in part.

    Null text has size 0; a null source is a source of its own. Documents without words take 0. Long
    texts are counted whole. Rows without an id, or with one id, are spread by their texts; those with equal
    texts too are interchangeable and share a range. Other columns, whatever their names, are not looked at.
    No rows give no rows.

    Sizes are summed by ranges of the key, and the ranges in order; only in the range that holds a source's
    cut are rows sorted.
    """
    key = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    base = docs.select(
        "doc_id", *[F.col(c).alias(f"_carry_{c}") for c in carry], F.col("source").alias("_source"), word_count(F.col("text")).alias("_size"),
        F.struct(F.col("source").isNull().alias("none"), F.coalesce("source", F.lit("")).alias("name")).alias("_src"), key.alias("_key"),
    )
    slim = cut(base.drop(*[f"_carry_{c}" for c in carry]))
    ranges = ranges or max(RANGES, -(-slim.count() // RANGE_ROWS))
    ranged = lambda rows: rows.withColumn("_range", F.floor(F.conv(F.substring("_key", 1, DIGITS), 16, 10).cast("long") * ranges / F.lit(16**DIGITS)))
    base, slim = ranged(base), ranged(slim)
    sums = slim.groupBy("_src", "_range").agg(F.sum("_size").alias("_range_size"))
    earlier = Window.partitionBy("_src").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    plan = (
        sums.withColumn("_before", F.coalesce(F.sum("_range_size").over(earlier), F.lit(0)))
        .join(source_targets(sums.withColumnRenamed("_range_size", "_size")), "_src")
        .withColumn("_budget", F.floor("_target"))
        .withColumn("_epochs", F.when(F.col("_source_size") > 0, F.floor(F.col("_budget") / F.col("_source_size"))).otherwise(F.lit(0)))
        .withColumn("_cut", F.col("_budget") - F.col("_epochs") * F.col("_source_size") - F.col("_before"))
        .drop("_before", "_budget")
    )
    plan = cut(plan)
    within = Window.partitionBy("_src", "_range").orderBy("_key", "doc_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = (base if carry else slim).join(F.broadcast(plan) if plan.count() <= PLAN_ROWS else plan, ["_src", "_range"])
    holds_cut = (F.col("_cut") > 0) & (F.col("_cut") < F.col("_range_size"))
    start = F.coalesce(F.sum("_size").over(within), F.lit(0))
    cut_up = rows.where(holds_cut).withColumn("_part", F.least(F.col("_size"), F.greatest(F.lit(0), F.col("_cut") - start)))
    whole = rows.where(~holds_cut).withColumn("_part", F.when(F.col("_cut") > 0, F.col("_size")).otherwise(0))
    return whole.unionByName(cut_up).select(
        "doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        (F.col("_epochs") * F.col("_size") + F.col("_part")).cast("long").alias("taken"), F.col("_source").alias("source"),
        F.col("_epochs").cast("int").alias("epochs"), F.col("_part").cast("long").alias("part"), *[F.col(f"_carry_{c}") for c in carry],
    )


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each epoch that a document is in, its text cut in the epoch that ends inside it.

    Returns the columns of `docs`, whatever their names. Documents without words, or beyond the cut, are not
    in the mix. Nulls, long texts, ties and repeated rows are as in `mix`.
    """
    columns = docs.columns
    mixed = mix(docs, carry=tuple(columns))
    copies = mixed.withColumn("_copies", F.col("epochs") + (F.col("part") > 0).cast("int")).where("_copies > 0 AND size > 0")
    rows = copies.withColumn("_copy", F.explode(F.sequence(F.lit(1), "_copies")))
    ends_inside = (F.col("_copy") > F.col("epochs")) & (F.col("part") < F.col("size"))
    words = F.regexp_extract_all(F.col("_carry_text"), F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    text = F.when(ends_inside, F.array_join(F.slice(words, 1, F.greatest(F.col("part").cast("int"), F.lit(1))), "")).otherwise(F.col("_carry_text"))
    made = {"text": text}
    if "n_chars" in columns:
        made["n_chars"] = F.when(ends_inside, F.length(text)).otherwise(F.col("_carry_n_chars"))
    return rows.select(*[made.get(c, F.col(f"_carry_{c}")).alias(c) for c in columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents")).drop("epochs", "part", "source")


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, (source IS NULL)::INT AS s0, coalesce(source, '') AS s1, md5(concat('mix', coalesce(cast(doc_id AS VARCHAR), ''), ':', coalesce(text, ''))) AS k,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size
  FROM documents),
src AS (SELECT s0, s1, sum(size) AS source_size FROM sized GROUP BY s0, s1),
ranked AS (SELECT *, row_number() OVER (ORDER BY s0, s1) AS rnk FROM src),
capped AS (SELECT *, (rnk - 1) % 3 + 1 AS w, source_size * 3 AS cap FROM ranked),
lev AS (
  SELECT *, row_number() OVER (ORDER BY cap::DOUBLE / w, rnk) AS pos,
         (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap::DOUBLE / w, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS lvl
  FROM capped),
opening AS (SELECT min(pos) AS pos FROM lev WHERE cap >= lvl * w),
tgt AS (SELECT c.s0, c.s1, c.source_size, least(c.cap::DOUBLE, l.lvl * c.w) AS target
        FROM capped c CROSS JOIN (SELECT lvl FROM lev JOIN opening USING (pos)) l),
run AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         coalesce(sum(s.size) OVER (PARTITION BY s.s0, s.s1 ORDER BY s.k, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN tgt t ON s.s0 = t.s0 AND s.s1 = t.s1),
cutat AS (SELECT *, CASE WHEN source_size > 0 THEN floor(floor(target) / source_size) ELSE 0 END AS epochs FROM run)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(epochs * size + least(size, greatest(0, floor(target) - epochs * source_size - start)) AS BIGINT) AS taken
FROM cutat
"""
