"""SimHash near-duplicates.

A fingerprint has a bit set where over half of the hashes of the text's word shingles have it. The 64
bits are cut into segments of two and each fingerprint becomes the vector of its segments' bit counts.
The Manhattan distance of two such vectors never exceeds the Hamming distance of the fingerprints, so
fingerprints at most 2 bits apart lie at most 2 apart on the grid of count vectors and share a grid
point within 1 of both. The range join puts each fingerprint on its own grid point and the points next
to it, joins those that share a point, and verifies every such pair by the number of bits that differ.

A point that many distinct fingerprints share (`DENSE`) is not expanded into pairs. There verification
goes by words: two fingerprints differ in at most 2 bits if and only if some 64-bit word is within one
bit of both. The words with the point's counts are written out, and fingerprints that share one are
linked to the smallest, so the links of a dense point grow with its size and none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, partitions, read_table
from .components import components

SHINGLE = 3
SEED = 42
#: The radius of a link: the grid covers exactly this many bits.
RADIUS = 2
#: Segments have two bits: with so many counts hardly any two random fingerprints of billions lie within 2 on the grid.
SEGMENTS = 32
LOW_BITS = 0x5555555555555555
#: Distinct fingerprints on a grid point up to which all of its pairs are compared.
DENSE = 64
BLOCK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The unsigned fingerprint of one text; 0 if it has no word.

    A-Z are lower-cased; words are split at ASCII white space, as bytes.split() does. A text with fewer
    words than a shingle is one shingle. Long texts are counted in blocks of shingles.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    counts = np.zeros(64, dtype=np.int64)
    for start in range(0, n, BLOCK):
        hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + shingle]), SEED) for i in range(start, min(n, start + BLOCK))]
        bits = np.unpackbits(np.array(hashes, dtype="<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


@F.pandas_udf(LongType())
def fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Signed 64-bit fingerprints of a column of texts."""
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def segment_counts(word: Column) -> Column:
    """The bit counts of a word's two-bit segments, packed into two bits each."""
    half = F.shiftrightunsigned(word, 1)
    one = word.bitwiseXOR(half).bitwiseAND(F.lit(LOW_BITS))
    two = word.bitwiseAND(half).bitwiseAND(F.lit(LOW_BITS))
    return one.bitwiseOR(F.shiftleft(two, 1))


def grid_points(prints: DataFrame) -> DataFrame:
    """print, step, point: every fingerprint (column `print`) on its own grid point (step 0) and on those one count away.

    Step 1 + 2j raises the count of segment j, step 2 + 2j lowers it.
    """
    placed = prints.select("print", segment_counts(F.col("print")).alias("_own"), F.explode(F.sequence(F.lit(0), F.lit(2 * SEGMENTS))).alias("step"))
    at = "shiftright(step - 1, 1) * 2"
    count = F.expr(f"shiftrightunsigned(_own, {at}) & 3")
    # counts 0 and 1 differ in the low bit of the segment, counts 1 and 2 in both
    below, above = F.expr(f"_own ^ shiftleft(1L, {at})"), F.expr(f"_own ^ shiftleft(3L, {at})")
    raised, lowered = F.when(count == 0, below).when(count == 1, above), F.when(count == 1, below).when(count == 2, above)
    point = F.when(F.col("step") == 0, F.col("_own")).when(F.col("step") % 2 == 1, raised).otherwise(lowered)
    return placed.select("print", "step", point.alias("point")).where("point IS NOT NULL")


def _word_links(dense: DataFrame) -> DataFrame:
    """Links (a, b) of fingerprints on crowded points (print, step): each to the smallest one that shares a word within one bit of both."""
    bit = F.expr("transform(sequence(0, 1), i -> shiftleft(1L, shiftright(step - 1, 1) * 2 + i))")
    p, raises = F.col("print"), (F.col("step") % 2) == 1
    flips = F.filter(bit, lambda m: F.when(raises, p.bitwiseAND(m) == 0).otherwise(p.bitwiseAND(m) != 0))
    words = F.when(F.col("step") == 0, F.array(p)).otherwise(F.transform(flips, lambda m: p.bitwiseXOR(m)))
    written = dense.select("print", F.explode(words).alias("word"))
    roots = written.groupBy("word").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi").select("word", "lo")
    return written.join(roots, "word").where("print <> lo").select(F.col("print").alias("a"), F.col("lo").alias("b"))


def grid_links(prints: DataFrame, dense: int = DENSE) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column `print`) at most 2 bits apart.

    All such pairs that meet on a grid point of at most `dense` fingerprints, and on the others enough
    that two fingerprints are joined by links exactly if they are by pairs.
    """
    points = grid_points(prints)
    shared = points.groupBy("point").agg(F.count("*").alias("_n")).where("_n > 1")
    near = cut(points.join(shared, "point"))
    few = near.where(F.col("_n") <= dense)
    one, two = few.select("point", F.col("print").alias("a")), few.select("point", F.col("print").alias("b"))
    pairs = one.join(two, "point").where((F.col("a") > F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS)).select("a", "b")
    return pairs.union(_word_links(near.where(F.col("_n") > dense))).distinct()


def _rooted(marked: DataFrame) -> DataFrame:
    """print, _root, _first for each distinct fingerprint of `marked`: its component's smallest fingerprint, and its own smallest doc_id."""
    # a stated number of partitions, which adaptive execution keeps: each row becomes some fifty grid points
    firsts = cut(marked.groupBy("print").agg(F.min("doc_id").alias("_first")).repartition(partitions(marked.sparkSession), "print"))
    joined = components(grid_links(firsts.select("print")))
    return firsts.join(joined.withColumnRenamed("node", "print"), "print", "left").withColumn("_root", F.coalesce("component", "print"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document.

    Fingerprints at most 2 bits apart are linked; the component is the smallest doc_id that links reach.
    Null and wordless texts have fingerprint zero, which links like any other. A null doc_id takes part
    and is never a component's id unless all of its ids are null. Repeated rows are kept. Long texts are read
    whole. Columns other than doc_id and text, whatever their names, are not looked at. No rows give none.
    """
    marked = cut(docs.select("doc_id", fingerprints("text").alias("print")))
    rooted = _rooted(marked)
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = rooted.select("print", "_root").join(least, "_root").select("print", "component_id")
    return marked.join(named, "print").select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows that stand for their group of near-duplicates, one for each group whatever ids it has.

    The row with the smallest doc_id stays, one without an id only where no row of the group has any; of
    rows that share that id the one with the smallest digest of the text. Rows equal in both differ in
    other columns at most and become one before they are shuffled; others are only looked up by id and digest,
    so that no text is held by a group.

    Null and wordless texts are one group. Long texts are read whole. Columns may have any names; of rows that
    are equal in id and text the one whose other columns come first as JSON stays. No rows give none.
    """
    keys = {"_id": F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), "_digest": F.coalesce(F.md5(F.encode("text", "UTF-8")), F.lit("none"))}
    marked = cut(docs.select("doc_id", fingerprints("text").alias("print"), *[c.alias(k) for k, c in keys.items()]))
    order = F.struct(F.col("doc_id").isNull().alias("_last"), "doc_id", "_digest")
    firsts = marked.groupBy("print").agg(F.min(order).alias("_keep"))
    groups = firsts.join(_rooted(marked).select("print", "_root"), "print").groupBy("_root").agg(F.min("_keep").alias("_keep"))
    kept = cut(groups.select(F.coalesce(F.col("_keep.doc_id").cast("string"), F.lit("none")).alias("_id"), F.col("_keep._digest").alias("_digest")))
    repeated = cut(marked.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").join(kept, [*keys], "left_semi").select(*keys))
    rows = docs.select(*[c.alias(k) for k, c in keys.items()], F.struct(*docs.columns).alias("_row"))
    once = rows.join(kept.join(repeated, [*keys], "left_anti"), [*keys], "left_semi")
    if repeated.isEmpty():
        return once.select("_row.*")
    rest = F.to_json(F.struct(*[F.col(f"_row.`{c}`") for c in docs.columns if c != "text"]))
    many = rows.join(repeated, [*keys], "left_semi").withColumn("_rest", rest).groupBy(*keys).agg(F.min_by("_row", "_rest").alias("_row"))
    return once.select("_row.*").unionByName(many.select("_row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
