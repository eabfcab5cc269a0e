"""Words and boxes: lines rebuilt from words, images that need reading, and the choice and merging of readings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType, StructField, StructType

LINE = StructType([
    StructField("case_id", StringType()), StructField("page_id", LongType()), StructField("line_no", IntegerType()), StructField("text", StringType()),
    StructField("x0", DoubleType()), StructField("y0", DoubleType()), StructField("x1", DoubleType()), StructField("y1", DoubleType()),
])


def page_lines(words: list, limit: int | None) -> list[tuple]:
    """The lines of one page. Words are taken by (y0 to a tenth, x0), equal ones by `ord` and text; one joins the open line if its y0 is within 0.7 of the height of the line's last word (4 at least) of the line's first."""
    rows = sorted(words, key=lambda w: (round(w.y0, 1), w.x0, w.ord, w.text))
    out: list[tuple] = []
    held: list = []

    def close() -> None:
        line = sorted(held, key=lambda w: w.x0)
        out.append((len(out), " ".join(w.text for w in line), min(w.x0 for w in line), min(w.y0 for w in line), max(w.x1 for w in line), max(w.y1 for w in line)))

    for word in rows:
        if held and abs(word.y0 - held[0].y0) > 0.7 * max(4.0, held[-1].y1 - held[-1].y0):
            close()
            held = []
            if limit and len(out) >= limit:
                return out
        held.append(word)
    if held:
        close()
    return out


def rebuild(words: DataFrame, limit: int | None = None) -> DataFrame:
    """Lines of each page from words (case_id, page_id, ord, text, x0, y0, x1, y1): all of them, or the first `limit` (a heading takes few).

    Pages are dealt over partitions and read in one pass that holds the words of one page.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []
        for rows in batches:
            out: list[tuple] = []
            for word in rows.itertuples(index=False):
                if (word.case_id, word.page_id) != key:
                    out += [(*key, *line) for line in page_lines(held, limit)] if held else []
                    key, held = (word.case_id, word.page_id), []
                held.append(word)
            yield pd.DataFrame(out, columns=LINE.names)
        if held:
            yield pd.DataFrame([(*key, *line) for line in page_lines(held, limit)], columns=LINE.names)

    columns = ["case_id", "page_id", "ord", "text", "x0", "y0", "x1", "y1"]
    return words.select(*columns).repartition("case_id", "page_id").sortWithinPartitions("case_id", "page_id").mapInPandas(run, LINE)


def inside(x: Column, y: Column, box: Column, margin: float = 0.0) -> Column:
    """Whether a point lies in a box (x0, y0, x1, y1)."""
    return x.between(box["x0"] - margin, box["x1"] + margin) & y.between(box["y0"] - margin, box["y1"] + margin)


def images_to_read(images: DataFrame, words: DataFrame, pages: DataFrame, coverage: float = 0.5, least: float = 0.15, few: int = 5) -> DataFrame:
    """Per page: the share of the sheet under images (1 at most), and whether they need reading.

    They do at a share of `coverage`, or if an image of at least `least` of the sheet holds the centres of fewer than `few` words.
    """
    clip = lambda c, top: F.least(F.greatest(F.col(c), F.lit(0.0)), top)
    sized = images.join(pages.select("case_id", "page_id", "width_pt", "height_pt"), ["case_id", "page_id"])
    boxes = sized.select("case_id", "page_id", "image_no", F.struct(clip("x0", F.col("width_pt")).alias("x0"), clip("y0", F.col("height_pt")).alias("y0"), clip("x1", F.col("width_pt")).alias("x1"), clip("y1", F.col("height_pt")).alias("y1")).alias("box"), (F.col("width_pt") * F.col("height_pt")).alias("sheet"))
    area = F.greatest(F.lit(0.0), F.col("box.x1") - F.col("box.x0")) * F.greatest(F.lit(0.0), F.col("box.y1") - F.col("box.y0")) / F.col("sheet")
    centres = words.select("case_id", "page_id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    held = boxes.join(centres, ["case_id", "page_id"], "left").groupBy("case_id", "page_id", "image_no", "sheet", "box").agg(F.count_if(inside(F.col("cx"), F.col("cy"), F.col("box"))).alias("n"))
    marked = held.withColumn("share", area)
    per_page = marked.groupBy("case_id", "page_id").agg(F.least(F.lit(1.0), F.sum("share")).alias("share"), F.bool_or((F.col("share") >= least) & (F.col("n") < few)).alias("_bare"))
    return pages.select("case_id", "page_id").join(per_page, ["case_id", "page_id"], "left").select("case_id", "page_id", F.coalesce("share", F.lit(0.0)).alias("share"), F.coalesce(F.col("_bare") | (F.col("share") >= coverage), F.lit(False)).alias("needs_reading"))


def merge_readings(native: DataFrame, read: DataFrame, ink: DataFrame, margin: float = 2.0, unread: float = 0.02) -> tuple[DataFrame, DataFrame]:
    """Native words (with `ord`, their place) kept, with read words whose centre lies in no native box; and the confidence of each page's mixture.

    Where words were added a page's words are placed anew by height, to a tenth, and then from the left (equal ones by
    origin, `ord` and text, so that reruns agree), else the native ones keep their places. Confidence is null where nothing was added, 0 where reading found
    nothing or left more than `unread` of the ink (column `unread_ink`), else the mean of the words added.
    """
    keys = ["case_id", "page_id"]
    boxes = native.select(*keys, F.struct("x0", "y0", "x1", "y1").alias("_box"))
    points = read.withColumn("_cx", (F.col("x0") + F.col("x1")) / 2).withColumn("_cy", (F.col("y0") + F.col("y1")) / 2)
    there = [points[k] == boxes[k] for k in keys]
    extra = points.join(boxes, [*there, inside(F.col("_cx"), F.col("_cy"), F.col("_box"), margin)], "left_anti").drop("_cx", "_cy")
    columns = [*keys, "text", "x0", "y0", "x1", "y1", "conf"]
    both = native.select(*columns, "ord", F.lit("nativa").alias("origin")).unionByName(extra.select(*columns, "ord", F.lit("leida").alias("origin")))
    added = F.max(F.col("origin") == "leida").over(Window.partitionBy(*keys))
    order = Window.partitionBy(*keys).orderBy(F.round("y0", 1), "x0", F.desc("origin"), "ord", "text")
    words = both.withColumn("_added", added).withColumn("ord", F.when(F.col("_added"), F.row_number().over(order) - 1).otherwise(F.col("ord"))).drop("_added")
    found = read.groupBy(*keys).agg(F.count("*").alias("_read")).join(extra.groupBy(*keys).agg(F.avg("conf").alias("_mean")), keys, "left")
    pages = ink.join(found, keys, "left")
    conf = F.when(F.col("_read").isNull() | (F.col("unread_ink") > unread), F.lit(0.0)).otherwise(F.col("_mean"))
    return words, pages.select(*keys, conf.alias("conf"))


def choose_reading(readings: DataFrame, gain: float = 0.12) -> DataFrame:
    """Of each page's readings (case_id, page_id, pref, rotation, conf; pref 0 is the base) the first whose confidence exceeds the base's by more than `gain`, else the base."""
    base = readings.where("pref = 0").select("case_id", "page_id", F.struct("pref", "rotation", "conf").alias("_base"))
    better = readings.where("pref > 0").join(base, ["case_id", "page_id"]).where(F.col("conf") > F.col("_base.conf") + gain)
    first = better.groupBy("case_id", "page_id").agg(F.min_by(F.struct("pref", "rotation", "conf"), "pref").alias("_first"))
    return base.join(first, ["case_id", "page_id"], "left").select("case_id", "page_id", F.coalesce("_first", "_base").alias("_r")).select("case_id", "page_id", "_r.*")


def route(native_words: Column, needs_reading: Column, rotated: Column) -> Column:
    """How a page is read: `nativo`, `mixta` or `ocr`."""
    return F.when((native_words > 0) & ~needs_reading, "nativo").when((native_words > 0) & ~rotated, "mixta").otherwise("ocr")


def may_turn(conf: Column, has_ink: Column, suspicion: float = 0.75) -> Column:
    """Whether other rotations of a page are tried."""
    return (conf < suspicion) & has_ink
