"""Printed page numbers: candidates at the margins, runs of numbers, labels of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_text, page_label
from ..plans.graph import cut
from ..plans.ranges import inside

LEAST_READINGS = 4
LARGEST_GAP = 12
#: Zones in the order in which ties are settled.
ZONES = ("sup_der", "sup_cen", "inf_der", "inf_cen")


def zone(x0: Column, y0: Column, y1: Column, width: Column, height: Column) -> Column:
    """The margin zone of a word, or null; the right one is tried before the centre."""
    top, bottom = y1 < height * 0.13, y0 > height * 0.87
    side = F.when(x0 > width * 0.62, "der").when((x0 > width * 0.28) & (x0 < width * 0.72), "cen")
    return F.when((width > 0) & (height > 0) & (top | bottom), F.concat(F.when(top, "sup_").otherwise("inf_"), side))


def candidates(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Words (case_id, page_id, ord, text, x0, y0, y1, conf) of the margins that can be page numbers: case_id, global_no, ord, zone, num, suffix, label, conf."""
    number, suffix = page_label(F.col("text"))
    sized = words.join(pages.select("case_id", "page_id", "global_no", "width_pt", "height_pt"), ["case_id", "page_id"])
    found = sized.select("case_id", "global_no", "ord", zone(F.col("x0"), F.col("y0"), F.col("y1"), F.col("width_pt"), F.col("height_pt")).alias("zone"), number.alias("num"), suffix.alias("suffix"), F.coalesce("conf", F.lit(0.0)).alias("conf"))
    return found.where("zone IS NOT NULL AND num IS NOT NULL").withColumn("label", label_text(F.col("num"), F.col("suffix")))


def first_readings(found: DataFrame) -> DataFrame:
    """The first plain number of each page and zone: case_id, zone, global_no, num, conf."""
    first = found.where("suffix = ''").groupBy("case_id", "zone", "global_no").agg(F.min_by(F.struct("num", "conf"), "ord").alias("_first"))
    return first.select("case_id", "zone", "global_no", "_first.*")


def runs(readings: DataFrame, least: int = LEAST_READINGS, gap: int = LARGEST_GAP) -> DataFrame:
    """Runs of readings (case_id, zone, global_no, num) with one offset: from_page, to_page, shift, readings, interpolated, confidence.

    A run breaks where number minus page changes, or pages without a reading in between exceed the gap.
    """
    order = Window.partitionBy("case_id", "zone").orderBy("global_no")
    shift = F.col("num") - F.col("global_no")
    marked = readings.withColumn("shift", shift).withColumn(
        "_break", F.coalesce((F.col("shift") != F.lag("shift").over(order)) | (F.col("global_no") - F.lag("global_no").over(order) > gap), F.lit(True)).cast("int")
    )
    grouped = marked.withColumn("_run", F.sum("_break").over(order)).groupBy("case_id", "zone", "_run").agg(
        F.min("global_no").alias("from_page"), F.max("global_no").alias("to_page"), F.first("shift").alias("shift"), F.count("*").alias("readings")
    )
    length = F.col("to_page") - F.col("from_page") + 1
    confidence = F.round(0.35 + 0.35 * F.col("readings") / length + 0.30 * F.least(F.lit(1.0), F.col("readings") / 12), 3)
    return grouped.where(F.col("readings") >= least).withColumns({"interpolated": length - F.col("readings"), "confidence": confidence}).drop("_run")


def settle(found: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """The runs that stay: by readings, then confidence, then zone and start; a run that overlaps a chosen one goes whole.

    Works on all cases at once: in each round every run that comes before all that it overlaps stays, and
    those that it overlaps go, until no two are left that overlap. Rounds look at such pairs only, so a run
    that overlaps none stays without one. Equal rows are one run. Columns and rows are those of `found`; no
    runs give none.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, zones)), F.col("zone")), F.lit(0))
    place = F.when(rank == 0, len(zones) + 1).otherwise(rank)
    rest = [c for c in found.columns if c not in ("case_id", "readings", "confidence", "zone", "from_page", "to_page")]
    runs_ = cut(found.distinct().withColumn("_p", F.struct((-F.col("readings")).alias("r"), (-F.col("confidence")).alias("c"), place.alias("z"), F.col("zone"), F.col("from_page"), F.col("to_page"), *rest)))
    # of two runs that overlap one holds the other's start
    a = runs_.select("case_id", F.col("_p").alias("_a"), F.col("from_page").alias("_from"), F.col("to_page").alias("_to"))
    b = runs_.select("case_id", F.col("_p").alias("_b"), F.col("from_page").alias("_at"))
    held = inside(a, b, ["case_id"], "_from", "_to", "_at").where("_a <> _b")
    pairs = cut(held.select("case_id", F.least("_a", "_b").alias("_first"), F.greatest("_a", "_b").alias("_later")).distinct())
    out = runs_
    while not pairs.isEmpty():
        later = pairs.select("case_id", F.col("_later").alias("_first")).distinct()
        best = pairs.join(later, ["case_id", "_first"], "left_anti")
        gone = cut(best.select("case_id", F.col("_later").alias("_p")).distinct())
        out = out.join(gone, ["case_id", "_p"], "left_anti")
        # a pair of a run that stays ends in one that goes, so what is left has neither
        pairs = cut(pairs.join(gone.withColumnRenamed("_p", "_first"), ["case_id", "_first"], "left_anti").join(gone.withColumnRenamed("_p", "_later"), ["case_id", "_later"], "left_anti"))
    return out.select(*found.columns)


def label_pages(chosen: DataFrame, readings: DataFrame, suffixed: DataFrame | None = None, fixed: DataFrame | None = None) -> DataFrame:
    """Labels from runs: case_id, global_no, num, suffix, reading (`leida` or `interpolada`), conf.

    A page read by its run has the run's confidence, another 0.7 of it. Suffixed readings (case_id,
    global_no, num, suffix, conf) win over runs. Pages in `fixed` (confirmed or typed) get no label.
    """
    spread = chosen.select("case_id", "zone", "shift", "confidence", F.explode(F.sequence("from_page", "to_page")).alias("global_no"))
    read = readings.select("case_id", "zone", "global_no", (F.col("num") - F.col("global_no")).alias("shift"), F.lit(True).alias("_read"))
    by_run = spread.join(read, ["case_id", "zone", "global_no", "shift"], "left").select(
        "case_id", "global_no", (F.col("global_no") + F.col("shift")).alias("num"), F.lit("").alias("suffix"),
        F.when(F.col("_read"), "leida").otherwise("interpolada").alias("reading"), F.when(F.col("_read"), F.col("confidence")).otherwise(F.round(F.col("confidence") * 0.7, 3)).alias("conf"), F.lit(0).alias("_rank"),
    )
    every = by_run
    if suffixed is not None:
        extra = suffixed.select("case_id", "global_no", "num", "suffix", F.lit("leida").alias("reading"), F.round(0.5 + 0.4 * F.col("conf"), 3).alias("conf"), F.lit(1).alias("_rank"))
        every = by_run.unionByName(extra)
    best = every.groupBy("case_id", "global_no").agg(F.max_by(F.struct("num", "suffix", "reading", "conf"), F.struct("_rank", -F.col("num"))).alias("_best"))
    out = best.select("case_id", "global_no", "_best.*")
    return out if fixed is None else out.join(fixed.select("case_id", "global_no"), ["case_id", "global_no"], "left_anti")


def summary(pages: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per case: pages, pages by the origin of their number, those whose number was not read but follows from a run, and runs."""
    of = lambda o: F.count_if(F.col("origin") == o)
    counts = pages.groupBy("case_id").agg(
        F.count("*").alias("pages"), of("desconocida").alias("unknown"), of("detectada").alias("detected"), of("confirmada").alias("confirmed"), of("manual").alias("typed"), F.count_if(F.col("reading") == "interpolada").alias("interpolated")
    )
    return counts.join(chosen.groupBy("case_id").agg(F.count("*").alias("runs")), "case_id", "left").fillna(0, ["runs"])


def bad_steps(pages: DataFrame) -> DataFrame:
    """Pages (case_id, global_no) whose number falls, or rises by more than the pages since the numbered page before them, `previous`.

    Pages are dealt over partitions by ranges, and each partition's first page meets the last one before it.
    """
    spark = pages.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    numbered = pages.where("num IS NOT NULL").select("case_id", "global_no", "num")
    dealt = cut(numbered.repartitionByRange(parts, "case_id", "global_no").withColumn("_part", F.spark_partition_id()))
    ends = dealt.groupBy("case_id", "_part").agg(F.max_by(F.struct("global_no", "num"), "global_no").alias("_end"))
    ends = ends.select("case_id", "_part", F.lag("_end").over(Window.partitionBy("case_id").orderBy("_part")).alias("_end"))
    order = Window.partitionBy("case_id", "_part").orderBy("global_no")
    before = dealt.withColumn("_own", F.lag(F.struct("global_no", "num")).over(order)).join(ends, ["case_id", "_part"]).withColumn("_b", F.coalesce("_own", "_end"))
    step = F.col("num") - F.col("_b.num")
    return before.where((step < 0) | (step > F.col("global_no") - F.col("_b.global_no"))).select("case_id", "global_no", F.col("_b.global_no").alias("previous"))


def discontinuous(pieces: DataFrame, pages: DataFrame) -> DataFrame:
    """Pieces (case_id, piece_id, page_start, page_end) with `discontinuous`: between two numbered pages a number falls, or rises by more than the pages between.

    A piece is not looked at where a person typed both ends (columns `origin_start`, `origin_end`, if there),
    nor where it has no end page. Only the pages where the series breaks meet pieces, by interval bins.
    """
    asked = pieces.where("page_end > page_start")
    if {"origin_start", "origin_end"} <= set(pieces.columns):
        asked = asked.where("NOT (origin_start <=> 'manual' AND origin_end <=> 'manual')")
    ranges = asked.select("case_id", "piece_id", F.col("page_start").alias("_first"), F.col("page_end").alias("_last"))
    hit = inside(ranges, bad_steps(pages), ["case_id"], "_first", "_last", "global_no").where("previous >= _first")
    found = hit.select("case_id", "piece_id", F.lit(True).alias("discontinuous")).distinct()
    return pieces.join(found, ["case_id", "piece_id"], "left").fillna(False, ["discontinuous"])


def refused_numbers(log: DataFrame) -> DataFrame:
    """Typed numbers that are refused: not blank, and no page number."""
    number, _ = page_label(F.col("label"))
    return log.where((F.col("kind") == "fijar") & (F.trim(F.coalesce("label", F.lit(""))) != "") & number.isNull())


def typed_numbers(pages: DataFrame, log: DataFrame) -> DataFrame:
    """Pages (case_id, global_no, num, suffix, origin, reading, conf) after what people typed and confirmed: log of seq, case_id, from_page, to_page, kind (`fijar` or `confirmar`), label.

    The last typed number of a page holds: it is `manual` with confidence 1, and a blank one makes the number
    unknown; one that is no number is refused (`refused_numbers`) and changes nothing. A confirmation makes
    a detected number `confirmada` with confidence 1 and touches no other. After a typed number nothing is
    detected, so a confirmation before or after it changes nothing. Ranges meet pages by interval bins.
    """
    number, suffix = page_label(F.col("label"))
    typed = log.where("kind = 'fijar'").join(refused_numbers(log).select("case_id", "seq"), ["case_id", "seq"], "left_anti").withColumns({"_num": number, "_suffix": F.coalesce(suffix, F.lit(""))})
    keys = pages.select("case_id", "global_no")
    last = inside(typed.select("case_id", "seq", "from_page", "to_page", "_num", "_suffix"), keys, ["case_id"], "from_page", "to_page", "global_no").groupBy("case_id", "global_no").agg(F.max_by(F.struct("_num", "_suffix"), "seq").alias("_typed"))
    confirmed = inside(log.where("kind = 'confirmar'").select("case_id", "from_page", "to_page"), keys, ["case_id"], "from_page", "to_page", "global_no", "left_semi").withColumn("_confirmed", F.lit(True))
    rows = pages.join(last, ["case_id", "global_no"], "left").join(confirmed, ["case_id", "global_no"], "left")
    there, known = F.col("_typed").isNotNull(), F.col("_typed._num").isNotNull()
    firm = F.coalesce(F.col("_confirmed") & (F.col("origin") == "detectada"), F.lit(False))
    return rows.select(
        "case_id", "global_no", F.when(there, F.col("_typed._num")).otherwise(F.col("num")).alias("num"), F.when(there, F.col("_typed._suffix")).otherwise(F.col("suffix")).alias("suffix"),
        F.when(there & known, "manual").when(there, "desconocida").when(firm, "confirmada").otherwise(F.col("origin")).alias("origin"),
        F.when(~there, F.col("reading")).alias("reading"), F.when(there & known, 1.0).when(there, None).when(firm, 1.0).otherwise(F.col("conf")).alias("conf"),
    )
