"""Pieces from page sequences: the cutting fold, closing, coverage, and proposals for new pages only."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

from ..functions.text import find_date
from ..plans.graph import cut
from ..plans.order import placed
from ..plans.ranges import inside
from .decisions import labelled
from .headings import Rule, continuation, heading, recognise, title_line

CUT, LONG, TEXT = 0.45, 40, 1200
POOR = 0.55
# Fixed value: why a detection made nothing.
COVERED = "todas las páginas leídas ya tienen una pieza que las cubre"
CUTS = StructType([StructField("case_id", StringType()), StructField("doc_id", LongType()), StructField("global_no", LongType()), StructField("piece_no", IntegerType())])


def follows(n: int | None, m: int | None, last: tuple[int, int] | None) -> bool:
    """Whether a sheet counter goes on from the last one; without one of them nothing speaks against it."""
    return n is None or last is None or (m == last[1] and n == last[0] + 1)


class Cutter:
    """Cuts the pages of a document, given one by one in page order.

    A page opens a piece if none is open, pages are missing before it, its counter starts anew or does
    not go on, or its heading is strong enough and it does not continue a piece of its own type.
    """

    def __init__(self):
        self.piece, self.previous, self.kind, self.last = -1, None, None, None

    def step(self, global_no: int, kind: str, score: float, continues: bool, n: float, m: float) -> int:
        """The number of the page's piece."""
        counter = None if n is None or n != n else (int(n), int(m))
        open_ = self.previous is not None
        gap = open_ and global_no != self.previous + 1
        goes_on = follows(*(counter or (None, None)), self.last)
        same = continues and open_ and not gap and kind == self.kind and goes_on
        restart = open_ and counter is not None and (counter[0] == 1 or not goes_on)
        if not open_ or gap or restart or (score >= CUT and not same):
            self.piece += 1
            self.kind, self.last = kind, counter
        else:
            self.last = counter or self.last
        self.previous = global_no
        return self.piece


def cuts(marked: DataFrame) -> DataFrame:
    """The piece of each page (case_id, doc_id, global_no, type, score, continues, n, m).

    Pieces never cross documents: documents are dealt over partitions, sorted by page, and read in one
    pass that holds no more than the open piece.
    """
    columns = ["case_id", "doc_id", "global_no", "type", "score", "continues", "n", "m"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, cutter = None, Cutter()
        for rows in batches:
            pieces = []
            for case, doc, *page in zip(*[rows[c] for c in columns], strict=True):
                if (case, doc) != key:
                    key, cutter = (case, doc), Cutter()
                pieces.append(cutter.step(*page))
            yield rows[["case_id", "doc_id", "global_no"]].assign(piece_no=pieces)

    dealt = marked.select(*columns).repartition("case_id", "doc_id").sortWithinPartitions("case_id", "doc_id", "global_no")
    return dealt.mapInPandas(run, CUTS)


def mark_pages(pages: DataFrame, rules: list[Rule], *more: str) -> DataFrame:
    """Pages (case_id, doc_id, global_no, text, conf, and `more` columns) with what their headings say."""
    headed = pages.withColumn("_head", heading(F.col("text")))
    marked = headed.withColumn("_found", recognise(F.col("_head"), rules)).withColumn("_goes", continuation(F.col("_head")))
    return marked.select("case_id", "doc_id", *more, "global_no", "text", F.coalesce("conf", F.lit(0.0)).alias("conf"), "_found.type", "_found.score", "_goes.continues", "_goes.n", "_goes.m")


def confidence(score: Column, read: Column, pages: Column) -> Column:
    """How far a proposal is to be believed: its title's strength and its worst page's reading, less for long pieces. In thousandths."""
    exact = F.least(F.lit(1.0), (0.55 * score + 0.45 * F.least(F.lit(1.0), read)) * F.when(pages > LONG, 0.75).otherwise(1.0))
    # to three places Spark rounds the shortest decimal of a number, which may lie above the number itself
    return F.round(exact * 1000) / 1000


def first_text(rows: DataFrame, keys: list[str], limit: int = TEXT) -> DataFrame:
    """`keys` and source_text: the texts of rows (keys, global_no, text) in page order with spaces between, cut to `limit` characters.

    Pages are cut before they meet, and those that begin beyond the limit are left out, so that no group
    holds more than some `limit` pages or characters. One that begins just at the limit still gives the space
    before it. A page without text gives neither text nor space; source_text is null where no page has any.
    """
    order = Window.partitionBy(*keys).orderBy("global_no")
    short = rows.select(*keys, "global_no", F.left("text", F.lit(limit)).alias("_text"))
    before = F.coalesce(F.sum(F.length("_text") + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    kept = short.withColumn("_before", before).where(F.col("_before") <= limit)
    texts = F.collect_list(F.when(F.col("_text").isNotNull(), F.struct("global_no", "_text")))
    joined = F.array_join(F.transform(F.array_sort(texts), lambda x: x["_text"]), " ")
    return kept.groupBy(*keys).agg(F.when(F.count("_text") > 0, F.left(joined, F.lit(limit))).alias("source_text"))


def range_texts(ranges: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """`keys` (case_id among them) and source_text of page ranges (keys, page_start, page_end), from pages (case_id, global_no, text)."""
    slim = ranges.select(*keys, F.col("page_start").alias("_first"), F.col("page_end").alias("_last"))
    return first_text(inside(slim, pages.select("case_id", "global_no", "text"), ["case_id"], "_first", "_last", "global_no"), keys)


def titled(text: Column, kind: Column, rules: list[Rule]) -> Column:
    """The title line that a page gives to a piece that begins on it, null where nothing is legible."""
    return title_line(text, kind, rules)


def finished(grouped: DataFrame) -> DataFrame:
    """Proposals from pieces (case_id, doc_id, page_start, page_end, type, score, title, read_conf, source_text) with description, confidence, date and warnings."""
    n = F.col("page_end") - F.col("page_start") + 1
    named = F.coalesce("title", F.concat(F.lit("Pieza sin título legible (pág. "), F.col("page_start").cast("string"), F.lit(")")))
    warn = lambda test, name: F.when(test, F.lit(name))
    warnings = F.filter(F.array(warn(F.col("score") == 0, "sin_titulo"), warn(F.col("read_conf") < POOR, "ocr_pobre"), warn(n > LONG, "pieza_larga")), lambda x: x.isNotNull())
    return grouped.select(
        "case_id", "doc_id", "page_start", "page_end", "type", named.alias("description"), confidence(F.col("score"), F.col("read_conf"), n).alias("confidence"),
        find_date(F.col("source_text")).alias("date"), "source_text", warnings.alias("warnings"),
    )


def propose(pages: DataFrame, rules: list[Rule], covered: DataFrame | None = None) -> DataFrame:
    """Pieces of the pages that have text and are not in `covered` (case_id, global_no)."""
    left = pages.where("text IS NOT NULL")
    if covered is not None:
        left = left.join(covered.select("case_id", "global_no"), ["case_id", "global_no"], "left_anti")
    marked = cut(mark_pages(left, rules).drop("text"))
    keys = ["case_id", "doc_id", "global_no"]
    placed_ = left.select(*keys, "text").join(marked.join(cuts(marked), keys), keys)
    piece = ["case_id", "doc_id", "piece_no"]
    first = F.min_by(F.struct("type", "score", "text"), "global_no")
    heads = placed_.groupBy(*piece).agg(F.min("global_no").alias("page_start"), F.max("global_no").alias("page_end"), first.alias("_first"), F.min("conf").alias("read_conf"))
    grouped = heads.join(first_text(placed_, piece), piece)
    return finished(grouped.select("*", "_first.type", "_first.score", titled(F.col("_first.text"), F.col("_first.type"), rules).alias("title")))


def coverage(pieces: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages that a piece standing for its pages (`stands`) covers: those of its own document within its range, or of any for a piece without document."""
    ranges = pieces.where("stands").select("case_id", F.col("doc_id").alias("_doc"), F.col("page_start").alias("_first"), F.coalesce("page_end", "page_start").alias("_last"))
    met = inside(ranges, pages.select("case_id", "global_no", "doc_id"), ["case_id"], "_first", "_last", "global_no")
    return met.where("_doc IS NULL OR _doc = doc_id").select("case_id", "global_no").distinct()


def accept(proposals: DataFrame, covered: DataFrame) -> DataFrame:
    """Proposals none of whose pages is covered; one that touches a covered page goes whole."""
    ranges = proposals.select("case_id", F.col("page_start").alias("_first"), F.col("page_end").alias("_last"))
    bad = inside(ranges, covered.select("case_id", "global_no").distinct(), ["case_id"], "_first", "_last", "global_no").select("case_id", "_first", "_last").distinct()
    met = [proposals["case_id"] == bad["case_id"], proposals["page_start"] == bad["_first"], proposals["page_end"] == bad["_last"]]
    return proposals.join(bad, met, "left_anti")


def save(proposals: DataFrame, covered: DataFrame, pieces: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The new pieces that proposals make, and what became of these in each case.

    Pieces are the accepted proposals, pending and automatic, with the printed numbers of their ends and an
    order that goes on, page by page, from the largest of the case. The report has case_id, `created`,
    `existing` (automatic pieces that are active), `discarded`, and a `reason` where nothing is made though
    there are pieces. Coverage and pieces are those at the time of saving, not of proposing.
    """
    good = cut(accept(proposals, covered))
    top_order = pieces.groupBy("case_id").agg(F.max("order_out").alias("_top"))
    rows = placed(good, ["case_id"], [F.col("page_start"), F.col("page_end")], "_nth").join(top_order, "case_id", "left")
    made = labelled(rows.withColumn("order_out", F.coalesce("_top", F.lit(0)) + F.col("_nth")).drop("_top", "_nth"), pages).withColumns({"state": F.lit("pendiente"), "origin": F.lit("automatica"), "active": F.lit(True)})
    count = lambda df, n: df.groupBy("case_id").agg(F.count("*").alias(n))
    asked = count(proposals, "_all").join(count(good, "created"), "case_id", "left")
    every = asked.join(count(pieces.where("origin = 'automatica' AND active"), "existing"), "case_id", "full").fillna(0)
    reason = F.when((F.col("created") == 0) & (F.col("existing") > 0), COVERED)
    return made, every.select("case_id", "created", "existing", (F.col("_all") - F.col("created")).alias("discarded"), reason.alias("reason"))


def untouched(pieces: DataFrame, log: DataFrame, people: DataFrame, tags: DataFrame, settled_pairs: DataFrame) -> DataFrame:
    """Automatic, active, pending pieces that no person has touched: no final values, notes or group, no log, person, tag or settled pair."""
    free = pieces.where("origin = 'automatica' AND active AND state = 'pendiente' AND type_final IS NULL AND description_final IS NULL AND notes IS NULL AND group_id IS NULL")
    pairs = settled_pairs.select("case_id", F.explode(F.array("a", "b")).alias("piece_id"))
    for other in (log, people, tags, pairs):
        free = free.join(other.select("case_id", "piece_id"), ["case_id", "piece_id"], "left_anti")
    return free


def retire(free: DataFrame) -> DataFrame:
    """Log rows that switch untouched proposals off, so that their pages are proposed anew; pieces that anybody touched are not among them."""
    return free.select("case_id", "piece_id", F.lit("rehacer_deteccion").alias("field"), F.lit("1").alias("old"), F.lit("0").alias("new"))


def redo(pieces: DataFrame, pages: DataFrame, rules: list[Rule], free: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Log rows that retire `free` proposals, and new proposals for the pages that no other piece (with `stands`) covers."""
    kept = pieces.join(free.select("case_id", "piece_id"), ["case_id", "piece_id"], "left_anti")
    covered = coverage(kept, pages)
    return retire(free), accept(propose(pages, rules, covered), covered)
