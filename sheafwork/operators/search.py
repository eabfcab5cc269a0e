"""Search over page texts and pieces: postings, queries, ranking, snippets."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import fold, label_text
from ..plans.graph import cut
from ..plans.order import top

LIMIT, CONTEXT = 200, 90
K1, B = 1.2, 0.75
LEAST_PREFIX = 3
#: Files of a stored index that a term is dealt over, so that a very frequent one is no task of its own.
SLOTS = 8


def terms(text: Column) -> Column:
    """The folded lower-case words of a text."""
    return F.filter(F.split(F.lower(fold(F.coalesce(text, F.lit("")))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value, which is worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _grouped(words: Column, test: Callable[[Column], Column] | None = None) -> Column:
    """The places of each word, from an array of words; of words that pass a test where one is given. Sorted, so that equal words are a run."""
    spots = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    found = F.sort_array(spots if test is None else F.filter(spots, lambda x: test(x["term"])))

    def runs(s: Column) -> Column:
        starts = F.filter(F.transform(s, lambda x, i: F.when((i == 0) | (x["term"] != F.get(s, i - 1)["term"]), i)), lambda i: i.isNotNull())
        end = lambda at, k: F.coalesce(F.get(at, k + 1), F.size(s))
        run = lambda at, places: F.transform(at, lambda i, k: F.struct(F.get(s, i)["term"].alias("term"), F.slice(places, i + 1, end(at, k) - i).alias("positions")))
        return _bound(starts, lambda at: _bound(F.transform(s, lambda x: x["pos"]), lambda places: run(at, places)))

    return _bound(found, runs)


def _worded(pages: DataFrame) -> DataFrame:
    """Pages (case_id, page_id, text) with their words `_w` and the number of these."""
    return pages.select("case_id", "page_id", terms(F.col("text")).alias("_w")).withColumn("length", F.size("_w"))


def postings(pages: DataFrame) -> DataFrame:
    """Pages (case_id, page_id, text) as case_id, term, page_id, length, positions, tf.

    A page's words are grouped in its own row, so no word is shuffled. Only rows that share a page meet.
    """
    there = pages.where("text IS NOT NULL")
    single = lambda rows: rows.select("case_id", "page_id", "length", F.inline(_grouped(F.col("_w"))))
    if there.groupBy("case_id", "page_id").agg(F.count("*").alias("_n")).where("_n > 1").isEmpty():
        found = single(_worded(there))
    else:
        counted = _worded(there).withColumn("_n", F.count("*").over(Window.partitionBy("case_id", "page_id")))
        met = single(counted.where("_n > 1")).groupBy("case_id", "page_id", "length", "term").agg(F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"))
        found = single(counted.where("_n = 1")).unionByName(met)
    return found.select("case_id", "term", "page_id", "length", "positions", F.size("positions").alias("tf"))


@dataclass(frozen=True)
class Clause:
    """Words in a row; the last may be a beginning."""

    words: tuple[str, ...]
    prefix: bool


def parse(query: str) -> list[Clause]:
    """Quoted words are a phrase, a bare word of 3 letters or more is a beginning; all must be found."""
    import unicodedata

    plain = "".join(c for c in unicodedata.normalize("NFD", query) if unicodedata.category(c) != "Mn").lower()
    split = lambda t: tuple(w for w in re.split(r"[\W_]+", t) if w)
    out = []
    for quoted, bare in re.findall(r'"([^"]*)"|(\S+)', plain):
        words = split(quoted or bare)
        if words:
            out.append(Clause(words, bool(bare) and len(words[-1]) >= LEAST_PREFIX))
    return out


@dataclass(frozen=True)
class Index:
    """Postings (case_id, term, page_id, positions, length) and the pages they are of (case_id, page_id, length)."""

    postings: DataFrame
    pages: DataFrame

    def of(self, test: Callable[[Column], Column]) -> Index:
        return self


@dataclass(frozen=True)
class Texts:
    """Pages (case_id, page_id, text) without a stored index."""

    pages: DataFrame

    def of(self, test: Callable[[Column], Column]) -> Index:
        """An index of the words that pass a test, and of all pages with words. Texts are read once; lengths and what is found are written down."""
        found = cut(_worded(self.pages).select("case_id", "page_id", "length", _grouped(F.col("_w"), test).alias("_found"))).where("length > 0")
        return Index(found.select("case_id", "page_id", "length", F.inline("_found")), found.select("case_id", "page_id", "length").distinct())


def index_of(pages: DataFrame) -> Texts:
    """An index of page texts that is not written down."""
    return Texts(pages)


def write_index(pages: DataFrame, path: str, part: int = 0) -> None:
    """Adds pages (case_id, page_id, text) to a stored index as a part of their own; nothing of other parts is read or written.

    Postings are dealt by terms, each of them over `SLOTS` files at most, and sorted, so a word reads few files, and
    a beginning few row groups of each. Nothing is sampled for that. A page that is in several parts counts by the largest of these, so a
    part can replace pages of earlier ones; a text without words takes a page away. A part that is written
    again replaces itself.
    """
    parts = max(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), pages.sparkSession.sparkContext.defaultParallelism)
    # a row without a word tells a page's length, so that texts are read once
    length = F.array(F.struct(F.lit("").alias("term"), F.array().cast("array<int>").alias("positions")))
    found = _worded(pages).select("case_id", "page_id", "length", F.inline(F.concat(_grouped(F.col("_w")), length)))
    dealt = found.select("case_id", "term", "page_id", "length", "positions", F.size("positions").alias("tf")).repartition(parts, "term", F.pmod(F.hash("page_id"), F.lit(SLOTS)))
    dealt.sortWithinPartitions("term", "case_id", "page_id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(f"{path}/postings/part={part}")
    pages.sparkSession.read.parquet(f"{path}/postings/part={part}").where("term = ''").select("case_id", "page_id", "length").write.mode("overwrite").parquet(f"{path}/pages/part={part}")


def open_index(spark: SparkSession, path: str) -> Index:
    """A stored index. Neither opening nor searching it reads a text."""
    every = spark.read.parquet(f"{path}/pages")
    last = every.groupBy("case_id", "page_id").agg(F.max_by(F.struct("part", "length"), "part").alias("_l")).select("case_id", "page_id", "_l.*").where("length > 0")
    held = spark.read.parquet(f"{path}/postings").where("term <> ''").join(last.select("case_id", "page_id", "part"), ["case_id", "page_id", "part"], "left_semi")
    return Index(held.drop("part"), last.drop("part"))


def _wanted(clauses: list[Clause]) -> list[tuple[int, int, Callable[[Column], Column]]]:
    """Each word of a query with its clause, its place there, and the test that a term has to pass."""
    out = []
    for i, clause in enumerate(clauses):
        for j, word in enumerate(clause.words):
            begins = clause.prefix and j == len(clause.words) - 1
            out.append((i, j, (lambda t, w=word: t.startswith(w)) if begins else (lambda t, w=word: t == w)))
    return out


def any_word(clauses: list[Clause]) -> Callable[[Column], Column]:
    """Whether a term is looked for."""
    return lambda term: reduce(or_, [test(term) for *_, test in _wanted(clauses)])


def match(index: Index, clauses: list[Clause]) -> DataFrame:
    """Pages that each clause is found on, with how often: case_id, page_id, length, clause, tf. The postings are read once for all words."""
    places = F.filter(F.array(*[F.when(test(F.col("term")), F.struct(F.lit(i).alias("clause"), F.lit(j).alias("at"))) for i, j, test in _wanted(clauses)]), lambda x: x.isNotNull())
    sizes = F.element_at(F.array(*[F.lit(len(c.words)) for c in clauses]), F.col("clause") + 1)
    rows = index.postings.where(any_word(clauses)(F.col("term"))).select("case_id", "page_id", "length", "positions", F.inline(places)).select("case_id", "page_id", "length", "clause", F.explode(F.transform("positions", lambda p: p - F.col("at"))).alias("_start"))
    # a place holds one word, so a clause stands where as many of its words fit as it has
    whole = rows.groupBy("case_id", "page_id", "length", "clause", "_start").agg(F.count("*").alias("_n")).where(F.col("_n") == sizes)
    return whole.groupBy("case_id", "page_id", "length", "clause").agg(F.count("*").alias("tf"))


def search_pages(index: Index | Texts, query: str, limit: int = LIMIT, pages: DataFrame | None = None) -> DataFrame:
    """The best pages of each case that hold all clauses of a query, `limit` of a case at most: case_id, page_id, score (BM25 within the case), place.

    With `pages` (case_id, page_id, global_no, num, suffix, origin, text) also global_no, the printed number
    `label` with its origin, and a `snippet`; only pages found are looked up. Equal scores to six places go
    by page. A query without words finds nothing.
    """
    clauses = parse(query)
    empty = index.pages.limit(0).select("case_id", "page_id", F.lit(0.0).alias("score"), F.lit(0).alias("place"))
    if clauses:
        index = index.of(any_word(clauses))
        stats = index.pages.groupBy("case_id").agg(F.count("*").alias("_n"), F.avg("length").alias("_avg"))
        hits = match(index, clauses)
        df = hits.groupBy("case_id", "clause").agg(F.count("*").alias("_df"))
        rows = hits.join(df, ["case_id", "clause"]).join(stats, "case_id")
        idf = F.greatest(F.ln((F.col("_n") - F.col("_df") + 0.5) / (F.col("_df") + 0.5)), F.lit(1e-6))
        part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("_avg")))
        scored = rows.withColumn("_part", part).groupBy("case_id", "page_id").agg(F.round(F.sum("_part"), 6).alias("score"), F.count("*").alias("_found")).where(F.col("_found") == len(clauses)).drop("_found")
        found = top(scored, ["case_id"], [F.desc("score"), F.col("page_id")], limit)
    else:
        found = empty
    if pages is None:
        return found
    shown = pages.select("case_id", "page_id", "global_no", label_text(F.col("num"), F.col("suffix")).alias("label"), "origin", snippet(F.col("text"), query).alias("snippet"))
    return found.join(shown, ["case_id", "page_id"])


def snippet(text: Column, query: str) -> Column:
    """90 characters on both sides of the query's first word, with dots where text is cut; the text's beginning where the word is not found as written."""
    first = next(iter(re.findall(r"[^\s\"]+", query)), "")
    at = F.when(F.lit(bool(first)), F.instr(F.lower(text), first.lower())).otherwise(0)
    start, stop = F.greatest(at - CONTEXT, F.lit(1)), F.least(at + len(first) + CONTEXT - 1, F.length(text))
    cut = F.concat(F.when(start > 1, "…").otherwise(""), F.trim(F.substring(text, start, stop - start + 1)), F.when(stop < F.length(text), "…").otherwise(""))
    head = F.concat(F.trim(F.substring(text, 1, 2 * CONTEXT)), F.when(F.length(text) > 2 * CONTEXT, "…").otherwise(""))
    return F.when(at > 0, cut).otherwise(head)


def search_pieces(view: DataFrame, query: str, limit: int = LIMIT, folded: bool = False) -> DataFrame:
    """Active pieces of each case with a text in description, source text or introducer, by page and then id, `limit` of a case at most, with their `place`. Spaces round the text do not count, and a blank one finds nothing. Accents count unless `folded`."""
    wanted = query.strip()
    side = (lambda c: F.lower(fold(c))) if folded else F.lower
    found = F.lit(False)
    for c in ("description", "source_text", "introducer"):
        found = found | F.coalesce(F.contains(side(F.col(c)), side(F.lit(wanted))), F.lit(False))
    return top(view.where("active").where(found if wanted else F.lit(False)), ["case_id"], [F.col("page_start").asc_nulls_first(), F.col("piece_id")], limit)


def search(index: Index | Texts, view: DataFrame, query: str, pages: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Pages and pieces for a query."""
    return search_pages(index, query, pages=pages), search_pieces(view, query)
