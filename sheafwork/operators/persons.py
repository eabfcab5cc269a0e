"""Persons: keys, proposals to merge, accepted merges, and what each introduces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import name_key
from ..plans.graph import smallest_reachable
from ..plans.order import placed

LEAST = 0.72


def with_keys(people: DataFrame) -> DataFrame:
    """Persons (person_id, name, …) with their key and `kept_id`, the smallest id of that key in the case; an empty key is kept apart."""
    keyed = people.withColumn("key", name_key(F.col("name")))
    first = keyed.where("key <> ''").groupBy("case_id", "key").agg(F.min("person_id").alias("_first"))
    return keyed.join(first, ["case_id", "key"], "left").withColumn("kept_id", F.coalesce("_first", "person_id")).drop("_first")


def common_words(a: Column, b: Column) -> Column:
    """Words that two names share; an initial that only one has counts if it begins a longer word that only the other has."""
    initials = lambda x, y: F.filter(F.array_except(x, y), lambda w: (F.length(w) == 1) & F.exists(F.array_except(y, x), lambda v: (F.length(v) > 1) & v.startswith(w)))
    return F.array_union(F.array_union(F.array_intersect(a, b), initials(a, b)), initials(b, a))


def likeness(a: Column, b: Column, n: Column | None = None) -> Column:
    """How alike two arrays of distinct words of names are: their Jaccard, or more if one name is contained in the other by two words at least. `n` is the number of their common words, where that is known."""
    n = F.size(common_words(a, b)) if n is None else n
    share = n / F.size(F.array_union(a, b))
    contained = (n >= F.least(F.size(a), F.size(b))) & (n >= 2)
    return F.when(n == 0, 0.0).when(contained, F.greatest(share, 0.75 + 0.25 * share)).otherwise(share)


def merge_proposals(people: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """Pairs (case_id, a, b, score, reason) of persons (person_id, name, document) that may be one.

    The threshold needs a shared document, one equal word as the whole of both names, or two matches of
    words or initials, so only persons that share one of these meet; a common word alone brings nobody
    together. Decided pairs are left out. What persons meet on is a 64-bit hash: two that clash only bring
    a pair more to be scored. Rows with a row for each pair of words are never broadcast, as plans estimate
    them by the names they come from.
    """
    rows = people.select("case_id", "person_id", "document", F.array_distinct(F.filter(F.split(name_key(F.col("name")), " "), lambda w: w != "")).alias("w"))
    # a word may match as it is, or as an initial (s) with a longer word of that initial (l)
    forms = lambda w, turned: F.array(F.concat(F.lit("="), w), F.concat(F.when(F.length(w) == 1, "l" if turned else "s").otherwise("s" if turned else "l"), F.left(w, F.lit(1))))
    both = lambda x, y: F.transform(x, lambda a: F.transform(y, lambda b: F.concat(F.least(a, b), F.lit(" "), F.greatest(a, b))))

    def two(turned: bool) -> Column:
        later = lambda i: F.filter(F.transform("w", lambda v, j: F.when(j > i, v)), lambda v: v.isNotNull())
        pairs = F.flatten(F.transform("w", lambda u, i: F.flatten(F.transform(later(i), lambda v: F.flatten(both(forms(u, turned), forms(v, turned)))))))
        return F.when(F.size("w") == 1, F.transform("w", lambda u: F.concat(F.lit("only "), u))).otherwise(pairs)

    dealt = lambda turned, name: rows.select("case_id", F.col("person_id").alias(name), F.explode(F.array_distinct(two(turned))).alias("_b"))
    side_of = lambda turned, name: dealt(turned, name).select(F.xxhash64("case_id", "_b").alias("block"), "case_id", name)
    by_words = side_of(False, "p").hint("merge").join(side_of(True, "q"), ["block", "case_id"]).where("p < q").select("case_id", "p", "q")
    papers = rows.where("document IS NOT NULL AND document <> ''").select("case_id", "document", "person_id")
    by_paper = papers.withColumnRenamed("person_id", "p").hint("merge").join(papers.withColumnRenamed("person_id", "q"), ["case_id", "document"]).where("p < q").select("case_id", "p", "q")
    met = by_words.union(by_paper).select("case_id", F.col("p").alias("a"), F.col("q").alias("b")).distinct()
    if decided is not None:
        met = met.join(decided.select("case_id", "a", "b"), ["case_id", "a", "b"], "left_anti")
    side = lambda x: rows.select("case_id", F.col("person_id").alias(x), F.col("w").alias(f"w_{x}"), F.col("document").alias(f"document_{x}"))
    full = met.join(side("a").hint("merge"), ["case_id", "a"]).join(side("b").hint("merge"), ["case_id", "b"])
    paper = F.coalesce((F.col("document_a") == F.col("document_b")) & (F.col("document_a") != ""), F.lit(False))

    def judged(n: Column) -> Column:
        contained = (n >= F.least(F.size("w_a"), F.size("w_b"))) & (n >= 2)
        reason = F.when(paper, "mismo_documento").when(contained, "nombre_incompleto").otherwise("nombres_parecidos")
        return F.struct(F.when(paper, 1.0).otherwise(F.round(likeness(F.col("w_a"), F.col("w_b"), n), 3)).alias("score"), reason.alias("reason"))

    # an array of one holds the number of common words, so that it is counted once for a pair
    found = F.transform(F.array(F.size(common_words(F.col("w_a"), F.col("w_b")))), judged)
    return full.select("case_id", "a", "b", F.inline(F.filter(found, lambda x: x["score"] >= LEAST)))


def merged(people: DataFrame, accepted: DataFrame) -> DataFrame:
    """Persons with `kept_id` after accepted merges (case_id, kept, absorbed); chains of merges end at their smallest person."""
    found = smallest_reachable(accepted.select("case_id", F.col("kept").alias("a"), F.col("absorbed").alias("b")))
    return people.join(found.select("case_id", F.col("node").alias("person_id"), F.col("root").alias("_root")), ["case_id", "person_id"], "left").withColumn("kept_id", F.coalesce("_root", "person_id")).drop("_root")


def relink(links: DataFrame, people: DataFrame) -> DataFrame:
    """Links (case_id, piece_id, person_id, function) moved to the persons kept; what becomes equal is one link."""
    return links.join(people.select("case_id", "person_id", "kept_id"), ["case_id", "person_id"]).select("case_id", "piece_id", F.col("kept_id").alias("person_id"), "function").distinct()


def load(people: DataFrame, links: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per person: active pieces introduced, and included ones."""
    own = links.where("function = 'introductor'").join(pieces.where("active").select("case_id", "piece_id", "state"), ["case_id", "piece_id"])
    counts = own.groupBy("case_id", "person_id").agg(F.count_distinct("piece_id").alias("introduced"), F.count_distinct(F.when(F.col("state") == "incluida", F.col("piece_id"))).alias("included"))
    return people.select("case_id", "person_id", "name").join(counts, ["case_id", "person_id"], "left").fillna(0, ["introduced", "included"])


def by_introducer(people: DataFrame, links: DataFrame, pieces: DataFrame, included_only: bool = False) -> DataFrame:
    """Per introducer the list of its active pieces by page and id; those without one come under a null person."""
    rows = pieces.where("active AND state = 'incluida'" if included_only else "active").select("case_id", "piece_id", "page_start")
    own = rows.join(links.where("function = 'introductor'").select("case_id", "piece_id", "person_id"), ["case_id", "piece_id"], "left")
    listed = own.groupBy("case_id", "person_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("page_start", "piece_id"))), lambda x: x["piece_id"]).alias("pieces"))
    named = people.select("case_id", "person_id", "name")
    return listed.join(named, ["case_id", "person_id"], "left")


def introduced(people: DataFrame, links: DataFrame, pieces: DataFrame) -> DataFrame:
    """The same as rows, a row for each active piece, so that no person's pieces, nor those without one, are gathered: case_id, person_id, name, piece_id, place among the person's pieces by page."""
    who = links.where("function = 'introductor'").select("case_id", "piece_id", "person_id").join(people.select("case_id", "person_id", "name"), ["case_id", "person_id"])
    rows = pieces.where("active").select("case_id", "piece_id", "page_start").join(who, ["case_id", "piece_id"], "left")
    return placed(rows, ["case_id", "person_id"], [F.col("page_start").asc_nulls_last(), F.col("piece_id")], "place").select("case_id", "person_id", "name", "piece_id", "place")
