"""Search: limits of each case, blank queries, the stored index, and snapshots of a log."""

import random

from pyspark.sql import functions as F

from sheafwork.operators import decisions, lineage, search
from sheafwork.plans import snapshots, tables


def hits(index, query, **kw):
    return {(r.case_id, r.page_id): (round(r.score, 6), r.place) for r in search.search_pages(index, query, **kw).collect()}


def test_no_case_is_starved(spark):
    rows = [(c, i, "alpha beta " * (1 + i % 3) + c) for c in "ab" for i in range(300)]
    index = search.index_of(spark.createDataFrame(rows, "case_id string, page_id long, text string"))
    got = search.search_pages(index, "alpha").groupBy("case_id").agg(F.count("*").alias("n"), F.max("place").alias("p")).collect()
    assert {(r.case_id, r.n, r.p) for r in got} == {("a", 200, 200), ("b", 200, 200)}
    assert search.search_pages(index, " \"\" ").isEmpty() and search.search_pages(index, "nothing-here").isEmpty()


def test_pieces_are_found_by_case_and_not_by_blanks(spark):
    rows = [(c, i, True, f"Acta {i}", None, None, None if i == 3 else i) for c in "ab" for i in range(5)]
    view = spark.createDataFrame(rows, "case_id string, piece_id long, active boolean, description string, source_text string, introducer string, page_start long")
    assert search.search_pieces(view, "   ").isEmpty()
    got = [(r.case_id, r.piece_id, r.place) for r in search.search_pieces(view, " ACTA ", 2).collect()]
    assert sorted(got) == [("a", 0, 2), ("a", 3, 1), ("b", 0, 2), ("b", 3, 1)]


def test_found_pages_have_number_and_snippet(spark):
    rows = [("a", 1, 11, 400, "bis", "manual", "before the word Alpha and after"), ("a", 2, 12, None, None, "desconocida", "alpha")]
    pages = spark.createDataFrame(rows, "case_id string, page_id long, global_no long, num long, suffix string, origin string, text string")
    out = {r.page_id: r for r in search.search_pages(search.index_of(pages), "alpha", pages=pages).collect()}
    assert (out[1].global_no, out[1].label, out[1].origin, out[1].snippet) == (11, "400 bis", "manual", "before the word Alpha and after") and out[2].label is None


def test_a_stored_index_grows_by_parts(spark, sf, tmp_path):
    pages = tables.documents(spark, sf).select(F.col("source").alias("case_id"), F.col("doc_id").alias("page_id"), "text")
    path = str(tmp_path / "index")
    search.write_index(pages.where("page_id % 3 <> 0"), path)
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "index" / "postings" / "part=0").iterdir()}
    changed = pages.where("page_id % 3 = 0").unionByName(pages.where("page_id % 7 = 1").withColumn("text", F.concat(F.lit("Replaced the text "), "page_id"))).unionByName(pages.where("page_id % 7 = 2 AND page_id % 3 <> 0").withColumn("text", F.lit(None).cast("string")))
    changed = changed.dropDuplicates(["case_id", "page_id"])
    search.write_index(changed, path, part=1)
    assert before == {f.name: f.stat().st_mtime_ns for f in (tmp_path / "index" / "postings" / "part=0").iterdir()}
    now = pages.join(changed.select("case_id", "page_id"), ["case_id", "page_id"], "left_anti").unionByName(changed)
    stored, fresh = search.open_index(spark, path), search.index_of(now)
    for query in ("the", '"of the" tion', "replaced", '"the text"', "zzz"):
        assert hits(stored, query) == hits(fresh, query), query
    assert hits(stored, "replaced")
    plan = search.search_pages(stored, "tion")._jdf.queryExecution().toString()
    assert "StringStartsWith(term,tion)" in plan and "text" not in plan.split("ReadSchema")[-1]


def test_postings_shuffle_no_words_and_join_rows_of_a_page(spark, sf):
    pages = spark.createDataFrame([("a", 1, "b a b"), ("a", 1, "a c d"), ("a", 1, "b"), ("a", 2, "Ä, a?"), ("b", 2, None), ("b", 3, " - ")], "case_id string, page_id long, text string")
    got = sorted((r.case_id, r.page_id, r.length, r.term, r.positions, r.tf) for r in search.postings(pages).collect())
    assert got == [("a", 1, 1, "b", [0], 1), ("a", 1, 3, "a", [0, 1], 2), ("a", 1, 3, "b", [0, 2], 2), ("a", 1, 3, "c", [1], 1), ("a", 1, 3, "d", [2], 1), ("a", 2, 2, "a", [0, 1], 2)]
    assert "Exchange hashpartitioning" not in search.postings(tables.documents(spark, sf).select(F.col("source").alias("case_id"), F.col("doc_id").alias("page_id"), "text"))._jdf.queryExecution().toString()


def counted(spark, sf):
    """Pages, and a counter of how often a text of them is read."""
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    pages = tables.documents(spark, sf).select(F.col("source").alias("case_id"), F.col("doc_id").alias("page_id"), F.udf(read)("text").alias("text"))
    return pages, seen


def test_an_index_is_written_from_one_reading_of_the_texts(spark, sf, tmp_path):
    pages, seen = counted(spark, sf)
    search.write_index(pages, str(tmp_path / "index"))
    assert seen.value == pages.count()
    assert search.open_index(spark, str(tmp_path / "index")).postings.where("term = ''").isEmpty()


def test_a_search_reads_the_texts_once(spark, sf):
    pages, seen = counted(spark, sf)
    assert search.search_pages(search.index_of(pages), '"of the" tion').collect()
    assert seen.value == pages.count()


def test_a_snapshot_and_the_rest_fold_like_the_log(spark, sf, tmp_path):
    log = tables.log(spark, sf).unionByName(tables.made_log(spark, sf).select((F.col("seq") + F.col("piece_id") % 900).alias("seq"), F.lit("e0").alias("case_id"), "piece_id", "field", F.lit("1").alias("new"))).dropDuplicates(["case_id", "piece_id", "field", "seq"])
    path, rng = str(tmp_path / "snapshots"), random.Random(1)
    top = log.agg(F.max("seq")).first()[0]
    cuts = sorted(rng.sample(range(top), 3))
    assert snapshots.stored(spark, path) == [] and snapshots.since(log, path).count() == log.count()
    for n in cuts:
        snapshots.take(log, path, n)
    assert snapshots.stored(spark, path) == cuts
    for at in (None, cuts[1], cuts[1] + 5, cuts[0] - 1):
        whole, short = log if at is None else log.where(F.col("seq") <= at), snapshots.since(log, path, at)
        assert short.count() <= whole.count()
        for fold in (decisions.finals, lambda x: decisions.last(x, "state"), lambda x: decisions.last(x, "group_id"), lineage.last_switch):
            a, b = fold(whole), fold(short)
            assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
    links = tables.link_log(spark, sf)
    snapshots.take(links, f"{path}-links", cuts[1], ("case_id", "piece_id", "person_id", "function"))
    a, b = decisions.links(links), decisions.links(snapshots.since(links, f"{path}-links"))
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
