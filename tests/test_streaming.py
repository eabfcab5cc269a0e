"""Streaming twins give what their batch twins give."""

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import decisions, registration, segmentation
from sheafwork.plans import queries, tables
from sheafwork.sources import files
from sheafwork.streaming import live


@pytest.fixture
def stream(spark, tmp_path):
    """Writes a table as several files and reads it as a stream, a file at a time."""

    def make(table, name, parts=3):
        table.repartition(parts).write.parquet(str(tmp_path / name))
        return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))

    return make


def drain(frame, mode, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return frame.sparkSession.table(name)


def test_intake_equals_registration(spark, sf, stream):
    rows = tables.deliveries(spark, sf)
    got = drain(live.intake(stream(rows, "deliveries")), "append", "intake")
    want = registration.register(rows, magic=None).where("outcome = 'registrado'").select("case_id", "sha256")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_live_states_and_counters(spark, sf, stream):
    log = tables.log(spark, sf)
    got = drain(live.live_states(stream(log, "log")), "complete", "states")
    want = decisions.last(log, "state")
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    counts = drain(live.live_counters(stream(log, "log2")), "complete", "counters")
    assert counts.exceptAll(log.groupBy("case_id", "field", "new").agg(F.count("*").alias("n"))).isEmpty()


def same(got, want):
    assert got.count() == want.count() and got.select(want.columns).exceptAll(want).isEmpty()


def test_the_fold_of_a_stream_equals_batch(spark, sf, stream):
    switches = tables.made_log(spark, sf).select("seq", F.lit("e0").alias("case_id"), (F.col("piece_id") % 50).alias("piece_id"), "field", F.lit("1").alias("new"))
    # one order of numbers for each piece
    log = tables.log(spark, sf).unionByName(switches.withColumn("seq", F.xxhash64("seq", "piece_id", "field") % 10**9)).dropDuplicates(["case_id", "piece_id", "seq"])
    got = drain(live.live_fold(stream(log.orderBy(F.rand(3)), "fold", parts=7)), "complete", "folded")
    pieces = log.select("case_id", "piece_id").distinct()
    from sheafwork.operators import lineage

    want = decisions.states(pieces, log).join(decisions.finals(log), ["case_id", "piece_id"], "left").join(decisions.last(log, "group_id"), ["case_id", "piece_id"], "left").join(lineage.last_switch(log).withColumnRenamed("field", "switch"), ["case_id", "piece_id"], "left")
    same(got, want)
    assert got.where("switch IS NOT NULL").count() > 10 and got.where("number_start_final IS NOT NULL").count() > 10


def test_streamed_proposals_equal_batch(spark, sf, stream, tmp_path):
    pages = queries.chat_numbered(spark, sf)
    covered = pages.where("doc_id % 5 = 0 OR global_no % 17 = 3").select("case_id", "global_no")
    source = stream(pages.repartition(1, "doc_id"), "pages", parts=1)
    live.proposals(source, tables.RULES, covered, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    same(live.latest(spark.read.parquet(str(tmp_path / "out"))), segmentation.propose(pages, tables.RULES, covered))


def test_pages_of_a_document_come_split_late_and_twice(spark, sf, tmp_path):
    pages = queries.chat_numbered(spark, sf).withColumn("text", F.when(F.col("global_no") % 11 != 4, F.col("text")))
    for part in (2, 0, 1):
        pages.where(F.col("page_no") % 3 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    pages.where("page_no = 1").coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    none = pages.limit(0).select("case_id", "global_no")
    q = live.proposals(source, tables.RULES, none, str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    same(live.latest(spark.read.parquet(str(tmp_path / "out"))), segmentation.propose(pages, tables.RULES, none))


def test_rows_of_a_batch_do_not_grow(spark, sf, tmp_path):
    pages = queries.chat_numbered(spark, sf)
    for part in range(6):
        pages.where(F.col("doc_id") % 6 == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    source = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    q = live.proposals(source, tables.RULES, pages.limit(0).select("case_id", "global_no"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert len(read) == 6 and max(read) <= 3 * pages.count() / 6 and sum(read) <= 2 * pages.count()


def test_proposals_hold_state_by_shelves_of_documents(spark, sf, stream, tmp_path):
    pages = queries.chat_numbered(spark, sf).withColumn("case_id", F.lit("c"))
    source = stream(pages.repartition(1), "pages2", parts=1)
    q = live.proposals(source, tables.RULES, pages.limit(0).select("case_id", "global_no"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    shelves = pages.select("case_id", F.shiftright("doc_id", 8)).distinct().count()
    held = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    assert pages.select("case_id", "doc_id").distinct().count() > 10 * shelves and held <= 2 * shelves


def test_a_page_that_waits_and_comes_again_counts_once(spark, tmp_path):
    page = lambda doc, n, text: ("a", doc, n, 100 * doc + n, text, 0.9)
    schema = "case_id string, doc_id long, page_no int, global_no long, text string, conf double"
    batches = [[page(1, 3, "x3"), page(2, 2, "y2")], [page(1, 3, "x3"), page(1, 4, "x4")], [page(2, 1, "y1")], [page(1, 1, "x1"), page(1, 2, "x2"), page(1, 3, "x3")], [page(1, 5, "x5"), page(300, 1, "z1")]]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "pages"))
    pages = spark.createDataFrame([r for rows in batches for r in rows], schema).distinct()
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "pages"))
    none = pages.limit(0).select("case_id", "global_no")
    live.proposals(source, tables.RULES, none, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    got = live.latest(spark.read.parquet(str(tmp_path / "out")))
    same(got, segmentation.propose(pages, tables.RULES, none))
    assert {r.source_text for r in got.collect()} == {"x1 x2 x3 x4 x5", "y1 y2", "z1"}


def test_streamed_counters_equal_batch(spark, sf, stream, tmp_path):
    log, start = tables.log(spark, sf), queries.start_view(spark, sf)
    q = live.checklist_counters(stream(log.orderBy(F.rand(5)), "log3", parts=5), start, str(tmp_path / "counts"), str(tmp_path / "mark"))
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "counts"))
    last = got.where(F.col("batch") == got.agg(F.max("batch")).first()[0]).drop("batch")
    same(last, queries.counters(spark, sf))
    assert got.select("batch").distinct().count() == 5
    read = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
    assert max(read) <= 2 * log.count() / 5


def test_counters_hold_state_by_shelves_of_pieces(spark, sf, stream, tmp_path):
    log, start = tables.log(spark, sf), queries.start_view(spark, sf)
    q = live.checklist_counters(stream(log.repartition(1), "log4", parts=1), start, str(tmp_path / "counts"), str(tmp_path / "mark"))
    q.awaitTermination()
    shelves = start.select("case_id", F.shiftright("piece_id", live.SHELF)).distinct().count()
    held = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    assert start.count() > 100 and held <= 3 * shelves


def test_sinks_and_folder_load(spark, sf, tmp_path):
    for case in ("a", "b"):
        (tmp_path / "in" / case).mkdir(parents=True)
        for n in range(3):
            (tmp_path / "in" / case / f"{n}.pdf").write_bytes(b"%PDF-1.4 " + bytes([65 + n % 2]))
    (tmp_path / "in" / "a" / "9.pdf").write_bytes(b"no")
    rows = files.load_folder(spark, str(tmp_path / "in"))
    found = registration.register(rows)
    assert {(r.case_id, r.arrival): r.outcome for r in found.collect()}[("a", 4)] == "pdf_invalido"
    assert found.where("outcome = 'repetido'").count() == 2
    files.append_exceptions(registration.exceptions(found), str(tmp_path / "bad"))
    files.append_exceptions(registration.exceptions(found), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "bad")).count() == 2
    texts = queries.report_texts(spark, sf)
    files.write_texts(texts, str(tmp_path / "texts"))
    assert spark.read.text(str(tmp_path / "texts"), wholetext=True).count() == texts.count()
    files.write_backups(queries.backups(spark, sf), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).where("size(evidencias) > 0 AND size(fojas) > 0").count() == 5
    reading = spark.createDataFrame([("a", 1, "x"), ("b", 1, "y")], "case_id string, page_id long, text string")
    files.overwrite_readings(reading, str(tmp_path / "readings"))
    files.overwrite_readings(reading.where("case_id = 'a'").withColumn("text", F.lit("z")), str(tmp_path / "readings"))
    assert {r.text for r in spark.read.parquet(str(tmp_path / "readings")).collect()} == {"z", "y"}
