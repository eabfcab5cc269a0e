"""Procedural operators against plain restatements, on small tables with known results."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sheafwork.functions import text as tx
from sheafwork.operators import decisions, headings, lineage, lines, numbering, report, segmentation, similarity
from sheafwork.operators.headings import Rule
from sheafwork.plans import queries, tables
from sheafwork.sources import files

RULES = [Rule("acta", "Acta", "documental", 0.9, (r"^ACTA\b",)), Rule("pericia", "Pericia", "pericial", 0.7, (r"\bPERICIA\b",))]


def pages(spark, *documents):
    """Documents of pages of lines as a numbered page table."""
    rows, at = [], 0
    for doc, texts in enumerate(documents):
        for text in texts:
            at += 1
            rows.append(("c", doc, at, text, 0.9))
    return spark.createDataFrame(rows, "case_id string, doc_id long, global_no long, text string, conf double")


@pytest.mark.parametrize(
    ("texts", "want"),
    [
        (["ACTA\nHOJA 1 DE 2", "ACTA\nHOJA 2 DE 2", "ACTA\nHOJA 1 DE 2", "ACTA\nHOJA 2 DE 2"], [(1, 2), (3, 4)]),
        (["ACTA\nHOJA 1 DE 3", "ACTA\nHOJA 2 DE 3", "ACTA\nHOJA 3 DE 3"], [(1, 3)]),
        (["ACTA\nHOJA 1 DE 2", "ACTA\nHOJA 2 DE 2", "ACTA\nHOJA 2 DE 5"], [(1, 2), (3, 3)]),
        (["ACTA\nHOJA 1 DE 1", "OTRA COSA\nHOJA 1 DE 2", "OTRA COSA\nHOJA 2 DE 2"], [(1, 1), (2, 3)]),
        (["nada", "se transcribe a continuacion", "PERICIA", "sigue"], [(1, 2), (3, 4)]),
    ],
)
def test_cuts(spark, texts, want):
    got = segmentation.propose(pages(spark, texts), RULES).orderBy("page_start").collect()
    assert [(r.page_start, r.page_end) for r in got] == want


def test_documents_cut_and_covered_pages_split(spark):
    table = pages(spark, ["ACTA uno", "mas"], ["cola", "fin", "resto"])
    covered = spark.createDataFrame([("c", 4)], "case_id string, global_no long")
    got = segmentation.propose(table, RULES, covered).orderBy("page_start").collect()
    assert [(r.page_start, r.page_end, r.doc_id) for r in got] == [(1, 2, 0), (3, 3, 1), (5, 5, 1)]
    assert got[1].warnings == ["sin_titulo"] and got[0].description == "ACTA uno"
    assert got[0].confidence == round(0.55 * 0.9 + 0.45 * 0.9, 3)


def test_proposals_cover_every_page_once(spark, sf):
    numbered = queries.chat_numbered(spark, sf)
    spread = queries.proposals(spark, sf).select("case_id", F.explode(F.sequence("page_start", "page_end")).alias("global_no"))
    assert spread.count() == spread.distinct().count() == numbered.where("text IS NOT NULL").count()
    assert numbered.select("case_id", "global_no").exceptAll(spread).isEmpty()


def test_runs_settle_by_readings(spark):
    rows = [("k", "sup_der", p, p + 399) for p in range(1, 40) if p % 5] + [("k", "inf_der", p, p + 1) for p in range(10, 20)] + [("k", "sup_cen", p, p + 5) for p in range(1, 40, 13)] + [("k", "inf_cen", p, p) for p in range(50, 55)]
    readings = spark.createDataFrame(rows, "case_id string, zone string, global_no long, num long")
    chosen = numbering.settle(numbering.runs(readings))
    assert sorted((r.zone, r.from_page, r.to_page, r.readings) for r in chosen.collect()) == [("inf_cen", 50, 54, 5), ("sup_der", 1, 39, 32)]
    labels = {r.global_no: r for r in numbering.label_pages(chosen, readings).collect()}
    assert len(labels) == 44 and labels[5].reading == "interpolada" and labels[5].num == 404 and labels[6].reading == "leida"
    assert abs(labels[5].conf - round(labels[6].conf * 0.7, 3)) < 1e-9


def test_runs_equal_the_greedy_loop(spark):
    rng, rows, want = random.Random(4), [], set()
    for case in range(60):
        found, page = {}, 0
        for _ in range(rng.randrange(1, 40)):
            page += rng.choice([1, 1, 1, 2, 5, 13, 14])
            found[page] = page + rng.choice([3, 3, 3, 3, 8])
        rows += [(f"c{case}", "z", p, n) for p, n in found.items()]
        ordered = sorted(found)
        start = last = ordered[0]
        n = 1
        for p in [*ordered[1:], None]:
            if p is not None and found[p] - p == found[last] - last and p - last <= 12:
                last, n = p, n + 1
                continue
            if n >= 4:
                want.add((f"c{case}", start, last, n))
            start = last = p
            n = 1
    got = numbering.runs(spark.createDataFrame(rows, "case_id string, zone string, global_no long, num long")).collect()
    assert {(r.case_id, r.from_page, r.to_page, r.readings) for r in got} == want


def test_lines_from_words(spark):
    rows = [("c", 1, 0, "mundo", 50.0, 10.4, 80.0, 20.0), ("c", 1, 1, "hola", 10.0, 10.0, 40.0, 20.0), ("c", 1, 2, "abajo", 10.0, 30.0, 40.0, 38.0), ("c", 2, 0, "otra", 1.0, 1.0, 2.0, 2.0)]
    words = spark.createDataFrame(rows, "case_id string, page_id long, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    got = [(r.page_id, r.line_no, r.text, r.x1) for r in lines.rebuild(words).orderBy("page_id", "line_no").collect()]
    assert got == [(1, 0, "hola mundo", 80.0), (1, 1, "abajo", 40.0), (2, 0, "otra", 2.0)]
    assert [r.text for r in lines.rebuild(words, limit=1).orderBy("page_id").collect()] == ["hola mundo", "otra"]


def test_lines_hold_every_word_of_a_page(spark, sf):
    rows = [("c", 1, n, f"w{n}", 10.0, 20.0 * n, 40.0, 20.0 * n + 10) for n in range(9)]
    words = spark.createDataFrame(rows, "case_id string, page_id long, ord int, text string, x0 double, y0 double, x1 double, y1 double")
    assert [(r.line_no, r.text) for r in lines.rebuild(words).orderBy("line_no").collect()] == [(n, f"w{n}") for n in range(9)]
    held = queries.QUERIES["w3_lines"](spark, sf).agg(F.sum(F.size(F.split("text", " ")))).first()[0]
    assert held == tables.lineitem(spark, sf).count() and "line_no <" not in queries.ORACLES["w3_lines"]


def test_images_and_readings(spark):
    pg = spark.createDataFrame([("c", 1, 100.0, 100.0), ("c", 2, 100.0, 100.0), ("c", 3, 100.0, 100.0)], "case_id string, page_id long, width_pt double, height_pt double")
    images = spark.createDataFrame([("c", 1, 0, 0.0, 0.0, 50.0, 40.0), ("c", 2, 0, -10.0, 0.0, 10.0, 10.0)], "case_id string, page_id long, image_no int, x0 double, y0 double, x1 double, y1 double")
    words = spark.createDataFrame([("c", 1, "w", float(i), 1.0, float(i) + 1, 2.0) for i in range(4)], "case_id string, page_id long, text string, x0 double, y0 double, x1 double, y1 double")
    got = {r.page_id: (r.share, r.needs_reading) for r in lines.images_to_read(images, words, pg).collect()}
    assert got == {1: (0.2, True), 2: (0.01, False), 3: (0.0, False)}
    schema = "case_id string, page_id long, text string, x0 double, y0 double, x1 double, y1 double, conf double"
    native = spark.createDataFrame([("c", 1, "nativa", 0.0, 0.0, 10.0, 10.0, 1.0, 0), ("c", 3, "b", 9.0, 9.0, 10.0, 10.0, 1.0, 0), ("c", 3, "a", 0.0, 0.0, 1.0, 1.0, 1.0, 1)], schema + ", ord int")
    read = spark.createDataFrame([("c", 1, "doble", 1.0, 1.0, 9.0, 9.0, 0.9, 0), ("c", 1, "nueva", 30.0, -0.04, 40.0, 9.0, 0.8, 1), ("c", 1, "arriba", 30.0, -20.0, 40.0, -11.0, 0.6, 2), ("c", 3, "b", 9.0, 9.0, 10.0, 10.0, 0.5, 0)], schema + ", ord int")
    ink = spark.createDataFrame([("c", 1, 0.0), ("c", 2, 0.0), ("c", 3, 0.0)], "case_id string, page_id long, unread_ink double")
    merged, conf = lines.merge_readings(native, read, ink)
    assert {(r.page_id, r.text): r.ord for r in merged.collect()} == {(1, "arriba"): 0, (1, "nativa"): 1, (1, "nueva"): 2, (3, "b"): 0, (3, "a"): 1}
    assert {r.page_id: r.conf for r in conf.collect()} == {1: 0.7, 2: 0.0, 3: None}
    readings = spark.createDataFrame([("c", 1, 0, 0, 0.5), ("c", 1, 1, 90, 0.6), ("c", 1, 2, 180, 0.9), ("c", 2, 0, 0, 0.5)], "case_id string, page_id long, pref int, rotation int, conf double")
    assert {r.page_id: r.rotation for r in lines.choose_reading(readings).collect()} == {1: 180, 2: 0}


def test_scalars(spark):
    def one(column):
        return spark.range(1).select(column.alias("x")).first().x

    cases = [("411", 411, ""), ("411vta.", 411, "vta"), ("fs. 411", 411, ""), ("-411-", 411, ""), ("(12 bis)", 12, "bis"), ("0", None, None), ("12345", None, None), ("x1", None, None)]
    for token, number, suffix in cases:
        n, s = tx.page_label(F.lit(token))
        assert (one(n), one(s)) == (number, suffix), token
    dates = [("el 12 de marzo de 2024", "2024-03-12"), ("1/2/24", "2024-02-01"), ("31.12.1999 y 1/1/2000", "1999-12-31"), ("45/1/2000 1/1/2000", None), ("3 de setiembre de 1850, 4-5-71", "1971-05-04"), ("", None)]
    for raw, iso in dates:
        assert one(tx.find_date(F.lit(raw))) == iso, raw
    assert one(tx.sentence_case(F.lit("ACTA DE SECUESTRO DNI N° 12A -"))) == "Acta de secuestro DNI N° 12A"
    assert one(tx.sentence_case(F.lit("Ya Escrito"))) == "Ya Escrito"
    assert one(tx.slug(F.lit("N° 12/2024"), F.lit("Pérez, Ñandú s/ robo"))) == "n-12-2024-perez-nandu-s-robo"
    assert one(tx.name_key(F.lit("PÉREZ, Juan"))) == one(tx.name_key(F.lit("juan perez"))) == "juan perez"
    heads = [("ACTA HOJA 2 DE 3", (True, 2, 3)), ("ACTA HOJA 1 DE 3", (False, 1, 3)), ("SE TRANSCRIBEN A CONTINUACION", (False, None, None)), ("CONTINUA AL DORSO", (True, None, None))]
    for head, want in heads:
        assert tuple(one(headings.continuation(F.lit(head)))) == want, head


def brute_pairs(rows):
    def grams(text):
        w = text.split()
        return set(w) if len(w) < 3 else {" ".join(w[i : i + 3]) for i in range(len(w) - 2)}

    def share(a, b):
        return len(a & b) / len(a | b) if a and b else 0.0

    out = {}
    for i, (pa, ta, da, sa, ga) in enumerate(rows):
        for pb, tb, db, sb, gb in rows[i + 1 :]:
            if ga and gb and abs(ga - gb) > 400:
                continue
            key = da.upper().replace(" ", "") == db.upper().replace(" ", "") != ""
            score = (0.15 if ta == tb else 0.0) + (0.5 * share(grams(da), grams(db)) + 0.35 * share(grams(sa), grams(sb)))
            score = max(score, 0.9) if key else score
            if score >= 0.62:
                out[(min(pa, pb), max(pa, pb))] = round(score, 9)
    return out


def test_blocked_duplicates_equal_all_pairs(spark):
    rng, words = random.Random(9), [f"w{i}" for i in range(14)]
    rows = []
    for i in range(250):
        desc = " ".join(rng.choices(words, k=rng.randrange(0, 7)))
        if rows and rng.random() < 0.4:
            desc = rng.choice(rows)[2]
        rows.append((i, rng.choice("ab"), desc, " ".join(rng.choices(words, k=rng.randrange(0, 12))), rng.choice([0, 1, 350, 401, 700, 1200, 5000])))
    table = spark.createDataFrame([("c", *r) for r in rows], "case_id string, piece_id long, type string, description string, source_text string, page_start long")
    got = {(r.a, r.b): round(r.score, 9) for r in similarity.near_duplicates(table).collect()}
    assert got == brute_pairs(rows) and len(got) > 50
    some = spark.createDataFrame([("c", *p) for p in list(got)[:5]], "case_id string, a long, b long")
    assert similarity.near_duplicates(table, some).count() == len(got) - 5


def test_lineage_with_cycles_and_three_ways(spark):
    edges = spark.createDataFrame([("c", 1, 2), ("c", 2, 3), ("c", 3, 2), ("c", 3, 4), ("d", 1, 4)], "case_id string, parent long, child long")
    pieces = spark.createDataFrame([("c", 1, "excluida", True), ("c", 2, "incluida", False), ("c", 3, "incluida", True), ("c", 4, "incluida", True), ("d", 4, "incluida", True)], "case_id string, piece_id long, state string, active boolean")
    down = lineage.tainted(edges, pieces)
    assert {(r.case_id, r.piece_id) for r in down.collect()} == {("c", 2), ("c", 3), ("c", 4)}
    up = lineage.excluded_ancestry(edges, pieces, pieces.select("case_id", F.col("piece_id").alias("root")))
    assert {(r.case_id, r.root) for r in up.collect()} == {("c", 2), ("c", 3), ("c", 4)}
    straight = edges.where("NOT (parent = 3 AND child = 2)")
    assert {(r.case_id, r.piece_id) for r in lineage.tainted_sql(spark, straight, pieces).collect()} == {("c", 2), ("c", 3), ("c", 4)}
    asked = spark.createDataFrame([("c", 4, "incluida"), ("c", 3, "excluida"), ("c", 2, "incluida"), ("d", 9, "incluida"), ("d", 4, "incluida")], "case_id string, piece_id long, new string")
    found = {(r.case_id, r.piece_id): r.outcome for r in decisions.validate(asked, pieces.withColumn("state", F.when(F.col("piece_id") == 4, "pendiente").otherwise(F.col("state"))), edges).collect()}
    assert found == {("c", 4): "procedencia_excluida", ("c", 3): "aceptada", ("c", 2): "inactiva", ("d", 9): "inexistente", ("d", 4): "aceptada"}


def test_a_lineage_beyond_the_depth_is_told(spark):
    edges = spark.createDataFrame([("c", i, i + 1) for i in range(6)], "case_id string, parent long, child long")
    pieces = spark.createDataFrame([("c", 0, "excluida", True)], "case_id string, piece_id long, state string, active boolean")
    assert lineage.tainted_sql(spark, edges, pieces, 7).count() == lineage.tainted(edges, pieces).count() == 6
    with pytest.raises(Exception, match="levels or more"):
        lineage.tainted_sql(spark, edges, pieces, 3).collect()


def test_undo_of_splits_and_merges(spark):
    edges = spark.createDataFrame([("c", 1, 2, "division"), ("c", 1, 3, "division"), ("c", 4, 6, "union"), ("c", 5, 6, "union"), ("c", 10, 11, "division"), ("c", 10, 12, "division"), ("c", 11, 14, "union"), ("c", 13, 14, "union")], "case_id string, parent long, child long, kind string")
    on = {2, 3, 6, 12, 14}
    pieces = spark.createDataFrame([("c", i, "pendiente", i in on) for i in (*range(1, 7), *range(10, 15))], "case_id string, piece_id long, state string, active boolean")
    roots = pieces.select("case_id", F.col("piece_id").alias("root"))
    got = {r.root for r in decisions.may_undo(edges, pieces, roots).where("allowed").collect()}
    assert got == {2, 3, 6, 14}  # 12 is a half whose sister lives on in 14
    changes = {(r.piece_id, r.active, r.field) for r in decisions.undo(edges, pieces, roots.where("root IN (3, 6, 12)")).collect()}
    assert changes == {(2, False, None), (3, False, None), (1, True, "deshacer_division"), (6, False, "deshacer_union"), (4, True, None), (5, True, None)}


def test_pieces_stand_for_their_pages_by_the_last_switch(spark):
    edges = spark.createDataFrame([("c", 4, 5), ("c", 6, 7)], "case_id string, parent long, child long")
    pieces = spark.createDataFrame([("c", i, i in (3,)) for i in range(1, 8)], "case_id string, piece_id long, active boolean")
    events = [(1, 1, "descarte"), (1, 2, "descarte"), (2, 2, "restauracion"), (3, 2, "deshacer_union"), (1, 5, "descarte"), (1, 4, "union"), (9, 7, "deshacer_division"), (2, 7, "descarte"), (1, 6, "rehacer_deteccion")]
    log = spark.createDataFrame([(s, "c", i, f) for s, i, f in events], "seq long, case_id string, piece_id long, field string")
    assert {r.piece_id for r in lineage.standing(pieces, edges, log).where("stands").collect()} == {1, 3, 4, 5}
    assert {r.piece_id: r.field for r in lineage.last_switch(log).collect()} == {1: "descarte", 2: "deshacer_union", 4: "union", 5: "descarte", 7: "deshacer_division"}
    assert {r.piece_id for r in decisions.may_restore(edges, pieces, log).where("allowed").collect()} == {1, 5}


def test_names_meet_as_all_pairs_do(spark):
    from itertools import combinations

    from sheafwork.operators import persons

    rng, words = random.Random(6), ["ana", "a", "perez", "p", "juan", "j", "maria", "jose", "lopez"]
    rows = [("c", i, " ".join(rng.choices(words, k=rng.randrange(1, 5))), None) for i in range(120)]
    people = spark.createDataFrame(rows, "case_id string, person_id long, name string, document string")

    def score(a, b):
        x, y = set(a.split()), set(b.split())
        short = lambda p, q: {w for w in p - q if len(w) == 1 and any(len(v) > 1 and v.startswith(w) for v in q - p)}
        n = len((x & y) | short(x, y) | short(y, x))
        share = n / len(x | y)
        return 0.0 if n == 0 else max(share, 0.75 + 0.25 * share) if n >= min(len(x), len(y)) and n >= 2 else share

    want = {(p[1], q[1]) for p, q in combinations(rows, 2) if round(score(p[2], q[2]), 3) >= 0.72}
    assert {(r.a, r.b) for r in persons.merge_proposals(people).collect()} == want and len(want) > 100


def test_rows_for_pairs_of_words_are_not_broadcast(spark, sf):
    from sheafwork.operators import persons

    found = persons.merge_proposals(tables.names(spark, sf))
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 100


def test_marks_and_dates_are_found_as_plain_patterns_find_them(spark):
    import re

    rng, bits = random.Random(8), ["HOJA", "PAG.", "CONTINUACION", "CONTINUA", "EN", "VIENE", "DE", "LA", "VUELTA", "FS", "SIGUE", "AL", "DORSO", "(", "/", " ", " ", " ", "2", "10"]
    heads = ["".join(rng.choices(bits, k=rng.randrange(12))) for _ in range(3000)] + ["HOJA 2 DE 5", "SIGUE AL DORSO", "VIENE DE LA VUELTA", "( CONTINUACION"]
    dates = ["7 de mayo de 2023", "x 31/12/99", "1-2-2024 o 3 de ágosto de 2020", "mayo de", "3 de mayo de 1800, 4.5.2001", "٣ de mayo de 2020"]
    table = spark.createDataFrame([(h,) for h in heads + dates], "h string")
    rows = table.select("h", headings.continuation(F.col("h")).alias("c"), tx.find_date(F.col("h")).alias("d")).collect()
    for r in rows[: len(heads)]:
        n = re.search(headings.COUNTER, r.h, re.ASCII)
        assert (r.c.continues, r.c.n) == ((int(n[1]) >= 2, int(n[1])) if n else (bool(re.search("|".join(headings.GOES_ON), r.h, re.ASCII)), None)), r.h
    assert [r.d for r in rows[len(heads) :]] == ["2023-05-07", "1999-12-31", "2020-08-03", None, "2001-05-04", None]


def test_keys_and_numerals_beyond_the_usual(spark):
    row = spark.range(1).select(tx.slug(F.lit("9" * 60), F.lit(None).cast("string")).alias("a"), tx.slug(F.lit("--"), F.lit("")).alias("b"), tx.roman(F.lit(4004)).alias("c"), tx.fold(F.lit("άй Ấ")).alias("d"), tx.slug(F.lit(""), F.lit("x" * 90)).alias("e")).first()
    assert tuple(row) == ("9" * 60, "caso", "MMMMIV", "αи A", "x" * 40)


def test_an_empty_report_is_not_published(spark, sf, tmp_path):
    view = queries.report_view(spark, sf)
    with pytest.raises(report.Empty):
        report.publish(report.assemble(view.withColumn("state", F.lit("pendiente"))), view, spark.createDataFrame([], "case_id string, parent long, child long"), str(tmp_path / "none"))


def test_a_report_is_made_of_included_pieces_without_their_source_texts(spark, sf):
    view, whole = queries.report_view(spark, sf), queries.view(spark, sf)
    assert "source_text" not in view.columns
    keys = lambda rows: sorted((r.case_id, r.piece_id, r.description) for r in rows.collect())
    assert keys(view) == keys(whole.where("state = 'incluida' AND active")) and view.count() < whole.count()


def test_nothing_excluded_is_published(spark, sf, tmp_path):
    view = queries.report_view(spark, sf)
    pieces = decisions.states(tables.raw_pieces(spark, sf), tables.log(spark, sf))
    paragraphs = report.assemble(view, "grupos")
    none = spark.createDataFrame([], "case_id string, parent long, child long")
    assert report.barred(paragraphs, pieces, none).isEmpty()
    report.publish(paragraphs, pieces, none, str(tmp_path / "good"))
    out = pieces.where("state = 'excluida'").first()
    piece = paragraphs.where("kind = 'pieza'").first()
    bad = spark.createDataFrame([(piece.case_id, out.piece_id, piece.piece_id)], "case_id string, parent long, child long")
    flipped = pieces.withColumn("state", F.when((F.col("case_id") == piece.case_id) & (F.col("piece_id") == out.piece_id), "excluida").otherwise(F.col("state")))
    flipped = flipped.unionByName(spark.createDataFrame([flipped.where(F.col("piece_id") == out.piece_id).first()], flipped.schema).withColumn("case_id", F.lit(piece.case_id)))
    with pytest.raises(report.Barred):
        report.publish(paragraphs, flipped, bad, str(tmp_path / "bad"))
    assert not (tmp_path / "bad").exists()
    with pytest.raises(report.Stale):
        report.text_of(paragraphs, paragraphs.select("case_id", F.lit("x").alias("title")).distinct(), queries.staleness(spark, sf))


def test_no_row_crosses_cases(spark, sf):
    for name in ("d1_d3_near_duplicates", "w1_global_numbers", "g2_sections"):
        rows = queries.QUERIES[name](spark, sf)
        assert rows.where("case_id IS NULL").isEmpty()
    pair = similarity.near_duplicates(spark.createDataFrame([("a", 1, "t", "x y z", "x y z", 1), ("b", 2, "t", "x y z", "x y z", 1)], "case_id string, piece_id long, type string, description string, source_text string, page_start long"))
    assert pair.isEmpty()


def test_settle_is_independent_of_partitioning(spark, sf):
    found = numbering.runs(tables.readings(spark, sf))
    a, b = (sorted(map(tuple, numbering.settle(x).collect())) for x in (found, found.repartition(7)))
    assert a == b and isinstance(pd.DataFrame(a), pd.DataFrame)


def test_redo_proposes_only_what_nobody_touched(spark):
    table = pages(spark, ["ACTA uno", "mas", "ACTA dos", "PERICIA"])
    schema = "case_id string, piece_id long, doc_id long, page_start long, page_end long, stands boolean"
    pieces = spark.createDataFrame([("c", 1, 0, 1, 2, True), ("c", 2, 0, 3, 3, True), ("c", 3, 0, 4, 4, True)], schema)
    free = pieces.where("piece_id <> 2").select("case_id", "piece_id")
    events, fresh = segmentation.redo(pieces, table, RULES, free)
    assert {r.piece_id for r in events.collect()} == {1, 3}
    assert sorted((r.page_start, r.page_end) for r in fresh.collect()) == [(1, 2), (4, 4)]


def test_settled_runs_equal_the_greedy_loop(spark):
    rng, rows = random.Random(9), []
    for case in range(25):
        starts = sorted(rng.sample(range(400), rng.randrange(1, 30)))
        rows += [(f"c{case}", rng.choice([*numbering.ZONES, "otra"]), a, a + rng.randrange(0, 40), 0, rng.randrange(4, 9), 0, rng.choice([0.7, 0.8])) for a in starts]
    found = spark.createDataFrame(rows, "case_id string, zone string, from_page long, to_page long, shift long, readings long, interpolated long, confidence double")
    rank, want = {z: i for i, z in enumerate(numbering.ZONES)}, []
    for r in sorted(rows, key=lambda r: (-r[5], -r[7], rank.get(r[1], 9), r[1], r[2])):
        if all(k[0] != r[0] or r[3] < k[2] or r[2] > k[3] for k in want):
            want.append(r)
    assert sorted(map(tuple, numbering.settle(found).collect())) == sorted(want)
    assert numbering.settle(found.limit(0)).isEmpty()


def test_report_lines_are_the_text(spark, tmp_path):
    rows = [("c", 1, "encabezado", "I.-", "UNO", None), ("c", 2, "pieza", "1.-", "a", "b"), ("c", 3, "pieza", None, "z", None), ("d", 1, "pieza", "1.-", None, None), ("e", 1, "pieza", "1.-", "x", None)]
    paragraphs = spark.createDataFrame(rows, "case_id string, ord int, kind string, number string, text string, edited string")
    cases = spark.createDataFrame([("c", "N/1", "Causa C"), ("d", None, "D — "), ("none", "9", "N"), ("e", "7", None)], "case_id string, file_no string, title string")
    lines = report.lines_of(paragraphs, cases)
    texts = {r.case_id: r.text for r in report.text_of(paragraphs, cases).collect()}
    joined: dict = {}
    for r in sorted(lines.collect(), key=lambda r: (r.case_id, r.ord)):
        joined[r.case_id] = joined.get(r.case_id, "") + r.line + "\n"
    assert joined == texts and texts["c"] == "Legajo N/1 — Causa C\nPRUEBA OFRECIDA\n\n\nI.- UNO\n\n1.- b\nz\n" and set(texts) == {"c", "d", "e"}
    assert texts["d"].startswith("Legajo  — D\n") and texts["e"].startswith("Legajo 7\n")
    files.write_lines(lines, str(tmp_path / "out"))
    for case, text in texts.items():
        assert "".join(f.read_text() for f in sorted((tmp_path / "out" / f"case_id={case}").glob("part-*"))) == text


def test_needed_texts_and_many_patterns(spark):
    assert headings.needed(r"^ACTA\b") == ("ACTA",) and headings.needed(r"\b(?:DER|DIE|DAS)\b") == ("ER", "IE", "AS")
    assert headings.needed(r"\bINFORME\s+(?:DE\s+)?PERICIA\b") == ("INFORME",) and headings.needed(r"[A-Z]+\d*") == () and headings.needed("(?i)acta") == () and headings.needed("A|[0-9]") == ()
    assert headings.needed("(?:AB){2,}C?") == ("AB",) and headings.needed("X{0,3}") == ()
    rng = random.Random(1)
    words = ["".join(rng.choices("ABCDEFGH", k=5)) for _ in range(100)]
    rules = [Rule(w.lower(), w, "f", 0.5 + i / 1000, (rf"^{w}\b", rf"\b{w}\s+[A-H]+")) for i, w in enumerate(words)]
    heads = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(9))) + rng.choice(["", "\nACTA", " " * 95 + rng.choice(words) + " A"])) for i in range(300)]
    table = spark.createDataFrame(heads, "id int, head string")
    got = {r.id: tuple(r.f) for r in table.select("id", headings.recognise(F.col("head"), rules).alias("f")).collect()}
    import re

    for i, head in heads:
        best = (0.0, 0, headings.UNKNOWN)
        for order, rule in enumerate(rules):
            at = next((m.start() + 1 for p in rule.patterns if (m := re.search(p, head, re.M))), None)
            if at:
                best = max(best, (rule.weight * (1 if at <= 90 else 0.6), -order, rule.key))
        assert got[i] == (best[2], best[0])


def test_decisions_are_refused_in_order(spark):
    edges = spark.createDataFrame([("c", 1, 2)], "case_id string, parent long, child long")
    pieces = spark.createDataFrame([("c", 1, "excluida", True), ("c", 2, "incluida", True), ("c", 3, "incluida", True), ("c", 4, "pendiente", False)], "case_id string, piece_id long, state string, active boolean")
    asked = [(2, "incluida"), (3, "incluida"), (3, "bogus"), (4, "bogus"), (9, "incluida"), (3, None), (1, "excluida")]
    got = [(r.piece_id, r.new, r.outcome) for r in decisions.validate(spark.createDataFrame([("c", *a) for a in asked], "case_id string, piece_id long, new string"), pieces, edges).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [(2, "incluida", "procedencia_excluida"), (3, "incluida", "sin_cambio"), (3, "bogus", "estado_desconocido"), (4, "bogus", "estado_desconocido"), (9, "incluida", "inexistente"), (3, None, "estado_desconocido"), (1, "excluida", "sin_cambio")]))
    log = spark.createDataFrame([(1, "c", 3, "type_final", "x"), (2, "c", 3, "type_final", " "), (3, "c", 4, "notes", "n"), (4, "c", 3, "type_final", "acta")], "seq long, case_id string, piece_id long, field string, new string")
    assert {r.seq for r in decisions.editable(log, ("acta",), pieces).collect()} == {2, 4}


PIECE = "case_id string, piece_id long, page_start long, page_end long, doc_id long, type string, type_final string, description string, notes string, warnings array<string>, group_id long, date string, confidence double, order_out long, active boolean, state string"


def test_halves_and_merged_pieces_in_full(spark):
    numbers = spark.createDataFrame([("c", p, 400 + p, "") for p in range(1, 20) if p != 5], "case_id string, global_no long, num long, suffix string")
    row = lambda i, a, b, **kw: ("c", i, a, b, kw.get("doc", 7), kw.get("type", "acta"), kw.get("final"), kw.get("d", f"P{i}"), "n", ["w"], 3, kw.get("date"), kw.get("conf", 0.5), i, kw.get("on", True), kw.get("state", "pendiente"))
    pieces = spark.createDataFrame([row(1, 1, 5, final="pericia", date="2024-01-02"), row(2, 6, 6), row(3, 7, None, conf=None), row(4, None, None), row(5, 8, 9, type="otra"), row(6, 10, 12, state="excluida"), row(7, 13, 15, on=False)], PIECE)
    at = spark.createDataFrame([("c", 1, 3), ("c", 2, 6), ("c", 3, 8), ("c", 4, 1), ("c", 5, 9), ("c", 6, 11), ("c", 7, 14)], "case_id string, piece_id long, page long")
    halves, links = decisions.split(pieces, at, numbers)
    got = {(r.parent, r.half): r for r in halves.collect()}
    assert set(got) == {(1, 1), (1, 2), (5, 1), (5, 2)} and links.count() == 4
    r = got[(1, 2)]
    assert (r.page_start, r.page_end, r.description, r.type, r.doc_id, r.warnings, r.number_start, r.number_end, r.state, r.origin, r.date) == (3, 5, "P1 (segunda parte)", "pericia", 7, ["w"], "403", None, "pendiente", "division", "2024-01-02")
    parts = spark.createDataFrame([("c", 1, 2), ("c", 1, 1), ("c", 2, 2), ("c", 2, 4), ("c", 3, 3), ("c", 3, 2), ("c", 4, 5), ("c", 4, 99), ("c", 5, 5)], "case_id string, union_id long, piece_id long")
    merged = {r.union_id: r for r in decisions.union(pieces, parts, numbers).collect()}
    assert set(merged) == {1, 3}  # 2 has a part without pages, 4 one that is not there, 5 is alone
    assert (merged[1].page_start, merged[1].page_end, merged[1].description, merged[1].type, merged[1].warnings, merged[1].number_start, merged[1].number_end) == (1, 6, "P1", "pericia", ["union_de_tipos_distintos"], "401", "406")
    assert (merged[3].page_start, merged[3].page_end, merged[3].warnings, merged[3].confidence) == (6, 7, [], 0.5)


def test_the_view_without_an_end_page(spark):
    from sheafwork.operators import checklist

    pieces = spark.createDataFrame([("c", 1, 2, None), ("c", 2, 2, None), ("c", 3, 9, 3), ("c", 4, 2, 3)], "case_id string, piece_id long, page_start long, page_end long")
    for name, kind in (("active", "boolean"), ("state", "string"), ("origin", "string"), ("confidence", "double"), ("order_out", "long"), ("order_in_group", "long"), ("group_id", "long"), ("type", "string"), ("description", "string"), ("date_detected", "string"), ("source_text", "string")):
        pieces = pieces.withColumn(name, F.lit(None).cast(kind))
    pieces = pieces.withColumn("warnings", F.array().cast("array<string>")).withColumn("active", F.lit(True))
    pages_ = spark.createDataFrame([("c", 2, 402, "", "detectada", "interpolada"), ("c", 3, 403, "", "confirmada", "leida")], "case_id string, global_no long, num long, suffix string, origin string, reading string")
    log = spark.createDataFrame([(1, "c", 1, "number_start_final", "77")], "seq long, case_id string, piece_id long, field string, new string")
    groups = spark.createDataFrame([], "case_id string, group_id long, name string, ord int")
    links = spark.createDataFrame([], "case_id string, piece_id long, person_id long, function string")
    people = spark.createDataFrame([], "case_id string, person_id long, name string")
    out = {r.piece_id: r for r in checklist.effective(pieces, decisions.finals(log), pages_, groups, links, people).collect()}
    say = lambda r: (r.number_start, r.number_end, r.origin_start, r.origin_end, r.firm, r.interpolated)
    assert say(out[1]) == ("77", None, "manual", "manual", True, False)
    assert say(out[2]) == ("402", None, "detectada", "detectada", False, True)
    assert say(out[3]) == (None, "403", "desconocida", "confirmada", False, False)
    assert say(out[4]) == ("402", "403", "detectada", "confirmada", False, True)
    assert {r.piece_id for r in checklist.filtered(checklist.effective(pieces, decisions.finals(log), pages_, groups, links, people), "foja_sin_confirmar").collect()} == {2, 3, 4}


def test_the_strip_shows_the_piece_listed_last(spark):
    from sheafwork.operators import checklist

    rows = [("c", 1, 1, 4, 1, "pendiente"), ("c", 2, 2, 3, 2, "excluida"), ("c", 3, 3, 3, 0, "incluida"), ("c", 4, 6, None, 5, "excluida"), ("c", 5, 6, 9, None, "pendiente")]
    view = spark.createDataFrame(rows, "case_id string, piece_id long, page_start long, page_end long, order_out long, state string").withColumn("active", F.lit(True))
    sheets = spark.range(1, 9).select(F.lit("c").alias("case_id"), F.col("id").alias("global_no"))
    assert {r.mark: r.state for r in checklist.page_strip(view, sheets).collect()} == {0: "pendiente", 1: "excluida", 2: "incluida", 3: "pendiente", 5: "pendiente", 6: "pendiente", 7: "pendiente"}
    assert {r.mark: r.state for r in checklist.page_strip(view, sheets, 4).collect()} == {0: "pendiente", 1: "incluida", 2: "pendiente", 3: "pendiente"}


def test_saving_a_detection(spark):
    offered = spark.createDataFrame([("c", 1, 2), ("c", 3, 3), ("c", 5, 6), ("d", 1, 1)], "case_id string, page_start long, page_end long")
    covered = spark.createDataFrame([("c", 6), ("d", 1)], "case_id string, global_no long")
    pieces = spark.createDataFrame([("c", 8, "automatica", True), ("c", 4, "manual", True), ("d", 1, "automatica", True), ("d", 2, "automatica", False)], "case_id string, order_out long, origin string, active boolean")
    numbers = spark.createDataFrame([("c", 1, 401, ""), ("c", 3, 3, "bis")], "case_id string, global_no long, num long, suffix string")
    made, said = segmentation.save(offered, covered, pieces, numbers)
    assert sorted((r.page_start, r.order_out, r.number_start, r.number_end) for r in made.collect()) == [(1, 9, "401", None), (3, 10, "3 bis", "3 bis")]
    assert {r.case_id: (r.created, r.existing, r.discarded, r.reason) for r in said.collect()} == {"c": (2, 1, 1, None), "d": (0, 1, 1, segmentation.COVERED)}


def test_a_page_that_begins_at_the_limit_gives_its_space(spark):
    rows = [("a", 1, "x" * 9), ("a", 2, "more"), ("b", 1, "x" * 10), ("b", 2, "more"), ("c", 1, None), ("c", 2, "y"), ("c", 3, None), ("c", 4, "z"), ("d", 1, None)]
    got = segmentation.first_text(spark.createDataFrame(rows, "case_id string, global_no long, text string"), ["case_id"], 10)
    assert {r.case_id: r.source_text for r in got.collect()} == {"a": "x" * 9 + " ", "b": "x" * 10, "c": "y z", "d": None}


def test_confidence_is_rounded_by_its_own_value(spark):
    # 0.36 and 0.69 make a number just below 0.5085
    row = spark.range(1).select(segmentation.confidence(F.lit(0.6) * F.lit(0.6), F.lit(0.69), F.lit(1)).alias("a"), segmentation.confidence(F.lit(0.9), F.lit(1.0), F.lit(41)).alias("b")).first()
    assert (row.a, row.b) == (round(0.55 * (0.6 * 0.6) + 0.45 * 0.69, 3), round((0.55 * 0.9 + 0.45) * 0.75, 3)) and row.a == 0.508


def test_words_that_only_differ_in_text_have_one_order(spark):
    words = [("c", 1, 1, t, 5.0, 7.0, 9.0, 12.0, 0.5) for t in ("b", "a", "c")]
    schema = "case_id string, page_id long, ord int, text string, x0 double, y0 double, x1 double, y1 double, conf double"
    ink = spark.createDataFrame([("c", 1, 0.0)], "case_id string, page_id long, unread_ink double")
    for rows in (words, words[::-1]):
        table = spark.createDataFrame(rows, schema).coalesce(1)
        assert [r.text for r in lines.rebuild(table).collect()] == ["a b c"]
        merged = lines.merge_readings(table.limit(0), table, ink)[0]
        assert {r.text: r.ord for r in merged.collect()} == {"a": 0, "b": 1, "c": 2}


def test_fragments_make_up_the_backup(spark):
    cases = spark.createDataFrame([("a", 'N "1"'), ("b", None)], "case_id string, title string")
    one = spark.createDataFrame([("a", 2, 'x,"y"'), ("a", 1, None), ("a", 10, "z"), ("b", 3, "w"), ("z", 4, "no case")], "case_id string, id long, text string")
    two = spark.createDataFrame([("a", ["p", None])], "case_id string, warnings array<string>")
    parts = {"one": one, "two": two, "none": one.limit(0)}
    want = {r.case_id: r.json for r in report.backup(cases, **parts).collect()}
    rows = sorted(report.backup_fragments(cases, **parts).collect(), key=lambda r: (r.case_id, r.part_no, r.place))
    assert {c: "".join(r.text for r in rows if r.case_id == c) for c in ("a", "b")} == want and {r.case_id for r in rows} == set(want)
