import numpy as np

from sheafwork.llm import toxicity


def test_noisy_or_by_hand():
    model = toxicity.Model({"vile": 4.0, "vil*": 9.0, "nast*": 2.0}, -3.0)
    text = "A vile, vile day. Fine here!\nNasty nasty thing"
    p = [1 / (1 + np.exp(-z)) for z in (-3 + 4.0, -3.0, -3 + 2.0)]
    assert abs(model.document(text) - (1 - np.prod([1 - x for x in p]))) < 1e-12
    assert model.document(None) == model.document("") == model.document("... !!") == 0.0


def test_training_finds_the_words_and_their_sentences(spark):
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(60)]
    rows, marks = [], []
    for i in range(400):
        lines = [" ".join(rng.choice(words, 6)) + "." for _ in range(int(rng.integers(1, 9)))]
        bad = int(i % 3 == 0)
        if bad:
            at = int(rng.integers(len(lines)))
            lines[at] = lines[at].replace(" ", " grumblefish ", 1)
        rows.append((i, " ".join(lines)))
        marks.append((i, 1, bad))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")
    got = toxicity.score_documents(docs, labels).collect()
    assert all(r.predicted == marks[r.doc_id][2] for r in got) and any(r.held_out for r in got)
    found = toxicity.offending_sentences(docs, toxicity.train(docs, labels)).collect()
    assert {r.doc_id for r in found} == {i for i, _, t in marks if t}
    assert all("grumblefish" in r.sentence and rows[r.doc_id][1][r.start : r.stop] == r.sentence for r in found)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = toxicity.score_documents(docs, labels).collect()
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert len(rows) == docs.count() and sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.93
    clean = [r for r in held if truth[r.doc_id] == 0]
    assert sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (None, 1, 1), (6, 1, 1), (6, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.score for r in rows if r.doc_id in (2, 3, 4)} == {0.0}
    assert toxicity.clean(odd, labels.limit(0)).count() == odd.count()
    assert toxicity.score_documents(odd.limit(0), labels).collect() == []


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    other = labels.withColumns({"toxic": F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")), "quality": F.lit(0)})
    blank = docs.withColumns({"lang": F.lit("x"), "source": F.lit(None).cast("string"), "n_chars": F.lit(1)})
    a, b = ({r.doc_id: r.score for r in toxicity.score_documents(d, x).collect()} for d, x in ((docs, labels), (blank, other)))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_query_equals_a_plain_rewrite_of_the_score(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.train(docs, labels)
    order = list(model.weights)
    got = {r.doc_id: r for r in toxicity.query(spark, sf).collect()}
    import re

    for r in docs.collect():
        clean = 1.0
        for s in re.split(r"(?<=[.!?])(?![.!?])|\n", r.text or ""):
            words = set(re.findall(r"\w+", s.lower()))
            if words:
                known = [[f for f in [w, *(w[:k] + "*" for k in range(4, 9) if len(w) > k)] if f in model.weights] for w in words]
                clean *= 1 - 1 / (1 + np.exp(-model.bias - sum(model.weights[min(f, key=order.index)] for f in known if f)))
        assert abs(got[r.doc_id].score - (1 - clean)) < 1e-6 and got[r.doc_id].predicted == int(got[r.doc_id].score >= 0.5)


def test_clean_returns_the_callers_columns(odd):
    labels = odd.sparkSession.createDataFrame([], "doc_id long, quality int, toxic int")
    assert sorted(map(str, toxicity.clean(odd, labels).collect())) == sorted(map(str, odd.collect()))


def test_a_repeated_id_is_one_training_row(docs, spark):
    ids = [i for i in range(40)]
    table = docs([(i, f"text {i}", "en", "s") for i in ids] + [(i, f"again {n}", "en", "s") for i in ids for n in range(5)])
    labels = spark.createDataFrame([(i, 1, i % 2) for i in ids], "doc_id long, quality int, toxic int")
    known = toxicity.training_rows(table.where("text LIKE 'text%'"), labels).count()
    assert 20 < known < 40 and toxicity.training_rows(table, labels).count() == known
    assert toxicity.training_rows(table, labels, sample=7).count() == 7


def test_few_toxic_labels_still_reject(spark):
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    rows = [r for r in toxicity.score_documents(docs, labels).collect() if r.doc_id in truth]
    assert sum(r.predicted for r in rows if truth[r.doc_id] == 1) >= 5
    assert sum(r.predicted for r in rows if truth[r.doc_id] == 0) <= 1
