import numpy as np

from sheafwork.llm import quality


def test_statistics_do_not_depend_on_blocks(monkeypatch):
    text = "Some words here. ANOTHER!! 12\nline | with signs $$ " * 200
    whole = quality.statistics(text)
    monkeypatch.setattr(quality, "BLOCK", 17)
    assert np.allclose(whole, quality.statistics(text)) and len(whole) == len(quality.STATISTICS)
    assert all(np.isfinite(quality.statistics(t)).all() for t in (None, "", " ", "x", "\x00", "!" * 50))


def test_scores_equal_the_normal_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(k, 1 + k, (400 + 300 * k, 4)) @ rng.normal(0, 1, (4, 4)) for k in (0, 1)]
    counts, sums = np.array([len(a) for a in x], float), np.stack([a.sum(axis=0) for a in x])
    model = quality.fit(counts, sums, np.stack([a.T @ a for a in x]), to_pooled=0.0, to_identity=0.0)
    at = np.concatenate([a[:50] for a in x])
    log = []
    for a, n in zip(x, counts, strict=True):
        m, c = a.mean(axis=0), np.cov(a.T, bias=True)
        d = at - m
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(c), d) - 0.5 * np.linalg.slogdet(c)[1] + np.log(n))
    assert np.allclose(model.scores(at), 1 / (1 + np.exp(log[0] - log[1])), atol=1e-6)


def test_held_out_accuracy_and_rerun(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.score_documents(docs, labels).collect()
    assert len(rows) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    again = {r.doc_id: r.score for r in quality.score_documents(docs.repartition(5), labels).collect()}
    assert all(abs(again[r.doc_id] - r.score) < 1e-6 for r in rows)


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark, sf):
    from pyspark.sql import functions as F

    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    blank = docs.withColumns({"lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    a, b = ({r.doc_id: r.score for r in quality.score_documents(d, x).collect()} for d, x in ((docs, labels), (blank, flipped)))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_query_equals_a_plain_rewrite(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet").collect() for t in ("documents", "labels"))
    from zlib import crc32

    held = {r.doc_id: crc32(str(r.doc_id).encode()) % 5 == 0 for r in docs}
    x = {r.doc_id: np.array(quality.statistics(r.text)) for r in docs}
    y = {r.doc_id: r.quality for r in labels if r.doc_id in x and not held[r.doc_id]}
    rows = np.array([x[i] for i in y])
    mean, spread = rows.mean(axis=0), rows.std(axis=0)
    spread = np.where(spread > 1e-6, spread, 1.0)
    groups = [(np.array([x[i] for i in y if y[i] == k]) - mean) / spread for k in (0, 1)]
    own = [np.cov(g.T, bias=True) for g in groups]
    pooled = sum(c * len(g) for c, g in zip(own, groups, strict=True)) / len(rows)
    shrunk = [(1 - quality.TO_POOLED) * c + quality.TO_POOLED * pooled for c in own]
    shrunk = [(1 - quality.TO_IDENTITY) * c + quality.TO_IDENTITY * np.trace(c) / len(c) * np.eye(len(c)) for c in shrunk]
    for r in quality.query(spark, sf).collect():
        z = (x[r.doc_id] - mean) / spread
        log = [np.log(len(g)) - 0.5 * (z - g.mean(axis=0)) @ np.linalg.solve(c, z - g.mean(axis=0)) - 0.5 * np.linalg.slogdet(c)[1] for g, c in zip(groups, shrunk, strict=True)]
        want = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        assert abs(r.score - want) < 1e-6 and r.predicted == int(r.score >= 0.3) and r.held_out == held[r.doc_id]


def test_odd_rows(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (5, 0, None), (5, None, 1), (None, 1, 1), (6, 1, 1), (9, 0, 0), (77, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.score_documents(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    assert {r.score for r in quality.score_documents(odd, labels.limit(0)).collect()} == {0.5}
    kept = quality.accepted(odd, labels)
    assert kept.columns == odd.columns and set(map(str, kept.collect())) <= set(map(str, odd.collect()))
    assert quality.score_documents(odd.limit(0), labels).collect() == []
