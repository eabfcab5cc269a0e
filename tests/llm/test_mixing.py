import re

from pyspark.sql import functions as F

from sheafwork.llm import mixing
from sheafwork.llm.common import read_table


def water(sizes, weights=(1, 2, 3)):
    """Targets by resharing what exceeds a cap until none does."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        rest = total - sum(fixed.values())
        share = {s: rest * w[s] / sum(w[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: 3 * sizes[s] for s in over}


def test_targets_and_cuts(spark, sf, docs, odd):
    tail = docs([(100 + i, "w " * 400, "en", "tiny" if i == 0 else "s9") for i in range(6)])
    for table in (read_table(spark, sf, "documents"), odd.union(tail)):
        rows = mixing.mix(table).collect()
        texts = table.collect()
        assert len(rows) == len(texts)
        sizes = {}
        for r in texts:
            sizes[r.source] = sizes.get(r.source, 0) + len(re.findall(r"[^\x20\x09-\x0d]+", r.text or ""))
        want, taken = water(sizes), {}
        for r in rows:
            assert r.source_size == sizes[r.source] and abs(r.target - want[r.source]) < 1e-6 * (1 + r.target)
            assert 0 <= r.taken <= 3 * r.size
            taken[r.source] = taken.get(r.source, 0) + r.taken
        for s, n in taken.items():
            assert abs(n - want[s]) <= 1 + 1e-6 * n


def test_reruns_agree_and_ranges_do_not_matter(spark, sf):
    table = read_table(spark, sf, "documents")
    a, b = (sorted((r.doc_id, r.taken) for r in mixing.mix(t, ranges=n).collect()) for t, n in ((table, 1024), (table.repartition(7), 4)))
    assert a == b


def test_mixed_documents_hold_the_words_taken(docs):
    table = docs([(i, " ".join(f"w{j}" for j in range(i % 7)) + "\n", "en", "ab"[i % 5 == 0]) for i in range(60)])
    out = mixing.mixed_documents(table)
    assert out.columns == table.columns
    got = {}
    for r in out.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
        assert r.n_chars == len(r.text)
    assert got == {r.doc_id: r.taken for r in mixing.mix(table).collect() if r.taken}


def test_empty_table(docs):
    assert mixing.mix(docs([])).collect() == [] and mixing.mixed_documents(docs([])).collect() == []


def test_rows_without_id_spread_over_ranges(spark, docs):
    table = docs([(None if i % 3 else 7, f"text {i} of some", "en", "s") for i in range(3000)])
    key = F.md5(F.concat(F.lit(mixing.SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "text").cast("binary"))
    most = table.groupBy(F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * 1024 / 16**8)).count().agg(F.max("count")).first()[0]
    assert most < 20
    rows = mixing.mix(table).collect()
    assert len(rows) == 3000 and sum(r.taken for r in rows) == 3000 * 4
    two = table.union(docs([(i, "w " * 40, "en", "t") for i in range(50)]))
    a, b = (sorted((str(r.doc_id), r.size, r.taken) for r in mixing.mix(t, ranges=n).collect()) for t, n in ((two, 1024), (two.repartition(9), 16)))
    assert a == b and sum(r[2] for r in a) <= 3000 * 4 + 2000


def test_a_large_plan_is_shuffled(docs, monkeypatch):
    table = docs([(i, "w " * (i % 9), "en", f"s{i % 5}") for i in range(200)])
    want = sorted((r.doc_id, r.taken) for r in mixing.mix(table).collect())
    monkeypatch.setattr(mixing, "PLAN_ROWS", 1)
    assert want == sorted((r.doc_id, r.taken) for r in mixing.mix(table).collect())
