import pytest

import corpus_pipeline
from sheafwork.llm import pieces, quality, simhash, toxicity


@pytest.fixture(scope="module")
def steps(spark):
    """The input and the results of all stages over 1,000 documents, as dictionaries by doc_id, and the stages' columns."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, out[-1], folder)
        out.append(spark.createDataFrame(made.collect(), made.schema))
    return out


def test_stages_and_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "simhash near-dedup", "mixing", "sentencepiece"]
    assert all(s.columns == steps[0].columns for s in steps[:-1])


def test_filters_follow_their_scores(spark, steps):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    for n, (module, column) in enumerate(((toxicity, "toxic"), (quality, "quality"))):
        scores = {r.doc_id: r.predicted for r in module.score_documents(steps[n], labels).collect()}
        kept = {r.doc_id for r in steps[n + 1].collect()}
        assert kept == {i for i, p in scores.items() if p == (1 if column == "quality" else 0)}
        truth = {r.doc_id: r[column] for r in labels.collect()}
        good = [i for i in scores if i in truth and truth[i] == (1 if column == "quality" else 0)]
        assert sum(i in kept for i in good) / len(good) > 0.98


def test_one_of_each_group_stays(steps):
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in steps[2].collect()}
    root = dict(zip(prints, prints, strict=True))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if bin(prints[a] ^ prints[b]).count("1") <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in steps[3].collect()) == sorted({find(i) for i in ids})


def test_mix_and_tokens(steps):
    words = sum(len(r.text.split()) for r in steps[3].collect())
    taken = sum(len(r.text.split()) for r in steps[4].collect())
    assert abs(words - taken) <= 20  # a word or less is lost for each source
    lib = pieces.pieces(pieces.model_path()).library
    want = sorted((r.doc_id, len(lib.encode(r.text)) + 2) for r in steps[4].collect())
    assert sorted((r.doc_id, r.n_tokens) for r in steps[5].collect()) == want


def test_run_equals_the_stages(spark, steps):
    got = corpus_pipeline.run(spark, "/root/testdata/sf0.01").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, steps[5].collect()))


def test_empty_and_odd_tables_pass_every_stage(spark, odd):
    for table in (odd, odd.limit(0)):
        docs = table
        for _, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, "/root/testdata/sf0.001")
            docs = spark.createDataFrame(made.collect(), made.schema)
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
