import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sheafwork.llm import pieces
from sheafwork.llm.common import read_table

HARD = ["", " ", "  a  b ", "a\tb\nc\r\n", "é日本\U0001d4b3\x00x", "▁a ▁", "é", "<s>hi</s><unk>", "ﬁ Ａ\xa0b", "​", "\n", "\n\n x", "a" * 5000, "the " * 3000, "▁" * 50, "   " * 40 + "x"]


def test_against_the_library():
    p = pieces.pieces(pieces.model_path())
    rng = random.Random(1)
    alphabet = "etaoin shrdlu▁\n  é日\U0001f600\x7f0123.,-_<>ABC"
    texts = HARD + ["".join(rng.choice(alphabet) for _ in range(rng.randrange(120))) for _ in range(2000)]
    for t in texts:
        ids = p.library.encode(t, add_bos=True, add_eos=True)
        assert np.frombuffer(p.encode(t), "<u4").tolist() == ids, t
        assert p.decode(p.encode(t)) == p.library.decode(ids), t


def test_whole_text_merging_equals_segments():
    p = pieces.pieces(pieces.model_path())
    for t in HARD[:13]:
        marked = pieces.SPACE + t.replace(" ", pieces.SPACE)
        assert p.ids_of(marked) == [i for s in p.segments.findall(marked) for i in p.ids_of(s)]


def test_many_at_a_time_equals_one_by_one():
    p = pieces.pieces(pieces.model_path())
    rng = random.Random(3)
    words = sorted({"▁" + "".join(rng.choice("etaoinshrdlçê日\x00") for _ in range(rng.randrange(31))) for _ in range(3000)}, key=len)
    assert p.lone and [np.frombuffer(x, "<u4").tolist() for x in p.merge_many(words)] == [p.ids_of(w) for w in words]


def test_a_difference_from_the_library_is_told():
    p = pieces.Pieces(pieces.model_path(), checked=True)
    assert [same for _, same in p.encode_all(HARD)] == [True] * len(HARD)
    p.check(["▁the", "▁a"], [b"\1\0\0\0", np.array(p.ids_of("▁a"), "<u4").tobytes()])
    assert [same for _, same in p.encode_all(["of the", "a"])] == [False, True]


def test_all_documents_in_batches(spark, sf):
    table = read_table(spark, sf, "documents")
    assert table.select(pieces.compared()("text").alias("c")).where("NOT c.same_ids OR NOT c.same_text").count() == 0
    lib = pieces.pieces(pieces.model_path()).library
    texts = {r.doc_id: r.text for r in table.collect()}
    for r in pieces.query(spark, sf).collect():
        ids = lib.encode(texts[r.doc_id], add_bos=True, add_eos=True)
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.same_ids
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()


def test_odd_rows(odd, docs):
    assert pieces.encode_documents(odd).count() == odd.count()
    assert odd.select(pieces.compared()("text").alias("c")).where(F.col("c.same_ids") & F.col("c.same_text")).count() == odd.count()
    assert {r.n_tokens for r in pieces.encode_documents(odd).where("doc_id IN (2, 3)").collect()} == {2}
    assert pieces.encode_documents(docs([])).collect() == []
    assert pieces.token_ids(docs([(1, "", "en", "s")])).first().ids == [1, 2]
