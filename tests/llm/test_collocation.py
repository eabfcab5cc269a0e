import random
import re
from collections import Counter

import numpy as np
import pytest

from sheafwork.llm import collocation
from sheafwork.llm.common import read_table


def brute(rows, least, longest=5, subsumed=100, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    key = (lang, tuple(words[i : i + k]))
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        inside = lambda q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))  # noqa: B023, E731
        if any(x == lang and len(q) > len(p) and 100 * b >= subsumed * a and inside(q) for (x, q), b in candidates.items()):
            continue
        score, _, l, r = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), l, r))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, found in out.items() for i, (s, a, p, l, r) in enumerate(sorted(found)[:top]))


def got(table, **kw):
    return sorted((r.lang, r.rank, r.phrase, r.a, r.l, r.r, r.n, r.score) for r in collocation.collocations(table, **kw).collect())


@pytest.fixture
def random_texts():
    rng = random.Random(5)
    words = ["a", "B", "c", "ab", "Été", "x y", "longer-than-eight-bytes", "longer-than-eight-byteZ", "日本", "d"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "; "]) for _ in range(rng.randrange(120)))
    return [(i, text(), rng.choice(["en", "fr", None, "und"]), "s") for i in range(60)]


def test_against_brute_force(docs, random_texts, odd, monkeypatch):
    monkeypatch.setattr(collocation, "ROW", 2)
    table = docs(random_texts)
    rows = [(lang, text) for _, text, lang, _ in random_texts]
    for kw in ({"least": 3}, {"least": 8, "longest": 3}, {"least": 3, "subsumed": 60, "top": 7}):
        assert got(table, **kw) == brute(rows, kw["least"], kw.get("longest", 5), kw.get("subsumed", 100), kw.get("top", 2000))
    assert got(odd, least=2) == brute([(r.lang, r.text) for r in odd.collect()], 2)


def test_chunks_do_not_matter(spark, docs, random_texts):
    hot = docs(random_texts + [(100 + i, "a b c a b c a b " * 30, "en", "s") for i in range(20)])
    want = got(hot, least=20)
    assert want == got(hot.repartition(5), least=20) and want


def test_long_texts_are_cut_where_pieces_end():
    import pyarrow as pa

    old, collocation.CHUNK = collocation.CHUNK, 50
    try:
        text = ("one two three four. " * 40 + "w " * 100).encode()
        batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], names=["lang", "text"])
        parts = [t for _, t in collocation._chunks(iter([batch]))]
        assert b"".join(parts) == text and len(parts) > 10 and all(p.rstrip().endswith(b".") for p in parts[:-1])
    finally:
        collocation.CHUNK = old


def test_equal_hashes_are_told_apart():
    one, two = np.array([1, 1, 2, 1], dtype=np.uint64), np.array([7, 8, 7, 7], dtype=np.uint64)
    first, number = collocation._distinct(one, two)
    assert len(first) == 3 and number[0] == number[3] and len(set(number.tolist())) == 3


def test_filter_lets_all_frequent_phrases_pass(spark):
    hashes = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 5000)
    bits = collocation.filter_bits(spark.createDataFrame([(int(h),) for h in hashes], "hash long"))
    assert collocation.passes(bits, hashes.view(np.uint64)).all()
    others = np.random.default_rng(2).integers(-(2**63), 2**63 - 1, 5000).view(np.uint64)
    assert collocation.passes(bits, others).mean() < 0.1
    assert collocation.filter_bits(spark.createDataFrame([], "hash long")) is None


def test_empty_and_rare(docs, odd, spark, sf):
    assert got(docs([])) == [] and got(docs([(1, "", "en", "s"), (2, None, None, None)])) == []
    assert got(odd, least=10**6) == []
    assert got(read_table(spark, sf, "documents"), least=40) == brute([(r.lang, r.text) for r in read_table(spark, sf, "documents").collect()], 40)
