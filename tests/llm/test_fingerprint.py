import hashlib
import re
from collections import Counter

from sheafwork.llm import fingerprint
from sheafwork.llm.common import read_table


def expected(rows):
    """(doc_id, text, edited text, next text) by brute force over rows in descending id, nulls last."""
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for i, (doc_id, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 3
        out.append((doc_id, text, text[: len(text) - k] + after[:k], after))
    return out


def jaccard(a, b):
    x, y = (Counter(re.findall(r"[^\x20\x09-\x0d]+", t)) for t in (a, b))
    top = sum((x | y).values())
    return sum((x & y).values()) / top if top else 1.0


def test_query_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in read_table(spark, sf, "documents").collect()]
    got = {r.doc_id: r for r in fingerprint.query(spark, sf).collect()}
    assert len(got) == len(rows)
    errors, signs = [], {}
    for doc_id, text, edited, after in expected(rows):
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        errors += [(r.near_edited, jaccard(text, edited)), (r.near_next, jaccard(text, after))]
        assert signs.setdefault(text, r.fingerprint) == r.fingerprint
        if edited in signs:
            assert signs[edited] == r.edited_fingerprint
    off = [a - b for a, b in errors]
    assert abs(sum(off) / len(off)) < 0.02  # unbiased
    spread = sum(x * x for x in off) / sum(b * (1 - b) / fingerprint.SAMPLES for _, b in errors)
    assert 0.8 < spread < 1.2  # with the variance of independent samples


def test_odd_rows(spark, docs, odd):
    out = fingerprint.fingerprints(odd).collect()
    assert len(out) == odd.count()
    assert len({r.fingerprint for r in out if r.doc_id in (1, 6)}) == 1
    empty = [r for r in out if r.doc_id in (2, 3, 4)]
    assert {r.fingerprint for r in empty} == {"ffffff" * fingerprint.SAMPLES}
    alone = fingerprint.fingerprints(docs([(5, "a b c d e f", "en", "s")])).collect()[0]
    assert alone.near_next == 1.0 and alone.n_chars == 11
    assert fingerprint.fingerprints(docs([])).collect() == []


def test_order_without_gaps_over_many_parts(spark, docs):
    ids = [7, -3, 12, 900, 15, 16, None, 44]
    got = {r.doc_id: r._next.doc_id for r in fingerprint.with_next(docs([(i, str(i), "en", "s") for i in ids]), parts=5).collect()}
    order = sorted(ids, key=lambda i: (i is None, -(i or 0)))
    assert got == {i: order[(n + 1) % len(order)] for n, i in enumerate(order)}
