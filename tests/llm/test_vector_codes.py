import hashlib
import math
import random

import numpy as np
import pytest

from sheafwork.llm import vector_codes
from sheafwork.llm.common import read_table

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, _label string, _n string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, "c", "e", "l", "n") for i, v, label in rows], SCHEMA)


def brute(rows, parts, entries, rounds):
    kept = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    first = {}
    for i, v, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, v), v)
    width = len(kept[0][1]) // parts
    cutup = lambda v: [v[p * width : (p + 1) * width] for p in range(parts)]
    books = [[cutup(first[i])[p] for i in sorted(first)[:entries]] for p in range(parts)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))
    for _ in range(rounds):
        new = [list(b) for b in books]
        for p in range(parts):
            by = {}
            for _, v, _ in kept:
                by.setdefault(near(p, cutup(v)[p])[1], []).append(cutup(v)[p])
            for k, xs in by.items():
                new[p][k] = [sum(c) // len(xs) for c in zip(*xs, strict=True)]
        books = new
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out = []
    for i, v, label in kept:
        found = [near(p, x) for p, x in enumerate(cutup(v))]
        out.append((i, "".join(f"{k:02x}" for _, k in found), sum(d for d, _ in found), label))
    by_label = {}
    for *_, e, label in out:
        by_label[label] = by_label.get(label, 0) + e
    return sorted(map(str, ((i, c, e, by_label[label], sha) for i, c, e, label in out)))


def got(df, **kw):
    return sorted(map(str, ((r.vec_id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in vector_codes.compress(df, **kw).collect())))


@pytest.fixture
def rows():
    rng = random.Random(3)
    vector = lambda: [float(np.float32(rng.choice([rng.gauss(0, 0.3), 0.5, -0.25]))) for _ in range(8)]
    out = [(i, vector(), rng.choice([None, 1, 2, 3])) for i in range(150)]
    same = vector()
    out += [(200 + i, same, 1) for i in range(60)] + [(5, vector(), 2), (5, same, None), (None, vector(), 3), (None, same, None)]
    out += [(-1, None, 1), (-2, [float("nan")] + [0.0] * 7, 1), (-3, [float("inf")] + [0.0] * 7, 1), (-4, [None] + [0.0] * 7, 1), (-5, [-float("inf")] * 8, None)]
    return out


def test_against_brute_force(spark, rows):
    df = table(spark, rows)
    for kw in ({"parts": 4, "entries": 8, "rounds": 2}, {"parts": 2, "entries": 64, "rounds": 1}, {"parts": 8, "entries": 3, "rounds": 3}, {"parts": 4, "entries": 500, "rounds": 0}):
        if kw["entries"] == 500:
            kw["entries"] = 200
        assert got(df, **kw) == brute(rows, **kw)


def test_memo_bound_and_hot_labels_do_not_matter(spark, rows, monkeypatch):
    df, want = table(spark, rows), brute(rows, 4, 8, 2)
    monkeypatch.setattr(vector_codes, "HOT", 3)
    assert got(df.repartition(6), parts=4, entries=8) == want
    cells = vector_codes.Cells(np.array([[0, 0], [100, 40], [-70, 9], [100, 40]]))
    monkeypatch.setattr(vector_codes, "MEMO", 5)
    monkeypatch.setattr(vector_codes, "HELD", 16)
    points = np.random.default_rng(0).integers(-200, 200, (500, 2))
    best, far = cells.nearest(points)
    every = ((points[:, None, :] - cells.entries) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()


def test_cells_keep_every_nearest_entry(spark, sf):
    vectors = np.array([r.embedding for r in read_table(spark, sf, "embeddings").collect()])
    points = np.floor(vectors * 256).astype(np.int64)[:, :4]
    cells = vector_codes.Cells(points[:64].copy())
    best, far = cells.nearest(points)
    every = ((points[:, None, :] - cells.entries) ** 2).sum(axis=2)
    assert (best == every.argmin(axis=1)).all() and (far == every.min(axis=1)).all()
    kept = sum(len(v) for v in cells.memo.values()) / len(cells.memo)
    assert kept < 40  # of 64


def test_decoding_and_empty(spark, rows):
    df = vector_codes.kept_vectors(table(spark, rows))
    books = vector_codes.train(df, 4, 8)
    r = vector_codes.decode(vector_codes.encode(df, books), books).where("vec_id = 7").first()
    flat = [c / 256 for p in range(4) for c in books[p][int(r.code[2 * p : 2 * p + 2], 16)]]
    assert r.approximation == flat
    assert got(table(spark, [])) == [] and got(table(spark, [(1, None, None)])) == []
    with pytest.raises(ValueError):
        vector_codes.compress(table(spark, [(1, [1.0] * 7, None)]), parts=4).collect()
