"""Plans that many operators share, against plain restatements."""

import random

import pytest
from pyspark.sql import functions as F

from sheafwork.operators import lineage, numbering, similarity
from sheafwork.plans import graph, order, ranges


def test_ranges_hold_their_points(spark):
    rng = random.Random(2)
    spans = [(rng.choice("ab"), i, a := rng.randrange(300), a + rng.choice([0, 1, 2, 5, 40, 200])) for i in range(150)] + [("a", 900, 7, 6), ("a", 901, None, 5), ("a", 902, 5, None)]
    points = [(c, p) for c in "ab" for p in range(0, 420, 3)]
    table = spark.createDataFrame(spans, "case_id string, piece long, lo long, hi long")
    asked = spark.createDataFrame(points, "case_id string, page long")
    want = {(c, p, i) for c, p in points for k, i, a, b in spans if k == c and a is not None and b is not None and a <= p <= b}
    got = ranges.inside(table, asked, ["case_id"], "lo", "hi", "page").select("case_id", "page", "piece").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    semi = {tuple(r) for r in ranges.inside(table, asked, ["case_id"], "lo", "hi", "page", "left_semi").collect()}
    assert semi == {w[:2] for w in want}
    anti = {(r.case_id, r.page) for r in ranges.inside(table, asked, ["case_id"], "lo", "hi", "page", "left_anti").collect()}
    assert anti == set(points) - semi
    assert ranges.inside(table.limit(0), asked, ["case_id"], "lo", "hi", "page").isEmpty()
    assert ranges.inside(table.limit(0), asked, ["case_id"], "lo", "hi", "page", "left_anti").count() == len(points)


@pytest.mark.parametrize(("lo", "hi"), [(0, 0), (1, 1_000_000), (7, 1_048_583), (2**35, 2**35 + 12345), (0, 2**20 - 1)])
def test_a_long_range_takes_few_blocks(spark, lo, hi):
    rows = spark.range(1).select(F.explode(ranges.blocks(F.lit(lo).cast("long"), F.lit(hi).cast("long"))).alias("b")).select("b.*").collect()
    spans = sorted((r.block << r.level, (r.block + 1) << r.level) for r in rows)
    assert spans[0][0] == lo and spans[-1][1] == hi + 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:], strict=False))
    assert len(rows) <= 42


def test_places_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.9 else rng.choice("xyz"), i, rng.choice([None, *range(20)])) for i in range(700)]
    table = spark.createDataFrame(rows, "case_id string, id long, v long")
    got = {(r.case_id, r.id): r.position for r in order.placed(table, ["case_id"], [F.col("v").desc_nulls_last(), F.col("id").asc()]).collect()}
    want = {}
    for c in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == c), key=lambda r: (r[2] is None, -(r[2] or 0), r[1]))
        want |= {(c, r[1]): n + 1 for n, r in enumerate(mine)}
    assert got == want
    first = order.top(table, ["case_id"], [F.col("v").asc_nulls_last(), F.col("id")], 3, 2).collect()
    assert {r.place for r in first} <= {3, 4, 5} and len([r for r in first if r.case_id == "hot"]) == 3


def test_a_chain_of_5000_levels(spark):
    n = 5000
    edges = spark.range(n).select(F.lit("c").alias("case_id"), F.col("id").alias("parent"), (F.col("id") + 1).alias("child"))
    top = spark.createDataFrame([("c", 0)], "case_id string, root long")
    assert lineage.descendants(edges, top).count() == n
    pieces = spark.createDataFrame([("c", n // 2, "excluida")], "case_id string, piece_id long, state string")
    assert lineage.tainted(edges, pieces).count() == n - n // 2


def test_closure_of_random_graphs(spark):
    rng = random.Random(8)
    links = {("c", rng.randrange(40), rng.randrange(40)) for _ in range(55)}
    edges = spark.createDataFrame(list(links), "case_id string, a long, b long")
    roots = spark.createDataFrame([("c", i) for i in range(40)], "case_id string, root long")

    def below(node):
        seen, todo = set(), [node]
        while todo:
            at = todo.pop()
            for _, a, b in links:
                if a == at and b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    want = {(r, x) for r in range(40) for x in below(r) if x != r}
    assert {(r.root, r.node) for r in graph.closure(edges, roots).collect()} == want
    marks = set(range(0, 40, 3))
    marked = spark.createDataFrame([("c", i) for i in marks], "case_id string, node long")
    few = {(r.node, r.found) for r in graph.few_reached(edges, marked, 3).collect()}
    assert few == {(i, x) for i in range(40) for x in sorted((below(i) - {i}) & marks)[:3]}
    some = spark.createDataFrame([("c", 3), ("c", 11)], "case_id string, node long")
    assert {r.node for r in graph.reached(edges, some).collect()} == below(3) | below(11)


def test_breaks_of_a_series_over_partitions(spark):
    rng = random.Random(5)
    pages, n = [], 100
    for p in range(1, 400):
        n += rng.choice([0, 1, 1, 1, 1, 1, 1, 2, -1]) if rng.random() < 0.2 else 1
        if rng.random() < 0.8:
            pages.append(("c", p, n))
    pieces = [("c", i, a, rng.choice([None, a, a + 1, a + 4]), o) for i in range(200) for a in [rng.randrange(1, 390)] for o in [rng.choice(["manual", "detectada"])]]

    def bad(a, b):
        mine = [(p, n) for _, p, n in pages if a <= p <= b]
        return any(y - x < 0 or y - x > q - p for (p, x), (q, y) in zip(mine, mine[1:], strict=False))

    table = spark.createDataFrame(pieces, "case_id string, piece_id long, page_start long, page_end long, origin_start string").withColumn("origin_end", F.col("origin_start"))
    got = {r.piece_id: r.discontinuous for r in numbering.discontinuous(table, spark.createDataFrame(pages, "case_id string, global_no long, num long")).collect()}
    assert got == {i: o != "manual" and b is not None and b > a and bad(a, b) for _, i, a, b, o in pieces}
    assert any(got.values())


def test_typed_and_confirmed_numbers(spark):
    pages = [("c", p, 400 + p if p % 4 else None, "", "detectada" if p % 4 else "desconocida", "leida", 0.8) for p in range(1, 13)]
    table = spark.createDataFrame(pages, "case_id string, global_no long, num long, suffix string, origin string, reading string, conf double")
    events = [(1, 2, 2, "fijar", "55 bis"), (2, 2, 2, "fijar", "abc"), (3, 3, 3, "fijar", "7"), (4, 3, 3, "fijar", " "), (5, 1, 9, "confirmar", None), (6, 8, 8, "fijar", "12"), (7, 5, 5, "fijar", "x")]
    log = spark.createDataFrame([(s, "c", a, b, k, x) for s, a, b, k, x in events], "seq long, case_id string, from_page long, to_page long, kind string, label string")
    got = {r.global_no: (r.origin, r.num, r.suffix, r.conf) for r in numbering.typed_numbers(table, log).collect()}
    assert got[2] == ("manual", 55, "bis", 1.0) and got[3] == ("desconocida", None, "", None) and got[8] == ("manual", 12, "", 1.0)
    assert got[1] == ("confirmada", 401, "", 1.0) and got[4] == ("desconocida", None, "", 0.8) and got[5] == ("confirmada", 405, "", 1.0) and got[10] == ("detectada", 410, "", 0.8)
    assert {r.seq for r in numbering.refused_numbers(log).collect()} == {2, 7}


def test_undo_by_witnesses_equals_undo_by_pairs(spark, monkeypatch):
    from sheafwork.operators import decisions

    rng = random.Random(12)
    rows = {("c", rng.randrange(60), rng.randrange(60, 120), rng.choice(["union", "division"])) for _ in range(70)} | {("c", rng.randrange(60, 120), rng.randrange(120, 150), rng.choice(["union", "division"])) for _ in range(40)}
    edges = spark.createDataFrame(list({r[:3]: r for r in rows}.values()), "case_id string, parent long, child long, kind string")
    pieces = spark.createDataFrame([("c", i, rng.random() < 0.6) for i in range(150)], "case_id string, piece_id long, active boolean")
    roots = pieces.select("case_id", F.col("piece_id").alias("root"))
    want = {tuple(r) for r in decisions.may_undo(edges, pieces, roots).collect()}
    for n in (1, 2, 50):
        monkeypatch.setattr(decisions, "WITNESSES", n)
        assert {tuple(r) for r in decisions.may_undo(edges, pieces, roots).collect()} == want
    assert 0 < sum(r[2] for r in want) < 100


def test_totals_of_ranges_make_no_pairs(spark):
    rng = random.Random(5)
    spans = [(rng.choice("ab"), i, a := rng.randrange(300), a + rng.choice([0, 1, 5, 40, 900])) for i in range(120)] + [("a", 900, 7, 6), ("a", 901, None, 5), ("a", 902, 5000, 6000)]
    points = [(c, p) for c in "ab" for p in range(0, 1500, 3)] + [("a", 3)]
    table = spark.createDataFrame(spans, "case_id string, piece long, lo long, hi long")
    asked = spark.createDataFrame(points, "case_id string, page long")
    got = {r.piece: (r.n, r.total) for r in ranges.totals(table, asked, ["case_id"], "lo", "hi", "page").collect()}
    held = {i: [p for k, p in points if k == c and a is not None and a <= p <= b] for c, i, a, b in spans}
    assert got == {i: (len(ps), sum(ps)) for i, ps in held.items() if ps}
    assert ranges.totals(table.limit(0), asked, ["case_id"], "lo", "hi", "page").isEmpty()
    # a join of many long ranges with the points of all holds a few rows for a range
    many = spark.range(2000).select(F.lit("c").alias("case_id"), F.col("id").alias("piece"), F.col("id").alias("lo"), (F.col("id") + 2000).alias("hi"))
    dealt = ranges.spread(many, "lo", "hi").count()
    assert dealt < 2000 * 22 and ranges.totals(many, spark.range(5000).select(F.lit("c").alias("case_id"), F.col("id").alias("page")), ["case_id"], "lo", "hi", "page").where("n = 2001").count() == 2000


def test_excluded_ancestry_holds_no_other_ancestors(spark, monkeypatch):
    def held(*_):
        raise AssertionError("all ancestors are held")

    monkeypatch.setattr(lineage, "ancestors", held)
    edges = spark.createDataFrame([("c", 1, 2), ("c", 2, 3), ("c", 3, 4), ("c", 9, 3), ("d", 1, 2)], "case_id string, parent long, child long")
    pieces = spark.createDataFrame([("c", 1, "excluida"), ("c", 9, "excluida"), ("c", 2, "incluida"), ("d", 2, "excluida")], "case_id string, piece_id long, state string")
    roots = spark.createDataFrame([("c", 2), ("c", 4), ("d", 2)], "case_id string, root long")
    got = {tuple(r) for r in lineage.excluded_ancestry(edges, pieces, roots).collect()}
    assert got == {("c", 2, 1), ("c", 4, 1), ("c", 4, 9)}


@pytest.mark.parametrize("turned", [False, True])
@pytest.mark.parametrize("cycle", [False, True])
def test_closure_of_forests_compares_no_pairs(spark, monkeypatch, turned, cycle):
    rng = random.Random(8)
    up = {("a", n): n - 1 for n in range(1, 150)} | {("b", n): rng.randrange(max(0, n - 4), n) for n in range(1, 120)}
    if cycle:
        up["c", 0], up["c", 1], up["c", 2], up["c", 3] = 1, 2, 0, 1
    want = set()
    for case, n in up:
        seen, at = set(), n
        while (case, at) in up and up[case, at] not in seen:
            at = up[case, at]
            seen.add(at)
        want |= {(case, n, a) for a in seen - {n}}
    if turned:
        want = {(c, a, n) for c, n, a in want}
    edges = [(c, p, n) if turned else (c, n, p) for (c, n), p in up.items()] + [("a", 5, None), ("b", None, 7)]
    nodes = sorted({(c, x) for c, *two in edges for x in two if x is not None})
    ends = [x for x in nodes if x[1] % 3]
    rows, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: (out := cut(df), rows.append(out.count()))[0])
    table = lambda x, names: spark.createDataFrame(x, f"case_id string, {names}")
    roots = table(nodes, "root long")
    got = graph.closure(table(edges, "a long, b long"), roots).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert cycle or sum(rows) < len(want) / 2
    got = graph.closure(table(edges, "a long, b long"), roots.where("root % 4 <> 1"), table(ends, "node long")).collect()
    some = {w for w in want if w[1] % 4 != 1 and w[2] % 3}
    assert len(got) == len(some) and {tuple(r) for r in got} == some


def test_texts_of_hopeless_pairs_are_not_compared(spark, monkeypatch):
    rows = [("c", i, "x" if i % 2 else "y", f"one two three four w{i} v{i} u{i}" if i < 6 else "one two three four same", "a b c d" if i % 3 else "e f g h", i) for i in range(12)]
    pieces = spark.createDataFrame(rows, "case_id string, piece_id long, type string, description string, source_text string, page_start int")
    want, plain, seen = similarity.near_duplicates(pieces).collect(), similarity.jaccard, []

    def counted(a, b):
        seen.append(spark.sparkContext.accumulator(0))
        n = seen[-1]
        return F.udf(lambda x: (n.add(1), x)[1], "double").asNondeterministic()(plain(a, b))

    monkeypatch.setattr(similarity, "jaccard", counted)
    assert sorted(similarity.near_duplicates(pieces).collect()) == sorted(want) and len(want) > 14
    assert 0 < seen[1].value < seen[0].value
