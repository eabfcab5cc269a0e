import random

from pyspark.sql import functions as F

from sheafwork.llm import simhash
from sheafwork.llm.common import read_table


def brute(prints):
    """Smallest id of each component over all pairs of fingerprints."""
    ids, distinct = {}, {}
    for i, p in prints:
        distinct.setdefault(p, []).append(i)
    keys = list(distinct)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if bin(a ^ b).count("1") <= 2:
                root[find(a)] = find(b)
    for k in keys:
        ids.setdefault(find(k), []).extend(i for i in distinct[k] if i is not None)
    return {(i, k): min(ids[find(k)], default=None) for k in keys for i in distinct[k]}


def test_fingerprint_is_spark_xxhash64(spark):
    row = spark.sql("SELECT xxhash64('one two') AS h").first()
    assert simhash.fingerprint("ONE\ttwo") == row.h % 2**64
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_blocks_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(1000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text) == whole


def test_query_equals_brute_force(spark, sf):
    got = simhash.query(spark, sf).collect()
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    prints = [(i, simhash.fingerprint(t)) for i, t in texts.items()]
    want = brute(prints)
    assert {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in got} == want
    assert len(got) == len(texts)


def test_links_equal_brute_force_on_dense_and_chained_prints(spark, monkeypatch):
    rng = random.Random(5)
    prints = {0, 1 << 63, 2**64 - 1}
    for _ in range(12):
        at = rng.getrandbits(64)
        for _ in range(25):
            at ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(at)
        prints |= {at ^ (1 << i) ^ (1 << j) for i, j in ((rng.randrange(64), rng.randrange(64)) for _ in range(15))}
    rows = list(enumerate(sorted(prints)))
    signed = [(p - 2**64 if p >= 2**63 else p,) for _, p in rows]
    from sheafwork.llm.components import components

    got = components(simhash.grid_links(spark.createDataFrame(signed, "print long"))).collect()
    group = {r.node % 2**64: r.component % 2**64 for r in got}
    want = brute(rows)
    mine, theirs = {}, {}
    for i, p in rows:
        mine.setdefault(group.get(p, p), set()).add(i)
        theirs.setdefault(want[(i, p)], set()).add(i)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_crowded_points_give_the_same_groups(spark):
    rng = random.Random(11)
    prints, at = set(), rng.getrandbits(64)
    for _ in range(150):
        prints.add(at ^ sum(1 << rng.randrange(12) for _ in range(3)))
    prints |= {rng.getrandbits(64) for _ in range(50)}
    from sheafwork.llm.components import components

    rows = list(enumerate(sorted(prints)))
    want = brute(rows)
    table = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for _, p in rows], "print long")
    for dense in (0, 2, 10_000):
        links = simhash.grid_links(table, dense)
        assert all(bin((r.a ^ r.b) % 2**64).count("1") <= 2 for r in links.collect())
        group = {r.node % 2**64: r.component % 2**64 for r in components(links).collect()}
        mine, theirs = {}, {}
        for i, p in rows:
            mine.setdefault(group.get(p, p), set()).add(i)
            theirs.setdefault(want[(i, p)], set()).add(i)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_manhattan_distance_on_the_grid_is_a_lower_bound(spark):
    rng = random.Random(2)
    pairs = [(rng.getrandbits(64) - 2**63, rng.getrandbits(64) - 2**63) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a long, b long").select("a", "b", simhash.segment_counts(F.col("a")).alias("x"), simhash.segment_counts(F.col("b")).alias("y")).collect()
    for r in rows:
        counts = [[(v >> 2 * j) & 3 for j in range(32)] for v in (r.x, r.y)]
        assert counts == [[bin((v >> 2 * j) & 3).count("1") for j in range(32)] for v in (r.a, r.b)]
        assert sum(abs(p - q) for p, q in zip(*counts, strict=True)) <= bin((r.a ^ r.b) % 2**64).count("1")


def test_odd_rows(spark, odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    by = {(r.doc_id, r.fingerprint): r.component_id for r in got}
    assert by[(2, "0" * 16)] == 2 and by[(3, "0" * 16)] == 2 and by[(None, "0" * 16)] == 2
    assert {r.component_id for r in got if r.doc_id in (1, 6)} == {1}
    assert simhash.near_duplicates(odd.limit(0)).collect() == []


def test_one_of_each_keeps_columns_and_one_row(odd):
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert ids.count(1) == 1 and 6 not in ids and 3 not in ids and 2 in ids
    assert ids.count(None) == 1  # "no id here" has a group of its own


def test_one_of_each_goes_by_groups_and_not_by_ids(spark, odd, docs):
    kept = [(r.doc_id, r.text) for r in simhash.one_of_each(odd).collect()]
    assert (None, "no id here") in kept and (None, None) not in kept and (2, None) in kept
    a, b, c = ("the first text of all", "quite another matter here", "and a third one that has words")
    table = docs([(None, a, "en", "s"), (None, a, "en", "s"), (None, b, "en", "s"), (7, b, "en", "s"), (4, c, "en", "s"), (4, "unlike the other text of four", "en", "s"), (9, c, "en", "s")])
    want = [(None, a), (4, c), (4, "unlike the other text of four"), (7, b)]
    assert sorted(((r.doc_id, r.text) for r in simhash.one_of_each(table).collect()), key=str) == sorted(want, key=str)
