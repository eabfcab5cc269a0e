import math
import re
from types import SimpleNamespace

from sheafwork.llm import urls
from sheafwork.llm.common import read_table

SCHEMA = "page_id long, url string, html string, host string, score string, _top string, length string, n string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", "h", "s", "t", "l", "n") for i, u in rows], SCHEMA)


def plain_rule(url, rules):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1], m[2]) if m else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, verdict in rules:
        name, _, rest = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(rule) > len(best[0])):
            best = (rule, verdict)
    return host, path, *(best or (None, None))


ODD = [
    (1, None), (2, ""), (3, "no scheme.com/"), (4, "http://com"), (5, "http://COM/"), (6, "HTTP://WWW.Example.COM/en/1?x=://a.net/es/"), (7, "http://example.com/EN/"), (8, "http://notexample.com/en/"),
    (9, "http://a.net/es/" + "x" * 50_000), (10, "http://net/fr/"), (11, "://.net/fr/"), (12, "http://İ.com/é#f"), (None, "http://b.net/es/1"), (6, "http://b.net/es/1"), (6, "http://b.net/es/1"), (13, "http://ü:80/en\n/x?a=1&b=2#c"),
]


def test_rules_against_a_plain_loop(spark, sf):
    for table in (pages(spark, ODD), read_table(spark, sf, "pages")):
        want = sorted(map(str, ((r.page_id, *plain_rule(r.url, urls.RULES)) for r in table.collect())))
        out = urls.judge(table).collect()
        ruled = [(r.page_id, r.host, r.path, r.rule, r.verdict if r.rule else None) for r in out]
        assert sorted(map(str, ruled)) == want
        assert all(0 <= r.score <= 1 and r.verdict in ("allow", "block") and (r.rule or (r.verdict == "block") == (r.score >= 0.5)) for r in out)


def test_clashing_rules_and_bounds(spark):
    rules = [("a.com/", "block"), ("a.com/", "allow"), ("com/xxxx", "block"), ("b.a.com/", "block")]
    rows = pages(spark, [(1, "http://a.com/xxxx"), (2, "http://b.a.com/"), (3, "http://c.com/xxx")])
    got = {r.page_id: (r.rule, r.verdict) for r in urls.ruled(rows, rules).collect()}
    assert got == {1: ("com/xxxx", "block"), 2: ("b.a.com/", "block"), 3: (None, None)}
    assert [r.rule for r in urls.ruled(rows, []).collect()] == [None] * 3


def test_entropy_and_counts(spark):
    rows = pages(spark, [(1, "http://ab12.x-y.com/p/q.html?a=1&b=2#z"), (2, None)])
    out = {r.page_id: r for r in urls.lexical(urls.ruled(rows)).collect()}
    bits = -sum(c / 12 * math.log2(c / 12) for c in [1] * 10 + [2])  # a b 1 2 x - y c o m once, two dots
    r = out[1]
    assert r.entropy == int(4 * bits)
    assert (r.depth, r.labels, r.parameters, r.fragment, r._top, r._domain, r._ending) == (2, 3, 2, 1, "com", "x-y.com", "html")
    assert out[2].length == 0 and out[2].entropy == 0 and out[2].labels == 0


def labelled(spark, n=600):
    # spam: many digits and parameters; else short words
    rows = [(f"http://h{i % 7}.{('info', 'org')[i % 5 > 0]}/" + (f"{i * 7919}-{i}?a={i}&b=2&c=3" if i % 3 == 0 else f"page/{'abc'[i % 3]}"), int(i % 3 == 0)) for i in range(n)]
    return urls.ruled(spark.createDataFrame(rows, "url string, blocked int"), []).select("url", "host", "path", "blocked")


def grow(rows, trees, depth):
    """The same boosting in plain Python, over (features, n, b)."""
    total, blocked = sum(n for _, n, _ in rows), sum(b for *_, b in rows)
    base = math.log(blocked / (total - blocked))
    margins, out = [base] * len(rows), []
    for _ in range(trees):
        p = [1 / (1 + math.exp(-m)) for m in margins]
        grads = [(round((n * q - b) * urls.UNIT), round(n * q * (1 - q) * urls.UNIT)) for (_, n, b), q in zip(rows, p, strict=True)]
        node, values, splits = [0] * len(rows), {}, {}
        for level in range(depth + 1):
            nodes = {}
            for at, (g, h) in zip(node, grads, strict=True):
                if at >= 2**level - 1:
                    a = nodes.get(at, (0, 0))
                    nodes[at] = (a[0] + g, a[1] + h)
            for i, (g, h) in nodes.items():
                values[i] = -urls.RATE * (g / urls.UNIT) / (h / urls.UNIT + urls.RIDGE)
            if level == depth:
                break
            histogram = {}
            for at, (f, *_), (g, h) in zip(node, rows, grads, strict=True):
                if at in nodes:
                    for k, v in enumerate(f):
                        a = histogram.get((at, k, v), (0, 0))
                        histogram[at, k, v] = (a[0] + g, a[1] + h)
            best = urls._best([SimpleNamespace(node=a, feature=k, value=v, g=g, h=h) for (a, k, v), (g, h) in histogram.items()], nodes)
            splits |= {i: (urls.FEATURES.index(b[0]), b[1]) for i, b in best.items()}
            node = [2 * a + (1 if f[splits[a][0]] <= splits[a][1] else 2) if a in best else a for a, (f, *_) in zip(node, rows, strict=True)]
        margins = [m + values[a] for m, a in zip(margins, node, strict=True)]
        out.append((splits, values))
    return margins


def test_trees_against_plain_python(spark):
    rows = labelled(spark)
    model = urls.train(rows, trees=3, depth=3)
    got = model.features(rows).withColumn("margin", model.margin()).collect()
    counted = {}
    for r in got:
        f = tuple(r[c] for c in urls.FEATURES)
        n, b, _ = counted.get(f, (0, 0, 0))
        counted[f] = (n + 1, b + r.blocked, r.margin)
    want = grow([(f, n, b) for f, (n, b, _) in counted.items()], 3, 3)
    assert len(model.trees) == 3
    assert all(abs(m - w) < 1e-9 for (_, _, m), w in zip(counted.values(), want, strict=True))


def test_held_out_accuracy_and_reruns(spark):
    rows = labelled(spark)
    half = rows.where("crc32(url) % 2 = 0")
    model = urls.train(half)
    scored = model.scored(rows.where("crc32(url) % 2 = 1")).collect()
    assert sum((r.score >= 0.5) == (r.blocked == 1) for r in scored) / len(scored) > 0.97
    again = urls.train(half.repartition(7))
    assert [(t.splits, t.leaves) for t in again.trees] == [(t.splits, t.leaves) for t in model.trees]


def test_one_class_and_empty(spark):
    one = urls.train(labelled(spark).where("blocked = 1"))
    assert one.trees == [] and [r.score > 0.99 for r in one.scored(urls.ruled(pages(spark, [(1, None)]))).collect()] == [True]
    assert urls.judge(pages(spark, [])).collect() == []
    assert [r.verdict for r in urls.judge(pages(spark, [(1, None), (2, "http://x.com/")])).orderBy("page_id").collect()] == ["allow", "allow"]
