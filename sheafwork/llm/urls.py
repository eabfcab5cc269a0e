"""URL filters: rules by host and path, and gradient-boosted trees on lexical features where no rule speaks.

Everything is a DataFrame expression. Features are small whole numbers, so labelled URLs shrink to the
distinct rows of features with counts before a tree is grown. Each level of a tree takes one histogram of
gradients by node, feature and value; gradients are summed as whole numbers, so the trees do not depend on
the order of rows. The trees become one expression of nested conditions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

ALLOW, BLOCK = "allow", "block"
#: Host and path of a rule, and its verdict. The path begins with a slash.
RULES = [("com/", ALLOW), ("example.com/en/", BLOCK), ("www.example.com/en/", ALLOW), ("net/es/", BLOCK), ("net/fr/", BLOCK)]
#: A list of rules is part of the plan, so it has a bound.
MOST_RULES = 10_000
TREES, DEPTH, RATE, RIDGE, LEAST_WEIGHT = 10, 3, 0.4, 1.0, 5.0
THRESHOLD = 0.5
#: Suffixes with statistics of their own, of each kind, those with most labelled URLs first; others have the share of all.
SUFFIXES, PRIOR = 1000, 20
#: Features have values from 0 to this.
TOP = 31
#: Gradients are summed in units of 2**-20.
UNIT = 1 << 20

SUFFIX_KINDS = ("top", "domain", "ending")
FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digits", "host_digits", "hyphens", "entropy", "path_entropy", "parameters", "query_length", "fragment", "slash") + tuple(f"{k}_share" for k in SUFFIX_KINDS) + tuple(f"{k}_count" for k in SUFFIX_KINDS)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path; both empty where the URL is null or has no `://`."""
    pattern = r"^(?s:.*?)://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return F.translate(part(1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), part(2)


def matched(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct (length, rule, verdict), or null. Of rules given twice the last counts; of rules of one length that with the longer host."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    by_host: dict[str, list[Column]] = {}
    for rule, verdict in dict(rules).items():
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name, []).append(F.struct(F.lit(len(rule)).alias("length"), F.lit(len(name)).alias("host"), F.lit(rule).alias("rule"), F.lit(slash + rest).alias("path"), F.lit(verdict).alias("verdict")))
    if not by_host:
        return F.lit(None).cast("struct<length:int,host:int,rule:string,path:string,verdict:string>")
    table = F.create_map(*[c for name, found in by_host.items() for c in (F.lit(name), F.array(*found))])
    labels = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    found = F.flatten(F.filter(F.transform(suffixes, lambda s: F.try_element_at(table, s)), lambda x: x.isNotNull()))
    return F.array_max(F.filter(found, lambda r: F.startswith(path, r["path"])))


def _steps(n: Column) -> Column:
    """A count in steps that widen: twice its logarithm."""
    return F.least(F.lit(TOP), F.floor(2 * F.log2(n + 1))).cast("int")


def _entropy(text: Column) -> Column:
    """Bits a character, in quarters."""
    n = F.length(text)
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    bits = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda total, c: total - F.when(share(c) > 0, share(c) * F.log2(share(c))).otherwise(0.0))
    return F.when(n == 0, 0).otherwise(F.least(F.lit(TOP), F.floor(4 * F.round(bits, 6)))).cast("int")


def lexical(rows: DataFrame) -> DataFrame:
    """Rows (url, host, path) with their features but the suffixes' statistics, and the suffixes as `_top`, `_domain` and `_ending`."""
    url = F.coalesce("url", F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    many = lambda text, signs: F.length(text) - F.length(F.translate(text, signs, ""))
    ratio = lambda text: F.when(F.length(text) == 0, 0).otherwise(F.floor(TOP * many(text, "0123456789") / F.length(text))).cast("int")
    labels = F.split(host, r"\.")
    return rows.withColumns({
        "length": _steps(F.length(url)), "host_length": _steps(F.length(host)), "path_length": _steps(F.length(path)),
        "depth": F.least(F.lit(TOP), F.regexp_count(path, F.lit("[^/]+"))).cast("int"), "labels": F.least(F.lit(TOP), F.when(F.length(host) == 0, 0).otherwise(F.size(labels))).cast("int"),
        "digits": ratio(url), "host_digits": ratio(host), "hyphens": F.least(F.lit(TOP), many(url, "-_")).cast("int"), "entropy": _entropy(host), "path_entropy": _entropy(path),
        "parameters": F.when(F.length(query) == 0, 0).otherwise(F.least(F.lit(TOP), many(query, "&") + 1)).cast("int"), "query_length": _steps(F.length(query)),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "slash": F.endswith(path, F.lit("/")).cast("int"),
        "_top": F.element_at(labels, -1), "_domain": F.array_join(F.slice(labels, F.greatest(F.lit(1), F.size(labels) - 1), 2), "."), "_ending": F.regexp_extract(path, r"\.([A-Za-z0-9]{1,8})$", 1),
    })


@dataclass
class Tree:
    """Nodes by number: a split (feature, largest value that goes left) or a leaf's value. The children of node i are 2i+1 and 2i+2."""

    splits: dict[int, tuple[str, int]] = field(default_factory=dict)
    leaves: dict[int, float] = field(default_factory=dict)

    def node(self) -> Column:
        """The number of the node, so far, that a row falls into."""
        walk = lambda i: F.when(F.col(self.splits[i][0]) <= self.splits[i][1], walk(2 * i + 1)).otherwise(walk(2 * i + 2)) if i in self.splits else F.lit(i)
        return walk(0)

    def value(self) -> Column:
        walk = lambda i: F.when(F.col(self.splits[i][0]) <= self.splits[i][1], walk(2 * i + 1)).otherwise(walk(2 * i + 2)) if i in self.splits else F.lit(self.leaves.get(i, 0.0))
        return walk(0)


@dataclass
class Model:
    """Trees over features, and the suffixes' statistics (kind, suffix, share, count): at most `SUFFIXES` of each kind."""

    base: float
    trees: list[Tree]
    suffixes: DataFrame | None
    usual: int = 0

    def margin(self) -> Column:
        out = F.lit(self.base)
        for tree in self.trees:
            out = out + tree.value()
        return out

    def features(self, rows: DataFrame) -> DataFrame:
        return with_suffixes(lexical(rows), self.suffixes, self.usual)

    def scored(self, rows: DataFrame) -> DataFrame:
        """Rows (url, host, path, and others) with `score`, the probability that a URL is to be blocked."""
        return self.features(rows).withColumn("score", 1 / (1 + F.exp(-self.margin()))).drop(*FEATURES, *[f"_{k}" for k in SUFFIX_KINDS])


def with_suffixes(rows: DataFrame, suffixes: DataFrame | None, usual: int) -> DataFrame:
    for kind in SUFFIX_KINDS:
        if suffixes is None:
            rows = rows.withColumns({f"{kind}_share": F.lit(usual), f"{kind}_count": F.lit(0)})
            continue
        own = suffixes.where(F.col("kind") == kind).select(F.col("suffix").alias(f"_{kind}"), F.col("share").alias(f"{kind}_share"), F.col("count").alias(f"{kind}_count"))
        rows = rows.join(F.broadcast(own), f"_{kind}", "left").fillna({f"{kind}_share": usual, f"{kind}_count": 0})
    return rows


def suffix_statistics(rows: DataFrame, share: float) -> DataFrame:
    """How often the commonest suffixes of labelled rows are to be blocked, smoothed towards the share of all, and how often they are there."""
    each = rows.select("blocked", F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(f"_{k}").alias("suffix")) for k in SUFFIX_KINDS])))
    counted = each.groupBy("kind", "suffix").agg(F.count("*").alias("n"), F.sum("blocked").alias("b"))
    out = None
    for k in SUFFIX_KINDS:
        # the top of each kind is taken from every task's top
        best = counted.where(F.col("kind") == k).orderBy(F.desc("n"), "suffix").limit(SUFFIXES)
        out = best if out is None else out.unionByName(best)
    return cut(out.select("kind", "suffix", F.floor(TOP * (F.col("b") + PRIOR * share) / (F.col("n") + PRIOR)).cast("int").alias("share"), _steps(F.col("n")).alias("count")))


def _best(histogram: list, nodes: dict[int, tuple[int, int]]) -> dict[int, tuple]:
    """For each node the split of largest gain: (feature, value, sums left, sums right). The split lies midway between two values that occur; ties go to the first feature and the lowest value."""
    out: dict[int, tuple] = {}
    gain: dict[int, float] = {}
    score = lambda g, h: (g / UNIT) ** 2 / (h / UNIT + RIDGE)
    by: dict[tuple[int, int], list] = {}
    for r in histogram:
        by.setdefault((r.node, r.feature), []).append((r.value, r.g, r.h))
    for (node, feature), values in sorted(by.items()):
        g_all, h_all = nodes[node]
        values, g, h = sorted(values), 0, 0
        for (value, dg, dh), after in zip(values, values[1:], strict=False):
            g, h = g + dg, h + dh
            if min(h, h_all - h) < LEAST_WEIGHT * UNIT / 4:
                continue
            found = score(g, h) + score(g_all - g, h_all - h) - score(g_all, h_all)
            if found > gain.get(node, 1e-9):
                gain[node], out[node] = found, (FEATURES[feature], (value + after[0]) // 2, (g, h), (g_all - g, h_all - h))
    return out


def train(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH) -> Model:
    """A model from labelled rows (url, host, path, blocked 0 or 1), all of them. Without rows of both classes it has no trees and gives the share of 1, or 0 without rows."""
    rows = lexical(labelled.withColumn("blocked", F.col("blocked").cast("long")))
    n, b = rows.agg(F.count("*"), F.sum("blocked")).first()
    share = (b or 0) / n if n else 0.0
    if not n or share in (0.0, 1.0):
        return Model(50.0 if share else -50.0, [], None, int(TOP * share))
    usual = int(TOP * share)
    suffixes = suffix_statistics(rows, share)
    full = with_suffixes(rows, suffixes, usual)
    table = cut(full.groupBy(*FEATURES).agg(F.count("*").alias("n"), F.sum("blocked").alias("b")))
    model = Model(math.log(share / (1 - share)), [], suffixes, usual)
    values = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(c).alias("value")) for i, c in enumerate(FEATURES)])
    for _ in range(trees):
        tree = Tree()
        p = 1 / (1 + F.exp(-model.margin()))
        graded = table.select(*FEATURES, F.round((F.col("n") * p - F.col("b")) * UNIT).cast("long").alias("g"), F.round(F.col("n") * p * (1 - p) * UNIT).cast("long").alias("h"))
        nodes: dict[int, tuple[int, int]] = {0: (0, 0)}
        for level in range(depth):
            asked = graded.withColumn("node", tree.node()).where(F.col("node").isin(*nodes))
            histogram = asked.select("node", "g", "h", F.inline(values)).groupBy("node", "feature", "value").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            if not level:
                nodes[0] = tuple(sum(r[c] for r in histogram if r.feature == 0) for c in ("g", "h"))
            grown = _best(histogram, nodes)
            for i, (g, h) in nodes.items():
                tree.leaves[i] = -RATE * (g / UNIT) / (h / UNIT + RIDGE)
            nodes = {}
            for i, (feature, value, left, right) in grown.items():
                tree.splits[i] = (feature, value)
                nodes |= {2 * i + 1: left, 2 * i + 2: right}
            if not nodes:
                break
        for i, (g, h) in nodes.items():
            tree.leaves[i] = -RATE * (g / UNIT) / (h / UNIT + RIDGE)
        if not tree.splits:
            break
        model.trees.append(tree)
    return model


def ruled(rows: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """Rows (url, and others) with host, path, and the rule that fits with its verdict, null where none does."""
    host, path = split_url(F.col("url"))
    parts = rows.withColumns({"host": host, "path": path})
    return parts.withColumn("_rule", matched(F.col("host"), F.col("path"), rules)).withColumns({"rule": F.col("_rule.rule"), "verdict": F.col("_rule.verdict")}).drop("_rule")


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, model: Model | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Every row of pages (page_id, url): page_id, host, path, rule, verdict and the model's score.

    The verdict is the rule's where one fits, else `block` if the score reaches the threshold. Without a
    model one is trained on all URLs that rules decide, with these verdicts as labels.

    A null url has an empty host and path and is judged like an empty one. Very long URLs are read whole.
    Repeated rows are judged each, and alike; a null page_id is kept. Ties of rules: see `matched`. Other
    columns, whatever their names, are not looked at. No rows give no rows.
    """
    rows = ruled(pages.select("page_id", "url"), rules)
    if model is None:
        model = train(rows.where("rule IS NOT NULL").select("url", "host", "path", (F.col("verdict") == BLOCK).cast("int").alias("blocked")))
    scored = model.scored(rows)
    verdict = F.coalesce("verdict", F.when(F.col("score") >= threshold, BLOCK).otherwise(ALLOW))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
