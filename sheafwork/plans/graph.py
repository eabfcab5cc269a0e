"""Iterative plans over edge tables: closures and connected groups."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_ROUNDS = 200
#: Steps whose ends a node holds in a row of its own; a power of two.
STRIDE = 16


def shared(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where none is set and the master is local."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not named and sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sheafwork-"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder."""
    shared(df.sparkSession)
    return df.checkpoint(eager=True)


def _links(edges: DataFrame) -> DataFrame:
    return cut(edges.select("case_id", F.col("a").alias("node"), F.col("b").alias("_next")).distinct())


def _single(links: DataFrame, column: str) -> bool:
    """Whether no two links of a case have the same value in a column."""
    return links.groupBy("case_id", column).agg(F.count("*").alias("_n")).where("_n > 1").isEmpty()


def _climbed(links: DataFrame, starts: DataFrame, wanted: DataFrame | None) -> DataFrame | None:
    """(case_id, start, node): all that links (case_id, node, _next) lead to from the starts (case_id, start), of `wanted` (case_id, node) where it is given. None if the links have a cycle.

    For links that leave each node once at most. Every node holds what lies within `STRIDE` steps in one row, and
    a start meets only every `STRIDE`th node on its way; so pairs are first made where they are given out, without
    comparing them. Distances double, so 10,000 links in a row take four rounds and ten.
    """
    if wanted is None:
        own = links.withColumn("_held", F.array("_next"))
    else:
        marks = wanted.select("case_id", F.col("node").alias("_next"), F.lit(True).alias("_w")).distinct()
        own = links.join(marks, ["case_id", "_next"], "left").withColumn("_held", F.filter(F.array(F.when(F.col("_w"), F.col("_next"))), lambda x: x.isNotNull()))
    up, steps = own.select("case_id", "node", F.col("_next").alias("_last"), F.lit(1).alias("_n"), "_held"), 1
    while steps < STRIDE:
        more = up.select("case_id", F.col("node").alias("_last"), F.col("_last").alias("_far"), F.col("_n").alias("_m"), F.col("_held").alias("_on"))
        up = cut(up.join(more, ["case_id", "_last"], "left").select(
            "case_id", "node", F.coalesce("_far", "_last").alias("_last"), (F.col("_n") + F.coalesce("_m", F.lit(0))).alias("_n"), F.when(F.col("_on").isNull(), F.col("_held")).otherwise(F.concat("_held", "_on")).alias("_held"),
        ))
        steps *= 2
    levels, total = [cut(up.where(F.col("_n") == steps).select("case_id", "node", F.col("_last").alias("_next")))], links.count()
    while not levels[-1].isEmpty():
        if steps > total:
            return None
        onward = levels[-1].select("case_id", F.col("node").alias("_next"), F.col("_next").alias("_far"))
        levels.append(cut(levels[-1].join(onward, ["case_id", "_next"]).select("case_id", "node", F.col("_far").alias("_next"))))
        steps *= 2
    known = starts.select("case_id", "start").distinct().withColumn("node", F.col("start"))
    for jumps in levels[:-1]:
        known = cut(known)
        known = known.unionByName(known.join(jumps, ["case_id", "node"]).select("case_id", "start", F.col("_next").alias("node")))
    return known.join(up.select("case_id", "node", "_held"), ["case_id", "node"]).select("case_id", "start", F.explode("_held").alias("node"))


def _doubled(links: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """All rows (keys, node) that links (case_id, node, _next) lead to from `seen`, which holds what lies within a step.

    In round k `seen` holds what lies within 2**k steps, and paths of just 2**k steps lead on from it, so a
    chain of 10,000 links takes 14 rounds. A round that finds nothing new is the last, so cycles end.
    """
    parts, jumps = [seen], links
    # links that leave each node once, or reach each once, join to paths of which none comes twice
    lone = _single(links, "node") or _single(links, "_next")
    while True:
        if jumps.isEmpty():
            known = parts[0]
            for one in parts[1:]:
                known = known.unionByName(one)
            return known
        known = parts[0]
        for one in parts[1:]:
            known = known.unionByName(one)
        reached = known.join(jumps, ["case_id", "node"]).select(*keys, F.col("_next").alias("node")).distinct()
        fresh = cut(reached.join(known, [*keys, "node"], "left_anti"))
        if fresh.isEmpty():
            return known
        parts.append(fresh)
        onward = jumps.select("case_id", F.col("node").alias("_next"), F.col("_next").alias("_far"))
        longer = jumps.join(onward, ["case_id", "_next"]).select("case_id", "node", F.col("_far").alias("_next"))
        jumps = cut(longer if lone else longer.distinct())


def closure(edges: DataFrame, roots: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(case_id, root, node) for all nodes that edges (case_id, a, b) lead to from each root (case_id, root), the root itself excluded, of `ends` (case_id, node) where it is given. Works on all roots at once, in rounds that double the steps.

    Where edges leave each node once at most, what lies ahead of a node is a row. Where they reach each node once at
    most, and the roots are half of all nodes they leave or more, the same is done backwards from the ends.
    """
    links = _links(edges.where("a IS NOT NULL AND b IS NOT NULL"))
    if _single(links, "node"):
        found = _climbed(links, roots.select("case_id", F.col("root").alias("start")), ends)
        if found is not None:
            return found.select("case_id", F.col("start").alias("root"), "node")
    elif _single(links, "_next") and 2 * roots.select("case_id", "root").distinct().count() >= links.select("case_id", "node").distinct().count():
        back = links.select("case_id", F.col("_next").alias("node"), F.col("node").alias("_next"))
        starts = back.select("case_id", "node") if ends is None else ends
        found = _climbed(back, starts.select("case_id", F.col("node").alias("start")), roots.select("case_id", F.col("root").alias("node")))
        if found is not None:
            return found.select("case_id", F.col("node").alias("root"), F.col("start").alias("node"))
    found = _paired(links, roots)
    return found if ends is None else found.join(ends.select("case_id", "node").distinct(), ["case_id", "node"], "left_semi").select("case_id", "root", "node")


def _paired(links: DataFrame, roots: DataFrame) -> DataFrame:
    """The closure of any links, with its pairs compared in each round."""
    first = cut(roots.select("case_id", "root", F.col("root").alias("node")).distinct().join(links, ["case_id", "node"]).select("case_id", "root", F.col("_next").alias("node")).distinct())
    return _doubled(links, first, ["case_id", "root"]).where("root <> node")


def reached(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(case_id, node) of the nodes that edges (case_id, a, b) lead to from any of the sources (case_id, node) in a step or more. Holds nodes, and no pairs of source and node."""
    links = _links(edges)
    first = cut(sources.select("case_id", "node").join(links, ["case_id", "node"]).select("case_id", F.col("_next").alias("node")).distinct())
    return _doubled(links, first, ["case_id"])


def few_reached(edges: DataFrame, marked: DataFrame, few: int) -> DataFrame:
    """(case_id, node, found): for each node the `few` smallest marked nodes (case_id, node) that edges (case_id, a, b) lead to from it, itself excluded.

    Holds no more than `few` rows of a node. In round k they are the smallest within 2**k steps, and meet
    those at the ends of paths of just 2**k steps. A round that changes nothing is the last.
    """
    best = Window.partitionBy("case_id", "node").orderBy("found")
    smallest = lambda df: df.where("node <> found").distinct().withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= few).drop("_n")
    jumps, on = _links(edges), marked.select("case_id", F.col("node").alias("_next"), F.col("node").alias("found"))
    ends = lambda known: known.select("case_id", F.col("node").alias("_next"), "found").unionByName(on)
    meet = lambda known: jumps.join(ends(known), ["case_id", "_next"]).select("case_id", "node", "found")
    now = cut(smallest(jumps.join(on, ["case_id", "_next"]).select("case_id", "node", "found")))
    while True:
        after = cut(smallest(now.unionByName(meet(now))))
        if after.join(now, ["case_id", "node", "found"], "left_anti").isEmpty():
            return now
        now = after
        onward = jumps.select("case_id", F.col("node").alias("_next"), F.col("_next").alias("_far"))
        jumps = cut(jumps.join(onward, ["case_id", "_next"]).select("case_id", "node", F.col("_far").alias("_next")).distinct())


def smallest_reachable(edges: DataFrame) -> DataFrame:
    """(case_id, node, root): the smallest node of each connected group of edges (case_id, a, b). Labels fall to neighbours' and jump to their labels' labels."""
    both = cut(edges.where("a <> b").select("case_id", F.col("a").alias("node"), F.col("b").alias("_other")).union(edges.where("a <> b").select("case_id", F.col("b"), F.col("a"))).distinct())
    labels = cut(both.groupBy("case_id", "node").agg(F.least(F.min("_other"), F.col("node")).alias("root")))
    for _ in range(MAX_ROUNDS):
        near = both.join(labels.select("case_id", F.col("node").alias("_other"), F.col("root").alias("_r")), ["case_id", "_other"]).groupBy("case_id", "node").agg(F.min("_r").alias("_r"))
        fallen = labels.join(near, ["case_id", "node"]).select("case_id", "node", F.least("root", "_r").alias("_down"), "root")
        jump = labels.select("case_id", F.col("node").alias("_down"), F.col("root").alias("_up"))
        after = cut(fallen.join(jump, ["case_id", "_down"], "left").select("case_id", "node", F.least("_down", F.coalesce("_up", "_down")).alias("_new"), "root"))
        labels = after.select("case_id", "node", F.col("_new").alias("root"))
        if after.where("_new <> root").isEmpty():
            return labels
    raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")
