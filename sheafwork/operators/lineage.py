"""Lineage of pieces: what they came from, what came from them, and the barrier against excluded material."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import closure, reached

# The events that switch a piece off or on. The last one tells why it is off.
SWITCHES = ("descarte", "restauracion", "union", "division", "deshacer_union", "deshacer_division")


def ancestors(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(case_id, root, node): the pieces each root came from, by edges (case_id, parent, child)."""
    return closure(edges.select("case_id", F.col("child").alias("a"), F.col("parent").alias("b")), roots)


def descendants(edges: DataFrame, roots: DataFrame, ends: DataFrame | None = None) -> DataFrame:
    """(case_id, root, node): the pieces that came from each root, of `ends` (case_id, node) where it is given."""
    return closure(edges.select("case_id", F.col("parent").alias("a"), F.col("child").alias("b")), roots, ends)


def excluded_ancestry(edges: DataFrame, pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """Each root's ancestors that are excluded. Found downwards from these, so that no other ancestor is held."""
    out = pieces.where("state = 'excluida'").select("case_id", F.col("piece_id").alias("root")).distinct()
    down = descendants(edges, out).select("case_id", F.col("node").alias("root"), F.col("root").alias("node"))
    return down.join(roots.select("case_id", "root"), ["case_id", "root"], "left_semi").select("case_id", "root", "node")


def tainted(edges: DataFrame, pieces: DataFrame) -> DataFrame:
    """The same from the other end: pieces (case_id, piece_id) that descend from an excluded one. Kept apart from `excluded_ancestry`, so that one checks the other."""
    sources = pieces.where("state = 'excluida'").select("case_id", F.col("piece_id").alias("node"))
    return reached(edges.select("case_id", F.col("parent").alias("a"), F.col("child").alias("b")), sources).select("case_id", F.col("node").alias("piece_id"))


def tainted_sql(spark, edges: DataFrame, pieces: DataFrame, depth: int = 90) -> DataFrame:
    """`tainted` by a recursive query, for lineage of fewer than `depth` levels without cycles; where that depth is reached the query fails."""
    return spark.sql(
        f"""WITH RECURSIVE down(case_id, piece_id, level) AS (
              SELECT case_id, piece_id, 0 FROM {{pieces}} WHERE state = 'excluida'
              UNION ALL
              SELECT e.case_id, e.child, d.level + 1 FROM down d JOIN {{edges}} e ON e.case_id = d.case_id AND e.parent = d.piece_id WHERE d.level < {depth})
            SELECT DISTINCT case_id, piece_id FROM down WHERE level > 0 AND CASE WHEN level < {depth} THEN true ELSE CAST(raise_error('lineage of {depth} levels or more') AS BOOLEAN) END""",
        edges=edges, pieces=pieces,
    )


def active_descendants(edges: DataFrame, pieces: DataFrame, roots: DataFrame, but: DataFrame | None = None) -> DataFrame:
    """Each root's descendants that are active, without those in `but` (case_id, node)."""
    on = pieces.where("active").select("case_id", F.col("piece_id").alias("node"))
    found = descendants(edges, roots, on)
    found = found if but is None else found.join(but, ["case_id", "node"], "left_anti")
    return found.select("case_id", "root", "node")


def last_switch(log: DataFrame) -> DataFrame:
    """The last event that switched each piece: case_id, piece_id, field."""
    return log.where(F.col("field").isin(*SWITCHES)).groupBy("case_id", "piece_id").agg(F.max_by("field", "seq").alias("field"))


def standing(pieces: DataFrame, edges: DataFrame, log: DataFrame) -> DataFrame:
    """Pieces with `stands`: whether they stand for their pages, being active, discarded by a person, or with a descendant that is one of these. What an undo or a new detection switched off stands for nothing."""
    off = last_switch(log).where("field = 'descarte'").select("case_id", "piece_id", F.lit(True).alias("_discarded"))
    own = pieces.join(off, ["case_id", "piece_id"], "left").withColumn("_own", F.col("active") | F.coalesce("_discarded", F.lit(False)))
    good = own.where("_own").select("case_id", F.col("piece_id").alias("node"))
    above = reached(edges.select("case_id", F.col("child").alias("a"), F.col("parent").alias("b")), good)
    by_child = above.select("case_id", F.col("node").alias("piece_id"), F.lit(True).alias("_below"))
    return own.join(by_child, ["case_id", "piece_id"], "left").withColumn("stands", F.col("_own") | F.coalesce("_below", F.lit(False))).drop("_discarded", "_own", "_below")
