"""Near-duplicate pieces: proposals, never merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalise, ocr_key
from ..plans.graph import cut

LEAST, WINDOW = 0.62, 400
#: A kept pair without equal keys has at least this Jaccard of descriptions: (0.62 - 0.15 - 0.35) / 0.5, less a margin.
LEAST_SHARE = 0.2399


def shingles(text: Column) -> Column:
    """The distinct word trigrams of a text, or its words if there are fewer than three."""
    words = F.filter(F.split(normalise(text), " "), lambda w: w != "")
    triples = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))), lambda i: F.array_join(F.slice(w, i, 3), " "))
    # an array of one holds the words, so that they are made once and not for every trigram
    return F.get(F.transform(F.array(words), lambda w: F.array_distinct(F.when(F.size(w) < 3, w).otherwise(triples(w)))), F.lit(0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all of two sets of distinct values; 0 if either is empty."""
    common = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(common / (F.size(a) + F.size(b) - common))


def meet(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs a < b of rows (piece_id, page, and others) with equal keys and pages at most 400 apart; page 0 is near every page.

    Pages are cut into bands of 400, so that a value that many pieces share is joined band by band. Every
    pair is met in both directions, as bands are; the one with a < b counts.
    """
    left = rows.select(*[F.col(c).alias(f"{c}_a") if c not in keys else F.col(c) for c in rows.columns]).withColumn("_band", F.floor(F.col("page_a") / WINDOW))
    right = rows.select(*[F.col(c).alias(f"{c}_b") if c not in keys else F.col(c) for c in rows.columns]).withColumn("_at", F.floor(F.col("page_b") / WINDOW))
    paged = left.where("page_a <> 0").join(right.where("page_b <> 0").withColumn("_band", F.explode(F.array(F.col("_at") - 1, F.col("_at"), F.col("_at") + 1))).drop("_at"), [*keys, "_band"]).where("piece_id_a < piece_id_b")
    loose = left.where("page_a = 0").drop("_band").join(right.drop("_at"), keys).unionByName(left.where("page_a <> 0").drop("_band").join(right.where("page_b = 0").drop("_at"), keys))
    near = paged.drop("_band").where(F.abs(F.col("page_a") - F.col("page_b")) <= WINDOW).unionByName(loose)
    return near.where("piece_id_a < piece_id_b").withColumns({"a": F.col("piece_id_a"), "b": F.col("piece_id_b")})


def candidate_pairs(sets: DataFrame, share: float = LEAST_SHARE) -> DataFrame:
    """Pairs (case_id, a, b) that can reach a Jaccard of `share`, from (case_id, piece_id, page, shingles).

    Each set is ordered by rising frequency in its case; two sets that reach the share have a common
    value among the first size - ceil(share * size) + 1 of each, so only these are joined.
    """
    spread = sets.select("case_id", "piece_id", "page", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    often = spread.groupBy("case_id", "s").agg(F.count("*").alias("df"))
    order = Window.partitionBy("case_id", "piece_id").orderBy("df", "s")
    ordered = spread.join(often, ["case_id", "s"]).withColumn("_at", F.row_number().over(order))
    placed = ordered.where((F.col("_at") <= F.col("n") - F.ceil(F.lit(share) * F.col("n")) + 1) & (F.col("df") > 1)).drop("_at", "df")
    met = meet(placed, ["case_id", "s"]).where(F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * share)
    return met.select("case_id", "a", "b").distinct()


def near_duplicates(pieces: DataFrame, dismissed: DataFrame | None = None) -> DataFrame:
    """Pairs (case_id, a, b, score, reasons) of active pieces (piece_id, type, description, source_text, page_start) that look alike.

    The score is 0.15 for equal types plus half the Jaccard of descriptions and 0.35 of that of texts;
    an equal key of the description makes it 0.9 at least. Pairs more than 400 pages apart, and dismissed
    ones, are left out.
    """
    made = cut(pieces.select("case_id", "piece_id", "type", F.coalesce("page_start", F.lit(0)).alias("page"), shingles(F.col("description")).alias("d"), shingles(F.col("source_text")).alias("t"), ocr_key(F.col("description")).alias("k")))
    by_shingle = candidate_pairs(made.select("case_id", "piece_id", "page", F.col("d").alias("shingles")))
    by_key = meet(made.where("k <> ''").select("case_id", "k", "piece_id", "page"), ["case_id", "k"]).select("case_id", "a", "b")
    pairs = by_shingle.union(by_key).distinct()
    if dismissed is not None:
        pairs = pairs.join(dismissed.select("case_id", "a", "b"), ["case_id", "a", "b"], "left_anti")
    side = lambda x, *names: made.select("case_id", F.col("piece_id").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in names])
    near = pairs.join(side("a", "type", "d", "k"), ["case_id", "a"]).join(side("b", "type", "d", "k"), ["case_id", "b"])
    same_type, same_key = F.col("type_a").eqNullSafe(F.col("type_b")) & F.col("type_a").isNotNull(), (F.col("k_a") == F.col("k_b")) & (F.col("k_a") != "")
    told = near.select("case_id", "a", "b", same_type.alias("_type"), same_key.alias("_key"), jaccard(F.col("d_a"), F.col("d_b")).alias("_jd"))
    same_type, same_key = F.col("_type"), F.col("_key")
    score = lambda jt: F.when(same_type, 0.15).otherwise(0.0) + (0.5 * F.col("_jd") + 0.35 * jt)
    # texts are only looked at where an equal text would make the score high enough; a sum of rounded parts rises with each part
    hopeful = told.where(same_key | (score(F.lit(1.0)) >= LEAST))
    full = hopeful.join(side("a", "t"), ["case_id", "a"]).join(side("b", "t"), ["case_id", "b"])
    scored = full.withColumn("_jt", jaccard(F.col("t_a"), F.col("t_b"))).withColumn("_s", score(F.col("_jt")))
    reasons = F.filter(F.array(F.when(same_key, "misma_clave"), F.when(F.col("_jd") > 0.85, "misma_descripcion"), F.when(F.col("_jt") > 0.7, "texto_parecido")), lambda x: x.isNotNull())
    out = scored.withColumn("score", F.when(same_key, F.greatest(F.col("_s"), F.lit(0.9))).otherwise(F.col("_s"))).withColumn("reasons", reasons)
    return out.where(F.col("score") >= LEAST).select("case_id", "a", "b", "score", "reasons")


def open_pairs(pairs: DataFrame, pieces: DataFrame) -> DataFrame:
    """Pairs both of whose pieces are active, with their descriptions, the most alike first."""
    side = lambda x: pieces.where("active").select("case_id", F.col("piece_id").alias(x), F.col("description").alias(f"description_{x}"))
    return pairs.join(side("a"), ["case_id", "a"]).join(side("b"), ["case_id", "b"]).orderBy(F.desc("score"), "case_id", "a", "b")


def partners(pairs: DataFrame) -> DataFrame:
    """Both directions of each pair: case_id, piece_id, other_id, score."""
    turned = pairs.select("case_id", F.col("b").alias("piece_id"), F.col("a").alias("other_id"), "score")
    return pairs.select("case_id", F.col("a").alias("piece_id"), F.col("b").alias("other_id"), "score").unionByName(turned)
