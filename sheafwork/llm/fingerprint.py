"""Document fingerprints by consistent weighted sampling.

The terms of a text are its words, weighted by how often they occur. Sample j of a term of weight w
draws r and c from Gamma(2, 1) and b from Uniform(0, 1), all hashed from the term and j alone, and takes
t = floor(ln w / r + b), ln y = r (t - b), ln a = ln c - ln y - r. The term with the least a gives the
signature's position j, as a hash of (term, t). Two texts have the same value there with a probability
equal to the generalised Jaccard similarity of their weights: sum of minima over sum of maxima.

All of it is Spark SQL. Words are counted within the row that holds their text, and only distinct ones
are exploded there, so counting and the minima need no shuffle of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, cut, partitions, read_table

SAMPLES = 32
#: Bits of a position in the signature.
BITS = 24
#: Range partitions of the order by id: as many at least, and more where they would hold more rows than this.
PARTS, PART_ROWS = 64, 500_000


def _uniform(bits: Column, shift: int) -> Column:
    """16 bits of a hash as a number between 0 and 1, ends excluded."""
    return (F.shiftrightunsigned(bits, shift).bitwiseAND(F.lit(0xFFFF)) + F.lit(0.5)) / F.lit(65536.0)


def _sample(j: int) -> Column:
    """Sample j of the row's term as one number: ln a in the high bits, the hash of (term, t) in the low ones.

    r and c take the four quarters of a hash of their own, b a quarter of one that four samples share.
    """
    own, shared = F.xxhash64(F.col("_term"), F.lit(j)), F.xxhash64(F.col("_term"), F.lit(-1 - j // 4))
    r = -F.ln(_uniform(own, 0) * _uniform(own, 16))
    ln_c = F.ln(-F.ln(_uniform(own, 32) * _uniform(own, 48)))
    b = _uniform(shared, 16 * (j % 4))
    t = F.floor(F.col("_ln_weight") / r + b)
    ln_a = ln_c - r * (t - b + F.lit(1.0))
    value = own.bitwiseXOR(F.shiftrightunsigned(own, 29)).bitwiseXOR(F.lit(0x9E3779) * t).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.floor(ln_a * F.lit(float(1 << 27))) * F.lit(1 << BITS) + value


def terms(texts: DataFrame, keys: list[str]) -> DataFrame:
    """`keys`, _term (hash of a word), _ln_weight for the distinct words of each row of `texts` (keys, text); nulls for a text without words.

    Words are counted within their row: their sorted hashes fall into runs of equal ones. The steps are kept
    apart, as Spark would work an array out again for each of its elements.
    """
    hashed = texts.select(*keys, F.sort_array(F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w))).alias("_hashes"))
    sized = hashed.select(*keys, "_hashes", F.size("_hashes").alias("_n"))
    first = lambda i: (i == 0) | (F.get("_hashes", i) != F.get("_hashes", i - 1))
    runs = sized.select(*keys, "_hashes", "_n", F.when(F.col("_n") > 0, F.filter(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0))), first)).alias("_starts"))
    counted = lambda a, i: F.struct(F.get("_hashes", a).alias("term"), (F.coalesce(F.get("_starts", i + 1), F.col("_n")) - a).alias("weight"))
    rows = runs.select(*keys, F.explode_outer(F.transform("_starts", counted)).alias("_t"))
    return rows.select(*keys, F.col("_t.term").alias("_term"), F.ln(F.col("_t.weight").cast("double")).alias("_ln_weight"))


def signatures(texts: DataFrame, keys: list[str], samples: int = SAMPLES) -> DataFrame:
    """`keys` and `_signature` (array of long) for each row of `texts` (keys, text); keys name a row and partition the table.

    A text without words has the signature of an empty set: -1 at every position.
    """
    minima = terms(texts, keys).groupBy(*keys).agg(*[F.min(_sample(j)).alias(f"_m{j}") for j in range(samples)])
    low = [F.coalesce(F.col(f"_m{j}").bitwiseAND(F.lit((1 << BITS) - 1)), F.lit(-1)) for j in range(samples)]
    return minima.select(*keys, F.array(*low).alias("_signature"))


def as_text(signature: Column) -> Column:
    """A signature as hex digits, six for each position."""
    return F.array_join(F.transform(signature, lambda x: F.lower(F.lpad(F.hex(x.bitwiseAND(F.lit((1 << BITS) - 1))), BITS // 4, "0"))), "")


def likeness(a: Column, b: Column, samples: int = SAMPLES) -> Column:
    """The share of positions at which two signatures agree."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x) / F.lit(float(samples))


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """Distinct (doc_id, hash of text) of `docs`, how often they occur, the length, and the next one: descending doc_id, nulls last; the first after the last.

    Range partitions are numbered and written; the order then needs only rows within a part and the
    first row of every other part.
    """
    keys = cut(docs.groupBy("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_h")).agg(
        F.count("*").alias("_times"), F.max(F.length(F.coalesce("text", F.lit("")))).alias("_n")
    ))
    parts = parts or max(PARTS, -(-keys.count() // PART_ROWS))
    order = [F.col("doc_id").desc_nulls_last(), F.col("_h")]
    parted = cut(keys.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    me = F.struct("doc_id", "_h")
    heads = parted.groupBy("_part").agg(F.max_by(me, F.struct(F.col("doc_id").isNotNull(), "doc_id", -F.col("_h").cast("decimal(20,0)"))).alias("_head"))
    ring = Window.orderBy("_part")
    first = F.first("_head").over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select("_part", F.coalesce(F.lead("_head").over(ring), first).alias("_after"))
    inside = parted.withColumn("_next", F.lead(me).over(Window.partitionBy("_part").orderBy(*order)))
    return inside.join(after, "_part").select("doc_id", "_h", "_times", "_n", F.coalesce("_next", "_after").alias("_next"))


def fingerprints(docs: DataFrame, *, samples: int = SAMPLES, parts: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every document.

    The edited text has its last floor(n_chars / 3) code points replaced by the first as many (or all) of
    the next document in descending doc_id, nulls last, and after the last the first. Null text counts as
    empty. Rows that share a doc_id are ordered by a hash of their text; rows equal in both are one
    document for this order, and each of them is returned. A text without words has the fingerprint
    of the empty set, which is like itself and like no other. Long texts are taken whole. Of terms with the
    same least sample the one with the smaller hash counts. Other columns, whatever their names, are not
    looked at. No rows give no rows.
    """
    key = ["_row", "_h"]
    row = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    ahead = with_next(docs, parts).select(row("doc_id").alias("_row"), "_h", "doc_id", "_times", "_n", row("_next.doc_id").alias("_next_row"), F.col("_next._h").alias("_next_h"))
    # a stated number of partitions, which adaptive execution keeps: the work per byte is large
    texts = docs.select(row("doc_id").alias("_row"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text")).repartition(partitions(docs.sparkSession), *key)
    again = F.lag(F.lit(True)).over(Window.partitionBy(*key).orderBy(*key))
    own = texts.withColumn("_again", again).where("_again IS NULL").drop("_again")
    # what each document gives to the one before it, cut to the length needed there
    behind = ahead.select(F.col("_row").alias("_prev_row"), F.col("_h").alias("_prev_h"), F.floor(F.col("_n") / 3).cast("int").alias("_need"), F.col("_next_row").alias("_row"), F.col("_next_h").alias("_h"))
    given = own.join(behind.hint("merge"), key).select(F.col("_prev_row").alias("_row"), F.col("_prev_h").alias("_h"), F.substring("text", F.lit(1), F.col("_need")).alias("_given"))
    n, k = F.length("text"), F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.col("_given"))
    # merged where the texts are dealt out: a broadcast would move the work below to the few partitions of the other side
    pairs = own.join(given.hint("merge"), key).withColumn("_edited", edited)
    both = pairs.select(*key, F.explode(F.array(F.struct(F.lit(0).alias("_which"), "text"), F.struct(F.lit(1).alias("_which"), F.col("_edited").alias("text")))).alias("_t"))
    signed = signatures(both.select(*key, F.col("_t._which").alias("_which"), F.col("_t.text").alias("text")), [*key, "_which"], samples)
    sides = signed.groupBy(*key).agg(*[F.first(F.when(F.col("_which") == w, F.col("_signature")), ignorenulls=True).alias(f"_s{w}") for w in (0, 1)])
    facts = pairs.select(*key, F.sha2(F.col("_edited").cast("binary"), 256).alias("edited_sha256"))
    found = cut(facts.join(sides, key))
    nexts = found.select(F.col("_row").alias("_next_row"), F.col("_h").alias("_next_h"), F.col("_s0").alias("_sn"))
    rows = found.join(ahead, key).join(nexts, ["_next_row", "_next_h"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int")))).select(
        "doc_id", F.col("_n").cast("long").alias("n_chars"), "edited_sha256", as_text(F.col("_s0")).alias("fingerprint"), as_text(F.col("_s1")).alias("edited_fingerprint"),
        likeness(F.col("_s0"), F.col("_s1"), samples).alias("near_edited"), likeness(F.col("_s0"), F.col("_sn"), samples).alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
