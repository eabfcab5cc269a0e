"""Vector code compression: product codes with codebooks trained by rounds of assignment and averaging.

Every part of a vector goes to the nearest entry of its position's codebook. Parts are hashed by the
coarse grid cell they lie in. For each cell met, the entries are kept that are not dominated across its
box: an entry whose least distance to the box is above the smallest of the entries' largest distances is
farther than another one from every point in it. Only the kept ones are measured exactly. Cells are
remembered within a task; all arithmetic is in whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, read_table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Cells remembered for each part before they are forgotten, and numbers held at once while distances are taken.
MEMO, HELD = 50_000, 1 << 21
#: Whole components are below this, so that no distance passes 64 bits.
LARGEST = 1 << 24
#: A label with more than this share of all rows, of which there are as many at most, is joined by broadcast.
HOT = 1000


def whole(vectors: pa.Array, width: int) -> np.ndarray:
    """Vectors of one length as whole numbers, floor(256 x)."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.floor(flat * SCALE)
    if len(out) != len(vectors) * width or (len(out) and np.abs(out).max() >= LARGEST):
        raise ValueError(f"vectors need {width} components each, and these below {LARGEST // SCALE}")
    return out.astype(np.int64).reshape(len(vectors), width)


class Cells:
    """The nearest entries of one codebook (entries, components), by memoised grid cells."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.memo = entries, {}
        spread = (entries.max(axis=0) - entries.min(axis=0)).mean() if entries.size else 1
        #: The side of a cell: an eighth of the codebook's mean spread, as a power of two.
        self.side = 1 << max(0, int(spread).bit_length() - 4)

    def candidates(self, cells: np.ndarray) -> list[np.ndarray]:
        """For each cell the entries, ascending, that are nearest to some point of its box, ties included."""
        out, step = [], max(1, HELD // max(1, self.entries.size))
        for i in range(0, len(cells), step):
            low = (cells[i : i + step] * self.side)[:, None, :]
            high = low + self.side - 1
            least = np.maximum(np.maximum(low - self.entries, self.entries - high), 0)
            most = np.maximum(np.abs(self.entries - low), np.abs(self.entries - high))
            keep = (least * least).sum(axis=2) <= (most * most).sum(axis=2).min(axis=1)[:, None]
            out += [np.flatnonzero(k) for k in keep]
        return out

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of the nearest entry of each point, the lowest of equals, and its squared distance."""
        cells = np.ascontiguousarray(np.floor_divide(points, self.side))
        if not len(points):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        keys = cells.view(np.dtype((np.void, cells.dtype.itemsize * cells.shape[1]))).reshape(-1)
        _, first, number = np.unique(keys, return_index=True, return_inverse=True)
        number = number.reshape(-1)
        names = [keys[i].tobytes() for i in first]
        fresh = [i for i, name in enumerate(names) if name not in self.memo]
        if len(self.memo) + len(fresh) > MEMO:
            self.memo, fresh = {}, list(range(len(names)))
        self.memo.update(zip((names[i] for i in fresh), self.candidates(cells[first[fresh]]), strict=True))
        found = [self.memo[name] for name in names]
        sizes = np.array([len(f) for f in found])
        listed = np.empty((len(found), sizes.max()), dtype=np.int64)
        for i, f in enumerate(found):
            listed[i, : len(f)] = f
            listed[i, len(f) :] = f[-1]
        # rows with as many candidates are measured together, so that none is measured against more than its cell's
        best, error = np.empty(len(points), dtype=np.int64), np.empty(len(points), dtype=np.int64)
        order = np.argsort(sizes[number], kind="stable")
        at = 0
        while at < len(order):
            n = sizes[number[order[at]]]
            stop = np.searchsorted(sizes[number], n, side="right", sorter=order)
            rows = order[at : min(stop, at + max(1, HELD // max(1, n * points.shape[1])))]
            cand = listed[number[rows], :n]
            far = self.entries[cand] - points[rows][:, None, :]
            far = (far * far).sum(axis=2)
            pick = far.argmin(axis=1)
            best[rows], error[rows] = cand[np.arange(len(rows)), pick], far[np.arange(len(rows)), pick]
            at += len(rows)
        return best, error


def kept_vectors(table: DataFrame) -> DataFrame:
    """Rows whose vector is there and has only finite components."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return table.where(F.col("embedding").isNotNull()).where(F.coalesce(F.forall("embedding", fine), F.lit(False)))


def first_books(kept: DataFrame, parts: int, entries: int) -> np.ndarray:
    """The codebooks (part, entry, component) that the smallest ids begin with; of rows with one id the smallest vector counts.

    The smallest rows are taken until they hold enough ids: once, unless ids repeat.
    """
    begun: dict = {}
    rest = kept.where("vec_id IS NOT NULL").select("vec_id", "embedding")
    while len(begun) < entries and (rows := rest.orderBy("vec_id", "embedding").limit(entries).collect()):
        for r in rows:
            begun.setdefault(r.vec_id, r.embedding)
        rest = rest.where(F.col("vec_id") > F.lit(rows[-1].vec_id))
    vectors = list(begun.values())[:entries] or [r.embedding for r in kept.select("embedding").orderBy("embedding").limit(1).collect()]
    if not vectors:
        return np.zeros((parts, 0, 0), dtype=np.int64)
    width = len(vectors[0])
    if width % parts or not width:
        raise ValueError(f"vectors of {width} components can't be cut into {parts} equal parts")
    return whole(pa.array(vectors), width).reshape(len(vectors), parts, width // parts).transpose(1, 0, 2).copy()


def _sums(kept: DataFrame, books: np.ndarray) -> np.ndarray:
    """The next codebooks: means of the parts assigned to each entry, rounded down; an entry without parts stays. Parts are summed in each task before they meet, 1,024 sums in all."""
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, total, n = [Cells(b) for b in books], np.zeros((parts, entries, width), dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            points = whole(batch.column(0), parts * width).reshape(-1, parts, width)
            for p in range(parts):
                best, _ = cells[p].nearest(points[:, p])
                n[p] += np.bincount(best, minlength=entries)
                for c in range(width):
                    # sums below 2**53 of whole numbers are exact in doubles: a batch has few rows
                    total[p, :, c] += np.bincount(best, weights=points[:, p, c], minlength=entries).astype(np.int64)
        at = np.flatnonzero(n.reshape(-1))
        sums = total.reshape(-1, width)[at]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n.reshape(-1)[at]), *[pa.array(sums[:, c]) for c in range(width)]], names=["entry", "n", *[f"s{c}" for c in range(width)]])

    schema = ", ".join(["entry long", "n long", *[f"s{c} long" for c in range(width)]])
    summed = kept.select("embedding").mapInArrow(run, schema).groupBy("entry").agg(*[F.sum(c).alias(c) for c in ["n", *[f"s{c}" for c in range(width)]]])
    out = books.reshape(-1, width).copy()
    for r in summed.collect():
        out[r.entry] = [r[f"s{c}"] // r.n for c in range(width)]
    return out.reshape(books.shape)


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) after some rounds over all kept vectors."""
    if entries > 256:
        raise ValueError("an entry's number has two hex digits")
    books = first_books(kept, parts, entries)
    for _ in range(rounds if books.size else 0):
        books = _sums(kept, books)
    return books


def encode(kept: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code and error of every kept vector (vec_id, embedding, label)."""
    parts, _, width = books.shape
    id_type, label_type = (dict(kept.dtypes)[c] for c in ("vec_id", "label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(b) for b in books]
        for batch in batches:
            points = whole(batch.column(2), parts * width).reshape(-1, parts, width)
            codes, errors = np.zeros((len(points), parts), dtype=np.uint8), np.zeros(len(points), dtype=np.int64)
            for p in range(parts):
                best, far = cells[p].nearest(points[:, p])
                codes[:, p] = best
                errors += far
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], names=["vec_id", "label", "code", "error"])

    return kept.select("vec_id", "label", "embedding").mapInArrow(run, f"vec_id {id_type}, label {label_type}, code string, error long")


def decode(codes: DataFrame, books: np.ndarray) -> DataFrame:
    """`codes` (vec_id, code) with the vectors that the codes stand for, as `approximation`, an array of doubles."""
    flat = F.lit([[[float(x) / SCALE for x in entry] for entry in book] for book in books.tolist()])
    at = lambda p: F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")
    return codes.withColumn("approximation", F.concat(*[F.get(F.get(flat, p), at(p)) for p in range(len(books))]))


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """`coded` (label, error, ...) with `label_error`, the error summed over equal labels, nulls together. Few labels are hot, and these are joined by broadcast, so no task gets one whole."""
    key = F.struct(F.col("label").isNull().alias("none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("value"))
    rows = coded.withColumn("_label", key)
    sums = cut(rows.groupBy("_label").agg(F.sum("error").alias("label_error"), F.count("*").alias("_n")))
    everything = sums.agg(F.sum("_n")).first()[0] or 0
    hot = F.broadcast(sums.where(F.col("_n") * HOT > everything).select("_label", "label_error"))
    rest = sums.where(F.col("_n") * HOT <= everything).select("_label", "label_error")
    return rows.join(hot, "_label").unionByName(rows.join(hot, "_label", "left_anti").join(rest, "_label")).drop("_label")


def compress(table: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row for each kept vector of a table (vec_id, embedding, label): vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out. All others need one length, a
    multiple of `parts`, and components whose whole part is below 65,536; else the job fails and says so. Rows
    without an id are coded and begin no codebook. Rows with one id are coded each, and the smallest of
    their vectors begins a codebook. Fewer ids than `entries` give codebooks of as many. Ties go to the
    lower entry. Other columns, whatever their names, are not looked at. No rows give no rows.
    """
    kept = kept_vectors(table.select("vec_id", "embedding", "label"))
    books = train(kept, parts, entries, rounds)
    coded = cut(encode(kept, books)) if books.size else kept.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")).limit(0)
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(read_table(spark, sf_dir, "embeddings"))


def _round(n: int) -> str:
    return f"""a{n} AS (SELECT v.id, v.p, arg_min(b.e, b.e + 64 * list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))) AS e FROM v JOIN b{n} b ON b.p = v.p GROUP BY 1, 2),
m{n} AS (SELECT p, e, list(s ORDER BY i) AS x FROM (SELECT a.p, a.e, i, CAST(floor_div(sum(v.x[i]), count(*)) AS BIGINT) AS s FROM a{n} a JOIN v ON v.id = a.id AND v.p = a.p, unnest(range(1, len(v.x) + 1)) AS t(i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
b{n + 1} AS (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{n} b LEFT JOIN m{n} m ON m.p = b.p AND m.e = b.e)"""


SQL = """
WITH k AS (SELECT row_number() OVER () AS id, vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
v AS (SELECT id, vec_id, p, w[p * len(w) // 16 + 1:(p + 1) * len(w) // 16] AS x FROM k, (SELECT unnest(range(16)) AS p)),
s AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM (SELECT DISTINCT vec_id FROM k WHERE vec_id IS NOT NULL) ORDER BY vec_id LIMIT 64),
b0 AS (SELECT v.p, s.e, min(v.x) AS x FROM s JOIN v USING (vec_id) GROUP BY 1, 2),
""" + ",\n".join(map(_round, range(ROUNDS))) + f""",
d AS (SELECT v.id, v.p, min(b.e + 64 * list_sum(list_transform(range(1, len(v.x) + 1), lambda i: (v.x[i] - b.x[i]) * (v.x[i] - b.x[i])))) AS far FROM v JOIN b{ROUNDS} b ON b.p = v.p GROUP BY 1, 2),
c AS (SELECT id, string_agg(lower(printf('%02x', CAST(far % 64 AS INT))), '' ORDER BY p) AS code, CAST(sum(far // 64) AS BIGINT) AS error FROM d GROUP BY 1),
h AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b{ROUNDS})
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY k.label) AS BIGINT) AS label_error, h.codebooks_sha256 FROM k JOIN c USING (id), h
"""
SQL = SQL.replace("floor_div(sum(v.x[i]), count(*))", "(sum(v.x[i]) - ((sum(v.x[i]) % count(*)) + count(*)) % count(*)) // count(*)")
