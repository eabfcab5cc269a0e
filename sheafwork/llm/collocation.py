"""Phrase collocation mining with stripes.

A stripe is a counter of the words that follow a prefix; the empty word in it counts what follows no
further. Stripes of one prefix from all over the corpus are merged element by element. A merged stripe
gives the counts of the prefix's extensions, its sum the count of the prefix itself (for the empty prefix
the number of all words), and its largest counts whether a longer phrase takes the place of a shorter one.

Phrases grow by a word a level. A phrase is counted only where the two phrases one word shorter in it
were frequent; these are told by a bit filter of bounded size, which may let others pass but loses none.
Nothing is approximated: what passes is counted by its words.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, read_table

LEAST, LONGEST, TOP, SUBSUMED = 100, 5, 2000, 100
#: Bytes of text that are counted at once, and words in one row of a stripe.
CHUNK, ROW = 12 << 20, 128
#: Segments by the next word's hash for stripes of frequent prefixes, and of the empty one; a prefix is frequent with more than a thousandth of all words.
SEGMENTS, FIRST_SEGMENTS, HOT = 64, 1024, 1000
#: Bits of a filter: 16 for each frequent phrase, and 16 MB at most, beyond which more phrases pass it in vain.
LEAST_BITS, MOST_BITS = 15, 27
BLOCK = 32768

LETTER, BLANK, END = 0, 1, 2
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[ord(c) for c in ".,;:!?"] + [0x0A, 0x0B, 0x0C, 0x0D]] = END
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_MASK = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_ENDS = re.compile(rb"[.,;:!?\n-\r]")

STRIPES = "lang string, prefix binary, segment int, words binary, counts binary"
MERGED = "lang string, prefix string, next string, f long, hash long"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seed_of(lang: str, salt: int) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(f"{salt} {lang}".encode(), digest_size=8).digest(), "big"))


class Words:
    """The words of a text: where they are, how many more follow in their piece, and two hashes of each."""

    def __init__(self, text: bytes, lang: str):
        self.text = text.translate(_LOWER)
        kind = _KIND[np.frombuffer(self.text, dtype=np.uint8)]
        edge = np.diff((kind == LETTER).view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        n = len(self.starts)
        piece = np.searchsorted(np.flatnonzero(kind == END), self.starts)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if n else np.zeros(0, dtype=np.int64)
        self.after = last[np.searchsorted(last, np.arange(n))] - np.arange(n) if n else last
        self.hashes = [self._hash(seed_of(lang, salt)) for salt in (0, 1)]

    def _hash(self, seed: np.uint64) -> np.ndarray:
        at, left = self.starts.copy(), self.ends - self.starts
        eight = np.ndarray((len(self.text) + 1,), dtype="<u8", buffer=self.text + bytes(8), strides=(1,))
        out, rows = _mix(seed + left.astype(np.uint64)), np.arange(len(at))
        while len(rows):
            out[rows] = _mix(out[rows] ^ (eight[at[rows]] & _MASK[np.minimum(left[rows], 8)]))
            at[rows] += 8
            left[rows] -= 8
            rows = rows[left[rows] > 0]
        return out

    def phrases(self, length: int) -> list[np.ndarray]:
        """Both hashes of the phrase of `length` words that begins at each word, where the text is that long."""
        out = [h.copy() for h in self.hashes]
        for k in range(1, length):
            out = [_mix(o[: max(0, len(o) - 1)] * np.uint64(0x9E3779B97F4A7C15) + h[k:]) for o, h in zip(out, self.hashes, strict=True)]
        return out

    def at(self, i: int, length: int) -> bytes:
        return b" ".join([self.text[a:b] for a, b in zip(self.starts[i : i + length].tolist(), self.ends[i : i + length].tolist(), strict=True)])


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which phrases a filter lets pass."""
    slot = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _distinct(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of distinct pairs of hashes, and the number of each row's pair. Two things are one only if both hashes agree."""
    _, first, number = np.unique(one, return_index=True, return_inverse=True)
    if (two[first][number] == two).all():
        return first, number
    _, first, number = np.unique(np.stack([one, two], axis=1), axis=0, return_index=True, return_inverse=True)
    return first, number.reshape(-1)


def stripes(words: Words, length: int, bits: np.ndarray | None, hot: np.ndarray) -> tuple[pa.Array, ...]:
    """The stripes of one text for phrases of `length` words: prefix, segment, words, counts."""
    n, k = len(words.starts), length - 1
    if length == 1:
        first, at, keys = np.zeros(1, dtype=np.int64), np.arange(n), np.zeros(n, dtype=np.int64)
        goes = np.ones(n, dtype=bool)
        segments = np.array([FIRST_SEGMENTS])
    else:
        one, two = words.phrases(k)
        good = passes(bits, one) & (words.after[: len(one)] >= k - 1)
        at = np.flatnonzero(good)
        goes = words.after[at] >= k
        goes[goes] = good[at[goes] + 1]
        first, keys = _distinct(one[at], two[at])
        segments = np.where(np.isin(one[at[first]].view(np.int64), hot), SEGMENTS, 1)
        first = at[first]
    found = at[goes] + k
    unique, number = _distinct(words.hashes[0][found], words.hashes[1][found])
    unique = found[unique]
    follows = np.zeros(len(at), dtype=np.int64)
    follows[goes] = number + 1
    code, counts = np.unique(keys * (len(unique) + 1) + follows, return_counts=True)
    key, nth = np.divmod(code, len(unique) + 1)
    spread = np.append(np.uint64(0), words.hashes[0][unique])
    segment = (spread[nth] % segments[key].astype(np.uint64)).astype(np.int64) if len(key) else nth
    order = np.lexsort((nth, segment, key))
    key, nth, counts, segment = key[order], nth[order], counts[order], segment[order]
    new = np.append(True, (key[1:] != key[:-1]) | (segment[1:] != segment[:-1]))[: len(key)]
    begin = np.flatnonzero(new)
    place = np.arange(len(key)) - (begin[np.cumsum(new) - 1] if len(key) else 0)
    begin = np.flatnonzero(new | (place % ROW == 0))
    named = pa.array([b""] + [words.at(i, 1) for i in unique.tolist()], pa.binary())
    listed = pa.ListArray.from_arrays(pa.array(np.append(begin, len(key)), pa.int32()), named.take(pa.array(nth)))
    packed = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer((np.append(begin, len(key)) * 4).astype(np.int32)), pa.py_buffer(counts.astype("<u4"))])
    prefixes = pa.array([words.at(i, k) for i in first.tolist()], pa.binary())
    return prefixes.take(pa.array(key[begin])), pa.array(segment[begin], pa.int32()), pc.binary_join(listed, b" "), packed


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """Texts of one language put together, up to a size. A longer text is cut where a piece ends; a longer piece stays whole."""
    held: dict[str, list[bytes]] = {}
    size = 0
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            text = text.as_py()
            start = 0
            while len(text) - start > CHUNK and (end := _ENDS.search(text, start + CHUNK)):
                yield lang, text[start : end.end()]
                start = end.end()
            held.setdefault(lang, []).append(text[start:])
            size += len(text) - start + 1
            if size > CHUNK:
                yield from ((x, b"\n".join(held.pop(x))) for x in list(held))
                size = 0
    yield from ((x, b"\n".join(t)) for x, t in held.items())


def count(texts: DataFrame, length: int, bits: np.ndarray | None, hot: np.ndarray) -> DataFrame:
    """Stripes of texts (lang, text as bytes), a row for each prefix, segment and at most `ROW` words. Prefixes in `hot` (hashes) have segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, text in _chunks(batches):
            words = Words(text, lang)
            if len(words.starts):
                prefix, segment, nexts, counts = stripes(words, length, bits, hot)
                rows = pa.RecordBatch.from_arrays([pa.array([lang] * len(prefix), pa.string()), prefix, segment, nexts, counts], names=["lang", "prefix", "segment", "words", "counts"])
                yield from (rows.slice(i, 20_000) for i in range(0, len(prefix), 20_000))

    return texts.mapInArrow(run, STRIPES)


def _open(batch: pa.RecordBatch) -> pa.Table:
    """The elements of stripes: row, word, n."""
    words = pc.split_pattern(batch.column(3).cast(pa.string()), " ")
    counts = b"".join(batch.column(4).to_pylist())
    return pa.table({"row": pc.list_parent_indices(words).cast(pa.int64()), "word": pc.list_flatten(words), "n": pa.array(np.frombuffer(counts, dtype="<u4").astype(np.int64))})


def merge(rows: DataFrame, length: int, least: int) -> DataFrame:
    """Merged stripes as their frequent elements: lang, prefix, next, f, and the phrase's hash. For the empty prefix each segment's sum follows as an element without word.

    Stripes are dealt by prefix and segment and sorted; a task holds a batch of rows and the stripe that is open.
    """

    def out(keys: list[tuple], merged: pa.Table, sums: bool) -> Iterator[pa.RecordBatch]:
        kept = merged.filter(pc.and_(pc.greater_equal(merged["n"], least), pc.not_equal(merged["word"], "")))
        row, word = kept["row"].to_numpy(), kept["word"].to_pylist()
        made = [(keys[r][0], keys[r][1].decode("utf-8", "surrogateescape"), w, n) for r, w, n in zip(row.tolist(), word, kept["n"].to_pylist(), strict=True)]
        by: dict[str, list[int]] = {}
        for i, m in enumerate(made):
            by.setdefault(m[0], []).append(i)
        hashes = np.zeros(len(made), dtype=np.int64)
        for lang, places in by.items():
            text = "\n".join(f"{made[i][1]} {made[i][2]}" for i in places).encode("utf-8", "surrogateescape")
            seen = Words(text, lang)
            # a phrase a line, so its first words stand `length` apart
            hashes[places] = seen.phrases(length)[0][::length].view(np.int64)
        cols = [[m[i] for m in made] for i in range(4)]
        if sums:
            total = merged.group_by("row").aggregate([("n", "sum")])
            for r, n in zip(total["row"].to_pylist(), total["n_sum"].to_pylist(), strict=True):
                for c, v in zip(cols, (keys[r][0], "", None, n), strict=True):
                    c.append(v)
            hashes = np.append(hashes, np.zeros(len(total), dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64()), pa.array(hashes)], names=["lang", "prefix", "next", "f", "hash"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_key, open_rows = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            number, runs = np.zeros(len(keys), dtype=np.int64), [] if open_key is None else [open_key]
            for i, k in enumerate(keys):
                if not runs or k != runs[-1]:
                    runs.append(k)
                number[i] = len(runs) - 1
            table = _open(batch)
            table = table.set_column(0, "row", pa.array(number[table["row"].to_numpy()]))
            if open_rows is not None:
                table = pa.concat_tables([open_rows, table])
            merged = table.group_by(["row", "word"]).aggregate([("n", "sum")]).rename_columns(["row", "word", "n"])
            last = pc.equal(merged["row"], len(runs) - 1)
            if len(runs) > 1:
                yield from out(runs, merged.filter(pc.invert(last)), length == 1)
            open_rows = merged.filter(last)
            open_rows = open_rows.set_column(0, "row", pa.array(np.zeros(open_rows.num_rows, dtype=np.int64)))
            open_key = runs[-1]
        if open_key is not None:
            yield from out([open_key], open_rows, length == 1)

    dealt = rows.repartition("lang", "prefix", "segment").sortWithinPartitions("lang", "prefix", "segment")
    return dealt.mapInArrow(run, MERGED)


def filter_bits(frequent: DataFrame) -> np.ndarray | None:
    """A bit filter of phrases' hashes, 2**`MOST_BITS` bits at most; None without phrases."""
    n = frequent.count()
    if not n:
        return None
    width = min(MOST_BITS, max(LEAST_BITS, (16 * n - 1).bit_length()))
    slot = F.shiftrightunsigned("hash", 64 - width)
    blocks = frequent.select(slot.alias("_s")).groupBy(F.floor(F.col("_s") / BLOCK).alias("block")).agg(F.bitmap_construct_agg(F.col("_s") % BLOCK).alias("bits")).collect()
    out = np.zeros(2**width // 8, dtype=np.uint8)
    for r in blocks:
        part = np.frombuffer(bytes(r.bits), dtype=np.uint8)
        out[r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = part
    return out


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """Phrases of 1 to `longest` words that occur `least` times or more in their language (lang, phrase, prefix, length, f), and the number of words of each language (lang, n)."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    bits, hot, levels, words = None, np.zeros(0, dtype=np.int64), [], None
    for length in range(1, longest + 1):
        found = cut(merge(count(texts, length, bits, hot), length, least))
        if length == 1:
            words = found.where("next IS NULL").groupBy("lang").agg(F.sum("f").alias("n"))
            found = found.where("next IS NOT NULL")
            everything = words.agg(F.sum("n")).first()[0] or 0
        phrase = F.col("next") if length == 1 else F.concat("prefix", F.lit(" "), "next")
        levels.append(found.select("lang", phrase.alias("phrase"), F.col("prefix"), F.lit(length).alias("length"), "f", "hash"))
        bits = filter_bits(levels[-1])
        if bits is None:
            break
        # at most HOT prefixes have more than that share of all words
        hot = np.array([r.hash for r in levels[-1].where(F.col("f") * HOT > everything).select("hash").collect()], dtype=np.int64)
    out = levels[0]
    for one in levels[1:]:
        out = out.unionByName(one)
    return out.drop("hash"), words


def _part(first: Column | int, last: Column) -> Column:
    """The words of a phrase from the one numbered `first` to `last`, from 1."""
    return F.array_join(F.slice(F.split("phrase", " "), first, last), " ")


def collocations(docs: DataFrame, *, least: int = LEAST, longest: int = LONGEST, subsumed: int = SUBSUMED, top: int = TOP) -> DataFrame:
    """The best phrases of each language (null: `und`): lang, rank, phrase, a, l, r, n, score.

    A phrase has 2 to `longest` words, is found `least` times or more within pieces of text, and scores
    floor(1000 a n / (l r)) at its worst cut into two parts, that with the fewest first words if several
    are worst. One that lies in a longer candidate with at least `subsumed` per cent of its count is left
    out. Counts are exact, and products have 38 digits.

    Null and empty texts have no words; long texts are read whole; repeated rows count each; ties are
    ordered by count, then by the phrase's bytes. Columns other than lang and text are not looked at. No
    rows, or no frequent phrase, give no rows.
    """
    phrases, words = frequent_phrases(docs, least, longest)
    phrases = cut(phrases)
    rows = phrases.where("length >= 2")
    # of longer candidates those one word longer have the largest counts: its stripe's largest, and the largest of the stripes that lead to it
    longer = rows.where("length >= 3").select("lang", "f", F.explode(F.array("prefix", _part(2, F.col("length") - 1))).alias("phrase"))
    largest = longer.groupBy("lang", "phrase").agg(F.max("f").alias("_most"))
    kept = rows.join(largest, ["lang", "phrase"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < subsumed * F.col("f")))
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"), "length")
    known = phrases.select("lang", "phrase", "f")
    parts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("_first"), _part(F.col("k") + 1, F.col("length") - F.col("k")).alias("_rest"))
    left = parts.join(known.select("lang", F.col("phrase").alias("_first"), F.col("f").alias("l")), ["lang", "_first"])
    both = left.join(known.select("lang", F.col("phrase").alias("_rest"), F.col("f").alias("r")), ["lang", "_rest"]).join(F.broadcast(words) if words.limit(HOT + 1).count() <= HOT else words, "lang")
    scored = both.withColumn("score", F.expr("CAST(1000 AS DECIMAL(4,0)) * CAST(a AS DECIMAL(17,0)) * CAST(n AS DECIMAL(17,0)) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"))
    worst = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("_w"))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    flat = worst.select("lang", "phrase", "a", "_w.l", "_w.r", "n", "_w.score")
    return flat.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


_UPPER, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SQL = f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOW}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM p),
g AS (SELECT lang, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest(range(1, {LONGEST + 1})) AS k)),
f AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE k = 1 GROUP BY 1),
c AS (SELECT * FROM f WHERE k >= 2 AND f >= {LEAST}),
kept AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.lang = c.lang AND x.k > c.k AND 100 * x.f >= {SUBSUMED} * c.f AND contains(concat(' ', x.phrase, ' '), concat(' ', c.phrase, ' ')))),
cuts AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS h FROM kept),
s AS (SELECT cuts.lang, cuts.phrase, a, h, x.f AS l, y.f AS r, n, CAST(1000::HUGEINT * a * n // (x.f::HUGEINT * y.f) AS BIGINT) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(w[1:h], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(w[h + 1:], ' ') JOIN n ON n.lang = cuts.lang),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, h) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b QUALIFY rank <= {TOP}
"""
