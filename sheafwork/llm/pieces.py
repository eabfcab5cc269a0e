"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

Symbols start as code points. An agenda holds the adjacent pairs whose join is in the vocabulary; the
pair with the best score, then the leftmost, is merged, and the pairs that the new symbol forms with its
neighbours enter the agenda. What ends up outside the vocabulary is spelled in byte pieces. Long pieces of
text have an agenda each (`merge`, a heap). Short ones are taken many at a time (`merge_many`): their
agendas are the rows of a matrix, and each round merges the best entry of every row.

Where no piece has the space mark after another character, no merge crosses from a character to a
following space mark. Texts are then cut there, and the ids of recent segments are kept in a bounded table.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType

from .common import read_table

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose ids a Python worker keeps in each of two generations, and the longest that are kept and merged many at a time.
KEPT = 300_000
SHORT = 32
#: Segments merged at once, and code points of texts that are cut into segments at once.
ABREAST, GATHERED = 8192, 4 << 20
#: The rank of a pair that does not join.
NONE = np.iinfo(np.int32).max

CODED = StructType([StructField("n_tokens", LongType()), StructField("ids_sha256", StringType()), StructField("decoded_sha256", StringType()), StructField("same_ids", BooleanType())])
COMPARED = StructType([StructField("same_ids", BooleanType()), StructField("same_text", BooleanType())])


def model_path(name: str = MODEL) -> str:
    """Where the installed package of public tokenizers keeps the file."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Pieces:
    """A merge-type vocabulary: encodes texts to ids as little-endian 32-bit words, and decodes ids."""

    def __init__(self, path: str, checked: bool = False):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.library.get_piece_size()
        names = [self.library.id_to_piece(i) for i in range(size)]
        kinds = [(self.library.is_control(i), self.library.is_unknown(i), self.library.is_byte(i), self.library.is_unused(i)) for i in range(size)]
        self.ids = {n: i for i, (n, k) in enumerate(zip(names, kinds, strict=True)) if not any(k)}
        self.scores = {n: self.library.get_score(i) for n, i in self.ids.items()}
        self.byte_ids = {int(names[i][3:5], 16): i for i in range(size) if kinds[i][2]}
        self.unknown, self.bos, self.eos = self.library.unk_id(), self.library.bos_id(), self.library.eos_id()
        surface = [b"" if k[0] else b" \xe2\x81\x87 " if k[1] else bytes([int(n[3:5], 16)]) if k[2] else n.replace(SPACE, " ").encode() for n, k in zip(names, kinds, strict=True)]
        self.surface = np.array(surface, dtype=object)
        self.cuts = not any(SPACE in n.lstrip(SPACE) for n in self.ids)
        self.segments = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.checked, self.differs = checked, set()
        self._tables(size)

    def _tables(self, size: int) -> None:
        """What `merge_many` looks up: pieces of one code point, and for pairs of pieces (as one sorted number) the rank of their join's score and the join."""
        self.single = np.full(0x110000, -1, np.int64)
        for name, i in self.ids.items():
            if len(name) == 1:
                self.single[ord(name)] = i
        values = np.array([self.scores[n] for n in self.ids])
        ranks = dict(zip(self.ids, np.unique(-values, return_inverse=True)[1].tolist(), strict=True))
        splits = ((self.ids.get(n[:k]), self.ids.get(n[k:]), ranks[n], i) for n, i in self.ids.items() for k in range(1, len(n)))
        pairs = sorted((a * size + b, rank, i) for a, b, rank, i in splits if a is not None and b is not None)
        self.size = size
        # a last entry that no pair equals, so that a search past the end needs no care
        self.codes, joined, self.joins = np.array([*pairs, (np.iinfo(np.int64).max, NONE, -1)], dtype=np.int64).T.copy()
        self.ranks = joined.astype(np.int32)
        #: Whether a code point that is no piece is in no longer piece either, so that nothing joins it.
        self.lone = all(self.single[ord(c)] >= 0 for n in self.ids for c in n)

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and join of pairs of pieces; -1 is no piece."""
        code = np.where((left >= 0) & (right >= 0), left * self.size + right, -1)
        at = np.searchsorted(self.codes, code)
        return np.where(self.codes[at] == code, self.ranks[at], NONE), self.joins[at]

    def merge(self, text: str) -> list[str]:
        """The symbols of a text after all merges."""
        n = len(text)
        if n < 2:
            return [text] if text else []
        scores = self.scores
        symbols: list[str] = list(text)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        # (minus score, left position, length of the joined symbol, right position)
        agenda = [(-s, i, 2, i + 1) for i in range(n - 1) if (s := scores.get(text[i : i + 2])) is not None]
        heapify(agenda)
        while agenda:
            _, left, length, right = heappop(agenda)
            a, b = symbols[left], symbols[right]
            if not a or not b or after[left] != right or len(a) + len(b) != length:
                continue
            symbols[left], symbols[right] = joined, _ = a + b, ""
            after[left] = follows = after[right]
            if follows >= 0:
                before[follows] = left
                if (s := scores.get(joined + symbols[follows])) is not None:
                    heappush(agenda, (-s, left, length + len(symbols[follows]), follows))
            if (precedes := before[left]) >= 0 and (s := scores.get(symbols[precedes] + joined)) is not None:
                heappush(agenda, (-s, precedes, len(symbols[precedes]) + length, left))
        return [s for s in symbols if s]

    def ids_of(self, segment: str) -> list[int]:
        out: list[int] = []
        for symbol in self.merge(segment):
            known = self.ids.get(symbol)
            if known is not None:
                out.append(known)
            else:
                self._spell(symbol, out)
        return out

    def merge_many(self, segments: list[str]) -> list[bytes]:
        """The ids of short segments. Row i of the matrices is the agenda of segment i: the pair that starts at each place, with its rank; the least rank, then the leftmost, is merged in all rows at once."""
        n, lengths = len(segments), np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        # a place past the end stands for no symbol
        width = int(lengths.max()) + 1
        starts = np.cumsum(lengths) - lengths
        points = np.frombuffer("".join(segments).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        places = np.repeat(np.arange(n) * width - starts, lengths) + np.arange(len(points))
        symbols = np.full(n * width, -1, np.int64)
        symbols[places] = self.single[points]
        after, before = np.arange(1, n * width + 1), np.arange(-1, n * width - 1)
        there = np.zeros(n * width, dtype=bool)
        there[places] = True
        ranks, joins = np.full(n * width, NONE, np.int32), np.zeros(n * width, np.int64)
        ranks[:-1], joins[:-1] = self._pairs(symbols[:-1], symbols[1:])
        rows, first = ranks.reshape(n, width), np.arange(n) * width
        going = np.arange(n)
        while True:
            best = rows[going].argmin(axis=1) + first[going]
            more = ranks[best] < NONE
            going, best = going[more], best[more]
            if not len(going):
                break
            right = after[best]
            symbols[best] = joins[best]
            ranks[right], there[right] = NONE, False
            follows = after[right]
            after[best], before[follows] = follows, best
            ranks[best], joins[best] = self._pairs(symbols[best], symbols[follows])
            inner = best > first[going]
            here = best[inner]
            precedes = before[here]
            ranks[precedes], joins[precedes] = self._pairs(symbols[precedes], symbols[here])
        left = there.reshape(n, width).sum(axis=1)
        kept = symbols[there]
        flat, ends = kept.astype("<u4").tobytes(), (np.cumsum(left) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        if len(kept) and kept.min() < 0:
            stops = np.cumsum(left)
            for i in np.unique(np.searchsorted(stops, np.flatnonzero(kept < 0), side="right")).tolist():
                out[i] = self._spelled(segments[i], kept[stops[i] - left[i] : stops[i]].tolist())
        return out

    def _spelled(self, segment: str, symbols: list[int]) -> bytes:
        """The ids of merged symbols, with bytes (or the unknown piece, once for a run) in place of code points that are no pieces."""
        unknown = iter([c for c in segment if self.single[ord(c)] < 0])
        out: list[int] = []
        for x in symbols:
            if x >= 0:
                out.append(x)
            else:
                self._spell(next(unknown), out)
        return np.array(out, dtype="<u4").tobytes()

    def _spell(self, symbol: str, out: list[int]) -> None:
        if self.byte_ids:
            out += [self.byte_ids[b] for b in symbol.encode()]
        elif not out or out[-1] != self.unknown:
            out.append(self.unknown)

    def check(self, segments: list[str], found: list[bytes]) -> None:
        """Notes in `differs` the segments, all with the space mark first, whose ids are not the library's. It puts that mark before every text itself, but for an empty one."""
        theirs = [x if s != SPACE else [self.library.piece_to_id(SPACE)] for s, x in zip(segments, self.library.encode([s[1:].replace(SPACE, " ") for s in segments], num_threads=1), strict=True)]
        flat = np.fromiter(chain.from_iterable(theirs), dtype="<u4").tobytes()
        if flat != b"".join(found) or list(map(len, theirs)) != [len(x) // 4 for x in found]:
            self.differs |= {s for s, x, y in zip(segments, theirs, found, strict=True) if np.array(x, dtype="<u4").tobytes() != y}

    def learn(self, segments: set[str]) -> dict[str, bytes]:
        """A table with the ids of all segments. It is kept for later texts: when full it becomes the old generation, from which what is met again is taken over, so frequent segments stay."""
        if len(self.kept) >= KEPT:
            self.old, self.kept = self.kept, {}
        fresh = segments - self.kept.keys()
        known = fresh & self.old.keys()
        self.kept |= {s: self.old[s] for s in known}
        fresh = sorted(fresh - known, key=len)
        short = bisect_right(fresh, SHORT, key=len) if self.lone else 0
        for start in range(0, short, ABREAST):
            part = fresh[start : min(short, start + ABREAST)]
            found = self.merge_many(part)
            if self.checked:
                self.check(part, found)
            self.kept |= zip(part, found, strict=True)
        long = {s: np.array(self.ids_of(s), dtype="<u4").tobytes() for s in fresh[short:]}
        if self.checked and long:
            self.check(list(long), list(long.values()))
        return self.kept | long if long else self.kept

    def encode_all(self, texts: list[str]) -> Iterator[tuple[bytes, bool]]:
        """The ids of each text, begin and end included, and whether the library gives the same for all of its segments (true where nothing is checked)."""
        bos, eos = np.array([self.bos], "<u4").tobytes(), np.array([self.eos], "<u4").tobytes()
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= GATHERED):
                size, stop = size + len(texts[stop]), stop + 1
            marked = (SPACE + t.replace(" ", SPACE) if t else "" for t in texts[at:stop])
            found = [self.segments.findall(m) if self.cuts else [m] if m else [] for m in marked]
            known = self.learn(set().union(*found))
            for segments in found:
                yield b"".join([bos, *map(known.__getitem__, segments), eos]), not self.differs or self.differs.isdisjoint(segments)
            at = stop

    def encode(self, text: str) -> bytes:
        """The ids of one text, begin and end included."""
        return next(self.encode_all([text]))[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; the space that encoding puts first is taken off again."""
        text = b"".join(self.surface[np.frombuffer(ids, dtype="<u4")].tolist()).decode("utf-8", "replace")
        return text.removeprefix(" ")


_LOADED: dict[tuple[str, bool], Pieces] = {}


def pieces(path: str, checked: bool = False) -> Pieces:
    """The vocabulary at `path`, loaded once in a worker; `checked` ones compare every segment that they encode with the library."""
    if (path, checked) not in _LOADED:
        _LOADED[path, checked] = Pieces(path, checked)
    return _LOADED[path, checked]


def coded(model: str = MODEL, checked: bool = False):
    """A column function: text to (n_tokens, ids_sha256, decoded_sha256, same_ids)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(model_path(model), checked)
        for batch in batches:
            rows = []
            for ids, same in vocabulary.encode_all([t or "" for t in batch]):
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(vocabulary.decode(ids).encode()).hexdigest(), same))
            yield pd.DataFrame(rows, columns=CODED.names)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, CODED)


def compared(model: str = MODEL):
    """A column function: text to whether the sentencepiece library gives the same ids and the same decoded text."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        vocabulary = pieces(model_path(model))
        for batch in batches:
            texts = [t or "" for t in batch]
            theirs = vocabulary.library.encode(texts, add_bos=True, add_eos=True, num_threads=1)
            mine = [ids for ids, _ in vocabulary.encode_all(texts)]
            same = [np.array(x, "<u4").tobytes() == y for x, y in zip(theirs, mine, strict=True)]
            decoded = [vocabulary.library.decode(x) == vocabulary.decode(y) for x, y in zip(theirs, mine, strict=True)]
            yield pd.DataFrame({"same_ids": same, "same_text": decoded})

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, COMPARED)


def encode_documents(docs: DataFrame, model: str = MODEL, checked: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document; ids include begin and end.

    With `checked`, same_ids too: whether the sentencepiece library encodes every segment of the text to the
    same ids, compared in each Arrow batch when a worker first meets the segment. Null text counts as empty
    and has the two ids of begin and end. Long texts are encoded whole. Of pairs with the same score the
    leftmost is merged first. Repeated rows are encoded each; other columns, whatever their names, are not
    looked at. No rows give none.
    """
    rows = docs.select("doc_id", coded(model, checked)("text").alias("_coded")).select("doc_id", "_coded.*")
    return rows if checked else rows.drop("same_ids")


def token_ids(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and its ids (array of int). A null or empty text has none but begin and end; long texts are read whole; repeated rows and ids give theirs each. Other columns, whatever their names, are not looked at. No rows give none."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vocabulary = pieces(model_path(model))
        for batch in batches:
            yield pd.Series([np.frombuffer(ids, "<u4").astype(np.int32) for ids, _ in vocabulary.encode_all([t or "" for t in batch])])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    from pyspark.sql.types import ArrayType, IntegerType

    return docs.select("doc_id", F.pandas_udf(run, ArrayType(IntegerType()))("text").alias("ids"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(read_table(spark, sf_dir, "documents"), checked=True)
