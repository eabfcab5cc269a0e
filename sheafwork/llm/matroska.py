"""Media columns in Matroska: payloads stored as PCM audio, and files parsed into packet tables.

The parser walks EBML elements of variable length (unknown lengths too), takes apart clusters, simple
blocks and block groups with all four kinds of lacing, and reads the cues. A packet is a frame: track,
timestamp, byte range, and where it came from.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from .common import read_table

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = range(4)

#: Samples a second, samples in a frame, frames in a block, blocks in a cluster, and what the payload is padded to.
RATE, FRAME, LACED, BLOCKS, ALIGN = 8000, 512, 8, 8, 64

PACKET = StructType([
    StructField("track", IntegerType()), StructField("timestamp_ns", LongType()), StructField("offset", LongType()), StructField("size", IntegerType()),
    StructField("keyframe", BooleanType()), StructField("lacing", IntegerType()), StructField("cluster", IntegerType()),
])
STORED = StructType([
    StructField("n_bytes", LongType()), StructField("payload_bytes", LongType()), StructField("payload_sha256", StringType()), StructField("tail_crc32", LongType()),
    StructField("media_bytes", LongType()), StructField("media_sha256", StringType()), StructField("feature", StringType()),
])


def element(name: int, body: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + number(len(body)) + body


def number(value: int, length: int | None = None) -> bytes:
    """A length as an EBML number of variable size; all bits set is kept for unknown lengths."""
    length = length or next(n for n in range(1, 9) if value < (1 << 7 * n) - 1)
    return (value | 1 << 7 * length).to_bytes(length, "big")


def unsigned(name: int, value: int) -> bytes:
    return element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes]) -> tuple[int, bytes]:
    """The kind of lacing for some frames and its header: fixed for equal sizes, else the shorter of the other two."""
    if len(frames) == 1:
        return NO_LACING, b""
    sizes = [len(f) for f in frames]
    count = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return FIXED, count
    xiph = b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    signed = [next((d + (1 << 7 * n - 1) - 1, n) for n in range(1, 9) if abs(d) < (1 << 7 * n - 1)) for d in np.diff(sizes[:-1]).tolist()]
    ebml = number(sizes[0]) + b"".join(number(v, n) for v, n in signed)
    return (XIPH, count + xiph) if len(xiph) < len(ebml) else (EBML_LACING, count + ebml)


def simple_block(track: int, at: int, frames: list[bytes]) -> bytes:
    kind, head = laced(frames)
    return element(SIMPLE_BLOCK, number(track) + struct.pack(">hB", at, 0x80 | kind << 1) + head + b"".join(frames))


def write(payload: bytes) -> bytes:
    """A Matroska file with the payload as unsigned 8-bit mono PCM in laced blocks, with a cue for every cluster."""
    head = element(EBML, unsigned(0x4286, 1) + unsigned(0x42F7, 1) + unsigned(0x42F2, 4) + unsigned(0x42F3, 8) + element(0x4282, b"matroska") + unsigned(0x4287, 4) + unsigned(0x4285, 2))
    info = element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"sheafwork") + element(WRITING_APP, b"sheafwork") + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8))
    track = unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + unsigned(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + unsigned(DEFAULT_DURATION, FRAME * 10**9 // RATE)
    parts, cues = [info, element(TRACKS, element(TRACK_ENTRY, track + audio))], []
    at = sum(map(len, parts))
    for start in range(0, len(payload), FRAME * LACED * BLOCKS):
        first = start * 1000 // RATE
        blocks = [unsigned(TIMESTAMP, first)]
        for b in range(start, min(len(payload), start + FRAME * LACED * BLOCKS), FRAME * LACED):
            frames = [payload[i : i + FRAME] for i in range(b, min(len(payload), b + FRAME * LACED), FRAME)]
            blocks.append(simple_block(1, b * 1000 // RATE - first, frames))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, first) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, at))))
        at += len(cluster)
        parts.append(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def read_number(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int]:
    """The EBML number at a place and its length; -1 for the unknown length."""
    length = 9 - data[at].bit_length()
    if length > 8 or at + length > len(data):
        raise ValueError(f"no EBML number at byte {at}")
    value = int.from_bytes(data[at : at + length], "big")
    if not keep_marker:
        value &= (1 << 7 * length) - 1
        if value == (1 << 7 * length) - 1:
            value = -1
    return value, length


def next_top_level(data: bytes, at: int, end: int) -> int:
    """Where the first element of the segment's own level starts, from a place inside a cluster on; the end if there is none."""
    while at < end:
        name, n = read_number(data, at, keep_marker=True)
        size, m = read_number(data, at + n)
        if name in TOP_LEVEL:
            return at
        if size < 0:
            return end
        at += n + m + size
    return end


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body) of the elements between two places.

    An element of unknown length reaches to the end of its parent, or, for a cluster, to the next element
    of the segment's own level; the headers in it are walked over once to find that.
    """
    while at < end:
        name, n = read_number(data, at, keep_marker=True)
        size, m = read_number(data, at + n)
        body = at + n + m
        stop = body + size if size >= 0 else next_top_level(data, body, end) if name == CLUSTER else end
        if stop > end:
            raise ValueError(f"element {name:#x} at byte {at} is cut off")
        yield name, at, body, stop
        at = stop


def frame_sizes(data: bytes, at: int, end: int, kind: int) -> tuple[int, list[int]]:
    """Where the frames of a block start, and their sizes."""
    if kind == NO_LACING:
        return at, [end - at]
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED:
        if (end - at) % count:
            raise ValueError("frames of a fixed lace are not equal")
        return at, [(end - at) // count] * count
    for i in range(count - 1):
        if kind == XIPH:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            value, n = read_number(data, at)
            if value < 0:
                value = (1 << 7 * n) - 1
            size, at = value if i == 0 else sizes[-1] + value - ((1 << 7 * n - 1) - 1), at + n
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("frames of a lace exceed their block")
    return at, sizes


@dataclass
class File:
    """What a file holds: scale of timestamps (ns), duration of a frame (ns) by track, codecs, packets, cues and starts of clusters within the segment."""

    scale: int = 1_000_000
    frame_ns: dict[int, int] = field(default_factory=dict)
    codecs: dict[int, str] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: list[int] = field(default_factory=list)


def value(data: bytes, body: int, stop: int) -> int:
    return int.from_bytes(data[body:stop], "big")


def parse(data: bytes, out: File | None = None) -> File:
    """A file's tables. Elements that are not needed are skipped by their length. What is no Matroska file, or is cut off, raises; `out` then holds what came before."""
    out = File() if out is None else out
    for name, _, body, stop in elements(data, 0, len(data)):
        if name != SEGMENT:
            continue
        for part, start, inner, end in elements(data, body, stop):
            if part == INFO:
                out.scale = next((value(data, b, e) for i, _, b, e in elements(data, inner, end) if i == TIMESTAMP_SCALE), out.scale)
            elif part == TRACKS:
                for entry in (x for x in elements(data, inner, end) if x[0] == TRACK_ENTRY):
                    found = {i: data[b:e] for i, _, b, e in elements(data, entry[2], entry[3])}
                    track = int.from_bytes(found[TRACK_NUMBER], "big")
                    out.codecs[track] = found.get(CODEC_ID, b"").decode("ascii", "replace")
                    out.frame_ns[track] = int.from_bytes(found.get(DEFAULT_DURATION, b""), "big")
            elif part == CLUSTER:
                out.clusters.append(start - body)
                _cluster(data, inner, end, out)
            elif part == CUES:
                for point in (x for x in elements(data, inner, end) if x[0] == CUE_POINT):
                    at, places = 0, []
                    for i, _, b, e in elements(data, point[2], point[3]):
                        if i == CUE_TIME:
                            at = value(data, b, e)
                        elif i == CUE_TRACK_POSITIONS:
                            places.append({k: value(data, x, y) for k, _, x, y in elements(data, b, e)})
                    out.cues += [(at, p.get(CUE_TRACK, 0), p.get(CUE_CLUSTER_POSITION, -1)) for p in places]
    return out


def _cluster(data: bytes, at: int, end: int, out: File) -> None:
    base = 0
    for name, _, body, stop in elements(data, at, end):
        if name == TIMESTAMP:
            base = value(data, body, stop)
        elif name == SIMPLE_BLOCK:
            _block(data, body, stop, base, bool(data[body + read_number(data, body)[1] + 2] & 0x80), out)
        elif name == BLOCK_GROUP:
            inside = list(elements(data, body, stop))
            for i, _, b, e in inside:
                if i == BLOCK:
                    _block(data, b, e, base, not any(x[0] == 0xFB for x in inside), out)


def _block(data: bytes, at: int, end: int, base: int, keyframe: bool, out: File) -> None:
    track, n = read_number(data, at)
    relative, flags = struct.unpack_from(">hB", data, at + n)
    kind = flags >> 1 & 3
    place, sizes = frame_sizes(data, at + n + 3, end, kind)
    step = out.frame_ns.get(track, 0)
    for i, size in enumerate(sizes):
        out.packets.append((track, (base + relative) * out.scale + i * step, place, size, keyframe, kind, len(out.clusters) - 1))
        place += size


def padded(text: str | None) -> tuple[int, bytes]:
    """The bytes of a text, and these with zeros up to a positive multiple of 64."""
    data = (text or "").encode("utf-8", "replace")
    return len(data), data + bytes(-len(data) % ALIGN if data else ALIGN)


def features(found: File, payload: bytes) -> str:
    """A line on the packet table and the samples, in whole numbers."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    total = squares = crossings = 0
    for a in range(0, len(samples), 1 << 20):
        x = samples[a : a + (1 << 20)].astype(np.int64) - 128
        total, squares, crossings = total + int(x.sum()), squares + int((x * x).sum()), crossings + int(np.count_nonzero(np.diff(x >= 0)))
    n = len(samples)
    starts = set(found.clusters)
    placed = sum(p in starts for _, _, p in found.cues)
    kinds = "/".join(str(sum(p[5] == k for p in found.packets)) for k in range(4))
    last = max((p[1] for p in found.packets), default=0)
    return f"packets={len(found.packets)};clusters={len(found.clusters)};cues={placed}/{len(found.cues)};lacing={kinds};last_ns={last};mean={total * 1000 // n};power={squares // n};crossings={crossings}"


def stored(text: str | None) -> tuple:
    """The digest columns of one text, stored as a Matroska file and read back."""
    n_bytes, payload = padded(text)
    media = write(payload)
    found = parse(media)
    back = b"".join(media[p[2] : p[2] + p[3]] for p in found.packets if p[0] == 1)
    return (n_bytes, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), features(found, back))


@F.pandas_udf(STORED)
def stored_columns(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        yield pd.DataFrame([stored(t) for t in batch], columns=STORED.names)


def media(docs: DataFrame) -> DataFrame:
    """doc_id and `media`, the text's payload as a Matroska file. Null and empty texts are 64 zero bytes; long ones are written whole; repeated rows are written each; no rows give none."""
    from pyspark.sql.types import BinaryType

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([write(padded(t)[1]) for t in batch])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.select("doc_id", F.pandas_udf(run, BinaryType())("text").alias("media"))


def readable(data: bytes | None) -> tuple[File, str | None]:
    """A file's tables, and what is wrong with it: null, or why reading stopped. Bytes without a packet are wrong too."""
    out = File()
    if not data:
        return out, None
    try:
        parse(data, out)
    except (ValueError, IndexError, KeyError, struct.error, OverflowError) as x:
        return out, f"{type(x).__name__}: {x}"
    return out, None if out.packets else "no packets"


def packets(files: DataFrame, key: str = "doc_id", content: str = "media") -> DataFrame:
    """The packet table of a column of Matroska files: the key, the columns of PACKET, and `error`.

    A null or empty file has no packets. A damaged or foreign one has the packets before the damage, if
    its segment is whole, and a row without packet that tells the `error`. Repeated keys are read each; no rows give none. Other columns,
    whatever their names, are not looked at.
    """
    told = StructType([*PACKET.fields, StructField("error", StringType())])

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            rows = []
            for data in batch:
                found, error = readable(data)
                held = [dict(zip(PACKET.names, p, strict=True)) | {"error": None} for p in found.packets]
                rows.append(held + ([dict.fromkeys(PACKET.names) | {"error": error}] if error else []))
            yield pd.Series(rows, dtype=object)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    table = F.pandas_udf(run, ArrayType(told))(content)
    return files.select(key, F.explode(table).alias("_packet")).select(key, "_packet.*")


def store_documents(docs: DataFrame) -> DataFrame:
    """doc_id and the digest columns of every document's text.

    Null text counts as empty and is stored as 64 zero bytes. Long texts are stored whole, in as many
    clusters as they need. Equal texts have equal values; repeated rows are stored each. Other columns,
    whatever their names, are not looked at. No rows give none.
    """
    return docs.select("doc_id", stored_columns("text").alias("_stored")).select("doc_id", "_stored.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_documents(read_table(spark, sf_dir, "documents"))
