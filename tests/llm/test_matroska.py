import hashlib
import random
import struct
import zlib

import pytest

from sheafwork.llm import matroska as mk
from sheafwork.llm.common import read_table


def test_every_lacing_and_unknown_lengths():
    rng = random.Random(3)
    for _ in range(200):
        frames = [rng.randbytes(rng.choice([1, 7, 254, 255, 256, 600, 5000])) for _ in range(rng.randrange(1, 9))]
        kind, head = mk.laced(frames)
        at, sizes = mk.frame_sizes(head + b"".join(frames), 0, len(head) + sum(map(len, frames)), kind)
        assert at == len(head) and sizes == [len(f) for f in frames]
    block = mk.simple_block(1, 5, [b"abc", b"d"])
    group = mk.element(mk.BLOCK_GROUP, mk.element(mk.BLOCK, mk.number(2) + struct.pack(">hB", -1, 0) + b"xyz") + mk.unsigned(mk.BLOCK_DURATION, 9))
    cluster = b"\x1f\x43\xb6\x75\xff" + mk.unsigned(mk.TIMESTAMP, 10) + block + mk.element(0xEC, b"\0" * 300) + group
    data = b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster + cluster
    found = mk.parse(data)
    assert [(p[0], p[1], data[p[2] : p[2] + p[3]], p[6]) for p in found.packets] == [
        (1, 15_000_000, b"abc", 0), (1, 15_000_000, b"d", 0), (2, 9_000_000, b"xyz", 0), (1, 15_000_000, b"abc", 1), (1, 15_000_000, b"d", 1), (2, 9_000_000, b"xyz", 1)]
    with pytest.raises(ValueError, match="cut off"):
        mk.parse(mk.write(b"x" * 640)[:-3])


def test_many_clusters_of_unknown_length():
    import time

    cluster = b"\x1f\x43\xb6\x75\xff" + mk.unsigned(mk.TIMESTAMP, 1) + mk.simple_block(1, 0, [b"ab"])
    begun = time.perf_counter()
    found = mk.parse(b"\x18\x53\x80\x67\x01\xff\xff\xff\xff\xff\xff\xff" + cluster * 10_000)
    assert len(found.clusters) == len(found.packets) == 10_000 and time.perf_counter() - begun < 5


def test_query_against_brute_force(spark, sf):
    texts = {r.doc_id: r.text for r in read_table(spark, sf, "documents").collect()}
    rows = mk.query(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        data = texts[r.doc_id].encode()
        pay = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pay), hashlib.sha256(pay).hexdigest(), zlib.crc32(pay[-64:]))
        assert r.media_bytes > r.payload_bytes and f"packets={-(-len(pay) // mk.FRAME)};" in r.feature


def test_odd_rows_and_packet_table(spark, odd, docs):
    rows = {r.doc_id: r for r in mk.store_documents(odd).collect()}
    assert (rows[2].n_bytes, rows[2].payload_bytes) == (0, 64) and rows[2].media_sha256 == rows[3].media_sha256
    assert rows[1].media_sha256 == rows[6].media_sha256
    assert mk.store_documents(docs([])).collect() == []
    files = mk.media(odd)
    table = mk.packets(files).where("doc_id = 5").orderBy("timestamp_ns").collect()
    content = files.where("doc_id = 5").first().media
    back = b"".join(content[p.offset : p.offset + p.size] for p in table)
    assert hashlib.sha256(back).hexdigest() == rows[5].payload_sha256
    steps = {b.timestamp_ns - a.timestamp_ns for a, b in zip(table, table[1:], strict=False)}
    assert steps == {mk.FRAME * 10**9 // mk.RATE}
    found = mk.parse(content)
    assert [c[2] for c in found.cues] == found.clusters and len(found.clusters) > 3


def test_damaged_files_become_error_rows(spark):
    rng = random.Random(7)
    good = mk.write(b"x" * 6400)
    rows = [(0, good), (1, None), (2, b""), (3, good[: len(good) // 2]), (4, b"RIFF....WAVEfmt "), (5, rng.randbytes(500))]
    rows += [(10 + i, bytes(b ^ (rng.random() < 0.01) * rng.randrange(1, 256) for b in good)) for i in range(40)]
    out = mk.packets(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(r.error is None for r in by[0]) and 1 not in by and 2 not in by
    assert by[3][-1].error and by[3][-1].offset is None and len(by[3]) == 1
    assert by[4][-1].error and by[5][-1].error
    assert all(sum(r.error is not None for r in v) <= 1 for v in by.values())
    assert any(len(v) > 1 and v[-1].error for v in by.values())
