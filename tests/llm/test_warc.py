import hashlib
import zlib

import pytest

from sheafwork.llm import warc


def test_round_trip_of_odd_pages(spark):
    body = "<p>ünï</p>" * 20
    rows = [(3, "http://a/\r\nX: y", body, "x"), (1, None, body, "x"), (1, "u", body, "x"), (2, "u", None, "x"), (4, "u", "", "x"), (None, "u", body, "x"),
            (5, "u", "short", "x"), (6, "u", "short", "x"), (7, "u", "WARC/1.1\r\n\r\n" * 9000, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_type string")
    got = sorted(map(tuple, warc.round_trip(pages).collect()), key=str)
    want = []
    for i, _, html, _ in rows:
        data = (html or "").encode()
        again = html == body and i != 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None, True))
    assert got == sorted(want, key=str)
    assert warc.round_trip(pages.limit(0)).collect() == []


def test_payloads_and_offsets(spark):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * i * 50) for i in range(40)], "page_id long, url string, html string")
    archives = warc.write_archives(warc.page_records(pages.coalesce(1))).collect()
    content = {a.archive: a.content for a in archives}
    records = warc.read_archives(spark.createDataFrame(archives, warc.ARCHIVES)).collect()
    assert {r.record_id: r.payload.decode() for r in records} == {f"urn:page:{i}": f"page {i} " * i * 50 for i in range(40)}
    for r in records:
        member = content[r.archive][r.offset : r.offset + r.length]
        assert zlib.decompress(member, 31).startswith(b"WARC/1.1\r\nWARC-Type: response")


def test_damage_is_found():
    good = warc.record("response", "urn:page:1", b"payload", 7, hashlib.sha256(b"payload").hexdigest())
    bad = warc.record("response", "urn:page:1", b"payload", 7, hashlib.sha256(b"other").hexdigest())
    assert [r["digest_ok"] for r in warc.parse("a", good + bad)] == [True, False]
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parse("a", good[:-4]))


def test_damaged_archives_become_error_rows(spark):
    one = warc.record("response", "urn:page:1", b"payload", 7, hashlib.sha256(b"payload").hexdigest())
    rows = [("good", one), ("cut", one + one[:-4]), ("foreign", b"not gzip at all"), ("plain", zlib.compress(b"no record", wbits=31)), ("empty", b""), ("none", None)]
    got = warc.read_archives(spark.createDataFrame(rows, warc.ARCHIVES)).collect()
    by = {}
    for r in got:
        by.setdefault(r.archive, []).append((r.record_id, bool(r.error)))
    assert by == {"good": [("urn:page:1", False)], "cut": [("urn:page:1", False), (None, True)], "foreign": [(None, True)], "plain": [(None, True)]}
