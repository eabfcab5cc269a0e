"""WARC archives: written with one gzip member per record, read back sequentially.

Archives are rows of a table (`archive`, `content` binary), which any store that Spark writes to can
hold; `read_archives` takes the same columns, so `.warc.gz` files read with Spark's binaryFile source
go through it as well (path and content).
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StringType, StructField, StructType
from pyspark.sql.types import BinaryType

from .common import cut, read_table

#: Payloads below this many bytes are always stored.
LEAST_BYTES = 100
#: An archive is closed once it holds this much.
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 16

ARCHIVES = StructType([StructField("archive", StringType()), StructField("content", BinaryType())])
RECORDS = StructType([
    StructField("archive", StringType()), StructField("offset", LongType()), StructField("length", LongType()), StructField("record_type", StringType()),
    StructField("record_id", StringType()), StructField("url", StringType()), StructField("refers_to", StringType()), StructField("payload_digest", StringType()),
    StructField("payload_bytes", LongType()), StructField("digest_ok", BooleanType()), StructField("payload", BinaryType()), StructField("error", StringType()),
])


def record(kind: str, record_id: str, payload: bytes | None, size: int, digest: str, url: str | None = None, refers_to: str | None = None) -> bytes:
    """One record as one gzip member. A revisit has the HTTP header of the page and no body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    fields = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)))
    if kind == "revisit":
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    member = zlib.compressobj(6, zlib.DEFLATED, 31)
    return member.compress(head.encode("utf-8") + block + b"\r\n\r\n") + member.flush()


def members(content: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, data) of each gzip member in turn, inflated a piece at a time."""
    view, at = memoryview(content), 0
    while at < len(view):
        inflate, out, pos = zlib.decompressobj(31), [], at
        while not inflate.eof:
            if pos >= len(view):
                raise ValueError(f"gzip member at byte {at} is cut off")
            piece = view[pos : pos + READ]
            out.append(inflate.decompress(piece))
            pos += len(piece)
        end = pos - len(inflate.unused_data)
        yield at, end - at, b"".join(out)
        at = end


def fields_of(lines: bytes) -> dict[str, str]:
    pairs = (x.partition(b":") for x in lines.split(b"\r\n")[1:] if x)
    return {k.strip().lower().decode(): v.strip().decode("utf-8", "replace") for k, _, v in pairs}


def parse(archive: str, content: bytes) -> Iterator[dict]:
    """The records of an archive, framed by Content-Length; `digest_ok` tells if the block, and a stored payload, have their digests."""
    for offset, length, data in members(content):
        head_end = data.index(b"\r\n\r\n") + 4
        if not data.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at byte {offset}")
        head = fields_of(data[:head_end])
        size = int(head["content-length"])
        block = data[head_end : head_end + size]
        if len(block) != size or data[head_end + size :] != b"\r\n\r\n":
            raise ValueError(f"record at byte {offset} is not framed by its Content-Length")
        http_end = block.find(b"\r\n\r\n") + 4
        payload, kind = block[http_end:], head["warc-type"]
        digest = head.get("warc-payload-digest", "").removeprefix("sha256:")
        good = head.get("warc-block-digest") == f"sha256:{hashlib.sha256(block).hexdigest()}"
        if kind == "response":
            good &= digest == hashlib.sha256(payload).hexdigest()
        yield {
            "archive": archive, "offset": offset, "length": length, "record_type": kind, "record_id": head["warc-record-id"].strip("<>"), "url": head.get("warc-target-uri"),
            "refers_to": head["warc-refers-to"].strip("<>") if kind == "revisit" else None, "payload_digest": digest,
            "payload_bytes": int(fields_of(block[:http_end]).get("content-length", len(payload))), "digest_ok": good, "payload": payload if kind == "response" else None, "error": None,
        }


def records_of(archive: str, content: bytes) -> Iterator[dict]:
    """The records of an archive up to the first damaged one, and then a row that tells the `error` and has nothing else but the archive. A null archive has no records."""
    try:
        yield from parse(archive, content or b"")
    except (ValueError, KeyError, IndexError, zlib.error) as x:
        yield dict.fromkeys(RECORDS.names) | {"archive": archive, "error": f"{type(x).__name__}: {x}", "payload_bytes": 0}


def write_archives(rows: DataFrame) -> DataFrame:
    """(archive, content) from rows of record_type, record_id, url, refers_to, payload (binary, null for a revisit), payload_bytes, payload_digest."""

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                url, refers = (x if isinstance(x, str) else None for x in (r.url, r.refers_to))
                held.append(record(r.record_type, r.record_id, r.payload, int(r.payload_bytes), r.payload_digest, url, refers))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    content = b"".join(held)
                    yield pd.DataFrame({"archive": [hashlib.sha256(content).hexdigest()[:32]], "content": [content]})
                    held, size = [], 0
        if held:
            content = b"".join(held)
            yield pd.DataFrame({"archive": [hashlib.sha256(content).hexdigest()[:32]], "content": [content]})

    return rows.select("record_type", "record_id", "url", "refers_to", "payload", "payload_bytes", "payload_digest").mapInPandas(pack, ARCHIVES)


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of archives (archive, content), one archive at a time, some records to a batch. A damaged archive ends with a row that tells its `error` (`records_of`); no archives give no rows."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["archive"], batch["content"], strict=True):
                held, size = [], 0
                for r in records_of(name, content):
                    size += r["payload_bytes"]
                    held.append(r if payloads else r | {"payload": None})
                    if len(held) >= 1000 or size > 8 << 20:
                        yield pd.DataFrame(held, columns=RECORDS.names)
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=RECORDS.names)

    return archives.select("archive", "content").mapInPandas(unpack, RECORDS)


def page_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Rows for `write_archives`. Of pages with equal payloads of at least `least_bytes`, the smallest page_id is a response, the others revisit it.

    Null html is an empty payload; long ones are stored whole. Rows that repeat the smallest page_id are
    responses all. A null page_id revisits the smallest one that is not null; where all are null, all are
    responses. Other columns, whatever their names, are not looked at. No rows give none.

    Equal payloads are found on digests alone. Bodies are then joined by page and digest, so that a payload
    that many pages share is spread over all of them.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    rows = pages.select("page_id", name("page_id").alias("record_id"), "url", body.alias("_body")).withColumns(
        {"payload_bytes": F.octet_length("_body").cast("long"), "payload_digest": F.sha2("_body", 256)}
    )
    slim = rows.where(F.col("payload_bytes") >= least_bytes).select("page_id", "record_id", "payload_digest")
    first = cut(slim.groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count("*").alias("_n")).where("_n > 1 AND _first IS NOT NULL"))
    again = slim.join(first, "payload_digest").where(~F.col("page_id").eqNullSafe(F.col("_first"))).select("record_id", "payload_digest", name("_first").alias("refers_to"))
    joined = rows.join(cut(again.distinct()), ["record_id", "payload_digest"], "left")
    revisits = F.col("refers_to").isNotNull()
    return joined.select(
        F.when(revisits, "revisit").otherwise("response").alias("record_type"), "record_id", "url", "refers_to",
        F.when(~revisits, F.col("_body")).alias("payload"), "payload_bytes", "payload_digest",
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Pages written as archives, cut off in the shared folder, and read back: page_id, payload_bytes, payload_digest, record_type, refers_to, digest_ok. Odd rows are as in `page_records`."""
    number = lambda c: F.expr(f"try_cast(substr({c}, 10) AS BIGINT)")
    return read_archives(cut(write_archives(page_records(pages))), payloads=False).select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), F.coalesce("digest_ok", F.lit(False)).alias("digest_ok")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "pages"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS lo FROM d)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND lo IS DISTINCT FROM page_id AND lo IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND lo IS DISTINCT FROM page_id THEN lo END AS refers_to, TRUE AS digest_ok
FROM f
"""
