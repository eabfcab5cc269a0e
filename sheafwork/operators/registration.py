"""Documents of a case: registration by content, audit, numbering of pages, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug

MAX_BYTES = 500 << 20


def verdict(content: Column, magic: bytes | None = b"%PDF", limit: int = MAX_BYTES) -> Column:
    """Why a delivery is rejected, or null: `vacio`, `muy_grande`, or `pdf_invalido` if the content does not start with `magic` after white space."""
    size = F.coalesce(F.octet_length(content), F.lit(0))
    out = F.when(size == 0, "vacio").when(size > limit, "muy_grande")
    if magic:
        start = F.ltrim(F.decode(F.substring(content.cast("binary"), 1, 64), "ISO-8859-1"))
        out = out.when(~start.startswith(magic.decode("latin-1")), "pdf_invalido")
    return out


def register(deliveries: DataFrame, magic: bytes | None = b"%PDF") -> DataFrame:
    """Deliveries (case_id, arrival, name, content) with `sha256`, `outcome` and `original`.

    `outcome` is `registrado` for the first arrival of a content in its case, `repetido` for later ones
    (with the first one's arrival in `original`), or the reason why it is rejected.
    """
    marked = deliveries.withColumn("outcome", verdict(F.col("content"), magic)).withColumn("sha256", F.sha2(F.coalesce(F.col("content").cast("binary"), F.lit(b"")), 256))
    good = marked.where("outcome IS NULL").groupBy("case_id", "sha256").agg(F.min("arrival").alias("_first"))
    joined = marked.join(good, ["case_id", "sha256"], "left")
    first = F.col("arrival") == F.col("_first")
    return joined.select(
        "case_id", "arrival", "name", "sha256", F.coalesce("outcome", F.when(first, "registrado").otherwise("repetido")).alias("outcome"),
        F.when(F.col("outcome").isNull() & ~first, F.col("_first")).alias("original"),
    )


def exceptions(registered: DataFrame) -> DataFrame:
    """The rejected deliveries, as rows for the table of exceptions."""
    return registered.where("outcome NOT IN ('registrado', 'repetido')").select("case_id", "arrival", "name", F.col("outcome").alias("class"))


def audit(registry: DataFrame, stored: DataFrame) -> DataFrame:
    """Each registered (case_id, doc_id, sha256) against the stored content (case_id, doc_id, content): `ok`, `alterado` or `ausente`."""
    now = stored.select("case_id", "doc_id", F.sha2(F.col("content").cast("binary"), 256).alias("_now"))
    state = F.when(F.col("_now").isNull(), "ausente").when(F.col("_now") == F.col("sha256"), "ok").otherwise("alterado")
    return registry.join(now, ["case_id", "doc_id"], "left").select("case_id", "doc_id", state.alias("state"))


def unread(pages: DataFrame, done: DataFrame, keys: tuple[str, ...] = ("case_id", "doc_id", "page_no")) -> DataFrame:
    """Pages that have not been processed."""
    return pages.join(done.select(*keys).distinct(), list(keys), "left_anti")


def replace_readings(readings: DataFrame) -> DataFrame:
    """The last version of each page's reading: (case_id, page_id, version, text, route, conf)."""
    columns = [c for c in readings.columns if c not in ("case_id", "page_id")]
    last = readings.groupBy("case_id", "page_id").agg(F.max_by(F.struct(*columns), "version").alias("_last"))
    return last.select("case_id", "page_id", "_last.*")


def offsets(documents: DataFrame) -> DataFrame:
    """Documents (case_id, doc_id, ord, n_pages) with the number of pages before them in their case."""
    before = Window.partitionBy("case_id").orderBy("ord", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    return documents.withColumn("page_offset", F.coalesce(F.sum("n_pages").over(before), F.lit(0)))


def number_pages(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages (case_id, doc_id, page_no) with `global_no`, their place in the whole case."""
    numbered = offsets(documents).select("case_id", "doc_id", "page_offset")
    return pages.join(numbered, ["case_id", "doc_id"]).withColumn("global_no", F.col("page_offset") + F.col("page_no")).drop("page_offset")


def same_documents(documents: DataFrame, wanted: DataFrame) -> DataFrame:
    """Per case, what an order (case_id, doc_id) leaves out and what it adds; an order is good where both are 0."""
    both = documents.select("case_id", "doc_id").withColumn("_a", F.lit(1)).join(wanted.select("case_id", "doc_id").withColumn("_b", F.lit(1)), ["case_id", "doc_id"], "full")
    return both.groupBy("case_id").agg(F.count_if(F.col("_b").isNull()).alias("left_out"), F.count_if(F.col("_a").isNull()).alias("added"))


def renumber(pieces: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Pieces (case_id, piece_id, page_start, page_end) with their ends carried over from the old to the new page numbers, by document and page."""
    moved = old.select("case_id", "doc_id", "page_no", F.col("global_no").alias("_old")).join(new.select("case_id", "doc_id", "page_no", F.col("global_no").alias("_new")), ["case_id", "doc_id", "page_no"])
    end = lambda c: moved.select("case_id", F.col("_old").alias(c), F.col("_new").alias(f"new_{c}"))
    return pieces.join(end("page_start"), ["case_id", "page_start"], "left").join(end("page_end"), ["case_id", "page_end"], "left")


def read_progress(pages: DataFrame) -> DataFrame:
    """Per document: pages, and pages that have text."""
    return pages.groupBy("case_id", "doc_id").agg(F.count("*").alias("pages"), F.count("text").alias("read"))


def case_summary(cases: DataFrame, documents: DataFrame, pages: DataFrame, pieces: DataFrame) -> DataFrame:
    """Per case: documents, pages, active pieces, and of those the included and pending ones. Each table is summed up before it is joined."""
    counts = lambda df, **aggs: df.groupBy("case_id").agg(*[a.alias(n) for n, a in aggs.items()])
    active = pieces.where("active")
    parts = [
        counts(documents, documents=F.count("*")), counts(pages, pages=F.count("*")),
        counts(active, pieces=F.count("*"), included=F.count_if(F.col("state") == "incluida"), pending=F.count_if(F.col("state") == "pendiente")),
    ]
    out = cases
    for part in parts:
        out = out.join(part, "case_id", "left")
    return out.fillna(0, ["documents", "pages", "pieces", "included", "pending"])


def case_keys(cases: DataFrame) -> DataFrame:
    """Cases (file_no, title, arrival) with a `slug` each; equal ones get -2, -3, … in order of arrival."""
    named = cases.withColumn("_base", slug(F.col("file_no"), F.col("title")))
    nth = F.row_number().over(Window.partitionBy("_base").orderBy("arrival"))
    return named.withColumn("_nth", nth).withColumn("slug", F.when(F.col("_nth") == 1, F.col("_base")).otherwise(F.concat_ws("-", "_base", F.col("_nth").cast("string")))).drop("_base", "_nth")
