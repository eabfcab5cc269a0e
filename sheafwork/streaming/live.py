"""Streaming twins of batch operators. Each gives what its batch twin gives over all input seen so far, with work in proportion to a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..operators.checklist import COUNTERS, FIRM, LOW, counters
from ..operators.decisions import FIELDS, PENDING
from ..operators.lineage import SWITCHES
from ..operators.segmentation import TEXT, Cutter, finished, mark_pages, titled

#: The store that keyed state needs.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def intake(deliveries: DataFrame) -> DataFrame:
    """Accepted contents of a stream of deliveries, each content of a case once and for ever."""
    marked = deliveries.withColumn("sha256", F.sha2(F.col("content").cast("binary"), 256))
    return marked.where("content IS NOT NULL AND length(content) > 0").dropDuplicates(["case_id", "sha256"]).select("case_id", "sha256")


def live_states(log: DataFrame) -> DataFrame:
    """The state of each piece from a stream of decisions, by the order of their numbers and not of their arrival (update mode)."""
    return log.where("field = 'state'").groupBy("case_id", "piece_id").agg(F.max_by("new", "seq").alias("state"))


def live_fold(log: DataFrame) -> DataFrame:
    """The fold of a stream of log rows: of each piece the last state, the last value of every field a person sets, its group, and the last event that switched it (update mode).

    Spark keeps a value and its number for each of them, so a late row with a smaller number changes nothing,
    and a batch costs what its own pieces cost.
    """
    value = lambda f: F.struct((F.nullif(F.trim("new"), F.lit("")) if f in FIELDS else F.col("new")).alias("v"))
    of = lambda f: F.max_by(F.when(F.col("field") == f, value(f)), F.when(F.col("field") == f, F.col("seq")))
    turn = F.col("field").isin(*SWITCHES)
    names = ("state", "group_id", *FIELDS)
    folded = log.groupBy("case_id", "piece_id").agg(*[of(f).alias(f"_{f}") for f in names], F.max_by(F.when(turn, F.col("field")), F.when(turn, F.col("seq"))).alias("switch"))
    return folded.select("case_id", "piece_id", F.coalesce("_state.v", F.lit(PENDING)).alias("state"), *[F.col(f"_{f}.v").alias(f) for f in names[1:]], "switch")


def live_counters(log: DataFrame) -> DataFrame:
    """Decisions of a stream by case and kind (update or complete mode)."""
    return log.groupBy("case_id", "field", "new").agg(F.count("*").alias("n"))


# --- counters by deltas -----------------------------------------------------------------------------

NAMES = ("detectadas", *COUNTERS)
#: What the counters need to know of a piece before any decision.
BASE = "active boolean, introduced boolean, numbered boolean, origin_start string, origin_end string, open_end boolean, guessed_start boolean, guessed_end boolean, confidence double"
_FOLDED = ("state", "type_final", "description_final", "number_start_final", "number_end_final")


def flags(base: tuple, values: dict) -> list[int]:
    """Which counters a piece is in, as 0 and 1 in the order of `NAMES`."""
    active, introduced, numbered, origin_start, origin_end, open_end, guessed_start, guessed_end, confidence = base
    if not active:
        return [0] * len(NAMES)
    state = values.get("state") or PENDING
    typed_start, typed_end = values.get("number_start_final") is not None, values.get("number_end_final") is not None
    start = "manual" if typed_start else origin_start
    end = "manual" if typed_end else start if open_end else origin_end
    firm = start in FIRM and end in FIRM
    bits = {
        "detectadas": True, "incluidas": state == "incluida", "excluidas": state == "excluida", "pendientes": state == PENDING, "sin_testigo": not introduced,
        "sin_foja": not (numbered or typed_start), "foja_sin_confirmar": not firm, "foja_interpolada": (guessed_start and not typed_start) or (guessed_end and not typed_end),
        "baja_confianza": confidence is not None and confidence == confidence and confidence < LOW, "modificadas": any(values.get(f) is not None for f in _FOLDED[1:]),
        "incluidas_sin_testigo": state == "incluida" and not introduced, "incluidas_sin_foja_firme": state == "incluida" and not firm,
    }
    return [int(bits[n]) for n in NAMES]


#: Pieces whose ids differ only in this many low bits share a key, so that state is called for once for all of them.
SHELF = 10
_BASE_NAMES = [f.split()[0] for f in BASE.split(", ")]


class Deltas(StatefulProcessor):
    """Keyed by case and shelf, which is 1,024 ids of pieces: of each piece what it is without decisions, and the last value of each field with its number. A batch of a shelf gives what it takes from and adds to the counters of its case."""

    def init(self, handle) -> None:
        self.base = handle.getValueState("base", f"pieces array<struct<piece_id: bigint, {BASE.replace(' ', ': ')}>>".replace(",:", ","))
        self.values = handle.getValueState("values", "last array<struct<piece_id: bigint, field: string, value: string, seq: bigint>>")

    def handleInitialState(self, key, rows, timers) -> None:
        held = list(self.base.get()[0]) if self.base.exists() else []
        columns = [rows[c].astype(object).where(rows[c].notna(), None) for c in _BASE_NAMES]
        self.base.update(([*held, *((int(i), *rest) for i, *rest in zip(rows["piece_id"], *columns, strict=True))],))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        known: dict[int, dict] = {}
        for piece, field, value, seq in self.values.get()[0] if self.values.exists() else []:
            known.setdefault(piece, {})[field] = (value, seq)
        before: dict[int, dict] = {}
        for table in rows:
            # of each piece and field only the last row counts
            own = table[table["field"].isin(_FOLDED)].sort_values("seq", ascending=False, kind="stable").drop_duplicates(["piece_id", "field"])
            for piece, field, new, seq in zip(own["piece_id"], own["field"], own["new"], own["seq"], strict=True):
                values = known.setdefault(int(piece), {})
                before.setdefault(int(piece), dict(values))
                if seq > values.get(field, (None, float("-inf")))[1]:
                    values[field] = (None if new is None or new != new else str(new) if field == "state" else str(new).strip() or None, int(seq))
        if not before:
            return
        self.values.update(([(p, f, *last) for p, values in known.items() for f, last in values.items()],))
        plain = lambda values: {f: v for f, (v, _) in values.items()}
        change = [0] * len(NAMES)
        for piece, *base in self.base.get()[0] if self.base.exists() else []:
            if piece in before:
                change = [n + b - a for n, a, b in zip(change, flags(base, plain(before[piece])), flags(base, plain(known[piece])), strict=True)]
        if any(change):
            yield pd.DataFrame([(key[0], *change)], columns=["case_id", *NAMES])

    def close(self) -> None:
        pass


def checklist_counters(log: DataFrame, start: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream that keeps the checklist's twelve counters of each case up to date; `path` gets a row for each case and batch.

    `start` is the view before any decision of the stream, of pieces without final values; it is counted and
    loaded into the state once. A batch reads its own rows, the state of their pieces, and the counters of the
    batch before. A batch that is run again writes to its own place. Decisions on pieces that are not in
    `start` change nothing.
    """
    spark = log.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    shelf = F.shiftright(F.col("piece_id").cast("long"), SHELF).alias("shelf")
    seen = start.select(
        "case_id", shelf, "piece_id", "active", F.col("introducer_id").isNotNull().alias("introduced"), F.col("number_start").isNotNull().alias("numbered"), "origin_start", "origin_end",
        F.col("page_end").isNull().alias("open_end"), "guessed_start", "guessed_end", "confidence",
    ).where("piece_id IS NOT NULL")
    cases = start.select("case_id").distinct()

    def run(deltas: DataFrame, number: int) -> None:
        if number:
            before = spark.read.parquet(f"{path}/batch={number - 1}")
        else:
            before = counters(cases, start)
        added = deltas.groupBy("case_id").agg(*[F.sum(n).alias(f"_{n}") for n in NAMES])
        now = before.join(added, "case_id", "left").select("case_id", *[(F.col(n) + F.coalesce(f"_{n}", F.lit(0))).alias(n) for n in NAMES])
        now.write.mode("overwrite").parquet(f"{path}/batch={number}")

    changed = log.where("piece_id IS NOT NULL").select("case_id", shelf, "piece_id", "seq", "field", "new").groupBy("case_id", "shelf").transformWithStateInPandas(
        statefulProcessor=Deltas(), outputStructType="case_id string, " + ", ".join(f"{n} long" for n in NAMES), outputMode="Update", timeMode="None", initialState=seen.groupBy("case_id", "shelf")
    )
    return changed.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# --- proposals --------------------------------------------------------------------------------------

PAGE = "global_no long, text string, type string, score double, title string, continues boolean, n int, m int, conf double"
OPEN = "doc_id long, next int, waiting int, piece int, previous long, kind string, last_n int, last_m int, page_start long, page_end long, type string, score double, title string, read_conf double, source_text string"
PIECE = "case_id string, doc_id long, page_start long, page_end long, type string, score double, title string, read_conf double, source_text string, closed boolean"
#: Documents whose ids differ only in this many low bits share a key. A batch with a page of one of them writes the open pieces of all anew, so they are fewer than pieces on a shelf.
DOCUMENTS = 8
_PAGE_NAMES = [f.split()[0] for f in PAGE.split(", ")]


class Document:
    """A document while pages of it come: the next page to be cut, how many wait in the state, the open piece, the last sheet counter, and pages of this batch that came before their turn."""

    def __init__(self, case_id, doc_id, following=1, waiting=0, number=-1, previous=None, kind=None, last_n=None, last_m=None, *piece):
        self.key, self.following, self.waiting, self.early, self.cutter = (case_id, doc_id), following, waiting, {}, Cutter()
        self.cutter.piece, self.cutter.previous, self.cutter.kind = number, previous, kind
        self.cutter.last = None if last_n is None else (last_n, last_m)
        self.piece = list(piece) if piece and piece[0] is not None else None

    def take(self, page: tuple) -> list[tuple]:
        """Cuts the next page; the piece that it closes, if any."""
        self.following += 1
        global_no, text, kind, score, title, continues, n, m, conf = page
        if text is None:  # a page that is not to be cut: what follows it begins anew
            closed, self.piece, self.cutter.previous = self.piece, None, None
            return [(*self.key, *closed, True)] if closed else []
        number = self.cutter.piece
        if self.cutter.step(int(global_no), kind, float(score), bool(continues), n, m) != number or self.piece is None:
            closed, self.piece = self.piece, [int(global_no), int(global_no), kind, float(score), title, float(conf), text]
            return [(*self.key, *closed, True)] if closed else []
        self.piece[1], self.piece[5], self.piece[6] = int(global_no), min(self.piece[5], float(conf)), f"{self.piece[6]} {text}"[:TEXT]
        return []

    def held(self) -> tuple:
        last, previous = self.cutter.last or (None, None), self.cutter.previous
        return (self.key[1], self.following, self.waiting, self.cutter.piece, None if previous is None else int(previous), self.cutter.kind, *last, *(self.piece or [None] * 7))


class Documents(StatefulProcessor):
    """Keyed by case and shelf, which is 256 ids of documents: of each document what `Document` holds, and the pages that came before their turn. Pages are cut in order; a piece goes out when it grows and once more when it is closed."""

    def init(self, handle) -> None:
        self.open = handle.getValueState("open", f"documents array<struct<{OPEN.replace(' ', ': ').replace(',:', ',')}>>")
        self.early = handle.getMapState("early", "doc_id long, page_no int", PAGE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        nothing = lambda x: None if x is None or x != x else x
        number = lambda x, t: None if x is None else t(x)
        known = {d[0]: tuple(d) for d in self.open.get()[0]} if self.open.exists() else {}
        came: dict[int | None, Document] = {}
        out = []
        for table in rows:
            for doc, page_no, *page in zip(*[table[c] for c in ("doc_id", "page_no", *_PAGE_NAMES)], strict=True):
                doc = number(nothing(doc), int)
                if doc not in came:
                    came[doc] = Document(key[0], doc, *known.get(doc, ())[1:])
                document = came[doc]
                if page_no >= document.following:
                    document.early[int(page_no)] = tuple(nothing(x) for x in page)
                # a page in its turn is cut at once, so that only those before their turn are held
                while not document.waiting and document.following in document.early:
                    out += document.take(document.early.pop(document.following))
        for doc, document in came.items():
            while document.waiting or document.following in document.early:
                at, page = (doc, document.following), document.early.pop(document.following, None)
                if document.waiting and self.early.containsKey(at):
                    page = page or tuple(nothing(x) for x in self.early.getValue(at))
                    self.early.removeKey(at)
                    document.waiting -= 1
                if page is None:
                    break
                out += document.take(page)
            stored = document.waiting
            for page_no, page in document.early.items():
                document.waiting += not (stored and self.early.containsKey((doc, page_no)))
                self.early.updateValue((doc, page_no), (int(page[0]), page[1], page[2], number(page[3], float), page[4], number(page[5], bool), number(page[6], int), number(page[7], int), number(page[8], float)))
            if document.piece:
                out.append((*document.key, *document.piece, False))
        self.open.update(([*(d for doc, d in known.items() if doc not in came), *(document.held() for document in came.values())],))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in PIECE.split(", ")])

    def close(self) -> None:
        pass


def proposals(pages: DataFrame, rules: list, covered: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """A stream that writes proposals for pages (case_id, doc_id, page_no, global_no, text, conf) which no piece covers; `latest` reads what holds.

    The pages of a document are cut in the order of `page_no`, from 1. A page that comes early waits in the
    state of its shelf of documents, so a batch reads its own pages and no others. A piece that grows is written again;
    what was closed stays. Pages without text, or in `covered` (case_id, global_no), end a piece and are in
    none. A page that comes twice counts once. A batch that is run again writes to its own place.
    """
    pages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    marked = mark_pages(pages, rules, "page_no").withColumn("title", titled(F.col("text"), F.col("type"), rules))
    done = covered.select("case_id", "global_no", F.lit(True).alias("_covered")).distinct()
    rows = marked.join(done, ["case_id", "global_no"], "left").withColumn("text", F.when(F.col("_covered").isNull(), F.left("text", F.lit(TEXT))))
    shelf = F.shiftright(F.col("doc_id").cast("long"), DOCUMENTS).alias("shelf")
    cut_up = rows.select("case_id", shelf, "doc_id", "page_no", *_PAGE_NAMES).groupBy("case_id", "shelf").transformWithStateInPandas(statefulProcessor=Documents(), outputStructType=PIECE, outputMode="Update", timeMode="None")

    def run(pieces: DataFrame, number: int) -> None:
        finished(pieces).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return cut_up.writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(proposed: DataFrame) -> DataFrame:
    """Of proposals by batch the last of each piece, which its document and first page tell."""
    keys = ["case_id", "doc_id", "page_start"]
    rest = [c for c in proposed.columns if c not in (*keys, "batch")]
    last = proposed.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", "page_end")).alias("_l"))
    return last.select(*keys, "_l.*")
