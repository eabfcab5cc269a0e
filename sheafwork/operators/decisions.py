"""The append-only log of decisions, and its fold into the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_text
from ..plans.graph import cut, few_reached, reached
from .lineage import active_descendants, last_switch, tainted

#: Active descendants of a piece that are looked at before all are.
WITNESSES = 4

# The three states, the fields that a person may set, what halves and bulk changes are called, and the warning of a merge.
INCLUDED, EXCLUDED, PENDING = "incluida", "excluida", "pendiente"
STATES = (INCLUDED, EXCLUDED, PENDING)
FIELDS = ("type_final", "subtype_final", "description_final", "number_start_final", "number_end_final", "date", "notes")
HALVES, BULK, MIXED = ("(primera parte)", "(segunda parte)"), "cambio en lote", "union_de_tipos_distintos"


def last(log: DataFrame, field: str, keys: tuple[str, ...] = ("case_id", "piece_id")) -> DataFrame:
    """The last value of a field for each key, nulls included: keys and a column named like the field. Order is by `seq`, not by arrival."""
    rows = log.where(F.col("field") == field).groupBy(*keys).agg(F.max_by(F.struct("new"), "seq").alias("_last"))
    return rows.select(*keys, F.col("_last.new").alias(field))


def finals(log: DataFrame, fields: tuple[str, ...] = FIELDS) -> DataFrame:
    """The last value of each of some fields, one column for each; a blank value counts as none. One shuffle for all fields."""
    value = F.struct(F.nullif(F.trim("new"), F.lit("")).alias("v"))
    picked = [F.max_by(F.when(F.col("field") == f, value), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}") for f in fields]
    rows = log.where(F.col("field").isin(*fields)).groupBy("case_id", "piece_id").agg(*picked)
    return rows.select("case_id", "piece_id", *[F.col(f"_{f}.v").alias(f) for f in fields])


def states(pieces: DataFrame, log: DataFrame) -> DataFrame:
    """Pieces with their state: the last decision, or pending."""
    return pieces.join(last(log, "state"), ["case_id", "piece_id"], "left").withColumn("state", F.coalesce("state", F.lit(PENDING)))


def validate(requests: DataFrame, pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """Requests (case_id, piece_id, new) with their `outcome`: `aceptada`, `sin_cambio`, `inexistente`, `inactiva`, `procedencia_excluida` or `estado_desconocido`.

    A piece with excluded ancestors cannot be included, not even if it is already. With a column `batch`, requests of one batch stand
    or fall together: one that must not be included refuses all others too (`lote_rechazado`).
    """
    asked = requests.join(pieces.select("case_id", "piece_id", "state", "active"), ["case_id", "piece_id"], "left")
    marked = asked.join(tainted(edges, pieces).withColumn("_tainted", F.lit(True)), ["case_id", "piece_id"], "left")
    bad = F.coalesce((F.col("new") == INCLUDED) & F.col("_tainted"), F.lit(False))
    outcome = (
        F.when(F.col("new").isNull() | ~F.col("new").isin(*STATES), "estado_desconocido").when(F.col("active").isNull(), "inexistente").when(~F.col("active"), "inactiva")
        .when(bad, "procedencia_excluida").when(F.col("state") == F.col("new"), "sin_cambio").otherwise("aceptada")
    )
    if "batch" not in requests.columns:
        return marked.select("case_id", "piece_id", "new", outcome.alias("outcome"))
    refused = marked.where(bad).select("case_id", "batch", F.lit(True).alias("_refused")).distinct()
    whole = marked.join(refused, ["case_id", "batch"], "left")
    return whole.select("case_id", "batch", "piece_id", "new", F.when(F.col("_refused"), F.when(bad, "procedencia_excluida").otherwise("lote_rechazado")).otherwise(outcome).alias("outcome"))


def editable(log: DataFrame, types: tuple[str, ...], pieces: DataFrame) -> DataFrame:
    """Edits of active pieces, without those that give a type outside the rules; a blank type is an edit, as it brings back what was detected."""
    value = F.coalesce(F.trim("new"), F.lit(""))
    good = log.where((F.col("field") != "type_final") | (value == "") | value.isin(*types))
    return good.join(pieces.where("active").select("case_id", "piece_id"), ["case_id", "piece_id"], "left_semi")


def change_log(log: DataFrame, first: Column | None = None) -> DataFrame:
    """The log with `old`, the value before each change; changes that change nothing are left out. With a column `batch`, null for single changes, `detail` tells changes of many pieces at once."""
    order = Window.partitionBy("case_id", "piece_id", "field").orderBy("seq")
    old = F.lag(F.struct("new")).over(order)["new"]
    before = F.when(F.row_number().over(order) == 1, first if first is not None else F.lit(None).cast("string")).otherwise(old)
    out = log.withColumn("old", before).where(~F.col("old").eqNullSafe(F.col("new")))
    return out.withColumn("detail", F.when(F.col("batch").isNotNull(), BULK)).drop("batch") if "batch" in log.columns else out


def groups_of(pieces: DataFrame, log: DataFrame, groups: DataFrame) -> DataFrame:
    """Pieces with the group last assigned, null where it is gone from `groups` (case_id, group_id)."""
    moved = pieces.select("case_id", "piece_id").join(last(log, "group_id"), ["case_id", "piece_id"], "left").withColumn("group_id", F.col("group_id").try_cast("long"))
    there = groups.select("case_id", "group_id", F.lit(True).alias("_there"))
    return moved.join(there, ["case_id", "group_id"], "left").select("case_id", "piece_id", F.when(F.col("_there"), F.col("group_id")).alias("group_id"))


def append_order(moved: DataFrame, existing: DataFrame) -> DataFrame:
    """New members (case_id, group_id, piece_id, seq) numbered on from the largest order that each group has."""
    top = existing.groupBy("case_id", "group_id").agg(F.max("order_in_group").alias("_top"))
    nth = F.row_number().over(Window.partitionBy("case_id", "group_id").orderBy("seq"))
    return moved.join(top, ["case_id", "group_id"], "left").withColumn("order_in_group", F.coalesce("_top", F.lit(0)) + nth).drop("_top")


def tags(log: DataFrame) -> DataFrame:
    """Tags (case_id, piece_id, tag) whose last operation (`add` or `remove`) adds them."""
    rows = log.groupBy("case_id", "piece_id", "tag").agg(F.max_by("op", "seq").alias("op"))
    return rows.where("op = 'add'").drop("op")


def links(log: DataFrame) -> DataFrame:
    """Links of pieces to persons from a log of seq, case_id, piece_id, person_id, function, op. A piece has one introducer, the last one linked."""
    one = log.where("function = 'introductor'").groupBy("case_id", "piece_id").agg(F.max_by(F.struct("op", "person_id"), "seq").alias("_l")).where("_l.op = 'add'").select("case_id", "piece_id", F.col("_l.person_id").alias("person_id"), F.lit("introductor").alias("function"))
    many = log.where("function <> 'introductor'").groupBy("case_id", "piece_id", "person_id", "function").agg(F.max_by("op", "seq").alias("op")).where("op = 'add'").drop("op")
    return one.unionByName(many)


def manual_pieces(requests: DataFrame) -> DataFrame:
    """Requests for pieces by hand (case_id, request, page_start, page_end, description, number_start): their outcome, and blank numbers as null. Confidence is null for these."""
    end = F.coalesce("page_end", "page_start")
    outcome = F.when(F.coalesce(F.trim("description"), F.lit("")) == "", "sin_descripcion").when(F.col("page_start").isNull() | (end < F.col("page_start")), "rango_invalido").otherwise("creada")
    return requests.select("case_id", "request", "page_start", end.alias("page_end"), F.trim("description").alias("description"), F.nullif(F.trim("number_start"), F.lit("")).alias("number_start"), outcome.alias("outcome"), F.lit("manual").alias("origin"))


def _effective(pieces: DataFrame, name: str) -> Column:
    final = f"{name}_final"
    return F.coalesce(final, name) if final in pieces.columns else F.col(name)


def labelled(ranges: DataFrame, pages: DataFrame) -> DataFrame:
    """Ranges (case_id, page_start, page_end) with the printed numbers of their first and last page, `number_start` and `number_end`, null where a page has none."""
    label = lambda c, n: pages.select("case_id", F.col("global_no").alias(c), label_text(F.col("num"), F.col("suffix")).alias(n))
    return ranges.join(label("page_start", "number_start"), ["case_id", "page_start"], "left").join(label("page_end", "number_end"), ["case_id", "page_end"], "left")


def split(pieces: DataFrame, at: DataFrame, pages: DataFrame, edges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The halves of pieces cut before a page (case_id, piece_id, page), and edges to them (case_id, parent, child_no).

    The page lies after the start and not after the end, and the piece is neither excluded nor, by `edges`,
    descended from an excluded one; others are passed over. Halves are pending and have the document, the
    present type, the present description with their part, notes, warnings, group, date, confidence and
    order of the piece, and the printed numbers of their own ends. Their text is cut anew from the pages
    (`segmentation.range_texts`), and their persons are those of the piece (`inherited_links`).
    """
    good = pieces.join(at, ["case_id", "piece_id"]).where("active AND state <> 'excluida' AND page > page_start AND page <= page_end")
    if edges is not None:
        good = good.join(tainted(edges, pieces), ["case_id", "piece_id"], "left_anti")
    half = lambda n, a, b: F.struct(F.lit(n).alias("half"), F.lit(HALVES[n - 1]).alias("name"), a.alias("start"), b.alias("end"))
    both = good.withColumn("_h", F.explode(F.array(half(1, F.col("page_start"), F.col("page") - 1), half(2, F.col("page"), F.col("page_end")))))
    halves = both.select(
        "case_id", F.col("piece_id").alias("parent"), F.col("_h.half").alias("half"), F.col("_h.start").alias("page_start"), F.col("_h.end").alias("page_end"), "doc_id", _effective(pieces, "type").alias("type"),
        F.trim(F.concat(F.coalesce(_effective(pieces, "description"), F.lit("")), F.lit(" "), F.col("_h.name"))).alias("description"), "notes", F.coalesce("warnings", F.array().cast("array<string>")).alias("warnings"),
        "group_id", "date", "confidence", "order_out", F.lit(PENDING).alias("state"), F.lit("division").alias("origin"),
    )
    return labelled(halves, pages), halves.select("case_id", "parent", F.col("half").alias("child_no"))


def inherited_links(links: DataFrame, made: DataFrame, source: str) -> DataFrame:
    """Persons of new pieces: for each row of `made` the links (case_id, piece_id, person_id, function) of the piece in its column `source`; what several sources share is one link."""
    keys = [c for c in made.columns if c != source]
    return made.join(links.withColumnRenamed("piece_id", source), ["case_id", source]).select(*keys, "person_id", "function").distinct()


def union(pieces: DataFrame, parts: DataFrame, pages: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """Pieces merged from parts (case_id, union_id, piece_id): two or more, all there, active and with a first page, none excluded and none, by `edges`, descended from an excluded one.

    The range spans all parts; document, present type and description, group and order come from the first
    by page, the date is the first one known, the confidence the least, and differing types give a warning.
    Printed numbers are those of the range's ends. `segmentation.range_texts` gives the text, `union_edges`
    and `inherited_links` the merged piece's edges and persons.
    """
    own = pieces.select("case_id", "piece_id", "page_start", F.coalesce("page_end", "page_start").alias("page_end"), "doc_id", _effective(pieces, "type").alias("type"), _effective(pieces, "description").alias("description"), "group_id", "order_out", "date", "confidence", "active", "state")
    rows = parts.join(own, ["case_id", "piece_id"], "left")
    bad = F.lit(False)
    if edges is not None:
        rows, bad = rows.join(tainted(edges, pieces).withColumn("_bad", F.lit(True)), ["case_id", "piece_id"], "left"), F.coalesce("_bad", F.lit(False))
    order = F.struct("page_start", "piece_id")
    fit = F.coalesce(F.col("active") & (F.col("state") != EXCLUDED) & F.col("page_start").isNotNull() & ~bad, F.lit(False))
    grouped = rows.groupBy("case_id", "union_id").agg(
        F.count("*").alias("parts"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"), F.min_by(F.struct("doc_id", "type", "description", "group_id", "order_out"), order).alias("_f"),
        F.min_by("date", F.when(F.col("date").isNotNull(), order)).alias("date"), F.min("confidence").alias("confidence"), F.count_distinct(F.struct("type")).alias("_types"), F.bool_and(fit).alias("_ok"),
    )
    good = grouped.where("parts >= 2 AND _ok")
    warned = F.when(F.col("_types") > 1, F.array(F.lit(MIXED))).otherwise(F.array().cast("array<string>"))
    out = good.select("case_id", "union_id", "parts", "page_start", "page_end", "_f.doc_id", "_f.type", "_f.description", "_f.group_id", "_f.order_out", "date", "confidence", warned.alias("warnings"), F.lit(PENDING).alias("state"), F.lit("union").alias("origin"))
    return labelled(out, pages)


def union_edges(pieces: DataFrame, parts: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges of merged pieces to their parts by page: case_id, union_id, piece_id, part_no from 0."""
    rows = parts.join(merged.select("case_id", "union_id"), ["case_id", "union_id"], "left_semi").join(pieces.select("case_id", "piece_id", "page_start"), ["case_id", "piece_id"])
    order = Window.partitionBy("case_id", "union_id").orderBy("page_start", "piece_id")
    return rows.select("case_id", "union_id", "piece_id", (F.row_number().over(order) - 1).alias("part_no"))


def may_undo(edges: DataFrame, pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """Roots (case_id, root) with whether the merge or the split that made them may be undone.

    Edges have a `kind`, `union` or `division`. The piece must be active. A merge may be undone if no part
    of it has an active descendant but the merged piece and the parts themselves; a split if its origin has
    none but the halves.
    """
    made = roots.join(edges.select("case_id", F.col("child").alias("root"), F.col("parent").alias("source"), "kind"), ["case_id", "root"])
    own = cut(made.join(pieces.where("active").select("case_id", F.col("piece_id").alias("root")), ["case_id", "root"], "left_semi"))
    halves = edges.where("kind = 'division'").select("case_id", F.col("parent").alias("source"), F.col("child").alias("node"))
    own_parts = own.where("kind = 'union'").select("case_id", "root", F.explode(F.array("root", "source")).alias("node"))
    exempt = own_parts.union(own.where("kind = 'division'").join(halves, ["case_id", "source"]).select("case_id", "root", "node")).distinct()
    # a few active descendants of each source tell, unless all of them are exempt and there may be more
    on = pieces.where("active").select("case_id", F.col("piece_id").alias("node"))
    below = few_reached(edges.select("case_id", F.col("parent").alias("a"), F.col("child").alias("b")), on, WITNESSES).select("case_id", F.col("node").alias("source"), F.col("found").alias("node"))
    seen = cut(own.select("case_id", "root", "source").join(below, ["case_id", "source"]).join(exempt.withColumn("_exempt", F.lit(True)), ["case_id", "root", "node"], "left"))
    told = seen.groupBy("case_id", "root", "source").agg(F.count("*").alias("_n"), F.count("_exempt").alias("_e"))
    busy = told.where("_n > _e").select("case_id", "root")
    unsure = cut(told.where((F.col("_n") == F.col("_e")) & (F.col("_n") == WITNESSES)).select("case_id", "root", "source"))
    if not unsure.isEmpty():
        every = active_descendants(edges, pieces, unsure.select("case_id", F.col("source").alias("root")).distinct()).select("case_id", F.col("root").alias("source"), "node")
        busy = busy.union(unsure.join(every, ["case_id", "source"]).join(exempt, ["case_id", "root", "node"], "left_anti").select("case_id", "root"))
    free = own.select("case_id", "root").distinct().join(busy.distinct(), ["case_id", "root"], "left_anti").withColumn("_free", F.lit(True))
    return roots.join(free, ["case_id", "root"], "left").select("case_id", "root", F.coalesce("_free", F.lit(False)).alias("allowed"))


def undo(edges: DataFrame, pieces: DataFrame, roots: DataFrame) -> DataFrame:
    """What undoing the allowed ones of some roots (case_id, root) changes: case_id, piece_id, active, field.

    A merged piece goes off and its parts come back; all halves of a split go off and its origin comes back.
    The event (`deshacer_union` on the merged piece, `deshacer_division` on the origin) is in `field`, null for the others.
    """
    allowed = may_undo(edges, pieces, roots).where("allowed").select("case_id", "root")
    made = allowed.join(edges.select("case_id", F.col("child").alias("root"), F.col("parent").alias("source"), "kind"), ["case_id", "root"])
    row = lambda df, piece, active, field: df.select("case_id", F.col(piece).alias("piece_id"), F.lit(active).alias("active"), F.lit(field).cast("string").alias("field"))
    merged, cut_up = made.where("kind = 'union'"), made.where("kind = 'division'")
    halves = cut_up.join(edges.where("kind = 'division'").select("case_id", F.col("parent").alias("source"), F.col("child").alias("half")), ["case_id", "source"])
    return (
        row(merged, "root", False, "deshacer_union").union(row(merged, "source", True, None))
        .union(row(cut_up, "source", True, "deshacer_division")).union(row(halves, "half", False, None)).distinct()
    )


def may_restore(edges: DataFrame, pieces: DataFrame, log: DataFrame) -> DataFrame:
    """Pieces that are off (case_id, piece_id) with whether they may be restored: a person discarded them last, and nothing that came from them is active."""
    off = pieces.where("NOT active").select("case_id", "piece_id")
    discarded = off.join(last_switch(log).where("field = 'descarte'").select("case_id", "piece_id"), ["case_id", "piece_id"], "left_semi")
    on = pieces.where("active").select("case_id", F.col("piece_id").alias("node"))
    busy = reached(edges.select("case_id", F.col("child").alias("a"), F.col("parent").alias("b")), on).select("case_id", F.col("node").alias("piece_id"))
    free = discarded.join(busy, ["case_id", "piece_id"], "left_anti").withColumn("_free", F.lit(True))
    return off.join(free, ["case_id", "piece_id"], "left").select("case_id", "piece_id", F.coalesce("_free", F.lit(False)).alias("allowed"))


def settings(log: DataFrame) -> DataFrame:
    """The last value of each key: log of seq, case_id, k, v."""
    return log.groupBy("case_id", "k").agg(F.max_by(F.struct("v"), "seq").alias("_l")).select("case_id", "k", "_l.v")


def upserts(log: DataFrame, key: str, fields: tuple[str, ...], required: str) -> DataFrame:
    """Master data (groups, persons) from a log of seq, case_id, key, field, new: the last value of each allowed field; a blank required one is not taken."""
    good = log.where(F.col("field").isin(*fields) & ~((F.col("field") == required) & (F.coalesce(F.trim("new"), F.lit("")) == "")))
    picked = [F.max_by(F.when(F.col("field") == f, F.struct("new")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}") for f in fields]
    return good.groupBy("case_id", key).agg(*picked).select("case_id", key, *[F.col(f"_{f}.new").alias(f) for f in fields]).where(F.col(required).isNotNull())
