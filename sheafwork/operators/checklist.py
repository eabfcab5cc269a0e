"""The checklist: effective values, filters, orders, counters, page strip."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import label_text, level
from ..plans.order import placed, top
from ..plans.ranges import inside

LOW = 0.55
FIRM = ("confirmada", "manual")
GUESSED = ("interpolada", "desconocida")


def effective(pieces: DataFrame, finals: DataFrame, pages: DataFrame, groups: DataFrame, links: DataFrame, people: DataFrame) -> DataFrame:
    """Pieces as people see them: final values over detected ones, printed numbers from the first and last page unless typed, and the introducer with the smallest id.

    A number's origin is `manual` if typed, else its page's, `desconocida` without one. Without an end page
    there is no end number but a typed one, and the end's origin is the start's. `firm`: both ends are
    confirmed or typed. `interpolated`: an end that is not typed was not read.
    """
    number = lambda c, x: pages.select("case_id", F.col("global_no").alias(c), F.struct(label_text(F.col("num"), F.col("suffix")).alias("label"), "origin", "reading").alias(x))
    who = links.where("function = 'introductor'").join(people.select("case_id", "person_id", "name"), ["case_id", "person_id"]).groupBy("case_id", "piece_id").agg(F.min_by(F.struct("person_id", "name"), "person_id").alias("_who"))
    rows = (
        pieces.join(finals, ["case_id", "piece_id"], "left")
        .join(number("page_start", "_s"), ["case_id", "page_start"], "left").join(number("page_end", "_e"), ["case_id", "page_end"], "left")
        .join(groups.select("case_id", "group_id", F.col("name").alias("group_name"), F.col("ord").alias("group_ord")), ["case_id", "group_id"], "left")
        .join(who, ["case_id", "piece_id"], "left")
    )
    typed_s, typed_e = F.col("number_start_final").isNotNull(), F.col("number_end_final").isNotNull()
    unknown = F.lit("desconocida")
    origin_s = F.when(typed_s, "manual").otherwise(F.coalesce("_s.origin", unknown))
    origin_e = F.when(typed_e, "manual").when(F.col("page_end").isNull(), origin_s).otherwise(F.coalesce("_e.origin", unknown))
    guessed = lambda typed, page: ~typed & F.coalesce(F.col(f"{page}.reading").isin(*GUESSED), F.lit(False))
    return rows.select(
        "case_id", "piece_id", "page_start", "page_end", "active", "state", "origin", "confidence", "warnings", "order_out", "order_in_group", "group_id", "group_name", "group_ord",
        F.coalesce("type_final", "type").alias("type"), F.coalesce("description_final", "description").alias("description"), F.coalesce("date", "date_detected").alias("date"), "source_text",
        F.coalesce("number_start_final", "_s.label").alias("number_start"), F.coalesce("number_end_final", "_e.label").alias("number_end"), origin_s.alias("origin_start"), origin_e.alias("origin_end"),
        (origin_s.isin(*FIRM) & origin_e.isin(*FIRM)).alias("firm"), (guessed(typed_s, "_s") | guessed(typed_e, "_e")).alias("interpolated"),
        F.coalesce("type_final", "description_final", "number_start_final", "number_end_final").isNotNull().alias("modified"),
        F.col("_who.person_id").alias("introducer_id"), F.col("_who.name").alias("introducer"), level(F.col("confidence")).alias("level"),
        guessed(typed_s, "_s").alias("guessed_start"), guessed(typed_e, "_e").alias("guessed_end"),
    )


def included(view: DataFrame) -> DataFrame:
    """The only way into a report: included and active."""
    return view.where("state = 'incluida' AND active")


#: Named filters over the effective view; `duplicados` needs the open pairs.
FILTERS: dict[str, Callable[[], Column]] = {
    "todas": lambda: F.lit(True),
    "incluidas": lambda: F.col("state") == "incluida",
    "excluidas": lambda: F.col("state") == "excluida",
    "pendientes": lambda: F.col("state") == "pendiente",
    "sin_testigo": lambda: F.col("introducer_id").isNull(),
    "sin_foja": lambda: F.col("number_start").isNull(),
    "foja_sin_confirmar": lambda: ~F.col("firm"),
    "foja_interpolada": lambda: F.col("interpolated"),
    "baja_confianza": lambda: F.col("confidence").isNotNull() & (F.col("confidence") < LOW),
    "modificadas": lambda: F.col("modified"),
    "manuales": lambda: F.col("origin") == "manual",
}


def filtered(view: DataFrame, name: str, pairs: DataFrame | None = None) -> DataFrame:
    """Active pieces that a named filter keeps; an unknown name keeps all."""
    rows = view.where("active")
    if name == "duplicados" and pairs is not None:
        both = pairs.select("case_id", F.col("a").alias("piece_id")).union(pairs.select("case_id", F.col("b"))).distinct()
        return rows.join(both, ["case_id", "piece_id"], "left_semi")
    return rows.where(FILTERS.get(name, FILTERS["todas"])())


def narrowed(view: DataFrame, *, group: int | None = None, kind: str | None = None, text: str | None = None) -> DataFrame:
    """Active pieces of a group (0: of none), of a type, and with a text in description, source text or introducer (% and _ are ordinary characters)."""
    out = view.where("active")
    if group is not None:
        out = out.where(F.col("group_id").isNull() if group == 0 else F.col("group_id") == group)
    if kind:
        out = out.where(F.col("type") == kind)
    if text:
        found = F.lit(False)
        for c in ("description", "source_text", "introducer"):
            found = found | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
        out = out.where(found)
    return out


def covering(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """Active pieces that cover pages (case_id, page): case_id, page, piece_id."""
    ranges = view.where("active").select("case_id", "piece_id", F.col("page_start").alias("_first"), F.coalesce("page_end", "page_start").alias("_last"))
    return inside(ranges, wanted.select("case_id", "page"), ["case_id"], "_first", "_last", "page").select("case_id", "page", "piece_id")


def warnings(view: DataFrame) -> DataFrame:
    """The view with the warnings that follow from numbers, after the stored ones, and the number of pages."""
    long = F.coalesce("page_end", "page_start") > F.col("page_start")
    mine = [
        F.when(F.col("number_start").isNotNull() & ~F.col("firm"), "foja_sin_confirmar"), F.when(F.col("interpolated"), "foja_interpolada"),
        F.when(F.col("number_start").isNull(), "sin_foja"), F.when(F.col("number_start").isNotNull() & F.col("number_end").isNull() & long, "sin_foja_final"),
    ]
    more = F.filter(F.array(*mine), lambda x: x.isNotNull())
    return view.withColumn("warnings", F.concat(F.coalesce("warnings", F.array().cast("array<string>")), more)).withColumn("n_pages", F.coalesce("page_end", "page_start") - F.col("page_start") + 1)


def page_list(pages: DataFrame, start: int, limit: int = 500) -> DataFrame:
    """Pages of each case from a number on, 500 of a case at most, with whether they are read."""
    rows = pages.where(F.col("global_no") >= start).select("case_id", "global_no", F.col("text").isNotNull().alias("read"))
    return top(rows, ["case_id"], [F.col("global_no")], min(limit, 500)).drop("place")


#: Named orders; nulls come last and the id settles ties.
ORDERS = {
    "manual": ("order_out", "page_start"), "pagina": ("page_start",), "grupos": ("group_ord", "order_in_group", "page_start"),
    "cronologico": ("date", "page_start"), "tipo": ("type", "page_start"), "testigo": ("introducer", "page_start"),
}


def order_by(name: str) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ORDERS.get(name, ORDERS["manual"])] + [F.col("piece_id").asc()]


def page_of(view: DataFrame, name: str, start: int = 0, limit: int = 200) -> DataFrame:
    """One page of each case's listing: at most 500 rows from an offset on, each with its `place` in the listing and the `total` of its case."""
    totals = view.groupBy("case_id").agg(F.count("*").alias("total"))
    return top(view, ["case_id"], order_by(name), min(limit, 500), start).join(totals, "case_id")


def positions(view: DataFrame, name: str) -> DataFrame:
    """The place of every piece of a case in a named order, by range partitions: no case sits in one task."""
    slim = view.select("case_id", "piece_id", *[c for c in dict.fromkeys(ORDERS.get(name, ORDERS["manual"]))])
    return placed(slim, ["case_id"], order_by(name)).select("case_id", "piece_id", F.col("position").cast("int").alias("position"))


def missing(ids: DataFrame, shown: DataFrame) -> DataFrame:
    """Ids of a full listing that its pages, read one by one, did not show."""
    return ids.select("case_id", "piece_id").join(shown.select("case_id", "piece_id"), ["case_id", "piece_id"], "left_anti")


def reorder(view: DataFrame, wanted: DataFrame) -> DataFrame:
    """Changes that an explicit order (case_id, ids) makes: case_id, piece_id, old, new, only where they differ."""
    placed = wanted.select("case_id", F.posexplode("ids").alias("_at", "piece_id")).withColumn("new", F.col("_at") + 1)
    return placed.join(view.select("case_id", "piece_id", F.col("order_out").alias("old")), ["case_id", "piece_id"]).where(~F.col("old").eqNullSafe(F.col("new"))).select("case_id", "piece_id", "old", "new")


#: The counters of the checklist, over active pieces.
COUNTERS: dict[str, Callable[[], Column]] = {n: FILTERS[n] for n in ("incluidas", "excluidas", "pendientes", "sin_testigo", "sin_foja", "foja_sin_confirmar", "foja_interpolada", "baja_confianza", "modificadas")} | {
    "incluidas_sin_testigo": lambda: FILTERS["incluidas"]() & FILTERS["sin_testigo"](),
    "incluidas_sin_foja_firme": lambda: FILTERS["incluidas"]() & ~F.col("firm"),
}


def counters(cases: DataFrame, view: DataFrame) -> DataFrame:
    """The twelve counts of each case's active pieces, all of them (`detectadas`) first; zeros for a case without any."""
    counted = view.where("active").groupBy("case_id").agg(F.count("*").alias("detectadas"), *[F.count_if(test()).alias(n) for n, test in COUNTERS.items()])
    return cases.select("case_id").join(counted, "case_id", "left").fillna(0)


def sections(groups: DataFrame, view: DataFrame) -> DataFrame:
    """Counts by group, and a row for pieces without a group where there are any."""
    active = view.where("active")
    counts = [F.count("piece_id").alias("total")] + [F.count_if(F.col("state") == s).alias(n) for s, n in (("incluida", "included"), ("excluida", "excluded"), ("pendiente", "pending"))]
    named = groups.select("case_id", "group_id", "name", "ord").join(active.select("case_id", "group_id", "piece_id", "state"), ["case_id", "group_id"], "left").groupBy("case_id", "group_id", "name", "ord").agg(*counts)
    loose = active.where("group_id IS NULL").groupBy("case_id").agg(*counts).select("case_id", F.lit(None).cast("long").alias("group_id"), F.lit("Sin agrupar").alias("name"), F.lit(9999).alias("ord"), "total", "included", "excluded", "pending")
    return named.withColumn("ord", F.col("ord").cast("int")).unionByName(loose)


def tag_usage(tags: DataFrame, used: DataFrame) -> DataFrame:
    """How often each tag (case_id, tag) is used, zero included."""
    return tags.join(used, ["case_id", "tag"], "left").groupBy("case_id", "tag").agg(F.count("piece_id").alias("uses"))


def history(log: DataFrame) -> DataFrame:
    """The log of each piece, the newest change first: `place` counts from 1."""
    return log.withColumn("place", F.row_number().over(Window.partitionBy("case_id", "piece_id").orderBy(F.desc("seq"))))


def page_strip(view: DataFrame, pages: DataFrame, marks: int = 300) -> DataFrame:
    """States of pages in marks: case_id, mark, state. A case of more than `marks` pages gets as many of equal width; marks without a piece have no row.

    A page is `incluida` if any active piece on it is, else it has the state of the piece listed last on it
    (`manual` order). Of the pages under a mark, `incluida` wins over `pendiente` over others. States only
    change where a piece begins or ends, so only these pages and the marks' first ones are looked at.
    """
    last = pages.groupBy("case_id").agg(F.max("global_no").alias("_last"))
    width = F.greatest(F.lit(1), F.ceil(F.col("_last") / marks))
    sized = last.select("case_id", "_last", width.alias("_width"))
    null_last = lambda c: (F.col(c).isNull().alias(f"_no_{c}"), F.col(c))
    listed = F.struct(*null_last("order_out"), *null_last("page_start"), F.col("piece_id"))
    ranges = view.where("active AND page_start IS NOT NULL").select("case_id", "state", listed.alias("_listed"), F.col("page_start").alias("_first"), F.coalesce("page_end", "page_start").alias("_end"))
    turns = ranges.select("case_id", F.explode(F.array(F.col("_first"), F.col("_end") + 1)).alias("page"))
    begins = sized.select("case_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("_last") - 1) / F.col("_width")))).alias("_m"), "_width").select("case_id", (F.col("_m") * F.col("_width") + 1).alias("page"))
    held = inside(ranges, turns.union(begins).distinct(), ["case_id"], "_first", "_end", "page")
    state = F.when(F.bool_or(F.col("state") == "incluida"), "incluida").otherwise(F.max_by("state", "_listed"))
    by_page = held.groupBy("case_id", "page").agg(state.alias("state")).join(sized, "case_id").where(F.col("page") <= F.col("_last"))
    rank = F.when(F.col("state") == "incluida", 3).when(F.col("state") == "pendiente", 2).otherwise(1)
    best = by_page.groupBy("case_id", F.floor((F.col("page") - 1) / F.col("_width")).alias("mark")).agg(F.max(rank).alias("_r"))
    return best.select("case_id", "mark", F.element_at(F.array(F.lit("excluida"), F.lit("pendiente"), F.lit("incluida")), F.col("_r")).alias("state"))
