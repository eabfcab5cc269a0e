"""Reports: pre-flight checks, citations, paragraphs, assembly behind the barrier, carried edits, staleness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import date_words, roman
from ..plans.graph import cut
from ..plans.order import placed
from .checklist import included
from .lineage import tainted

# What a text says where a value is missing or not sure, and its templates.
NO_NUMBER, UNSURE, NO_WITNESS, BROKEN = "[FOJA PENDIENTE]", "[FOJA A CONFIRMAR]", "[TESTIGO PENDIENTE]", "[RANGO DE FOJAS A REVISAR]"
TEMPLATES = {"remision": "{descripcion}{fecha}, obrante a {fojas}{testigo}.", "abreviado": "{descripcion}{fecha}, obrante a {fojas}."}
BY_FAMILY = {"testimonial": "{descripcion}{fecha}, obrante a {fojas}.", "material": "{descripcion}{fecha}, según constancias de {fojas}{testigo}."}
GROUPING = ("grupos", "tipo", "testigo")


class Barred(RuntimeError):
    """Something that is not included, or descends from what is excluded, was about to be published."""


class Empty(RuntimeError):
    """A report without a single piece."""


class Stale(RuntimeError):
    """A report no longer says what its pieces say."""


def preflight(view: DataFrame) -> DataFrame:
    """Problems of included pieces (view with `discontinuous` and `process_type`): case_id, problem, piece_id."""
    long = F.coalesce("page_end", "page_start") > F.col("page_start")
    there = F.col("number_start").isNotNull()
    tests = [
        F.when(~there, "sin_foja"), F.when(there & F.col("number_end").isNull() & long, "sin_foja_final"), F.when(there & ~F.col("firm"), "foja_sin_confirmar"),
        F.when(F.col("firm") & F.col("interpolated"), "foja_interpolada"), F.when(F.col("discontinuous"), "fojas_discontinuas"),
        F.when(F.col("introducer").isNull() & (F.col("process_type") == "remision"), "sin_testigo"),
    ]
    return included(view).select("case_id", "piece_id", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull())).alias("problem")).select("case_id", "problem", "piece_id")


def ready(cases: DataFrame, view: DataFrame) -> DataFrame:
    """Per case the number of included pieces, and whether nothing stands in the way of its report."""
    stops = preflight(view).where("problem IN ('sin_foja', 'sin_foja_final', 'sin_testigo')").groupBy("case_id").agg(F.count("*").alias("_stops"))
    counts = included(view).groupBy("case_id").agg(F.count("*").alias("included"))
    rows = cases.select("case_id").join(counts, "case_id", "left").join(stops, "case_id", "left").fillna(0)
    return rows.select("case_id", "included", ((F.col("included") > 0) & (F.col("_stops") == 0)).alias("ready"))


def citation() -> Column:
    """The sheets of a piece: `fs. a/b`, one of them, or a mark for what is missing."""
    a, b = F.col("number_start"), F.col("number_end")
    long = F.coalesce("page_end", "page_start") > F.col("page_start")
    return F.when(a.isNull(), F.lit(f"fs. {NO_NUMBER}")).when(b.isNull() & long, F.concat(F.lit("fs. "), a, F.lit(f"/{NO_NUMBER}"))).when(b.isNull() | (a == b), F.concat(F.lit("fs. "), a)).otherwise(F.concat(F.lit("fs. "), a, F.lit("/"), b))


def sheets(confirmed: bool = True) -> Column:
    """The citation with marks for a range that is no series, and for numbers that no person has confirmed."""
    base = F.when(F.col("discontinuous"), F.concat(citation(), F.lit(f" {BROKEN}"))).otherwise(citation())
    out = F.when(~F.col("firm"), F.concat(base, F.lit(f" {UNSURE}"))).otherwise(base) if confirmed else base
    return F.when(F.col("number_start").isNull(), F.lit(f"fs. {NO_NUMBER}")).otherwise(out)


def paragraph(template: str | None = None, confirmed: bool = True) -> Column:
    """A piece's text (view with `family`, `label`, `process_type`, `discontinuous`), by its family's template unless one is given."""
    usual = F.when(F.col("process_type") == "abreviado", TEMPLATES["abreviado"]).otherwise(TEMPLATES["remision"])
    chosen = F.lit(template) if template and template not in TEMPLATES.values() else F.when(F.col("family") == "testimonial", BY_FAMILY["testimonial"]).when(F.col("family") == "material", BY_FAMILY["material"]).otherwise(F.lit(template) if template else usual)
    date = date_words(F.col("date"))
    witness = F.when(F.col("process_type") == "remision", F.concat(F.lit(", que será introducida al debate mediante la declaración testimonial de "), F.coalesce("introducer", F.lit(NO_WITNESS)))).otherwise("")
    values = {
        "fecha": F.when(date == "", "").otherwise(F.concat(F.lit(", de fecha "), date)), "fojas": sheets(confirmed), "testigo": witness, "tipo": F.col("label"),
        "descripcion": F.regexp_replace(F.trim(F.coalesce("description", F.lit(""))), r"\.+$", ""),
    }
    # the names become characters that no text holds first, so that a value with braces is left alone
    out = chosen
    for i, name in enumerate(values):
        out = F.replace(out, F.lit("{" + name + "}"), F.lit(chr(0xF0000 + i)))
    for i, v in enumerate(values.values()):
        out = F.replace(out, F.lit(chr(0xF0000 + i)), v)
    return F.replace(out, F.lit("  "), F.lit(" "))


def group_key(criterion: str) -> Column:
    """What a report is grouped by, as a struct (order, key, heading)."""
    struct = lambda o, k, h: F.struct(o.cast("int").alias("order"), k.cast("string").alias("key"), h.alias("heading"))
    if criterion == "grupos":
        return struct(F.when(F.col("group_id").isNotNull(), F.col("group_ord")).otherwise(9999), F.lpad(F.coalesce(F.col("group_id"), F.lit(0)).cast("string"), 19, "0"), F.coalesce("group_heading", "group_name", F.lit("Sin agrupar")))
    if criterion == "tipo":
        return struct(F.lit(0), F.col("family"), F.col("family"))
    if criterion == "testigo":
        return struct(F.when(F.col("introducer").isNull(), 1).otherwise(0), F.coalesce("introducer", F.lit("")), F.coalesce("introducer", F.lit("Sin testigo asignado")))
    return struct(F.lit(0), F.lit(""), F.lit(""))


def report_order(criterion: str) -> list[Column]:
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    if criterion == "cronologico":
        return [F.col("date").asc_nulls_last(), zero("page_start"), F.col("piece_id")]
    if criterion in GROUPING:
        return [F.col("_g.order"), F.col("_g.key"), zero("order_in_group"), zero("order_out"), zero("page_start"), F.col("piece_id")]
    return [zero("order_out"), zero("page_start"), F.col("piece_id")]


def assemble(view: DataFrame, criterion: str = "manual", headings: bool = True, numbering: str = "continua", template: str | None = None, confirmed: bool = True) -> DataFrame:
    """The paragraphs of each case's report: case_id, ord, kind, piece_id, section, number, text.

    Sections have Roman numbers, pieces Arabic ones, over the case or (`por_grupo`) within the section. Pieces
    are placed over range partitions, and sections by their first piece, so no case sits in one task.
    """
    rows = cut(placed(included(view).withColumn("_g", group_key(criterion)), ["case_id"], report_order(criterion), "_n"))
    grouped = headings and criterion in GROUPING
    if grouped:
        parts = rows.groupBy("case_id", "_g").agg(F.min("_n").alias("_first"))
        parts = parts.withColumn("_s", F.row_number().over(Window.partitionBy("case_id").orderBy("_first")))
        rows = rows.join(parts, ["case_id", "_g"])
    else:
        rows = rows.withColumns({"_first": F.lit(1).cast("long"), "_s": F.lit(0)})
    number = F.col("_n") - F.col("_first") + 1 if grouped and numbering == "por_grupo" else F.col("_n")
    pieces = rows.select("case_id", (F.col("_n") + F.col("_s")).alias("ord"), F.lit("pieza").alias("kind"), "piece_id", F.lit(None).cast("string").alias("section"), F.concat(number.cast("string"), F.lit(".-")).alias("number"), paragraph(template, confirmed).alias("text"))
    if grouped:
        heads = parts.select("case_id", (F.col("_first") + F.col("_s") - 1).alias("ord"), F.lit("encabezado").alias("kind"), F.lit(None).cast("long").alias("piece_id"), F.col("_g.key").alias("section"), F.concat(roman(F.col("_s")), F.lit(".-")).alias("number"), F.upper("_g.heading").alias("text"))
        pieces = pieces.unionByName(heads)
    return pieces.withColumn("ord", F.col("ord").cast("int"))


def barred(paragraphs: DataFrame, pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """Pieces of a report that are not included and active by their own table, or that descend from an excluded piece."""
    used = paragraphs.where("kind = 'pieza'").select("case_id", "piece_id")
    good = pieces.where("state = 'incluida' AND active").select("case_id", "piece_id")
    return used.join(good, ["case_id", "piece_id"], "left_anti").union(used.join(tainted(edges, pieces), ["case_id", "piece_id"], "left_semi")).distinct()


def publish(paragraphs: DataFrame, pieces: DataFrame, edges: DataFrame, path: str) -> None:
    """Writes a report to a new place, but nothing if it holds no piece or a piece of it is barred."""
    if paragraphs.where("kind = 'pieza'").isEmpty():
        raise Empty("nothing is included")
    found = barred(paragraphs, pieces, edges).limit(5).collect()
    if found:
        raise Barred(f"not to be published: {[(r.case_id, r.piece_id) for r in found]}")
    paragraphs.write.mode("errorifexists").parquet(path)


def carry_edits(old: DataFrame, new: DataFrame) -> DataFrame:
    """New paragraphs with `edited` from old ones (with `edited`) of the same kind, piece, section and text; each edit is used once, and a heading without key never moves."""
    keys = ["case_id", "kind", "piece_id", "section", "text"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("ord"))
    edits = old.where("edited IS NOT NULL AND (kind = 'pieza' OR section IS NOT NULL)").withColumn("_nth", nth).select(*[F.col(k).alias(f"_{k}") for k in keys], "_nth", F.col("edited"))
    numbered = new.drop("edited").withColumn("_mth", nth)
    met = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys] + [F.col("_nth") == F.col("_mth")]
    return numbered.join(edits, met, "left").drop(*[f"_{k}" for k in keys], "_nth", "_mth")


def edit_counts(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per case how many edits of an old report were moved to the new one (`carry_edits` gives these paragraphs) and how many stayed behind."""
    there = old.where("edited IS NOT NULL AND (kind = 'pieza' OR section IS NOT NULL)").groupBy("case_id").agg(F.count("*").alias("_all"))
    moved = new.groupBy("case_id").agg(F.count("edited").alias("moved"))
    return there.join(moved, "case_id", "left").select("case_id", F.coalesce("moved", F.lit(0)).alias("moved"), (F.col("_all") - F.coalesce("moved", F.lit(0))).alias("left_behind"))


def last_edits(paragraphs: DataFrame, log: DataFrame) -> DataFrame:
    """Paragraphs with the last edit of their text (log of seq, case_id, ord, new); a blank one brings the generated text back."""
    last = log.groupBy("case_id", "ord").agg(F.max_by(F.struct("new"), "seq").alias("_l")).select("case_id", "ord", F.nullif(F.trim(F.col("_l.new")), F.lit("")).alias("edited"))
    return paragraphs.drop("edited").join(last, ["case_id", "ord"], "left")


def read(paragraphs: DataFrame, pieces: DataFrame) -> DataFrame:
    """A report as it reads: edited text over generated, whether it is edited, and the piece's present state."""
    now = pieces.select("case_id", "piece_id", "state")
    return paragraphs.join(now, ["case_id", "piece_id"], "left").select("case_id", "ord", "kind", "piece_id", "number", F.coalesce("edited", "text").alias("text"), F.col("edited").isNotNull().alias("is_edited"), "state")


def staleness(saved: DataFrame, rebuilt: DataFrame, pieces: DataFrame, edges: DataFrame) -> DataFrame:
    """What makes a saved report stale: case_id, problem, piece_id.

    `ya_no_incluida`, `procedencia_excluida`, `cambio_texto`, `falta` (newly included), and `reordenada`
    where the same paragraphs stand in another order. A case without rows is up to date.
    """
    own, now = (p.where("kind = 'pieza'") for p in (saved, rebuilt))
    gone = own.select("case_id", "piece_id").join(pieces.where("state = 'incluida' AND active").select("case_id", "piece_id"), ["case_id", "piece_id"], "left_anti")
    bad = own.select("case_id", "piece_id").join(tainted(edges, pieces), ["case_id", "piece_id"], "left_semi")
    changed = own.join(now.select("case_id", "piece_id", F.col("text").alias("_now")), ["case_id", "piece_id"]).where("text <> _now")
    fresh = now.select("case_id", "piece_id").join(own.select("case_id", "piece_id"), ["case_id", "piece_id"], "left_anti")
    moved = own.select("case_id", "piece_id", "ord").join(now.select("case_id", "piece_id", F.col("ord").alias("_ord")), ["case_id", "piece_id"]).where("ord <> _ord")
    named = lambda df, p: df.select("case_id", F.lit(p).alias("problem"), "piece_id")
    found = named(gone, "ya_no_incluida").union(named(bad, "procedencia_excluida")).union(named(changed, "cambio_texto")).union(named(fresh, "falta"))
    only_moved = named(moved, "reordenada").join(found.select("case_id").distinct(), "case_id", "left_anti")
    return found.union(only_moved.select("case_id", "problem", "piece_id")).distinct()


def export_gate(cases: DataFrame, saved: DataFrame, problems: DataFrame) -> DataFrame:
    """Whether the saved report of each case may go out: case_id, pieces, problems, allowed. It may if there is one and nothing (rows of `staleness`) makes it stale."""
    pieces = saved.where("kind = 'pieza'").groupBy("case_id").agg(F.count("*").alias("pieces"))
    found = problems.groupBy("case_id").agg(F.count("*").alias("problems"))
    rows = cases.select("case_id").join(pieces, "case_id", "left").join(found, "case_id", "left").fillna(0)
    return rows.withColumn("allowed", (F.col("pieces") > 0) & (F.col("problems") == 0))


def _up_to_date(refuse: DataFrame | None) -> None:
    if refuse is not None and (found := refuse.limit(3).collect()):
        raise Stale(f"out of date: {[(r.case_id, r.problem) for r in found]}")


def _line(paragraphs: DataFrame) -> Column:
    """A paragraph as it stands in the text: number, then edited over generated text, and blank lines round headings."""
    line = F.concat_ws(" ", "number", F.coalesce("edited", "text") if "edited" in paragraphs.columns else F.col("text"))
    return F.when(F.col("kind") == "encabezado", F.concat(F.lit("\n"), line, F.lit("\n"))).otherwise(line)


# Fixed value: the second line of every text.
OFFERED = "PRUEBA OFRECIDA"


def heading_line(file_no: Column, title: Column) -> Column:
    """The first line of a case's text, without dashes at its ends."""
    return F.regexp_replace(F.concat(F.lit("Legajo "), F.coalesce(file_no, F.lit("")), F.lit(" — "), F.coalesce(title, F.lit(""))), r"^[ —]+|[ —]+$", "")


def lines_of(paragraphs: DataFrame, cases: DataFrame, refuse: DataFrame | None = None) -> DataFrame:
    """The texts of reports as rows, so that no case is gathered anywhere: case_id, ord, line. `cases` has case_id, file_no, title.

    The heading has place -1, and the fixed second line, with a blank line after it, place 0; the lines of a
    case by `ord`, each ended by a line feed, are its `text_of`. A case without paragraphs has no row. Stale
    cases (in `refuse`) raise.
    """
    _up_to_date(refuse)
    body = paragraphs.select("case_id", "ord", _line(paragraphs).alias("line")).join(cases.select("case_id"), "case_id", "left_semi")
    there = cases.join(paragraphs.select("case_id"), "case_id", "left_semi")
    heads = there.select("case_id", F.inline(F.array(F.struct(F.lit(-1).alias("ord"), heading_line(F.col("file_no"), F.col("title")).alias("line")), F.struct(F.lit(0).alias("ord"), F.lit(f"{OFFERED}\n").alias("line")))))
    return body.unionByName(heads)


def text_of(paragraphs: DataFrame, cases: DataFrame, refuse: DataFrame | None = None) -> DataFrame:
    """One text for each case: the lines of `lines_of`, white space at its ends off, and a line feed at the end. Stale cases (in `refuse`) raise. For cases that fit a row; `lines_of` has no such bound."""
    rows = lines_of(paragraphs, cases, refuse)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("case_id").agg(F.concat(F.regexp_replace(joined, r"^\s+|\s+$", ""), F.lit("\n")).alias("text"))


def backup_records(**parts: DataFrame) -> DataFrame:
    """A backup as rows: case_id, part, json. Each table (with a case_id) gives a JSON line for each of its rows, so no case is gathered anywhere; `sources.files.write_records` saves them by case and part."""
    out = None
    for name, df in parts.items():
        one = df.select("case_id", F.lit(name).alias("part"), F.to_json(F.struct(*[c for c in df.columns if c != "case_id"])).alias("json"))
        out = one if out is None else out.unionByName(one)
    return out


def backup(cases: DataFrame, **parts: DataFrame) -> DataFrame:
    """A JSON document for each case: the case, and of each table (with a case_id) its rows as a list, sorted; a table without rows of the case gives an empty list. Not held back by staleness. For cases that fit a row; `backup_fragments` and `backup_records` have no such bound."""
    out = cases
    for name, df in parts.items():
        row = F.struct(*[c for c in df.columns if c != "case_id"])
        listed = df.groupBy("case_id").agg(F.array_sort(F.collect_list(row)).alias(name))
        out = out.join(listed, "case_id", "left").withColumn(name, F.coalesce(name, F.array().cast(listed.schema[name].dataType)))
    return out.select("case_id", F.to_json(F.struct(*out.columns)).alias("json"))


def backup_fragments(cases: DataFrame, **parts: DataFrame) -> DataFrame:
    """The documents of `backup` in fragments: case_id, part_no, place, part, text. The texts of a case in order of part_no and place, without anything between them, are its document.

    Each row of a table is a fragment, after a comma but for the first, and what stands before a table is one
    with place 0. Rows are placed over range partitions, so no case and no table is gathered anywhere.
    """
    names = list(parts)
    head = F.to_json(F.struct(*cases.columns))
    before = [F.concat(F.substring(head, F.lit(1), F.length(head) - 1) if i == 0 else F.lit("]"), F.lit(f',"{n}":[')) for i, n in enumerate(names)] + [F.lit("]}")]
    ends = F.array(*[F.struct(F.lit(i).alias("part_no"), F.lit(0).cast("long").alias("place"), F.lit(n).alias("part"), x.alias("text")) for i, (n, x) in enumerate(zip([*names, None], before, strict=True))])
    out = cases.select("case_id", F.inline(ends))
    for i, (name, df) in enumerate(parts.items()):
        rest = [c for c in df.columns if c != "case_id"]
        rows = placed(df.join(cases.select("case_id"), "case_id", "left_semi"), ["case_id"], [F.col(c) for c in rest], "_n")
        text = F.concat(F.when(F.col("_n") > 1, ",").otherwise(""), F.to_json(F.struct(*rest)))
        out = out.unionByName(rows.select("case_id", F.lit(i).alias("part_no"), F.col("_n").alias("place"), F.lit(name).alias("part"), text.alias("text")))
    return out


def file_name(file_no: Column, extension: str, prefix: str = "listado") -> Column:
    """`<prefix>-<number>.<extension>`, slashes as hyphens and without spaces."""
    return F.concat(F.lit(f"{prefix}-"), F.replace(F.replace(file_no, F.lit("/"), F.lit("-")), F.lit(" "), F.lit("")), F.lit(f".{extension}"))
