"""Dossier tables derived from the star schema, events, conversations and documents, in Spark and in SQL.

Every table takes (spark, sf_dir). `SQL` holds the same tables as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.headings import Rule

#: Rules for the languages of the corpus, for folded upper-case headings.
RULES = [
    Rule("en_the", "English, the", "english", 0.9, (r"^THE\b", r"\bTHE\b")),
    Rule("en_that", "English, that", "english", 0.6, (r"\bTHAT\b", r"\bWITH\b")),
    Rule("de_der", "German", "german", 0.8, (r"\b(?:DER|DIE|DAS)\b", r"\bUND\b")),
    Rule("fr_le", "French", "french", 0.7, (r"\b(?:LE|LES|DES)\b", r"\bQUE\b")),
    Rule("es_el", "Spanish", "spanish", 0.5, (r"\b(?:EL|LOS|LAS)\b", r"\bPARA\b")),
]


#: A table of fewer bytes than this for each core may have too few splits for them.
SMALL_SPLIT = 16 << 20


def table(name: str, spread: bool = False):
    """A reader of a table. With `spread`, a small one (`SMALL_SPLIT` bytes a core, by the plan's own estimate) is dealt out over all cores."""

    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        df, cores = spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark.sparkContext.defaultParallelism
        size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if spread else 0
        return df.repartition(cores) if spread and size < cores * SMALL_SPLIT else df

    return read


documents, conversations = table("documents", spread=True), table("conversations", spread=True)
events, orders, part, lineitem = map(table, ("events", "orders", "part", "lineitem"))


def deliveries(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select(F.col("source").alias("case_id"), F.col("doc_id").alias("arrival"), F.concat(F.lit("doc-"), "doc_id").alias("name"), F.col("text").alias("content"))


def chat_pages(spark: SparkSession, d: str) -> DataFrame:
    return chat_pages_of(conversations(spark, d))


def chat_pages_of(rows: DataFrame) -> DataFrame:
    return rows.select(F.concat(F.lit("c"), F.col("conv_id") % 10).alias("case_id"), F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("page_no"), "text", (((F.col("conv_id") * 31 + F.col("turn") * 17) % 100) / 100.0).alias("conf"))


def chat_documents(spark: SparkSession, d: str) -> DataFrame:
    return chat_pages(spark, d).groupBy("case_id", "doc_id").agg(F.max("page_no").alias("n_pages")).withColumn("ord", F.col("doc_id"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    """Number readings of three zones over order keys, a thousand pages to a case."""
    page = orders(spark, d).select(F.col("o_orderkey").cast("long").alias("global_no"))
    case = F.concat(F.lit("k"), F.floor(F.col("global_no") / 1000).cast("string")).alias("case_id")
    zone = lambda z, num, keep: page.where(keep).select(case, F.lit(z).alias("zone"), "global_no", num.cast("long").alias("num"))
    p = F.col("global_no")
    return (
        zone("sup_der", p + 399 + 7 * F.floor(p / 100), p % 5 != 0).unionByName(zone("sup_cen", p + 5, p % 13 == 0)).unionByName(zone("inf_der", p + 1, (p % 1000).between(500, 560)))
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    return log_of(events(spark, d))


def log_of(rows: DataFrame) -> DataFrame:
    kind, e = F.col("event_type"), F.col("event_id")
    typed = (kind == "signup") & (e % 3 < 2)
    field = F.when(kind == "click", "group_id").when(kind == "view", "type_final").when(typed & (e % 3 == 0), "number_start_final").when(typed, "number_end_final").otherwise("state")
    new = (
        F.when(kind == "click", (e % 6).cast("string")).when(kind == "view", F.element_at(F.array(*map(F.lit, ("", "fr", "de", "en"))), (e % 4).cast("int") + 1)).when(typed & (e % 7 == 0), " ").when(typed, (e % 900).cast("string"))
        .when(kind == "purchase", "incluida").when(kind == "error", "excluida").otherwise("pendiente")
    )
    return rows.select(e.alias("seq"), F.concat(F.lit("e"), F.col("user_id") % 5).alias("case_id"), F.col("user_id").alias("piece_id"), field.alias("field"), new.alias("new"))


def link_log(spark: SparkSession, d: str) -> DataFrame:
    function = F.when(F.col("event_type").isin("click", "view"), "introductor").otherwise("mencionado")
    return events(spark, d).select(F.col("event_id").alias("seq"), F.concat(F.lit("e"), F.col("user_id") % 5).alias("case_id"), F.col("user_id").alias("piece_id"), (F.col("event_id") % 40).alias("person_id"), function.alias("function"), F.when(F.col("event_id") % 9 == 0, "remove").otherwise("add").alias("op"))


def tag_log(spark: SparkSession, d: str) -> DataFrame:
    return link_log(spark, d).select("seq", "case_id", "piece_id", F.concat(F.lit("t"), F.col("person_id") % 6).alias("tag"), "op")


def people(spark: SparkSession, d: str) -> DataFrame:
    """Persons that the link log names, one person in each case."""
    return link_log(spark, d).select("case_id", "person_id").distinct().withColumn("name", F.concat(F.lit("Persona "), "person_id"))


def groups(spark: SparkSession, d: str) -> DataFrame:
    found = log(spark, d).where("field = 'group_id' AND new <> '0'").select("case_id", F.col("new").cast("long").alias("group_id")).distinct()
    return found.withColumn("name", F.concat(F.lit("Grupo "), "group_id")).withColumn("ord", (10 - F.col("group_id")).cast("int"))


def raw_pieces(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    first = F.substring_index("text", "\n", 1)
    start = F.floor(i / 5) + 1
    manual = i % 11 == 0
    date = F.concat(F.lit("2024-"), F.lpad((i % 12 + 1).cast("string"), 2, "0"), F.lit("-"), F.lpad((i % 28 + 1).cast("string"), 2, "0"))
    return documents(spark, d).select(
        F.concat(F.lit("e"), i % 5).alias("case_id"), i.alias("piece_id"), (i % 3).alias("doc_id"), start.alias("page_start"), F.when(i % 23 != 5, start + i % 3).alias("page_end"), F.col("lang").alias("type"),
        F.left(first, F.lit(80)).alias("description"), F.left("text", F.lit(1200)).alias("source_text"), (i % 17 != 3).alias("active"), F.when(manual, "manual").otherwise("automatica").alias("origin"),
        F.when(~manual, (F.col("n_chars") % 100) / 100.0).alias("confidence"), (i * 7919 % 10007).alias("order_out"), (i % 13).alias("order_in_group"), F.when(i % 4 != 0, date).alias("date_detected"),
        F.array().cast("array<string>").alias("warnings"), F.lit(None).cast("string").alias("notes"),
    )


def numbered_pages(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("doc_id")
    page = F.floor(i / 5) + 1
    return documents(spark, d).where(i % 29 != 11).select(
        F.concat(F.lit("e"), i % 5).alias("case_id"), page.alias("global_no"), F.when(i % 7 != 0, page + 399 + F.when(i % 50 > 40, 5).otherwise(0)).alias("num"), F.when(i % 7 != 0, "").alias("suffix"),
        F.when(i % 7 == 0, "desconocida").when(i % 3 == 0, "confirmada").otherwise("detectada").alias("origin"), F.when(i % 7 == 0, "desconocida").when(i % 4 == 0, "interpolada").otherwise("leida").alias("reading"), "text",
    )


def edges(spark: SparkSession, d: str) -> DataFrame:
    return orders(spark, d).where("o_orderkey > 1").select(F.lit("l").alias("case_id"), F.floor(F.col("o_orderkey") / 2).cast("long").alias("parent"), F.col("o_orderkey").cast("long").alias("child"))


def order_pieces(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return orders(spark, d).select(F.lit("l").alias("case_id"), k.cast("long").alias("piece_id"), F.when(k % 50 == 7, "excluida").when(k % 2 == 0, "incluida").otherwise("pendiente").alias("state"), (F.col("o_orderstatus") != "F").alias("active"))


def piece_edges(spark: SparkSession, d: str) -> DataFrame:
    """Lineage of the checklist's pieces: every third one came from the fifth before it, which is in its case."""
    i = F.col("doc_id")
    return documents(spark, d).where((i >= 5) & (i % 3 == 0)).select(F.concat(F.lit("e"), i % 5).alias("case_id"), (i - 5).alias("parent"), i.alias("child"))


#: Where the ids of merged pieces begin, and of those merged from these.
MERGED, AGAIN = 10**9, 2 * 10**9


def made_edges(spark: SparkSession, d: str) -> DataFrame:
    """Splits and merges in every ten order keys: 1 and 2 are merged, and these again by twos; 3 is split into 4 and 5, and 4 into 6 and 7."""
    k = F.col("o_orderkey").cast("long")
    ten, one = F.floor(k / 10), k % 10
    keys = orders(spark, d)
    edge = lambda test, parent, child, kind: keys.where(test).select(F.lit("l").alias("case_id"), parent.cast("long").alias("parent"), child.cast("long").alias("child"), F.lit(kind).alias("kind"))
    return (
        edge(one.isin(1, 2), k, ten + MERGED, "union").unionByName(edge(one == 1, ten + MERGED, F.floor(ten / 2) + AGAIN, "union"))
        .unionByName(edge(one.isin(4, 5), k - one + 3, k, "division")).unionByName(edge(one.isin(6, 7), k - one + 4, k, "division"))
    )


def made_pieces(spark: SparkSession, d: str) -> DataFrame:
    """The order keys and the merged pieces, some of them active."""
    made = made_edges(spark, d).where("kind = 'union'").select("case_id", F.col("child").alias("piece_id")).distinct()
    own = orders(spark, d).select(F.lit("l").alias("case_id"), F.col("o_orderkey").cast("long").alias("piece_id")).union(made)
    return own.withColumns({"active": F.col("piece_id") % 1000003 * 7919 % 5 < 2, "state": F.when(F.col("piece_id") * 31 % 11 == 0, "excluida").otherwise("pendiente")})


def made_log(spark: SparkSession, d: str) -> DataFrame:
    """Events that switch these pieces off and on, in a mixed order."""
    kinds = ("descarte", "restauracion", "union", "division", "deshacer_union", "deshacer_division", "rehacer_deteccion", "alta")
    rows = made_pieces(spark, d).select("case_id", "piece_id", F.posexplode(F.array(*map(F.lit, kinds))).alias("_e", "field")).where((F.col("piece_id") * 13 + F.col("_e")) % 3 == 0)
    return rows.select(((F.col("piece_id") * 17 + F.col("_e") * 5) % 7 * 10 + F.col("_e")).alias("seq"), "case_id", "piece_id", "field")


def names(spark: SparkSession, d: str) -> DataFrame:
    """Persons from part names, a hundred to a case: as written, turned round, or with an initial."""
    k = F.col("p_partkey")
    w = F.split("p_name", " ")
    a, b = F.get(w, F.lit(0)), F.get(w, F.lit(1))
    name = F.when(k % 3 == 1, F.concat(b, F.lit(", "), a)).when(k % 3 == 2, F.concat(a, F.lit(" "), F.left(b, F.lit(1)), F.lit("."))).otherwise(F.col("p_name"))
    return part(spark, d).select(F.concat(F.lit("p"), F.floor(k / 100).cast("string")).alias("case_id"), k.cast("long").alias("person_id"), name.alias("name"), F.when(k % 25 == 0, F.concat(F.lit("D"), (k % 4).cast("string"))).alias("document"))


SQL = {
    "deliveries": "SELECT source AS case_id, doc_id AS arrival, concat('doc-', doc_id) AS name, text AS content FROM documents",
    "chat_pages": "SELECT concat('c', conv_id % 10) AS case_id, conv_id AS doc_id, turn + 1 AS page_no, text, ((conv_id * 31 + turn * 17) % 100) / 100.0::DOUBLE AS conf FROM conversations",
    "chat_documents": "SELECT case_id, doc_id, max(page_no) AS n_pages, doc_id AS ord FROM chat_pages GROUP BY case_id, doc_id",
    "readings": """SELECT concat('k', p // 1000) AS case_id, zone, p AS global_no, num FROM (
        SELECT 'sup_der' AS zone, o_orderkey AS p, o_orderkey + 399 + 7 * (o_orderkey // 100) AS num FROM orders WHERE o_orderkey % 5 <> 0
        UNION ALL SELECT 'sup_cen', o_orderkey, o_orderkey + 5 FROM orders WHERE o_orderkey % 13 = 0
        UNION ALL SELECT 'inf_der', o_orderkey, o_orderkey + 1 FROM orders WHERE o_orderkey % 1000 BETWEEN 500 AND 560)""",
    "log": """SELECT event_id AS seq, concat('e', user_id % 5) AS case_id, user_id AS piece_id,
        CASE WHEN event_type = 'click' THEN 'group_id' WHEN event_type = 'view' THEN 'type_final' WHEN event_type = 'signup' AND event_id % 3 = 0 THEN 'number_start_final' WHEN event_type = 'signup' AND event_id % 3 = 1 THEN 'number_end_final' ELSE 'state' END AS field,
        CASE WHEN event_type = 'click' THEN cast(event_id % 6 AS VARCHAR) WHEN event_type = 'view' THEN CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'en' END
          WHEN event_type = 'signup' AND event_id % 3 < 2 THEN CASE WHEN event_id % 7 = 0 THEN ' ' ELSE cast(event_id % 900 AS VARCHAR) END
          WHEN event_type = 'purchase' THEN 'incluida' WHEN event_type = 'error' THEN 'excluida' ELSE 'pendiente' END AS new FROM events""",
    "link_log": """SELECT event_id AS seq, concat('e', user_id % 5) AS case_id, user_id AS piece_id, event_id % 40 AS person_id,
        CASE WHEN event_type IN ('click', 'view') THEN 'introductor' ELSE 'mencionado' END AS function, CASE WHEN event_id % 9 = 0 THEN 'remove' ELSE 'add' END AS op FROM events""",
    "tag_log": "SELECT seq, case_id, piece_id, concat('t', person_id % 6) AS tag, op FROM link_log",
    "people": "SELECT DISTINCT case_id, person_id, concat('Persona ', person_id) AS name FROM link_log",
    "groups": "SELECT DISTINCT case_id, cast(new AS BIGINT) AS group_id, concat('Grupo ', new) AS name, 10 - cast(new AS INT) AS ord FROM log WHERE field = 'group_id' AND new <> '0'",
    "raw_pieces": """SELECT concat('e', documents.doc_id % 5) AS case_id, documents.doc_id AS piece_id, documents.doc_id % 3 AS doc_id, documents.doc_id // 5 + 1 AS page_start, CASE WHEN documents.doc_id % 23 <> 5 THEN documents.doc_id // 5 + 1 + documents.doc_id % 3 END AS page_end, lang AS type,
        left(split_part(text, chr(10), 1), 80) AS description, left(text, 1200) AS source_text, documents.doc_id % 17 <> 3 AS active, CASE WHEN documents.doc_id % 11 = 0 THEN 'manual' ELSE 'automatica' END AS origin,
        CASE WHEN documents.doc_id % 11 <> 0 THEN (n_chars % 100) / 100.0::DOUBLE END AS confidence, documents.doc_id * 7919 % 10007 AS order_out, documents.doc_id % 13 AS order_in_group,
        CASE WHEN documents.doc_id % 4 <> 0 THEN concat('2024-', lpad(cast(documents.doc_id % 12 + 1 AS VARCHAR), 2, '0'), '-', lpad(cast(documents.doc_id % 28 + 1 AS VARCHAR), 2, '0')) END AS date_detected FROM documents""",
    "numbered_pages": """SELECT concat('e', doc_id % 5) AS case_id, doc_id // 5 + 1 AS global_no, CASE WHEN doc_id % 7 <> 0 THEN doc_id // 5 + 400 + CASE WHEN doc_id % 50 > 40 THEN 5 ELSE 0 END END AS num,
        CASE WHEN doc_id % 7 = 0 THEN 'desconocida' WHEN doc_id % 3 = 0 THEN 'confirmada' ELSE 'detectada' END AS origin,
        CASE WHEN doc_id % 7 = 0 THEN 'desconocida' WHEN doc_id % 4 = 0 THEN 'interpolada' ELSE 'leida' END AS reading, text FROM documents WHERE doc_id % 29 <> 11""",
    "edges": "SELECT 'l' AS case_id, o_orderkey // 2 AS parent, o_orderkey AS child FROM orders WHERE o_orderkey > 1",
    "order_pieces": "SELECT 'l' AS case_id, o_orderkey AS piece_id, CASE WHEN o_orderkey % 50 = 7 THEN 'excluida' WHEN o_orderkey % 2 = 0 THEN 'incluida' ELSE 'pendiente' END AS state, o_orderstatus <> 'F' AS active FROM orders",
    "piece_edges": "SELECT concat('e', doc_id % 5) AS case_id, doc_id - 5 AS parent, doc_id AS child FROM documents WHERE doc_id >= 5 AND doc_id % 3 = 0",
    "made_edges": f"""SELECT o_orderkey AS parent, o_orderkey // 10 + {MERGED} AS child, 'union' AS kind FROM orders WHERE o_orderkey % 10 IN (1, 2)
        UNION ALL SELECT o_orderkey // 10 + {MERGED}, o_orderkey // 20 + {AGAIN}, 'union' FROM orders WHERE o_orderkey % 10 = 1
        UNION ALL SELECT o_orderkey - o_orderkey % 10 + 3, o_orderkey, 'division' FROM orders WHERE o_orderkey % 10 IN (4, 5)
        UNION ALL SELECT o_orderkey - o_orderkey % 10 + 4, o_orderkey, 'division' FROM orders WHERE o_orderkey % 10 IN (6, 7)""",
    "made_pieces": "SELECT piece_id, piece_id % 1000003 * 7919 % 5 < 2 AS active FROM (SELECT cast(o_orderkey AS BIGINT) AS piece_id FROM orders UNION SELECT child FROM made_edges WHERE kind = 'union')",
    "made_log": """SELECT (piece_id * 17 + e * 5) % 7 * 10 + e AS seq, piece_id, ['descarte', 'restauracion', 'union', 'division', 'deshacer_union', 'deshacer_division', 'rehacer_deteccion', 'alta'][e + 1] AS field
        FROM made_pieces, (SELECT unnest(range(8)) AS e) WHERE (piece_id * 13 + e) % 3 = 0""",
    "made_last": "SELECT piece_id, arg_max(field, seq) AS field FROM made_log WHERE field NOT IN ('rehacer_deteccion', 'alta') GROUP BY piece_id",
    "names": """SELECT concat('p', p_partkey // 100) AS case_id, p_partkey AS person_id, CASE p_partkey % 3 WHEN 1 THEN concat(split_part(p_name, ' ', 2), ', ', split_part(p_name, ' ', 1))
        WHEN 2 THEN concat(split_part(p_name, ' ', 1), ' ', left(split_part(p_name, ' ', 2), 1), '.') ELSE p_name END AS name, CASE WHEN p_partkey % 25 = 0 THEN concat('D', p_partkey % 4) END AS document FROM part""",
    # folds of the log, and the checklist's view
    "last_state": "SELECT case_id, piece_id, arg_max(new, seq) AS state FROM log WHERE field = 'state' GROUP BY ALL",
    "last_type": "SELECT case_id, piece_id, nullif(arg_max(new, seq), '') AS type_final FROM log WHERE field = 'type_final' GROUP BY ALL",
    "last_start": "SELECT case_id, piece_id, nullif(trim(arg_max(new, seq)), '') AS number_start_final FROM log WHERE field = 'number_start_final' GROUP BY ALL",
    "last_end": "SELECT case_id, piece_id, nullif(trim(arg_max(new, seq)), '') AS number_end_final FROM log WHERE field = 'number_end_final' GROUP BY ALL",
    "last_group": "SELECT case_id, piece_id, cast(arg_max(new, seq) AS BIGINT) AS g FROM log WHERE field = 'group_id' GROUP BY ALL",
    "intro": "SELECT case_id, piece_id, l.person_id, p.name FROM (SELECT case_id, piece_id, arg_max(person_id, seq) AS person_id, arg_max(op, seq) AS op FROM link_log WHERE function = 'introductor' GROUP BY case_id, piece_id) l JOIN people p USING (case_id, person_id) WHERE op = 'add'",
    "pieces": """SELECT r.*, coalesce(s.state, 'pendiente') AS state, g.group_id, g.name AS group_name, g.ord AS group_ord, t.type_final, ns.number_start_final, ne.number_end_final
        FROM raw_pieces r LEFT JOIN last_start ns USING (case_id, piece_id) LEFT JOIN last_end ne USING (case_id, piece_id) LEFT JOIN last_state s USING (case_id, piece_id) LEFT JOIN last_type t USING (case_id, piece_id) LEFT JOIN last_group lg USING (case_id, piece_id)
        LEFT JOIN groups g ON g.case_id = r.case_id AND g.group_id = lg.g""",
    "view": """SELECT *, origin_start IN ('confirmada', 'manual') AND origin_end IN ('confirmada', 'manual') AS firm FROM (
        SELECT p.case_id, p.piece_id, page_start, page_end, active, state, p.origin, confidence, order_out, order_in_group, group_id, group_name, group_ord, coalesce(type_final, type) AS type, description,
        date_detected AS date, source_text, coalesce(number_start_final, cast(a.num AS VARCHAR)) AS number_start, coalesce(number_end_final, cast(b.num AS VARCHAR)) AS number_end,
        CASE WHEN number_start_final IS NOT NULL THEN 'manual' ELSE coalesce(a.origin, 'desconocida') END AS origin_start,
        CASE WHEN number_end_final IS NOT NULL THEN 'manual' WHEN page_end IS NULL THEN CASE WHEN number_start_final IS NOT NULL THEN 'manual' ELSE coalesce(a.origin, 'desconocida') END ELSE coalesce(b.origin, 'desconocida') END AS origin_end,
        (number_start_final IS NULL AND coalesce(a.reading, '') IN ('interpolada', 'desconocida')) OR (number_end_final IS NULL AND coalesce(b.reading, '') IN ('interpolada', 'desconocida')) AS interpolated,
        type_final IS NOT NULL OR number_start_final IS NOT NULL OR number_end_final IS NOT NULL AS modified, i.person_id AS introducer_id, i.name AS introducer,
        CASE WHEN confidence IS NULL THEN 'manual' WHEN confidence >= 0.75 THEN 'alta' WHEN confidence >= 0.55 THEN 'media' ELSE 'baja' END AS level
        FROM pieces p LEFT JOIN numbered_pages a ON a.case_id = p.case_id AND a.global_no = p.page_start LEFT JOIN numbered_pages b ON b.case_id = p.case_id AND b.global_no = p.page_end
        LEFT JOIN intro i ON i.case_id = p.case_id AND i.piece_id = p.piece_id)""",
}
NEEDS = {
    "made_pieces": ["made_edges"], "made_log": ["made_pieces"], "made_last": ["made_log"],
    "chat_documents": ["chat_pages"], "tag_log": ["link_log"], "people": ["link_log"], "groups": ["log"], "last_state": ["log"], "last_type": ["log"], "last_group": ["log"], "last_start": ["log"], "last_end": ["log"], "intro": ["link_log", "people"],
    "pieces": ["raw_pieces", "last_state", "last_type", "last_start", "last_end", "last_group", "groups"], "view": ["pieces", "numbered_pages", "intro"],
}


def sql(needs: str, body: str, recursive: bool = False) -> str:
    """A query over the named tables, with these and what they need as common table expressions."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            add(n)
        if name not in order:
            order.append(name)

    for name in needs.split():
        add(name)
    head = ",\n".join(f"{n} AS ({SQL[n]})" for n in order)
    if body.lstrip().startswith("WITH "):
        body = body.lstrip()[5:]
        return f"WITH {'RECURSIVE ' if recursive else ''}{head + ',' if head else ''}\n{body}"
    return f"WITH {head}\n{body}" if head else body
