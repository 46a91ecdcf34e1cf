"""Registered queries of the scoring and document operators, each with an equal SQL text where SQL can say it.

The base tables stand in for records: an order is a record, a line item's part an item of the section its type
stands for, returned lines the predicted side, accepted lines the gold side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import text as T
from strataform.operators import chat, extract, joins, match, metrics, nested, report, retrieve, segment
from strataform.sources import pages, records
from strataform.sources.tables import table

_SECTION = {"ECONOMY": "target_materials", "LARGE": "acids_and_solvents", "STANDARD": "resins_or_columns", "PROMO": "elution_conditions", "SMALL": "final_products", "MEDIUM": "final_products"}
_SECTION_SQL = "CASE p_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _SECTION.items()) + " END"


def ct_sql(x: str) -> str:
    """Canonical text of ASCII input in DuckDB's dialect."""
    y = rf"regexp_replace(regexp_replace(lower(trim({x})), '\s+', ' ', 'g'), '[^\w.\-+()/]+', ' ', 'g')"
    y = rf"regexp_replace({y}, '(\d)\s*[- ]?\s*x\s*[- ]?\s*(\d)', '\1x\2', 'g')"
    return rf"trim(regexp_replace({y}, '\s+', ' ', 'g'))"


def r6(c: F.Column) -> F.Column:
    return F.round(c, 6)


# ---- canonical forms --------------------------------------------------------------------------------------------


def canon_text(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_size")
    raw = F.concat_ws("  ", "p_name", F.lit("~"), "p_brand", F.col("p_size"), F.lit("x"), F.col("p_size"))
    return p.select("p_partkey", T.canonical_text(raw).alias("canon"))


def canon_text_unicode(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.canonical_text(F.col("text")).alias("canon"))


_ISOTOPE = [("0", "concat(p_size, 'Co')"), ("1", "concat('cobalt-', p_size)"), ("2", "concat('iron ', p_size)"), ("3", "p_name")]
_ISOTOPE_SQL = "CASE p_partkey % 4 " + " ".join(f"WHEN {i} THEN {e}" for i, e in _ISOTOPE) + " END"


def canon_isotope(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    return p.select("p_partkey", T.canonical_isotope(F.expr(_ISOTOPE_SQL)).alias("canon"))


_CONC_SQL = "CASE p_partkey % 4 WHEN 0 THEN concat(p_size, ' M') WHEN 1 THEN concat(p_size, '.50M') WHEN 2 THEN concat('Concentrated ', p_name) ELSE concat('0.', p_size, ' m') END"


def canon_concentration(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    return p.select("p_partkey", T.canonical_concentration(F.expr(_CONC_SQL)).alias("canon"))


_CHEM_SQL = "CASE p_partkey % 6 WHEN 0 THEN concat('Hydrochloric Acid ', p_name) WHEN 1 THEN 'dilute nitric  acid' WHEN 2 THEN concat('HCl in ', p_name) WHEN 3 THEN 'Ultrapure Water' WHEN 4 THEN concat(p_size, ' M H2SO4') ELSE p_name END"


def canon_chemical(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    return p.select("p_partkey", T.canonical_chemical(F.expr(_CHEM_SQL)).alias("chemical"), T.canonical_eluent(F.expr(_CHEM_SQL)).alias("eluent"))


def _chem_sql(t: str) -> str:
    syn = " ".join(f"WHEN contains({t}, '{p}') THEN '{v}'" for p, v in T.SYNONYMS)
    words = " ".join(rf"WHEN regexp_matches({t}, '\b{w}\b') THEN '{w}'" for w in T.WORDS)
    return f"CASE WHEN {t} = '' THEN '' {syn} {words} ELSE {t} END"


def canon_id(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "extraction_records", "record_id", "path")
    return p.select("record_id", T.canonical_id(F.col("path")).alias("id"), T.stem_id(F.col("path")).alias("stem"), T.experiment_number(F.col("path")).alias("exp"))


def path_filter(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "extraction_records", "record_id", "path", "kind")
    e = T.experiment_number(F.col("path"))
    return p.where((F.element_at(F.split("path", "/"), -2) == F.col("kind")) & joins.experiment_allowed(e, least=18)).select("record_id", e.alias("exp"), report.method(F.col("kind")).alias("method"))


def retry_hints(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "event_type", "value")
    m = F.when(F.col("event_type") == "error", F.concat(F.lit("Rate limit. Please try again in "), F.col("event_id").cast("string"), F.lit("ms."))).when(F.col("event_type") == "click", F.concat(F.lit("try again in "), (F.col("event_id") % 60).cast("string"), F.lit(".5 seconds"))).otherwise("busy")
    return e.select("event_id", r6(T.retry_after_seconds(m)).alias("wait_s"))


def sanitized(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", T.sanitize(F.col("text"), 500).alias("clean"))


# ---- records and metrics ----------------------------------------------------------------------------------------


def _items(spark: SparkSession, d: str, *flags: str) -> DataFrame:
    l = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_returnflag").where(F.col("l_returnflag").isin(*flags))  # noqa: E741
    p = table(spark, d, "part", "p_partkey", "p_name", "p_brand", "p_type")
    sec = F.create_map(*[F.lit(x) for kv in _SECTION.items() for x in kv])[F.col("p_type")]
    keyed = p.select("p_partkey", sec.alias("section"), F.concat_ws("|", T.canonical_text(F.col("p_name"), False), T.canonical_text(F.col("p_brand"), False)).alias("key"))
    return l.join(keyed, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("record_key"), "l_returnflag", "section", "key")


_ITEMS_SQL = f"SELECT l_orderkey AS record_key, l_returnflag, {_SECTION_SQL} AS section, concat({ct_sql('p_name')}, '|', {ct_sql('p_brand')}) AS key FROM lineitem JOIN part ON l_partkey = p_partkey"


def distinct_keys(spark: SparkSession, d: str) -> DataFrame:
    return _items(spark, d, "R").groupBy("record_key", "section").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("key").alias("unique_keys"))


def completeness_duplicates(spark: SparkSession, d: str) -> DataFrame:
    s = _items(spark, d, "R").groupBy("record_key", "section").agg(F.count(F.lit(1)).alias("items"), F.countDistinct("key").alias("u"))
    return s.groupBy("record_key").agg(r6(F.count(F.lit(1)) / 5).alias("completeness"), F.sum("items").alias("items_total"), (F.sum("items") - F.sum("u")).alias("duplicates"), r6((F.sum("items") - F.sum("u")) / F.sum("items")).alias("duplicate_rate"))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    k = _items(spark, d, "R", "A").groupBy("record_key", "section", "l_returnflag").agg(F.array_sort(F.collect_set("key")).alias("keys"))
    m = lambda flag: F.map_from_entries(F.collect_list(F.when(F.col("l_returnflag") == flag, F.struct("section", "keys"))))
    return k.groupBy("record_key").agg(m("R").alias("pred"), m("A").alias("gold"))


def exact_report(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.gold_report(_pairs(spark, d), exact=True)
    return g.select("record_key", *[r6(F.col(c)).alias(c) for c in ("micro_precision", "micro_recall", "micro_f1", "jaccard_micro", "macro_f1", "hallucination_rate")])


_EXACT_SQL = f"""
WITH k AS (SELECT DISTINCT record_key, section, key, l_returnflag FROM ({_ITEMS_SQL}) WHERE l_returnflag IN ('R', 'A')),
j AS (SELECT coalesce(p.record_key, g.record_key) AS record_key, coalesce(p.section, g.section) AS section, count(p.key) FILTER (g.key IS NOT NULL) AS tp, count(p.key) FILTER (g.key IS NULL) AS fp, count(g.key) FILTER (p.key IS NULL) AS fn
      FROM (SELECT * FROM k WHERE l_returnflag = 'R') p FULL JOIN (SELECT * FROM k WHERE l_returnflag = 'A') g ON p.record_key = g.record_key AND p.section = g.section AND p.key = g.key GROUP BY 1, 2),
f AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM j),
m AS (SELECT record_key, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END) / 5 AS macro_f1 FROM f GROUP BY 1),
x AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM m)
SELECT record_key, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS micro_f1,
  round(CASE WHEN tp + fp + fn = 0 THEN 1.0 ELSE tp / (tp + fp + fn) END, 6) AS jaccard_micro, round(macro_f1, 6) AS macro_f1, round(fp / greatest(tp + fp, 1), 6) AS hallucination_rate FROM x"""


def relaxed_report(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.gold_report(_pairs(spark, d))
    cols = ("micro_precision", "micro_recall", "micro_f1", "macro_precision", "macro_recall", "macro_f1", "jaccard_micro", "hallucination_rate", "fabricated", "matched", "missed")
    return g.select("record_key", *[F.col(c) if c in ("fabricated", "matched", "missed") else r6(F.col(c)).alias(c) for c in cols])


def task_success(spark: SparkSession, d: str) -> DataFrame:
    g = metrics.gold_report(_pairs(spark, d), exact=True)
    n = F.size(F.map_keys("pred"))
    return g.select("record_key", metrics.task_success(n / 5, F.col("micro_f1"), F.col("hallucination_rate"), n).alias("task_success"))


_SUCCESS_SQL = f"""WITH e AS ({_EXACT_SQL}), n AS (SELECT record_key, count(DISTINCT section) FILTER (l_returnflag = 'R') AS n FROM ({_ITEMS_SQL}) WHERE l_returnflag IN ('R', 'A') GROUP BY 1)
SELECT record_key, n >= 5 AND micro_f1 >= 0.65 AND hallucination_rate <= 0.25 AS task_success FROM e JOIN n USING (record_key)"""


def _record_items(spark: SparkSession, d: str, fields: list[str] | None = None, records: bool = False) -> DataFrame:
    return nested.flatten_items(table(spark, d, "extraction_records", "record_id", "record"), "record_id", "record", list(metrics.SECTIONS), fields, records)


def record_report(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: completeness, duplicates, validity and heuristic scores of every extraction record, those without items too."""
    r = metrics.score_records(_record_items(spark, d, records=True))
    return r.select(F.col("record_key").alias("record_id"), r6("completeness").alias("completeness"), "items_total", "duplicates", r6("duplicate_rate").alias("duplicate_rate"), r6("schema_validity").alias("schema_validity"), r6("heuristic_accuracy").alias("heuristic_accuracy"), r6("heuristic_hallucination").alias("heuristic_hallucination"))


def json_items(spark: SparkSession, d: str) -> DataFrame:
    return _record_items(spark, d, []).groupBy(F.col("record_key").alias("record_id"), "section").agg(F.count(F.lit(1)).alias("items"))


def json_records(spark: SparkSession, d: str) -> DataFrame:
    df = records.with_record_flag(table(spark, d, "extraction_records", "record_id", "record"), "record")
    return df.select("record_id", "is_record")


_IS_OBJECT = "CASE WHEN json_valid(record) THEN json_type(record) = 'OBJECT' ELSE false END"


def _sec_sql(s: str) -> str:
    return f"SELECT record_id, '{s}' AS section, CAST(i AS INT) AS item_no FROM (SELECT record_id, record, unnest(range(CAST(json_array_length(record, '$.{s}.items') AS BIGINT))) AS i FROM o WHERE json_type(record, '$.{s}.items') = 'ARRAY') WHERE json_type(record, concat('$.{s}.items[', i, ']')) = 'OBJECT'"


_FLAT_SQL = "WITH o AS (SELECT record_id, record FROM extraction_records WHERE " + _IS_OBJECT + ") "
_ITEMS_JSON_SQL = _FLAT_SQL + "SELECT record_id, section, count(*) AS items FROM (" + " UNION ALL ".join(_sec_sql(s) for s in metrics.SECTIONS) + ") GROUP BY 1, 2"
P7_SQL = _FLAT_SQL + " UNION ALL ".join(_sec_sql(s) for s in nested.FLAT_SECTIONS)
_RECORD_SQL = "SELECT record_id, CASE WHEN coalesce(json_valid(record), false) THEN json_type(record) = 'OBJECT' AND (" + " OR ".join(f"coalesce(json_type(record, '$.{s}.items') = 'ARRAY', false)" for s in metrics.SECTIONS) + ") ELSE false END AS is_record FROM extraction_records"


# ---- reports ----------------------------------------------------------------------------------------------------


def _report_rows(spark: SparkSession, d: str) -> DataFrame:
    l = table(spark, d, "lineitem", "l_suppkey", "l_returnflag", "l_discount", "l_tax", "l_quantity", "l_linestatus")  # noqa: E741
    return l.select((F.col("l_suppkey") % 30).cast("int").alias("exp"), F.col("l_returnflag").alias("method"), F.col("l_discount").alias("micro_f1"), F.col("l_tax").alias("hallucination_rate"), F.col("l_quantity").alias("runtime_seconds"), (F.col("l_linestatus") == "F").alias("task_success"), F.col("l_quantity").cast("int").alias("items_total"))


_ROWS_SQL = "SELECT CAST(l_suppkey % 30 AS INT) AS exp, l_returnflag AS method, l_discount AS micro_f1, l_tax AS hallucination_rate, l_quantity AS runtime_seconds, l_linestatus = 'F' AS task_success, CAST(l_quantity AS INT) AS items_total FROM lineitem"


def method_summary(spark: SparkSession, d: str) -> DataFrame:
    s = report.method_summary(report.poster_scope(_report_rows(spark, d)))
    return s.select("method", "n", *[r6(F.col(c)).alias(c) for c in s.columns if c not in ("method", "n")])


def runtime_by_method(spark: SparkSession, d: str) -> DataFrame:
    return report.runtime_by_method(_report_rows(spark, d)).select("method", r6("runtime_mean").alias("runtime_mean"))


def success_by_experiment(spark: SparkSession, d: str) -> DataFrame:
    return report.success_rate(_report_rows(spark, d), "exp").select("exp", r6("success_rate").alias("success_rate"), r6("micro_f1").alias("micro_f1"))


def cube_means(spark: SparkSession, d: str) -> DataFrame:
    return report.cube_means(_report_rows(spark, d)).select("exp", "method", "n", F.round("micro_f1_mean", 8).alias("micro_f1_mean"))


def global_means(spark: SparkSession, d: str) -> DataFrame:
    rows = _report_rows(spark, d)
    for m in report.MEANS:
        if m not in rows.columns:
            rows = rows.withColumn(m, F.col("micro_f1"))
    g = report.global_means(rows)
    return g.select("matched", "skipped", *[r6(F.col(c)).alias(c) for c in ("micro_f1_mean", "hallucination_rate_mean", "task_success_rate")])


def box_stats(spark: SparkSession, d: str) -> DataFrame:
    b = report.box_stats(table(spark, d, "events", "event_type", "value"), "event_type", "value")
    return b.select("event_type", "n", *[r6(F.col(c)).alias(c) for c in ("q1", "median", "q3", "low", "high")])


# ---- documents --------------------------------------------------------------------------------------------------


def doi_scan(spark: SparkSession, d: str) -> DataFrame:
    """First DOI on the first pages; a document's lines stand for its pages, its paper's DOI is on some of them."""
    docs = table(spark, d, "documents", "doc_id", "paper_id", "text")
    p = table(spark, d, "papers", "paper_id", "doi")
    j = docs.join(p, "paper_id", "left").select("doc_id", F.posexplode(F.split(F.concat_ws("\n", "text", "doi"), "\n")).alias("page", "text"))
    m = pages.metadata(j, "doc_id", title=None)
    return m.select("doc_id", "doi")


_DOI_SQL = r"""WITH j AS (SELECT doc_id, string_split(concat_ws(E'\n', text, doi), E'\n') AS l FROM documents LEFT JOIN papers USING (paper_id)),
p AS (SELECT doc_id, unnest(l) AS t, unnest(range(len(l))) AS page FROM j), d AS (SELECT doc_id, page, regexp_extract(t, '10\.\d{4,}/\S+', 0) AS x FROM p)
SELECT doc_id, coalesce(arg_min(x, page) FILTER (page < 3 AND x <> ''), '') AS doi FROM d GROUP BY doc_id"""


def _sections(spark: SparkSession, d: str) -> DataFrame:
    return segment.sections(segment.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"))


def section_segments(spark: SparkSession, d: str) -> DataFrame:
    return _sections(spark, d).select(F.col("doc").alias("doc_id"), "seg", "section", F.length("page_content").alias("n_chars"), F.md5("page_content").alias("content_md5"))


_STRIP_SQL = r"regexp_replace(x, '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')"
_HEAD_SQL = " OR ".join("regexp_matches(line, '" + h.replace("'", "''") + "')" for h in segment.HEADINGS)
_SEGMENT_SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS x, unnest(range(len(string_split(text, E'\n')))) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, {_STRIP_SQL} AS line FROM l), b AS (SELECT *, ({_HEAD_SQL}) AS head FROM s WHERE line <> ''),
w AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM b),
g AS (SELECT doc_id, seg, coalesce(max(line) FILTER (head), 'Front Matter') AS section, string_agg(line, E'\n' ORDER BY pos) FILTER (NOT head) AS c FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(seg AS BIGINT) AS seg, section, CAST(length(c) AS INT) AS n_chars, md5(c) AS content_md5 FROM g WHERE c IS NOT NULL AND regexp_matches(c, '\S')"""


def upper_segments(spark: SparkSession, d: str) -> DataFrame:
    s = segment.sections(segment.lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), upper=True, default="Unknown")
    return s.select(F.col("doc").alias("doc_id"), "seg", "section")


def procedural_split(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    return docs.where(F.col("text").isNotNull()).select("doc_id", F.size(segment.procedural_parts(F.col("text"))).alias("parts"))


_SPLIT_SQL = r"""WITH b AS (SELECT doc_id, unnest(string_split(text, E'\n\n')) AS x FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, """ + _STRIP_SQL + r""" AS b FROM b), p AS (SELECT doc_id, unnest(string_split(regexp_replace(b, '(\.)[\s\p{Z}]+(After|Then|Subsequently|Next|Finally)', E'\\1\x01\\2', 'g'), E'\x01')) AS part FROM s WHERE b <> ''),
c AS (SELECT doc_id, count(*) FILTER (regexp_matches(part, '[^\s\p{Z}][\s\p{Z}]+[^\s\p{Z}]')) AS n FROM p GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS INT) AS parts FROM (SELECT doc_id FROM documents WHERE text IS NOT NULL) d LEFT JOIN c USING (doc_id)"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    c = segment.chunks(_sections(spark, d))
    return c.select(F.col("doc").alias("doc_id"), "chunk_id", "section", "page_content")


def summary_concat(spark: SparkSession, d: str) -> DataFrame:
    s = _sections(spark, d).select("doc", F.col("seg").alias("chunk_id"), "page_content")
    return extract.summarise_parts(s, extract.FirstWords).select(F.col("doc").alias("doc_id"), F.col("reply").alias("summary"))


_SUMMARY_SQL = _SEGMENT_SQL.replace("SELECT doc_id, CAST(seg AS BIGINT) AS seg, section, CAST(length(c) AS INT) AS n_chars, md5(c) AS content_md5 FROM g WHERE", r"SELECT doc_id, string_agg(left(c, 80), E'\n\n' ORDER BY seg) AS summary FROM g WHERE") + " GROUP BY doc_id"


def retrieval_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.nearest(q, e, "query_id", "embedding", "vec_id", "embedding", k=4).select("query_id", "vec_id", F.round("distance", 5).alias("distance"), "rank")


_TOPK_SQL = """WITH q AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 20 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS w FROM embeddings),
x AS (SELECT query_id, vec_id, list_distance(v, w) AS d, row_number() OVER (PARTITION BY query_id ORDER BY list_distance(v, w), vec_id) AS rank FROM q, e)
SELECT query_id, vec_id, round(d, 5) AS distance, CAST(rank AS INT) AS rank FROM x WHERE rank <= 4"""


def rag_context(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    docs = table(spark, d, "documents", "doc_id", "text").withColumn("text", F.coalesce("text", F.lit("")))
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    hits = retrieve.nearest(q, e, "query_id", "embedding", "vec_id", "embedding", k=2)
    queries = docs.select(F.col("doc_id").alias("query_id"), "text")
    return retrieve.augment(hits, docs, "query_id", "vec_id", "doc_id", "text", queries, "text")


_RAG_SQL = (
    "WITH t AS ("
    + _TOPK_SQL.replace("rank <= 4", "rank <= 2")
    + r"""), d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), p AS (SELECT query_id, string_agg(text, E'\n\n' ORDER BY rank) AS p FROM t JOIN d ON vec_id = doc_id GROUP BY 1)
SELECT query_id, concat_ws(E'\n\n', text, 'Context:', p) AS message FROM p JOIN d ON query_id = doc_id"""
)


# ---- conversations ----------------------------------------------------------------------------------------------


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    role = F.when(F.col("event_type") == "signup", "system").when(F.col("event_type").isin("click", "view"), "user").when(F.col("event_type") == "purchase", "assistant").otherwise("tool")
    return e.select((F.col("event_id") % 2000).alias("conv_id"), F.col("event_id").alias("turn"), role.alias("role"), F.format_string("t%s", F.col("event_id")).alias("text"))


_CONV_SQL = "SELECT event_id % 2000 AS conv_id, event_id AS turn, CASE WHEN event_type = 'signup' THEN 'system' WHEN event_type IN ('click', 'view') THEN 'user' WHEN event_type = 'purchase' THEN 'assistant' ELSE 'tool' END AS role, concat('t', event_id) AS text FROM events"


def chat_last_user(spark: SparkSession, d: str) -> DataFrame:
    return chat.last_user(_conversations(spark, d))


def chat_merge_roles(spark: SparkSession, d: str) -> DataFrame:
    return chat.merge_roles(_conversations(spark, d))


_MERGE_SQL = rf"""WITH c AS ({_CONV_SQL}), k AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM c WHERE role <> 'tool'),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> role THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM k),
g AS (SELECT conv_id, run, min(turn) AS turn, any_value(role) AS role, string_agg(text, E'\n\n' ORDER BY turn) AS text FROM r GROUP BY 1, 2),
l AS (SELECT conv_id, max(run) FILTER (role <> 'assistant') AS keep, bool_or(role = 'user') AS has, max(turn) AS e FROM g GROUP BY 1)
SELECT g.conv_id, turn, role, text FROM g JOIN l USING (conv_id) WHERE run <= keep
UNION ALL SELECT conv_id, coalesce(e, -1) + 1, 'user', ' ' FROM (SELECT DISTINCT conv_id FROM c) LEFT JOIN l USING (conv_id) WHERE NOT coalesce(has, false)"""


def chat_fold_system(spark: SparkSession, d: str) -> DataFrame:
    return chat.fold_system(_conversations(spark, d).where("role <> 'tool'"))


# ---- joins ------------------------------------------------------------------------------------------------------


def doi_join(spark: SparkSession, d: str) -> DataFrame:
    preds = table(spark, d, "papers", "paper_id", "doi").select("paper_id", T.canonical_id(F.col("doi")).alias("doi"))
    gold = table(spark, d, "bibliography", "entry_id", "doi").select(F.col("entry_id").cast("string").alias("gold_path"), T.canonical_id(F.col("doi")).alias("doi"))
    return joins.by_identifier(preds, gold).select("paper_id", "doi", "doi_gold")


def _id_sql(x: str) -> str:
    return rf"coalesce(trim(regexp_replace(regexp_replace(regexp_replace(lower(trim({x})), '\.pdf(\.json)?$', ''), '\.json$', ''), '[^a-z0-9]+', '_', 'g'), '_'), '')"


def stem_join(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "extraction_records", "record_id", "path").select("record_id", T.stem_id(F.col("path")).alias("stem"))
    g = table(spark, d, "papers", "file", "paper_id").select(T.stem_id(F.col("file")).alias("stem"), F.lpad(F.col("paper_id").cast("string"), 12, "0").alias("gold_path"))
    return joins.by_stem(p, g).select("record_id", "stem", "stem_gold")


def fuzzy_join(spark: SparkSession, d: str) -> DataFrame:
    """Each typed role, once, to the nearest entry of the reference list."""
    roles = table(spark, d, "acids_and_solvents", "role").where("role IS NOT NULL").distinct()
    p = roles.select(F.col("role").alias("path"), F.lower("role").alias("title"), F.lit("").alias("source"), F.lit("").alias("stem"))
    g = table(spark, d, "vocab", "term_id", "term").select(F.lpad(F.col("term_id").cast("string"), 6, "0").alias("gold_path"), F.col("term").alias("title"), F.lit("").alias("source"), F.lit("").alias("stem"))
    return joins.nearest_by_text(p, g).select(F.col("path").alias("role"), F.col("fuzzy_gold").alias("term"), r6("ratio").alias("ratio"))


def timing_concat(spark: SparkSession, d: str) -> DataFrame:
    """Objects written one after the other, per user, then read back; the last of a file wins."""
    e = table(spark, d, "events", "event_id", "user_id", "event_type", "value")
    obj = F.format_string('{"file": "%s.pdf", "rag_time": %s}', F.col("event_type"), F.col("event_id").cast("string"))
    t = e.groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", obj.alias("o")))), lambda x: x["o"]), "").alias("t"))
    return records.concatenated_objects(t, "t", ["user_id"]).select("user_id", "stem", "rag_time", "full_summary_time")


def latest_document(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "paper_id", "n_chars").where("paper_id IS NOT NULL")
    return joins.first_by(docs, "paper_id", F.coalesce("n_chars", F.lit(-1)), "doc_id").select("paper_id", "doc_id", "n_chars")


def key_sets(spark: SparkSession, d: str) -> DataFrame:
    """Keys on both sides, tagged by side: union, intersection and difference of sections' keys."""
    k = _items(spark, d, "R", "A").select("l_returnflag", "section", "key")
    r, a = (k.where(F.col("l_returnflag") == f).select("section", "key") for f in ("R", "A"))
    return r.intersect(a).withColumn("side", F.lit("both")).unionByName(r.exceptAll(a).distinct().subtract(r.intersect(a)).withColumn("side", F.lit("pred")))


_SETS_SQL = f"WITH k AS (SELECT DISTINCT l_returnflag, section, key FROM ({_ITEMS_SQL})), r AS (SELECT section, key FROM k WHERE l_returnflag = 'R'), a AS (SELECT section, key FROM k WHERE l_returnflag = 'A') SELECT *, 'both' AS side FROM (SELECT * FROM r INTERSECT SELECT * FROM a) UNION ALL SELECT *, 'pred' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM a)"


QUERIES = {
    "record_report": record_report, "canon_text": canon_text, "canon_text_unicode": canon_text_unicode, "canon_isotope": canon_isotope, "canon_concentration": canon_concentration, "canon_chemical": canon_chemical,
    "canon_id": canon_id, "path_filter": path_filter, "retry_hints": retry_hints, "sanitized": sanitized, "distinct_keys": distinct_keys, "completeness_duplicates": completeness_duplicates, "exact_report": exact_report,
    "relaxed_report": relaxed_report, "task_success": task_success, "json_items": json_items, "json_records": json_records, "method_summary": method_summary, "runtime_by_method": runtime_by_method,
    "success_by_experiment": success_by_experiment, "cube_means": cube_means, "global_means": global_means, "box_stats": box_stats, "doi_scan": doi_scan, "section_segments": section_segments, "upper_segments": upper_segments,
    "procedural_split": procedural_split, "chunks": chunks, "summary_concat": summary_concat, "retrieval_topk": retrieval_topk, "rag_context": rag_context, "chat_last_user": chat_last_user, "chat_merge_roles": chat_merge_roles,
    "chat_fold_system": chat_fold_system, "doi_join": doi_join, "stem_join": stem_join, "fuzzy_join": fuzzy_join, "timing_concat": timing_concat, "latest_document": latest_document, "key_sets": key_sets,
}

ORACLE = {
    "canon_text": f"SELECT p_partkey, {ct_sql('''concat_ws('  ', p_name, '~', p_brand, p_size, 'x', p_size)''')} AS canon FROM part",
    "canon_isotope": rf"""WITH t AS (SELECT p_partkey, {ct_sql(_ISOTOPE_SQL)} AS t FROM part) SELECT p_partkey, CASE WHEN regexp_matches(replace(t, ' ', ''), '^\d{{1,3}}[a-z]{{1,3}}$') THEN concat(CAST(regexp_extract(t, '^(\d+)', 1) AS INT), regexp_extract(replace(t, ' ', ''), '([a-z]+)$', 1))
      WHEN regexp_matches(t, '^[a-z]+\s*[- ]\s*\d{{1,3}}$') THEN concat(CAST(regexp_extract(t, '(\d+)$', 1) AS INT), CASE regexp_extract(t, '^([a-z]+)', 1) WHEN 'cobalt' THEN 'co' ELSE left(regexp_extract(t, '^([a-z]+)', 1), 2) END) ELSE t END AS canon FROM t""",
    "canon_concentration": rf"""WITH t AS (SELECT p_partkey, {ct_sql(_CONC_SQL)} AS t FROM part), n AS (SELECT *, TRY_CAST(regexp_extract(t, '^(\d+(\.\d+)?)\s*m$', 1) AS DOUBLE) AS n FROM t)
      SELECT p_partkey, CASE WHEN contains(t, 'concentrated') THEN 'concentrated' WHEN n IS NOT NULL THEN concat(CASE WHEN n = round(n) THEN CAST(CAST(n AS BIGINT) AS VARCHAR) ELSE CAST(n AS VARCHAR) END, ' m') ELSE t END AS canon FROM n""",
    "canon_chemical": rf"""WITH t AS (SELECT p_partkey, {ct_sql(_CHEM_SQL)} AS t FROM part), e AS (SELECT *, regexp_replace(t, '^\d+(\.\d+)?\s*m\s+', '') AS e FROM t) SELECT p_partkey, {_chem_sql('t')} AS chemical, {_chem_sql('e')} AS eluent FROM e""",
    "canon_id": rf"SELECT record_id, {_id_sql('path')} AS id, {_id_sql('''string_split(path, '/')[-1]''')} AS stem, TRY_CAST(regexp_extract(path, '(?:^|/)[eE][xX][pP](\d+)(?:/|$)', 1) AS INT) AS exp FROM extraction_records",
    "path_filter": r"SELECT record_id, exp, CASE kind WHEN 'rag_output' THEN 'RAG' WHEN 'section_summaries' THEN 'SECTION_SUMMARIES' WHEN 'full_summary' THEN 'FULL_SUMMARY' END AS method FROM (SELECT record_id, kind, path, TRY_CAST(regexp_extract(path, '(?:^|/)[eE][xX][pP](\d+)(?:/|$)', 1) AS INT) AS exp FROM extraction_records) WHERE exp >= 18 AND string_split(path, '/')[-2] = kind",
    "retry_hints": "SELECT event_id, round(CASE event_type WHEN 'error' THEN event_id / 1000 WHEN 'click' THEN event_id % 60 + 0.5 END, 6) AS wait_s FROM events",
    "sanitized": r"""SELECT doc_id, CASE WHEN length(text) > 500 THEN concat(regexp_replace(left(text, 460), '[\s\p{Z}]+$', ''), E'\n\n[... content truncated for API limits ...]') ELSE text END AS clean FROM documents""",
    "distinct_keys": f"SELECT record_key, section, count(*) AS items, count(DISTINCT key) AS unique_keys FROM ({_ITEMS_SQL}) WHERE l_returnflag = 'R' GROUP BY 1, 2",
    "completeness_duplicates": f"WITH s AS (SELECT record_key, section, count(*) AS items, count(DISTINCT key) AS u FROM ({_ITEMS_SQL}) WHERE l_returnflag = 'R' GROUP BY 1, 2) SELECT record_key, round(count(*) / 5, 6) AS completeness, CAST(sum(items) AS BIGINT) AS items_total, CAST(sum(items) - sum(u) AS BIGINT) AS duplicates, round((sum(items) - sum(u)) / sum(items), 6) AS duplicate_rate FROM s GROUP BY 1",
    "exact_report": _EXACT_SQL,
    "task_success": _SUCCESS_SQL,
    "json_items": _ITEMS_JSON_SQL,
    "json_records": _RECORD_SQL,
    "method_summary": f"SELECT method, count(*) AS n, round(avg(micro_f1), 6) AS micro_f1_mean, round(median(micro_f1), 6) AS micro_f1_median, round(avg(hallucination_rate), 6) AS hallucination_rate_mean, round(median(hallucination_rate), 6) AS hallucination_rate_median, round(avg(runtime_seconds), 6) AS runtime_seconds_mean, round(median(runtime_seconds), 6) AS runtime_seconds_median, round(avg(CAST(task_success AS DOUBLE)), 6) AS task_success_rate FROM ({_ROWS_SQL}) WHERE exp IN (18, 19, 20, 24, 25) AND items_total > 0 GROUP BY 1",
    "runtime_by_method": f"SELECT method, round(avg(runtime_seconds), 6) AS runtime_mean FROM ({_ROWS_SQL}) GROUP BY 1",
    "success_by_experiment": f"SELECT exp, round(avg(CAST(task_success AS DOUBLE)), 6) AS success_rate, round(avg(micro_f1), 6) AS micro_f1 FROM ({_ROWS_SQL}) GROUP BY 1",
    "cube_means": f"SELECT exp, method, count(*) AS n, round(avg(micro_f1), 8) AS micro_f1_mean FROM ({_ROWS_SQL}) GROUP BY CUBE (exp, method)",
    "global_means": f"SELECT count(micro_f1) AS matched, count(*) - count(micro_f1) AS skipped, round(avg(micro_f1), 6) AS micro_f1_mean, round(avg(hallucination_rate), 6) AS hallucination_rate_mean, round(avg(CAST(task_success AS DOUBLE)), 6) AS task_success_rate FROM ({_ROWS_SQL})",
    "box_stats": "WITH q AS (SELECT event_type, count(value) AS n, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1) SELECT q.event_type, q.n, round(q1, 6) AS q1, round(q.median, 6) AS median, round(q3, 6) AS q3, round(min(value), 6) AS low, round(max(value), 6) AS high FROM q JOIN events e ON q.event_type = e.event_type AND value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY ALL",
    "doi_scan": _DOI_SQL,
    "section_segments": _SEGMENT_SQL,
    "procedural_split": _SPLIT_SQL,
    "summary_concat": _SUMMARY_SQL,
    "retrieval_topk": _TOPK_SQL,
    "rag_context": _RAG_SQL,
    "chat_last_user": f"SELECT conv_id, 'user' AS role, coalesce(arg_max(text, turn) FILTER (role = 'user'), ' ') AS text FROM ({_CONV_SQL}) GROUP BY 1",
    "chat_merge_roles": _MERGE_SQL,
    "doi_join": f"WITH g AS (SELECT {_id_sql('doi')} AS doi, max(CAST(entry_id AS VARCHAR)) AS doi_gold FROM bibliography GROUP BY 1 HAVING {_id_sql('doi')} <> ''), p AS (SELECT paper_id, {_id_sql('doi')} AS doi FROM papers) SELECT paper_id, doi, doi_gold FROM p LEFT JOIN g USING (doi)",
    "stem_join": f"""WITH p AS (SELECT record_id, {_id_sql("string_split(path, '/')[-1]")} AS stem FROM extraction_records), g AS (SELECT {_id_sql('file')} AS stem, min(lpad(CAST(paper_id AS VARCHAR), 12, '0')) AS stem_gold FROM papers GROUP BY 1) SELECT record_id, stem, stem_gold FROM p LEFT JOIN g USING (stem)""",
    "timing_concat": "SELECT user_id, event_type AS stem, CAST(max(event_id) AS DOUBLE) AS rag_time, 0.0::DOUBLE AS full_summary_time FROM events GROUP BY 1, 2",
    "latest_document": "SELECT paper_id, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS rn FROM documents WHERE paper_id IS NOT NULL) WHERE rn = 1",
    "key_sets": _SETS_SQL,
    "p7_found": P7_SQL,
}
