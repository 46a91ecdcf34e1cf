"""Registered queries of record scoring, record joins and small text operators, each with its SQL counterpart.

The SQL texts spell the definitions out once more: canonical forms, item keys, greedy relaxed matching.
"""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions import text as T
from strataform.operators import chat, extract, joins, match, metrics, nested, report, segment
from strataform.plans import reference_queries as R
from strataform.sources import records, sinks
from strataform.sources.tables import table

# ---- SQL of the canonical forms ---------------------------------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@cache
def _compatible() -> tuple[str, str, dict[str, str]]:
    """Compatibility forms by Unicode's data: characters and what they become (one character), and those that become
    several."""
    one, to, many = [], [], {}
    for cp in [*range(0xA0, 0x2500), *range(0x3000, 0x3040), *range(0xFB00, 0xFB07), *range(0xFF01, 0xFFEF), *range(0x1D400, 0x1D800)]:
        c = chr(cp)
        n = unicodedata.normalize("NFKC", c)
        if n == c or unicodedata.normalize("NFC", c) == n:
            continue
        if len(n) == 1:
            one.append(c)
            to.append(n)
        else:
            many[c] = n
    return "".join(one), "".join(to), many


def nfkc_sql(x: str) -> str:
    a, b, many = _compatible()
    wide = x
    for c, n in many.items():
        wide = f"replace({wide}, {_q(c)}, {_q(n)})"
    wide = f"CASE WHEN regexp_matches({x}, {_q('[' + ''.join(many) + ']')}) THEN {wide} ELSE {x} END"
    return f"CASE WHEN regexp_matches({x}, '[^\\x00-\\x7F]') THEN nfc_normalize(translate({wide}, {_q(a)}, {_q(b)})) ELSE {x} END"


_SPACE = "[\\s\\p{Z}\\x{85}\\x{1C}-\\x{1F}\\x0B]"


def canon_sql(x: str) -> str:
    """Canonical text of any text."""
    y = f"replace(translate({nfkc_sql(x)}, '×−–—·•µ', 'x---  u'), 'Ω', 'ohm')"
    y = f"lower(regexp_replace({y}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))"
    y = f"regexp_replace({y}, '{_SPACE}+', ' ', 'g')"
    y = rf"regexp_replace({y}, '[^\p{{L}}\p{{Nl}}\p{{M}}\p{{Nd}}\p{{Pc}}\x{{200C}}\x{{200D}}.\-+()/]+', ' ', 'g')"
    y = rf"regexp_replace({y}, '(\p{{Nd}})\s*[- ]?\s*x\s*[- ]?\s*(\p{{Nd}})', '\1x\2', 'g')"
    return rf"coalesce(trim(regexp_replace({y}, '\s+', ' ', 'g')), '')"


def _isotope_sql(t: str) -> str:
    element = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in T.ELEMENTS.items())
    name = rf"regexp_extract({t}, '^([a-z]+)\s*[- ]\s*([0-9]{{1,3}})$', 1)"
    packed = f"replace({t}, ' ', '')"
    return rf"""CASE WHEN regexp_matches({packed}, '^[0-9]{{1,3}}[a-z]{{1,3}}$') THEN concat(CAST(regexp_extract({packed}, '^([0-9]+)', 1) AS INT), regexp_extract({packed}, '([a-z]+)$', 1))
      WHEN regexp_matches({t}, '^[a-z]+\s*[- ]\s*[0-9]{{1,3}}$') THEN concat(CAST(regexp_extract({t}, '([0-9]+)$', 1) AS INT), CASE {name} {element} ELSE left({name}, 2) END) ELSE {t} END"""


def _concentration_sql(t: str) -> str:
    n = rf"TRY_CAST(regexp_extract({t}, '^(\d+(?:\.\d+)?)\s*m$', 1) AS DOUBLE)"
    return f"CASE WHEN contains({t}, 'concentrated') THEN 'concentrated' WHEN {n} IS NOT NULL THEN concat(CASE WHEN {n} = round({n}) THEN CAST(CAST({n} AS HUGEINT) AS VARCHAR) ELSE printf('%g', {n}) END, ' m') ELSE {t} END"


# ---- item keys and the record report ----------------------------------------------------------------------------

_FIELDS = [f for f in metrics.FIELDS if f != "yield_"]


def _items_sql() -> str:
    """Per item: its fields as texts (raw_) and in canonical form (c_), key, and what the scores are made of."""
    items = " UNION ALL ".join(
        f"SELECT record_id, '{s}' AS section, i AS item_no, json_extract(record, concat('$.{s}.items[', i, ']')) AS item FROM (SELECT record_id, record, unnest(range(CAST(json_array_length(record, '$.{s}.items') AS BIGINT))) AS i FROM o WHERE json_type(record, '$.{s}.items') = 'ARRAY') WHERE json_type(record, concat('$.{s}.items[', i, ']')) = 'OBJECT'"
        for s in metrics.SECTIONS
    )
    texts = ", ".join(f"{{'f': '{f}', 'raw': json_extract_string(item, '$.{f}')}}" for f in _FIELDS)
    pivot = ", ".join(f"max(raw) FILTER (f = '{f}') AS raw_{f.lower()}, coalesce(max(canon) FILTER (f = '{f}'), '') AS c_{f.lower()}" for f in _FIELDS)
    eluent = r"regexp_replace(c_eluent, '^\d+(?:\.\d+)?\s*m\s+', '')"
    chem = R._chem_sql
    iso, named, conc = _isotope_sql("c_isotope"), _isotope_sql("c_name"), _concentration_sql("c_concentration")
    join = lambda *parts: "concat_ws('|', " + ", ".join(f"nullif({p}, '')" for p in parts) + ")"
    key = f"""CASE section WHEN 'target_materials' THEN {join(iso, 'c_chemical_formula', 'c_name')} WHEN 'acids_and_solvents' THEN {join(chem('c_name'), 'c_type', conc)} WHEN 'resins_or_columns' THEN {join('c_name', 'c_material')}
      WHEN 'elution_conditions' THEN {join(chem('c_elu'), conc)} ELSE {join(f"CASE WHEN {iso} <> '' THEN {iso} WHEN regexp_matches({named}, '^[0-9]{{1,3}}[a-z]{{1,3}}$') THEN {named} ELSE '' END", 'c_name', 'c_chemical_form')} END"""
    some = lambda pre, names: "(" + " OR ".join(f"regexp_matches(coalesce({pre}{n.lower()}, ''), '[^\\s\\p{{Z}}]')" for n in names) + ")"
    by = lambda f: "CASE section " + " ".join(f"WHEN '{s}' THEN {f(s)}" for s in metrics.SECTIONS) + " END"
    filled = by(lambda s: " + ".join(f"CAST({some('raw_', n)} AS INT)" for n in metrics.REQUIRED[s]))
    return f"""o AS (SELECT record_id, record FROM extraction_records WHERE {R._IS_OBJECT}), it AS ({items}),
u AS (SELECT record_id, section, item_no, unnest([{texts}]) AS x FROM it), t AS (SELECT record_id, section, item_no, x.f AS f, x.raw AS raw, {canon_sql('x.raw')} AS canon FROM u),
p AS (SELECT record_id, section, item_no, {pivot} FROM t GROUP BY 1, 2, 3), e AS (SELECT *, {eluent} AS c_elu FROM p),
k AS (SELECT record_id, section, item_no, {key} AS key, {by(lambda s: str(len(metrics.REQUIRED[s])))} AS checked, {filled} AS filled,
      {by(lambda s: some('c_', metrics.IDENTITY[s]))} AS identity, {by(lambda s: some('c_', metrics.CONDITION[s]))} AS condition, {some('raw_', ['source_section'])} AS sourced FROM e),
s AS (SELECT *, CASE WHEN NOT identity THEN 0.0 WHEN condition THEN 1.0 ELSE 0.6 END AS score, NOT sourced OR NOT identity AS flagged FROM k)"""


def item_keys(spark: SparkSession, d: str) -> DataFrame:
    """Every item with its canonical key and what its record's scores are made of."""
    s = metrics.item_scores(R._record_items(spark, d))
    return s.select(F.col("record_key").alias("record_id"), "section", "key", F.col("checked").cast("int").alias("checked"), F.col("filled").cast("int").alias("filled"), F.round("score", 2).alias("score"), "flagged")


_ITEM_KEYS_SQL = f"WITH {_items_sql()} SELECT record_id, section, key, CAST(checked AS INT) AS checked, CAST(filled AS INT) AS filled, CAST(round(score, 2) AS DOUBLE) AS score, flagged FROM s"
_REPORT_SQL = f"""WITH {_items_sql()},
g AS (SELECT record_id, section, count(*) AS items, count(DISTINCT nullif(key, '')) AS keys, sum(filled) AS filled, sum(checked) AS checked, sum(score) AS score, sum(CAST(flagged AS INT)) AS flagged FROM s GROUP BY 1, 2),
r AS (SELECT record_id, count(section) AS n, coalesce(sum(items), 0) AS items, coalesce(sum(items - keys), 0) AS dup, coalesce(sum(filled), 0) AS filled, coalesce(sum(checked), 0) AS checked, coalesce(sum(score), 0) AS score, coalesce(sum(flagged), 0) AS flagged FROM (SELECT DISTINCT record_id FROM o) LEFT JOIN g USING (record_id) GROUP BY 1)
SELECT record_id, round(CAST(n AS DOUBLE) / 5, 6) AS completeness, CAST(items AS BIGINT) AS items_total, CAST(dup AS BIGINT) AS duplicates,
  {", ".join(f"CAST(round(CASE WHEN {b} = 0 THEN 0.0 ELSE CAST({a} AS DOUBLE) / {b} END, 6) AS DOUBLE) AS {n}" for a, b, n in (("dup", "items", "duplicate_rate"), ("filled", "checked", "schema_validity"), ("score", "items", "heuristic_accuracy"), ("flagged", "items", "heuristic_hallucination")))} FROM r"""

# ---- relaxed matching -------------------------------------------------------------------------------------------

_PART = "(x = y OR (x <> '' AND y <> '' AND regexp_matches(y, '[a-z]') AND contains(x, y)))"


def _fits_sql(x: str, y: str, iso: bool) -> str:
    """Whether predicted key x fits gold key y; the parts of x that are taken travel as a text of positions."""
    free = f"list_filter(range(1, len(string_split({x}, '|')) + 1), lambda i: {_PART.replace('x ', f'string_split({x}, {_q('|')})[i] ').replace('(x,', f'(string_split({x}, {_q('|')})[i],').replace('y ', 'part ').replace('y)', 'part)').replace('(y,', '(part,')} AND NOT contains(s, ',' || i || ','))[1]"
    fold = f"list_reduce(string_split({y}, '|'), lambda s, part: CASE WHEN s = '!' THEN '!' ELSE coalesce(s || {free} || ',', '!') END, ',') <> '!'"
    token = lambda k: f"list_filter(string_split({k}, '|'), lambda z: regexp_matches(z, '^[0-9]{{1,3}}[a-z]{{1,3}}$'))[1]"
    short = f" OR coalesce({token(x)} = {token(y)}, false)" if iso else ""
    return f"({x} = {y} OR ({x} <> '' AND {y} <> '' AND {fold}){short})"


def _tp_sql(iso: bool) -> str:
    first = f"list_filter(range(1, len(gold) + 1), lambda j: NOT contains(u, ',' || j || ',') AND {_fits_sql('p', 'gold[j]', iso)})[1]"
    used = f"list_reduce(pred, lambda u, p: u || coalesce({first} || ',', ''), ',')"
    return f"length({used}) - length(replace({used}, ',', '')) - 1"


_PRF = "CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r"
_F1 = "CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END"
_RELAXED_SQL = f"""WITH k AS (SELECT DISTINCT record_key, section, key, l_returnflag FROM ({R._ITEMS_SQL}) WHERE l_returnflag IN ('R', 'A')),
l AS (SELECT record_key, section, coalesce(list_sort(list(key) FILTER (l_returnflag = 'R')), []) AS pred, coalesce(list_sort(list(key) FILTER (l_returnflag = 'A')), []) AS gold FROM k GROUP BY 1, 2),
m AS (SELECT record_key, coalesce(list_sort(list(section || ':' || key) FILTER (l_returnflag = 'R')), []) AS pred, coalesce(list_sort(list(section || ':' || key) FILTER (l_returnflag = 'A')), []) AS gold FROM k GROUP BY 1),
c AS (SELECT record_key, len(pred) AS np, len(gold) AS ng, CASE WHEN section IN ('target_materials', 'final_products') THEN {_tp_sql(True)} ELSE {_tp_sql(False)} END AS tp FROM l),
s AS (SELECT record_key, tp, np - tp AS fp, ng - tp AS fn FROM c), f AS (SELECT *, {_PRF} FROM s),
a AS (SELECT record_key, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, sum(p) / 5 AS mp, sum(r) / 5 AS mr, sum({_F1}) / 5 AS mf FROM f GROUP BY 1),
b AS (SELECT record_key, tp, np - tp AS fp, ng - tp AS fn FROM (SELECT record_key, len(pred) AS np, len(gold) AS ng, {_tp_sql(False)} AS tp FROM m)), x AS (SELECT *, {_PRF} FROM b)
SELECT x.record_key, round(p, 6) AS micro_precision, round(r, 6) AS micro_recall, round({_F1}, 6) AS micro_f1, round(mp, 6) AS macro_precision, round(mr, 6) AS macro_recall, round(mf, 6) AS macro_f1,
  round(CASE WHEN x.tp + x.fp + x.fn = 0 THEN 1.0 ELSE x.tp / (x.tp + x.fp + x.fn) END, 6) AS jaccard_micro, round(a.fp / greatest(a.tp + a.fp, 1), 6) AS hallucination_rate,
  CAST(a.fp AS INT) AS fabricated, CAST(a.tp AS INT) AS matched, CAST(a.fn AS INT) AS missed FROM x JOIN a ON x.record_key = a.record_key"""


def part_matches(spark: SparkSession, d: str) -> DataFrame:
    """Component match and isotope token over names of parts."""
    p = table(spark, d, "part", "p_partkey", "p_name", "p_size")
    word = F.split("p_name", " ")
    return p.select("p_partkey", match.component_match(F.col("p_name"), word[0]).alias("holds"), match.component_match(word[0], F.col("p_name")).alias("held"), match.isotope_token(F.concat_ws("|", "p_name", F.concat("p_size", F.lit("co")))).alias("token"))


# ---- joins of records -------------------------------------------------------------------------------------------


def gold_modes(spark: SparkSession, d: str) -> DataFrame:
    """Every paper to a published work by stem, else by identifier: the equal-key steps of the cascade."""
    p = table(spark, d, "papers", "paper_id", "file", "doi").select(F.col("paper_id").cast("string").alias("path"), T.stem_id(F.col("file")).alias("stem"), T.canonical_id(F.col("doi")).alias("doi"))
    g = table(spark, d, "bibliography", "entry_id", "title", "doi").select(F.lpad(F.col("entry_id").cast("string"), 12, "0").alias("gold_path"), T.canonical_id(F.col("title")).alias("stem"), T.canonical_id(F.col("doi")).alias("doi"))
    return joins.by_equal_keys(p, g).select("path", "gold_path", "mode")


_MODES_SQL = f"""WITH p AS (SELECT CAST(paper_id AS VARCHAR) AS path, {R._id_sql('file')} AS stem, {R._id_sql('doi')} AS doi FROM papers), g AS (SELECT lpad(CAST(entry_id AS VARCHAR), 12, '0') AS gold_path, {R._id_sql('title')} AS stem, {R._id_sql('doi')} AS doi FROM bibliography),
a AS (SELECT stem, min(gold_path) AS s FROM g GROUP BY 1), b AS (SELECT doi, max(gold_path) AS i FROM g WHERE doi <> '' GROUP BY 1)
SELECT path, coalesce(s, i) AS gold_path, CASE WHEN s IS NOT NULL THEN 'stem' WHEN i IS NOT NULL THEN 'doi' END AS mode FROM p LEFT JOIN a USING (stem) LEFT JOIN b USING (doi)"""


def runtime_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Every extraction record with the run time of its method, paper and experiment, and its experiment's model."""
    r = table(spark, d, "extraction_records", "record_id", "paper_id", "exp", "kind").withColumn("stem", F.col("paper_id").cast("string"))
    p = table(spark, d, "papers", "paper_id", "n_pages")
    hours = lambda k: (F.coalesce("n_pages", F.lit(0)) * k).cast("double")
    timing = p.select(F.lit(18).alias("exp"), F.col("paper_id").cast("string").alias("stem"), hours(3).alias("section_summary_time"), hours(2).alias("full_summary_time"), hours(1).alias("rag_time"))
    models = records.experiment_models(spark, {18: {"model": "alpha"}, 19: {"llm_model": "beta", "model": 3}, 20: {"size": 1}})
    out = joins.with_runtime(r, timing).join(F.broadcast(models), "exp", "left")  # one row an experiment
    return out.select("record_id", "runtime_seconds", "model")


_RUNTIME_SQL = "SELECT record_id, CASE WHEN exp = 18 THEN CAST(coalesce(n_pages, 0) * CASE kind WHEN 'section_summaries' THEN 3 WHEN 'full_summary' THEN 2 WHEN 'rag_output' THEN 1 END AS DOUBLE) END AS runtime_seconds, CASE exp WHEN 18 THEN 'alpha' WHEN 19 THEN 'beta' END AS model FROM extraction_records LEFT JOIN papers USING (paper_id)"


def top_documents(spark: SparkSession, d: str) -> DataFrame:
    """The five longest documents of every paper, as a list."""
    docs = table(spark, d, "documents", "doc_id", "paper_id", "n_chars").where("paper_id IS NOT NULL AND n_chars IS NOT NULL")
    return joins.top_list(docs, "paper_id", "n_chars", "doc_id").select("paper_id", F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


_TOP_SQL = "SELECT paper_id, array_to_string(list(CAST(doc_id AS VARCHAR) ORDER BY n_chars DESC, doc_id)[1:5], ',') AS top FROM documents WHERE paper_id IS NOT NULL AND n_chars IS NOT NULL GROUP BY 1"


def first_paper(spark: SparkSession, d: str) -> DataFrame:
    """The first paper by file name: the mode that runs one document only."""
    return extract.first_document(table(spark, d, "papers", "file", "paper_id"), "file", "paper_id")


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "papers", "paper_id", "file", "title", "doi", "source")
    return p.select("paper_id", T.fingerprint(F.col("doi"), F.col("title"), F.col("source"), F.col("file")).alias("f")).select("paper_id", "f.*")


_PRINTS_SQL = f"""SELECT paper_id, {R._id_sql('doi')} AS doi, {R._id_sql('title')} AS title, {R._id_sql('source')} AS source, {R._id_sql("string_split(file, '/')[-1]")} AS stem FROM papers"""


# ---- texts and conversations ------------------------------------------------------------------------------------


def text_predicates(spark: SparkSession, d: str) -> DataFrame:
    """Non-empty test, model family test and first reply there is, over documents."""
    t = table(spark, d, "documents", "doc_id", "text", "lang", "source")
    return t.select("doc_id", T.nonempty(F.col("text")).alias("nonempty"), F.coalesce(T.is_small_instruct_family(F.col("source"), "a"), F.lit(False)).alias("family"), T.reply_text(F.col("lang"), F.col("text")).alias("reply"))


_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}\\x0B]+|[\\s\\p{{Z}}\\x0B]+$', '', 'g')".format
_PREDICATES_SQL = f"SELECT doc_id, regexp_matches(coalesce(text, ''), '[^\\s\\p{{Z}}]') AS nonempty, contains(lower(coalesce(source, '')), 'a') AS family, {_STRIP('''coalesce(lang, text, '')''')} AS reply FROM documents"


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Section and summary prompts over the segments of every document."""
    from strataform.operators.retrieve import section_prompt, summary_prompt

    s = R._sections(spark, d)
    return s.select(F.col("doc").alias("doc_id"), "seg", F.md5(section_prompt(F.col("section"), F.col("page_content"))).alias("section_prompt"), F.md5(summary_prompt(F.col("section"), F.col("page_content"))).alias("summary_prompt"))


_PROMPTS_SQL = R._SEGMENT_SQL.replace("SELECT doc_id, CAST(seg AS BIGINT) AS seg, section, CAST(length(c) AS INT) AS n_chars, md5(c) AS content_md5 FROM g WHERE", r"SELECT doc_id, CAST(seg AS BIGINT) AS seg, md5(concat('Section (', section, E'):\n\n', c)) AS section_prompt, md5(concat('Summary of ', section, E':\n', c)) AS summary_prompt FROM g WHERE")


def section_dumps(spark: SparkSession, d: str) -> DataFrame:
    """Every document's sections of more than one word, under headers and rules."""
    return sinks.section_dump(R._sections(spark, d), "doc", "section", "page_content", "seg").select(F.col("doc").alias("doc_id"), F.md5("dump").alias("dump"))


_DUMP_SQL = R._SEGMENT_SQL.replace("SELECT doc_id, CAST(seg AS BIGINT) AS seg, section, CAST(length(c) AS INT) AS n_chars, md5(c) AS content_md5 FROM g WHERE", r"SELECT doc_id, md5(string_agg(concat('[', section, E']\n', repeat('-', 80), E'\n', c), E'\n\n' ORDER BY seg)) AS dump FROM g WHERE regexp_matches(c, '[^\s\p{Z}][\s\p{Z}]+[^\s\p{Z}]') AND") + " GROUP BY doc_id"


def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as JSON records, nulls kept."""
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", sinks.record_json(F.struct("s_suppkey", "s_name", F.lit(None).cast("string").alias("note"))).alias("line"))


def flat_rows(spark: SparkSession, d: str) -> DataFrame:
    """The report table in its columns; what a row lacks is null."""
    return report.flat_report(R._report_rows(spark, d).groupBy("exp", "method").agg(F.max("micro_f1").alias("micro_f1"), F.max("items_total").alias("items_total")))


_FLAT_SQL = "SELECT " + ", ".join({"exp": "exp", "method": "method", "micro_f1": "max(micro_f1) AS micro_f1", "items_total": "max(items_total) AS items_total"}.get(c, f"CAST(NULL AS DOUBLE) AS {c}") for c in report.REPORT_COLUMNS) + f" FROM ({R._ROWS_SQL}) GROUP BY exp, method"
_ROLE = "CASE event_type WHEN 'signup' THEN 'SystemMessage' WHEN 'click' THEN 'Human' WHEN 'view' THEN 'user' WHEN 'purchase' THEN 'AIMessage' ELSE 'tool' END"
_ROLES_SQL = "SELECT event_id % 2000 AS conv_id, event_id AS turn, CASE event_type WHEN 'signup' THEN 'system' WHEN 'click' THEN 'user' WHEN 'view' THEN 'user' WHEN 'purchase' THEN 'assistant' END AS role FROM events"


def chat_roles(spark: SparkSession, d: str) -> DataFrame:
    """Roles of messages whatever their classes are called."""
    e = table(spark, d, "events", "event_id", "event_type")
    return chat.with_role(e.select((F.col("event_id") % 2000).alias("conv_id"), F.col("event_id").alias("turn"), F.expr(_ROLE).alias("role"))).select("conv_id", "turn", "role")


def _fold_sql(last: bool) -> str:
    fold = rf"""WITH c AS (SELECT * FROM ({R._CONV_SQL}) WHERE role <> 'tool'), a AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM c),
b AS (SELECT *, role = 'user' AND coalesce(prev = 'system', false) AS js FROM a), e AS (SELECT *, coalesce(lag(js) OVER (PARTITION BY conv_id ORDER BY turn), false) AS pj FROM b),
f AS (SELECT *, CASE role WHEN 'system' THEN coalesce(prev = 'system', false) WHEN 'user' THEN js OR (coalesce(prev = 'user', false) AND NOT pj) ELSE false END AS same FROM e),
r AS (SELECT *, sum(CASE WHEN NOT same OR n <= 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM f),
g AS (SELECT conv_id, run, min(turn) AS turn, arg_min(role, turn) AS r0, max(n) AS n, arg_min(text, turn) AS t0, string_agg(text, E'\n\n' ORDER BY turn) AS t FROM r GROUP BY 1, 2),
h AS (SELECT conv_id, turn, CASE WHEN n > 1 AND r0 = 'system' THEN 'user' ELSE r0 END AS role, CASE WHEN n <= 1 OR r0 = 'assistant' THEN t0 ELSE t END AS text FROM g)"""
    return fold + (" SELECT conv_id, 'user' AS role, coalesce(arg_max(text, turn) FILTER (role = 'user'), ' ') AS text FROM h GROUP BY 1" if last else " SELECT conv_id, turn, role, text FROM h")


def chat_normalised(spark: SparkSession, d: str) -> DataFrame:
    """One user message a conversation: its last one after system messages are folded."""
    return chat.normalise(R._conversations(spark, d).where("role <> 'tool'"), merge_only=False)


_UPPER_SQL = rf"""WITH l AS (SELECT doc_id, unnest(string_split(text, E'\n')) AS x, unnest(range(len(string_split(text, E'\n')))) AS pos FROM documents WHERE text IS NOT NULL),
s AS (SELECT doc_id, pos, {R._STRIP_SQL} AS line FROM l), b AS (SELECT *, upper(line) = line AND lower(line) <> line AND length(line) < 100 AS head FROM s),
w AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS seg FROM b),
g AS (SELECT doc_id, seg, coalesce(max(line) FILTER (head), 'Unknown') AS section, string_agg(line, E'\n' ORDER BY pos) FILTER (NOT head) AS c FROM w GROUP BY 1, 2)
SELECT doc_id, CAST(seg AS BIGINT) AS seg, section FROM g WHERE c IS NOT NULL AND regexp_matches(c, '[^\s\p{{Z}}]')"""


# ---- extraction -------------------------------------------------------------------------------------------------


def extracted_records(spark: SparkSession, d: str) -> DataFrame:
    """All sections of every record by one call, with a model that replies with what it is given; unreadable replies
    and missing sections are empty."""
    texts = table(spark, d, "extraction_records", "record_id", "record").select(F.col("record_id").alias("doc"), F.col("record").alias("text"))
    out = extract.extract_all(texts, extract.Echo)
    n = lambda s: F.expr(f"size(try_variant_get(try_parse_json({s}), '$.items', 'array<variant>'))")
    return out.select(F.col("doc").alias("record_id"), *[n(s).alias(s) for s in metrics.SECTIONS])


_EXTRACTED_SQL = "SELECT record_id, " + ", ".join(f"CAST(CASE WHEN {R._IS_OBJECT} AND json_type(record, '$.{s}.items') = 'ARRAY' THEN json_array_length(record, '$.{s}.items') ELSE 0 END AS INT) AS {s}" for s in metrics.SECTIONS) + " FROM extraction_records"


def _table_sql(section: str) -> str:
    fields = nested.SECTION_FIELDS[section]
    one = lambda f: f"json_extract_string(item, '$.{f}')"
    cols = ", ".join((f"coalesce({one(f)}, {one('yield')})" if f == "yield_" else one(f)) + f" AS {f}" for f in fields)
    return R._FLAT_SQL + f"SELECT record_id AS record_key, item_no, {cols} FROM (SELECT record_id, CAST(i AS INT) AS item_no, json_extract(record, concat('$.{section}.items[', i, ']')) AS item FROM (SELECT record_id, record, unnest(range(CAST(json_array_length(record, '$.{section}.items') AS BIGINT))) AS i FROM o WHERE json_type(record, '$.{section}.items') = 'ARRAY')) WHERE json_type(item) = 'OBJECT'"


QUERIES = {
    "item_keys": item_keys, "part_matches": part_matches, "gold_modes": gold_modes, "runtime_lookup": runtime_lookup, "top_documents": top_documents, "first_paper": first_paper, "fingerprints": fingerprints,
    "text_predicates": text_predicates, "prompts": prompts, "section_dumps": section_dumps, "record_lines": record_lines, "flat_rows": flat_rows, "chat_roles": chat_roles, "chat_normalised": chat_normalised, "extracted_records": extracted_records,
}

ORACLE = {
    "record_report": _REPORT_SQL,
    "relaxed_report": _RELAXED_SQL,
    "canon_text_unicode": f"SELECT doc_id, {canon_sql('text')} AS canon FROM documents",
    "upper_segments": _UPPER_SQL,
    "chat_fold_system": _fold_sql(False),
    "item_keys": _ITEM_KEYS_SQL,
    "part_matches": "SELECT p_partkey, contains(p_name, string_split(p_name, ' ')[1]) AS holds, string_split(p_name, ' ')[1] = p_name OR contains(string_split(p_name, ' ')[1], p_name) AS held, CASE WHEN length(CAST(p_size AS VARCHAR)) <= 3 THEN concat(p_size, 'co') END AS token FROM part",
    "gold_modes": _MODES_SQL,
    "runtime_lookup": _RUNTIME_SQL,
    "top_documents": _TOP_SQL,
    "first_paper": "SELECT file, paper_id FROM papers ORDER BY file, paper_id LIMIT 1",
    "fingerprints": _PRINTS_SQL,
    "text_predicates": _PREDICATES_SQL,
    "prompts": _PROMPTS_SQL,
    "section_dumps": _DUMP_SQL,
    "record_lines": "SELECT s_suppkey, concat('{\"s_suppkey\":', s_suppkey, ',\"s_name\":\"', s_name, '\",\"note\":null}') AS line FROM supplier",
    "flat_rows": _FLAT_SQL,
    "chat_roles": _ROLES_SQL,
    "chat_normalised": _fold_sql(True),
    "extracted_records": _EXTRACTED_SQL,
    "p7_acid_table": _table_sql("acids_and_solvents"),
    "p7_elution_table": _table_sql("elution_conditions"),
    "p7_product_table": _table_sql("final_products"),
    "p7_resin_table": _table_sql("resins_or_columns"),
    "p7_record_table": R._FLAT_SQL + "SELECT record_id AS record_key, " + ", ".join(f"json_extract_string(record, '$.paper_metadata.{f}') AS {f}" for f in ("title", "doi", "source")) + " FROM o",
}
