"""Registered queries of the training-text operators: pN_... over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataform.llm import copies, langid, leakage, linkage, lookalike, scans, tokens, vocab_map
from strataform.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    acids = table(spark, d, "acids_and_solvents", "item_id", "name", "type", "role")
    elution = table(spark, d, "elution_conditions", "item_id", "eluent")
    cols = [(acids, "name", "name", "substance"), (acids, "type", "type", "type"), (acids, "role", "role", "role"), (elution, "eluent", "eluent", "substance")]
    return vocab_map.found(spark, cols, table(spark, d, "vocab"))


def _links(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "papers", "paper_id", "title", "doi", "source", "n_pages")
    books = table(spark, d, "bibliography", "entry_id", "title", "doi", "source", "pub_year", "page_count")
    a = {"key": "paper_id", "title": "title", "doi": "doi", "source": "source", "pages": "n_pages", "year": None}
    b = {"key": "entry_id", "title": "title", "doi": "doi", "source": "source", "pages": "page_count", "year": "pub_year"}
    return linkage.link(papers, books, a, b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _links(spark, d).select("paper_id", "entry_id").distinct()


def _forms(spark: SparkSession, d: str) -> list[tuple[DataFrame, str, str]]:
    t = lambda n, c: (table(spark, d, n, "item_id", c), c, c)
    return [t("acids_and_solvents", "concentration"), t("target_materials", "isotope"), t("target_materials", "chemical_formula")]


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return lookalike.found(_forms(spark, d))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "raw_items", "raw_id", "paper_id", "section", "payload"), "raw_id", ["paper_id", "section"], "payload")


def _quotes(spark: SparkSession, d: str) -> DataFrame:
    parts = [table(spark, d, t, "item_id", "source_section") for t in ("acids_and_solvents", "elution_conditions", "target_materials")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_records(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record, with its number of copies."""
    return copies.collapsed(table(spark, d, "raw_items", "raw_id", "paper_id", "section", "payload"), "raw_id", ["paper_id", "section"], "payload")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return scans.found(_quotes(spark, d))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


def p5_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    """The repaired text of every quote."""
    q = _quotes(spark, d)
    words, model = scans.fit(q, "source_section")
    return scans.clean(q, "item_id", "source_section", words, model).select("item_id", "paragraph").distinct()


def p2_matches(spark: SparkSession, d: str) -> DataFrame:
    """The links with their confidence."""
    return _links(spark, d)


def p3_forms(spark: SparkSession, d: str) -> DataFrame:
    """Every concentration, isotope and chemical formula in its one form."""
    return lookalike.forms(_forms(spark, d))


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every segment with its language and confidence."""
    docs = table(spark, d, "documents", "doc_id", "text", "lang")
    return langid.segments(docs, "doc_id", "text", langid.train(langid.training_rows(docs, "text", "lang"))).drop("best")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    docs, tests = table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark", "item_id", "text")
    return leakage.scan(docs, tests, "doc_id", "text", "item_id", "text").select("doc_id", "item_id")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return langid.found(table(spark, d, "documents", "doc_id", "text", "lang"), "doc_id", "text", "lang")


QUERIES: dict[str, Query] = {"p1_found": p1_found, "p2_found": p2_found, "p2_matches": p2_matches, "p3_found": p3_found, "p3_forms": p3_forms, "p4_found": p4_found, "p4_records": p4_records, "p5_found": p5_found, "p5_paragraphs": p5_paragraphs, "p8_ids": p8_ids, "p9_found": p9_found, "p10_found": p10_found, "p10_segments": p10_segments}
_ORDINARY = "[^\\x09\\x0A\\x0D\\x20-\\x7E²³¹⁰⁴-⁹₀-₉–·×°µßÀ-ÖØ-öø-ÿĀ-İĲ-ķĹ-ŉŌ-žαβγ]"
_FORM_COLUMNS = (("acids_and_solvents", "concentration"), ("target_materials", "isotope"), ("target_materials", "chemical_formula"))
_ODD = " UNION ".join(
    f"SELECT item_id, '{c}' AS field FROM {t} WHERE regexp_matches({c}, '{_ORDINARY}') OR nfc_normalize({c}) <> {c}"
    for t, c in _FORM_COLUMNS
)
_FORM = " UNION ".join(f"SELECT item_id, '{c}' AS field, {one} AS form, coalesce({odd}, false) AS odd FROM {t}" for t, c in _FORM_COLUMNS for one, odd in [lookalike.sql_form(c)])
_NAME = "regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')".format
# two letters stand in for the points inside numbers and the percent signs that stay
_POINTS = "regexp_replace(regexp_replace(lower({}), '([0-9])\\.([0-9])', '\\1ꙮ\\2', 'g'), '([0-9])\\.([0-9])', '\\1ꙮ\\2', 'g')".format
_VALUE = lambda v: f"translate(regexp_replace(replace({_POINTS(v)}, '%', 'ꙭ'), '[\\s\\p{{Z}}\\p{{P}}\\p{{C}}\\x0B]+', '', 'g'), 'ꙮꙭ', '.%')"
_COPIES = f"""WITH r AS (SELECT raw_id, paper_id, section, payload, coalesce(regexp_matches(payload, '^\s*\{{'), false) AS js FROM raw_items),
j AS (SELECT raw_id, k AS name, json_extract_string(payload, concat('$."', k, '"')) AS value FROM (SELECT raw_id, payload, unnest(json_keys(payload)) AS k FROM r WHERE js AND json_valid(payload))),
s AS (SELECT raw_id, unnest(CASE WHEN contains(payload, '|') THEN string_split(payload, '|') WHEN contains(payload, ';') THEN string_split(payload, ';') ELSE string_split_regex(payload, '\r\n|\n|\r') END) AS part FROM r WHERE NOT js),
v AS (SELECT raw_id, CASE WHEN regexp_matches(part, '[:=]') THEN regexp_extract(part, '^([^:=]*)[:=]', 1) ELSE '' END AS name, CASE WHEN regexp_matches(part, '[:=]') THEN regexp_extract(part, '(?s)^[^:=]*[:=](.*)$', 1) ELSE part END AS value FROM s),
a AS (SELECT * FROM j UNION ALL SELECT * FROM v UNION ALL SELECT raw_id, '', payload FROM r WHERE js AND NOT json_valid(payload)),
n AS (SELECT raw_id, {_NAME('name')} AS name, {_VALUE('value')} AS value FROM a),
g AS (SELECT r.raw_id, paper_id, section, coalesce(list_sort(list(name || chr(1) || value) FILTER (value <> '')), []) AS f FROM r LEFT JOIN n USING (raw_id) GROUP BY ALL),
m AS (SELECT *, min(raw_id) OVER (PARTITION BY paper_id, section, f) AS first_id FROM g)
SELECT first_id, raw_id AS copy_id FROM m WHERE raw_id <> first_id"""
ORACLE: dict[str, str] = {"p3_found": _ODD, "p3_forms": _FORM, "p4_found": _COPIES}
