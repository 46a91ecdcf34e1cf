"""Bring visually identical text to one form (embedded SQL engine inside Arrow partitions).

Cases: null -> null form, not flagged; empty and blank text unchanged; very long texts are handled
whole; repeated rows give repeated output rows (found() reports each key once); empty input gives an
empty result; only the columns named are read, so extra columns never clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataform.functions.lookalikes import GREEK_ALONE, INVISIBLE, fold_pairs, wide_pairs
from strataform.session import ship

#: What may stay: ASCII, super- and subscript digits, four signs, accented letters in one character
#: (Latin-1 and Latin Extended-A without the dotless and long forms), Greek letters, the micro sign.
ORDINARY = "\\x{9}\\x{A}\\x{D}\\x{20}-\\x{7E}²³¹⁰⁴-⁹₀-₉–·×°µßÀ-ÖØ-öø-ÿĀ-İĲ-ķĹ-ŉŌ-žΑ-Ωα-ω"


def sql_form(value: str) -> tuple[str, str]:
    """SQL expressions (one form, looks different underneath) for a text expression."""
    a, b = fold_pairs()
    q = lambda s: "'" + s.replace("'", "''") + "'"
    wide = value
    for x, y in wide_pairs().items():
        wide = f"replace({wide}, {q(x)}, {q(y)})"
    wide = f"CASE WHEN regexp_matches({value}, {q('[' + ''.join(wide_pairs()) + ']')}) THEN {wide} ELSE {value} END"
    gone = f"regexp_replace(nfc_normalize({wide}), {q('[' + INVISIBLE + ']')}, '', 'g')"
    one = f"translate({gone}, {q(a)}, {q(b)})"
    for g, latin in zip(*GREEK_ALONE, strict=True):  # Greek letters inside a word are look-alikes
        one = f"regexp_replace({one}, {q(f'([A-Za-z]){g}')}, {q(chr(92) + '1' + latin)}, 'g')"
        one = f"regexp_replace({one}, {q(f'{g}([A-Za-z])')}, {q(latin + chr(92) + '1')}, 'g')"
    one = f"nfc_normalize({one})"
    odd = f"({one} IS DISTINCT FROM {value} OR regexp_matches({value}, {q('[^' + ORDINARY + chr(92) + 'p{S}' + chr(92) + 'p{P}]')}))"
    return one, odd


def unify(df: DataFrame, column: str, keep: list[str], flagged_only: bool = False) -> DataFrame:
    """keep columns plus form STRING (the text in one consistent form) and odd BOOLEAN (the text holds
    invisible characters, odd spaces, other-width or styled forms, separate accents or look-alikes).
    flagged_only drops the rows that are not odd inside the partition. No shuffle."""
    one, odd = sql_form("v")
    src = df.select(*keep, F.col(column).alias("__v"))
    names = list(keep)
    query = f"SELECT i, {one} AS form, coalesce({odd}, false) AS odd FROM t" + (f" WHERE coalesce({odd}, false)" if flagged_only else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"})
        try:
            for b in batches:
                if not b.num_rows:
                    continue
                v = b.column(len(names))
                t = pa.table({"i": pa.array(range(b.num_rows), pa.int64()), "v": v})  # noqa: F841
                con.register("t", t)
                r = con.sql(query).to_arrow_table()
                con.unregister("t")
                cols = [b.column(k).take(r["i"].combine_chunks()) for k in range(len(names))]
                out = pa.table([*cols, r["form"].cast(pa.string()), r["odd"]], names=[*names, "form", "odd"])
                yield from out.to_batches()
        finally:
            con.close()

    ship(df.sparkSession)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1])
    return src.mapInArrow(run, f"{schema}, form string, odd boolean")


_ASCII = "^[\\x09\\x0A\\x0D\\x20-\\x7E]*$"


def found(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(item_id, field) of each value that is not in ordinary characters. tables: (df, column, field).
    Plain ASCII values, most of all, are passed by before they leave the JVM."""
    parts = [
        unify(df.where(F.col(c).isNotNull() & ~F.col(c).rlike(_ASCII)), c, ["item_id"], flagged_only=True).select("item_id", F.lit(f).alias("field"))
        for df, c, f in tables
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def forms(tables: list[tuple[DataFrame, str, str]]) -> DataFrame:
    """(item_id, field, form, odd) of each value, odd or not. tables: (df, column, field)."""
    parts = [unify(df, c, ["item_id"]).select("item_id", F.lit(f).alias("field"), "form", "odd") for df, c, f in tables]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def unify_local(text: str | None) -> str | None:
    """The same form by plain Python; the tests hold the embedded SQL against it."""
    import unicodedata

    if text is None:
        return None
    a, b = fold_pairs()
    s = unicodedata.normalize("NFC", "".join(wide_pairs().get(c, c) for c in text))
    s = "".join(c for c in s if c not in INVISIBLE).translate(str.maketrans(a, b))
    for g, latin in zip(*GREEK_ALONE, strict=True):
        s = re.sub(f"([A-Za-z]){g}", rf"\1{latin}", s)
        s = re.sub(f"{g}([A-Za-z])", rf"{latin}\1", s)
    return unicodedata.normalize("NFC", s)
