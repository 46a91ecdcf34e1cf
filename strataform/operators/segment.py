"""Sections and chunks of page text: line sessionisation and recursive chunking."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Shapes of a heading line.
HEADINGS = (r"^\s*\d+\.\s+[A-Z][A-Za-z].+$", r"^\s*\d+\.\d+\.\s+[A-Z][A-Za-z].+$", r"^[A-Z][A-Z\s\-]{3,}$", r"^(Abstract|Introduction|Results|Discussion|Conclusion|References)\b")
# Words that open a new step of a procedure.
STEP_WORDS = ("After", "Then", "Subsequently", "Next", "Finally")


def is_heading(line: Column) -> Column:
    out = F.lit(False)
    for h in HEADINGS:
        out = out | line.rlike(h)
    return out


def is_upper_heading(line: Column) -> Column:
    """Has a cased character, none of them lower, and fewer than 100 characters."""
    return (F.upper(line) == line) & (F.lower(line) != line) & (F.length(line) < 100)


def lines(docs: DataFrame, doc: str, text: str, page: str | None = None) -> DataFrame:
    """doc, pos, line (stripped), page: one row per line, in order."""
    p = F.col(page) if page else F.lit(0)
    pages = docs.select(F.col(doc).alias("doc"), p.alias("page"), F.posexplode(F.split(text, "\n")).alias("at", "raw"))
    return pages.select("doc", "page", F.struct("page", "at").alias("pos"), F.regexp_replace("raw", r"(?U)^\s+|\s+$", "").alias("line"))


def sections(rows: DataFrame, upper: bool = False, default: str = "Front Matter") -> DataFrame:
    """doc, section, page_content, page (of the last line), seg. rows as of lines().

    A running count of headings numbers the segments; each is folded by one aggregation on the same
    partitioning, so that documents are shuffled once. Segments without a body give no row.
    """
    body = rows if upper else rows.where("line <> ''")
    head = is_upper_heading(F.col("line")) if upper else is_heading(F.col("line"))
    w = Window.partitionBy("doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seg = body.withColumn("head", head).withColumn("seg", F.sum(F.col("head").cast("int")).over(w))
    out = seg.groupBy("doc", "seg").agg(
        F.max(F.when(F.col("head"), F.col("line"))).alias("title"),
        F.array_sort(F.collect_list(F.when(~F.col("head"), F.struct("pos", "line")))).alias("b"),
        F.max("page").alias("page"),
    )
    content = F.array_join(F.transform("b", lambda x: x["line"]), "\n")
    return out.select("doc", F.coalesce("title", F.lit(default)).alias("section"), content.alias("page_content"), "page", "seg").where(r"page_content RLIKE '\\S'")


def procedural_parts(text: Column) -> Column:
    """Blank-line blocks cut before sentences that open a new step; parts of one word or less are dropped."""
    blocks = F.filter(F.transform(F.split(text, "\n\n"), lambda b: F.regexp_replace(b, r"(?U)^\s+|\s+$", "")), lambda b: b != "")
    parts = F.flatten(F.transform(blocks, lambda b: F.split(b, rf"(?U)(?<=\.)\s+(?={'|'.join(STEP_WORDS)})")))
    return F.filter(parts, more_than_one_word)


def more_than_one_word(c: Column) -> Column:
    return c.rlike(r"(?U)\S\s+\S")


def split_recursively(text: str, size: int = 600, overlap: int = 120, separators: tuple[str, ...] = ("\n\n", "\n", " ", "")) -> list[str]:
    """Pieces of at most `size` characters at the coarsest separator that works, joined up to the size, each
    beginning with up to `overlap` characters of the last."""
    sep, rest = separators[-1], ()
    for i, s in enumerate(separators):
        if s == "" or s in text:
            sep, rest = s, separators[i + 1 :]
            break
    parts = list(text) if sep == "" else [p for p in text.split(sep)]
    out: list[str] = []
    window: list[str] = []

    def flush() -> None:
        joined = sep.join(window).strip()
        if joined:
            out.append(joined)

    def length(x: list[str]) -> int:
        return sum(map(len, x)) + len(sep) * max(0, len(x) - 1)

    for p in parts:
        if p == "":
            continue
        if len(p) > size and rest:
            if window:
                flush()
                window.clear()
            out += split_recursively(p, size, overlap, rest)
            continue
        if window and length(window) + len(sep) + len(p) > size:
            flush()
            while window and (length(window) > overlap or length(window) + len(sep) + len(p) > size):
                window.pop(0)
        window.append(p)
    if window:
        flush()
    return out


def chunks(sections_df: DataFrame, size: int = 600, overlap: int = 120) -> DataFrame:
    """doc, chunk_id (dense over the kept chunks of a document), section, page_content. The recursive cut is no
    relational operation: an Arrow function."""

    @F.pandas_udf("array<string>")
    def cut_text(s: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in s:
            yield part.map(lambda t: split_recursively(t, size, overlap) if t else [])

    parts = sections_df.select("doc", "section", "seg", F.posexplode(procedural_parts_or_whole(F.col("page_content"))).alias("part", "text"))
    pieces = parts.select("doc", "section", "seg", "part", F.posexplode(cut_text("text")).alias("piece", "page_content")).where(more_than_one_word(F.col("page_content")))
    w = Window.partitionBy("doc").orderBy("seg", "part", "piece")
    return pieces.select("doc", (F.row_number().over(w) - 1).alias("chunk_id"), "section", "page_content")


def procedural_parts_or_whole(text: Column) -> Column:
    parts = procedural_parts(text)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(text))


def document_chunks(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """The combined loader: chunks of the pages' text, then the tables as documents of their own. pages: doc, page, text,
    is_table."""
    rows = lines(pages.where("NOT is_table"), "doc", "text", "page")
    return with_tables(chunks(sections(rows)), tables)


def with_tables(chunk_df: DataFrame, tables: DataFrame) -> DataFrame:
    """Chunks, then tables (section Table, no chunk id), with their order: nothing is merged or dropped."""
    return chunk_df.withColumn("part", F.lit(0)).unionByName(tables.withColumn("part", F.lit(1)), allowMissingColumns=True)
