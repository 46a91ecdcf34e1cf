"""Page texts, identifiers and tables of documents. PDF parsing is a plug-in; everything after it is relational."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: bytes -> (page texts, title, tables as (text, page))
Parser = Callable[[bytes], tuple[list[str], str, list[tuple[str, int | None]]]]


def fitz_parser(data: bytes) -> tuple[list[str], str, list[tuple[str, int | None]]]:
    """The optional PDF library, where it is installed."""
    try:
        import fitz
    except ImportError as e:
        raise RuntimeError("reading PDF files needs PyMuPDF") from e
    with fitz.open(stream=data, filetype="pdf") as d:
        tables = [("\n".join("\t".join(c or "" for c in r) for r in t.extract()), n) for n, p in enumerate(d) for t in p.find_tables().tables]
        return [p.get_text() for p in d], (d.metadata or {}).get("title") or "", tables


class _Html(HTMLParser):
    """Text outside tables by page (a new one at <hr>), the title, and tables with a line per row and tabs between
    cells."""

    def __init__(self) -> None:
        super().__init__()
        self.pages, self.title, self.tables = [""], "", []
        self.depth, self.inside = 0, ""

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "table":
            self.depth += 1
            if self.depth == 1:
                self.tables.append(("", len(self.pages) - 1))
        elif tag in ("tr", "td", "th") and self.depth:
            text, page = self.tables[-1]
            self.tables[-1] = (text + ("\n" if tag == "tr" and text else "\t" if tag != "tr" and text and text[-1] != "\n" else ""), page)
        elif tag in ("p", "br", "div", "li", "h1", "h2", "h3", "h4") and self.pages[-1]:
            self.pages[-1] += "\n"
        elif tag == "hr":
            self.pages.append("")
        self.inside = tag if tag in ("title", "script", "style") else ""

    def handle_endtag(self, tag: str) -> None:
        self.depth -= tag == "table" and self.depth > 0
        self.inside = ""

    def handle_data(self, data: str) -> None:
        words = " ".join(data.split())
        if not words or self.inside in ("script", "style"):
            return
        if self.inside == "title":
            self.title += words
        elif self.depth:
            text, page = self.tables[-1]
            self.tables[-1] = (text + words, page)
        else:
            end = self.pages[-1]
            self.pages[-1] = f"{end} {words}" if end and end[-1] != "\n" else end + words


def html_parser(data: bytes) -> tuple[list[str], str, list[tuple[str, int | None]]]:
    """Pages of HTML, with their tables; needs nothing but the standard library."""
    h = _Html()
    h.feed(data.decode("utf-8", "replace"))
    h.close()
    return h.pages, h.title, list(h.tables)


def read_documents(spark: SparkSession, path: str, parser: Parser = fitz_parser, glob: str = "*.pdf") -> DataFrame:
    """doc, page, text, title and tables of each file of a folder (not below it), by name."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for p, c in zip(pdf["path"], pdf["content"], strict=True):
                pages, title, tables = parser(bytes(c))
                rows += [(p, i, t, title, False) for i, t in enumerate(pages)]
                rows += [(p, n, t, title, True) for t, n in tables]
            yield pd.DataFrame(rows, columns=["doc", "page", "text", "title", "is_table"])

    return files.mapInPandas(run, "doc string, page int, text string, title string, is_table boolean")


DOI = r"10\.\d{4,}/\S+"


def metadata(pages: DataFrame, doc: str = "doc", page: str = "page", text: str = "text", title: str | None = "title", first: int = 3) -> DataFrame:
    """doc, title, doi: the first DOI on the first pages, in page order, as written; '' where there is none."""
    d = F.regexp_extract(text, DOI, 0)
    found = F.min_by(F.when((F.col(page) < first) & (d != ""), d), F.when((F.col(page) < first) & (d != ""), F.col(page)))
    t = F.coalesce(F.max(title), F.lit("")) if title else F.lit("")
    return pages.groupBy(doc).agg(t.alias("title"), F.coalesce(found, F.lit("")).alias("doi"))


def table_rows(pages: DataFrame) -> DataFrame:
    """Table elements as documents of their own."""
    return pages.where("is_table").select("doc", F.lit("Table").alias("section"), F.col("text").alias("page_content"), "page", F.lit("unstructured").alias("source"))
