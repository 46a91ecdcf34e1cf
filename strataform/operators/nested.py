"""Nested JSON records to flat related tables.

The JVM parses each record once into a variant and hands Arrow a list of typed structs per record and section;
lists are then flattened by their buffers: values by list_flatten, parents by list_parent_indices,
positions from the list offsets, parent keys by one vectorised take. No record is walked in Python and no item is
parsed a second time.

Cases: a null, empty, truncated or non-object text gives no rows; sections of another shape give none;
array elements that are not objects are counted by item_no but give no row; empty objects give a row of
nulls; of repeated keys the last counts; repeated records give their rows again under their own record key; fields
that are not asked for are not read; extra columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.stage import staged
from strataform.session import ship

#: Fields of each section of a record (fixed values of the data model).
SECTION_FIELDS = {
    "target_materials": ["name", "chemical_formula", "isotope", "physical_form", "source_section"],
    "acids_and_solvents": ["name", "type", "concentration", "role", "source_section"],
    "resins_or_columns": ["name", "material", "mesh_size", "column_dimensions", "role", "source_section"],
    "elution_conditions": ["eluent", "concentration", "volume", "flow_rate", "temperature", "pH", "source_section"],
    "final_products": ["name", "isotope", "chemical_form", "purity", "yield_", "source_section"],
}
FLAT_SECTIONS = ["acids_and_solvents", "elution_conditions", "final_products", "resins_or_columns"]
_END = "#end-of-record#"


def keep_last_keys(spark: SparkSession) -> None:
    """Let variants hold texts with repeated keys: the last of them counts, at any depth. Without this setting of the
    session one repeated key makes the whole text null."""
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "true")


def complete_object(text: str) -> Column:
    """Variant of the text if it is one complete JSON object, else null. The text is parsed inside an
    array before a marker: whatever follows or breaks the object, the marker is then not element 1.
    See keep_last_keys for repeated keys."""
    whole = f"try_parse_json(concat('[', `{text}`, ',\"{_END}\"]'))"
    ok = f"try_variant_get(w, '$[1]', 'string') = '{_END}' AND try_variant_get(w, '$[2]', 'string') IS NULL AND schema_of_variant(try_variant_get(w, '$[0]', 'variant')) LIKE 'OBJECT%'"
    return F.expr(f"transform(array({whole}), w -> CASE WHEN {ok} THEN try_variant_get(w, '$[0]', 'variant') END)[0]")


def _fields(item: str, section: str, fields: list[str]) -> str:
    """Struct of the fields of item number i as texts, and whether it is an object (o). Leaves of another kind come as
    their JSON text; `yield` and `yield_` both fill yield_. A variant orders keys anew, so the rare leaf that is an
    object or array is read from the text."""

    def one(f: str) -> str:
        written = f"get_json_object(`__text`, concat('$.{section}.items[', i, '].{f}'))"
        return f"transform(array(CAST(try_variant_get({item}, '$.{f}', 'variant') AS STRING)), s -> CASE WHEN startswith(s, '{{') OR startswith(s, '[') THEN coalesce({written}, s) ELSE s END)[0]"

    parts = [f"'{f}', " + (f"coalesce({one(f)}, {one('yield')})" if f == "yield_" else one(f)) for f in fields]
    return f"named_struct({', '.join([f"'o', schema_of_variant({item}) LIKE 'OBJECT%'", *parts])})"


def _items(section: str, fields: list[str]) -> Column:
    """items of a section as array<struct>; null unless section is an object with an array."""
    own = [f for f in fields if f in SECTION_FIELDS[section]]
    typed = F.expr(f"transform(try_variant_get(v, '$.{section}.items', 'array<variant>'), (x, i) -> {_fields('x', section, own)})")
    if own == fields:
        return typed
    return F.transform(typed, lambda x: F.struct(x["o"].alias("o"), *[(x[f] if f in own else F.lit(None).cast("string")).alias(f) for f in fields]))


def _flatten(batches: Iterator[pa.RecordBatch], sections: list[str], fields: list[str], records: bool) -> Iterator[pa.RecordBatch]:
    for b in batches:
        key = b.column(0)
        kind = pa.struct([(f, pa.string()) for f in fields or ["none"]])
        if records:
            n = len(key)
            yield pa.record_batch([key, pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()), pa.nulls(n, kind)], names=["record_key", "section", "item_no", "item"])
        for k, section in enumerate(sections):
            lists = b.column(k + 1)
            parent = pc.list_parent_indices(lists)
            if not len(parent):
                continue
            values = pc.list_flatten(lists)
            # list_flatten skips what null lists hide, so offsets are rebuilt from the lengths
            run = pa.array(np.arange(len(values)))
            lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int64())
            begin = pc.subtract(pc.cumulative_sum(lengths), lengths).take(parent)
            pos = pc.subtract(run, begin).cast(pa.int32())
            children = [values.field(f) for f in fields] or [pa.nulls(len(values), pa.string())]
            out = pa.record_batch(
                [key.take(parent), pa.array([section]).take(pa.array(np.zeros(len(pos), np.int32))), pos, pa.StructArray.from_arrays(children, fields=list(kind))],
                names=["record_key", "section", "item_no", "item"],
            )
            yield out.filter(values.field("o"))


def flatten_items(df: DataFrame, key: str, text: str, sections: list[str] | None = None, fields: list[str] | None = None, records: bool = False) -> DataFrame:
    """record_key BIGINT, section STRING, item_no INT, item STRUCT of the fields (all of the sections' by default) as
    STRING: one row per object in `items` of each section. records=True adds one row per record that is one JSON
    object, with null section, number and item, so that records without items are not lost. Narrow: no shuffle,
    whatever the size of a record."""
    sections = sections or FLAT_SECTIONS
    fields = sorted({f for s in sections for f in SECTION_FIELDS[s]}) if fields is None else fields
    keep_last_keys(df.sparkSession)
    src = df.select(F.col(key).cast("bigint").alias("record_key"), F.col(text).alias("__text"))
    src = staged(src.where(F.col("__text").isNotNull()), {"v": complete_object("__text")}).where("v IS NOT NULL")
    lists = src.select("record_key", *[_items(s, fields).alias(f"s{i}") for i, s in enumerate(sections)])
    ship(df.sparkSession)
    item = ", ".join(f"`{f}`: string" for f in fields or ["none"])
    return lists.mapInArrow(lambda it: _flatten(it, sections, fields, records), f"record_key bigint, section string, item_no int, item struct<{item}>")


def section_table(flat: DataFrame, section: str) -> DataFrame:
    """One section as a flat table: the parent link (record_key, item_no) and its fields as STRING."""
    return flat.where(F.col("section") == section).select("record_key", "item_no", *[F.col("item")[f].alias(f) for f in SECTION_FIELDS[section]])


def record_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """The parent table: record_key with title, doi and source of paper_metadata; records that are not one
    JSON object are absent."""
    keep_last_keys(df.sparkSession)
    v = df.select(F.col(key).cast("bigint").alias("record_key"), complete_object(text).alias("v")).where("v IS NOT NULL")
    return v.select("record_key", *[F.expr(f"try_variant_get(v, '$.paper_metadata.{f}', 'string')").alias(f) for f in ("title", "doi", "source")])


def p7_found(df: DataFrame) -> DataFrame:
    return flatten_items(df, "record_id", "record", fields=[]).select(F.col("record_key").alias("record_id"), "section", "item_no")
