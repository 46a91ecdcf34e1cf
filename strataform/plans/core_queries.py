"""Registered queries of the general data operators p6 and p7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators import nested, units
from strataform.sources.tables import table


def amounts(spark: SparkSession, d: str) -> DataFrame:
    """item_id, step_id, field, text, value, unit, posterior, uncertain of all four fields."""
    acids = units.long_form(table(spark, d, "acids_and_solvents", "item_id", "step_id", "concentration"), ["concentration"], ["item_id", "step_id"])
    elution = units.long_form(table(spark, d, "elution_conditions", "item_id", "step_id", "volume", "flow_rate", "temperature"), ["volume", "flow_rate", "temperature"], ["item_id", "step_id"])
    return units.convert(acids, ["concentration"]).unionByName(units.convert(elution, ["volume", "flow_rate", "temperature"]))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return units.same_quantity_pairs(amounts(spark, d), "item_id", "step_id")


def p6_amounts(spark: SparkSession, d: str) -> DataFrame:
    """Every item once, with its quantities in one unit per field."""
    a = amounts(spark, d).where("value IS NOT NULL")
    return a.groupBy("item_id", "field", "text").agg(F.first("value").alias("value"), F.first("uncertain").alias("uncertain"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.p7_found(table(spark, d, "extraction_records", "record_id", "record"))


def _section(spark: SparkSession, d: str, section: str) -> DataFrame:
    flat = nested.flatten_items(table(spark, d, "extraction_records", "record_id", "record"), "record_id", "record", [section])
    return nested.section_table(flat, section)


def p7_acid_table(spark: SparkSession, d: str) -> DataFrame:
    """The flat tables, one a section; their rows still point to their record."""
    return _section(spark, d, "acids_and_solvents")


def p7_elution_table(spark: SparkSession, d: str) -> DataFrame:
    return _section(spark, d, "elution_conditions")


def p7_product_table(spark: SparkSession, d: str) -> DataFrame:
    return _section(spark, d, "final_products")


def p7_resin_table(spark: SparkSession, d: str) -> DataFrame:
    return _section(spark, d, "resins_or_columns")


def p7_record_table(spark: SparkSession, d: str) -> DataFrame:
    """The parent table: every record that is one JSON object, with its title, doi and source."""
    return nested.record_table(table(spark, d, "extraction_records", "record_id", "record"), "record_id", "record")


QUERIES = {"p6_found": p6_found, "p6_amounts": p6_amounts, "p7_found": p7_found, "p7_acid_table": p7_acid_table, "p7_elution_table": p7_elution_table, "p7_product_table": p7_product_table, "p7_resin_table": p7_resin_table, "p7_record_table": p7_record_table}
ORACLE: dict[str, str] = {}
