"""All queries of the core library by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataform.plans import core_queries, reference_queries, scoring_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reference_queries.record_report(spark, sf_dir)


def queries() -> dict:
    return reference_queries.QUERIES | scoring_queries.QUERIES | core_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference_queries.ORACLE | scoring_queries.ORACLE | core_queries.ORACLE
