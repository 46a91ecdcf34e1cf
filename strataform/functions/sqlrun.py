"""Run a SQL text over DataFrames named in it as @name, without leaving views behind."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession


def run_sql(spark: SparkSession, text: str, **frames: DataFrame) -> DataFrame:
    views = {n: f"v_{uuid.uuid4().hex}_{n}" for n in frames}
    for n, df in frames.items():
        df.createTempView(views[n])
    try:
        return spark.sql(re.sub(r"@([a-z]+)\b", lambda m: views[m[1]], text))
    finally:
        for v in views.values():
            spark.catalog.dropTempView(v)
