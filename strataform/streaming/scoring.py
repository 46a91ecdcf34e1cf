"""Streams over arriving record files and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.operators.nested import flatten_items


def arriving_items(spark: SparkSession, path: str, schema: str = "record_id bigint, record string, loaded_at timestamp", sections: list[str] | None = None) -> DataFrame:
    """Items of extraction records as files arrive: the batch operator on a file stream."""
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(path)
    return flatten_items(src, "record_id", "record", sections)


def deliveries_per_window(stream: DataFrame, time: str = "loaded_at", key: str = "item_id", window: str = "1 day", late: str = "30 days") -> DataFrame:
    """Items per window of loading, each delivery of an item counted once within the lateness kept."""
    once = stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
    return once.groupBy(F.window(time, window).alias("w")).agg(F.count(F.lit(1)).alias("items")).select("w.start", "w.end", "items")
