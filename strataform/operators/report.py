"""Batch reports: global means, per-method statistics, the flat report table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of the report, in order.
REPORT_COLUMNS = (
    "exp", "file", "doi", "model", "runtime_seconds", "method", "protocol_completeness", "hallucination_rate", "task_success", "micro_precision", "micro_recall", "micro_f1", "micro_accuracy",
    "macro_precision", "macro_recall", "macro_f1", "jaccard_micro", "duplicate_rate", "duplicates", "items_total", "schema_validity",
)
METHODS = {"rag_output": "RAG", "section_summaries": "SECTION_SUMMARIES", "full_summary": "FULL_SUMMARY"}
MEANS = ("micro_precision", "micro_recall", "micro_f1", "macro_f1", "jaccard_micro", "hallucination_rate", "protocol_completeness", "duplicate_rate", "schema_validity")


def method(kind: F.Column) -> F.Column:
    out = F.lit(None).cast("string")
    for k, m in METHODS.items():
        out = F.when(kind == k, m).otherwise(out)
    return out


def flat_report(df: DataFrame) -> DataFrame:
    """The report columns; what a row lacks (error rows, micro_accuracy) is null."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).cast("double").alias(c) for c in REPORT_COLUMNS])


def global_means(df: DataFrame) -> DataFrame:
    """Means over the matched rows, the success rate and counts; 0 for no rows."""
    return df.agg(
        F.count_if(F.col("micro_f1").isNotNull()).alias("matched"), F.count_if(F.col("micro_f1").isNull()).alias("skipped"),
        *[F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean") for m in MEANS],
        F.coalesce(F.avg(F.when(F.col("micro_f1").isNotNull(), F.coalesce(F.col("task_success"), F.lit(False)).cast("double"))), F.lit(0.0)).alias("task_success_rate"),
    )


def method_summary(df: DataFrame, by: str = "method", measures: tuple[str, ...] = ("micro_f1", "hallucination_rate", "runtime_seconds"), success: str = "task_success") -> DataFrame:
    cols = [F.count(F.lit(1)).alias("n")]
    for m in measures:
        cols += [F.avg(m).alias(f"{m}_mean"), F.median(m).alias(f"{m}_median")]
    return df.groupBy(by).agg(*cols, F.avg(F.coalesce(F.col(success), F.lit(False)).cast("double")).alias("task_success_rate"))


def poster_scope(df: DataFrame, experiments: tuple[int, ...] = (18, 19, 20, 24, 25)) -> DataFrame:
    return df.where(F.col("exp").isin(*experiments) & (F.col("items_total") > 0))


def runtime_by_method(df: DataFrame) -> DataFrame:
    return df.where("runtime_seconds IS NOT NULL").groupBy("method").agg(F.avg("runtime_seconds").alias("runtime_mean")).orderBy("runtime_mean")


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles (linear interpolation) and whiskers: the extreme values within 1.5 quartile distances."""
    v = df.select(F.col(by).alias("g"), F.col(value).try_cast("double").alias("v")).where("v IS NOT NULL")
    q = v.groupBy("g").agg(F.percentile("v", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("q"), F.count(F.lit(1)).alias("n"))
    q = q.select("g", "n", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    inside = v.join(q, "g").where("v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)")
    w = inside.groupBy("g").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    return q.join(w, "g").select(F.col("g").alias(by), "n", "q1", "median", "q3", "low", "high")


def success_rate(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.avg(F.coalesce(F.col("task_success"), F.lit(False)).cast("double")).alias("success_rate"), F.avg("micro_f1").alias("micro_f1"))


def cube_means(df: DataFrame) -> DataFrame:
    """Global, per experiment, per method and per both in one pass."""
    return df.cube("exp", "method").agg(F.count(F.lit(1)).alias("n"), F.avg("micro_f1").alias("micro_f1_mean"))
