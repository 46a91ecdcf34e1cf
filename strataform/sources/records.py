"""Record files: JSON objects read leniently, directories of gold and predicted records, timing files, configs."""

from __future__ import annotations

from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataform.functions.text import basename, canonical_id, experiment_number, stem_id
from strataform.operators.nested import complete_object, keep_last_keys

KINDS = ("rag_output", "full_summary", "section_summaries")
RECORD_SECTIONS = ("target_materials", "acids_and_solvents", "resins_or_columns", "elution_conditions", "final_products")


def json_files(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """path, text of whole files; the root is checked by whoever parses it."""
    r = spark.read.option("wholetext", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", str(recursive).lower())
    return r.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def with_record_flag(df: DataFrame, text: str, flag: str = "is_record") -> DataFrame:
    """Adds whether a text is one JSON object in which any section holds an array of items."""
    arrays = [F.expr(f"try_variant_get(v, '$.{s}.items', 'array<variant>') IS NOT NULL") for s in RECORD_SECTIONS]
    out = arrays[0]
    for a in arrays[1:]:
        out = out | a
    keep_last_keys(df.sparkSession)
    return df.withColumn("v", complete_object(text)).withColumn(flag, F.coalesce(out, F.lit(False))).drop("v")


def gold_records(spark: SparkSession, path: str) -> DataFrame:
    """gold_path, stem, doi, title, source (canonical ids), text. Unreadable files are left out; count the files
    with json_files() for the total."""
    keep_last_keys(spark)
    v = json_files(spark, path).withColumn("v", complete_object("text"))
    meta = {f: canonical_id(F.coalesce(F.expr(f"try_variant_get(v, '$.paper_metadata.{f}', 'string')"), F.lit(""))) for f in ("doi", "title", "source")}
    return v.where("v IS NOT NULL").select(F.col("path").alias("gold_path"), stem_id(F.col("path")).alias("stem"), *[c.alias(n) for n, c in meta.items()], "text")


def predicted_records(spark: SparkSession, path: str, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """path, kind, exp, stem, doi, title, source, text of the files that lie directly in a folder named by kind, at
    any depth."""
    parent = F.element_at(F.split("path", "/"), -2)
    df = json_files(spark, path, recursive=True).withColumn("kind", parent).where(F.col("kind").isin(*kinds)).distinct()
    keep_last_keys(df.sparkSession)
    v = df.withColumn("v", complete_object("text"))
    meta = {f: canonical_id(F.coalesce(F.expr(f"try_variant_get(v, '$.paper_metadata.{f}', 'string')"), F.lit(""))) for f in ("doi", "title", "source")}
    return v.select("path", "kind", experiment_number(F.col("path")).alias("exp"), stem_id(F.col("path")).alias("stem"), F.regexp_replace(basename(F.col("path")), r"\.json$", "").alias("file"), *[c.alias(n) for n, c in meta.items()], F.col("v").isNotNull().alias("valid"), "text")


def concatenated_objects(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep, file stem and times of objects written one after the other (`}{`). Objects without a file are skipped,
    missing times are 0, the last object of a file wins; a text that does not parse gives none."""
    schema = "array<struct<file:string,section_summary_time:double,full_summary_time:double,rag_time:double>>"
    arr = F.from_json(F.concat(F.lit("["), F.regexp_replace(text, r"\}\s*\{", "},{"), F.lit("]")), schema)
    o = df.select(*keep, F.posexplode(arr).alias("pos", "o")).where("o.file IS NOT NULL").withColumn("stem", canonical_id(basename(F.col("o.file"))))
    g = o.groupBy(*keep, "stem").agg(F.max_by("o", "pos").alias("o"))
    return g.select(*keep, "stem", *[F.coalesce(f"o.{t}", F.lit(0.0)).alias(t) for t in ("section_summary_time", "full_summary_time", "rag_time")])


def timing_files(spark: SparkSession, path: str) -> DataFrame:
    t = json_files(spark, path, recursive=True).where(basename(F.col("path")) == "timing.json").withColumn("exp", experiment_number(F.col("path")))
    return concatenated_objects(t, "text", ["exp"])


def read_prompts(folder: str | Path, pattern: str = "*.txt") -> dict[str, str]:
    """Name without ending and text of the prompt files of a folder: driver-side constants of a run."""
    return {p.stem: p.read_text(encoding="utf-8") for p in sorted(Path(folder).glob(pattern))}


def read_yaml(path: str | Path) -> dict[str, Any]:
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("reading YAML configs needs PyYAML") from e
    with open(path, encoding="utf-8") as f:
        d = yaml.safe_load(f)
    return d if isinstance(d, dict) else {}


def model_name(config: dict[str, Any]) -> str | None:
    """`model` if it is text, else the first text under a key that speaks of a model."""
    m = config.get("model")
    if isinstance(m, str):
        return m
    return next((v for k, v in config.items() if "model" in str(k).lower() and isinstance(v, str)), None)


def experiment_models(spark: SparkSession, configs: dict[int, dict[str, Any]]) -> DataFrame:
    """exp, model: one row per experiment, for a broadcast join."""
    return spark.createDataFrame([(e, model_name(c)) for e, c in sorted(configs.items())], "exp int, model string")
