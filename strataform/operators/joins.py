"""Predictions to gold records: stem, then identifier, then nearest by text; and side tables by experiment."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strataform.session import ship


def sequence_ratio(a: str, b: str) -> float:
    from difflib import SequenceMatcher

    return SequenceMatcher(None, a, b).ratio()


def by_stem(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Left join on stem; of several gold paths of a stem the first by name."""
    g = gold.groupBy("stem").agg(F.min("gold_path").alias("stem_gold"))
    return preds.join(g, "stem", "left")


def by_identifier(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """Left join on a non-empty DOI; of several gold paths of a DOI the last by name."""
    g = gold.where("doi <> ''").groupBy("doi").agg(F.max("gold_path").alias("doi_gold"))
    return preds.join(g, "doi", "left")


def nearest_by_text(preds: DataFrame, gold: DataFrame, names: tuple[str, ...] = ("title", "source", "stem"), least: float = 0.65, block: int = 2000) -> DataFrame:
    """path, fuzzy_gold, ratio: best sequence ratio over all pairings of non-empty names; ties to the first gold
    path; below `least` none. The gold list is the stated, hand-made side: it is held against all predictions in
    blocks, so nothing is shuffled but one row per prediction and block."""
    spark = preds.sparkSession
    rows = gold.select("gold_path", *names).orderBy("gold_path").toLocalIterator()
    src = preds.select("path", *names)
    out, part = None, []

    def add(part: list, out: DataFrame | None) -> DataFrame:
        shared = spark.sparkContext.broadcast(part)  # at most `block` gold records

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from difflib import SequenceMatcher

            # a matcher keeps what it works out of its second text; its quick ratios are upper bounds
            gold_texts = [(g[0], [SequenceMatcher(None, "", y) for y in g[1:] if y]) for g in shared.value]
            for b in batches:
                best = []
                for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True):
                    own = [x for x in row[1:] if x]
                    top = (-1.0, None)
                    for g, matchers in gold_texts:
                        r = 0.0
                        for m in matchers:
                            for x in own:
                                m.set_seq1(x)
                                if m.real_quick_ratio() > max(r, top[0]) and m.quick_ratio() > max(r, top[0]):
                                    r = max(r, m.ratio())
                        if r > top[0]:
                            top = (r, g)
                    best.append((row[0], top[1], top[0]))
                if best:
                    p, g, r = zip(*best, strict=True)
                    yield pa.record_batch([pa.array(p, pa.string()), pa.array(g, pa.string()), pa.array(r, pa.float64())], names=["path", "g", "r"])

        one = src.mapInArrow(run, "path string, g string, r double")
        return one if out is None else out.unionByName(one)

    ship(spark)
    for r in rows:
        part.append(tuple(r))
        if len(part) == block:
            out, part = add(part, out), []
    if part:
        out = add(part, out)
    if out is None:
        return preds.select("path", F.lit(None).cast("string").alias("fuzzy_gold"), F.lit(None).cast("double").alias("ratio"))
    best = out.groupBy("path").agg(F.min(F.struct((-F.col("r")).alias("n"), "g")).alias("m"))
    return best.select("path", F.when(-F.col("m.n") >= least, F.col("m.g")).alias("fuzzy_gold"), (-F.col("m.n")).alias("ratio"))


def by_equal_keys(preds: DataFrame, gold: DataFrame) -> DataFrame:
    """preds with gold_path and mode: by stem, else by identifier; null where neither is equal."""
    step = by_identifier(by_stem(preds, gold), gold)
    mode = F.when(F.col("stem_gold").isNotNull(), "stem").when(F.col("doi_gold").isNotNull(), "doi")
    return step.withColumns({"gold_path": F.coalesce("stem_gold", "doi_gold"), "mode": mode}).drop("stem_gold", "doi_gold")


def cascade(preds: DataFrame, gold: DataFrame, strict: bool = False) -> DataFrame:
    """path, gold_path, mode: stem, doi or fuzzy; only what the equal keys leave over meets the text search.
    strict raises on a prediction without a gold record."""
    step = by_equal_keys(preds, gold)
    found = step.where("mode IS NOT NULL").select("path", "gold_path", "mode")
    rest = step.where("mode IS NULL").drop("gold_path", "mode")
    fuzzy = nearest_by_text(rest, gold).select("path", F.col("fuzzy_gold").alias("gold_path"), F.when(F.col("fuzzy_gold").isNotNull(), "fuzzy").alias("mode"))
    out = found.unionByName(fuzzy)
    if strict:
        out = out.select("path", F.when(F.col("gold_path").isNull(), F.raise_error(F.concat(F.lit("no gold record for "), "path"))).otherwise(F.col("gold_path")).alias("gold_path"), "mode")
    return out


def first_by(df: DataFrame, key: str, score: F.Column, tie: str) -> DataFrame:
    """The row of the highest score of each key; ties to the smallest `tie`."""
    w = Window.partitionBy(key).orderBy(score.desc(), F.col(tie))
    return df.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def top_list(df: DataFrame, key: str, score: str, value: str, k: int = 5) -> DataFrame:
    """The k best values of each key as a list."""
    return df.groupBy(key).agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), F.col(value).alias("v")))), 1, k), lambda x: x["v"]).alias("top"))


def with_runtime(rows: DataFrame, timing: DataFrame) -> DataFrame:
    """Adds runtime_seconds by experiment, stem and kind; a missing time is 0."""
    t = timing.select("exp", "stem", F.expr("stack(3, 'section_summaries', section_summary_time, 'full_summary', full_summary_time, 'rag_output', rag_time) AS (kind, runtime_seconds)"))
    return rows.join(t, ["exp", "stem", "kind"], "left")


def experiment_allowed(exp: F.Column, chosen: set[int] | None = None, least: int | None = None, most: int | None = None) -> F.Column:
    """A chosen set overrides a range; a missing number passes only where there is no filter."""
    if chosen:
        return F.coalesce(exp.isin(*sorted(chosen)), F.lit(False))
    out = F.lit(True)
    if least is not None:
        out = out & F.coalesce(exp >= least, F.lit(False))
    if most is not None:
        out = out & F.coalesce(exp <= most, F.lit(False))
    return out
