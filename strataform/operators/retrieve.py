"""Vector retrieval and prompt assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def nearest(queries: DataFrame, corpus: DataFrame, q_id: str, q_vec: str, c_id: str, c_vec: str, k: int = 4, block: int = 1000) -> DataFrame:
    """q_id, c_id, distance, rank: the k nearest corpus vectors (L2, ties by id) of each query.

    The stated query set is held against all vectors in blocks of `block` queries: each task keeps only its k best
    per query before anything moves, so that the shuffle carries k rows per query and partition.
    """
    spark = corpus.sparkSession
    rows = queries.select(q_id, q_vec).orderBy(q_id).toLocalIterator()
    out, part = None, []

    def add(part: list, out: DataFrame | None) -> DataFrame:
        import numpy as np
        import pyarrow as pa

        ids = [r[0] for r in part]
        m = np.array([r[1] for r in part], dtype=np.float64)
        shared = spark.sparkContext.broadcast((ids, m))  # at most `block` queries

        def run(batches):  # noqa: ANN001, ANN202
            ids, m = shared.value
            best_d = np.full((len(ids), 0), np.inf)
            best_i = np.zeros((len(ids), 0), dtype=np.int64)
            for b in batches:
                if not b.num_rows:
                    continue
                x = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                d = ((m[:, None, :] - x[None]) ** 2).sum(2) if x.shape[0] * len(ids) * x.shape[1] < 5_000_000 else np.stack([((x - v) ** 2).sum(1) for v in m])
                best_d = np.concatenate([best_d, d], 1)
                best_i = np.concatenate([best_i, np.broadcast_to(b.column(0).to_numpy()[None], d.shape)], 1)
                keep = np.lexsort((best_i, best_d), axis=1)[:, :k]
                best_d, best_i = np.take_along_axis(best_d, keep, 1), np.take_along_axis(best_i, keep, 1)
            if best_d.shape[1]:
                yield pa.record_batch([pa.array(np.repeat(np.array(ids, dtype=np.int64), best_d.shape[1])), pa.array(best_i.ravel()), pa.array(np.sqrt(best_d.ravel()))], names=["q", "c", "d"])

        one = corpus.select(F.col(c_id).cast("bigint"), c_vec).mapInArrow(run, "q bigint, c bigint, d double")
        return one if out is None else out.unionByName(one)

    for r in rows:
        part.append((r[0], r[1]))
        if len(part) == block:
            out, part = add(part, out), []
    if part:
        out = add(part, out)
    if out is None:
        return spark.createDataFrame([], f"{q_id} bigint, {c_id} bigint, distance double, rank int")
    best = out.groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "c"))), 1, k).alias("top"))
    return best.select(F.col("q").alias(q_id), F.posexplode("top").alias("rank", "x")).select(q_id, F.col("x.c").alias(c_id if c_id != q_id else f"near_{c_id}"), F.col("x.d").alias("distance"), (F.col("rank") + 1).alias("rank"))


def context_prompt(query: Column, passages: Column) -> Column:
    """Query and retrieved passages as one message."""
    return F.concat_ws("\n\n", query, F.lit("Context:"), F.array_join(passages, "\n\n"))


def section_prompt(section: Column, text: Column) -> Column:
    return F.format_string("Section (%s):\n\n%s", section, text)


def summary_prompt(section: Column, text: Column) -> Column:
    return F.format_string("Summary of %s:\n%s", section, text)


def augment(hits: DataFrame, texts: DataFrame, q_id: str, hit_id: str, text_id: str, text: str, query: DataFrame, query_text: str) -> DataFrame:
    """q_id, message: each query's text with its hits' texts in rank order."""
    t = texts.select(F.col(text_id).alias(hit_id), F.col(text).alias("passage"))
    got = hits.join(t, hit_id).groupBy(q_id).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "passage"))), lambda x: x["passage"]).alias("p"))
    return query.select(q_id, F.col(query_text).alias("q")).join(got, q_id).select(q_id, context_prompt(F.col("q"), F.col("p")).alias("message"))
