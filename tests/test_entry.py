import os

import pytest

import __spark_entry__ as entry
from strataform.operators.skew import hot_split_lookup

SF = "/root/testdata/sf0.001"


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 40


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
@pytest.mark.parametrize("name", ["canon_text", "json_items", "section_segments", "retrieval_topk", "chat_merge_roles", "box_stats", "doi_join", "p7_found"])
def test_oracle(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    want = con.sql(entry.oracle_sql()[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    assert sorted(map(str, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(str, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_hot_keys(spark):
    rows = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN -1 WHEN id % 3 = 1 THEN id END AS k")
    counts = rows.where("k IS NOT NULL").groupBy("k").count().withColumnRenamed("count", "n").withColumn("v", rows.sparkSession.range(1).select("id").first()[0] + __import__("pyspark").sql.functions.col("k"))
    out = hot_split_lookup(rows, counts, ["k"], "n")
    assert out.count() == 2000 and out.where("k <> v").count() == 0
    assert hot_split_lookup(rows.limit(0), counts.limit(0), ["k"], "n").count() == 0
