import unicodedata

import pytest
from pyspark.sql import functions as F

from strataform.functions import text as T
from strataform.functions.lookalikes import fold, fold_pairs


def one(spark, f, *values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").select("o").collect()]


def test_canonical_text(spark):
    got = one(spark, T.canonical_text, None, "  AG 1×8 ", "AG 1-X8", "AG 1 x 8", "1 x 8 x 2", "< 4.5 M", "É,è|x", "4–6 M", "ＨＣｌ", "")
    assert got == ["", "ag 1x8", "ag 1x8", "ag 1x8", "1x8 x 2", "4.5 m", "é è x", "4-6 m", "hcl", ""]


def test_concentration(spark):
    got = one(spark, T.canonical_concentration, "6M", "6.0 M", "0.10 M", "4–6 M", "< 4.5 M", "Concentrated", "0.00001 M", "1234567.5 M", "12000000 M", None)
    assert got == ["6 m", "6 m", "0.1 m", "4-6 m", "4.5 m", "concentrated", "1e-05 m", "1.23457e+06 m", "12000000 m", ""]


@pytest.mark.parametrize("v", [0.1, 2.5, 123456.7, 0.00012345678, 999999.5, 3.14159265, 1e-7, 7.0])
def test_general_number(spark, v):
    assert spark.range(1).select(T.general_number(F.lit(v))).first()[0] == f"{v:g}"


def test_isotopes(spark):
    assert one(spark, T.canonical_isotope, "58Co", "055Co", "cobalt-58", "iron-58", "co55", "58mCo", "Thorium - 232") == ["58co", "55co", "58co", "58ir", "co55", "58mco", "232th"]


def test_chemicals(spark):
    assert one(spark, T.canonical_chemical, "Hydrochloric Acid", "18 MΩ·cm water", "dilute HCl", "hclx", "Toluene") == ["hcl", "water", "hcl", "hclx", "toluene"]
    assert one(spark, T.canonical_eluent, "0.1 M HNO3", "6 m toluene") == ["hno3", "toluene"]


def test_ids_and_paths(spark):
    assert one(spark, T.canonical_id, "X.pdf.json", "X.json", "./papers/X.pdf", None) == ["x", "x", "papers_x", ""]
    assert one(spark, T.experiment_number, "out/exp18/a/b.json", "out/exp/a.json", "out/EXP07/b.json") == [18, None, 7]
    assert one(spark, T.stem_id, "out/exp1/rag_output/Some Paper.pdf.json") == ["some_paper"]


def test_sanitize_and_hints(spark):
    long = "a" * 600
    got = one(spark, lambda c: T.sanitize(c, 500), "a\x00b", long)
    assert got[0] == "ab" and got[1].startswith("a" * 460 + "\n\n[") and len(got[1]) == 504
    assert one(spark, T.retry_after_seconds, "Please try again in 250ms.", "try again in 1.5 s", "no hint", None) == [0.25, 1.5, None, None]


def test_fold_matches_unicode(spark):
    a, b = fold_pairs()
    assert len(a) == len(b) == len(set(a))
    for x, y in zip(a, b):
        if unicodedata.normalize("NFKC", x) != x and unicodedata.normalize("NFKC", x).isascii():
            assert unicodedata.normalize("NFKC", x) == y
    assert one(spark, fold, "１０​ ｍｏｌ/Ｌ", None) == ["10 mol/L", None]
