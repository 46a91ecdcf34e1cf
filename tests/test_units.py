import random

import pytest
from pyspark.sql import functions as F

from strataform.functions import quantity as q
from strataform.operators import units


def values(spark, field, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    df = q.read(df, "text")
    return [r[0] for r in df.select("i", q.value(field, F.col("n"), F.col("u")).alias("v")).orderBy("i").select("v").collect()]


CASES = {
    "concentration": {"6 M": 6, "0,25 mol L-1": 0.25, "500 mM": 0.5, "5×10^-3 mol/mL": 5, "2E+03 uM": 0.002, "20 000 mmol/L": 20, "two molar": 2, "1.5 kmol/m3": 1.5, "7 mol·L–1": 7, "９ М": 9, "4-6 M": None, "2 g/L": None, "30 wt%": None, "1:3 (v/v)": None, "saturated": None, "0.1 mo​l/L": 0.1, "1,000 mmol/L": 1, "50 mmol per litre": 0.05},
    "volume": {"80mL": 80, "0,5 cm3": 0.5, "20 000 µL": 20, "ten millilitres": 10, "7.5E-02 dL": 7.5, "0.5 cubic centimetres": 0.5, "1.5 x 10^-2 litre": 15, "3 column volumes": None, "2 BV": None, "a few drops": None, "twenty-five cc": 25},
    "flow_rate": {"0.1 ml/min": 0.1, "4 mL min-1": 4, "16.667 uL s-1": 1.00002, "0.72 L/day": 0.5, "600 µL/min": 0.6, "480 ml/hr": 8, "by vacuum": None, "2 BV/h": None, "8 mL per minute": 8},
    "temperature": {"20 °C": 20, "293.15K": 20, "68 °F": 20, "-14 ºC": -14, "98.6 degrees Fahrenheit": 37, "277 kelvin": 3.85, "ambient": None, "20-25 °C": None},
}


@pytest.mark.parametrize("field", CASES)
def test_values(spark, field):
    got = values(spark, field, list(CASES[field]))
    for (t, want), v in zip(CASES[field].items(), got, strict=True):
        assert (v is None) == (want is None) and (want is None or abs(v - want) < 1e-6 * max(1, abs(want))), (t, v, want)


def table(spark, rows):
    return spark.createDataFrame([(i, s, v, "x") for i, s, v in rows], "item_id long, step_id long, volume string, field string")


def pairs(spark, rows):
    long = units.long_form(table(spark, rows), ["volume"], ["item_id", "step_id"])
    return {(r.item_a, r.item_b) for r in units.same_quantity_pairs(units.convert(long, ["volume"]), "item_id", "step_id").collect()}


def test_pairs(spark):
    rows = [(1, 1, "10 mL"), (2, 1, "0.01 L"), (3, 1, "10 mL"), (4, 1, "13 mL"), (5, None, "10 cc"), (6, 2, "10 cc"), (2, 1, "0.01 L"), (7, 1, None), (8, 1, " "), (9, 1, "10.09 cc"), (10, 1, "0 mL"), (11, 1, "0 L")]
    assert pairs(spark, rows) == {(1, 2), (2, 3), (1, 9), (2, 9), (3, 9), (10, 11)}
    assert pairs(spark, []) == set()


def test_pairs_against_brute_force(spark):
    r = random.Random(2)
    rows = [(i, r.randint(1, 3), f"{v:.4g} {u}") for i in range(80) for v, u in [(r.choice([1, 1.004, 1.0099, 1.0102, 1.02, 5]) * f, u) for f, u in [r.choice([(1, "mL"), (0.001, "L"), (1000, "uL")])]]]
    f = {"mL": 1, "L": 1000, "uL": 0.001}
    val = {i: float(t.split()[0]) * f[t.split()[1]] for i, _, t in rows}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2] and abs(val[a[0]] - val[b[0]]) <= 0.01 * max(val[a[0]], val[b[0]])}
    assert pairs(spark, rows) == want


def test_missing_units(spark):
    r = random.Random(1)
    rows = [(i, i, f"{r.uniform(8, 12):.2f} mL") for i in range(300)] + [(1000, 1, "10000"), (1001, 2, "10"), (1002, 3, "0.0098"), (1003, 4, "x")]
    long = units.long_form(table(spark, rows), ["volume"], ["item_id", "step_id"])
    got = {x.item_id: x for x in units.convert(long, ["volume"]).where("item_id >= 1000").collect()}
    assert (got[1000].unit, got[1001].unit, got[1002].unit, got[1003].value) == ("uL", "mL", "L", None)
    assert abs(got[1000].value - 10) < 1e-9 and not got[1000].uncertain and got[1000].posterior > 0.95


def test_negative_amounts_meet(spark):
    a = spark.createDataFrame([(1, 7, "volume", "-5 mL", -5.0, False), (2, 7, "volume", "-0.005 L", -5.0, False), (3, 7, "volume", "5 mL", 5.0, False), (4, 7, "volume", "5.04 mL", 5.04, False), (5, 7, "volume", "0 L", 0.0, False), (6, 7, "volume", "0 mL", 0.0, False)], "item_id long, step_id long, field string, text string, value double, uncertain boolean")
    assert sorted((r.item_a, r.item_b) for r in units.same_quantity_pairs(a, "item_id", "step_id").collect()) == [(1, 2), (3, 4), (5, 6)]
