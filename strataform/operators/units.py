"""Quantities recorded in different units: one value per field, units of bare numbers by posterior.

Cases: null, blank and non-numeric texts have no value; texts without a unit get the unit of highest
posterior, flagged uncertain below the threshold; ties in the posterior are uncertain; repeated deliveries
of an item count once in the pairs; empty tables give none; very long texts are read whole.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataform.functions import quantity as q
from strataform.functions.stage import staged

_BIN = 0.05  # decades (degrees/20 for temperature) of the histograms the mixtures are fitted to
_REACH = 400  # bins to either side; what lies beyond falls into the last bin


def long_form(df: DataFrame, fields: list[str], keep: list[str]) -> DataFrame:
    """keep, field, text: one row per non-blank text of the fields."""
    pairs = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields])
    return df.select(*keep, F.explode(pairs).alias("p")).select(*keep, "p.field", "p.text").where(r"text RLIKE '\\S'")


def _by_field(fields: list[str], f) -> Column:
    out = F.lit(None).cast("double")
    for name in fields:
        out = F.when(F.col("field") == name, f(name)).otherwise(out)
    return out


def _scaled(field: str, v: Column) -> Column:
    return v / 20 if field == "temperature" else F.log10(v)


def read_units(long: DataFrame, fields: list[str]) -> DataFrame:
    """Adds n and u (number and unit as written), written (value in the field's unit) and bare (the number of
    a text without a unit)."""
    df = q.read(long, "text")
    return staged(df, {"written": _by_field(fields, lambda f: q.value(f, F.col("n"), F.col("u"))), "bare": F.when(F.col("u") == "", F.col("n"))})


def fit_units(readings: DataFrame, fields: list[str]) -> dict[str, dict[str, tuple[float, float, float]]]:
    """Per field and candidate unit (weight, mean, deviation), mean and deviation of the field's values in
    its one unit on the log scale (temperature: linear). The components lie apart by the known conversion factors;
    weights, mean and deviation by EM over the bare numbers, along with the values whose units are written.

    Only histograms of at most 2 * _REACH + 1 bins a field reach the driver, whatever the data's size.
    """
    clip = lambda c: F.when(c.isNotNull(), F.greatest(F.least(F.round(c / _BIN), F.lit(_REACH)), F.lit(-_REACH))).cast("int")
    scaled = lambda v: F.when(F.col("field") == "temperature", v / 20).otherwise(F.log10(v))
    h = readings.select("field", clip(scaled(F.col("written"))).alias("known"), clip(scaled(F.col("bare"))).alias("raw"))
    h = h.groupBy("field", "known", "raw").count().collect()
    out = {}
    for f in fields:
        k = np.array([(r["known"], r["count"]) for r in h if r["field"] == f and r["known"] is not None], dtype=float).reshape(-1, 2)
        b = np.array([(r["raw"], r["count"]) for r in h if r["field"] == f and r["known"] is None and r["raw"] is not None], dtype=float).reshape(-1, 2)
        names = list(q.CANDIDATES[f])
        if not len(k):
            out[f] = {n: (1 / len(names), 0.0, 1.0) for n in names}
            continue
        x, w = k[:, 0] * _BIN, k[:, 1]
        mean = float((x * w).sum() / w.sum())
        dev = max(float(math.sqrt(((x - mean) ** 2 * w).sum() / w.sum())), 0.1)
        pi = np.full(len(names), 1 / len(names))
        if len(b):
            y = b[:, 0] * _BIN
            at = np.stack([_placed(f, y, *q.CANDIDATES[f][n]) for n in names], 1)
            for _ in range(100):
                post = np.exp(-0.5 * ((at - mean) / dev) ** 2) / dev * pi
                post /= np.maximum(post.sum(1, keepdims=True), 1e-300)
                part = post * b[:, 1:]
                pi = part.sum(0) / max(part.sum(), 1e-300)
                total = w.sum() + part.sum()
                mean = float(((x * w).sum() + (at * part).sum()) / total)
                dev = max(float(math.sqrt((((x - mean) ** 2 * w).sum() + ((at - mean) ** 2 * part).sum()) / total)), 0.1)
        out[f] = {n: (float(pi[i]), mean, dev) for i, n in enumerate(names)}
    return out


def _placed(field: str, y: np.ndarray, factor: float, offset: float) -> np.ndarray:
    """Where numbers lie on the field's scale if they are in a unit."""
    return (y * 20 * factor + offset) / 20 if field == "temperature" else y + math.log10(factor)


def convert(long: DataFrame, fields: list[str], sure: float = 0.95) -> DataFrame:
    """Adds value DOUBLE (one unit per field), unit STRING (the unit read or assigned), posterior DOUBLE (1 for
    units that were written) and uncertain BOOLEAN (assigned below `sure`). Narrow once the mixtures are fitted."""
    df = read_units(long, fields)
    model = fit_units(df, fields)
    bare = F.col("bare")
    best = F.lit(None).cast("struct<p:double,value:double,unit:string>")
    for f in fields:
        if sum(w for w, _, _ in model[f].values()) == 0:
            continue
        options = []
        for name, (factor, offset) in q.CANDIDATES[f].items():
            pi, mean, dev = model[f][name]
            v = bare * factor + offset
            z = (_scaled(f, v) - mean) / dev
            options.append(F.struct((F.lit(pi / dev) * F.exp(-0.5 * z * z)).alias("p"), v.alias("value"), F.lit(name).alias("unit")))
        arr = F.array(*options)
        total = F.aggregate(arr, F.lit(0.0), lambda a, o: a + F.coalesce(o["p"], F.lit(0.0)))
        top = F.array_max(F.filter(arr, lambda o: o["p"].isNotNull()))
        best = F.when(F.col("field") == f, F.when(total > 0, F.struct((top["p"] / total).alias("p"), top["value"].alias("value"), top["unit"].alias("unit")))).otherwise(best)
    df = staged(df, {"b": F.when(F.col("written").isNull() & bare.isNotNull(), best)})
    out = {
        "value": F.coalesce("written", "b.value"),
        "unit": F.when(F.col("written").isNotNull(), F.col("u")).otherwise(F.col("b.unit")),
        "posterior": F.when(F.col("written").isNotNull(), 1.0).otherwise(F.col("b.p")),
        "uncertain": F.coalesce(F.col("b.p") < sure, F.lit(False)),
    }
    return staged(df, out).select(*long.columns, *out)


def same_quantity_pairs(amounts: DataFrame, item: str, within: str, rel: float = 0.01, degrees: float = 0.5) -> DataFrame:
    """(field, item_a, item_b) of amounts in the same group whose texts differ but whose values agree. Amounts whose unit
    is uncertain state no quantity and make no pair.

    An equi-join on group and value bucket: one side holds its own bucket, the other its neighbours too, so
    that a group of any size is met only by values next to each other, never by all of its pairs."""
    a = amounts.where(F.col("value").isNotNull() & ~F.col("uncertain") & F.col(within).isNotNull())
    temp = F.col("field") == "temperature"
    size = F.floor(F.log(F.nullif(F.abs("value"), F.lit(0.0))) / -math.log1p(-rel))  # negative amounts far from positive ones
    bucket = F.when(temp, F.floor(F.col("value") / degrees)).when(F.col("value") == 0, F.lit(-(10**9))).otherwise(size + F.when(F.col("value") < 0, 10**9).otherwise(0))
    a = staged(a, {"b": bucket.cast("bigint")}).select("field", F.col(within).alias("g"), F.col(item).alias("item"), "text", "value", "b")
    left = a.select("field", "g", "b", F.col("item").alias("item_a"), F.col("text").alias("ta"), F.col("value").alias("va"))
    right = a.select("field", "g", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1)).alias("b"), F.col("item").alias("item_b"), F.col("text").alias("tb"), F.col("value").alias("vb"))
    d = F.abs(F.col("va") - F.col("vb"))
    close = F.when(temp, d <= degrees + 1e-9).otherwise(d <= rel * F.greatest(F.abs("va"), F.abs("vb")) * (1 + 1e-9))
    return left.join(right, ["field", "g", "b"]).where((F.col("item_a") < F.col("item_b")) & (F.col("ta") != F.col("tb")) & close).select("field", "item_a", "item_b").distinct()
