"""Relaxed one-to-one matching of canonical key sets, as native array expressions (no join, no Python).

A gold part must occur inside a predicted part; each predicted key goes to the first unused gold key it
fits, predicted keys in code point order. Greedy, not a maximum matching, by definition.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_ISO = "^[0-9]{1,3}[a-z]{1,3}$"


def component_match(pred: Column, gold: Column) -> Column:
    return (pred == gold) | ((pred != "") & (gold != "") & gold.rlike("[a-z]") & F.contains(pred, gold))


def isotope_token(key: Column) -> Column:
    return F.get(F.filter(F.split(key, "[|]"), lambda x: x.rlike(_ISO)), F.lit(0))


def key_match(pred: Column, gold: Column, isotope_shortcut: bool) -> Column:
    """Equal, or (with the shortcut) of the same isotope, or every gold part inside another predicted part, taken
    greedily in order."""
    p, g = F.split(pred, "[|]"), F.split(gold, "[|]")
    start = F.struct(F.lit(True).alias("ok"), F.expr("CAST(array() AS array<int>)").alias("used"))

    def step(acc: Column, part: Column) -> Column:
        free = F.filter(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda z: component_match(z["x"], part) & ~F.array_contains(acc["used"], z["i"]))
        first = F.get(free, F.lit(0))["i"]
        return F.struct((acc["ok"] & first.isNotNull()).alias("ok"), F.when(first.isNotNull(), F.array_append(acc["used"], first)).otherwise(acc["used"]).alias("used"))

    fits = (pred != "") & (gold != "") & F.aggregate(g, start, step)["ok"]
    if isotope_shortcut:
        a, b = isotope_token(pred), isotope_token(gold)
        fits = F.coalesce(a == b, F.lit(False)) | fits
    return (pred == gold) | fits


def match_counts(pred: Column, gold: Column, isotope_shortcut: bool = False) -> Column:
    """struct<tp,fp,fn> of two arrays of distinct keys; null counts as empty."""
    empty = F.expr("CAST(array() AS array<string>)")
    p, g = F.array_sort(F.coalesce(pred, empty)), F.array_sort(F.coalesce(gold, empty))
    start = F.expr("CAST(array() AS array<int>)")

    def step(used: Column, x: Column) -> Column:
        fit = F.filter(F.transform(g, lambda y, i: F.struct(y.alias("y"), i.alias("i"))), lambda z: ~F.array_contains(used, z["i"]) & key_match(x, z["y"], isotope_shortcut))
        first = F.get(fit, F.lit(0))["i"]
        return F.when(first.isNotNull(), F.array_append(used, first)).otherwise(used)

    tp = F.size(F.aggregate(p, start, step))
    return F.struct(tp.alias("tp"), (F.size(p) - tp).alias("fp"), (F.size(g) - tp).alias("fn"))


def exact_counts(pred: Column, gold: Column) -> Column:
    """struct<tp,fp,fn> of plain set overlap."""
    empty = F.expr("CAST(array() AS array<string>)")
    p, g = F.coalesce(pred, empty), F.coalesce(gold, empty)
    tp = F.size(F.array_intersect(p, g))
    return F.struct(tp.alias("tp"), F.size(F.array_except(p, g)).alias("fp"), F.size(F.array_except(g, p)).alias("fn"))


def prf(counts: Column) -> dict[str, Column]:
    """precision, recall and F1; 0 where a denominator is 0."""
    tp, fp, fn = (counts[x].cast("double") for x in ("tp", "fp", "fn"))
    p = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    r = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def jaccard(counts: Column) -> Column:
    """tp / (tp + fp + fn); 1 where both sides are empty."""
    n = counts["tp"] + counts["fp"] + counts["fn"]
    return F.when(n == 0, 1.0).otherwise(counts["tp"].cast("double") / n)
