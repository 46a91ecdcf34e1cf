"""Lookups that stay whole and balanced when few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def hot_split_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], weight: str, share: int = 1000) -> DataFrame:
    """Inner join of rows with lookup (unique on keys; weight = how many rows have the key).

    Keys that hold at least 1/share of the total weight number at most `share`, so this part of the
    lookup is broadcast whatever the data's size; the hot rows never move. All other keys go through
    an ordinary shuffle join, where no key exceeds 1/share of the rows. Null keys match nothing.
    The lookup is read twice, so pass a materialised one (see session.cut) if it is costly.
    """
    bound = lookup.agg((F.sum(weight) / F.lit(share)).alias("b"))
    b = bound.first()["b"] or 0  # one number to the driver
    hot = lookup.where(F.col(weight) >= F.lit(float(b))).drop(weight)
    cold = lookup.where(F.col(weight) < F.lit(float(b))).drop(weight)
    hot_keys = hot.select(*keys)
    near = rows.join(F.broadcast(hot), keys, "inner")
    rest = rows.join(F.broadcast(hot_keys), keys, "left_anti").join(cold, keys, "inner")
    return near.unionByName(rest)
