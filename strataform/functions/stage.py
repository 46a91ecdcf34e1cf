"""Computed columns that the optimizer evaluates once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def staged(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """withColumns behind a one-row generator. Filters and later projections on the new columns stay above it,
    so that costly expressions (regular expressions, JSON) are neither repeated per use nor merged into one
    oversized generated method."""
    keep = [c for c in df.columns if c not in cols]
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))
