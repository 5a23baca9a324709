"""Evaluate an expression once and use it several times.

Catalyst substitutes a projected column into every filter above it and a Python expression is built by
copying its parts, so long derivations (address resolution, titles from paths) would grow without end.
``let`` binds a value inside an expression; ``stage`` adds computed columns to a DataFrame that later
filters refer to instead of repeating.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stage(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns, computed once per row. A name that exists is replaced."""
    kept = [F.col(c) for c in df.columns if c not in columns]
    row = F.struct(*[v.alias(k) for k, v in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))
