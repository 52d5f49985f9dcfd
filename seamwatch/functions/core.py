"""Evaluate once: Spark inlines projections into filters and lambdas, which repeats costly expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind a value inside one expression; ``body`` may use it many times."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def compute_once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a row generator, so later filters read them instead of recomputing them."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))
