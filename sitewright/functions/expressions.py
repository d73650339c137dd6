"""Building blocks that keep costly expressions from being computed more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, also where it is used inside a lambda."""
    return F.transform(F.array(value), body)[0]


def compute_and_keep(df: DataFrame, name: str, value: Column, condition: Callable[[Column], Column]) -> DataFrame:
    """Set column ``name`` to ``value`` and keep the rows for which ``condition(value)`` holds.

    A plain filter would be pushed below the projection, which computes ``value`` twice; behind an
    explode of zero or one element it is computed once.
    """
    others = [c for c in df.columns if c != name]
    return df.select(*others, F.explode(F.filter(F.array(value), condition)).alias(name))
