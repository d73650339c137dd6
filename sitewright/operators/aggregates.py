"""Counts, shares, coverage, score summaries and vocabulary counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, most frequent first, nulls left out."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), column)


def grouped_share(df: DataFrame, column: str, keep: Sequence[str], other: str = "Other") -> DataFrame:
    """Rows and percent per value, values outside ``keep`` as one group."""
    group = F.when(F.col(column).isin(*keep), F.col(column)).otherwise(F.lit(other))
    counts = df.groupBy(group.alias(column)).agg(F.count("*").alias("n"))
    # at most len(keep) + 1 rows reach this window
    total = F.sum("n").over(Window.partitionBy())
    return counts.withColumn("percent", F.round(100.0 * F.col("n") / total, 1))


def class_shares(df: DataFrame, label: str, classes: Sequence[int] = (0, 1)) -> DataFrame:
    counts = df.filter(F.col(label).isin(*classes)).groupBy(label).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # one row per class
    return counts.withColumn("share", F.round(F.col("n") / total, 6))


def coverage(df: DataFrame, present: Column, missing: Column, dual: Column | None = None) -> DataFrame:
    """One row with total, present, missing (and dual) counts and percentages."""
    columns = [
        F.count("*").alias("total"),
        F.count_if(present).alias("present"),
        F.count_if(missing).alias("missing"),
    ]
    if dual is not None:
        columns.append(F.count_if(dual).alias("dual"))
    counted = df.agg(*columns)
    for name in counted.columns[1:]:
        counted = counted.withColumn(f"{name}_percent", F.round(100.0 * F.col(name) / F.col("total"), 2))
    return counted


def conditional_counts(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the number of rows for each condition."""
    return df.agg(*[F.count_if(condition).alias(name) for name, condition in conditions.items()])


def t_share(t: float, freedom: int) -> float:
    """Probability that a t-distributed value lies within -t and t: the finite series for whole degrees of freedom."""
    angle = math.atan(t / math.sqrt(freedom))
    sine, cosine = math.sin(angle), math.cos(angle)
    odd = freedom % 2
    term = cosine if odd else 1.0
    total = 0.0
    for k in range(odd, freedom - 1, 2):
        total += term
        term *= cosine * cosine * (k + 1) / (k + 2)
    return 2 / math.pi * (angle + sine * total) if odd else sine * total


def t_quantile(freedom: int, level: float = 0.95) -> float:
    """Two-sided quantile of the t distribution, to six digits."""
    low, high = 0.0, 1e6
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if t_share(middle, freedom) < level else (low, middle)
    return round(high, 6)


def score_interval(df: DataFrame, score: str, level: float = 0.95) -> DataFrame:
    """Mean, extremes and interval of repeated scores; the quantile follows the number of scores present.

    ``lower``/``upper`` scale by the population standard deviation, ``se_lower``/``se_upper``
    by the standard error. With fewer than two scores the intervals are null.
    """
    runs = df.filter(F.col(score).isNotNull()).count()
    quantile = F.lit(t_quantile(runs - 1, level) if runs > 1 else None).cast("double")
    stats = df.agg(
        F.avg(score).alias("mean"),
        F.min(score).alias("min"),
        F.max(score).alias("max"),
        F.stddev_pop(score).alias("_pop"),
        F.stddev_samp(score).alias("_samp"),
        F.count(score).alias("n"),
    )
    wide, narrow = quantile * F.col("_pop"), quantile * F.col("_samp") / F.sqrt("n")
    return stats.select(
        "n",
        *[F.round(c, 6).alias(c) for c in ("mean", "min", "max")],
        F.round(F.col("mean") - wide, 6).alias("lower"),
        F.round(F.col("mean") + wide, 6).alias("upper"),
        F.round(F.col("mean") - narrow, 6).alias("se_lower"),
        F.round(F.col("mean") + narrow, 6).alias("se_upper"),
    )


def mean_score(df: DataFrame, groups: Sequence[str], scores: Sequence[str]) -> DataFrame:
    return df.groupBy(*groups).agg(*[F.avg(s).alias(f"mean_{s}") for s in scores])


def term_counts(df: DataFrame, words: Column) -> DataFrame:
    """Occurrences (tf) and documents (df) per term, in one pass over the text.

    Each document yields its words with (1, 0) and its distinct words with (0, 1); both sums are taken in
    the same aggregate, which combines before the shuffle, so a frequent term costs one
    row per partition.
    """
    seen = F.transform(words, lambda w: F.struct(w.alias("term"), F.lit(1).alias("tf"), F.lit(0).alias("df")))
    once = F.transform(
        F.array_distinct(words), lambda w: F.struct(w.alias("term"), F.lit(0).alias("tf"), F.lit(1).alias("df"))
    )
    pairs = df.select(F.explode(F.concat(seen, once)).alias("p"))
    return pairs.groupBy(F.col("p.term").alias("term")).agg(F.sum("p.tf").alias("tf"), F.sum("p.df").alias("df"))


def any_match(df: DataFrame, key: str, match: Column, name: str = "matched") -> DataFrame:
    """True per key if any of its rows matches; null matches count as false."""
    return df.groupBy(key).agg(F.bool_or(F.coalesce(match, F.lit(False))).alias(name))
