"""Evaluation of predictions: accuracy, report, macro F1, probability histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def accuracy(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.agg(F.round(F.avg((F.col(label) == F.col(prediction)).cast("double")), 6).alias("accuracy"))


def class_scores(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """Precision, recall, F1 and support per class, from the confusion counts."""
    counts = df.groupBy(F.col(label).cast("int").alias("y"), F.col(prediction).cast("int").alias("p")).agg(
        F.count("*").alias("n")
    )
    hit = F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(F.lit(0))
    sides = counts.select(
        F.explode(
            F.array(
                F.struct(F.col("y").alias("class"), hit.alias("tp"), F.col("n").alias("support"), F.lit(0).alias("said")),
                F.struct(F.col("p").alias("class"), F.lit(0).alias("tp"), F.lit(0).alias("support"), F.col("n").alias("said")),
            )
        ).alias("s")
    )
    totals = sides.groupBy(F.col("s.class").alias("class")).agg(
        F.sum("s.tp").alias("tp"), F.sum("s.support").alias("support"), F.sum("s.said").alias("said")
    )
    precision = F.when(F.col("said") > 0, F.col("tp") / F.col("said")).otherwise(F.lit(0.0))
    recall = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(F.lit(0.0))
    f1 = F.when(F.col("said") + F.col("support") > 0, 2.0 * F.col("tp") / (F.col("said") + F.col("support")))
    return totals.select(
        "class",
        precision.alias("precision"),
        recall.alias("recall"),
        F.coalesce(f1, F.lit(0.0)).alias("f1"),
        "support",
        "tp",
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row per class, then accuracy, macro and weighted averages."""
    scores = class_scores(df, label, prediction)
    names = ("precision", "recall", "f1")
    per_class = scores.select(F.col("class").cast("string").alias("class"), *names, "support")
    share = F.sum("tp") / F.sum("support")
    right = scores.agg(*[share.alias(n) for n in names], F.sum("support").alias("support"))
    macro = scores.agg(*[F.avg(n).alias(n) for n in names], F.sum("support").alias("support"))
    weighted = scores.agg(
        *[(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(n) for n in names],
        F.sum("support").alias("support"),
    )
    report = per_class
    for title, rows in (("accuracy", right), ("macro avg", macro), ("weighted avg", weighted)):
        report = report.unionByName(rows.withColumn("class", F.lit(title)))
    return report.select("class", *[F.round(n, 6).alias(n) for n in names], "support")


def macro_f1(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return class_scores(df, label, prediction).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def histogram(
    df: DataFrame, label: str, value: str, bins: int = 50, classes: Sequence[int] = (0, 1)
) -> DataFrame:
    """Rows per class and bin; each class has its own range and a closed last bin."""
    known = df.filter(F.col(label).isin(*classes) & F.col(value).isNotNull()).select(label, value)
    limits = known.groupBy(label).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    placed = known.join(F.broadcast(limits), label)  # one row per class in ``classes``
    width = F.col("hi") - F.col("lo")
    place = F.least(F.floor((F.col(value) - F.col("lo")) / width * bins), F.lit(bins - 1)).cast("int")
    binned = placed.withColumn("bin", F.when(width > 0, place).otherwise(F.lit(bins // 2)))
    return binned.groupBy(label, "bin").agg(F.count("*").alias("n"))
