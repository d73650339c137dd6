"""Classifiers on assembled features: training, reports, search, prediction, explanation."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes, RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import Binarizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, CrossValidatorModel, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.operators.features import FeatureSet
from sitewright.operators.metrics import accuracy, classification_report, histogram, macro_f1
from sitewright.operators.rows import decide
from sitewright.operators.sampling import fold_number, one_per_key, oversample, side_by_side, split, top_k

MAX_TREE_DEPTH = 30  # the limit of the tree learner


def logistic_l1(rows: int, c: float = 1.0, max_iter: int = 10_000, tol: float = 1e-4) -> LogisticRegression:
    """L1 logistic regression with inverse strength ``c``.

    The loss here is a mean over rows, hence the weight 1 / (c * rows).
    """
    return LogisticRegression(
        elasticNetParam=1.0,
        regParam=1.0 / (c * rows),
        standardization=False,
        maxIter=max_iter,
        tol=tol,
        labelCol="label",
    )


def random_forest(
    rows: int,
    trees: int = 200,
    depth: int | None = None,
    sample: int = 2000,
    min_rows: int = 1,
    seed: int = 22494,
) -> RandomForestClassifier:
    """Entropy forest; each tree sees about ``sample`` rows. Without ``depth`` trees grow as deep as the learner allows."""
    if depth and depth > MAX_TREE_DEPTH:
        raise ValueError(f"trees can be {MAX_TREE_DEPTH} deep at most")
    return RandomForestClassifier(
        impurity="entropy",
        numTrees=trees,
        maxDepth=depth or MAX_TREE_DEPTH,
        minInstancesPerNode=min_rows,
        subsamplingRate=min(1.0, sample / rows),
        featureSubsetStrategy="sqrt",
        seed=seed,
        labelCol="label",
    )


@dataclass
class BernoulliBayes:
    """Bernoulli naive Bayes on features above 0, with class shares as prior.

    The built-in model smooths the prior as well; ``shift`` puts the plain shares back.
    """

    model: PipelineModel
    shift: list[float]

    @classmethod
    def fit(cls, train: DataFrame, smoothing: float = 1.0) -> BernoulliBayes:
        binary = Binarizer(threshold=0.0, inputCol="features", outputCol="present")
        bayes = NaiveBayes(modelType="bernoulli", smoothing=smoothing, featuresCol="present", labelCol="label")
        fitted = bayes.fit(binary.transform(train))
        counts = {r["label"]: r["n"] for r in train.groupBy("label").agg(F.count("*").alias("n")).collect()}
        total = sum(counts.values())
        pi = fitted.pi.toArray()
        shift = [math.log(counts[c] / total) - float(pi[c]) for c in sorted(counts)]
        return cls(PipelineModel([binary, fitted]), shift)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``scores`` (log score per class), ``proba`` of class 1 and ``prediction``."""
        scored = self.model.transform(df).drop("prediction", "probability")
        shifts = F.array(*[F.lit(s) for s in self.shift])
        scores = F.zip_with(vector_to_array("rawPrediction"), shifts, lambda raw, s: raw + s)
        top = scored.withColumn("scores", scores).drop("rawPrediction", "present")
        gap = F.col("scores")[0] - F.col("scores")[1]
        proba = 1.0 / (1.0 + F.exp(gap))
        return top.withColumn("proba", proba).withColumn("prediction", (gap < 0).cast("double"))


def positive_share(df: DataFrame, name: str = "proba") -> DataFrame:
    """Probability of class 1 from the probability vector."""
    return df.withColumn(name, vector_to_array("probability")[1])


@dataclass
class TrainedModel:
    model: object
    train: DataFrame
    test: DataFrame

    def accuracies(self) -> DataFrame:
        parts = [
            accuracy(df).withColumn("part", F.lit(name)) for name, df in (("train", self.train), ("test", self.test))
        ]
        return parts[0].unionByName(parts[1])

    def report(self) -> DataFrame:
        return classification_report(self.test)

    def histograms(self, bins: int = 50) -> DataFrame:
        parts = [
            histogram(df, "label", "proba", bins).withColumn("part", F.lit(name))
            for name, df in (("train", self.train), ("test", self.test))
        ]
        return parts[0].unionByName(parts[1])


def train_model(estimator, train: DataFrame, test: DataFrame, path: str | None = None) -> TrainedModel:
    """Fit, score both parts and optionally save the model."""
    model = estimator.fit(train)
    if path:
        model.write().overwrite().save(path)
    return evaluate(model, train, test)


def evaluate(model, train: DataFrame, test: DataFrame) -> TrainedModel:
    """A fitted model with both parts scored."""
    return TrainedModel(model, positive_share(model.transform(train)), positive_share(model.transform(test)))


def cross_validate(
    estimator, df: DataFrame, key: str, folds: int = 5, seed: int = 22494, grid: list | None = None, parallelism: int = 3
) -> CrossValidatorModel:
    """k-fold accuracy with hash folds; ``grid`` lists the parameter maps to try."""
    folded = df.withColumn("fold", fold_number([key], folds, seed))
    validator = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid or [{}],
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy", labelCol="label"),
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
    )
    return validator.fit(folded)


def logistic_grid(estimator: LogisticRegression, rows: int, exponents: Sequence[int] = range(-3, 4)) -> list:
    """Seven strengths times L1, L2 and five mixes: 49 points."""
    mixes = [1.0, 0.0, 0.1, 0.3, 0.5, 0.7, 0.9]
    return (
        ParamGridBuilder()
        .addGrid(estimator.regParam, [1.0 / (10.0**e * rows) for e in exponents])
        .addGrid(estimator.elasticNetParam, mixes)
        .build()
    )


def forest_grid(
    estimator: RandomForestClassifier,
    depths: Sequence[int] = (10, MAX_TREE_DEPTH),
    trees: Sequence[int] = (100, 200, 500, 1000, 1500),
) -> list:
    """The axes of the forest search that the learner has."""
    return (
        ParamGridBuilder()
        .addGrid(estimator.bootstrap, [True, False])
        .addGrid(estimator.impurity, ["entropy", "gini"])
        .addGrid(estimator.maxDepth, list(depths))
        .addGrid(estimator.minInstancesPerNode, [1, 2, 4])
        .addGrid(estimator.numTrees, list(trees))
        .build()
    )


def search_logistic(df: DataFrame, key: str, folds: int = 10, seed: int = 22494) -> CrossValidatorModel:
    """Accuracy of all 49 points in ten folds over all labelled feature rows."""
    rows = df.count()
    model = logistic_l1(rows)
    return cross_validate(model, df, key, folds, seed, logistic_grid(model, rows))


def search_forest(df: DataFrame, key: str, folds: int = 10, seed: int = 22494) -> CrossValidatorModel:
    """Accuracy of all points of the forest grid in ten folds over all labelled feature rows."""
    model = random_forest(df.count())
    return cross_validate(model, df, key, folds, seed, forest_grid(model))


def grid_table(fitted: CrossValidatorModel) -> DataFrame:
    """One row per grid point with its parameters and mean accuracy."""
    from pyspark.sql import SparkSession

    rows = [
        (i, ", ".join(sorted(f"{p.name}={v}" for p, v in params.items())), float(score))
        for i, (params, score) in enumerate(zip(fitted.getEstimatorParamMaps(), fitted.avgMetrics))
    ]
    return SparkSession.getActiveSession().createDataFrame(rows, "point int, parameters string, mean_accuracy double")


def scoring_model(features: FeatureSet, classifier) -> PipelineModel:
    """Features and classifier as one model that can be saved and loaded."""
    return PipelineModel([*features.stages, classifier])


def predict(model: PipelineModel, df: DataFrame, key: str = "key", seed: int = 22494) -> DataFrame:
    """``key, predictions_proba, predictions`` with one row per key."""
    ready = df.filter(F.col("text").isNotNull())
    scored = positive_share(model.transform(ready), "predictions_proba")
    labelled = scored.select(key, "predictions_proba", decide(F.col("predictions_proba")).alias("predictions"))
    return one_per_key(labelled, [key], [key, "predictions_proba"], seed)


def coefficient_rows(df: DataFrame, size: int = 20, mask: Sequence[str] = ()) -> DataFrame:
    """Most negative and most positive features next to each other.

    ``df`` has ``feature, coef``; ``mask`` lists features to leave out (embedding positions).
    """
    words = df.filter(~F.col("feature").isin(*mask)) if mask else df
    low = top_k(words, "coef", "feature", size, ascending=True)
    high = top_k(words, "coef", "feature", size)
    low = low.select(F.col("feature").alias("negative_word"), F.col("coef").alias("negative_coef"))
    high = high.select(F.col("feature").alias("positive_word"), F.col("coef").alias("positive_coef"))
    return side_by_side(
        low,
        high,
        [F.col("negative_coef").asc(), F.col("negative_word")],
        [F.col("positive_coef").desc(), F.col("positive_word")],
    )


def coefficient_table(classifier, features: FeatureSet, size: int = 20, mask: bool = True) -> DataFrame:
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    rows = [(name, float(value)) for name, value in zip(features.names, classifier.coefficients.toArray())]
    hidden = [name for name in features.names if name.isdigit() or name == "doc_vector"] if mask else []
    return coefficient_rows(spark.createDataFrame(rows, "feature string, coef double"), size, hidden)


def repeated_splits(
    rows: DataFrame,
    key: str,
    seeds: Sequence[int],
    fraction: float = 0.8,
    estimator=None,
    oversample_value: int | None = None,
    total: int = 0,
) -> DataFrame:
    """Test accuracy and macro F1 for each split seed.

    The feature rows are computed once and kept; each seed is one distributed fit. With ``oversample_value`` that
    class of the training part is filled up to ``total`` rows.
    """
    kept = rows.persist()
    size = kept.count()
    results = []
    for seed in seeds:
        train, test = split(kept, [key], fraction, seed)
        if oversample_value is not None:
            train = oversample(train, [key], "label", oversample_value, total, seed)
        fit = estimator or logistic_l1(round(size * fraction))
        scored = fit.fit(train).transform(test)
        score = accuracy(scored).withColumn("seed", F.lit(seed))
        f1 = macro_f1(scored)
        results.append((seed, score.first()["accuracy"], f1.first()["macro_f1"]))
    kept.unpersist()
    return rows.sparkSession.createDataFrame(results, "seed int, accuracy double, macro_f1 double")


def export_by_zip(predictions: DataFrame, base: DataFrame, key: str, zip_column: str, label: str) -> DataFrame:
    """``zip, label, prediction`` joined on the key."""
    chosen = base.select(key, zip_column, label)
    return chosen.join(predictions.select(key, F.col("predictions").alias("prediction")), key)
