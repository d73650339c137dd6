"""Language detection by character trigrams.

The profile is learned in one pass over labelled texts: counts per (language, trigram), of
which the most frequent per language are kept. Scoring is multinomial naive Bayes over these
counts. The profile has a fixed size (terms x languages), so scoring is a row-local
transform without join or shuffle, and works on whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import NaiveBayes, NaiveBayesModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sitewright.functions.trigrams import best_class, count_partitions
from sitewright.operators.aggregates import value_counts
from sitewright.sources.tables import save_stage

UNKNOWN = "unknown"


@dataclass
class LanguageProfile:
    codes: list[str]
    terms: list[str]
    vectorizer: CountVectorizerModel
    model: NaiveBayesModel

    @classmethod
    def fit(cls, df: DataFrame, text: str, language: str, per_language: int = 300) -> LanguageProfile:
        spark = df.sparkSession
        df = df.filter(F.col(language).isNotNull())
        lowered = df.select(F.col(language).alias("lang"), F.lower(text).cast("binary").alias("lower"))
        found = lowered.mapInArrow(count_partitions, "lang string, term string, n long")
        # counted once; of these the planner keeps the first per language in every task before it sorts a language
        counts = save_stage(found.groupBy("lang", "term").agg(F.sum("n").alias("n")), "trigrams")
        frequent = Window.partitionBy("lang").orderBy(F.desc("n"), "term")
        top = counts.withColumn("place", F.row_number().over(frequent)).filter(F.col("place") <= per_language)
        rows = counts.join(top.select("term").distinct(), "term", "left_semi").collect()
        per_language_docs = df.groupBy(F.col(language).alias("lang")).agg(F.count("*").alias("docs")).collect()
        sizes = {r["lang"]: r["docs"] for r in per_language_docs}
        codes = sorted(sizes)
        terms = sorted({r["term"] for r in rows})
        place = {term: i for i, term in enumerate(terms)}
        per_code: dict[str, dict[int, float]] = {code: {} for code in codes}
        for r in rows:
            # naive Bayes multiplies by the weight again, which restores the counts
            per_code[r["lang"]][place[r["term"]]] = r["n"] / sizes[r["lang"]]
        summary = spark.createDataFrame(
            [(float(i), float(sizes[c]), Vectors.sparse(len(terms), per_code[c])) for i, c in enumerate(codes)],
            ["label", "docs", "features"],
        )
        bayes = NaiveBayes(modelType="multinomial", smoothing=1.0, weightCol="docs").setFeaturesCol("_tf")
        model = bayes.fit(summary.withColumnRenamed("features", "_tf"))
        model.setPredictionCol("_code").setRawPredictionCol("_raw").setProbabilityCol("_chance")
        vectorizer = CountVectorizerModel.from_vocabulary(terms, inputCol="_grams", outputCol="_tf")
        return cls(codes, terms, vectorizer, model)

    def save(self, path: str) -> None:
        self.vectorizer.write().overwrite().save(f"{path}/terms")
        self.model.write().overwrite().save(f"{path}/model")
        spark = SparkSession.getActiveSession()
        codes = spark.createDataFrame(list(enumerate(self.codes)), "place int, code string")
        codes.write.mode("overwrite").parquet(f"{path}/codes")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LanguageProfile:
        vectorizer = CountVectorizerModel.load(f"{path}/terms")
        codes = [r["code"] for r in spark.read.parquet(f"{path}/codes").orderBy("place").collect()]
        return cls(codes, vectorizer.vocabulary, vectorizer, NaiveBayesModel.load(f"{path}/model"))

    def transform(self, df: DataFrame, text: str, output: str = "language") -> DataFrame:
        """Add the language code; texts without any known trigram (or null) give 'unknown'."""
        weights, prior = self.model.theta.toArray(), self.model.pi.toArray()
        detect = F.arrow_udf(best_class(self.terms, self.codes, weights, prior, UNKNOWN), "string")
        return df.withColumn(output, detect(F.lower(text).cast("binary")))


def language_table(df: DataFrame, text: str, profile: LanguageProfile) -> DataFrame:
    """Rows per detected language."""
    return value_counts(profile.transform(df, text, "language"), "language")
