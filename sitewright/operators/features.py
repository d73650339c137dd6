"""Text features: TF-IDF, bag of words, embeddings, and their assembly into one vector.

A vocabulary is fitted by one aggregate over the corpus and has a bounded size; applying it is
row-local (sparse vectors, never a column per word). A fitted feature set is a Spark
ML ``PipelineModel``, so it is saved and reused with the classifier.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.functions.words import WORD_GAP, tokens
from sitewright.operators.aggregates import term_counts
from sitewright.operators.sampling import one_per_key, oversample, split
from sitewright.operators.word_vectors import WordVectors, mean_stage, mean_vectors, train_vectors
from sitewright.sources.tables import drop_stage, save_stage


@dataclass
class Vocabulary:
    """The most frequent terms with document counts, and the corpus size."""

    terms: list[str]
    doc_counts: list[int]
    docs: int

    @classmethod
    def fit(cls, df: DataFrame, text: str, max_terms: int) -> Vocabulary:
        # '' never is a token, so one '' per document counts the documents in the same pass
        words = F.concat(tokens(F.col(text)), F.array(F.lit("")))
        counts = term_counts(df, words)
        top = counts.orderBy((F.col("term") == "").desc(), F.desc("tf"), "term").limit(max_terms + 1).collect()
        if not top:
            return cls([], [], 0)
        terms = sorted(top[1:], key=lambda row: row["term"])
        return cls([r["term"] for r in terms], [r["df"] for r in terms], top[0]["df"])

    @classmethod
    def fit_groups(cls, df: DataFrame, group: str, text: str, max_terms: int) -> dict[str, Vocabulary]:
        """The vocabulary of every value of ``group`` from one aggregate over (group, term)."""
        words = F.concat(tokens(F.col(text)), F.array(F.lit("")))
        named = F.transform(words, lambda w: F.struct(F.col(group).alias("group"), w.alias("word")))
        counts = term_counts(df, named).select("term.group", F.col("term.word").alias("term"), "tf", "df")
        order = Window.partitionBy("group").orderBy((F.col("term") == "").desc(), F.desc("tf"), "term")
        top = counts.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= max_terms + 1)
        found: dict[str, list] = {}
        for row in top.orderBy("group", "term").collect():
            found.setdefault(row["group"], []).append(row)
        return {
            name: cls([r["term"] for r in rows[1:]], [r["df"] for r in rows[1:]], rows[0]["df"]) for name, rows in found.items()
        }

    def smooth_idf(self) -> list[float]:
        return [math.log((1 + self.docs) / (1 + count)) + 1.0 for count in self.doc_counts]


def count_stages(vocabulary: Vocabulary, text: str, output: str, binary: bool = False) -> list:
    """Stages text -> words -> term counts."""
    return [
        RegexTokenizer(inputCol=text, outputCol="words", pattern=WORD_GAP, minTokenLength=2),
        CountVectorizerModel.from_vocabulary(vocabulary.terms, inputCol="words", outputCol=output, binary=binary)
        if binary
        else CountVectorizerModel.from_vocabulary(vocabulary.terms, inputCol="words", outputCol=output),
    ]


def tfidf_stages(vocabulary: Vocabulary, text: str, output: str = "tfidf") -> list:
    """Stages text -> words -> counts -> counts times smooth idf -> unit length."""
    return [
        *count_stages(vocabulary, text, "counts"),
        ElementwiseProduct(scalingVec=Vectors.dense(vocabulary.smooth_idf()), inputCol="counts", outputCol="weighted"),
        Normalizer(p=2.0, inputCol="weighted", outputCol=output),
    ]


def tfidf(df: DataFrame, text: str, max_terms: int, output: str = "tfidf") -> tuple[DataFrame, Vocabulary]:
    """TF-IDF over the whole set, to be split afterwards."""
    vocabulary = Vocabulary.fit(df, text, max_terms)
    model = PipelineModel(tfidf_stages(vocabulary, text, output))
    return model.transform(df).drop("words", "counts", "weighted"), vocabulary


def bag_of_words(
    df: DataFrame, text: str, max_terms: int, binary: bool = False, output: str = "bow"
) -> tuple[DataFrame, Vocabulary]:
    vocabulary = Vocabulary.fit(df, text, max_terms)
    model = PipelineModel(count_stages(vocabulary, text, output, binary))
    return model.transform(df).drop("words"), vocabulary


def split_then_tfidf(
    train: DataFrame, test: DataFrame, text: str, max_terms: int
) -> tuple[DataFrame, DataFrame, Vocabulary]:
    """Vocabulary and idf from the training part, applied to both."""
    vocabulary = Vocabulary.fit(train, text, max_terms)
    model = PipelineModel(tfidf_stages(vocabulary, text))
    helper = ("words", "counts", "weighted")
    return model.transform(train).drop(*helper), model.transform(test).drop(*helper), vocabulary


def split_then_bag_of_words(
    train: DataFrame, test: DataFrame, text: str, max_terms: int
) -> tuple[DataFrame, DataFrame, Vocabulary]:
    vocabulary = Vocabulary.fit(train, text, max_terms)
    model = PipelineModel(count_stages(vocabulary, text, "bow"))
    return model.transform(train).drop("words"), model.transform(test).drop("words"), vocabulary


def long_form(df: DataFrame, keys: Sequence[str], vector: str, terms: list[str], value: str = "weight") -> DataFrame:
    """One row per key and term with a weight that is not 0; zeros leave inside the array, so they never become rows."""
    names = F.array(*[F.lit(t) for t in terms])
    named = F.zip_with(names, vector_to_array(vector), lambda t, w: F.struct(t.alias("term"), w.alias(value)))
    present = F.filter(named, lambda x: x[value] != 0)
    return df.select(*keys, F.explode(present).alias("_present")).select(*keys, "_present.term", f"_present.{value}")


def text_sets(
    df: DataFrame,
    key: str,
    label: str,
    fraction: float,
    seed: int,
    oversample_value: int | None = None,
    total: int = 0,
    oversample_seed: int = 22494,
) -> tuple[DataFrame, DataFrame]:
    """Train and test rows; copies of the small class are added to the training part only."""
    train, test = split(df, [key], fraction, seed)
    if oversample_value is not None:
        train = oversample(train, [key], label, oversample_value, total, oversample_seed)
    return train, test


def transformer_sets(
    df: DataFrame, key: str, label: str, fraction: float, seed: int, oversample_value: int, total: int
) -> tuple[DataFrame, DataFrame]:
    """Balanced training set and test set with one row per key, no key in both."""
    train, test = text_sets(df, key, label, fraction, seed, oversample_value, total)
    return train, one_per_key(test, [key], [key], seed)


# --- embeddings ---------------------------------------------------------------------------


def train_word_vectors(
    df: DataFrame,
    words: str,
    size: int,
    epochs: int,
    window: int,
    min_count: int,
    seed: int = 22494,
    partitions: int | None = None,
) -> WordVectors:
    """Word vectors from an array column.

    Training is spread over ``partitions`` blocks of documents, by default one per ``word_vectors.BLOCK_TOKENS`` words. The result
    depends on their number, so it is an argument or follows the input, and is not taken from the session.
    """
    return WordVectors(vectors=train_vectors(df, words, size, epochs, window, min_count, seed, partitions), size=size, inputCol=words)


def doc_vector(df: DataFrame, key: str, words: Column, vectors: DataFrame) -> DataFrame:
    """One number per key: the mean over all vector components of its known words; keys without known words do not come back.

    ``vectors`` has (word, vector as array). Documents ask for words block by block, and nothing of the vectors' size is broadcast.
    """
    total = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x)
    means = vectors.select("word", F.array(total / F.size("vector")).alias("vector"))
    texts = save_stage(df.select(F.col(key).alias("id"), words.alias("words")), "worded-texts", release=True)
    found = mean_vectors(texts, means, 1, known_only=True).filter("known > 0")
    drop_stage(texts)  # its words are in blocks now
    sums = found.groupBy(F.col("id").alias(key)).agg(F.sum(F.col("mean")[0] * F.col("known")).alias("sum"), F.sum("known").alias("n"))
    return sums.select(key, (F.col("sum") / F.col("n")).alias("doc_vector"))


def document_embeddings(df: DataFrame, key: str, words: str, model: WordVectors, output: str = "embedding") -> DataFrame:
    """(key, embedding as array): the mean vector of a document's known words; zeros if it has none."""
    size = model.getVectorSize()
    by_key = df.groupBy(F.col(key).alias("id")).agg(F.flatten(F.collect_list(words)).alias("words"))
    texts = save_stage(by_key, "embedded-texts", release=True)
    keys = save_stage(texts.select(F.col("id").alias(key)), "embedded-keys")
    means = mean_stage(texts, model.getVectors(), size, known_only=True)
    zeros = F.array_repeat(F.lit(0.0), size)
    joined = keys.join(means.drop("known").withColumnRenamed("id", key), key, "left")
    return joined.select(key, F.coalesce("mean", zeros).alias(output))


def word_vector_table(model: WordVectors) -> DataFrame:
    return model.getVectors().select("word", F.col("vector").cast("array<double>").alias("vector"))


@dataclass
class FeatureSet:
    """Fitted features: stages up to the assembled vector, with a name per position."""

    stages: list
    names: list[str] = field(default_factory=list)

    def model(self) -> PipelineModel:
        return PipelineModel(self.stages)


HELPER_COLUMNS = ("words", "counts", "weighted", "tfidf", "embedding", "in_language")


def fit_features(
    df: DataFrame,
    text: str,
    max_terms: int,
    language: str | None = None,
    language_code: str = "en",
    embedding: dict | None = None,
    extra: Sequence[str] = (),
    output: str = "features",
    vocabulary: Vocabulary | None = None,
) -> FeatureSet:
    """TF-IDF, optional language flag, document embedding and numeric columns in one vector.

    ``embedding`` holds the arguments of ``train_word_vectors``; the document vector is the mean of its word
    vectors. All parts are computed on the same row, so nothing is joined by position or key.
    """
    vocabulary = vocabulary or Vocabulary.fit(df, text, max_terms)
    stages = tfidf_stages(vocabulary, text)
    parts, names = ["tfidf"], list(vocabulary.terms)
    if extra:
        parts += list(extra)
        names += list(extra)
    if language:
        flag = f"CAST(coalesce({language} = '{language_code}', false) AS DOUBLE) AS in_language"
        stages.append(SQLTransformer(statement=f"SELECT *, {flag} FROM __THIS__"))
        parts.append("in_language")
        names.append("in_language")
    if embedding:
        words = stages[0].transform(df)
        # next to the words: the stage writes its rows once, and counts and weights are then made from these
        stages.insert(1, train_word_vectors(words, "words", **embedding))
        parts.append("embedding")
        names += [str(i) for i in range(embedding["size"])]
    stages.append(VectorAssembler(inputCols=parts, outputCol=output))
    return FeatureSet(stages, names)


def assemble(df: DataFrame, key: str, features: FeatureSet, seed: int = 22494, keep: Sequence[str] = ()) -> DataFrame:
    """One row per key with the feature vector and the columns in ``keep`` (label, zip ...)."""
    ready = features.model().transform(df).select(key, *keep, "features")
    return one_per_key(ready, [key], [key], seed)


def training_sets(
    df: DataFrame,
    key: str,
    text: str,
    label: str,
    fraction: float,
    seed: int,
    max_terms: int,
    oversample_value: int | None = None,
    total: int = 0,
    prebuild: bool = False,
    keep: Sequence[str] = (),
    **options,
) -> tuple[DataFrame, DataFrame, FeatureSet]:
    """Feature rows split into train and test.

    The small class is filled up in the training part. With ``prebuild=True`` it is filled up before the
    vocabulary is fitted and the copies are dropped again, which only moves the
    vocabulary and idf.
    """
    base = df
    if prebuild and oversample_value is not None:
        base = oversample(df, [key], label, oversample_value, total, 22494)
    features = fit_features(base, text, max_terms, **options)
    # read for both parts, and for the counts, ranks and copies of the small class: made once
    rows = save_stage(assemble(df, key, features, seed, [label, *keep]), "feature-rows")
    train, test = split(rows, [key], fraction, seed)
    if oversample_value is not None and not prebuild:
        train = oversample(train, [key], label, oversample_value, total, 22494)
    return train, test, features
