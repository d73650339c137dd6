"""The whole way from a table of URLs to predictions, and the training of the model it uses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.functions.words import count_words
from sitewright.operators import models, pages, rows
from sitewright.operators.features import training_sets
from sitewright.operators.language import LanguageProfile
from sitewright.operators.pages import text_with_frames
from sitewright.operators.texts import Languages, html_to_text
from sitewright.sources.tables import read_table, save_stage


def detect_pages(
    df: DataFrame,
    row_id: str,
    html: str,
    profile: LanguageProfile,
    page_table: DataFrame,
    output: str = "language",
    words: str | None = None,
) -> DataFrame:
    """Language of the text a visitor sees: without popups, with the frames that can be found.

    ``words`` names an optional column with the number of words of that text.
    """
    shown = text_with_frames(df, row_id, html, page_table).withColumnRenamed("text", "_shown")
    if words:
        shown = shown.withColumn(words, count_words(F.col("_shown")))
    return profile.transform(shown, "_shown", output).drop("_shown")


def clean_pages(
    df: DataFrame, page_table: DataFrame, profile: LanguageProfile, languages: Languages, country: str = "be"
) -> DataFrame:
    """``page_id, url, html`` to ``page_id, url, language, text`` in one of the two languages.

    Detected languages are written once, because the switch looks at them from both sides of its join.
    """
    table = save_stage(detect_pages(page_table.select("url", "html"), "url", "html", profile, page_table), "page-languages")
    known = save_stage(detect_pages(df.select("page_id", "url", "html"), "page_id", "html", profile, page_table), "languages")
    switched = pages.apply_switch(known, "page_id", table, languages.both, languages.primary, country)
    kept = save_stage(rows.in_languages(switched, "language", languages.both), "switched")
    texts = html_to_text(kept, "page_id", "html", "language", languages, page_table)
    return texts.select("page_id", "url", "language", "text")


@dataclass
class TrainingConfig:
    terms: int = 300
    fraction: float = 0.8
    seed: int = 22494
    strength: float = 1.0
    embedding: dict | None = None
    language: str | None = None
    language_code: str = "en"
    small_class: int | None = None
    total: int = 0
    prebuild: bool = False


def train_scorer(df: DataFrame, config: TrainingConfig) -> tuple[PipelineModel, models.TrainedModel, list[str]]:
    """Fit features and an L1 logistic regression on ``key, text, label``.

    Returns the model for scoring, the evaluated classifier and the feature names.
    """
    options = {"language": config.language, "language_code": config.language_code, "embedding": config.embedding}
    train, test, fitted = training_sets(
        df,
        "key",
        "text",
        "label",
        config.fraction,
        config.seed,
        config.terms,
        oversample_value=config.small_class,
        total=config.total,
        prebuild=config.prebuild,
        **options,
    )
    train, test = save_stage(train, "train"), save_stage(test, "test")
    trained = models.train_model(models.logistic_l1(train.count(), config.strength), train, test)
    return models.scoring_model(fitted, trained.model), trained, fitted.names


def score_pages(
    df: DataFrame,
    page_table: DataFrame,
    profile: LanguageProfile,
    languages: Languages,
    model: PipelineModel,
    language: str = "language",
) -> DataFrame:
    """Predictions for a table of pages: language, switch, clean text, features, classifier."""
    cleaned = clean_pages(df, page_table, profile, languages)
    corpus = rows.load_corpus(cleaned, "page_id", "text", language="language")
    return models.predict(model, corpus.withColumnRenamed("language", language))


def score_url_table(
    path: str,
    page_table: DataFrame,
    profile: LanguageProfile,
    languages: Languages,
    model: PipelineModel,
    language: str = "language",
    sep: str = ",",
) -> DataFrame:
    """From a delimited file of (page_id, url) to predictions: read, fetch from the page table, then ``score_pages``.

    Rows without URL, or whose page is not in the table, have no prediction.
    """
    asked = read_table(page_table.sparkSession, path, "page_id long, url string", sep)
    known = rows.with_url(asked, "url")
    fetched = pages.attach_html(known, "page_id", "url", page_table, "url", "html").filter(F.col("html").isNotNull())
    return score_pages(fetched, page_table, profile, languages, model, language)
