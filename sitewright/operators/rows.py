"""Row filters, projections and recodes of company and document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.words import count_words


def with_url(df: DataFrame, url: str) -> DataFrame:
    return df.filter(F.col(url).isNotNull())


def without_url(df: DataFrame, url: str) -> DataFrame:
    return df.filter(F.col(url).isNull())


def in_languages(df: DataFrame, column: str, codes: Sequence[str]) -> DataFrame:
    return df.filter(F.col(column).isin(*codes))


def by_status(df: DataFrame, status: str, wanted: int = 200) -> tuple[DataFrame, DataFrame]:
    """Rows with the wanted status and all others; a null status counts as 0."""
    value = F.coalesce(F.col(status), F.lit(0))
    return df.filter(value == wanted), df.filter(value != wanted)


def enough_words(df: DataFrame, text: str, min_words: int = 20, inclusive: bool = False) -> DataFrame:
    """Rows with more than ``min_words`` words (at least, if inclusive); null text is dropped."""
    return df.filter(has_enough_words(F.col(text), min_words, inclusive))


def has_enough_words(text: Column, min_words: int = 20, inclusive: bool = False) -> Column:
    count = count_words(text)
    return count >= min_words if inclusive else count > min_words


def enough_characters(df: DataFrame, text: str, min_length: int = 20) -> DataFrame:
    return df.filter(F.length(text) >= min_length)


# Names of the two classes.
CLASS_NAMES = ("innovative", "not innovative")


def recode_label(label: Column, positive: str = CLASS_NAMES[0], negative: str = CLASS_NAMES[1]) -> Column:
    return F.when(label == 1, F.lit(positive)).otherwise(F.lit(negative))


def decide(probability: Column, threshold: float = 0.5) -> Column:
    return F.when(probability > threshold, F.lit(1)).otherwise(F.lit(0))


def drop_trailing(df: DataFrame, count: int) -> DataFrame:
    """All but the last ``count`` columns."""
    return df.select(*df.columns[: len(df.columns) - count])


def rows_to_documents(df: DataFrame, names: dict[str, str], key: str, label: str) -> DataFrame:
    """Rename survey columns; the key becomes a string, the label an integer.

    ``names`` maps survey columns to attributes. Column ``document`` holds the
    attributes that are not null as one JSON text.
    """
    fields = []
    for old, new in names.items():
        column = F.col(old).cast("int") if old == label else F.col(old)
        fields.append(column.alias(new))
    flat = df.select(F.col(key).cast("string").alias("_key"), *fields)
    return flat.withColumn("document", F.to_json(F.struct(*[F.col(c) for c in names.values()])))


def load_corpus(
    df: DataFrame, key: str, text: str, label: str | None = None, language: str | None = None
) -> DataFrame:
    """Project to ``key, text[, label][, language]``."""
    columns = [F.col(key).alias("key"), F.col(text).alias("text")]
    if label:
        columns.append(F.col(label).alias("label"))
    if language:
        columns.append(F.col(language).alias("language"))
    return df.select(*columns)


def load_revision(df: DataFrame, revision: str, label: str, key: str | None = None) -> DataFrame:
    """Rows that have both the text revision and the label; without ``key`` only these two."""
    present = df.filter(F.col(revision).isNotNull() & F.col(label).isNotNull())
    columns = [F.col(key).alias("key")] if key else []
    return present.select(*columns, F.col(revision).alias("text"), F.col(label).alias("innovation"))
