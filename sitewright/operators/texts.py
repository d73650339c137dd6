"""Whole text chains: pages to clean text, and several text revisions in one pass."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.cleaning import Recipe, versions
from sitewright.functions.expressions import compute_and_keep
from sitewright.functions.html import page_text, remove_popups
from sitewright.functions.words import MIN_STEM, SUFFIX_RULES, stop_list
from sitewright.operators.pages import text_with_frames


@dataclass(frozen=True)
class Languages:
    primary: str
    secondary: str

    @property
    def both(self) -> tuple[str, str]:
        return self.primary, self.secondary


def _stop_words(languages: Languages) -> dict[str, frozenset[bytes]]:
    """The primary language loses both lists, the secondary its own."""
    lists = {code: frozenset(word.encode() for word in stop_list(code)) for code in languages.both}
    return lists | {languages.primary: lists[languages.primary] | lists[languages.secondary]}


def clean_column(text: Column, language: Column, languages: Languages, min_length: int = 3, least: int = 0) -> Column:
    """Letters only, short words out, stop words out; null for other languages and texts with fewer than ``least`` words left.

    Not for use inside a lambda.
    """
    return versions(text, language, [Recipe(min_length, least, _stop_words(languages))])[0]


def clean_corpus(
    df: DataFrame, text: str, language: str, languages: Languages, min_words: int = 20, inclusive: bool = False
) -> DataFrame:
    """Rows in the two languages with clean text of more than ``min_words`` words."""
    chosen = df.filter(F.col(language).isin(*languages.both))
    least = min_words if inclusive else min_words + 1
    cleaned = clean_column(F.col(text), F.col(language), languages, least=least)
    return compute_and_keep(chosen, text, cleaned, lambda t: t.isNotNull())


def html_to_text(
    df: DataFrame,
    row_id: str,
    html: str,
    language: str,
    languages: Languages,
    pages: DataFrame | None = None,
    min_words: int = 20,
) -> DataFrame:
    """Pages to clean text: popups out, visible text, frames, letters, stop words, length.

    Without a page table for frames the chain is row-local, one scan and no shuffle. The language
    filter comes first, since stop words are only known for the two languages.
    """
    chosen = df.filter(F.col(language).isin(*languages.both))
    if pages is None:
        seen, text = chosen, page_text(remove_popups(F.col(html)))
    else:
        seen, text = text_with_frames(chosen, row_id, html, pages), F.col("text")
    cleaned = clean_column(text, F.col(language), languages, least=min_words + 1)
    return compute_and_keep(seen, "text", cleaned, lambda t: t.isNotNull())


@dataclass(frozen=True)
class Revision:
    name: str
    stem: bool = False
    stop: bool = True
    min_length: int = 3
    min_words: int = 20


def _recipe(config: Revision, languages: Languages) -> Recipe:
    """Null if the text is too short or the language has no lists."""
    stop = _stop_words(languages) if config.stop else None
    rules = {code: {a.encode(): b.encode() for a, b in SUFFIX_RULES[code]} for code in languages.both} if config.stem else None
    return Recipe(config.min_length, config.min_words, stop, rules, MIN_STEM)


def build_revisions(
    df: DataFrame, key: str, text: str, language: str, languages: Languages, configs: Sequence[Revision]
) -> DataFrame:
    """``key, language, revision, text`` for all configurations in one pass over the text, cut into words once."""
    made = versions(F.col(text), F.col(language), [_recipe(config, languages) for config in configs])
    names = F.array(*[F.lit(config.name) for config in configs])
    named = F.zip_with(names, made, lambda name, t: F.struct(name.alias("revision"), t.alias("text")))
    present = F.filter(named, lambda r: r["text"].isNotNull())
    listed = df.select(key, F.col(language).alias("language"), F.explode(present).alias("r"))
    return listed.select(key, "language", "r.revision", "r.text")
