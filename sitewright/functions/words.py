"""Column expressions on plain text: cleaning, stop words, stems, counts, tokens, trigrams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.functions.expressions import bind
from sitewright.functions.stop_lists import STOP_LISTS

WORD_GAP = r"[^\p{L}\p{N}_]+"  # whatever is not a letter, digit or underscore of any script

# Fixed values: (suffix, replacement) per language; the longest suffix that leaves at least
# MIN_STEM letters is replaced, one rule per word.
MIN_STEM = 3
SUFFIX_RULES = {
    "en": [
        ("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"),
        ("tional", "tion"), ("ations", "ate"), ("ation", "ate"), ("ement", ""), ("ments", ""), ("ingly", ""),
        ("ment", ""), ("ness", ""), ("able", ""), ("ible", ""), ("ance", ""), ("ence", ""), ("edly", ""),
        ("ings", ""), ("ing", ""), ("ies", "i"), ("ied", "i"), ("ity", ""), ("ers", ""), ("ed", ""), ("er", ""),
        ("es", ""), ("ly", ""), ("ss", "ss"), ("s", ""), ("y", "i"), ("e", ""),
    ],
    "de": [
        ("heiten", "heit"), ("keiten", "keit"), ("ungen", ""), ("lichen", ""), ("ischen", ""), ("liche", ""), ("heit", ""),
        ("keit", ""), ("isch", ""), ("lich", ""), ("igen", ""), ("ung", ""), ("end", ""), ("ern", ""), ("em", ""),
        ("en", ""), ("er", ""), ("es", ""), ("ig", ""), ("ik", ""), ("e", ""), ("s", ""),
    ],
    "nl": [
        ("heden", "heid"), ("ingen", ""), ("lijke", ""), ("baar", ""), ("heid", ""), ("lijk", ""), ("end", ""),
        ("ene", ""), ("ing", ""), ("en", ""), ("ig", ""), ("je", ""), ("se", ""), ("e", ""), ("s", ""),
    ],
}


def clean_text(text: Column, min_length: int = 3, separator: str = "") -> Column:
    """Only A-Z, a-z and blanks stay; words shorter than ``min_length`` go; lower case.

    With the default separator other characters vanish, so words around a line break
    join up; pass ``separator=' '`` to keep them apart.
    """
    # the ASCII letters; this class runs several times faster than the same set as two ranges
    letters = F.regexp_replace(text, r"[^\p{Alpha} ]+", separator)
    kept = F.filter(F.split(letters, " +"), lambda word: F.length(word) >= min_length)
    return F.lower(F.array_join(kept, " "))


def stop_list(language: str) -> list[str]:
    return list(STOP_LISTS[language])


def _without(text: Column, stop: list[str]) -> Column:
    # a list of more than ten literals is looked up as a hash set
    return F.array_join(F.filter(F.split(text, " +"), lambda word: ~word.isin(stop)), " ")


def remove_stopwords(
    text: Column,
    language: Column,
    primary: str,
    secondary: str,
    stop: dict[str, list[str]] | None = None,
) -> Column:
    """The primary language loses both lists, the secondary its own; other languages give null."""
    lists = stop or {code: stop_list(code) for code in (primary, secondary)}
    both = sorted(set(lists[primary]) | set(lists[secondary]))
    return F.when(language == primary, _without(text, both)).when(
        language == secondary, _without(text, lists[secondary])
    )


def _stem_word(word: Column, rules: list[tuple[str, str]], min_stem: int) -> Column:
    ordered = sorted((suffix for suffix, _ in rules), key=len, reverse=True)
    pattern = rf"^.{{{min_stem},}}?({'|'.join(ordered)})$"
    swaps = F.create_map(*[F.lit(v) for pair in rules if pair[1] for v in pair])

    def cut(suffix: Column) -> Column:
        stem = F.substring(word, F.lit(1), F.length(word) - F.length(suffix))
        return F.concat(stem, F.coalesce(F.element_at(swaps, suffix), F.lit("")))

    return bind(F.regexp_extract(word, pattern, 1), cut)


def stem_text(
    text: Column,
    language: Column,
    codes: tuple[str, ...],
    rules: dict[str, list[tuple[str, str]]] = SUFFIX_RULES,
    min_stem: int = MIN_STEM,
) -> Column:
    """Each word cut by the longest suffix rule of its language; null for other languages.

    Row-local on purpose: a job over the distinct vocabulary would shuffle every token twice.
    """

    def stems(code: str) -> Column:
        words = F.transform(F.split(text, " +"), lambda word: _stem_word(word, rules[code], min_stem))
        return F.when(language == code, F.array_join(words, " "))

    return F.coalesce(*[stems(code) for code in codes])


def count_words(text: Column) -> Column:
    """Number of blank-separated words; 0 for '', null for null."""
    words = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    return F.when(text.isNotNull(), F.size(F.filter(words, lambda word: word != "")))


def tokens(text: Column, min_length: int = 2) -> Column:
    """Lower-case word tokens of at least ``min_length`` characters."""
    return F.filter(F.split(F.lower(text), WORD_GAP), lambda word: F.length(word) >= min_length)


def trigrams(text: Column) -> Column:
    """All overlapping three-character sequences of the letters-only lower-case text.

    Three passes at offsets 0, 1 and 2 take time linear in the text; a substring per position
    would be quadratic.
    """
    flat = F.regexp_replace(F.lower(text), r"[\s0-9!-/:-@\[-`{-~]+", " ")

    def slices(letters: Column) -> Column:
        starts = [F.substring(letters, i, 2147483647) for i in (1, 2, 3)]
        return F.concat(*[F.regexp_extract_all(start, F.lit("(?s)..."), F.lit(0)) for start in starts])

    return bind(flat, slices)


def language_flag(language: Column, code: str) -> Column:
    return F.coalesce((language == code).cast("int"), F.lit(0))


def sector_prefix(code: Column) -> Column:
    return F.substring(code.cast("string"), 1, 2)


def softmax(logits: Column) -> Column:
    """Class probabilities of an array of logits."""
    scores = logits.cast("array<double>")
    powers = bind(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))

    def shares(raised: Column) -> Column:
        total = F.aggregate(raised, F.lit(0.0), lambda acc, x: acc + x)
        return bind(total, lambda t: F.transform(raised, lambda x: x / t))

    return bind(powers, shares)
