"""Column expressions and worker helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Space, tab, line feed, vertical tab, form feed, carriage return
BLANKS = " \t\n\x0b\x0c\r"


def whole(text: str | Column) -> Column:
    """The text, with null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, nothing else. ``lower`` does that for pure ASCII and is several times faster."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def sha256_hex(text: Column) -> Column:
    return F.sha2(text, 256)


def narrow(docs: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under the operator's own names, so that further columns cannot clash."""
    return docs.select(*[F.col(source).alias(name) for name, source in columns.items()])


def with_row_number(df: DataFrame, name: str) -> DataFrame:
    """Tell identical rows apart; stable once the frame is written as a stage."""
    return df.withColumn(name, F.monotonically_increasing_id())


def slices(texts: list[str], limit: int, overlap: int) -> Iterator[list[tuple[int, str]]]:
    """Groups of (index, piece) with about ``limit`` characters each.

    A longer text is cut into pieces that share ``overlap`` characters, so every run of ``overlap + 1``
    characters lies in exactly one piece.
    """
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        start = 0
        while True:
            piece = text[start : start + limit + overlap]
            group.append((i, piece))
            size += len(piece)
            if size >= limit:
                yield group
                group, size = [], 0
            start += limit
            if start + overlap >= len(text):
                break
    if group:
        yield group
