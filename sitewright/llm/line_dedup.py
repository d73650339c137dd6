"""Lines found in many documents are dropped everywhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.texts import BLANKS, ascii_lower, whole
from sitewright.sources.tables import save_stage

MIN_DOCS = 10
MIN_CHARS = 1


def lines_of(text: Column) -> Column:
    return F.split(whole(text), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def line_digest(line: Column, min_chars: int) -> Column:
    """128 bits of the key; null for keys that are never dropped."""
    return F.transform(F.array(line_key(line)), lambda k: F.when(F.length(k) >= min_chars, F.unhex(F.md5(k))))[0]


def repeated_lines(lines: DataFrame, min_docs: int) -> DataFrame:
    """Digests found in at least ``min_docs`` documents, each document counted once."""
    each = lines.select(F.explode(F.array_distinct("digests")).alias("digest")).filter(F.col("digest").isNotNull())
    return each.groupBy("digest").count().filter(F.col("count") >= min_docs).select("digest")


def in_distinct_documents(lines: DataFrame, often: DataFrame, min_docs: int) -> DataFrame:
    """Those of the digests ``often`` that are found under at least ``min_docs`` different doc_id.

    Rows without doc_id are a document each. First distinct pairs of digest and document, then their number, so a digest of
    many documents is spread.
    """
    own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()).alias("own")
    each = lines.select("doc_id", own, F.array_distinct("digests").alias("digests"))
    pairs = each.select("doc_id", "own", F.explode("digests").alias("digest")).join(often, "digest", "left_semi").distinct()
    return pairs.groupBy("digest").count().filter(F.col("count") >= min_docs).select("digest")


def drop_repeated_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    keep: Sequence[str] = (),
    by_id: bool = False,
) -> DataFrame:
    """One row per document: doc_id, kept_text, n_lines, n_dropped, and the columns in ``keep`` as a struct ``kept``.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least ``min_chars`` code
    points in at least ``min_docs`` documents lose all their lines; the others are joined again in their order.
    A null or empty text is one empty line and gives ''; a text that loses all lines gives '' as well. Every row is a
    document: repeated rows count and come out each, rows without doc_id too. With ``by_id`` rows of one doc_id are one
    document in the count and still come out each. An empty table gives no rows.
    Further columns are ignored.

    Only digests are exploded and shuffled. A document's digests are stored once as an array; the
    positions to drop go back to the text by doc_id and text digest, a key that no large group shares.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.struct(*keep).alias("kept")] if keep else []))
    keyed = rows.withColumn("text_hash", F.xxhash64(whole("text")))
    per_line = F.transform(lines_of("text"), lambda line: line_digest(line, min_chars))
    lines = save_stage(keyed.select("doc_id", "text_hash", per_line.alias("digests")), "line-digests")
    repeated = save_stage(repeated_lines(lines, min_docs), "repeated-lines")
    if by_id:  # no digest has more documents than rows, so only those found often need the exact count
        repeated = save_stage(in_distinct_documents(lines, repeated, min_docs), "repeated-lines")
    placed = lines.select("doc_id", "text_hash", F.posexplode("digests").alias("place", "digest"))
    gone = (
        placed.join(repeated, "digest", "left_semi")
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set("place").alias("gone"))
        .select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash"), "gone")
    )
    same = F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("text_hash") == F.col("gone_hash"))
    joined = keyed.join(gone, same, "left").withColumn("lines", lines_of("text"))
    n_lines = F.size("lines")
    left = F.array_except(F.sequence(F.lit(0), n_lines - 1), F.col("gone"))
    kept = F.array_join(F.transform(left, lambda i: F.get(F.col("lines"), i)), "\n")
    return joined.select(
        "doc_id",
        F.when(F.col("gone").isNull(), whole("text")).otherwise(kept).alias("kept_text"),
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        *(["kept"] if keep else []),
    )
