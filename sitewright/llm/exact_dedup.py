"""Exact duplicates with a heavy-hitter split; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.llm.texts import ascii_lower, narrow, whole, with_row_number
from sitewright.sources.tables import save_stage

SUPPORT = 0.001  # a digest that may hold more than this share of the rows is treated as heavy


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, digest, row) of every row, stored once so that texts are read and hashed a single time."""
    rows = narrow(docs, doc_id=doc_id, text=text)
    digest = F.unhex(F.sha2(ascii_lower(whole("text")), 256))
    return save_stage(with_row_number(rows.select("doc_id", digest.alias("digest")), "row"), "digests")


def heavy_winners(hashed: DataFrame, support: float = SUPPORT) -> DataFrame:
    """Winner and size of each digest that holds at least ``support`` of the rows.

    ``freqItems`` is a Misra-Gries summary: it keeps at most ``1 / support`` counters per partition and in all and
    misses no digest above that share. The candidates are then counted exactly, so at most ``1 / support``
    rows come out, whatever the data. It is given strings: it compares byte arrays by identity and would never count.
    """
    named = hashed.select(F.hex("digest").alias("digest"))
    found = named.stat.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("name"))
    found = found.select(F.unhex("name").alias("digest"))
    total = hashed.agg(F.count("*").alias("total"))
    counted = hashed.join(F.broadcast(found.distinct()), "digest").groupBy("digest").agg(*_group())
    verified = counted.join(F.broadcast(total), F.col("group_size") >= F.col("total") * support)
    return verified.drop("total")


def _group() -> list:
    # nulls are smallest in a struct, so a row without id stays only where no row has one
    return [F.max(F.struct("doc_id", "row")).alias("winner"), F.count("*").alias("group_size")]


def exact_groups(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", support: float = SUPPORT
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal if they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with the
    largest doc_id stays; of identical rows one; a row without doc_id only if none of its group has one (keep_id is
    null then). An empty table gives no rows. Further columns are ignored.

    Digests that hold a large share of the rows are found first. Their winners, a table of bounded size, are
    broadcast and settle those rows where they are; only the others are shuffled.
    """
    hashed = digests(docs, doc_id, text)
    heavy = heavy_winners(hashed, support)
    marked = hashed.join(F.broadcast(heavy), "digest", "left")
    settled = marked.filter(F.col("group_size").isNotNull())
    others = marked.filter(F.col("group_size").isNull()).drop("winner", "group_size")
    grouped = others.groupBy("digest").agg(*_group())
    rest = others.join(grouped, "digest")
    return settled.unionByName(rest).select(
        "doc_id",
        F.col("winner.doc_id").alias("keep_id"),
        "group_size",
        (F.col("winner.row") == F.col("row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
