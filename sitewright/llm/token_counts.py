"""Token counts with a cache of digests."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm.pieces import CACHE_ENTRIES, SPACE, Remembered
from sitewright.llm.texts import narrow, whole
from sitewright.operators.joins import SALTS, lookup
from sitewright.sources.tables import save_stage

LIMIT = 4096


def tokenizer_version(proto: bytes) -> str:
    """Digest of the model and of how it is called; counts of another version are never used."""
    return hashlib.sha256(b"sentencepiece ids without begin and end\0" + proto).hexdigest()


def normalized(text: Column) -> Column:
    """What the model reads alike: null and empty, a space and its mark."""
    return F.translate(whole(text), SPACE, " ")


def empty_cache(spark: SparkSession, path: str) -> str:
    """Create a cache without counts."""
    spark.createDataFrame([], "digest binary, tokenizer string, n_tokens long").write.parquet(path)
    return path


def stored_counts(spark: SparkSession, path: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version, one row each even if two jobs added the same text."""
    stored = spark.read.schema("digest binary, tokenizer string, n_tokens long").parquet(path)
    return stored.filter(F.col("tokenizer") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_partitions(proto: bytes):
    """Worker function: (digest, text) -> digest, n_tokens, counted by the library.

    If no piece holds a space mark behind another character and line feeds are in no piece, the ids of a text are those
    of its parts, so parts seen before need no second call.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        whole_only = any("\n" in p or any(a != SPACE and b == SPACE for a, b in zip(p, p[1:], strict=False)) for p in pieces)
        front = len(model.encode("\n"))  # a line feed in front keeps the part from getting another space
        known = Remembered(lambda part: len(model.encode("\n" + part)) - front, CACHE_ENTRIES)
        cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")

        def count(text: str) -> int:
            if whole_only or not text:
                return len(model.encode(text))
            return sum(map(known.__getitem__, cut.findall(SPACE + text.replace(" ", SPACE))))

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                piece = batch.slice(start, 256)
                counts = [count(text) for text in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = narrow(docs, doc_id=doc_id, text=text)
    content = rows.select("doc_id", F.octet_length(whole("text")).cast("long").alias("n_bytes"), normalized("text").alias("content"))
    holder = F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("holder")
    return content.select("doc_id", "n_bytes", holder, F.unhex(F.sha2("content", 256)).alias("digest"), "content")


def fill_cache(docs: DataFrame, proto: bytes, cache: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode each distinct text that has no stored count and append its count; returns doc_id, n_bytes, holder, digest per row."""
    spark = docs.sparkSession
    version = tokenizer_version(proto)
    keyed = _keyed(docs, doc_id, text)
    keys = save_stage(keyed.drop("content"), "token-keys")
    known = stored_counts(spark, cache, version)
    misses = keys.groupBy("digest").agg(F.min("holder").alias("holder")).join(known, "digest", "left_anti")
    place = ["digest", "holder"]  # a sorted join, so that the join's shuffle serves the duplicates too
    texts = keyed.select(*place, "content").join(misses.hint("merge"), place, "left_semi").dropDuplicates(place).drop("holder")
    counted = texts.mapInArrow(count_partitions(proto), "digest binary, n_tokens long")
    counted.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    return keys


def count_tokens(
    docs: DataFrame, proto: bytes, cache: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit.

    ``cache`` is a folder of Parquet files (see ``empty_cache``). Digests of the normalized content are joined to the counts
    stored for this tokenizer version; each distinct text without a count is encoded once and its count
    appended. The append is one atomic Spark job, so a lost executor or a failed job leaves no partial counts.

    Null counts as empty (0 bytes, 0 tokens). Repeated rows come out each, null doc_ids stay null, an empty table gives no
    rows, further columns are ignored. Of equal texts the smallest doc_id is chosen on digests alone, combined before the shuffle;
    texts are then dealt by digest and doc_id, so copies of one text under different ids meet in no task (repeated rows of
    one id do). Counts go back to the rows by a join that spreads frequent digests.
    """
    keys = fill_cache(docs, proto, cache, doc_id, text)
    counts = stored_counts(docs.sparkSession, cache, tokenizer_version(proto))
    asked, counts = (x.withColumn("digest", F.hex("digest")) for x in (keys, counts))  # frequent items need strings
    return lookup(asked, counts, "digest", ["doc_id"], how="inner", salts=SALTS).select(
        "doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit")
    )
