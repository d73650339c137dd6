"""From raw documents to encoded training texts: five stages, each on all rows the one before has kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import decontaminate, language, line_dedup, pieces, simhash
from sitewright.llm.registry import tokenizer_file
from sitewright.llm.texts import sha256_hex
from sitewright.session import new_table_path
from sitewright.sources.tables import read_parquet

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without any recognizable language go; mixed ones stay."""
    return language.known_language(docs, language.fit_on_documents(docs)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go from all texts; n_chars is that of what is left."""
    kept = line_dedup.drop_repeated_lines(docs, keep=["lang", "source"], by_id=True)
    n_chars = F.length("kept_text").cast("long").alias("n_chars")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "kept.lang", "kept.source", n_chars)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates the document with the smallest id stays."""
    return simhash.keep_one_per_class(docs).select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_leaks(docs, read_parquet(spark, sf_dir, "benchmark")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and what they decode to."""
    encoded = pieces.encode_documents(docs, tokenizer_file())
    return encoded.select(
        "doc_id", "n_tokens", sha256_hex("ids_text").alias("ids_sha256"), sha256_hex("decoded").alias("decoded_sha256")
    )


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("encoding", encode),
]

# Language proportions and subword merging cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written as Parquet and read again by the next."""
    docs = read_parquet(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = new_table_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
