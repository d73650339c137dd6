"""Queries of this subpackage; SQL is added where it can express the operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Job = Callable[[SparkSession, str], DataFrame]

JOBS: dict[str, Job] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        JOBS[name] = job
        if sql:
            SQL[name] = sql
        return job

    return register


def tokenizer_file(name: str = "piece_bpe_32k.model") -> bytes:
    """Content of a public tokenizer file, read on the driver and sent with the job."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()
