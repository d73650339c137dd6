"""Delimited files whose quoted fields hold line breaks, read range by range.

A line break ends a record if an even number of quotes comes before it. Spark's text source already cuts a file into byte ranges that own
whole lines; so every range counts its quotes, a running parity over the ranges of a file tells whether a range begins inside a
quoted field, and each range then finds its records alone. Only what crosses a border is put together by a shuffle.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sitewright.session import new_table_path

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

WHOLE, HEAD, INNER, TAIL = range(4)  # a record; the end of one, a part of one, the begin of one that crosses borders
PIECES = "file long, block long, kind int, first boolean, record string"
PART_BYTES = 2_000_000  # lines held as Python texts at once, about; a batch may have 64 MB


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about ``PART_BYTES``."""
    for batch in batches:
        rows = max(1, batch.num_rows * PART_BYTES // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def piece_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: lines (file, block, odd, value) in order -> pieces (file, block, kind, first, record).

    ``odd`` says that the range begins inside a quoted field; ``first`` marks the first record of a file. Memory holds
    one batch, a part of it as texts, and the record that is open.
    """
    import pyarrow.compute as pc

    names = ["file", "block", "kind", "first", "record"]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    place, inside, open_lines, from_border, first = None, False, [], False, False

    def piece(kind):
        return (*place, kind, first, "\n".join(open_lines))

    for batch in _parts(batches):
        made = []
        quotes = pc.count_substring(batch.column(3), '"').to_pylist()
        columns = [batch.column(i).to_pylist() for i in range(4)]
        for file, block, odd, value, n in zip(*columns, quotes, strict=True):
            if (file, block) != place:
                if open_lines:
                    made.append(piece(INNER if from_border else TAIL))
                place, inside, open_lines, from_border, first = (file, block), odd, [], odd, block == 0
            open_lines.append(value)
            inside ^= n % 2 == 1
            if not inside:
                made.append(piece(HEAD if from_border else WHOLE))
                open_lines, from_border, first = [], False, False
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)
    if open_lines:
        last = piece(INNER if from_border else TAIL)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, types, strict=True)], names=names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    read = spark.read.option("lineSep", "\n").text(path)
    return read.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value"
    )


def records(spark: SparkSession, path: str) -> DataFrame:
    """(record, first) of every record of the files, in no order; ``first`` marks the first record of a file.

    The list of ranges that begin inside a quoted field is broadcast: two numbers for each, and only ranges that do not begin
    a file can be among them, so it has fewer rows than the bytes read divided by ``spark.sql.files.maxPartitionBytes`` (some
    13 MB for 100 TB). Pieces are written once, as they are read twice.
    """
    lines = _lines(spark, path)
    counted = lines.groupBy("file", "block").agg(F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))).alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = counted.withColumn("before", F.sum("n").over(before)).filter("before % 2 = 1").select("file", "block", F.lit(True).alias("odd"))
    marked = lines.join(F.broadcast(odd), ["file", "block"], "left")  # streams the lines, so their order stays
    marked = marked.select("file", "block", F.coalesce("odd", F.lit(False)).alias("odd"), "value")
    stage = new_table_path(spark, "pieces")
    marked.mapInArrow(piece_partitions, PIECES).write.parquet(stage)
    pieces = spark.read.schema(PIECES).parquet(stage)
    cut = pieces.filter(F.col("kind") != WHOLE)
    so_far = Window.partitionBy("file").orderBy("block", "kind")
    begins = F.last(F.when(F.col("kind") == TAIL, F.col("block")), ignorenulls=True).over(so_far)
    chains = cut.select("file", "block", "kind").withColumn("begin", begins)
    parts = F.sort_array(F.collect_list(F.struct("block", "kind", "record")))
    joined = cut.join(chains, ["file", "block", "kind"]).groupBy("file", "begin").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), "\n").alias("record"), F.bool_or("first").alias("first")
    )
    found = pieces.filter(F.col("kind") == WHOLE).select("record", "first").unionByName(joined.select("record", "first"))
    return found.withColumn("record", F.regexp_replace("record", "\r$", ""))


def _ddl(schema: StructType) -> str:
    return ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in schema)


def read_delimited(spark: SparkSession, path: str, schema: StructType, sep: str = ",") -> DataFrame:
    """Rows of delimited files with a header, whose quoted fields may hold quotes (doubled), separators and line breaks.

    A large file is read by as many tasks as it has ranges. A quote inside a field without quotes around it is not allowed (it would shift the
    parity). Empty lines between records are left out; fields that do not fit the schema are null; an empty folder gives no rows.
    """
    rows = records(spark, path).filter(~F.col("first") & (F.col("record") != ""))
    options = {"sep": sep, "quote": '"', "escape": '"', "mode": "PERMISSIVE"}
    parsed = rows.select(F.from_csv("record", _ddl(schema), options).alias("row"))
    return parsed.select("row.*")
