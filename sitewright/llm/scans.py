"""Running values over rows in order, inside groups of any size."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from sitewright.sources.tables import save_stage

Fold = Callable[[tuple | None, dict], tuple]
Combine = Callable[[tuple, tuple], tuple]


def running(
    df: DataFrame, group: Sequence[str], order: Sequence[str | Column], state: str, fold: Fold, combine: Combine, name: str
) -> DataFrame:
    """Add the columns of ``state``: what ``fold`` makes of a row's group up to and with the row, in ``order``.

    ``fold(None, row)`` begins a group and ``fold(state, row)`` goes on; ``combine(a, b)`` joins the state of the rows
    before with the state of the rows after, begun anew. Rows are dealt by ranges of (group, order), so a group of any
    size is spread over tasks. Each task folds its own rows; the last states of all partitions (one row each, so their number is
    that of partitions, not of rows or groups) give what every partition carries over from those before it.
    """
    spark = df.sparkSession
    added = StructType.fromDDL(state)
    names, inputs, keys = added.names, df.columns, list(group)
    local = StructType([*df.schema.fields, *added.fields, *StructType.fromDDL("_part int, _open boolean, _last boolean").fields])
    # schema of results
    final = StructType([*df.schema.fields, *added.fields])
    local_arrow, final_arrow = (to_arrow_schema(x) for x in (local, final))

    def fold_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: list[dict] = []
        own, value, open_run = None, None, True
        for batch in batches:
            if held:
                yield pa.RecordBatch.from_pylist(held, local_arrow)
            held = batch.to_pylist()
            for row in held:
                key = tuple(row[k] for k in keys)
                if value is None or key != own:
                    open_run = value is None
                    own, value = key, fold(None, row)
                else:
                    value = fold(value, row)
                row.update(zip(names, value, strict=True), _part=part, _open=open_run, _last=False)
        if held:
            held[-1]["_last"] = True
            yield pa.RecordBatch.from_pylist(held, local_arrow)

    ranged = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    staged = save_stage(ranged.mapInArrow(fold_partitions, local), name)
    ends = staged.filter("_last").select("_part", "_open", *keys, *names).collect()  # one row per partition
    carried: dict[int, tuple[tuple, tuple]] = {}
    before: tuple[tuple, tuple] | None = None
    for end in sorted(ends, key=lambda r: r["_part"]):
        if before:
            carried[end["_part"]] = before
        key, value = tuple(end[k] for k in keys), tuple(end[n] for n in names)
        value = tuple(bytes(v) if isinstance(v, bytearray) else v for v in value)
        key = tuple(bytes(v) if isinstance(v, bytearray) else v for v in key)
        before = (key, combine(before[1], value) if before and end["_open"] and before[0] == key else value)

    def carry_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            for row in rows:
                carry = carried.get(row["_part"]) if row["_open"] else None
                if carry and carry[0] == tuple(row[k] for k in keys):
                    row.update(zip(names, combine(carry[1], tuple(row[n] for n in names)), strict=True))
            yield pa.RecordBatch.from_pylist([{k: row[k] for k in final_arrow.names} for row in rows], final_arrow)

    spans = {part for part, (key, _) in carried.items()}
    kept = F.col("_open") & F.col("_part").isin(*spans) if spans else F.lit(False)
    if len(spans) > 1000:  # a long list of partitions is no better than none
        kept = F.col("_open")
    settled = staged.filter(~kept).select(*inputs, *names)
    return settled.unionByName(staged.filter(kept).mapInArrow(carry_partitions, final))
