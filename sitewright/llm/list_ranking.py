"""Prefix sums along a linked list whose entries lie anywhere, by repeated contraction."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitewright.sources.tables import save_stage

CELL = 1 << 16  # entries a task contracts at a time
LEAST_SHRINKAGE = 0.75  # if a round by ranges leaves more than this share, the next one pairs neighbors
CONTRACTED = "a long, b long, head_a long, head_b long, off_x long, off_y long, next_a long, next_b long, x long, y long"


def contract_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (a, b, next_a, next_b, x, y) -> every entry with the head of its run and the sums before it there.

    A run is what the partition's own links connect. The head's row also holds the run's successor and sums.
    """
    entries: dict[tuple, tuple] = {}
    for batch in batches:
        a, b, next_a, next_b, x, y = (column.to_pylist() for column in batch.columns)
        entries.update(zip(zip(a, b, strict=True), zip(zip(next_a, next_b, strict=True), x, y, strict=True), strict=True))
    reached = {successor for successor, _, _ in entries.values()}
    out: list[tuple] = []
    for head in entries:
        if head in reached:
            continue
        begin, at, x, y = len(out), head, 0, 0
        while at in entries:
            successor, own_x, own_y = entries[at]
            out.append((*at, *head, x, y, None, None, None, None))
            at, x, y = successor, x + own_x, y + own_y
        out[begin] = (*out[begin][:6], *at, x, y)
    names = [field.split()[0] for field in CONTRACTED.split(", ")]
    for i in range(0, len(out), 10_000):
        columns = [pa.array(column, pa.int64()) for column in zip(*out[i : i + 10_000], strict=True)]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def prefix_sums(links: DataFrame, cell: int = CELL) -> DataFrame:
    """(a, b, before_x, before_y): for each entry (a, b), the sums of x and y over all entries before it.

    ``links`` has a, b (the entry), next_a, next_b (its successor; null at the end), x and y, all bigint, and is one list without
    cycles. In each round entries are dealt by ranges of (a, b), every partition contracts its own runs to their
    heads, and the heads, linked by what follows their runs, are the next round's list. Lists whose neighbors have near
    ids shrink to a few entries per partition. If a round leaves more than three quarters, the next deals entries so that a
    random quarter meets its predecessor, whatever the order of ids is. A list of one entry ends the rounds; positions
    then go back down. No task holds more than about ``cell`` entries. An empty list gives no rows.
    """
    level, size, paired = save_stage(links.select("a", "b", "next_a", "next_b", "x", "y"), "list"), None, False
    size = level.count()
    rounds: list[DataFrame] = []
    while size > 1:
        parts = math.ceil(size / cell)
        if parts == 1:
            dealt = level.coalesce(1)
        elif paired:
            def coin(a: str, b: str, k: int = len(rounds)):
                return F.pmod(F.xxhash64(F.lit(k), a, b), F.lit(2)) == 1

            joins_next = ~coin("a", "b") & F.col("next_a").isNotNull() & coin("next_a", "next_b")
            meets = F.when(joins_next, F.xxhash64("next_a", "next_b")).otherwise(F.xxhash64("a", "b"))
            dealt = level.repartition(parts, meets)
        else:
            dealt = level.repartitionByRange(parts, "a", "b")
        rounds.append(save_stage(dealt.mapInArrow(contract_partitions, CONTRACTED), "contracted"))
        level = rounds[-1].filter("x is not null").select("a", "b", "next_a", "next_b", "x", "y")
        left = level.count()
        paired, size = left > LEAST_SHRINKAGE * size, left
    if not rounds:
        return level.select("a", "b", F.lit(0).cast("long").alias("before_x"), F.lit(0).cast("long").alias("before_y"))
    known = rounds[-1].select("a", "b", F.col("off_x").alias("before_x"), F.col("off_y").alias("before_y"))
    for k, members in enumerate(reversed(rounds[:-1])):
        above = known.select(F.col("a").alias("head_a"), F.col("b").alias("head_b"), "before_x", "before_y")
        joined = members.select("a", "b", "head_a", "head_b", "off_x", "off_y").join(above, ["head_a", "head_b"])
        known = joined.select(
            "a", "b", (F.col("before_x") + F.col("off_x")).alias("before_x"), (F.col("before_y") + F.col("off_y")).alias("before_y")
        )
        if k % 2:
            known = save_stage(known, "ranked")  # keeps plans short if there are many rounds
    return known
