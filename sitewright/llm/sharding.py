"""Resharding by minimum-cost flow: shards of near equal bytes, moving as few bytes as possible."""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitewright.llm.texts import whole
from sitewright.session import new_table_path
from sitewright.sources.tables import save_stage

ROW_BYTES = 16
OLD_SHARDS = 32
SHARDS = 40
BLOCKS = 64  # blocks of a shard at least; a block is the unit in which files are kept or rewritten
BLOCK_BYTES = 128 << 20  # text bytes of a block at most, as a task writes whole blocks
REFINEMENTS = 3


def moving_cost(old: int, new: int) -> int:
    """Staying is free, any other shard costs one per byte."""
    return int(old != new)


def transfers(
    sizes: Sequence[int], capacities: Sequence[int], cost: Callable[[int, int], int] = moving_cost
) -> dict[tuple[int, int], int]:
    """Bytes to send from each old to each new shard at minimum cost: successive shortest paths with potentials.

    The network has a node per shard, so it does not grow with the data. Capacities must hold all sizes.
    """
    if sum(capacities) < sum(sizes):
        raise ValueError("the capacities do not hold the data")
    n, m = len(sizes), len(capacities)
    source, sink = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, room, price = [], [], []

    def arc(a: int, b: int, c: int, p: int) -> None:
        for x, y, r, q in ((a, b, c, p), (b, a, 0, -p)):
            graph[x].append(len(to))
            to.append(y)
            room.append(r)
            price.append(q)

    for i, size in enumerate(sizes):
        arc(source, i, size, 0)
        for j in range(m):
            arc(i, n + j, size, cost(i, j))
    for j, capacity in enumerate(capacities):
        arc(n + j, sink, capacity, 0)
    potential = [0] * (n + m + 2)
    while True:
        distance, via = {source: 0}, {}
        heap, done = [(0, source)], set()
        while heap:
            d, x = heapq.heappop(heap)
            if x in done:
                continue
            done.add(x)
            for e in graph[x]:
                y, reach = to[e], d + price[e] + potential[x] - potential[to[e]]
                if room[e] and y not in done and reach < distance.get(y, math.inf):
                    distance[y], via[y] = reach, e
                    heapq.heappush(heap, (reach, y))
        if sink not in distance:
            break
        far = distance[sink]
        for x in range(len(potential)):
            potential[x] += min(distance.get(x, far), far)
        path, x = [], sink
        while x != source:
            path.append(via[x])
            x = to[via[x] ^ 1]
        amount = min(room[e] for e in path)
        for e in path:
            room[e] -= amount
            room[e ^ 1] += amount
    flow = {}
    for i in range(n):
        for e in graph[i]:
            if to[e] != source and e % 2 == 0 and room[e ^ 1]:
                flow[i, to[e] - n] = room[e ^ 1]
    return flow


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (i < total % shards) for i in range(shards)]


def size_of(text: Column) -> Column:
    return F.octet_length(whole(text)).cast("long") + ROW_BYTES


@dataclass(frozen=True)
class Layout:
    """A folder of Parquet files by shard and block."""

    path: str
    schema: T.StructType

    def read(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(self.schema).parquet(self.path)


def write_layout(
    docs: DataFrame,
    shards: int,
    blocks: int = BLOCKS,
    block_bytes: int = BLOCK_BYTES,
    key: str = "doc_id",
    text: str = "text",
) -> Layout:
    """Write ``docs`` as shard folders with block folders, by hash of the key.

    Rows are packed into ``row`` next to the operator's own columns, so no name clashes. ``place`` identifies the rows of
    a block for good; within a block places follow each other without gaps. Rows that share a key are spread over blocks by their
    text; copies of one row share a block.
    """
    spark = docs.sparkSession
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    own_key, own_text = F.col(f"row.{key}"), F.col(f"row.{text}")
    total = docs.agg(F.sum(size_of(F.col(text)))).first()[0] or 0
    blocks = max(1, blocks, math.ceil(total / shards / block_bytes))
    dealt = packed.select(
        "row",
        size_of(own_text).alias("size"),
        F.pmod(F.xxhash64(own_key), F.lit(shards)).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit(1), own_key, own_text), F.lit(blocks)).cast("int").alias("block"),
    )
    path = new_table_path(spark, "layout")
    sorted_blocks = dealt.repartition("shard", "block").sortWithinPartitions("shard", "block")
    together = sorted_blocks.withColumn("place", F.monotonically_increasing_id())
    together.write.partitionBy("shard", "block").parquet(path)
    return Layout(path, together.schema)


def _positions(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Add the bytes of its shard in front of the middle of each row (in half bytes).

    Running sums are formed within blocks, and over block totals; no task sees a whole shard's rows.
    """
    before = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy("shard", "block")
        .agg(F.sum("size").alias("bytes"))
        .select("shard", "block", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("offset"))
    )
    inside = Window.partitionBy("shard", "block").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("upto", F.sum("size").over(inside))
    middle = (F.col("offset") + F.col("upto")) * 2 - F.col("size")
    return summed.join(offsets, ["shard", "block"]).withColumn("middle", middle).drop("upto", "offset")


def _intervals(spark: SparkSession, flow: dict[tuple[int, int], int]) -> DataFrame:
    """(shard, cuts): for each old shard its targets with the bytes they get, staying first; one row per shard."""
    cuts: dict[int, list] = {}
    ends: dict[int, int] = {}
    for (i, j), amount in sorted(flow.items(), key=lambda x: (x[0][0], x[0][0] != x[0][1], x[0][1])):
        start = ends.get(i, 0)
        ends[i] = start + amount
        cuts.setdefault(i, []).append((j, 2 * start, 2 * ends[i]))
    return spark.createDataFrame(list(cuts.items()), "shard int, cuts array<struct<target:int,start:long,end:long>>")


def _cut(rows: DataFrame, flow: dict[tuple[int, int], int], order: list[Column]) -> DataFrame:
    """Add ``target``: the shard whose interval holds the row's middle; rows beyond all intervals stay."""
    intervals = F.broadcast(_intervals(rows.sparkSession, flow))  # one row per shard
    fits = F.filter("cuts", lambda c: (F.col("middle") >= c["start"]) & (F.col("middle") < c["end"]))
    placed = _positions(rows, order).join(intervals, "shard", "left")
    return placed.withColumn("target", F.coalesce(F.get(fits, F.lit(0))["target"], F.col("shard"))).drop("cuts", "middle")


def plan(rows: DataFrame, capacities: Sequence[int], refinements: int = REFINEMENTS) -> DataFrame:
    """(shard, block, place, size, target, refined) for every row of a layout.

    Shard sizes are the only numbers gathered. The flow says how many bytes go from where to where; each shard's rows,
    block after block, are cut at these amounts, so whole blocks stay or move and only blocks at a cut are divided. Cuts
    fall between rows; the bytes by which shards then differ are evened out in the same way with the smallest
    rows of one block per shard.
    """
    narrow_rows = save_stage(rows.select("shard", "block", "place", "size"), "layout-rows")
    count = 1 + (narrow_rows.agg(F.max("shard")).first()[0] or 0)
    sizes = _sizes(narrow_rows, "shard", max(count, 1))
    planned = save_stage(_cut(narrow_rows, transfers(sizes, capacities), [F.col("place")]).withColumn("refined", F.lit(False)), "plan")
    for _ in range(refinements):
        now = _sizes(planned, "target", len(capacities))
        flow = {k: v for k, v in transfers(now, capacities).items() if k[0] != k[1]}
        if not flow:
            break
        group = planned.groupBy("target", "shard", "block").agg(F.count("*").alias("n"))
        chosen = group.groupBy("target").agg(F.max(F.struct("n", "shard", "block")).alias("most"))
        chosen = chosen.select("target", F.struct("most.shard", "most.block").alias("at"))
        near = planned.join(F.broadcast(chosen), "target").filter(F.struct("shard", "block") == F.col("at"))
        as_rows = near.select(F.col("target").alias("shard"), F.lit(0).alias("block"), "size", F.struct("shard", "block", "place").alias("id"))
        moved = _cut(as_rows, flow, [F.col("size"), F.col("id")]).filter("target <> shard")
        moved = moved.select("id.*", F.col("target").alias("moved"))
        joined = planned.join(moved, ["shard", "block", "place"], "left")
        refined = F.col("refined") | F.col("moved").isNotNull()
        evened = joined.withColumn("refined", refined).withColumn("target", F.coalesce("moved", "target"))
        planned = save_stage(evened.drop("moved"), "plan")
    return planned


def _sizes(rows: DataFrame, shard: str, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in rows.groupBy(shard).agg(F.sum("size")).collect()}
    return [found.get(i, 0) for i in range(shards)]


def rewrite(spark: SparkSession, layout: Layout, planned: DataFrame) -> DataFrame:
    """Rewrite the blocks that lose rows; the others keep their files. Gives all rows with ``target`` and ``slot`` in it.

    A block all of whose rows get the same shard keeps its files; its rows find target and slot in a table with one row per block
    (a row's slot is that of its block plus its place inside). Slots run by (old shard, block, place) within a target. Only texts of
    divided blocks are shuffled: the flow has fewer arcs than old and new shards together, an arc ends in one block and a refinement
    touches one block per shard, so their number does not grow with the data.
    """
    old = layout.read(spark)
    parts = planned.groupBy("shard", "block", "target").agg(F.count("*").alias("n"), F.min("place").alias("first_place"))
    in_block = Window.partitionBy("shard", "block")
    before = Window.partitionBy("target").orderBy("shard", "block").rowsBetween(Window.unboundedPreceding, -1)
    parts = save_stage(  # one row per block, and some more for divided ones
        parts.withColumn("divided", F.count("*").over(in_block) > 1).withColumn(
            "first_slot", F.coalesce(F.sum("n").over(before), F.lit(0))
        ),
        "parts",
    )
    whole_blocks = parts.filter("not divided").select("shard", "block", "target", "first_place", "first_slot")
    unmoved = old.join(whole_blocks, ["shard", "block"])
    unmoved = unmoved.withColumn("slot", F.col("first_slot") + F.col("place") - F.col("first_place"))

    divided = parts.filter("divided").select("shard", "block", "target", "first_slot")
    inside = Window.partitionBy("target", "shard", "block").orderBy("place")
    targets = planned.join(divided, ["shard", "block", "target"]).select(
        "shard", "block", "place", "target", (F.col("first_slot") + F.row_number().over(inside) - 1).alias("slot")
    )
    cut = old.join(divided.select("shard", "block").distinct(), ["shard", "block"], "left_semi")
    moved = cut.join(targets, ["shard", "block", "place"])
    new_path = new_table_path(spark, "layout")
    moved.repartition("target", "shard", "block").write.partitionBy("target").parquet(new_path)
    columns = ["row", "size", "shard", "block", "place", "target", "slot"]
    return unmoved.select(*columns).unionByName(spark.read.schema(moved.schema).parquet(new_path).select(*columns))


def reshard(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    old_shards: int = OLD_SHARDS,
    shards: int = SHARDS,
    blocks: int = BLOCKS,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """All rows of ``docs`` in ``shards`` shards of near equal bytes: row (all columns as a struct), size, shard, slot.

    The starting point is a layout of ``old_shards`` shards by hash of doc_id, written as files. A row's size is its UTF-8
    bytes (null: none) plus 16. Equal sizes do not tie rows together; a text longer than a shard's share makes its shard
    larger. Repeated rows and rows without doc_id are placed one by one, an empty table gives no rows, and
    other columns keep their names inside ``row``.
    """
    spark = docs.sparkSession
    layout = write_layout(docs, old_shards, blocks, block_bytes, doc_id, text)
    rows = layout.read(spark)
    total = rows.agg(F.sum("size")).first()[0] or 0
    planned = plan(rows, equal_capacities(total, shards))
    return rewrite(spark, layout, planned).select("row", "size", F.col("target").alias("shard"), "slot")
