"""Near duplicates by SimHash fingerprints and pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.components import connected_components
from sitewright.llm.texts import narrow, whole, with_row_number
from sitewright.operators.joins import lookup
from sitewright.sources.tables import save_stage

BITS = 64
SHINGLE = 3
DISTANCE = 3
BLOCKS = 5  # pairs at distance d share BLOCKS - d blocks; more blocks make smaller buckets and more keys
CELL = 4096  # fingerprints of one bucket that are compared at a time
SALTS = 64  # tasks that share a fingerprint or class with very many rows
SEED = 42


def fingerprint(text: bytes, shingle: int) -> int:
    """Signed 64-bit SimHash; a bit is set if more than half of the shingle hashes, repeats included, have it."""
    import numpy as np
    import xxhash

    words = text.lower().split()  # for bytes: A-Z only, and space and \t to \r only
    if not words:
        return 0
    k = min(shingle, len(words))
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_digest
    parts = [joined[s:e] for s, e in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    hashes = [digest(part, SEED) for part in parts]
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 15):  # a long text is unpacked in parts
        part = hashes[i : i + (1 << 15)]
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_partitions(shingle: int):
    """Worker function: (key, text as bytes) -> key, fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [fingerprint(text.as_py() or b"", shingle) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks, pa.int64())], names=["key", "fp"])

    return run


def block_masks(distance: int, blocks: int) -> list[int]:
    """Bit masks of every choice of ``blocks - distance`` blocks.

    Two fingerprints with ``distance`` different bits or fewer differ in that many blocks at most, so they agree in
    at least one choice.
    """
    if blocks <= distance:
        raise ValueError("more blocks than differing bits are needed")
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:], strict=False)]
    masks = [sum(chosen) for chosen in combinations(each, blocks - distance)]
    return [m - (1 << BITS) if m >> (BITS - 1) else m for m in masks]


def link_partitions(distance: int):
    """Worker function: (cell, fp) sorted by cell -> links (a, b) that connect what is linked inside each cell.

    A cell's fingerprints are searched breadth first, each reached one is compared with those not yet reached in
    one vector operation. So a cell of n fingerprints yields at most n - 1 links, and one full of near copies costs
    little more than n comparisons.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def links(cells, marks):
            first: list = []
            second: list = []
            borders = np.flatnonzero(np.diff(cells)) + 1
            starts = np.concatenate([[0], borders])
            ends = np.concatenate([borders, [len(cells)]])
            for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
                rest = marks[s:e]
                while len(rest) > 1:
                    reached, rest = [rest[0]], rest[1:]
                    while reached and len(rest):
                        x = reached.pop()
                        near = np.bitwise_count(rest ^ x) <= distance
                        if near.any():
                            found = rest[near]
                            first.append(np.full(len(found), x))
                            second.append(found)
                            reached.extend(found)
                            rest = rest[~near]
            if first:
                a, b = (np.concatenate(x).view(np.int64) for x in (first, second))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        cells, marks = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            marks = np.concatenate([marks, batch.column(1).to_numpy().view(np.uint64)])
            if len(cells):
                cut = np.searchsorted(cells, cells[-1])  # the last cell may go on in the next batch
                if cut:
                    yield from links(cells[:cut], marks[:cut])
                cells, marks = cells[cut:], marks[cut:]
        if len(cells):
            yield from links(cells, marks)

    return run


def fingerprint_links(marks: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, cell: int = CELL) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` whose components are those of all pairs within ``distance``.

    Fingerprints are bucketed by every choice of blocks. A bucket with more than ``cell`` fingerprints is cut into
    chunks by hash and every pair of chunks becomes a cell of its own, so no task holds more than two chunks of a
    bucket and no pair is lost.
    """
    buckets = [
        F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(mask))) for i, mask in enumerate(block_masks(distance, blocks))
    ]  # buckets that meet by their hash only cost comparisons: links are verified
    keyed = marks.select("fp", F.explode(F.array(*buckets)).alias("bucket"))
    sizes = keyed.groupBy("bucket").count()
    own = F.pmod(F.xxhash64("fp"), F.col("chunks"))
    cells = (
        keyed.join(sizes, "bucket")
        .withColumn("chunks", F.ceil(F.col("count") / F.lit(cell)))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
        .select(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), "fp")
    )
    dealt = cells.repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(link_partitions(distance), "a long, b long")


def _marked(docs: DataFrame, shingle: int) -> DataFrame:
    """(row, doc_id, text_hash, fp): the fingerprint of each row's text; ``docs`` has doc_id and text."""
    key = F.struct("row", "doc_id", F.xxhash64(whole("text")).alias("text_hash")).alias("key")
    rows = with_row_number(docs, "row").select(key, F.col("text").cast("binary").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()
    marks = rows.mapInArrow(fingerprint_partitions(shingle), f"key {kind}, fp long")
    return save_stage(marks.select("key.*", "fp"), "marks")


def _rooted(marked: DataFrame, first: Column, distance: int, blocks: int) -> DataFrame:
    """(fp, first, root) of every fingerprint, ``first`` being the smallest value among its rows."""
    distinct = save_stage(marked.groupBy("fp").agg(F.min(first).alias("first")), "fingerprints")
    roots = connected_components(fingerprint_links(distinct.select("fp"), distance, blocks), "a", "b")
    joined = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return save_stage(joined.withColumn("root", F.coalesce("root", "fp")), "rooted")


def near_duplicate_classes(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Words are runs without blanks, A-Z lower-cased; shingles count as often as they occur. Texts with fewer words have
    one shingle; null and empty texts have fingerprint zero and are linked like any other. Equal fingerprints
    meet before they are compared, so a group of copies of any size is one node. Repeated rows come out each; a row
    without doc_id belongs to its class (component_id is null only if no row of the class has an id). An empty
    table gives no rows; further columns are ignored.
    """
    marked = _marked(narrow(docs, doc_id=doc_id, text=text), shingle)
    rooted = _rooted(marked, F.col("doc_id"), distance, blocks)
    classes = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = lookup(rooted.select("fp", "root"), classes, "root", ["fp"], how="inner", salts=SALTS)
    found = lookup(marked, named.select("fp", "component_id"), "fp", ["row"], how="inner", salts=SALTS)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one_per_class(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    distance: int = DISTANCE,
    blocks: int = BLOCKS,
) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each class of linked fingerprints the row with the smallest doc_id stays.

    Classes are those of ``near_duplicate_classes``, so all empty and null texts are one class. Rows without doc_id stay
    only if no row of the class has one (then the one with the smallest text hash); of identical rows one stays. All
    columns are kept. An empty table gives no rows.
    """
    marked = _marked(narrow(docs, doc_id=doc_id, text=text), shingle)
    rank = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "text_hash")
    first = _rooted(marked, rank, distance, blocks).groupBy("root").agg(F.min("first").alias("first"))
    winners = first.select(F.col("first.doc_id").alias("v_id"), F.col("first.text_hash").alias("v_hash"))
    winners = save_stage(winners, "winners")
    row = docs.select(F.struct(*docs.columns).alias("row"))
    own_id, own_hash = F.col(f"row.{doc_id}"), F.xxhash64(whole(F.col(f"row.{text}")))
    same = own_id.eqNullSafe(F.col("v_id")) & (own_hash == F.col("v_hash"))
    repeated = marked.groupBy(F.col("doc_id").alias("v_id"), F.col("text_hash").alias("v_hash")).count().filter("count > 1")
    repeated = save_stage(repeated.drop("count"), "repeated")
    if repeated.isEmpty():
        return row.join(winners, same, "left_semi").select("row.*")
    again = F.col("v_id").eqNullSafe(F.col("r_id")) & (F.col("v_hash") == F.col("r_hash"))
    repeated = repeated.toDF("r_id", "r_hash")
    alone = row.join(winners.join(repeated, again, "left_anti"), same, "left_semi")
    number = F.row_number().over(Window.partitionBy("v_id", "v_hash").orderBy(F.xxhash64("row")))
    several = row.join(winners.join(repeated, again, "left_semi"), same).withColumn("number", number).filter("number = 1")
    return alone.unionByName(several.select("row")).select("row.*")
