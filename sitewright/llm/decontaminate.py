"""Benchmark items inside documents: size-partitioned MinHash containment search with exact verification."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sitewright.llm.pieces import CACHE_ENTRIES, Remembered
from sitewright.llm.texts import narrow
from sitewright.sources.tables import save_stage

SHINGLE = 5
CONTAINMENT = 0.8
BLOCK_SHINGLES = 500_000  # item shingles sent to the workers at a time; more items make more passes
WORD = re.compile(r"\w+")
FACTOR = 0x9E3779B97F4A7C15  # odd, so word hashes of a shingle are mixed without loss


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles_of(words: list[str], shingle: int) -> list[str]:
    """Distinct shingles in order; the whole sequence if there are fewer words, none without words."""
    n = min(shingle, len(words))
    return list(dict.fromkeys(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))) if n else []


def sketch_size(shingles: int, containment: float) -> int:
    """Number of minima kept for an item of its size class (powers of two).

    A document that holds the share ``containment`` of an item lacks fewer shingles than this, so it holds one of the
    minima for certain: the search loses nothing, for short items and for long documents alike.
    """
    largest = (1 << shingles.bit_length()) - 1
    return min(shingles, math.floor((1 - containment) * largest + 1e-9) + 1)


class ItemIndex:
    """MinHash sketches and shingles of one block of items."""

    def __init__(self, items: list[tuple[object, list[str]]], containment: float) -> None:
        import numpy as np
        import xxhash

        self.np, self.containment = np, containment
        self.hash_word = Remembered(lambda word: xxhash.xxh64_intdigest(word), CACHE_ENTRIES)
        self.ids = [i for i, _ in items]
        self.sizes = [len(s) for _, s in items]
        self.holders: dict[str, list[int]] = {}
        minima: dict[int, list] = {}
        every: dict[int, list] = {}
        for number, (_, shingles) in enumerate(items):
            words = shingles[0].split(" ")
            table = np.array([self._word_hashes(s.split(" ")) for s in shingles])
            hashes = np.sort(self._mix(table.T, len(words)))
            minima.setdefault(len(words), []).append(hashes[: sketch_size(len(shingles), containment)])
            every.setdefault(len(words), []).append(hashes)
            for s in shingles:
                self.holders.setdefault(s, []).append(number)
        self.minima = {n: self._table(x) for n, x in minima.items()}
        self.every = {n: self._table(x) for n, x in every.items()}

    def _word_hashes(self, words: list[str]):
        return self.np.fromiter(map(self.hash_word.__getitem__, words), self.np.uint64, len(words))

    def _mix(self, columns, n: int):
        mixed = columns[0].copy()
        for i in range(1, n):
            mixed = mixed * self.np.uint64(FACTOR) + columns[i]
        return mixed

    def _table(self, parts: list):
        """Sorted values, and a bitmap of their leading 20 bits that settles most misses."""
        values = self.np.unique(self.np.concatenate(parts))
        bitmap = self.np.zeros(1 << 20, bool)
        bitmap[values >> self.np.uint64(44)] = True
        return values, bitmap

    def _members(self, hashes, table):
        values, bitmap = table
        places = self.np.flatnonzero(bitmap[hashes >> self.np.uint64(44)])
        at = self.np.searchsorted(values, hashes[places])
        return places[values[self.np.minimum(at, len(values) - 1)] == hashes[places]]

    def leaks(self, text: str | None) -> list[tuple[int, int]]:
        """(item number, shared shingles) of the items held to the given share."""
        words = words_of(text)
        hashes = self._word_hashes(words)
        shared: dict[int, int] = {}
        for n, table in self.minima.items():
            if len(words) < n:
                continue
            mixed = self._mix([hashes[i : len(words) - n + 1 + i] for i in range(n)], n)
            if not len(self._members(mixed, table)):
                continue
            found = {" ".join(words[p : p + n]) for p in self._members(mixed, self.every[n]).tolist()}
            for shingle in found:
                for number in self.holders.get(shingle, ()):
                    shared[number] = shared.get(number, 0) + 1
        return sorted((i, k) for i, k in shared.items() if k >= self.containment * self.sizes[i] - 1e-9)


def item_blocks(items: DataFrame, item_id: str, text: str, shingle: int, block_shingles: int) -> Iterator[list]:
    """Items with their shingles, in blocks of about ``block_shingles`` shingles.

    A block is all that is sent to the driver and the workers at a time; a larger test set makes more blocks, not
    larger ones.
    """
    rows = narrow(items, item_id=item_id, text=text)
    kind = rows.schema["item_id"].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            found = [shingles_of(words_of(t), shingle) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["item_id", "shingles"])

    cut_items = save_stage(
        rows.mapInArrow(cut, f"item_id {kind}, shingles array<string>").filter(F.size("shingles") > 0), "items"
    )
    total = cut_items.agg(F.sum(F.size("shingles"))).first()[0] or 0
    blocks = math.ceil(total / block_shingles)
    block = F.pmod(F.xxhash64("item_id", "shingles"), F.lit(blocks)) if blocks > 1 else F.lit(0)
    for i in range(blocks):
        yield [(r[0], r[1]) for r in cut_items.filter(block == i).collect()]


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """One row per document and item of which it holds at least the share ``containment``: doc_id, item_id, n_shared,
    n_shingles, containment.

    Words are runs of letters, digits and underscores, lower-cased; shingles are distinct. Null and empty texts hold
    nothing; an item with fewer words than a shingle is one shingle, an item without words is never found. Repeated rows
    come out each, null ids stay null, empty tables give no rows, further columns are ignored. Documents are
    read where they are: nothing is shuffled, and memory follows the longest text and one block of items.
    """
    rows = narrow(docs, doc_id=doc_id, text=text)
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, n_shared long, n_shingles long, containment double"
    id_type = to_arrow_type(items.schema[item_id].dataType)
    result = rows.sparkSession.createDataFrame([], schema)
    for block in item_blocks(items, item_id, item_text, shingle, block_shingles):
        sent = rows.sparkSession.sparkContext.broadcast(block)

        def search(batches, sent=sent):
            index = ItemIndex(sent.value, containment)
            for batch in batches:
                out = []
                for i, text in enumerate(batch.column(1)):
                    out += [(i, number, shared) for number, shared in index.leaks(text.as_py())]
                if out:
                    at = pa.array([i for i, _, _ in out], pa.int64())
                    sizes = [index.sizes[n] for _, n, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).take(at),
                            pa.array([index.ids[n] for _, n, _ in out], id_type),
                            pa.array([k for _, _, k in out], pa.int64()),
                            pa.array(sizes, pa.int64()),
                            pa.array([k / size for (_, _, k), size in zip(out, sizes, strict=True)], pa.float64()),
                        ],
                        names=["doc_id", "item_id", "n_shared", "n_shingles", "containment"],
                    )

        result = result.unionByName(rows.mapInArrow(search, schema))
    return result


def without_leaks(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    shingle: int = SHINGLE,
    containment: float = CONTAINMENT,
    block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; row-local."""
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.col(text).alias("text"))
    for block in item_blocks(items, item_id, item_text, shingle, block_shingles):
        sent = docs.sparkSession.sparkContext.broadcast(block)

        def clean(batches, sent=sent):
            index = ItemIndex(sent.value, containment)
            for batch in batches:
                yield batch.filter(pa.array([not index.leaks(t.as_py()) for t in batch.column(1)], pa.bool_()))

        rows = rows.mapInArrow(clean, rows.schema)
    return rows.select("row.*")
