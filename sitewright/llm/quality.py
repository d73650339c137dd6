"""Perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.texts import narrow, whole
from sitewright.sources.tables import save_stage

ORDER = 5  # characters per n-gram
BITS = 12  # per character
CLASSES = (1 << BITS) - 2  # characters are counted in this many classes by code point
PAD, END = 0, 1
CALIBRATION = 4  # one trusted document in so many is not trained on and sets the thresholds instead
QUANTILE = 0.98  # of these documents of a language and length class
MARGIN = 0.02  # nats per character by which a document may exceed its class's quantile
CLASS_ROWS = 100  # a length class with fewer calibration documents is merged with the next
STEPS = 1000  # thresholds are exact to 1 / STEPS nats
SLICE = 1_000_000
BLOCK_ROWS = 16_000
PACK_CHARS = 200_000  # texts of a block are packed and compressed in parts of this size before they travel
MASK = [(1 << (BITS * n)) - 1 for n in range(ORDER + 1)]


def gram_slices(texts: list[str | None]) -> Iterator[tuple]:
    """(owner, gram) arrays over all n-grams, a slice of about ``SLICE`` characters at a time.

    A text has a gram for each character and one for its end; in front it is padded.
    """
    import numpy as np

    def grams(chars, owners):
        code = np.zeros(len(chars) - ORDER + 1, np.int64)
        for i in range(ORDER):
            code = (code << BITS) | chars[i : len(chars) - ORDER + 1 + i]
        own = owners[: len(code)] == owners[ORDER - 1 :]
        return owners[: len(code)][own], code[own]

    chars: list = []
    owners: list = []
    size = 0
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").encode("utf-32-le"), np.uint32).astype(np.int64) % CLASSES + 2
        points = np.concatenate([np.full(ORDER - 1, PAD), points, [END]])
        for start in range(0, len(points) - ORDER + 1, SLICE):
            part = points[start : start + SLICE + ORDER - 1]
            chars.append(part)
            owners.append(np.full(len(part), i))
            size += len(part)
            if size >= SLICE:
                yield grams(np.concatenate(chars), np.concatenate(owners))
                chars, owners, size = [], [], 0
            if start + SLICE + ORDER - 1 >= len(points):
                break
    if chars:
        yield grams(np.concatenate(chars), np.concatenate(owners))


def count_partitions():
    """Worker function: (block, text) -> block, gram, n, combined within a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            blocks = batch.column(0).to_numpy()
            for block in np.unique(blocks).tolist():
                at = pa.array(np.flatnonzero(blocks == block))
                grams, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
                for _, codes in gram_slices(batch.column(1).take(at).to_pylist()):
                    code, n = np.unique(codes, return_counts=True)
                    grams, back = np.unique(np.concatenate([grams, code]), return_inverse=True)
                    counts = np.bincount(back, np.concatenate([counts, n])).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(grams), block)), pa.array(grams), pa.array(counts)], names=["block", "gram", "n"]
                )

    return run


def _gram_counts(rows: DataFrame) -> DataFrame:
    return rows.mapInArrow(count_partitions(), "block long, gram long, n long")


def _low(gram: str, n: int) -> Column:
    """The last ``n`` characters."""
    return F.col(gram).bitwiseAND(F.lit(MASK[n]))


def _context(gram: str) -> Column:
    """All characters but the last."""
    return F.shiftright(F.col(gram), BITS)


def discounts(counts: dict[int, int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and more from the numbers of n-grams that occur 1 to 4 times."""
    n1, n2, n3, n4 = (counts.get(i, 0) for i in (1, 2, 3, 4))
    base = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * base * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * base * n3 / n2 if n2 else min(1.0, d1 * 1.5)
    d3 = 3 - 4 * base * n4 / n3 if n3 else min(1.5, d1 * 2)
    return tuple(min(max(d, 0.05), k - 0.05) for d, k in ((d1, 1), (d2, 2), (d3, 3)))


class NgramModel:
    """Counts by order (raw at the top, continuation counts below), contexts and discounts, as stored tables."""

    def __init__(self, trusted: DataFrame) -> None:
        """``trusted`` has block and text; all of it is counted."""
        table = save_stage(_gram_counts(trusted).groupBy("gram").agg(F.sum("n").alias("n")), "grams-5")
        self.counts: dict[int, DataFrame] = {ORDER: table}
        for n in range(ORDER - 1, 0, -1):
            lower = self.counts[n + 1].groupBy(_low("gram", n).alias("gram")).agg(F.count("*").alias("n"))
            self.counts[n] = save_stage(lower, f"grams-{n}")
        self.discounts, self.contexts = {}, {}
        for n, table in self.counts.items():
            rare = {r[0]: r[1] for r in table.filter("n <= 4").groupBy("n").count().collect()}  # four rows at most
            d = self.discounts[n] = discounts(rare)
            kept_back = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            by_context = table.groupBy(_context("gram").alias("context"))
            total = by_context.agg(F.sum("n").alias("total"), (F.sum(kept_back) / F.sum("n")).alias("backoff"))
            self.contexts[n] = save_stage(total, f"contexts-{n}")
        self.empty = table.limit(1).count() == 0
        # a character class never seen shares the mass of all classes
        self.floor = 1.0 / (CLASSES + 1)

    def log_probabilities(self, asked: DataFrame) -> DataFrame:
        """(gram, logp) for distinct grams of the highest order.

        Order by order: the grams' endings are joined to the counts, their contexts to the backoff weights,
        and the result to the next order.
        """
        below = None
        for n in range(1, ORDER + 1):
            d = self.discounts[n]
            wanted = asked.select(_low("gram", n).alias("gram")).distinct() if n < ORDER else asked.select("gram")
            keyed = wanted.withColumn("context", _context("gram"))
            joined = keyed.join(self.counts[n], "gram", "left").join(self.contexts[n], "context", "left")
            kept = F.col("n") - F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
            own = F.coalesce(kept / F.col("total"), F.lit(0.0))
            backoff = F.coalesce("backoff", F.lit(1.0))  # a context never seen leaves all to the shorter one
            if below is None:
                lower = F.lit(self.floor)
            else:
                joined = joined.withColumn("ending", _low("gram", n - 1)).join(
                    below.select(F.col("gram").alias("ending"), F.col("p").alias("lower")), "ending"
                )
                lower = F.col("lower")
            below = save_stage(joined.select("gram", (own + backoff * lower).alias("p")), f"probabilities-{n}")
        return below.select("gram", F.log("p").alias("logp"))


def pack_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (block, row, text) -> block, rows, packed: neighboring texts of a block compressed together."""
    import zstandard

    packer = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        blocks, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(2).to_pylist()]
        start = 0
        out: tuple[list, list, list] = ([], [], [])
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and blocks[end] == blocks[start] and size < PACK_CHARS:
                size += len(texts[end])
                end += 1
            lengths = [len(t.encode()) for t in texts[start:end]]
            head = len(lengths).to_bytes(4, "big") + b"".join(n.to_bytes(8, "big") for n in lengths)
            out[0].append(blocks[start])
            out[1].append((start, end))
            out[2].append(packer.compress(head + "".join(texts[start:end]).encode()))
            start = end
        offsets = pa.array([s for s, _ in out[1]] + [len(texts)], pa.int32())
        rows = pa.ListArray.from_arrays(offsets, batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(out[0], pa.int64()), rows, pa.array(out[2], pa.binary())], names=["block", "rows", "packed"]
        )


def unpack(packed: bytes) -> list[str]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(packed)
    count = int.from_bytes(raw[:4], "big")
    lengths = [int.from_bytes(raw[4 + 8 * i : 12 + 8 * i], "big") for i in range(count)]
    at, texts = 4 + 8 * count, []
    for n in lengths:
        texts.append(raw[at : at + n].decode())
        at += n
    return texts


def _score_block(key, packs: pa.Table, table: pa.Table) -> pa.Table:
    """Mean log-probability of each document of a block from the block's own table of grams, pack by pack."""
    import numpy as np

    grams, first = np.unique(table.column("gram").to_numpy(), return_index=True)
    logp = table.column("logp").to_numpy()[first]
    losses, sizes = [], []
    for packed in packs.column("packed"):
        texts = unpack(packed.as_py())
        total, size = np.zeros(len(texts)), np.zeros(len(texts))
        for owners, codes in gram_slices(texts):
            total += np.bincount(owners, logp[np.searchsorted(grams, codes)], minlength=len(texts))
            size += np.bincount(owners, minlength=len(texts))
        losses.append(-total / size)
        sizes.append(size)
    rows = pc.list_flatten(packs.column("rows"))
    return pa.table({"row": rows, "loss": pa.array(np.concatenate(losses), pa.float64()), "size": pa.array(np.concatenate(sizes).astype(np.int64))})


def default_position(doc_id: str, text: str) -> tuple[Column, Column]:
    """(block, place) for frames that have no file positions."""
    return F.pmod(F.xxhash64(F.col(text)), F.lit(64)).cast("long"), F.xxhash64(F.col(doc_id), F.col(text))


def file_position(rows: int = BLOCK_ROWS) -> tuple[Column, Column]:
    """(block, place): blocks of neighboring rows of a Parquet file, so that one task meets a whole block without a shuffle."""
    index = F.col("_metadata.row_index")
    return F.xxhash64("_metadata.file_path", F.floor(index / rows)), index


def calibrates(doc_id: str) -> Column:
    """True for the trusted documents that set thresholds and are not trained on."""
    return F.pmod(F.xxhash64(F.col(doc_id)), F.lit(CALIBRATION)) == 0


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    label_id: str = "doc_id",
    quality: str = "quality",
    position: tuple[Column, Column] | None = None,
    quantile: float = QUANTILE,
    margin: float = MARGIN,
    class_rows: int = CLASS_ROWS,
) -> DataFrame:
    """One row per document: doc_id, lang, perplexity, threshold, kept.

    A character model of order 5 is trained on the whole texts of the documents labelled 1, but for every fourth of them by
    hash of doc_id. Perplexity is per character (and one end per text). Short texts lose more per character, so a threshold
    holds for a language and a length class: the ``quantile`` of the loss of those left out, plus ``margin`` nats.
    Lengths are classed by powers of two of their characters and end; going up, a class with fewer than ``class_rows``
    such documents is merged with the next, and a thin last one with the one before. Documents above the threshold are not kept. A language without such documents has no threshold (null) and keeps all;
    a null lang is a group of its own. Null counts as empty: its only n-gram is the end. Without any trusted text all
    are kept and perplexity is that of equal chances. Repeated rows come out each; an empty table gives no rows;
    further columns are ignored.

    Each block of documents asks for its distinct n-grams only. They are joined to the model's counts, which are
    spread by n-gram, and the answers meet the texts of their block again, so what is shuffled are the texts once,
    compressed, and per block a table of its n-grams. Labels are joined to ids alone; a block then gets the list of its
    trusted rows. ``position`` has two bigint expressions on ``docs``: the block, and what tells its rows apart (rows
    that agree in it must have the same id and text); see ``file_position``.
    """
    block, place = position or default_position(doc_id, text)
    base = docs.select(
        block.alias("block"), place.alias("place"), F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text")
    )
    good = labels.filter(F.col(quality) == 1).select(F.col(label_id).alias("doc_id")).distinct()
    learned, checked = good.filter(~calibrates("doc_id")), good.filter(calibrates("doc_id"))
    places = base.select("block", "place", "doc_id").join(learned, "doc_id", "left_semi").groupBy("block")
    trusted = save_stage(places.agg(F.collect_set("place").alias("places")), "trusted")
    marked = base.select("block", "place", "text").join(trusted, "block").filter(F.array_contains("places", F.col("place")))
    model = NgramModel(marked.select("block", "text"))
    asked = save_stage(_gram_counts(base.select("block", "text")).select("block", "gram"), "asked")
    known = model.log_probabilities(asked.select("gram").distinct())
    answers = asked.join(known, "gram").select("block", "gram", F.col("logp").cast("float").alias("logp"))
    rows = base.select("block", F.struct("doc_id", "lang").alias("row"), "text")
    kind = rows.schema["row"].dataType.simpleString()
    packs = rows.mapInArrow(pack_partitions, f"block long, rows array<{kind}>, packed binary")
    scored = packs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score_block, f"row {kind}, loss double, size long")
    scored = scored.select("row.doc_id", "row.lang", "loss", F.floor(F.log2("size")).cast("int").alias("length"))
    scored = save_stage(scored, "losses")
    limits = _thresholds(scored.join(checked, "doc_id", "left_semi"), quantile, margin, class_rows)
    within = (F.col("length") >= F.col("low")) & (F.col("length") < F.col("high"))
    limited = scored.join(F.broadcast(limits), scored["lang"].eqNullSafe(limits["limit_lang"]) & within, "left")  # a row per class
    return limited.select(
        "doc_id",
        scored["lang"],
        F.exp("loss").alias("perplexity"),
        F.exp("limit").alias("threshold"),
        F.coalesce(F.col("loss") <= F.col("limit"), F.lit(True)).alias("kept"),
    )


def length_classes(counts: dict[int, int], least: int) -> list[tuple[int, int]]:
    """Ranges [low, high) of lengths that hold ``least`` rows each, if there are so many, and all lengths together."""
    starts, n = [0], 0
    for length in sorted(counts):
        if n >= least:
            starts.append(length)
            n = 0
        n += counts[length]
    if n < least and len(starts) > 1:
        starts.pop()
    return list(zip(starts, [*starts[1:], 64], strict=True))


def _thresholds(trusted: DataFrame, quantile: float, margin: float, class_rows: int) -> DataFrame:
    """(limit_lang, low, high, limit) from counts of losses rounded up to 1 / STEPS: the same in every run, in bounded memory."""
    step = F.ceil(F.col("loss") * STEPS).alias("step")
    steps = save_stage(trusted.groupBy("lang", "length", step).agg(F.count("*").alias("n")), "loss-steps")
    counts: dict = {}
    for r in steps.groupBy("lang", "length").agg(F.sum("n")).collect():  # a few dozen rows per language
        counts.setdefault(r[0], {})[r[1]] = r[2]
    ranges = [(lang, *x) for lang, sizes in counts.items() for x in length_classes(sizes, class_rows)]
    kind = f"limit_lang {trusted.schema['lang'].dataType.simpleString()}, low int, high int"
    classes = F.broadcast(trusted.sparkSession.createDataFrame(ranges, kind))
    own = steps["lang"].eqNullSafe(classes["limit_lang"]) & (F.col("length") >= F.col("low")) & (F.col("length") < F.col("high"))
    group = ["limit_lang", "low", "high"]
    steps = steps.join(classes, own).groupBy(*group, "step").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(Window.partitionBy(*group))
    reached = steps.withColumn("upto", upto).withColumn("total", total).filter(F.col("upto") >= F.col("total") * quantile)
    return reached.groupBy(*group).agg((F.min("step") / STEPS + margin).alias("limit"))
