"""Word vectors trained in blocks of documents, and means of word vectors per document.

Documents are dealt to blocks of about ``BLOCK_TOKENS`` words, larger ones if there are many. In every epoch a block gets the vectors
of its own words, trains on its documents in one task, and returns the vectors; a word's vectors are the means over its blocks,
weighted with its occurrences there. Blocks take their turns in waves, whose means are added up, so that what is between tasks at a time
stays in proportion to the texts. Vocabulary and vectors are tables: the driver holds neither, and a task holds the words of a block.
"""

from __future__ import annotations

import math
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.cloudpickle import register_pickle_by_value
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.sources.tables import drop_stage, save_stage

register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package

BLOCK_TOKENS = 1_000_000
FEW_BLOCKS = 32  # more blocks than these are larger: fewer blocks share a word, whose vectors then travel less often
BLOCK_NUMBERS, MOST_TOKENS = 400_000_000, 8_000_000  # words of a block times size of a vector, and words of a block, at most
WAVE_BLOCKS = 12  # blocks of a wave, at least
TOKEN_BYTES = 10  # vectors on their way in a wave, per word of the texts, if waves of WAVE_BLOCKS allow it
BUCKET_BYTES = 4_000_000  # vectors that one task averages at a time
STEP = 256  # positions of an update at most; small blocks get about UPDATES updates of LEAST_STEP positions or more
LEAST_STEP, UPDATES = 16, 4000
NEGATIVES = 5  # noise words per position, as weight of the SHARED words drawn for an update
SHARED = 32
MOST = 8  # places of one word that count in an update
AHEAD = 64  # updates whose places are looked up at once
RATE, LAST_RATE = 0.025, 0.0001
TRAINED = pa.schema([("block", pa.int32()), ("n", pa.int64()), ("word", pa.string()), ("inner", pa.binary()), ("outer", pa.binary())])
PLACES = "array<struct<block: int, place: int, n: long>>"
CHUNK = 20_000  # positions whose vectors are held at once when means are taken


def _pack(ids: pa.DataType):
    """Group function: (block, id, words) -> one row: distinct words with their counts, codes of all words, end of each document."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id")  # the same block gives the same vectors, however its rows came
        texts = rows.column("words").combine_chunks()
        lengths = np.diff(texts.offsets.to_numpy())
        flat = texts.flatten().dictionary_encode()
        codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.bincount(codes, minlength=len(flat.dictionary)).astype(np.int64)
        return pa.table(
            {
                "block": pa.array([rows.column("block")[0].as_py()], pa.int32()),
                "ids": pa.array([rows.column("id").to_pylist()], pa.list_(ids)),
                "words": pa.array([flat.dictionary.to_pylist()], pa.list_(pa.string())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
                "codes": pa.array([codes.tobytes()], pa.binary()),
                "ends": pa.array([np.cumsum(lengths).astype(np.int64).tobytes()], pa.binary()),
            }
        )

    return run


def by_block(df: DataFrame, block: str, blocks: int) -> DataFrame:
    """Rows dealt by block, few blocks to a task: a block is much work in few bytes, by which the planner would put many in one task.

    Some four tasks a block, most without rows, keep blocks apart that a hash puts together; of thousands of blocks each task has few anyway.
    """
    return df.repartition(max(blocks, min(4 * blocks, 2000)), block)


def word_blocks(df: DataFrame, block: Column, blocks: int) -> DataFrame:
    """Rows (id, words, without null or empty words) as a stage with one row per block."""
    kind = df.schema["id"].dataType
    schema = f"block int, ids array<{kind.simpleString()}>, words array<string>, counts array<long>, codes binary, ends binary"
    arrow = df.sparkSession.createDataFrame([], "id " + kind.simpleString()).toArrow().schema.field("id").type
    placed = df.select(block.cast("int").alias("block"), "id", "words")
    return save_stage(by_block(placed, "block", blocks).groupBy("block").applyInArrow(_pack(arrow), schema), "word-blocks", release=True)


def _asked(blocks: DataFrame) -> DataFrame:
    """(block, place, word, n): the distinct words of every block."""
    pairs = blocks.select("block", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "pair"))
    return pairs.select("block", "place", F.col("pair.words").alias("word"), F.col("pair.counts").alias("n"))


def _token_count(df: DataFrame, words: str) -> int:
    return df.agg(F.sum(F.size(words))).first()[0] or 0


def block_count(tokens: int, size: int, block_tokens: int = BLOCK_TOKENS) -> int:
    """Blocks of ``block_tokens`` words; if these are more than ``FEW_BLOCKS``, fewer blocks, as large as a task can hold."""
    most = max(block_tokens, min(BLOCK_NUMBERS // size, MOST_TOKENS))
    return max(1, math.ceil(min(tokens / block_tokens, max(FEW_BLOCKS, tokens / most))))


def first_vectors(words: list[str], size: int, seed: int) -> np.ndarray:
    """Starting vectors fixed by word and seed, uniform within 0.5 / size of 0."""
    with np.errstate(over="ignore"):
        named = np.array([zlib.crc32(f"{seed}:{w}".encode()) << 32 | zlib.crc32(f"{w}:{seed}".encode()) for w in words], np.uint64)
        x = named[:, None] + np.arange(1, size + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
    return ((x >> np.uint64(11)).astype(np.float64) / 2**53 - 0.5).astype(np.float32) / size


def _groups(places: np.ndarray, weights: np.ndarray, gap: int) -> list[tuple]:
    """How the rows of every update (a row of ``places``) are added to a table: (places that occur once, their rows, which of these are scaled
    down and by what; places that occur more often, a matrix entry for each of their rows: place, row, scale).

    Rows of a place that weigh more than ``MOST`` together are scaled down to it. Places from ``gap`` on are left out.
    """
    updates, size = places.shape
    order = np.argsort(places, axis=1, kind="stable")
    ordered = np.take_along_axis(places, order, axis=1)
    begins = np.ones(places.shape, bool)
    begins[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
    starts = np.flatnonzero(begins)
    counts = np.diff(starts, append=places.size)
    scale = np.minimum(1, MOST / np.add.reduceat(np.take_along_axis(weights, order, axis=1).ravel(), starts)).astype(np.float32)
    place, first = ordered.ravel()[starts], order.ravel()[starts]
    kept = place < gap
    single, several = np.flatnonzero(kept & (counts == 1)), np.flatnonzero(kept & (counts > 1))
    group = np.repeat(np.arange(len(starts)), counts)
    member = np.flatnonzero((kept & (counts > 1))[group])
    number = np.zeros(len(starts), np.int64)
    number[several] = np.arange(len(several))
    ends = np.arange(updates + 1) * size
    cuts = [np.searchsorted(x, ends) for x in (starts[single], starts[several], member)]
    made = []
    for k in range(updates):
        (a, b), (c, d), (e, f) = ((x[k], x[k + 1]) for x in cuts)
        one, more, rows = single[a:b], several[c:d], member[e:f]
        less = np.flatnonzero(scale[one] < 1)
        own = group[rows]
        made.append((place[one], first[one], less, scale[one[less]][:, None], place[more], number[own] - c, order.ravel()[rows], scale[own]))
    return made


def _add_rows(table: np.ndarray, rows: np.ndarray, groups: tuple, shift: int = 0) -> None:
    """Add rows to the places of a table that ``_groups`` found; ``shift`` is the number of the first row."""
    one, first, less, scale, more, place, row, weight = groups
    added = rows[first - shift]
    if len(less):
        added[less] *= scale
    added += table[one]
    table[one] = added
    if len(more):
        sums = np.zeros((len(more), len(row)), np.float32)
        sums[place, np.arange(len(row))] = weight
        table[more] += sums @ rows[row - shift]


def _around(rows: np.ndarray, reach: int) -> np.ndarray:
    """Sum of the ``reach`` rows on each side of every row but the first and last ``reach``."""
    n = len(rows) - 2 * reach
    if reach <= 2:
        sums = rows[:n] + rows[2 * reach :]
        for offset in range(1, reach):
            sums += rows[offset : offset + n]
            sums += rows[2 * reach - offset : 2 * reach - offset + n]
        return sums
    # sums of 1, 2, 4 ... rows, of which some make up the whole width
    sums, at, span, width = -rows[reach : reach + n], 0, 1, 2 * reach + 1
    while width:
        if width & 1:
            sums += rows[at : at + n]
            at += span
        width >>= 1
        if width:
            rows, span = rows[:-span] + rows[span:], 2 * span
    return sums


def train_codes(
    codes: np.ndarray, ends: np.ndarray, inner: np.ndarray, outer: np.ndarray, window: int, rates: tuple[float, float], seed: tuple[int, ...]
) -> tuple[np.ndarray, np.ndarray]:
    """``inner`` and ``outer`` vectors after one pass of continuous bag of words with negative sampling over documents.

    The mean of the vectors around a position predicts its word against noise words drawn with frequency to the power 0.75. Windows
    shrink at random, as in the usual learner, but with one draw per update; an update shares its noise words, and moves a word as
    far as ``MOST`` of its places would, at most. What does not depend on the vectors is found for ``AHEAD`` updates at once.
    """
    if not len(codes):
        return inner, outer
    random = np.random.default_rng(seed)
    noise = np.cumsum(np.bincount(codes, minlength=len(inner)) ** 0.75)
    # a gap of places without word before and after every document keeps windows inside it
    gap = len(inner)
    document = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    line = np.full(len(codes) + window * (len(ends) + 3), gap)
    line[np.arange(len(codes)) + window * (document + 2)] = codes
    inner, outer = (np.vstack([x, np.zeros((1, x.shape[1]), np.float32)]) for x in (inner, outer))
    n = len(line)
    there = line != gap
    before = np.concatenate([[0], np.cumsum(there)])
    step = min(STEP, max(LEAST_STEP, len(codes) // UPDATES))
    starts = np.arange(2 * window, n - 2 * window, step)
    whole = len(starts) - (starts[-1] + step > n - 2 * window)
    for some in [*np.array_split(starts[:whole], range(AHEAD, whole, AHEAD)), starts[whole:]]:
        if not len(some):
            continue
        size = min(step, n - 2 * window - int(some[-1]))
        drawn, reaches = np.zeros((len(some), SHARED), np.int64), np.zeros((len(some), 1), np.int64)
        for k in range(len(some)):
            reaches[k] = random.integers(1, window + 1)
            drawn[k] = np.searchsorted(noise, random.random(SHARED) * noise[-1], side="right")
        places = some[:, None] + np.arange(size)
        target = line[places]
        count = before[places + reaches + 1] - before[places - reaches] - there[places]
        active = ((count > 0) & there[places]).astype(np.float32)
        share = (1 / np.maximum(count, 1)).astype(np.float32)[:, :, None]
        heavy = np.repeat(active.sum(axis=1, keepdims=True) * (NEGATIVES / SHARED), SHARED, axis=1)
        to_outer = _groups(np.hstack([target, drawn]), np.maximum(np.hstack([active, heavy]), 1), gap)
        column = np.arange(size + 2 * window)
        near = line[some[:, None] - window + column]
        far = (column < window - reaches) | (column >= size + window + reaches)
        to_inner = _groups(np.where(far, gap, near), np.ones(near.shape), gap)
        hits = [np.nonzero(target[k][:, None] == drawn[k]) for k in range(len(some))]
        for k, start in enumerate(some):
            reach = int(reaches[k, 0])
            rate = np.float32(rates[0] + (rates[1] - rates[0]) * start / n)
            mean = _around(inner[near[k, window - reach : size + window + reach]], reach)
            mean *= share[k]
            right, wrong = outer[target[k]], outer[drawn[k]]
            up = rate * active[k] / (1 + np.exp(np.minimum(np.einsum("ij,ij->i", mean, right), 30)))
            down = 1 / (1 + np.exp(np.minimum(-(mean @ wrong.T), 30)))
            down *= (rate * np.float32(NEGATIVES / SHARED)) * active[k][:, None]
            if len(hits[k][0]):
                down[hits[k]] = 0
            change = np.zeros((size + 4 * reach, inner.shape[1]), np.float32)
            middle = change[2 * reach : -2 * reach]
            np.multiply(right, up[:, None], out=middle)
            middle -= down @ wrong
            moves = np.empty((size + SHARED, inner.shape[1]), np.float32)
            np.matmul(-down.T, mean, out=moves[size:])
            np.multiply(mean, up[:, None], out=moves[:size])
            _add_rows(outer, moves, to_outer[k])
            _add_rows(inner, _around(change, reach), to_inner[k], window - reach)
    return inner[:-1], outer[:-1]


def _known_codes(block: pa.Table, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words at ``places``, renumbered in their order, and the ends of documents without the other words."""
    codes = np.frombuffer(block.column("codes")[0].as_py(), np.int32)
    ends = np.frombuffer(block.column("ends")[0].as_py(), np.int64)
    size = len(block.column("words")[0])
    number = np.full(size, -1, np.int64)
    number[places] = np.arange(len(places))
    new = number[codes]
    kept = np.concatenate([[0], np.cumsum(new >= 0)])
    return new[new >= 0], kept[ends]


def _matrix(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """A column of binary values of one size as a matrix of float32."""
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, kind).reshape(len(column), -1).astype(np.float32)


def _binary(matrix: np.ndarray) -> pa.Array:
    width = matrix.shape[1] * matrix.itemsize
    data = np.ascontiguousarray(matrix)
    return pa.Array.from_buffers(pa.binary(width), len(matrix), [None, pa.py_buffer(data)]).cast(pa.binary())


def _no_rows(schema: pa.Schema) -> pa.Table:
    return pa.Table.from_batches([], schema=schema)


def _train_blocks(size: int, window: int, seed: int, epoch: int, epochs: int):
    """Cogroup function: (words of a block with vectors), block -> vectors after a pass over the block."""
    fall = RATE - LAST_RATE
    rates = (RATE - fall * epoch / epochs, RATE - fall * (epoch + 1) / epochs)

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        if not len(asked):
            return _no_rows(TRAINED)
        asked = asked.sort_by("place")
        words = asked.column("word")
        if epoch:
            inner, outer = _matrix(asked.column("inner"), np.float16), _matrix(asked.column("outer"), np.float16)
        else:
            inner = first_vectors(words.to_pylist(), size, seed)
            outer = np.zeros_like(inner)
        codes, ends = _known_codes(block, asked.column("place").to_numpy())
        inner, outer = train_codes(codes, ends, inner, outer, window, rates, (seed, epoch, asked.column("block")[0].as_py()))
        columns = [*asked.select(["block", "n"]).columns, words, *[_binary(x.astype(np.float16)) for x in (inner, outer)]]
        return pa.table(columns, schema=TRAINED)

    return run


def _average(rows: pa.Table) -> pa.Table:
    """Group function: words of a bucket with their places, or with vectors from blocks and from the waves before (as places may be, too)
    -> a row per word: places, occurrences so far and means of the vectors, weighted with occurrences."""
    rows = rows.sort_by([("word", "ascending"), ("block", "ascending")])
    flat = rows.column("word").combine_chunks().dictionary_encode()
    number = flat.indices.to_numpy()
    trained = rows.column("n").to_numpy() > 0
    found, own = rows.filter(pa.array(trained)).select(["n", "inner", "outer"]), number[trained]
    n, means = np.zeros(len(flat.dictionary), np.int64), [pa.nulls(len(flat.dictionary), pa.binary())] * 2
    if len(found):
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        n[own[starts]] = np.add.reduceat(found.column("n").to_numpy(), starts)
        weight = found.column("n").to_numpy().astype(np.float32)[:, None]
        total = np.add.reduceat(weight, starts)
        row = np.full(len(n), -1)
        row[own[starts]] = np.arange(len(starts))
        taken = pa.array(row, mask=row < 0)
        sums = [np.add.reduceat(_matrix(found.column(c), np.float16) * weight, starts) for c in ("inner", "outer")]
        means = [_binary((x / total).astype(np.float16)).take(taken) for x in sums]
    places = rows.filter(rows.column("places").is_valid()).column("places")  # of every word once, in the order of words
    return pa.table([flat.dictionary, places, pa.array(n), *means], names=["word", "places", "n", "inner", "outer"])


def train_vectors(
    df: DataFrame,
    words: str,
    size: int,
    epochs: int,
    window: int,
    min_count: int,
    seed: int,
    blocks: int | None = None,
    block_tokens: int = BLOCK_TOKENS,
    waves: int | None = None,
) -> DataFrame:
    """(word, vector as array of float) of all words with ``min_count`` occurrences, trained on an array column of words.

    Null words do not count. Equal documents are dealt to blocks one by one, so a text with many copies is not one task. Vectors
    depend on the rows, the seed and the numbers of blocks and waves (from the numbers of words, if not given), not on partitions.

    Where a word occurs (block, place in its list of words, occurrences) is kept with its vectors, so blocks get them without a join. Stages and
    shuffles that are done with are deleted at once: in a wave there are the texts in blocks, the vectors before the epoch, the means so far,
    and vectors on their way to and from the blocks of the wave.
    """
    texts = df.select(F.array_compact(words).alias("words")).filter(F.size("words") > 0)
    named = texts.select(F.md5(F.concat_ws("\x1f", "words")).alias("id"), "words")
    distinct = named.groupBy("id").agg(F.first("words").alias("words"), F.count("*").alias("copies"))
    grouped = save_stage(distinct, "word-texts", release=True)
    copies = grouped.select("id", "words", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    tokens = _token_count(copies, "words")
    blocks = blocks or block_count(tokens, size, block_tokens)
    dealt = word_blocks(copies, F.pmod(F.xxhash64("id", "copy"), F.lit(blocks)), blocks)
    drop_stage(grouped)
    places = F.collect_list(F.struct("block", "place", "n").cast("struct<block: int, place: int, n: long>")).alias("places")
    known = _asked(dealt).groupBy("word").agg(F.sum("n").alias("total"), places).filter(F.col("total") >= min_count)
    blank = F.lit(None).cast("binary")
    state = save_stage(known.select("word", "places", blank.alias("inner"), blank.alias("outer")), "word-vectors", release=True)
    asks = state.agg(F.sum(F.size("places"))).first()[0] or 0
    buckets = max(1, math.ceil(asks * size * 4 / BUCKET_BYTES))
    if not waves:
        waves = min(math.ceil(asks * size * 8 / max(1, tokens * TOKEN_BYTES)), blocks // WAVE_BLOCKS)
    waves = max(1, min(waves, blocks))
    columns = ["word", "places", "n", "inner", "outer", "block"]
    for epoch in range(max(epochs, 1)):
        means = None
        for wave in range(waves):
            first, after = wave * blocks // waves, (wave + 1) * blocks // waves
            there = F.filter("places", lambda x: (x["block"] >= first) & (x["block"] < after))  # noqa: B023
            rows = state.select("word", *(["inner", "outer"] if epoch else []), F.inline(there))
            turn = dealt.filter((F.col("block") >= first) & (F.col("block") < after))
            pairs = by_block(rows, "block", after - first).groupBy("block").cogroup(by_block(turn, "block", after - first).groupBy("block"))
            trained = pairs.applyInArrow(
                _train_blocks(size, window, seed, epoch, max(epochs, 1)), "block int, n long, word string, inner binary, outer binary"
            )
            # before the first wave there are no means yet, only the words and their places
            held = means or state.select("word", "places", F.lit(0).cast("long").alias("n"), blank.alias("inner"), blank.alias("outer"))
            every = held.withColumn("block", F.lit(-1)).select(columns).unionByName(trained.withColumn("places", F.lit(None).cast(PLACES)))
            named = every.withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(buckets)).cast("int"))
            schema = f"word string, places {PLACES}, n long, inner binary, outer binary"
            done = save_stage(named.groupBy("bucket").applyInArrow(_average, schema), "word-vectors", release=True)
            drop_stage(means)
            means = done
        drop_stage(state)
        state = means
    vectors = save_stage(state.select("word", "inner").mapInArrow(_arrays, "word string, vector array<float>"), "word-vectors")
    drop_stage(state)
    drop_stage(dealt)
    return vectors


def _arrays(batches):
    """Worker function: (word, inner as binary) -> (word, vector)."""
    for batch in batches:
        if batch.num_rows:
            matrix = _matrix(pa.chunked_array([batch.column(1)]), np.float16)
            ends = pa.array(np.arange(0, matrix.size + 1, matrix.shape[1]), pa.int32())
            vectors = pa.ListArray.from_arrays(ends, pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), vectors], names=["word", "vector"])


def _mean_blocks(size: int, known_only: bool, ids: pa.DataType):
    """Cogroup function: (vectors of the words of a block), block -> mean vector per document."""

    def run(asked: pa.Table, block: pa.Table) -> pa.Table:
        names = block.column("ids").combine_chunks().flatten()
        ends = np.frombuffer(block.column("ends")[0].as_py(), np.int64)
        lengths = np.diff(ends, prepend=0)
        sums, known = np.zeros((len(ends), size)), np.zeros(len(ends), np.int64)
        if len(asked):
            asked = asked.sort_by("place")
            vectors = asked.column("vector").combine_chunks()
            matrix = np.asarray(vectors.flatten()).reshape(len(asked), size)
            codes, kept = _known_codes(block, asked.column("place").to_numpy())
            known = np.diff(kept, prepend=0)
            owner = np.repeat(np.arange(len(kept)), known)
            for start in range(0, len(codes), CHUNK):
                part, mine = matrix[codes[start : start + CHUNK]].astype(np.float64), owner[start : start + CHUNK]
                firsts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
                sums[mine[firsts]] += np.add.reduceat(part, firsts, axis=0)
        means = sums / np.maximum(known if known_only else lengths, 1)[:, None]
        offsets = pa.array(np.arange(0, means.size + 1, size), pa.int32())
        columns = [names.cast(ids), pa.ListArray.from_arrays(offsets, pa.array(means.ravel())), pa.array(known)]
        return pa.table(columns, names=["id", "mean", "known"])

    return run


def mean_vectors(df: DataFrame, vectors: DataFrame, size: int, known_only: bool, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(id, mean, known): mean vector over the words of each row (id, words), over those with a vector or over all of them, and how
    many have one.

    A row of the input with words gives one row. A block of rows asks once for the vector of each of its words. The vectors
    are never broadcast: their number grows with the texts.
    """
    return _means(df, vectors, size, known_only, block_tokens)[0]


def mean_stage(texts: DataFrame, vectors: DataFrame, size: int, known_only: bool) -> DataFrame:
    """The rows of ``mean_vectors`` as a stage; the stage ``texts`` and the shuffles on the way are deleted."""
    means, blocks = _means(texts, vectors, size, known_only, BLOCK_TOKENS)
    stage = save_stage(means, "embedded-means", release=True)
    drop_stage(blocks)
    drop_stage(texts)
    return stage


def _means(df: DataFrame, vectors: DataFrame, size: int, known_only: bool, block_tokens: int) -> tuple[DataFrame, DataFrame]:
    """Rows of ``mean_vectors``, and the stage of blocks that they are made from."""
    texts = df.select("id", F.array_compact("words").alias("words")).filter(F.size("words") > 0)
    count = block_count(_token_count(texts, "words"), size, block_tokens)
    blocks = word_blocks(texts, F.pmod(F.xxhash64("id"), F.lit(count)), count)
    kind = df.schema["id"].dataType.simpleString()
    arrow = blocks.select("ids").limit(0).toArrow().schema.field("ids").type.value_type
    asked = _asked(blocks).drop("n").join(vectors.select("word", "vector").hint("merge"), "word").drop("word")
    own = by_block(blocks.withColumnRenamed("block", "own"), "own", count)
    pairs = by_block(asked, "block", count).groupBy("block").cogroup(own.groupBy("own"))
    return pairs.applyInArrow(_mean_blocks(size, known_only, arrow), f"id {kind}, mean array<double>, known long"), blocks


class WordVectors(Model, HasInputCol, HasOutputCol, MLWritable, MLReadable):
    """Pipeline stage: adds the mean vector of a row's words (an array column) over all its words; zeros if none is known.

    Vectors are a table, saved with the stage. Rows are written once and joined with the means of their distinct texts.
    """

    @keyword_only
    def __init__(self, *, vectors: DataFrame | None = None, size: int = 0, inputCol: str = "words", outputCol: str = "embedding"):
        super().__init__()
        self.vectors, self.size = vectors, size
        self._set(inputCol=inputCol, outputCol=outputCol)

    def getVectorSize(self) -> int:
        return self.size

    def getVectors(self) -> DataFrame:
        """(word, vector as array of float)."""
        return self.vectors

    def _transform(self, dataset: DataFrame) -> DataFrame:
        words = self.getInputCol()
        digest = F.md5(F.concat_ws("\x1f", words))
        rows = save_stage(dataset, "embedded-rows", release=True).withColumn("_digest", digest)
        distinct = rows.groupBy(F.col("_digest").alias("id")).agg(F.first(words).alias("words"))
        texts = save_stage(distinct, "embedded-texts", release=True)
        means = mean_stage(texts, self.vectors, self.size, False).drop("known").withColumnRenamed("id", "_digest")
        zeros = F.array_repeat(F.lit(0.0), self.size)
        joined = rows.join(means, "_digest", "left")
        return joined.withColumn(self.getOutputCol(), array_to_vector(F.coalesce("mean", zeros))).drop("mean", "_digest")

    def write(self) -> MLWriter:
        return _VectorsWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return _VectorsReader(cls)


class _VectorsWriter(MLWriter):
    def __init__(self, instance: WordVectors):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession, {"size": self.instance.size})
        self.instance.vectors.write.parquet(f"{path}/vectors")


class _VectorsReader(MLReader):
    def __init__(self, kind: type[WordVectors]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> WordVectors:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        table = self.sparkSession.read.schema("word string, vector array<float>").parquet(f"{path}/vectors")
        loaded = self.kind(vectors=table, size=metadata["size"])
        loaded._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(loaded, metadata)
        return loaded
