"""Exact Jaccard join of documents as a join in a metric space, for thresholds near 1."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.components import connected_components
from sitewright.llm.texts import narrow, whole, with_row_number
from sitewright.operators.joins import lookup
from sitewright.sources.tables import save_stage

SHINGLE = 3
SIMILARITY = (90, 100)  # link if 100 * intersection >= 90 * union
PIVOTS = 8
CELL_SETS, CELL_SHINGLES = 2048, 1 << 21  # what one task joins at a time
LEAF_SETS = 64  # a region of so few sets is compared by an index of its shingles
SALTS = 64
PART_BYTES = 1 << 20
KEYS_HELD = 1 << 18
CACHED_WORDS = 1 << 18


# --- sets and their signatures, in Python workers -------------------------------------------------


def mixed(x):
    """A bijection of 64-bit integers without visible structure (splitmix64)."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def shingle_set(text: bytes, shingle: int, hashes: WordHashes, part_bytes: int = PART_BYTES):
    """Sorted distinct 64-bit hashes of the shingles of a whole text; a long text is read part by part.

    A-Z are lowered, words are runs without blanks. Fewer words than ``shingle`` make one shingle, no words none.
    """
    import numpy as np

    found, tail, start = [], np.zeros(0, np.uint64), 0
    while start < len(text) or not start:
        end = len(text)
        if end - start > part_bytes:
            stops = [x for x in (text.find(blank, start + part_bytes) for blank in (b" ", b"\n", b"\t")) if x >= 0]
            end = min(stops, default=end)
        words = text[start:end].lower().split()  # for bytes: A-Z only, and space and \t to \r only
        own = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
        own = np.concatenate([tail, own])
        if len(own) >= shingle:
            value = np.zeros(len(own) - shingle + 1, np.uint64)
            for i in range(shingle):
                value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - shingle + 1 + i])
            found.append(np.unique(value))
        tail = own[max(0, len(own) - shingle + 1) :]
        start = max(end, 1)
    if not found and len(tail):
        value = np.full(1, len(tail), np.uint64)
        for word in tail:
            value = mixed(value * np.uint64(0x9E3779B97F4A7C15) + word)
        return value
    return np.unique(np.concatenate(found)) if found else tail


def size_classes(largest: int, similarity: tuple[int, int] = SIMILARITY) -> list[int]:
    """Smallest sizes of the size classes up to ``largest``: linked sets lie in the same class or in neighboring ones."""
    num, den = similarity
    lows = [1]
    while lows[-1] <= largest:
        lows.append(max(lows[-1] + 1, (lows[-1] - 1) * den // num + 1))
    return lows


def signatures(values, lows: list[int], similarity: tuple[int, int] = SIMILARITY):
    """Keys of a set of which it shares at least one with every set it is linked to.

    Linked sets differ in at most D elements, D = floor((1 - t) / t * size of the smaller one). So if all hashes are dealt to D + 1
    ranges, the two sets are equal in one range at least, whose content (with its place) makes a common key. D follows the size
    class; a set has the keys of its own class and, as the larger set of a pair, those of the class below.
    """
    import numpy as np

    num, den = similarity
    own = int(np.searchsorted(lows, len(values), side="right")) - 1
    keys = []
    scrambled = mixed(values)
    for level in (own - 1, own):
        if level < 0:
            continue
        ranges = (lows[level + 1] - 1) * (den - num) // num + 1
        borders = (np.arange(ranges + 1, dtype=np.float64) * (2.0**64 / ranges))[1:-1].astype(np.uint64)
        at = np.concatenate([[0], np.searchsorted(values, borders), [len(values)]])
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(scrambled, dtype=np.uint64)])
        content = sums[at[1:]] - sums[at[:-1]]
        place = np.arange(ranges, dtype=np.uint64) + np.uint64(level << 32)
        keys.append(mixed(mixed(place) + content))
    return np.concatenate(keys).view(np.int64)


def signature_partitions(shingle: int, similarity: tuple[int, int]):
    """Worker function: (row, text as bytes) -> row, n, digest, keys of the text's set. Empty sets have no digest and no keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hashes, lows = WordHashes(), size_classes(1 << 40, similarity)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1):
                values = shingle_set(text.as_py() or b"", shingle, hashes)
                sizes.append(len(values))
                digests.append(xxhash.xxh3_128_hexdigest(values.tobytes()) if len(values) else None)
                keys.append(signatures(values, lows, similarity) if len(values) else [])
            columns = [
                batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(keys, pa.list_(pa.int64()))
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "digest", "keys"])

    return run


def set_partitions(shingle: int):
    """Worker function: (region, row, text as bytes) -> region, row, n, shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            sets = [shingle_set(text.as_py() or b"", shingle, hashes).tobytes() for text in batch.column(2)]
            sizes = pa.array([len(x) // 8 for x in sets], pa.int64())
            columns = [batch.column(0), batch.column(1), sizes, pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["region", "row", "n", "shingles"])

    return run


# --- coarse regions -------------------------------------------------------------------------------


def _pairs_of_runs(keys, rows):
    """(first row, other row) of each run of equal keys in sorted ``keys``, distinct, and the runs' begins."""
    import numpy as np

    begins = np.concatenate([[True], keys[1:] != keys[:-1]])
    first = rows[np.flatnonzero(begins)[np.cumsum(begins) - 1]]
    again = ~begins & (first != rows)
    pairs = np.unique(np.stack([first[again], rows[again]], axis=1), axis=0)
    return pairs, begins


def combined_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (row, keys) -> key, row; of rows with the same key one goes on before anything is shuffled.

    The others are tied to it by a key of the two rows alone, so a key that a third of all rows have makes no hot task.
    """
    import numpy as np

    def flushed(held):
        keys = np.concatenate([k for k, _ in held])
        rows = np.concatenate([r for _, r in held])
        order = np.lexsort((rows, keys))
        keys, rows = keys[order], rows[order]
        pairs, begins = _pairs_of_runs(keys, rows)
        tie = mixed(mixed(pairs[:, 0].view(np.uint64)) + pairs[:, 1].view(np.uint64)).view(np.int64)
        keys = np.concatenate([keys[begins], tie, tie])
        rows = np.concatenate([rows[begins], pairs[:, 0], pairs[:, 1]])
        for i in range(0, len(keys), 1 << 16):
            part = [pa.array(x[i : i + (1 << 16)], pa.int64()) for x in (keys, rows)]
            yield pa.RecordBatch.from_arrays(part, names=["key", "row"])

    held, n = [], 0
    for batch in batches:
        lists = batch.column(1)
        values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        lengths = np.diff(lists.offsets.to_numpy())
        held.append((values, np.repeat(batch.column(0).to_numpy(), lengths)))
        n += len(values)
        if n >= KEYS_HELD:
            yield from flushed(held)
            held, n = [], 0
    if n:
        yield from flushed(held)


def meeting_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (key, row) in order -> a, b: each row with the first one of its key."""
    import numpy as np

    key, first = None, None
    for batch in batches:
        keys, rows = (batch.column(i).to_numpy() for i in range(2))
        if not len(keys):
            continue
        if key is not None and keys[0] == key:  # the run goes on
            keys, rows = np.concatenate([[key], keys]), np.concatenate([[first], rows])
        pairs, begins = _pairs_of_runs(keys, rows)
        key, first = keys[-1], rows[np.flatnonzero(begins)[-1]]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])


# --- the metric space: pivots, Voronoi regions, windows -------------------------------------------


class Sets:
    """Some sets with their ids, and distances between them (1 - intersection / union, a metric)."""

    def __init__(self, ids, sets, similarity: tuple[int, int]):
        import numpy as np

        self.ids, self.sets, self.similarity = ids, sets, similarity
        self.sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        self.radius = 1 - similarity[0] / similarity[1]

    def part(self, chosen) -> Sets:
        return Sets(self.ids[chosen], [self.sets[i] for i in chosen], self.similarity)

    def overlaps(self, other, size: int):
        """Sizes of intersection and union of each set with one other set."""
        import numpy as np

        everything = np.concatenate(self.sets)
        at = np.minimum(np.searchsorted(other, everything), len(other) - 1)
        ends = np.cumsum(self.sizes)
        hits = np.concatenate([[0], np.cumsum(other[at] == everything)])
        shared = hits[ends] - hits[ends - self.sizes]
        return shared, self.sizes + size - shared

    def linked(self, shared, union):
        return self.similarity[1] * shared >= self.similarity[0] * union


def index_links(region: Sets):
    """Links that connect what is linked inside the region: breadth first, candidates from an index of rare shingles.

    A set of n shingles shares at least c = ceil(num / den * n) of them with a set it is linked to. With all shingles in one order, the
    rarest first, two linked sets therefore share one of the first n - c + 1 of each; only these are indexed. Candidates are
    compared whole.
    """
    import numpy as np

    num, den = region.similarity
    _, number, often = np.unique(np.concatenate(region.sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    owner, ends = np.repeat(np.arange(len(region.sets)), region.sizes), np.cumsum(region.sizes)
    least = -(-num * region.sizes // den)
    ranks = rank[number]
    ranks = ranks[np.lexsort((ranks, owner))]
    starts = ends - region.sizes
    place = np.arange(len(ranks)) - starts[owner]
    first = place <= (region.sizes - least)[owner]
    held, holders = ranks[first], owner[first]
    order = np.argsort(held, kind="stable")
    held, holders = held[order], holders[order]
    mine, left = np.zeros(len(often), bool), np.ones(len(region.sets), bool)
    for start in range(len(region.sets)):
        reached = [start] if left[start] else []
        left[start] = False
        while reached and left.any():
            x = reached.pop()
            own = ranks[starts[x] : ends[x]]
            prefix = own[: region.sizes[x] - least[x] + 1]
            lows, highs = np.searchsorted(held, prefix), np.searchsorted(held, prefix, side="right")
            near = np.zeros(len(left), bool)
            for low, high in zip(lows.tolist(), highs.tolist(), strict=True):
                near[holders[low:high]] = True
            near = np.flatnonzero(near & left)
            if not len(near):
                continue
            n = region.sizes[near]
            at = np.repeat(starts[near] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            mine[own] = True
            shared = np.add.reduceat(mine[ranks[at]].astype(np.int64), np.cumsum(n) - n)
            mine[own] = False
            found = near[region.linked(shared, n + region.sizes[x] - shared)]
            left[found] = False
            for y in found:
                yield region.ids[x], region.ids[y]
            reached.extend(found.tolist())


def voronoi_links(region: Sets, pivots: int = PIVOTS, leaf: int = LEAF_SETS):
    """Links whose components are those of all linked pairs of the region.

    Every set belongs to its nearest pivot (its home). If x is at home with p and y is linked to x, then d(y, p) <= d(y, home of y) + 2r
    for the link radius r, so y is copied to every region within that window, and each linked pair meets in a region. Sets linked to a
    pivot are one component: a region of such sets alone is done. Others are joined in the same way. If one of them
    hardly shrinks, or if the region is small, its sets are compared by an index.
    """
    import numpy as np

    if len(region.ids) <= leaf:
        yield from index_links(region)
        return
    chosen = np.argsort(mixed(region.ids.view(np.uint64)))[:pivots]
    measured = [region.overlaps(region.sets[i], region.sizes[i]) for i in chosen]
    distance = np.stack([1 - shared / union for shared, union in measured])
    linked = np.stack([region.linked(shared, union) for shared, union in measured])
    for p, i in enumerate(chosen):
        for x in np.flatnonzero(linked[p]):
            if x != i:
                yield region.ids[i], region.ids[x]
    window = distance <= distance.min(axis=0) + 2 * region.radius + 1e-9
    open_pivots = [p for p in range(len(chosen)) if not linked[p][window[p]].all()]
    if any(window[p].sum() > 0.75 * len(region.ids) for p in open_pivots):  # pivots do not split it: one index of the whole
        yield from index_links(region)
        return
    for p in open_pivots:
        yield from voronoi_links(region.part(np.flatnonzero(window[p])), pivots, leaf)


def cell_partitions(similarity: tuple[int, int]):
    """Worker function: (cell, row, shingles) sorted by cell -> links (a, b) inside each cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def links(held: dict):
            ids = np.fromiter(held, np.int64, len(held))
            found = list(voronoi_links(Sets(ids, [np.frombuffer(x, np.uint64) for x in held.values()], similarity)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])

        cell, held = None, {}
        for batch in batches:
            for own, row, shingles in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                if own != cell:
                    if len(held) > 1:
                        yield from links(held)
                    cell, held = own, {}
                held[row] = shingles.as_py()
        if len(held) > 1:
            yield from links(held)

    return run


def distance_partitions(similarity: tuple[int, int]):
    """Worker function: (region, row, n, shingles, pivots) -> region, row, n, shingles, near (pivot, linked).

    ``near`` holds the pivots in whose window the set lies: its home and all at most two link radii farther away.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        radius = 1 - similarity[0] / similarity[1]
        near_type = pa.list_(pa.struct([("pivot", pa.int64()), ("linked", pa.bool_())]))
        for batch in batches:
            near = []
            for shingles, pivots in zip(batch.column(3), batch.column(4), strict=True):
                own = Sets(None, [np.frombuffer(shingles.as_py(), np.uint64)], similarity)
                seen = []
                for pivot in pivots.as_py():
                    other = np.frombuffer(pivot["shingles"], np.uint64)
                    shared, union = own.overlaps(other, len(other))
                    seen.append((1 - shared[0] / union[0], pivot["row"], bool(own.linked(shared, union)[0])))
                limit = min(seen)[0] + 2 * radius + 1e-9
                near.append([{"pivot": row, "linked": linked} for d, row, linked in seen if d <= limit])
            columns = [*batch.columns[:4], pa.array(near, near_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["region", "row", "n", "shingles", "near"])

    return run


def _cells(regions: DataFrame, similarity: tuple[int, int]) -> DataFrame:
    """Links within regions (region, row, shingles, chunks); one of several chunks is joined chunk pair by chunk pair."""
    last = F.col("chunks") - 1
    own = F.pmod(F.xxhash64("row"), F.col("chunks"))
    other = F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("other")
    spread = regions.select("region", "row", "shingles", own.alias("own"), other)
    cell = F.xxhash64("region", F.least("own", "other"), F.greatest("own", "other")).alias("cell")
    dealt = spread.select(cell, "row", "shingles").repartition("cell").sortWithinPartitions("cell")
    return dealt.mapInArrow(cell_partitions(similarity), "a long, b long")


def region_links(
    members: DataFrame,
    similarity: tuple[int, int] = SIMILARITY,
    pivots: int = PIVOTS,
    cell_sets: int = CELL_SETS,
    cell_shingles: int = CELL_SHINGLES,
) -> DataFrame:
    """Links (a, b) whose components are those of all linked pairs inside each region of ``members``.

    ``members`` has region, row, n and shingles. Regions that fit a task are joined there. A larger one is split around
    ``pivots`` of its sets: each set goes to the region of its nearest pivot and to all whose window it lies in; child regions with
    only sets linked to their pivot are done, the others are regions of the next round. Where splitting makes more than twice the
    rows, or a child with more than three quarters of them, the region is cut into chunks instead, and each
    pair of chunks is joined in a task: more work, the same links.
    """
    links: DataFrame | None = None
    level = members
    while True:
        chunks = F.greatest(F.ceil(F.count("*") / F.lit(cell_sets)), F.ceil(F.sum("n") / F.lit(cell_shingles)))
        sizes = save_stage(level.groupBy("region").agg(F.count("*").alias("count"), chunks.alias("chunks")), "regions")
        small = level.join(sizes.filter("chunks = 1 and count > 1").select("region", "chunks"), "region")
        found = _cells(small, similarity)
        links = found if links is None else links.unionByName(found)
        large = sizes.filter("chunks > 1")
        if large.isEmpty():
            return links
        big = lookup(level, large, "region", ["row"], how="inner", salts=SALTS)
        nearest = Window.partitionBy("region").orderBy(F.xxhash64("row"), "row")
        drawn = level.join(large.select("region"), "region", "left_semi").select(
            "region", "row", F.row_number().over(nearest).alias("number")
        )
        drawn = drawn.filter(F.col("number") <= pivots).select("region", "row")
        sets = level.join(drawn, ["region", "row"]).groupBy("region").agg(F.collect_list(F.struct("row", "shingles")).alias("pivots"))
        asked = lookup(big, sets, "region", ["row"], how="inner", salts=SALTS).select("region", "row", "n", "shingles", "pivots")
        kinds = dict(level.dtypes)
        measured = asked.mapInArrow(
            distance_partitions(similarity),
            f"region {kinds['region']}, row long, n long, shingles binary, near array<struct<pivot: long, linked: boolean>>",
        )
        measured = save_stage(measured, "measured")
        child = F.xxhash64("region", "near.pivot").alias("child")
        placed = measured.select("region", "row", F.explode("near").alias("near")).select("region", child, "row", "near")
        links = links.unionByName(placed.filter("near.linked and near.pivot <> row").select(F.col("near.pivot").alias("a"), F.col("row").alias("b")))
        open_children = placed.groupBy("region", "child").agg(F.count("*").alias("rows"), F.count_if(~F.col("near.linked")).alias("open"))
        open_children = open_children.filter("open > 0")
        spread = open_children.groupBy("region").agg(F.sum("rows").alias("total"), F.max("rows").alias("most"))
        verdict = large.join(spread, "region").withColumn(
            "split", (F.col("total") <= 2 * F.col("count")) & (F.col("most") <= 0.75 * F.col("count"))
        )
        verdict = save_stage(verdict.select("region", "chunks", "split"), "verdict")
        whole_regions = lookup(measured.drop("near"), verdict.filter("not split"), "region", ["row"], how="inner", salts=SALTS)
        links = links.unionByName(_cells(whole_regions, similarity))
        next_regions = open_children.join(verdict.filter("split").select("region"), "region", "left_semi").select("child")
        exploded = measured.select("row", "n", "shingles", "region", F.explode("near").alias("near")).select(child, "row", "n", "shingles")
        moved = lookup(exploded, next_regions, "child", ["row"], how="inner", salts=SALTS)
        level = save_stage(moved.select(F.col("child").alias("region"), "row", "n", "shingles"), "level")


def similar_documents(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    similarity: tuple[int, int] = SIMILARITY,
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id reachable by links, its own included).

    A document is the set of its distinct shingles of ``shingle`` words (A-Z lowered, words are runs without blanks), compared as
    64-bit hashes. Two documents are linked if den * intersection >= num * union for ``similarity`` = (num, den). Fewer
    words make one shingle; null and empty texts make an empty set, which is linked with nothing. Equal sets are one point, however many rows
    have it. Repeated rows come out each; a row without doc_id belongs to its component (component_id is null only if
    no row of it has an id). An empty table gives no rows; further columns are ignored.

    Nearly all pairs of texts have distance 1, where pivots tell nothing. So points first fall into coarse regions: what is connected
    by equal parts of signatures, of which linked sets must share one. Only points that are not alone there go on; inside a region, distances are graded, and it
    is joined by pivots, Voronoi regions and windows.
    """
    texts = narrow(docs, doc_id=doc_id, text=text).withColumn("text_hash", F.xxhash64(whole("text")))
    numbered = with_row_number(texts, "row").select(
        F.struct("row", "doc_id", "text_hash").alias("row"), F.col("text").cast("binary").alias("text")
    )
    kind = numbered.schema["row"].dataType.simpleString()
    made = numbered.mapInArrow(
        signature_partitions(shingle, similarity), f"row {kind}, n long, digest string, keys array<bigint>"
    )
    marked = save_stage(made.select("row.*", "n", "digest", "keys"), "marked")
    chosen = F.min(F.struct("row", "doc_id", "text_hash")).alias("chosen")
    points = marked.filter("digest is not null").groupBy("digest").agg(chosen, F.min("doc_id").alias("first_id"))
    points = save_stage(points.withColumn("row", F.col("chosen.row")), "points")
    keyed = marked.select("row", "keys").join(points.select("row"), "row", "left_semi")
    shuffled = keyed.mapInArrow(combined_partitions, "key long, row long").repartition("key").sortWithinPartitions("key", "row")
    meetings = shuffled.mapInArrow(meeting_partitions, "a long, b long")
    regions = connected_components(meetings, "a", "b").withColumnsRenamed({"node": "row", "root": "region"})
    asked = points.join(regions, "row").select(
        "region", "row", F.col("chosen.doc_id").alias("v_id"), F.col("chosen.text_hash").alias("v_hash")
    )
    same = F.col("doc_id").eqNullSafe(F.col("v_id")) & (F.col("text_hash") == F.col("v_hash"))
    # always a sorted join: a plan that switches with the number of regions would need more shuffle only at large sizes
    read = texts.join(save_stage(asked, "asked").hint("merge"), same).groupBy("row").agg(  # identical rows are one
        F.first("region").alias("region"), F.first("text").cast("binary").alias("text")
    )
    members = read.select("region", "row", "text").mapInArrow(
        set_partitions(shingle), "region long, row long, n long, shingles binary"
    )
    links = region_links(save_stage(members, "members"), similarity)
    roots = connected_components(links, "a", "b")
    rooted = points.join(roots.withColumnRenamed("node", "row"), "row", "left").select(
        "digest", "first_id", F.coalesce("root", "row").alias("root")
    )
    rooted = save_stage(rooted, "rooted")
    first = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = lookup(rooted.select("digest", "root"), first, "root", ["digest"], how="inner", salts=SALTS)
    out = lookup(marked.select("row", "doc_id", "n", "digest"), named.select("digest", "component_id"), "digest", ["row"], salts=SALTS)
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), own.alias("component_id"))
