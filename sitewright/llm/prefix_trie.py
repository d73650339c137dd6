"""Prefix trie of conversations: shared beginnings, their sizes and what storing them once would save."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.llm.list_ranking import prefix_sums
from sitewright.llm.scans import running
from sitewright.llm.texts import sha256_hex, whole
from sitewright.sources.tables import save_stage

MODULUS = (1 << 127) - 1  # prefix digests are polynomials in BASE over this prime field, so digests of parts can be joined
BASE = 0x5BD1E9955BD1E995C6A4A7935BD1E995
ROOT = bytes(16)
IDS_PER_CHUNK = 4096


def turn_rows(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv, place, digest, size): every turn with its place in its conversation (from 1), MD5 and UTF-8 bytes of text.

    Turns go by ``turn``, null first; equal ones by their digest. Null roles and texts are empty. Rows without conv_id
    belong to no conversation and are left out. Texts are not shuffled; a conversation of any length is spread over tasks.
    """
    said, spoken = whole(role), whole(text)
    digest = F.unhex(F.md5(F.concat(F.length(said).cast("string"), F.lit(":"), said, spoken)))
    rows = conversations.filter(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        digest.alias("digest"),
        F.octet_length(spoken).cast("long").alias("size"),
    )
    counted = running(
        rows, ["conv"], ["turn", "digest"], "place long", lambda n, _: ((n[0] if n else 0) + 1,), lambda a, b: (a[0] + b[0],), "turns"
    )
    return save_stage(counted.select("conv", "place", "digest", "size"), "turns")


def rebuilt_turns(turns: DataFrame, stride: int = 5, modulus: int = 9) -> tuple[DataFrame, DataFrame]:
    """Conversations with a borrowed beginning: (their turns, all their ids).

    Conversation c gets the first h turns of conversation c - c % stride and keeps its own turns after its first h, where h is
    the unsigned CRC-32 of c's decimal digits modulo ``modulus``. A conversation can end up without turns.
    """
    borrowed = F.crc32(F.col("conv").cast("string").cast("binary")) % modulus
    members = turns.filter("place = 1").select("conv", (F.col("conv") - F.col("conv") % stride).alias("base"), borrowed.alias("h"))
    early = turns.filter(F.col("place") < modulus).withColumnRenamed("conv", "base")
    heads = members.join(early, "base").filter("place <= h").select("conv", F.lit(0).alias("half"), "place", "digest", "size")
    own = turns.filter(F.col("place") > borrowed).select("conv", F.lit(1).alias("half"), "place", "digest", "size")
    return heads.unionByName(own), members.select("conv")


def _extended(before: bytes, length: int, after: bytes) -> bytes:
    """Digest of a sequence from those of its beginning and of the ``length`` turns after it."""
    value = int.from_bytes(before, "big") * pow(BASE, length, MODULUS) + int.from_bytes(after, "big")
    return (value % MODULUS).to_bytes(16, "big")


def _one_more(state: tuple | None, row: dict) -> tuple:
    depth, prefix, _ = state or (0, ROOT, ROOT)
    own = int.from_bytes(row["digest"], "big") % (MODULUS - 1) + 1
    return depth + 1, _extended(prefix, 1, own.to_bytes(16, "big")), prefix


def _joined(a: tuple, b: tuple) -> tuple:
    return a[0] + b[0], _extended(a[1], b[0], b[1]), _extended(a[1], b[0] - 1, b[2])


def _sibling(state: tuple | None, row: dict) -> tuple:
    """(the parent's id, the child before this one in descending order, this child)."""
    if row["kind"] == 0:
        return row["conv"], None, None
    parent, _, latest = state or (None, None, None)
    return parent, latest, row["conv"]


def _sibling_after(a: tuple, b: tuple) -> tuple:
    return (a[0] if b[0] is None else b[0]), (a[2] if b[1] is None else b[1]), b[2]


def chunk_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (prefix, conv) in order -> prefix, first, ids: decimal ids joined by commas, some at a time."""
    for batch in batches:
        rows: list[tuple] = []
        own, first, ids = None, None, []
        for prefix, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if prefix != own or len(ids) == IDS_PER_CHUNK:
                if ids:
                    rows.append((own, first, ",".join(ids)))
                own, first, ids = prefix, conv, []
            ids.append(str(conv))
        if ids:
            rows.append((own, first, ",".join(ids)))
        if rows:
            kinds = (pa.binary(), pa.int64(), pa.string())
            columns = [pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["prefix", "first", "ids"])


def digest_partitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Worker function: (prefix, first, ids) in order -> prefix, ends_sha256 of all its chunks joined by commas."""
    own, state = None, None
    for batch in batches:
        rows: list[tuple] = []
        for prefix, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if prefix == own:
                state.update(b",")
            else:
                if state:
                    rows.append((own, state.hexdigest()))
                own, state = prefix, hashlib.sha256()
            state.update(ids.encode())
        if rows:
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows])], names=["prefix", "ends_sha256"]
            )
    if state:
        yield pa.RecordBatch.from_arrays([pa.array([own], pa.binary()), pa.array([state.hexdigest()])], names=["prefix", "ends_sha256"])


def _ends(steps: DataFrame, members: DataFrame) -> DataFrame:
    """(prefix, ends_sha256) of the nodes at which conversations end."""
    last = steps.groupBy("conv").agg(F.max_by("prefix", "depth").alias("prefix"))
    ends = members.join(last, "conv", "left").select(F.coalesce("prefix", F.lit(ROOT)).alias("prefix"), "conv")
    ranged = ends.repartitionByRange("prefix", "conv").sortWithinPartitions("prefix", "conv")
    chunks = ranged.mapInArrow(chunk_partitions, "prefix binary, first long, ids string")
    dealt = chunks.repartition("prefix").sortWithinPartitions("prefix", "first")
    return dealt.mapInArrow(digest_partitions, "prefix binary, ends_sha256 string")


def _arcs(nodes: DataFrame) -> DataFrame:
    """The Euler tour as a linked list: an enter and an exit arc per node, each with its successor, leaves and savings.

    An arc is (conv, 2 * depth) or (conv, 2 * depth + 1): a node is known by its smallest member and its depth.
    Children are visited by ascending member.
    """
    step = 2 * F.col("depth")
    leaf = F.col("first_child").isNull()
    enter = F.struct(
        F.col("conv").alias("a"),
        step.alias("b"),
        F.when(leaf, F.col("conv")).otherwise(F.col("first_child")).alias("next_a"),
        F.when(leaf, step + 1).otherwise(step + 2).alias("next_b"),
        leaf.cast("long").alias("x"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("y"),
    )
    last = F.col("next_sibling").isNull()
    leave = F.struct(
        F.col("conv").alias("a"),
        (step + 1).alias("b"),
        F.when(last, F.col("parent_conv")).otherwise(F.col("next_sibling")).alias("next_a"),
        F.when(~last, step).when(F.col("parent_conv").isNotNull(), step - 1).alias("next_b"),
        F.lit(0).cast("long").alias("x"),
        F.lit(0).cast("long").alias("y"),
    )
    return nodes.select(F.explode(F.array(enter, leave)).alias("arc")).select("arc.*")


def trie(turns: DataFrame, members: DataFrame | None = None, order: tuple[str | Column, ...] = ("place",)) -> DataFrame:
    """One row per node of the trie of all conversations in ``turns`` (conv, digest, size and the columns of ``order``).

    ``members`` (conv, each once) adds conversations without turns; without it the members are those that have turns.
    Columns: conv (smallest member), depth, parent_conv, n_convs, n_children, n_leaves, saved, ends_sha256.
    """
    members = turns.select("conv").distinct() if members is None else members
    walked = running(turns, ["conv"], order, "depth long, prefix binary, parent binary", _one_more, _joined, "walked")
    steps = save_stage(walked.select("conv", "depth", "prefix", "parent", "size"), "steps")
    known = steps.groupBy("prefix").agg(
        F.min("conv").alias("conv"),
        F.min("depth").alias("depth"),
        F.min("parent").alias("parent"),
        F.count("*").alias("n_convs"),
        F.max("size").alias("size"),
    )
    top = members.agg(F.min("conv").alias("conv"), F.count("*").alias("n_convs")).filter("n_convs > 0")
    top = top.withColumns(
        {"prefix": F.lit(ROOT), "depth": F.lit(0).cast("long"), "parent": F.lit(None).cast("binary"), "size": F.lit(0).cast("long")}
    )
    known = save_stage(known.unionByName(top), "known")

    children = known.groupBy(F.col("parent").alias("prefix")).agg(
        F.count("*").alias("n_children"), F.min("conv").alias("first_child")
    )
    described = known.join(children, "prefix", "left").join(_ends(steps, members), "prefix", "left")
    family = known.select(F.col("prefix").alias("family"), F.lit(0).alias("kind"), "conv", "depth").unionByName(
        known.filter("parent is not null").select(F.col("parent").alias("family"), F.lit(1).alias("kind"), "conv", "depth")
    )
    order_in = ["kind", F.desc("conv")]
    siblings = running(family, ["family"], order_in, "parent_conv long, next_sibling long, latest long", _sibling, _sibling_after, "family")
    siblings = siblings.filter("kind = 1").select("conv", "depth", "parent_conv", "next_sibling")
    nodes = save_stage(described.join(siblings, ["conv", "depth"], "left").drop("prefix", "parent"), "nodes")

    placed = prefix_sums(_arcs(nodes))
    sign = F.when(F.col("b") % 2 == 1, 1).otherwise(-1)
    inside = placed.groupBy(F.col("a").alias("conv"), F.floor(F.col("b") / 2).alias("depth")).agg(
        F.sum(sign * F.col("before_x")).alias("n_leaves"), F.sum(sign * F.col("before_y")).alias("saved")
    )
    return nodes.join(inside, ["conv", "depth"]).select(
        "conv",
        "depth",
        "parent_conv",
        "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"),
        "n_leaves",
        "saved",
        F.coalesce("ends_sha256", sha256_hex(F.lit(""))).alias("ends_sha256"),
    )


def prefix_trie(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """The trie of all conversations: nodes are the distinct sequences of first turns (role and text), the root has none.

    Subtree leaves and savings come from an Euler tour: an enter and an exit arc per node, ranked as a linked list by
    contraction, with prefix sums at the arcs; a node's subtree is what lies between its two arcs.

    Turns go by ``turn`` (null first, equal ones by the digest of role and text); null roles and texts are empty; rows
    without conv_id are left out. Identical conversations share all their nodes, repeated rows are turns of their own.
    Conversations may have any length, nodes any number of members and children. An empty table gives no rows; further
    columns are ignored.
    """
    return trie(turn_rows(conversations, conv_id, turn, role, text))
