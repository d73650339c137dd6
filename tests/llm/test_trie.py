"""Prefix tries against brute force, with long, repeated and turnless conversations."""

import hashlib
import random
import zlib

import pytest

from sitewright.llm import list_ranking, prefix_trie, scans

SCHEMA = "conv_id long, turn long, role string, text string, depth string, conv string, prefix string, size string"


def brute(rows, rebuild):
    found = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            mark = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            found.setdefault(conv, []).append((turn is not None, turn or 0, mark, (role or "", text or "")))
    given = {c: [t[3] for t in sorted(turns)] for c, turns in found.items()}
    convs = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = tuple(given.get(c - c % 5, [])[:h] + own[h:] if rebuild else own)
    nodes, kids = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(turns[:d], []).append(c)
    for path in nodes:
        if path:
            kids[path[:-1]] = kids.get(path[:-1], 0) + 1
    leaves, saved = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for path, members in nodes.items():
        gain = (len(members) - 1) * len(path[-1][1].encode()) if path else 0
        for d in range(len(path) + 1):
            leaves[path[:d]] += path not in kids
            saved[path[:d]] += gain
    out = []
    for path, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(convs[c]) == len(path))
        up = min(nodes[path[:-1]]) if path else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(members), len(path), up, len(members), kids.get(path, 0), leaves[path], saved[path], digest))
    return sorted(out, key=str)


def hard_conversations():
    rng = random.Random(4)
    rows = []
    for c in range(140):
        for t in range(rng.randint(1, 7)):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["hi", "Ünï", "ok", "what now"])))
    rows += [(c, 0, "user", "the very common first turn") for c in range(200, 300)]
    rows += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(4)]
    rows += [(400, t, "user", f"long {t % 50}") for t in range(700)] + [(401, t, "user", f"long {t % 50}") for t in range(350)]
    rows += [(500, None, None, None), (500, 0, "user", None), (500, 0, "", "a"), (500, 0, "", "a"), (501, 3, "use", "rx"), (502, 3, "user", "x")]
    rows += [(None, 0, "user", "nobody's"), (-7, 0, "user", "negative id"), (-7, 1, "user", "x" * 20_000), (10**15, 5, "user", "far away")]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def conversations(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "clash", "clash", "clash", "clash") for r in rows], SCHEMA)

    return make


def test_trie_of_given_conversations(conversations):
    rows = hard_conversations()
    got = [tuple(r) for r in prefix_trie.prefix_trie(conversations(rows).repartition(6)).collect()]
    assert sorted(got, key=str) == brute(rows, False)


def test_trie_of_rebuilt_conversations_in_small_pieces(spark, conversations, monkeypatch):
    rows = hard_conversations()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # conversations and siblings span partitions
    monkeypatch.setattr(prefix_trie, "IDS_PER_CHUNK", 7)
    try:
        turns, members = prefix_trie.rebuilt_turns(prefix_trie.turn_rows(conversations(rows).repartition(6)))
        got = [tuple(r) for r in prefix_trie.trie(turns, members, ("half", "place")).collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert sorted(got, key=str) == brute(rows, True)


def test_no_conversations(conversations):
    assert prefix_trie.prefix_trie(conversations([])).collect() == []
    assert prefix_trie.prefix_trie(conversations([(None, 1, "user", "x")])).collect() == []
    turns = prefix_trie.turn_rows(conversations([(5, 0, "user", "x")]))
    only = prefix_trie.trie(turns.filter("place > 1"), turns.select("conv")).collect()
    assert [tuple(r)[:7] for r in only] == [(5, 0, None, 1, 0, 1, 0)]


@pytest.mark.parametrize("cell", [4, 64, 1 << 16])
@pytest.mark.parametrize("scrambled", [False, True])
def test_prefix_sums_along_a_list(spark, cell, scrambled):
    """In order of ids, runs shrink at once; in random order, rounds of pairs are needed. The sums are the same."""
    order = list(range(600))
    if scrambled:
        random.Random(1).shuffle(order)
    rng = random.Random(2)
    weights = [(rng.randint(0, 9), rng.randint(0, 10**12)) for _ in order]
    rows, want, x, y = [], {}, 0, 0
    for k, i in enumerate(order):
        after = order[k + 1] if k + 1 < len(order) else None
        rows.append((i, 7, after, None if after is None else 7, *weights[k]))
        want[i] = (x, y)
        x, y = x + weights[k][0], y + weights[k][1]
    links = spark.createDataFrame(rows, "a long, b long, next_a long, next_b long, x long, y long")
    got = {r.a: (r.before_x, r.before_y) for r in list_ranking.prefix_sums(links, cell).collect()}
    assert got == want
    assert list_ranking.prefix_sums(links.filter("false"), cell).collect() == []


def test_running_values_over_partition_borders(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1000).selectExpr("if(id < 700, 1, id) as g", "id", "cast(id % 3 as string) as other")
        out = scans.running(
            rows, ["g"], ["id"], "n long, total long", lambda s, r: ((s or (0, 0))[0] + 1, (s or (0, 0))[1] + r["id"]),
            lambda a, b: (a[0] + b[0], a[1] + b[1]), "test",
        ).collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = {i: (i + 1, i * (i + 1) // 2) if i < 700 else (1, i) for i in range(1000)}
    assert {r.id: (r.n, r.total) for r in out} == want and len(out) == 1000
