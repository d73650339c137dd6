"""SimHash classes against all pairs."""

import random
from collections import Counter

import pytest
import xxhash

from sitewright.llm import simhash
from sitewright.llm.components import connected_components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def brute_mark(text, k=3):
    words = (text or "").encode().translate(LOWER).replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes, n = [xxhash.xxh64(p, seed=42).intdigest() for p in parts], len(parts)
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute_classes(marks, distance):
    root = {m: m for m in marks}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(root)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= distance:
                root[find(a)] = find(b)
    return {m: find(m) for m in keys}


def brute(rows, k=3, distance=3):
    marks = [brute_mark(t, k) for _, t in rows]
    root = brute_classes(set(marks), distance)
    smallest = {}
    for (i, _), m in zip(rows, marks, strict=True):
        if i is not None:
            smallest[root[m]] = min(i, smallest.get(root[m], i))
    return Counter((i, f"{m:016x}", smallest.get(root[m])) for (i, _), m in zip(rows, marks, strict=True)), root, marks


def near_rows(seed=5):
    rng = random.Random(seed)
    base = [rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(300)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(300)] = "edit" + str(rng.randint(0, 9))
        rows.append((1000 + i, " ".join(words)))
    return rows


def test_classes_of_hard_rows(frame, hard_rows):
    rows = hard_rows + near_rows()
    got = simhash.near_duplicate_classes(frame(rows)).collect()
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == brute(rows)[0]
    assert simhash.near_duplicate_classes(frame([])).collect() == []


def test_one_row_per_class_stays(frame, hard_rows):
    rows = hard_rows + near_rows()
    kept = simhash.keep_one_per_class(frame(rows)).collect()
    _, root, marks = brute(rows)
    classes = {}
    for (i, t), m in zip(rows, marks, strict=True):
        classes.setdefault(root[m], []).append(i)
    assert len(kept) == len(classes)
    for r in kept:
        ids = [i for i in classes[root[brute_mark(r.text)]] if i is not None]
        assert r.doc_id == min(ids, default=None) and r.digest == "clash"
    assert simhash.keep_one_per_class(frame([])).collect() == []


@pytest.mark.parametrize("distance,blocks", [(0, 1), (1, 3), (3, 4), (3, 5), (3, 6), (8, 11)])
def test_links_of_crowded_fingerprints(spark, distance, blocks):
    rng = random.Random(distance * 10 + blocks)
    marks = set()
    for _ in range(25):
        center = rng.getrandbits(64)
        for _ in range(30):
            mark = center
            for _ in range(rng.randint(0, 5)):
                mark ^= 1 << rng.randrange(64)
            marks.add(mark)
    signed = {m - (1 << 64) if m >> 63 else m: m for m in marks}
    frame = spark.createDataFrame([(m,) for m in signed], "fp long")
    want = {}
    for m, root in brute_classes(marks, distance).items():
        want.setdefault(root, set()).add(m)
    for cell in (4096, 7):  # with small cells, buckets are cut into many chunks
        links = simhash.fingerprint_links(frame, distance, blocks, cell)
        assert all((signed[r.a] ^ signed[r.b]).bit_count() <= distance for r in links.collect())
        found = {}
        for r in connected_components(links, "a", "b").collect():
            found.setdefault(r.root, set()).add(signed[r.node])
        assert sorted(map(sorted, found.values())) == sorted(sorted(c) for c in want.values() if len(c) > 1)


def test_long_chain_is_one_component(spark):
    chain = spark.range(500).selectExpr("(id * 7919) % 500 as a", "((id + 1) * 7919) % 500 as b")
    rows = connected_components(chain, "a", "b").collect()
    assert len(rows) == 500 and {r.root for r in rows} == {0}


def test_a_hub_with_most_edges(spark):
    edges = spark.range(3000).selectExpr("if(id % 3 = 0, 5000, id + 10000) as a", "id + 20000 as b")
    rows = connected_components(edges, "a", "b").collect()
    assert {r.node for r in rows if r.root == 5000} == {5000} | {i + 20000 for i in range(0, 3000, 3)}
    assert len(rows) == 1 + 1000 + 2 * 2000
