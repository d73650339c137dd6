"""The Jaccard join against all pairs."""

import random
from collections import Counter

import numpy as np
import pytest

from sitewright.llm import jaccard_join
from sitewright.llm.components import connected_components


def brute_set(text, k=3):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else frozenset()


def linked(a, b, num=90, den=100):
    return bool(a) and bool(b) and den * len(a & b) >= num * len(a | b)


def brute(rows, num=90, den=100):
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if linked(a, sets[j], num, den):
                root[find(i)] = find(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[find(i)] = min(doc, smallest.get(find(i), doc))
    return Counter((doc, len(sets[i]), smallest.get(find(i))) for i, (doc, _) in enumerate(rows))


def edited_rows(seed=7, bases=12, copies=10, edits=6):
    """Texts of all lengths with a few words changed, dropped or added: many pairs lie just above or under the threshold."""
    rng = random.Random(seed)
    rows = []
    for g in range(bases):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.choice([1, 2, 3, 5, 9, 11, 12, 20, 40, 150, 400]))]
        for i in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                at = rng.randrange(len(words) + 1)
                words[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], [f"e{rng.randint(0, 5)}"]])
            rows.append((1000 + 20 * g + i, " ".join(words)))
    return rows


def test_components_of_hard_rows(frame, hard_rows):
    rows = hard_rows + edited_rows()
    got = jaccard_join.similar_documents(frame(rows)).collect()
    assert Counter(tuple(r) for r in got) == brute(rows)
    assert jaccard_join.similar_documents(frame([])).collect() == []
    assert [tuple(r) for r in jaccard_join.similar_documents(frame([(1, None), (2, "")])).collect()] in (
        [(1, 0, 1), (2, 0, 2)],
        [(2, 0, 2), (1, 0, 1)],
    )


@pytest.mark.parametrize("similarity", [(90, 100), (80, 100), (1, 1)])
def test_linked_sets_share_a_signature(similarity):
    """Also at the largest number of differing elements the threshold allows."""
    rng, num, den = random.Random(1), *similarity
    lows = jaccard_join.size_classes(5000, similarity)
    assert lows == sorted(set(lows))
    for _ in range(600):
        n = rng.choice([1, 2, 5, 8, 9, 10, 11, 17, 18, 19, 20, 50, 99, 100, 333, 1000])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = set(a)
        while True:
            c = set(b)
            if rng.random() < 0.5 and c:
                c.discard(rng.choice(sorted(c)))
            if rng.random() < 0.5:
                c.add(rng.getrandbits(64))
            if not (c and den * len(a & c) >= num * len(a | c)):
                break
            b = c
            if rng.random() < 0.02 or num == den:
                break
        keys = [set(jaccard_join.signatures(np.array(sorted(x), np.uint64), lows, similarity).tolist()) for x in (a, b)]
        assert keys[0] & keys[1]


def crowd(seed=2):
    """Sets around a few centers, at graded distances, so that regions, windows and chunks all matter."""
    rng = random.Random(seed)
    universe = list(range(1, 4000))
    out = {}
    for g in range(6):
        center = set(rng.sample(universe, 200))
        for i in range(60):
            own = set(center)
            for _ in range(rng.choice([0, 2, 5, 8, 12, 20, 60])):
                own.discard(rng.choice(sorted(own)))
                own.add(rng.choice(universe))
            out[g * 100 + i] = own
    return out


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {i: find(i) for i in ids}


def test_voronoi_regions_lose_no_link():
    sets = crowd()
    pairs = [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])]
    region = jaccard_join.Sets(np.array(list(sets)), [np.array(sorted(s), np.uint64) for s in sets.values()], (90, 100))
    for pivots, leaf in ((2, 4), (8, 8), (8, 64), (3, 1000)):
        found = list(jaccard_join.voronoi_links(region, pivots, leaf))
        assert all(linked(sets[a], sets[b]) for a, b in found)
        assert components(sets, found) == components(sets, pairs)


@pytest.mark.parametrize("cell_sets,pivots", [(2048, 8), (25, 4), (7, 3)])
def test_large_regions_are_split_and_chunked(spark, cell_sets, pivots):
    sets = crowd()
    rows = [(1, i, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for i, s in sets.items()]
    members = spark.createDataFrame(rows, "region long, row long, n long, shingles binary")
    links = jaccard_join.region_links(members, pivots=pivots, cell_sets=cell_sets)
    found = {(r.a, r.b) for r in links.collect()}
    assert all(linked(sets[a], sets[b]) for a, b in found)
    pairs = [(a, b) for a in sets for b in sets if a < b and linked(sets[a], sets[b])]
    assert components(sets, found) == components(sets, pairs)


def test_long_texts_are_read_in_parts():
    words = [f"W{i % 977}" for i in range(5000)]
    text = "\n ".join(words).encode()
    hashes = jaccard_join.WordHashes()
    want = jaccard_join.shingle_set(text, 3, hashes)
    assert len(want) == len(brute_set(text.decode())) == 977
    for part in (1, 10, 1000):
        assert jaccard_join.shingle_set(text, 3, hashes, part).tolist() == want.tolist()


def test_keys_of_most_rows_meet_once_per_task(spark):
    """Rows with a common key are combined before the shuffle, and still end up in one component."""
    rows = spark.range(20_000).selectExpr("id as row", "array(7L, id + 100) as keys").coalesce(4)
    combined = rows.mapInArrow(jaccard_join.combined_partitions, "key long, row long")
    assert combined.filter("key = 7").count() <= 4
    dealt = combined.repartition("key").sortWithinPartitions("key", "row")
    links = dealt.mapInArrow(jaccard_join.meeting_partitions, "a long, b long")
    assert connected_components(links, "a", "b").select("root").distinct().count() == 1
