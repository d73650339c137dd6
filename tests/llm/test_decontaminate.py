"""Benchmark containment against brute force."""

import random
import re
from collections import Counter

import pytest

from sitewright.llm import decontaminate


def shingle_set(text, n=5):
    words = re.findall(r"\w+", (text or "").lower())
    n = min(n, len(words))
    return {" ".join(words[i : i + n]) for i in range(len(words) - n + 1)} if n else set(), n


def brute(docs, items):
    out = Counter()
    for i, text in docs:
        words = re.findall(r"\w+", (text or "").lower())
        for k, item in items:
            wanted, n = shingle_set(item)
            if not wanted or len(words) < n:
                continue
            held = {" ".join(words[p : p + n]) for p in range(len(words) - n + 1)}
            shared = len(wanted & held)
            if shared >= 0.8 * len(wanted) - 1e-9:
                out[i, k, shared, len(wanted)] += 1
    return out


@pytest.fixture(scope="module")
def planted(hard_rows):
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(6, 60)))) for i in range(40)]
    items += [(50, "two words"), (51, None), (52, ""), (53, "!!!"), (54, "repeat " * 20), (55, items[3][1]), (None, items[4][1])]
    docs = list(hard_rows)
    for i in range(150):
        item = rng.choice(items[:40])[1].split()
        for _ in range(rng.randint(0, 3)):
            item[rng.randrange(len(item))] = "changed"
        cut = rng.randint(0, len(item))  # scattered passages count as well
        body = rng.choices(vocabulary, k=rng.randint(0, 2000))
        docs.append((500 + i, " ".join(item[:cut]).upper() + ", " + " ".join(body) + "\n" + " ".join(item[max(0, cut - 4) :])))
    docs.append((900, "here are Two  WORDS"))
    return docs, items


@pytest.mark.parametrize("block_shingles", [500_000, 200])
def test_contained_items(spark, frame, planted, block_shingles):
    docs, items = planted
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contained_items(frame(docs), table, block_shingles=block_shingles).collect()
    want = brute(docs, items)
    assert len(want) > 50
    assert Counter((r.doc_id, r.item_id, r.n_shared, r.n_shingles) for r in got) == want
    assert all(r.containment == r.n_shared / r.n_shingles for r in got)


def test_clean_rows_stay_whole(spark, frame, planted):
    docs, items = planted
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.without_leaks(frame(docs), table).collect()
    bad = {(i, t) for i, t in docs for _ in [0] if brute([(i, t)], items)}
    assert Counter((r.doc_id, r.text) for r in got) == Counter((i, t) for i, t in docs if (i, t) not in bad)
    assert all(r.row == "clash" for r in got)


def test_empty_tables(spark, frame, planted):
    docs, items = planted
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contained_items(frame(docs), none).collect() == []
    assert decontaminate.without_leaks(frame(docs), none).count() == len(docs)
    assert decontaminate.contained_items(frame([]), spark.createDataFrame(items, none.schema)).collect() == []


def test_sketch_never_misses():
    for size in range(1, 400):
        missing = int(0.2 * size + 1e-9)
        assert decontaminate.sketch_size(size, 0.8) > missing
