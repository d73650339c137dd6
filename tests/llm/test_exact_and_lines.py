"""Exact duplicates and repeated lines against brute force."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sitewright.llm import exact_dedup, line_dedup

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_exact_groups(frame, hard_rows):
    for support in (0.001, 0.2, 0.5):
        got = exact_dedup.exact_groups(frame(hard_rows), support=support).collect()
        groups = defaultdict(list)
        for i, text in hard_rows:
            groups[(text or "").translate(LOWER)].append(i)
        want = Counter()
        for text, ids in groups.items():
            keep = max((i for i in ids if i is not None), default=None)
            want.update((i, keep, len(ids), sha(text)) for i in ids)
        assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == want
        kept = [r for r in got if r.kept]
        assert len(kept) == len(groups) and all(r.doc_id == r.keep_id for r in kept)


def test_heavy_digests_are_found_and_verified(frame):
    rows = [(i, "hot") for i in range(300)] + [(1000 + i, f"cold {i}") for i in range(700)]
    hashed = exact_dedup.digests(frame(rows))
    heavy = exact_dedup.heavy_winners(hashed, 0.1).collect()
    assert [(r.winner.doc_id, r.group_size) for r in heavy] == [(299, 300)]
    assert exact_dedup.heavy_winners(hashed, 0.4).count() == 0


def test_heavy_digests_among_many_others(spark):
    for parts in (1, 5):
        rows = spark.range(0, 20_000, 1, parts)
        name = F.when(F.col("id") % 10 == 0, "hot").when(F.col("id") % 70 == 1, "warm").otherwise(F.concat(F.lit("cold "), "id"))
        hashed = rows.select(F.col("id").alias("doc_id"), F.unhex(F.sha2(name, 256)).alias("digest"), F.col("id").alias("row"))
        sizes = sorted(r.group_size for r in exact_dedup.heavy_winners(hashed, 0.01).collect())
        want = sorted(n for n in Counter("hot" if i % 10 == 0 else "warm" if i % 70 == 1 else "" for i in range(20_000)).items() if n[0])
        assert sizes == sorted(n for _, n in want)


def test_main_path_is_native(frame, hard_rows):
    plan = exact_dedup.exact_groups(frame(hard_rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def brute_lines(rows, min_docs):
    blanks = " \t\n\x0b\x0c\r"
    lines = [(i, (t or "").split("\n")) for i, t in rows]
    often = Counter(k for _, ls in lines for k in {x.strip(blanks).translate(LOWER) for x in ls} if k)
    out = Counter()
    for i, ls in lines:
        kept = [x for x in ls if often[x.strip(blanks).translate(LOWER)] < min_docs]
        out[i, "\n".join(kept), len(ls), len(ls) - len(kept)] += 1
    return out


def test_repeated_lines(frame, hard_rows):
    rows = hard_rows + [(300 + i, f"own {i}\n\x0b Shared LINE \r\nend {i % 7}\nShared line") for i in range(12)]
    for min_docs in (1, 3, 10, 12, 13):
        got = line_dedup.drop_repeated_lines(frame(rows), min_docs=min_docs).collect()
        assert Counter((r.doc_id, r.kept_text, r.n_lines, r.n_dropped) for r in got) == brute_lines(rows, min_docs)


def test_repeated_ids_are_one_document(frame):
    rows = [(1, "a\nonce")] * 10 + [(10 + i, "b\nnine") for i in range(9)] + [(30 + i, "Often") for i in range(10)]
    rows += [(None, "without")] * 10 + [(10, "b\nnine")]
    got = line_dedup.drop_repeated_lines(frame(rows), by_id=True).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_dropped == (1 if r.kept_text == "" else 0)
        assert (r.kept_text == "") == (r.doc_id is None or r.doc_id >= 30)


def test_empty_tables(frame):
    empty = frame([])
    assert exact_dedup.exact_groups(empty).collect() == []
    assert line_dedup.drop_repeated_lines(empty, keep=["lang", "row"]).collect() == []
    assert [r.kept.row for r in line_dedup.drop_repeated_lines(frame([(1, "a")]), keep=["row"]).collect()] == ["clash"]
