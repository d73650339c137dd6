"""Source divergence against dense brute-force arithmetic."""

import re
from collections import Counter, defaultdict

from sitewright.llm import divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LANGS, SOURCES = ["en", "de", None, ""], ["a", "b", "Ä", None]


def brute(rows, min_docs=10, top=10):
    counted = [(lang or "", source or "", Counter(TERM.findall((text or "").translate(LOWER)))) for lang, source, text in rows]
    out = set()
    for lang in {r[0] for r in counted}:
        docs, in_lang, groups = Counter(), Counter(), defaultdict(Counter)
        for own, source, counts in counted:
            if own == lang:
                docs.update(counts.keys())
                groups[source].update(counts)
        kept = [t for t, n in docs.items() if n >= min_docs]
        for counts in groups.values():
            in_lang.update({t: counts[t] for t in kept})

        def shares(counts, kept=kept):
            below = sum(counts[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // below for t in kept}

        def gap(p, q):
            return (p - q) ** 2 // (p + q)

        p, q = {s: shares(c) for s, c in groups.items()}, shares(in_lang)
        for source in groups:
            pairs = [(o, sum(gap(p[source][t], p[o][t]) for t in kept)) for o in groups if o != source]
            more = [(t, gap(p[source][t], q[t])) for t in kept if groups[source][t] and p[source][t] > q[t]]
            for part, items in (("pair", pairs), ("term", more)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                keep = items if part == "pair" else items[:top]
                out |= {(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(keep)}
    return out


def table(spark, rows):
    columns = "lang string, source string, text string, doc_id long, term string, n string, p string, total string"
    return spark.createDataFrame([(*r, None, "clash", "clash", "clash", "clash") for r in rows], columns)


def rows_of(hard_rows):
    texts = [t for _, t in hard_rows] * 3
    return [(LANGS[i % 7 % 4], SOURCES[i % 5 % 4], t) for i, t in enumerate(texts)] + [("xx", "only", "???"), ("yy", "s1", "few"), ("yy", "s2", "few")]


def test_all_groups_pairs_and_terms(spark, hard_rows):
    rows = rows_of(hard_rows)
    got = [tuple(r) for r in divergence.divergence(table(spark, rows)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)
    assert {r[2] for r in got} == {"pair", "term"} and ("yy", "s1", "pair", "s2", 0, 1) in got


def test_empty_table_and_other_thresholds(spark, hard_rows):
    assert divergence.divergence(table(spark, [])).collect() == []
    rows = rows_of(hard_rows)[:60]
    got = {tuple(r) for r in divergence.divergence(table(spark, rows), min_docs=3, top_terms=2).collect()}
    assert got == brute(rows, 3, 2)


def test_terms_of_long_texts_are_cut_at_blanks_only():
    text = ("Straße, ÉTÉ x" * 50 + "y" * 500 + "\x00z9z").encode()
    want = Counter(t.encode() for t in TERM.findall(text.decode().translate(LOWER)))
    for part in (1, 7, 100, 1 << 20):
        assert divergence.term_counter(text, divergence.translate_table(), part) == want


def test_counts_handed_on_early_are_the_same(spark, hard_rows):
    frame = table(spark, rows_of(hard_rows)).selectExpr(
        "coalesce(lang, '') as lang", "coalesce(source, '') as source", "cast(coalesce(text, '') as binary) as text"
    )
    schema = "lang string, source string, term binary, n long, docs long"

    def counts(*bounds):
        summed = frame.coalesce(2).mapInArrow(divergence.count_partitions(*bounds), schema).groupBy("lang", "source", "term")
        return {tuple(r) for r in summed.sum("n", "docs").selectExpr("lang", "source", "hex(term)", "`sum(n)`", "`sum(docs)`").collect()}

    assert counts(5, 1 << 20) == counts(1 << 20, 50) == counts()


def test_shares_of_counts_beyond_64_bits(spark):
    total, vocabulary, count = 10**14, 10**9, 3 * 10**12
    row = spark.createDataFrame([(count, total, vocabulary)], "n long, total long, vocabulary long")
    share = row.select(divergence._share(row["n"]).alias("p")).first()["p"]
    assert share == 1 + 10**9 * (count + 2) // (total + 2 * vocabulary)
