"""Kneser-Ney probabilities against a direct computation."""

import math
from collections import Counter, defaultdict

import pytest

from sitewright.llm import quality
from sitewright.llm.quality import CLASSES, END, ORDER, PAD, discounts


def grams(text):
    points = [PAD] * (ORDER - 1) + [ord(c) % CLASSES + 2 for c in text or ""] + [END]
    return [tuple(points[i : i + ORDER]) for i in range(len(points) - ORDER + 1)]


class Direct:
    def __init__(self, texts):
        self.counts = {ORDER: Counter(g for t in texts for g in grams(t))}
        for n in range(ORDER - 1, 0, -1):
            self.counts[n] = Counter(g[1:] for g in self.counts[n + 1])
        self.d, self.total, self.kept = {}, {}, {}
        for n, counts in self.counts.items():
            self.d[n] = discounts(Counter(counts.values()))
            self.total[n], self.kept[n] = Counter(), defaultdict(float)
            for g, c in counts.items():
                self.total[n][g[:-1]] += c
                self.kept[n][g[:-1]] += self.d[n][min(c, 3) - 1]

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / (CLASSES + 1)
        total = self.total[n][gram[:-1]]
        if not total:
            return self.p(gram[1:])
        c = self.counts[n][gram]
        own = (c - self.d[n][min(c, 3) - 1]) / total if c else 0
        return own + self.kept[n][gram[:-1]] / total * self.p(gram[1:])

    def loss(self, text):
        return -sum(math.log(self.p(g)) for g in grams(text)) / len(grams(text))


@pytest.fixture(scope="module")
def scored(spark, frame, hard_rows):
    langs = [None if i is None else "abc"[i % 3] for i, _ in hard_rows]
    labels = [(i, int(i % 2 == 0 and i % 3 != 2)) for i, _ in hard_rows if i is not None] + [(None, 1), (9999, 1)]
    labels = spark.createDataFrame(labels, "doc_id long, quality int")
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id", quality.calibrates("doc_id").alias("checks")).collect()
    trusted = {r.doc_id for r in good if not r.checks}, {r.doc_id for r in good if r.checks}
    got = quality.score_documents(frame(hard_rows, langs), labels, quantile=0.8, margin=0.0).collect()
    return hard_rows, langs, trusted, got


def test_perplexity(scored):
    rows, langs, trusted, got = scored
    model = Direct([t for i, t in rows if i in trusted[0]])
    want = sorted((str(i), str(lang), round(model.loss(t), 4)) for (i, t), lang in zip(rows, langs, strict=True))
    assert len(got) == len(want)
    for (i, lang, loss), (i2, lang2, loss2) in zip(want, sorted((str(r.doc_id), str(r.lang), round(math.log(r.perplexity), 4)) for r in got), strict=True):
        assert (i, lang) == (i2, lang2) and abs(loss - loss2) < 1e-3


def test_thresholds(scored):
    rows, langs, trusted, got = scored
    for lang in set(langs):
        losses = sorted(math.log(r.perplexity) for r in got if r.lang == lang and r.doc_id in trusted[1])
        mine = [r for r in got if r.lang == lang]
        if not losses:
            assert all(r.threshold is None and r.kept for r in mine)
            continue
        limit = losses[math.ceil(0.8 * len(losses)) - 1]
        assert all(abs(math.log(r.threshold) - limit) <= 2e-3 for r in mine)
        assert all(r.kept == (math.log(r.perplexity) <= math.log(r.threshold) + 1e-12) for r in mine)


def test_probabilities_sum_to_one(scored):
    rows, _, trusted, _ = scored
    model = Direct([t for i, t in rows if i in trusted[0]])
    context = grams(next(t for i, t in rows if i in trusted[0] and t))[3][1:]
    assert abs(sum(model.p((*context, w)) for w in range(1, CLASSES + 2)) - 1) < 1e-6


def test_length_classes():
    assert quality.length_classes({}, 5) == [(0, 64)]
    assert quality.length_classes({3: 4}, 5) == [(0, 64)]
    assert quality.length_classes({1: 5, 4: 2, 7: 3, 9: 6}, 5) == [(0, 4), (4, 9), (9, 64)]
    assert quality.length_classes({1: 5, 4: 9, 9: 2}, 5) == [(0, 4), (4, 64)]


def test_long_texts_are_not_measured_by_short_ones(spark):
    losses = [("a", 2, 3.0 + i / 100) for i in range(10)] + [("a", 9, 1.0 + i / 100) for i in range(10)] + [(None, 9, 2.0)]
    frame = spark.createDataFrame(losses, "lang string, length int, loss double")
    found = {(r.limit_lang, r.low, r.high): round(r.limit, 3) for r in quality._thresholds(frame, 1.0, 0.0, 10).collect()}
    assert found == {("a", 0, 9): 3.09, ("a", 9, 64): 1.09, (None, 0, 64): 2.0}


def test_without_trust_or_rows(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    got = quality.score_documents(frame([(1, "a b"), (2, None)]), labels).collect()
    assert len(got) == 2 and all(r.kept and r.threshold is None for r in got)
    assert all(abs(r.perplexity - (CLASSES + 1)) < 1 for r in got)
    assert quality.score_documents(frame([]), labels).collect() == []


def test_slices_hold_every_gram_once(monkeypatch):
    monkeypatch.setattr(quality, "SLICE", 7)
    texts = ["", "a", "abcdefg", "x" * 40, None, "hello world, this is longer than a slice"]
    got = Counter()
    for owners, codes in quality.gram_slices(texts):
        got.update(zip(owners.tolist(), codes.tolist(), strict=True))
    want = Counter()
    for i, t in enumerate(texts):
        for g in grams(t):
            code = 0
            for c in g:
                code = code << quality.BITS | c
            want[i, code] += 1
    assert got == want
