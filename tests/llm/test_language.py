"""Language mixtures: held-out accuracy, proportions and edge cases."""

from collections import Counter

import numpy as np
import pytest

from sitewright.llm import language

EN = "the quick brown fox and the other dogs of this house were running with that old man in the garden "
DE = "der schnelle braune fuchs und die anderen hunde von diesem haus liefen mit dem alten mann in dem garten "
FR = "le renard brun et les autres chiens de cette maison couraient avec ce vieil homme dans le jardin de la ville "


@pytest.fixture(scope="module")
def model(spark):
    rows = [(i, t * 3, lang) for i, (t, lang) in enumerate([(EN, "en"), (DE, "de"), (FR, "fr")] * 5)]
    return language.fit_model(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_hard_rows(frame, hard_rows, model):
    got = language.identify(frame(hard_rows), model).collect()
    assert Counter((r.row.doc_id, r.row.text) for r in got) == Counter(hard_rows)
    for r in got:
        lettered = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred != "und") == lettered and 0 <= r.score <= 1
        assert r.row.digest == "clash"
        if not lettered:
            assert r.score == 0 and r.mixture == []
    kept = language.known_language(frame(hard_rows), model)
    assert kept.count() == sum(any(c.isalpha() for c in t or "") for _, t in hard_rows)
    assert language.identify(frame([]), model).collect() == []


def test_single_and_mixed(frame, model):
    rows = [(1, EN), (2, DE), (3, FR), (4, EN * 3 + DE), (5, DE + FR * 2), (6, EN.upper())]
    got = {r.row.doc_id: r for r in language.identify(frame(rows), model).collect()}
    assert [got[i].lang_pred for i in range(1, 7)] == ["en", "de", "fr", "en", "fr", "en"]
    assert all(got[i].score > 0.99 and len(got[i].mixture) == 1 for i in (1, 2, 3, 6))
    assert {m.lang for m in got[4].mixture} == {"en", "de"} and 0.65 < got[4].score < 0.85
    assert {m.lang for m in got[5].mixture} == {"de", "fr"} and 0.55 < got[5].score < 0.8


def test_maximization_is_plain_em(model):
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, (4, len(model.profiles))).astype(float)
    got, _ = model._maximize(counts, np.ones((4, 3)))
    for row, shares in zip(counts, got, strict=True):
        theta = np.ones(3) / 3
        for _ in range(language.ROUNDS):
            new = np.zeros(3)
            for n, profile in zip(row, model.profiles, strict=True):
                new += n * theta * profile / (theta * profile).sum()
            theta = new / row.sum()
        assert np.allclose(theta, shares, atol=1e-8)


def test_long_text_in_slices(frame, model, monkeypatch):
    rows = [(1, EN * 50 + DE * 50)]
    whole = language.identify(frame(rows), model).first()
    monkeypatch.setattr(language, "SLICE", 1000)
    cut = language.identify(frame(rows), model).first()
    assert whole.lang_pred == cut.lang_pred and abs(whole.score - cut.score) < 0.02


def test_nothing_to_learn(spark, frame):
    empty = language.fit_model(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(frame([(1, "text"), (2, None)]), empty).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit_on_documents(docs)
    found = language.identify(docs, model).filter(language.held_out("row.doc_id"))
    rows = found.select("row.lang", "lang_pred").collect()
    assert len(rows) > 200 and sum(a == b for a, b in rows) / len(rows) > 0.97


def test_without_labels_texts_with_letters_stay(spark, frame, hard_rows):
    none = language.fit_model(spark.createDataFrame([], "doc_id long, text string, lang string"))
    kept = language.known_language(frame(hard_rows), none).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter(x for x in hard_rows if any(c.isalpha() for c in x[1] or ""))
