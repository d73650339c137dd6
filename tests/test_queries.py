"""Every registered query with SQL gives the same rows as the SQL."""

import pytest
from compare import difference, duck

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
SQL = entry.oracle_sql()
JOBS = entry.queries()


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", [name for name in JOBS if name in SQL and not name.startswith(("op", "pipeline"))])
def test_same_rows_as_sql(spark, con, name):
    got = JOBS[name](spark, FOLDER).toPandas()
    want = con.execute(SQL[name]).df()
    assert difference(got, want) is None
    assert list(got.columns) == list(want.columns)


def column(rows, name):
    return [r[name] for r in rows]


def test_word_and_document_vectors(spark, con):
    words = JOBS["f5_word_vectors"](spark, FOLDER).collect()
    assert words and all(len(r.vector) == 200 for r in words) and len(set(column(words, "word"))) == len(words)
    corpus = con.execute(SQL["f6_doc_vector"]).df()
    for name, size in (("f6_trained_doc_vector", None), ("f7_document_embeddings", 50)):
        rows = JOBS[name](spark, FOLDER).collect()
        ids = column(rows, "doc_id")
        assert len(set(ids)) == len(ids) and set(corpus.doc_id) <= set(ids) | set(corpus.doc_id)
        assert size is None or all(len(r.embedding) == size for r in rows)


@pytest.mark.parametrize("name", ["f8_assembled_features", "f9_zip_features"])
def test_features(spark, name):
    rows = JOBS[name](spark, FOLDER).collect()
    assert len({r.key for r in rows}) == len(rows) > 0
    assert {len(r.features) for r in rows} == {len(rows[0].features)} and set(column(rows, "label")) <= {0, 1}
    if name == "f9_zip_features":
        assert {r.part for r in rows} == {"train", "test"} and all(r.zip == 1000 + r.key % 9000 for r in rows)


def test_predictions_reports_and_histograms_agree(spark):
    test = JOBS["m1_logistic_l1"](spark, FOLDER).collect()
    assert len({r.key for r in test}) == len(test) > 0
    assert all(0 <= r.proba <= 1 and r.prediction == float(r.proba > 0.5) for r in test)
    report = {r["class"]: r for r in JOBS["m4_train_report"](spark, FOLDER).collect()}
    for label in (0, 1):
        hits = sum(r.label == label and r.prediction == label for r in test)
        support = sum(r.label == label for r in test)
        assert report[str(label)].support == support
        assert report[str(label)].recall == pytest.approx(hits / support if support else 0, abs=1e-6)
    assert report["accuracy"].f1 == pytest.approx(sum(r.label == r.prediction for r in test) / len(test), abs=1e-6)
    bars = [r for r in JOBS["m4_train_histograms"](spark, FOLDER).collect() if r.part == "test"]
    assert sum(r.n for r in bars) == len(test)
    accuracies = JOBS["m4_prebuilt_accuracies"](spark, FOLDER).collect()
    assert {r.part for r in accuracies} == {"train", "test"} and all(0 <= r.accuracy <= 1 for r in accuracies)


def test_forest_and_folds(spark):
    rows = JOBS["m2_random_forest"](spark, FOLDER).collect()
    assert len({r.key for r in rows}) == len(rows) > 0 and all(0 <= r.proba <= 1 for r in rows)
    folds = JOBS["m5_cross_validation"](spark, FOLDER).collect()
    assert len(folds) == 1 and 0 <= folds[0].mean_accuracy <= 1


def test_searches_and_repeated_fits(spark):
    points = JOBS["m6_logistic_search"](spark, FOLDER).collect()
    assert {r.point for r in points} == set(range(49)) and len({(r.c, r.l1_share) for r in points}) == 49
    assert all(0 <= r.mean_accuracy <= 1 for r in points)
    (interval,) = JOBS["m11_repeated_splits"](spark, FOLDER).collect()
    assert 90 <= interval.n <= 100 and interval.min <= interval["mean"] <= interval.max
    assert interval.lower <= interval.se_lower <= interval["mean"]
    curve = JOBS["m12_embedding_curve"](spark, FOLDER).collect()
    assert sorted(column(curve, "fraction")) == [0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
    revisions = JOBS["m13_revision_sensitivity"](spark, FOLDER).collect()
    assert len(revisions) == 4 and all(0 <= r.mean_macro_f1 <= 1 and 0 <= r.mean_accuracy <= 1 for r in revisions)


def test_loaded_scorer_predicts_the_same(spark):
    rows = JOBS["m8_save_and_load"](spark, FOLDER).collect()
    assert rows and all(r.equal for r in rows)
    again = {r.key: r.predictions_proba for r in JOBS["m9_predict"](spark, FOLDER).collect()}
    assert again == {r.key: r.predictions_proba for r in rows}


def test_coefficients_are_ordered(spark):
    for name, size in (("m10_coefficients", 20), ("m16_sector_model", 15)):
        rows = sorted(JOBS[name](spark, FOLDER).collect(), key=lambda r: r["rank"])
        assert 0 < len(rows) <= size
        assert column(rows, "negative_coef") == sorted(column(rows, "negative_coef"))
        assert column(rows, "positive_coef") == sorted(column(rows, "positive_coef"), reverse=True)


def test_exports_and_page_scores(spark):
    full = JOBS["m14_zip_export"](spark, FOLDER).collect()
    part = JOBS["m14_zip_export_test"](spark, FOLDER).collect()
    assert 0 < len(part) < len(full) and all(r.prediction in (0, 1) and r.label in (0, 1) for r in full)
    scored = JOBS["m15_score_pages"](spark, FOLDER).collect()
    from_file = JOBS["m15_score_url_file"](spark, FOLDER).collect()
    assert scored and {tuple(r) for r in scored} == {tuple(r) for r in from_file}


def test_every_query_without_sql_is_tested():
    named = {n for n in JOBS if n not in SQL and not n.startswith(("op", "pipeline"))}
    with open(__file__) as file:
        text = file.read()
    assert all(n in text for n in named)


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == ["doc_id", "term", "weight"]
    assert result.count() > 0


def test_every_sql_has_a_job():
    assert set(SQL) <= set(JOBS)
