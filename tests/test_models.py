"""Classifiers and features against direct computation and their properties."""

import math
import threading
import time

import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitewright.operators import features, metrics, models, sampling
from sitewright.operators.language import LanguageProfile
from sitewright.plans import experiments
from sitewright.plans.scoring import TrainingConfig, train_scorer

WORDS = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]


@pytest.fixture(scope="module")
def documents(spark):
    """120 texts whose label depends on two words, with a third label-free part."""
    rows = []
    for i in range(120):
        label = int(i % 3 == 0)
        text = ["alpha"] * (2 + i % 3) if label else ["beta"] * (1 + i % 4)
        text += [WORDS[2 + i % 4], WORDS[2 + (i * 7) % 4], "omega" if i % 5 == 0 else "rest"]
        rows.append((i, " ".join(text), label, "en" if i % 2 else "de"))
    return spark.createDataFrame(rows, "key long, text string, label int, lang string").repartition(3)


def test_tfidf_by_hand(spark):
    df = spark.createDataFrame([(1, "aa aa bb"), (2, "bb cc"), (3, "")], "key int, text string")
    weighted, vocabulary = features.tfidf(df, "text", 2)
    assert (vocabulary.terms, vocabulary.doc_counts, vocabulary.docs) == (["aa", "bb"], [1, 2], 3)
    got = {(r.key, r.term): r.weight for r in features.long_form(weighted, ["key"], "tfidf", vocabulary.terms).collect()}
    a, b = 2 * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert got == {
        (1, "aa"): pytest.approx(a / math.hypot(a, b)),
        (1, "bb"): pytest.approx(b / math.hypot(a, b)),
        (2, "bb"): pytest.approx(1.0),
    }


def test_bernoulli_bayes_by_hand(documents):
    train, test, fitted = features.training_sets(documents, "key", "text", "label", 0.8, 3, 5)
    scored = models.BernoulliBayes.fit(train).transform(test).collect()
    rows = [(r.label, vector) for r, vector in ((r, r.features.toArray() > 0) for r in train.collect())]
    for r in scored:
        x = r.features.toArray() > 0
        for c in (0, 1):
            members = [v for label, v in rows if label == c]
            score = math.log(len(members) / len(rows))
            for j in range(len(fitted.names)):
                p = (sum(v[j] for v in members) + 1) / (len(members) + 2)
                score += math.log(p if x[j] else 1 - p)
            assert r.scores[c] == pytest.approx(score)
        assert r.prediction == float(r.scores[1] > r.scores[0])


def test_scorer_round_trip(spark, documents, tmp_path):
    config = TrainingConfig(terms=8, language="lang", embedding={"size": 4, "epochs": 1, "window": 2, "min_count": 1}, small_class=1, total=80)
    model, trained, names = train_scorer(documents, config)
    assert names[-5:] == ["in_language", "0", "1", "2", "3"] and len(names) == 12
    assert trained.train.filter("label = 1").count() == 80
    assert trained.report().filter("class = 'accuracy'").first().f1 > 0.9
    path = str(tmp_path / "scorer")
    model.write().save(path)
    doubled = documents.unionByName(documents)
    got = models.predict(PipelineModel.load(path), doubled).collect()
    assert len(got) == 120 and {r.key for r in got} == set(range(120))
    assert all(0 <= r.predictions_proba <= 1 and r.predictions == int(r.predictions_proba > 0.5) for r in got)
    table = models.coefficient_table(trained.model, features.FeatureSet([], names), size=3).orderBy("rank").collect()
    assert table[0].positive_word == "alpha" and table[0].negative_word == "beta"
    assert not any(r.positive_word.isdigit() or r.negative_word.isdigit() for r in table)


def test_prebuilt_set_keeps_one_row_per_key(documents):
    train, test, _ = features.training_sets(
        documents, "key", "text", "label", 0.8, 3, 5, oversample_value=1, total=100, prebuild=True
    )
    keys = [r.key for r in train.unionByName(test).select("key").collect()]
    assert sorted(keys) == list(range(120))


def test_forest_and_cross_validation(documents):
    train, test, _ = features.training_sets(documents, "key", "text", "label", 0.8, 3, 8)
    fitted = models.train_model(models.random_forest(train.count(), trees=5, depth=4), train, test)
    assert fitted.accuracies().filter("part = 'test'").first().accuracy > 0.9
    logistic = models.logistic_l1(96, max_iter=20)
    search = models.cross_validate(logistic, train, "key", folds=2, grid=models.logistic_grid(logistic, 96)[:2])
    assert models.grid_table(search).count() == 2
    assert len(models.logistic_grid(logistic, 96)) == 49
    assert len(models.forest_grid(models.random_forest(96))) == 120


def test_report_with_a_class_that_is_never_predicted(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0), (1, 0.0), (2, 2.0)], "label int, prediction double")
    got = {r["class"]: (r.precision, r.recall, r.f1, r.support) for r in metrics.classification_report(df).collect()}
    assert got["1"] == (0.0, 0.0, 0.0, 1)
    assert got["0"] == (pytest.approx(2 / 3, abs=1e-6), 1.0, 0.8, 2)
    assert got["accuracy"] == (0.75, 0.75, 0.75, 4)
    assert got["macro avg"][2] == pytest.approx(1.8 / 3, abs=1e-6)


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(0, 0.3), (0, 0.3), (1, 0.0), (1, 1.0)], "label int, p double")
    got = {(r.label, r.bin): r.n for r in metrics.histogram(df, "label", "p").collect()}
    assert got == {(0, 25): 2, (1, 0): 1, (1, 49): 1}


def test_unknown_language(spark, tmp_path):
    df = spark.createDataFrame([("the cat and the hat", "en"), ("der hund und der mund", "de")], "text string, lang string")
    profile = LanguageProfile.fit(df, "text", "lang", per_language=20)
    texts = spark.createDataFrame([("the hat",), ("der mund",), ("12 34",), ("",), (None,), ("qqqqq",)], "text string")
    got = [r.language for r in profile.transform(texts, "text").collect()]
    assert got == ["en", "de", "unknown", "unknown", "unknown", "unknown"]
    profile.save(str(tmp_path / "profile"))
    again = LanguageProfile.load(spark, str(tmp_path / "profile"))
    assert [r.language for r in again.transform(texts, "text").collect()] == got


def test_doc_vector_counts_known_words_only(spark):
    df = spark.createDataFrame([(1, "aa bb zz"), (2, "zz")], "key int, text string")
    vectors = spark.createDataFrame([("aa", [1.0, 3.0]), ("bb", [0.0, 0.0])], "word string, vector array<double>")
    got = features.doc_vector(df, "key", F.split("text", " "), vectors).collect()
    assert [(r.key, r.doc_vector) for r in got] == [(1, 1.0)]


def test_embeddings_are_means_of_known_words_under_any_session_setting(spark):
    df = spark.createDataFrame([(1, "aa bb aa rare"), (2, "bb cc cc bb"), (3, "once"), (4, "aa cc bb")], "key int, text string")
    df = df.withColumn("words", F.split("text", " ")).drop("text")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    results = []
    for parts in ("3", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        model = features.train_word_vectors(df, "words", 4, 2, 2, 2)
        vectors = {r.word: list(r.vector) for r in features.word_vector_table(model).collect()}
        assert set(vectors) == {"aa", "bb", "cc"}
        got = {r.key: r.embedding for r in features.document_embeddings(df, "key", "words", model).collect()}
        for key, known in ((1, ["aa", "bb", "aa"]), (2, ["bb", "cc", "cc", "bb"]), (4, ["aa", "cc", "bb"])):
            want = [sum(vectors[w][i] for w in known) / len(known) for i in range(4)]
            assert got[key] == pytest.approx(want)
        assert got[3] == [0.0] * 4
        results.append(got)
    spark.conf.set("spark.sql.shuffle.partitions", before)
    for key, values in results[0].items():  # the learner itself is not exact to the last digits
        assert results[1][key] == pytest.approx(values, abs=1e-3)


def test_experiments_on_small_settings(spark, documents):
    _, fitted = None, features.fit_features(documents, "text", 8)
    ready = features.assemble(documents, "key", fitted, keep=["label"])
    row = experiments.repeated_accuracy(ready, "key", seeds=(1, 2, 3), oversample_value=1, total=90).first()
    assert row.n == 3 and 0.8 < row["mean"] <= 1
    embedding = {"size": 4, "epochs": 1, "window": 2, "min_count": 1}
    curve = experiments.embedding_size_curve(documents, "key", "text", 8, embedding, fractions=(0.5, 1.0), seeds=(1,))
    assert {r.fraction for r in curve.collect()} == {0.5, 1.0}
    revisions = documents.withColumn("revision", F.explode(F.array(F.lit("A"), F.lit("B"))))
    assert {r.revision for r in experiments.revision_sensitivity(revisions, "key", "text", 8, seeds=(1,)).collect()} == {"A", "B"}


def test_vocabularies_of_groups_are_those_of_single_fits(spark):
    rows = [("A", "zz cc yy bb cc"), ("A", "bb"), ("B", "yy yy zz"), ("B", ""), ("C", "?!")]
    df = spark.createDataFrame(rows, "revision string, text string")
    both = features.Vocabulary.fit_groups(df, "revision", "text", 2)
    assert set(both) == {"A", "B", "C"}
    for name, vocabulary in both.items():
        assert vocabulary == features.Vocabulary.fit(df.filter(F.col("revision") == name), "text", 2)


def test_depth_beyond_the_learner_is_refused():
    with pytest.raises(ValueError, match="deep"):
        models.random_forest(100, depth=100)


def test_word_vectors_have_the_asked_size(documents):
    tokens = documents.select(F.split("text", " ").alias("words"))
    model = features.train_word_vectors(tokens, "words", 6, 1, 2, 2, partitions=2)
    row = features.word_vector_table(model).first()
    assert len(row.vector) == 6
    assert model.transform(tokens).select(vector_to_array("embedding")).first()[0]


def test_vocabulary_breaks_ties_by_term(spark):
    df = spark.createDataFrame([("zz cc yy bb",)], "text string")
    assert features.Vocabulary.fit(df, "text", 2).terms == ["bb", "cc"]


def test_fold_split_is_used(documents):
    folded = documents.withColumn("fold", sampling.fold_number(["key"], 3, 1))
    assert folded.groupBy("fold").count().count() == 3


def test_feature_rows_are_made_once(spark):
    """F6-F13, F17, F19: both parts, and all steps that fill up the small class, read the written rows, not the texts."""
    texts = [(i, f"alpha beta {'gamma' if i % 3 else 'delta'} word{i % 5}", int(i % 3 > 0)) for i in range(90)]
    df = spark.createDataFrame(texts, "key int, text string, label int")
    train, test, _ = features.training_sets(df, "key", "text", "label", 0.8, 3, 6, oversample_value=0, total=60)
    for part in (train, test):
        assert part.inputFiles() and all("feature-rows" in f for f in part.inputFiles())
    assert train.filter("label = 0").count() == 60
    assert train.select("key").distinct().count() + test.count() == 90


def test_small_trainings_run_two_at_a_time(documents):
    """one after the other, trainings of few blocks left most cores idle; with as many blocks as cores they still run so."""
    inside, most, lock = [0], [0], threading.Lock()

    def make(item):
        with lock:
            inside[0] += 1
            most[0] = max(most[0], inside[0])
        time.sleep(0.5)
        with lock:
            inside[0] -= 1
        return item * 10

    assert experiments.side_by_side(make, [1, 2, 3, 4], documents, "text", {"size": 4}) == [10, 20, 30, 40]
    assert most == [2]
    most[0] = 0
    many = documents.withColumn("text", F.repeat(F.lit("word "), 10**5)).crossJoin(documents.sparkSession.range(100))
    cores = documents.sparkSession.sparkContext.defaultParallelism
    many = many.limit(20 * cores).repartition(cores)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(experiments.word_vectors, "block_count", lambda tokens, size: cores if tokens == 20 * cores * 10**5 else 1)
        assert experiments.side_by_side(make, [1, 2], many, "text", {"size": 4}) == [10, 20]
    assert most == [1]
