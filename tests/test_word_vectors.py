"""Word vectors by blocks against one pass by hand, and their properties."""

import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from sitewright.operators import features
from sitewright.operators import word_vectors as wv
from sitewright.sources import tables
from sitewright.sources.tables import save_stage


@pytest.fixture(scope="module")
def corpus(spark):
    """400 documents of one of two topics, whose words never meet."""
    random = np.random.default_rng(5)
    rows = [(i, [f"{'ab'[i % 2]}{n}" for n in random.integers(0, 12, 60)]) for i in range(400)]
    return spark.createDataFrame(rows, "key int, words array<string>").repartition(5)


def _cosines(vectors):
    """Mean cosine of two words of one topic, and of two words of both, without what all words have in common."""
    common = np.mean(list(vectors.values()), axis=0)
    made = {w: (v - common) / np.linalg.norm(v - common) for w, v in vectors.items()}
    names = sorted(made)
    matrix = np.array([made[n] for n in names])
    same = np.array([[a[0] == b[0] and a != b for b in names] for a in names])
    other = np.array([[a[0] != b[0] for b in names] for a in names])
    return (matrix @ matrix.T)[same].mean(), (matrix @ matrix.T)[other].mean()


@pytest.mark.parametrize("blocks", [1, 4])
def test_words_of_a_topic_are_near(corpus, blocks):
    model = features.train_word_vectors(corpus, "words", 16, 5, 5, 2, partitions=blocks)
    vectors = {r.word: r.vector for r in features.word_vector_table(model).collect()}
    assert len(vectors) == 24 and all(len(v) == 16 and np.isfinite(v).all() for v in vectors.values())
    same, other = _cosines(vectors)
    assert same > other + 0.5


def test_no_vector_passes_the_driver(spark, corpus, monkeypatch):
    """Neither vocabulary nor vectors are collected: rows that reach the driver are single sums."""
    seen = []
    kind = type(corpus)
    collect = kind.collect
    monkeypatch.setattr(kind, "collect", lambda self: seen.append(rows := collect(self)) or rows)
    for name in ("toPandas", "toArrow", "toLocalIterator"):
        old = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda self, *a, f=old, **k: seen.append(self.limit(2).count() * [0]) or f(self, *a, **k))
    model = features.train_word_vectors(corpus, "words", 8, 1, 2, 1, partitions=3)
    features.document_embeddings(corpus, "key", "words", model).write.format("noop").mode("overwrite").save()
    assert all(len(rows) <= 1 for rows in seen)


def test_blocks_count_all_words_of_all_copies(spark):
    rows = [(["aa", "bb"],)] * 5 + [(["cc", "aa", None],), ([],), (None,)]
    df = spark.createDataFrame(rows, "words array<string>")
    model = features.train_word_vectors(df, "words", 4, 1, 2, 5, partitions=3)
    assert {r.word for r in model.getVectors().collect()} == {"aa", "bb"}  # aa 6, bb 5, cc 1


def test_no_frequent_word_gives_zeros(spark):
    df = spark.createDataFrame([(1, ["aa", "bb"]), (2, [])], "key int, words array<string>")
    model = features.train_word_vectors(df, "words", 3, 2, 2, 5)
    assert model.getVectors().count() == 0
    assert {r.key: r.embedding for r in features.document_embeddings(df, "key", "words", model).collect()} == {1: [0.0] * 3, 2: [0.0] * 3}
    assert {tuple(r.e) for r in model.transform(df).select(vector_to_array("embedding").alias("e")).collect()} == {(0.0, 0.0, 0.0)}


def test_stage_divides_by_all_words_and_survives_saving(spark, corpus, tmp_path):
    model = features.train_word_vectors(corpus, "words", 4, 1, 2, 1)
    table = {r.word: np.array(r.vector) for r in features.word_vector_table(model).collect()}
    rows = [(1, ["a1", "zz", "a1", "b2"]), (2, ["zz"]), (3, []), (4, ["a1", "zz", "a1", "b2"]), (4, ["b3"])]
    df = spark.createDataFrame(rows, "key int, words array<string>")
    path = str(tmp_path / "stage")
    PipelineModel([model]).write().save(path)
    for one in (model, PipelineModel.load(path)):
        got = sorted((r.key, tuple(r.e)) for r in one.transform(df).select("key", vector_to_array("embedding").alias("e")).collect())
        long = tuple((2 * table["a1"] + table["b2"]) / 4)
        want = sorted([(1, long), (2, (0.0,) * 4), (3, (0.0,) * 4), (4, long), (4, tuple(table["b3"]))])
        assert [k for k, _ in got] == [k for k, _ in want]
        for (_, a), (_, b) in zip(got, want, strict=True):
            assert a == pytest.approx(b)


def test_means_do_not_depend_on_blocks(spark, corpus):
    model = features.train_word_vectors(corpus, "words", 4, 1, 2, 1)
    texts = corpus.withColumnRenamed("key", "id")
    results = [
        {r.id: r["mean"] for r in wv.mean_vectors(texts, model.getVectors(), 4, True, tokens).collect()} for tokens in (500, 10**6)
    ]
    assert len(results[0]) == 400
    assert all(results[0][k] == pytest.approx(v) for k, v in results[1].items())


def test_document_numbers_are_exact_and_broadcast_no_vectors(spark, capsys):
    """the driver must not hold a value per word, so words are not joined by a broadcast however small their table looks."""
    texts = [(1, ["a", "b", "a", None]), (1, ["c"]), (2, ["zz"]), (None, ["b", "c", "zz"]), (3, []), (4, None)]
    df = spark.createDataFrame(texts, "id int, words array<string>")
    vectors = spark.createDataFrame([("a", [0.1, 0.2]), ("b", [1.0, 2.0]), ("c", [1e-9, 3e-9])], "word string, vector array<double>")
    vectors = save_stage(vectors, "vectors")  # files of known, small size
    got = {r.id: r.doc_vector for r in features.doc_vector(df, "id", F.col("words"), vectors).collect()}
    assert got == {1: pytest.approx((0.15 * 2 + 1.5 + 2e-9) / 4, abs=1e-15), None: pytest.approx((1.5 + 2e-9) / 2, abs=1e-15)}
    features.doc_vector(df, "id", F.col("words"), vectors).explain()
    plan = capsys.readouterr().out
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def _files(folder, kind):
    return [f for f in folder.rglob(kind) if f.is_file()]


def test_training_leaves_one_table_and_no_shuffles(spark, corpus, tmp_path, monkeypatch):
    """stages and shuffle files of past epochs stayed until the driver collected its garbage, or for good."""
    local = Path(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    monkeypatch.setattr(tables, "new_table_path", lambda spark, name: f"{tmp_path}/{name}-{uuid.uuid4().hex}")
    stages = lambda: {f.parts[len(tmp_path.parts)] for f in _files(tmp_path, "*.parquet")}
    old = {f.name for f in _files(local, "shuffle_*")}
    vectors = wv.train_vectors(corpus, "words", 8, 3, 2, 1, 7, blocks=6, waves=3)
    assert stages() == {Path(vectors.stage_path).name}
    left = [f for f in _files(local, "shuffle_*") if f.name not in old]
    assert sum(f.stat().st_size for f in left) < 10_000  # sums of single numbers
    texts = save_stage(corpus.withColumnRenamed("key", "id"), "texts")
    means = wv.mean_stage(texts, vectors, 8, True)
    assert stages() == {Path(x.stage_path).name for x in (vectors, means)}
    assert (vectors.count(), means.count()) == (24, 400)


def test_waves_change_only_the_rounding(corpus):
    """Means added up wave by wave are the means over all blocks; every block is trained once in an epoch."""
    made = [
        {r.word: np.array(r.vector) for r in wv.train_vectors(corpus, "words", 8, 2, 2, 1, 7, blocks=6, waves=w).collect()} for w in (1, 2, 6)
    ]
    assert len(made[0]) == 24
    for other in made[1:]:
        assert all(np.abs(other[w] - v).max() < 2e-3 * np.abs(v).max() for w, v in made[0].items())


def test_words_that_a_wave_does_not_have_keep_their_vectors(spark):
    rows = [([f"w{i}"] * 3,) for i in range(40)]
    df = spark.createDataFrame(rows, "words array<string>")
    vectors = {r.word: np.array(r.vector) for r in wv.train_vectors(df, "words", 4, 2, 2, 1, 7, blocks=10, waves=5).collect()}
    assert len(vectors) == 40 and all(np.isfinite(v).all() and v.any() for v in vectors.values())


def test_many_words_make_larger_blocks():
    count = wv.block_count
    assert [count(n * 10**6, 50) for n in (0, 1, 13, 32)] == [1, 1, 13, 32]
    assert count(100 * 10**6, 50) == 32 and count(800 * 10**6, 50) == 100 and count(130 * 10**6, 200) == 65


def test_a_document_of_one_word_changes_nothing():
    inner, outer = np.ones((2, 3), np.float32), np.zeros((2, 3), np.float32)
    codes, ends = np.array([0, 1]), np.array([1, 2])
    got = wv.train_codes(codes, ends, inner, outer, 2, (0.1, 0.1), (1,))
    assert np.array_equal(got[0], inner) and np.array_equal(got[1], outer)
    joined = wv.train_codes(codes, np.array([2]), inner, outer, 2, (0.1, 0.1), (1,))
    assert not np.array_equal(joined[1], outer)


def test_blocks_are_not_put_into_few_tasks(spark):
    blocks = spark.createDataFrame([(i % 9, str(i)) for i in range(90)], "block int, word string")
    pairs = wv.by_block(blocks, "block", 9).groupBy("block").cogroup(wv.by_block(blocks, "block", 9).groupBy("block"))

    def place(left, right):
        import pyarrow as pa
        from pyspark import TaskContext

        return pa.table({"block": left.column("block")[:1], "task": pa.array([TaskContext.get().partitionId()], pa.int32())})

    found = pairs.applyInArrow(place, "block int, task int").collect()
    assert sorted(r.block for r in found) == list(range(9))
    assert len({r.task for r in found}) >= 6  # the planner put all of these few bytes into one task
