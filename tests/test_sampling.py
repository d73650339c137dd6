"""Properties of samples, splits and oversampling."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sitewright.operators import features, sampling


def order_key(i, seed):
    return hashlib.md5(f"{i}:{seed}".encode()).hexdigest(), i


@pytest.mark.parametrize("n", [0, 1, 4_095, 25_000, 60_000, 100_000, 120_000])
def test_exact_sample_by_cut_value(spark, n):
    df = spark.range(100_000)
    got = {r.id for r in df.filter(sampling.first_by_hash(df, ["id"], n, 7)).collect()}
    want = set(sorted(range(100_000), key=lambda i: order_key(i, 7))[:n])
    assert got == want


def test_small_and_large_samples_agree(spark, monkeypatch):
    df = spark.range(5_000)
    small = {r.id for r in sampling.sample_rows(df, ["id"], 1_234, 3).collect()}
    monkeypatch.setattr(sampling, "SORT_LIMIT", 10)
    assert {r.id for r in sampling.sample_rows(df, ["id"], 1_234, 3).collect()} == small


@pytest.mark.parametrize("rows", [100, 200_000])
def test_copies_of_a_key_across_the_cut_are_refused(spark, rows):
    df = spark.range(rows).select(F.lit(1).alias("k"))
    for sample in (
        lambda: sampling.first_by_hash(df, ["k"], rows // 2, 1),
        lambda: sampling.sample_rows(df, ["k"], rows // 2, 1),
        lambda: sampling.split_exact(df, ["k"], 0.5, 1),
    ):
        with pytest.raises(ValueError, match="identify"):
            sample()
    assert sampling.sample_rows(df, ["k"], rows, 1).count() == rows


def test_split_is_complete_disjoint_and_stable(spark):
    df = spark.range(20_000).withColumn("v", F.col("id") * 2)
    train, test = sampling.split(df, ["id"], 0.8, 5)
    a, b = {r.id for r in train.collect()}, {r.id for r in test.collect()}
    assert not a & b and len(a | b) == 20_000 and abs(len(a) / 20_000 - 0.8) < 0.02
    again, _ = sampling.split(df.repartition(13, "v"), ["id"], 0.8, 5)
    assert {r.id for r in again.collect()} == a
    everything, nothing = sampling.split(df, ["id"], 1.0, 5)
    assert everything.count() == 20_000 and nothing.count() == 0


def test_exact_split_size(spark):
    train, test = sampling.split_exact(spark.range(33_333), ["id"], 0.7, 5)
    assert train.count() == round(0.7 * 33_333) and test.count() == 33_333 - round(0.7 * 33_333)


def test_rank_does_not_depend_on_buckets(spark, monkeypatch):
    df = spark.range(3_000)
    few = {(r.id, r["rank"]) for r in sampling.with_rank(df, ["id"], 1, 3_000).collect()}
    monkeypatch.setattr(sampling, "ROWS_PER_BUCKET", 2)
    many = {(r.id, r["rank"]) for r in sampling.with_rank(df.repartition(5), ["id"], 1, 3_000).collect()}
    assert few == many
    assert sorted(rank for _, rank in few) == list(range(1, 3_001))


def test_one_per_key_with_a_hot_key(spark):
    df = spark.range(9_000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k"))
    got = {r.k: r.id for r in sampling.one_per_key(df, ["k"], ["id"], 4).collect()}
    groups = {}
    for r in df.collect():
        groups.setdefault(r.k, []).append(r.id)
    assert got == {k: min(ids, key=lambda i: order_key(i, 4)) for k, ids in groups.items()}


def test_oversample(spark):
    df = spark.range(1_000).select("id", (F.col("id") % 10 == 0).cast("int").alias("label"), F.lit("x").alias("text"))
    grown = sampling.oversample(df, ["id"], "label", 1, 700, 9, mark="copy")
    counts = {(r.label, r["copy"]): r["n"] for r in grown.groupBy("label", "copy").agg(F.count("*").alias("n")).collect()}
    assert counts == {(0, 0): 900, (1, 0): 100, (1, 1): 600}
    assert grown.columns == ["id", "label", "text", "copy"]
    copies = grown.filter("copy = 1")
    assert copies.filter("id % 10 <> 0").isEmpty() and copies.select("id").distinct().count() > 90
    again = sampling.oversample(df.repartition(7), ["id"], "label", 1, 700, 9, mark="copy")
    assert again.exceptAll(grown).isEmpty()
    with pytest.raises(ValueError):
        sampling.oversample(df, ["id"], "label", 1, 50, 9)
    with pytest.raises(ValueError):
        sampling.oversample(df, ["id"], "label", 5, 50, 9)


def test_folds(spark):
    folds = spark.range(10_000).select(sampling.fold_number(["id"], 10, 1).alias("f")).groupBy("f").count().collect()
    assert sorted(r.f for r in folds) == list(range(10)) and min(r["count"] for r in folds) > 850


def test_no_key_in_train_and_test(spark):
    df = spark.range(2_000).select(F.col("id").alias("key"), (F.col("id") % 5 == 0).cast("int").alias("label"), F.lit("t").alias("text"))
    train, test = features.transformer_sets(df, "key", "label", 0.8, 3, 1, 1_500)
    assert train.join(test, "key").isEmpty()
    assert test.groupBy("key").count().filter("count > 1").isEmpty()
    assert train.filter("label = 1").count() == 1_500
