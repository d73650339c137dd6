"""Trigram counts in batches equal the trigram lists, and detection equals the built-in stages on them."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitewright.functions import trigrams as batches
from sitewright.functions import words
from sitewright.operators.language import UNKNOWN, LanguageProfile

TEXTS = [None, "", "ab", "Ab1cé  d", "  12 İstanbul, ΟΔΟΣ!\n\n\tline\x0bend ", "日本語 𝔸𝔹𝔹 x\x00y", "a\nb" * 40, "the cat sat on the mat"]


def counted(texts: list[str | None]) -> Counter:
    column = pa.array([None if t is None else t.encode() for t in texts], pa.binary())
    langs = pa.array(["x"] * len(texts))
    found: Counter = Counter()
    for made in batches.count_partitions([pa.RecordBatch.from_arrays([langs, column], names=["lang", "lower"])]):
        for row in made.to_pylist():
            found[row["term"]] += row["n"]
    return found


@pytest.mark.parametrize("limits", [(1_000_000, 1_000, 4_000_000), (10, 1, 4_000_000), (1_000_000, 3, 1)])
def test_counts_equal_lists(spark, monkeypatch, limits):
    for name, value in zip(("CHARACTERS", "TEXTS", "TABLE"), limits, strict=True):
        monkeypatch.setattr(batches, name, value)
    df = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    lists = df.select(words.trigrams(F.col("text")).alias("g"), F.lower("text").alias("lower")).collect()
    wanted = Counter(gram for row in lists for gram in row.g or [])
    assert counted([row.lower for row in lists]) == wanted
    terms = sorted(wanted)[::2]
    finder = batches.TermFinder(terms)
    column = pa.array([None if r.lower is None else r.lower.encode() for r in lists], pa.binary())
    got = np.vstack([finder.counts(joined, end - begin) for begin, end, joined in batches._chunks(column)])
    assert got.tolist() == [[(row.g or []).count(t) for t in terms] for row in lists]


def test_detection_equals_the_built_in_stages_without_lists(spark):
    known = [("de", "der hund und die katze sind im garten"), ("en", "the dog and the cat are in the garden"), (None, "zzz")] * 3
    profile = LanguageProfile.fit(spark.createDataFrame(known, "lang string, text string"), "text", "lang")
    df = spark.createDataFrame([(t,) for t in [*TEXTS, "Der Garten", "in the garden", "qqq"]], "text string")
    found = profile.transform(df, "text")
    grams = df.withColumn("_grams", F.coalesce(words.trigrams(F.col("text")), F.array().cast("array<string>")))
    scored = profile.model.transform(profile.vectorizer.transform(grams)).collect()
    wanted = [profile.codes[int(r._code)] if set(r._grams) & set(profile.terms) else UNKNOWN for r in scored]
    assert [r.language for r in found.collect()] == wanted
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "regexp_extract_all" not in plan
