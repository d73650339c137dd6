"""Texts cleaned in Arrow batches equal the column expressions, and are cut into words once."""

from pyspark.sql import functions as F

from sitewright.functions import words
from sitewright.functions.expressions import bind
from sitewright.operators.rows import has_enough_words
from sitewright.operators.texts import build_revisions, clean_column
from sitewright.plans.inputs import LANGUAGES
from sitewright.plans.texts import REVISIONS

ROWS = [
    (1, None, "de"),
    (2, "Straße und Überraschung " * 30, None),
    (3, "  Running   runs\n\nthe ss sses été y ies cities nationality " * 20, "en"),
    (4, "bonjour le monde " * 30, "fr"),
    (5, "", "de"),
    (6, "Die Häuser, Freiheiten und the Wohnungen\tsind freundlichen Zeilen " * 4, "de"),
    (7, "und the oder and", "de"),
]


def by_expressions(config):
    text, language = F.col("text"), F.col("lang")

    def stopped(t):
        return words.remove_stopwords(t, language, *LANGUAGES.both) if config.stop else t

    def finish(t):
        final = words.stem_text(t, language, LANGUAGES.both) if config.stem else t
        return F.when(has_enough_words(t, config.min_words, inclusive=True), final)

    return bind(bind(words.clean_text(text, config.min_length), stopped), finish)


def test_revisions_equal_the_expressions(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, lang string")
    got = {(r.id, r.revision): r.text for r in build_revisions(df, "id", "text", "lang", LANGUAGES, REVISIONS).collect()}
    wanted = {}
    for config in REVISIONS:
        for row in df.select("id", by_expressions(config).alias("t")).filter("t is not null").collect():
            wanted[row.id, config.name] = row.t
    assert got == wanted
    assert {key[0] for key in got} == {2, 3, 4, 6}


def test_clean_column_counts_what_is_left(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, lang string")
    for least, left in ((0, {3, 5, 6, 7}), (1, {3, 6})):
        cleaned = clean_column(F.col("text"), F.col("lang"), LANGUAGES, least=least)
        assert {r.id for r in df.select("id", cleaned.alias("t")).filter("t is not null").collect()} == left


def test_revisions_cut_a_text_once(spark):
    df = spark.createDataFrame(ROWS, "id long, text string, lang string")
    plan = build_revisions(df, "id", "text", "lang", LANGUAGES, REVISIONS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    assert "regexp_" not in plan and "split(" not in plan
