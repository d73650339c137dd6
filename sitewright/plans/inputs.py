"""The same inputs as ``sqltext.INPUTS``, derived from the given tables with DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions.words import tokens
from sitewright.operators.aggregates import term_counts
from sitewright.operators.texts import Languages, clean_corpus
from sitewright.sources.tables import read_parquet, read_spread, save_stage, spread

LANGUAGES = Languages(primary="de", secondary="en")
SEED = 22494


def url_rows(spark: SparkSession, folder: str) -> DataFrame:
    i, url = F.col("page_id"), F.col("url")
    changed = (
        F.when(i % 7 == 0, F.lit(None))
        .when(i % 13 == 5, F.lit(""))
        .when(i % 3 == 1, F.regexp_replace(url, "^https?://", ""))
        .when(i % 3 == 2, F.regexp_replace(url, "/$", ""))
        .otherwise(url)
    )
    return read_parquet(spark, folder, "pages").select("page_id", i.cast("string").alias("key"), changed.alias("url"))


def page_status(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    status = F.when(i % 5 == 0, F.lit(404)).when(i % 11 != 0, F.lit(200))
    return read_parquet(spark, folder, "pages").select("page_id", "url", status.alias("status"))


def rounds(spark: SparkSession, folder: str) -> DataFrame:
    i, html = F.col("page_id"), F.col("html")
    first = F.when(i % 4 != 0, html).alias("html_r1")
    second = F.when(i % 8 != 0, html).alias("html_r2")
    return read_parquet(spark, folder, "pages").select("page_id", "url", "html", first, second)


def companies(spark: SparkSession, folder: str) -> DataFrame:
    k, segment, nation = F.col("c_custkey"), F.col("c_mktsegment"), F.col("c_nationkey")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    return read_parquet(spark, folder, "customer").select(
        k.alias("btw"),
        text("Firm   ", F.col("c_name"), "\n  ", segment).alias("cur_firm"),
        F.when(k % 17 != 0, k % 2).alias("inno5"),
        F.when(k % 3 != 0, text("www.", F.lower(segment), k, ".example.com")).alias("cur_web"),
        F.when(k % 5 == 2, text("info@", F.lower(segment), ".example.org"))
        .when(k % 5 == 3, text("info@my-firm", k, ".be"))
        .when(k % 5 == 4, F.lit("no address"))
        .alias("cur_email"),
        F.when(k % 4 > 1, text("http://site", k, ".example.net/")).alias("web"),
        F.when(k % 2 == 1, F.lit("a.b@shop.example.com")).alias("email"),
        text("Main street ", k, " (bus ", nation, ")").alias("street"),
        (1000 + nation * 10).alias("main_zip"),
        F.when(k % 3 != 1, 1000 + k % 9000).alias("activity_zip"),
    )


def nav(spark: SparkSession, folder: str) -> DataFrame:
    """Pages with their language and three other pages to link to."""
    pages = read_spread(spark, folder, "pages", "page_id")
    n, i = F.lit(pages.count()), F.col("page_id")
    base = pages.select(
        "page_id",
        "url",
        "html",
        F.regexp_extract("html", '<html lang="([a-z]+)"', 1).alias("language"),
        F.pmod(7 * i + 3, n).alias("t1"),
        F.pmod(11 * i + 5, n).alias("t2"),
        F.pmod(13 * i + 1, n).alias("t3"),
    )
    for place in (1, 2, 3):
        target = pages.select(F.col("page_id").alias(f"t{place}"), F.col("url").alias(f"u{place}"))
        base = base.join(target, f"t{place}")
    return base.select("page_id", "url", "html", "language", "u1", "u2", "u3", "t1")


def linked(spark: SparkSession, folder: str) -> DataFrame:
    i, u1, u2, u3 = F.col("page_id"), F.col("u1"), F.col("u2"), F.col("u3")

    def text(*parts: str | Column) -> Column:
        return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])

    extra = (
        F.when(i % 6 == 0, text('<a hreflang="de" href="', u1, '">Deutsch</a>'))
        .when(
            i % 6 == 1,
            text(
                '<a hreflang="de" href="', u1, '">Deutsch</a><a hreflang="de-be" href="', u2,
                "?be\">DE</a><a class=\"x\" href='", u3, "' hreflang=\"de\">D</a>",
            ),
        )
        .when(i % 6 == 2, text('<a href="', u1, '">Kies  de </a><a href="', u2, '">en</a><a href="', u3, '">x</a>'))
        .when(i % 6 == 3, text('<a href="', u3, '">other</a>'))
        .when(i % 6 == 4, text('<a href="', u1, '"> <b>Cont</b>act us</a><a href="', u2, '">Vestigingen</a>'))
        .otherwise(text('<a href="..', i, '.html.">Locaties</a>'))
    )
    address = F.when(i % 3 == 0, text("<p>Teststraat ", 10000 + i, "</p>")).otherwise(F.lit(""))
    html = F.replace(F.col("html"), F.lit("</body>"), F.concat(extra, address, F.lit("</body>")))
    made = nav(spark, folder).select("page_id", "url", "language", "t1", html.alias("html"))
    return spread(save_stage(made, "linked"), "page_id")  # read several times by the link queries


def framed(spark: SparkSession, folder: str) -> DataFrame:
    i = F.col("page_id")
    cookie = '<div id="cookiebar">We use <div class="x">inner</div> cookies</div>'
    popup = "<DIV CLASS='my-popup big'>Join <div>now</div></DIV>"
    head = F.concat(
        F.lit("<body>"),
        F.when(i % 2 == 0, F.lit(cookie)).otherwise(F.lit("")),
        F.when(i % 5 == 1, F.lit(popup)).otherwise(F.lit("")),
    )
    frames = F.concat(
        F.lit('<frame src="'), F.col("u1"), F.lit('"><frame src="http://nowhere.example.com/"><frame src="'),
        F.col("u2"), F.lit('">'),
    )
    tail = F.concat(F.when(i % 3 == 0, frames).otherwise(F.lit("")), F.lit("</body>"))
    html = F.replace(F.replace(F.col("html"), F.lit("<body>"), head), F.lit("</body>"), tail)
    return nav(spark, folder).select("page_id", "url", F.col("html").alias("base_html"), html.alias("html"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", "lang", "source", "text")


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    return clean_corpus(_documents(spark, folder), "text", "lang", LANGUAGES)


def labelled(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_parquet(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    # labels first, so that documents without one are not cleaned
    return clean_corpus(_documents(spark, folder).join(labels, "doc_id"), "text", "lang", LANGUAGES)


def proba(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "n_chars")
    labels = read_parquet(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    p = F.col("n_chars") % 997 / F.lit(997.0)
    return (
        documents.join(labels, "doc_id")
        .withColumn("p", p)
        .withColumn("prediction", F.when(F.col("p") > 0.5, 1).otherwise(0))
    )


def coefficients(spark: SparkSession, folder: str) -> DataFrame:
    """(feature, coef): share of documents of class 1 minus share of class 0 among those with the term."""
    rows = labelled(spark, folder)
    words = F.explode(F.array_distinct(F.split("text", " "))).alias("feature")
    signed = F.when(F.col("label") == 1, 1.0).otherwise(-1.0)
    counts = rows.select("label", words).groupBy("feature")
    scored = counts.agg(F.round(F.sum(signed) / F.count("*"), 6).alias("coef"), F.count("*").alias("n"))
    return scored.filter(F.col("n") >= 5).drop("n")


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return term_counts(corpus(spark, folder), tokens(F.col("text")))
