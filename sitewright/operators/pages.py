"""Page table lookups and link operators: each fetch of the scraper is a join on the URL.

If several pages share a normalized URL, the one with the smallest URL answers. Link lists stay
inside the page row as long as possible; only (page, place, target) rows travel. These narrow
tables are written to the shared folder before their join: the join looks at them twice (for
the asked URLs and for the rows), and the pages behind them should be parsed once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.html import frame_sources, links, numeric_tokens, page_text, plain_text, remove_popups
from sitewright.functions.urls import fix_http, resolve_link, street_name
from sitewright.operators.aggregates import any_match
from sitewright.operators.joins import lookup
from sitewright.sources.tables import save_stage

# Parts of link texts that lead to contact and location pages.
CONTACT_WORDS = ("cont",)
LOCATION_WORDS = ("vest", "loc")


def _find(df: DataFrame, row_id: Sequence[str], pages: DataFrame, url: str, **columns: Column) -> DataFrame:
    """Add ``columns`` of the page whose normalized URL is ``_target``; drops ``_target``."""
    table = pages.select(
        fix_http(F.col(url)).alias("_target"), F.col(url).alias("_url"), *[c.alias(n) for n, c in columns.items()]
    )
    return lookup(df, table.filter(F.col("_target").isNotNull()), "_target", row_id, first_by="_url").drop("_target")


def attach_html(df: DataFrame, row_id: str, url: str, pages: DataFrame, page_url: str, html: str) -> DataFrame:
    """Add ``html`` of the page with the normalized URL, null if there is none."""
    keyed = df.withColumn("_target", fix_http(F.col(url)))
    return _find(keyed, [row_id], pages, page_url, html=F.col(html))


def attach_column(df: DataFrame, row_id: str, url: str, pages: DataFrame, page_url: str, column: str) -> DataFrame:
    """Add one column of the page with the normalized URL."""
    keyed = df.withColumn("_target", fix_http(F.col(url)))
    return _find(keyed, [row_id], pages, page_url, **{column: F.col(column)})


def attach_status(df: DataFrame, row_id: str, url: str, pages: DataFrame, page_url: str, status: str) -> DataFrame:
    """Add the status of the page, 0 if it cannot be reached."""
    keyed = df.withColumn("_target", fix_http(F.col(url)))
    found = _find(keyed, [row_id], pages, page_url, _found=F.col(status))
    return found.withColumn("status", F.coalesce("_found", F.lit(0))).drop("_found")


def fetch_rounds(
    df: DataFrame, row_id: str, url: str, rounds: Sequence[DataFrame], page_url: str, html: str
) -> DataFrame:
    """Try one page table after the other; only rows still without HTML go on.

    ``round`` is the number of the source that answered; ``ssl_fail`` is true if only the last
    one did.
    """
    answered, open_rows = None, df
    for number, pages in enumerate(rounds, 1):
        filled = pages.filter(F.col(html).isNotNull())
        # whether a page answers is decided on URLs alone; HTML is joined to the rows that it answers
        asked = open_rows.withColumn("_target", fix_http(F.col(url)))
        tried = save_stage(_find(asked, [row_id], filled, page_url, _hit=F.lit(True)), f"round-{number}")
        hit = attach_html(tried.filter("_hit").drop("_hit"), row_id, url, filled, page_url, html)
        hit = hit.withColumn("round", F.lit(number))
        answered = hit if answered is None else answered.unionByName(hit)
        open_rows = tried.filter(F.col("_hit").isNull()).drop("_hit")
    lost = open_rows.withColumn("html", F.lit(None).cast("string")).withColumn("round", F.lit(None).cast("int"))
    return answered.unionByName(lost).withColumn("ssl_fail", F.coalesce(F.col("round") == len(rounds), F.lit(False)))


def link_table(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """One row per link: page, position from 0, href, text, hreflang."""
    listed = pages.select(page_id, F.posexplode(links(F.col(html))).alias("position", "link"))
    return listed.select(page_id, "position", "link.href", "link.text", "link.hreflang")


def text_links(html: Column, base: Column, words: Sequence[str], absolute_mark: str = "www") -> Column:
    """Distinct targets of the links whose text contains one of the words."""
    wanted = F.filter(links(html), lambda link: _contains_any(link["text"], words))
    return F.array_distinct(F.transform(wanted, lambda link: resolve_link(base, link["href"], absolute_mark)))


def _contains_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def crawl_links(
    pages: DataFrame, page_id: str, url: str, html: str, words: Sequence[str], absolute_mark: str = "www"
) -> DataFrame:
    """(page, target) for contact or location links; the set is per page, so no shuffle."""
    targets = text_links(F.col(html), F.col(url), words, absolute_mark)
    return pages.select(page_id, F.explode(targets).alias("target"))


def language_candidates(html: Column, url: Column, code: str, country: str) -> Column:
    """Ordered targets that may be the page in language ``code``.

    Without hreflang links: texts with the word, then hrefs with the code. With one: that
    one. With more: those whose href contains the country, then the first.
    """
    all_links = links(html)
    marked = F.filter(all_links, lambda link: link["hreflang"].rlike(code))
    by_text = F.filter(all_links, lambda link: F.array_contains(F.split(link["text"], r"\s+"), code))
    by_href = F.filter(all_links, lambda link: F.lower(link["href"]).contains(code))
    by_country = F.filter(marked, lambda link: link["href"].contains(country))
    ordered = (
        F.when(F.size(marked) == 0, F.concat(by_text, by_href))
        .when(F.size(marked) == 1, marked)
        .otherwise(F.concat(by_country, F.slice(marked, 1, 1)))
    )
    return F.transform(ordered, lambda link: resolve_link(url, link["href"]))


def switch_language(
    pages: DataFrame,
    page_id: str,
    url: str,
    html: str,
    languages: DataFrame,
    code: str,
    country: str = "be",
) -> DataFrame:
    """Per page ``switched`` (a candidate exists) and ``new_url`` ('' if none is in the language).

    ``languages`` holds (url, language) of all pages.
    """
    targets = language_candidates(F.col(html), F.col(url), code, country)
    listed = pages.select(page_id, F.posexplode_outer(targets).alias("place", "candidate"))
    keyed = save_stage(listed, "candidates").withColumn("_target", fix_http(F.col("candidate")))
    known = _find(keyed, [page_id, "place"], languages, "url", _language=F.col("language"))
    first = F.min(F.when(F.col("_language") == code, F.struct("place", "candidate")))
    return known.groupBy(page_id).agg(
        F.bool_or(F.col("candidate").isNotNull()).alias("switched"),
        F.coalesce(first["candidate"], F.lit("")).alias("new_url"),
    )


def apply_switch(
    df: DataFrame,
    row_id: str,
    pages: DataFrame,
    targets: Sequence[str],
    code: str,
    country: str = "be",
) -> DataFrame:
    """Switch rows with HTML that are in no target language: new URL, HTML and language.

    ``df`` has ``url, html, language``; ``pages`` has the same columns for every page that can
    be fetched. Other rows pass without a shuffle.
    """
    needs = F.col("html").isNotNull() & ~F.coalesce(F.col("language"), F.lit("")).isin(*targets)
    todo = df.filter(needs)
    found = switch_language(todo, row_id, "url", "html", pages.select("url", "language"), code, country)
    found = found.filter(F.col("new_url") != "").select(row_id, "new_url", fix_http(F.col("new_url")).alias("_target"))
    fetched = _find(found, [row_id], pages, "url", _html=F.col("html"), _language=F.col("language"))
    changed = todo.join(fetched, row_id, "left")
    for name, new in (("url", "new_url"), ("html", "_html"), ("language", "_language")):
        changed = changed.withColumn(name, F.coalesce(new, name))
    return df.filter(~needs).unionByName(changed.select(*df.columns))


def primary_language_url(
    df: DataFrame, row_id: str, languages: DataFrame, code: str, country: str = "be", wanted_status: int = 200
) -> DataFrame:
    """``language_url``: the switched URL for reachable pages in another language, else the URL."""
    needs = (F.coalesce("status", F.lit(0)) == wanted_status) & (F.coalesce("language", F.lit("")) != code)
    found = switch_language(df.filter(needs), row_id, "url", "html", languages, code, country)
    found = found.filter(F.col("new_url") != "").select(row_id, "new_url")
    joined = df.join(found, row_id, "left")
    return joined.withColumn("language_url", F.coalesce("new_url", "url")).drop("new_url")


def _match_page_or_linked(
    df: DataFrame,
    row_id: str,
    here: Column,
    there: Column,
    carried: Sequence[str],
    pages: DataFrame,
    content: Column,
    absolute_mark: str,
    base: str,
) -> DataFrame:
    """True if the row's own page matches or any of its contact or location pages does.

    Rows that match on their own page follow no links.
    """
    first = df.withColumn("_here", F.coalesce(here, F.lit(False)))
    linked = F.concat(
        text_links(F.col("html"), F.col(base), CONTACT_WORDS, absolute_mark),
        text_links(F.col("html"), F.col(base), LOCATION_WORDS, absolute_mark),
    )
    todo = first.filter(~F.col("_here")).select(row_id, *carried, F.explode(linked).alias("_link"))
    keyed = save_stage(todo, "linked-pages").withColumn("_target", fix_http(F.col("_link")))
    seen = _find(keyed, [row_id, "_link"], pages, "url", _content=content)
    matched = any_match(seen, row_id, there, "_there").filter("_there")
    joined = first.select(row_id, "_here").join(matched, row_id, "left")
    return joined.select(row_id, F.coalesce("_there", "_here").alias("valid"))


def validate_zip(
    df: DataFrame, row_id: str, zip_1: str, zip_2: str, pages: DataFrame, absolute_mark: str = "www", base: str = "url"
) -> DataFrame:
    """``valid`` if one of the zips is a number on the page or on a contact or location page.

    ``base`` names the column with the URL in front of relative links, if it is not the page's own.
    """

    def has_zip(numbers: Column) -> Column:
        zips = [F.coalesce(F.array_contains(numbers, F.col(z).cast("string")), F.lit(False)) for z in (zip_1, zip_2)]
        return zips[0] | zips[1]

    here = has_zip(numeric_tokens(F.col("html")))
    there = has_zip(F.col("_content"))
    content = numeric_tokens(F.col("html"))
    return _match_page_or_linked(df, row_id, here, there, [zip_1, zip_2], pages, content, absolute_mark, base)


def validate_street(
    df: DataFrame, row_id: str, street: str, pages: DataFrame, absolute_mark: str = "www", base: str = "url"
) -> DataFrame:
    """``valid`` if the street name is in the text of the page or of a contact or location page; ``base`` as above."""
    name = street_name(F.col(street))
    here = (name != "") & plain_text(F.col("html")).contains(name)
    there = (name != "") & F.col("_content").contains(name)
    content = plain_text(F.col("html"))
    return _match_page_or_linked(df, row_id, here, there, [street], pages, content, absolute_mark, base)


def text_with_frames(df: DataFrame, row_id: str, html: str, pages: DataFrame) -> DataFrame:
    """Visible text without popups, followed by the text of the frames that can be found.

    A frame that is missing is skipped. Only pages with frames take part in the join.
    """
    may_frame = F.coalesce(F.col(html).rlike(r"(?i)<frame\s"), F.lit(False))
    plain = df.filter(~may_frame).withColumn("text", page_text(remove_popups(F.col(html))))
    shown = df.filter(may_frame).withColumn("_shown", remove_popups(F.col(html)))
    asked = shown.select(row_id, F.posexplode(frame_sources(F.col("_shown"))).alias("_place", "_src"))
    keyed = save_stage(asked, "frames").withColumn("_target", fix_http(F.col("_src")))
    answers = _find(keyed, [row_id, "_place"], pages, "url", _content=F.col("html"))
    texts = answers.withColumn("_content", page_text(F.col("_content")))
    # one group is the frame list of one page, which came out of one row
    parts = texts.filter(F.col("_content").isNotNull()).groupBy(row_id)
    ordered = parts.agg(F.array_sort(F.collect_list(F.struct("_place", "_content"))).alias("_parts"))
    extra = ordered.select(row_id, F.array_join(F.col("_parts._content"), " ").alias("_extra"))
    joined = shown.join(extra, row_id, "left")
    framed = joined.withColumn("text", F.trim(F.concat_ws(" ", page_text(F.col("_shown")), F.col("_extra"))))
    return plain.unionByName(framed.drop("_shown", "_extra"))
