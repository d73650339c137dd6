"""Queries over page tables and links.

Links of the given pages lead to no page in the table; the inputs add links to other pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import urls
from sitewright.operators import pages as ops
from sitewright.plans import inputs
from sitewright.plans import sqltext as q
from sitewright.plans.registry import query
from sitewright.sources.tables import read_spread

CODE, COUNTRY = "de", "be"


def resolved(base: str, href: str, mark: str = "http") -> str:
    return f"(case when contains({href}, '{mark}') then {href} else {base} || regexp_replace({href}, '^\\.+|\\.+$', '', 'g') end)"


@query(
    "j7_page_lookup",
    q.using(
        "nav upages",
        f"select n.page_id, u.page_id as found_id, md5(u.html) as html_md5 from nav n left join upages u on u.norm = {q.fix_http('n.u2')}",
    ),
)
def j7(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_spread(spark, folder, "pages", "page_id")
    asked = inputs.nav(spark, folder).select("page_id", F.col("u2").alias("asked"))
    table = pages.select(F.col("page_id").alias("found_id"), "url", "html")
    found = ops.attach_html(asked, "page_id", "asked", table, "url", "html")
    ids = ops.attach_column(found, "page_id", "asked", table, "url", "found_id")
    return ids.select("page_id", "found_id", F.md5("html").alias("html_md5"))


@query(
    "l1_attach_html",
    q.using("url_rows upages", f"select r.page_id, r.url, u.html from url_rows r left join upages u on u.norm = {q.fix_http('r.url')}"),
)
def l1(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_spread(spark, folder, "pages", "page_id")
    rows = inputs.url_rows(spark, folder).select("page_id", "url")
    return ops.attach_html(rows, "page_id", "url", pages, "url", "html").select("page_id", "url", "html")


def _round_sql(column: str) -> str:
    return (
        f"(select norm, arg_min({column}, url) as html from (select *, {q.fix_http('url')} as norm from rounds "
        f"where {column} is not null) group by norm)"
    )


@query(
    "l2_fetch_rounds",
    q.using(
        "url_rows rounds",
        f"""select page_id, url, coalesce(a.html, b.html, c.html) as html,
                   case when a.html is not null then 1 when b.html is not null then 2 when c.html is not null then 3 end as round,
                   a.html is null and b.html is null and c.html is not null as ssl_fail
            from (select *, {q.fix_http('url')} as norm from url_rows) r
            left join {_round_sql('html_r1')} a on a.norm = r.norm
            left join {_round_sql('html_r2')} b on b.norm = r.norm
            left join {_round_sql('html')} c on c.norm = r.norm""",
    ),
)
def l2(spark: SparkSession, folder: str) -> DataFrame:
    table = inputs.rounds(spark, folder)
    rounds = [
        table.filter(F.col(c).isNotNull()).select(F.col("url").alias("page_url"), F.col(c).alias("page_html"))
        for c in ("html_r1", "html_r2", "html")
    ]
    asked = inputs.url_rows(spark, folder).select("page_id", "url")
    return ops.fetch_rounds(asked, "page_id", "url", rounds, "page_url", "page_html")


@query(
    "l3_status",
    q.using(
        "url_rows page_status",
        f"""select page_id, r.url, coalesce(s.status, 0) as status
            from (select *, {q.fix_http('url')} as norm from url_rows) r
            left join (select norm, arg_min_null(status, url) as status
                       from (select *, {q.fix_http('url')} as norm from page_status) group by norm) s on s.norm = r.norm""",
    ),
)
def l3(spark: SparkSession, folder: str) -> DataFrame:
    asked = inputs.url_rows(spark, folder).select("page_id", "url")
    table = inputs.page_status(spark, folder)
    return ops.attach_status(asked, "page_id", "url", table, "url", "status").select("page_id", "url", "status")


@query("l4_link_table", q.using("links", "select page_id, position, href, text, hreflang from links"))
def l4(spark: SparkSession, folder: str) -> DataFrame:
    return ops.link_table(inputs.linked(spark, folder), "page_id", "html")


@query("l5_resolve_links", q.using("links", f"select page_id, position, {resolved('url', 'href')} as target from links"))
def l5(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.linked(spark, folder)
    links = ops.link_table(pages.withColumn("page", F.struct("page_id", "url")), "page", "html")
    target = urls.resolve_link(F.col("page.url"), F.col("href"))
    return links.select("page.page_id", "position", target.alias("target"))


def _crawl_sql(words, mark: str = "http") -> str:
    wanted = " or ".join(f"contains(text, '{w}')" for w in words)
    return f"select distinct page_id, {resolved('url', 'href', mark)} as target from links where {wanted}"


@query("l6_contact_pages", q.using("links", _crawl_sql(("cont",))))
def l6(spark: SparkSession, folder: str) -> DataFrame:
    return ops.crawl_links(inputs.linked(spark, folder), "page_id", "url", "html", ops.CONTACT_WORDS, "http")


@query("l7_location_pages", q.using("links", _crawl_sql(("vest", "loc"))))
def l7(spark: SparkSession, folder: str) -> DataFrame:
    return ops.crawl_links(inputs.linked(spark, folder), "page_id", "url", "html", ops.LOCATION_WORDS, "http")


@query("l6_contact_pages_www", q.using("links", _crawl_sql(("cont",), "www")))
def l6_www(spark: SparkSession, folder: str) -> DataFrame:
    return ops.crawl_links(inputs.linked(spark, folder), "page_id", "url", "html", ops.CONTACT_WORDS)


@query("l7_location_pages_www", q.using("links", _crawl_sql(("vest", "loc"), "www")))
def l7_www(spark: SparkSession, folder: str) -> DataFrame:
    return ops.crawl_links(inputs.linked(spark, folder), "page_id", "url", "html", ops.LOCATION_WORDS)


SWITCH = f""",
    marks as (select page_id, count(*) filter (regexp_matches(hreflang, '{CODE}')) as m from links group by 1),
    marked as (select l.*, m from links l join marks using (page_id)),
    ruled as (
        select page_id, url, 1 as rule, position, href from marked
        where m = 0 and list_contains(string_split_regex(text, '\\s+'), '{CODE}')
        union all select page_id, url, 2, position, href from marked where m = 0 and contains(lower(href), '{CODE}')
        union all select page_id, url, 3, position, href from marked where m = 1 and regexp_matches(hreflang, '{CODE}')
        union all select page_id, url, 4, position, href from marked
        where m > 1 and regexp_matches(hreflang, '{CODE}') and contains(href, '{COUNTRY}')
        union all select page_id, url, 5, min(position), arg_min(href, position) from marked
        where m > 1 and regexp_matches(hreflang, '{CODE}') group by page_id, url),
    candidates as (select page_id, rule, position, {resolved('url', 'href')} as candidate from ruled),
    hits as (select c.page_id, arg_min(candidate, rule * 1000000 + position) as new_url
             from candidates c join ulinked u on u.norm = {q.fix_http('candidate')} where u.language = '{CODE}' group by 1),
    switched as (select p.page_id, coalesce(c.s, false) as switched, coalesce(h.new_url, '') as new_url
                 from linked p left join (select distinct page_id, true as s from candidates) c using (page_id)
                 left join hits h using (page_id))"""


@query("l8_switch_language", q.using("links ulinked", SWITCH + " select * from switched"))
def l8(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.linked(spark, folder)
    return ops.switch_language(pages, "page_id", "url", "html", pages.select("url", "language"), CODE, COUNTRY)


@query(
    "l9_apply_switch",
    q.using(
        "links ulinked",
        SWITCH
        + f""" select p.page_id, coalesce(new_url, url) as url, coalesce(n.language, p.language) as language,
                      md5(coalesce(n.html, p.html)) as html_md5
               from linked p
               left join (select page_id, new_url from switched where new_url <> '') s
                   on s.page_id = p.page_id and p.language not in ('de', 'en')
               left join ulinked n on n.norm = {q.fix_http('s.new_url')}""",
    ),
)
def l9(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.linked(spark, folder).select("page_id", "url", "html", "language")
    changed = ops.apply_switch(pages, "page_id", pages, ["de", "en"], CODE, COUNTRY)
    return changed.select("page_id", "url", "language", F.md5("html").alias("html_md5"))


@query(
    "l10_primary_language_url",
    q.using(
        "links ulinked page_status",
        SWITCH
        + """ select page_id, status, case when status = 200 and language <> 'de' and new_url <> '' then new_url else p.url end as language_url
              from linked p join page_status using (page_id) join switched using (page_id)""",
    ),
)
def l10(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.linked(spark, folder)
    status = inputs.page_status(spark, folder).select("page_id", "status")
    known = pages.join(status, "page_id")
    found = ops.primary_language_url(known, "page_id", pages.select("url", "language"), CODE, COUNTRY)
    return found.select("page_id", "status", "language_url")


CRAWLED = f", crawled as ({_crawl_sql(('cont', 'vest', 'loc'))})"


@query(
    "l11_validate_zip",
    q.using(
        "links ulinked",
        CRAWLED
        + f""", asked as (select page_id, html, cast(10000 + t1 as varchar) as z1,
                                 case when page_id % 9 = 0 then cast(10000 + page_id as varchar) end as z2 from linked),
              own as (select page_id, z1, z2, regexp_extract_all({q.plain('html')}, '\\d+') as nums from asked),
              other as (select norm, regexp_extract_all({q.plain('html')}, '\\d+') as nums from ulinked),
              there as (select a.page_id, bool_or(coalesce(list_contains(o.nums, z1), false) or coalesce(list_contains(o.nums, z2), false)) as hit
                        from own a join crawled c using (page_id) join other o on o.norm = {q.fix_http('c.target')} group by 1)
              select page_id, coalesce(list_contains(nums, z1), false) or coalesce(list_contains(nums, z2), false) or coalesce(hit, false) as valid
              from own left join there using (page_id)""",
    ),
)
def l11(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.linked(spark, folder)
    asked = pages.withColumn("zip_1", 10000 + F.col("t1")).withColumn(
        "zip_2", F.when(F.col("page_id") % 9 == 0, 10000 + F.col("page_id"))
    )
    return ops.validate_zip(asked, "page_id", "zip_1", "zip_2", pages, "http")


@query(
    "l12_validate_street",
    q.using(
        "links ulinked",
        CRAWLED
        + f""", own as (select page_id, {q.plain('html')} as body, case when page_id % 7 <> 0 then 'Teststraat' else '' end as street from linked),
              other as (select norm, {q.plain('html')} as body from ulinked),
              there as (select a.page_id, bool_or(contains(o.body, street)) as hit
                        from own a join crawled c using (page_id) join other o on o.norm = {q.fix_http('c.target')} group by 1)
              select page_id, street <> '' and (contains(body, street) or coalesce(hit, false)) as valid
              from own left join there using (page_id)""",
    ),
)
def l12(spark: SparkSession, folder: str) -> DataFrame:
    pages = inputs.linked(spark, folder)
    street = F.when(F.col("page_id") % 7 != 0, F.concat(F.lit("Teststraat "), F.col("page_id"))).otherwise(F.lit(""))
    return ops.validate_street(pages.withColumn("street", street), "page_id", "street", pages, "http")
