"""Queries over sampling, text cleaning, language detection and text chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import html, urls, words
from sitewright.operators import rows, sampling, texts
from sitewright.operators.language import LanguageProfile, language_table
from sitewright.operators.pages import text_with_frames
from sitewright.plans import inputs
from sitewright.plans import sqltext as q
from sitewright.plans.inputs import LANGUAGES, SEED
from sitewright.plans.registry import query
from sitewright.plans.scoring import detect_pages
from sitewright.sources.tables import read_parquet, read_spread

# --- sampling, order, set operations --------------------------------------------------------


@query("o1_sample", f"select * from (select * from documents order by {q.key_hash('doc_id', 123)}, doc_id limit 300)")
def o1(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_rows(read_spread(spark, folder, "documents", "doc_id"), ["doc_id"], 300, 123)


@query(
    "o2_split",
    f"""select doc_id, quality, case when substr({q.key_hash('doc_id')}, 1, 8) < 'cccccccd' then 'train' else 'test' end as part
        from labels""",
)
def o2(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_parquet(spark, folder, "labels").select("doc_id", "quality")
    train, test = sampling.split(labels, ["doc_id"], 0.8, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


ITEM_KEY = "concat_ws(':', l_orderkey, l_linenumber, l_partkey, 22494)"


@query(
    "o2_split_exact",
    """select o_orderkey, case when r <= round(0.7 * n) then 'train' else 'test' end as part
       from (select o_orderkey, row_number() over (order by md5(concat_ws(':', o_orderkey, 22494)), o_orderkey) as r,
                    count(*) over () as n from orders)""",
)
def o2_exact(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_orderkey")
    train, test = sampling.split_exact(orders, ["o_orderkey"], 0.7, SEED)
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))


@query(
    "o3_sample_keys",
    f"""select c_custkey from (select c_custkey, row_number() over (order by {q.key_hash('c_custkey')}, c_custkey) as r,
               count(*) over () as n from customer) where r <= floor(n * 0.35)""",
)
def o3(spark: SparkSession, folder: str) -> DataFrame:
    return sampling.sample_keys(read_parquet(spark, folder, "customer"), "c_custkey", 0.35, SEED)


@query(
    "o4_one_per_key",
    f"""select o_custkey, o_orderkey, o_totalprice from (
            select *, row_number() over (partition by o_custkey order by {q.key_hash('o_orderkey')}, o_orderkey) as r
            from orders) where r = 1""",
)
def o4(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return sampling.one_per_key(orders, ["o_custkey"], ["o_orderkey"], SEED)


@query(
    "o5_oversample",
    f"""with m as (select *, row_number() over (order by {q.key_hash('doc_id')}, doc_id) as r from labels where quality = 0),
             s as (select count(*) filter (quality = 0) as n, count(*) filter (quality = 1) as total from labels),
             d as (select {q.number(q.key_hash('i'))} % n + 1 as r
                   from (select unnest(range(total - n)) as i, n from s))
        select doc_id, quality, toxic, 0 as copy from labels
        union all select m.doc_id, m.quality, m.toxic, 1 from d join m using (r)""",
)
def o5(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_parquet(spark, folder, "labels")
    total = labels.filter(F.col("quality") == 1).count()
    return sampling.oversample(labels, ["doc_id"], "quality", 0, total, SEED, mark="copy")


TOP = "select 'high' as side, * from (select c_custkey, c_acctbal from customer order by c_acctbal desc, c_custkey limit 20)"
LOW = "select 'low' as side, * from (select c_custkey, c_acctbal from customer order by c_acctbal, c_custkey limit 20)"


@query("o6_top_k", f"{TOP} union all {LOW}")
def o6(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_parquet(spark, folder, "customer").select("c_custkey", "c_acctbal")
    high = sampling.top_k(customer, "c_acctbal", "c_custkey", 20).select(F.lit("high").alias("side"), "*")
    low = sampling.top_k(customer, "c_acctbal", "c_custkey", 20, ascending=True).select(F.lit("low").alias("side"), "*")
    return high.unionByName(low)


@query(
    "o7_append",
    """select c_custkey as key, c_name as name, c_mktsegment as segment, null::double as balance from customer
       union all select s_suppkey, s_name, null, s_acctbal from supplier""",
)
def o7(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")
    )
    supplier = read_parquet(spark, folder, "supplier").select(
        F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    return sampling.append(customer, supplier)


@query("o8_folds", f"select doc_id, cast({q.number(q.key_hash('doc_id'), 8)} % 10 as integer) as fold from documents")
def o8(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", sampling.fold_number(["doc_id"], 10, SEED).alias("fold"))


@query(
    "o9_row_rank",
    f"""select o_orderkey, row_number() over (order by {q.key_hash('o_orderkey')}, o_orderkey) as rank from orders""",
)
def o9(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_orderkey")
    return sampling.with_rank(orders, ["o_orderkey"], SEED, orders.count())


# --- text expressions -----------------------------------------------------------------------------


@query("t1_fix_http", q.using("url_rows", f"select page_id, {q.fix_http('url')} as url from url_rows"))
def t1(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.url_rows(spark, folder).select("page_id", urls.fix_http(F.col("url")).alias("url"))


@query(
    "t2_url_from_email",
    q.using(
        "companies",
        f"""select 'c' as origin, btw as id, {q.email_url('cur_email')} as domain from companies
            union all select 'd', doc_id, {q.email_url('text')} from documents""",
    ),
)
def t2(spark: SparkSession, folder: str) -> DataFrame:
    firms = inputs.companies(spark, folder).select(
        F.lit("c").alias("origin"), F.col("btw").alias("id"), urls.url_from_email(F.col("cur_email")).alias("domain")
    )
    documents = read_spread(spark, folder, "documents", "doc_id").select(
        F.lit("d").alias("origin"), F.col("doc_id").alias("id"), urls.url_from_email(F.col("text")).alias("domain")
    )
    return firms.unionByName(documents)


@query("t3_visible_text", f"select page_id, {q.visible('html')} as text from pages")
def t3(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "pages", "page_id").select("page_id", html.visible_text(F.col("html")).alias("text"))


@query("t4_page_text", f"select page_id, {q.page_text('html')} as text from pages")
def t4(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "pages", "page_id").select("page_id", html.page_text(F.col("html")).alias("text"))


@query(
    "t5_remove_popups",
    q.using("framed", f"select page_id, {q.page_text('base_html')} as text from framed"),
)
def t5(spark: SparkSession, folder: str) -> DataFrame:
    kept = html.remove_popups(F.col("html"))
    return inputs.framed(spark, folder).select("page_id", html.page_text(kept).alias("text"))


@query(
    "t6_text_with_frames",
    q.using(
        "framed upages",
        f"""select f.page_id, trim(concat_ws(' ', {q.page_text('f.base_html')},
                   case when f.page_id % 3 = 0 and contains(f.base_html, '</body>') then {q.page_text('a.html')} end,
                   case when f.page_id % 3 = 0 and contains(f.base_html, '</body>') then {q.page_text('b.html')} end)) as text
            from framed f join upages a on a.norm = {q.fix_http('f.u1')} join upages b on b.norm = {q.fix_http('f.u2')}""",
    ),
)
def t6(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_spread(spark, folder, "pages", "page_id")
    framed = inputs.framed(spark, folder).select("page_id", "html")
    return text_with_frames(framed, "page_id", "html", pages).select("page_id", "text")


@query("t7_clean_text", f"select doc_id, {q.clean('text')} as text from documents")
def t7(spark: SparkSession, folder: str) -> DataFrame:
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", words.clean_text(F.col("text")).alias("text"))


@query("t7_clean_text_apart", f"select doc_id, {q.clean('text', 2, ' ')} as text from documents")
def t7_apart(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = words.clean_text(F.col("text"), min_length=2, separator=" ")
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", cleaned.alias("text"))


@query("t8_stopwords", f"select doc_id, {q.no_stop(q.clean('text'), 'lang')} as text from documents")
def t8(spark: SparkSession, folder: str) -> DataFrame:
    cleaned = texts.clean_column(F.col("text"), F.col("lang"), LANGUAGES)
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", cleaned.alias("text"))


@query("t9_stem", f"select doc_id, {q.stem(q.clean('text'), 'lang')} as text from documents")
def t9(spark: SparkSession, folder: str) -> DataFrame:
    stemmed = words.stem_text(words.clean_text(F.col("text")), F.col("lang"), LANGUAGES.both)
    return read_spread(spark, folder, "documents", "doc_id").select("doc_id", stemmed.alias("text"))


@query(
    "t10_count_words",
    f"select conv_id, turn, cast({q.word_count('text')} as integer) as words from conversations",
)
def t10(spark: SparkSession, folder: str) -> DataFrame:
    counts = words.count_words(F.col("text")).alias("words")
    return read_parquet(spark, folder, "conversations").select("conv_id", "turn", counts)


PROFILE_SQL = f"""
    with grams as (select lang, unnest({q.trigrams('text')}) as term from documents),
    counts as (select lang, term, count(*) as n from grams group by 1, 2),
    ranked as (select *, row_number() over (partition by lang order by n desc, term) as place from counts),
    vocabulary as (select distinct term from ranked where place <= 300),
    docs as (select lang, count(*) as docs from documents group by 1),
    sizes as (select lang, sum(n) as total from counts join vocabulary using (term) group by 1),
    weights as (select d.lang, v.term, ln((coalesce(c.n, 0) + 1) / (s.total + (select count(*) from vocabulary))) as w
                from docs d join sizes s using (lang) cross join vocabulary v
                left join counts c on c.lang = d.lang and c.term = v.term),
    prior as (select lang, ln((docs + 1) / ((select sum(docs) from docs) + (select count(*) from docs))::double) as pi from docs)"""
DETECT_SQL = """,
    hits as (select id, term, count(*) as n from (select id, unnest(grams) as term from texts) join vocabulary using (term) group by 1, 2),
    scores as (select h.id, w.lang, sum(h.n * w.w) + max(p.pi) as score from hits h join weights w using (term)
               join prior p on p.lang = w.lang group by 1, 2),
    best as (select id, arg_max(lang, score) as language from scores group by 1),
    detected as (select t.id, coalesce(b.language, 'unknown') as language from texts t left join best b using (id))"""


def profile(spark: SparkSession, folder: str) -> LanguageProfile:
    return LanguageProfile.fit(read_spread(spark, folder, "documents", "doc_id"), "text", "lang")


@query(
    "t11_detect_documents",
    PROFILE_SQL
    + f", texts as (select doc_id as id, {q.trigrams('text')} as grams from documents)"
    + DETECT_SQL
    + " select id as doc_id, language from detected",
)
def t11(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_spread(spark, folder, "documents", "doc_id").select("doc_id", "text")
    return profile(spark, folder).transform(documents, "text").select("doc_id", "language")


PAGE_GRAMS = f", texts as (select page_id as id, {q.trigrams('text')} as grams from (select page_id, {q.page_text('html')} as text from pages))"


@query("t11_detect_pages", PROFILE_SQL + PAGE_GRAMS + DETECT_SQL + " select id as page_id, language from detected")
def t11_pages(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_spread(spark, folder, "pages", "page_id")
    found = detect_pages(pages.select("page_id", "url", "html"), "page_id", "html", profile(spark, folder), pages)
    return found.select("page_id", "language")


FRAMED_TEXT = f"""select f.page_id, trim(concat_ws(' ', {q.page_text('f.base_html')},
           case when f.page_id % 3 = 0 and contains(f.base_html, '</body>') then {q.page_text('a.html')} end,
           case when f.page_id % 3 = 0 and contains(f.base_html, '</body>') then {q.page_text('b.html')} end)) as text
    from framed f join upages a on a.norm = {q.fix_http('f.u1')} join upages b on b.norm = {q.fix_http('f.u2')}"""


@query(
    "t11_detect_framed_pages",
    q.using(
        "framed upages",
        ", shown as ("
        + FRAMED_TEXT
        + "),"
        + PROFILE_SQL.replace("with grams", " grams", 1)
        + f", texts as (select page_id as id, {q.trigrams('text')} as grams from shown)"
        + DETECT_SQL
        + f""" select id as page_id, language, cast({q.word_count('text')} as integer) as words
               from detected join shown on shown.page_id = detected.id""",
    ),
)
def t11_framed(spark: SparkSession, folder: str) -> DataFrame:
    """Popups go, frames count, as in the text a visitor sees; with its number of words."""
    pages = read_spread(spark, folder, "pages", "page_id")
    framed = inputs.framed(spark, folder).select("page_id", "url", "html")
    found = detect_pages(framed, "page_id", "html", profile(spark, folder), pages, words="words")
    return found.select("page_id", "language", "words")


@query(
    "l13_language_counts",
    PROFILE_SQL + PAGE_GRAMS + DETECT_SQL + " select language, count(*) as n from detected group by 1",
)
def l13(spark: SparkSession, folder: str) -> DataFrame:
    pages = read_spread(spark, folder, "pages", "page_id")
    shown = text_with_frames(pages.select("page_id", "html"), "page_id", "html", pages)
    return language_table(shown, "text", profile(spark, folder))


@query("t12_tokens", f"select conv_id, turn, array_to_string({q.tokens('text')}, ' ') as words from conversations")
def t12(spark: SparkSession, folder: str) -> DataFrame:
    joined = F.array_join(words.tokens(F.col("text")), " ").alias("words")
    return read_parquet(spark, folder, "conversations").select("conv_id", "turn", joined)


@query(
    "t13_search_phrase",
    q.using(
        "companies",
        "select btw, replace(regexp_replace(cur_firm, ' +', ' ', 'g'), chr(10), '') as phrase from companies",
    ),
)
def t13(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.companies(spark, folder).select("btw", urls.search_phrase(F.col("cur_firm")).alias("phrase"))


@query(
    "t14_hit_site",
    """select page_id, regexp_replace(split_part(hit, '›', 1), '\\s+$', '') as site from (
           select page_id, case when page_id % 4 = 0 then url else replace(url, '/en/', ' › en › ') || ' › x' end as hit from pages)""",
)
def t14(spark: SparkSession, folder: str) -> DataFrame:
    longer = F.concat(F.replace(F.col("url"), F.lit("/en/"), F.lit(" › en › ")), F.lit(" › x"))
    hit = F.when(F.col("page_id") % 4 == 0, F.col("url")).otherwise(longer)
    return read_spread(spark, folder, "pages", "page_id").select("page_id", urls.hit_site(hit).alias("site"))


@query(
    "t15_numeric_tokens",
    f"select page_id, array_to_string(regexp_extract_all({q.plain('html')}, '\\d+'), ' ') as numbers from pages",
)
def t15(spark: SparkSession, folder: str) -> DataFrame:
    numbers = F.array_join(html.numeric_tokens(F.col("html")), " ")
    return read_spread(spark, folder, "pages", "page_id").select("page_id", numbers.alias("numbers"))


@query(
    "t16_street_name",
    q.using(
        "companies",
        """select btw, regexp_replace(trim(regexp_replace(street, '\\d+', '', 'g')), '[(\\[].*?[)\\]]', '', 'g') as street
           from companies""",
    ),
)
def t16(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.companies(spark, folder).select("btw", urls.street_name(F.col("street")).alias("street"))


T17_SQL = f"""select page_id, text from (
        select page_id, {q.no_stop(q.clean('shown'), 'language')} as text from (
            select page_id, regexp_extract(html, '<html lang="([a-z]+)"', 1) as language, {q.page_text('html')} as shown from pages)
        where language in ('de', 'en')) where {q.word_count('text')} > 20"""


@query("t17_html_to_text", T17_SQL)
def t17(spark: SparkSession, folder: str) -> DataFrame:
    language = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    pages = read_spread(spark, folder, "pages", "page_id").select("page_id", "html", language.alias("language"))
    return texts.html_to_text(pages, "page_id", "html", "language", LANGUAGES).select("page_id", "text")


@query(
    "t17_framed_to_text",
    q.using(
        "framed upages",
        f"""select page_id, text from (
              select page_id, {q.no_stop(q.clean('shown'), 'language')} as text from (
                select f.page_id, regexp_extract(f.html, '<html lang="([a-z]+)"', 1) as language,
                       trim(concat_ws(' ', {q.page_text('f.base_html')},
                       case when f.page_id % 3 = 0 and contains(f.base_html, '</body>') then {q.page_text('a.html')} end,
                       case when f.page_id % 3 = 0 and contains(f.base_html, '</body>') then {q.page_text('b.html')} end)) as shown
                from framed f join upages a on a.norm = {q.fix_http('f.u1')} join upages b on b.norm = {q.fix_http('f.u2')})
              where language in ('de', 'en')) where {q.word_count('text')} > 20""",
    ),
)
def t17_framed(spark: SparkSession, folder: str) -> DataFrame:
    language = F.regexp_extract("html", '<html lang="([a-z]+)"', 1)
    framed = inputs.framed(spark, folder).select("page_id", "html", language.alias("language"))
    pages = read_spread(spark, folder, "pages", "page_id")
    return texts.html_to_text(framed, "page_id", "html", "language", LANGUAGES, pages).select("page_id", "text")


REVISIONS = [
    texts.Revision("SA01", stem=True, stop=True, min_length=2),
    texts.Revision("SA02", stem=True, stop=False, min_length=3),
    texts.Revision("SA03", stem=False, stop=True, min_length=3, min_words=10),
    texts.Revision("SA16", stem=False, stop=False, min_length=2),
]


def _revision_sql() -> str:
    parts = []
    for config in REVISIONS:
        text = q.clean("text", config.min_length)
        text = q.no_stop(text, "lang") if config.stop else text
        final = q.stem("t", "lang") if config.stem else "t"
        parts.append(
            f"""select doc_id, lang as language, '{config.name}' as revision, {final} as text
                from (select doc_id, lang, {text} as t from documents) where {q.word_count('t')} >= {config.min_words}"""
        )
    return f"select * from ({' union all '.join(parts)}) where text is not null"


@query("t18_revisions", _revision_sql())
def t18(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_spread(spark, folder, "documents", "doc_id")
    return texts.build_revisions(documents, "doc_id", "text", "lang", LANGUAGES, REVISIONS)


@query(
    "s6_revision_corpus",
    q.using("labelled", "select doc_id as key, text, label as innovation from labelled"),
)
def s6_corpus(spark: SparkSession, folder: str) -> DataFrame:
    return rows.load_revision(inputs.labelled(spark, folder), "text", "label", "doc_id")
