"""Queries over sources, projections, filters, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.functions import urls, words
from sitewright.operators import aggregates, joins, metrics, rows
from sitewright.plans import inputs
from sitewright.plans.registry import query
from sitewright.plans.sqltext import email_url, fix_http, stop_words, using, word_count  # noqa: F401
from sitewright.session import new_table_path
from sitewright.sources.tables import read_parquet, read_table, save_stage, write_table

# --- sources and sinks ---------------------------------------------------------------------


@query("s1_read_table", "select doc_id, text, lang, source, n_chars from documents")
def s1(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "documents-csv")
    documents = read_parquet(spark, folder, "documents")
    write_table(documents, path)
    return read_table(spark, path, documents.schema)


@query("s2_write_table", "select page_id, url, html from pages")
def s2(spark: SparkSession, folder: str) -> DataFrame:
    path = new_table_path(spark, "pages-csv")
    pages = read_parquet(spark, folder, "pages").select("page_id", "url", "html")
    write_table(pages, path, sep=";")
    return read_table(spark, path, pages.schema, sep=";")


@query("s3_save_stage", "select source, count(*) as n, cast(sum(n_chars) as bigint) as chars from documents group by source")
def s3(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents")
    counts = documents.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return save_stage(counts, "source-counts")


SURVEY_NAMES = {
    "cur_firm": "Name",
    "inno5": "Innovation",
    "street": "Street_1",
    "main_zip": "Main_Zip",
    "activity_zip": "Activity_Zip",
    "cur_email": "Registry_Email",
    "cur_web": "Registry_Website",
    "email": "User_Provided_Email",
    "web": "User_Provided_Website",
}


@query(
    "s4_rows_to_documents",
    using(
        "companies",
        f"""select cast(btw as varchar) as _key,
            {', '.join(f'cast({a} as integer) as "{b}"' if a == 'inno5' else f'{a} as "{b}"' for a, b in SURVEY_NAMES.items())},
            {' + '.join(f'cast({a} is not null as integer)' for a in SURVEY_NAMES)} as attributes
        from companies""",
    ),
)
def s4(spark: SparkSession, folder: str) -> DataFrame:
    made = rows.rows_to_documents(inputs.companies(spark, folder), SURVEY_NAMES, "btw", "inno5")
    return made.withColumn("attributes", F.size(F.json_object_keys("document"))).drop("document")


@query(
    "s5_load_corpus",
    "select doc_id as key, text, quality as label, lang as language from documents join labels using (doc_id)",
)
def s5(spark: SparkSession, folder: str) -> DataFrame:
    both = read_parquet(spark, folder, "documents").join(read_parquet(spark, folder, "labels"), "doc_id")
    return rows.load_corpus(both, "doc_id", "text", "quality", "lang")


REVISION_SQL = """
    with d as (select doc_id, case when n_chars >= 300 then text end as rev, quality
               from documents left join labels using (doc_id))
    select {columns} rev as text, quality as innovation from d where rev is not null and quality is not null"""


def _with_revision(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents")
    revised = documents.withColumn("rev", F.when(F.col("n_chars") >= 300, F.col("text")))
    return revised.join(read_parquet(spark, folder, "labels"), "doc_id", "left")


@query("s6_load_revision", REVISION_SQL.format(columns="doc_id as key,"))
def s6(spark: SparkSession, folder: str) -> DataFrame:
    return rows.load_revision(_with_revision(spark, folder), "rev", "quality", "doc_id")


@query("s6_load_revision_no_key", REVISION_SQL.format(columns=""))
def s6_no_key(spark: SparkSession, folder: str) -> DataFrame:
    return rows.load_revision(_with_revision(spark, folder), "rev", "quality")


UPSERT_INPUT = """
    with base as (select c_custkey as key, c_mktsegment as segment, c_acctbal as balance from customer),
         patch as (select o_custkey * 2 as key, max(o_totalprice) as balance,
                          case when max(o_orderkey) % 2 = 0 then min(o_orderpriority) end as priority
                   from orders group by 1)"""


def _upsert_input(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    base = read_parquet(spark, folder, "customer").select(
        F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance")
    )
    orders = read_parquet(spark, folder, "orders").groupBy((F.col("o_custkey") * 2).alias("key"))
    patch = orders.agg(
        F.max("o_totalprice").alias("balance"),
        F.when(F.max("o_orderkey") % 2 == 0, F.min("o_orderpriority")).alias("priority"),
    )
    return base, patch


@query(
    "s7_upsert",
    UPSERT_INPUT
    + """ select key, b.segment, coalesce(p.balance, b.balance) as balance, p.priority
          from base b left join patch p using (key)""",
)
def s7(spark: SparkSession, folder: str) -> DataFrame:
    base, patch = _upsert_input(spark, folder)
    return joins.upsert_by_key(base, patch, "key", ["balance", "priority"])


@query(
    "s7_upsert_insert",
    UPSERT_INPUT
    + """ select key, b.segment, coalesce(p.balance, b.balance) as balance, p.priority
          from base b full join patch p using (key)""",
)
def s7_insert(spark: SparkSession, folder: str) -> DataFrame:
    base, patch = _upsert_input(spark, folder)
    return joins.upsert_by_key(base, patch, "key", ["balance", "priority"], insert=True)


# --- projections, filters, predicates ----------------------------------------------------------


@query("p1_with_url", using("url_rows", "select page_id, key, url from url_rows where url is not null"))
def p1(spark: SparkSession, folder: str) -> DataFrame:
    return rows.with_url(inputs.url_rows(spark, folder), "url")


@query("p1_without_url", using("url_rows", "select page_id, key, url from url_rows where url is null"))
def p1_missing(spark: SparkSession, folder: str) -> DataFrame:
    return rows.without_url(inputs.url_rows(spark, folder), "url")


@query("p2_languages", "select doc_id, lang from documents where lang in ('de', 'en')")
def p2(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents").select("doc_id", "lang")
    return rows.in_languages(documents, "lang", ["de", "en"])


@query(
    "p3_status_parts",
    using(
        "page_status",
        "select page_id, status, case when coalesce(status, 0) = 200 then 'ok' else 'other' end as part from page_status",
    ),
)
def p3(spark: SparkSession, folder: str) -> DataFrame:
    good, other = rows.by_status(inputs.page_status(spark, folder), "status")
    parts = good.withColumn("part", F.lit("ok")).unionByName(other.withColumn("part", F.lit("other")))
    return parts.select("page_id", "status", "part")


@query("p4_more_words", f"select doc_id, text from documents where {word_count('text')} > 20")
def p4(spark: SparkSession, folder: str) -> DataFrame:
    return rows.enough_words(read_parquet(spark, folder, "documents").select("doc_id", "text"), "text")


@query("p4_at_least_words", f"select doc_id, n_chars from documents where {word_count('text')} >= 20")
def p4_inclusive(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents")
    return rows.enough_words(documents, "text", inclusive=True).select("doc_id", "n_chars")


@query("p5_min_characters", "select conv_id, turn, text from conversations where length(text) >= 20")
def p5(spark: SparkSession, folder: str) -> DataFrame:
    return rows.enough_characters(read_parquet(spark, folder, "conversations").select("conv_id", "turn", "text"), "text")


@query(
    "p6_project_rename",
    "select o_orderkey as key, o_custkey as company, o_orderstatus as status, o_totalprice as price from orders",
)
def p6(spark: SparkSession, folder: str) -> DataFrame:
    names = {"o_orderkey": "key", "o_custkey": "company", "o_orderstatus": "status", "o_totalprice": "price"}
    return rows.drop_trailing(read_parquet(spark, folder, "orders"), 2).withColumnsRenamed(names)


@query(
    "p7_sector_counts",
    "select substr(p_type, 1, 2) as sector, count(*) as n from part group by 1",
)
def p7(spark: SparkSession, folder: str) -> DataFrame:
    part = read_parquet(spark, folder, "part")
    return aggregates.value_counts(part.select(words.sector_prefix(F.col("p_type")).alias("sector")), "sector")


@query(
    "p7_sector_rows",
    "select p_partkey as key, p_name as text, cast(p_size > 25 as integer) as label from part where substr(p_type, 1, 2) = 'EC'",
)
def p7_rows(spark: SparkSession, folder: str) -> DataFrame:
    part = read_parquet(spark, folder, "part").filter(words.sector_prefix(F.col("p_type")) == "EC")
    labelled = part.withColumn("label", (F.col("p_size") > 25).cast("int"))
    return rows.load_corpus(labelled, "p_partkey", "p_name", "label")


SOURCE_SQL = """select btw, case when cur_web is not null and web is not null then 'Needs Checking'
                     else coalesce(web, cur_web, 'No Data') end as clean_web from companies"""


def _sources(spark: SparkSession, folder: str) -> DataFrame:
    table = inputs.companies(spark, folder)
    return table.select("btw", urls.website_source(F.col("cur_web"), F.col("web")).alias("clean_web"))


@query("p8_website_source", using("companies", SOURCE_SQL))
def p8(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder)


@query(
    "p9_needs_check",
    using("companies", f"select * from ({SOURCE_SQL}) where clean_web = 'No Data' or clean_web = 'Needs Checking'"),
)
def p9(spark: SparkSession, folder: str) -> DataFrame:
    return _sources(spark, folder).filter(urls.needs_check(F.col("clean_web")))


PRIMARY = f"""case when cur_web is not null then {fix_http('cur_web')}
    when cur_email is not null then {fix_http(email_url('cur_email'))}
    when web is not null then {fix_http('web')}
    when email is not null then {fix_http(email_url('email'))} else '' end"""


def _best_guess(spark: SparkSession, folder: str) -> DataFrame:
    guess = urls.assign_primary_url(*[F.col(c) for c in ("cur_web", "cur_email", "web", "email")])
    return inputs.companies(spark, folder).select("btw", guess.alias("best_guess"))


@query("p10_primary_url", using("companies", f"select btw, {PRIMARY} as best_guess from companies"))
def p10(spark: SparkSession, folder: str) -> DataFrame:
    return _best_guess(spark, folder)


@query(
    "p11_fill_best_guess",
    using(
        "companies",
        f"""select btw, case when best_guess = '' then {fix_http('found')} else best_guess end as best_guess
            from (select btw, {PRIMARY} as best_guess from companies) g
            left join (select s_suppkey * 2 as btw, lower(s_name) || '.example.com' as found from supplier) s using (btw)""",
    ),
)
def p11(spark: SparkSession, folder: str) -> DataFrame:
    manual = read_parquet(spark, folder, "supplier").select(
        (F.col("s_suppkey") * 2).alias("btw"), F.concat(F.lower("s_name"), F.lit(".example.com")).alias("found")
    )
    merged = joins.left_join(_best_guess(spark, folder), manual, "btw")
    return merged.select("btw", urls.fill_best_guess(F.col("best_guess"), F.col("found")).alias("best_guess"))


@query("p12_language_flag", "select doc_id, cast(lang = 'en' as integer) as flag from documents")
def p12(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_parquet(spark, folder, "documents")
    return documents.select("doc_id", words.language_flag(F.col("lang"), "en").alias("flag"))


@query(
    "p13_label_names",
    "select doc_id, case when quality = 1 then 'innovative' else 'not innovative' end as inno from labels",
)
def p13(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_parquet(spark, folder, "labels")
    return labels.select("doc_id", rows.recode_label(F.col("quality")).alias("inno"))


@query("p14_zip", using("companies", "select btw, coalesce(activity_zip, main_zip) as zip from companies"))
def p14(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.companies(spark, folder).select("btw", F.coalesce("activity_zip", "main_zip").alias("zip"))


@query("p15_first_html", using("rounds", "select page_id, coalesce(html_r1, html_r2) as html from rounds"))
def p15(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.rounds(spark, folder).select("page_id", F.coalesce("html_r1", "html_r2").alias("html"))


@query(
    "p16_fill_nulls",
    using(
        "companies",
        "select btw, coalesce(inno5, 0) as inno5, main_zip, coalesce(activity_zip, 0) as activity_zip from companies",
    ),
)
def p16(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.companies(spark, folder).select("btw", "inno5", "main_zip", "activity_zip").na.fill(0)


@query("p17_decide", using("proba", "select doc_id, p, prediction as decided from proba"))
def p17(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.proba(spark, folder).select("doc_id", "p", rows.decide(F.col("p")).alias("decided"))


@query(
    "p18_softmax",
    """select vec_id, round(exp(embedding[2]::double - m) / s, 6) as class_1 from (
           select vec_id, embedding, m, list_sum(list_transform(embedding, lambda x: exp(x::double - m))) as s
           from (select vec_id, embedding, list_max(embedding)::double as m from embeddings))""",
)
def p18(spark: SparkSession, folder: str) -> DataFrame:
    vectors = read_parquet(spark, folder, "embeddings")
    return vectors.select("vec_id", F.round(words.softmax(F.col("embedding"))[1], 6).alias("class_1"))


# --- joins -------------------------------------------------------------------------------------


@query(
    "j1_inner_project",
    "select o_orderkey, o_custkey, c_name, c_mktsegment from orders join customer on o_custkey = c_custkey",
)
def j1(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customer = read_parquet(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.inner_project(orders, customer, "o_custkey", ["c_name", "c_mktsegment"])


@query(
    "j2_left_join",
    """select c_custkey, c_name, s_name, s_acctbal from customer
       left join supplier on c_custkey = s_suppkey""",
)
def j2(spark: SparkSession, folder: str) -> DataFrame:
    customer = read_parquet(spark, folder, "customer").select("c_custkey", "c_name")
    supplier = read_parquet(spark, folder, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", "s_acctbal")
    return joins.left_join(customer, supplier, "c_custkey")


@query(
    "j3_join_features",
    """select l.doc_id, l.quality, d.n_chars, cast(d.lang = 'en' as integer) as in_en, round(e.embedding[1]::double, 6) as e0
       from labels l join documents d using (doc_id) join embeddings e on e.vec_id = l.doc_id""",
)
def j3(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_parquet(spark, folder, "labels").select("doc_id", "quality")
    texts = read_parquet(spark, folder, "documents").select(
        "doc_id", "n_chars", words.language_flag(F.col("lang"), "en").alias("in_en")
    )
    vectors = read_parquet(spark, folder, "embeddings").select(
        F.col("vec_id").alias("doc_id"), F.round(F.col("embedding")[0].cast("double"), 6).alias("e0")
    )
    return labels.join(texts, "doc_id").join(vectors, "doc_id")


@query(
    "j4_rank_join",
    using(
        "coefficients",
        """, low as (select feature, coef, row_number() over (order by coef, feature) as r from coefficients),
             high as (select feature, coef, row_number() over (order by coef desc, feature) as r from coefficients)
        select cast(r as integer) as rank, low.feature as negative_word, low.coef as negative_coef,
               high.feature as positive_word, high.coef as positive_coef
        from low join high using (r) where r <= 15""",
    ),
)
def j4(spark: SparkSession, folder: str) -> DataFrame:
    from sitewright.operators.models import coefficient_rows

    return coefficient_rows(inputs.coefficients(spark, folder), 15)


@query("j5_complement", "select * from documents where doc_id not in (select doc_id from labels)")
def j5(spark: SparkSession, folder: str) -> DataFrame:
    return joins.complement(read_parquet(spark, folder, "documents"), read_parquet(spark, folder, "labels"), "doc_id")


@query("j6_restrict", "select doc_id, source from documents where doc_id in (select doc_id from labels where toxic = 1)")
def j6(spark: SparkSession, folder: str) -> DataFrame:
    toxic = read_parquet(spark, folder, "labels").filter(F.col("toxic") == 1)
    return joins.restrict(read_parquet(spark, folder, "documents"), toxic, "doc_id").select("doc_id", "source")


# --- aggregates -----------------------------------------------------------------------------


@query("a1_value_counts", "select event_type, count(*) as n from events where event_type is not null group by 1")
def a1(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.value_counts(read_parquet(spark, folder, "events"), "event_type")


@query(
    "a2_language_share",
    """select lang, n, round(100.0::double * n / sum(n) over (), 1) as percent from (
           select case when lang in ('de', 'en') then lang else 'Other' end as lang, count(*) as n
           from documents group by 1)""",
)
def a2(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.grouped_share(read_parquet(spark, folder, "documents"), "lang", ["de", "en"])


@query(
    "a3_class_shares",
    "select quality, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from labels group by 1",
)
def a3(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.class_shares(read_parquet(spark, folder, "labels"), "quality")


@query(
    "a4_coverage",
    using(
        "companies",
        f"""select *, round(100.0::double * present / total, 2) as present_percent,
               round(100.0::double * missing / total, 2) as missing_percent,
               round(100.0::double * dual / total, 2) as dual_percent
            from (select count(*) as total,
                     count(*) filter (clean_web not in ('No Data', 'Needs Checking')) as present,
                     count(*) filter (clean_web = 'No Data') as missing,
                     count(*) filter (clean_web = 'Needs Checking') as dual
                  from ({SOURCE_SQL}))""",
    ),
)
def a4(spark: SparkSession, folder: str) -> DataFrame:
    source = F.col("clean_web")
    return aggregates.coverage(
        _sources(spark, folder), ~urls.needs_check(source), source == "No Data", source == "Needs Checking"
    )


@query(
    "a5_conditional_counts",
    using(
        "rounds",
        """select count(html_r1) as first_round, count(html_r2) as second_round,
               count(coalesce(html_r1, html_r2)) as found,
               count(*) filter (html_r1 is null and html_r2 is null) as unfound from rounds""",
    ),
)
def a5(spark: SparkSession, folder: str) -> DataFrame:
    first, second = F.col("html_r1").isNotNull(), F.col("html_r2").isNotNull()
    return aggregates.conditional_counts(
        inputs.rounds(spark, folder),
        {"first_round": first, "second_round": second, "found": first | second, "unfound": ~(first | second)},
    )


@query(
    "a6_score_interval",
    """select n, round(m, 6) as mean, round(lo, 6) as min, round(hi, 6) as max,
           round(m - 1.984217::double * p, 6) as lower, round(m + 1.984217::double * p, 6) as upper,
           round(m - 1.984217::double * s / sqrt(n), 6) as se_lower, round(m + 1.984217::double * s / sqrt(n), 6) as se_upper
       from (select count(a) as n, avg(a) as m, min(a) as lo, max(a) as hi, stddev_pop(a) as p, stddev_samp(a) as s
             from (select l_partkey % 100 as run, avg(l_discount * 10) as a from lineitem group by 1))""",
)
def a6(spark: SparkSession, folder: str) -> DataFrame:
    items = read_parquet(spark, folder, "lineitem")
    runs = items.groupBy((F.col("l_partkey") % 100).alias("run")).agg(F.avg(F.col("l_discount") * 10).alias("a"))
    return aggregates.score_interval(runs, "a")


@query(
    "a7_mean_score",
    """select l_returnflag, l_linestatus, round(avg(l_discount), 6) as mean_l_discount, round(avg(l_tax), 6) as mean_l_tax
       from lineitem group by 1, 2""",
)
def a7(spark: SparkSession, folder: str) -> DataFrame:
    items = read_parquet(spark, folder, "lineitem")
    means = aggregates.mean_score(items, ["l_returnflag", "l_linestatus"], ["l_discount", "l_tax"])
    return means.select(*[F.round(c, 6).alias(c) if c.startswith("mean") else c for c in means.columns])


@query(
    "a8_accuracy",
    using("proba", "select round(avg(cast(label = prediction as integer)), 6) as accuracy from proba"),
)
def a8(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.accuracy(inputs.proba(spark, folder))


REPORT_SQL = """, pairs as (select label as y, prediction as p, count(*) as n from proba group by 1, 2),
    classes as (select y as c from pairs union select p from pairs),
    scores as (select c, sum(case when y = c and p = c then n else 0 end) as tp,
                      sum(case when y = c then n else 0 end) as support,
                      sum(case when p = c then n else 0 end) as said
               from classes, pairs group by c),
    per as (select c, tp, support, case when said > 0 then tp / said::double else 0 end as precision,
                   case when support > 0 then tp / support::double else 0 end as recall,
                   case when said + support > 0 then 2.0::double * tp / (said + support) else 0 end as f1 from scores)"""


@query(
    "a9_report",
    using(
        "proba",
        REPORT_SQL
        + """ select class, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1,
                     cast(support as bigint) as support from (
            select cast(c as varchar) as class, precision, recall, f1, support from per
            union all select 'accuracy', sum(tp) / sum(support)::double, sum(tp) / sum(support)::double, sum(tp) / sum(support)::double, sum(support) from per
            union all select 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) from per
            union all select 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
                             sum(f1 * support) / sum(support), sum(support) from per)""",
    ),
)
def a9(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.classification_report(inputs.proba(spark, folder))


@query("a10_macro_f1", using("proba", REPORT_SQL + " select round(avg(f1), 6) as macro_f1 from per"))
def a10(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.macro_f1(inputs.proba(spark, folder))


@query(
    "a11_histogram",
    using(
        "proba",
        """, lim as (select label, min(p) as lo, max(p) as hi from proba group by 1)
        select label, cast(case when hi > lo then least(floor((p - lo) / (hi - lo) * 50), 49) else 25 end as integer) as bin,
               count(*) as n from proba join lim using (label) group by 1, 2""",
    ),
)
def a11(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.histogram(inputs.proba(spark, folder), "label", "p")


@query(
    "a12_term_counts",
    using("words", "select term, count(*) as tf, count(distinct doc_id) as df from words group by term"),
)
def a12(spark: SparkSession, folder: str) -> DataFrame:
    return inputs.word_counts(spark, folder)


@query(
    "a13_any_match",
    """select o_custkey, coalesce(bool_or(l_shipdate > o_orderdate + interval 30 day), false) as matched
       from orders left join lineitem on l_orderkey = o_orderkey group by 1""",
)
def a13(spark: SparkSession, folder: str) -> DataFrame:
    orders = read_parquet(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = read_parquet(spark, folder, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate")
    late = F.col("l_shipdate") > F.col("o_orderdate") + F.expr("interval 30 days")
    return aggregates.any_match(orders.join(items, "o_orderkey", "left"), "o_custkey", late)
