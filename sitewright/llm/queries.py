"""Registered queries with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitewright.llm import (
    decontaminate,
    divergence,
    exact_dedup,
    jaccard_join,
    language,
    line_dedup,
    pieces,
    prefix_trie,
    quality,
    sharding,
    simhash,
    token_counts,
    url_filter,
)
from sitewright.llm.registry import JOBS, SQL, query, tokenizer_file  # noqa: F401
from sitewright.llm.texts import sha256_hex
from sitewright.session import new_table_path
from sitewright.sources.tables import read_parquet

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return read_parquet(spark, folder, "documents")


@query("op1_language_mixture")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder)
    model = language.fit_on_documents(docs)
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "row.doc_id",
        language.held_out("row.doc_id").alias("held_out"),
        "lang_pred",
        "score",
        F.size("mixture").alias("n_languages"),
    )


@query(
    "op2_line_dedup",
    f"""
    with split as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as place
                   from (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents)),
         keyed as (select *, {LOWER.format(f"trim(line, {BLANK})")} as key from split),
         often as (select key from keyed where length(key) >= 1 group by key having count(distinct doc_id) >= 10),
         marked as (select k.*, o.key is not null as gone from keyed k left join often o on o.key = k.key)
    select doc_id, count(*)::bigint as n_lines, (count(*) filter (where gone))::bigint as n_dropped,
           sha256(coalesce(string_agg(line, chr(10) order by place) filter (where not gone), '')) as kept_sha256
    from marked group by doc_id""",
)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(documents(spark, folder), by_id=True)
    return kept.select("doc_id", "n_lines", "n_dropped", sha256_hex("kept_text").alias("kept_sha256"))


@query("op3_perplexity")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_parquet(spark, folder, "labels")
    return quality.score_documents(documents(spark, folder), labels, position=quality.file_position())


@query("op4_url_words")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return url_filter.judge(read_parquet(spark, folder, "pages"))


@query("op5_simhash")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicate_classes(documents(spark, folder))


@query("op6_piece_encoding")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    encoded = pieces.encode_documents(documents(spark, folder), tokenizer_file())
    return encoded.select(
        "doc_id",
        "n_tokens",
        sha256_hex("ids_text").alias("ids_sha256"),
        sha256_hex("decoded").alias("decoded_sha256"),
    )


@query("op7_flow_sharding")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    placed = sharding.reshard(documents(spark, folder).select("doc_id", "text"))
    return placed.select(
        "row.doc_id",
        "size",
        F.crc32(F.coalesce("row.text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_token_counts")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """A first pass fills the cache from every eighth document by hash; the pass over all documents meets hits and misses."""
    cache = token_counts.empty_cache(spark, new_table_path(spark, "token-cache"))
    docs, proto = documents(spark, folder), tokenizer_file()
    token_counts.fill_cache(docs.filter(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(8)) == 0), proto, cache)
    return token_counts.count_tokens(docs, proto, cache)


@query(
    "op9_exact_dedup",
    f"""
    with hashed as (select doc_id, sha256({LOWER.format("coalesce(text, '')")}) as text_sha256 from documents),
         grouped as (select text_sha256, max(doc_id) as keep_id, count(*)::bigint as group_size from hashed group by 1)
    select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256
    from hashed join grouped using (text_sha256)""",
)
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, folder)).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("text_sha256")
    )


@query(
    "op10_decontamination",
    """
    with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from documents),
         i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') as w from benchmark),
         ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' '))) as s
                from d where len(w) >= 5),
         s as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda p: array_to_string(w[p:p+4], ' '))) as s
               from i where len(w) >= 5),
         sizes as (select item_id, count(*) as n_shingles from s group by 1)
    select doc_id, item_id, count(*)::bigint as n_shared, n_shingles::bigint as n_shingles, count(*) / n_shingles as containment
    from ds join s using (s) join sizes using (item_id)
    group by doc_id, item_id, n_shingles having count(*) >= 0.8 * n_shingles - 1e-9""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contained_items(documents(spark, folder), read_parquet(spark, folder, "benchmark"))


@query(
    "op11_source_divergence",
    f"""
    with d as (select row_number() over () as doc, coalesce(lang, '') as lang, coalesce(source, '') as source,
                      regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w
               from documents),
         t as (select doc, lang, source, unnest(w) as term from d),
         kept as (select lang, term from t group by all having count(distinct doc) >= 10),
         v as (select lang, count(*) as v from kept group by lang),
         c as (select lang, source, term, count(*) as n from t join kept using (lang, term) group by all),
         g as (select distinct lang, source from d),
         totals as (select lang, source, coalesce(sum(n), 0) as total from g left join c using (lang, source) group by all),
         q as (select lang, term, 1 + 1000000000::hugeint * (sum(n) + 2) // ((sum(sum(n)) over (partition by lang)) + 2 * any_value(v)) as q
               from c join v using (lang) group by lang, term),
         p as (select lang, source, term, coalesce(n, 0) as n,
                      1 + 1000000000::hugeint * (coalesce(n, 0) + 2) // (total + 2 * v) as p
               from totals join kept using (lang) join v using (lang) left join c using (lang, source, term)),
         pairs as (select a.lang, a.source, b.source as item,
                          sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
                   from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
         every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0)::bigint as value
                   from g a join g b on a.lang = b.lang and a.source <> b.source
                   left join pairs on pairs.lang = a.lang and pairs.source = a.source and pairs.item = b.source
                   union all
                   select lang, source, 'term', term, ((p - q) * (p - q) // (p + q))::bigint from p join q using (lang, term)
                   where n > 0 and p > q),
         ranked as (select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from every)
    select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 10""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(documents(spark, folder))


# unsigned CRC-32 of the decimal digits of a number, bit by bit
CRC32 = """xor(4294967295::bigint, list_reduce(
    list_concat([4294967295::bigint], list_transform(string_split({0}::varchar, ''), lambda ch: ord(ch)::bigint)),
    lambda acc, byte: list_reduce([xor(acc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
                                  lambda crc, bit: xor(crc >> 1, 3988292384::bigint * (crc & 1)))))"""


@query(
    "op12_prefix_trie",
    f"""
    with t as (select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
                      row_number() over (partition by conv_id order by turn nulls first,
                          md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as place
               from conversations where conv_id is not null),
         convs as (select distinct c, c - c % 5 as base, {CRC32.format("c")} % 9 as h from t),
         r as (select convs.c, 0 as half, place, role, text from convs join t on t.c = convs.base where place <= h
               union all select c, 1, place, role, text from t join convs using (c) where place > h),
         steps as (select c, row_number() over one as depth, text,
                          string_agg(md5(role || '/' || md5(text)), '' order by half, place) over one as path
                   from r window one as (partition by c order by half, place)),
         every as (select c, depth, md5(path) as node, lag(md5(path), 1, 'root') over (partition by c order by depth) as parent,
                          octet_length(encode(text)) as size from steps
                   union all select c, 0, 'root', null, 0 from convs),
         nodes as (select node, min(c) as conv_id, any_value(depth) as depth, any_value(parent) as parent, count(*) as n_convs,
                          any_value(size) as size from every group by node),
         children as (select parent as node, count(*) as n_children from nodes where parent is not null group by 1),
         own as (select *, coalesce(n_children, 0) as kids from nodes left join children using (node)),
         inside as (select e.node, count(*) filter (where kids = 0) as n_leaves, sum((own.n_convs - 1) * own.size) as saved
                    from own join every e on e.c = own.conv_id and e.depth <= own.depth group by 1),
         lasts as (select c, arg_max(node, depth) as node from every group by c),
         ends as (select node, string_agg(c::varchar, ',' order by c) as ids from lasts group by node)
    select own.conv_id, own.depth::bigint as depth, up.conv_id as parent_conv_id, own.n_convs::bigint as n_convs,
           own.kids::bigint as n_children, n_leaves::bigint as n_leaves, saved::bigint as saved_tokens,
           sha256(coalesce(ids, '')) as ends_sha256
    from own join inside using (node) left join ends using (node) left join nodes up on up.node = own.parent""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    turns, members = prefix_trie.rebuilt_turns(prefix_trie.turn_rows(read_parquet(spark, folder, "conversations")))
    nodes = prefix_trie.trie(turns, members, order=("half", "place"))
    return nodes.withColumnsRenamed({"conv": "conv_id", "parent_conv": "parent_conv_id", "saved": "saved_tokens"})


@query(
    "op13_jaccard_join",
    f"""
    with recursive
         w as (select doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') as w from documents),
         s as (select distinct doc_id, unnest(case when len(w) < 3 then [array_to_string(w, ' ')]
                      else list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' ')) end) as shingle
               from w where len(w) > 0),
         sizes as (select doc_id, count(*) as n from s group by 1),
         shared as (select a.doc_id as a, b.doc_id as b, count(*) as both_have
                    from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
         links as (select a, b from shared join sizes x on x.doc_id = a join sizes y on y.doc_id = b
                   where 100 * both_have >= 90 * (x.n + y.n - both_have)),
         reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join links l on l.a = r.b)
    select d.doc_id, coalesce(n, 0)::bigint as n_shingles, (select min(b) from reach where a = d.doc_id) as component_id
    from documents d left join sizes using (doc_id)""",
)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.similar_documents(documents(spark, folder))
