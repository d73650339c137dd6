"""Source divergence audit: how far the term shares of sources differ from each other and from their language."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitewright.llm.texts import whole
from sitewright.sources.tables import save_stage

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
PART_BYTES = 1 << 20  # of a text, so much is split at a time
HELD_TERMS, HELD_BYTES = 1 << 17, 1 << 25  # counts a task holds before it hands them on
PRESENT = b""  # no term is empty: one such row per document shows the group, also without terms

Group = tuple[str, str]


def translate_table() -> bytes:
    """Bytes of terms stay, A-Z are lowered, all others become blanks; every byte of a multi-byte character stays."""
    return bytes(b if b >= 0x80 or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))


def term_counter(text: bytes, table: bytes, part_bytes: int = PART_BYTES) -> Counter:
    """Occurrences per term. A long text is split part by part, cut at blanks, so only its distinct terms are held."""
    lowered = text.translate(table)
    counts: Counter = Counter()
    start = 0
    while start < len(lowered):
        end = lowered.find(b" ", start + part_bytes)
        end = len(lowered) if end < 0 else end
        counts.update(lowered[start:end].split())
        start = end
    return counts


def count_partitions(held_terms: int = HELD_TERMS, held_bytes: int = HELD_BYTES):
    """Worker function: (lang, source, text as bytes) -> lang, source, term, n (occurrences), docs.

    Counts of documents of one group are added up in the task, up to a bound, before they are shuffled.
    """
    table = translate_table()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences: dict[Group, Counter] = {}
        holders: dict[Group, Counter] = {}
        held = size = 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for group, docs in holders.items():
                terms = list(docs)
                columns = [
                    pa.array([group[0]] * len(terms), pa.string()),
                    pa.array([group[1]] * len(terms), pa.string()),
                    pa.array(terms, pa.binary()),
                    pa.array([occurrences[group].get(term, 0) for term in terms], pa.int64()),
                    pa.array(list(docs.values()), pa.int64()),
                ]
                whole_group = pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
                yield from (whole_group.slice(i, 10_000) for i in range(0, len(terms), 10_000))
            occurrences.clear()
            holders.clear()

        for batch in batches:
            for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                group = (lang.as_py(), source.as_py())
                counts = term_counter(text.as_py(), table)
                docs = holders.setdefault(group, Counter())
                before = len(docs)
                docs.update(counts.keys())
                docs[PRESENT] += 1
                total = occurrences.setdefault(group, Counter())
                for term, n in counts.items():
                    total[term] += n
                held += len(docs) - before
                size += sum(map(len, counts)) if len(docs) > before else 0
                if held >= held_terms or size >= held_bytes:
                    yield from flushed()
                    held = size = 0
        yield from flushed()

    return run


def _share(count: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (total + 2 * vocabulary)), exact for any count."""
    above = F.lit(SCALE).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    below = (F.col("total") + 2 * F.col("vocabulary")).cast("decimal(20,0)")
    return F.lit(1).cast("long") + F.call_function("div", above, below)


def _gap(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so the square fits a bigint."""
    a, b = F.col(p), F.col(q)
    return F.call_function("div", (a - b) * (a - b), a + b)


def divergence(
    docs: DataFrame,
    lang: str = "lang",
    source: str = "source",
    text: str = "text",
    min_docs: int = MIN_DOCS,
    top_terms: int = TOP_TERMS,
) -> DataFrame:
    """(lang, source, part, item, value, rank) of every occurring group of language and source.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z lowered; a language keeps those in ``min_docs`` of its
    documents or more. Every kept term has a smoothed share in every group and language. Part ``pair``: the gap
    between the group and each other source of its language, summed over all kept terms. Part ``term``: the terms
    used more than in the language at large, the first ``top_terms`` by their gap. Ranks go by value, then by the
    item's bytes.

    Null texts, languages and sources count as empty strings, so they form groups as any other. Documents without terms
    still make their group known. A language without kept terms has pairs of value 0 and no terms; one with a single
    source has no pairs. Repeated rows are documents of their own. An empty table gives no rows; further columns are
    ignored.

    Counts are sparse: a term is stored only for the groups that use it. A pair's sum is that of two groups that use no
    kept term, corrected by terms used in one of them (by a histogram of shares) and in both (by a join on the term).
    """
    narrow = docs.select(
        whole(lang).alias("lang"), whole(source).alias("source"), whole(text).cast("binary").alias("text")
    )
    counted = narrow.mapInArrow(count_partitions(), "lang string, source string, term binary, n long, docs long")
    # dealt by language and term: sums per group and per language need one shuffle
    summed = counted.repartition("lang", "term").groupBy("lang", "source", "term").agg(
        F.sum("n").alias("n"), F.sum("docs").alias("docs")
    )
    in_lang = Window.partitionBy("lang", "term")
    every = summed.withColumn("n_lang", F.sum("n").over(in_lang)).withColumn("docs_lang", F.sum("docs").over(in_lang))
    marker = F.octet_length("term") == 0
    kept = save_stage(every.filter(marker | (F.col("docs_lang") >= min_docs)).drop("docs", "docs_lang"), "terms")

    used = kept.filter(~marker)
    # one row per group and one per language; every group has a marker row, so none is missing
    in_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    # a term's own language row is counted once, at its smallest source
    first = used.groupBy("lang", "term").agg(F.min("n_lang").alias("n_lang"))
    by_lang = first.groupBy("lang").agg(F.count("*").alias("vocabulary"), F.sum("n_lang").alias("total"))
    sized = in_group.join(by_lang.withColumnRenamed("total", "total_lang"), "lang", "left").withColumn(
        "vocabulary", F.coalesce("vocabulary", F.lit(0).cast("long"))
    )
    some = F.col("vocabulary") > 0
    groups = save_stage(sized.withColumn("p0", F.when(some, _share(F.lit(0)))), "groups")

    shares = used.join(groups, ["lang", "source"]).withColumn("p", _share(F.col("n")))
    in_all = shares.withColumn("total", F.col("total_lang")).withColumn("q", _share(F.col("n_lang")))
    shares = save_stage(in_all.select("lang", "source", "term", "p", "p0", "q"), "shares")

    more = shares.filter((F.col("p") > F.col("q"))).select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), _gap("p", "q").alias("value")
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = more.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_terms)

    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"))
    base = groups.join(other, "lang").filter("source <> item")
    base = base.select("lang", "source", "item", F.coalesce(F.col("vocabulary") * _gap("p0", "q0"), F.lit(0)).alias("value"))
    levels = shares.groupBy("lang", "source", "p", "p0").agg(F.count("*").alias("terms"))
    alone = levels.join(other, "lang").filter("source <> item")
    alone = alone.groupBy("lang", "source", "item").agg(
        F.sum(F.col("terms") * (_gap("p", "q0") - _gap("p0", "q0"))).alias("value")
    )
    right = shares.select("lang", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("p0").alias("q0"))
    both = shares.drop("q").join(right, ["lang", "term"]).filter("source < item")
    gain = _gap("p", "q") - _gap("p", "q0") - _gap("p0", "q") + _gap("p0", "q0")
    both = both.groupBy("lang", "source", "item").agg(F.sum(gain).alias("value"))
    pair = [F.struct(F.col(a).alias("source"), F.col(b).alias("item")) for a, b in (("source", "item"), ("item", "source"))]
    both_ways = alone.unionByName(both).select("lang", F.explode(F.array(*pair)).alias("pair"), "value")
    both_ways = both_ways.select("lang", "pair.source", "pair.item", "value")
    sums = base.unionByName(both_ways).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    pairs = sums.withColumn("rank", F.row_number().over(order)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
