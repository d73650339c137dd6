"""URL verdicts: host rules, and naive Bayes on segmented host and path words where no rule fits."""

from __future__ import annotations

import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitewright.functions.html import page_text
from sitewright.llm.texts import ascii_lower, narrow, whole
from sitewright.operators.joins import SALTS, lookup
from sitewright.sources.tables import save_stage

ALLOW, BLOCK = "allow", "block"
LONGEST_WORD = 20
SMOOTHING = 1.0


@dataclass(frozen=True)
class Rule:
    """A verdict for a host with all its subdomains, for paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule(ALLOW, "org", "/"),
    Rule(BLOCK, "example.org", "/es/"),
    Rule(BLOCK, "example.org", "/en/1"),
    Rule(ALLOW, "com", "/fr/"),
    Rule(BLOCK, "com", "/de/"),
)


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(whole(url), "://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(whole(url), "://[^/?#]*([^?#]*)", 1)


def first_rule(host: Column, path: Column, rules: tuple[Rule, ...], value) -> Column:
    """``value(rule)`` of the longest rule that fits, the one with the longer host of equals; null if none does."""
    chosen = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), len(r.host), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        chosen = F.when(fits, F.lit(value(rule))).otherwise(chosen)
    return chosen


def word_counts(texts: DataFrame, text: Column, longest: int = LONGEST_WORD) -> DataFrame:
    """(word, n): how often each word of plain letters a-z occurs in the texts."""
    words = texts.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.filter(F.col("word").rlike(f"^[a-z]{{2,{longest}}}$")).groupBy("word").agg(F.count("*").alias("n"))


def best_split(run: str, counts: dict[str, int], total: int, longest: int = LONGEST_WORD) -> list[str]:
    """Viterbi split of a run of letters under unigram word counts.

    An unknown word of length n has probability 10 / (total * 10 ** n). Of equally likely splits the one with the
    longer last word wins.
    """
    size = len(run)
    score, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
    for end in range(1, size + 1):
        for start in range(max(0, end - longest), end):
            n = counts.get(run[start:end], 0)
            gain = math.log(n / total) if n else math.log(10 / total) - (end - start) * math.log(10)
            if score[start] + gain > score[end]:
                score[end], back[end] = score[start] + gain, start
    words, end = [], size
    while end:
        words.append(run[back[end] : end])
        end = back[end]
    return words[::-1]


def segment_runs(runs: DataFrame, words: DataFrame, longest: int = LONGEST_WORD) -> DataFrame:
    """(run, words): every distinct run of letters split into words.

    The substrings of a run are joined to the word counts, so the word list may have any size and is never
    broadcast by force; a run gets only the words it contains.
    """
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] or 1
    ends = F.sequence(F.lit(2), F.lit(longest))
    starts = runs.select("run", F.explode(F.sequence(F.lit(1), F.greatest(F.length("run"), F.lit(1)))).alias("start"))
    parts = (
        starts.select("run", "start", F.explode(ends).alias("size"))
        .filter(F.col("start") + F.col("size") - 1 <= F.length("run"))
        .select("run", F.substring("run", F.col("start"), F.col("size")).alias("word"))
        .distinct()
    )
    known = parts.join(words, "word").groupBy("run").agg(F.collect_list(F.struct("word", "n")).alias("known"))

    @F.pandas_udf("array<string>")
    def split(run: pd.Series, known: pd.Series) -> pd.Series:
        out = []
        for r, k in zip(run, known, strict=True):
            counts = {} if k is None else {x["word"]: x["n"] for x in k}
            out.append(best_split(r, counts, total, longest))
        return pd.Series(out)

    return runs.join(known, "run", "left").select("run", split("run", "known").alias("words"))


def url_parts(host: Column, path: Column) -> Column:
    """Array of (place, run, fixed): runs of letters to be split, and for digits a token that tells their number."""

    def parts(text: Column, place: str) -> Column:
        letters = F.transform(
            F.regexp_extract_all(ascii_lower(text), F.lit("[a-z]+"), F.lit(0)),
            lambda x: F.struct(F.lit(place).alias("place"), x.alias("run"), F.lit(False).alias("fixed")),
        )
        digits = F.transform(
            F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)),
            lambda x: F.struct(
                F.lit(place).alias("place"), F.concat(F.lit("#"), F.length(x).cast("string")).alias("run"), F.lit(True).alias("fixed")
            ),
        )
        return F.concat(letters, digits)

    return F.concat(parts(host, "host"), parts(path, "path"))


def judge(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    rules: tuple[Rule, ...] = RULES,
    words: DataFrame | None = None,
) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score.

    The longest fitting rule decides; elsewhere multinomial naive Bayes does, which learns from the pages that rules decide:
    their host and path words, counted once per page. A positive score (log odds of block) blocks; a tie allows, and so
    does everything while rules give only one of the two verdicts or none. ``words`` has word counts (word, n); by
    default the visible text of all pages is counted.

    A null url, or one without ``://``, has empty host and path, no rule and only the prior. Repeated rows come out
    each, null page_ids stay null, an empty table gives no rows, further columns are ignored. Work on words is done per
    distinct run of letters and per distinct (host, path), so a hot host counts once; what is left of it is salted.
    """
    rows = narrow(pages, page_id=page_id, url=url).select(
        "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    )
    rule = lambda value: first_rule(F.col("host"), F.col("path"), rules, value)
    urls = save_stage(
        rows.groupBy("host", "path")
        .agg(F.count("*").alias("pages"))
        .withColumn("rule", rule(lambda r: r.name))
        .withColumn("ruled", rule(lambda r: r.verdict))
        .withColumn("url_id", F.xxhash64("host", "path")),
        "urls",
    )
    # host runs come from distinct hosts first, so that a host with many paths adds its runs once per distinct url only
    parts = save_stage(
        urls.select("url_id", "pages", "ruled", F.inline(url_parts(F.col("host"), F.col("path")))), "url-parts"
    )
    if words is None:
        words = word_counts(pages.select(F.col(html).alias("html")), page_text(F.col("html")))
    words = save_stage(words, "words")
    split = segment_runs(parts.filter(~F.col("fixed")).select("run").distinct(), words)
    fixed = parts.filter("fixed").select("run").distinct().select("run", F.array("run").alias("words"))
    split = save_stage(split.unionByName(fixed), "split")

    in_class = lambda verdict: F.sum(F.when(F.col("ruled") == verdict, F.col("pages")).otherwise(0))
    prior = urls.agg(in_class(ALLOW), in_class(BLOCK)).first()
    allowed, blocked = prior[0] or 0, prior[1] or 0
    taught = bool(allowed and blocked)
    per_run = parts.groupBy("place", "run").agg(in_class(ALLOW).alias("a"), in_class(BLOCK).alias("b"))
    per_run = save_stage(per_run.join(split, "run"), "runs")
    per_word = per_run.select("place", "a", "b", F.explode("words").alias("word")).groupBy("place", "word")
    counts = save_stage(per_word.agg(F.sum("a").alias("a"), F.sum("b").alias("b")), "word-classes")
    total_a, total_b, kinds = counts.agg(F.sum("a"), F.sum("b"), F.count("*")).first()
    odds = (
        F.log(F.col("b") + SMOOTHING)
        - F.log(F.lit((total_b or 0) + SMOOTHING * (kinds + 1)))
        - F.log(F.col("a") + SMOOTHING)
        + F.log(F.lit((total_a or 0) + SMOOTHING * (kinds + 1)))
    )
    weights = counts.select("place", "word", odds.alias("weight"))
    run_scores = (
        per_run.select("place", "run", F.explode("words").alias("word"))
        .join(weights, ["place", "word"])
        .groupBy("place", "run")
        .agg(F.sum("weight").alias("weight"))
        .select(F.concat_ws(":", "place", "run").alias("part"), "weight")
    )
    asked = parts.select("url_id", F.concat_ws(":", "place", "run").alias("part"))
    scores = lookup(asked, run_scores, "part", ["url_id"], salts=SALTS).groupBy("url_id").agg(F.sum("weight").alias("evidence"))
    start = math.log(blocked / allowed) if taught else 0.0
    score = (F.lit(start) + F.coalesce("evidence", F.lit(0.0))) if taught else F.lit(0.0)
    decided = (
        urls.join(scores, "url_id", "left")
        .withColumn("score", F.round(score, 9))
        .withColumn("verdict", F.coalesce("ruled", F.when(F.col("score") > 0, BLOCK).otherwise(ALLOW)))
        .select("host", "path", "rule", "verdict", "score")
    )
    return rows.join(decided, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "score")
