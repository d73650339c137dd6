"""Host and path, rules, word splits and naive Bayes against direct computation."""

import math
import re
from collections import Counter
from itertools import product

import pytest

from sitewright.llm import url_filter
from sitewright.llm.url_filter import ALLOW, BLOCK, RULES, best_split

WORDS = {"the": 900, "ring": 40, "there": 60, "ing": 200, "blog": 30, "red": 50, "news": 45, "es": 20, "casino": 9, "de": 70, "fr": 70}


def parts(url):
    at = (url or "").find("://")
    if at < 0:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url[at + 3 :], re.S)
    return re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]


def rule_of(host, path):
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


def tokens(host, path):
    for place, text in (("host", host), ("path", path)):
        for run in re.findall("[a-z]+", re.sub("[A-Z]", lambda x: x[0].lower(), text)):
            for word in best_split(run, WORDS, sum(WORDS.values())):
                yield place, word
        for run in re.findall("[0-9]+", text):
            yield place, f"#{len(run)}"


def brute(rows):
    ruled = [(rule_of(*parts(u)), Counter(tokens(*parts(u)))) for _, u in rows]
    counts = {v: sum((t for r, t in ruled if r and r.verdict == v), Counter()) for v in (ALLOW, BLOCK)}
    pages = {v: sum(1 for r, _ in ruled if r and r.verdict == v) for v in (ALLOW, BLOCK)}
    kinds = len({t for _, ts in ruled for t in ts})
    out = Counter()
    for (i, u), (rule, ts) in zip(rows, ruled, strict=True):
        score = 0.0
        if pages[ALLOW] and pages[BLOCK]:
            score = math.log(pages[BLOCK] / pages[ALLOW])
            for t, n in ts.items():
                p = {v: (counts[v][t] + 1) / (counts[v].total() + kinds + 1) for v in counts}
                score += n * math.log(p[BLOCK] / p[ALLOW])
        verdict = rule.verdict if rule else BLOCK if score > 0 else ALLOW
        out[i, *parts(u), rule.name if rule else None, verdict, round(score, 6) + 0.0] += 1
    return out


URLS = [f"http{s}://{h}.example.{d}/{p}" for s, h, d, p in product(["", "s"], ["thering", "blog.casino", "m.rednews"], ["org", "com", "net"], ["en/12", "es/7.html", "fr/x?y=/de/", "de/9#/fr/", "en/2"])]
URLS += ["HTTP://WWW.Example.ORG/ES/1", "ftp://org/", "x://org", "://com/fr/", "a://b://com/fr/", "http://notexample.org/es/1", "http://example.org/en/1", "http://example.org/en/12?x", None, "", "nothing", "http://", "http:///fr/", "http://com:80/fr/", "http://é.com/fr/ü\nx", "http://" + "the" * 500 + ".net/" + "z" * 300]


@pytest.fixture(scope="module")
def words(spark):
    return spark.createDataFrame(list(WORDS.items()), "word string, n long")


def pages(spark, rows):
    return spark.createDataFrame([(i, u, None, "clash", "clash", "clash") for i, u in rows], "page_id long, url string, html string, host string, part string, verdict string")


def test_verdicts(spark, words):
    rows = list(enumerate(URLS)) + [(0, URLS[0]), (None, URLS[3]), (None, None)] + [(500 + i, "http://hot.example.net/es/1") for i in range(60)]
    got = url_filter.judge(pages(spark, rows), words=words).collect()
    assert Counter((r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 6) + 0.0) for r in got) == brute(rows)
    assert url_filter.judge(pages(spark, []), words=words).collect() == []
    one_sided = url_filter.judge(pages(spark, [(1, "http://a.org/x"), (2, "http://a.net/es/")]), words=words).collect()
    assert {r.page_id: r.verdict for r in one_sided} == {1: ALLOW, 2: ALLOW}


def all_splits(run):
    for cuts in product([0, 1], repeat=len(run) - 1):
        words, start = [], 0
        for i, cut in enumerate(cuts, 1):
            if cut:
                words.append(run[start:i])
                start = i
        yield [*words, run[start:]]


def test_viterbi_finds_the_best_split():
    total = sum(WORDS.values())

    def value(words):
        return sum(math.log(WORDS[w] / total) if w in WORDS else math.log(10 / total) - len(w) * math.log(10) for w in words)

    for run in ["thering", "therenews", "casinoblog", "xqzthe", "rednewses", "a", "theretheing"]:
        got = best_split(run, WORDS, total)
        assert "".join(got) == run
        assert abs(value(got) - max(map(value, all_splits(run)))) < 1e-9
    assert best_split("therednews", WORDS, total) == ["the", "red", "news"]


def test_words_come_from_visible_text(spark):
    html = "<html><head><title>hidden</title></head><body><p>The ring, the RING x été</p><script>var secret</script></body></html>"
    rows = spark.createDataFrame([(html,), (None,), ("",)], "html string")
    got = {r.word: r.n for r in url_filter.word_counts(rows, url_filter.page_text(rows["html"])).collect()}
    assert got == {"the": 2, "ring": 2}
