"""Hand-made rows for behavior that the given tables do not show."""

import pytest
from pyspark.sql import functions as F

from sitewright.functions import html, urls, words


def values(spark, rows, column, schema="x string"):
    return [r[0] for r in spark.createDataFrame([(r,) if not isinstance(r, tuple) else r for r in rows], schema).select(column).collect()]


def test_fix_http(spark):
    rows = ["a.be", "a.be/", "http://a.be", "https://a.be/", "", None, "x.http"]
    want = ["http://a.be/", "http://a.be/", "http://a.be/", "https://a.be/", None, None, "x.http/"]
    assert values(spark, rows, urls.fix_http(F.col("x"))) == want


def test_url_from_email(spark):
    rows = ["info@my-firm.be", "a@b.com", "nobody", "", None, "x@9a.be"]
    assert values(spark, rows, urls.url_from_email(F.col("x"))) == ["my", "b.com", "", "", "", ""]


def test_primary_url_stops_at_email_without_domain(spark):
    rows = [
        ("w.be", "i@f.be", None, None),
        (None, "i@f.be", "w.be", None),
        (None, "nobody", "w.be", None),
        (None, None, "w.be", "i@f.be"),
        (None, None, None, "i@f.be"),
        (None, None, None, None),
        ("", "i@f.be", None, None),
    ]
    column = urls.assign_primary_url(*[F.col(c) for c in "abcd"])
    got = values(spark, rows, column, "a string, b string, c string, d string")
    assert got == ["http://w.be/", "http://f.be/", None, "http://w.be/", "http://f.be/", "", None]


def test_fill_best_guess_keeps_null(spark):
    rows = [("", "a.be"), ("", None), ("http://b.be/", "a.be"), (None, "a.be")]
    got = values(spark, rows, urls.fill_best_guess(F.col("g"), F.col("f")), "g string, f string")
    assert got == ["http://a.be/", None, "http://b.be/", None]


def test_resolve_link(spark):
    rows = ["/x", "./x.", "..", "http://a.be", "x?u=http"]
    got = values(spark, rows, urls.resolve_link(F.lit("http://p.be/"), F.col("x")))
    assert got == ["http://p.be//x", "http://p.be//x", "http://p.be/", "http://a.be", "x?u=http"]


def test_street_and_hits(spark):
    rows = ["Main street 12 (bus 3)", "", None]
    assert values(spark, rows, urls.street_name(F.col("x"))) == ["Main street  ", "", None]
    assert values(spark, ["www.a.be › shop › x", "www.a.be  ", None], urls.hit_site(F.col("x"))) == ["www.a.be", "www.a.be", None]
    assert values(spark, ["A   B\nC", None], urls.search_phrase(F.col("x"))) == ["A BC", None]


def test_visible_text(spark):
    page = (
        "<html><head><title>T</title><meta></head><body><!-- <b>no</b> --><p>a &amp; b</p>\n\n\n<SCRIPT>x('</p>')</SCRIPT>"
        "<style>p{}</style><b>c</b><i>d</i></body></html>"
    )
    assert values(spark, [page], html.visible_text(F.col("x"))) == [" a & b c d "]


def test_escaped_markup_goes_in_the_second_pass(spark):
    assert values(spark, ["<p>a &amp; &lt;b&gt; c"], html.page_text(F.col("x"))) == ["a & c"]


def test_entities(spark):
    rows = ["&eacute;&#233;&#xE9;&#128512;", "&nope; & x", "&nbsp;", None, "a"]
    assert values(spark, rows, html.decode_entities(F.col("x"))) == ["éé" "é😀", "&nope; & x", " ", None, "a"]


@pytest.mark.parametrize(
    ("page", "left"),
    [
        ('a<div id="cookiebar">b<div>c</div>d</div>e', "ae"),
        ("a<DIV CLASS='my-popup x'>b<DIV>c</DIV></DIV>e<div>f</div>", "ae<div>f</div>"),
        ('a<div class="x"><div id=cookie>b</div>c</div>d', 'a<div class="x">c</div>d'),
        ('a<div id="cook">b<div class="popup">c</div></div>d<div id="cook">e</div>f', "adf"),
        ('a<div data-x="cook">b</div>', 'a<div data-x="cook">b</div>'),
        ('a<div id="COOK">b</div>', 'a<div id="COOK">b</div>'),
        ('<script>"<div id=cook>"</script>a<div>b</div>', "a<div>b</div>"),
        ("plain", "plain"),
        ('a<div id="cook">never closed', "a"),
    ],
)
def test_remove_popups(spark, page, left):
    assert values(spark, [page], html.remove_popups(F.col("x"))) == [left]


def test_links(spark):
    page = (
        "<link rel=x href='s.css'><a href=\"/a?x=1&amp;y=2\" hreflang=\"nl-be\"> <b>NL</b> site </a>"
        "<a name=q>no</a><!-- <a href='c'>c</a> --><A HREF=up>Up</A><script>'<a href=\"s\">'</script>"
    )
    got = values(spark, [page], html.links(F.col("x")))[0]
    assert [tuple(link) for link in got] == [("s.css", "", None), ("/a?x=1&y=2", "nl site", "nl-be"), ("up", "up", None)]


def test_numbers_are_whole_tokens(spark):
    page = "<script>9999</script><p>B-9000 Gent</p><td>12</td><td>34</td> 019000"
    assert values(spark, [page], html.numeric_tokens(F.col("x"))) == [["9000", "1234", "019000"]]


def test_clean_text(spark):
    rows = ["Hello\nWorld a1b2 of", "été Straße", "...", "", None]
    assert values(spark, rows, words.clean_text(F.col("x"))) == ["helloworld", "strae", "", "", None]
    apart = words.clean_text(F.col("x"), separator=" ")
    assert values(spark, ["Hello\nWorld"], apart) == ["hello world"]


def test_stopwords_by_language(spark):
    rows = [("der the haus house", "de"), ("der the haus house", "en"), ("der the", "fr"), ("der", None), (None, "de")]
    column = words.remove_stopwords(F.col("t"), F.col("l"), "de", "en")
    assert values(spark, rows, column, "t string, l string") == ["haus house", "der haus house", None, None, None]


def test_stem(spark):
    rows = [("running relational cats is bus", "en"), ("zeitungen haus", "de"), ("x", "fr"), (None, "en"), ("a", None)]
    column = words.stem_text(F.col("t"), F.col("l"), ("en", "de"))
    assert values(spark, rows, column, "t string, l string") == ["runn relate cat is bus", "zeit hau", None, None, None]


def test_count_words(spark):
    rows = ["a b", "  a \n b  ", "", "   ", None]
    assert values(spark, rows, words.count_words(F.col("x"))) == [2, 2, 0, 0, None]


def test_word_limit_is_exclusive_or_inclusive(spark):
    from sitewright.operators.rows import enough_words

    df = spark.createDataFrame([(n, " ".join(["w"] * n)) for n in (19, 20, 21)], "n int, text string")
    assert [r.n for r in enough_words(df, "text").collect()] == [21]
    assert [r.n for r in enough_words(df, "text", inclusive=True).orderBy("n").collect()] == [20, 21]


def test_trigrams_cover_all_positions(spark):
    got = values(spark, ["Ab1cé  d"], words.trigrams(F.col("x")))[0]
    text = "ab cé d"
    assert sorted(got) == sorted(text[i : i + 3] for i in range(len(text) - 2))


def test_tokens_and_flags(spark):
    assert values(spark, ["A bc, De-f"], words.tokens(F.col("x"))) == [["bc", "de"]]
    assert values(spark, ["en", "de", None], words.language_flag(F.col("x"), "en")) == [1, 0, 0]
    assert values(spark, [46123], words.sector_prefix(F.col("x")), "x int") == ["46"]


def test_softmax(spark):
    got = values(spark, [([1.0, 2.0, 3.0],), ([1000.0, 1000.0, 1000.0],)], words.softmax(F.col("x")), "x array<double>")
    assert got[0] == pytest.approx([0.0900306, 0.2447285, 0.6652410], abs=1e-6)
    assert got[1] == pytest.approx([1 / 3] * 3)


STEMS = {  # written by hand, not derived from the rule table
    "en": {
        "relational": "relate", "hopefulness": "hopeful", "running": "runn", "cities": "citi", "agreement": "agre", "classes": "class",
        "sings": "sing", "was": "was", "quickly": "quick", "happy": "happi", "tried": "tri", "glass": "glass", "the": "the",
    },
    "de": {"freundlichkeiten": "freundlichkeit", "zeitungen": "zeit", "kinder": "kind", "musik": "mus", "der": "der", "tages": "tag"},
    "nl": {"vrijheden": "vrijheid", "boeken": "boek", "huisje": "huis", "het": "het", "oefeningen": "oefen"},
}


def test_stems_by_hand(spark):
    rows = [(code, word, stem) for code, words in STEMS.items() for word, stem in words.items()]
    df = spark.createDataFrame(rows, "lang string, word string, want string")
    got = df.withColumn("got", words.stem_text(F.col("word"), F.col("lang"), ("en", "de", "nl"))).collect()
    assert {(r.lang, r.word): r.got for r in got} == {(lang, word): stem for lang, word, stem in rows}


def test_words_of_any_script(spark):
    df = spark.createDataFrame([("für ältere Mädchen, niños: été_1 日本",)], "text string")
    assert df.select(words.tokens(F.col("text"))).first()[0] == ["für", "ältere", "mädchen", "niños", "été_1", "日本"]
