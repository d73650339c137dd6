"""Column expressions that read HTML: visible text, popups, links, frames, numbers.

Everything here is row-local and stays inside Catalyst, so cleaning 100 TB of pages is one
scan without a shuffle and without a Python worker.
"""

from __future__ import annotations

import json
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from sitewright.functions.expressions import bind

# Patterns of the markup that is looked for.
HIDDEN_BLOCKS = [
    r"(?is)<script\b.*?</script\s*>",
    r"(?is)<style\b.*?</style\s*>",
    r"(?s)<!--.*?-->",
    r"(?is)<head\b.*?</head\s*>",
    r"(?is)<title\b.*?</title\s*>",
]
CODE_BLOCKS = HIDDEN_BLOCKS[:3]
TAG = r"</?[A-Za-z][^>]*>|<[!?][^>]*>"
LONG_BLANK = r"\s{3,}"
POPUP_WORDS = ("cook", "popup")
ENTITY = r"&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
LINK_ELEMENT = r"(?is)<a\s[^>]*>.*?</a\s*>|<[a-z][a-z0-9]*\s[^>]*>"
FRAME_TAG = r"(?is)<frame\s[^>]*>"


def _replace_all(text: Column, patterns: list[str], by: str) -> Column:
    for pattern in patterns:
        text = F.regexp_replace(text, pattern, by)
    return text


def _entity_table() -> dict[str, str]:
    """Named references, and numbers 128 to 159, which pages use for the Windows character set."""
    table = {f"&{name};": chr(code) for name, code in name2codepoint.items()}
    for code in range(128, 160):
        char = bytes([code]).decode("cp1252", errors="ignore")
        if char:
            table[f"&#{code};"] = char
    return table


def decode_entities(text: Column) -> Column:
    """Named and numeric character references; unknown names stay as they are."""
    # one literal instead of a map call with an argument per name keeps plans small
    named = F.from_json(F.lit(json.dumps(_entity_table())), "map<string,string>")

    def decode_one(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#([0-9]+);$", 1)
        hexed = F.regexp_extract(piece, r"^&#[xX]([0-9a-fA-F]+);$", 1)
        code = F.when(digits != "", digits.cast("bigint")).when(hexed != "", F.conv(hexed, 16, 10).cast("bigint"))
        legal = code.between(1, 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        numeric = F.when(code.isNotNull(), F.when(legal, char).otherwise(F.lit("\ufffd")))
        return F.when(piece.rlike("^" + ENTITY + "$"), F.coalesce(F.element_at(named, piece), numeric, piece)).otherwise(piece)

    def decode_all(raw: Column) -> Column:
        pieces = F.regexp_extract_all(raw, F.lit(f"(?s){ENTITY}|[^&]+|&"), F.lit(0))
        return F.when(raw.contains("&"), F.array_join(F.transform(pieces, decode_one), "")).otherwise(raw)

    return bind(text, decode_all)


def strip_tags(text: Column, by: str = " ") -> Column:
    """Each run of neighboring tags becomes one ``by``."""
    marked = F.regexp_replace(text, TAG, "\u0001")
    return F.regexp_replace(marked, "\u0001+", by)


def visible_text(html: Column) -> Column:
    """Text outside style, script, head, title, comments; blanks of three or more become one."""
    shown = strip_tags(_replace_all(html, HIDDEN_BLOCKS, ""))
    return F.regexp_replace(decode_entities(shown), LONG_BLANK, " ")


def page_text(html: Column) -> Column:
    """Visible text taken twice, so that escaped markup is removed as well."""
    return F.trim(visible_text(visible_text(html)))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of one opening tag, null if the tag does not have it."""
    pattern = rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
    bare = r"""^["']|["']$"""
    return bind(
        F.regexp_extract(tag, pattern, 1),
        lambda raw: F.when(raw != "", decode_entities(F.regexp_replace(raw, bare, ""))),
    )


def remove_popups(html: Column, words: tuple[str, ...] = POPUP_WORDS) -> Column:
    """Drop each ``div`` whose id or class contains one of ``words``, with all it contains.

    The page is cut in front of every opening or closing ``div``. A fold over the pieces keeps
    the nesting depth and the depth at which a cut began. Pages without such a ``div``
    skip the fold. Scripts, styles and comments go first so that markup inside them cannot
    shift the depth.
    """
    any_word = "|".join(words)
    suspect = rf"""(?s)<(?i:div)\s[^>]*(?:{any_word})"""
    cut_tag = (
        rf"""(?s)^<[^>]*?\s(?i:id|class)\s*=\s*(?:"[^">]*(?:{any_word})|'[^'>]*(?:{any_word})|[^\s"'>]*(?:{any_word}))"""
    )
    start = F.struct(
        F.lit(0).alias("depth"),
        F.lit(0).alias("cut"),
        F.array().cast("array<string>").alias("kept"),
    )

    def step(state: Column, piece: Column) -> Column:
        opens = piece.rlike(r"(?i)^<div\b")
        closes = piece.rlike(r"(?i)^</div\b")
        inside = state["cut"] > 0
        depth_in = F.when(opens, state["depth"] + 1).otherwise(state["depth"])
        begins = opens & ~inside & piece.rlike(cut_tag)
        ends = closes & inside & (state["depth"] == state["cut"])
        keep = F.when(ends, F.regexp_replace(piece, r"(?s)^<[^>]*>", "")).when(~inside & ~begins, piece)
        return F.struct(
            F.when(closes, F.greatest(state["depth"] - 1, F.lit(0))).otherwise(depth_in).alias("depth"),
            F.when(begins, depth_in).when(ends, F.lit(0)).otherwise(state["cut"]).alias("cut"),
            F.when(keep.isNull(), state["kept"]).otherwise(F.concat(state["kept"], F.array(keep))).alias("kept"),
        )

    def fold(shown: Column) -> Column:
        pieces = F.split(shown, r"(?i)(?=</?div\b)")
        folded = F.aggregate(pieces, start, step, lambda state: F.array_join(state["kept"], ""))
        return F.when(shown.rlike(suspect), folded).otherwise(shown)

    return bind(_replace_all(html, CODE_BLOCKS, ""), fold)


def links(html: Column) -> Column:
    """Array of (href, text, hreflang) of all elements with an href, in document order.

    The text is lower-cased and trimmed; it is '' for elements that hold none.
    """
    shown = _replace_all(html, CODE_BLOCKS, "")
    elements = F.regexp_extract_all(shown, F.lit(LINK_ELEMENT), F.lit(0))

    def read(element: Column) -> Column:
        return bind(
            F.regexp_extract(element, r"(?s)^<[^>]*>", 0),
            lambda tag: F.struct(
                attribute(tag, "href").alias("href"),
                F.trim(F.lower(decode_entities(strip_tags(element, "")))).alias("text"),
                attribute(tag, "hreflang").alias("hreflang"),
            ),
        )

    with_href = F.filter(elements, lambda e: e.rlike(r"(?is)^<[^>]*\shref\s*="))
    return F.filter(F.transform(with_href, read), lambda link: link["href"].isNotNull())


def frame_sources(html: Column) -> Column:
    """Array of the ``src`` of all frames, in document order."""
    tags = F.regexp_extract_all(html, F.lit(FRAME_TAG), F.lit(0))
    return F.filter(F.transform(tags, lambda tag: attribute(tag, "src")), lambda src: src.isNotNull())


def plain_text(html: Column) -> Column:
    """All text but scripts and comments, markup removed without leaving a blank, blanks single."""
    shown = _replace_all(html, [HIDDEN_BLOCKS[0], HIDDEN_BLOCKS[2]], "")
    return F.trim(F.regexp_replace(decode_entities(strip_tags(shown, "")), r"\s+", " "))


def numeric_tokens(html: Column) -> Column:
    """All runs of digits in the plain text."""
    return F.regexp_extract_all(plain_text(html), F.lit(r"\d+"), F.lit(0))
