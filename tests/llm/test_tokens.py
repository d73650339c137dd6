"""Subword encoding and cached counts against the tokenizer library."""

import random
from collections import Counter

import pytest

from sitewright.llm import pieces, token_counts
from sitewright.llm.registry import tokenizer_file
from sitewright.session import new_table_path

SPM = pytest.importorskip("sentencepiece")


@pytest.fixture(scope="module")
def proto():
    return tokenizer_file()


@pytest.fixture(scope="module")
def library(proto):
    return SPM.SentencePieceProcessor(model_proto=proto)


@pytest.fixture(scope="module")
def model(proto):
    return pieces.PieceModel(proto)


FIXED = ["", " ", "\n", "a▁b", "  a  b ", " " * 40, "▁" * 7 + "a", "a" * 50, "\x00\t\r\n", "<s></s><0x0A>", "日本語😀é ｘ", "﻿", "İı"]


def test_encoding_is_the_librarys(model, library):
    rng = random.Random(3)
    alphabet = ["a", "th", "in", "the", " ", "  ", "\n", "é", "ß", "日", "😀", ".", "!!", "THE", "0", "▁", "tion", "\t"]
    known = list(model.ids)
    texts = FIXED + ["".join(rng.choices(alphabet, k=rng.randint(1, 40))) for _ in range(2000)]
    texts += ["".join(rng.choices(known, k=rng.randint(1, 6))).replace("▁", " ") for _ in range(2000)]
    for text in texts:
        ids = library.encode(text)
        assert model.encode(text) == ids and model.decode(ids) == library.decode(ids), text


def test_compatibility_is_merging_anew(model):
    rng = random.Random(4)
    known = [p for p in model.ids if len(p) < 6]
    for _ in range(3000):
        pair = rng.choice(known), rng.choice(known)
        parts = model.history("".join(pair))[1]
        assert model.compatible[pair] == (parts == list(pair)), pair


def test_documents(frame, hard_rows, proto, library):
    got = pieces.encode_documents(frame(hard_rows), proto).collect()
    want = Counter()
    for i, text in hard_rows:
        ids = library.encode(text or "")
        want[i, len(ids), ",".join(map(str, ids)), library.decode(ids)] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_text, r.decoded) for r in got) == want
    assert pieces.encode_documents(frame([]), proto).collect() == []
    arrays = pieces.ids_array(pieces.encode_documents(frame([(1, "the end"), (2, "")]), proto)).collect()
    assert {r.doc_id: r.ids for r in arrays} == {1: library.encode("the end"), 2: []}


def test_counts_and_cache(spark, frame, hard_rows, proto, library):
    cache = token_counts.empty_cache(spark, new_table_path(spark, "cache"))
    first, second = hard_rows[:50], hard_rows
    for rows in (first, second, second):
        got = token_counts.count_tokens(frame(rows), proto, cache, limit=20).collect()
        want = Counter()
        for i, text in rows:
            n = len(library.encode(text or ""))
            want[i, len((text or "").encode()), n, n > 20] += 1
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in got) == want
        stored = spark.read.parquet(cache)
        # every distinct text was encoded once, in whichever run it came first
        assert stored.count() == len({(t or "").replace("▁", " ") for _, t in rows})
    assert token_counts.count_tokens(frame([]), proto, cache).collect() == []
    assert spark.read.parquet(cache).filter("tokenizer is null").count() == 0


def test_other_versions_are_not_used(spark, frame, proto):
    cache = token_counts.empty_cache(spark, new_table_path(spark, "cache"))
    token_counts.count_tokens(frame([(1, "text")]), proto, cache)
    assert token_counts.stored_counts(spark, cache, "other").count() == 0
