import random
import re
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import tokens

PIECES = ["a", "ab", "abc", "bc", "c", "ca", "é", "the", "th", "ing"]
DOCS = "doc_id bigint, id string, text string, lang string, source string, metadata struct<source:string,topic:string>, n_tokens string, digest string"


def by_hand(text, pieces=PIECES):
    low, n, at = (text or "").lower(), 0, 0
    while at < len(low):
        c = low[at]
        if c in " \t\r\n\xa0":
            at += 1
        elif unicodedata.category(c)[0] != "L":
            at, n = at + 1, n + 1
        else:
            end = at
            while end < len(low) and unicodedata.category(low[end])[0] == "L":
                end += 1
            while at < end:
                step = max((len(p) for p in pieces if low.startswith(p, at) and at + len(p) <= end), default=1)
                at, n = at + step, n + 1
    return n


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("abcéthing ½²3_.\xa0́ßİΣ漢\n​"), max_size=40))
def test_counter_against_hand(text):
    assert tokens.PieceCounter(PIECES)(text) == by_hand(text)


def test_counter_of_nothing_and_of_much():
    count = tokens.PieceCounter(PIECES)
    assert (count(None), count(""), count(" \t\r\n\xa0")) == (0, 0, 0)
    assert count("ab" * 100_000) == by_hand("ab" * 100_000)
    assert tokens.PieceCounter([])("abc d") == 4


def documents(spark, rows):
    return spark.createDataFrame([(i, f"d{i}", t, lang, s, m, "x", "x") for i, (t, lang, s, m) in enumerate(rows)], DOCS)


def test_document_and_slice_counts(spark):
    rng = random.Random(2)
    texts = ["abc the", "abc the", None, "", "ing " * 2000, "漢 12"]
    rows = [(rng.choice(texts), rng.choice(["en", "EN", None]), rng.choice(["Wiki Dump", "wiki-dump"]), rng.choice([("WIKI_dump ", "a b"), (None, "A-B"), (" ", None)])) for _ in range(60)]
    vocab = spark.createDataFrame([(i, p) for i, p in enumerate(PIECES)], "piece_id int, piece string")
    make = tokens.piece_tokenizer(vocab)
    docs = documents(spark, rows)
    got = {r["doc_id"]: r for r in tokens.document_tokens(docs, make).collect()}
    assert {i: r["n_tokens"] for i, r in got.items()} == {i: by_hand(r[0]) for i, r in enumerate(rows)}
    assert {r["source"] for r in got.values()} == {"wiki-dump"} and {r["lang"] for r in got.values()} == {"en", "(none)"}
    slices = tokens.slice_tokens(docs, make).collect()
    assert {(r["source"], r["lang"], r["topic"]) for r in slices} == {(r["source"], r["lang"], r["topic"]) for r in got.values()}
    assert sum(r["n_tokens"] for r in slices) == sum(map(by_hand, (r[0] for r in rows))) and sum(r["n_docs"] for r in slices) == 60
    for r in slices:
        own = [i for i, g in got.items() if (g["source"], g["lang"], g["topic"]) == (r["source"], r["lang"], r["topic"])]
        assert r["n_tokens"] == sum(got[i]["n_tokens"] for i in own)
        assert r["n_distinct_tokens"] == sum(map(by_hand, {rows[i][0] or "" for i in own}))


def test_each_distinct_text_is_tokenized_once(spark, tmp_path):
    def make():
        def count(text):
            with open(f"{tmp_path}/seen", "a") as f:
                f.write(f"{text}\n")
            return 1

        return count

    docs = documents(spark, [("same", "en", "s", None)] * 50 + [("other", "en", "s", None)])
    assert tokens.slice_tokens(docs, make).first()["n_tokens"] == 51
    assert sorted(open(f"{tmp_path}/seen").read().split()) == ["other", "same"]


def test_empty_table(spark):
    docs, make = documents(spark, [("a", "en", "s", None)]).limit(0), lambda: len
    assert tokens.document_tokens(docs, make).count() == tokens.slice_tokens(docs, make).count() == 0


def test_vocabulary_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_PIECES", 2)
    with pytest.raises(ValueError, match="more than"):
        tokens.vocabulary(spark.createDataFrame([("a",), ("b",), ("c",)], "piece string"))


def test_public_tokenizer(spark):
    folder = pytest.importorskip("public_tokenizers")
    from quern.llm.queries import BYTE_BPE_PATTERN

    count = tokens.bpe_tokenizer(spark, folder.path("byte_bpe_50k.tiktoken"), BYTE_BPE_PATTERN)()
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(folder.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    for text in ("Hello, world! It's 12 o'clock.", "", "größer  \n\n x", "<|endoftext|>"):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)
    assert re.compile("x") and count(None) == 0
