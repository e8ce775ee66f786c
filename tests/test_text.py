from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quern.functions import prompts, text
from quern.functions.thinking import split_thinking


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column).first()[0]


def test_exact_match_ignores_case_and_punctuation(spark):
    assert one(spark, text.exact_match(F.col("a"), F.col("b")), a="Hello, World!", b="hello world") == 1.0


@pytest.mark.parametrize(("a", "b", "want"), [("", "", 1.0), ("", "x", 0.0), ("a b", "c", 0.0), ("the cat sat", "cat sat sat", 2 / 3), ("ß Ä", "ß ä", 1.0)])
def test_token_f1(spark, a, b, want):
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(want)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.text("ab ,.", max_size=12), st.text("ab ,.", max_size=12)), min_size=1, max_size=8))
def test_token_f1_against_counters(spark, pairs):
    def brute(p, r):
        p, r = ("".join(c if c.isalnum() else " " for c in x).split() for x in (p, r))
        if not p or not r:
            return float(len(p) == len(r))
        n = sum((Counter(p) & Counter(r)).values())
        return 2 * n / (len(p) + len(r))

    got = spark.createDataFrame(pairs, "a string, b string").select(text.token_f1(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([brute(*p) for p in pairs])


def test_nulls_stay_null(spark):
    assert one(spark, text.token_f1(F.col("a"), F.col("b")), a=None, b="x") is None
    assert one(spark, text.normalize(F.col("a")), a=None) is None


def test_references_prefer_the_list(spark):
    rows = spark.createDataFrame([([" a ", "a", " "], "z"), ([], "z"), (None, ""), (None, None)], "l array<string>, s string")
    assert [r[0] for r in rows.select(text.references(F.col("l"), F.col("s"))).collect()] == [["a"], ["z"], [], []]


def test_question_key_folds(spark):
    assert one(spark, text.question_key(F.col("a")), a="  STRASSE    straße? ") == "strasse strasse?"


def test_folding_is_python_s(spark):
    specials = [*text.FOLDED, "ẞ", "Σ", "ŉ", "ſ", "ΐ", "ﬀ", "Straße", "ΟΔΟΣ"]
    rows = spark.createDataFrame([(c,) for c in specials], "a string").select("a", text.folded(F.col("a")).alias("f")).collect()
    assert {r["a"]: r["f"] for r in rows} == {c: c.casefold() for c in specials}


def test_lenient_json(spark):
    assert one(spark, text.lenient_json(F.col("a")), a='so: {"k": {"x": 1}} there') == '{"k": {"x": 1}}'
    assert one(spark, text.lenient_json(F.col("a")), a="nothing") is None


def test_keyed_seed_is_python_s(spark):
    import hashlib

    want = int.from_bytes(hashlib.sha256(b"42:p:m").digest()[:8], "big")
    assert int(one(spark, text.keyed_seed("42", F.col("a"), "m"), a="p")) == want


def test_prompt_column_equals_prompt_text(spark):
    row = spark.createDataFrame([("q?", ["one", "two"]), ("q?", [])], "q string, c array<string>")
    got = [r[0] for r in row.select(prompts.prompt(F.col("q"), F.col("c"))).collect()]
    assert got == [prompts.prompt_text("q?", ["one", "two"]), prompts.prompt_text("q?", [])]
    assert got[1].endswith(prompts.NO_DOCUMENTS)
    assert len(prompts.identity()["template_sha256"]) == 64


def test_thinking_parts(spark):
    def parts(ids, **more):
        row = spark.createDataFrame([(ids,)], "ids array<int>")
        return row.select(split_thinking(F.col("ids"), pad=1, eos=more.pop("eos", 1), opening=98, closing=99, **more).alias("t")).first()["t"]

    got = parts([10, 11, 99, 20, 1, 1])
    assert (got["reasoning"], got["answer"], got["output"], got["problem"]) == ([10, 11], [20, 1], [10, 11, 99, 20, 1], None)
    assert parts([98, 10, 99, 20, 1], eos=2)["reasoning"] == [10]
    assert parts([10, 20])["problem"] == "missing boundary"
    assert parts([10, 99, 20, 99, 3])["problem"] == "several boundaries"
    assert parts([10, 98, 99, 20])["problem"] == "misplaced opening boundary"
    assert parts([10, 99, 1], eos=2)["problem"] == "empty answer"
    assert parts([10, 99, 20], enabled=False)["problem"]
    assert parts([10, 20], enabled=False)["answer"] == [10, 20]
    assert parts(None)["problem"] == "missing boundary"
