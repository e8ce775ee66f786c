import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import pieces, together


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab. \n\r\t#-é"), max_size=200), st.integers(5, 40), st.integers(0, 4))
def test_cut_gives_the_text_back(text, limit, overlap):
    parts = pieces.cut(text, limit, overlap)
    assert all(b - a <= limit for a, b, _ in parts)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    assert all(nxt[0] == this[1] - overlap for this, nxt in zip(parts, parts[1:]))
    assert text[: parts[0][1]] + "".join(text[this[1] : nxt[1]] for this, nxt in zip(parts, parts[1:])) == text


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a" * 10 + "\n \t\r\n" + "b" * 10, "paragraph"),
        ("a" * 10 + "\n" + "b" * 10, "line"),
        ("a" * 10 + "\r\n" + "b" * 10, "line"),
        ("a" * 10 + "\r" + "b" * 10, "word"),
        ("a" * 10 + "\xa0" + "b" * 10, "none"),
        ("a" * 11, "none"),
        ("a" * 10 + "\n\n\n" + "b" * 10 + "\n\n", "paragraph"),
    ],
)
def test_boundary(text, want):
    assert pieces.boundary(text, 10) == want


def test_cuts_where_the_text_pauses():
    text = "\n\n".join("word " * 20 + "end." for _ in range(5))
    assert {how for *_, how in pieces.cut(text, 250, 10)} == {"paragraph", "end"}


def test_split_documents(spark):
    rows = [(1, "x" * 100, "q"), (2, None, "q"), (3, "", "q"), (4, "é" * 101, "q"), (5, ("word " * 30 + "\n\n") * 3, "q"), (6, "\U0001f600" * 100, "q")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string")
    got = pieces.split_documents(docs, 100, 20).orderBy("doc_id", "piece").collect()
    assert {r["doc_id"] for r in got} == {4, 5} and all(len(r["text"]) == r["n_chars"] <= 100 for r in got)
    assert {r["doc_id"]: r["boundary"] for r in pieces.boundaries(pieces.split_documents(docs, 100, 20)).collect()} == {4: "none", 5: "word"}
    assert pieces.split_documents(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        pieces.split_documents(docs, 10, 10)


QA = "id string, question string, relevant_doc_ids array<string>, metadata struct<split:string,author:string,source:string>, group_id string"


def by_hand(rows):
    parent = {r[0]: r[0] for r in rows if r[0]}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = {}
    for id_, question, refs, meta, _ in rows:
        if not id_:
            continue
        author = ((meta and meta[1]) or "").strip(" \t\r\n").lower()
        keys = [("a", author)] if author not in ("", "unknown") else []
        q = " ".join((question or "").lower().split())
        keys += [("q", q)] if q else []
        keys += [("d", r.strip(" \t\r\n")) for r in refs or [] if r and r.strip(" \t\r\n")]
        for k in keys:
            a, b = top(id_), top(seen.setdefault(k, id_))
            parent[max(a, b)] = min(a, b)
    return {i: top(i) for i in parent}


@pytest.mark.parametrize("seed", range(2))
def test_groups_against_union_find(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(150):
        author = rng.choice([None, "", " unknown", f"Ann {rng.randint(0, 300)}", f"ann {rng.randint(0, 300)} ", "UNKNOWN"])
        rows.append((f"r{i:03}", rng.choice([None, "", f"What  {rng.randint(0, 200)}?", f"what {rng.randint(0, 200)}? "]), rng.choice([None, [], [None, " "], [f" d{rng.randint(0, 200)}", f"d{rng.randint(0, 200)}"]]), (None, author, None) if rng.random() < 0.9 else None, "x"))
    rows += rows[:10] + [(None, "What 1?", ["d1"], None, "x")]
    got = together.tied_groups(spark.createDataFrame(rows, QA)).collect()
    assert {r["id"]: r["group_id"] for r in got} == by_hand(rows) and len(got) == 150
    sizes = {g: sum(r["group_id"] == g for r in got) for g in {r["group_id"] for r in got}}
    assert all(r["n_records"] == sizes[r["group_id"]] for r in got)


def test_one_author_of_a_third(spark):
    rows = spark.range(6000).selectExpr("lpad(id, 6, '0') as id", "concat('q', id) as question", "array(concat('d', id)) as relevant_doc_ids", "named_struct('split', 's', 'author', if(id % 3 = 0, 'hot', concat('a', id)), 'source', 's') as metadata")
    got = together.tied_groups(rows)
    assert got.where("group_id = '000000'").count() == 2000 and got.where("n_records = 1").count() == 4000


def test_splits_keep_groups_and_shares(spark):
    groups = spark.range(20000).selectExpr("cast(id as string) as id", "cast(id div 2 as string) as group_id")
    shares = spark.createDataFrame([("train", 0.8), ("validation", 0.1), ("test", 0.1), ("none", 0.0)], "split string, share double")
    assigned = together.assign_splits(groups, shares)
    assert assigned.groupBy("group_id").agg({"split": "approx_count_distinct"}).where("`approx_count_distinct(split)` > 1").count() == 0
    report = {r["split"]: r for r in together.split_report(assigned, shares).collect()}
    assert all(abs(report[s]["reached_share"] - x) < 0.015 for s, x in (("train", 0.8), ("validation", 0.1), ("test", 0.1)))
    assert report["none"]["n_records"] == 0
    with pytest.raises(ValueError):
        together.assign_splits(groups, shares.limit(0))


def test_groups_of_nothing(spark):
    assert together.tied_groups(spark.createDataFrame([], QA)).count() == 0
