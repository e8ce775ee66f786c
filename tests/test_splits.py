import random

import pytest

from quern.operators import records, splits
from quern.operators.components import connected_components
from quern.operators.order import running_total

QA = "id string, question string, relevant_doc_ids array<string>, reference_answer string"


def by_hand(edges):
    parent = {}

    def top(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    return {x: top(x) for x in parent}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(i, i + 1) for i in range(100, 160)] + [(200, i) for i in range(201, 230)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 5)], "x int, y int"), "x", "y").collect()}
    assert got == by_hand(edges)


def test_components_of_nothing_and_of_loops(spark):
    assert connected_components(spark.createDataFrame([], "x int, y int"), "x", "y").count() == 0
    assert [tuple(r) for r in connected_components(spark.createDataFrame([("a", "a"), ("a", "a")], "x string, y string"), "x", "y").collect()] == [("a", "a")]


def test_components_with_a_hub(spark):
    edges = spark.range(1, 5000).selectExpr("id as x", "if(id % 3 = 0, 0, id - 1) as y")
    got = connected_components(edges, "x", "y")
    assert got.count() == 5000 and got.where("component <> 0").count() == 0


def test_running_total(spark, monkeypatch):
    monkeypatch.setattr("quern.operators.order.BUCKET_ROWS", 10)
    rows = [(i % 2, random.Random(i).getrandbits(63), i, i) for i in range(200)]
    got = running_total(spark.createDataFrame(rows, "g int, h bigint, v bigint, k bigint"), "g", "h", "v", "k", "t").collect()
    for g in (0, 1):
        total = 0
        for r in sorted((r for r in got if r["g"] == g), key=lambda r: r["h"]):
            total += r["v"]
            assert r["t"] == total


def rows_of(spark, n, **more):
    return spark.createDataFrame([(f"r{i}", more.get("q", lambda i: f"question {i}")(i), more.get("d", lambda i: [f"d{i}"])(i), "a") for i in range(n)], QA)


def test_row_split_sizes(spark):
    got = splits.split_rows(rows_of(spark, 10), 0.2).collect()
    assert sum(r["split"] == "validation" for r in got) == 2
    assert splits.split_rows(rows_of(spark, 10), 0.0).where("split = 'validation'").count() == 0
    with pytest.raises(ValueError, match="two"):
        splits.split_rows(rows_of(spark, 1), 0.5)


def test_target_rounds_half_to_even():
    assert [splits.target_rows(n, 0.5, 2) for n in (3, 5, 7)] == [2, 2, 4]
    with pytest.raises(ValueError):
        splits.target_rows(5, 1.0, 5)


def test_groups_never_part(spark):
    rows = rows_of(spark, 60, q=lambda i: f"Question  {i // 3}" if i % 2 else f"question {i // 3} ")
    groups = splits.question_groups(rows)
    got = splits.split_groups(groups, 0.2)
    assert splits.audit(rows, got).first().asDict() == {"train_rows": 48, "validation_rows": 12, "groups": 20, "group_overlap": 0, "question_overlap": 0, "document_overlap": 0}
    with pytest.raises(ValueError):
        splits.split_groups(splits.question_groups(rows_of(spark, 5, q=lambda i: "same")), 0.5)


def test_grouping_by_document_and_audit(spark):
    rows = rows_of(spark, 12, d=lambda i: [f"d{i // 2}", " "])
    groups = {r["id"]: r["group"] for r in splits.question_groups(rows, by_document=True).collect()}
    assert all(groups[f"r{i}"] == groups[f"r{i + 1}"] for i in range(0, 12, 2)) and len(set(groups.values())) == 6
    torn = splits.split_rows(rows, 0.5)
    assert splits.audit(rows, torn).first()["document_overlap"] > 0


def test_document_pools(spark):
    rows = rows_of(spark, 20)
    docs = spark.createDataFrame([(f"d{i}", "t") for i in range(40)], "id string, text string")
    assigned = splits.split_rows(rows, 0.2)
    pools = {r["doc_id"]: r["pool"] for r in splits.document_pools(docs, assigned, rows, 0.25).collect()}
    sides = {r["id"]: r["split"] for r in assigned.collect()}
    assert len(pools) == 40 and all(pools[f"d{i}"] == sides[f"r{i}"] for i in range(20))
    assert sum(p == "validation" for d, p in pools.items() if int(d[1:]) >= 20) == 5


def test_fingerprints(spark):
    one, other = rows_of(spark, 5), rows_of(spark, 5, q=lambda i: f" QUESTION   {i}")
    f = lambda r: splits.table_fingerprint(splits.source_fingerprints(r, "reference_answer")).first()
    assert f(one)["fingerprint"] == f(other)["fingerprint"] != f(rows_of(spark, 4))["fingerprint"]


def test_records(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(["b ", None, "a", "b"], [("c", "t"), ("a", None)])], "i array<string>, e array<struct<doc_id:string,text:string>>")
    assert row.select(records.merged_evidence(F.col("i"), F.col("e"))).first()[0] == ["b", "a", "c"]
    docs = spark.createDataFrame([("a", "x"), ("a", " "), (" ", "x"), (None, None)], "id string, text string")
    assert {(r["id"], r["rule"]) for r in records.violations(docs, records.document_rules()).collect()} == {("a", "blank_text"), (" ", "blank_id"), (None, "blank_id"), (None, "blank_text")}
    assert [tuple(r) for r in records.repeated_ids(docs).collect()] == [("a", 2)]


def test_accessors_and_conflicts(spark):
    rows = spark.createDataFrame([("a", "q", ["x "], ["y"], [("z", True), ("w", False)])], "id string, question string, relevant_doc_ids array<string>, evidence_doc_ids array<string>, contexts array<struct<doc_id:string,relevant:boolean>>")
    assert rows.select(records.document_ids(rows)).first()[0] == ["x", "y", "z"] and rows.select(records.document_ids(rows, every=True)).first()[0][-1] == "w"
    tuned = spark.createDataFrame([(" ", "Q "), ("s", ""), ("t", None)], "id string, input string")
    other = spark.createDataFrame([("", ""), ("u", "q")], "id string, question string")
    assert [(r["kind"], r["value"]) for r in records.training_conflicts(tuned, other).collect()] == [("question", "q")]
    with pytest.raises(ValueError, match="one overlaps two: question q"):
        records.require_disjoint(tuned, other, ("one", "two"))


@pytest.mark.parametrize(
    ("contexts", "evidence", "problems"),
    [
        ([("a", True), ("b", False)], ["a"], []),
        ([], [], ["no contexts", "no evidence", "nothing relevant"]),
        ([("a", True), ("a", True)], ["a", "a"], ["repeated contexts", "repeated evidence"]),
        ([("a", True)], ["b"], ["evidence not in contexts", "relevant contexts not in evidence", "evidence differs from relevant contexts"]),
        ([("a", False)], ["a"], ["evidence marked irrelevant", "nothing relevant", "evidence differs from relevant contexts"]),
    ],
)
def test_raft_rules(spark, contexts, evidence, problems):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(contexts, evidence)], "c array<struct<doc_id:string,relevant:boolean>>, e array<string>")
    assert row.select(records.raft_problems(F.col("c"), F.col("e"))).first()[0] == problems


def test_grouping_by_fields_and_row_fingerprints(spark):
    rows = spark.createDataFrame([("a", "1", None, (["x", "y"], "t1")), ("b", "2", None, (["y"], None)), ("c", "3", None, (None, "t1")), ("d", "4", None, ([""], ""))], "id string, question string, relevant_doc_ids array<string>, meta struct<tags:array<string>,thread:string>")
    got = {r["id"]: r["group"] for r in splits.question_groups(rows, ("meta.tags", "meta.thread")).collect()}
    assert got == {"a": "a", "b": "a", "c": "a", "d": "d"}
    with pytest.raises(ValueError, match="without a value"):
        splits.question_groups(rows, ("meta.tags",), strict=True)
    with pytest.raises(ValueError, match="no field"):
        splits.question_groups(rows, ("meta.other",))
    as_json = rows.selectExpr("id", "question", "relevant_doc_ids", "to_json(meta) as meta")
    assert {r["id"]: r["group"] for r in splits.question_groups(as_json, ("meta.tags", "meta.thread")).collect()} == {"a": "a", "b": "a", "c": "a", "d": "d"}
    one = {r["id"]: r["fingerprint"] for r in splits.row_fingerprints(rows.select("id", "question")).collect()}
    assert one == {r["id"]: r["fingerprint"] for r in splits.row_fingerprints(rows.select("question", "id")).collect()} and len(set(one.values())) == 4
