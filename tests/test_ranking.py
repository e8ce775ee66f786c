import math
import random
from collections import Counter

import numpy as np
import pytest

from quern.operators import mining, ranking

DOCS = "id string, text string, pos bigint"
QUERIES = "id string, question string"


def bm25_by_hand(docs, query, k):
    words = [(d.lower() or "").split() for _, d, _ in docs]
    df = Counter(w for d in words for w in set(d))
    n, avg = len(docs), sum(map(len, words)) / len(docs)
    raw = {w: math.log(n - c + 0.5) - math.log(c + 0.5) for w, c in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}
    out = []
    for (id_, _, pos), d in zip(docs, words):
        tf = Counter(d)
        s = sum(idf[w] * tf[w] * 2.5 / (tf[w] + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in query.lower().split() if w in idf)
        out.append((-round(s, 9), pos, id_, s))
    return [(i, r + 1, pytest.approx(s, abs=1e-6)) for r, (_, _, i, s) in enumerate(sorted(out)[:k])]


def test_bm25_against_hand(spark):
    rng = random.Random(3)
    docs = [(f"d{i}", " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))), i) for i in range(30)]
    queries = [("q1", "a b"), ("q2", "h h c"), ("q3", "zz"), ("q4", "a zz")]
    got = ranking.BM25().index(spark.createDataFrame(docs, DOCS)).rank(spark.createDataFrame(queries, QUERIES), 5)
    rows = got.orderBy("query_id", "rank").collect()
    for id_, text in queries:
        assert [(r["doc_id"], r["rank"], r["score"]) for r in rows if r["query_id"] == id_] == bm25_by_hand(docs, text, 5)


@pytest.mark.parametrize("texts", [["x y", "x z", "x"], ["x", "x y"], ["a b", "a b c", "a c", "b", "zz zz a"]])
def test_bm25_keeps_negative_scores(spark, texts):
    docs = [(f"d{i}", t, i) for i, t in enumerate(texts)]
    queries = [("q1", "x a"), ("q2", "y b"), ("q3", "none"), ("q4", "z c a")]
    got = ranking.BM25().index(spark.createDataFrame(docs, DOCS)).rank(spark.createDataFrame(queries, QUERIES), 4).orderBy("query_id", "rank").collect()
    for id_, text in queries:
        assert [(r["doc_id"], r["rank"], r["score"]) for r in got if r["query_id"] == id_] == bm25_by_hand(docs, text, 4)


def test_bm25_without_excluded_documents_keeps_the_ranks(spark):
    rng = random.Random(5)
    docs = [(f"d{i}", " ".join(rng.choices("abcdefgh", k=rng.randint(1, 9))), i) for i in range(30)]
    queries = [("q1", "a b"), ("q2", "h h c"), ("q3", "zz")]
    banned = [("q1", f"d{i}") for i in range(25)] + [("q2", "d3"), ("q3", "d0"), ("q3", "d2"), ("q3", "gone")]
    index = ranking.BM25().index(spark.createDataFrame(docs, DOCS))
    got = index.rank(spark.createDataFrame(queries, QUERIES), 3, excluded=spark.createDataFrame(banned, "query_id string, doc_id string")).collect()
    for id_, text in queries:
        want = [x for x in bm25_by_hand(docs, text, 30) if (id_, x[0]) not in banned][:3]
        assert [(r["doc_id"], r["rank"], r["score"]) for r in sorted((r for r in got if r["query_id"] == id_), key=lambda r: r["rank"])] == want


def test_cells_find_what_the_exact_search_finds(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(size=8) * 3 + rng.normal(size=(40, 8)) for _ in range(6)]).round(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]], i) for i in range(len(v))] + [(999, None, 999)], "id bigint, embedding array<double>, pos bigint")
    asked = rows.where("id % 20 = 0")
    exact = ranking.Dense().index(rows).rank(asked, 3)
    every = ranking.Cells(cells=6, probes=6).index(rows)
    assert ranking.recall(every.rank(asked, 3), exact).first()["recall"] == 1.0
    assert every.documents.count() == len(v)


def test_bm25_ties_keep_the_order_of_the_corpus(spark):
    docs = spark.createDataFrame([("one", "alpha evidence", 0), ("two", "beta noise", 1), ("three", None, 2)], DOCS)
    got = ranking.BM25().index(docs).rank(spark.createDataFrame([("q", "alpha"), ("n", None)], QUERIES), 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [("n", "one"), ("n", "two"), ("q", "one"), ("q", "two")]


def test_bm25_of_nothing(spark):
    assert ranking.BM25().index(spark.createDataFrame([], DOCS)).rank(spark.createDataFrame([("q", "a")], QUERIES), 3).count() == 0


def test_dense_against_numpy_in_blocks(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(60, 8)).round(2)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]], i) for i in range(60)], "id bigint, embedding array<double>, pos bigint")
    got = ranking.Dense(block=4).index(rows).rank(rows.where("id < 10"), 3, skip_self=True).collect()
    for q in range(10):
        s = v @ v[q]
        want = [i for i in np.lexsort((np.arange(60), -s.round(9))).tolist() if i != q][:3]
        assert [r["doc_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_measures(spark):
    ranked = spark.createDataFrame([("q", "b", 1), ("q", "a", 2), ("u", "a", 1)], "query_id string, doc_id string, rank int")
    wanted = spark.createDataFrame([("q", "a"), ("q", "a"), ("w", "z")], "query_id string, doc_id string")
    got = ranking.query_measures(ranked, wanted, 2).where("query_id = 'q'").first()
    assert (got["recall"], got["hit"], got["rr"], got["ndcg"]) == (1.0, 1.0, 0.5, pytest.approx(1 / math.log2(3)))
    whole = ranking.retrieval_measures(ranked, wanted, 2).first()
    assert (whole["evaluated"], whole["recall_at_k"]) == (2, 0.5)
    none = ranking.retrieval_measures(ranked, wanted.limit(0), 2).first()
    assert (none["evaluated"], none["mrr"]) == (0, 0.0)


def test_retriever_kinds():
    assert isinstance(ranking.retriever({"kind": "bm25"}), ranking.BM25)
    with pytest.raises(NotImplementedError):
        ranking.retriever({"kind": "hybrid"})
    with pytest.raises(ValueError, match="unknown"):
        ranking.retriever({"kind": "x"})


def test_negatives(spark):
    docs = spark.createDataFrame([(f"d{i}", f"text {i}", i) for i in range(7)], DOCS)
    asked = spark.createDataFrame([("a", "q"), ("b", "q")], QUERIES)
    relevant = spark.createDataFrame([("a", "d1"), ("a", "d2"), ("b", "gone")], "query_id string, doc_id string")
    got = mining.random_negatives(asked, docs, relevant, 3).collect()
    assert Counter(r["query_id"] for r in got) == {"a": 3, "b": 3}
    assert not {r["doc_id"] for r in got if r["query_id"] == "a"} & {"d1", "d2"}
    assert {tuple(r) for r in got} == {tuple(r) for r in mining.random_negatives(asked, docs, relevant, 3).collect()}
    assert len({r["doc_id"] for r in mining.random_negatives(asked, docs, relevant, 99).collect() if r["query_id"] == "a"}) == 5
    ranked = spark.createDataFrame([("a", f"d{i}", i + 1, 1.0 - i / 10) for i in range(7)], "query_id string, doc_id string, rank int, score double")
    hard = mining.hard_negatives(ranked, relevant, 2).orderBy("nth").collect()
    assert [(r["doc_id"], r["rank"]) for r in hard] == [("d0", 1), ("d3", 4)]


def test_training_examples(spark):
    docs = spark.createDataFrame([(f"d{i}", f"text {i}", i) for i in range(5)], DOCS)
    rows = spark.createDataFrame([("a", "q", "yes", [" d1 ", None, "d1"]), ("b", "q", " ", ["d1"]), ("c", "q", "no", ["gone"])], "id string, question string, reference_answer string, relevant_doc_ids array<string>")
    negatives = spark.createDataFrame([("a", "d3"), ("b", "d4"), ("c", "d4")], "query_id string, doc_id string")
    got = mining.training_examples(rows, docs, negatives).collect()
    assert [r["id"] for r in got] == ["a"]
    assert {(c["doc_id"], c["relevant"]) for c in got[0]["contexts"]} == {("d1", True), ("d3", False)}
    assert (got[0]["evidence_doc_ids"], got[0]["problems"]) == (["d1"], [])


@pytest.mark.parametrize("postings", [40, 10_000])
def test_bm25_in_blocks_and_rounds(spark, postings):
    """Rare, common and repeated terms, equal documents, and more queries and documents than a round and a block hold."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    docs = [(f"d{i}", " ".join(rng.choices(words, [1 / (n + 1) for n in range(60)], k=rng.randint(0, 25))), i * 3) for i in range(400)]
    docs += [(f"s{i}", docs[i % 7][1], 2000 - i) for i in range(60)]
    docs.sort(key=lambda d: d[2])
    queries = [(f"q{i}", " ".join(rng.choices(words, k=rng.randint(1, 8)))) for i in range(40)] + [("none", "zz"), ("same", docs[0][1]), ("null", None)]
    banned = [(q, f"d{rng.randint(0, 399)}") for q, _ in queries for _ in range(5)] + [(q, "gone") for q, _ in queries]
    index = ranking.BM25(postings=postings, round_size=15, sample=100).index(spark.createDataFrame(rng.sample(docs, len(docs)), DOCS).repartition(3))
    asked = spark.createDataFrame(queries, QUERIES)
    one = index.rank(asked, 6).collect()
    other = index.rank(asked, 4, excluded=spark.createDataFrame(banned, "query_id string, doc_id string")).collect()
    for id_, text in queries:
        want = bm25_by_hand(docs, text or "", len(docs))
        for got, k, without in ((one, 6, ()), (other, 4, banned)):
            rows = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == id_)
            assert [(d, n, s) for n, d, s in rows] == [x for x in want if (id_, x[0]) not in without][:k]


@pytest.mark.parametrize("postings, pairs", [(40, 30), (10_000, 1_000_000)])
def test_bm25_searches_common_terms_once_for_all_their_queries(spark, monkeypatch, postings, pairs):
    """Questions of a few wordings with names of their own, some with many excluded documents; ties, and none in common."""
    monkeypatch.setattr(ranking, "PAIRS", pairs)
    rng = random.Random(13)
    words, names = [f"w{i}" for i in range(12)], [f"n{i}" for i in range(80)]
    docs = [(f"d{i}", " ".join(rng.choices(words, k=rng.randint(0, 8)) + rng.sample(names, rng.randint(0, 2))), i * 2) for i in range(300)]
    wordings = [" ".join(rng.choices(words, k=3)) for _ in range(5)] + ["", "zz"]
    queries = [(f"q{i}", f"{rng.choice(wordings)} {' '.join(rng.sample(names, rng.randint(0, 3)))}") for i in range(90)]
    banned = [(q, f"d{rng.randint(0, 299)}") for q, _ in queries for _ in range(6)] + [("q1", f"d{i}") for i in range(250)]
    index = ranking.BM25(postings=postings, round_size=40, sample=100, often=15).index(spark.createDataFrame(docs, DOCS).repartition(3))
    asked = spark.createDataFrame(queries, QUERIES)
    assert index._parts(asked.withColumnRenamed("id", "query_id")).select("part").distinct().count() < 60
    one = index.rank(asked, 6).collect()
    other = index.rank(asked, 4, excluded=spark.createDataFrame(banned, "query_id string, doc_id string")).collect()
    for id_, text in queries:
        want = bm25_by_hand(docs, text, len(docs))
        for got, k, without in ((one, 6, ()), (other, 4, banned)):
            rows = sorted((r["rank"], r["doc_id"], r["score"]) for r in got if r["query_id"] == id_)
            assert [(d, n, s) for n, d, s in rows] == [x for x in want if (id_, x[0]) not in without][:k]


def test_bm25_moves_no_pairs(spark):
    """What is shuffled follows the queries' best documents, not all documents that share a word with a query."""
    docs = spark.range(3000).selectExpr("concat('d', id) as id", "concat('the note on item ', id % 1500, ' of the shop') as text", "id as pos")
    asked = spark.range(200).selectExpr("concat('q', id) as id", "concat('the note on item ', id * 5) as question")
    index = ranking.BM25(sample=500).index(docs)
    found = index._round(asked.withColumnRenamed("id", "query_id"), 2, None)
    assert found.count() < 200 * 2 * max(4, found.rdd.getNumPartitions()) < 200 * 3000
    assert index.rank(asked, 2).count() == 400
