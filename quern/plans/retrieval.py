"""Queries on retrieval: BM25, dense vectors, their measures, negatives and training examples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import mining, ranking
from quern.plans.common import EVAL, NUMBER, SEED, TOP_K, TRAIN, documents, examples, relevant, sql_clean, sql_hash, sql_words
from quern.runtime import Stash, table


def _rounded(rankings: DataFrame) -> DataFrame:
    return rankings.select("query_id", "doc_id", F.col("rank").cast("bigint").alias("rank"), F.round("score", 6).alias("score"))


def _bm25(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int, excluded: DataFrame | None = None) -> DataFrame:
    index = ranking.BM25().index(documents(spark, sf_dir))
    ranked = index.rank(queries, k, excluded)
    index.release()
    return ranked


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_bm25(spark, sf_dir, examples(spark, sf_dir), TOP_K))


def bm25_index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranking.BM25().index(documents(spark, sf_dir))
    terms = index.terms.agg(F.count("*").alias("n_terms"), F.sum("df").alias("n_postings"), F.round(F.avg("idf"), 6).alias("mean_idf"))
    return index.stats.select("n_docs", F.round("avgdl", 6).alias("avgdl")).crossJoin(terms)  # one row each


def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = Stash(spark).put(examples(spark, sf_dir).select("id", "question", "relevant_doc_ids"))
    return ranking.retrieval_measures(_bm25(spark, sf_dir, queries, TOP_K), relevant(queries), TOP_K)


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding", F.col("vec_id").alias("pos"), "label")


def _dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _vectors(spark, sf_dir)
    return ranking.Dense().index(vectors).rank(vectors.where(F.col("id") % 20 == 0), TOP_K, skip_self=True)


def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_dense(spark, sf_dir))


def dense_label_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of the query's label are relevant; they are counted by label, and only ranked ones are looked up."""
    vectors = _vectors(spark, sf_dir)
    one = vectors.where(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "label")
    sizes = one.join(vectors.groupBy("label").agg((F.count("*") - 1).alias("n")), "label").select("query_id", "n")
    ranked = _dense(spark, sf_dir).join(one, "query_id").join(vectors.select(F.col("id").alias("doc_id"), F.col("label").alias("own")), "doc_id")
    return ranking.mean_measures(ranking.hit_measures(ranked.where("label = own").select("query_id", "rank"), sizes, TOP_K))


def dense_cells_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of the exact search the inverted file finds."""
    vectors = _vectors(spark, sf_dir)
    found = ranking.Cells().index(vectors).rank(vectors.where(F.col("id") % 20 == 0), TOP_K, skip_self=True)
    return ranking.recall(found, _dense(spark, sf_dir)).select("n_exact", (F.col("recall") >= 0.9).alias("enough"))


def bm25_common_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus whose terms all stand in more than half of its documents, so that sharing one counts against a document."""
    key = F.col("n_nationkey").cast("bigint")
    words = [F.lit("all"), F.when(key % 5 != 0, "most"), F.when(key % 3 != 0, "many"), F.when(key % 2 == 0, "half half")]
    docs = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), key.cast("string")).alias("id"), F.concat_ws(" ", *words).alias("text"), key.alias("pos"))
    asked = spark.createDataFrame([("a", "all"), ("m", "most many most"), ("h", "half zz"), ("z", "zz"), ("e", "")], "id string, question string")
    return _rounded(ranking.BM25().index(docs).rank(asked, 12))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries = examples(spark, sf_dir, "train_qa")
    return _rounded(_bm25(spark, sf_dir, queries, 2, relevant(queries)))


def random_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = examples(spark, sf_dir, "train_qa")
    mined = mining.random_negatives(train, documents(spark, sf_dir), relevant(train), 2, SEED)
    return mined.select("query_id", "doc_id", F.col("nth").cast("bigint").alias("nth"))


def raft_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, docs = examples(spark, sf_dir, "train_qa"), documents(spark, sf_dir)
    negatives = Stash(spark).put(mining.random_negatives(train, docs, relevant(train), 2, SEED))
    rows = mining.training_examples(train, docs, negatives, SEED)
    ids = F.array_join(F.transform("contexts", lambda c: F.concat(c["doc_id"], F.when(c["relevant"], "+").otherwise("-"))), " ")
    chars = F.aggregate("contexts", F.lit(0).cast("bigint"), lambda n, c: n + F.char_length(c["text"]))
    return rows.select("id", ids.alias("contexts"), F.array_join("evidence_doc_ids", " ").alias("evidence"), chars.alias("n_chars"), F.size("problems").cast("bigint").alias("n_problems"))


def bm25_sql(queries: str, k: str) -> str:
    """The rankings r (qid, id, pos, s, rank) of the queries (id, question), as common table expressions."""
    return f"""
d AS (SELECT id, doc_id AS pos, coalesce({sql_words('text')}, []) AS w FROM documents),
tf AS (SELECT id, pos, dl, term, count(*) AS tf FROM (SELECT id, pos, len(w) AS dl, unnest(w) AS term FROM d) GROUP BY ALL),
st AS (SELECT count(*) AS n, avg(len(w)) AS a FROM d),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
raw AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS r FROM df, st),
idf AS (SELECT term, df, CASE WHEN r < 0 THEN 0.25 * (SELECT avg(r) FROM raw) ELSE r END AS i FROM raw),
q AS (SELECT qid, term, count(*) AS qtf FROM (SELECT id AS qid, unnest({sql_words('question')}) AS term FROM ({queries})) GROUP BY ALL),
s AS (SELECT qid, tf.id, pos, sum(qtf * i * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS s FROM q JOIN tf USING (term) JOIN idf USING (term), st GROUP BY ALL),
al AS (SELECT u.id AS qid, d.id, d.pos, coalesce(s.s, 0) AS s FROM ({queries}) u CROSS JOIN d LEFT JOIN s ON s.qid = u.id AND s.id = d.id),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, pos) AS rank FROM al) WHERE rank <= {k})"""


_ALL = "SELECT id, question FROM ev"
_ASKED = f"SELECT id, question FROM ev WHERE {NUMBER} % 20 = 0"
_ALL_TRAIN = "SELECT id, question FROM tr"


def _measures_sql(relevant: str) -> str:
    """Measures of the rankings r (qid, id, rank) against rel (qid, id), at 5."""
    return f"""rel AS ({relevant}),
f AS (SELECT rel.qid, count(*) AS n, count(r.rank) AS h, min(r.rank) AS fst, sum(1 / log2(r.rank + 1)) AS dcg FROM rel LEFT JOIN r ON r.qid = rel.qid AND r.id = rel.id GROUP BY rel.qid),
m AS (SELECT h / n AS recall, CASE WHEN h > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(1.0 / fst, 0) AS rr, coalesce(dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))), 0) AS ndcg FROM f)
SELECT round(avg(recall), 6) AS recall_at_k, round(avg(hit), 6) AS hit_rate_at_k, round(avg(rr), 6) AS mrr, round(avg(ndcg), 6) AS ndcg_at_k, count(*) AS evaluated FROM m"""


_DENSE = """v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label FROM embeddings),
r AS (SELECT * FROM (SELECT qid, id, s, row_number() OVER (PARTITION BY qid ORDER BY round(s, 9) DESC, id) AS rank
      FROM (SELECT q.id AS qid, v.id, list_dot_product(q.e, v.e) AS s FROM v q JOIN v ON q.id % 20 = 0 AND q.id <> v.id)) WHERE rank <= 5)"""

_RANDOM = f"""{TRAIN},
ring AS (SELECT id AS did, row_number() OVER (ORDER BY {sql_hash("'42'", 'id')}, id) - 1 AS place FROM documents),
n AS (SELECT count(*) AS n FROM documents),
sd AS (SELECT list(x ORDER BY x)[1:1024] AS sd FROM n, range(1, 20000) t(x) WHERE gcd(x, n.n) = 1 AND x <= greatest(1, n.n)),
rel AS (SELECT DISTINCT id AS qid, unnest({sql_clean('relevant_doc_ids')}) AS did FROM tr),
own AS (SELECT qid, count(*) AS c FROM rel GROUP BY qid),
a AS (SELECT tr.id AS qid, {sql_hash("'42'", 'tr.id', digits=12)} % n.n AS st, sd.sd[1 + {sql_hash("'42'", "'stride'", 'tr.id', digits=12)} % len(sd.sd)] AS sr, n.n, unnest(range(0, least(n.n, 2 + coalesce(own.c, 0)))) AS step FROM tr LEFT JOIN own ON own.qid = tr.id, n, sd),
met AS (SELECT a.qid, ring.did, a.step FROM a JOIN ring ON ring.place = (a.st + a.step * a.sr) % a.n ANTI JOIN rel ON rel.qid = a.qid AND rel.did = ring.did),
neg AS (SELECT * FROM (SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY step) AS nth FROM met) WHERE nth <= 2)"""

QUERIES = {f.__name__: f for f in (bm25_topk, bm25_index_stats, bm25_common_terms, retrieval_metrics, dense_topk, dense_label_metrics, dense_cells_recall, hard_negatives, random_negatives, raft_examples)}
SQL = {
    "bm25_topk": f"WITH {EVAL}, {bm25_sql(_ALL, '5')} SELECT qid AS query_id, id AS doc_id, rank, round(s, 6) AS score FROM r",
    "bm25_index_stats": f"WITH {EVAL}, {bm25_sql(_ASKED, '5')} SELECT n AS n_docs, round(a, 6) AS avgdl, count(*) AS n_terms, CAST(sum(df) AS BIGINT) AS n_postings, round(avg(i), 6) AS mean_idf FROM idf, st GROUP BY n, a",
    "retrieval_metrics": f"WITH {EVAL}, {bm25_sql(_ALL, '5')}, " + _measures_sql(f"SELECT DISTINCT id AS qid, unnest({sql_clean('relevant_doc_ids')}) AS id FROM ev"),
    "bm25_common_terms": f"""WITH documents AS (SELECT 'n' || n_nationkey AS id, CAST(n_nationkey AS BIGINT) AS doc_id, 'all' || CASE WHEN n_nationkey % 5 <> 0 THEN ' most' ELSE '' END || CASE WHEN n_nationkey % 3 <> 0 THEN ' many' ELSE '' END || CASE WHEN n_nationkey % 2 = 0 THEN ' half half' ELSE '' END AS text FROM nation),
        ask AS (SELECT * FROM (VALUES ('a', 'all'), ('m', 'most many most'), ('h', 'half zz'), ('z', 'zz'), ('e', '')) v(id, question)), {bm25_sql("SELECT id, question FROM ask", "12")}
        SELECT qid AS query_id, id AS doc_id, rank, round(s, 6) AS score FROM r""",
    "dense_cells_recall": "SELECT count(*) * 5 AS n_exact, TRUE AS enough FROM embeddings WHERE vec_id % 20 = 0",
    "dense_topk": f"WITH {_DENSE} SELECT qid AS query_id, id AS doc_id, rank, round(s, 6) AS score FROM r",
    "dense_label_metrics": f"WITH {_DENSE}, " + _measures_sql("SELECT q.id AS qid, v.id FROM v q JOIN v ON q.label = v.label AND q.id <> v.id AND q.id % 20 = 0"),
    "hard_negatives": f"""WITH {TRAIN}, rel AS (SELECT DISTINCT id AS qid, unnest({sql_clean('relevant_doc_ids')}) AS id FROM tr),
        {bm25_sql(_ALL_TRAIN, '(SELECT count(*) FROM documents)')},
        h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank) AS nth FROM r ANTI JOIN rel ON rel.qid = r.qid AND rel.id = r.id)
        SELECT qid AS query_id, id AS doc_id, rank, round(s, 6) AS score FROM h WHERE nth <= 2""",
    "random_negatives": f"WITH {_RANDOM} SELECT qid AS query_id, did AS doc_id, nth FROM neg",
    "raft_examples": f"""WITH {_RANDOM},
        c AS (SELECT qid, did, TRUE AS relevant FROM rel UNION ALL SELECT qid, did, FALSE FROM neg),
        p AS (SELECT c.qid, c.did, c.relevant, d.text, sha256(concat_ws(':', '42', c.qid, c.did)) AS h FROM c JOIN documents d ON d.id = c.did JOIN tr ON tr.id = c.qid AND trim(tr.reference_answer, ' ') <> '')
        SELECT qid AS id, string_agg(did || CASE WHEN relevant THEN '+' ELSE '-' END, ' ' ORDER BY h) AS contexts,
               string_agg(did, ' ' ORDER BY h) FILTER (relevant) AS evidence, CAST(sum(length(text)) AS BIGINT) AS n_chars, CAST(0 AS BIGINT) AS n_problems
        FROM p GROUP BY qid HAVING count(*) FILTER (relevant) > 0""",
}
