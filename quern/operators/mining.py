"""Negatives for training examples, and the examples built from them."""

from __future__ import annotations

import math
from itertools import islice

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.order import running_total
from quern.operators.records import clean_ids, raft_problems
from quern.runtime import Stash

STRIDES = 1024
"""How many different strides there are at most."""


def hard_negatives(rankings: DataFrame, relevant: DataFrame, count: int) -> DataFrame:
    """(query_id, doc_id, rank, score, nth): the first ``count`` documents of each full ranking that aren't relevant.

    Ranks and scores are those of the ranking, which must go count + the number of relevant documents deep.
    """
    others = rankings.join(relevant.distinct(), ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return others.withColumn("nth", nth).where(F.col("nth") <= count).select("query_id", "doc_id", "rank", "score", "nth")


def shuffled_positions(documents: DataFrame, seed: int) -> DataFrame:
    """(doc_id, place): the documents in the order of their hashes, counted from 0; distributed, without a global sort."""
    rows = documents.select(F.col("id").alias("doc_id"), F.lit(1).alias("one"), F.lit("all").alias("g"), F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), 1, 15), 16, 10).cast("bigint").alias("h"))
    rows = rows.withColumn("h", F.shiftleft("h", 3))  # uniform and not negative
    return running_total(rows, "g", "h", "one", "doc_id", "place").select("doc_id", (F.col("place") - 1).alias("place"))


def random_negatives(examples: DataFrame, documents: DataFrame, relevant: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(query_id, doc_id, nth): ``count`` documents for each example, none of them relevant, or all there are.

    The documents stand on a ring in the order of their hashes. An example starts at a place given by its own hash, and
    walks on by a stride given by another one that has no divisor in common with the ring's size; so it meets no document
    twice, and examples that start side by side part. Relevant documents are passed over; no example meets the whole corpus.
    """
    stash = Stash(documents.sparkSession)
    ring = stash.put(shuffled_positions(documents, seed))
    n = ring.count()
    own = relevant.distinct().groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    start = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256), 1, 12), 16, 10).cast("bigint") % F.lit(max(1, n))
    steady = list(islice((x for x in range(1, max(2, n + 1)) if math.gcd(x, n) == 1), STRIDES)) or [1]
    pick = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.lit("stride"), "id"), 256), 1, 12), 16, 10).cast("bigint") % F.lit(len(steady))
    stride = F.element_at(F.array(*map(F.lit, steady)), (pick + 1).cast("int")).cast("bigint")
    asked = examples.select(F.col("id").alias("query_id"), start.alias("start"), stride.alias("stride")).join(own, "query_id", "left")
    steps = F.least(F.lit(n), F.lit(count) + F.coalesce("n_relevant", F.lit(0))).cast("int")
    asked = asked.select("query_id", "start", "stride", F.explode(F.when(steps > 0, F.sequence(F.lit(0), steps - 1))).alias("step"))
    met = asked.withColumn("place", (F.col("start") + F.col("step") * F.col("stride")) % F.lit(max(1, n))).join(ring, "place")
    met = met.join(relevant.distinct(), ["query_id", "doc_id"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("step"))
    return met.withColumn("nth", nth).where(F.col("nth") <= count).select("query_id", "doc_id", "nth")


def training_examples(examples: DataFrame, documents: DataFrame, negatives: DataFrame, seed: int = 42) -> DataFrame:
    """(id, question, answer, contexts, evidence_doc_ids, problems) of the examples with an answer and relevant documents.

    contexts: the relevant documents in the corpus and the negatives, shuffled by a hash of seed, example and document.
    problems: the rules of evidence that the example breaks, none for one that was built from sound parts.
    """
    usable = examples.where("trim(reference_answer) <> ''").select("id", "question", F.col("reference_answer").alias("answer"), clean_ids(F.col("relevant_doc_ids")).alias("refs"))
    texts = documents.select(F.col("id").alias("doc_id"), "text")
    positive = usable.select("id", F.explode("refs").alias("doc_id"), F.lit(True).alias("relevant"))
    chosen = positive.unionByName(negatives.select(F.col("query_id").alias("id"), "doc_id", F.lit(False).alias("relevant")))
    placed = chosen.join(texts, "doc_id").withColumn("h", F.sha2(F.concat_ws(":", F.lit(seed), "id", "doc_id"), 256))
    context = F.array_sort(F.collect_list(F.struct("h", "doc_id", "text", "relevant")))
    grouped = placed.groupBy("id").agg(context.alias("c"))
    rows = usable.join(grouped, "id").withColumn("contexts", F.transform("c", lambda c: F.struct(c["doc_id"].alias("doc_id"), c["text"].alias("text"), c["relevant"].alias("relevant"))))
    rows = rows.withColumn("evidence_doc_ids", F.transform(F.filter("contexts", lambda c: c["relevant"]), lambda c: c["doc_id"]))
    rows = rows.where(F.size("evidence_doc_ids") > 0)
    return rows.select("id", "question", "answer", "contexts", "evidence_doc_ids", raft_problems(F.col("contexts"), F.col("evidence_doc_ids")).alias("problems"))
