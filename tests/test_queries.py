from pathlib import Path

import pytest

import compare
from quern.plans import registry, retrieval
from quern.plans.common import examples, relevant
from quern.runtime import shared_folder, table

pytestmark = pytest.mark.skipif(not compare.FOLDER.exists(), reason="no test tables here")


def test_queries_equal_their_sql(spark):
    assert compare.differences(spark, registry.queries(), registry.sql()) == {}


def test_the_entry_runs(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


def test_retrieval_metrics_keep_neither_index_nor_examples(spark):
    """Once the queries are ranked, the disk holds their rankings, not the corpus, and nothing reads the tables again."""
    folder = Path(shared_folder(spark).removeprefix("file:"))
    held = lambda: sum(p.stat().st_size for p in folder.rglob("*") if p.is_file())
    before = held()
    found = retrieval.retrieval_metrics(spark, str(compare.FOLDER))
    assert held() - before < (compare.FOLDER / "documents.parquet").stat().st_size
    assert not [f for f in found.inputFiles() if str(compare.FOLDER) in f]
    assert found.collect() == found.collect()


def test_bm25_topk_ranks_every_example(spark):
    every = {r["id"] for r in table(spark, str(compare.FOLDER), "eval").where("id is not null").collect()}
    assert {r["query_id"] for r in retrieval.bm25_topk(spark, str(compare.FOLDER)).collect()} == every


def test_retrieval_metrics_evaluate_every_example_with_references(spark):
    every = relevant(examples(spark, str(compare.FOLDER))).select("query_id").distinct().count()
    assert retrieval.retrieval_metrics(spark, str(compare.FOLDER)).first()["evaluated"] == every > 20


def test_hard_negatives_are_there_for_every_training_example(spark):
    every = {r["id"] for r in examples(spark, str(compare.FOLDER), "train_qa").select("id").collect()}
    assert {r["query_id"] for r in retrieval.hard_negatives(spark, str(compare.FOLDER)).collect()} == every
