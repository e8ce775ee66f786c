from datetime import datetime

import pytest

from quern.operators import orphans
from quern.runtime import Stash
from quern.streaming.orphans import OrphanStream

DAY = lambda n: datetime(2025, 1, n)
RECORDS = "id string, relevant_doc_ids array<string>, created_at timestamp, kind string"
PARENTS = "id string, added_at timestamp, deleted_at timestamp"


def references(spark, rows):
    return orphans.explode_references(spark.createDataFrame([(*r, "x") for r in rows], RECORDS), "t")


def parents(spark, rows):
    return orphans.parent_index(spark.createDataFrame(rows, PARENTS))


def found(state):
    return {(r["id"], r["ref_id"], r["kind"]) for r in orphans.open_orphans(state).collect()}


def test_kinds_and_dirt(spark):
    rows = [("a", [" d1 ", "d1", None, " \t", "none"], DAY(5)), ("a", ["d1", "none"], DAY(6)), ("b", ["late", "gone", "D1"], DAY(5)), ("c", None, DAY(5)), (None, ["none"], DAY(5)), ("n", ["late"], None), ("e", ["edge", "back"], DAY(5))]
    docs = [("d1", DAY(1), None), ("late", DAY(9), None), ("gone", DAY(1), DAY(3)), ("edge", DAY(5), DAY(5)), ("back", DAY(1), DAY(3)), ("back", DAY(4), None), (None, DAY(1), None)]
    state = orphans.advance(orphans.empty_state(spark), references(spark, rows), parents(spark, docs))
    assert found(state) == {("a", "none", "missing"), ("b", "late", "late"), ("b", "gone", "deleted"), ("b", "D1", "missing"), ("e", "edge", "deleted")}
    counts = {(r["month"], r["n_references"], r["n_missing"]) for r in orphans.snapshot(state).collect()}
    assert counts == {("2025-01", 7, 2), (None, 1, 0)}


def test_increments_resolve_and_reopen(spark):
    stash = Stash(spark)
    state = orphans.advance(orphans.empty_state(spark), references=references(spark, [("a", ["x", "y"], DAY(5))]), stash=stash)
    assert {k for *_, k in found(state)} == {"missing"}
    state = orphans.advance(state, parents=parents(spark, [("x", DAY(1), None), ("y", DAY(7), None)]), stash=stash)
    assert found(state) == {("a", "y", "late")}
    state = orphans.advance(state, parents=parents(spark, [("x", DAY(1), DAY(4))]), references=references(spark, [("b", ["x"], DAY(2)), ("a", ["x"], DAY(5))]), stash=stash)
    assert found(state) == {("a", "y", "late"), ("a", "x", "deleted")}


def test_empty_tables(spark):
    state = orphans.advance(orphans.empty_state(spark), references(spark, [("a", ["x"], DAY(1))]).limit(0), parents(spark, [("x", DAY(1), None)]).limit(0))
    assert found(state) == set()


def test_hot_references_don_t_need_a_shuffle_of_theirs(spark):
    rows = spark.range(6000).selectExpr("'t' as tbl", "cast(id as string) as id", "if(id % 3 = 0, 'hot', concat('d', id)) as ref_id", "timestamp'2025-01-05' as created_at")
    docs = spark.range(6000).selectExpr("concat('d', id) as ref_id", "timestamp'2025-01-01' as added_at", "cast(null as timestamp) as deleted_at")
    state = orphans.advance(orphans.empty_state(spark), rows, docs)
    assert state.references.count() == 6000
    assert {k for *_, k in found(state)} == {"missing"} and len(found(state)) == 2000


def test_stream_equals_batch(spark, tmp_path):
    docs = [("x", DAY(1), None), ("y", DAY(7), None), ("z", DAY(1), DAY(2))]
    rows = [("a", ["x", "y", "q"], DAY(5)), ("b", ["z"], DAY(5))]
    batch = orphans.advance(orphans.empty_state(spark), references(spark, rows), parents(spark, docs))
    references(spark, rows[:1]).write.parquet(f"{tmp_path}/refs/1")
    parents(spark, docs).write.parquet(f"{tmp_path}/parents/1")
    tracker = OrphanStream(spark, f"{tmp_path}/state")
    schema = "tbl string, id string, ref_id string, created_at timestamp"
    tracker.start("references", spark.readStream.schema(schema).parquet(f"{tmp_path}/refs/*"), f"{tmp_path}/c1").awaitTermination()
    tracker.start("parents", spark.readStream.schema(orphans.PARENTS).parquet(f"{tmp_path}/parents/*"), f"{tmp_path}/c2").awaitTermination()
    references(spark, rows[1:]).write.parquet(f"{tmp_path}/refs/2")
    tracker.start("references", spark.readStream.schema(schema).parquet(f"{tmp_path}/refs/*"), f"{tmp_path}/c1").awaitTermination()
    assert found(tracker.state()) == found(batch) and found(batch)
    before = tracker.version
    tracker.apply("references", references(spark, rows), 0)  # a batch that was done before
    assert tracker.version == before


def test_stream_outlives_its_process(spark, tmp_path):
    """A new object goes on where the last one stopped, also when it died between writing a version and its index."""
    docs = [("x", DAY(1), None), ("y", DAY(7), None), ("z", DAY(1), DAY(2))]
    rows = [("a", ["x", "y", "q"], DAY(5)), ("b", ["z"], DAY(5)), ("c", ["q", "w"], DAY(5))]
    batch = orphans.advance(orphans.empty_state(spark), references(spark, rows), parents(spark, docs))
    state = f"{tmp_path}/state"
    OrphanStream(spark, state).apply("references", references(spark, rows[:1]), 0)
    dying = OrphanStream(spark, state)
    dying._publish = lambda index: (_ for _ in ()).throw(OSError("lost"))
    with pytest.raises(OSError):
        dying.apply("parents", parents(spark, docs), 0)
    for n in range(2):
        OrphanStream(spark, state).apply("parents", parents(spark, docs), n)
    last = OrphanStream(spark, state)
    before = last.index["at"]
    last.apply("references", references(spark, rows[1:]), 1)
    last.apply("references", references(spark, rows[1:]), 1)
    assert found(OrphanStream(spark, state).state()) == found(batch) and last.version == 4
    moved = {b for b, v in last.index["at"].items() if before.get(b) != v}
    assert len(moved) <= 3  # the ids z, q and w
    with pytest.raises(ValueError, match="buckets"):
        OrphanStream(spark, state, buckets=8)


@pytest.mark.parametrize("ids", [["a" * 5000], [""]])
def test_odd_ids(spark, ids):
    state = orphans.advance(orphans.empty_state(spark), references(spark, [("r", ids, DAY(1))]), parents(spark, [("x", None, None)]))
    assert len(found(state)) == (ids != [""])
