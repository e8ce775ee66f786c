import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quern.llm import mixing, packing


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 20), max_size=40))
def test_best_fit_is_valid_and_tight(sizes):
    bins = packing.best_fit([(s, i) for i, s in enumerate(sizes)], 20)
    assert sorted(i for _, b in bins for i in b) == list(range(len(sizes)))
    assert all(fill == sum(sizes[i] for i in b) <= 20 for fill, b in bins)
    assert sum(fill <= 10 for fill, _ in bins) <= 1


def packed(spark, sizes, parts=6, **options):
    frame = spark.createDataFrame([(i, n, "x", "y") for i, n in enumerate(sizes)], "doc_id bigint, n_tokens int, container string, part string").repartition(parts)
    return packing.pack(frame, **options)


@pytest.mark.parametrize("room", [16_384, 10])
def test_every_token_has_a_place(spark, room):
    rng = random.Random(5)
    sizes = [rng.choice([0, 1, 3, 40, 99, 100, 101, 250, 1000]) for _ in range(400)] + [None]
    rows = packed(spark, sizes, parts=20, capacity=100, room=room).collect()
    fill, parts = defaultdict(int), defaultdict(list)
    for r in rows:
        fill[r["container"]] += r["n_tokens"]
        parts[r["doc_id"]].append(r)
    assert max(fill.values()) <= 100
    assert {i: sum(r["n_tokens"] for r in p) for i, p in parts.items()} == {i: n or 0 for i, n in enumerate(sizes)}
    assert {i for i, p in parts.items() if len(p) > 1} == {i for i, n in enumerate(sizes) if (n or 0) > 100}
    assert all(sorted(r["part"] for r in p) == list(range(1, len(p) + 1)) and {r["n_parts"] for r in p} == {len(p)} for p in parts.values())
    assert {r["doc_id"] for r in packing.divided(packed(spark, sizes, capacity=100)).collect()} == {i for i, n in enumerate(sizes) if (n or 0) > 100}


def test_little_room_is_left(spark):
    rng = random.Random(1)
    report = packing.fill_report(packed(spark, [rng.randint(20, 700) for _ in range(3000)], parts=12)).first()
    assert report["used_share"] > 0.98 and report["n_tokens"] <= report["n_containers"] * 1024


def test_equal_halves_that_can_t_be_joined(spark):
    for room in (16_384, 20):
        rows = packed(spark, [60] * 500, parts=10, capacity=100, room=room).collect()
        assert len({r["container"] for r in rows}) == 500


def test_small_groups_pack_nearly_as_well(spark):
    rng = random.Random(2)
    sizes = [rng.randint(200, 700) for _ in range(3000)]
    assert packing.fill_report(packed(spark, sizes, parts=12, room=200)).first()["used_share"] > 0.96


def test_nothing_to_pack(spark):
    assert packed(spark, [1]).where("doc_id < 0").count() == 0
    assert packing.pack(spark.createDataFrame([], "doc_id bigint, n_tokens int")).count() == 0
    with pytest.raises(ValueError):
        packed(spark, [1], capacity=0)


SIZES = "doc_id bigint, source string, n_tokens int, finish string"
TARGETS = "source string, target_share double, max_repeats int"


def test_mix_reaches_the_shares(spark):
    rng = random.Random(8)
    sizes = [(i, "abc"[min(2, i % 7)], rng.randint(50, 150), "x") for i in range(7000)] + [(9001, None, 5, "x"), (9002, "other", 5, "x"), (9003, "a", None, "x"), (9004, "b", 0, "x")]
    targets = spark.createDataFrame([("A ", 0.5, 3), ("b", 0.2, 2), ("c", 0.2, 1), ("gone", 0.1, 4)], TARGETS)
    frame = spark.createDataFrame(sizes, SIZES)
    mix, report = mixing.mix(frame, targets, mixing.exact_budget(frame, targets))
    rows = mix.collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    assert len({(r["doc_id"], r["copy"]) for r in rows}) == len(rows)
    shares = {r["source"]: r for r in report.collect()}
    for s, want, repeats in (("a", 0.5 / 0.9, 3), ("b", 0.2 / 0.9, 2), ("c", 0.2 / 0.9, 1)):
        assert shares[s]["reached_share"] == pytest.approx(want, abs=0.002) and shares[s]["most_copies"] <= repeats
        assert shares[s]["n_tokens"] == sum(r["n_tokens"] for r in rows if r["source"] == s)
    assert (shares["gone"]["n_tokens"], shares["gone"]["reached_share"]) == (0, 0.0)
    total = {s: sum(n or 0 for _, x, n, _ in sizes if x == s) for s in "abc"}
    best = min(total["a"] * 3 / (0.5 / 0.9), total["b"] * 2 / (0.2 / 0.9), total["c"] / (0.2 / 0.9))
    assert best - 1000 < sum(r["n_tokens"] for r in rows) <= best


def test_a_source_that_runs_out_is_made_up_for(spark):
    """Half of the mix is wanted from a tenth of the documents, twice at most; the others share what it lacks, 3 to 2."""
    sizes = [(i, "a" if i % 10 == 0 else "bc"[i % 2], 10, "x") for i in range(10_000)] + [(-1, "d", 10, "x")]
    targets = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 1), ("c", 0.2, 5)], TARGETS)
    mix, report = mixing.mix(spark.createDataFrame(sizes, SIZES), targets)
    shares = {r["source"]: r for r in report.collect()}
    assert mix.agg({"n_tokens": "sum"}).first()[0] == 100_000 == sum(r["n_tokens"] for r in shares.values())
    assert shares["a"]["n_tokens"] == 20_000 and shares["a"]["most_copies"] == 2 and shares["a"]["reached_share"] == 0.2
    assert shares["b"]["n_tokens"] == min(40_000, 48_000) and shares["c"]["n_tokens"] == 40_000
    assert mixing.finish_time([(0.5, 10), (0.5, 100)], 50) == pytest.approx(80) and mixing.finish_time([(1.0, 5)], 9) == 5


def test_mix_to_a_budget(spark):
    sizes = spark.createDataFrame([(i, "ab"[i % 2], 10, "x") for i in range(100)], SIZES)
    targets = spark.createDataFrame([("a", 0.75, 2), ("b", 0.25, 2)], TARGETS)
    rows = mixing.mix(sizes, targets, total_tokens=400)[0].collect()
    assert sum(r["n_tokens"] for r in rows) == 400 and sum(r["source"] == "a" for r in rows) == 30
    assert max(r["copy"] for r in rows) == 1
    again = mixing.mix(sizes, targets, total_tokens=400)[0].collect()
    assert rows == again


def test_mix_of_nothing(spark):
    mix, report = mixing.mix(spark.createDataFrame([], SIZES), spark.createDataFrame([("a", 1.0, 2)], TARGETS))
    assert mix.count() == 0 and report.first()["reached_share"] == 0
