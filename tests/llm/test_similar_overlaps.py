import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from quern.llm import overlaps, similar, tables
from quern.llm.shingles import Shingler

DOCS = "doc_id bigint, text string, rep string, a string"


def shingle_set(text, width):
    words = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(docs, threshold, width):
    sets = {i: shingle_set(t, width) for i, t, *_ in docs if t is not None}
    texts = {i: t for i, t, *_ in docs if t is not None}
    out = set()
    for i in sets:
        for j in sets:
            if i < j:
                both, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
                if texts[i] == texts[j] or (either and both >= threshold * either - 1e-9):
                    out.add((i, j))
    return out


def altered(rng, text):
    words = text.split(" ")
    for _ in range(rng.randint(0, 5)):
        k = rng.randrange(len(words) or 1)
        word = words[k] if words else "w"
        words[k : k + 1] = rng.choice([[], [word, "new"], [word + "x"], [word.upper()]])
    return " ".join(words)


def corpus(seed, n=60):
    rng = random.Random(seed)
    base = [" ".join(f"w{int(rng.paretovariate(0.4)) % 900}" for _ in range(rng.randint(1, 80))) for _ in range(n)]
    rows = [(i, t) for i, t in enumerate(base + [altered(rng, t) for t in base for _ in range(2)])]
    rows += [(1000, None), (1001, ""), (1002, ""), (1003, "two words"), (1004, "two words"), (1005, "Two  Words"), (1006, "\x00 �"), (1007, "z " * 20000), (1008, "z " * 20001), (-5, base[0])]
    return [(i, t, "x", "y") for i, t in rows]


@pytest.mark.parametrize(("seed", "threshold", "width"), [(0, 0.6, 3), (1, 0.6, 3), (2, 0.8, 5), (3, 0.3, 2), (4, 1.0, 3)])
def test_pairs_against_all_pairs(spark, seed, threshold, width):
    docs = corpus(seed)
    members, links = similar.similar_classes(spark.createDataFrame(docs, DOCS), threshold, width)
    got = [(r["doc_id_a"], r["doc_id_b"]) for r in similar.similar_pairs(members, links).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(docs, threshold, width)


def test_long_lists_are_cut(spark, monkeypatch):
    monkeypatch.setattr(similar, "HOT_LIST", 4)
    docs = corpus(7)
    members, links = similar.similar_classes(spark.createDataFrame(docs, DOCS), 0.6, 3)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in similar.similar_pairs(members, links).collect()} == brute(docs, 0.6, 3)


@pytest.mark.parametrize("bits", [16, 10, 6])
def test_a_full_table_changes_neither_pairs_nor_postings(spark, monkeypatch, bits):
    """Shrunk up to a thousandfold, the table only stops telling which elements occur once."""
    monkeypatch.setattr(tables, "SLICE", 64)
    monkeypatch.setattr(similar, "bits_for", lambda keys, most: bits)
    docs = corpus(8)
    frame = spark.createDataFrame(docs, DOCS).repartition(7)
    members, links = similar.similar_classes(frame, 0.6, 3)
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in similar.similar_pairs(members, links).collect()} == brute(docs, 0.6, 3)
    hits = tables.summed(similar._scan(frame, 3, bits), 1 << bits)
    assert int(hits.sum()) == sum(len(shingle_set(t, 3)) for _, t, *_ in docs)
    texts = frame.select("doc_id", "text").where("text is not null")
    posted = similar._postings(texts, 3, bits, spark.sparkContext.broadcast(similar.levels(hits)), Fraction("0.6"), 8).agg({"n": "sum"}).first()[0]
    sizes = [n for _, t, *_ in docs if (n := len(shingle_set(t, 3)))]
    assert posted <= sum(n - math.ceil(0.6 * n - 1e-9) + 1 for n in sizes)


def test_packed_postings_come_back():
    rng = np.random.default_rng(1)
    columns = [np.sort(rng.integers(0, 1 << 40, 500).astype(np.uint64)), rng.integers(-(1 << 62), 1 << 62, 500), rng.integers(1, 9999, 500), rng.integers(0, 9, 500), rng.integers(0, 3, 500)]
    assert all((a == b).all() for a, b in zip(columns, similar._unpacked(similar._packed(columns), 500)))


def test_groups_of_copies(spark):
    docs = spark.range(900).selectExpr("id as doc_id", "if(id % 3 = 0, 'one text that many rows share here', concat('own words of row ', id, ' only ', id * 7)) as text", "'x' as rep", "'y' as a")
    members, links = similar.similar_classes(docs, 0.6, 3)
    groups = similar.similar_groups(members, links)
    assert groups.where("group_id = 0").count() == 300 and groups.count() == 900
    assert similar.similar_classes(docs.limit(0), 0.6, 3)[0].count() == 0
    with pytest.raises(ValueError):
        similar.similar_classes(docs, 0.0, 3)


def test_hashes_don_t_depend_on_the_neighbours():
    rng = random.Random(4)
    texts = [" ".join(rng.choices(["ab", "ba", "a", "b", "é", "ß_", "12"], k=rng.randint(0, 30))) for _ in range(200)] + [None, ""]
    s = Shingler(3)
    together = [set(h[a:b].tolist()) for _, h, bounds in s.chunks(texts) for a, b in zip(bounds[:-1], bounds[1:])]
    alone = [set(s(t).tolist()) for t in texts]
    assert together == alone
    assert [len(x) for x in alone] == [len(shingle_set(t, 3)) for t in texts]


QA = "id string, question string, metadata struct<split:string,source:string>, key string, n string"


def brute_overlaps(evals, trains):
    def grams(q):
        t = re.sub(r"[\W_]+", " ", (q or "").lower()).strip(" ")
        return {t[i : i + 3] for i in range(len(t) - 2)}

    out = set()
    for e, q, *_ in evals:
        for t, p, *_ in trains:
            x, y = grams(q), grams(p)
            if e and t and x and y and 4 * len(x & y) >= 3 * len(x | y):
                out.add((e, t))
    return out


@pytest.mark.parametrize("hot", [4000, 5])
def test_overlaps_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(overlaps, "HOT_KEY", hot)
    rng = random.Random(6)
    trains = [(f"t{i}", " ".join(rng.choice(["what", "does", "the", "cache", "keep", "for", f"name{rng.randint(0, 9999)}x"]) for _ in range(rng.randint(4, 12))) + "?", ("train", "s"), "x", "y") for i in range(150)]
    evals = []
    for i in range(80):
        q = list(rng.choice(trains)[1])
        for _ in range(rng.choice([0, 0, 1, 2, 3, 4])):
            q[rng.randrange(len(q))] = rng.choice("abc 7-")
        evals.append((f"e{i}", "".join(q).upper() if i % 3 else "".join(q), ("test" if i % 2 else "validation", "s"), "x", "y"))
    evals += [("n", None, None, "x", "y"), ("b", "  ", None, "x", "y"), ("s", "ab", None, "x", "y"), (None, "what", None, "x", "y"), ("l", "long " * 20000, None, "x", "y"), evals[0]]
    trains += [("b", " ", None, "x", "y"), ("s", "ab", None, "x", "y"), ("l", "long " * 20000, None, "x", "y"), trains[0]]
    e, t = spark.createDataFrame(evals, QA), spark.createDataFrame(trains, QA)
    found = overlaps.split_overlaps(e, t)
    rows = found.collect()
    assert {(r["eval_id"], r["train_id"]) for r in rows} == brute_overlaps(evals, trains) and len(rows) == len(brute_overlaps(evals, trains))
    assert all(0 <= r["overlap"] <= 1 and 0.75 <= r["similarity"] <= 1 for r in rows)
    report = overlaps.overlap_report(found, e).collect()
    assert sum(r["n_pairs"] for r in report) == len(rows) and sum(r["n_records"] for r in report) == 84
    assert overlaps.split_overlaps(e.limit(0), t).count() == 0 == overlaps.split_overlaps(e, t.limit(0)).count()


def test_chunks_move_with_their_content():
    chunker = overlaps.Chunker()
    text = "which component keeps noisy labels on behalf of the ranker"
    assert "".join(chunker(text)) == text
    a, b = Counter(chunker(text)), Counter(chunker("and " + text))
    assert sum(len(c) * min(n, b[c]) for c, n in a.items()) > 0.7 * len(text)


def test_overlaps_of_short_and_repetitive_questions(spark):
    """Pairs whose chunks hardly meet, though their sequences do: short ones with an edit, repeated words, elongated letters."""
    rng = random.Random(4)
    word = lambda k: "".join(rng.choices("abdeilnorstuw", k=k))
    evals, trains = [("e", "wo legt"), ("f", "la liste")], [("t", "awo legt"), ("u", "la liste" + "e" * 150)]
    for i in range(80):
        short = f"{word(rng.randint(2, 8))} {word(rng.randint(3, 10))}"
        at = rng.randint(0, len(short))
        long = " ".join(word(rng.randint(3, 7)) for _ in range(8))
        evals += [(f"a{i}", short), (f"b{i}", long), (f"c{i}", long)]
        trains += [(f"s{i}", short[:at] + word(1) + short[at:]), (f"r{i}", long + (" " + long.split()[-1]) * 30), (f"l{i}", long + long[-1] * 150)]
    e, t = (spark.createDataFrame(x, "id string, question string") for x in (evals, trains))
    found = {(r["eval_id"], r["train_id"]) for r in overlaps.split_overlaps(e, t).collect()}
    assert found == brute_overlaps(evals, trains) and ("e", "t") in found


def test_overlaps_meet_over_pairs_of_rare_sequences(spark):
    """Similar texts meet, whatever differs; texts of one wording with other names mostly don't, however many there are."""
    rng = random.Random(12)
    name = lambda k: "".join(rng.choice("bdfghjklmnprstvz") + rng.choice("aeiou") for _ in range(k))
    asked = [f"how many frozen layers may {name(5)} {rng.randint(1000, 99999)}{name(1)} pass to {name(4)} under heavy load" for _ in range(600)]
    near = []
    for text in asked[:200]:
        q = list(text)
        for _ in range(rng.randint(0, 4)):
            q[rng.randrange(len(q))] = rng.choice("xyz ")
        near.append(overlaps.normal("".join(q)))
    rows = spark.createDataFrame([(str(i).encode(), t) for i, t in enumerate([*asked, *near])], "digest binary, norm string")
    least = Fraction("0.75")
    table = spark.sparkContext.broadcast(overlaps._frequencies(rows))
    posted = overlaps._posted(rows, table, least).toArrow()
    keys, owner = overlaps._meeting(posted.column("keys").combine_chunks(), posted.column("n").to_numpy(), least)
    texts, brought = posted.column("norm").to_pylist(), [set(keys[owner == i].tolist()) for i in range(len(rows.collect()))]
    met = similar = 0
    for i in range(600):
        for j in range(600, 800):
            x, y = overlaps.grams(texts[i]), overlaps.grams(texts[j])
            meets = bool(brought[i] & brought[j])
            met += meets
            if 4 * len(x & y) >= 3 * len(x | y):
                similar += 1
                assert meets
    assert similar > 100 and met < 0.5 * 600 * 200


def test_overlaps_in_rounds_move_no_candidates(spark, monkeypatch):
    """Questions of one template all meet; several rounds find the same pairs, and only pairs that are similar are written."""
    rng = random.Random(9)
    trains = [(f"t{i}", f"which component keeps {rng.choice('abcdefgh') * 4} label {rng.randint(0, 60)} for the ranker \U0001f600") for i in range(120)] + [("u", "a퟿b c")]
    evals = [(f"e{i}", q.replace("keeps", "holds") if i % 2 else q) for i, (_, q) in enumerate(trains[:50])] + [("v", "A퟿b C!")]
    e, t = (spark.createDataFrame(x, "id string, question string") for x in (evals, trains))
    want = brute_overlaps(evals, trains)
    for size in (100_000, 7):
        monkeypatch.setattr(overlaps, "ROUND", size)
        written, put = [], overlaps.Stash.put
        monkeypatch.setattr(overlaps.Stash, "put", lambda self, df: written.append(put(self, df)) or written[-1])
        found = [(r["eval_id"], r["train_id"]) for r in overlaps.split_overlaps(e, t).collect()]
        monkeypatch.setattr(overlaps.Stash, "put", put)
        assert set(found) == want and len(found) == len(want)
        assert not any({"ta", "tb"} == set(x.columns) or "key" in x.columns for x in written)
