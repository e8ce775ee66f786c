"""Rankings as rows (query_id, doc_id, rank, score): BM25, dense vectors, and the measures of rankings.

All queries are ranked in one plan; rank 1 is best and ties go by the position of the document.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from collections import Counter
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quern.functions.text import tokens
from quern.runtime import Stash, spread

K1, B, EPSILON = 1.5, 0.75, 0.25
_words = re.compile(r"\w+")
POSTINGS, BLOCK, SAMPLE = 6_000_000, 60_000, 40_000
"""A block of BM25 is closed after so many postings; partitions have about BLOCK documents; corpora larger than SAMPLE are bounded first."""
ROUND, PAIRS = 250_000, 1_000_000
"""Queries that BM25 ranks, and broadcasts, at a time; pairs of query and document that a block holds at a time."""
OFTEN = 1000
"""Terms in more than one of so many documents are common; queries with the same common terms are scored for these together."""
SLACK, TINY = 1e-8, 5e-10
"""What bounds give way, more than rounding scores to nine places moves them; positive scores below TINY round to 0."""


class Retriever(ABC):
    """Ranks the documents of an indexed corpus for all queries at once."""

    @abstractmethod
    def index(self, documents: DataFrame) -> Retriever: ...

    @abstractmethod
    def rank(self, queries: DataFrame, k: int = 5) -> DataFrame: ...


def top_k(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query from (query_id, doc_id, pos, score); partitions keep their own k best before the shuffle."""
    best = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), "pos")
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "doc_id", "rank", "score", "pos")


class BM25(Retriever):
    """Okapi BM25 over words. Negative idf values are replaced by EPSILON times the mean idf.

    documents: (id, text, pos), id and pos unique; a null text has no words. The index holds the terms' counts of each
    document, one row a document, and the idf of each term. Documents are ranked in blocks where they are read: each
    block knows the terms of all queries of a round and gives its own best, so pairs of query and document never move.
    Queries with the same common terms are one part: a block is searched for the part once, and each of its queries adds
    the few documents that have its rare terms.
    """

    def __init__(self, lowercase: bool = True, postings: int = POSTINGS, round_size: int = ROUND, sample: int = SAMPLE, often: int = OFTEN) -> None:
        self.lowercase, self.postings, self.round_size, self.sample, self.often = lowercase, postings, round_size, sample, often

    def index(self, documents: DataFrame) -> BM25:
        """Count the terms of each document in one narrow pass, and keep the counts as a table for all later plans."""
        stash = Stash(documents.sparkSession)
        kind, lower = documents.schema["id"].dataType, self.lowercase

        def count(batches):
            for batch in batches:
                lengths, terms, times, ends = [], [], [], [0]
                for text in batch.column("text").to_pylist():
                    words = _words.findall((text.lower() if lower else text) if text else "")
                    found = Counter(words)
                    lengths.append(len(words))
                    terms += found
                    times += found.values()
                    ends.append(len(terms))
                ends = pa.array(ends, pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, t)) for x, t in ((terms, pa.string()), (times, pa.int32()))]
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("pos"), pa.array(lengths, pa.int32()), *lists], ["id", "pos", "dl", "terms", "tfs"])

        schema = f"id {kind.simpleString()}, pos bigint, dl int, terms array<string>, tfs array<int>"
        self.rows = stash.put(spread(documents.select("id", F.col("pos").cast("bigint").alias("pos"), "text")).mapInArrow(count, schema), "zstd")
        self.stats = self.rows.agg(F.count("*").alias("n_docs"), (F.sum("dl") / F.count("*")).alias("avgdl"))
        size = self.stats.first()
        self.n_docs, self.avgdl, self.stash = size["n_docs"], size["avgdl"] or 1.0, stash
        df = self.rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        raw = stash.put(df.withColumn("raw", F.log(F.lit(self.n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)), "zstd")
        mean = raw.agg(F.avg("raw")).first()[0]
        self.common = EPSILON * (mean or 0.0)  # the idf of terms in more than half of the documents
        self.terms = raw.select("term", "df", F.when(F.col("raw") < 0, F.lit(self.common)).otherwise(F.col("raw")).alias("idf"))
        self.written = self.rows, raw
        return self

    def release(self) -> None:
        """Delete the index; rankings that were made stay, as they are written."""
        for frame in self.written:
            self.stash.release(frame)

    def rank(self, queries: DataFrame, k: int = 5, excluded: DataFrame | None = None) -> DataFrame:
        """The k best documents of each query. Those without a common term score 0 and stand, in their order, behind
        positive scores and before negative ones.

        Pairs (query_id, doc_id) that are ``excluded`` are passed over; the others keep their ranks among all documents.
        Scores can only be negative if the mean idf is, which takes a corpus whose words mostly stand in more than half
        of its documents. Queries are ranked ``round_size`` at a time, so what is broadcast has a fixed size; each round
        reads all documents.
        """
        pair = ["query_id", "doc_id"]
        written = asked = self.stash.put(self._parts(queries.select(F.col("id").alias("query_id"), "question")), "zstd")
        if excluded is not None:
            excluded = self.stash.put(excluded.select(*pair).distinct(), "zstd")
        rounds = max(1, -(-asked.count() // self.round_size))
        if rounds > 1:  # a part stays in one round unless its queries are too many
            large = max(1, self.round_size // 8)
            many = asked.groupBy("part").agg(F.count("*").alias("n")).where(F.col("n") > large)
            cell = F.pmod(F.xxhash64("query_id"), F.coalesce(F.ceil(F.col("n") / large), F.lit(1)))
            asked = asked.join(F.broadcast(many), "part", "left").withColumn("round", F.pmod(F.xxhash64("part", cell), F.lit(rounds))).drop("n")
        parts = []
        for n in range(rounds):
            own = asked.where(F.col("round") == n) if rounds > 1 else asked
            parts.append(self.stash.put(self._round(own, k, excluded)))
        self.stash.release(written)
        self.stash.release(excluded)
        found = reduce(DataFrame.unionByName, parts)
        best = top_k(found.where("kept").drop("kept"), k)
        if excluded is None:
            return best.drop("pos")
        best = self.stash.put(best)
        places = found.where("not kept").select("query_id", F.round("score", 9).alias("_score"), F.col("pos").alias("_pos"))
        before = (F.col("_score") > F.round("score", 9)) | ((F.col("_score") == F.round("score", 9)) & (F.col("_pos") < F.col("pos")))
        ahead = best.join(places, "query_id").where(before).groupBy(*pair).agg(F.count("*").alias("_ahead"))
        ranked = best.join(ahead, pair, "left").withColumn("rank", (F.col("rank") + F.coalesce("_ahead", F.lit(0))).cast("int"))
        return ranked.select("query_id", "doc_id", "rank", "score")

    def _parts(self, asked: DataFrame) -> DataFrame:
        """(query_id, part, common, rare) of (query_id, question): the terms of each query as (order, term, weight), and a
        digest of the common ones. All terms count as common if scores may be negative."""
        words = asked.select("query_id", F.explode(tokens(F.col("question"), self.lowercase)).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        each = F.struct((-F.col("idf")).alias("order"), "term", (F.col("qtf") * F.col("idf")).alias("weight"))  # rare terms first, in the same order in every block
        often = F.col("df") * self.often > self.n_docs if self.common > 0 else F.lit(True)
        lists = [F.sort_array(F.collect_list(F.when(x, each))).alias(y) for x, y in ((often, "common"), (~often, "rare"))]
        held = words.join(self.terms, "term").groupBy("query_id").agg(*lists)
        whole = asked.select("query_id").distinct().join(held, "query_id", "left")
        return whole.select("query_id", F.unhex(F.md5(F.coalesce(F.to_json("common"), F.lit("[]")))).alias("part"), "common", "rare")

    def _round(self, asked: DataFrame, k: int, excluded: DataFrame | None) -> DataFrame:
        """(query_id, doc_id, pos, score, kept): of each block its k best documents of each query, as far as they may be
        among the k best of all, and, not kept, the excluded ones. asked: (query_id, question), or rows of ``_parts``."""
        asked = asked if "part" in asked.columns else self._parts(asked)
        shown = asked.groupBy("part").agg(F.any_value("common").alias("common")).select("part", F.col("common.term").alias("terms"), F.col("common.weight").alias("weights")).toArrow()
        held = asked.select("query_id", "part", F.col("rare.term").alias("terms"), F.col("rare.weight").alias("weights")).toArrow()
        part = pc.index_in(held.column("part"), shown.column("part").combine_chunks()).to_numpy()
        by = np.argsort(part, kind="stable")
        held, part = held.take(pa.array(by)), part[by]
        names = held.column("query_id").combine_chunks()
        (common, weights, ends), (rare, shares, edges) = map(_flat, (shown, held))
        vocabulary = pc.unique(pa.concat_arrays([common, rare]))
        common, rare = (pc.index_in(x, vocabulary).to_numpy().astype(np.int32) for x in (common, rare))
        banned, out, apart = pa.array([], to_arrow_type(self.rows.schema["id"].dataType)), np.zeros(0, np.int64), np.zeros(len(names) + 1, np.int64)
        if excluded is not None:
            pairs = excluded.select("query_id", "doc_id").distinct().join(asked.select("query_id"), "query_id", "left_semi").toArrow()
            banned = pc.unique(pairs.column("doc_id").combine_chunks())
            whose, out = (pc.index_in(pairs.column(c), values).to_numpy().astype(np.int64) for c, values in (("query_id", names), ("doc_id", banned)))
            by = np.argsort(whose, kind="stable")
            out, apart = out[by], np.searchsorted(whose[by], np.arange(len(names) + 1))
        context = self.rows.sparkSession.sparkContext
        shared = context.broadcast((names, part, vocabulary, (common, weights, ends), (rare, shares, edges), banned, out, apart))
        asker = asked.schema["query_id"].dataType.simpleString()
        cores, least = context.defaultParallelism, np.full(len(names), -np.inf)
        if self.n_docs > self.sample:  # the k-th best of some documents bounds the k-th best of all from below
            share = max(2, min(32, self.n_docs * 2 // self.sample))
            some = self._blocks(self.rows.where(F.pmod(F.xxhash64("pos"), F.lit(share)) == 0).coalesce(cores), asker, shared, context.broadcast(least), k, False)
            some = top_k(some.where("kept"), k).where(F.col("rank") == k).select("query_id", "score").toArrow()
            least[pc.index_in(some.column("query_id"), names).to_numpy()] = some.column("score").to_numpy()
        return self._blocks(self.rows.coalesce(max(cores, -(-self.n_docs // BLOCK))), asker, shared, context.broadcast(least), k, True)

    def _blocks(self, rows: DataFrame, asker: str, shared, bounds, k: int, aside: bool) -> DataFrame:
        """``asker``: the type of the queries' ids; ``aside``: also give the excluded documents."""
        kind, most, avgdl, signed = rows.schema["id"].dataType.simpleString(), self.postings, self.avgdl, self.common <= 0

        def search(batches):
            names, part, vocabulary, common, rare, banned, out, apart = shared.value
            least, parts, size = bounds.value.copy(), [], 0

            def ranked():
                block = _Block(parts, vocabulary, banned, avgdl)
                for q, d, s, flag in block.ranked(part, common, rare, out, apart, k, least, signed, aside):
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), block.ids.take(pa.array(d)), pa.array(block.pos[d]), pa.array(s), pa.array(flag)], ["query_id", "doc_id", "pos", "score", "kept"])

            for batch in batches:
                parts.append(batch)
                size += len(batch.column("terms").flatten())
                if size >= most:
                    yield from ranked()
                    parts, size = [], 0
            if parts:
                yield from ranked()

        return rows.select("id", "pos", "dl", "terms", "tfs").mapInArrow(search, f"query_id {asker}, doc_id {kind}, pos bigint, score double, kept boolean")


def _flat(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The terms and weights of all rows, and where each row's begin."""
    terms, weights = (table.column(c).combine_chunks() for c in ("terms", "weights"))
    sizes = pc.fill_null(pc.list_value_length(terms), 0).to_numpy()
    return terms.flatten(), weights.flatten().to_numpy(), np.cumsum([0, *sizes])


def _runs(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all runs, one after the other."""
    return np.arange(sizes.sum()) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)


def _kth(values: np.ndarray, k: int) -> float:
    """The k-th largest."""
    return float(np.partition(values, len(values) - k)[len(values) - k])


class _Block:
    """Documents in the order of their positions, with their postings of the queries' terms."""

    def __init__(self, batches: list[pa.RecordBatch], vocabulary: pa.Array, banned: pa.Array, avgdl: float) -> None:
        whole = pa.Table.from_batches(batches)
        pos = whole.column("pos").to_numpy()
        order = np.argsort(pos, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        self.pos, self.ids = pos[order], whole.column("id").combine_chunks().take(pa.array(order))
        found = pc.index_in(banned, self.ids)
        self.banned = pc.fill_null(found, -1).to_numpy().astype(np.int64)
        terms, docs, base, at = [], [], [], 0
        for batch in batches:
            own = pc.fill_null(pc.index_in(batch.column("terms").flatten(), vocabulary), -1).to_numpy()
            rows = np.repeat(np.arange(len(batch), dtype=np.int32), pc.list_value_length(batch.column("terms")).to_numpy())
            use = np.flatnonzero(own >= 0)
            rows, tf = rows[use], batch.column("tfs").flatten().to_numpy()[use]
            terms.append(own[use])
            docs.append(place[at + rows])
            base.append(tf * (K1 + 1) / (tf + K1 * (1 - B + B * batch.column("dl").to_numpy()[rows] / avgdl)))
            at += len(batch)
        terms, docs, base = map(np.concatenate, (terms, docs, base))
        by = np.argsort(terms.astype(np.int64) * len(pos) + docs)
        self.docs, self.base = docs[by].astype(np.int64), base[by]
        edges = np.searchsorted(terms[by], np.arange(len(vocabulary) + 1))
        full = np.flatnonzero(np.diff(edges))
        self.most = np.zeros(len(vocabulary))
        self.most[full] = np.maximum.reduceat(self.base, edges[full]) if len(full) else 0
        self.edges, self.sums = edges, np.zeros(len(pos))

    def _postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        at = slice(self.edges[term], self.edges[term + 1])
        return self.docs[at], self.base[at]

    def scores(self, terms: np.ndarray, weights: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Of some documents."""
        sums = np.zeros(len(docs))
        for t, w in zip(terms.tolist(), weights.tolist()):
            self._add(sums, docs, t, w)
        return sums

    def _add(self, sums: np.ndarray, docs: np.ndarray, term: int, weight: float) -> None:
        own, base = self._postings(term)
        if len(own):
            at = np.minimum(np.searchsorted(own, docs), len(own) - 1)
            sums += np.where(own[at] == docs, base[at] * weight, 0.0)

    def ranked(self, part: np.ndarray, common: tuple, rare: tuple, out: np.ndarray, apart: np.ndarray, k: int, least: np.ndarray, signed: bool, aside: bool):
        """Arrays (query, document, score, kept): the k best documents of each query, and, if ``aside``, the excluded ones.

        part: of each query, in order; common and rare: terms, weights and where the parts' or queries' begin; out, apart:
        the excluded documents and where the queries' begin; least: what the k-th best of a query has at least, raised here.
        """
        gone = self.banned[out]
        kept = np.append(0, np.cumsum(gone >= 0))
        barred = np.diff(kept[apart])  # of each query, in this block
        found = np.append(0, np.cumsum(np.diff(self.edges)[rare[0]]))
        load = np.cumsum(k + barred + np.diff(found[rare[2]])) // PAIRS
        cuts = [0, *(np.flatnonzero(np.diff(load)) + 1).tolist(), len(part)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if a < b:
                mine = np.arange(a, b)
                bans = np.repeat(mine, np.diff(apart[a : b + 1])) * len(self.pos) + gone[apart[a] : apart[b]]
                bans = np.unique(bans[gone[apart[a] : apart[b]] >= 0])
                yield from self._ranked(a, b, part[a:b], common, rare, bans, barred[a:b], k, least, signed, aside)

    def _ranked(self, a: int, b: int, part: np.ndarray, common: tuple, rare: tuple, bans: np.ndarray, barred: np.ndarray, k: int, least: np.ndarray, signed: bool, aside: bool):
        """Of the queries from a to b; bans: their excluded documents, pairs are query * documents + document.

        A query's best are among the documents with rare terms of its own and as many of its part's best as it wants and
        excludes, as rare terms only add to a score.
        """
        total, at = len(self.pos), slice(rare[2][a], rare[2][b])
        terms = rare[0][at]
        sizes = self.edges[terms + 1] - self.edges[terms]
        which = _runs(self.edges[terms], sizes)
        pairs = np.repeat(np.repeat(np.arange(a, b), np.diff(rare[2][a : b + 1])), sizes) * total + self.docs[which]
        own, place = np.unique(np.concatenate((pairs, bans)), return_inverse=True)
        added = np.bincount(place[: len(pairs)], self.base[which] * np.repeat(rare[1][at], sizes), len(own))
        starts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), b - a)
        edges = np.searchsorted(own, (a + starts) * total)
        scores, tops, lists = np.zeros(len(own)), [], [0]
        lows, most = (f.reduceat(x, starts[:-1]).tolist() for f, x in ((np.minimum, least[a:b]), (np.maximum, barred)))
        for n, p in enumerate(part[starts[:-1]].tolist()):
            mine = slice(common[2][p], common[2][p + 1])
            terms, weights = common[0][mine], common[1][mine]
            tops.append(self.best(terms, weights, k + most[n], lows[n], signed))
            lists.append(lists[-1] + len(tops[-1][0]))
            if edges[n] < edges[n + 1]:
                rows = slice(edges[n], edges[n + 1])
                scores[rows] = self.scores(terms, weights, own[rows] % total)
        scores += added
        docs, values = (np.concatenate(x) for x in zip(*tops))
        lists = np.array(lists)
        sizes = np.repeat(np.diff(lists), np.diff(starts))
        sizes = np.minimum(sizes, k + barred)
        which, asker = _runs(np.repeat(lists[:-1], np.diff(starts)), sizes), np.repeat(np.arange(a, b), sizes)
        fit = values[which] >= least[asker] - SLACK
        which, asker = which[fit], asker[fit]
        pairs = asker * total + docs[which]
        new = ~np.isin(pairs, own, assume_unique=True)
        free = ~np.isin(own, bans, assume_unique=True) & (scores >= least[own // total] - SLACK)
        pairs, values = np.concatenate((pairs[new], own[free])), np.concatenate((values[which][new], scores[free]))
        query, docs = pairs // total, pairs % total
        order = np.lexsort((docs, -np.round(values, 9), query))
        query, docs, values = query[order], docs[order], values[order]
        first = np.flatnonzero(np.diff(query, prepend=-1))
        rank = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        last = rank == k - 1
        least[query[last]] = np.maximum(least[query[last]], values[last])
        best = rank < k
        yield query[best], docs[best], values[best], np.full(np.count_nonzero(best), True)
        if aside and len(bans):
            yield bans // total, bans % total, scores[np.searchsorted(own, bans)], np.full(len(bans), False)

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: float, signed: bool) -> tuple[np.ndarray, np.ndarray]:
        """The k best documents that may reach ``least``, in order, and their scores.

        Terms are added from the rarest on until the rest of them can't lift a document without them to the bound; the
        rest is then looked up for the documents that may still reach it.
        """
        sums = self.sums
        held = self.edges[terms + 1] > self.edges[terms]
        terms, weights = terms[held].tolist(), weights[held]
        rest = np.append(np.cumsum((weights * self.most[terms])[::-1])[::-1], 0.0).tolist() if terms else [0.0]
        weights = weights.tolist()
        if not signed and rest[0] < least - SLACK:
            return np.zeros(0, np.int64), np.zeros(0)
        sums[:] = 0.0
        at = 0
        while at < len(terms) and (signed or rest[at] >= least - SLACK or least <= SLACK):
            docs, base = self._postings(terms[at])
            now = sums[docs] + base * weights[at]
            sums[docs] = now
            if not signed and k <= len(now) <= 4096:
                least = max(least, _kth(now, k))
            at += 1
        if signed:
            docs = np.arange(len(sums))
        else:
            docs = np.flatnonzero(sums >= max(least - rest[at] - SLACK, TINY))
        values = sums[docs]
        for n in range(at, len(terms)):
            if len(docs) > 4 * k + 16:  # what they have so far may raise the bound
                least = max(least, _kth(values, k))
                keep = values >= least - rest[n] - SLACK
                docs, values = docs[keep], values[keep]
            own, base = self._postings(terms[n])
            if len(own) <= 8 * len(docs):
                sums[docs] = values
                sums[own] += base * weights[n]
                values = sums[docs]
            elif len(docs):
                self._add(values, docs, terms[n], weights[n])
            keep = values >= least - rest[n + 1] - SLACK
            docs, values = docs[keep], values[keep]
        short = np.round(values, 9)
        if len(docs) > k:
            keep = short >= _kth(short, k)
            docs, values, short = docs[keep], values[keep], short[keep]
        order = np.lexsort((docs, -short))[:k]
        docs, values = docs[order], values[order]
        if len(docs) < k and least <= SLACK and not signed:  # the first documents without a score
            first = np.arange(min(len(sums), k + len(docs)))
            first = first[~np.isin(first, docs)][: k - len(docs)]
            docs, values = np.concatenate((docs, first)), np.concatenate((values, np.zeros(len(first))))
        return docs, values


def _matrices(vectors: DataFrame, rows: int) -> DataFrame:
    """(ids, pos, matrix): vectors in blocks of at most so many rows; null vectors are left out."""
    kind = vectors.schema["id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                flat = np.concatenate(part.column("embedding").to_numpy(zero_copy_only=False)).astype("<f8")
                listed = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in ("id", "pos")]
                yield pa.RecordBatch.from_arrays([*listed, pa.array([flat.tobytes()], pa.binary())], ["ids", "pos", "matrix"])

    return vectors.where("embedding is not null").select("id", "pos", "embedding").mapInArrow(pack, f"ids array<{kind}>, pos array<bigint>, matrix binary")


def _vectors(frame: DataFrame) -> DataFrame:
    return frame.select("id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("pos").cast("bigint").alias("pos"))


def _best(pairs: DataFrame, kind: str, k: int, skip_self: bool) -> DataFrame:
    """(query_id, doc_id, pos, score): the k best of each block of documents for each query, from (q_ids, q_matrix, ids, pos, matrix)."""

    def best(batches):
        for batch in batches:
            rows = ([], [], [], [])
            for names, q, ids, pos, m in zip(*(batch.column(c).to_pylist() for c in ("q_ids", "q_matrix", "ids", "pos", "matrix"))):
                q, m, pos = np.frombuffer(q, "<f8").reshape(len(names), -1), np.frombuffer(m, "<f8").reshape(len(ids), -1), np.array(pos)
                scores = np.round(m @ q.T, 12)
                for n, name in enumerate(names):
                    order = np.lexsort((pos, -np.round(scores[:, n], 9)))[: k + 1]
                    for i in [i for i in order.tolist() if not (skip_self and ids[i] == name)][:k]:
                        for column, value in zip(rows, (name, ids[i], int(pos[i]), float(scores[i, n]))):
                            column.append(value)
            own = batch.schema.field("ids").type.value_type
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (own, own, pa.int64(), pa.float64()))], ["query_id", "doc_id", "pos", "score"])

    return pairs.select("q_ids", "q_matrix", "ids", "pos", "matrix").mapInArrow(best, f"query_id {kind}, doc_id {kind}, pos bigint, score double")


class Dense(Retriever):
    """Dot products of vectors: (id, embedding, pos); the exact search.

    Vectors and queries are packed into matrices of fixed size. Every matrix of vectors meets every matrix of queries in
    one scan, and only the k best of each pair of matrices are shuffled. The queries are broadcast only up to ``spread``
    bytes.
    """

    def __init__(self, block: int = 1024, spread: int = 64 << 20) -> None:
        self.block, self.spread = block, spread

    def index(self, documents: DataFrame) -> Dense:
        self.documents = _vectors(documents)
        return self

    def rank(self, queries: DataFrame, k: int = 5, skip_self: bool = False) -> DataFrame:
        asked = Stash(queries.sparkSession).put(_matrices(queries.select("id", F.lit(0).cast("bigint").alias("pos"), F.col("embedding").cast("array<double>").alias("embedding")), self.block))
        asked = asked.select(F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        size = asked.agg(F.sum(F.octet_length("q_matrix"))).first()[0] or 0
        pairs = _matrices(self.documents, self.block).crossJoin(F.broadcast(asked) if size <= self.spread else asked)
        return top_k(_best(pairs, self.documents.schema["id"].dataType.simpleString(), k, skip_self), k).drop("pos")


class Cells(Retriever):
    """Dot products of vectors through an inverted file: every vector lies in the cell of its nearest centre, and a query
    reads the cells of its ``probes`` nearest centres.

    The centres are fitted on at most ``sample`` vectors, those with the least hashes; every vector is indexed. Exact only
    within the cells read; ``recall`` compares it with Dense.
    """

    def __init__(self, cells: int = 16, probes: int = 12, sample: int = 20_000, block: int = 1024, seed: int = 42) -> None:
        self.cells, self.probes, self.sample, self.block, self.seed = cells, probes, sample, block, seed

    def index(self, documents: DataFrame) -> Cells:
        vectors = _vectors(documents).where("embedding is not null")
        chosen = vectors.orderBy(F.xxhash64("id", F.lit(self.seed)), "pos").limit(self.sample).select("embedding").toPandas()["embedding"]
        data = np.stack(chosen.to_numpy()) if len(chosen) else np.zeros((1, 1))
        rng = np.random.default_rng(self.seed)
        centres = data[rng.choice(len(data), min(self.cells, len(data)), replace=False)]
        for _ in range(10):
            near = np.argmin((centres**2).sum(1) - 2 * data @ centres.T, axis=1)
            centres = np.stack([data[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
        self.centres = documents.sparkSession.sparkContext.broadcast(centres)
        self.documents = Stash(documents.sparkSession).put(self._assigned(vectors, 1))
        return self

    def _assigned(self, vectors: DataFrame, cells: int) -> DataFrame:
        """vectors with ``cell``, once for each of the nearest cells."""
        kind, held = vectors.schema["id"].dataType.simpleString(), self.centres

        def assign(batches):
            centres = held.value
            for batch in batches:
                data = np.stack(batch.column("embedding").to_numpy(zero_copy_only=False)) if len(batch) else np.zeros((0, centres.shape[1]))
                # vectors go by distance, queries by the same, as both are compared with the same centres
                near = np.argsort((centres**2).sum(1) - 2 * data @ centres.T, axis=1, kind="stable")[:, :cells]
                rows = np.repeat(np.arange(len(batch)), near.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(rows)) for c in ("id", "embedding", "pos")), pa.array(near.ravel().astype(np.int32))], ["id", "embedding", "pos", "cell"])

        return vectors.select("id", "embedding", "pos").mapInArrow(assign, f"id {kind}, embedding array<double>, pos bigint, cell int")

    def rank(self, queries: DataFrame, k: int = 5, skip_self: bool = False) -> DataFrame:
        kind = self.documents.schema["id"].dataType.simpleString()
        asked = self._assigned(_vectors(queries.withColumn("pos", F.lit(0))).where("embedding is not null"), self.probes)

        # a large cell is many blocks; sorting within the partitions there are keeps blocks whole without gathering a cell
        left = _cell_matrices(asked.sortWithinPartitions("cell"), self.block).select("cell", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_matrix"))
        pairs = _cell_matrices(self.documents.sortWithinPartitions("cell"), self.block).join(left, "cell")
        return top_k(_best(pairs, kind, k, skip_self), k).drop("pos")


def _cell_matrices(rows: DataFrame, size: int) -> DataFrame:
    """(cell, ids, pos, matrix) of rows sorted by cell, in blocks of at most ``size``."""
    kind = rows.schema["id"].dataType.simpleString()

    def pack(batches):
        for batch in batches:
            cell = batch.column("cell").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(cell)) + 1).tolist(), len(cell)]
            for a, b in zip(edges[:-1], edges[1:]):
                for at in range(a, b, size):
                    part = batch.slice(at, min(size, b - at))
                    flat = np.concatenate(part.column("embedding").to_numpy(zero_copy_only=False)).astype("<f8")
                    listed = [pa.array([part.column(c).to_pylist()], pa.list_(part.schema.field(c).type)) for c in ("id", "pos")]
                    yield pa.RecordBatch.from_arrays([pa.array([int(cell[at])], pa.int32()), *listed, pa.array([flat.tobytes()], pa.binary())], ["cell", "ids", "pos", "matrix"])

    return rows.select("id", "embedding", "pos", "cell").mapInArrow(pack, f"cell int, ids array<{kind}>, pos array<bigint>, matrix binary")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row (n_exact, n_found, recall): which part of the exact rankings' documents another search found."""
    both = exact.select("query_id", "doc_id").join(found.select("query_id", "doc_id", F.lit(1).alias("hit")), ["query_id", "doc_id"], "left")
    return both.agg(F.count("*").alias("n_exact"), F.count("hit").alias("n_found"), (F.count("hit") / F.count("*")).alias("recall"))


def retriever(config: dict) -> Retriever:
    """The retriever that a configuration names. Hybrid ranking is configured by some but not part of this engine."""
    kind = config.get("kind")
    if kind == "bm25":
        return BM25(config.get("lowercase", True))
    if kind == "dense":
        if config.get("model_id") and not config.get("revision"):
            raise ValueError("another embedding model needs its revision")
        return Dense()
    if kind == "cells":
        return Cells(config.get("cells", 16), config.get("probes", 12))
    if kind == "hybrid":
        raise NotImplementedError("hybrid retrieval isn't implemented; use bm25 or dense")
    raise ValueError(f"unknown retriever kind: {kind}")


def discount(rank: Column) -> Column:
    return 1 / F.log2(rank + 1)


def query_measures(rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, hit, rr, ndcg) of each query with relevant documents, from its k first ranks.

    relevant: (query_id, doc_id), repeated rows count once. A query that isn't ranked scores 0.
    """
    wanted = relevant.distinct()
    hits = wanted.join(rankings.select("query_id", "doc_id", "rank"), ["query_id", "doc_id"]).select("query_id", "rank")
    return hit_measures(hits, wanted.groupBy("query_id").agg(F.count("*").alias("n")), k)


def hit_measures(hits: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """query_measures from (query_id, rank) of the relevant documents that are ranked, and (query_id, n), how many there are."""
    found = sizes.where("n > 0").join(hits.where(F.col("rank") <= k).select("query_id", "rank"), "query_id", "left")
    one = found.groupBy("query_id", "n").agg(F.count("rank").alias("hits"), F.min("rank").alias("first"), F.sum(discount(F.col("rank"))).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.least("n", F.lit(k).cast("bigint"))), F.lit(0.0), lambda s, i: s + discount(i))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return one.select("query_id", (F.col("hits") / F.col("n")).alias("recall"), (F.col("hits") > 0).cast("double").alias("hit"), zero(1 / F.col("first")).alias("rr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def retrieval_measures(rankings: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row (recall_at_k, hit_rate_at_k, mrr, ndcg_at_k, evaluated): means over the queries; zeros if there are none."""
    return mean_measures(query_measures(rankings, relevant, k))


def mean_measures(per_query: DataFrame) -> DataFrame:
    mean = lambda c, n: F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6).alias(n)
    return per_query.agg(mean("recall", "recall_at_k"), mean("hit", "hit_rate_at_k"), mean("rr", "mrr"), mean("ndcg", "ndcg_at_k"), F.count("*").alias("evaluated"))


def unranked_documents(rankings: DataFrame, documents: DataFrame) -> DataFrame:
    """Rankings of documents that aren't in the corpus."""
    return rankings.join(documents.select(F.col("id").alias("doc_id")), "doc_id", "left_anti")
