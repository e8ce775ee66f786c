"""Near-duplicate texts: an exact set-similarity self-join that skips by set relations.

Equal sets are one class, whose members take over the answers of its representative. Representatives are joined
through the rarest elements of their sets. Inverted lists are cut into blocks of one set size, sorted by position;
blocks whose size doesn't fit end a walk, and within a block only the positions that still leave room are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shingles import Shingler
from quern.llm.tables import bits_for, bloom, passes, slices, summed
from quern.operators.components import connected_components
from quern.runtime import Stash, join_unique

HOT_LIST = 4000
"""An inverted list longer than about this is cut into parts, and each pair of parts is joined on its own."""
SHARD = 4_000_000
"""Postings of a shard, which a task holds at a time, on average."""
FLUSH, MEET = 2_000_000, 2_000_000
PAIRS_A_TASK = 5000


def _scan(docs: DataFrame, width: int, bits: int) -> DataFrame:
    """(doc_id, digest, n) of each text's set and, per partition, (slice, data): how often each slot of the table is hit."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, hits = Shingler(width), np.zeros(1 << bits, np.uint32)
        names, shift, one = ["doc_id", "digest", "n", "slice", "data"], np.uint64(64 - bits), np.uint32(1)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            digests, sizes = [], []
            for first, hashes, bounds in shingler.chunks(texts):
                np.add.at(hits, (hashes >> shift).astype(np.int64), one)
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    digests.append(xxhash.xxh3_128_digest(hashes[a:b] if b > a else "\0" + texts[first + k]))
                    sizes.append(b - a)
            size = len(digests)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.nulls(size, pa.int32()), pa.nulls(size, pa.binary())], names)
        table = slices(hits)
        size = table.num_rows
        yield pa.RecordBatch.from_arrays([pa.nulls(size, pa.int64()), pa.nulls(size, pa.binary()), pa.nulls(size, pa.int32()), table.column("slice"), table.column("data")], names)

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    return texts.mapInArrow(scan, "doc_id bigint, digest binary, n int, slice int, data binary")


def levels(hits: np.ndarray) -> np.ndarray:
    """The rarity of the elements in each slot: 0 for one occurrence at most, else 1 + 8 * log2 of the count, as a byte.

    What a slot typically holds of other elements is taken off its count; so once the table is full, slots stand out
    only by their own frequent elements, and the rest count as rare.
    """
    own = np.maximum(hits.astype(np.float64) - np.median(hits), 1)
    return np.where(hits > 1, 1 + np.minimum(np.rint(8 * np.log2(own)), 254), 0).astype(np.uint8)


def frequency(level: int) -> float:
    return 2 ** ((level - 1) / 8)


def _sets(batch: pa.RecordBatch, shingler: Shingler, of=lambda h: h) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(doc_id, set, what ``of`` gives for its elements) of every text of a batch."""
    ids = batch.column("doc_id").to_pylist()
    for first, hashes, bounds in shingler.chunks(batch.column("text").to_pylist()):
        values = of(hashes)
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            yield ids[first + k], hashes[a:b], values[a:b]


#: The columns of postings: key (40 bits of the element), document, size of its set, position in it, and side: which of the two
#: parts of a cut list that meet under this key it belongs to (1 or 2), or 0 if all meet all.
COLUMNS = (np.uint64, np.int64, np.int32, np.int32, np.int8)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Postings of one shard, sorted by key, as compressed planes of bytes."""
    key, *rest = (c.astype(t) for c, t in zip(columns, COLUMNS))
    planes = [np.diff(key, prepend=np.uint64(0)), *rest]
    return zstandard.ZstdCompressor(1).compress(b"".join(c.view(np.uint8).reshape(-1, c.itemsize).T.tobytes() for c in planes))


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    raw, at, out = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, n * 25), np.uint8), 0, []
    for kind in COLUMNS:
        size = np.dtype(kind).itemsize
        out.append(np.ascontiguousarray(raw[at : at + n * size].reshape(size, n).T).view(kind).ravel())
        at += n * size
    return [np.cumsum(out[0], dtype=np.uint64), *out[1:]]


def _parts(key: int, doc_id: int, count: float) -> Iterator[tuple[int, int]]:
    """(key, side) for every pair of parts of a long list in which this document's part takes part."""
    parts = math.ceil(count / HOT_LIST) + 1
    own = xxhash.xxh3_64_intdigest(doc_id.to_bytes(8, "little", signed=True)) % parts
    for other in range(parts):
        low, high = min(own, other), max(own, other)
        yield xxhash.xxh3_64_intdigest(f"{key} {low} {high}") >> 24, 0 if low == high else 1 if own == low else 2


def _postings(texts: DataFrame, width: int, bits: int, table, least: Fraction, shards: int) -> DataFrame:
    """(shard, n, data): postings of the first elements of each set, rarest first, that can decide on the similarity.

    Elements known to occur once are counted in the position but not written, as nothing can meet them.
    """
    num, den = least.numerator, least.denominator

    def blobs(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        shard = (columns[0] % np.uint64(shards)).astype(np.int64)
        order = np.lexsort((columns[0], shard))
        columns, ends = [c[order] for c in columns], np.cumsum(np.bincount(shard, minlength=shards))
        rows = [(k, b - a, _packed([c[a:b] for c in columns])) for k, (a, b) in enumerate(zip([0, *ends[:-1].tolist()], ends.tolist())) if b > a]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary()))], ["shard", "n", "data"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, known, shift, hot = Shingler(width), table.value, np.uint64(64 - bits), 1 + 8 * math.log2(HOT_LIST)
        held, size = [], 0
        for batch in batches:
            for doc_id, s, level in _sets(batch, shingler, lambda h: known[(h >> shift).astype(np.int64)]):
                n = len(s)
                if not n:
                    continue
                first = n - (-(-n * num // den)) + 1
                order = np.argsort(level, kind="stable")[:first]  # ties by hash, as s is sorted
                pos = np.flatnonzero(level[order])
                order = order[pos]
                key, lists = s[order] >> np.uint64(24), level[order]
                side = np.zeros(len(key), np.int8)
                if len(key) and lists[-1] >= hot:  # sorted by level
                    cut = int(np.searchsorted(lists, hot))
                    more = [(k, p, x) for e, p, x0 in zip(key[cut:].tolist(), pos[cut:].tolist(), lists[cut:].tolist()) for k, x in _parts(e, doc_id, frequency(x0))]
                    key = np.concatenate((key[:cut], np.array([k for k, _, _ in more], np.uint64)))
                    side = np.concatenate((side[:cut], np.array([x for *_, x in more], np.int8)))
                    pos = np.concatenate((pos[:cut], np.array([p for _, p, _ in more], pos.dtype)))
                held.append([key, np.full(len(key), doc_id, np.int64), np.full(len(key), n), pos, side])
                size += len(key)
                if size >= FLUSH:
                    yield blobs(held)
                    held, size = [], 0
        if size:
            yield blobs(held)

    return texts.mapInArrow(post, "shard int, n int, data binary")


def _meet(key: np.ndarray, doc: np.ndarray, n: np.ndarray, pos: np.ndarray, side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of documents (smaller id, larger id) that meet in a list where sizes and positions still allow the similarity.

    A list's entries of one set size are a block, sorted by position. An entry walks its own block and those of larger
    sets; it reads a block only up to the last position at which enough elements remain, and none of it if it has too
    few elements left itself.
    """
    order = np.lexsort((pos, n, key))
    key, doc, side = key[order], doc[order], side[order]
    n, pos = n[order].astype(np.int64), pos[order].astype(np.int64)
    start = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (n[1:] != n[:-1]))))
    block = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    last = np.searchsorted(key[start], key[start], "right")  # behind the last block of the list
    size, wide = n[start], np.int64(1 << 32)
    place = block * wide + pos
    at = np.flatnonzero(pos < n - (-(-2 * num * n // (num + den))) + 1)  # may be the smaller set
    visited = block[at]
    while len(at):
        m = size[visited]
        fits = n[at] * den >= m * num  # blocks are sorted by size: what is too large here only grows
        at, visited, m = at[fits], visited[fits], m[fits]
        need = -(-num * (n[at] + m) // (num + den))
        low = np.where(visited == block[at], at + 1, start[visited])
        high = np.searchsorted(place, visited * wide + (m - need), "right")
        count = np.where(n[at] - pos[at] >= need, np.maximum(high - low, 0), 0)
        ends = np.cumsum(count)
        a = 0
        while a < len(count):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + MEET, "right")))
            some, total = count[a:b], int(ends[b - 1] - (ends[a - 1] if a else 0))
            if total:
                one = np.repeat(at[a:b], some)
                two = np.repeat(low[a:b] - (np.cumsum(some) - some), some) + np.arange(total)
                good = (doc[one] != doc[two]) & ((side[one] == 0) | (side[one] != side[two]))
                x, y = doc[one[good]], doc[two[good]]
                pairs = np.unique(np.stack((np.minimum(x, y), np.maximum(x, y)), 1), axis=0)
                yield pairs[:, 0], pairs[:, 1]
            a = b
        visited = visited + 1
        more = visited < last[block[at]]
        at, visited = at[more], visited[more]


def _candidates(postings: DataFrame, least: Fraction) -> DataFrame:
    """Distinct pairs (a, b) of documents that share one of their first elements where sizes and positions allow it."""
    num, den = least.numerator, least.denominator

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in _meet(*(np.concatenate(c) for c in zip(*held)), num, den):
                for at in range(0, len(a), 100_000):
                    yield pa.RecordBatch.from_arrays([pa.array(a[at : at + 100_000]), pa.array(b[at : at + 100_000])], ["a", "b"])

        at, held = None, []
        for batch in batches:
            for shard, n, data in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "data"))):
                if shard != at and held:
                    yield from pairs(held)
                    held = []
                at = shard
                held.append(_unpacked(data, n))
        if held:
            yield from pairs(held)

    return postings.repartition("shard").sortWithinPartitions("shard").mapInArrow(join, "a bigint, b bigint").distinct()


def _verify(pairs: DataFrame, docs: DataFrame, width: int, least: Fraction, stash: Stash) -> DataFrame:
    """The pairs (a, b, similarity) whose sets really are that similar.

    Only texts that a Bloom filter of the pairs' documents lets pass are read as sets. The left set of a document's pairs
    travels once for each PAIRS_A_TASK of them, and its partners' sets stream past it.
    """
    num, den = least.numerator, least.denominator
    ids = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(bloom(ids, ids.count()))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(width)
        for batch in batches:
            some = batch.filter(pa.array(passes(wanted.value, batch.column("doc_id").to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array([s.tobytes() for _, s, _ in _sets(some, shingler)], pa.binary())], ["doc_id", "elements"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, x = None, np.empty(0, np.uint64)
        for batch in batches:
            a, b, similarity = [], [], []
            for i, j, data in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "elements"))):
                y = np.frombuffer(data, np.uint64)
                if j is None:
                    left, x = i, y
                    continue
                assert i == left
                both = np.concatenate((x, y))
                both.sort()
                common = int((both[1:] == both[:-1]).sum())
                union = len(both) - common
                if common * den >= num * union:
                    a.append(i)
                    b.append(j)
                    similarity.append(common / union)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(similarity, pa.float64())], ["a", "b", "similarity"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    elements = stash.put(texts.mapInArrow(sets, "doc_id bigint, elements binary"))
    tasks = pairs.groupBy("a").agg(F.ceil(F.count("*") / PAIRS_A_TASK).alias("tasks"))
    pairs = pairs.join(tasks, "a").select("a", "b", F.pmod(F.xxhash64("b"), "tasks").alias("task"))
    first = pairs.select("a", "task").distinct().join(elements.withColumnRenamed("doc_id", "a"), "a")
    others = pairs.join(elements.withColumnRenamed("doc_id", "b"), "b").select("a", "task", "b", "elements")
    rows = first.select("a", "task", F.lit(None).cast("bigint").alias("b"), "elements").unionByName(others)
    rows = rows.repartition("a", "task").sortWithinPartitions("a", "task", F.asc_nulls_first("b"))
    return rows.select("a", "b", "elements").mapInArrow(compare, "a bigint, b bigint, similarity double")


def similar_classes(docs: DataFrame, threshold: float = 0.8, width: int = 5) -> tuple[DataFrame, DataFrame]:
    """Members (doc_id, rep) and links (a, b, similarity) between representatives, a < b.

    A text is the set of its sequences of ``width`` words; two are linked if the elements in both are at least
    ``threshold`` of those in either. Texts with equal sets form a class, represented by its least doc_id; the links of
    a representative are its members' as well, and members of a class are similar by 1. Equal texts of fewer words form
    classes too, but have no other links. Null texts and null doc_ids have no rows; doc_id is unique; extra columns are
    ignored; an empty table gives none. Exact: every link between different texts comes out, whatever the list lengths.
    """
    least = Fraction(str(threshold))
    if not 0 < least <= 1:
        raise ValueError("the threshold must be above 0 and at most 1")
    spark = docs.sparkSession
    stash = Stash(spark)
    chars = docs.agg(F.sum(F.char_length("text"))).first()[0] or 0
    bits = bits_for(chars // 6, most=24)
    scanned = stash.put(_scan(docs, width, bits))
    sets = scanned.where("doc_id is not null").select("doc_id", "digest")
    classes = stash.put(sets.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")))
    total = classes.agg(F.sum("n_rows")).first()[0] or 0
    members = stash.put(join_unique(sets, classes, "digest", total).select("doc_id", "rep"))
    copies = stash.put(members.where("doc_id <> rep").select("doc_id"))
    elements = scanned.agg(F.sum("n")).first()[0] or 0
    table = spark.sparkContext.broadcast(levels(summed(scanned, 1 << bits)))
    stash.release(scanned)
    stash.release(classes)
    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), "text")
    texts = texts.join(copies, "doc_id", "left_anti")
    shards = max(4 * spark.sparkContext.defaultParallelism, math.ceil(float(1 - least) * elements / SHARD))
    pairs = stash.put(_candidates(_postings(texts, width, bits, table, least, shards), least))
    links = stash.put(_verify(pairs, docs, width, least, stash))
    stash.release(pairs)
    stash.release(copies)
    return members, links


def similar_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """All pairs (doc_id_a, doc_id_b), a < b, of different documents, copies included."""
    between = links.select(F.col("a").alias("rep"), F.col("b").alias("other")).unionByName(members.select("rep", F.col("rep").alias("other")).distinct())
    left = members.select("rep", F.col("doc_id").alias("x"))
    right = members.select(F.col("rep").alias("other"), F.col("doc_id").alias("y"))
    pairs = between.join(left, "rep").join(right, "other").where("rep <> other or x < y")
    return pairs.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))


def similar_groups(members: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (doc_id, rep, group_id, n_links): links of its representative, and the least doc_id that links lead to."""
    stash = Stash(members.sparkSession)
    parts = stash.put(connected_components(links, "a", "b"))
    ends = links.select(F.explode(F.array("a", "b")).alias("rep")).groupBy("rep").agg(F.count("*").alias("n_links"))
    info = members.groupBy("rep").agg(F.count("*").alias("n_rows")).join(ends, "rep", "left").join(parts.withColumnRenamed("node", "rep"), "rep", "left")
    info = stash.put(info.select("rep", F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_rows"))
    total = info.agg(F.sum("n_rows")).first()[0] or 0
    return join_unique(members, info, "rep", total).select("doc_id", "rep", "group_id", "n_links")
