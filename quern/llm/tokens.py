"""Token counts of documents, and token budgets per slice."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.llm.tables import bloom, passes
from quern.runtime import Stash, join_unique

#: The tokenizer's blanks, which give no token. Fixed values.
BLANKS = " \t\r\n "
MAX_PIECES = 2_000_000
CACHE = 400_000

_runs = re.compile(r"[^\W\d_]+")
_letters = regex.compile(r"\p{L}+")


class PieceCounter:
    """Counts tokens by the longest listed piece, remembering the words met so far (a bounded memory, for speed only)."""

    def __init__(self, pieces: Iterable[str]) -> None:
        self.pieces = frozenset(pieces)
        self.longest = max(map(len, self.pieces), default=1)
        self.known: dict[str, int] = {}

    def word(self, word: str) -> int:
        """Tokens of a run of letters."""
        n = at = 0
        while at < len(word):
            for end in range(min(len(word), at + self.longest), at + 1, -1):
                if word[at:end] in self.pieces:
                    at = end
                    break
            else:
                at += 1
            n += 1
        return n

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        low = text.lower()
        words = _runs.findall(low)
        joined = "".join(words)
        if joined and not joined.isalpha():  # numerals that count as word characters
            words = _letters.findall(low)
            joined = "".join(words)
        known, n = self.known, len(low) - len(joined) - sum(map(low.count, BLANKS))
        for word in words:
            try:
                n += known[word]
            except KeyError:
                if len(known) >= CACHE:
                    known.clear()
                known[word] = m = self.word(word)
                n += m
        return n


def vocabulary(vocab: DataFrame) -> list[str]:
    """The distinct pieces, gathered on the driver; more than MAX_PIECES are refused, as a vocabulary doesn't grow."""
    rows = vocab.select("piece").where("piece is not null and piece <> ''").distinct().limit(MAX_PIECES + 1).collect()
    if len(rows) > MAX_PIECES:
        raise ValueError(f"more than {MAX_PIECES} pieces")
    return [row[0] for row in rows]


def piece_tokenizer(vocab: DataFrame) -> Callable[[], Callable[[str | None], int]]:
    """A factory of counters under the vocabulary, to be made once in each Python worker."""
    pieces = vocabulary(vocab)
    return lambda: PieceCounter(pieces)


def bpe_tokenizer(spark: SparkSession, ranks_file: str, pattern: str) -> Callable[[], Callable[[str | None], int]]:
    """A factory of counters under a public byte-level BPE, given by its file of ranks and its splitting pattern.

    The driver reads the file, whose size is that of a vocabulary, and broadcasts it; executors need no copy.
    """
    with open(ranks_file, "rb") as f:
        held = spark.sparkContext.broadcast(f.read())

    def make() -> Callable[[str | None], int]:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, held.value.splitlines())}
        encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return lambda text: len(encoding.encode_ordinary(text)) if text else 0

    return make


def with_token_counts(docs: DataFrame, make: Callable[[], Callable[[str | None], int]], text: str = "text", out: str = "n_tokens") -> DataFrame:
    """docs with the text replaced by its number of tokens; null and empty texts have none."""
    kept = [c for c in docs.columns if c != text]
    fields = [docs.schema[c] for c in kept]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            n = pa.array([counter(x) for x in batch.column(text).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), n], [*kept, out])

    return docs.select(*kept, text).mapInArrow(count, T.StructType([*fields, T.StructField(out, T.LongType())]))


def label(column: str, empty: str = "(none)") -> F.Column:
    """A label however it was spelt: lower case, runs of blanks, hyphens, underscores, dots and slashes as one hyphen."""
    text = F.regexp_replace(F.lower(F.col(column)), r"[\s ​_./\\-]+", "-")
    text = F.trim(text, F.lit("-"))
    return F.when(text.isNull() | (text == ""), empty).otherwise(text)


def sliced(docs: DataFrame) -> DataFrame:
    """docs as (doc_id, digest, source, lang, topic, text); the source is metadata.source, else source."""
    wide = docs.select("doc_id", "text", F.col("source").alias("own_source"), F.col("lang").alias("own_lang"), F.col("metadata.source").alias("meta_source"), F.col("metadata.topic").alias("meta_topic"))
    source = F.when(label("meta_source") == "(none)", label("own_source")).otherwise(label("meta_source"))
    digest = F.sha2(F.coalesce("text", F.lit("")), 256)
    return wide.select("doc_id", F.unhex(digest).alias("digest"), source.alias("source"), label("own_lang").alias("lang"), label("meta_topic").alias("topic"), F.coalesce("text", F.lit("")).alias("text"))


def _distinct_counts(rows: DataFrame, copies: DataFrame, make: Callable[[], Callable[[str | None], int]], stash: Stash) -> DataFrame:
    """(digest, n_tokens): each distinct text tokenized once.

    A text is tokenized where it is read unless a Bloom filter says that its digest may be repeated; only such texts
    move, one for each digest and partition, so a text that fills a third of the table moves hardly at all.
    """
    repeated = copies.where("n_rows > 1").select(F.conv(F.hex(F.substring("digest", 1, 7)), 16, 10).cast("bigint").alias("key"))
    maybe = rows.sparkSession.sparkContext.broadcast(bloom(repeated, repeated.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = make()
        for batch in batches:
            digests = batch.column("digest").to_pylist()
            keys = np.array([int.from_bytes(d[:7], "big") for d in digests], np.int64)
            moves = passes(maybe.value, keys).tolist()
            texts = batch.column("text").to_pylist()
            n = [None if m else counter(t) for m, t in zip(moves, texts)]
            held = [t if m else None for m, t in zip(moves, texts)]
            yield pa.RecordBatch.from_arrays([batch.column("digest"), pa.array(n, pa.int64()), pa.array(held, pa.string())], ["digest", "n_tokens", "text"])

    met = stash.put(rows.select("digest", "text").mapInArrow(count, "digest binary, n_tokens bigint, text string"))
    moved = met.where("text is not null").groupBy("digest").agg(F.any_value("text").alias("text"))
    return met.where("text is null").select("digest", "n_tokens").unionByName(with_token_counts(moved, make))


def document_tokens(docs: DataFrame, make: Callable[[], Callable[[str | None], int]]) -> DataFrame:
    """Rows (doc_id, source, lang, topic, n_tokens), one for each document.

    Equal texts are found by their SHA-256, tokenized once, and the count joined back to all copies. Documents need a
    unique doc_id; one without a text has no tokens. Extra columns are ignored; an empty table gives no rows.
    """
    stash = Stash(docs.sparkSession)
    rows = sliced(docs)
    labels = stash.put(rows.drop("text"))
    copies = stash.put(labels.groupBy("digest").agg(F.count("*").alias("n_rows")))
    counts = stash.put(_distinct_counts(rows, copies, make, stash).join(copies, "digest"))
    total = counts.agg(F.sum("n_rows")).first()[0] or 0
    return join_unique(labels, counts, "digest", total).select("doc_id", "source", "lang", "topic", "n_tokens")


def slice_tokens(docs: DataFrame, make: Callable[[], Callable[[str | None], int]]) -> DataFrame:
    """Rows (source, lang, topic, n_docs, n_texts, n_tokens, n_distinct_tokens), one for each slice however it was spelt.

    n_texts and n_distinct_tokens count equal texts of a slice once. Multiplicities are taken before the join, so a
    text that fills a third of the table is one row per slice. Edge cases as in document_tokens.
    """
    stash = Stash(docs.sparkSession)
    rows = sliced(docs)
    parts = stash.put(rows.groupBy("digest", "source", "lang", "topic").agg(F.count("*").alias("copies")))
    copies = parts.groupBy("digest").agg(F.sum("copies").alias("n_rows"))
    joined = parts.join(_distinct_counts(rows, copies, make, stash), "digest")
    return joined.groupBy("source", "lang", "topic").agg(
        F.sum("copies").alias("n_docs"),
        F.count("*").alias("n_texts"),
        F.sum(F.col("copies") * F.col("n_tokens")).alias("n_tokens"),
        F.sum("n_tokens").alias("n_distinct_tokens"),
    )


def sliced_sizes(docs: DataFrame, make: Callable[[], Callable[[str | None], int]]) -> DataFrame:
    """Rows (doc_id, source, n_tokens), the source in its normal form; a narrow plan, which tokenizes every document."""
    return with_token_counts(sliced(docs).select("doc_id", "source", "text"), make)
