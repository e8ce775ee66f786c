"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The hierarchy of separators, from coarse to fine; a text is cut behind a match. Section: before a heading or rule.
SEPARATORS = (
    ("section", re.compile(r"(?:\r?\n)(?=#{1,6}[ \t]|={3,}|-{3,}[ \t]*\r?\n)|(?:\r?\n[ \t]*){3,}")),
    ("paragraph", re.compile(r"\r?\n(?:[ \t]*\r?\n)+")),
    ("line", re.compile(r"\r?\n")),
    ("sentence", re.compile(r"[.!?…][\"'”’»)\]]*[ \t\r\n]+")),
    ("word", re.compile(r"[ \t\r\n]+")),
)
#: The separators of which the coarsest that suffices alone is a document's boundary.
BOUNDARIES = tuple(s for s in SEPARATORS if s[0] in ("paragraph", "line", "word"))
ROWS = "doc_id bigint, boundary string, piece int, start int, n_chars int, cut string, text string"


def boundary(text: str, limit: int) -> str:
    """The coarsest of paragraph, line and word at which cutting alone gives stretches of at most limit, else none."""
    for name, pattern in BOUNDARIES:
        at = 0
        for m in pattern.finditer(text):
            if m.start() - at > limit:
                break
            at = m.end()
        else:
            if len(text) - at <= limit:
                return name
    return "none"


def _units(text: str, start: int, end: int, limit: int, level: int = 0) -> Iterator[tuple[int, str]]:
    """The ends of consecutive units of at most limit characters, with the separator that each is cut at."""
    if end - start <= limit:
        yield end, SEPARATORS[level - 1][0] if level else "section"
        return
    if level == len(SEPARATORS):
        for at in range(start + limit, end, limit):
            yield at, "character"
        yield end, "character"
        return
    at = start
    for m in SEPARATORS[level][1].finditer(text, start, end):
        if at < m.end() < end:
            yield from _under(text, at, m.end(), limit, level)
            at = m.end()
    yield from _under(text, at, end, limit, level)


def _under(text: str, start: int, end: int, limit: int, level: int) -> Iterator[tuple[int, str]]:
    """One unit, cut at the separator of level, or the finer units that it is made of."""
    if end - start <= limit:
        yield end, SEPARATORS[level][0]
    else:
        yield from _units(text, start, end, limit, level + 1)


def cut(text: str, limit: int = 4000, overlap: int = 200) -> list[tuple[int, int, str]]:
    """(start, end, cut) of each piece: units packed greedily, each piece from overlap characters before the last end."""
    out: list[tuple[int, int, str]] = []
    start = end = 0
    how = "end"
    for stop, name in _units(text, 0, len(text), limit - overlap):
        if stop - start > limit:
            out.append((start, end, how))
            start = end - overlap
        end, how = stop, name
    return [*out, (start, end, "end")]


def split_documents(docs: DataFrame, limit: int = 4000, overlap: int = 200) -> DataFrame:
    """Rows (doc_id, boundary, piece, start, n_chars, cut, text): the pieces of every text of more than limit characters.

    A text is split by section, paragraph, line, sentence, word and character, as far down as its stretches need, and
    the parts are packed greedily into pieces of at most ``limit`` characters (code points); each piece repeats the
    last ``overlap`` characters of the one before. ``cut`` names the separator at the end of a piece, ``boundary`` the
    coarsest one that would do for the whole text. Texts that fit, null and empty ones have no rows. A narrow operator:
    no shuffle, and only oversized texts reach Python. Without its overlaps, a text's pieces give it back.
    """
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be at least 0 and less than the limit")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                edge = boundary(text, limit)
                rows += [(doc_id, edge, k, a, b - a, how, text[a:b]) for k, (a, b, how) in enumerate(cut(text, limit, overlap))]
            types = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string())
            names = ("doc_id", "boundary", "piece", "start", "n_chars", "cut", "text")
            columns = list(zip(*rows)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return docs.select(F.col("doc_id").cast("bigint"), "text").where(F.char_length("text") > limit).mapInArrow(pieces, ROWS)


def boundaries(pieces: DataFrame) -> DataFrame:
    """Rows (doc_id, boundary), one for each document that was split."""
    return pieces.where("piece = 0").select("doc_id", "boundary")
