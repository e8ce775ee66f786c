"""Texts that were decoded with a wrong character set: finding and restoring them."""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.tables import ROWS, slices, summed

BITS = 21
"""Counts of character pairs are kept in two tables of 2**BITS slots each, whatever the corpus; the lesser count holds."""
CACHE = 400_000

#: Character sets that texts are wrongly read in, and those that they may really have been in besides UTF-8. Fixed values.
READ_AS = ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "koi8_r")
REALLY = ("cp1252", "mac_roman", "cp850", "cp1251", "koi8_r")
#: Sets of more than one byte that UTF-8 is wrongly read in.
READ_WIDE = ("gbk", "shift_jis", "big5")
CHARS = 0x110000

_QUOTED = re.compile("[“”„\"«»‘’‹›'][^\\s“”„\"«»‘’‹›']{1,8}[“”„\"«»‘’‹›']")
_CLUSTER = re.compile(r"[^\x00-\x7f]+")
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
LOST = "�"
SURPRISE = -2.0
"""A pair whose mutual information is below this raises the score of a run, others lower it."""
SMOOTH = 10.0
"""Every character counts as if it stood SMOOTH times the root of the corpus' length more often. So two characters that
are rare by themselves are expected to meet SMOOTH squared times, and their mutual information is low if they never did;
without it, characters that occur in garbled text only would have the highest of all."""
GAIN_UTF8, GAIN_CLUSTER, GAIN_TEXT = 0.5, 4.0, 7.0
"""Least gain in log probability: a pair on average, for UTF-8; a cluster and all of a text's clusters, for other sets."""


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte; bytes that the set leaves open stand for the control characters of the same number."""
    out = {}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return {chr(b): b for b in range(128, 160) if chr(b) not in out} | out if codec == "cp1252" else out


_MAPS = {codec: _bytes_of(codec) for codec in READ_AS}
_CHARS = {codec: {b: c for c, b in _bytes_of(codec).items()} for codec in REALLY}


def _slots(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of pairs in the first table, and in the second, which follows it."""
    h = (pairs ^ (pairs >> np.uint64(21))) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    one, two = h >> np.uint64(64 - BITS), (h & np.uint64((1 << BITS) - 1)) + np.uint64(1 << BITS)
    return one.astype(np.int64), two.astype(np.int64)


def _codes(texts: list[str | None]) -> np.ndarray:
    """Code points of the texts, each followed by a line feed."""
    return np.frombuffer("\n".join([*(t or "" for t in texts), ""]).encode("utf-32-le", "surrogatepass"), np.uint32)


def _wide_pairs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the adjacent pairs with a character outside ASCII, and the pairs as numbers."""
    at = np.flatnonzero((codes[:-1] > 127) | (codes[1:] > 127))
    return at, (codes[at].astype(np.uint64) << np.uint64(21)) | codes[at + 1].astype(np.uint64)


def _kinds(codec: str) -> np.ndarray:
    """For each code point up to 0xFFFF, how many bytes the UTF-8 sequence has that its byte begins; 1 for the bytes within one."""
    out = np.zeros(1 << 16, np.uint8)
    for char, b in _MAPS[codec].items():
        out[ord(char)] = 1 if b < 0xC0 else 2 if 0xC2 <= b < 0xE0 else 3 if 0xE0 <= b < 0xF0 else 4 if 0xF0 <= b < 0xF5 else 0
    return out


_KINDS = {codec: _kinds(codec) for codec in READ_AS}


def _suspects(codes: np.ndarray) -> np.ndarray:
    """Positions of the characters that are UTF-8 as one of the sets reads it, and of lost ones, whatever their frequency."""
    wide = np.flatnonzero(codes > 127)
    low = np.minimum(codes[wide], 0xFFFF)
    hit = low == ord(LOST)
    beside = np.diff(wide) == 1
    for kinds in _KINDS.values():
        kind = kinds[low]
        follows = beside & (kind[1:] == 1)
        for size in (2, 3, 4):
            heads = np.flatnonzero(kind[: len(kind) - size + 1] == size) if len(kind) >= size else np.zeros(0, np.int64)
            for k in range(size - 1):
                heads = heads[follows[heads + k]]
            for k in range(size):
                hit[heads + k] = True
    return wide[hit]


def _misplaced_kinds() -> np.ndarray:
    """For each character: 1 small letter, 2 capital letter, 3 a sign that words don't have, 4 a letter of another alphabet; else 0."""
    out = np.zeros(CHARS, np.uint8)
    inside = "'’‘‐‑­·ʼ"
    for c in range(0x10000):
        kind, char = unicodedata.category(chr(c)), chr(c)
        if kind[0] == "L":
            latin = c < 0x250 or 0x1E00 <= c < 0x1F00 or 0xFB00 <= c < 0xFB07
            out[c] = (2 if kind in ("Lu", "Lt") else 1) if latin else 4 if 0x370 <= c < 0x530 else 0
        elif c > 127 and char not in inside and (kind[0] in "SP" or kind in ("No", "Cc", "Co", "Lm")):
            out[c] = 3
    return out


_MISPLACED = _misplaced_kinds()


def _misplaced(codes: np.ndarray) -> np.ndarray:
    """Positions of wide characters where writing doesn't have them, as one set read as another leaves them.

    A sign between two letters, a capital behind a small letter, a Greek or Cyrillic letter beside a Latin one.
    """
    at = np.flatnonzero(codes > 127)
    at = at[(at > 0) & (at < len(codes) - 1)]
    own, before, after = _MISPLACED[codes[at]], _MISPLACED[codes[at - 1]], _MISPLACED[codes[at + 1]]
    latin = lambda k: (k == 1) | (k == 2)
    return at[((own == 3) & (before > 0) & (before != 3) & (after > 0) & (after != 3)) | ((own == 2) & (before == 1)) | ((own == 4) & (latin(before) | latin(after)))]


def pair_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all texts: the pairs in each slot of the two tables, without suspects and without misplaced ones; each character.

    So UTF-8 read wrongly, and one set read as another, become probable neither by copies nor by being frequent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros((4 << BITS) + CHARS, np.uint32)
        for batch in batches:
            codes = _codes(batch.column("text").to_pylist())
            if len(codes) > 1:
                at, wide = _wide_pairs(codes)
                for first, marked in ((0, _suspects(codes)), (2 << BITS, _misplaced(codes))):
                    odd = np.zeros(len(codes), np.bool_)
                    odd[marked] = True
                    pairs, n = np.unique(wide[~(odd[at] | odd[at + 1])], return_counts=True)
                    for slots in _slots(pairs):
                        np.add.at(hits, slots + first, n.astype(np.uint32))
                chars, n = np.unique(codes, return_counts=True)
                hits[chars.astype(np.int64) + (4 << BITS)] += n.astype(np.uint32)
        yield slices(hits)

    texts = docs.select("text").where("text is not null and text <> ''")
    return summed(texts.mapInArrow(count, ROWS), (4 << BITS) + CHARS)


class PairModel:
    """Mutual information and log probabilities of adjacent characters, from the counts of the whole corpus."""

    def __init__(self, table: np.ndarray, without: str) -> None:
        """``without`` says which pairs the counts leave out: suspects or misplaced ones."""
        first = {"suspects": 0, "misplaced": 2 << BITS}[without]
        self.table, self.chars = table[first : first + (2 << BITS)], table[4 << BITS :]
        self.total = max(1.0, float(self.chars.sum()))
        self.smooth = SMOOTH * math.sqrt(self.total)
        self.known: dict[str, float] = {}

    def pairs(self, pairs: np.ndarray) -> np.ndarray:
        """Log probabilities."""
        one, two = _slots(pairs)
        return np.log((np.minimum(self.table[one], self.table[two]) + 0.3) / self.total)

    def information(self, pairs: np.ndarray) -> np.ndarray:
        """Pointwise mutual information: the log of how much more often a pair occurs than its characters alone would give."""
        first, second = (self.chars[x.astype(np.int64)] + self.smooth for x in (pairs >> np.uint64(21), pairs & np.uint64((1 << 21) - 1)))
        return self.pairs(pairs) - np.log(first / self.total) - np.log(second / self.total)

    def text(self, text: str) -> float:
        """Sum of the log probabilities of the adjacent pairs, of which each must have a character outside ASCII."""
        total = 0.0
        for k in range(len(text) - 1):
            pair = text[k : k + 2]
            value = self.known.get(pair)
            if value is None:
                if len(self.known) >= CACHE:
                    self.known.clear()
                value = float(self.pairs(np.array([(ord(pair[0]) << 21) | ord(pair[1])], np.uint64))[0])
                self.known[pair] = value
            total += value
        return total


def runs(positions: np.ndarray, scores: np.ndarray, cost: float = 2.0) -> list[tuple[int, int]]:
    """The maximum-scoring segments (start, end) of a text whose pairs at ``positions`` score; others cost ``cost`` each."""
    out: list[tuple[int, int]] = []
    start, best, here, last = -1, 0.0, 0.0, 0
    for at, score in zip(positions.tolist(), scores.tolist()):
        here -= cost * (at - last - 1) if start >= 0 else 0
        last = at
        if start >= 0 and here <= 0:
            out.append((start, end))  # noqa: F821
            start, here, best = -1, 0.0, 0.0
        here += score
        if start < 0:
            if score <= 0:
                here = 0.0
                continue
            start = at
        if here >= best:
            best, end = here, at + 2
    if start >= 0:
        out.append((start, end))
    return out


def _utf8_undone(run: str, codec: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, original) of the stretches of a run of wide characters that are UTF-8 read in the character set."""
    known = _MAPS[codec]
    for m in _UTF8.finditer(bytes(known.get(c, 0) for c in run)):
        try:
            yield m.start(), m.end(), m.group().decode("utf-8")
        except UnicodeDecodeError:
            continue


def _depths(text: str, codec: str) -> Iterator[str]:
    """The originals of a text that was read wrongly once, twice or three times."""
    for _ in range(2):
        yield text
        undone = next(_utf8_undone(text, codec), (0, 0, ""))
        if undone[:2] != (0, len(text)):
            return
        text = undone[2]
    yield text


class Undoing:
    """What each inverse mapping makes of a cluster of wide characters between its neighbours; remembered, for speed only."""

    def __init__(self, table: np.ndarray) -> None:
        self.model, self.placed = PairModel(table, "suspects"), PairModel(table, "misplaced")
        self.known: dict[tuple[str, str, str], tuple[dict, dict]] = {}

    def __call__(self, left: str, run: str, right: str) -> tuple[dict[str, list], dict[tuple[str, str], tuple[float, str]]]:
        """UTF-8 by the set it was read in: (start, end, original, gain a pair); and swaps of sets: (gain, original)."""
        found = self.known.get((left, run, right))
        if found is None:
            if len(self.known) >= CACHE:
                self.known.clear()
            found = self.known[left, run, right] = self._utf8(left, run, right), self._swaps(left, run, right)
        return found

    def _utf8(self, left: str, run: str, right: str) -> dict[str, list]:
        out: dict[str, list] = {}
        for codec in READ_AS:
            for i, j, original in _utf8_undone(run, codec):
                x, y = (run[i - 1] if i else left), (run[j] if j < len(run) else right)
                before = self.model.text(x + run[i:j] + y) / (j - i + 1)
                after, original = max((self.model.text(x + o + y) / (len(o) + 1), o) for o in _depths(original, codec))
                out.setdefault(codec, []).append((i, j, original, after - before))
        for codec in READ_WIDE if max(run) >= "⺀" else ():
            try:
                original = run.encode(codec).decode("utf-8")
            except UnicodeError:
                continue
            gain = self.model.text(left + original + right) / (len(original) + 1) - self.model.text(left + run + right) / (len(run) + 1)
            out[codec] = [(0, len(run), original, gain)]
        return out

    def _swaps(self, left: str, run: str, right: str) -> dict[tuple[str, str], tuple[float, str]]:
        if run.isspace():
            return {}
        out, before = {}, self.placed.text(left + run + right)
        for codec in READ_AS:
            known = _MAPS[codec]
            if all(c in known for c in run):
                for really in REALLY:
                    original = "".join(_CHARS[really][known[c]] for c in run)
                    if really != codec and original != run:
                        out[codec, really] = (self.placed.text(left + original + right) - before, original)
        return out


def repair(text: str, spans: list[tuple[int, int]], undo: Undoing) -> tuple[str, str | None, int]:
    """The text with its garbled stretches undone, the mappings found inside the spans, and how many characters are lost.

    Once the spans prove a mapping, it is undone in the whole text, and what remains is searched for another one.
    """
    text, mapping, lost = _repair(text, spans, undo)
    used = [mapping] if mapping else []
    while mapping and len(used) < len(READ_AS):
        text, mapping, _ = _repair(text, [(0, len(text))], undo)
        used += [mapping] if mapping else []
    return text, ", ".join(used) or None, lost


def _repair(text: str, spans: list[tuple[int, int]], undo: Undoing) -> tuple[str, str | None, int]:
    """One mapping: the one that gains most."""
    quoted = [m.span() for m in _QUOTED.finditer(text)]

    def clusters(parts: list[tuple[int, int]]) -> list[tuple[int, int]]:
        found = (m.span() for a, b in parts for m in _CLUSTER.finditer(text, _back(text, a), _ahead(text, b)))
        return [c for c in dict.fromkeys(found) if not any(a < c[1] and c[0] < b for a, b in quoted)]

    def undone(a: int, b: int) -> tuple[dict[str, list], dict[tuple[str, str], tuple[float, str]]]:
        return undo(text[max(0, a - 1) : a] or "\n", text[a:b], text[b : b + 1] or "\n")

    odd, lost = clusters(spans), 0
    read, swapped = Counter(), Counter()
    for a, b in odd:
        lost += text.count(LOST, a, b)
        utf8, swaps = undone(a, b)
        for codec, edits in utf8.items():
            read[codec] += sum(gain * (j - i) for i, j, _, gain in edits if gain >= GAIN_UTF8)
        for pair, (gain, _) in swaps.items():
            if gain >= GAIN_CLUSTER:
                swapped[pair] += gain
    mapping, edits = None, []
    if read and (codec := max(read, key=lambda c: (read[c], c))) and read[codec] > 0:
        mapping = f"utf-8 as {codec}"
        for a, b in clusters([(0, len(text))]):
            edits += [(a + i, a + j, original) for i, j, original, gain in undone(a, b)[0].get(codec, ()) if gain >= -GAIN_UTF8]
    else:
        for pair in sorted(swapped, key=lambda p: (-swapped[p], REALLY.index(p[1]), p)):
            if swapped[pair] < GAIN_TEXT:
                break
            found = [(a, b, *undone(a, b)[1].get(pair, (-1.0, ""))) for a, b in clusters([(0, len(text))])]
            edits = _consistent(text, found)
            if edits:
                mapping = f"{pair[1]} as {pair[0]}"
                break
    for a, b, original in sorted(edits, reverse=True):
        text = text[:a] + original + text[b:]
    return text, mapping, lost


def _consistent(text: str, found: list[tuple[int, int, float, str]]) -> list[tuple[int, int, str]]:
    """The edits of a swap of sets, from all clusters (start, end, gain, original) of a text; none if they prove too little.

    A character read wrongly is wrong throughout: one that mostly stands where it belongs, and once doesn't, is a slip
    of the writer, and no evidence.
    """
    balance: Counter[str] = Counter()
    for a, b, gain, _ in found:
        for c in set(text[a:b]):
            balance[c] += 1 if gain > 0 else -1
    good = [(a, b, gain, original) for a, b, gain, original in found if gain >= 0 and all(balance[c] > 0 for c in text[a:b])]
    proof = sum(gain for _, _, gain, _ in good if gain >= GAIN_CLUSTER)
    return [(a, b, original) for a, b, _, original in good] if proof >= GAIN_TEXT else []


def _back(text: str, at: int) -> int:
    while at > 0 and text[at] > "\x7f" and text[at - 1] > "\x7f":
        at -= 1
    return at


def _ahead(text: str, at: int) -> int:
    while 0 < at < len(text) and text[at - 1] > "\x7f" and text[at] > "\x7f":
        at += 1
    return at


def garbled(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, mapping, n_lost, restored) of the documents whose text was decoded with a wrong character set.

    Adjacent characters are scored by their mutual information in all texts; maximum-scoring segments are the improbable
    runs, and only inside them inverse mappings are tried: UTF-8 that was read in another set, once or several times,
    and one set read as another. A mapping counts if it makes the run more probable. The statistics leave out stretches
    that are valid UTF-8 as some set reads it, replacement characters, and characters where writing doesn't have them;
    so garbling can't vouch for itself, by copies or by being frequent, and the first two are looked at in any case.
    Replacement characters can't be undone: n_lost counts them, and restored is the text with everything else undone.
    Characters that stand between quotation marks on their own are quoted, not garbled. Null and empty texts have no
    rows; doc_id is passed on as it is. The model is a table of fixed size, broadcast; the operator itself is narrow.
    """
    table = docs.sparkSession.sparkContext.broadcast(pair_counts(docs).astype(np.float32))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        undo = Undoing(table.value)
        for batch in batches:
            ids, texts, rows = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), []
            codes = _codes(texts)
            at, pairs = _wide_pairs(codes)
            scores = SURPRISE - undo.placed.information(pairs)
            starts = np.cumsum([0, *(len(t or "") + 1 for t in texts)])
            first = np.searchsorted(at, starts)
            odd = np.add.reduceat(np.append(scores > 0, False), np.minimum(first[:-1], len(scores))) if len(scores) else np.zeros(len(texts))
            suspects = _suspects(codes)
            held = np.searchsorted(suspects, starts)
            for k in np.flatnonzero(((odd > 0) & (first[:-1] < first[1:])) | (held[:-1] < held[1:])).tolist():
                part = slice(first[k], first[k + 1])
                spans, size = runs(at[part] - starts[k], scores[part]), len(texts[k])
                spans += [(a, a + 1) for a in (suspects[held[k] : held[k + 1]] - starts[k]).tolist()]
                restored, mapping, lost = repair(texts[k], [(a, min(b, size)) for a, b in spans if a < size], undo)
                if mapping or lost:
                    rows.append((ids[k], mapping, lost, restored))
            columns = list(zip(*rows)) or [[]] * 4
            types = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "mapping", "n_lost", "restored"])

    texts = docs.select(F.col("doc_id").cast("bigint"), "text").where("text is not null and text <> ''")
    return texts.mapInArrow(find, "doc_id bigint, mapping string, n_lost int, restored string")
