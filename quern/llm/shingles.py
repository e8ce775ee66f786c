"""Word sequences of texts as sets of 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 20
"""Characters hashed at a time, or one text if that is longer."""
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


class Shingler:
    """The distinct sequences of ``width`` words of texts: runs of letters and digits of their lower-cased form.

    A word's hash is a polynomial in its characters modulo 2**64, taken for all words at once from prefix sums.
    """

    def __init__(self, width: int) -> None:
        self.width = width
        self.word = np.frombuffer(bytes(chr(c).isalnum() for c in range(0x110000)), np.bool_)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.powers) < n:
            self.powers, self.inverses = (np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(max(n, CHUNK), b, np.uint64))), dtype=np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))

    def chunks(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, hashes, bounds): for the texts first, first + 1, ... their sorted distinct hashes, between the bounds."""
        at = 0
        while at < len(texts):
            low, size, first = [], 0, at
            while at < len(texts) and (not low or size < CHUNK):
                low.append((texts[at] or "").lower())
                size += len(low[-1]) + 1
                at += 1
            yield first, *self._hashes(low)

    def _hashes(self, low: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        inside = self.word[codes]
        edges = np.flatnonzero(np.diff(inside, prepend=False, append=False))
        start, end = edges[::2], edges[1::2]
        self._grow(len(codes))
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(_mix(codes.astype(np.uint64) + np.uint64(1)) * self.powers[: len(codes)], out=sums[1:])
        words = _mix((sums[end] - sums[start]) * self.inverses[start] + (end - start).astype(np.uint64))
        stops = np.cumsum([len(t) + 1 for t in low])
        doc = np.searchsorted(stops, start, "right")
        n = max(0, len(words) - self.width + 1)
        out = words[:n].copy()
        for k in range(1, self.width):
            out = _mix(out) + words[k : k + n]
        out, doc = _mix(out), doc[:n] if self.width == 1 else np.where(doc[:n] == doc[self.width - 1 : self.width - 1 + n], doc[:n], -1)
        out, doc = out[doc >= 0], doc[doc >= 0]
        bounds = np.searchsorted(doc, np.arange(len(low) + 1))
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            out[a:b].sort()
        new = np.ones(len(out), np.bool_)
        new[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
        return out[new], np.concatenate(([0], np.cumsum(new)))[bounds]

    def __call__(self, text: str | None) -> np.ndarray:
        return next(iter(self.chunks([text])))[1]
