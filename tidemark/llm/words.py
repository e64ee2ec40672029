"""Words of whole slices of text at once, with numpy.

A word is a maximal run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z: digits, a-z and
everything beyond ASCII. In UTF-8 each byte tells its class, so texts are never decoded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidemark.llm.common import mix, text_buffers

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_GRAM = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Words:
    """data: lower-cased bytes; start, end: of each word; doc: its text; first: index of each text's first word, n+1."""

    def __init__(self, col: pa.Array, hashes: bool = True):
        raw, self.off = text_buffers(col)
        self.data = _LOWER[raw]
        n = len(self.data)
        inside = _IS_WORD[self.data]
        before = np.zeros(n, bool)
        before[1:] = inside[:-1]
        heads = self.off[:-1][self.off[:-1] < n]
        before[heads] = False
        starts = inside & ~before
        after = np.zeros(n, bool)
        after[:-1] = inside[1:] & ~starts[1:]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.start, self.off)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(col)), self.count)
        if hashes:
            self.hash = self._hash(inside)

    def _hash(self, inside: np.ndarray) -> np.ndarray:
        if not len(self.start):
            return np.empty(0, np.uint64)
        size = self.end - self.start
        begin = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(begin, size)
        values = _BYTE[self.data[inside]] * _PLACE[place & 4095]
        if int(size.max()) > 4096:
            far = np.flatnonzero(place > 4095)  # only these, or hashes would depend on a word's company
            values[far] = mix(values[far] + (place[far] >> 12).astype(np.uint64))
        return mix(np.add.reduceat(values, begin) + size.astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        """Hash of the k words from each word on; those that leave their text are for the caller to drop (``fits``)."""
        out = np.zeros(len(self.start), np.uint64)
        n = len(out)
        for j in range(min(k, n)):
            out[: n - j] += self.hash[j:] * _GRAM[j]
        return mix(out + np.uint64(k))

    def fits(self, k: int) -> np.ndarray:
        """Whether the k words from each word on are all in its text."""
        return np.arange(len(self.start)) + k <= self.first[self.doc + 1]

    def text(self, i: int, j: int) -> bytes:
        """Words i to j, joined by blanks."""
        d = self.data
        return b" ".join(d[s:e].tobytes() for s, e in zip(self.start[i:j].tolist(), self.end[i:j].tolist(), strict=True))
