"""Vectorised text kernels on Arrow buffers: words, lines and 64-bit hashes.

Whole batches are handled as one flat byte array with document offsets, so
cost per document is a few array elements instead of Python objects.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

U = np.uint64
# The splitmix64 constants and the six white-space bytes of [\x20\x09-\x0D].
GOLDEN, MIX1, MIX2 = U(0x9E3779B97F4A7C15), U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB)
SPACES = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]

IS_SPACE = np.zeros(256, bool)
IS_SPACE[SPACES] = True
BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2**64
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: a bijection on 64-bit values."""
    x = (x + GOLDEN).astype(U, copy=False)
    x = (x ^ (x >> U(30))) * MIX1
    x = (x ^ (x >> U(27))) * MIX2
    return x ^ (x >> U(31))


BYTE_VALUE = mix(np.arange(256, dtype=U))
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
FOLDED_VALUE = BYTE_VALUE[FOLD]


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        base = BASE if kind == "up" else pow(BASE, -1, 1 << 64)
        have = np.full(max(n, 1 << 16), U(base))
        have[0] = U(1)
        _powers[kind] = have = np.cumprod(have)
    return have[:n]


class Flat:
    """A batch of texts as one byte array ``b`` with offsets ``off`` (n + 1)."""

    def __init__(self, texts: pa.Array, fold: bool = False):
        self.n = len(texts)
        buffers = texts.buffers()
        off = np.frombuffer(buffers[1], np.int64, count=self.n + 1, offset=8 * texts.offset) if self.n else np.zeros(1, np.int64)
        data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
        self.b = data[off[0] : off[-1]]
        self.off = off - off[0]
        self.fold = fold
        self._prefix = self._words = None

    def runs(self, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the maximal runs of marked bytes; a document border ends a run."""
        inside = np.zeros(len(self.b) + 2, bool)
        inside[1:-1] = mask
        at = np.flatnonzero(inside[1:] != inside[:-1])
        cut = np.unique(self.off)
        inner = cut[inside[cut] & inside[cut + 1]]
        if len(inner):
            at = np.sort(np.concatenate([at, inner, inner]))
        return at[0::2], at[1::2]

    def word_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, first): byte spans of all words, and per document the index of its first word (n + 1)."""
        if self._words is None:
            starts, ends = self.runs(~IS_SPACE[self.b])
            self._words = starts, ends, np.searchsorted(starts, self.off)
        return self._words

    def line_spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, document) of the \\n-split lines."""
        breaks = np.flatnonzero(self.b == 10)
        counts = np.diff(np.searchsorted(breaks, self.off)) + 1
        starts = np.sort(np.concatenate([self.off[:-1], breaks + 1]))
        ends = np.sort(np.concatenate([self.off[1:], breaks]))
        return starts, ends, np.repeat(np.arange(self.n), counts)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte span, equal for equal bytes wherever they stand."""
        if self._prefix is None:
            self._prefix = np.zeros(len(self.b) + 1, U)
            np.cumsum((FOLDED_VALUE if self.fold else BYTE_VALUE)[self.b] * _power("up", len(self.b)), out=self._prefix[1:])
        p = self._prefix
        value = (p[ends] - p[starts]) * _power("down", len(self.b) + 1)[starts]
        return mix(value ^ mix((ends - starts).astype(U)))

    def per_document(self, flags: np.ndarray) -> np.ndarray:
        """Sum of a per-byte 0/1 array within each document."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.off[1:]] - total[self.off[:-1]]


# Odd multipliers that make a window's hash depend on the order of its words.
STEP = [U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F), U(0xE7037ED1A0B428DB), U(0x8EBC6AF09C88C6E3), U(0x589965CC75374CC3)]


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hash of every ``width`` consecutive word hashes (len - width + 1 values)."""
    n = len(words) - width + 1
    if n <= 0:
        return np.zeros(0, U)
    out = words[:n] * STEP[0]
    for k in range(1, width):
        out += words[k : k + n] * STEP[k]
    return mix(out)
