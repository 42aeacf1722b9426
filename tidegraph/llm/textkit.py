"""Vectorised hashing of words and word sequences over Arrow text columns.

A *word* is a maximal run of bytes other than 0x20 and 0x09-0x0D of the UTF-8
text.  Words, shingles and windows are compared by 64-bit hashes: a byte (or
word) polynomial modulo 2**64 with an odd base, so that any span's hash comes
from two prefix sums, followed by a SplitMix64 finaliser.  Such polynomials have equal values for some different
sequences of over a thousand letters, whatever the base; so words of over LONG bytes are hashed by BLAKE2b, and spans are
of fewer than a hundred words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
#: Bytes of a word up to which its hash is a polynomial.
LONG = 40
BLOCK = 1 << 18

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_RAW = _rng.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_fold = np.arange(256)
_fold[65:91] += 32
_FOLDED = _RAW[_fold]
FOLD_BYTES = bytes(_fold.astype(np.uint8))
_BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASES = (0xD6E8FEB86659FD93 | 1, 0xA0761D6478BD642F | 1)


class _Powers:
    """Growing tables of base**i and base**-i modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16, 2 * len(self.up) if n < PIECE else n)
            for name, b in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, b, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_byte_powers = _Powers(_BYTE_BASE)
_word_powers = tuple(_Powers(b) for b in WORD_BASES)


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null becomes empty."""
    if not (pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type)):
        column = pc.cast(column, pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return [x or b"" for x in column.to_pylist()]


def blocks(texts: list[bytes], target: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``target`` bytes; a longer text has a range of its own."""
    lo = size = 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > target:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


class Words:
    """Words of some texts, joined: hashes ``h``, byte ranges, and ``off[i]:off[i + 1]`` for text i."""

    def __init__(self, texts: list[bytes], fold: bool = False):
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(sizes + 1, out=at[1:])
        edge = np.diff(np.concatenate(([False], ~_SPACE[self.buf], [False])).view(np.int8))
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.off = np.searchsorted(self.start, at)
        self.h = self._hashes(_FOLDED if fold else _RAW)

    def _hashes(self, table: np.ndarray) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + PIECE, "right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            up, down = _byte_powers(hi - lo)
            sums = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(table[self.buf[lo:hi]] * up, out=sums[1:])
            s = self.start[i:j] - lo
            out[i:j] = mix((sums[self.end[i:j] - lo] - sums[s]) * down[s])
            i = j
        for i in np.flatnonzero(self.end - self.start > LONG):
            word = self.buf[self.start[i]:self.end[i]]
            word = np.where((word >= 65) & (word <= 90), word + 32, word).astype(np.uint8) if table is _FOLDED else word
            out[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8, key=b"words").digest(), "little")
        return out

    def counts(self) -> np.ndarray:
        return np.diff(self.off)

    def ends_of(self) -> np.ndarray:
        """For each word, the index after the last word of its text."""
        return np.repeat(self.off[1:], self.counts())


class Spans:
    """Hashes of word sequences ``h[s:e]``, in one of two independent families."""

    def __init__(self, h: np.ndarray, family: int = 0):
        up, self.down = _word_powers[family](len(h) + 1)
        self.sums = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * up[: len(h)], out=self.sums[1:])

    def __call__(self, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        return mix((self.sums[e] - self.sums[s]) * self.down[s] + (e - s).astype(np.uint64) * np.uint64(0x632BE59BD9B4E019))


def shingle_lists(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, repeats included, and offsets by text.

    A text of fewer than k words, but one at least, has its whole sequence as one shingle.
    """
    n = words.counts()
    many = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    off = np.concatenate(([0], np.cumsum(many)))
    if not off[-1]:
        return np.empty(0, np.uint64), off
    s = np.arange(off[-1]) - np.repeat(off[:-1] - words.off[:-1], many)
    e = np.minimum(s + k, np.repeat(words.off[1:], many))
    return Spans(words.h)(s, e), off


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
