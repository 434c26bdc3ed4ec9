"""Words, hashes and n-grams of whole blocks of texts, in numpy.

A block is the UTF-8 bytes of some documents and their offsets.  Words are
the maximal runs of bytes outside U+0020 and U+0009..U+000D; those bytes
never occur inside a multi-byte character, so no decoding is needed.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes outside ASCII letters, digits and multi-byte characters, as separators of bare words.
_SIGN = np.ones(256, dtype=bool)
_SIGN[48:58] = _SIGN[65:91] = _SIGN[97:123] = _SIGN[128:] = False
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (the splitmix64 constants)."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(_BASE))
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]


def tidy(run):
    """A function for mapInArrow that gives freed memory back to the system when a task ends: workers are reused, and two share an executor."""

    def tidied(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # other systems' C libraries have no such call
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return tidied


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse, grown on demand."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def reach(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, BLOCK_BYTES + 1)
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                factors = np.full(size, base, dtype=np.uint64)
                factors[0] = 1
                setattr(cls, name, np.multiply.accumulate(factors))
        return cls.up, cls.down


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of runs of whole texts of about ``limit`` bytes.

    A null text counts as empty.  A text longer than the limit is a block of its own.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        yield lo, hi, raw[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def split(buf: np.ndarray, offs: np.ndarray, bare: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words of a block, and for each document the index of its first word (one more at the end).

    With ``bare``, words are runs of letters, digits and non-ASCII characters only.
    """
    n = len(buf)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    ink = ~(_SIGN if bare else _SPACE)[buf]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offs] = True
    before = np.empty(n, dtype=bool)
    before[0] = False
    before[1:] = ink[:-1]
    after = np.empty(n, dtype=bool)
    after[-1] = False
    after[:-1] = ink[1:]
    starts = np.flatnonzero(ink & (~before | edge[:-1]))
    ends = np.flatnonzero(ink & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of each word; with ``fold`` A-Z count as a-z."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    table, out = (_FOLDED if fold else _BYTE), np.empty(len(starts), dtype=np.uint64)
    step = BLOCK_BYTES
    lo = 0
    while lo < len(starts):  # in pieces, so that one huge text needs no huge table of powers
        hi = max(lo + 1, int(np.searchsorted(ends, starts[lo] + step, side="right")))
        a, b = int(starts[lo]), int(ends[hi - 1])
        up, down = _Powers.reach(b - a + 1)
        total = np.zeros(b - a + 1, dtype=np.uint64)
        np.cumsum(table[buf[a:b]] * up[: b - a], out=total[1:])
        s, e = starts[lo:hi] - a, ends[lo:hi] - a
        out[lo:hi] = (total[e] - total[s]) * down[s]
        lo = hi
    return mix(out + (ends - starts).astype(np.uint64))


def grams(words: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of ``n`` words (empty when there are fewer)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = words[:m].copy()
    for j in range(1, n):
        out *= _U(_BASE)
        out += words[j : j + m]
    return mix(out)


def shingle_set(words: np.ndarray, n: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``n``-word shingles; fewer words make one shingle, no word makes none."""
    if not len(words):
        return words
    return np.unique(grams(words, min(n, len(words))))


def hashes_of(words: list[str]) -> np.ndarray:
    """The hashes that ``hashes`` gives single words, in the order given."""
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(w) for w in raw])
    return hashes(np.frombuffer(b"".join(raw), dtype=np.uint8), ends - [len(w) for w in raw], ends)
