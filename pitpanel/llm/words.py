"""Words and word shingles of Arrow text columns as numpy hash arrays.

A word is a longest run of bytes other than 0x20 and 0x09-0x0D. Hashes are 64 bits: a polynomial over the word's
bytes, mixed. Memory is bounded by PIECE bytes of text at a time (or the longest single word), plus 8 bytes a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
U = np.uint64
_BASE, _FOLD, _MIX = 0x9E3779B97F4A7C15, U(0xC2B2AE3D27D4EB4F), U(0xFF51AFD7ED558CCD)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> U(33))
    h *= _MIX
    return h ^ (h >> U(29))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["p"]) < n:
        for name, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(max(n, PIECE + 4096), base, dtype=U)
            a[0] = 1
            _powers[name] = np.multiply.accumulate(a)
    return _powers["p"][:n], _powers["i"][:n]


def chunks(col: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them) of runs of rows of about `most` bytes; null: empty."""
    col = pc.fill_null(col, "").cast(pa.large_string())
    n = len(col)
    if not n:
        return
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64, count=n + 1 + col.offset)[col.offset :]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def runs(col: pa.Array, most: int = PIECE) -> Iterator[tuple[int, int]]:
    """(first row, end row) of runs of rows of about `most` bytes of text."""
    size = np.cumsum(pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 64)
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi
        lo = hi


def word_spans(buf: np.ndarray, offs: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words in buf, and the index of each row's first word (one more entry than rows).

    space: of each byte, whether it stands between words.
    """
    ink = ~space[buf]
    if not len(buf):
        none = np.zeros(0, dtype=np.int64)
        return none, none, np.zeros(len(offs), dtype=np.int64)
    cut = np.zeros(len(buf) + 1, dtype=bool)
    cut[offs] = True
    before = np.concatenate(([True], ~ink[:-1]))
    starts = np.flatnonzero(ink & (before | cut[:-1]))
    after = np.concatenate((~ink[1:], [True]))
    ends = np.flatnonzero(ink & (after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A hash for each word; words longer than PIECE, or together with others, are taken piece by piece."""
    out = np.empty(len(starts), dtype=U)
    k = 0
    while k < len(starts):
        s = starts[k]
        j = max(k + 1, int(np.searchsorted(ends, s + PIECE, "right")))
        part = buf[s : ends[j - 1]]
        p, inv = _power(len(part))
        sums = np.zeros(len(part) + 1, dtype=U)
        np.cumsum(((_LOWER[part] if lower else part).astype(U) + U(1)) * p, out=sums[1:])
        out[k:j] = (sums[ends[k:j] - s] - sums[starts[k:j] - s]) * inv[starts[k:j] - s]
        k = j
    return mix(out)


def shingle_hashes(h: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word shingles by row, and the index of each row's first; a row of fewer words has one, of all."""
    count = np.diff(first)
    n = np.where(count >= k, count - k + 1, (count > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(n)))
    rows = np.repeat(np.arange(len(n)), n)
    pos = first[:-1][rows] + (np.arange(at[-1]) - at[:-1][rows])
    size = np.minimum(count, k)[rows]
    s = size.astype(U)
    padded = np.concatenate((h, np.zeros(k, dtype=U)))
    for i in range(k):
        s = np.where(size > i, mix(s * _FOLD + padded[pos + i]), s)
    return s, at
