"""SetSketch registers (exponentially spaced truncated minima), their bands, and the joint likelihood of two of them."""

from __future__ import annotations

import numpy as np

from pitpanel.llm.words import U

BASE, RATE, BANDS, ROWS = 1.1, 20.0, 28, 6
M = BANDS * ROWS
_rng = np.random.default_rng(20240229)
_MUL = _rng.integers(1, 1 << 63, size=M, dtype=U) * U(2) + U(1)
_ADD = _rng.integers(0, 1 << 63, size=M, dtype=U) * U(2) + _rng.integers(0, 2, size=M, dtype=U)


def registers(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of M register values (uint8) per set; s: element hashes by set, at: index of each set's first.

    Register i is floor(1 - log_b of the smallest exponential variate of the elements), cut to 0..255. The
    variate is a decreasing map of a hash, so only the smallest hash is turned into one. Merging two sketches is
    the elementwise maximum. Empty sets get zeros.
    """
    some = np.flatnonzero(np.diff(at))
    low = np.empty((M, len(some)), dtype=U)
    heads = at[some]
    step = 1 << 16  # stays in cache
    tmp = np.empty(min(len(s), step) or 1, dtype=U)
    if len(some):
        low[:] = U(0xFFFFFFFFFFFFFFFF)
        for a in range(0, len(s), step):
            part = s[a : a + step]
            t = tmp[: len(part)]
            i = max(0, int(np.searchsorted(heads, a, "right")) - 1)
            j = int(np.searchsorted(heads, a + len(part), "left"))
            cuts = np.maximum(heads[i:j], a) - a
            for r in range(M):
                np.multiply(part, _MUL[r], out=t)
                np.add(t, _ADD[r], out=t)
                np.minimum(low[r, i:j], np.minimum.reduceat(t, cuts), out=low[r, i:j])
    u = (low.astype(np.float64) + 1.0) / 2.0**64
    x = -np.log1p(-np.minimum(u, 1 - 1e-16)) / RATE
    k = np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, 255).astype(np.uint8)
    out = np.zeros((len(at) - 1, M), dtype=np.uint8)
    out[some] = k.T
    return out


def bands(reg: np.ndarray) -> np.ndarray:
    """BANDS keys (int64) per sketch: the band's number and its register values, side by side."""
    r = reg.reshape(len(reg), BANDS, ROWS).astype(np.int64)
    key = np.arange(BANDS, dtype=np.int64)[None, :].repeat(len(reg), 0)
    for i in range(ROWS):
        key = (key << 8) | r[:, :, i]
    return key


def _p(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)


def likely_jaccard(more: np.ndarray, less: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarity, given in how many registers a is above b and below it, and both sizes."""
    u, v = na / (na + nb), nb / (na + nb)
    same = M - more - less
    lo, hi = np.zeros(len(u)), np.minimum(u / v, v / u)

    def value(j):
        pa, pb = np.maximum(_p(u - v * j), 1e-12), np.maximum(_p(v - u * j), 1e-12)
        return more * np.log(pa) + less * np.log(pb) + same * np.log(np.maximum(1 - pa - pb, 1e-12))

    for _ in range(18):  # the likelihood has one peak
        a, b = lo + (hi - lo) * 0.382, lo + (hi - lo) * 0.618
        up = value(a) < value(b)
        lo, hi = np.where(up, a, lo), np.where(up, hi, b)
    return (lo + hi) / 2


def floor_at(similarity: float) -> tuple[int, float]:
    """Equal registers and likely similarity that a pair of this similarity misses about once in ten million."""
    p = 1 - 2 * float(_p(np.array((1 - similarity) / 2)))
    sd = (p * (1 - p) / M) ** 0.5
    return int(M * (p - 5.2 * sd)), similarity - 5.2 * sd * 1.1
