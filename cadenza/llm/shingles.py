"""Word shingles of whole texts, their hashed document frequencies, and consistent weighted samples, in numpy."""

from __future__ import annotations

import functools

import numpy as np

WORDS = 5
#: Cells of the table of document frequencies; shingles are counted by their hash modulo this.
CELLS = 1 << 20

_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = np.uint64(0x100000001B3)  # odd, so it has an inverse modulo 2**64
_BLOCK = 1 << 16


def _mixed(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all bits."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


@functools.cache
def _powers() -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_STEP), -1, 1 << 64))
    up = np.cumprod(np.full(_BLOCK, _STEP, np.uint64))
    return up, np.cumprod(np.full(_BLOCK, inverse, np.uint64))


@functools.cache
def _word_bytes() -> np.ndarray:
    """For each byte, whether it belongs to a word: ASCII letters and digits, and all bytes of other characters."""
    return np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_hashes(text: str) -> np.ndarray:
    """64-bit hashes of the words: runs of letters and digits in lower case; all other ASCII characters separate."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    inside = _word_bytes()[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    up, down = _powers()
    out = np.zeros(len(starts), np.uint64)
    # a word's hash is the sum of its bytes times powers of the step, counted from the word's own first byte
    total = np.uint64(0)
    sums = np.empty(len(raw) + 1, np.uint64)
    sums[0] = 0
    reps = -(-len(raw) // _BLOCK)
    if reps == 1:
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=sums[1:])
        out = (sums[ends] - sums[starts]) * down[starts]
    else:
        base, scale = np.uint64(1), np.empty(reps, np.uint64)
        back, undo = np.uint64(1), np.empty(reps, np.uint64)
        with np.errstate(over="ignore"):
            for k in range(reps):
                scale[k], undo[k] = base, back
                base, back = base * up[-1], back * down[-1]
                part = raw[k * _BLOCK : (k + 1) * _BLOCK].astype(np.uint64) + np.uint64(1)
                run = np.cumsum(part * up[: len(part)]) * scale[k] + total
                sums[k * _BLOCK + 1 : k * _BLOCK + 1 + len(part)] = run
                total = run[-1]
            out = (sums[ends] - sums[starts]) * down[starts % _BLOCK] * undo[starts // _BLOCK]
    return _mixed(out + (ends - starts).astype(np.uint64) * _ODD)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of WORDS words, sorted, and how often each occurs; a shorter text is one shingle, one without words none."""
    w = word_hashes(text)
    if not len(w):
        return w, np.empty(0, np.int64)
    n = max(1, len(w) - WORDS + 1)
    h = np.zeros(n, np.uint64)
    for k in range(min(WORDS, len(w))):
        h = _mixed(h + w[k : k + n]) + _ODD
    return np.unique(h, return_counts=True)


def cells(h: np.ndarray) -> np.ndarray:
    return (h % np.uint64(CELLS)).astype(np.int64)


def idf(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Inverse document frequency, 1 for a shingle of all documents."""
    return 1.0 + np.log10((n_docs + 1) / (np.minimum(df, n_docs) + 1))


@functools.cache
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the two gamma variates and the uniform one, 65536 equally likely values each, in a fixed random order."""
    rng = np.random.default_rng(20240229)
    at = (np.arange(1 << 16) + 0.5) / (1 << 16)
    x = at * 4  # solve 1 - (1 + x) exp(-x) = at
    for _ in range(60):
        x = np.maximum(x - (1 - (1 + x) * np.exp(-x) - at) / np.maximum(x * np.exp(-x), 1e-12), x / 4)
    return tuple(rng.permutation(v).astype(np.float32) for v in (x, np.log(x), at))


def weighted_samples(h: np.ndarray, weights: np.ndarray, n: int) -> np.ndarray:
    """``n`` improved consistent weighted samples of a weighted set of hashes.

    Sample k draws r, c ~ Gamma(2, 1) and b ~ U(0, 1) for each element from its hash, takes t = floor(ln w / r + b) and
    y = exp(r (t - b)), and keeps the element with the least c / (y exp(r)). Two sets agree in a sample with a probability
    equal to their weighted Jaccard similarity. The logarithm of the least value stands for the sampled (element, t).
    """
    r_of, lc_of, b_of = _draws()
    k = np.arange(1, n + 1, dtype=np.uint64)[:, None]
    odd = _mixed(k * _ODD) | np.uint64(1)
    low = np.full(n, np.inf, np.float32)
    lnw = np.log(weights).astype(np.float32)
    mask = np.uint64(0xFFFF)
    for at in range(0, len(h), 4096):
        x = (h[None, at : at + 4096] ^ (odd >> np.uint64(7))) * odd
        x ^= x >> np.uint64(29)
        r = r_of[x >> np.uint64(48)]
        b = b_of[(x >> np.uint64(32)) & mask]
        a = lc_of[(x >> np.uint64(16)) & mask]
        t = np.floor(lnw[None, at : at + 4096] / r + b)
        t -= b
        t += np.float32(1)
        t *= r
        a = a - t
        np.minimum(low, a.min(axis=1), out=low)
    return low
