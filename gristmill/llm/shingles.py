"""Words and runs of words as 64-bit hashes, and min-wise signatures: whole batches of texts at a time, in numpy.

A word is a run of letters or digits in lower case. Its hash is a polynomial in its characters, taken as a difference of prefix sums over the
whole batch, so that no text is looped over in Python.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_GOLD = 0x9E3779B97F4A7C15

# Letters and digits among the code points below this, and their lower case; what lies above is neither.
_POINTS = 0x20000
_LOWER = np.arange(_POINTS + 1, dtype=np.uint32)
_ALNUM = np.zeros(_POINTS + 1, bool)
for _k in range(_POINTS):
    if not 0xD800 <= _k < 0xE000:
        _c = chr(_k)
        if _c.isalnum():
            _ALNUM[_k] = True
            if len(_c.lower()) == 1:
                _LOWER[_k] = ord(_c.lower())

#: Characters handled at a time, unless one text is longer.
_CHUNK = 400_000
_P = 0x5851F42D4C957F2D
_powers: tuple[np.ndarray, np.ndarray] = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit touches every output bit."""
    x = (x ^ (x >> _S)) * _M
    x = (x ^ (x >> _S)) * _N
    return x ^ (x >> _S)


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64; kept for the usual length, made anew for a longer text."""
    global _powers
    if len(_powers[0]) >= n:
        return _powers
    size = max(n, 2 * _CHUNK)
    out = []
    for base in (_P, pow(_P, -1, 1 << 64)):
        x = np.full(size, base, np.uint64)
        x[0] = 1
        out.append(np.cumprod(x, dtype=np.uint64))
    made = (out[0], out[1])
    if size <= 2 * _CHUNK:
        _powers = made
    return made


def _chunk_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes, bounds): words bounds[k]:bounds[k + 1] belong to text k."""
    points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(points):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    points = np.minimum(points, _POINTS)
    inside = _ALNUM[points]
    up, down = _power(len(points) + 1)
    sums = np.cumsum(np.where(inside, _LOWER[points].astype(np.uint64) + np.uint64(1), np.uint64(0)) * up[: len(points)], dtype=np.uint64)
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if inside[0]:
        edge = np.concatenate([[0], edge])
    if inside[-1]:
        edge = np.concatenate([edge, [len(points)]])
    start, stop = edge[0::2], edge[1::2]
    before = np.where(start > 0, sums[start - 1], np.uint64(0))
    ids = mix((sums[stop - 1] - before) * down[start] + (stop - start).astype(np.uint64))
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    return ids, np.concatenate([[0], np.searchsorted(start, ends)])


def word_hashes(texts: Sequence[str | None]) -> Iterator[np.ndarray]:
    """The word hashes of each text, in order; none for NULL or empty texts."""
    part: list[str] = []
    size = 0
    for t in texts:
        part.append(t or "")
        size += len(part[-1])
        if size >= _CHUNK or len(part) >= 4096:
            yield from _split(part)
            part, size = [], 0
    if part:
        yield from _split(part)


def _split(part: list[str]) -> Iterator[np.ndarray]:
    ids, bounds = _chunk_words(part)
    for a, b in zip(bounds[:-1], bounds[1:]):
        yield ids[a:b]


def runs(ids: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of `width` words, repetitions kept."""
    n = len(ids) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = ids[:n] * np.uint64(_GOLD)
    for k in range(1, width):
        h += ids[k : n + k] * np.uint64(pow(_GOLD, k + 1, 1 << 64))
    return mix(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted, without repetitions."""
    if len(h) < 2:
        return h
    h = np.sort(h)
    return h[np.concatenate([[True], h[1:] != h[:-1]])]


class MinHasher:
    """The minima of a set of hashes under `size` fixed functions of the multiply-add family modulo 2^32, as uint32.

    Hashes are well mixed already; arithmetic on 32 bits runs at twice the rate of that on 64. Repetitions change nothing.
    """

    def __init__(self, size: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.a = rng.integers(1, 2**32, (size, 1), dtype=np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 2**32, (size, 1), dtype=np.uint32)

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        low = hashes.astype(np.uint32)[None, :]
        best = None
        # In runs of hashes, so that the table stays in the cache whatever the length of the text.
        for at in range(0, low.shape[1], 256):
            x = self.a * low[:, at : at + 256]
            x += self.b
            m = x.min(axis=1)
            best = m if best is None else np.minimum(best, m)
        return best
