"""Vectorised hashes of words and word shingles, straight from the UTF-8 bytes of a column."""

from __future__ import annotations

import numpy as np

#: Words are maximal runs of other bytes than these.
SPACES = bytes([0x20, *range(0x09, 0x0E)])
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)
_CODES = np.random.default_rng(20240601).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = 1 << 20
_POWERS: list[np.ndarray] = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS:
        for base in (_BASE, _INVERSE):
            p = np.full(_STEP + 1, base, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hash_words(d: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, start) of each word of d, at most _STEP bytes; a word also ends before each position in breaks."""
    word = ~_IS_SPACE[d]
    edge = np.zeros(len(d) + 1, bool)
    edge[breaks] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:-1]
    last = word
    last[:-1] &= ~word[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = _powers()
    total = np.zeros(len(d) + 1, np.uint64)
    np.cumsum(_CODES[_LOWER[d]] * up[: len(d)], out=total[1:])
    return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)), start


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each row), A-Z lower-cased, of rows that lie between offsets.

    Rows are cut into pieces at white space, so temporary memory is bounded; a single word of more than a
    piece is hashed over its pieces.
    """
    hashes, starts, at, end = [], [], 0, len(data)
    while at < end:
        stop = min(end, at + _STEP)
        if stop < end and not (inner := np.any(offsets == stop)):
            back = np.flatnonzero(_IS_SPACE[data[at:stop]])
            edge = offsets[(offsets > at) & (offsets < stop)]
            stop = max(at + int(back[-1]) + 1 if len(back) else at, int(edge[-1]) if len(edge) else at)
            if stop == at:  # one word longer than a piece
                stop = at + _STEP
                while stop < end and not _IS_SPACE[data[stop]] and not np.any(offsets == stop):
                    more = _IS_SPACE[data[stop : stop + _STEP]]
                    jump = int(np.argmax(more)) if more.any() else len(more)
                    edge = offsets[(offsets > stop) & (offsets < stop + jump)]
                    stop = int(edge[0]) if len(edge) else stop + jump
                total = 0
                for i in range(at, stop, _STEP):
                    h, _ = _hash_words(data[i : min(i + _STEP, stop)], np.zeros(0, int))
                    total = (total * _BASE + int(h[0])) % (1 << 64)
                hashes.append(np.array([total], np.uint64))
                starts.append(np.array([at]))
                at = stop
                continue
        inside = offsets[(offsets > at) & (offsets < stop)] - at
        h, s = _hash_words(data[at:stop], inside)
        hashes.append(h)
        starts.append(s + at)
        at = stop
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    start = np.concatenate(starts)
    return np.concatenate(hashes), np.diff(np.searchsorted(start, offsets))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes row after row, size of each row's set).

    A shingle is k words; a row of fewer words, but not none, is one shingle.
    """
    words, counts = word_hashes(data, offsets)
    n = np.where(counts >= k, counts - k + 1, (counts > 0).astype(np.int64))
    ends = np.cumsum(counts)
    first = np.repeat(ends - counts, n) + (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n))
    length = np.repeat(np.minimum(counts, k), n)
    rng = np.random.default_rng(k)
    h = length.astype(np.uint64)
    for j, c in enumerate(rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)):
        whole = length > j
        h[whole] += words[first[whole] + j] * c
    h = mix(h)
    bounds = np.concatenate([[0], np.cumsum(n)])
    for i, j in zip(bounds[:-1], bounds[1:]):
        h[i:j].sort()
    keep = np.ones(len(h), bool)
    keep[1:] = h[1:] != h[:-1]
    keep[bounds[:-1][n > 0]] = True
    sizes = np.add.reduceat(np.append(keep, 0), bounds[:-1]) * (n > 0) if len(n) else n
    return h[keep], sizes.astype(np.int64)
