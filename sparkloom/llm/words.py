"""Words of UTF-8 texts and their hashes, for the operators that count or align words."""

from __future__ import annotations

import numpy as np

BLOCK = 1 << 18  # bytes taken at a time
_STEP = 0x100000001B3
_FULL = 1 << 64


def _powers_of(x: int, n: int) -> np.ndarray:
    out = np.ones(n, np.uint64)
    out[1:] = x
    return np.multiply.accumulate(out)


_POWERS, _INVERSE = _powers_of(_STEP, BLOCK), _powers_of(pow(_STEP, -1, _FULL), BLOCK)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def words_in(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and hash of every word between ASCII white space.

    A word's hash depends on its bytes alone, wherever it stands; a word may be of any length.
    """
    every, was_space, carry = np.frombuffer(data, np.uint8), True, 0
    starts, ends, low, high = [], [], [], []
    for a in range(0, len(every), BLOCK):
        x = every[a : a + BLOCK]
        space = SPACES[x]
        before = np.empty_like(space)
        before[0], before[1:] = was_space, space[:-1]
        begin, end = np.flatnonzero(before & ~space), np.flatnonzero(space & ~before)
        sums = (x.astype(np.uint64) + np.uint64(1)) * _POWERS[: len(x)]
        if a:
            sums *= np.uint64(pow(_STEP, a, _FULL))
        sums = np.cumsum(sums, dtype=np.uint64) + np.uint64(carry)
        for found, kept, at in ((begin, low, starts), (end, high, ends)):
            h = sums[found - 1]
            if len(found) and found[0] == 0:
                h[0] = carry
            kept.append(h)
            at.append(found + a)
        carry, was_space = int(sums[-1]), bool(space[-1])
    if not was_space:
        ends.append(np.array([len(every)]))
        high.append(np.array([carry], np.uint64))
    if not starts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    starts, ends, low, high = (np.concatenate(c) for c in (starts, ends, low, high))
    back = _INVERSE[starts % BLOCK]
    for block in np.unique(starts[starts >= BLOCK] // BLOCK).tolist():
        rows = slice(*np.searchsorted(starts, (block * BLOCK, (block + 1) * BLOCK)))
        back[rows] *= np.uint64(pow(_STEP, -block * BLOCK, _FULL))
    return starts, ends, mix((high - low) * back)
