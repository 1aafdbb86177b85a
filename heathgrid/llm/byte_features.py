"""Words and character n-grams of many texts at once, as numbers, by vector operations on their bytes."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
MIX = np.uint64(0xD6E8FEB86659FD93)
WHITE = np.zeros(256, dtype=bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LETTERS = np.zeros(256, dtype=bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_powers = [powers(BASE, 1024), powers(INVERSE, 1024)]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX
    return h ^ (h >> np.uint64(29))


def spans(flat: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest runs of bytes of a kind; none crosses a text's border."""
    is_in = np.zeros(len(flat) + 2, dtype=bool)
    is_in[1:-1] = inside[flat]
    start, end = is_in[1:] & ~is_in[:-1], is_in[:-1] & ~is_in[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(flat))]
    split = inner[is_in[inner] & is_in[inner + 1]]
    start[split] = end[split] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of bytes."""
    n = len(flat) + 1
    if len(_powers[0]) < n:
        _powers[:] = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
    sums = np.zeros(n, dtype=np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * _powers[0][: n - 1], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _powers[1][starts])


def grams(flat: np.ndarray, size: int) -> np.ndarray:
    """A hash of the `size` bytes that start at each place; the last places have none."""
    n = len(flat) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    code = np.zeros(n, dtype=np.uint64)
    for k in range(size):
        code = (code << np.uint64(8)) | flat[k : n + k]
    return mixed(code * BASE)


def per_text(values: np.ndarray, places: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and number of the values, which stand at ascending places, of each text."""
    at = np.searchsorted(places, offsets)
    sums = np.zeros(len(values) + 1)
    np.cumsum(values, out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]], np.diff(at)
