"""Fuzzy keys of 23-bit words by the perfect binary Golay code.

Each 23-bit word lies within 3 bits of exactly one of the 4096 codewords. The keys of a word are the codewords
nearest to the word and to its one-bit changes. Words at distance 2 or less have a word within one
bit of both, so they share a key; at distance 1 the nearest codeword of one is a key of the other.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS = 23
# Fixed value: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code.
GENERATOR = 0b110001110101


def _remainder(v: int) -> int:
    for i in range(BITS - 1, 10, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - 11)
    return v


def _tables() -> tuple[np.ndarray, np.ndarray]:
    high = np.array([_remainder(i << 11) for i in range(4096)], dtype=np.int64)
    error = np.zeros(2048, dtype=np.int64)
    for weight in range(4):
        for places in combinations(range(BITS), weight):
            e = sum(1 << p for p in places)
            error[_remainder(e)] = e
    return high, error


_HIGH, _ERROR = _tables()


def decode(v: np.ndarray) -> np.ndarray:
    """Index (12 bits) of the nearest codeword of each word."""
    return (v ^ _ERROR[_HIGH[v >> 11] ^ (v & 2047)]) >> 11


def fuzzy_keys(v: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, key), each key of a row once, rows ascending. Only the lowest ``bits`` are changed."""
    flips = np.concatenate([[0], 1 << np.arange(bits)]).astype(np.int64)
    keys = np.sort(decode(v[:, None] ^ flips[None, :]), axis=1)
    new = np.ones(keys.shape, dtype=bool)
    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
    row, place = np.nonzero(new)
    return row, keys[row, place]


def products(rows: int, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]):
    """(row, key of a, key of b) for all pairs of keys of the same row."""
    na, nb = np.bincount(a[0], minlength=rows), np.bincount(b[0], minlength=rows)
    sa, sb = np.concatenate([[0], np.cumsum(na)[:-1]]), np.concatenate([[0], np.cumsum(nb)[:-1]])
    each = na * nb
    row = np.repeat(np.arange(rows), each)
    within = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    return row, a[1][sa[row] + within // nb[row]], b[1][sb[row] + within % nb[row]]
