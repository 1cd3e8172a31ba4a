"""The perfect binary Golay code of length 23, for fuzzy keys.

Every word of 23 bits is within 3 bits of exactly one codeword. A word has as its near codewords all
those within 4 bits: one of them, or six. Two words that differ in one bit share the codeword of
either; two words that differ in two bits share that of the word between them.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: Generator polynomial.
POLYNOMIAL = 0b110001110101
NEAR = 6


def _remainder(words: np.ndarray) -> np.ndarray:
    rest = words.copy()
    for bit in range(LENGTH - 1, CHECK - 1, -1):
        rest = np.where(rest >> bit & 1, rest ^ (POLYNOMIAL << (bit - CHECK)), rest)
    return rest


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper 12 and the lower 11 bits, and the error of at most 3 bits for each remainder."""
    high, low = _remainder(np.arange(1 << 12) << CHECK), np.arange(1 << CHECK)
    errors = np.array([sum(1 << b for b in bits) for n in range(4) for bits in combinations(range(LENGTH), n)])
    table = np.zeros(1 << CHECK, dtype=np.int64)
    table[_remainder(errors)] = errors
    return high, low, table


def decoded(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each word."""
    high, low, table = _tables()
    return (words ^ table[high[words >> CHECK] ^ low[words & (1 << CHECK) - 1]]) >> CHECK


def near(words: np.ndarray) -> np.ndarray:
    """The distinct indices of codewords within 4 bits of each word, six places a word, -1 where unused."""
    around = words[:, None] ^ np.array([0, *(1 << b for b in range(LENGTH))])[None, :]
    found = np.sort(decoded(around.ravel()).reshape(around.shape), axis=1)
    fresh = np.ones(found.shape, dtype=bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    place = np.cumsum(fresh, axis=1) - 1
    out = np.full((len(words), NEAR), -1, dtype=np.int64)
    rows, columns = np.nonzero(fresh)
    out[rows, place[rows, columns]] = found[rows, columns]
    return out
