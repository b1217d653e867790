"""The binary Golay code of length 23 as a fuzzy hash.

Every 23-bit word lies within 3 bits of exactly one of the 4096 codewords; that codeword's 12 data
bits are the word's index. The indices of all words within one bit of a word are its keys, six at
most. Two words that differ in two bits or fewer have a word within one bit of both, so they share
a key.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

WORD, DATA = 23, 12
GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _remainders(words: np.ndarray) -> np.ndarray:
    """Of the division by the generator polynomial: zero for codewords, else a name of the error."""
    left = words.astype(np.int64)
    for place in range(WORD - 1, WORD - DATA - 1, -1):
        left = np.where(left >> place & 1, left ^ GENERATOR << (place - WORD + DATA), left)
    return left


@cache
def _errors() -> np.ndarray:
    """By remainder, the only error of three bits or fewer that leaves it."""
    errors = np.array([sum(1 << p for p in places) for n in range(4) for places in combinations(range(WORD), n)])
    table = np.zeros(1 << WORD - DATA, np.int64)
    table[_remainders(errors)] = errors
    return table


def decode(words: np.ndarray) -> np.ndarray:
    """The index of the nearest codeword of each word."""
    return (words ^ _errors()[_remainders(words)]) >> WORD - DATA


def keys(words: np.ndarray) -> np.ndarray:
    """Per word a row of the indices within one bit of it: 24 columns, sorted, repeats as -1."""
    near = np.stack([words, *[words ^ (1 << p) for p in range(WORD)]], axis=1)
    found = np.sort(decode(near.ravel()).reshape(near.shape), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found
