"""Keys of the binary Golay code for fuzzy hashing.

The code has 4,096 words of 23 bits, any two at least seven bits apart, and every vector lies within three
bits of exactly one.  A vector gets the index of that word; one that is exactly three bits away also gets the
five words four bits away.  Two vectors that differ in at most two bits then share an index.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np

LENGTH, CHECK = 23, 11
#: Fixed value: a generator polynomial of the code.
GENERATOR = 0b101011100011


def _remainder(v: int) -> int:
    for i in range(LENGTH - 1, CHECK - 1, -1):
        if v >> i & 1:
            v ^= GENERATOR << (i - CHECK)
    return v


@cache
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the upper twelve bits; by syndrome the error pattern, and the steps to the five further words."""
    upper = np.array([_remainder(m << CHECK) for m in range(1 << LENGTH - CHECK)], np.int64)
    light = {int(m << CHECK | upper[m]) for m in range(len(upper)) if (m << CHECK | int(upper[m])).bit_count() == 7}
    error, steps = np.zeros(1 << CHECK, np.int64), np.zeros((1 << CHECK, 5), np.int64)
    for size in range(4):
        for places in combinations(range(LENGTH), size):
            e = sum(1 << p for p in places)
            s = _remainder(e)
            error[s] = e
            if size == 3:
                steps[s] = sorted(w for w in light if w & e == e)
    return upper, error, steps


def indices(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each vector of ``v`` its index, and its five further indices (all equal to the first where there are none)."""
    upper, error, steps = tables()
    s = (v & (1 << CHECK) - 1) ^ upper[v >> CHECK]
    word = v ^ error[s]
    return word >> CHECK, (word[:, None] ^ steps[s]) >> CHECK
