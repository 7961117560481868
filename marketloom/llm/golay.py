"""The binary Golay code (23, 12): decoding of 23-bit words to nearby codewords.

The code is perfect: every word lies within three bits of exactly one codeword.  A word
at distance three has five further codewords at distance four, a nearer word has none.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np

BITS, CHECK = 23, 11
#: Fixed value: the generator x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for at in range(BITS - 1, CHECK - 1, -1):
        if word >> at & 1:
            word ^= GENERATOR << (at - CHECK)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the low 12 and the high 11 bits; by syndrome: the error, how many
    further codewords are at distance four, and these as changes of the index."""
    units = [_remainder(1 << i) for i in range(BITS)]

    def syndromes(first: int, count: int) -> np.ndarray:
        out = np.zeros(1, dtype=np.int64)
        for i in range(first, first + count):
            out = np.concatenate([out, out ^ units[i]])
        return out

    error = np.zeros(1 << CHECK, dtype=np.int64)
    for size in range(1, 4):
        for places in combinations(range(BITS), size):
            syndrome = 0
            for i in places:
                syndrome ^= units[i]
            error[syndrome] = sum(1 << i for i in places)
    messages = np.arange(1 << (BITS - CHECK), dtype=np.int64) << CHECK
    words = messages | syndromes(CHECK, BITS - CHECK)
    light = words[np.bitwise_count(words) == 7]
    count, change = np.zeros(1 << CHECK, dtype=np.int64), np.zeros((1 << CHECK, 5), dtype=np.int64)
    for syndrome in np.flatnonzero(np.bitwise_count(error) == 3):
        holds = light[(light & error[syndrome]) == error[syndrome]]
        count[syndrome], change[syndrome] = len(holds), holds >> CHECK
    return syndromes(0, 12), syndromes(12, 11), error, count, change


LOW, HIGH, ERROR, COUNT, CHANGE = _tables()


def nearest(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index (12 bits) of the one codeword within three bits, and the syndrome."""
    syndrome = LOW[words & 0xFFF] ^ HIGH[words >> 12]
    return (words ^ ERROR[syndrome]) >> CHECK, syndrome


def fuzzy_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, index): keys of each word, of which two words that differ in at most
    one bit share one.

    A word with an odd number of ones has all codewords within four bits as keys, one
    with an even number its nearest only.  Of two words that differ in one bit, one is
    even, and its codeword is at most four bits from the other.
    """
    index, syndrome = nearest(words)
    further = np.where(np.bitwise_count(words) & 1, COUNT[syndrome], 0)
    wide = np.flatnonzero(further)
    position = np.concatenate([np.arange(len(words)), np.repeat(wide, 5)])
    return position, np.concatenate([index, (index[wide, None] ^ CHANGE[syndrome[wide]]).reshape(-1)])
