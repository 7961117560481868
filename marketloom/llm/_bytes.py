"""Vectorised word splitting and hashing over batches of UTF-8 texts.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D.  Batches of texts
are joined with one blank, so no word crosses a document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
GOLDEN = _U(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift), elementwise."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: A random 64-bit value for each byte, 0 for white space.
BYTE_CODE = mix64(np.arange(1, 257, dtype=np.uint64) * GOLDEN) * IS_WORD
_powers = np.ones(1, dtype=np.uint64)


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        steps = np.full(max(n, 64), _U(0xD6E8FEB86659FD93))
        steps[0] = 1
        _powers = np.multiply.accumulate(steps)
    return _powers


def ranges(sizes, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of items whose sizes add up to about ``limit`` (one item at least)."""
    first = total = 0
    for i, n in enumerate(sizes):
        if i > first and total + n > limit:
            yield first, i
            first, total = i, 0
        total += n + 1
    if first < len(sizes):
        yield first, len(sizes)


def text_sizes(column: pa.Array) -> np.ndarray:
    """Bytes of each value of a text or binary column, 0 for nulls."""
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)


def slices(texts: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of texts whose bytes add up to about ``limit``."""
    return ranges([len(t) for t in texts], limit)


class Words:
    """Words of some texts: ``hash`` of each and ``offsets`` of each text's words."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        word = IS_WORD[data]
        before = np.empty_like(word)
        before[0] = False
        before[1:] = word[:-1]
        self.data = data
        self.starts = np.flatnonzero(word & ~before)
        lengths = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        text_ends = np.cumsum(lengths + 1)
        self.offsets = np.concatenate(([0], np.searchsorted(self.starts, text_ends)))
        if len(self.starts):
            gaps = np.diff(np.append(self.starts, len(data)))
            within = np.arange(self.starts[0], len(data)) - np.repeat(self.starts, gaps)
            coded = BYTE_CODE[data[self.starts[0]:]] * _power(int(gaps.max()))[within]
            self.hash = mix64(np.add.reduceat(coded, self.starts - self.starts[0]))
        else:
            self.hash = np.empty(0, dtype=np.uint64)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles and the offsets of each text's ones.

    A text with fewer than ``size`` words, but one at least, has one shingle: all of it.
    """
    h, n = words.hash, len(words.hash)
    counts = np.diff(words.offsets)
    full = np.zeros(max(n - size + 1, 0), dtype=np.uint64)
    for k in range(size):
        full = mix64((full ^ h[k:k + len(full)]) * GOLDEN + _U(k + 1))
    parts, lengths = [], np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    if (lengths == np.maximum(counts - size + 1, 0)).all():
        take = np.repeat(words.offsets[:-1] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
        return full[take + np.arange(len(take))], np.concatenate(([0], np.cumsum(lengths)))
    for i, count in enumerate(counts):
        a = words.offsets[i]
        if count >= size:
            parts.append(full[a:a + count - size + 1])
        elif count:
            whole = np.zeros(1, dtype=np.uint64)
            for k in range(count):
                whole = mix64((whole ^ h[a + k:a + k + 1]) * GOLDEN + _U(k + 1))
            parts.append(mix64(whole + _U(count)))
    out = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return out, np.concatenate(([0], np.cumsum(lengths)))
