"""Vectorised text tools for Python workers: blocks of UTF-8 texts as one byte array, words as spans of it.

A block holds whole texts only and at least one, so a very long text makes a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 19


class Block:
    """Texts of some rows: data (uint8), offsets (int64, one more than rows), null flags."""

    def __init__(self, texts: pa.Array):
        texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
        self.null = texts.is_null().to_numpy(zero_copy_only=False)
        texts = texts.fill_null("").cast(pa.large_string())
        n = len(texts)
        if n == 0:
            self.offsets, self.data = np.zeros(1, np.int64), np.zeros(0, np.uint8)
            return
        offsets = np.frombuffer(texts.buffers()[1], np.int64, count=n + 1 + texts.offset)[texts.offset :]
        data = texts.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.data, self.offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `most` bytes together."""
    sizes = np.asarray(pc.binary_length(column.fill_null("")), np.int64)
    lo, total = 0, 0
    for i, s in enumerate(sizes):
        if i > lo and total + s > most:
            yield lo, i
            lo, total = i, 0
        total += int(s)
    if lo < len(sizes):
        yield lo, len(sizes)


def separators(chars: bytes) -> np.ndarray:
    """A lookup table: which byte values separate words."""
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


WHITE = separators(b" \t\n\x0b\x0c\r")


def words(block: Block, is_separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word, the row of each word, and where each row's words begin (one more than rows)."""
    n = len(block.data)
    inside = np.zeros(n + 1, bool)
    np.logical_not(is_separator[block.data], out=inside[:n])
    before = np.empty(n + 1, bool)
    before[0] = False
    before[1:] = inside[:-1]
    firsts = block.offsets[:-1]
    after_cut = before.copy()
    after_cut[firsts] = False
    starts = np.flatnonzero(inside & ~after_cut)
    # A word ends before a separator or before the next row's first byte.
    following = inside.copy()
    following[firsts] = False
    ends = np.flatnonzero(before & ~following)
    bounds = np.searchsorted(starts, block.offsets)
    rows = np.repeat(np.arange(len(block)), np.diff(bounds))
    return starts, ends, rows, bounds


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits (the constants of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


STEP = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


#: Bytes hashed at a time; powers up to here are kept.
CHUNK_BYTES = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p, out=p))
    return out[0], out[1]


_KEPT_POWERS = _powers(CHUNK_BYTES + 1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span's bytes, alike wherever the bytes stand; spans in order, a chunk of the bytes at a time.

    A span longer than a chunk makes a chunk of its own, so extra memory is that of the longest word, not of the text.
    """
    out = np.empty(len(starts), np.uint64)
    lo = 0
    while lo < len(starts):
        first = int(starts[lo])
        hi = max(lo + 1, int(np.searchsorted(ends, first + CHUNK_BYTES, side="right")))
        n = int(ends[hi - 1]) - first
        up, down = _KEPT_POWERS if n <= CHUNK_BYTES else _powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data[first : first + n]] * up[:n], out=sums[1:])
        s, e = starts[lo:hi] - first, ends[lo:hi] - first
        out[lo:hi] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64))
        lo = hi
    return out


#: Different constants to keep kinds of hashed terms apart.
SALTS = mix(np.arange(16, dtype=np.uint64) * STEP)


def occurrences(hashes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """How often each value has come before within its row."""
    key = mix(hashes + rows.astype(np.uint64) * STEP)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.ones(len(key), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    at = np.arange(len(key))
    nth = np.empty(len(key), np.int64)
    nth[order] = at - np.maximum.accumulate(np.where(new, at, 0))
    return nth


def gram_hashes(hashes: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words within a row, and the index of each one's first word."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    for j in range(k):
        total = (total + hashes[j : n + j]) * np.uint64(_BASE)
    first = np.flatnonzero(rows[:n] == rows[k - 1 :])
    return mix(total[first] + np.uint64(k)), first
