"""Texts of an Arrow batch as flat numpy arrays: words, word hashes, window hashes.

A word is a longest run of bytes other than the six ASCII white-space bytes, which on UTF-8 text is the
pattern ``[^\\x20\\x09-\\x0D]+``.  All functions work on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LANE_MASK = np.array([(1 << (8 * n)) - 1 for n in range(8)] + [2**64 - 1], np.uint64)
_MUL_A, _MUL_B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass
class Words:
    """Words of many texts: text ``i`` has the words ``first[i]:first[i + 1]``."""

    data: np.ndarray  # bytes of all texts, one after the other
    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray

    @property
    def text_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def bounded(batches: Iterator[pa.RecordBatch], column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts in ``column`` have about ``most`` bytes, or one row."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        cuts = np.flatnonzero(np.diff(ends // most)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def text_bytes(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and text offsets of a string column; a null is an empty text."""
    array = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], array.type)
    array = array.cast(pa.large_string()).fill_null("")
    if not len(array):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64)[array.offset : array.offset + len(array) + 1]
    data = np.frombuffer(array.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def split_words(column: pa.ChunkedArray | pa.Array) -> Words:
    data, offsets = text_bytes(column)
    inside = ~_SPACE[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    begin[edges] = inside[edges]  # a text never continues the word of the text before it
    end[edges - 1] = inside[edges - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, np.searchsorted(starts, offsets), starts, ends)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= _MUL_A
    h ^= h >> np.uint64(27)
    h *= _MUL_B
    h ^= h >> np.uint64(31)
    return h


def hash_words(words: Words, seed: int) -> np.ndarray:
    """A 64-bit hash of each word, from eight bytes at a time."""
    padded = np.concatenate([words.data, np.zeros(8, np.uint8)])
    lanes = np.ndarray((len(words.data) + 1,), np.uint64, buffer=padded, strides=(1,))
    left = words.ends - words.starts
    h = mix(left.astype(np.uint64) * _STEP + np.uint64(seed))
    at, active = words.starts, None
    while len(left):
        lane = lanes[at] & _LANE_MASK[np.minimum(left, 8)]
        if active is None:
            h = mix((h ^ lane) + _STEP)
        else:
            h[active] = mix((h[active] ^ lane) + _STEP)
        more = np.flatnonzero(left > 8)
        active = more if active is None else active[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def window_hashes(word_hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``width`` words inside one text, and the word each window starts at."""
    n = len(word_hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h *= _STEP
        h += word_hashes[k : k + n]
    fits = np.ones(n, bool)
    for back in range(1, width):  # the last words of a text start no window
        at = first[1:] - back
        at = at[(at >= first[:-1]) & (at < n)]
        fits[at] = False
    starts = np.flatnonzero(fits)
    return mix(h[starts]), starts


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set in each text."""
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]
