"""Words of whole Arrow string batches as numpy arrays, without a loop over rows.

A word is a run of bytes other than space and 0x09 to 0x0D, which in UTF-8 is the same as a
run of such characters. Its hash is a polynomial over its bytes modulo 2**64 that is then
mixed, so that sums of word hashes behave as independent 64-bit numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Bytes of text that are worked on at once; one longer text is worked on alone.
CHUNK_BYTES = 2_000_000

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, _U)
    out[0] = 1
    size = 1
    step = base & 0xFFFFFFFFFFFFFFFF
    while size < n:  # doubling: powers[size:2*size] = powers[:size] * base**size
        k = min(size, n - size)
        out[size : size + k] = out[:k] * _U(step)
        size += k
        step = step * step & 0xFFFFFFFFFFFFFFFF
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which each input bit changes half of the output bits."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


@dataclass
class Words:
    """Words of the texts of a chunk, in order.

    ``row`` is the row of each word, ``start`` and ``end`` its bytes in ``data``, ``hash`` its
    hash; ``first`` holds, per row and one past the end, the index of the row's first word.
    """

    data: np.ndarray
    row: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    def position(self) -> np.ndarray:
        """The place of each word in its text, from 0."""
        return np.arange(len(self.row)) - self.first[self.row]

    def left(self) -> np.ndarray:
        """The number of words from each word to the end of its text, itself included."""
        return self.first[self.row + 1] - np.arange(len(self.row))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def split_words(column: pa.Array, lower_ascii: bool = False) -> Words:
    """All words of a column of texts."""
    data, offsets = text_buffer(column)
    n, rows = len(data), len(offsets) - 1
    if not n:
        e = np.empty(0, np.int64)
        return Words(data, e, e, e, np.empty(0, _U), np.zeros(rows + 1, np.int64))
    if lower_ascii:
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
    inside = ~_SPACE[data]
    begins, ends = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True  # words end where texts end
    begins[:n] = inside
    begins[1:n] &= ~inside[:-1] | edge[1:n]
    ends[1:] = inside
    ends[1:n] &= ~inside[1:] | edge[1:n]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends)
    row = np.searchsorted(offsets, start, side="right") - 1
    power = _powers(_BASE, n + 1)
    total = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=total[1:])
    inverse = _powers(_INVERSE, n + 1)
    hashes = mix((total[end] - total[start]) * inverse[start])
    first = np.searchsorted(row, np.arange(rows + 1))
    return Words(data, row, start, end, hashes, first)


def gram_hashes(words: Words, n: int) -> np.ndarray:
    """Hash of the ``n`` words that start at each word; meaningless where fewer are left."""
    out = np.zeros(len(words.hash), _U)
    for i in range(n):
        k = len(out) - i
        if k <= 0:
            break
        out[:k] += mix(words.hash[i:] + _U(0xD1B54A32D192ED03 * (i + 1) & 0xFFFFFFFFFFFFFFFF))
    return mix(out)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    _, offsets = text_buffer(column)
    at = 0
    while at < len(column):
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(max(to, at + 1), len(column))
        yield batch.slice(at, to - at)
        at = to
