"""Vectorised word splitting and hashing over the UTF-8 bytes of Arrow string columns.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Everything
works on slices of a few MB, so memory doesn't follow the size of a batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer document is a slice of its own.
SLICE = 2 << 20

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: Also every ASCII character that is no letter or digit.
_PUNCTUATION = _SPACE.copy()
_PUNCTUATION[[i for i in range(128) if not chr(i).isalnum()]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _power_tables(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, SLICE)
        inverse = pow(base, -1, 1 << 64)
        have = tuple(np.concatenate(([_U(1)], np.cumprod(np.full(size - 1, b, _U), dtype=_U))) for b in (base, inverse))
        if size <= 4 * SLICE:
            _powers[base] = have
    return have


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """Strings without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    return column.cast(pa.string()) if not pa.types.is_string(column.type) else column


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets of the rows in them) for runs of rows of about `size` bytes."""
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        end = min(end, len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def _cuts(data: np.ndarray, outside: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of about SLICE bytes that end after a byte between words, so memory follows SLICE and not the text; a longer word stays whole."""
    at = 0
    while at < len(data):
        end = at
        while True:
            end = min(len(data), end + SLICE)
            if end == len(data):
                break
            between = np.flatnonzero(outside[data[max(at, end - SLICE) : end]])
            if len(between):
                end = max(at, end - SLICE) + int(between[-1]) + 1
                break
        yield at, end
        at = end


def _words(data: np.ndarray, edge: np.ndarray, base: int, lower: bool, outside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, hashes) of the words of a piece that starts at `base`; rows end at `edge`."""
    if lower:
        data = _LOWER[data]
    inside = ~outside[data]
    n = len(data)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    first[edge] |= inside[edge]
    last[edge - 1] |= inside[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    power, inverse = _power_tables(n + 1, _BASE)
    sums = np.zeros(n + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * power[:n], out=sums[1:])
    return starts + base, ends + base, mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(_U))


class Words:
    """The words of a slice: byte positions, hashes, and the range of each row.

    lower: A-Z as a-z. letters: ASCII punctuation parts words too.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, letters: bool = False):
        outside = _PUNCTUATION if letters else _SPACE
        edge = offsets[1:-1]
        edge = edge[(edge > 0) & (edge < len(data))]
        parts = [_words(data[a:b], edge[(edge > a) & (edge < b)] - a, a, lower, outside) for a, b in _cuts(data, outside)]
        self.starts, self.ends, self.hashes = (np.concatenate(x) if len(parts) != 1 else x[0] for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U))
        self.rows = np.searchsorted(self.starts, offsets)

    def of(self, row: int) -> np.ndarray:
        return self.hashes[self.rows[row] : self.rows[row + 1]]


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive words."""
    if len(hashes) < n:
        return np.zeros(0, _U)
    if n <= 16:
        out = np.zeros(len(hashes) - n + 1, _U)
        for i in range(n):
            out = out * _U(_BASE) + hashes[i : i + len(out)]
        return mix(out)
    first = np.arange(len(hashes) - n + 1)
    return stretches(hashes, first, first + n)


def stretches(hashes: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words [first, end) for each pair of positions."""
    power, inverse = _power_tables(len(hashes) + 1, _BASE)
    sums = np.zeros(len(hashes) + 1, _U)
    np.cumsum(hashes * power[: len(hashes)], out=sums[1:])
    return mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(_U))
