"""Columnar text blocks: whole Arrow string columns as one byte array plus offsets.

Every Python-side operator here works on *blocks*: some rows' texts laid end to end in a uint8
array.  Words, shingles and their hashes are then found with array operations over the block and
never with a loop over characters.  A block holds at most ``BLOCK_BYTES`` unless a single text is
longer than that, so memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

U64 = np.uint64
_ODD = U64(0x9E3779B97F4A7C15)


def _ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = _ascii_lower()
#: The white space of the word rules: 0x20 and 0x09 to 0x0D.
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


@dataclass
class Block:
    """Rows ``first`` to ``first + len(self)`` of a batch; text i is ``data[offsets[i]:offsets[i + 1]]``."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def blocks(column: pa.Array | pa.ChunkedArray, limit: int = BLOCK_BYTES, rows: int = 1 << 30) -> Iterator[Block]:
    """Cut a string column into blocks of at most ``rows`` texts; a null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    first = 0
    while first < len(column):
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), first + rows, len(column))
        begin, end = offsets[first], offsets[last]
        yield Block(first, data[begin:end], offsets[first : last + 1] - begin)
        first = last


def binary_array(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Slices that follow each other in ``data`` as an Arrow array, without copying."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1,
        [None, pa.py_buffer(np.ascontiguousarray(offsets, dtype=np.int64)), pa.py_buffer(np.ascontiguousarray(data))],
    )


@dataclass
class Words:
    """Word w of the block is ``data[start[w]:end[w]]`` and belongs to text ``doc[w]``."""

    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray  #: words of text i are first[i] to first[i + 1]


def words(block: Block, is_space: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs without white space; a run ends where its text ends."""
    solid = ~is_space[block.data]
    n = len(solid)
    begins, ends = solid.copy(), solid.copy()
    if n:
        begins[1:] &= ~solid[:-1]
        ends[:-1] &= ~solid[1:]
        inner = block.offsets[1:-1]
        inner = inner[(inner > 0) & (inner < n)]
        begins[inner] = solid[inner]
        ends[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, block.offsets)
    doc = np.repeat(np.arange(len(block)), np.diff(first))
    return Words(start, end, doc, first)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64-bit words (shift, xor and multiply rounds)."""
    x = x.copy()
    with np.errstate(over="ignore"):
        x ^= x >> U64(30)
        x *= U64(0xBF58476D1CE4E5B9)
        x ^= x >> U64(27)
        x *= U64(0x94D049BB133111EB)
        x ^= x >> U64(31)
    return x


_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers 0 to n and their inverses modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, BLOCK_BYTES + 1)
        base = int(_ODD) | 1
        inverse = pow(base, -1, 1 << 64)
        with np.errstate(over="ignore"):
            up, down = np.full(size, base, dtype=U64), np.full(size, inverse, dtype=U64)
            up[0] = down[0] = 1
            _POWERS[:] = [np.multiply.accumulate(up), np.multiply.accumulate(down)]
    return _POWERS[0], _POWERS[1]


_BYTE_CODE = mix(np.arange(1, 257, dtype=U64) * _ODD)


def slice_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each slice, equal for equal bytes wherever they stand (prefix sums of a polynomial)."""
    up, down = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, dtype=U64)
        np.cumsum(_BYTE_CODE[data] * up[: len(data)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(U64))


def gram_hashes(word: np.ndarray, size: int) -> np.ndarray:
    """The hash of ``size`` consecutive words for each place where such a run can begin in the block."""
    n = len(word) - size + 1
    if n <= 0:
        return np.empty(0, dtype=U64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, dtype=U64)
        factor = int(_ODD)
        for k in range(size):
            total += word[k : k + n] * U64(factor)
            factor = factor * 0xD1342543DE82EF95 + 2 & (1 << 64) - 1 | 1
        return mix(total)


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The concatenation of start[i], start[i] + 1, ... with length[i] numbers each."""
    total = int(length.sum())
    before = np.cumsum(length) - length
    return np.repeat(start - before, length) + np.arange(total)


def distinct_sorted(x: np.ndarray) -> np.ndarray:
    """The distinct values in ascending order, by one sort."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x
