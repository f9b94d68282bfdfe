"""Vectorised word and shingle hashing over Arrow text columns.

A chunk is a run of rows whose texts total half a MB (a longer text is a chunk
of its own), so memory depends on the longest text, not on the batch.
Words are runs of bytes other than space and \\t..\\r; A-Z count as a-z.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 19
U = np.uint64
#: Multiplier of the polynomial word hash and its inverse modulo 2**64.
MUL = 0x9E3779B97F4A7C15
INV = pow(MUL, -1, 1 << 64)

_A, _TAB = np.uint8(65), np.uint8(9)
_space = np.zeros(256, dtype=bool)
_space[[32, 9, 10, 11, 12, 13]] = True


@dataclass
class Chunk:
    first: int  # row of the batch
    last: int
    data: np.ndarray  # uint8, all texts one after the other
    ends: np.ndarray  # byte offset after each text


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """The rows of a string column; a null counts as an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    column = column.fill_null("") if column.null_count else column
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield Chunk(first, last, data[offsets[first] : offsets[last]], offsets[first + 1 : last + 1] - offsets[first])
        first = last


class Powers:
    """MUL**i and INV**i, grown as needed."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, U)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", MUL), ("down", INV)):
                p = np.full(size, base, U)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up, self.down


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads 64-bit values (the finaliser of splitmix64)."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


@dataclass
class Words:
    start: np.ndarray  # byte offsets into the chunk
    end: np.ndarray
    row: np.ndarray  # row within the chunk
    hash: np.ndarray


def words(chunk: Chunk, powers: Powers, lower: bool = True, hashed: bool = True) -> Words:
    b = chunk.data
    n = len(b)
    if not n:
        e = np.zeros(0, np.int64)
        return Words(e, e, e, np.zeros(0, U))
    gap = (b == 32) | (b - _TAB < 5)
    start_at = ~gap
    start_at[1:] &= gap[:-1]
    stop_at = ~gap
    stop_at[:-1] &= gap[1:]
    starts_of_rows = np.concatenate(([0], chunk.ends[:-1]))
    inner = starts_of_rows[(starts_of_rows > 0) & (starts_of_rows < n)]  # a text ends a word
    start_at[inner] |= ~gap[inner]
    stop_at[inner - 1] |= ~gap[inner - 1]
    start, end = np.flatnonzero(start_at), np.flatnonzero(stop_at) + 1
    row = np.repeat(np.arange(len(chunk.ends)), np.diff(np.searchsorted(start, chunk.ends), prepend=0))
    if not hashed:
        return Words(start, end, row, np.zeros(0, U))
    up, down = powers.upto(n + 1)
    total = np.zeros(n + 1, U)
    if lower:
        b = b + ((b - _A < 26).view(np.uint8) << 5)
    np.multiply(b, up[:n], out=total[1:])
    total[1:] += up[:n]
    np.cumsum(total[1:], out=total[1:])
    return Words(start, end, row, mix((total[end] - total[start]) * down[start] + (end - start).astype(U)))


def shingles(w: Words, rows: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each row's distinct runs of `size` words, and where each row's begin (rows + 1 offsets).

    A row with fewer words has its whole sequence as its only shingle; one without words has none.
    """
    per_row = np.bincount(w.row, minlength=rows) if len(w.row) else np.zeros(rows, np.int64)
    begin = np.concatenate(([0], np.cumsum(per_row)))
    n = len(w.hash)
    out, owner = [], []
    if n >= size:
        k = n - size + 1
        same = w.row[:k] == w.row[size - 1 :]
        h = np.zeros(k, U)
        for j in range(size):
            h = h * U(MUL) + w.hash[j : j + k]
        out.append(mix(h[same]))
        owner.append(w.row[:k][same])
    short = np.flatnonzero((per_row > 0) & (per_row < size))
    if len(short):
        h = np.full(len(short), 0x5851F42D4C957F2D, U)
        for j in range(size - 1):
            has = per_row[short] > j
            h[has] = h[has] * U(MUL) + w.hash[begin[short[has]] + j]
        out.append(mix(h + per_row[short].astype(U)))
        owner.append(short)
    if not out:
        return np.zeros(0, U), np.zeros(rows + 1, np.int64)
    h, r = np.concatenate(out), np.concatenate(owner)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[first], r[first]
    return h, np.concatenate(([0], np.cumsum(np.bincount(r, minlength=rows))))
