"""Texts inside a task as flat arrays: bytes, words, characters.

A task sees Arrow batches of rows. ``text_blocks`` cuts a batch into runs of rows of a few
megabytes and hands each out as one byte array with row offsets, so all later steps are array
operations over whole words and whole texts; a text longer than the limit is a block of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 2 << 20
# The word separators of all contracts, bytes 0x20 and 0x09-0x0D.
SPACES = b" \t\n\x0b\x0c\r"
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def text_blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets of the rows in them); null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if n == 0:
        return
    _, off_buf, data_buf = column.buffers()
    offs = np.frombuffer(off_buf, np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(data_buf, np.uint8) if data_buf is not None and data_buf.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, "right")) - 1)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


@cache
def _space_table() -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(SPACES)] = True
    return t


@cache
def lower_table() -> np.ndarray:
    """Byte to byte, A-Z to a-z."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def runs(member: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross a row: starts, ends, and row offsets into the runs."""
    n = len(member)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inner = offs[(offs > 0) & (offs < n)]
    first = member.copy()
    first[1:] &= ~member[:-1]
    first[inner] = member[inner]
    last = member.copy()
    last[:-1] &= ~member[1:]
    last[inner - 1] = member[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between separators: starts, ends, and row offsets into the words."""
    return runs(~_space_table()[data], offs)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (in place where possible)."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@cache
def value_table(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed) * np.uint64(1000)) * _GOLD)


_powers = {}


def powers(n: int) -> np.ndarray:
    """Powers of an odd multiplier, as many as asked for, kept between calls."""
    have = _powers.get("p")
    if have is None or len(have) < n:
        with np.errstate(over="ignore"):
            m = np.full(max(n, 256), 0x5851F42D4C957F2D | 1, np.uint64)
            m[0] = 1
            have = np.multiply.accumulate(m)
        if n <= 1 << 16:
            _powers["p"] = have
    return have


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hash of values[start:end] for every run; values are bytes or small code points."""
    if len(starts) == 0:
        return np.zeros(0, np.uint64)
    lens = ends - starts
    at = np.cumsum(lens) - lens
    pos = np.arange(int(lens.sum())) - np.repeat(at, lens)
    own = values[pos + np.repeat(starts, lens)]
    with np.errstate(over="ignore"):
        v = value_table(seed)[own] if own.dtype == np.uint8 else mix((own.astype(np.uint64) + np.uint64(seed * 1000 + 1)) * _GOLD)
        v = v * powers(int(lens.max()))[pos]
        return mix(np.add.reduceat(v, at) + lens.astype(np.uint64) * _GOLD)


def combine(*hashes: np.ndarray) -> np.ndarray:
    """Order-sensitive hash of equally long hash arrays, element by element."""
    with np.errstate(over="ignore"):
        out = mix(hashes[0] + _GOLD)
        for h in hashes[1:]:
            out = mix(out * np.uint64(0xD1342543DE82EF95) + h)
        return out


def ranges(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """All indices start, start+1, ... of several runs, one after the other."""
    lens = lens.astype(np.int64)
    if len(lens) == 0:
        return np.zeros(0, np.int64)
    return np.arange(int(lens.sum())) + np.repeat(starts - (np.cumsum(lens) - lens), lens)


def code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of whole texts to code points, with the row offsets in code points."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == len(data):
        return points, offs
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return points, lead[offs]


def per_row(row_offs: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sum of the values of every row, zero for rows without any."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), values.dtype if values.dtype.kind != "b" else np.int64)
    np.cumsum(values, axis=0, out=total[1:])
    return total[row_offs[1:]] - total[row_offs[:-1]]
