"""Rising integer sequences in near-minimal space, by Elias-Fano coding.

Of n values below u every value keeps its low floor(log2(u / n)) bits as they are; the high part is
written in unary, one set bit per value, n + u / 2^low bits at most. So a value takes about
2 + log2(u / n) bits. Value i is found by select: the position of set bit i, less i, is its high part.
Every ``STEP``-th position is kept, as 32-bit numbers where they do, so a select scans the few bytes between two of them.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 512
_HEAD = struct.Struct("<QqBBQ")


class EliasFano:
    """A rising sequence of integers of at most 63 bits, stored from its first value on."""

    def __init__(self, n: int, base: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.base, self.low_bits = n, base, low_bits
        self.low, self.high, self.samples = low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n = len(values)
        if n and (np.diff(values) < 0).any():
            raise ValueError("values fall")
        base = int(values[0]) if n else 0
        if n and int(values[-1]) - base >= 1 << 63:
            raise ValueError("values are more than 63 bits apart")
        rest = (values - base).astype(np.uint64)
        low_bits = max(0, (int(rest[-1]) // n).bit_length() - 1) if n else 0
        bits = (rest[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1) if low_bits else np.zeros((n, 0), np.uint64)
        at = (rest >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        samples = at[::STEP]
        return cls(n, base, low_bits, np.packbits(bits.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), samples.astype("<u4" if len(high) < 1 << 32 else "<u8"))

    def select(self, first: int, last: int) -> np.ndarray:
        """Values number ``first`` to ``last``, the last left out."""
        last = min(last, self.n)
        if first >= last:
            return np.zeros(0, np.int64)
        block, behind = first // STEP, -(-last // STEP)
        start = int(self.samples[block])
        end = int(self.samples[behind]) if behind < len(self.samples) else len(self.high) * 8
        ones = np.flatnonzero(np.unpackbits(self.high[start // 8 : -(-end // 8)], bitorder="little")) + start // 8 * 8
        ones = ones[np.searchsorted(ones, start) :]
        rank = np.arange(first, last)
        high = ones[rank - block * STEP] - rank
        a, b = first * self.low_bits, last * self.low_bits
        bits = np.unpackbits(self.low[a // 8 : -(-b // 8)], bitorder="little")[a % 8 : a % 8 + b - a].reshape(last - first, self.low_bits)
        low = bits.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64)) if self.low_bits else 0
        return ((high << self.low_bits) | low) + self.base

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        return int(self.select(i, i + 1)[0])

    def before(self, value: int) -> int:
        """How many values are at most ``value``: the place of the document that holds a token, plus one."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self[mid] <= value else (lo, mid)
        return lo

    def tobytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return _HEAD.pack(self.n, self.base, self.low_bits, self.samples.dtype.itemsize, len(parts[1])) + b"".join(parts)

    @classmethod
    def at(cls, data: bytes | memoryview, offset: int = 0) -> tuple[EliasFano, int]:
        """The sequence stored at an offset, read in place, and the offset behind it."""
        n, base, low_bits, width, n_high = _HEAD.unpack_from(data, offset)
        offset += _HEAD.size
        n_low, n_samples = -(-n * low_bits // 8), -(-n // STEP)
        low = np.frombuffer(data, np.uint8, n_low, offset)
        high = np.frombuffer(data, np.uint8, n_high, offset + n_low)
        samples = np.frombuffer(data, f"<u{width}", n_samples, offset + n_low + n_high)
        return cls(n, base, low_bits, low, high, samples), offset + n_low + n_high + n_samples * width
