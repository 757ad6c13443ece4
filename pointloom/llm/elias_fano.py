"""Elias-Fano coding of non-decreasing integers, with a select structure."""

from __future__ import annotations

import struct

import numpy as np

#: One sampled position per this many values.
STEP = 256
_HEAD = "<QQB7xQQQ"
_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(values: np.ndarray) -> bytes:
    """Low bits packed side by side, high bits in unary, and a 32-bit sample every ``STEP`` values.

    About ``2 + log2(largest / count)`` bits a value, and an eighth of a bit for samples.
    """
    values = np.asarray(values, np.uint64)
    n = len(values)
    if n and (values[1:] < values[:-1]).any():
        raise ValueError("values must not decrease")
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    low_bits = ((values[:, None] >> np.arange(low, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8) if low else np.empty(0, np.uint8)
    ones = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    parts = [np.packbits(low_bits.ravel(), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes()]
    if n and ones[-1] >> 32:
        raise ValueError("too many high bits for 32-bit samples: write smaller files")
    parts.append(ones[::STEP].astype("<u4").tobytes())
    return struct.pack(_HEAD, n, top, low, *map(len, parts)) + b"".join(parts)


class EliasFano:
    """Values by position, straight from the coded bytes."""

    def __init__(self, data: bytes):
        self.n, self.top, self.low, a, b, c = struct.unpack_from(_HEAD, data)
        at = struct.calcsize(_HEAD)
        self.low_bytes = np.frombuffer(data, np.uint8, a, at)
        self.high = np.frombuffer(data, np.uint8, b, at + a)
        self.samples = np.frombuffer(data, "<u4", c // 4, at + a + b)
        self.size = at + a + b + c

    def _low(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.uint64)
        for k in range(self.low):
            bit = i * self.low + k
            out |= ((self.low_bytes[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(k)
        return out

    def __getitem__(self, i: int) -> int:
        """select: from the sampled byte on, count ones until the i-th."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(self.samples[i // STEP])
        byte, left = at >> 3, i % STEP
        bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        bits = bits[bits >= (at & 7)]
        while left >= len(bits):
            left -= len(bits)
            byte += 1
            while left >= _ONES[self.high[byte]]:
                left -= int(_ONES[self.high[byte]])
                byte += 1
            bits = np.flatnonzero(np.unpackbits(self.high[byte : byte + 1], bitorder="little"))
        one = byte * 8 + int(bits[left])
        return ((one - i) << self.low) | int(self._low(np.array([i]))[0])

    def block(self, first: int, last: int) -> np.ndarray:
        """select for positions ``first`` to ``last`` (exclusive): only the bytes between their samples are looked at."""
        first, last = max(first, 0), min(last, self.n)
        if first >= last:
            return np.empty(0, np.uint64)
        at, after = int(self.samples[first // STEP]), (last - 1) // STEP + 1
        end = int(self.samples[after]) if after < len(self.samples) else 8 * len(self.high)
        ones = np.flatnonzero(np.unpackbits(self.high[at >> 3 : (end >> 3) + 1], bitorder="little")) + (at & ~7)
        ones = ones[np.searchsorted(ones, at) + first % STEP :][: last - first]
        i = np.arange(first, last)
        return ((ones - i).astype(np.uint64) << np.uint64(self.low)) | self._low(i)
