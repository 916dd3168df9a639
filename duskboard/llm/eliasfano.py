"""Elias-Fano coding of an ascending sequence, with selection by sampled positions.

A value's low bits are stored as they are; its high part as a one in a bit vector, at the high part plus
the value's rank. That takes about two bits and the low bits per value. The place of every 256th one is
kept, so one value is read from a few bytes behind it.
"""

from __future__ import annotations

import struct

import numpy as np

EVERY = 256


class EliasFano:
    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        """values: unsigned 64-bit, ascending, equal ones allowed."""
        values = np.ascontiguousarray(values, dtype="<u8")
        n = len(values)
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        low = values & np.uint64((1 << bits) - 1)
        spread = (low[:, None] >> np.arange(bits, dtype="<u8")) & np.uint64(1)
        ones = (values >> np.uint64(bits)) + np.arange(n, dtype="<u8")
        vector = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=bool)
        vector[ones.astype("<i8")] = True
        return cls(n, bits, np.packbits(spread.astype(bool).ravel(), bitorder="little"), np.packbits(vector, bitorder="little"), ones[::EVERY].astype("<u4"))

    def to_bytes(self) -> bytes:
        parts = [x.tobytes() for x in (self.low, self.high, self.samples)]
        return struct.pack("<QB3Q", self.n, self.low_bits, *map(len, parts)) + b"".join(parts)

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        n, bits, *sizes = struct.unpack_from("<QB3Q", data)
        at, parts = struct.calcsize("<QB3Q"), []
        for size, kind in zip(sizes, ("u1", "u1", "<u4"), strict=True):
            parts.append(np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
            at += size
        return cls(n, bits, *parts)

    def _low(self, i: int) -> int:
        start = i * self.low_bits
        raw = int.from_bytes(self.low[start // 8 : (start + self.low_bits + 7) // 8].tobytes(), "little")
        return raw >> start % 8 & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The value with rank i, read from the sample before it onward."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, need = int(self.samples[i // EVERY]), i % EVERY
        byte, skip = at // 8, at % 8
        seen = 0
        while True:
            bits = int(self.high[byte]) >> skip << skip
            here = bits.bit_count()
            if seen + here > need:
                for _ in range(need - seen):
                    bits &= bits - 1
                place = byte * 8 + (bits & -bits).bit_length() - 1
                return (place - i) << self.low_bits | self._low(i)
            seen, byte, skip = seen + here, byte + 1, 0

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype("<u8")
        high = (ones - np.arange(self.n, dtype="<u8")) << np.uint64(self.low_bits)
        spread = np.unpackbits(self.low, count=self.n * self.low_bits, bitorder="little").reshape(self.n, self.low_bits)
        return high | (spread.astype("<u8") << np.arange(self.low_bits, dtype="<u8")).sum(axis=1, dtype="<u8")
