"""Elias-Fano code of a non-decreasing sequence of whole numbers.

A value is split into low bits, kept packed, and a high part, kept as the place of a one in a bit array: the i-th value
has its one at ``high + i``. That takes about ``2 + log2(universe / n)`` bits a value. Every 64th place is sampled, so
``select`` reads one value by looking at a few bytes; there is no table of 64-bit offsets.
"""

from __future__ import annotations

import struct

import numpy as np

SAMPLE = 64
HEADER = "<IQBI"


def encode(values: np.ndarray) -> bytes:
    """The code of ``values``, which must not decrease."""
    values = np.asarray(values, dtype=np.uint64)
    n, universe = len(values), int(values[-1]) if len(values) else 0
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    bits = (values[:, None] >> np.arange(low_bits, dtype=np.uint64)[None, :]) & np.uint64(1)
    low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    places = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros((universe >> low_bits) + n + 1, dtype=np.uint8)
    high[places] = 1
    packed = np.packbits(high, bitorder="little").tobytes()
    samples = places[::SAMPLE].astype("<u4").tobytes()
    return struct.pack(HEADER, n, universe, low_bits, len(packed)) + samples + low + packed


class EliasFano:
    """Reads a code without unpacking it."""

    def __init__(self, code: bytes) -> None:
        self.n, self.universe, self.low_bits, high_size = struct.unpack_from(HEADER, code)
        at = struct.calcsize(HEADER)
        self.samples = np.frombuffer(code, "<u4", -(-self.n // SAMPLE), at)
        at += self.samples.nbytes
        low_size = -(-self.n * self.low_bits // 8)
        self.low = np.frombuffer(code, np.uint8, low_size, at)
        self.high = np.frombuffer(code, np.uint8, high_size, at + low_size)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The i-th value."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        start, left, width = int(self.samples[i // SAMPLE]), i % SAMPLE, 16
        byte = start // 8
        while True:  # ones after the sampled place, in windows of bytes
            window = np.unpackbits(self.high[byte : byte + width], bitorder="little")
            ones = np.flatnonzero(window[start - 8 * byte :])
            if len(ones) > left:
                place = start + int(ones[left])
                break
            width *= 2
        return ((place - i) << self.low_bits) | self._low(i)

    def _low(self, i: int) -> int:
        first = i * self.low_bits
        last = first + self.low_bits
        word = int.from_bytes(self.low[first // 8 : -(-last // 8)].tobytes(), "little")
        return (word >> (first % 8)) & ((1 << self.low_bits) - 1)

    def values(self) -> np.ndarray:
        """All values."""
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.uint64)
        high = places - np.arange(self.n, dtype=np.uint64)
        bits = np.unpackbits(self.low, bitorder="little", count=self.n * self.low_bits).reshape(self.n, self.low_bits)
        low = (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (high << np.uint64(self.low_bits)) | low
