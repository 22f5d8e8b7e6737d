"""Elias-Fano codes of rising integers: two bits and the low bits for each, with sampled select for single reads."""

from __future__ import annotations

import struct

import numpy as np

HEADER = "<QQB"
#: Every so many ones of the upper bits has its place stored.
SAMPLE = 64


def encode(values: np.ndarray) -> bytes:
    """Non-negative integers in rising order (equal ones allowed) as bytes."""
    values = np.asarray(values, dtype=np.uint64)
    n = len(values)
    top = int(values[-1]) if n else 0
    low = max(0, (top // n).bit_length() - 1) if n else 0
    shifts = np.arange(low, dtype=np.uint64)
    lower = np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
    places = (values >> np.uint64(low)).astype(np.int64) + np.arange(n)
    upper = np.zeros(int(places[-1]) + 1 if n else 0, dtype=np.uint8)
    upper[places] = 1
    samples = places[::SAMPLE].astype("<u4" if len(upper) < 1 << 32 else "<u8")
    packed = np.packbits(upper, bitorder="little")
    wide = samples.dtype.itemsize
    sizes = struct.pack(HEADER, len(lower), len(packed), wide)
    return struct.pack(HEADER, n, top, low) + sizes + lower.tobytes() + packed.tobytes() + samples.tobytes()


class EliasFano:
    """Reads single values or many by select, or all of them."""

    def __init__(self, data: bytes) -> None:
        self.n, self.top, self.low = struct.unpack_from(HEADER, data)
        n_lower, n_upper, wide = struct.unpack_from(HEADER, data, struct.calcsize(HEADER))
        at = 2 * struct.calcsize(HEADER)
        self.lower = np.frombuffer(data, np.uint8, n_lower, at)
        self.upper = np.frombuffer(data, np.uint8, n_upper, at + n_lower)
        n_samples = (self.n + SAMPLE - 1) // SAMPLE
        self.samples = np.frombuffer(data, f"<u{wide}", n_samples, at + n_lower + n_upper)

    def __len__(self) -> int:
        return self.n

    def select(self, i: int) -> int:
        """The place of the i-th one of the upper bits: from the sample before it, by counting bits of bytes."""
        place = int(self.samples[i // SAMPLE])
        left = i % SAMPLE
        byte = place >> 3
        bits = int(self.upper[byte]) >> (place & 7) << (place & 7)
        while left >= bits.bit_count():
            left -= bits.bit_count()
            byte += 1
            bits = int(self.upper[byte])
        for _ in range(left):
            bits &= bits - 1
        return 8 * byte + (bits & -bits).bit_length() - 1

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        first = i * self.low
        window = int.from_bytes(self.lower[first >> 3 : (first + self.low + 7) >> 3].tobytes(), "little")
        return (self.select(i) - i) << self.low | window >> (first & 7) & ((1 << self.low) - 1)

    def at(self, places: np.ndarray) -> np.ndarray:
        """The values at many places: ones are counted by bytes once, then each place selects its byte and a bit of it."""
        places = np.asarray(places, dtype=np.int64)
        if len(places) and not 0 <= places.min() <= places.max() < self.n:
            raise IndexError(places)
        ones = np.bitwise_count(self.upper).astype(np.int64)
        upto = np.cumsum(ones)
        byte = np.searchsorted(upto, places, "right")
        left = places - (upto[byte] - ones[byte])
        seen = np.cumsum(np.unpackbits(self.upper[byte][:, None], axis=1, bitorder="little"), axis=1)
        upper = 8 * byte + (seen > left[:, None]).argmax(axis=1) - places
        bit = places[:, None] * self.low + np.arange(self.low)
        bits = (self.lower[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1
        lower = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return (upper.astype(np.uint64) << np.uint64(self.low)) | lower.astype(np.uint64)

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.upper, bitorder="little"))
        bits = np.unpackbits(self.lower, count=self.n * self.low, bitorder="little").reshape(self.n, self.low)
        lower = bits.astype(np.uint64) @ (np.uint64(1) << np.arange(self.low, dtype=np.uint64))
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low)) | lower.astype(np.uint64)
