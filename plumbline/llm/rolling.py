"""Vectorised hashes of words and of windows of words over the bytes of a text."""

from __future__ import annotations

import numpy as np

BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
#: Powers with smaller exponents are kept in a table.
KEPT = 1 << 17


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tables(dict):
    """The first powers of each number asked for; a task that it is sent to gets it empty."""

    def __missing__(self, of: int) -> np.ndarray:
        self[of] = _powers(of, KEPT - 1)
        self[of].flags.writeable = False
        return self[of]

    def __reduce__(self) -> tuple:
        return Tables, ()


TABLES = Tables()


def powers(of: np.uint64, n: int) -> np.ndarray:
    """The powers 0 to n of an odd number modulo 2**64, not to be written to."""
    return TABLES[int(of)][: n + 1] if n < KEPT else _powers(int(of), n)


def _powers(of: int, n: int) -> np.ndarray:
    out = np.full(n + 1, of, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a text."""
    letters = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = (letters != 0x20) & (letters - np.uint8(9) > 4)  # 9 to 13 are blank; what is below 9 wraps around
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, moved to a common origin and mixed."""
    letters = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(letters * powers(BASE, len(data))[:-1], out=total[1:])
    back = powers(INVERSE, len(data))[starts]
    return mix((total[ends] - total[starts]) * back + (ends - starts).astype(np.uint64))


def sums(hashes: np.ndarray) -> np.ndarray:
    """The polynomial of the words before each place."""
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes))[:-1], out=total[1:])
    return total


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each window of so many words; none if there are fewer."""
    return windows(sums(hashes), size)


def windows(total: np.ndarray, size: int) -> np.ndarray:
    """The same from ``sums``."""
    n = len(total) - size
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    return mix((total[size:] - total[:-size]) * powers(INVERSE, n - 1))
