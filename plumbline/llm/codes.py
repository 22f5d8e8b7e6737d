"""Vectors as short codes: for each part of a vector, the nearest entry of the part's codebook.

Entries are found by slicing and intersecting. For each dimension of a part the entries' coordinates are sorted, each with
a mask of the entries up to it. A first distance, to an entry that is near in one dimension, is a radius that the nearest
entry cannot exceed in any dimension; the entries of a range are the difference of two masks, and the masks of all
dimensions, ANDed, leave the few entries whose distances are computed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut
from plumbline.llm.vectors import sound, whole

PARTS = 16
#: Entries of a codebook, as many as a mask has bits at most.
ENTRIES = 64
ROUNDS = 2


@dataclass
class Slices:
    """A codebook (entries x dimensions) with, for each dimension, sorted coordinates and masks of the entries below."""

    book: np.ndarray

    def __post_init__(self) -> None:
        if len(self.book) > 64:
            raise ValueError("a mask has 64 bits")
        self.order = np.argsort(self.book, axis=0, kind="stable").T
        self.sorted = np.take_along_axis(self.book.T, self.order, axis=1)
        bits = np.uint64(1) << self.order.astype(np.uint64)
        self.masks = np.concatenate((np.zeros((len(bits), 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)), axis=1)

    def _apart(self, points: np.ndarray, entries: np.ndarray) -> np.ndarray:
        return ((points - self.book[entries]) ** 2).sum(axis=1)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """A mask for each point with all entries that are as near as the nearest, and few others."""
        last = len(self.book) - 1
        bound = np.full(len(points), np.iinfo(np.int64).max)
        for d, (order, values) in enumerate(zip(self.order, self.sorted, strict=True)):
            at = np.minimum(np.searchsorted(values, points[:, d]), last)
            bound = np.minimum(bound, self._apart(points, order[at]))
        radius = np.sqrt(bound.astype(np.float64)).astype(np.int64) + 1
        found = np.full(len(points), np.iinfo(np.uint64).max, dtype=np.uint64)
        for d, (values, masks) in enumerate(zip(self.sorted, self.masks, strict=True)):
            low = np.searchsorted(values, points[:, d] - radius)
            high = np.searchsorted(values, points[:, d] + radius, "right")
            found &= masks[high] ^ masks[low]
        return found

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry (ties: the lower) and the squared distance of each point."""
        entry = np.zeros(len(points), np.int64)
        best = np.full(len(points), np.iinfo(np.int64).max)
        left = self.candidates(points)
        rows = np.arange(len(points))
        while len(rows):
            lowest = left & (~left + np.uint64(1))
            bit = np.frexp(lowest.astype(np.float64))[1].astype(np.int64) - 1
            apart = self._apart(points[rows], bit)
            closer = apart < best[rows]
            best[rows[closer]], entry[rows[closer]] = apart[closer], bit[closer]
            left ^= lowest
            rows, left = rows[left != 0], left[left != 0]
        return entry, best


def _split(vectors: np.ndarray, parts: int) -> np.ndarray:
    """Parts x vectors x dimensions."""
    return vectors.reshape(len(vectors), parts, -1).swapaxes(0, 1)


def first_books(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """Codebooks of the parts of the vectors with the smallest ids; ties by vector, null ids last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").toArrow()
    vectors = whole(first.column(0).combine_chunks())
    if not len(vectors):
        return []
    if vectors.shape[1] % parts:
        raise ValueError(f"vectors of {vectors.shape[1]} components can't be cut into {parts} equal parts")
    return list(_split(vectors, parts))


def moved(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the mean (floor) of the parts nearest to it. Tasks return sums only, entries x components rows."""
    parts, (entries, width) = len(books), books[0].shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        counts = np.zeros((parts, entries), np.int64)
        sums = np.zeros((parts, entries, width), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            for p, points in enumerate(_split(whole(batch.column(0)), parts)):
                entry, _ = slices[p].nearest(points)
                counts[p] += np.bincount(entry, minlength=entries)
                np.add.at(sums[p], entry, points)
        p, e, d = np.nonzero(np.repeat(counts[:, :, None], width, axis=2))
        columns = [pa.array(x, pa.int64()) for x in (p, e, d, counts[p, e], sums[p, e, d])]
        yield pa.RecordBatch.from_arrays(columns, ["p", "e", "d", "n", "total"])

    each = rows.select("vector").mapInArrow(run, "p long, e long, d long, n long, total long")
    means = each.groupBy("p", "e", "d").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toArrow()
    p, e, d, n, total = (means.column(x).to_numpy() for x in ("p", "e", "d", "n", "total"))
    found = np.array(books)
    found[p, e, d] = total // n
    return list(found)


def learn(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """Codebooks after some rounds over all rows; entries nothing is nearest to stay as they are."""
    books = first_books(rows, parts, entries)
    for _ in range(rounds if books else 0):
        books = moved(rows, books)
    return books


def encode(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """``vec_id, label, code`` (a byte for each part) and ``error``, the squared distance to the coded vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices = [Slices(b) for b in books]
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [s.nearest(points) for s, points in zip(slices, _split(whole(batch.column(2)), len(books)), strict=True)]
            codes = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8)
            error = sum(apart for _, apart in found)
            columns = [batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    schema = "vec_id long, label long, code binary, error long"
    return rows.select("vec_id", "label", "vector").mapInArrow(run, schema) if books else rows.sparkSession.createDataFrame([], schema)


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined decimals."""
    return hashlib.sha256(",".join(str(x) for book in books for x in book.ravel().tolist()).encode()).hexdigest()


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """``vec_id, label, code, error, label_error`` (errors summed over equal labels, nulls together), and the codebooks.

    Input: ``vec_id, label, embedding`` among any columns. Rows with an unsound vector are left out; see ``vectors.sound``.
    Repeated rows count each; fewer rows than entries make smaller codebooks; an empty table gives no rows and no books.
    """
    rows = sound(embeddings)
    books = learn(rows, parts, entries, rounds)
    coded = cut(encode(rows, books))
    totals = coded.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    return coded.join(totals, coded["label"].eqNullSafe(totals["own"])).drop("own"), books
