"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits are cut into partitions of correlated bits. A pair within ``radius`` differing bits lies, for any
thresholds with ``sum(threshold + 1) = radius + 1`` (-1: the partition is left out), within the threshold of at least one
partition. Each fingerprint chooses its own thresholds by dynamic programming over estimated candidate counts, so that it
avoids the partitions in which many others share its value; it probes those and verifies what it meets.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts
from plumbline.llm.components import components

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 2
PARTITIONS = 2
#: Fingerprints from which correlations of bits are estimated, about; they only shape the partitions, not the result.
SAMPLE = 40_000
#: Cells of the table of candidate counts, for each partition.
CELLS = 1 << 18
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15


def fingerprint(text: str) -> int:
    """The majority of the bits of XXH64 (seed 42) over 3-word shingles, A-Z lower-cased; 0 without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    stops = ends.tolist()[SHINGLE - 1 :] or [len(joined)]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(stops), CHUNK):
        ranges = zip(starts[k : k + CHUNK], stops[k : k + CHUNK], strict=False)
        hashes = np.array([digest(joined[a:b], SEED) for a, b in ranges], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(stops)).astype(np.uint8)
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long), one row for each document. Null text counts as empty."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = np.array([fingerprint(t) for t in texts(batch)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fp long")


@dataclass(frozen=True)
class Layout:
    """Partitions of the bits, and how many fingerprints have each (hashed) value of a partition."""

    parts: tuple[tuple[int, ...], ...]
    counts: np.ndarray | None = None

    def values(self, fps: np.ndarray) -> np.ndarray:
        """The value of each partition, one row for each partition."""
        out = np.zeros((len(self.parts), len(fps)), dtype=np.uint64)
        for i, bits in enumerate(self.parts):
            for k, bit in enumerate(bits):
                out[i] |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
        return out


def cells(values: np.ndarray) -> np.ndarray:
    """The cell of the count table of each value, by a multiplicative hash."""
    mixed = (values ^ (values >> np.uint64(15))) * np.uint64(0x9E3779B97F4A7C15)
    return (mixed >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)


def flips(width: int, radius: int) -> list[np.ndarray]:
    """Masks with exactly 0, 1, ... ``radius`` bits of a partition."""
    found = [np.zeros(1, dtype=np.uint64)]
    for n in range(1, radius + 1):
        found.append(np.array([sum(1 << b for b in c) for c in combinations(range(width), n)], dtype=np.uint64))
    return found


def partition_bits(fps: np.ndarray, n_parts: int = PARTITIONS) -> tuple[tuple[int, ...], ...]:
    """Bits grouped greedily with those they correlate with most, in partitions of equal width."""
    bits = ((fps[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
    strength = np.zeros((BITS, BITS))
    if len(fps) > 1:
        centred = bits - bits.mean(axis=0)
        spread = np.sqrt((centred**2).sum(axis=0))
        spread[spread == 0] = np.inf
        strength = np.abs(centred.T @ centred) / np.outer(spread, spread)
        np.fill_diagonal(strength, 0)
    left = list(range(BITS))
    parts = []
    for i in range(n_parts):
        width = len(left) // (n_parts - i)
        part = [max(left, key=lambda b: (strength[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            part.append(max(left, key=lambda b: (strength[b, part].sum(), -b)))
            left.remove(part[-1])
        parts.append(tuple(sorted(part)))
    return tuple(parts)


def allocate(layout: Layout, values: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """For each partition and fingerprint, its threshold + 1 (0: left out), by dynamic programming.

    The cost of a threshold is its number of probes and the fingerprints estimated to lie in the cells probed, above the
    mean load of a cell.
    """
    n = values.shape[1]
    mean = layout.counts.sum(axis=1) / CELLS
    total = np.full((radius + 2, n), np.inf)
    total[0] = 0
    choice = np.zeros((len(layout.parts), radius + 2, n), dtype=np.int8)
    for i, bits in enumerate(layout.parts):
        costs = [np.zeros(n)]
        for masks in flips(len(bits), radius):
            more = np.zeros(n)
            for k in range(0, n, 1024):
                near = cells(values[i, k : k + 1024, None] ^ masks[None, :])
                more[k : k + 1024] = np.maximum(layout.counts[i][near] - mean[i], 0).sum(axis=1) + len(masks)
            costs.append(costs[-1] + more)
        after = np.full_like(total, np.inf)
        for units in range(radius + 2):
            for own in range(units + 1):
                cost = total[units - own] + costs[own]
                better = cost < after[units]
                after[units] = np.where(better, cost, after[units])
                choice[i, units] = np.where(better, own, choice[i, units])
        total = after
    units = np.full(n, radius + 1)
    chosen = np.zeros((len(layout.parts), n), dtype=np.int8)
    for i in reversed(range(len(layout.parts))):
        chosen[i] = choice[i, units, np.arange(n)]
        units = units - chosen[i]
    return chosen


def keyed(part: int, values: np.ndarray) -> np.ndarray:
    """One long for a partition and its value; partitions are narrower than 56 bits."""
    return (values | np.uint64(part << 56)).view(np.int64)


def _batch(fps: np.ndarray, keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64)), pa.array(keys)], ["fp", "key"])


def entries(distinct: DataFrame, layout: Layout) -> DataFrame:
    """``fp, key``: each fingerprint under its value in each partition."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, values in enumerate(layout.values(fps)):
                yield _batch(fps, keyed(i, values))

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def probes(distinct: DataFrame, layout: Layout, radius: int = RADIUS) -> DataFrame:
    """``fp, key``: the values each fingerprint looks up."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            values = layout.values(fps)
            chosen = allocate(layout, values, radius)
            for i, bits in enumerate(layout.parts):
                for distance, masks in enumerate(flips(len(bits), radius)):
                    of = np.flatnonzero(chosen[i] > distance)
                    for k in range(0, len(of), 256):
                        some = of[k : k + 256]
                        near = (values[i, some, None] ^ masks[None, :]).ravel()
                        yield _batch(np.repeat(fps[some], len(masks)), keyed(i, near))

    return distinct.select("fp").mapInArrow(run, "fp long, key long")


def count_cells(distinct: DataFrame, layout: Layout) -> np.ndarray:
    """Fingerprints in each cell of each partition: at most partitions x cells rows reach the driver."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for i, values in enumerate(layout.values(fps)):
                cell, n = np.unique(cells(values), return_counts=True)
                place = pa.array((cell + i * CELLS).astype(np.int32))
                yield pa.RecordBatch.from_arrays([place, pa.array(n.astype(np.int64))], ["cell", "n"])

    counted = distinct.select("fp").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    rows = counted.toArrow()
    out = np.zeros(len(layout.parts) * CELLS, dtype=np.float32)
    out[rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
    return out.reshape(len(layout.parts), CELLS)


def plan(distinct: DataFrame, n_parts: int = PARTITIONS) -> Layout:
    """Partitions from a sample by hash of about ``SAMPLE`` fingerprints, counts from all of them."""
    share = int(min(1.0, SAMPLE / max(1, distinct.count())) * (1 << 20))
    sample = distinct.select("fp").filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 20)) < share)
    fps = sample.toArrow().column("fp").to_numpy().view(np.uint64)
    parts = partition_bits(fps, n_parts)
    return Layout(parts, count_cells(distinct, Layout(parts)))


def links(distinct: DataFrame, layout: Layout, radius: int = RADIUS) -> DataFrame:
    """``a, b``: pairs of different fingerprints within ``radius`` bits; a pair may come from either side."""
    left = probes(distinct, layout, radius).withColumnRenamed("fp", "a")
    right = entries(distinct, layout).withColumnRenamed("fp", "b")
    near = (F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)
    return left.join(right, "key").filter(near).select("a", "b")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` for each document; the component is the smallest doc_id reachable over links.

    Equal fingerprints are reduced to one before anything is compared, so a group of copies costs as much as one
    document. Null and empty texts have fingerprint 0 and link like any other. A row without doc_id names no component
    but still links others. Repeated rows are in the same component; an empty table gives no row.
    """
    found = cut(fingerprints(docs))
    distinct = cut(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    stars = components(links(distinct, plan(distinct), radius))
    group = F.coalesce(F.col("root"), F.col("fp"))
    rooted = distinct.join(stars.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", group.alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = rooted.select("fp", "root").join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", "fp", "component_id")


def hex_digits(column: str) -> F.Column:
    """A long as 16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(column), 16, "0"))
