"""Benchmark decontamination: short test items found inside long documents by MinHash containment search.

Items are partitioned by their number of shingles. For each partition documents are cut into overlapping passages not much
longer than its items, so that high containment of an item means a Jaccard similarity that MinHash bands can find; what
collides is verified by exact containment of shingles in the whole document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rolling

SHINGLE = 5
THRESHOLD = 0.8
HASHES = 128
#: The chance with which a passage at the threshold may be missed, at most.
MISS = 1e-6
#: Items and bytes of a block: the items are taken to the executors block by block, each sought in all documents.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20


def shingles(data: bytes) -> set[bytes]:
    """The distinct runs of five words, A-Z lower-cased; none for fewer words."""
    w = data.lower().split()
    return {b" ".join(w[i : i + SHINGLE]) for i in range(len(w) - SHINGLE + 1)}


def hashes(data: bytes) -> np.ndarray:
    """A hash of each shingle, in order."""
    data = data.lower()
    return rolling.window_hashes(rolling.word_hashes(data, *rolling.words(data)), SHINGLE)


def band_rows(least: int, passage: int, n_hashes: int = HASHES) -> int:
    """Rows of a band: as many as leave the chance of a miss small.

    A passage that holds the threshold of an item of ``least`` shingles has at least this Jaccard similarity with it.
    """
    jaccard = THRESHOLD * least / (least + passage - THRESHOLD * least)
    rows = 1
    while (1 - jaccard ** (rows + 1)) ** (n_hashes // (rows + 1)) <= MISS:
        rows += 1
    return rows


def signature(values: np.ndarray, rows: int) -> np.ndarray:
    """MinHash values of a set of shingle hashes, folded into bands of so many rows."""
    seeds = rolling.mix(np.arange(1, HASHES + 1, dtype=np.uint64))
    least = np.array([rolling.mix(values ^ s).min() for s in seeds])
    bands = least[: HASHES // rows * rows].reshape(-1, rows)
    return rolling.mix((bands * rolling.powers(rolling.BASE, rows - 1)).sum(axis=1, dtype=np.uint64))


class Index:
    """Items ``(id, text)`` by size partition; ``search`` gives the items held by a text, as often as ``times`` says."""

    def __init__(self, items: list[tuple[int | None, str | None]], times: list[int] | None = None) -> None:
        self.items = []
        self.times = []
        self.partitions: dict[int, tuple[int, int, dict[tuple[int, int], list[int]]]] = {}
        every = [np.zeros(0, dtype=np.uint64)]
        for (name, text), n in zip(items, times or [1] * len(items), strict=True):
            data = (text or "").encode("utf-8", "surrogatepass")
            own = shingles(data)
            if not own:
                continue
            size = len(own).bit_length() - 1
            if size not in self.partitions:
                upper = 2 << size
                self.partitions[size] = (2 * upper, band_rows(1 << size, 2 * upper), {})
            _, rows, bands = self.partitions[size]
            values = hashes(data)
            every.append(values)
            for k, v in enumerate(signature(values, rows).tolist()):
                bands.setdefault((k, v), []).append(len(self.items))
            self.items.append((name, own))
            self.times.append(n)
        self.shingles = np.unique(np.concatenate(every))
        self.filter = np.zeros(1 << 20, dtype=bool)
        self.filter[self._cell(self.shingles)] = True

    @staticmethod
    def _cell(values: np.ndarray) -> np.ndarray:
        return (values >> np.uint64(44)).astype(np.int64)

    def hits(self, values: np.ndarray) -> np.ndarray:
        """Places of shingles that any item has. A passage without one has no minimum in common with any item."""
        maybe = np.flatnonzero(self.filter[self._cell(values)])
        found = np.searchsorted(self.shingles, values[maybe])
        found[found == len(self.shingles)] = 0
        return maybe[self.shingles[found] == values[maybe]]

    def search(self, text: str) -> list[tuple[int | None, int, int]]:
        """``(item, shared shingles, shingles)`` of each item whose containment in the text reaches the threshold."""
        data = text.encode("utf-8", "surrogatepass")
        values = hashes(data)
        hits = self.hits(values) if len(self.items) else ()
        if not len(hits):
            return []
        candidates: set[int] = set()
        for length, rows, bands in self.partitions.values():
            stride = length // 2
            first = np.unique(np.concatenate((hits // stride, np.maximum(hits // stride - 1, 0)))) * stride
            for start in first.tolist():
                found = signature(values[start : start + length], rows).tolist()
                candidates.update(i for k, v in enumerate(found) for i in bands.get((k, v), ()))
        own = shingles(data) if candidates else set()
        matches = []
        for i in sorted(candidates):
            name, wanted = self.items[i]
            shared = len(wanted & own)
            if shared >= THRESHOLD * len(wanted):
                matches += [(name, shared, len(wanted))] * self.times[i]
        return matches


def blocks(items: DataFrame) -> Iterator[Index]:
    """The items in blocks of bounded size, dealt by hash; more items give more blocks, each sought in all documents.

    Repeated rows are counted first and are one item of a block.
    """
    own = items.groupBy(F.col("item_id").cast("long").alias("item_id"), "text").agg(F.count("*").alias("times"))
    n, size = own.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    count = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    for k in range(count):
        part = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k)
        rows = part.collect()
        yield Index([(r["item_id"], r["text"]) for r in rows], [r["times"] for r in rows])


def find_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, n_shared, n_shingles`` for each document and item with a containment of 0.8 or more.

    Words are cut at ASCII blanks, A-Z lower-cased; shingles are five words. Texts and items of fewer words, null ones
    included, hold and match nothing. Repeated rows of either side match each; extra columns are left aside; without
    documents or items there is no row. Documents are not moved: each is searched where it is read.
    """

    def seek(index: Index):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                found = []
                for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    found += [(name, *match) for match in index.search(text or "")]
                columns = list(zip(*found, strict=True)) or [[]] * 4
                names = ["doc_id", "item_id", "n_shared", "n_shingles"]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

        return run

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, item_id long, n_shared long, n_shingles long"
    out = None
    for index in blocks(items):
        found = texts.mapInArrow(seek(index), schema)
        out = found if out is None else out.unionAll(found)
    return out


def drop_leaked(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The documents that hold no item, with their own columns.

    Null and short texts hold none and stay, repeated rows stay or go together, very long texts are searched whole; without
    items all stay, an empty table stays empty. Other columns may have any names.
    """

    def keep(index: Index, at: int):
        def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in rows:
                clean = [not index.search(text or "") for text in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    for index in blocks(items):
        docs = docs.mapInArrow(keep(index, docs.columns.index("text")), docs.schema)
    return docs
