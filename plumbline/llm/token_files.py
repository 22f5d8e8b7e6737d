"""Token ids as binary images: one concatenated id array, document boundaries and doc_ids in Elias-Fano code.

An image is self-contained and holds whole documents in rising doc_id order; many make up a table, kept as the binary column
of Parquet files so that any store Spark writes to can hold them. Offsets are read by select, without a table of 64-bit
numbers.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.llm import elias_fano
from plumbline.llm.common import shared_folder, texts
from plumbline.llm.elias_fano import EliasFano
from plumbline.llm.tokens import Form, encoder_of_worker, joined

#: Fixed values of the format: mark, bytes of an id, documents without doc_id (they come first), smallest doc_id, sizes.
MARK = b"PLTF0001"
HEAD = "<8sBQqQQQ"
#: An image is closed at so many ids; a longer document has one of its own.
IMAGE_IDS = 1 << 18


def write_image(doc_ids: list[int | None], lengths: list[int], ids: bytes, width: int) -> bytes:
    """One image; ``doc_ids`` rise, those that are null come first."""
    known = [d for d in doc_ids if d is not None]
    base = known[0] if known else 0
    names = elias_fano.encode(np.array([d - base for d in known], dtype=np.uint64))
    bounds = elias_fano.encode(np.concatenate(([0], np.cumsum(np.array(lengths, dtype=np.uint64)))).astype(np.uint64))
    head = struct.pack(HEAD, MARK, width, len(doc_ids) - len(known), base, len(names), len(bounds), len(ids))
    return head + names + bounds + ids


class Image:
    """Reads an image: ``len``, ``doc_id(i)``, ``start(i)`` and ``ids(i)`` by select."""

    def __init__(self, data: bytes) -> None:
        mark, self.width, self.n_null, self.base, n_names, n_bounds, n_ids = struct.unpack_from(HEAD, data)
        if mark != MARK:
            raise ValueError("not a token image")
        at = struct.calcsize(HEAD)
        self.names = EliasFano(data[at : at + n_names])
        self.bounds = EliasFano(data[at + n_names : at + n_names + n_bounds])
        self.array = np.frombuffer(data, f"<u{self.width}", n_ids // self.width, at + n_names + n_bounds)

    def __len__(self) -> int:
        return len(self.bounds) - 1

    def doc_id(self, i: int) -> int | None:
        return None if i < self.n_null else self.base + self.names[i - self.n_null]

    def start(self, i: int) -> int:
        return self.bounds[i]

    def starts(self, places: np.ndarray) -> np.ndarray:
        """The first id of each of many documents; the place after the last one gives the end."""
        return self.bounds.at(places).astype(np.int64)

    def doc_ids(self, places: np.ndarray) -> list[int | None]:
        known = places[places >= self.n_null] - self.n_null
        names = iter((self.names.at(known).astype(np.int64) + self.base).tolist())
        return [None if i < self.n_null else next(names) for i in places.tolist()]

    def ids(self, i: int) -> np.ndarray:
        return self.array[self.bounds[i] : self.bounds[i + 1]]


def _images(docs: Iterable[tuple[int | None, bytes]], width: int) -> Iterator[tuple[int, int, int, bytes]]:
    """``(seq, ids before, ids, image)`` of the documents of a task."""
    names: list[int | None] = []
    parts: list[bytes] = []
    seq = before = held = 0
    for name, data in docs:
        names.append(name)
        parts.append(data)
        held += len(data) // width
        if held >= IMAGE_IDS:
            yield seq, before, held, write_image(names, [len(p) // width for p in parts], b"".join(parts), width)
            seq, before, held, names, parts = seq + 1, before + held, 0, [], []
    if names:
        yield seq, before, held, write_image(names, [len(p) // width for p in parts], b"".join(parts), width)


def write_tokens(docs: DataFrame, folder: str, path: str, form: Form, end: int, width: int = 2) -> None:
    """Encodes every text, appends the id ``end`` to each and writes images in rising doc_id order to a folder.

    Columns written: ``part`` (rises with doc_id), ``seq`` in it, ``before`` (ids of the part before the image), ``n_ids``,
    ``image``. Texts are dealt by ranges of doc_id and a hash of the text once, so that rows of one doc_id or none spread,
    and encoded there. Null text counts as empty; rows without doc_id come first; repeated rows are written each; an empty
    table gives an empty one. ``width``: bytes of an id.
    """
    ending = np.array([end], dtype=f"<u{width}").tobytes()

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of_worker(path, form, width)
        part = TaskContext.get().partitionId()

        def encoded() -> Iterator[tuple[int | None, bytes]]:
            for batch in rows:
                for name, data in zip(batch.column(0).to_pylist(), joined(encoder, texts(batch)), strict=True):
                    yield name, data + ending

        for seq, before, n, image in _images(encoded(), width):
            columns = [[part], [seq], [before], [n], [image]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "seq", "before", "n_ids", "image"])

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    images = ordered.mapInArrow(run, "part int, seq int, before long, n_ids long, image binary")
    images.write.option("compression", "zstd").parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of each document from the images of a folder.

    ``start``: ids of all documents before it, read by batched select from the images' boundaries. Only the totals of the
    parts are summed up in order. Each written row gives one, null doc_ids first; an empty folder gives none.
    """
    images = spark.read.parquet(folder)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for part, before, data in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                image = Image(data)
                n = len(image)
                bounds = image.starts(np.arange(n + 1))
                crc = [zlib.crc32(image.array[a:b].astype("<u4").tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)]
                names = image.doc_ids(np.arange(n))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, part, dtype=np.int32)),
                        pa.array(names, pa.int64()),
                        pa.array(bounds[:-1] + before),
                        pa.array(np.diff(bounds)),
                        pa.array(crc, pa.int64()),
                    ],
                    ["part", "doc_id", "start", "n_tokens", "ids_crc32"],
                )

    schema = "part int, doc_id long, start long, n_tokens long, ids_crc32 long"
    found = images.select("part", "before", "image").mapInArrow(run, schema)
    totals = images.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    return found.join(bases, "part").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
