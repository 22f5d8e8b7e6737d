"""Exact substring deduplication of word windows with an FM-index per shard.

A window of 50 words always holds the same minimizer, a run of a few words; consecutive windows with one minimizer form a
passage. Passages go to the shard of their minimizer, so equal windows meet in one shard. Each shard indexes its different
passages (equal ones are reduced to the first before) and streams them through backward search, which gives the first
document of each window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import rolling
from plumbline.llm.common import cut
from plumbline.llm.fm_index import FMIndex

WINDOW = 50
#: Words of a minimizer.
RUN = 8
#: Words cut into passages at once.
CHUNK = 1 << 19
#: Bytes of texts hashed at once, unless one text has more.
PART = 1 << 16
#: Words of an index, about; a shard larger than that has several, none of which parts a minimizer's passages.
INDEX_WORDS = 1 << 20
#: A minimizer with more different passages than this, and than total / HOT_MOST, is hot: its windows are dealt by
#: themselves. There are at most HOT_MOST hot ones.
HOT_LEAST = 64
HOT_MOST = 200_000


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The minimum of each window of so many values, by doubling."""
    held, length = values, 1
    while 2 * length <= size:
        held = np.minimum(held[:-length], held[length:])
        length *= 2
    rest = size - length
    return np.minimum(held[:-rest], held[rest:]) if rest else held


def passages(total: np.ndarray, document: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(minimizer, first window, windows)`` of documents, chunk by chunk, from the sums of their words' hashes.

    ``document``: a number for the document of each word. The minimizer of a window is its run with the smallest hash, the
    leftmost of equal ones.
    """
    runs = rolling.windows(total, RUN)
    for start in range(0, max(1, len(document) - WINDOW + 1), CHUNK):
        part = runs[start : start + CHUNK + WINDOW - RUN]
        if len(part) <= WINDOW - RUN:
            return
        places = np.arange(len(part), dtype=np.uint64)
        low = np.uint64((1 << 20) - 1)
        least = (sliding_min((part & ~low) | places, WINDOW - RUN + 1) & low).astype(np.int64)
        of = document[start : start + len(least) + WINDOW - 1]
        whole = np.flatnonzero(of[: len(least)] == of[WINDOW - 1 :])
        least = least[whole]
        first = np.flatnonzero(np.diff(least, prepend=-1))
        yield part[least[first]], whole[first] + start, np.diff(np.append(first, len(least)))


def content(total: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A hash of the words of each passage, from the sums of the words' hashes."""
    length = n + WINDOW - 1
    scale = rolling.powers(rolling.INVERSE, len(total))[first]
    return rolling.mix((total[first + length] - total[first]) * scale + length.astype(np.uint64))


def _documents(docs: DataFrame) -> DataFrame:
    """Documents with a key for the row: repeated rows share it, other texts of the same doc_id don't."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("uid"), "text")


def _parts(texts: pa.Array) -> Iterator[slice]:
    """The texts of a batch in parts of at most ``PART`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, done = 0, 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + PART, side="right")))
        yield slice(start, stop)
        start, done = stop, int(ends[stop - 1])


def _words_of(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the word hashes of texts in a row, and the words of each text."""
    data = b" ".join([t or b"" for t in texts])
    starts, ends = rolling.words(data)
    bounds = np.cumsum([0] + [len(t or b"") + 1 for t in texts])
    return rolling.sums(rolling.word_hashes(data, starts, ends)), np.diff(np.searchsorted(starts, bounds))


SEGMENTS = "anchor long, shard long, content long, doc_id long, uid long, first int, n int, single boolean"


def segments(docs: DataFrame, hot: np.ndarray) -> DataFrame:
    """The passages of documents with an id, those of hot minimizers window by window.

    ``anchor``: the minimizer; ``shard``: what passages are grouped by, a window's own hash where ``single``.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 5 + [pa.int32()] * 2 + [pa.bool_()]
        names = [c.split()[0] for c in SEGMENTS.split(", ")]
        for batch in rows:
            found: list[tuple] = []
            held = 0
            ids, uids = (batch.column(k).to_numpy() for k in range(2))
            texts = batch.column(2).cast(pa.binary())
            for part in _parts(texts):
                total, sizes = _words_of(texts[part].to_pylist())
                document = np.repeat(np.arange(part.start, part.stop), sizes)
                begins = np.cumsum(sizes) - sizes
                for anchor, first, n in passages(total, document):
                    burning = np.zeros(len(anchor), dtype=bool)
                    if len(hot):
                        at = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
                        burning = hot[at] == anchor
                    cool = ~burning
                    single = np.zeros(int(cool.sum()), dtype=bool)
                    kinds_of = [(anchor[cool], anchor[cool], content(total, first[cool], n[cool]), first[cool], n[cool], single)]
                    if burning.any():
                        times = n[burning]
                        begin = np.repeat(first[burning] - np.cumsum(times) + times, times) + np.arange(times.sum())
                        one = np.ones(len(begin), dtype=np.int64)
                        value = content(total, begin, one)
                        kinds_of.append((np.repeat(anchor[burning], times), rolling.mix(value), value, begin, one, one.astype(bool)))
                    for a, s, c, f, k, single in kinds_of:
                        of = document[f]
                        found.append((a.view(np.int64), s.view(np.int64), c.view(np.int64), ids[of], uids[of], f - begins[of - part.start], k, single))
                        held += len(a)
                if held > 50_000:
                    yield pa.RecordBatch.from_arrays(_arrays(found, kinds), names)
                    found, held = [], 0
            if found:
                yield pa.RecordBatch.from_arrays(_arrays(found, kinds), names)

    return _documents(docs).filter("doc_id IS NOT NULL").mapInArrow(run, SEGMENTS)


def _arrays(found: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    columns = [np.concatenate(c) for c in zip(*found, strict=True)]
    return [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]


def shared_segments(docs: DataFrame) -> DataFrame:
    """Passages whose minimizer lies in two or more documents; hot minimizers are given window by window."""
    kinds = segments(docs, np.zeros(0, dtype=np.uint64)).groupBy("anchor", "content")
    kinds = kinds.agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"))
    totals = [F.min("least").alias("least"), F.max("most").alias("most"), F.count("*").alias("n")]
    anchors = cut(kinds.groupBy("anchor").agg(*totals).filter("least < most").select("anchor", "n"))
    total = anchors.agg(F.sum("n")).first()[0] or 0
    hot = anchors.filter(F.col("n") > max(HOT_LEAST, total // HOT_MOST)).select("anchor").toArrow()
    burning = np.sort(hot.column("anchor").to_numpy().view(np.uint64))
    return cut(segments(docs, burning).join(anchors.select("anchor"), "anchor", "left_semi").drop("anchor"))


def _lists(column: pa.Array, *fields: str) -> Iterator[list[list] | None]:
    """The values of fields of each row's list of structs, or null."""
    flat = column.flatten()
    values = [pc.struct_field(flat, f).to_pylist() for f in fields]
    at = 0
    for size in pc.list_value_length(column).to_pylist():
        if size is None:
            yield None
        else:
            yield [v[at : at + size] for v in values]
            at += size


def _words(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """``shard, content, owner, words``: the text of each passage, read where it occurs first."""
    by_row = firsts.groupBy("doc_id", "uid").agg(F.collect_list(F.struct("shard", "content", "first", "n")).alias("wanted"))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        names = ["shard", "content", "owner", "words"]
        for batch in rows:
            wanted = _lists(batch.column(2), "shard", "content", "first", "n")
            columns: list[list] = [[], [], [], []]
            for owner, text, (shard, contents, first, n) in zip(
                batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), wanted, strict=True
            ):
                w = (text or b"").split()
                columns[0] += shard
                columns[1] += contents
                columns[2] += [owner] * len(shard)
                columns[3] += [b" ".join(w[f : f + k + WINDOW - 1]) for f, k in zip(first, n, strict=True)]
                if len(columns[0]) > 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
                    columns = [[], [], [], []]
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    rows = _documents(docs).join(by_row, ["doc_id", "uid"]).select("doc_id", "text", "wanted")
    return rows.mapInArrow(run, "shard long, content long, owner long, words binary")


def search_shards(units: DataFrame) -> DataFrame:
    """``shard, content, skip, n, owner``: runs of windows of each passage with the first document that has them.

    A task reads its passages by rising shard and closes an index when it has words enough and the shard key changes.
    """

    def answer(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        split = pc.split_pattern(pa.array([row[3] for row in held], pa.binary()), " ")
        numbers = split.flatten().dictionary_encode().indices.to_numpy().astype(np.int64) + 1
        texts = np.split(numbers, split.offsets.to_numpy()[1:-1])
        index = FMIndex(texts, np.array([row[2] for row in held], dtype=np.int64), WINDOW)
        found = index.least_owners(texts)
        sizes = np.array([len(owners) for owners in found])
        owners, of = np.concatenate(found), np.repeat(np.arange(len(held)), sizes)
        new = np.ones(len(owners), dtype=bool)
        new[1:] = (owners[1:] != owners[:-1]) | (of[1:] != of[:-1])
        starts = np.flatnonzero(new)
        of_run = of[starts]
        shard, contents = (np.array([row[k] for row in held], dtype=np.int64)[of_run] for k in range(2))
        skip = starts - (np.cumsum(sizes) - sizes)[of_run]
        columns = [shard, contents, skip, np.diff(np.append(starts, len(owners))), owners[starts]]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
        arrays = [pa.array(c).cast(k) for c, k in zip(columns, kinds, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, ["shard", "content", "skip", "n", "owner"])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        last: tuple[int, int] | None = None
        for batch in rows:
            for row in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if held and size >= INDEX_WORDS and row[0] != held[-1][0]:
                    yield from answer(held)
                    held, size = [], 0
                if last != row[:2]:  # a repeated row gives its passages again
                    held.append(row)
                    size += row[3].count(b" ") + 1
                    last = row[:2]
        if held:
            yield from answer(held)

    dealt = units.repartition("shard").sortWithinPartitions("shard", "content")
    return dealt.mapInArrow(run, "shard long, content long, skip int, n int, owner long")


def repeated_windows(docs: DataFrame) -> DataFrame:
    """``doc_id, uid, first, last``: runs of windows whose words also start in a document with a smaller doc_id."""
    found = shared_segments(docs)
    first = F.min(F.struct("doc_id", "uid", "first", "n")).alias("x")
    kinds = found.groupBy("shard", "content").agg(first, F.max("doc_id").alias("most"), F.first("single").alias("single"))
    firsts = kinds.filter("NOT single OR x.doc_id < most").select("shard", "content", "x.*")
    answers = cut(search_shards(_words(docs, firsts))).withColumnRenamed("n", "run")
    matched = found.select("shard", "content", "doc_id", "uid", F.col("first").alias("begin"))
    begin = F.col("begin") + F.col("skip")
    return (
        matched.join(answers, ["shard", "content"])
        .filter("owner < doc_id")
        .select("doc_id", "uid", begin.alias("first"), (begin + F.col("run") - 1).alias("last"))
    )


def removal(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of the document) and ``runs``, the windows to remove as pairs of first and last, or null."""
    runs = repeated_windows(docs).groupBy("doc_id", "uid").agg(F.collect_set(F.struct("first", "last")).alias("runs"))
    runs = runs.withColumnsRenamed({"doc_id": "d", "uid": "u"})
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("doc_id", "text").alias("u"))
    return rows.join(runs, ["d", "u"], "left").select("row", "runs")


def kept_words(text: bytes | None, runs: list[list[int]] | None) -> tuple[list[bytes], int]:
    """The words left of a text, and how many were removed."""
    w = (text or b"").split()
    if not runs:
        return w, 0
    kept: list[bytes] = []
    done = 0
    for first, last in sorted(zip(*runs, strict=True)):
        if first > done:
            kept += w[done:first]
        done = max(done, last + WINDOW)
    kept += w[done:]
    return kept, len(w) - len(kept)


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256``: what deduplication leaves of each document.

    Each word covered by a 50-word window that also starts in a document with a smaller doc_id goes; windows are judged on
    the input. Null text has no words; shorter texts and rows without doc_id lose nothing; rows repeated with one doc_id do
    not count as smaller ones and all lose the same. Extra columns are left aside; an empty table gives no row.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = []
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for name, text, runs in zip(batch.column(0).to_pylist(), texts, _lists(batch.column(2), "first", "last"), strict=True):
                words, gone = kept_words(text, runs)
                found.append((name, len(words) + gone, gone, hashlib.sha256(b" ".join(words)).hexdigest()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            columns = list(zip(*found, strict=True)) or [[]] * 4
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = removal(docs.select("doc_id", "text")).select(F.col("row.doc_id").cast("long").alias("doc_id"), "row.text", "runs")
    return rows.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def drop_repeats(docs: DataFrame) -> DataFrame:
    """The documents with their own columns; texts that lose words are their kept words, joined by one space.

    ``n_chars``, if there is such a column, follows the text. Null texts, texts of fewer than 50 words and rows without doc_id
    stay as they are; very long texts are searched whole; rows repeated with one doc_id all lose the same; a text that loses all
    its words stays as an empty one; an empty table stays empty. Other columns may have any names.
    """
    schema = docs.schema

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            names = batch.schema.names[:-1]
            runs = list(_lists(batch.column(len(names)), "first", "last"))
            columns = dict(zip(names, batch.columns, strict=False))
            old = columns["text"].cast(pa.binary()).to_pylist()
            new = pa.array([b" ".join(kept_words(t, r)[0]) if r else t for t, r in zip(old, runs, strict=True)], pa.binary())
            columns["text"] = new.cast(columns["text"].type)
            if "n_chars" in columns:
                sizes = pc.utf8_length(columns["text"]).to_pylist()
                n = [size if r else x for size, r, x in zip(sizes, runs, columns["n_chars"].to_pylist(), strict=True)]
                columns["n_chars"] = pa.array(n, columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    name = "runs"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    return removal(docs).select("row.*", F.col("runs").alias(name)).mapInArrow(run, schema)
