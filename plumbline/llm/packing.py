"""Mixture-controlled packing of documents into training sequences by deficit round-robin.

Documents are dealt to parts of bounded size. Inside a part every source is a queue; for each window every source earns its
share of the window's tokens, and sources are served by falling deficit until the window is full. Deficits go on to the next
window and, as they depend on totals only, from part to part: a part starts with what the parts before it owe.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import cut, texts
from plumbline.llm.tokens import Form, encoder_of_worker, joined

WINDOW = 2048
#: The shortest piece served, unless a document or window ends before.
LEAST = 128
#: Bytes of text in a part, about.
PART_BYTES = 4 << 20
#: Parts whose totals are summed up by one task.
LANE = 1024

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
)


def window_sizes(tokens: int, window: int = WINDOW) -> list[int]:
    """Full windows, then the rest in falling powers of two: sequences without any padding."""
    rest = tokens % window
    return [window] * (tokens // window) + [1 << k for k in reversed(range(rest.bit_length())) if rest >> k & 1]


def deal(
    queues: dict[str, list[tuple[int, int]]], shares: dict[str, float], owed: dict[str, float], window: int = WINDOW, least: int = LEAST
) -> list[tuple[int, int, int, int, int]]:
    """Pieces ``(document, start, length, sequence, offset)`` of queues of ``(document, tokens)`` with tokens > 0.

    ``shares``: the wanted proportion of each source; ``owed``: deficits to start with. A source is served up to its deficit,
    at least ``least`` tokens, and goes into debt if that is more; ties go by name. Sources that run out leave their room to
    the others, so every document is packed whole.
    """
    pieces = []
    place = {s: 0 for s in queues}
    done = {s: 0 for s in queues}
    clock = 0.0  # tokens dealt so far: the deficit of a source is fixed + share * clock
    fixed = {s: owed.get(s, 0.0) for s in queues}
    live = sorted(queues)
    for sequence, size in enumerate(window_sizes(sum(n for q in queues.values() for _, n in q), window)):
        clock += size
        deficits = [(-(fixed[s] + shares.get(s, 0.0) * clock), s) for s in live]
        heapq.heapify(deficits)
        offset = 0
        while offset < size:
            debt, s = heapq.heappop(deficits)
            name, n = queues[s][place[s]]
            length = min(n - done[s], size - offset, max(least, int(-debt)))
            pieces.append((name, done[s], length, sequence, offset))
            offset += length
            done[s] += length
            fixed[s] -= length
            if done[s] == n:
                place[s] += 1
                done[s] = 0
            if place[s] < len(queues[s]):
                heapq.heappush(deficits, (debt + length, s))
            else:
                live.remove(s)
    return pieces


def encode(docs: DataFrame, path: str, form: Form, end: int, parts: int) -> DataFrame:
    """``part, doc_id, source, n, ids``: ids of each text and the end id, two bytes each, compressed.

    Parts are dealt by doc_id and text, so that rows of one doc_id, or of none, spread.
    """
    ending = np.array([end], dtype="<u2").tobytes()

    def run(rows):
        import zstandard

        squeeze = zstandard.ZstdCompressor(level=1).compress
        encoder = encoder_of_worker(path, form, 2)
        for batch in rows:
            ids = [data + ending for data in joined(encoder, texts(batch))]
            n = pa.array([len(x) // 2 for x in ids], pa.int64())
            columns = [*batch.columns[:3], n, pa.array([squeeze(x) for x in ids], pa.binary())]
            for k in range(0, len(ids), 1000):
                yield pa.RecordBatch.from_arrays([c[k : k + 1000] for c in columns], ["part", "doc_id", "source", "n", "ids"])

    part = F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)).cast("int").alias("part")
    rows = docs.select(part, F.col("doc_id").cast("long"), F.coalesce("source", F.lit("")).alias("source"), "text")
    return rows.mapInArrow(run, "part int, doc_id long, source string, n long, ids binary")


def carried(encoded: DataFrame, shares: dict[str, float] | None = None) -> DataFrame:
    """``part, source, share, owed``: the proportion wanted, and the deficit with which a part starts.

    Without ``shares`` each source has its share of all tokens. Totals are summed up in lanes of parts, then over lanes.
    """
    own = encoded.groupBy("part", "source").agg(F.sum("n").alias("n"))
    by_part = own.groupBy("part").agg(F.sum("n").alias("n")).withColumn("source", F.lit(None).cast("string"))
    lane = F.floor(F.col("part") / LANE).cast("int")
    totals = own.unionByName(by_part).withColumn("lane", lane)
    within = Window.partitionBy("source", "lane").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy("source").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = totals.groupBy("source", "lane").agg(F.sum("n").alias("all"))
    lanes = lanes.select("source", "lane", F.coalesce(F.sum("all").over(over), F.lit(0)).alias("earlier"))
    same = F.col("s").eqNullSafe(F.col("source"))
    running = (
        totals.withColumn("sofar", F.coalesce(F.sum("n").over(within), F.lit(0)))
        .join(lanes.select(F.col("source").alias("s"), F.col("lane").alias("l"), "earlier"), same & (F.col("l") == F.col("lane")))
        .select("part", "source", (F.col("sofar") + F.col("earlier")).alias("before"))
    )
    everything = running.filter("source IS NULL").select("part", F.col("before").alias("all_before"))
    if shares is None:
        total = own.agg(F.sum("n").alias("total")).first()["total"] or 1
        wanted = own.groupBy("source").agg((F.sum("n") / F.lit(total)).alias("share"))
    else:
        pairs = F.array(*[F.struct(F.lit(s).alias("source"), F.lit(float(x)).alias("share")) for s, x in shares.items()])
        sources = own.select("source").distinct()
        picked = F.get(F.filter(pairs, lambda x: x["source"] == F.col("source")), F.lit(0))["share"]
        wanted = sources.select("source", F.coalesce(picked, F.lit(0.0)).alias("share"))
    joined_totals = running.filter("source IS NOT NULL").join(everything, "part").join(wanted, "source")
    owed = F.col("share") * F.col("all_before") - F.col("before")
    names = [F.col(c).alias(c) for c in ("part", "source")]  # new columns: the table is grouped with its own origin
    return joined_totals.select(*names, "share", owed.alias("owed"))


def _pack(window: int, least: int):
    def pack(rows: pa.Table, deficits: pa.Table) -> pa.Table:
        import zstandard

        expand = zstandard.ZstdDecompressor().decompress
        part = rows.column("part")[0].as_py()
        doc_ids = rows.column("doc_id").to_pylist()
        sources = rows.column("source").to_pylist()
        sizes = rows.column("n").to_pylist()
        held = rows.column("ids").to_pylist()
        crcs = [zlib.crc32(h) for h in held]
        order = sorted(range(len(sizes)), key=lambda i: (doc_ids[i] is not None, doc_ids[i] or 0, crcs[i]))
        queues: dict[str, list[tuple[int, int]]] = {}
        for i in order:
            queues.setdefault(sources[i], []).append((i, sizes[i]))
        terms = deficits.to_pylist()
        shares = {t["source"]: t["share"] for t in terms}
        owed = {t["source"]: t["owed"] for t in terms}
        pieces = deal(queues, shares, owed, window, least)
        ids: dict[int, bytes] = {}
        found = []
        for i, start, length, sequence, offset in pieces:
            if i not in ids:
                ids[i] = np.frombuffer(expand(held[i]), "<u2").astype("<u4").tobytes()
            crc = zlib.crc32(ids[i][4 * start : 4 * (start + length)])
            if start + length == sizes[i]:
                del ids[i]
            found.append((doc_ids[i], start, length, crc, sizes[i], (part << 32) | sequence, offset, sources[i]))
        columns = list(zip(*found, strict=True))
        names = [c.split()[0] for c in PIECES.split(", ")]
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return pack


def pack(
    docs: DataFrame, path: str, form: Form, end: int, shares: dict[str, float] | None = None, window: int = WINDOW, least: int = LEAST
) -> DataFrame:
    """Pieces of all documents: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source``.

    Every id, the end id of each document included, lies in exactly one piece; pieces of a sequence follow each other from
    offset 0 without a gap; sequences hold ``window`` tokens or a smaller power of two, so none is padded. ``shares`` are
    the token proportions wanted of the sources, by default those of the corpus; what a source lacks others fill, as all
    documents are packed. Null text counts as empty (its end id remains), null source as the source ''; rows without doc_id
    are packed too; repeated rows are packed each; an empty table gives no row. The largest thing in memory is a part: about
    ``PART_BYTES`` of text, or one longer document; rows that agree in doc_id and text share a part.
    """
    text_bytes = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    encoded = cut(encode(docs, path, form, end, max(1, -(-text_bytes // PART_BYTES))))
    terms = carried(encoded, shares)
    return encoded.groupBy("part").cogroup(terms.groupBy("part")).applyInArrow(_pack(window, least), PIECES)
