"""Sharding by extendible hashing, with DataFrame functions only.

A directory maps prefixes of a document's hash to buckets. Only a bucket above the byte limit is split, on the next bit of
the hash, until every bucket fits; each bucket is a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut

#: Bits of the hash.
BITS = 60
#: Bits by which the counted prefixes are longer than the average shard needs; deeper buckets go another round.
SLACK = 6
STEP = 12


def hash60(key: Column) -> Column:
    """The first 60 bits of the MD5 of a key as text."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def prefix(value: Column, bits: Column | int) -> Column:
    """The first bits of a 60-bit hash."""
    return F.call_function("shiftright", value, F.lit(BITS) - bits)


def leaves(sizes: DataFrame, limit: int, start: int, depth: int) -> DataFrame:
    """The buckets of ``hash, n_bytes`` between two depths: ``depth, bits, n_bytes``, the deepest maybe still too large.

    Bytes are counted once by the longest prefix, a bounded number of cells; each cell then adds its bytes to its buckets of
    all depths, and the bucket of a cell is the first on its path that fits.
    """
    cells = sizes.groupBy(prefix(F.col("hash"), depth).alias("cell")).agg(F.sum("n_bytes").alias("n_bytes"))
    path = F.explode(F.sequence(F.lit(start), F.lit(depth))).alias("depth")
    bits = F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")).alias("bits")
    on_path = cells.select("cell", "n_bytes", path).select("cell", "depth", bits, "n_bytes")
    loads = on_path.groupBy("depth", "bits").agg(F.sum("n_bytes").alias("load"))
    fits = on_path.join(loads, ["depth", "bits"]).filter((F.col("load") <= limit) | (F.col("depth") == depth))
    first = fits.groupBy("cell").agg(F.min(F.struct("depth", "bits", "load")).alias("x"))
    return first.select("x.*").distinct().select("depth", "bits", F.col("load").alias("n_bytes"))


def directory(sizes: DataFrame, limit: int) -> DataFrame:
    """All buckets: ``depth, bits, n_bytes``. Together they cover the hashes that occur, without overlap."""
    total = sizes.agg(F.sum("n_bytes")).first()[0] or 0
    depth = min(BITS, max(1, -(-total // limit)).bit_length() + SLACK)
    found = cut(leaves(sizes, limit, 0, depth))
    done = found.filter((F.col("n_bytes") <= limit) | (F.col("depth") < depth))
    while depth < BITS:
        over = found.filter((F.col("depth") == depth) & (F.col("n_bytes") > limit))
        if over.isEmpty():
            return found
        wide = over.select(F.col("bits").alias("cell"))
        deeper = min(BITS, depth + STEP)
        inside = sizes.join(wide, prefix(F.col("hash"), depth) == F.col("cell"), "left_semi")
        found = cut(done.unionByName(leaves(inside, limit, depth + 1, deeper)))
        done = found.filter((F.col("n_bytes") <= limit) | (F.col("depth") < deeper))
        depth = deeper
    return found


def shard(docs: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """``doc_id, n_bytes, shard, depth, shard_bytes, oversize`` for each document.

    ``shard`` is the bucket's prefix as a string of bits (empty: one shard holds all), ``depth`` its length. A document's
    size is that of its text in UTF-8; null text is 0 bytes. Rows with one key share a hash and stay together, as do rows
    without key; only a bucket of one hash can exceed the limit and is marked ``oversize``. Documents of a large source
    spread like any others. An empty table gives no row.
    """
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    sizes = cut(docs.select(F.col(key).cast("long").alias("doc_id"), hash60(F.col(key)).alias("hash"), size))
    buckets = directory(sizes, limit).select("depth", "bits", F.col("n_bytes").alias("shard_bytes"))
    # A directory of the deepest depth that occurs: each document looks up its longest prefix once.
    depths = buckets.select("depth").distinct()
    paths = F.sort_array(F.collect_set("depth"))
    known = depths.agg(paths.alias("depths")).first()["depths"] or []
    tried = F.explode(F.array(*[F.lit(d) for d in known]) if known else F.array().cast("array<int>")).alias("depth")
    walked = sizes.select("doc_id", "hash", "n_bytes", tried).withColumn("bits", prefix(F.col("hash"), F.col("depth")))
    found = walked.join(buckets, ["depth", "bits"])
    text = F.when(F.col("depth") == 0, "").otherwise(F.lpad(F.conv(F.col("bits").cast("string"), 10, 2), F.col("depth"), "0"))
    return found.select(
        "doc_id", "n_bytes", text.alias("shard"), "depth", "shard_bytes", (F.col("shard_bytes") > limit).alias("oversize")
    )
