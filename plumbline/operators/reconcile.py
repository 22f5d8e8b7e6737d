"""Checking a restored or copied data set against its origin."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.sources.staging import cut_lineage

#: Tolerated difference of row counts.
TOLERATED_ROWS = 1000
TOLERATED_SHARE = 0.005
#: Bits of the key's hash that name a leaf of the hash tree, and bits of a step from a node to its children.
LEAF_BITS, STEP_BITS = 16, 4


def count_diverges(expected: Column, actual: Column) -> Column:
    """True beyond 1000 rows and 0.5% of the expected count."""
    delta = F.abs(expected - actual)
    share = F.when(expected != 0, delta / F.abs(expected)).otherwise(F.lit(1.0))
    return (delta > TOLERATED_ROWS) & (share > TOLERATED_SHARE)


def reconcile_counts(expected: DataFrame, actual: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row counts of origin and copy per table; tables without an expected count are left out."""
    joined = expected.select(*keys, F.col("rows").alias("expected_rows")).join(
        actual.select(*keys, F.col("rows").alias("actual_rows")), list(keys), "left"
    )
    seen = F.coalesce("actual_rows", F.lit(0))
    return joined.select(
        *keys,
        "expected_rows",
        seen.alias("actual_rows"),
        F.when(count_diverges(F.col("expected_rows"), seen), "diverged").otherwise("ok").alias("status"),
        F.lit("medium").alias("check_severity"),
    )


def reconcile_inventory(origin: DataFrame, copy: DataFrame) -> DataFrame:
    """Objects of the origin the copy lacks (object_type, object_key, compared without case)."""

    def keyed(df: DataFrame) -> DataFrame:
        return df.withColumn("k_type", F.lower("object_type")).withColumn("k_key", F.lower(F.trim("object_key")))

    lost = keyed(origin).join(keyed(copy).select("k_type", "k_key"), ["k_type", "k_key"], "left_anti")
    return lost.select("object_type", "object_key", F.lit("inventory").alias("kind"), F.lit("high").alias("check_severity"))


def group_digest(rows: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Digest of all rows of each group, whatever their order: count, sum and XOR of 60-bit row hashes.

    The two hashes are the halves of the MD5 of the values as text.  Everything
    is a partial aggregate, so a hot group is one row per task.
    """
    by = list(by)
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    hashed = rows.select(*by, F.md5(text).alias("row_hash"))

    def part(start: int) -> Column:
        return F.conv(F.substring("row_hash", start, 15), 16, 10).cast("bigint")

    parts = [F.count(F.lit(1)), F.sum(part(1).cast("decimal(38,0)")), F.bit_xor(part(17))]
    return hashed.groupBy(*by).agg(F.concat_ws("-", *[p.cast("string") for p in parts]).alias("digest"))


def reconcile_rows(origin: DataFrame, copy: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Groups (tables) of origin and copy whose digests differ or are missing on one side; all rows count."""
    by = list(by)
    left = group_digest(origin, by, columns).select(*by, F.col("digest").alias("origin_hash"))
    right = group_digest(copy, by, columns).select(*by, F.col("digest").alias("copy_hash"))
    both = left.join(right, by, "full")
    same = F.col("origin_hash").eqNullSafe(F.col("copy_hash"))
    return both.select(
        *by, "origin_hash", "copy_hash", F.when(same, "ok").otherwise("diverged").alias("status"), F.lit("high").alias("check_severity")
    )


def _row_digests(rows: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """``leaf``, the key, and the two halves of each row's MD5; null and text keys are hashed alike on both sides."""
    text = F.concat_ws("\u001f", *[F.coalesce(F.col(c).cast("string"), F.lit("\u0000")) for c in columns])
    name = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in key])
    leaf = F.shiftrightunsigned(name, 64 - LEAF_BITS).cast("int").alias("leaf")
    half = lambda start: F.conv(F.substring("md5", start, 15), 16, 10).cast("bigint")
    hashed = rows.select(*key, leaf, F.md5(text).alias("md5"))
    return hashed.select(*key, "leaf", half(1).alias("low"), half(17).alias("high"))


def _digest(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Count, sum and XOR of row hashes: digests of children add up to that of their node."""
    total = F.sum(F.col("low").cast("decimal(38,0)"))
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), total.alias("total"), F.bit_xor("high").alias("mixed"))


def _unlike(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Nodes whose digests differ or that one side lacks."""
    values = ["n", "total", "mixed"]
    there = right.select(*[F.col(b).alias(f"o_{b}") for b in by], *[F.col(v).alias(f"o_{v}") for v in values])
    on = [F.col(b).eqNullSafe(F.col(f"o_{b}")) for b in by]
    differs = [~F.col(v).eqNullSafe(F.col(f"o_{v}")) for v in values]
    both = left.join(there, on, "full").where(differs[0] | differs[1] | differs[2])
    return both.select(*[F.coalesce(b, f"o_{b}").alias(b) for b in by], F.col("n").alias("origin_n"), F.col("o_n").alias("copy_n"))


def differing_keys(origin: DataFrame, copy: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The keys whose rows differ between two copies: ``state`` is changed, only_origin or only_copy.

    A hash tree lies over ranges of the key's hash. Each side is read once for the digests of the leaves (counts, sums and
    XORs, partial aggregates); those of the nodes above add up from them. From the root only children of nodes that differ
    are compared, and only rows of leaves that differ are matched key by key. Several rows of one key are compared as a set
    with repetitions; null keys are a key. Equal copies give no row.
    """
    key = list(key)
    sides = [_row_digests(rows, key, columns) for rows in (origin, copy)]
    leaves = [cut_lineage(_digest(rows, ["leaf"])) for rows in sides]
    open_nodes = None
    for bits in range(STEP_BITS, LEAF_BITS + 1, STEP_BITS):
        node = F.shiftright("leaf", LEAF_BITS - bits).alias("node")
        levels = []
        for own in leaves:
            named = own.select(node, "n", "total", "mixed")
            if open_nodes is not None:
                parent = F.shiftright("node", STEP_BITS)
                named = named.join(open_nodes, parent == F.col("parent"), "left_semi")
            levels.append(named.groupBy("node").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.bit_xor("mixed").alias("mixed")))
        open_nodes = cut_lineage(_unlike(*levels, ["node"]).select(F.col("node").alias("parent")))
    within = [rows.join(open_nodes.select(F.col("parent").alias("leaf")), "leaf", "left_semi") for rows in sides]
    found = _unlike(*[_digest(rows, key) for rows in within], key)
    state = F.when(F.col("copy_n").isNull(), "only_origin").when(F.col("origin_n").isNull(), "only_copy").otherwise("changed")
    return found.select(*key, state.alias("state"))
