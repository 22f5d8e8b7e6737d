"""Pages deep inside an ordered list: from a cursor, or by number over a written rank index."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

#: A sort key: an expression and whether it falls. Nulls are the least, as in Spark: first if rising, last if falling.
Key = tuple[Column, bool]


def ordering(keys: Sequence[Key]) -> list[Column]:
    return [F.desc_nulls_last(k) if falls else F.asc_nulls_first(k) for k, falls in keys]


def _beyond(key: Key, value) -> Column:
    column, falls = key
    if value is None:
        return F.lit(False) if falls else column.isNotNull()
    return (column < F.lit(value)) | column.isNull() if falls else column > F.lit(value)


def cursor_of(keys: Sequence[Key], row: DataFrame) -> tuple:
    """The values of the sort keys of one row, from which ``page_after`` goes on."""
    found = row.select(*[k.alias(f"k{i}") for i, (k, _) in enumerate(keys)]).first()
    return tuple(found) if found else ()


def page_after(rows: DataFrame, keys: Sequence[Key], cursor: tuple = (), limit: int = 50) -> DataFrame:
    """The ``limit`` rows that follow a cursor; the first ones without it.

    Tasks keep ``limit`` rows each however deep the page lies, and the bound of the first key reaches the scan.  The keys must
    tell all rows apart, or equal ones are passed over.
    """
    if cursor:
        same = [k.eqNullSafe(F.lit(v)) for (k, _), v in zip(keys, cursor, strict=True)]
        beyond = [_beyond(k, v) for k, v in zip(keys, cursor, strict=True)]
        rows = rows.where(same[0] | beyond[0]).where(reduce(or_, [reduce(and_, [*same[:i], b]) for i, b in enumerate(beyond)]))
    return rows.orderBy(*ordering(keys)).limit(limit)


def write_rank_index(rows: DataFrame, keys: Sequence[Key], path: str) -> None:
    """Rows sorted over all parts by ranges of the keys, one folder for each part, and how many rows lie before each part.

    Written once for a list that is paged often; a rank needs no sort afterwards.
    """
    order = ordering(keys)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("place")
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", place, F.spark_partition_id().alias("part"))
    dealt.write.mode("overwrite").partitionBy("part").parquet(f"{path}/rows")
    dealt.limit(0).drop("part").write.mode("overwrite").parquet(f"{path}/none")
    sizes = rows.sparkSession.read.schema(dealt.schema).parquet(f"{path}/rows").groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # over one row for each part
    counts = sizes.select("part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    counts.write.mode("overwrite").parquet(f"{path}/parts")


def page_at(spark: SparkSession, path: str, offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset + limit`` of a rank index with their ``position``; only the parts that hold them are read."""
    parts = spark.read.parquet(f"{path}/parts")
    held = parts.where((F.col("before") < offset + limit) & (F.col("before") + F.col("n") > offset)).collect()
    if not held:
        return spark.read.parquet(f"{path}/none").withColumnRenamed("place", "position")
    rows = spark.read.parquet(f"{path}/rows").where(F.col("part").isin([r["part"] for r in held]))
    before = F.create_map(*[F.lit(x) for r in held for x in (r["part"], r["before"])])
    position = (before[F.col("part")] + F.col("place") + 1).alias("position")
    wanted = rows.select(*[c for c in rows.columns if c not in ("part", "place")], position)
    return wanted.where(F.col("position").between(offset + 1, offset + limit)).orderBy("position")
