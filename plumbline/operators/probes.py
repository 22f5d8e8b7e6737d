"""Ad-hoc quality probes over one audited table, and bounded samples."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F


def sample_share(limit: int, estimated_rows: int) -> float:
    """The share of a table that holds about four times ``limit`` rows, from 0.001 to 1."""
    return min(1.0, max(0.001, limit * 4 / max(estimated_rows, 1)))


def sample_rows(table: DataFrame, share: float, key: Sequence[str] = ()) -> DataFrame:
    """A repeatable part of the rows of a table.

    With ``key`` a row is taken by a hash of those columns, so the same rows come
    back on every engine; without it by a random number from a fixed seed.
    """
    if not key:
        return table.sample(withReplacement=False, fraction=share, seed=1)
    digest = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    bucket = F.conv(F.substring(digest, 1, 7), 16, 10).cast("bigint")
    return table.where(bucket < int(share * (1 << 28)))


def _issues(measured: DataFrame, kind: str, counts: Mapping[str, Column]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(kind).alias("kind"),
            F.lit(name).alias("column_name"),
            count.cast("bigint").alias("affected_rows"),
            F.col("sampled").cast("bigint").alias("sampled_rows"),
        )
        for name, count in counts.items()
    ]
    return measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def probe_nulls(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULLs of each column, all in one pass."""
    measured = table.agg(
        F.count(F.lit(1)).alias("sampled"), *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in columns]
    )
    return _issues(measured, "null", {c: F.col(f"n_{c}") for c in columns})


def _frequencies(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Totals of each column from its value counts: sampled, nonnull, values. One scan for all columns.

    Every row is spread to its (column, value) pairs and counted once; a value
    that holds most rows is one partial count per task.
    """
    pairs = [F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns]
    groups = table.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.column_name", "p.value").agg(F.count(F.lit(1)).alias("n"))
    known = F.col("value").isNotNull()
    totals = groups.groupBy("column_name").agg(
        F.sum("n").alias("sampled"),
        F.sum(F.when(known, F.col("n"))).alias("nonnull"),
        F.count_if(known).alias("values"),
    )
    asked = table.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in columns])).alias("column_name"))
    return asked.join(totals, "column_name", "left").na.fill(0)


def _each(found: DataFrame, kind: str, affected: Column) -> DataFrame:
    return found.select(
        F.lit(kind).alias("kind"), "column_name", affected.cast("bigint").alias("affected_rows"), F.col("sampled").cast("bigint").alias("sampled_rows")
    )


def probe_duplicates(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Surplus rows per candidate key; NULLs are left out and values compare as text."""
    return _each(_frequencies(table, columns), "duplicate", F.col("nonnull") - F.col("values"))


#: Counters of a sketch: a value with a half of a column's rows cannot drop out of it.
COUNTERS = 64


def _quoted(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def frequent_values(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with, for each column, the value (as text) that alone can hold most of its rows; NULL where there are no values.

    Every task keeps a fixed number of counters for each column and hands those on, so no value is shuffled.
    """
    texts = table.select(*[F.col(_quoted(c)).cast("string").alias(f"v{i}") for i, c in enumerate(columns)])
    sketches = [F.expr(f"approx_top_k(v{i}, 1, {COUNTERS}) FILTER (WHERE v{i} IS NOT NULL)").alias(f"t{i}") for i in range(len(columns))]
    return texts.agg(*sketches).select(*[F.get(f"t{i}", F.lit(0))["item"].alias(f"v{i}") for i in range(len(columns))])


def probe_distribution(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Columns where one value holds at least 80% of 30 or more sampled rows.

    Such a value is its column's frequent one; a second scan counts exactly those.
    """
    if not columns:
        raise ValueError("name at least one column")
    likely = frequent_values(table, columns)
    totals = [F.count(F.lit(1)).alias("sampled")]
    for i, name in enumerate(columns):
        value = F.col(_quoted(name))
        totals += [F.count(value).alias(f"k{i}"), F.count_if(value.cast("string") == likely.select(f"v{i}").scalar()).alias(f"n{i}")]
    each = [
        F.struct(F.lit(name).alias("column_name"), F.col(f"k{i}").alias("nonnull"), F.col(f"n{i}").alias("maximum"))
        for i, name in enumerate(columns)
    ]
    found = table.agg(*totals).select("sampled", F.explode(F.array(*each)).alias("c")).select("sampled", "c.*")
    skewed = (F.col("sampled") >= 30) & (F.col("maximum") * 100 >= F.col("nonnull") * 80) & (F.col("nonnull") > 0)
    return _each(found.where(skewed), "distribution", F.col("maximum"))


def probe_date_range(table: DataFrame, ranges: Mapping[str, tuple[str, str]]) -> DataFrame:
    """Values outside their expected period."""
    measured = table.agg(
        F.count(F.lit(1)).alias("sampled"),
        *[
            F.count_if(
                (F.col(c).cast("timestamp") < F.lit(low).cast("timestamp"))
                | (F.col(c).cast("timestamp") > F.lit(high).cast("timestamp"))
            ).alias(f"n_{c}")
            for c, (low, high) in ranges.items()
        ],
    )
    return _issues(measured, "date_range", {c: F.col(f"n_{c}") for c in ranges})


def probe_orphans(table: DataFrame, relations: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """Child rows without a parent for each simple relation (column -> parent table, parent column)."""
    parts = []
    for column, (parent, parent_column) in relations.items():
        values = table.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
        known = parent.select(F.col(parent_column).alias("parent")).where("parent IS NOT NULL").distinct()
        lost = F.col("parent").isNull() & F.col("value").isNotNull()
        both = values.join(known, F.col("value") == F.col("parent"), "left").agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("sampled"), F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("lost")
        )
        parts.append(_issues(both, "orphan", {column: F.col("lost")}))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union
