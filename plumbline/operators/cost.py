"""Monthly cost of storage, waste and statements from a price table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.operators.rules.base import GIB, MIB, TABLE

BLOCK_BYTES = 8192
HOURS_PER_MONTH = 730
COST_TYPES = ("storage", "unused_index", "bloat", "query")
PRICE_COLUMNS = ("version", "currency", "storage_gb_month", "instance_month", "vcpu_hour", "io_gb", "io_million", "effective_from")


def money(value: Column) -> Column:
    """Rounded to cents, half away from zero."""
    return F.round(value * 100) / 100


def current_price(prices: DataFrame) -> DataFrame:
    """Highest price version of every environment; the effective date is only shown."""
    return prices.groupBy("environment_id").agg(F.max_by(F.struct(*PRICE_COLUMNS), "version").alias("p")).select(
        "environment_id", "p.*"
    )


def price_as_of(rows: DataFrame, prices: DataFrame, at: str) -> DataFrame:
    """Rows with the price version that was in effect at their time, NULL before the first and without a time.

    Rows meet the few prices of their environment and month in one equality join;
    what a month starts with is carried from month to month, one row each.  No
    environment's rows are gathered in one task.
    """
    moment = F.col(at).cast("timestamp")
    start = F.coalesce(F.col("effective_from").cast("timestamp"), F.lit("0001-01-01").cast("timestamp"))
    mark = F.struct(start.alias("start"), F.col("version").cast("bigint").alias("order"), F.struct(*PRICE_COLUMNS).alias("price"))
    marks = prices.select(F.col("environment_id").alias("_env"), F.trunc(start, "month").alias("_month"), mark.alias("mark"))
    inside = marks.groupBy("_env", "_month").agg(F.sort_array(F.collect_list("mark")).alias("_marks"))
    asked = rows.select(F.col("environment_id").alias("_env"), F.trunc(moment, "month").alias("_month")).distinct()
    earlier = W.partitionBy("_env").orderBy("_month").rowsBetween(W.unboundedPreceding, -1)
    months = asked.union(marks.select("_env", "_month")).distinct().join(inside, ["_env", "_month"], "left")
    carried = F.last(F.try_element_at("_marks", F.lit(-1)), ignorenulls=True).over(earlier)
    terms = months.withColumn("_carried", carried)
    joined = rows.join(terms, (F.col("environment_id") == F.col("_env")) & (F.trunc(moment, "month") == F.col("_month")), "left")
    own = F.try_element_at(F.filter("_marks", lambda m: m["start"] <= moment), F.lit(-1))
    chosen = F.coalesce(own, F.col("_carried"))["price"]
    return joined.select(*[rows[c] for c in rows.columns], *[chosen[c].alias(f"price_{c}") for c in PRICE_COLUMNS])


def storage_amount(size_bytes: Column, price: Column) -> Column:
    return money(F.when(size_bytes > 0, size_bytes / F.lit(1e9)).otherwise(0.0) * price)


def _priced(items: DataFrame, prices: DataFrame, cost_type: str) -> DataFrame:
    """Items (environment_id, run_id, object_key, size_bytes) with their storage amount."""
    joined = items.join(current_price(prices).select("environment_id", "currency", "storage_gb_month"), "environment_id", "left")
    return joined.select(
        "environment_id",
        "run_id",
        F.lit(cost_type).alias("cost_type"),
        "object_key",
        F.col("size_bytes").cast("bigint").alias("size_bytes"),
        storage_amount(F.col("size_bytes"), F.col("storage_gb_month")).alias("month_amount"),
        "currency",
    )


def storage_cost(tables: DataFrame, prices: DataFrame) -> DataFrame:
    """Monthly storage of every table."""
    own = tables.where(F.col("schema_name") != "_timescaledb_internal")
    return _priced(own.select(*TABLE[:2], F.concat_ws(".", *TABLE[2:]).alias("object_key"), F.col("total_size_bytes").alias("size_bytes")), prices, "storage")


def unused_index_cost(unused: DataFrame, prices: DataFrame) -> DataFrame:
    """Monthly waste of open unused indexes of 100 MiB or more, known for two weeks or more.

    ``unused``: environment_id, run_id, object_key, size_bytes, first_seen_at, last_seen_at.
    """
    known = F.unix_micros(F.col("last_seen_at").cast("timestamp")) - F.unix_micros(F.col("first_seen_at").cast("timestamp"))
    kept = unused.where((F.col("size_bytes") >= 100 * MIB) & (known >= F.lit(14 * 86_400_000_000)))
    return _priced(kept, prices, "unused_index")


def bloat_cost(bloated: DataFrame, prices: DataFrame) -> DataFrame:
    """Monthly cost of recoverable space; ``bloated`` is the result of ``bloat``."""
    kept = bloated.where((F.col("bloat_ratio") >= 0.3) & (F.col("bloat_bytes") >= GIB))
    return _priced(kept.select(*TABLE[:2], F.concat_ws(".", *TABLE[2:]).alias("object_key"), F.col("bloat_bytes").alias("size_bytes")), prices, "bloat")


def query_cost(deltas: DataFrame, prices: DataFrame) -> DataFrame:
    """Monthly cost of statements from their share of time and the blocks they read.

    ``deltas``: environment_id, run_id, fingerprint, delta_total_us, delta_blocks_read.
    """
    whole = deltas.groupBy("environment_id").agg(F.sum("last_total_us").alias("window_us"))
    joined = deltas.join(whole, "environment_id").join(current_price(prices), "environment_id", "left")
    spent = F.col("delta_total_us")
    share = F.when((F.col("window_us") > 0) & (spent > 0), spent / F.col("window_us")).otherwise(0.0)
    blocks = F.col("delta_blocks_read")
    compute = F.coalesce(F.col("instance_month") * share, F.col("vcpu_hour") * HOURS_PER_MONTH * share, F.lit(0.0))
    reading = F.coalesce(
        blocks * BLOCK_BYTES / F.lit(1e9) * F.col("io_gb"),
        F.when(blocks > 0, blocks / F.lit(1e6) * F.col("io_million")),
        F.lit(0.0),
    )
    return joined.select(
        "environment_id",
        "run_id",
        F.lit("query").alias("cost_type"),
        F.col("fingerprint").alias("object_key"),
        F.lit(0).cast("bigint").alias("size_bytes"),
        F.when(F.col("currency").isNotNull(), money(compute + reading)).alias("month_amount"),
        "currency",
    )


def cost_ranking(items: DataFrame, n: int = 10) -> DataFrame:
    """The dearest items of every run; items without a price come last, larger ones first."""
    order = W.partitionBy("environment_id", "run_id").orderBy(
        F.desc_nulls_last("month_amount"), F.desc("size_bytes"), "cost_type", "object_key"
    )
    return items.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def cost_totals(items: DataFrame, *by: str) -> DataFrame:
    """Monthly totals per cost type over all items, in cents arithmetic."""
    cents = F.round(F.col("month_amount") * 100).cast("bigint")
    return items.groupBy(*by).agg(
        *[
            (F.coalesce(F.sum(F.when(F.col("cost_type") == t, cents)), F.lit(0)) / F.lit(100.0)).alias(f"{t}_month")
            for t in COST_TYPES
        ],
        F.bool_or(F.col("month_amount").isNotNull()).alias("priced"),
    )


def cost_series(items: DataFrame, runs: DataFrame, until: Column, days: int = 90) -> DataFrame:
    """Totals of every run of the last days."""
    until = until.cast("timestamp")
    wanted = runs.select("environment_id", "run_id", "started_at").where(
        F.col("started_at").between(until - F.make_dt_interval(F.lit(days)), until)
    )
    return cost_totals(items.join(wanted, ["environment_id", "run_id"]), "environment_id", "run_id", "started_at")
