"""What-if of retention and compression on time-partitioned storage."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import changed, micros_between

HYPERTABLE = ["environment_id", "run_id", "database_name", "schema_name", "hypertable_name"]
DEFAULT_RATIO = 5.0
BYTES_PER_GB = 1_000_000_000.0
DAY_MICROS = 86_400_000_000
#: Age bands of chunks and their upper limit in days.
AGE_BANDS = (("0-7d", 7), ("7-30d", 30), ("30-90d", 90), ("90-365d", 365))
OLDEST_BAND = ">365d"
MAX_BACKUP_DAYS = 7
MAX_DRILL_DAYS = 30


@dataclass(frozen=True)
class Scenario:
    """Days after which chunks are dropped and compressed; 0 leaves them as they are."""

    label: str
    retention_days: int = 0
    compress_after_days: int = 0


def compression_ratio(chunks: DataFrame) -> DataFrame:
    """Observed ratio of the compressed chunks of every hypertable, 5 where none was observed."""
    usable = F.col("is_compressed") & (F.col("before_bytes") > 0) & (F.col("after_bytes") > 0)
    sums = chunks.groupBy(*HYPERTABLE).agg(
        F.sum(F.when(usable, F.col("before_bytes"))).alias("before"), F.sum(F.when(usable, F.col("after_bytes"))).alias("after")
    )
    observed = F.coalesce((F.col("before") > 0) & (F.col("after") > 0), F.lit(False))
    return sums.select(
        *HYPERTABLE,
        F.when(observed, F.col("before") / F.col("after")).otherwise(DEFAULT_RATIO).alias("observed_ratio"),
        observed.alias("observed"),
    )


def age_buckets(chunks: DataFrame, now: Column) -> DataFrame:
    """Chunks and bytes per age band, by the end of their range."""
    days = F.floor(micros_between(F.col("range_end"), now) / F.lit(float(DAY_MICROS)))
    age = F.greatest(F.lit(0), F.coalesce(days, F.lit(0)))
    band = F.lit(OLDEST_BAND)
    for label, limit in reversed(AGE_BANDS):
        band = F.when(age <= limit, label).otherwise(band)
    return chunks.groupBy(*HYPERTABLE, band.alias("age_band")).agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("total_size_bytes").alias("bytes")
    )


def _cases(scenarios: Sequence[Scenario]) -> Column:
    """The scenarios as a literal array; they ride along with each row and nothing is joined."""
    return F.array(
        *[
            F.struct(
                F.lit(s.label).alias("label"),
                F.lit(s.retention_days).alias("retention_days"),
                F.lit(s.compress_after_days).alias("compress_after_days"),
            )
            for s in scenarios
        ]
    )


def _evaluated(chunks: DataFrame, scenarios: Sequence[Scenario], now: Column) -> DataFrame:
    """Every chunk under every scenario: whether it is dropped or compressed, and its size afterwards."""
    moment = F.unix_micros(now.cast("timestamp"))

    def older(days: Column) -> Column:
        end = F.unix_micros(F.col("range_end").cast("timestamp"))
        return F.coalesce((days > 0) & ~F.col("integer_range") & (end <= moment - days.cast("bigint") * F.lit(DAY_MICROS)), F.lit(False))

    retention, compress = F.col("s.retention_days"), F.col("s.compress_after_days")
    valid = (retention >= 0) & (compress >= 0)
    size = F.col("total_size_bytes")
    spread = (
        chunks.join(compression_ratio(chunks), HYPERTABLE)
        .withColumn("s", F.explode(_cases(scenarios)))
        .withColumn("dropped", valid & older(retention))
        .withColumn("squeezed", valid & ~F.col("dropped") & ~F.col("is_compressed") & older(compress))
    )
    after = F.when(F.col("dropped"), 0).when(F.col("squeezed"), F.round(size / F.col("observed_ratio")).cast("bigint")).otherwise(size)
    return spread.withColumn("size_after", after)


def simulate_retention(chunks: DataFrame, growth: DataFrame, scenarios: Sequence[Scenario], now: Column) -> DataFrame:
    """Bytes, savings and projections of each scenario for every hypertable.

    ``chunks`` also has chunk_name, dead_tuples and integer_range (true where the
    range is no time).  ``growth``: hypertable keys, growth_per_day.
    """
    totals = _evaluated(chunks, scenarios, now).groupBy(*HYPERTABLE, "s").agg(
        F.sum("total_size_bytes").alias("current_bytes"), F.sum("size_after").alias("bytes_after")
    )
    joined = totals.join(growth, HYPERTABLE, "left")
    grow = F.coalesce("growth_per_day", F.lit(0))
    return joined.select(
        *HYPERTABLE,
        "s.*",
        "current_bytes",
        "bytes_after",
        F.greatest(F.lit(0), F.col("current_bytes") - F.col("bytes_after")).alias("bytes_saved"),
        *[(F.col("bytes_after") + grow * d).alias(f"projection_{d}_bytes") for d in (30, 90, 180)],
    )


def scenario_risks(chunks: DataFrame, dependents: DataFrame, scenarios: Sequence[Scenario], now: Column) -> DataFrame:
    """Risks of each scenario for every hypertable, one row per risk.

    ``dependents``: hypertable keys, view_name, has_refresh_policy, refresh_window_days.
    """
    evaluated = _evaluated(chunks, scenarios, now)
    conflict = F.col("has_refresh_policy") & (F.col("refresh_window_days") > 0) & (F.col("s.retention_days") < F.col("refresh_window_days"))
    view_risk = F.when(conflict, F.concat(F.lit("retention_cagg_conflict:"), F.col("view_name"))).when(
        ~F.col("has_refresh_policy"), F.concat(F.lit("retention_cagg_no_refresh:"), F.col("view_name"))
    )
    chunk_risk = F.concat(F.lit("compress_active_write:"), F.col("chunk_name"))
    columns = [*HYPERTABLE, F.col("s.label").alias("label")]
    views = dependents.withColumn("s", F.explode(_cases(scenarios))).where((F.col("s.retention_days") > 0) & view_risk.isNotNull())
    writing = evaluated.where(F.col("squeezed") & (F.col("dead_tuples") > 0))
    unsure = evaluated.where((F.col("s.compress_after_days") > 0) & ~F.col("observed"))
    invalid = evaluated.where((F.col("s.retention_days") < 0) | (F.col("s.compress_after_days") < 0))
    return (
        views.select(*columns, view_risk.alias("risk"))
        .unionByName(writing.select(*columns, chunk_risk.alias("risk")))
        .unionByName(unsure.select(*columns, F.lit("low_confidence_ratio").alias("risk")))
        .unionByName(invalid.select(*columns, F.lit("invalid_scenario").alias("risk")))
        .distinct()
    )


def growth_per_day(hypertables: DataFrame, runs: DataFrame) -> DataFrame:
    """Daily growth against the successful run before it, at most 14 days away; 0 when unknown or shrinking."""
    dated = hypertables.join(
        runs.where(F.col("status") == "success").select("environment_id", "run_id", "started_at"), ["environment_id", "run_id"]
    )
    order = W.partitionBy("environment_id", *HYPERTABLE[2:]).orderBy("started_at", "run_id")
    span = micros_between(F.lag("started_at").over(order), F.col("started_at"))
    delta = F.col("total_size_bytes") - F.lag("total_size_bytes").over(order)
    usable = (span >= DAY_MICROS // 2) & (span <= 14 * DAY_MICROS) & (delta > 0)
    rate = F.floor(delta / (span / F.lit(float(DAY_MICROS)))).cast("bigint")
    return dated.select(*HYPERTABLE, F.when(usable, rate).otherwise(F.lit(0).cast("bigint")).alias("growth_per_day"))


def unscanned_chunks(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Chunks of two runs with their verdict: unscanned, in_use, not_collected, stats_reset or counter_regression.

    Inputs carry the hypertable keys, chunk_name, seq_scan, idx_scan, n_tup_ins,
    n_tup_upd, n_tup_del and stats_reset; chunks without an earlier row are left out.
    """
    counters = ["seq_scan", "idx_scan", "n_tup_ins", "n_tup_upd", "n_tup_del", "stats_reset"]
    keys = [*HYPERTABLE, "chunk_name"]
    before = previous.select(*keys, F.lit(True).alias("known"), *[F.col(c).alias(f"p_{c}") for c in counters])
    both = current.join(before, keys)
    missing = F.lit(False)
    for c in ("seq_scan", "idx_scan"):
        missing = missing | F.col(c).isNull() | F.col(f"p_{c}").isNull()
    reset = F.col("stats_reset").isNotNull() & (F.col("p_stats_reset").isNull() | (F.col("stats_reset") > F.col("p_stats_reset")))
    fell = (F.col("seq_scan") < F.col("p_seq_scan")) | (F.col("idx_scan") < F.col("p_idx_scan"))
    wrote = F.lit(False)
    for c in ("n_tup_ins", "n_tup_upd", "n_tup_del"):
        wrote = wrote | F.coalesce(F.col(c) > F.col(f"p_{c}"), F.lit(False))
    moved = changed(F.col("seq_scan"), F.col("p_seq_scan")) | changed(F.col("idx_scan"), F.col("p_idx_scan"))
    verdict = (
        F.when(missing, "not_collected")
        .when(reset, "stats_reset")
        .when(fell, "counter_regression")
        .when(~moved & ~wrote, "unscanned")
        .otherwise("in_use")
    )
    return both.select(*keys, verdict.alias("verdict"))


def purge_plan(policies: DataFrame, rows: DataFrame, evidence: DataFrame, now: Column) -> DataFrame:
    """Rows each retention term would make eligible, and what blocks a purge; nothing is removed.

    ``policies``: scope, retention_days, approved_at, approved_by, updated_at.
    ``rows``: scope, created_at.  ``evidence``: kind (backup_verified or
    restore_drill), performed_at.
    """
    now = now.cast("timestamp")
    terms = policies.select("scope", "retention_days")
    cutoff = F.unix_micros(now) - F.col("retention_days").cast("bigint") * F.lit(DAY_MICROS)
    eligible = rows.join(terms, "scope").groupBy("scope").agg(
        F.count_if((F.col("retention_days") > 0) & (F.unix_micros(F.col("created_at").cast("timestamp")) < cutoff)).alias("eligible_rows")
    )
    latest = evidence.agg(
        F.max(F.when(F.col("kind") == "backup_verified", F.col("performed_at"))).alias("backup_at"),
        F.max(F.when(F.col("kind") == "restore_drill", F.col("performed_at"))).alias("drill_at"),
    ).withColumn("_one", F.lit(1))
    joined = policies.join(eligible, "scope", "left").withColumn("_one", F.lit(1)).join(latest, "_one", "left").drop("_one")

    def too_old(column: str, days: int) -> Column:
        return F.unix_micros(now) - F.unix_micros(F.col(column).cast("timestamp")) > F.lit(days * DAY_MICROS)

    unapproved = F.col("approved_at").isNull() | (F.coalesce(F.trim("approved_by"), F.lit("")) == "")
    blockers = F.array_compact(
        F.array(
            F.when(unapproved, "not_approved").when(
                F.col("approved_at") < F.col("updated_at") - F.make_dt_interval(secs=F.lit(1)), "changed_after_approval"
            ),
            F.when(F.col("backup_at").isNull(), "no_backup").when(too_old("backup_at", MAX_BACKUP_DAYS), "backup_too_old"),
            F.when(F.col("drill_at").isNull(), "no_restore_drill").when(too_old("drill_at", MAX_DRILL_DAYS), "restore_drill_too_old"),
        )
    )
    return joined.select(
        "scope",
        "retention_days",
        F.coalesce("eligible_rows", F.lit(0)).alias("eligible_rows"),
        F.concat_ws(",", blockers).alias("blockers"),
        (F.size(blockers) == 0).alias("allowed"),
    )
