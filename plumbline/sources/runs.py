"""Picking runs: latest, latest complete, and the run before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

FINISHED = ("success", "partial_success")


def latest_run(runs: DataFrame) -> DataFrame:
    """Latest successful or partly successful run of every environment."""
    return _latest(runs.where(F.col("status").isin(*FINISHED)))


def _latest(runs: DataFrame) -> DataFrame:
    names = [c for c in runs.columns if c != "environment_id"]
    newest = F.max_by(F.struct(*names), F.struct("started_at", "run_id"))
    return runs.groupBy("environment_id").agg(newest.alias("r")).select("environment_id", "r.*")


def latest_complete_run(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Latest successful and successfully analysed run of every environment without a failed collector."""
    broken = coverage.where(F.lower("status") == "failed").select("environment_id", "run_id")
    complete = runs.where((F.col("status") == "success") & (F.col("analysis_status") == "success"))
    return _latest(complete.join(broken, ["environment_id", "run_id"], "left_anti"))


def previous_runs(runs: DataFrame, complete: Column | None = None) -> DataFrame:
    """Every complete run with the complete run before it and whether another run lies between.

    Adds previous_run_id, previous_started_at and gap (an incomplete run in between).
    """
    complete = F.col("status") == "success" if complete is None else complete
    order = W.partitionBy("environment_id").orderBy("started_at", "run_id")
    counted = runs.withColumn("complete", complete).withColumn(
        "incomplete_so_far", F.sum((~F.col("complete")).cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0))
    )
    return (
        counted.where("complete")
        .withColumn("previous_run_id", F.lag("run_id").over(order))
        .withColumn("previous_started_at", F.lag("started_at").over(order))
        .withColumn(
            "gap", F.coalesce(F.col("incomplete_so_far") > F.lag("incomplete_so_far").over(order), F.lit(False))
        )
        .drop("complete", "incomplete_so_far")
    )


def as_previous(snapshot: DataFrame, pairs: DataFrame) -> DataFrame:
    """Snapshot rows of the previous run, filed under the run they precede."""
    shift = pairs.where(F.col("previous_run_id").isNotNull()).select(
        "environment_id", F.col("previous_run_id").alias("run_id"), F.col("run_id").alias("next_run_id")
    )
    return snapshot.join(shift, ["environment_id", "run_id"]).drop("run_id").withColumnRenamed("next_run_id", "run_id")


def table_pairs(tables: DataFrame, runs: DataFrame) -> DataFrame:
    """Every table of a complete run next to itself in the previous complete run.

    Adds previous_size_bytes, previous_stats_reset, previous_collected_at and gap.
    Runs without a previous run are left out: there is nothing to compare yet.
    """
    keys = ["environment_id", "run_id", "database_name", "schema_name", "table_name"]
    pairs = previous_runs(runs).where(F.col("previous_run_id").isNotNull())
    before = as_previous(tables, pairs).select(
        *keys,
        F.col("total_size_bytes").alias("previous_size_bytes"),
        F.col("stats_reset").alias("previous_stats_reset"),
        F.col("collected_at").alias("previous_collected_at"),
    )
    return tables.join(pairs.select("environment_id", "run_id", "gap"), ["environment_id", "run_id"]).join(
        before, keys, "left"
    )
