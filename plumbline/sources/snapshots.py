"""Reading and appending snapshot tables."""

from __future__ import annotations

import os
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

PARTITIONS = ["environment_id", "run_id"]


def select_runs(snapshot: DataFrame, environments: Sequence[str] = (), runs: Sequence[str] = ()) -> DataFrame:
    """Rows of some environments and runs; on a partitioned table only their files are read."""
    kept = snapshot
    if environments:
        kept = kept.where(F.col("environment_id").isin(*environments))
    if runs:
        kept = kept.where(F.col("run_id").isin(*runs))
    return kept


def read_snapshots(
    spark: SparkSession, root: str, tables: Sequence[str], environments: Sequence[str] = (), runs: Sequence[str] = ()
) -> dict[str, DataFrame]:
    """Snapshot bundle: the named tables below ``root``, partitioned by environment and run."""
    return {
        name: select_runs(spark.read.parquet(os.path.join(root, name)), environments, runs) for name in tables
    }


def new_rows(rows: DataFrame, stored: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not stored yet, each key once."""
    fresh = rows.join(stored.select(*keys), list(keys), "left_anti")
    return fresh.dropDuplicates(list(keys))


def append_snapshot(rows: DataFrame, root: str, table: str, keys: Sequence[str]) -> None:
    """Append rows that the snapshot table lacks; repeating the call adds nothing.

    Only the partitions of the arriving runs are read to find out what is there.
    """
    spark = rows.sparkSession
    path = os.path.join(root, table)
    try:
        stored = spark.read.parquet(path)
    except Exception as error:  # a table that was never written
        if "PATH_NOT_FOUND" not in str(error):
            raise
        fresh = rows.dropDuplicates(list(keys))
    else:
        arriving = rows.select(*PARTITIONS).distinct()
        fresh = new_rows(rows, stored.join(arriving, PARTITIONS, "left_semi"), keys)
    fresh.write.mode("append").partitionBy(*PARTITIONS).parquet(path)


MANIFEST = "token string, environment_id string, run_id string, published_at timestamp"


def stage_runs(rows: DataFrame, root: str, table: str, keys: Sequence[str], token: str | None = None) -> str:
    """Write whole runs under a token of their own, each key once. Nobody sees them until the token is published."""
    token = token or uuid.uuid4().hex
    path = os.path.join(root, table)
    spark = rows.sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(os.path.join(path, "manifest"))
    staged = rows.dropDuplicates(list(keys)).withColumn("token", F.lit(token))
    staged.write.mode("append").partitionBy("token", *PARTITIONS).parquet(os.path.join(path, "data"))
    return token


def publish_runs(spark: SparkSession, root: str, table: str, token: str) -> None:
    """Make the runs of a token visible, all at once: one file of the manifest appears."""
    path = os.path.join(root, table)
    data = spark.read.parquet(os.path.join(path, "data")).where(F.col("token") == token)
    runs = data.select("token", *[F.col(c).cast("string").alias(c) for c in PARTITIONS]).distinct()
    runs.coalesce(1).withColumn("published_at", F.current_timestamp()).write.mode("append").parquet(os.path.join(path, "manifest"))


def published_runs(spark: SparkSession, root: str, table: str) -> DataFrame:
    """``environment_id, run_id, token``: of several tokens of a run the one published first counts, so none is ever mixed."""
    manifest = spark.read.schema(MANIFEST).parquet(os.path.join(root, table, "manifest"))
    return manifest.groupBy(*PARTITIONS).agg(F.min_by("token", F.struct("published_at", "token")).alias("token"))


def publish_snapshot(rows: DataFrame, root: str, table: str, keys: Sequence[str]) -> None:
    """Append whole runs: staged first, then published by the manifest.

    A job that dies in between leaves files that no reader looks at, and is simply repeated; runs that are published already
    are left out, so repeating a finished call adds nothing. Of two writers of one run the first to publish wins.
    """
    spark = rows.sparkSession
    spark.createDataFrame([], MANIFEST).write.mode("append").parquet(os.path.join(root, table, "manifest"))
    fresh = rows.join(published_runs(spark, root, table), PARTITIONS, "left_anti")
    token = stage_runs(fresh, root, table, keys)
    publish_runs(spark, root, table, token)


def read_published(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The rows of the published runs; folders of other tokens are pruned by the join."""
    data = spark.read.parquet(os.path.join(root, table, "data"))
    return data.join(published_runs(spark, root, table), ["token", *PARTITIONS], "left_semi").drop("token")
