"""Findings kept as tables: a merge reads and replaces only the environments that it brings news of."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators.findings import STATE_KEY, merge_findings
from plumbline.sources.staging import cut_lineage

#: The folder column: a copy of environment_id, which itself is part of the bucket key.
FOLDER = "in_environment"
OVERWRITE = "spark.sql.sources.partitionOverwriteMode"


def _folder() -> Column:
    return F.col("environment_id").alias(FOLDER)


@contextmanager
def _dynamic_overwrite(spark: SparkSession) -> Iterator[None]:
    """Only the folders that rows go to are replaced; ``insertInto`` takes that from the session, not from an option."""
    before = spark.conf.get(OVERWRITE)
    spark.conf.set(OVERWRITE, "dynamic")
    try:
        yield
    finally:
        spark.conf.set(OVERWRITE, before)


def _place(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows dealt as the buckets are, so that a task writes one file for each environment."""
    return rows.repartition(buckets, *STATE_KEY)


@dataclass(frozen=True)
class FindingStore:
    """Tables ``<name>_state`` and ``<name>_events`` below ``path``.

    The state has a folder for each environment and, inside, buckets by the whole key of a finding: merging shuffles what
    arrives and never what is stored.  ``buckets`` fixes how many parts an environment's state is joined in; a part of the
    largest one should fit a task.  environment_id may not be null.  The catalog must outlast the session if the tables are
    to be used by name in the next one.
    """

    spark: SparkSession
    name: str
    path: str
    buckets: int = 64

    def create(self, state: DataFrame) -> None:
        """Write the first state (of which only the columns matter if it is empty); the tables must not exist."""
        filed = state.select(*state.columns, _folder())
        writer = _place(filed, self.buckets).write.format("parquet").partitionBy(FOLDER).bucketBy(self.buckets, *STATE_KEY)
        writer.option("path", f"{self.path}/state").saveAsTable(f"{self.name}_state")

    def state(self) -> DataFrame:
        return self.spark.table(f"{self.name}_state").drop(FOLDER)

    def events(self) -> DataFrame:
        """The events of all merges since the first; each carries the time of its merge as ``merged_at``."""
        return self.spark.read.parquet(f"{self.path}/events").drop(FOLDER, "merge")

    def merge(self, observed: DataFrame, actions: DataFrame, now: Column) -> None:
        """Merge observed findings into the environments they come from; files of other environments stay as they are.

        The names of these environments are listed on the driver, as the folders of the table are for each reading.  Events
        are written first, in folders by time of merge and environment: a call that died is repeated with the same ``now``
        and replaces what it wrote.  A call repeated after it had ended sees its findings as stored ones, so callers keep
        the ``now`` of their last merge.
        """
        observed = cut_lineage(observed)  # read twice; and a constant version stays a column, so the join has the key of the buckets
        names = [r[0] for r in observed.select("environment_id").distinct().collect()]
        if None in names:
            raise ValueError("observed findings need an environment_id")
        if not names:
            return
        stored = self.spark.table(f"{self.name}_state")
        columns = [c for c in stored.columns if c != FOLDER]
        theirs = stored.where(F.col(FOLDER).isin(names)).drop(FOLDER)
        merged = merge_findings(theirs, observed, actions.where(F.col("environment_id").isin(names)), now)
        stamp = F.date_format(now.cast("timestamp"), "yyyyMMdd'T'HHmmss.SSSSSS")
        told = merged.events.select("*", now.cast("timestamp").alias("merged_at"), stamp.alias("merge"), _folder())
        writer = told.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("merge", FOLDER)
        writer.parquet(f"{self.path}/events")
        new = merged.state.select(*columns, _folder())
        with _dynamic_overwrite(self.spark):
            _place(new, self.buckets).write.insertInto(f"{self.name}_state", overwrite=True)
