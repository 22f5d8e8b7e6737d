"""Tables that streams write batch by batch, so that a repeated batch replaces what it wrote before."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def create(spark: SparkSession, path: str, schema: str) -> None:
    """An empty table; batches become folders of it."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{path}/batch=-1")


def replace_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write the rows of a batch in place of any that an interrupted try has left."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def read_batches(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The rows of all batches, or of those before one."""
    rows = spark.read.parquet(path)
    return (rows if before is None else rows.where(F.col("batch") < before)).drop("batch")


def read_newest(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the newest batch, for tables that each batch writes whole; other batches' files are not read."""
    rows = spark.read.parquet(path)
    newest = rows.agg(F.max("batch")).first()[0]
    return rows.where(F.col("batch") == F.lit(-1 if newest is None else newest)).drop("batch")
