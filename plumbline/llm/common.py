"""Helpers shared by the operators: words, tables, lineage cuts, texts of Arrow batches."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.staging import cut_lineage, shared_folder  # noqa: F401

#: Rows written to the shared checkpoint folder: computed once, safe against lost executors.
cut = cut_lineage

#: What separates words, as a set of characters and as a pattern.
BLANKS = " \t\n\x0b\x0c\r"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, also where lambdas use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(value: Column) -> Column:
    """The same value, not deterministic on paper: no filter moves below a projection that has it and repeats its work."""
    return F.when(F.spark_partition_id() >= 0, value)


def word_array(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, GAP))


def without(text: Column, characters: str) -> Column:
    """The number of code points of a text after some characters are taken out."""
    return F.length(F.translate(text, characters, ""))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A text column of an Arrow batch, null as the empty text."""
    return [x or "" for x in batch.column(batch.schema.get_field_index(name)).to_pylist()]
