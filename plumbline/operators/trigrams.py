"""Text search over written trigram postings: candidates by intersection, to be verified by the search itself."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Folders of a posting table; a search reads those of its own trigrams.
BUCKETS = 64
SIZE = 3


def grams(text: Column) -> Column:
    """The distinct trigrams of a text; none for null or shorter ones."""
    pieces = F.transform(F.sequence(F.lit(1), F.length(text) - SIZE + 1), lambda i: F.substring(text, i, SIZE))
    return F.when(F.length(text) >= SIZE, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>"))


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_postings(rows: DataFrame, key: Sequence[str], fields: Sequence[str], path: str) -> None:
    """``key, field, gram`` for each trigram of a field's lower-cased text, in folders by a hash of the trigram.

    Files are sorted by trigram, so that within a folder other trigrams are skipped.
    """
    texts = F.array(*[F.struct(F.lit(f).alias("field"), F.lower(F.col(f)).alias("text")) for f in fields])
    each = rows.select(*key, F.explode(texts).alias("t")).select(*key, "t.field", F.explode(grams(F.col("t.text"))).alias("gram"))
    dealt = each.withColumn("bucket", _bucket(F.col("gram"))).repartition("bucket", F.xxhash64(*key) % 4)
    dealt.sortWithinPartitions("bucket", "gram").write.mode("overwrite").partitionBy("bucket").parquet(path)


def candidates(spark: SparkSession, path: str, key: Sequence[str], text: str) -> DataFrame | None:
    """Keys of the rows of which one field has all trigrams of a text; None if the text is too short to have any."""
    low = text.lower()
    wanted = sorted({low[i : i + SIZE] for i in range(len(low) - SIZE + 1)})
    if not wanted:
        return None
    probe = spark.createDataFrame([(g,) for g in wanted], "gram string").select("gram", _bucket(F.col("gram")).alias("bucket"))
    buckets = sorted({r["bucket"] for r in probe.collect()})
    postings = spark.read.parquet(path).where(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    counted = postings.groupBy(*key, "field").agg(F.count_distinct("gram").alias("n"))
    return counted.where(F.col("n") == len(wanted)).select(*key).distinct()


def narrowed(rows: DataFrame, found: DataFrame | None, key: Sequence[str]) -> DataFrame:
    """The rows that are candidates; all of them where the text gives none to ask for."""
    return rows if found is None else rows.join(found, list(key), "left_semi")
