"""Which of many names occur in which texts: an inverted index of q-grams, asked for each name's rarest one."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

#: Lengths of the grams: a name is cut into those of the greatest length it has, shorter names are grams themselves.
SIZES = (0, 1, 2, 3, 4, 8, 16)


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of one length; the empty text is the only piece of length 0."""
    last = F.length(text) - size + 1
    cut = F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda at: F.substring(text, at, size)))
    return F.when(size == 0, F.array(F.lit(""))).when(last >= 1, cut).otherwise(F.array().cast("array<string>"))


def _candidates(wanted: DataFrame, kept: DataFrame, place: list[str]) -> DataFrame:
    """``place, _name, _id`` of the texts that hold a name's rarest gram."""
    key = F.xxhash64(*place, "_gram").alias("_key")
    sizes = wanted.select(*place, "_size").distinct()
    postings = kept.join(sizes, place).select(*place, "_id", F.explode(_grams(F.col("_text"), F.col("_size"))).alias("_gram"))
    postings = postings.select(key, "_id")
    held = postings.groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    asked = wanted.select(*place, "_name", F.explode(_grams(F.col("_name"), F.col("_size"))).alias("_gram"))
    rarest = (
        asked.select(*place, "_name", key)
        .join(held, "_key", "left")
        .groupBy(*place, "_name")
        .agg(F.min_by("_key", F.struct("_n", "_key")).alias("_key"), F.bool_and(F.col("_n").isNotNull()).alias("_all"))
        .where("_all")
    )
    return rarest.join(postings, "_key").select(*place, "_name", "_id")


def occurrences(names: DataFrame, texts: DataFrame, place: Sequence[str], name: str, text: str) -> DataFrame:
    """``place, name, text`` for each distinct name that is part of a text of the same place.

    Texts are cut into grams of the few lengths that the names of their place ask for, counted for each place; a name asks
    for the texts of its rarest gram and is compared with those alone.  Grams grow with the names, as many names that
    differ in a few characters have the same short ones.  A name with a gram that no text has is never compared.  Grams
    and texts travel as hashes; texts are read back for the comparison, which also settles equal hashes.
    Nulls in a place, name or text match nothing; an empty name is part of every text; repeated rows count once.
    """
    place = list(place)
    wanted = names.select(*place, F.col(name).alias("_name")).where(F.col("_name").isNotNull()).distinct()
    wanted = wanted.withColumn("_size", F.greatest(*[F.when(F.length("_name") >= n, n) for n in SIZES]))
    kept = texts.select(*place, F.col(text).alias("_text")).where(F.col("_text").isNotNull()).distinct()
    kept = kept.withColumn("_id", F.xxhash64(*place, "_text"))
    return (
        _candidates(wanted, kept, place).join(kept, [*place, "_id"])
        .where(F.contains("_text", "_name"))
        .select(*place, F.col("_name").alias(name), F.col("_text").alias(text))
        .distinct()
    )
