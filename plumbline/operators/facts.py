"""Facts of snapshots that rules judge: chunks, activity, reads and coverage, computed from the collected rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.intervals import interval_days
from plumbline.operators.substrings import occurrences

RUN = ["environment_id", "run_id"]
HYPERTABLE = [*RUN, "database_name", "schema_name", "hypertable_name"]
DAY_MICROS = 86_400_000_000


def _days(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(DAY_MICROS)


def chunk_facts(hypertables: DataFrame, chunks: DataFrame, now: Column) -> DataFrame:
    """Hypertables with the facts of their chunks, aggregated once per hypertable.

    Chunks that ended more than a day ago and are not compressed, the age of the
    oldest chunk in days, uncompressed bytes older than 30 days, compressed
    chunks with known sizes and their ratio; 0 where there are none.
    """
    age = _days(now, F.col("range_end"))
    plain = ~F.col("is_compressed")
    packed = F.col("is_compressed") & (F.col("before_bytes") > 0) & (F.col("after_bytes") > 0)
    facts = chunks.groupBy(*HYPERTABLE).agg(
        F.count_if(plain & (age > 1)).alias("uncompressed_closed_chunks"),
        F.max(age).alias("_age"),
        F.sum(F.when(plain & (age > 30), F.col("total_size_bytes"))).alias("uncompressed_old_bytes"),
        F.count_if(packed).alias("compressed_chunk_count"),
        F.sum(F.when(packed, F.col("before_bytes"))).alias("_before"),
        F.sum(F.when(packed, F.col("after_bytes"))).alias("_after"),
    )
    zero = F.lit(0).cast("bigint")
    return hypertables.join(facts, HYPERTABLE, "left").select(
        *[hypertables[c] for c in hypertables.columns],
        F.coalesce("uncompressed_closed_chunks", zero).alias("uncompressed_closed_chunks"),
        F.coalesce(F.greatest(F.round("_age").cast("bigint"), zero), zero).alias("oldest_chunk_days"),
        F.coalesce("uncompressed_old_bytes", zero).alias("uncompressed_old_bytes"),
        F.coalesce("compressed_chunk_count", zero).alias("compressed_chunk_count"),
        F.coalesce(F.col("_before") / F.col("_after"), F.lit(0.0)).alias("observed_ratio"),
    )


def policy_ratios(policies: DataFrame, chunks: DataFrame) -> DataFrame:
    """Policies with the compression ratio of their hypertable's chunks, 0 where no sizes are known."""
    known = chunks.where("before_bytes > 0 AND after_bytes > 0").groupBy(*HYPERTABLE)
    ratios = known.agg((F.sum("before_bytes") / F.sum("after_bytes")).alias("_ratio"))
    return policies.join(ratios, HYPERTABLE, "left").select(
        *[policies[c] for c in policies.columns], F.coalesce("_ratio", F.lit(0.0)).alias("compression_ratio")
    )


def activity_facts(tables: DataFrame) -> DataFrame:
    """Tables with the full days since their counters began, if those show no change at all, else NULL."""
    still = (F.col("n_tup_ins") == 0) & (F.col("n_tup_upd") == 0) & (F.col("n_tup_del") == 0)
    days = F.floor(_days(F.col("collected_at"), F.col("stats_reset"))).cast("bigint")
    return tables.withColumn("days_since_dml", F.when(still & F.col("stats_reset").isNotNull(), days))


def outside_reads(hypertables: DataFrame, dimensions: DataFrame, workload: DataFrame) -> DataFrame:
    """Hypertables with whether a statement reads them without naming their time column.

    A statement reads a hypertable that it references or whose name is in its
    text (without case).
    """
    place = [*RUN, "database_name"]
    named = hypertables.select(*HYPERTABLE).join(
        dimensions.where("column_name <> ''").select(*HYPERTABLE, F.lower("column_name").alias("time_column")), HYPERTABLE
    )
    used = workload.where("calls > 0").select(*place, F.lower("fingerprint_text").alias("text"), "referenced_objects")
    referenced = used.select(*place, "text", F.explode("referenced_objects").alias("object"))
    by_object = named.withColumn("object", F.concat_ws(".", "schema_name", "hypertable_name")).join(referenced, [*place, "object"])
    called = named.withColumn("name", F.lower("hypertable_name"))
    by_text = called.join(occurrences(called, used, place, "name", "text"), [*place, "name"])
    columns = [*HYPERTABLE, "time_column", "text"]
    hits = by_object.select(*columns).unionByName(by_text.select(*columns))
    outside = hits.where(~F.contains("text", "time_column")).select(*HYPERTABLE).distinct().withColumn("_outside", F.lit(True))
    return hypertables.join(outside, HYPERTABLE, "left").select(
        *[hypertables[c] for c in hypertables.columns], F.coalesce("_outside", F.lit(False)).alias("reads_outside_time")
    )


def refresh_windows(caggs: DataFrame, policies: DataFrame) -> DataFrame:
    """Continuous aggregates with the full days that their refresh policy goes back, 0 without one.

    A policy belongs to the view or to its materialization; of several the one
    of the smallest job counts.
    """
    key = [*RUN, "database_name", "schema_name", "view_name"]
    refresh = policies.where(F.lower("policy_type") == "refresh").select(
        *RUN, "database_name", F.col("schema_name").alias("_schema"), F.col("hypertable_name").alias("_name"), "job_id", "config"
    )
    owners = caggs.select(*key, F.col("schema_name").alias("_schema"), F.col("view_name").alias("_name")).unionByName(
        caggs.select(*key, F.col("materialization_schema").alias("_schema"), F.col("materialization_hypertable").alias("_name"))
    )
    config = owners.join(refresh, [*RUN, "database_name", "_schema", "_name"]).groupBy(*key).agg(F.min_by("config", "job_id").alias("_config"))
    days = interval_days(F.get_json_object("_config", "$.start_offset"))
    kept = [c for c in caggs.columns if c != "refresh_window_days"]
    return caggs.join(config, key, "left").select(
        *[caggs[c] for c in kept], F.coalesce(F.greatest(days, F.lit(0)), F.lit(0)).cast("bigint").alias("refresh_window_days")
    )


def truncated_runs(servers: DataFrame, coverage: DataFrame) -> DataFrame:
    """Servers with whether a coverage warning of their run tells of a truncated list."""
    cut = coverage.groupBy(*RUN).agg(F.bool_or(F.contains(F.lower("warning"), F.lit("truncated"))).alias("_cut"))
    return servers.join(cut, RUN, "left").select(
        *[servers[c] for c in servers.columns], F.coalesce("_cut", F.lit(False)).alias("chunks_truncated")
    )
