"""Rules over time-partitioned storage: chunks, aggregates, policies and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.intervals import interval_days, interval_seconds, policy_term
from plumbline.functions.keys import dotted, ratio
from plumbline.operators.rules.base import GIB, RUN, Bundle, Family, RowRule, Settings, match

FAMILY = Family()
HYPERTABLE = [*RUN, "database_name", "schema_name", "hypertable_name"]


def hypertable_key() -> Column:
    return dotted("database_name", "schema_name", "hypertable_name")


def is_failed(status: Column) -> Column:
    return F.lower(F.trim(status)).isin("failed", "error", "fatal", "crash")


def _hypertable(rule_id, source, when, severity, title, evidence, object_type="hypertable", key=None, dedup_title=None):
    key = hypertable_key() if key is None else key
    return RowRule(
        rule_id, source, when, severity, object_type, key, F.concat(F.lit(title + ": "), key), evidence,
        F.col("hypertable_name"), dedup_title=dedup_title,
    )


def _policies(b: Bundle, *types: str) -> DataFrame:
    return b["policies"].where(F.lower("policy_type").isin(*types))


@FAMILY.rows(
    "chunk.high_count",
    "timescale.compression_ratio_low",
)
def hypertable_rules(s: Settings) -> list[RowRule]:
    return [
        _hypertable(
            "chunk.high_count",
            "hypertables",
            F.col("num_chunks") >= 500,
            "medium",
            "High chunk count",
            {"num_chunks": F.col("num_chunks"), "threshold": F.lit(500), "size_bytes": F.col("total_size_bytes")},
        ),
        _hypertable(
            "timescale.compression_ratio_low",
            "hypertables",
            (F.col("compressed_chunk_count") >= 5) & (F.col("observed_ratio") > 0) & (F.col("observed_ratio") < 2),
            "low",
            "Taxa de compressão baixa",
            {
                "observed_ratio": F.col("observed_ratio"),
                "compressed_chunk_count": F.col("compressed_chunk_count"),
                "threshold": F.lit(2.0),
            },
        ),
    ]


@FAMILY.rows(
    "timescale.chunk_dead_tuples",
)
def chunk_rules(s: Settings) -> list[RowRule]:
    dead, live = F.col("dead_tuples"), F.col("live_tuples")
    key = dotted("database_name", "schema_name", "chunk_name")
    return [
        RowRule(
            "timescale.chunk_dead_tuples",
            "chunks",
            (dead >= 10_000) | (ratio(dead, live) > 0.2),
            "medium",
            "chunk",
            key,
            F.concat(F.lit("Chunk has local dead-tuple pressure: "), key),
            {"hypertable": F.col("hypertable_name"), "dead_tuples": dead, "live_tuples": live},
            F.col("chunk_name"),
        )
    ]


@FAMILY.rule("chunk.size_skew", "chunks")
def size_skew(b: Bundle, s: Settings) -> DataFrame:
    sizes = b["chunks"].groupBy(*HYPERTABLE).agg(
        F.count(F.lit(1)).alias("chunk_count"),
        F.max("total_size_bytes").alias("max_bytes"),
        F.sum("total_size_bytes").alias("sum_bytes"),
    )
    mean = F.col("sum_bytes") / F.col("chunk_count")
    skew = ratio(F.col("max_bytes"), mean)
    return match(
        sizes,
        _hypertable(
            "chunk.size_skew",
            "chunks",
            (F.col("chunk_count") >= 3) & (skew >= 5),
            "low",
            "Abnormal chunk size distribution",
            {
                "chunk_count": F.col("chunk_count"),
                "max_bytes": F.col("max_bytes"),
                "mean_bytes": F.round(mean).cast("bigint"),
                "ratio": F.round(skew, 1),
            },
        ),
    )


@FAMILY.rows(
    "chunk.inventory_truncated",
)
def coverage_rules(s: Settings) -> list[RowRule]:
    return [
        RowRule(
            "chunk.inventory_truncated",
            "servers",
            F.col("chunks_truncated"),
            "medium",
            "environment",
            F.col("environment_id"),
            "Chunk inventory truncated",
            {},
        )
    ]


@FAMILY.rows(
    "cagg.missing_refresh_policy",
    "cagg.materialization_lag",
    "cagg.realtime_hypothesis",
)
def aggregate_rules(s: Settings) -> list[RowRule]:
    key = dotted("database_name", "schema_name", "view_name")
    name = F.col("view_name")

    def rule(rule_id, when, severity, title, evidence):
        return RowRule(
            rule_id, "caggs", when, severity, "continuous_aggregate", key, F.concat(F.lit(title + ": "), key), evidence, name
        )

    return [
        rule(
            "cagg.missing_refresh_policy",
            ~F.col("has_refresh_policy"),
            "high",
            "CAGG without refresh policy",
            {
                "materialization": dotted("materialization_schema", "materialization_hypertable"),
                "materialized_only": F.col("materialized_only"),
            },
        ),
        rule(
            "cagg.materialization_lag",
            F.col("has_refresh_policy") & (interval_seconds(F.col("lag")) > 3600),
            "high",
            "CAGG materialization lag",
            {"lag": F.col("lag")},
        ),
        rule(
            "cagg.realtime_hypothesis",
            ~F.col("materialized_only"),
            "low",
            "CAGG real-time aggregation enabled",
            {"realtime": F.lit(True), "confidence": F.lit("low")},
        ),
    ]


@FAMILY.rule("cagg.overlap", "caggs")
def aggregate_overlap(b: Bundle, s: Settings) -> DataFrame:
    """Aggregates of a run with the same definition text; the first by name stands for the group."""
    member = F.struct("database_name", "schema_name", "view_name")
    groups = (
        b["caggs"]
        .where(F.col("view_definition") != "")
        .groupBy(*RUN, "view_definition")
        .agg(F.array_sort(F.collect_list(member)).alias("members"))
        .where(F.size("members") >= 2)
        .withColumn("first", F.element_at("members", 1))
    )
    first = groups.select(
        "*",
        F.col("first.database_name").alias("database_name"),
        F.col("first.schema_name").alias("schema_name"),
        F.col("first.view_name").alias("view_name"),
    )
    names = F.transform("members", lambda m: F.concat(m["schema_name"], F.lit("."), m["view_name"]))
    return match(
        first,
        RowRule(
            "cagg.overlap",
            "caggs",
            F.lit(True),
            "low",
            "continuous_aggregate",
            F.concat(F.col("database_name"), F.lit(".overlap:"), F.col("view_name")),
            F.concat(F.lit("Potentially overlapping CAGGs in "), F.col("database_name")),
            {"views": names, "definition": F.col("view_definition")},
            F.col("view_name"),
        ),
    )


@FAMILY.rows(
    "policy.job_failed",
    "cagg.refresh_window_exceeded",
    "policy.compression_ratio",
    "policy.compression_settings",
)
def policy_rules(s: Settings) -> list[RowRule]:
    start = interval_seconds(F.get_json_object("config", "$.start_offset"))
    end = interval_seconds(F.get_json_object("config", "$.end_offset"))
    schedule = interval_seconds(F.col("schedule_interval"))
    kind = F.lower("policy_type")
    compressing = kind.isin("compression", "columnstore")
    segment = F.coalesce(F.get_json_object("config", "$.compress_segmentby"), F.lit(""))
    order = F.coalesce(F.get_json_object("config", "$.compress_orderby"), F.lit(""))
    job = F.col("job_id").cast("string")
    rate = F.col("compression_ratio")
    return [
        RowRule(
            "policy.job_failed",
            "policies",
            is_failed(F.col("last_run_status")),
            "high",
            "policy",
            F.concat(F.col("database_name"), F.lit(".policy."), job),
            F.concat(
                F.lit("Policy job failing: "), F.col("database_name"), F.lit(" #"), job, F.lit(" ("), F.col("policy_type"), F.lit(")")
            ),
            {
                "job_id": F.col("job_id"),
                "policy_type": F.col("policy_type"),
                "last_run_status": F.col("last_run_status"),
                "schedule_interval": F.col("schedule_interval"),
                "proc_name": F.col("proc_name"),
            },
            F.col("hypertable_name"),
        ),
        _hypertable(
            "cagg.refresh_window_exceeded",
            "policies",
            (kind == "refresh") & (start - end > 0) & (schedule > 0) & (start - end > schedule),
            "medium",
            "CAGG refresh window exceeds the job schedule",
            {"window_seconds": (start - end).cast("bigint"), "schedule": F.col("schedule_interval")},
            "continuous_aggregate",
        ),
        _hypertable(
            "policy.compression_ratio",
            "policies",
            compressing & (rate > 0) & (rate < 1.2),
            "low",
            "Poor compression ratio",
            {"ratio": F.round(rate, 4), "before_after": F.lit(True), "policy_type": F.col("policy_type")},
        ),
        _hypertable(
            "policy.compression_settings",
            "policies",
            compressing & (segment == "") & (order == ""),
            "low",
            "Compression segmentby/orderby hypothesis",
            {"policy_type": F.col("policy_type"), "segmentby": segment, "orderby": order},
        ),
    ]


@FAMILY.rows(
    "job.unhealthy",
    "job.slo_exceeded",
)
def job_rules(s: Settings) -> list[RowRule]:
    failed = is_failed(F.col("last_run_status"))
    job = F.col("job_id").cast("string")
    key = F.concat(F.col("database_name"), F.lit(".job."), job)
    schedule = interval_seconds(F.col("schedule_interval"))
    return [
        RowRule(
            "job.unhealthy",
            "jobs",
            failed | (F.col("total_failures") >= 3),
            "medium",
            "job",
            key,
            F.concat(F.lit("Background job unhealthy: "), F.col("database_name"), F.lit(" #"), job),
            {
                "job_id": F.col("job_id"),
                "application": F.col("application"),
                "last_run_status": F.col("last_run_status"),
                "total_failures": F.col("total_failures"),
                "scheduled": F.col("scheduled"),
            },
            F.col("proc_name"),
        ),
        RowRule(
            "job.slo_exceeded",
            "jobs",
            (schedule > 0) & (interval_seconds(F.col("last_run_duration")) > schedule),
            "high",
            "job",
            key,
            F.concat(F.lit("Job slower than its schedule: "), F.col("database_name"), F.lit(" #"), job),
            {
                "job_id": F.col("job_id"),
                "proc": F.col("proc_name"),
                "last_run_status": F.col("last_run_status"),
                "duration": F.col("last_run_duration"),
                "schedule_interval": F.col("schedule_interval"),
                "total_failures": F.col("total_failures"),
            },
            F.col("proc_name"),
        ),
    ]


@FAMILY.rule("job.workers_saturated", "jobs")
def workers_saturated(b: Bundle, s: Settings) -> DataFrame:
    load = b["jobs"].groupBy(*RUN).agg(
        F.count_if("scheduled").alias("scheduled_jobs"), F.max("max_background_workers").alias("workers")
    )
    return match(
        load,
        RowRule(
            "job.workers_saturated",
            "jobs",
            (F.col("workers") > 0) & (F.col("scheduled_jobs") > F.col("workers")),
            "high",
            "environment",
            F.col("environment_id"),
            "Timescale background workers are saturated",
            {"scheduled_jobs": F.col("scheduled_jobs"), "max_background_workers": F.col("workers")},
        ),
    )


@FAMILY.rule("policy.missing_retention", "policies", "hypertables")
def missing_retention(b: Bundle, s: Settings) -> DataFrame:
    bare = b["hypertables"].join(_policies(b, "retention").select(*HYPERTABLE), HYPERTABLE, "left_anti")
    return match(
        bare,
        _hypertable(
            "policy.missing_retention",
            "hypertables",
            F.col("total_size_bytes") > 0,
            "medium",
            "Hypertable without retention policy",
            {"size_bytes": F.col("total_size_bytes"), "num_chunks": F.col("num_chunks")},
        ),
    )


@FAMILY.rule("policy.missing_compression", "policies", "hypertables")
def missing_compression(b: Bundle, s: Settings) -> DataFrame:
    bare = b["hypertables"].join(
        _policies(b, "compression", "columnstore").select(*HYPERTABLE), HYPERTABLE, "left_anti"
    )
    return match(
        bare,
        _hypertable(
            "policy.missing_compression",
            "hypertables",
            F.col("total_size_bytes") > GIB,
            "low",
            "Large hypertable without compression policy",
            {"size_bytes": F.col("total_size_bytes")},
        ),
    )


@FAMILY.rule("policy.retention_chunk_mismatch", "policies", "hypertables")
def retention_chunk_mismatch(b: Bundle, s: Settings) -> DataFrame:
    """Retention terms shorter than a chunk or no multiple of it."""
    intervals = b["hypertables"].where(F.col("chunk_interval") != "").select(*HYPERTABLE, "chunk_interval")
    keep, chunk = interval_seconds(policy_term(F.col("config"))), interval_seconds(F.col("chunk_interval"))
    joined = _policies(b, "retention").join(intervals, HYPERTABLE).where((keep > 0) & (chunk > 0))
    key = hypertable_key()
    return match(
        joined,
        RowRule(
            "policy.retention_chunk_mismatch",
            "policies",
            (keep < chunk) | ((keep > chunk) & (keep % chunk != 0)),
            "high",
            "hypertable",
            key,
            F.concat(
                F.when(keep < chunk, "Retention does not cover a closed chunk: ").otherwise(
                    "Retention drops later than the chunk boundary: "
                ),
                key,
            ),
            {"retention": policy_term(F.col("config")), "chunk_interval": F.col("chunk_interval")},
            F.col("hypertable_name"),
        ),
    )


@FAMILY.rule("policy.reorder_hypothesis", "policies", "hypertables")
def reorder_hypothesis(b: Bundle, s: Settings) -> DataFrame:
    bare = b["hypertables"].join(_policies(b, "reorder").select(*HYPERTABLE), HYPERTABLE, "left_anti")
    return match(
        bare,
        _hypertable(
            "policy.reorder_hypothesis", "hypertables", F.col("reads_outside_time"), "low", "Reorder policy hypothesis", {}
        ),
    )


@FAMILY.rule("policy.compression_not_applied", "policies", "hypertables")
def compression_not_applied(b: Bundle, s: Settings) -> DataFrame:
    applied = (
        _policies(b, "compression", "columnstore")
        .groupBy(*HYPERTABLE)
        .agg(F.max_by("policy_type", "job_id").alias("policy_type"))
    )
    return match(
        b["hypertables"].join(applied, HYPERTABLE),
        _hypertable(
            "policy.compression_not_applied",
            "hypertables",
            F.col("uncompressed_closed_chunks") >= 1,
            "medium",
            "Compression policy is not compressing closed chunks",
            {
                "uncompressed_closed_chunks": F.col("uncompressed_closed_chunks"),
                "policy_type": F.col("policy_type"),
                "size_bytes": F.col("total_size_bytes"),
            },
        ),
    )


@FAMILY.rule("timescale.retention_missing", "policies", "hypertables")
def retention_missing(b: Bundle, s: Settings) -> DataFrame:
    bare = b["hypertables"].join(_policies(b, "retention").select(*HYPERTABLE), HYPERTABLE, "left_anti")
    return match(
        bare,
        _hypertable(
            "timescale.retention_missing",
            "hypertables",
            (F.col("total_size_bytes") >= 10 * GIB) & (F.col("oldest_chunk_days") >= 365),
            "low",
            "Retenção ausente em hypertable grande",
            {
                "size_bytes": F.col("total_size_bytes"),
                "chunks_older_than_days": F.col("oldest_chunk_days"),
                "threshold_bytes": F.lit(10 * GIB),
            },
        ),
    )


@FAMILY.rule("timescale.compression_missing", "policies", "hypertables")
def compression_missing(b: Bundle, s: Settings) -> DataFrame:
    having = _policies(b, "compression", "columnstore").select(*HYPERTABLE).distinct().withColumn("has_policy", F.lit(True))
    share = ratio(F.col("uncompressed_old_bytes"), F.col("total_size_bytes"))
    has_policy = F.coalesce(F.col("has_policy"), F.lit(False))
    return match(
        b["hypertables"].join(having, HYPERTABLE, "left"),
        _hypertable(
            "timescale.compression_missing",
            "hypertables",
            (F.col("total_size_bytes") >= 5 * GIB) & (~has_policy | ~F.col("compression_enabled")) & (share >= 0.5),
            "medium",
            "Compressão ausente em hypertable grande",
            {
                "size_bytes": F.col("total_size_bytes"),
                "uncompressed_old_bytes": F.col("uncompressed_old_bytes"),
                "uncompressed_old_share": F.round(share, 3),
                "compression_enabled": F.col("compression_enabled"),
                "has_compression_policy": has_policy,
            },
        ),
    )


@FAMILY.rule("timescale.retention_cagg_conflict", "policies", "caggs", "hypertables")
def retention_cagg_conflict(b: Bundle, s: Settings) -> DataFrame:
    """Retention terms shorter than the refresh window of a dependent aggregate."""
    days = interval_days(policy_term(F.col("config")))
    terms = (
        _policies(b, "retention").where(days > 0).groupBy(*HYPERTABLE).agg(F.max_by(days, "job_id").alias("retention_days"))
    )
    named = (F.col("source_schema") != "") & (F.col("source_name") != "")
    window = F.when(F.col("refresh_window_days") == 0, interval_days(F.col("lag"))).otherwise(F.col("refresh_window_days"))
    dependents = b["caggs"].where("has_refresh_policy").select(
        *RUN,
        "database_name",
        F.when(named, F.col("source_schema")).otherwise(F.col("schema_name")).alias("h_schema"),
        F.when(named, F.col("source_name")).otherwise(F.col("view_name")).alias("hypertable_name"),
        dotted("schema_name", "view_name").alias("cagg"),
        "view_name",
        window.cast("int").alias("window_days"),
    ).withColumnRenamed("h_schema", "schema_name")
    joined = b["hypertables"].join(terms, HYPERTABLE).join(dependents, HYPERTABLE)
    key = hypertable_key()
    rule = RowRule(
        "timescale.retention_cagg_conflict",
        "hypertables",
        (F.col("window_days") > 0) & (F.col("retention_days") < F.col("window_days")),
        "high",
        "hypertable",
        key,
        F.concat(F.lit("Retenção conflita com CAGG "), F.col("cagg")),
        {
            "retention_days": F.col("retention_days"),
            "cagg": F.col("cagg"),
            "refresh_window_days": F.col("window_days"),
        },
        F.col("hypertable_name"),
        dedup_key=F.concat(key, F.lit(":"), F.col("view_name")),
    )
    return match(joined, rule)
