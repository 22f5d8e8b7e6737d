"""Rules over index snapshots, workload statistics and live activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.keys import dotted, micros_between, ratio
from plumbline.functions.text import access_method
from plumbline.operators.rules.base import (
    MIB,
    RUN,
    TABLE,
    Bundle,
    Family,
    RowRule,
    Settings,
    match,
    structural,
    table_key,
)

FAMILY = Family()
#: Words that are never a candidate column.
STATEMENT_WORDS = (
    "select",
    "from",
    "where",
    "and",
    "or",
    "order",
    "by",
    "group",
    "limit",
    "join",
    "on",
    "as",
    "inner",
    "left",
    "right",
)
SLOW_MEAN_MS = 500
SLOW_MIN_CALLS = 10


def index_key() -> Column:
    return dotted("database_name", "schema_name", "index_name")


@FAMILY.rows(
    "index.invalid",
)
def index_rules(s: Settings) -> list[RowRule]:
    return [
        structural(
            "index.invalid",
            "indexes",
            F.col("has_validity") & (~F.col("is_valid") | ~F.col("is_ready")),
            "index",
            F.col("index_name"),
            "medium",
            {"is_valid": F.col("is_valid"), "is_ready": F.col("is_ready"), "table": F.col("table_name")},
        )
    ]


@FAMILY.rule("index.overlap", "indexes")
def overlap(b: Bundle, s: Settings) -> DataFrame:
    """Indexes of a table that are equal but for their name."""
    text = F.lower(F.trim(F.regexp_replace("definition", r"\s+", " ")))
    structure = F.regexp_replace(text, "^.*? on ", "")
    usable = b["indexes"].where(
        (~F.col("has_validity") | (F.col("is_valid") & F.col("is_ready"))) & (F.col("definition") != "")
    )
    groups = (
        usable.groupBy(*TABLE, "is_unique", "is_primary", structure.alias("structure"))
        .agg(F.array_sort(F.collect_list("index_name")).alias("names"))
        .where(F.size("names") >= 2)
    )
    place = dotted("database_name", "schema_name")
    return match(
        groups,
        RowRule(
            "index.overlap",
            "indexes",
            F.lit(True),
            "low",
            "index",
            F.concat(place, F.lit(".dup:"), F.element_at("names", 1)),
            F.concat(F.lit("Possibly overlapping indexes on "), dotted("schema_name", "table_name")),
            {"index_names": F.col("names")},
        ),
    )


@FAMILY.rule("index.prefix_overlap", "indexes")
def prefix_overlap(b: Bundle, s: Settings) -> DataFrame:
    """Non-unique full indexes whose key is a strict prefix of another one on the table.

    The longer index is expanded to its proper prefixes, so the pair is an equality join.
    """
    eligible = b["indexes"].where(
        ~F.col("is_primary")
        & ~F.col("is_unique")
        & (F.col("predicate") == "")
        & (F.size("index_columns") > 0)
        & (~F.col("has_validity") | F.col("is_valid"))
    ).select(*TABLE, "index_name", "index_columns", "access_method")
    longer = (
        eligible.where(F.size("index_columns") > 1)
        .select(
            *TABLE,
            "access_method",
            F.col("index_name").alias("long_index"),
            F.explode(
                F.transform(
                    F.sequence(F.lit(1), F.size("index_columns") - 1), lambda n: F.slice("index_columns", F.lit(1), n)
                )
            ).alias("index_columns"),
        )
    )
    return match(
        eligible.join(longer, [*TABLE, "access_method", "index_columns"]),
        structural(
            "index.prefix_overlap",
            "indexes",
            F.lit(True),
            "index",
            F.col("index_name"),
            "low",
            {
                "table": F.col("table_name"),
                "short_index": F.col("index_name"),
                "long_index": F.col("long_index"),
                "prefix_columns": F.col("index_columns"),
            },
        ),
    )


def unchanged_scans(b: Bundle) -> DataFrame:
    """Non-unique indexes whose scan counter stands still since the previous run, without a reset between."""
    keys = [*RUN, "database_name", "schema_name", "index_name"]
    earlier = b["previous_indexes"].select(
        *keys, F.col("idx_scan").alias("previous_idx_scan"), F.col("collected_at").alias("previous_collected_at")
    )
    return (
        b["index_usage"]
        .where(~F.col("is_primary") & ~F.col("is_unique"))
        .join(earlier, keys)
        .where(
            (F.col("idx_scan") == F.col("previous_idx_scan"))
            & ~F.coalesce(F.col("stats_reset") > F.col("previous_collected_at"), F.lit(False))
        )
    )


@FAMILY.rule("index.unused", "index_usage", "previous_indexes")
def unused(b: Bundle, s: Settings) -> DataFrame:
    totals = b["index_usage"].groupBy(*TABLE).agg(F.sum("size_bytes").alias("table_index_bytes"))
    key = index_key()
    return match(
        unchanged_scans(b).join(totals, TABLE),
        RowRule(
            "index.unused",
            "index_usage",
            F.lit(True),
            "medium",
            "index",
            key,
            F.concat(F.lit("Possibly unused index: "), key),
            {
                "table_name": F.col("table_name"),
                "current_idx_scan": F.col("idx_scan"),
                "previous_idx_scan": F.col("previous_idx_scan"),
                "size_bytes": F.col("size_bytes"),
                "table_index_bytes": F.col("table_index_bytes"),
            },
            F.col("index_name"),
        ),
    )


@FAMILY.rule("cost.unused_index_waste", "index_usage", "previous_indexes")
def unused_waste(b: Bundle, s: Settings) -> DataFrame:
    """Unused indexes of 100 MiB or more, watched for two weeks or more."""
    size = F.col("size_bytes")
    days = micros_between(F.col("previous_collected_at"), F.col("collected_at")) / F.lit(86_400_000_000.0)
    key = index_key()
    return match(
        unchanged_scans(b),
        RowRule(
            "cost.unused_index_waste",
            "index_usage",
            (size >= 100 * MIB) & (days >= 14),
            F.when(size >= 5 * 1024 * MIB, "high").otherwise("medium"),
            "index",
            key,
            F.concat(F.lit("Desperdício de índice sem uso: "), key),
            {"size_bytes": size, "window_days": F.round(days).cast("bigint")},
            F.col("index_name"),
        ),
    )


def _one_object(queries: DataFrame) -> DataFrame:
    """Statements that name exactly one qualified object, with its two parts."""
    only = F.element_at("referenced_objects", 1)
    named = queries.where(
        (F.col("evidence_quality") == "object_reference") & (F.size("referenced_objects") == 1) & only.contains(".")
    )
    return named.withColumn("schema_name", F.substring_index(only, ".", 1)).withColumn(
        "table_name", F.expr("substring(referenced_objects[0], instr(referenced_objects[0], '.') + 1)")
    )


@FAMILY.rule("index.investigate_missing", "queries", "tables", "indexes")
def investigate_missing(b: Bundle, s: Settings) -> DataFrame:
    """Often-read tables without any index; the first statement per table is shown."""
    rule = "index.investigate_missing"
    read = _one_object(b["queries"].where(F.col("query_kind") == "select")).where(
        (F.col("calls") >= s.number(rule, "min_calls", 100))
        & (F.col("shared_blocks_read") >= s.number(rule, "min_shared_reads", 1000))
    )
    bare = read.join(b["tables"].select(*TABLE), TABLE, "left_semi").join(
        b["indexes"].select(*TABLE), TABLE, "left_anti"
    )
    first = bare.groupBy(*TABLE).agg(
        F.min_by(F.struct("fingerprint", "calls", "shared_blocks_read", "evidence_quality"), "fingerprint").alias("q")
    )
    return match(
        first,
        structural(
            rule,
            "queries",
            F.lit(True),
            "table",
            F.col("table_name"),
            "low",
            {
                "query_fingerprint": F.col("q.fingerprint"),
                "calls": F.col("q.calls"),
                "shared_blocks_read": F.col("q.shared_blocks_read"),
                "evidence_quality": F.col("q.evidence_quality"),
            },
        ),
    )


@FAMILY.rule("index.candidate", "indexes", "queries")
def candidate(b: Bundle, s: Settings) -> DataFrame:
    """Words of a statement that are no keyword and lead no index of the run.

    The words are one row each while the leading columns are taken out, then
    gathered per statement again in their order of appearance.
    """
    key = [*RUN, "fingerprint"]
    leads = (
        b["indexes"].where(F.size("index_columns") > 0).select(*RUN, F.lower(F.element_at("index_columns", 1)).alias("word")).distinct()
    )
    text = F.lower("fingerprint_text")
    words = F.array_except(
        F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z_][a-z0-9_]*"), F.lit(0))),
        F.array(*[F.lit(w) for w in STATEMENT_WORDS]),
    )
    spread = b["queries"].where(F.col("fingerprint") != "").select(*key, F.posexplode(words).alias("at", "word"))
    kept = spread.join(leads, [*RUN, "word"], "left_anti")
    gathered = kept.groupBy(*key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("at", "word"))), lambda p: p["word"]).alias("columns")
    )
    return match(
        gathered,
        RowRule(
            "index.candidate",
            "queries",
            F.lit(True),
            "low",
            "index",
            F.col("fingerprint"),
            F.concat(F.lit("Index candidate hypothesis "), F.col("fingerprint")),
            {"fingerprint": F.col("fingerprint"), "columns": F.col("columns")},
            confidence=0.4,
        ),
    )


@FAMILY.rule("performance.workload", "queries")
def workload_patterns(b: Bundle, s: Settings) -> DataFrame:
    """Scan, write and cost patterns of statements on one table, found in a single scan."""
    calls, reads, hits = F.col("calls"), F.col("shared_blocks_read"), F.col("shared_blocks_hit")
    kind = F.col("query_kind")
    predicates = {
        "scan": (kind == "select") & (calls >= 100) & (reads >= 1000) & (reads > hits),
        "write": kind.isin("insert", "update", "delete") & (calls >= 1000),
        "cost": F.col("total_exec_ms") >= 60_000,
    }
    seen = _one_object(b["queries"].where(calls >= 10))
    hits_of = F.filter(F.array(*[F.when(p, F.lit(n)) for n, p in predicates.items()]), lambda x: x.isNotNull())
    matched = seen.withColumn("pattern", F.explode(hits_of))
    pattern, object_name = F.col("pattern"), dotted("schema_name", "table_name")
    evidence = F.to_json(
        F.struct(F.col("fingerprint").alias("query_fingerprint"), "query_kind", "calls", "shared_blocks_read", "shared_blocks_hit", "total_exec_ms")
    )
    key = F.concat(table_key(), F.lit(":"), pattern, F.lit(":"), F.col("fingerprint"))
    rule_id = F.concat(F.lit("performance.workload_"), pattern)
    return matched.select(
        *RUN,
        rule_id.alias("rule_id"),
        F.lit("low").alias("severity"),
        F.lit("table").alias("object_type"),
        key.alias("object_key"),
        "database_name",
        "schema_name",
        F.col("table_name").alias("object_name"),
        F.concat(F.lit("Workload "), pattern, F.lit(" pattern on "), object_name).alias("title"),
        evidence.alias("evidence"),
        F.lit(None).cast("double").alias("confidence"),
        F.substring(F.sha2(F.concat(rule_id, F.lit("|"), key, F.lit("|")), 256), 1, 32).alias("dedup_key"),
    )


@FAMILY.rows(
    "performance.slow_query",
)
def slow_queries(s: Settings) -> list[RowRule]:
    only = F.element_at("referenced_objects", 1)
    qualified = (
        (F.size("referenced_objects") == 1) & (F.col("evidence_quality") == "object_reference") & only.contains(".")
    )
    fingerprint = F.when(F.col("fingerprint") == "", "unknown").otherwise(F.col("fingerprint"))
    database = F.col("database_name")
    return [
        RowRule(
            "performance.slow_query",
            "queries",
            (F.col("mean_exec_ms") >= SLOW_MEAN_MS) & (F.col("calls") >= SLOW_MIN_CALLS),
            "low",
            F.when(qualified, "table").otherwise("query"),
            F.when(qualified, F.concat(database, F.lit(".table:"), only, F.lit(".query:"), fingerprint)).otherwise(
                F.concat(database, F.lit(".query:"), fingerprint)
            ),
            F.when(qualified, F.concat(F.lit("Slow workload pattern on "), only)).otherwise(
                F.concat(F.lit("Slow query fingerprint on "), database)
            ),
            {
                "query_fingerprint": fingerprint,
                "calls": F.col("calls"),
                "mean_exec_ms": F.col("mean_exec_ms"),
                "total_exec_ms": F.col("total_exec_ms"),
                "rows": F.col("rows_total"),
            },
            F.when(
                qualified, F.expr("substring(referenced_objects[0], instr(referenced_objects[0], '.') + 1)")
            ).otherwise(fingerprint),
            F.when(qualified, F.substring_index(only, ".", 1)).otherwise(""),
        )
    ]


@FAMILY.rows(
    "performance.lock_wait",
    "performance.high_connections",
)
def activity_rules(s: Settings) -> list[RowRule]:
    database = F.col("database_name")
    share = ratio(F.col("connections"), F.col("max_connections"))
    role = F.col("role_name")
    return [
        RowRule(
            "performance.lock_wait",
            "locks",
            ~F.col("granted") & (F.col("wait_seconds") >= 30),
            "medium",
            "lock",
            F.concat(database, F.lit(".lock:"), F.col("mode"), F.lit(":"), F.col("pid").cast("string")),
            F.concat(F.lit("Long lock wait on "), database, F.lit(" ("), F.col("mode"), F.lit(")")),
            {
                "mode": F.col("mode"),
                "wait_age_seconds": F.col("wait_seconds"),
                "relation": F.col("relation"),
                "pid": F.col("pid"),
            },
            F.col("relation"),
        ),
        RowRule(
            "performance.high_connections",
            "connections",
            (F.col("max_connections") > 0) & (F.col("connections") > 0) & (share >= 0.8),
            F.when(share >= 0.95, "high").otherwise("medium"),
            "database",
            F.when(role != "", F.concat(database, F.lit(".connections:"), role)).otherwise(
                F.concat(database, F.lit(".connections"))
            ),
            F.concat(F.lit("High connection usage on "), database),
            {
                "count": F.col("connections"),
                "max_connections": F.col("max_connections"),
                "usage_ratio": F.round(share, 4),
                "role_name": role,
                "state": F.col("state"),
            },
            role,
        ),
    ]


def with_index_columns(indexes: DataFrame) -> DataFrame:
    """Index rows with their access method read from the definition."""
    return indexes.withColumn("access_method", access_method(F.col("definition")))
