"""Rules over table, column and constraint snapshots: storage, model, integrity, upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import dotted, micros_between, ratio
from plumbline.functions.text import type_family
from plumbline.operators.rules.base import (
    GIB,
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
from plumbline.operators.substrings import occurrences

FAMILY = Family()
DAY_MICROS = 86_400_000_000


def _days(count) -> Column:
    return F.lit(count) * F.lit(DAY_MICROS)


def consistent_name(name: Column, convention: Column) -> Column:
    return (
        F.when(convention == "none", True)
        .when(convention == "lowercase", name == F.lower(name))
        .otherwise(name.rlike("^[a-z][a-z0-9_]*$"))
    )


@FAMILY.rows(
    "model.naming_inconsistent",
    "model.wide_table",
    "maintenance.stale_analyze",
    "maintenance.dead_tuple_pressure",
    "storage.large_table",
    "integrity.missing_primary_key",
    "model.undocumented_critical",
    "inactivity.possibly_inactive",
    "security.rls_disabled_hypothesis",
)
def table_rules(s: Settings) -> list[RowRule]:
    name = F.col("table_name")
    size, rows = F.col("total_size_bytes"), F.col("row_estimate")
    key = table_key()
    convention = s.word("model.naming_inconsistent", "convention", "snake_case")
    min_columns = s.number("model.wide_table", "min_columns", 50)
    max_age = s.number("maintenance.stale_analyze", "max_age_days", 30)
    dead, live = F.col("n_dead_tup"), F.col("n_live_tup")
    pressure = "maintenance.dead_tuple_pressure"
    return [
        RowRule(
            "storage.large_table",
            "tables",
            size >= GIB,
            "low",
            "table",
            key,
            F.concat(F.lit("Large table: "), key),
            {"size_bytes": size, "threshold": F.lit(GIB)},
        ),
        structural(
            "integrity.missing_primary_key",
            "tables",
            ~F.col("has_primary_key") & ~F.col("is_partition") & (F.col("relation_class") != "foreign_table"),
            "table",
            name,
            "medium",
            {"row_estimate": rows, "relation_class": F.col("relation_class")},
        ),
        structural(
            "model.wide_table",
            "tables",
            F.col("column_count") >= min_columns,
            "table",
            name,
            "low",
            {"column_count": F.col("column_count"), "threshold": min_columns.cast("int")},
        ),
        structural(
            "model.undocumented_critical",
            "tables",
            (F.col("comment") == "")
            & ((size >= s.number("model.undocumented_critical", "min_bytes", GIB)) | (rows >= 1_000_000)),
            "table",
            name,
            "low",
            {"size_bytes": size, "row_estimate": rows},
        ),
        structural(
            "model.naming_inconsistent",
            "tables",
            ~consistent_name(name, convention),
            "table",
            name,
            "info",
            {"convention": convention},
        ),
        structural(
            "maintenance.stale_analyze",
            "tables",
            (micros_between(F.col("last_analyze"), F.col("collected_at")) > max_age.cast("bigint") * F.lit(DAY_MICROS))
            & (rows >= 10_000),
            "table",
            name,
            "low",
            {"row_estimate": rows, "threshold_days": F.lit(30)},
        ),
        structural(
            pressure,
            "vacuum",
            (dead >= s.number(pressure, "min_dead_tuples", 10_000))
            & (live > 0)
            & (ratio(dead, live) >= s.number(pressure, "min_dead_ratio", 0.2)),
            "table",
            name,
            "low",
            {"n_dead_tup": dead, "n_live_tup": live, "estimate_only": F.lit(True)},
        ),
        RowRule(
            "inactivity.possibly_inactive",
            "tables",
            F.col("days_since_dml") >= 90,
            "low",
            "table",
            key,
            F.concat(F.lit("Possibly inactive table: "), key),
            {
                "days_since_dml": F.col("days_since_dml"),
                "threshold_days": F.lit(90),
                "n_live_tup": live,
                "n_tup_ins": F.col("n_tup_ins"),
                "n_tup_upd": F.col("n_tup_upd"),
                "n_tup_del": F.col("n_tup_del"),
                "classification": F.lit("POSSIBLY_INACTIVE"),
            },
        ),
        RowRule(
            "security.rls_disabled_hypothesis",
            "tables",
            ~F.col("rls_enabled")
            & ~F.col("is_partition")
            & (F.col("schema_name") != "information_schema")
            & ~F.col("schema_name").startswith("pg_")
            & ~F.col("schema_name").startswith("_timescaledb"),
            "low",
            "table",
            key,
            F.concat(F.lit("RLS disabled hypothesis: "), key),
            {},
            confidence=0.4,
        ),
    ]


@FAMILY.rows(
    "model.naming_inconsistent",
    "model.type_review",
)
def column_rules(s: Settings) -> list[RowRule]:
    column = F.col("column_name")
    name = dotted("table_name", "column_name")
    kind = F.lower("data_type")
    convention = s.word("model.naming_inconsistent", "convention", "snake_case")
    review = "model.type_review"
    money = (kind == "money") & s.flag(review, "check_money", True)
    moment = (
        kind.contains("timestamp")
        & ~kind.contains("time zone")
        & s.flag(review, "check_timestamp_without_timezone", True)
    )
    coded = (
        (column.endswith("_status") | column.endswith("_code"))
        & kind.contains("character")
        & s.flag(review, "check_status_text", True)
    )
    return [
        structural(
            review,
            "columns",
            money | moment | coded,
            "column",
            name,
            "low",
            {"data_type": F.col("data_type"), "column": column},
        ),
        structural(
            "model.naming_inconsistent",
            "columns",
            ~consistent_name(column, convention),
            "column",
            name,
            "info",
            {"convention": convention},
        ),
    ]


@FAMILY.rows(
    "integrity.constraint_unvalidated",
)
def constraint_rules(s: Settings) -> list[RowRule]:
    return [
        structural(
            "integrity.constraint_unvalidated",
            "constraints",
            ~F.col("validated") & F.col("constraint_type").isin("f", "c"),
            "constraint",
            dotted("table_name", "constraint_name"),
            "medium",
            {
                "table": F.col("table_name"),
                "constraint_type": F.col("constraint_type"),
                "validated": F.lit(False),
            },
        )
    ]


@FAMILY.rule("storage.top_consumer", "tables")
def top_consumer(b: Bundle, s: Settings) -> DataFrame:
    """The five largest tables of every run."""
    order = W.partitionBy(*RUN).orderBy(F.desc("total_size_bytes"), "database_name", "schema_name", "table_name")
    ranked = b["tables"].where(F.col("total_size_bytes") > 0).withColumn("rank", F.row_number().over(order))
    key = table_key()
    return match(
        ranked,
        RowRule(
            "storage.top_consumer",
            "tables",
            F.col("rank") <= 5,
            "info",
            "table",
            key,
            F.concat(F.lit("Top storage consumer: "), key),
            {"size_bytes": F.col("total_size_bytes"), "rank": F.col("rank")},
        ),
    )


def vacuum_scope(tables: DataFrame) -> DataFrame:
    """Tables looked at for dead tuples: all but internal chunks."""
    return tables.where(F.col("schema_name") != "_timescaledb_internal")


@FAMILY.rows(
    "vacuum.high_dead_tuples",
)
def vacuum_rules(s: Settings) -> list[RowRule]:
    dead, live = F.col("n_dead_tup"), F.col("n_live_tup")
    total = live + dead
    share = ratio(dead, total)
    key = table_key()
    return [
        RowRule(
            "vacuum.high_dead_tuples",
            "vacuum",
            (total >= 1000) & (live > 0) & (share >= 0.2),
            F.when(share >= 0.4, "medium").otherwise("low"),
            "table",
            key,
            F.concat(F.lit("High dead-tuple ratio: "), key),
            {"n_live_tup": live, "n_dead_tup": dead, "dead_ratio": F.round(share, 4), "threshold": F.lit(0.2)},
        )
    ]


@FAMILY.rule("index.write_burden", "indexes", "tables")
def write_burden(b: Bundle, s: Settings) -> DataFrame:
    rule = "index.write_burden"
    counts = b["indexes"].groupBy(*TABLE).agg(F.count(F.lit(1)).alias("index_count"))
    writes = F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")
    observed = micros_between(F.col("stats_reset"), F.col("collected_at"))
    busy = b["tables"].where((observed >= _days(30)) & (writes >= s.number(rule, "min_writes", 100_000)))
    return match(
        busy.join(counts, TABLE),
        structural(
            rule,
            "tables",
            F.col("index_count") >= s.number(rule, "min_indexes", 8),
            "table",
            F.col("table_name"),
            "low",
            {"index_count": F.col("index_count"), "writes_since_reset": writes},
        ),
    )


@FAMILY.rule("model.repeated_columns", "columns")
def repeated_columns(b: Bundle, s: Settings) -> DataFrame:
    """Numbered nullable columns that share a prefix."""
    pattern = "^(.*)_([1-9][0-9]*)$"
    numbered = b["columns"].where(F.col("nullable") & F.col("column_name").rlike(pattern))
    groups = numbered.groupBy(*TABLE, F.regexp_extract("column_name", pattern, 1).alias("prefix")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return match(
        groups,
        structural(
            "model.repeated_columns",
            "columns",
            F.col("n") >= 2,
            "table",
            dotted("table_name", "prefix"),
            "info",
            {"prefix": F.col("prefix"), "count": F.col("n")},
        ),
    )


@FAMILY.rule("model.jsonb_critical", "tables", "columns")
def jsonb_critical(b: Bundle, s: Settings) -> DataFrame:
    big = b["tables"].where(F.col("row_estimate") >= 100_000).select(*TABLE, "row_estimate")
    documents = b["columns"].where(F.lower("data_type") == "jsonb")
    return match(
        documents.join(big, TABLE),
        structural(
            "model.jsonb_critical",
            "columns",
            F.lit(True),
            "column",
            dotted("table_name", "column_name"),
            "low",
            {"row_estimate": F.col("row_estimate"), "column": F.col("column_name")},
        ),
    )


@FAMILY.rule("model.implicit_relationship", "constraints", "columns", "tables")
def implicit_relationship(b: Bundle, s: Settings) -> DataFrame:
    """``x_id`` columns without a foreign key where a table ``x`` or ``xs`` exists."""
    linked = (
        b["constraints"]
        .where(F.col("constraint_type") == "f")
        .select(*TABLE, F.explode("key_columns").alias("column_name"))
    )
    named = b["columns"].where(F.col("column_name").endswith("_id"))
    named = named.withColumn("base", F.expr("substring(column_name, 1, length(column_name) - 3)"))
    place = [*RUN, "database_name", "schema_name"]
    names = b["tables"].select(*place, F.explode(F.array("table_name", _singular())).alias("base"))
    free = named.join(linked, [*TABLE, "column_name"], "left_anti")
    return match(
        free.join(names, [*place, "base"], "left_semi"),
        structural(
            "model.implicit_relationship",
            "columns",
            F.lit(True),
            "column",
            dotted("table_name", "column_name"),
            "info",
            {"column": F.col("column_name"), "confidence_note": F.lit("naming-only hypothesis")},
        ),
    )


def _singular() -> Column:
    name = F.col("table_name")
    return F.when(name.endswith("s"), F.expr("substring(table_name, 1, length(table_name) - 1)")).otherwise(name)


def repeated_entities(b: Bundle) -> DataFrame:
    """Tables whose name and column signature an earlier schema of the database has, too.

    Each is paired with the schema just before it only: findings are told apart
    by the table, so the other pairs would only overwrite each other, and a name
    that thousands of schemas share must not grow into all their pairs.
    """
    signature = F.array_sort(F.collect_list(F.concat("column_name", F.lit(":"), type_family(F.col("data_type")))))
    tables = (
        b["columns"]
        .groupBy(*TABLE)
        .agg(F.count(F.lit(1)).alias("column_count"), F.sha2(F.concat_ws("|", signature), 256).alias("signature"))
        .where(F.col("column_count") >= 3)
        .join(b["tables"].select(*TABLE), TABLE, "left_semi")
    )
    alike = W.partitionBy(*RUN, "database_name", "table_name", "signature").orderBy("schema_name")
    return tables.withColumn("other_schema", F.lag("schema_name").over(alike)).where(F.col("other_schema").isNotNull())


@FAMILY.rule("model.duplicate_entity", "columns", "tables")
def duplicate_entity(b: Bundle, s: Settings) -> DataFrame:
    return match(
        repeated_entities(b),
        structural(
            "model.duplicate_entity",
            "tables",
            F.lit(True),
            "table",
            F.col("table_name"),
            "info",
            {"other_schema": F.col("other_schema"), "column_count": F.col("column_count")},
        ),
    )


@FAMILY.rule("integrity.fk_without_index", "constraints", "indexes")
def fk_without_index(b: Bundle, s: Settings) -> DataFrame:
    """Foreign keys that no valid, full B-tree index starts with."""
    foreign = b["constraints"].where((F.col("constraint_type") == "f") & (F.size("key_columns") > 0))
    usable = b["indexes"].where(
        (~F.col("has_validity") | (F.col("is_valid") & F.col("is_ready")))
        & (F.col("predicate") == "")
        & (~F.col("has_validity") | (F.col("access_method") == "btree"))
    )
    # Every prefix of an index's key list serves the foreign keys equal to it.
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size("index_columns")), lambda n: F.concat_ws(",", F.slice("index_columns", F.lit(1), n))
    )
    served = usable.where(F.size("index_columns") > 0).select(*TABLE, F.explode(prefixes).alias("leading"))
    lonely = foreign.withColumn("leading", F.concat_ws(",", "key_columns")).join(
        served, [*TABLE, "leading"], "left_anti"
    )
    return match(
        lonely,
        structural(
            "integrity.fk_without_index",
            "constraints",
            F.lit(True),
            "constraint",
            dotted("table_name", "constraint_name"),
            "medium",
            {
                "table": F.col("table_name"),
                "columns": F.col("key_columns"),
                "referenced_schema": F.col("referenced_schema"),
                "referenced_table": F.col("referenced_table"),
            },
        ),
    )


@FAMILY.rule("integrity.fk_type_mismatch", "constraints", "columns")
def fk_type_mismatch(b: Bundle, s: Settings) -> DataFrame:
    """Column pairs of a foreign key whose type families differ."""
    foreign = b["constraints"].where(
        (F.col("constraint_type") == "f")
        & (F.size("key_columns") == F.size("referenced_columns"))
        & (F.col("referenced_table") != "")
    )
    pairs = foreign.select(
        *TABLE,
        "constraint_name",
        F.when(F.col("referenced_schema") == "", F.col("schema_name")).otherwise(F.col("referenced_schema")).alias("r_schema"),
        F.col("referenced_table").alias("r_table"),
        F.explode(F.arrays_zip("key_columns", "referenced_columns")).alias("pair"),
    ).select("*", F.col("pair.key_columns").alias("column_name"), F.col("pair.referenced_columns").alias("r_column"))
    types = b["columns"].select(*TABLE, "column_name", "data_type")
    targets = b["columns"].select(
        *RUN,
        "database_name",
        F.col("schema_name").alias("r_schema"),
        F.col("table_name").alias("r_table"),
        F.col("column_name").alias("r_column"),
        F.col("data_type").alias("r_type"),
    )
    joined = pairs.join(types, [*TABLE, "column_name"]).join(
        targets, [*RUN, "database_name", "r_schema", "r_table", "r_column"]
    )
    return match(
        joined,
        structural(
            "integrity.fk_type_mismatch",
            "constraints",
            type_family(F.col("data_type")) != type_family(F.col("r_type")),
            "constraint",
            dotted("table_name", "constraint_name", "column_name"),
            "low",
            {
                "column": F.col("column_name"),
                "column_type": F.col("data_type"),
                "referenced_column": F.col("r_column"),
                "referenced_type": F.col("r_type"),
            },
        ),
    )


def default_sequences(columns: DataFrame) -> DataFrame:
    """Columns whose default draws from a sequence, with that sequence's name as written."""
    drawn = columns.where(F.col("default_expr").contains("nextval("))
    return drawn.withColumn("written", F.explode(F.regexp_extract_all("default_expr", F.lit("'([^']*)'::regclass"), 1)))


@FAMILY.rule("integrity.sequence_default_mismatch", "sequences", "columns")
def sequence_default_mismatch(b: Bundle, s: Settings) -> DataFrame:
    """Defaults that use a sequence owned by another column."""
    owned = b["sequences"].where(F.col("owned_by_table") != "")
    named = owned.select(
        *RUN,
        "database_name",
        F.explode(F.array(F.col("sequence_name"), dotted("schema_name", "sequence_name"))).alias("written"),
        dotted("schema_name", "sequence_name").alias("sequence"),
        "owned_by_table",
        "owned_by_column",
    )
    used = default_sequences(b["columns"]).join(named, [*RUN, "database_name", "written"])
    return match(
        used,
        structural(
            "integrity.sequence_default_mismatch",
            "columns",
            (F.col("owned_by_table") != dotted("schema_name", "table_name"))
            | (F.col("owned_by_column") != F.col("column_name")),
            "column",
            dotted("table_name", "column_name"),
            "low",
            {
                "sequence": F.col("sequence"),
                "owned_by_table": F.col("owned_by_table"),
                "owned_by_column": F.col("owned_by_column"),
            },
        ),
    )


@FAMILY.rule("integrity.orphan_sequence", "columns", "sequences")
def orphan_sequence(b: Bundle, s: Settings) -> DataFrame:
    """Unowned sequences whose name occurs in no ``nextval`` default of the database.

    Names written in full are matched first; what is left is searched as text.
    """
    place = [*RUN, "database_name"]
    defaults = b["columns"].where(F.col("default_expr").contains("nextval(")).select(*place, "default_expr").distinct()
    bare = F.transform(
        F.regexp_extract_all("default_expr", F.lit("'([^']*)'"), 1), lambda q: F.element_at(F.split(q, r"\."), -1)
    )
    written = defaults.select(*place, F.explode(bare).alias("sequence_name"))
    free = b["sequences"].where(F.col("owned_by_table") == "")
    left = free.join(written, [*place, "sequence_name"], "left_anti")
    within = occurrences(left, defaults, place, "sequence_name", "default_expr")
    return match(
        left.join(within, [*place, "sequence_name"], "left_anti"),
        structural(
            "integrity.orphan_sequence",
            "sequences",
            F.lit(True),
            "sequence",
            F.col("sequence_name"),
            "low",
            {"owned_by_table": F.col("owned_by_table")},
        ),
    )


@FAMILY.rows(
    "sequence.near_limit",
)
def sequence_rules(s: Settings) -> list[RowRule]:
    used = ratio(F.col("last_value"), F.col("max_value"))
    high = s.number("sequence.near_limit", "sequence_integer_high_ratio", 0.8)
    key = dotted("database_name", "schema_name", "sequence_name")
    return [
        RowRule(
            "sequence.near_limit",
            "sequences",
            F.col("last_value").isNotNull()
            & (F.col("max_value") > 1000)
            & (used >= s.number("sequence.near_limit", "sequence_near_limit_ratio", 0.7)),
            F.when((used >= high) & F.col("data_type").isin("integer", "int4", "serial"), "high").otherwise("medium"),
            "sequence",
            key,
            F.concat(F.lit("Sequence near limit: "), key),
            {
                "last_value": F.col("last_value"),
                "max_value": F.col("max_value"),
                "ratio": F.round(used, 6),
                "owned_by_table": F.col("owned_by_table"),
                "owned_by_column": F.col("owned_by_column"),
                "data_type": F.col("data_type"),
            },
            F.col("sequence_name"),
        )
    ]


@FAMILY.rule("maintenance.growth_trend", "table_pairs")
def growth_trend(b: Bundle, s: Settings) -> DataFrame:
    """Growth of every table between two comparable runs.

    ``table_pairs`` has the table keys, size and reset marks of a run and of its
    comparison run (``previous_*``, NULL when there is none) and ``gap``.
    """
    size, before = F.col("total_size_bytes"), F.col("previous_size_bytes")
    delta = size - before
    grew = (delta > 0) & (size > 0) & (delta >= size * F.lit(0.05))
    window = micros_between(F.col("previous_collected_at"), F.col("collected_at"))
    reset = (F.col("stats_reset") != F.col("previous_stats_reset")) & F.col("stats_reset").isNotNull()
    reset = F.coalesce(reset, F.lit(False))
    broken = F.col("gap") | window.isNull() | (window <= 0) | (window > _days(14))
    coverage = (
        F.when(before.isNull(), "incomplete").when(reset, "stats_reset").when(broken, "gap").otherwise("complete")
    )
    confidence = F.when(coverage != "complete", 0.2).when(window < _days(1), 0.35).otherwise(0.55)
    key = table_key()
    complete = coverage == "complete"
    return match(
        b["table_pairs"],
        RowRule(
            "maintenance.growth_trend",
            "table_pairs",
            before.isNull() | grew,
            F.when(complete, "medium").otherwise("info"),
            "table",
            key,
            F.concat(F.lit("Tendência de manutenção: "), key),
            {
                "coverage": coverage,
                "delta_bytes": F.when(complete, delta),
                "bytes_per_day": F.when(complete, F.round(delta / (window / F.lit(float(DAY_MICROS)))).cast("bigint")),
            },
            confidence=confidence,
            dedup_title="tendência",
        ),
    )
