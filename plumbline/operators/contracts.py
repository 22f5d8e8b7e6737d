"""Declarative data-quality contracts over audited tables.

Row-level checks of one table (nulls, domain, freshness) share a single
aggregate pass.  Uniqueness and orphan checks aggregate by key first, so a key
that holds most of the rows travels as one partial count per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import severity_rank

#: Limits and defaults of a contract.
DEFAULT_MAX_AGE_HOURS = 24.0
DEFAULT_MAX_CHANGE_PCT = 50.0
#: Column names that mark the time of the last change.
FRESHNESS_NAMES = (
    "updated_at",
    "atualizado_em",
    "modified_at",
    "modificado_em",
    "last_updated",
    "last_modified",
    "alterado_em",
    "updatedat",
    "modification_time",
    "data_atualizacao",
    "dt_atualizacao",
)

RESULT_COLUMNS = (
    "check_key",
    "check_type",
    "column_name",
    "result",
    "reason",
    "severity",
    "observed_count",
    "observed_pct",
    "sample_size",
    "sample_method",
    "freshness_age_hours",
)


@dataclass(frozen=True)
class Check:
    """One check; only the settings of its type are read."""

    type: str
    column: str = ""
    columns: tuple[str, ...] = ()
    max_null_pct: float | None = None
    critical: bool = False
    ref_schema: str = ""
    ref_table: str = ""
    ref_column: str = ""
    allowed: tuple[str, ...] = ()
    min: float | None = None
    max: float | None = None
    min_date: str = ""
    max_date: str = ""
    tolerance_pct: float = 0.0
    max_age_hours: float | None = None
    max_change_pct: float | None = None
    severity: str = ""

    @property
    def keys(self) -> tuple[str, ...]:
        return self.columns or ((self.column,) if self.column else ())

    @property
    def key(self) -> str:
        """Stable identity used for trends and de-duplication."""
        if self.type == "uniqueness":
            return f"{self.type}:{','.join(self.keys)}"
        if self.type == "orphan":
            return f"{self.type}:{self.column}->{self.ref_schema}.{self.ref_table}.{self.ref_column}"
        return self.type if self.type == "volume" else f"{self.type}:{self.column}"

    @property
    def rated(self) -> str:
        """Severity of a violation."""
        if self.severity:
            return self.severity
        if self.type == "nulls":
            return "high" if self.critical else "medium"
        return {"uniqueness": "high", "freshness": "high", "volume": "low"}.get(self.type, "medium")

    @property
    def shown_column(self) -> str:
        return ",".join(self.keys) if self.type == "uniqueness" else self.column


@dataclass(frozen=True)
class Contract:
    database: str
    schema: str
    table: str
    checks: tuple[Check, ...] = field(default_factory=tuple)


def _within(value: float | None, low: float, high: float | None) -> bool:
    return value is not None and value >= low and (high is None or value <= high)


def check_problem(check: Check) -> str | None:
    """Why a check cannot be run as written, or None."""
    if check.type == "nulls":
        return None if check.column and _within(check.max_null_pct, 0, 100) else "nulls needs column and max_null_pct in 0..100"
    if check.type == "uniqueness":
        return None if check.keys else "uniqueness needs column or columns"
    if check.type == "orphan":
        named = check.column and check.ref_schema and check.ref_table and check.ref_column
        return None if named else "orphan needs column, ref_schema, ref_table and ref_column"
    if check.type == "domain":
        kinds = [bool(check.allowed), check.min is not None or check.max is not None, bool(check.min_date or check.max_date)]
        valid = check.column and sum(kinds) == 1 and _within(check.tolerance_pct, 0, 100)
        return None if valid else "domain needs column and exactly one of allowed, min/max, min_date/max_date"
    if check.type == "freshness":
        valid = check.column and check.max_age_hours is not None and check.max_age_hours > 0
        return None if valid else "freshness needs column and a positive max_age_hours"
    if check.type == "volume":
        return None if _within(check.max_change_pct, 0, None) else "volume needs max_change_pct >= 0"
    return f"unknown check type {check.type!r}"


def validate(contract: Contract) -> None:
    """Raise ValueError when a contract breaks its structural limits."""
    names = (contract.database, contract.schema, contract.table)
    if not all(n.strip() and len(n.encode()) <= 63 for n in names):
        raise ValueError("database, schema and table need 1 to 63 bytes")
    if not contract.checks:
        raise ValueError("a contract has at least one check")
    for position, check in enumerate(contract.checks):
        if problem := check_problem(check):
            raise ValueError(f"checks[{position}]: {problem}")


def _result(
    check: Check,
    result: Column,
    reason: Column,
    count: Column | None = None,
    pct: Column | None = None,
    size: Column | None = None,
    method: str = "",
    age: Column | None = None,
    executed: Column | None = None,
) -> list[Column]:
    severity = F.lit(check.rated)
    if executed is not None:
        severity = F.when(executed, severity).otherwise("info")
    nothing = F.lit(None)
    return [
        F.lit(check.key).alias("check_key"),
        F.lit(check.type).alias("check_type"),
        F.lit(check.shown_column).alias("column_name"),
        result.alias("result"),
        reason.alias("reason"),
        severity.alias("severity"),
        (count if count is not None else nothing).cast("bigint").alias("observed_count"),
        (pct if pct is not None else nothing).cast("double").alias("observed_pct"),
        (size if size is not None else nothing).cast("bigint").alias("sample_size"),
        F.lit(method).alias("sample_method"),
        (age if age is not None else nothing).cast("double").alias("freshness_age_hours"),
    ]


def _verdict(violated: Column) -> Column:
    return F.when(violated, "violated").otherwise("passed")


def _percent(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part.cast("double") * 100 / whole).otherwise(F.lit(0.0))


def _outside(check: Check) -> Column:
    """Rows whose non-NULL value leaves the allowed domain."""
    value = F.col(check.column)
    if check.allowed:
        return ~value.cast("string").isin(*check.allowed)
    low, high = F.lit(False), F.lit(False)
    if check.min is not None or check.max is not None:
        number = value.cast("double")
        low = low if check.min is None else number < check.min
        high = high if check.max is None else number > check.max
        return low | high
    moment = value.cast("timestamp")
    low = low if not check.min_date else moment < F.lit(check.min_date).cast("timestamp")
    high = high if not check.max_date else moment > F.lit(check.max_date).cast("timestamp")
    return low | high


def _not_executed(target: DataFrame, check: Check, reason: str) -> DataFrame:
    one_row = target.sparkSession.range(1)
    return one_row.select(*_result(check, F.lit("not_executed"), F.lit(reason), executed=F.lit(False)))


def scan_checks(target: DataFrame, checks: Sequence[Check], now: Column, method: str = "exact") -> DataFrame:
    """Nulls, domain and freshness checks of a table in one aggregate pass."""
    aggregates: list[Column] = [F.count(F.lit(1)).alias("total")]
    rows: list[Column] = []
    total = F.col("total")
    for position, check in enumerate(checks):
        name = f"c{position}"
        seen = F.col(name)
        value = F.col(check.column)
        if check.type == "nulls":
            aggregates.append(F.count_if(value.isNull()).alias(name))
            limit = check.max_null_pct or 0.0
            pct = _percent(seen, total)
            reason = F.when(pct > limit, F.format_string("%.2f%% nulos > máximo %.2f%%", pct, F.lit(limit)))
            row = _result(check, _verdict(pct > limit), reason, seen, pct, total, method)
        elif check.type == "domain":
            aggregates.append(F.count_if(value.isNotNull() & _outside(check)).alias(name))
            pct = _percent(seen, total)
            limit = check.tolerance_pct
            reason = F.when(
                pct > limit, F.format_string("%.2f%% fora do domínio (tolerância %.2f%%)", pct, F.lit(limit))
            )
            row = _result(check, _verdict(pct > limit), reason, seen, pct, total, method)
        else:
            aggregates.append(F.max(value).alias(name))
            limit = check.max_age_hours or DEFAULT_MAX_AGE_HOURS
            age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(seen.cast("timestamp"))) / F.lit(3.6e9)
            reason = (
                F.when(seen.isNull(), "sem valor temporal")
                .when(age > limit, F.format_string("%.0f h > máximo %.0f h", age, F.lit(limit)))
                .otherwise(F.format_string("%.0f h", age))
            )
            result = F.when(seen.isNull(), "not_executed").otherwise(_verdict(age > limit))
            row = _result(check, result, reason, method="aggregate_max", age=age)
        rows.append(F.struct(*row))
    measured = target.agg(*aggregates)
    return measured.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def check_uniqueness(target: DataFrame, check: Check, method: str = "exact") -> DataFrame:
    """Rows in groups with more than one row; NULL keys group together."""
    groups = target.groupBy(*check.keys).agg(F.count(F.lit(1)).alias("n"))
    measured = groups.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("duplicates"),
    )
    duplicates = F.col("duplicates")
    reason = F.when(duplicates > 0, "duplicata na amostra").otherwise("sem duplicata na amostra")
    return measured.select(
        *_result(check, _verdict(duplicates > 0), reason, duplicates, None, F.col("total"), method)
    )


def orphan_values(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Distinct non-NULL child values without a parent, with their row counts (``value, n``)."""
    values = (
        child.where(F.col(column).isNotNull())
        .groupBy(F.col(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    keys = parent.select(F.col(parent_column).alias("value"))
    return values.join(keys, "value", "left_anti")


def check_orphan(target: DataFrame, check: Check, parent: DataFrame, method: str = "exact") -> DataFrame:
    """Child rows whose value has no parent.  The child is counted per value before the join."""
    values = target.groupBy(F.col(check.column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    keys = parent.select(F.col(check.ref_column).alias("value")).distinct().withColumn("found", F.lit(True))
    lost = F.col("value").isNotNull() & F.col("found").isNull()
    measured = values.join(keys, "value", "left").agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(lost, F.col("n"))), F.lit(0)).alias("orphans"),
    )
    orphans = F.col("orphans")
    reason = F.when(orphans > 0, "órfã na amostra")
    return measured.select(*_result(check, _verdict(orphans > 0), reason, orphans, None, F.col("total"), method))


def volume_verdict(current: Column, previous: Column, max_change_pct: float) -> tuple[Column, Column, Column]:
    """(result, reason, change percent) of a row estimate against the previous one."""
    change = F.when(previous != 0, F.abs(current - previous).cast("double") * 100 / previous)
    result = (
        F.when(previous.isNull(), "not_executed")
        .when(previous == 0, F.when(current == 0, "passed").otherwise("violated"))
        .when(change > max_change_pct, "violated")
        .otherwise("passed")
    )
    reason = (
        F.when(previous.isNull(), "sem coleta anterior comparável")
        .when((previous == 0) & (current == 0), F.lit(None).cast("string"))
        .when(previous == 0, "variação indefinida a partir de zero")
        .when(
            change > max_change_pct,
            F.format_string("variação estimada %.1f%% fora de ±%.1f%% (confiança baixa)", F.bround(change, 1), F.lit(max_change_pct)),
        )
        .otherwise(F.format_string("variação estimada %.1f%% (confiança baixa)", F.bround(change, 1)))
    )
    return result, reason, change


def check_volume(
    table_snapshots: DataFrame, runs: DataFrame, max_change_pct: float = DEFAULT_MAX_CHANGE_PCT
) -> DataFrame:
    """Row estimate of every table in every successful run against the run before.

    ``table_snapshots`` has environment_id, run_id, database_name, schema_name,
    table_name and row_estimate; ``runs`` has environment_id, run_id, started_at, status.
    """
    by_time = W.partitionBy("environment_id").orderBy("started_at", "run_id")
    pairs = (
        runs.where(F.col("status") == "success")
        .withColumn("previous_run_id", F.lag("run_id").over(by_time))
        .select("environment_id", "run_id", "previous_run_id")
    )
    table = ["environment_id", "database_name", "schema_name", "table_name"]
    earlier = table_snapshots.select(
        *table, F.col("run_id").alias("previous_run_id"), F.col("row_estimate").alias("previous_rows")
    )
    joined = table_snapshots.join(pairs, ["environment_id", "run_id"]).join(
        earlier, [*table, "previous_run_id"], "left"
    )
    check = Check("volume", max_change_pct=max_change_pct)
    result, reason, change = volume_verdict(F.col("row_estimate"), F.col("previous_rows"), max_change_pct)
    seen = F.when(F.col("previous_rows").isNotNull(), F.col("row_estimate"))
    return joined.select(
        "environment_id", "run_id", *table[1:], *_result(check, result, reason, seen, change, method="estimated_rows")
    )


def run_contract(
    target: DataFrame,
    contract: Contract,
    references: Mapping[str, DataFrame],
    now: Column,
    volume: tuple[int, int | None] | None = None,
    method: str = "exact",
) -> DataFrame:
    """All checks of a contract as one result table.

    ``references`` holds parent tables by ``schema.table``; ``volume`` is the
    (current, previous) row estimate when a volume check is wanted.
    """
    validate(contract)
    present = set(target.columns)
    scanned: list[Check] = []
    parts: list[DataFrame] = []
    for check in contract.checks:
        parent = references.get(f"{check.ref_schema}.{check.ref_table}")
        if check.type != "volume" and not set(check.keys) <= present:
            parts.append(_not_executed(target, check, "coluna ausente"))
        elif check.type in ("nulls", "domain", "freshness"):
            scanned.append(check)
        elif check.type == "uniqueness":
            parts.append(check_uniqueness(target, check, method))
        elif check.type == "orphan" and parent is None:
            parts.append(_not_executed(target, check, "sem permissão na tabela referenciada"))
        elif check.type == "orphan":
            parts.append(check_orphan(target, check, parent, method))
        else:
            current, previous = volume or (0, None)
            result, reason, change = volume_verdict(
                F.lit(current), F.lit(previous).cast("bigint"), check.max_change_pct or 0.0
            )
            seen = F.lit(None if previous is None else current)
            row = _result(check, result, reason, seen, change, method="estimated_rows")
            parts.append(target.sparkSession.range(1).select(*row))
    if scanned:
        parts.insert(0, scan_checks(target, scanned, now, method))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def contract_status(results: DataFrame, *by: str) -> DataFrame:
    """Run status and coverage: violations alone keep success, a missing check makes it partial."""
    missing = F.count_if(F.col("result") == "not_executed")
    return results.groupBy(*by).agg(
        F.when(missing > 0, "partial_success").otherwise("success").alias("status"),
        F.when(missing > 0, "partial").otherwise("complete").alias("coverage"),
        F.count_if(F.col("result") == "violated").alias("violated"),
        missing.alias("not_executed"),
        F.count(F.lit(1)).alias("checks"),
    )


def contract_gate(results: DataFrame, fail_on: str, *by: str) -> DataFrame:
    """Exit code: 1 for a violation at or above the severity, else 3 if a check did not run, else 0."""
    broken = (F.col("result") == "violated") & (severity_rank(F.col("severity")) >= severity_rank(F.lit(fail_on)))
    return results.groupBy(*by).agg(
        F.when(F.max(broken.cast("int")) == 1, 1)
        .when(F.max((F.col("result") == "not_executed").cast("int")) == 1, 3)
        .otherwise(0)
        .alias("exit_code")
    )


def contract_trend(results: DataFrame, until: Column, days: int = 90) -> DataFrame:
    """Results per check of the last days, oldest first, gaps marked.

    ``results`` also has finished_at and coverage.
    """
    since = until.cast("timestamp") - F.make_dt_interval(F.lit(days))
    gap = (F.col("coverage") == "partial") | (F.col("result") == "not_executed")
    return (
        results.where(F.col("finished_at").between(since, until.cast("timestamp")))
        .withColumn("gap", gap)
        .orderBy("check_key", "finished_at")
    )


def propose_contracts(columns: DataFrame, constraints: DataFrame) -> DataFrame:
    """Proposed checks for every table of the column and constraint snapshots.

    ``columns``: table keys, column_name, position, data_type, nullable.
    ``constraints``: table keys, constraint_name, constraint_type, key_columns,
    referenced_schema, referenced_table, referenced_columns (arrays).
    One row per check, at most 50 per table in proposal order.
    """
    table = ["environment_id", "run_id", "database_name", "schema_name", "table_name"]
    none = F.lit(None)

    def shape(df: DataFrame, kind: str, column_name: Column, check_key: Column, group: int, place: Column, max_null_pct: Column, max_age_hours: Column) -> DataFrame:
        return df.select(
            *table,
            F.lit(kind).alias("check_type"),
            column_name.alias("column_name"),
            check_key.alias("check_key"),
            max_null_pct.cast("double").alias("max_null_pct"),
            max_age_hours.cast("double").alias("max_age_hours"),
            F.lit(group).alias("stage"),
            place.cast("string").alias("place"),
        )

    name = F.col("column_name")
    padded = F.lpad(F.col("position").cast("string"), 9, "0")
    nulls = shape(columns.where(~F.col("nullable")), "nulls", name, F.concat(F.lit("nulls:"), name), 0, padded, F.lit(0.0), none)

    key_list = F.concat_ws(",", "key_columns")
    unique = constraints.where(F.col("constraint_type").isin("p", "u") & (F.size("key_columns") > 0))
    unique = unique.groupBy(*table, key_list.alias("column_name")).agg(F.min("constraint_name").alias("place"))
    unique = shape(unique, "uniqueness", name, F.concat(F.lit("uniqueness:"), name), 1, F.col("place"), none, none)

    foreign = constraints.where(
        (F.col("constraint_type") == "f") & (F.size("key_columns") == 1) & (F.size("referenced_columns") == 1)
    )
    child = F.element_at("key_columns", 1)
    target = F.concat_ws(".", "referenced_schema", "referenced_table", F.element_at("referenced_columns", 1))
    orphan = shape(
        foreign, "orphan", child, F.concat(F.lit("orphan:"), child, F.lit("->"), target), 1, F.col("constraint_name"), none, none
    )

    kind = F.lower("data_type")
    temporal = kind.startswith("timestamp") | kind.startswith("date")
    dated = columns.where(F.lower(F.trim(name)).isin(*FRESHNESS_NAMES) & temporal)
    dated = dated.groupBy(*table).agg(F.min_by("column_name", "position").alias("column_name"))
    fresh = shape(
        dated, "freshness", name, F.concat(F.lit("freshness:"), name), 2, F.lit(""), none, F.lit(DEFAULT_MAX_AGE_HOURS)
    )

    everything = nulls.unionByName(unique).unionByName(orphan).unionByName(fresh)
    order = W.partitionBy(*table).orderBy("stage", "place", "check_type", "check_key")
    return everything.withColumn("ordinal", F.row_number().over(order)).drop("stage", "place")


def violation_findings(results: DataFrame) -> DataFrame:
    """Each violated check as a ``quality.contract_violation`` finding.

    ``results`` also has environment_id, run_id, database_name, schema_name,
    table_name, contract_id and version_id.
    """
    rule = F.lit("quality.contract_violation")
    object_key = F.concat_ws(".", "database_name", "schema_name", "table_name")
    evidence = F.to_json(
        F.struct("check_key", "check_type", "result", "observed_count", "sample_size")
    )
    return results.where(F.col("result") == "violated").select(
        "environment_id",
        "run_id",
        rule.alias("rule_id"),
        "severity",
        F.lit("table").alias("object_type"),
        object_key.alias("object_key"),
        "database_name",
        "schema_name",
        F.col("table_name").alias("object_name"),
        F.concat(F.lit("Violação de contrato: "), F.col("check_key"), F.lit(" em "), object_key).alias("title"),
        evidence.alias("evidence"),
        F.lit(0.7).alias("confidence"),
        F.concat_ws("|", rule, "contract_id", "version_id", "check_key").alias("dedup_key"),
    )
