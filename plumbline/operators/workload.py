"""Statement fingerprints, counter windows, regressions and histories."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import changed, dotted, micros_between
from plumbline.functions.text import strip_literals

DAY_MICROS = 86_400_000_000
#: Statement words in front of an object name.
_OBJECT = r"(?<![a-z0-9_])(?:from|join|update|into)\s+([a-z_][a-z0-9_$]*\.[a-z_][a-z0-9_$]*)"
STATEMENT_KINDS = ("select", "insert", "update", "delete")


def sql_fingerprint(queries: DataFrame, text: str = "query") -> DataFrame:
    """Statements with normalised text, its hash, the statement kind and the qualified objects it names."""
    clean = F.col("fingerprint_text")
    first = F.substring_index(clean, " ", 1)
    return (
        queries.withColumn("fingerprint_text", strip_literals(F.col(text)))
        .withColumn("fingerprint", F.concat(F.lit("sha256:"), F.sha2(clean, 256)))
        .withColumn("query_kind", F.when(first.isin(*STATEMENT_KINDS), first).otherwise("other"))
        .withColumn("referenced_objects", F.array_sort(F.array_distinct(F.regexp_extract_all(clean, F.lit(_OBJECT), 1))))
    )


# --- windows ---------------------------------------------------------------------------------
def complete_edges(points: DataFrame) -> DataFrame:
    """Collection points that may bound a window."""
    return points.where(
        (F.col("completeness") == "complete") & (F.col("run_status") == "success") & (F.col("analysis_status") == "success")
    )


def reset_free_window(edges: DataFrame, by: Sequence[str] = ("environment_id",)) -> DataFrame:
    """Longest run of edges without a counter reset, the latest one on ties.

    One row per group with first and last edge; groups with no run of two edges are left out.
    """
    by = list(by)
    order = W.partitionBy(*by).orderBy("started_at", "run_id")
    reset = changed(F.col("stats_reset"), F.lag("stats_reset").over(order)) | changed(
        F.col("workload_reset"), F.lag("workload_reset").over(order)
    )
    first_edge = F.lag("run_id").over(order).isNull()
    islands = edges.withColumn("reset", (~first_edge & reset).cast("int")).withColumn("island", F.sum("reset").over(order))
    edge = F.struct("started_at", "run_id")
    runs = islands.groupBy(*by, "island").agg(
        F.count(F.lit(1)).alias("edges"), F.min(edge).alias("first"), F.max(edge).alias("last")
    )
    best = runs.where(F.col("edges") >= 2).groupBy(*by).agg(
        F.max(F.struct("edges", "last", "first")).alias("best"), F.max("island").alias("islands")
    )
    return best.select(
        *by,
        F.col("best.edges").alias("edges"),
        F.col("best.first.run_id").alias("first_run_id"),
        F.col("best.first.started_at").alias("first_at"),
        F.col("best.last.run_id").alias("last_run_id"),
        F.col("best.last.started_at").alias("last_at"),
    )


def resolve_windows(points: DataFrame, by: Sequence[str] = ("environment_id",), max_gap_days: float = 7.0) -> DataFrame:
    """First and last comparable collection of every group, or the reason why there is none.

    ``reason`` is empty for a usable window, else too_few_edges, stats_reset or gap.
    """
    by = list(by)
    edges = complete_edges(points)
    counted = points.select(*by).distinct().join(
        edges.groupBy(*by).agg(F.count(F.lit(1)).alias("all_edges")), by, "left"
    )
    joined = counted.join(reset_free_window(edges, by), by, "left")
    span = micros_between(F.col("first_at"), F.col("last_at"))
    reason = (
        F.when(F.coalesce("all_edges", F.lit(0)) < 2, "too_few_edges")
        .when(F.col("edges").isNull(), "stats_reset")
        .when((span <= 0) | (span > max_gap_days * DAY_MICROS), "gap")
        .otherwise("")
    )
    return joined.withColumn("reason", reason).withColumn(
        "used_subwindow", F.coalesce(F.col("edges") < F.col("all_edges"), F.lit(False))
    )


def digest_max_gap(window_days: float) -> float:
    """Longest gap, in days, for a digest over windows of this many days."""
    return max(2 * window_days + 1, 7.0)


def counter_deltas(workload: DataFrame, windows: DataFrame, by: Sequence[str] = ("environment_id",)) -> DataFrame:
    """Counter growth of every statement between the edges of its window.

    A statement only in the last edge counts with its whole counters, one only
    in the first edge is kept as gone.  ``windows`` is the result of
    ``resolve_windows``; ``workload`` has database_name, fingerprint, calls,
    total_us and blocks_read.
    """
    by = list(by)
    usable = windows.where(F.col("reason") == "").select(*by, "first_run_id", "last_run_id")
    keys = [*by, "database_name", "fingerprint"]
    counters = ["calls", "total_us", "blocks_read"]

    def edge(name: str) -> DataFrame:
        at = usable.select(*by, F.col(f"{name}_run_id").alias("run_id"))
        return workload.join(at, [*by, "run_id"]).select(
            *keys, F.col("run_id").alias(f"{name}_run_id"), *[F.col(c).alias(f"{name}_{c}") for c in counters]
        )

    both = edge("first").join(edge("last"), keys, "full")
    gone = F.col("last_run_id").isNull()
    grown = [
        F.when(gone, F.lit(0)).otherwise(F.col(f"last_{c}") - F.coalesce(f"first_{c}", F.lit(0))).cast("bigint").alias(f"delta_{c}")
        for c in counters
    ]
    sides = [F.coalesce(f"{side}_{c}", F.lit(0)).cast("bigint").alias(f"{side}_{c}") for side in ("first", "last") for c in counters]
    return both.select(
        *keys, F.col("first_run_id").isNotNull().alias("in_first"), (~gone).alias("in_last"), *grown, *sides
    )


@dataclass(frozen=True)
class DigestThresholds:
    """Limits of the regression classes."""

    regression_mean_share: float = 0.50
    regression_us: float = 10_000.0
    min_calls: int = 100
    high_total_share: float = 1.00
    high_share: float = 0.05
    new_share: float = 0.05
    gone_share: float = 0.01
    improvement_share: float = 0.30
    top: tuple[tuple[str, int], ...] = (("regression", 10), ("new", 10), ("gone", 5), ("improvement", 5))


def _contribution(delta: str, last: str, first: str, kind: str) -> Column:
    """What a statement adds to its window: growth, else the only edge it is in."""
    only_first = F.col("in_first") & (F.col(last) == 0) & (F.col(first) > 0)
    value = (
        F.when(F.col("in_first") & (F.col(delta) > 0), F.col(delta))
        .when(only_first, F.col(first))
        .when(F.col(delta) > 0, F.col(delta))
        .when((F.col(last) > 0) & ~F.col("in_first"), F.col(last))
    )
    return value.when(F.col(delta) < 0, 0).otherwise(F.col(delta)) if kind == "calls" else value.otherwise(F.col(delta))


def window_activity(deltas: DataFrame, by: Sequence[str] = ("environment_id",)) -> DataFrame:
    """Calls, time and mean of every active statement, with the total time of the window.

    The total sums the cumulative counters at the last edge, not the growth.
    """
    by = list(by)
    calls = _contribution("delta_calls", "last_calls", "first_calls", "calls")
    total = _contribution("delta_total_us", "last_total_us", "first_total_us", "total")
    still = (F.col("delta_calls") == 0) & (F.col("delta_total_us") == 0)
    gone = F.col("in_first") & (F.col("last_calls") == 0) & (F.col("first_calls") > 0) & still
    totals = deltas.groupBy(*by).agg(F.sum("last_total_us").alias("window_us"))
    active = deltas.withColumn("calls", calls).withColumn("total_us", total)
    active = active.where(gone | (F.col("calls") > 0) | (F.col("total_us") > 0))
    mean = F.when((F.col("calls") > 0) & (F.col("total_us") > 0), F.col("total_us") / F.col("calls")).otherwise(0.0)
    return active.join(totals, by).select(
        *by, "database_name", "fingerprint", "calls", "total_us", mean.alias("mean_us"), "window_us"
    )


def compare_windows(prior: DataFrame, current: DataFrame, by: Sequence[str] = ("environment_id",), t: DigestThresholds = DigestThresholds()) -> DataFrame:
    """Statements of two windows side by side with their class and severity."""
    by = list(by)
    keys = [*by, "database_name", "fingerprint"]
    measures = ["calls", "total_us", "mean_us"]

    def side(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.lit(True).alias(f"in_{name}"), *[F.col(c).alias(f"{name}_{c}") for c in measures])

    def totals(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*by).agg(F.max("window_us").alias(f"{name}_window_us"))

    both = (
        side(prior, "prior")
        .join(side(current, "current"), keys, "full")
        .join(totals(prior, "prior"), by, "left")
        .join(totals(current, "current"), by, "left")
    )
    zero = F.lit(0)
    filled = both.select(
        *keys,
        F.coalesce("in_prior", F.lit(False)).alias("in_prior"),
        F.coalesce("in_current", F.lit(False)).alias("in_current"),
        *[F.coalesce(f"{s}_{c}", zero.cast("double") if c == "mean_us" else zero.cast("bigint")).alias(f"{s}_{c}") for s in ("prior", "current") for c in measures],
        *[F.coalesce(f"{s}_window_us", zero).alias(f"{s}_window_us") for s in ("prior", "current")],
    )

    def share(value: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.col(value) / F.col(whole)).otherwise(0.0)

    def growth(now: str, before: str) -> Column:
        return F.when(F.col(before) > 0, (F.col(now) - F.col(before)) / F.col(before)).otherwise(0.0)

    rated = (
        filled.withColumn("prior_share", share("prior_total_us", "prior_window_us"))
        .withColumn("current_share", share("current_total_us", "current_window_us"))
        .withColumn("mean_change", growth("current_mean_us", "prior_mean_us"))
        .withColumn("total_change", growth("current_total_us", "prior_total_us"))
    )
    return classify_queries(rated, t).drop("prior_window_us", "current_window_us")


def classify_queries(items: DataFrame, t: DigestThresholds = DigestThresholds()) -> DataFrame:
    """Class and severity of compared statements."""
    both = F.col("in_prior") & F.col("in_current")
    enough = (F.col("prior_calls") >= t.min_calls) & (F.col("current_calls") >= t.min_calls) & (F.col("prior_mean_us") > 0)
    slower = F.col("current_mean_us") - F.col("prior_mean_us") >= t.regression_us
    regression = both & enough & slower & (F.col("mean_change") >= t.regression_mean_share)
    improvement = both & enough & (F.col("mean_change") <= -t.improvement_share)
    new = F.col("in_current") & ~F.col("in_prior") & (F.col("current_share") >= t.new_share)
    gone = F.col("in_prior") & ~F.col("in_current") & (F.col("prior_share") >= t.gone_share)
    high = (F.col("total_change") >= t.high_total_share) & (F.col("current_share") >= t.high_share)
    label = (
        F.when(new, "new").when(gone, "gone").when(regression, "regression").when(improvement, "improvement").otherwise("stable")
    )
    severity = F.when(regression, F.when(high, "high").otherwise("medium")).when(new, "medium").otherwise("info")
    return items.withColumn("classification", label).withColumn("severity", severity)


def top_per_class(items: DataFrame, by: Sequence[str] = ("environment_id",), t: DigestThresholds = DigestThresholds()) -> DataFrame:
    """The leading statements of every class, each class in its own order."""
    label = F.col("classification")
    measure = (
        F.when(label == "regression", F.col("mean_change"))
        .when(label == "new", F.col("current_total_us").cast("double"))
        .when(label == "gone", F.col("prior_total_us").cast("double"))
        .otherwise(-F.col("mean_change"))
    )
    limits = F.create_map(*[F.lit(x) for pair in t.top for x in pair])
    order = W.partitionBy(*by, "classification").orderBy(
        F.desc("measure"), F.desc("current_total_us"), "database_name", "fingerprint"
    )
    ranked = items.where(label != "stable").withColumn("measure", measure).withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= max(n for _, n in t.top)).where(F.col("rank") <= limits[label]).drop("measure")


# --- run pairs and regressions -----------------------------------------------------------------
def pair_comparable(pairs: DataFrame, max_gap_days: float = 7.0, counters: bool = True) -> DataFrame:
    """Whether a run may be compared with the one before it, and why not.

    ``pairs`` has previous_started_at, started_at, gap and, for counters,
    stats_reset and previous_stats_reset.
    """
    span = micros_between(F.col("previous_started_at"), F.col("started_at"))
    reason = F.when(F.col("gap"), "intermediate_incomplete_run").when(
        span.isNull() | (span <= 0) | (span > max_gap_days * DAY_MICROS), "gap_window"
    )
    if counters:
        reason = reason.when(changed(F.col("previous_stats_reset"), F.col("stats_reset")), "stats_reset")
    reason = reason.otherwise("")
    return pairs.withColumn("reason", reason).withColumn("comparable", reason == "")


def regressed_findings(events: DataFrame, baseline: DataFrame, severities: Sequence[str] = ("high", "critical")) -> DataFrame:
    """Per run: how many strong findings it has, and the keys its baseline run does not have.

    ``events``: environment_id, run_id, dedup_key, severity.  ``baseline``:
    environment_id, baseline_run_id.
    """
    strong = events.where(F.col("severity").isin(*severities)).select("environment_id", "run_id", "dedup_key").distinct()
    known = (
        strong.join(baseline, "environment_id")
        .where(F.col("run_id") == F.col("baseline_run_id"))
        .select("environment_id", "dedup_key")
    )
    counts = strong.groupBy("environment_id", "run_id").agg(F.count(F.lit(1)).alias("strong_findings"))
    new = strong.join(known, ["environment_id", "dedup_key"], "left_anti")
    keys = new.groupBy("environment_id", "run_id").agg(F.count(F.lit(1)).alias("new_keys"))
    return counts.join(keys, ["environment_id", "run_id"], "left").na.fill(0, ["new_keys"])


def persistent_regression(metric: DataFrame, pairs: DataFrame, baseline: DataFrame) -> DataFrame:
    """Runs whose count and whose previous run's count both exceed the baseline's."""
    value = metric.select("environment_id", "run_id", "strong_findings")

    def at(column: str, name: str) -> DataFrame:
        return value.select(
            "environment_id", F.col("run_id").alias(column), F.col("strong_findings").alias(name)
        )

    zero = F.lit(0).cast("bigint")
    joined = (
        pairs.where(F.col("previous_run_id").isNotNull())
        .select("environment_id", "run_id", "previous_run_id")
        .join(baseline, "environment_id")
        .join(at("run_id", "current"), ["environment_id", "run_id"], "left")
        .join(at("previous_run_id", "previous"), ["environment_id", "previous_run_id"], "left")
        .join(at("baseline_run_id", "base"), ["environment_id", "baseline_run_id"], "left")
    )
    counted = joined.select(
        "environment_id",
        "run_id",
        "previous_run_id",
        "baseline_run_id",
        *[F.coalesce(c, zero).alias(c) for c in ("base", "previous", "current")],
    )
    return counted.withColumn(
        "persistent", (F.col("previous") > F.col("base")) & (F.col("current") > F.col("base"))
    )


def persistent_keys(keys: DataFrame, pairs: DataFrame) -> DataFrame:
    """Keys that regressed in a run and in the run before it.

    ``keys``: environment_id, run_id, regression_key.
    """
    shift = pairs.where(F.col("previous_run_id").isNotNull()).select(
        "environment_id", F.col("previous_run_id").alias("run_id"), F.col("run_id").alias("next_run_id")
    )
    before = keys.join(shift, ["environment_id", "run_id"]).select(
        "environment_id", F.col("next_run_id").alias("run_id"), "regression_key"
    )
    return keys.distinct().join(before.distinct(), ["environment_id", "run_id", "regression_key"])


def structure_regression_keys(tables: DataFrame, indexes: DataFrame, baseline: DataFrame) -> DataFrame:
    """Tables removed or changed, indexes removed and tables added without a key, against the baseline run.

    ``tables``: environment_id, run_id, names, relkind, has_primary_key,
    column_count, is_partition.  ``indexes``: environment_id, run_id, names.
    Every run of an environment is compared with its baseline run.
    """
    place = ["database_name", "schema_name"]
    table = [*place, "table_name"]
    runs = tables.select("environment_id", "run_id").distinct().join(baseline, "environment_id")
    runs = runs.where(F.col("run_id") != F.col("baseline_run_id"))
    shape = F.struct("relkind", "has_primary_key", "column_count")

    def base_of(df: DataFrame, *columns) -> DataFrame:
        at = baseline.withColumnRenamed("baseline_run_id", "run_id")
        return df.join(at, ["environment_id", "run_id"]).drop("run_id").select("environment_id", *columns)

    base_tables = base_of(tables, *table, shape.alias("base_shape"))
    current = tables.join(runs.select("environment_id", "run_id"), ["environment_id", "run_id"]).select(
        "environment_id",
        "run_id",
        *table,
        shape.alias("shape"),
        (~F.col("has_primary_key") & ~F.col("is_partition") & F.col("relkind").isin("r", "p")).alias("bare"),
    )
    expected = base_tables.join(runs.select("environment_id", "run_id"), "environment_id")
    keys = ["environment_id", "run_id", *table]
    both = expected.join(current, keys, "full")
    name = dotted(*table)
    removed = both.where(F.col("shape").isNull()).select("environment_id", "run_id", F.concat(F.lit("table_removed:"), name).alias("regression_key"))
    altered = both.where(
        F.col("shape").isNotNull() & F.col("base_shape").isNotNull() & changed(F.col("shape"), F.col("base_shape"))
    ).select("environment_id", "run_id", F.concat(F.lit("table_changed:"), name).alias("regression_key"))
    known_databases = base_tables.select("environment_id", "database_name").distinct()
    added = (
        both.where(F.col("base_shape").isNull() & F.col("bare") & ~F.col("schema_name").startswith("_timescaledb_"))
        .join(known_databases, ["environment_id", "database_name"], "left_semi")
        .select("environment_id", "run_id", F.concat(F.lit("table_added_without_pk:"), name).alias("regression_key"))
    )
    index = [*place, "index_name"]
    base_indexes = base_of(indexes, *index).join(runs.select("environment_id", "run_id"), "environment_id")
    present = current.select("environment_id", "run_id", "database_name").distinct()
    lost = (
        base_indexes.join(indexes.select("environment_id", "run_id", *index), ["environment_id", "run_id", *index], "left_anti")
        .join(present, ["environment_id", "run_id", "database_name"], "left_semi")
        .select("environment_id", "run_id", F.concat(F.lit("index_removed:"), dotted(*index)).alias("regression_key"))
    )
    return removed.unionByName(altered).unionByName(added).unionByName(lost)


def regression_alerts(candidates: DataFrame, alerts: DataFrame, recovered: DataFrame) -> DataFrame:
    """Regressions worth a new alert.

    ``candidates``: environment_id, baseline_run_id, category, run_id, current,
    keys (array).  ``alerts``: the earlier alerts with created_at, current and
    keys (NULL for old alerts without keys).  ``recovered``: environment_id,
    baseline_run_id, category whose last alert was seen gone since.  A
    regression is new without an earlier alert, after a recovery, or with a key
    the last alert did not have; without keys it must be worse than before.
    """
    scope = ["environment_id", "baseline_run_id", "category"]
    last = alerts.groupBy(*scope).agg(
        F.max_by(F.struct(F.col("current").alias("last_current"), F.col("keys").alias("last_keys")), "created_at").alias("a")
    )
    healed = recovered.select(*scope).distinct().withColumn("healed", F.lit(True))
    joined = candidates.join(last, scope, "left").join(healed, scope, "left")
    fresh_key = F.size(F.array_except("keys", F.col("a.last_keys"))) > 0
    new = (
        F.when(F.col("a").isNull() | F.col("healed"), True)
        .when(F.col("a.last_keys").isNull(), F.col("current") > F.col("a.last_current"))
        .otherwise(fresh_key)
    )
    return joined.withColumn("outcome", F.when(new, "recorded").otherwise("deduplicated")).select(
        *candidates.columns, "outcome"
    )


def recovered_regressions(alerts: DataFrame, measured: DataFrame) -> DataFrame:
    """Scopes whose last alert was followed by a run that shows the regression gone.

    ``alerts``: scope, alert_at, base_count and keys.  ``measured``: scope,
    started_at, current, keys of complete runs after the alert.
    """
    scope = ["environment_id", "baseline_run_id", "category"]
    seen = measured.select(*scope, "started_at", F.col("current").alias("seen_current"), F.col("keys").alias("seen_keys"))
    joined = alerts.join(seen, scope).where(F.col("started_at") > F.col("alert_at"))
    by_count = (F.col("category") == "findings") & (F.col("seen_current") <= F.col("base_count"))
    by_key = (F.col("category") != "findings") & F.when(
        F.col("keys").isNull(), F.col("seen_current") == 0
    ).otherwise(~F.arrays_overlap("keys", "seen_keys"))
    return joined.where(by_count | F.coalesce(by_key, F.lit(False))).select(*scope).distinct()


# --- histories -----------------------------------------------------------------------------------
def table_history(tables: DataFrame, runs: DataFrame, grain: str = "day") -> DataFrame:
    """Last snapshot of every table per time bucket with the change since the bucket before.

    Sizes compare between successful runs only; counters also need the same,
    known reset mark and may not fall.
    """
    table = ["environment_id", "database_name", "schema_name", "table_name"]
    dml = F.col("n_tup_ins") + F.col("n_tup_upd") + F.col("n_tup_del")
    known = tables.withColumn("bucket", F.date_trunc(grain, F.col("collected_at").cast("timestamp"))).withColumn("dml", dml)
    picked = ["run_id", "collected_at", "total_size_bytes", "row_estimate", "seq_scan", "dml", "stats_reset"]
    newest = known.groupBy(*table, "bucket").agg(
        F.max_by(F.struct(*picked), F.struct("collected_at", "run_id")).alias("s")
    )
    points = newest.select(*table, "bucket", "s.*").join(
        runs.select("environment_id", "run_id", F.col("status").alias("run_status")), ["environment_id", "run_id"]
    )
    order = W.partitionBy(*table).orderBy("bucket")

    def before(name: str) -> Column:
        return F.lag(name).over(order)

    usable = (F.col("run_status") == "success") & F.coalesce(before("run_status") == "success", F.lit(False))
    fell = (F.col("seq_scan") < before("seq_scan")) | (F.col("dml") < before("dml"))
    reset = ~F.coalesce(F.col("stats_reset") == before("stats_reset"), F.lit(False)) | fell
    out = {
        "size_delta": F.when(usable, F.col("total_size_bytes") - before("total_size_bytes")),
        "row_delta": F.when(usable, F.col("row_estimate") - before("row_estimate")),
        "seq_scan_delta": F.when(usable & ~reset, F.col("seq_scan") - before("seq_scan")),
        "dml_delta": F.when(usable & ~reset, F.col("dml") - before("dml")),
        "counters_reset": F.coalesce(usable & reset, F.lit(False)),
    }
    return points.select(
        *table, "bucket", "run_id", "run_status", "total_size_bytes", "row_estimate", *[c.alias(n) for n, c in out.items()]
    )


def bucket_runs(runs: DataFrame, grain: str = "day", statuses: Sequence[str] = ("success",)) -> DataFrame:
    """Latest run of every environment and time bucket."""
    kept = runs.where(F.col("status").isin(*statuses)).withColumn("bucket", F.date_trunc(grain, F.col("started_at").cast("timestamp")))
    names = [c for c in runs.columns if c != "environment_id"]
    return kept.groupBy("environment_id", "bucket").agg(
        F.max_by(F.struct(*names), F.struct("started_at", "run_id")).alias("r")
    ).select("environment_id", "bucket", "r.*")


def storage_history(tables: DataFrame, runs: DataFrame, grain: str = "day") -> DataFrame:
    """Size and rows per bucket by environment, database, schema and table, all levels in one aggregation."""
    chosen = bucket_runs(runs, grain).select("environment_id", "run_id", "bucket")
    rows = tables.join(chosen, ["environment_id", "run_id"])
    base = [F.col("environment_id"), F.col("bucket")]
    names = [F.col("database_name"), F.col("schema_name"), F.col("table_name")]
    grouped = rows.groupingSets([base, [*base, names[0]], [*base, *names[:2]], [*base, *names]], *base, *names).agg(
        F.sum("total_size_bytes").alias("total_size_bytes"),
        F.sum("row_estimate").alias("row_estimate"),
        F.grouping_id().alias("g"),
    )
    scope = (
        F.when(F.col("g") == 7, "environment").when(F.col("g") == 3, "database").when(F.col("g") == 1, "schema").otherwise("table")
    )
    label = F.when(F.col("g") == 7, "environment").otherwise(F.concat_ws(".", *names))
    return grouped.select(
        "environment_id", "bucket", scope.alias("scope"), label.alias("label"), "total_size_bytes", "row_estimate"
    )
