"""Scores, completeness, trends, inventory and search over snapshots and findings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import dotted, severity_rank
from plumbline.operators.workload import bucket_runs
from plumbline.sources.runs import FINISHED, latest_run

RUN = ["environment_id", "run_id"]
TABLE = [*RUN, "database_name", "schema_name", "table_name"]
#: Weight of each score group, and the finding categories in it; the rest counts as structure.
WEIGHTS = {"security": 35, "performance": 30, "structure": 20, "maintenance": 15}
GROUPS = {
    "security": ("security", "privilege", "rls", "config"),
    "performance": ("performance", "index", "workload"),
    "maintenance": ("storage", "vacuum", "policy", "job", "chunk", "cagg"),
}
#: Points a finding costs.
PENALTIES = {"critical": 25, "high": 15, "medium": 8, "low": 3}
#: Collectors a score needs per database.
SCORE_COLLECTORS = ("postgres.tables", "postgres.columns", "postgres.constraints", "postgres.indexes")


def score_group(category: Column) -> Column:
    group = F.lit("structure")
    for name, categories in GROUPS.items():
        group = F.when(category.isin(*categories), name).otherwise(group)
    return group


def severity_penalty(severity: Column) -> Column:
    penalty = F.lit(1)
    for name, points in PENALTIES.items():
        penalty = F.when(severity == name, points).otherwise(penalty)
    return penalty


def _scores(findings: DataFrame, tables: DataFrame, by: Sequence[str]) -> DataFrame:
    """Penalties and score per group of ``by``; groups come from ``tables``."""
    by = list(by)
    points = severity_penalty(F.col("severity"))
    group = score_group(F.col("category"))
    losses = findings.groupBy(*by).agg(
        *[F.least(F.lit(100), F.coalesce(F.sum(F.when(group == g, points)), F.lit(0))).alias(f"{g}_penalty") for g in WEIGHTS],
        F.count(F.lit(1)).alias("findings"),
    )
    counted = tables.groupBy(*by).agg(
        F.count(F.lit(1)).alias("tables"), F.count_if("has_primary_key").alias("primary_keys")
    )
    joined = counted.join(losses, by, "left").na.fill(0, [*[f"{g}_penalty" for g in WEIGHTS], "findings"])
    positive = F.expr("20 * primary_keys div tables")
    for g in WEIGHTS:
        start = F.lit(80) + positive if g == "structure" else F.lit(100)
        joined = joined.withColumn(f"{g}_score", F.greatest(F.lit(0), start - F.col(f"{g}_penalty")).cast("bigint"))
    weighted = sum((F.col(f"{g}_score") * w for g, w in WEIGHTS.items()), F.lit(0))
    return joined.withColumn("weighted", weighted).withColumn("score", F.expr("weighted div 100")).drop(
        "weighted", *[f"{g}_penalty" for g in WEIGHTS]
    )


def scope_score(findings: DataFrame, tables: DataFrame) -> DataFrame:
    """Weighted score of every run: findings cost points, primary keys earn them.

    ``findings``: environment_id, run_id, category, severity of the observed findings.
    """
    return _scores(findings, tables, RUN)


def scope_aggregates(findings: DataFrame, tables: DataFrame, runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Score of every schema; without its index collector or an analysis there is none.

    ``runs``: environment_id, run_id, status, analysis_status.  ``coverage``:
    environment_id, run_id, database_name, collector, status.
    """
    scope = [*RUN, "database_name", "schema_name"]
    indexed = (
        coverage.where((F.col("collector") == "postgres.indexes") & (F.col("status") == "success"))
        .select(*RUN, "database_name")
        .distinct()
        .withColumn("indexed", F.lit(True))
    )
    finished = runs.where(F.col("status").isin(*FINISHED)).select(*RUN, "status", "analysis_status")
    joined = _scores(findings, tables, scope).join(finished, RUN).join(indexed, [*RUN, "database_name"], "left")
    usable = F.col("indexed").isNotNull() & (F.coalesce("analysis_status", F.lit("")) == "success")
    return joined.select(
        *scope,
        "tables",
        F.when(usable, "available").otherwise("insufficient_coverage").alias("score_status"),
        F.when(usable, F.col("score")).alias("score"),
        F.when(usable, F.when(F.col("status") == "success", 1.0).otherwise(0.75)).otherwise(0.0).alias("confidence"),
    )


def coverage_confidence(databases: DataFrame, runs: DataFrame, coverage: DataFrame, collectors: Sequence[str] = SCORE_COLLECTORS) -> DataFrame:
    """Share of the wanted collectors that succeeded per run, three quarters of it for a partial run.

    ``databases``: environment_id, run_id, database_name.
    """
    wanted = databases.select(*RUN, "database_name").distinct().withColumn(
        "collector", F.explode(F.array(*[F.lit(c) for c in collectors]))
    )
    done = coverage.where(F.col("status") == "success").select(*RUN, "database_name", "collector").distinct()
    counted = wanted.join(done.withColumn("done", F.lit(1)), [*RUN, "database_name", "collector"], "left").groupBy(*RUN).agg(
        F.count("done").alias("done"), F.count(F.lit(1)).alias("wanted")
    )
    share = F.col("done") / F.col("wanted")
    return counted.join(runs.where(F.col("status").isin(*FINISHED)).select(*RUN, "status"), RUN).select(
        *RUN,
        (F.col("wanted") - F.col("done")).alias("missing_collectors"),
        F.when(F.col("status") == "success", share).otherwise(share * 0.75).alias("confidence"),
    )


def snapshot_completeness(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """complete, partial, empty or unknown per run."""
    failed = coverage.where(F.lower("status") == "failed")
    counted = failed.groupBy(*RUN).agg(
        F.countDistinct(F.nullif("database_name", F.lit(""))).alias("failed_databases"),
        F.count_if(F.col("database_name") == "").alias("failed_collectors"),
    )
    joined = runs.join(counted, RUN, "left").na.fill(0, ["failed_databases", "failed_collectors"])
    status = F.lower("status")
    bad = (F.col("failed_databases") > 0) | (F.col("failed_collectors") > 0)
    label = (
        F.when((status == "partial_success") | bad, "partial")
        .when(status == "success", "complete")
        .when(status == "failed", "empty")
        .otherwise("unknown")
    )
    return joined.select(*RUN, "status", "failed_databases", "failed_collectors", label.alias("completeness"))


def run_status(outcomes: DataFrame) -> DataFrame:
    """Status of each run from its collector outcomes (environment_id, run_id, status)."""
    counted = outcomes.groupBy(*RUN).agg(
        *[F.count_if(F.col("status") == s).alias(s) for s in ("success", "failed", "skipped", "cancelled")]
    )
    label = (
        F.when(F.col("cancelled") > 0, "cancelled")
        .when((F.col("failed") == 0) & (F.col("success") > 0), "success")
        .when((F.col("failed") > 0) & (F.col("success") > 0), "partial_success")
        .when(F.col("failed") > 0, "failed")
        .when(F.col("skipped") > 0, "success")
        .otherwise("failed")
    )
    return counted.withColumn("run_status", label)


# --- trends --------------------------------------------------------------------------------------
def _trend_runs(runs: DataFrame, coverage: DataFrame, grain: str, analysed: bool) -> DataFrame:
    incomplete = coverage.where(F.col("status").isin("failed", "skipped", "attempted")).select(*RUN).distinct()
    chosen = bucket_runs(runs, grain, FINISHED).join(incomplete.withColumn("incomplete", F.lit(True)), RUN, "left")
    complete = (F.col("status") == "success") & F.col("incomplete").isNull()
    if analysed:
        complete = complete & (F.coalesce("analysis_status", F.lit("")) == "success")
    return chosen.withColumn("coverage", F.when(complete, "complete").otherwise("partial")).drop("incomplete")


def storage_trend(runs: DataFrame, coverage: DataFrame, databases: DataFrame, grain: str = "month") -> DataFrame:
    """Size at the last run of every bucket; NULL without a database inventory.

    ``databases``: environment_id, run_id, size_bytes, is_template.
    """
    sizes = databases.where(~F.col("is_template")).groupBy(*RUN).agg(F.sum("size_bytes").alias("size_bytes"))
    return _trend_runs(runs, coverage, grain, analysed=False).join(sizes, RUN, "left")


def finding_trend(runs: DataFrame, coverage: DataFrame, events: DataFrame, grain: str = "month") -> DataFrame:
    """Observed findings at the last run of every bucket; NULL when the run was not analysed."""
    counted = events.groupBy(*RUN).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("severity") == "critical").alias("n_critical"),
        F.count_if(F.col("severity") == "high").alias("n_high"),
    )
    joined = _trend_runs(runs, coverage, grain, analysed=True).join(counted, RUN, "left")
    analysed = F.coalesce("analysis_status", F.lit("")) == "success"
    for name, source in {"findings": "n", "critical": "n_critical", "high": "n_high"}.items():
        joined = joined.withColumn(name, F.when(analysed, F.coalesce(source, F.lit(0))))
    return joined.drop("n", "n_critical", "n_high")


def trend_comparability(points: DataFrame) -> DataFrame:
    """Whether each point compares with the one before it: coverage, profile, versions and counter resets.

    ``points`` also has stats_reset, the newest reset mark of the run.
    """
    order = W.partitionBy("environment_id").orderBy("started_at", "run_id")

    def before(name: str) -> Column:
        return F.lag(name).over(order)

    first = before("run_id").isNull()
    reset = F.coalesce(before("stats_reset") != F.col("stats_reset"), F.lit(False))
    note = (
        F.when(reset, "counters_reset")
        .when(F.col("coverage") != "complete", "partial")
        .when(first, "")
        .when(before("coverage") != "complete", "previous_partial")
        .when(before("profile") != F.col("profile"), "profile")
        .when(before("collector_version") != F.col("collector_version"), "collector_version")
        .when(before("rules_hash") != F.col("rules_hash"), "rules")
        .otherwise("")
    )
    return points.withColumn("comparison_note", note).withColumn("comparable", F.col("comparison_note") == "").withColumn(
        "counter_reset", reset
    )


def score_trend(points: DataFrame, findings: DataFrame, tables: DataFrame, confidence: DataFrame) -> DataFrame:
    """Score of every complete trend point; NULL where a collector is missing or no table was seen.

    ``confidence`` is the result of ``coverage_confidence``.
    """
    scores = scope_score(findings, tables).select(*RUN, F.col("score").alias("run_score"))
    joined = points.join(confidence.select(*RUN, "missing_collectors", F.col("confidence").alias("score_confidence")), RUN, "left").join(scores, RUN, "left")
    usable = (F.col("coverage") == "complete") & (F.col("status") == "success") & (F.col("missing_collectors") == 0)
    return joined.withColumn("score", F.when(usable, F.col("run_score"))).drop("run_score", "missing_collectors")


def kpis(runs: DataFrame, databases: DataFrame, counted: Mapping[str, DataFrame]) -> DataFrame:
    """Size and object counts at the latest run of every environment.

    ``counted`` maps a result column to the snapshot rows it counts.
    """
    latest = latest_run(runs).select(*RUN)
    sizes = databases.where(~F.col("is_template")).groupBy(*RUN).agg(
        F.sum("size_bytes").alias("total_storage_bytes"), F.countDistinct("database_name").alias("databases")
    )
    result = latest.join(sizes, RUN, "left")
    for name, rows in counted.items():
        at_latest = rows.join(latest, RUN, "left_semi")
        result = result.join(at_latest.groupBy(*RUN).agg(F.count(F.lit(1)).alias(name)), RUN, "left")
    return result.na.fill(0, ["total_storage_bytes", "databases", *counted])


def run_counts(runs: DataFrame, recent: int = 50) -> DataFrame:
    """Successful and failed runs among the latest ones of each environment."""
    order = W.partitionBy("environment_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = runs.withColumn("place", F.row_number().over(order)).where(F.col("place") <= recent)
    return last.groupBy("environment_id").agg(
        F.count_if(F.col("status").isin(*FINISHED)).alias("successful"), F.count_if(F.col("status") == "failed").alias("failed")
    )


def top_tables(tables: DataFrame, runs: DataFrame, n: int = 15) -> DataFrame:
    """The largest tables at the latest run of every environment."""
    latest = latest_run(runs).select(*RUN)
    order = W.partitionBy("environment_id").orderBy(F.desc("total_size_bytes"), "database_name", "schema_name", "table_name")
    ranked = tables.join(latest, RUN, "left_semi").withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= n).select(*TABLE, "total_size_bytes", "rank")


def recent_growth(tables: DataFrame, runs: DataFrame, points: int = 6) -> DataFrame:
    """Size and table count of the last runs of every environment, by database."""
    order = W.partitionBy("environment_id").orderBy(F.desc("started_at"), F.desc("run_id"))
    last = (
        runs.where(F.col("status").isin(*FINISHED))
        .withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= points)
        .select(*RUN, "started_at", "place")
    )
    return (
        tables.join(last, RUN)
        .groupBy(*RUN, "started_at", "place", "database_name")
        .agg(F.sum("total_size_bytes").alias("bytes"), F.count(F.lit(1)).alias("tables"))
    )


def job_health(jobs: DataFrame, policies: DataFrame) -> DataFrame:
    """Jobs, scheduled jobs and policies per environment."""
    counted = jobs.groupBy("environment_id").agg(
        F.count(F.lit(1)).alias("jobs_total"), F.count_if("scheduled").alias("jobs_scheduled")
    )
    rules = policies.groupBy("environment_id").agg(F.count(F.lit(1)).alias("policies_total"))
    return counted.join(rules, "environment_id", "full").na.fill(0, ["jobs_total", "jobs_scheduled", "policies_total"])


# --- inventory -------------------------------------------------------------------------------------
def like_pattern(text: str) -> str:
    """``%text%`` with the wildcards of the text itself escaped."""
    escaped = text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return f"%{escaped}%"


def inventory(objects: DataFrame, name: str, text: str = "", filters: Mapping[str, str] | None = None, order_by: str = "", descending: bool = False, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of one kind of object: exact filters, a part of the name, an order."""
    kept = objects
    for column, value in (filters or {}).items():
        if value:
            kept = kept.where(F.col(column) == value)
    if text:
        kept = kept.where(F.col(name).ilike(like_pattern(text)))
    order = [F.desc(order_by) if descending else F.asc(order_by)] if order_by else []
    page = kept.orderBy(*order, "database_name", "schema_name", name)
    return (page.offset(offset) if offset else page).limit(limit)


def search(text: str, findings: DataFrame, runs: DataFrame, objects: Mapping[str, tuple[DataFrame, str]], limit: int = 10) -> DataFrame:
    """The best hits among findings, runs and the objects of the latest run of each environment.

    ``objects`` maps a kind to its snapshot rows and their name column.  Hits of
    a group are ordered on their own and cut to ``limit``.
    """
    pattern = like_pattern(text)
    shown = F.concat_ws(
        ".",
        F.nullif("database_name", F.lit("")),
        F.nullif("schema_name", F.lit("")),
        F.nullif("object_name", F.lit("")),
    )
    fields = ("title", "rule_id", "object_name", "object_key", "schema_name", "database_name")
    matched = F.lit(False)
    for field in fields:
        matched = matched | F.col(field).ilike(pattern)
    open_first = F.when(F.col("status") == "open", 0).when(F.col("status") == "acknowledged", 1).otherwise(2)
    found = (
        findings.where(matched)
        .orderBy(open_first, F.desc(severity_rank(F.col("severity"))), F.desc("last_seen_at"), "finding_id")
        .limit(limit)
        .select(
            F.lit("finding").alias("hit"),
            F.lit("").alias("object_kind"),
            "environment_id",
            F.col("finding_id").alias("id"),
            "title",
            F.concat_ws(" · ", F.col("rule_id"), F.nullif(shown, F.lit(""))).alias("subtitle"),
        )
    )
    by_run = (
        runs.where(F.col("profile").ilike(pattern) | F.col("status").ilike(pattern) | F.col("environment_id").ilike(pattern))
        .orderBy(F.desc("started_at"), "run_id")
        .limit(limit)
        .select(
            F.lit("run").alias("hit"),
            F.lit("").alias("object_kind"),
            "environment_id",
            F.col("run_id").alias("id"),
            F.concat(F.lit("Execução "), F.substring("run_id", 1, 8)).alias("title"),
            F.concat_ws(" · ", "environment_id", "profile", "status").alias("subtitle"),
        )
    )
    latest = latest_run(runs).select(*RUN)
    named = None
    for kind, (rows, name) in objects.items():
        part = (
            rows.where(F.col(name).ilike(pattern))
            .join(latest, RUN, "left_semi")
            .select("environment_id", "database_name", "schema_name", F.col(name).alias("name"), F.lit(kind).alias("object_kind"))
        )
        named = part if named is None else named.unionByName(part)
    exact = F.lower("name") == text.lower()
    best = (
        named.orderBy(F.desc(exact), F.length("name"), "name", "object_kind", "environment_id", "database_name", "schema_name")
        .limit(limit)
        .select(
            F.lit("inventory").alias("hit"),
            "object_kind",
            "environment_id",
            F.concat(F.col("object_kind"), F.lit(":"), F.col("environment_id"), F.lit(":"), dotted("database_name", "schema_name", "name")).alias("id"),
            dotted("schema_name", "name").alias("title"),
            F.col("database_name").alias("subtitle"),
        )
    )
    return found.unionByName(by_run).unionByName(best)


def table_assessment(tables: DataFrame, related: Mapping[str, DataFrame]) -> DataFrame:
    """Counts of related objects for all tables; ``related`` maps a result column to rows with the table keys."""
    result = tables.select(*TABLE)
    for name, rows in related.items():
        result = result.join(rows.groupBy(*TABLE).agg(F.count(F.lit(1)).alias(name)), TABLE, "left")
    return result.na.fill(0, list(related))


def table_score(tables: DataFrame, indexes: DataFrame, constraints: DataFrame) -> DataFrame:
    """Structural score of every table, from 100 down to 0."""
    invalid = indexes.where(~F.col("is_valid")).groupBy(*TABLE).agg(F.count(F.lit(1)).alias("invalid_indexes"))
    open_constraints = constraints.where(~F.col("validated")).groupBy(*TABLE).agg(
        F.count(F.lit(1)).alias("unvalidated_constraints")
    )
    joined = (
        tables.join(invalid, TABLE, "left").join(open_constraints, TABLE, "left").na.fill(0, ["invalid_indexes", "unvalidated_constraints"])
    )
    bare = ~F.col("is_partition") & (F.col("relation_class") != "foreign_table") & ~F.col("has_primary_key")
    tuples = F.col("n_live_tup") + F.col("n_dead_tup")
    dead = F.when(tuples >= 1000, F.col("n_dead_tup") / tuples)
    penalty = (
        F.when(bare, 20).otherwise(0)
        + F.least(F.lit(2), F.col("invalid_indexes")) * 15
        + F.least(F.lit(2), F.col("unvalidated_constraints")) * 10
        + F.when(dead > 0.5, 20).when(dead > 0.2, 10).otherwise(0)
    )
    return joined.select(
        *TABLE, "invalid_indexes", "unvalidated_constraints", F.greatest(F.lit(0), F.lit(100) - penalty).cast("bigint").alias("score")
    )


def relationship_graph(constraints: DataFrame) -> DataFrame:
    """Direct foreign-key edges of every table, seen from both ends."""
    foreign = constraints.where((F.col("constraint_type") == "f") & (F.col("referenced_table") != "")).withColumn(
        "target_schema", F.when(F.col("referenced_schema") == "", F.col("schema_name")).otherwise(F.col("referenced_schema"))
    )
    edge = [
        "constraint_name",
        F.col("schema_name").alias("from_schema"),
        F.col("table_name").alias("from_table"),
        F.col("target_schema").alias("to_schema"),
        F.col("referenced_table").alias("to_table"),
    ]
    place = [*RUN, "database_name"]
    out = foreign.select(*place, F.lit("out").alias("direction"), F.col("schema_name").alias("root_schema"), F.col("table_name").alias("root_table"), *edge)
    into = foreign.select(*place, F.lit("in").alias("direction"), F.col("target_schema").alias("root_schema"), F.col("referenced_table").alias("root_table"), *edge)
    return out.unionByName(into)


def latest_column_stats(stats: DataFrame, runs: DataFrame) -> DataFrame:
    """Column statistics of the newest run that has them, for every table."""
    table = ["environment_id", "database_name", "schema_name", "table_name"]
    dated = stats.join(runs.select(*RUN, "started_at"), RUN)
    newest = dated.groupBy(*table).agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return stats.join(newest, [*table, "run_id"])


def table_workload(queries: DataFrame, tables: DataFrame, n: int | None = None) -> DataFrame:
    """The statements that reference each table, ranked by their cost; the first ``n`` of each if wanted."""
    spread = queries.select(*RUN, "database_name", "fingerprint", "calls", "total_exec_ms", F.explode("referenced_objects").alias("object"))
    named = tables.select(*TABLE, F.concat_ws(".", "schema_name", "table_name").alias("object"))
    order = W.partitionBy(*TABLE).orderBy(F.desc("total_exec_ms"), "fingerprint")
    joined = spread.join(named, [*RUN, "database_name", "object"])
    ranked = joined.withColumn("rank", F.row_number().over(order)).drop("object")
    return ranked if n is None else ranked.where(F.col("rank") <= n)
