"""Life of a finding: policies, enrichment, merge with the stored state, queue and priority."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.operators.pages import Key, ordering
from plumbline.sources.staging import cut_lineage
from plumbline.functions.keys import dedup_key, severity_rank
from plumbline.operators.rules.catalog import catalog

STATE_KEY = ["environment_id", "dedup_key", "rule_version"]
UNKNOWN_RULE_VERSION = "1.0.0"
UNKNOWN_RULE_CONFIDENCE = 0.5
UNKNOWN_EFFORT = "médio"


# --- policies --------------------------------------------------------------------------------
def _policy_maps(policies: DataFrame) -> DataFrame:
    """(environment_id, schema_name) -> parameters as one map keyed ``rule|parameter``."""
    entries = F.transform(
        F.map_entries("parameters"),
        lambda e: F.struct(F.concat(F.col("rule_id"), F.lit("|"), e["key"]).alias("key"), e["value"].alias("value")),
    )
    return policies.groupBy("environment_id", "schema_name").agg(
        F.map_from_entries(F.flatten(F.collect_list(entries))).alias("parameters")
    )


def with_parameters(snapshot: DataFrame, policies: DataFrame) -> DataFrame:
    """Snapshot rows with the policy parameters of their environment and of their schema.

    ``policies`` has environment_id, schema_name ('' for the whole environment),
    rule_id, enabled and parameters (map of text).
    """
    maps = _policy_maps(policies)
    wide = maps.where(F.col("schema_name") == "").select(
        "environment_id", F.col("parameters").alias("environment_parameters")
    )
    narrow = maps.where(F.col("schema_name") != "").select(
        "environment_id", "schema_name", F.col("parameters").alias("schema_parameters")
    )
    return snapshot.join(wide, "environment_id", "left").join(narrow, ["environment_id", "schema_name"], "left")


def enrich_findings(findings: DataFrame, policies: DataFrame) -> DataFrame:
    """Findings with rule metadata frozen on them; disabled rules are dropped.

    A schema policy wins over an environment policy.  The stated confidence may
    only lower the one of the rule.  The final key also covers the rule version
    and its effective parameters.
    """
    rules = F.broadcast(catalog(findings.sparkSession).drop("effort"))  # one row per rule id, a fixed list
    wide = policies.where(F.col("schema_name") == "").select(
        "environment_id", "rule_id", F.col("enabled").alias("wide_enabled"), F.col("parameters").alias("wide_parameters")
    )
    narrow = policies.where(F.col("schema_name") != "").select(
        "environment_id",
        "schema_name",
        "rule_id",
        F.col("enabled").alias("narrow_enabled"),
        F.col("parameters").alias("narrow_parameters"),
    )
    joined = (
        findings.join(rules, "rule_id", "left")
        .join(wide, ["environment_id", "rule_id"], "left")
        .join(narrow, ["environment_id", "schema_name", "rule_id"], "left")
        .where(F.coalesce("narrow_enabled", "wide_enabled", F.lit(True)))
    )
    empty = F.create_map().cast("map<string,string>")
    defaults = F.coalesce("default_parameters", empty)
    effective = F.transform_values(
        defaults, lambda k, v: F.coalesce(F.col("narrow_parameters")[k], F.col("wide_parameters")[k], v)
    )
    ceiling = F.coalesce("max_confidence", F.lit(UNKNOWN_RULE_CONFIDENCE))
    stated = F.col("confidence")
    version = F.coalesce("rule_version", F.lit(UNKNOWN_RULE_VERSION))
    return (
        joined.withColumn("rule_version", version)
        .withColumn("category", F.coalesce("category", F.substring_index("rule_id", ".", 1)))
        .withColumn("confidence", F.when((stated > 0) & (stated <= ceiling), stated).otherwise(ceiling))
        .withColumn("rule_parameters", F.to_json(_sorted_map(effective)))
        .withColumn(
            "dedup_key",
            dedup_key(
                F.concat(F.col("rule_id"), F.lit("@"), F.col("rule_version")),
                F.col("object_key"),
                F.concat(F.col("title"), F.col("rule_parameters")),
            ),
        )
        .drop(
            "max_confidence",
            "default_parameters",
            "wide_enabled",
            "narrow_enabled",
            "wide_parameters",
            "narrow_parameters",
        )
    )


def _sorted_map(values: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(values)))


def evidence_signature(evidence: Column) -> Column:
    """Hash of the evidence in canonical order, without the measuring basis that moves every run."""
    fields = F.map_filter(F.from_json(evidence, "map<string,string>"), lambda k, v: k != "impact_basis")
    return F.sha2(F.coalesce(F.to_json(_sorted_map(fields)), evidence), 256)


# --- merge -----------------------------------------------------------------------------------
@dataclass(frozen=True)
class Merge:
    """The new state and the events that led to it."""

    state: DataFrame
    events: DataFrame


def discard_decision(status: Column, stored: Column, current: Column, until: Column, now: Column) -> Column:
    """``hold`` while an identical discard lasts, ``reopen`` once it does not, else ``proceed``."""
    same = (F.coalesce(stored, F.lit("")) != "") & (stored == current)
    over = until.isNotNull() & (until <= now)
    return (
        F.when(F.coalesce(status, F.lit("")) != "discarded", "proceed")
        .when(F.coalesce(same, F.lit(False)) & ~over, "hold")
        .otherwise("reopen")
    )


def merge_findings(state: DataFrame, observed: DataFrame, actions: DataFrame, now: Column) -> Merge:
    """Merge observed findings into the stored state.

    ``state``: environment_id, dedup_key, rule_version, finding_id, rule_id,
    object_key, run_id, severity, title, evidence, confidence, status,
    first_seen_at, last_seen_at, resolved_at, recurrence_count,
    suppressed_until, superseded_by.
    ``observed``: the same identity columns with run_id, severity, title,
    evidence and confidence, one row per key.
    ``actions``: environment_id, dedup_key, rule_version, action_status,
    evidence_sha256, suppress_until, one row per key.
    """
    now = now.cast("timestamp")
    carried = ["finding_id", "rule_id", "object_key", "run_id", "severity", "title", "evidence", "confidence"]
    kept = [*carried, "status", "first_seen_at", "last_seen_at", "resolved_at", "recurrence_count", "suppressed_until", "superseded_by"]
    old = state.select(*STATE_KEY, F.lit(True).alias("stored"), *[F.col(c).alias(f"old_{c}") for c in kept])
    new = observed.select(
        *STATE_KEY, F.lit(True).alias("seen"), *[F.col(c).alias(f"new_{c}") for c in carried if c != "finding_id"]
    )
    both = old.join(new, STATE_KEY, "full").join(actions, STATE_KEY, "left")
    stored, seen = F.col("stored").isNotNull(), F.col("seen").isNotNull()
    decision = F.when(
        seen,
        discard_decision(
            F.col("action_status"),
            F.col("evidence_sha256"),
            evidence_signature(F.col("new_evidence")),
            F.col("suppress_until"),
            now,
        ),
    )
    both = cut_lineage(both.withColumn("decision", decision))  # state and events both read it
    touched = seen & ~((F.col("decision") == "hold") & stored) & (F.col("decision") != "hold")
    held = seen & (F.col("decision") == "hold")
    was = F.col("old_status")
    lifted = (was == "suppressed") & ((F.col("decision") == "reopen") | (F.col("old_suppressed_until") <= now))
    lifted = F.coalesce(lifted, F.lit(False))
    resolved = F.coalesce(was == "resolved", F.lit(False))
    finding_id = F.coalesce("old_finding_id", F.sha2(F.concat_ws("|", *STATE_KEY), 256))

    def pick(name: str) -> Column:
        return F.when(touched, F.coalesce(f"new_{name}", f"old_{name}")).otherwise(F.col(f"old_{name}")).alias(name)

    merged = both.where(stored | touched).select(
        *STATE_KEY,
        finding_id.alias("finding_id"),
        *[pick(c) for c in carried if c != "finding_id"],
        F.when(touched & (~stored | resolved | lifted), "open").otherwise(was).alias("status"),
        F.coalesce("old_first_seen_at", now).alias("first_seen_at"),
        F.when(touched, now).otherwise(F.col("old_last_seen_at")).alias("last_seen_at"),
        F.when(~(touched & resolved), F.col("old_resolved_at")).alias("resolved_at"),
        (F.coalesce("old_recurrence_count", F.lit(0)) + (touched & resolved).cast("int")).alias("recurrence_count"),
        F.when(~(touched & lifted), F.col("old_suppressed_until")).alias("suppressed_until"),
        F.col("old_superseded_by").alias("superseded_by"),
    )

    # A newer rule version for the same object closes the older ones.
    current = (
        both.where(touched & (F.col("new_rule_id") != ""))
        .groupBy(
            "environment_id", F.col("new_rule_id").alias("rule_id"), F.col("new_object_key").alias("object_key")
        )
        .agg(
            F.max_by(
                F.struct(finding_id.alias("finding_id"), "rule_version", F.col("new_run_id").alias("run_id")),
                F.struct("rule_version", "dedup_key"),
            ).alias("winner")
        )
    )
    joined = merged.join(current, ["environment_id", "rule_id", "object_key"], "left")
    outdated = F.coalesce(
        F.col("superseded_by").isNull() & (F.col("winner.rule_version") != F.col("rule_version")), F.lit(False)
    )
    final = joined.select(
        *STATE_KEY,
        *carried,
        F.when(outdated, "resolved").otherwise(F.col("status")).alias("status"),
        "first_seen_at",
        "last_seen_at",
        F.when(outdated, now).otherwise(F.col("resolved_at")).alias("resolved_at"),
        "recurrence_count",
        "suppressed_until",
        F.when(outdated, F.col("winner.finding_id")).otherwise(F.col("superseded_by")).alias("superseded_by"),
    )

    reopened = touched & (
        resolved
        | (
            (F.coalesce("action_status", F.lit("")) == "discarded")
            & ~F.col("evidence_sha256").eqNullSafe(evidence_signature(F.col("new_evidence")))
        )
    )
    kinds = F.filter(
        F.array(
            F.when(held & stored, F.struct(F.lit("suppressed").alias("event_type"), F.lit("identical evidence remains discarded").alias("reason"))),
            F.when(touched, F.struct(F.lit("observed").alias("event_type"), F.lit("").alias("reason"))),
            F.when(reopened, F.struct(F.lit("reopened").alias("event_type"), F.lit("evidence changed or suppression expired").alias("reason"))),
        ),
        lambda e: e.isNotNull(),
    )
    transitions = both.select(
        *STATE_KEY, finding_id.alias("finding_id"), F.col("new_run_id").alias("run_id"), F.explode(kinds).alias("e")
    ).select(*STATE_KEY, "finding_id", "run_id", "e.event_type", "e.reason")
    closed = joined.where(outdated).select(
        *STATE_KEY,
        "finding_id",
        F.col("winner.run_id").alias("run_id"),
        F.lit("superseded").alias("event_type"),
        F.concat(F.lit("rule version changed to "), F.col("winner.rule_version")).alias("reason"),
    )
    return Merge(final, transitions.unionByName(closed))


# --- queue, counts, alerts -------------------------------------------------------------------
def queue_keys() -> list[Key]:
    """The sort keys of the queue, all falling: severity, confidence, last seen, id."""
    known = F.lower("severity").isin("critical", "high", "medium", "low")
    rank = F.when(known, severity_rank(F.col("severity"))).otherwise(0)
    return [(k, True) for k in (rank, F.col("confidence"), F.col("last_seen_at"), F.col("finding_id"))]


def queue_order() -> list[Column]:
    return ordering(queue_keys())


def finding_queue(findings: DataFrame, status: str = "", severity: str = "", rule_id: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of findings: strongest severity first, then confidence, last seen and id."""
    kept = findings
    if status == "open":
        kept = kept.where(F.col("status").isin("open", "acknowledged"))
    elif status:
        kept = kept.where(F.col("status") == status)
    if severity:
        kept = kept.where(F.col("severity") == severity)
    if rule_id:
        kept = kept.where(F.col("rule_id") == rule_id)
    page = kept.orderBy(*queue_order())
    return (page.offset(offset) if offset else page).limit(limit)


def finding_counts(findings: DataFrame) -> DataFrame:
    """Findings by severity, by status, by type and in total, in one pass; open counts acknowledged too."""
    cells = findings.select(
        "environment_id",
        F.lower("severity").alias("severity"),
        F.lower("status").alias("status"),
        "rule_id",
    )
    grouped = cells.groupingSets(
        [
            [F.col("environment_id")],
            [F.col("environment_id"), F.col("severity")],
            [F.col("environment_id"), F.col("status")],
            [F.col("environment_id"), F.col("rule_id")],
        ],
        F.col("environment_id"),
        F.col("severity"),
        F.col("status"),
        F.col("rule_id"),
    ).agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(F.col("status").isin("open", "acknowledged")).alias("open_findings"),
        F.grouping_id().alias("g"),
    )
    name = (
        F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "severity").when(F.col("g") == 5, "status").otherwise("type")
    )
    return grouped.select(
        "environment_id",
        name.alias("dimension"),
        F.coalesce("severity", "status", "rule_id", F.lit("")).alias("value"),
        "findings",
        "open_findings",
    )


JOB_RULES = ("policy.job_failed", "job.unhealthy", "job.slo_exceeded")


def alert_candidates(findings: DataFrame, run_pairs: DataFrame, sent: DataFrame) -> DataFrame:
    """Findings to alert on, each key once per environment.

    High and critical findings count when their run is complete and its
    neighbour allows a comparison (``run_pairs``: environment_id, run_id,
    alerts_allowed); job rules always count.  ``sent`` holds keys alerted before.
    """
    operational = F.col("rule_id").startswith("job.") | (F.col("rule_id") == "policy.job_failed")
    wanted = F.col("rule_id").isin(*JOB_RULES) | F.col("severity").isin("high", "critical")
    allowed = F.coalesce(F.col("alerts_allowed"), F.lit(False))
    fresh = (
        findings.where(wanted)
        .join(run_pairs.select("environment_id", "run_id", "alerts_allowed"), ["environment_id", "run_id"], "left")
        .where(operational | allowed)
        .drop("alerts_allowed")
        .join(sent.select("environment_id", "dedup_key"), ["environment_id", "dedup_key"], "left_anti")
    )
    names = [c for c in fresh.columns if c not in ("environment_id", "dedup_key")]
    first = F.min_by(F.struct(*names), F.struct("run_id", "severity", "title"))
    return fresh.groupBy("environment_id", "dedup_key").agg(first.alias("f")).select("environment_id", "dedup_key", "f.*")


# --- impact and priority ---------------------------------------------------------------------
def impact_estimate(findings: DataFrame) -> DataFrame:
    """Measured impact: value over denominator with a level, else the reason why it is not estimated.

    Besides the finding columns the rows carry a ``basis`` map of text with the
    numbers of the evidence: size_bytes, table_index_bytes, n_dead_tup,
    n_live_tup, shared_blocks_read, shared_blocks_hit, database_size_bytes,
    delta_bytes, previous_size_bytes, coverage, month_amount, currency and the
    window marks window_start / window_end / last_vacuum / first_seen / observed_at.
    """
    rule = F.col("rule_id")

    def number(name: str) -> Column:
        return F.col("basis")[name].try_cast("double")

    def moment(name: str) -> Column:
        return F.col("basis")[name].try_cast("timestamp")

    start = F.coalesce(moment("window_start"), moment("first_seen"))
    end = F.coalesce(moment("window_end"), moment("observed_at"))
    dead_rules = rule.isin("vacuum.high_dead_tuples", "maintenance.dead_tuple_pressure", "timescale.chunk_dead_tuples")
    size_rules = rule.isin("storage.large_table", "storage.top_consumer")
    money_rules = rule.isin("cost.unused_index_waste", "cost.bloat_recoverable", "cost.query_expensive")
    cases = [
        (rule == "index.unused", number("size_bytes"), number("table_index_bytes"), end > start, 0.3, 0.1, "index_bytes_without_scans"),
        (dead_rules, number("n_dead_tup"), number("n_dead_tup") + number("n_live_tup"), moment("observed_at") > moment("last_vacuum"), 0.5, 0.2, "dead_tuples_estimate"),
        (rule == "performance.workload_scan", number("shared_blocks_read"), number("shared_blocks_read") + number("shared_blocks_hit"), moment("window_end") > moment("window_start"), 0.8, 0.5, "shared_blocks_read"),
        (size_rules, number("size_bytes"), number("database_size_bytes"), moment("observed_at").isNotNull(), 0.3, 0.1, "relation_bytes"),
        (rule == "maintenance.growth_trend", number("delta_bytes"), number("previous_size_bytes"), (F.col("basis")["coverage"] == "complete") & (moment("window_end") > moment("window_start")), 0.5, 0.2, "size_delta_bytes"),
        (money_rules, number("month_amount"), F.lit(1.0), F.col("basis")["currency"] != "", 1000.0, 100.0, "estimated_monthly_cost"),
    ]
    nothing = F.lit(None)
    metric, value, denominator = nothing.cast("string"), nothing.cast("double"), nothing.cast("double")
    level = nothing.cast("string")
    for applies, amount, total, known, high, medium, name in cases:
        usable = applies & F.coalesce(known & (total > 0) & amount.isNotNull(), F.lit(False))
        share = F.when(usable, amount / total)
        metric = F.when(usable, name).otherwise(metric)
        value = F.when(usable, amount).otherwise(value)
        denominator = F.when(usable, total).otherwise(denominator)
        level = (
            F.when(usable & (share >= high), "alto")
            .when(usable & (share >= medium), "medio")
            .when(usable, "baixo")
            .otherwise(level)
        )
    measured = findings.withColumn("impact_metric", metric).withColumn("impact_value", value)
    measured = measured.withColumn("impact_denominator", denominator).withColumn("impact_level", level)
    known_rule = rule.isin("index.unused", "performance.workload_scan", "maintenance.growth_trend") | dead_rules | size_rules | money_rules
    return measured.withColumn("impact_ratio", F.col("impact_value") / F.col("impact_denominator")).withColumn(
        "impact_status",
        F.when(F.col("impact_level").isNotNull(), "estimated")
        .when(known_rule, "missing_measure")
        .otherwise("rule_without_metric"),
    )


def priority_score(findings: DataFrame) -> DataFrame:
    """Severity times impact times confidence over effort, rounded to two places."""
    severity = F.lower("severity")
    weight = (
        F.when(severity == "critical", 5.0).when(severity == "high", 4.0).when(severity == "medium", 3.0).when(severity == "low", 2.0).otherwise(1.0)
    )
    level = F.col("impact_level")
    impact = F.when(level.isNull(), 0.8).when(level == "alto", 1.5).when(level == "medio", 1.2).otherwise(1.0)
    trust = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("confidence", F.lit(0.0))))
    efforts = F.broadcast(catalog(findings.sparkSession).select("rule_id", "effort"))  # a fixed list of rules
    rated = findings.join(efforts, "rule_id", "left").withColumn("effort", F.coalesce("effort", F.lit(UNKNOWN_EFFORT)))
    divisor = F.when(F.col("effort") == "baixo", 1.0).when(F.col("effort") == "alto", 2.0).otherwise(1.5)
    score = F.round(weight * impact * F.greatest(trust, F.lit(0.3)) / divisor, 2)
    return rated.withColumn("severity_weight", weight).withColumn("score", score)


def priorities(findings: DataFrame, limit: int = 10) -> DataFrame:
    """The ``limit`` most urgent open findings of each environment, of all in its queue."""
    taken = findings.where(F.col("status").isin("open", "acknowledged"))
    order = W.partitionBy("environment_id").orderBy(F.desc("score"), F.desc("severity_weight"), "finding_id")
    return (
        priority_score(taken)
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= limit)
        .drop("severity_weight")
    )


# --- measured gain ---------------------------------------------------------------------------
def measure_gain(metrics: DataFrame, runs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Before and after of a metric, and whether the two runs can be compared.

    ``metrics``: environment_id, run_id, object_key, metric, value, counter_epoch
    (NULL for metrics that are no counter).  ``runs``: environment_id, run_id,
    started_at, status, completeness, analysis_status, profile,
    collector_version, rules_hash.  ``pairs``: environment_id, before_run_id,
    after_run_id, object_key, metric, workload_comparable.
    """
    query_metrics = ("query_mean_latency_us", "query_reads_per_1000_calls")

    def side(prefix: str) -> DataFrame:
        run = runs.select(
            "environment_id",
            F.col("run_id").alias(f"{prefix}_run_id"),
            F.struct("started_at", "status", "completeness", "analysis_status", "profile", "collector_version", "rules_hash").alias(f"{prefix}_run"),
        )
        values = metrics.select(
            "environment_id",
            F.col("run_id").alias(f"{prefix}_run_id"),
            "object_key",
            "metric",
            F.col("value").alias(f"{prefix}_value"),
            F.col("counter_epoch").alias(f"{prefix}_epoch"),
        )
        return run, values

    before_run, before = side("before")
    after_run, after = side("after")
    joined = (
        pairs.join(before_run, ["environment_id", "before_run_id"])
        .join(after_run, ["environment_id", "after_run_id"])
        .where(F.col("before_run.started_at") < F.col("after_run.started_at"))
        .join(before, ["environment_id", "before_run_id", "object_key", "metric"], "left")
        .join(after, ["environment_id", "after_run_id", "object_key", "metric"], "left")
    )
    sound = F.lit(True)
    for prefix in ("before_run", "after_run"):
        sound = (
            sound
            & (F.col(f"{prefix}.status") == "success")
            & (F.col(f"{prefix}.completeness") == "complete")
            & (F.col(f"{prefix}.analysis_status") == "success")
        )
    for name in ("profile", "collector_version", "rules_hash"):
        sound = sound & (F.col(f"before_run.{name}") == F.col(f"after_run.{name}"))
    epochs = ~F.col("metric").isin(*query_metrics) | (F.col("before_epoch") == F.col("after_epoch"))
    comparable = (
        F.col("workload_comparable")
        & sound
        & F.coalesce(epochs, F.lit(False))
        & F.col("before_value").isNotNull()
        & F.col("after_value").isNotNull()
    )
    comparable = F.coalesce(comparable, F.lit(False))
    return joined.select(
        "environment_id",
        "object_key",
        "metric",
        "before_run_id",
        "after_run_id",
        "before_value",
        "after_value",
        comparable.alias("comparable"),
        F.when(comparable, F.col("after_value") - F.col("before_value")).alias("change"),
        F.when(comparable, "measured").otherwise("not_comparable").alias("measured_status"),
    )
