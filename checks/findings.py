"""Life of findings: enrichment, merge, queue, impact, priority, alerts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.base import Registry, scratch
from checks.bundle import DerivedBundle
from checks.rules import policies
from plumbline.functions.keys import dedup_key
from plumbline.operators import findings as fnd
from plumbline.operators.rules import catalog
from plumbline.operators.rules.base import FINDING_COLUMNS
from plumbline.plans import analysis, derive
from plumbline.sources.findings_store import FindingStore

REGISTRY = Registry()
NOW = "2024-01-20 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def raw_findings(spark, folder):
    """Findings of two rules that carry parameters, over the derived tables."""
    bundle = DerivedBundle(spark, folder)
    tables = fnd.with_parameters(bundle["tables"], policies(spark, folder))
    parts = {"tables": tables, "columns": bundle["columns"], "indexes": bundle["indexes"]}
    burden = analysis.run_rule(parts, "index.write_burden", analysis.Settings(from_policies=True))
    return burden.unionByName(analysis.run_rule(bundle, "model.type_review")).select(*FINDING_COLUMNS)


RAW_TYPE = """SELECT environment_id, run_id, schema_name, 'model.type_review' AS rule_id, database_name || '.' || schema_name || '.' || table_name || '.' || column_name AS object_key,
 'model.type_review: ' || database_name || '.' || schema_name || '.' || table_name || '.' || column_name AS title FROM s_column WHERE data_type IN ('money', 'timestamp') OR column_name = 'order_status'"""
RAW_BURDEN = """SELECT t.environment_id, t.run_id, t.schema_name, 'index.write_burden' AS rule_id, t.database_name || '.' || t.schema_name || '.' || t.table_name AS object_key, 'index.write_burden: ' || t.database_name || '.' || t.schema_name || '.' || t.table_name AS title
 FROM s_table t JOIN (SELECT environment_id, run_id, database_name, schema_name, table_name, count(*) AS n FROM s_index GROUP BY ALL) i USING (environment_id, run_id, database_name, schema_name, table_name)
 LEFT JOIN s_policy_override e ON e.environment_id = t.environment_id AND e.schema_name = '' AND e.rule_id = 'index.write_burden' LEFT JOIN s_policy_override s ON s.environment_id = t.environment_id AND s.schema_name = t.schema_name AND s.rule_id = 'index.write_burden'
 WHERE n >= coalesce(s.min_indexes, e.min_indexes, 8) AND n_tup_ins + n_tup_upd + n_tup_del >= coalesce(s.min_writes, e.min_writes, 100000) AND collected_at - stats_reset >= INTERVAL 30 DAY"""


@REGISTRY.add(
    "fnd1_enrich_findings",
    derive.ctes("s_table", "s_column", "s_index", "s_policy_override") + f""" SELECT environment_id, run_id, rule_id, object_key, '1.0.0' AS rule_version, split_part(rule_id, '.', 1) AS category, CAST(CASE WHEN rule_id = 'model.type_review' THEN 0.45 ELSE 0.9 END AS DOUBLE) AS confidence, p AS rule_parameters,
 substr(sha256(rule_id || '@1.0.0|' || object_key || '|' || title || p), 1, 32) AS dedup_key FROM (SELECT f.*, CASE WHEN f.rule_id = 'model.type_review' THEN '{{"check_money":"true","check_status_text":"true","check_timestamp_without_timezone":"true"}}'
  ELSE '{{"min_indexes":"' || coalesce(s.min_indexes, e.min_indexes, 8) || '","min_writes":"' || coalesce(s.min_writes, e.min_writes, 100000) || '"}}' END AS p, coalesce(s.enabled, e.enabled, true) AS ok FROM ({RAW_TYPE} UNION ALL {RAW_BURDEN}) f
 LEFT JOIN s_policy_override e ON e.environment_id = f.environment_id AND e.schema_name = '' AND e.rule_id = f.rule_id LEFT JOIN s_policy_override s ON s.environment_id = f.environment_id AND s.schema_name = f.schema_name AND s.schema_name <> '' AND s.rule_id = f.rule_id) WHERE ok""",
)
def enrich(spark, folder):
    return fnd.enrich_findings(raw_findings(spark, folder), policies(spark, folder)).select(
        "environment_id", "run_id", "rule_id", "object_key", "rule_version", "category", "confidence", "rule_parameters", "dedup_key"
    )


@REGISTRY.add("fnd2_dedup_key", derive.ctes("f_observed") + " SELECT environment_id, run_id, object_key, title, substr(sha256(rule_id || '|' || object_key || '|' || title), 1, 32) AS dedup_key FROM f_observed")
def keys(spark, folder):
    key = dedup_key(F.col("rule_id"), F.col("object_key"), F.col("title"))
    return derive.view(spark, folder, "f_observed").select("environment_id", "run_id", "object_key", "title", key.alias("dedup_key"))


def merge(spark, folder):
    observed = derive.view(spark, folder, "f_observed").where("run_id = 'd20'").withColumn("rule_version", F.lit("1.0.0"))
    actions = derive.view(spark, folder, "f_action").withColumn("evidence_sha256", F.sha2("signed_evidence", 256))
    return fnd.merge_findings(derive.view(spark, folder, "f_state").drop("k"), observed, actions, now())


MERGE = derive.ctes("f_observed", "f_state", "f_action") + f""", ob AS (SELECT * FROM f_observed WHERE run_id = 'd20'),
 jn AS (SELECT environment_id, dedup_key, rule_version, s.finding_id, o.dedup_key IS NOT NULL AS seen, s.finding_id IS NOT NULL AS stored, o.rule_id AS orule, o.object_key AS oobj, o.run_id AS orun, o.severity AS osev, o.evidence AS oev, s.*, a.action_status, sha256(a.signed_evidence) AS sig, a.suppress_until
  FROM (SELECT *, '1.0.0' AS rule_version FROM ob) o FULL JOIN f_state s USING (environment_id, dedup_key, rule_version) LEFT JOIN f_action a USING (environment_id, dedup_key, rule_version)),
 dc AS (SELECT *, coalesce(finding_id, sha256(environment_id || '|' || dedup_key || '|' || rule_version)) AS fid, CASE WHEN NOT seen THEN NULL WHEN coalesce(action_status, '') <> 'discarded' THEN 'proceed' WHEN sig = sha256(oev) AND (suppress_until IS NULL OR suppress_until > TIMESTAMP '{NOW}') THEN 'hold' ELSE 'reopen' END AS decision FROM jn),
 tt AS (SELECT *, seen AND decision <> 'hold' AS touched, status = 'suppressed' AND (decision = 'reopen' OR suppressed_until <= TIMESTAMP '{NOW}') AS lifted FROM dc),
 m AS (SELECT environment_id, dedup_key, rule_version, fid AS finding_id, CASE WHEN coalesce(touched, false) THEN coalesce(orule, rule_id) ELSE rule_id END AS rule_id, CASE WHEN coalesce(touched, false) THEN oobj ELSE object_key END AS object_key, CASE WHEN coalesce(touched, false) THEN orun ELSE run_id END AS run_id, CASE WHEN coalesce(touched, false) THEN osev ELSE severity END AS severity,
  CASE WHEN coalesce(touched, false) AND (NOT stored OR status = 'resolved' OR coalesce(lifted, false)) THEN 'open' ELSE status END AS status, coalesce(first_seen_at, TIMESTAMP '{NOW}') AS first_seen_at, CASE WHEN coalesce(touched, false) THEN TIMESTAMP '{NOW}' ELSE last_seen_at END AS last_seen_at,
  CASE WHEN NOT (coalesce(touched, false) AND coalesce(status = 'resolved', false)) THEN resolved_at END AS resolved_at, CAST(coalesce(recurrence_count, 0) + CASE WHEN coalesce(touched, false) AND coalesce(status = 'resolved', false) THEN 1 ELSE 0 END AS INTEGER) AS recurrence_count,
  CASE WHEN NOT (coalesce(touched, false) AND coalesce(lifted, false)) THEN suppressed_until END AS suppressed_until FROM tt WHERE stored OR coalesce(touched, false)),
 w AS (SELECT environment_id, orule AS rule_id, oobj AS object_key, arg_max(fid, dedup_key) AS wid, max(orun) AS wrun FROM tt WHERE coalesce(touched, false) GROUP BY ALL),
 fin AS (SELECT m.*, wrun, CASE WHEN w.wid IS NOT NULL AND rule_version <> '1.0.0' THEN w.wid END AS superseded_by FROM m LEFT JOIN w USING (environment_id, rule_id, object_key))"""
STATE_SQL = MERGE + f" SELECT * EXCLUDE (wrun, status, resolved_at), CASE WHEN superseded_by IS NOT NULL THEN 'resolved' ELSE status END AS status, CASE WHEN superseded_by IS NOT NULL THEN TIMESTAMP '{NOW}' ELSE resolved_at END AS resolved_at FROM fin"


@REGISTRY.add("fnd3_upsert_findings", STATE_SQL)
def upsert(spark, folder):
    return merge(spark, folder).state.drop("title", "evidence", "confidence")


@REGISTRY.add("fnd4_supersede", MERGE + " SELECT environment_id, dedup_key, rule_version, superseded_by FROM fin WHERE superseded_by IS NOT NULL")
def supersede(spark, folder):
    return merge(spark, folder).state.where("superseded_by IS NOT NULL").select("environment_id", "dedup_key", "rule_version", "superseded_by")


@REGISTRY.add("fnd5_discard_hold", MERGE + " SELECT environment_id, dedup_key, rule_version, decision FROM dc WHERE decision IS NOT NULL")
def discard(spark, folder):
    observed = derive.view(spark, folder, "f_observed").where("run_id = 'd20'").withColumn("rule_version", F.lit("1.0.0"))
    joined = observed.join(derive.view(spark, folder, "f_action"), fnd.STATE_KEY, "left")
    decision = fnd.discard_decision(
        F.col("action_status"), F.sha2("signed_evidence", 256), fnd.evidence_signature(F.col("evidence")), F.col("suppress_until"), now()
    )
    return joined.select(*fnd.STATE_KEY, decision.alias("decision"))


@REGISTRY.add(
    "fnd6_finding_events",
    MERGE + """ SELECT environment_id, dedup_key, rule_version, fid AS finding_id, orun AS run_id, 'suppressed' AS event_type, 'identical evidence remains discarded' AS reason FROM tt WHERE seen AND stored AND decision = 'hold'
 UNION ALL SELECT environment_id, dedup_key, rule_version, fid, orun, 'observed', '' FROM tt WHERE touched
 UNION ALL SELECT environment_id, dedup_key, rule_version, fid, orun, 'reopened', 'evidence changed or suppression expired' FROM tt WHERE touched AND (coalesce(status = 'resolved', false) OR (coalesce(action_status, '') = 'discarded' AND sig IS DISTINCT FROM sha256(oev)))
 UNION ALL SELECT environment_id, dedup_key, rule_version, finding_id, wrun, 'superseded', 'rule version changed to 1.0.0' FROM fin WHERE superseded_by IS NOT NULL""",
)
def events(spark, folder):
    return merge(spark, folder).events


def merged_store(spark, folder):
    """The stored findings after a merge that brings news of one environment, then of the others, then of none."""
    store = FindingStore(spark, f"findings_{uuid.uuid4().hex}", scratch(spark, "findings"), buckets=8)
    store.create(derive.view(spark, folder, "f_state").drop("k"))
    observed = derive.view(spark, folder, "f_observed").where("run_id = 'd20'").withColumn("rule_version", F.lit("1.0.0"))
    actions = derive.view(spark, folder, "f_action").withColumn("evidence_sha256", F.sha2("signed_evidence", 256))
    first = F.col("environment_id") == "env0"
    store.merge(observed.where(first), actions, now())
    store.merge(observed.where(~first), actions, now())
    store.merge(observed.limit(0), actions, now())
    return store


@REGISTRY.add("fnd31_stored_merge", STATE_SQL)
def stored_merge(spark, folder):
    return merged_store(spark, folder).state().drop("title", "evidence", "confidence")


@REGISTRY.add("fnd32_stored_events", REGISTRY.sql["fnd6_finding_events"])
def stored_events(spark, folder):
    return merged_store(spark, folder).events().drop("merged_at")


RANK_SQL = "CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END"
QUEUE = f"{RANK_SQL} DESC, confidence DESC, last_seen_at DESC, finding_id DESC"


@REGISTRY.add("fnd7_finding_queue", derive.ctes("f_state") + f" SELECT environment_id, finding_id, severity, status FROM f_state WHERE status IN ('open', 'acknowledged') ORDER BY {QUEUE} LIMIT 40 OFFSET 20")
def queue(spark, folder):
    page = fnd.finding_queue(derive.view(spark, folder, "f_state"), status="open", limit=40, offset=20)
    return page.select("environment_id", "finding_id", "severity", "status")


def measured(spark, folder):
    """Findings with the numbers their impact is measured by."""
    text = {
        "size_bytes": F.col("k") * 10,
        "table_index_bytes": F.lit(100),
        "database_size_bytes": F.when(F.col("k") % 7 != 0, F.lit(200)),
        "n_dead_tup": F.col("k"),
        "n_live_tup": F.lit(30),
        "window_start": F.lit("2024-01-01 00:00:00"),
        "window_end": F.lit("2024-01-02 00:00:00"),
        "observed_at": F.lit("2024-01-03 00:00:00"),
        "last_vacuum": F.when(F.col("k") % 3 != 0, F.lit("2024-01-02 00:00:00")),
        "month_amount": F.col("k") * 50,
        "currency": F.when(F.col("k") % 4 == 0, "").otherwise("BRL"),
    }
    basis = F.map_filter(F.create_map(*[x for n, c in text.items() for x in (F.lit(n), c.cast("string"))]), lambda k, v: v.isNotNull())
    rule = F.when(F.col("rule_id") == "security.powerful_role", "cost.query_expensive").when(
        F.col("rule_id") == "integrity.fk_without_index", F.when(F.col("k") % 2 == 0, "vacuum.high_dead_tuples").otherwise(F.col("rule_id"))
    ).otherwise(F.col("rule_id"))
    return derive.view(spark, folder, "f_state").withColumn("rule_id", rule).withColumn("basis", basis)


IMPACT = derive.ctes("f_state") + """, rl AS (SELECT * REPLACE (CASE WHEN rule_id = 'security.powerful_role' THEN 'cost.query_expensive' WHEN rule_id = 'integrity.fk_without_index' AND k % 2 = 0 THEN 'vacuum.high_dead_tuples' ELSE rule_id END AS rule_id) FROM f_state),
 im AS (SELECT *, CASE WHEN rule_id = 'index.unused' THEN k * 10 / 100 WHEN rule_id = 'storage.large_table' AND k % 7 <> 0 THEN k * 10 / 200 WHEN rule_id = 'vacuum.high_dead_tuples' AND k % 3 <> 0 THEN k / (k + 30) WHEN rule_id = 'cost.query_expensive' AND k % 4 <> 0 THEN k * 50.0 END AS impact_ratio,
  CASE WHEN rule_id IN ('index.unused', 'storage.large_table') THEN 0.3 WHEN rule_id = 'vacuum.high_dead_tuples' THEN 0.5 ELSE 1000 END AS hi, CASE WHEN rule_id IN ('index.unused', 'storage.large_table') THEN 0.1 WHEN rule_id = 'vacuum.high_dead_tuples' THEN 0.2 ELSE 100 END AS me FROM rl),
 il AS (SELECT * EXCLUDE (hi, me), CASE WHEN impact_ratio >= hi THEN 'alto' WHEN impact_ratio >= me THEN 'medio' WHEN impact_ratio IS NOT NULL THEN 'baixo' END AS impact_level FROM im)"""


@REGISTRY.add("fnd8_impact_estimate", IMPACT + " SELECT environment_id, finding_id, rule_id, impact_level, round(CAST(impact_ratio AS DOUBLE), 6) AS impact_ratio, CASE WHEN impact_level IS NOT NULL THEN 'estimated' WHEN rule_id = 'integrity.fk_without_index' THEN 'rule_without_metric' ELSE 'missing_measure' END AS impact_status FROM il")
def impact(spark, folder):
    found = fnd.impact_estimate(measured(spark, folder))
    return found.select("environment_id", "finding_id", "rule_id", "impact_level", F.round("impact_ratio", 6).alias("impact_ratio"), "impact_status")


@REGISTRY.add(
    "fnd9_measure_gain",
    derive.ctes("f_table_daily", "f_daily_run") + """, ob AS (SELECT environment_id, run_id, database_name || '.' || schema_name || '.' || table_name AS object_key, 'table_size_bytes' AS metric, total_size_bytes AS value FROM f_table_daily)
 SELECT *, CASE WHEN comparable THEN after_value - before_value END AS change, CASE WHEN comparable THEN 'measured' ELSE 'not_comparable' END AS measured_status FROM (SELECT k.environment_id, k.object_key, 'table_size_bytes' AS metric, 'd4' AS before_run_id, after_run_id, b.value AS before_value, a.value AS after_value, rb.status = 'success' AND ra.status = 'success' AND b.value IS NOT NULL AND a.value IS NOT NULL AS comparable
 FROM (SELECT DISTINCT environment_id, object_key, CASE WHEN object_key LIKE '%1' THEN 'd8' ELSE 'd9' END AS after_run_id FROM ob) k JOIN f_daily_run rb ON rb.environment_id = k.environment_id AND rb.run_id = 'd4' JOIN f_daily_run ra ON ra.environment_id = k.environment_id AND ra.run_id = after_run_id LEFT JOIN ob b ON b.object_key = k.object_key AND b.environment_id = k.environment_id AND b.run_id = 'd4' LEFT JOIN ob a ON a.object_key = k.object_key AND a.environment_id = k.environment_id AND a.run_id = after_run_id)""",
)
def gain(spark, folder):
    metrics = derive.view(spark, folder, "f_table_daily").select(
        "environment_id", "run_id", F.concat_ws(".", "database_name", "schema_name", "table_name").alias("object_key"),
        F.lit("table_size_bytes").alias("metric"), F.col("total_size_bytes").alias("value"), F.lit(None).cast("string").alias("counter_epoch"),
    )
    runs = derive.view(spark, folder, "f_daily_run").select(
        "*", F.lit("complete").alias("completeness"), F.lit("success").alias("analysis_status"), F.lit("daily").alias("profile"),
        F.lit("c1").alias("collector_version"), F.lit("r1").alias("rules_hash"),
    )
    pairs = metrics.select("environment_id", "object_key").distinct().select(
        "*", F.lit("table_size_bytes").alias("metric"), F.lit("d4").alias("before_run_id"),
        F.when(F.col("object_key").endswith("1"), "d8").otherwise("d9").alias("after_run_id"), F.lit(True).alias("workload_comparable"),
    )
    return fnd.measure_gain(metrics, runs, pairs)


EFFORT_SQL = "CASE WHEN rule_id IN ('cost.query_expensive') THEN 'baixo' WHEN rule_id = 'storage.large_table' THEN 'alto' ELSE 'médio' END"
PRIORITY = IMPACT + f""", cd AS (SELECT * FROM il WHERE status IN ('open', 'acknowledged')),
 sc AS (SELECT *, {EFFORT_SQL} AS effort, CASE severity WHEN 'critical' THEN 5 WHEN 'high' THEN 4 WHEN 'medium' THEN 3 WHEN 'low' THEN 2 ELSE 1 END AS wt, CASE impact_level WHEN 'alto' THEN 1.5 WHEN 'medio' THEN 1.2 WHEN 'baixo' THEN 1.0 ELSE 0.8 END AS fc FROM cd),
 rk AS (SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY score DESC, wt DESC, finding_id) AS rank FROM (SELECT *, round(wt * CAST(fc AS DOUBLE) * confidence / CASE effort WHEN 'baixo' THEN 1 WHEN 'alto' THEN 2 ELSE 1.5 END, 2) AS score FROM sc))"""


@REGISTRY.add("fnd10_priority", PRIORITY + " SELECT environment_id, finding_id, effort, score, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 20")
def priority(spark, folder):
    ranked = fnd.priorities(fnd.impact_estimate(measured(spark, folder)), limit=20)
    return ranked.select("environment_id", "finding_id", "effort", "score", "rank")


COUNTS = " UNION ALL ".join(
    f"SELECT environment_id, '{d}' AS dimension, {v} AS value, count(*) AS findings, count(*) FILTER (WHERE status IN ('open', 'acknowledged')) AS open_findings FROM f_state GROUP BY ALL"
    for d, v in {"severity": "severity", "status": "status", "type": "rule_id"}.items()
) + " UNION ALL SELECT environment_id, 'total', '', count(*), count(*) FILTER (WHERE status IN ('open', 'acknowledged')) FROM f_state GROUP BY ALL"


@REGISTRY.add("fnd15_finding_counts", derive.ctes("f_state") + " " + COUNTS)
def counts(spark, folder):
    return fnd.finding_counts(derive.view(spark, folder, "f_state"))


@REGISTRY.add(
    "fnd28_alert_candidates",
    derive.ctes("f_observed") + """ SELECT environment_id, dedup_key, run_id, severity FROM (SELECT *, row_number() OVER (PARTITION BY environment_id, dedup_key ORDER BY run_id, severity, title) AS p FROM (SELECT * REPLACE (CASE WHEN rule_id = 'index.unused' THEN 'job.unhealthy' ELSE rule_id END AS rule_id) FROM f_observed) f
 WHERE (rule_id = 'job.unhealthy' OR (severity IN ('high', 'critical') AND run_id LIKE 'd1%')) AND NOT EXISTS (SELECT 1 FROM f_observed s WHERE s.run_id = 'd2' AND s.environment_id = f.environment_id AND s.dedup_key = f.dedup_key)) WHERE p = 1""",
)
def alerts(spark, folder):
    observed = derive.view(spark, folder, "f_observed")
    rule = F.when(F.col("rule_id") == "index.unused", "job.unhealthy").otherwise(F.col("rule_id"))
    pairs = observed.select("environment_id", "run_id").distinct().withColumn("alerts_allowed", F.col("run_id").startswith("d1"))
    found = fnd.alert_candidates(observed.withColumn("rule_id", rule), pairs, observed.where("run_id = 'd2'"))
    return found.select("environment_id", "dedup_key", "run_id", "severity")


@REGISTRY.add(
    "plan_analyze_counts",
    derive.ctes("s_table", "s_column", "s_sequence", "s_hypertable") + """ SELECT rule_id, severity, count(*) AS findings FROM (
 SELECT 'storage.large_table' AS rule_id, 'low' AS severity FROM s_table WHERE total_size_bytes >= 1073741824 UNION ALL SELECT 'integrity.missing_primary_key', 'medium' FROM s_table WHERE NOT has_primary_key AND NOT is_partition AND relation_class <> 'foreign_table'
 UNION ALL SELECT 'model.wide_table', 'low' FROM s_table WHERE column_count >= 50 UNION ALL SELECT 'model.naming_inconsistent', 'info' FROM s_table WHERE table_name LIKE 'Tbl%' UNION ALL SELECT 'model.naming_inconsistent', 'info' FROM s_column WHERE column_name = 'CreatedAt' OR column_name LIKE '%-%'
 UNION ALL SELECT 'sequence.near_limit', CASE WHEN last_value / max_value >= 0.8 AND data_type = 'integer' THEN 'high' ELSE 'medium' END FROM s_sequence WHERE max_value > 1000 AND last_value / max_value >= 0.7 UNION ALL SELECT 'chunk.high_count', 'medium' FROM s_hypertable WHERE num_chunks >= 500) GROUP BY ALL""",
)
def analyze(spark, folder):
    bundle = DerivedBundle(spark, folder)
    some = {name: bundle[name] for name in ("tables", "columns", "sequences", "hypertables")}
    wanted = ("storage.large_table", "integrity.missing_primary_key", "model.wide_table", "model.naming_inconsistent", "sequence.near_limit", "chunk.high_count")
    found = analysis.analyze(some).where(F.col("rule_id").isin(*wanted))
    return found.groupBy("rule_id", "severity").agg(F.count(F.lit(1)).alias("findings"))


assert set(catalog.PARAMETERS) <= set(catalog.RULE_IDS)
