"""Scores, completeness, trends, inventory and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry
from checks.bundle import DerivedBundle
from plumbline.operators import scores as sc
from plumbline.plans import derive

REGISTRY = Registry()
TABLE_SQL = "environment_id, run_id, database_name, schema_name, table_name"


def view(spark, folder, name):
    return derive.view(spark, folder, name)


PENALTY = "CASE severity WHEN 'critical' THEN 25 WHEN 'high' THEN 15 WHEN 'medium' THEN 8 WHEN 'low' THEN 3 ELSE 1 END"
GROUPED = "CASE WHEN category IN ('security', 'config') THEN 'security' WHEN category IN ('performance', 'index') THEN 'performance' WHEN category = 'vacuum' THEN 'maintenance' ELSE 'structure' END"


def score_sql(by: str) -> str:
    pens = ", ".join(f"least(100, coalesce(sum({PENALTY}) FILTER (WHERE {GROUPED} = '{g}'), 0)) AS {g[0]}{g[1]}" for g in ("security", "performance", "structure", "maintenance"))
    return f"""(SELECT *, (se * 35 + pe * 30 + st * 20 + ma * 15) // 100 AS score FROM (SELECT {by}, tables, primary_keys, coalesce(findings, 0) AS findings, greatest(0, 100 - coalesce(f.se, 0)) AS se, greatest(0, 100 - coalesce(f.pe, 0)) AS pe, greatest(0, 80 + 20 * primary_keys // tables - coalesce(f.st, 0)) AS st, greatest(0, 100 - coalesce(f.ma, 0)) AS ma
 FROM (SELECT {by}, count(*) AS tables, count(*) FILTER (WHERE has_primary_key) AS primary_keys FROM f_table_snapshot GROUP BY ALL) t LEFT JOIN (SELECT {by}, count(*) AS findings, {pens} FROM s_monthly_finding GROUP BY ALL) f USING ({by})))"""


SCORES = derive.ctes("f_table_snapshot", "s_monthly_finding", "f_run", "s_collector", "s_database")


@REGISTRY.add("fnd11_scope_score", SCORES + f" SELECT environment_id, run_id, tables, primary_keys, findings, CAST(se AS BIGINT) AS security_score, CAST(pe AS BIGINT) AS performance_score, CAST(st AS BIGINT) AS structure_score, CAST(ma AS BIGINT) AS maintenance_score, CAST(score AS BIGINT) AS score FROM {score_sql('environment_id, run_id')}")
def scope_score(spark, folder):
    return sc.scope_score(view(spark, folder, "s_monthly_finding"), view(spark, folder, "f_table_snapshot"))


SCOPE = "environment_id, run_id, database_name, schema_name"


@REGISTRY.add(
    "fnd12_scope_aggregates",
    SCORES + f""" SELECT {SCOPE}, tables, CASE WHEN ok THEN 'available' ELSE 'insufficient_coverage' END AS score_status, CASE WHEN ok THEN CAST(score AS BIGINT) END AS score, CAST(CASE WHEN NOT ok THEN 0 WHEN status = 'success' THEN 1 ELSE 0.75 END AS DOUBLE) AS confidence
 FROM (SELECT s.*, r.status, r.analysis_status = 'success' AND EXISTS (SELECT 1 FROM s_collector c WHERE c.environment_id = s.environment_id AND c.run_id = s.run_id AND c.database_name = s.database_name AND c.collector = 'postgres.indexes' AND c.status = 'success') AS ok FROM {score_sql(SCOPE)} s JOIN f_run r USING (environment_id, run_id) WHERE r.status <> 'failed')""",
)
def aggregates(spark, folder):
    return sc.scope_aggregates(
        view(spark, folder, "s_monthly_finding"), view(spark, folder, "f_table_snapshot"), view(spark, folder, "f_run"), view(spark, folder, "s_collector")
    )


CONFIDENCE = """cf AS (SELECT environment_id, run_id, count(*) * 4 AS w, sum((SELECT count(DISTINCT collector) FROM s_collector c WHERE c.environment_id = d.environment_id AND c.run_id = d.run_id AND c.database_name = d.database_name AND c.status = 'success')) AS n FROM s_database d GROUP BY ALL),
 cc AS (SELECT environment_id, run_id, CAST(w - n AS BIGINT) AS missing_collectors, n / w * CASE WHEN status = 'success' THEN 1 ELSE 0.75 END AS confidence FROM cf JOIN f_run USING (environment_id, run_id) WHERE status <> 'failed')"""


def confidence(spark, folder):
    return sc.coverage_confidence(view(spark, folder, "s_database"), view(spark, folder, "f_run"), view(spark, folder, "s_collector"))


@REGISTRY.add("fnd13_coverage_confidence", SCORES + f", {CONFIDENCE} SELECT environment_id, run_id, missing_collectors, round(CAST(confidence AS DOUBLE), 6) AS confidence FROM cc")
def coverage_confidence(spark, folder):
    return confidence(spark, folder).withColumn("confidence", F.round("confidence", 6))


@REGISTRY.add(
    "fnd14_snapshot_completeness",
    derive.ctes("f_run", "f_coverage") + """ SELECT environment_id, run_id, status, coalesce(n, 0) AS failed_databases, CAST(0 AS BIGINT) AS failed_collectors, CASE WHEN status = 'partial_success' OR n > 0 THEN 'partial' WHEN status = 'success' THEN 'complete' ELSE 'empty' END AS completeness
 FROM f_run LEFT JOIN (SELECT environment_id, run_id, count(DISTINCT database_name) AS n FROM f_coverage WHERE status = 'failed' GROUP BY ALL) USING (environment_id, run_id)""",
)
def completeness(spark, folder):
    return sc.snapshot_completeness(view(spark, folder, "f_run"), view(spark, folder, "f_coverage"))


TREND = """bd AS (SELECT DISTINCT environment_id, run_id FROM f_coverage WHERE status <> 'success'),
 bk AS (SELECT r.*, date_trunc('quarter', started_at) AS bucket, CASE WHEN status = 'success' AND b.run_id IS NULL THEN 'complete' ELSE 'partial' END AS cov FROM f_run r LEFT JOIN bd b USING (environment_id, run_id) WHERE status <> 'failed' QUALIFY row_number() OVER (PARTITION BY environment_id, date_trunc('quarter', started_at) ORDER BY started_at DESC, run_id DESC) = 1)"""
POINT = "environment_id, bucket, run_id, started_at, status, collector_version, profile, analysis_status, stats_reset, rules_hash"


@REGISTRY.add("fnd16_storage_trend", derive.ctes("f_run", "f_coverage", "s_database") + f", {TREND} SELECT {POINT}, cov AS coverage, z AS size_bytes FROM bk LEFT JOIN (SELECT environment_id, run_id, CAST(sum(size_bytes) AS BIGINT) AS z FROM s_database WHERE NOT is_template GROUP BY ALL) USING (environment_id, run_id)")
def storage_trend(spark, folder):
    return sc.storage_trend(view(spark, folder, "f_run"), view(spark, folder, "f_coverage"), view(spark, folder, "s_database"), "quarter")


FINDING_TREND = derive.ctes("f_run", "f_coverage", "s_monthly_finding", "f_table_snapshot", "s_collector", "s_database") + f""", {TREND}, ft AS (SELECT {POINT}, CASE WHEN analysis_status = 'success' THEN cov ELSE 'partial' END AS coverage, CASE WHEN analysis_status = 'success' THEN coalesce(n, 0) END AS findings, CASE WHEN analysis_status = 'success' THEN coalesce(c, 0) END AS critical, CASE WHEN analysis_status = 'success' THEN coalesce(h, 0) END AS high
 FROM bk LEFT JOIN (SELECT environment_id, run_id, count(*) AS n, count(*) FILTER (WHERE severity = 'critical') AS c, count(*) FILTER (WHERE severity = 'high') AS h FROM s_monthly_finding GROUP BY ALL) USING (environment_id, run_id))"""


def finding_points(spark, folder):
    return sc.finding_trend(view(spark, folder, "f_run"), view(spark, folder, "f_coverage"), view(spark, folder, "s_monthly_finding"), "quarter")


@REGISTRY.add("fnd16_finding_trend", FINDING_TREND + " SELECT * FROM ft")
def finding_trend(spark, folder):
    return finding_points(spark, folder)


@REGISTRY.add(
    "fnd17_trend_comparability",
    FINDING_TREND + """ SELECT environment_id, run_id, note AS comparison_note, note = '' AS comparable, coalesce(pr <> stats_reset, false) AS counter_reset FROM (SELECT *, CASE WHEN pr <> stats_reset THEN 'counters_reset' WHEN coverage <> 'complete' THEN 'partial' WHEN pi IS NULL THEN '' WHEN pc <> 'complete' THEN 'previous_partial' WHEN pp <> profile THEN 'profile' WHEN pv <> collector_version THEN 'collector_version' ELSE '' END AS note
 FROM (SELECT *, lag(run_id) OVER w AS pi, lag(coverage) OVER w AS pc, lag(profile) OVER w AS pp, lag(collector_version) OVER w AS pv, lag(stats_reset) OVER w AS pr FROM ft WINDOW w AS (PARTITION BY environment_id ORDER BY started_at)))""",
)
def comparability(spark, folder):
    return sc.trend_comparability(finding_points(spark, folder)).select("environment_id", "run_id", "comparison_note", "comparable", "counter_reset")


@REGISTRY.add(
    "fnd18_score_trend",
    FINDING_TREND + f", {CONFIDENCE} SELECT environment_id, ft.run_id, round(CAST(confidence AS DOUBLE), 6) AS score_confidence, CASE WHEN coverage = 'complete' AND ft.status = 'success' AND missing_collectors = 0 THEN CAST(s.score AS BIGINT) END AS score FROM ft LEFT JOIN cc USING (environment_id, run_id) LEFT JOIN {score_sql('environment_id, run_id')} s USING (environment_id, run_id)",
)
def score_trend(spark, folder):
    points = sc.score_trend(finding_points(spark, folder), view(spark, folder, "s_monthly_finding"), view(spark, folder, "f_table_snapshot"), confidence(spark, folder))
    return points.select("environment_id", "run_id", F.round("score_confidence", 6).alias("score_confidence"), "score")


LATEST = "(SELECT environment_id, arg_max(run_id, started_at) AS run_id FROM f_run WHERE status <> 'failed' GROUP BY 1)"


@REGISTRY.add("fnd19_kpis", derive.ctes("f_run", "s_database", "f_table_snapshot") + f" SELECT environment_id, l.run_id, CAST(coalesce((SELECT sum(size_bytes) FROM s_database d WHERE NOT is_template AND d.environment_id = l.environment_id AND d.run_id = l.run_id), 0) AS BIGINT) AS total_storage_bytes, (SELECT count(DISTINCT database_name) FROM s_database d WHERE NOT is_template AND d.environment_id = l.environment_id AND d.run_id = l.run_id) AS databases, (SELECT count(*) FROM f_table_snapshot t WHERE t.environment_id = l.environment_id AND t.run_id = l.run_id) AS tables FROM {LATEST} l")
def kpis(spark, folder):
    return sc.kpis(view(spark, folder, "f_run"), view(spark, folder, "s_database"), {"tables": view(spark, folder, "f_table_snapshot")})


@REGISTRY.add("fnd19_run_counts", derive.ctes("f_run") + " SELECT environment_id, count(*) FILTER (WHERE status IN ('success', 'partial_success')) AS successful, count(*) FILTER (WHERE status = 'failed') AS failed FROM (SELECT * FROM f_run QUALIFY row_number() OVER (PARTITION BY environment_id ORDER BY started_at DESC) <= 50) GROUP BY 1")
def run_counts(spark, folder):
    return sc.run_counts(view(spark, folder, "f_run"))


@REGISTRY.add("fnd20_top_tables", derive.ctes("f_run", "f_table_snapshot") + f" SELECT {TABLE_SQL}, total_size_bytes, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY total_size_bytes DESC, database_name, schema_name, table_name) AS rank FROM f_table_snapshot SEMI JOIN {LATEST} l USING (environment_id, run_id)) WHERE rank <= 15")
def top_tables(spark, folder):
    return sc.top_tables(view(spark, folder, "f_table_snapshot"), view(spark, folder, "f_run"))


@REGISTRY.add("fnd21_inventory", derive.ctes("s_table") + " SELECT database_name, schema_name, table_name, total_size_bytes FROM s_table WHERE environment_id = 'env1' AND schema_name = 'sales' AND table_name ILIKE '%tbl\\_1%' ESCAPE '\\' ORDER BY total_size_bytes DESC, database_name, schema_name, table_name LIMIT 50 OFFSET 100")
def inventory(spark, folder):
    page = sc.inventory(view(spark, folder, "s_table"), "table_name", "TBL_1", {"environment_id": "env1", "schema_name": "sales"}, "total_size_bytes", True, 50, 100)
    return page.select("database_name", "schema_name", "table_name", "total_size_bytes")


@REGISTRY.add("fnd21_inventory_functions", derive.ctes("s_function") + " SELECT run_id, database_name, schema_name, function_name, owner FROM s_function WHERE language = 'economy' AND function_name ILIKE '%fn\\_1%' ESCAPE '\\' ORDER BY database_name, schema_name, function_name LIMIT 80")
def functions(spark, folder):
    page = sc.inventory(view(spark, folder, "s_function"), "function_name", "fn_1", {"language": "economy"}, limit=80)
    return page.select("run_id", "database_name", "schema_name", "function_name", "owner")


@REGISTRY.add(
    "fnd22_search",
    derive.ctes("f_state", "f_run", "f_table_snapshot") + f""" SELECT * FROM (SELECT 'finding' AS hit, '' AS object_kind, environment_id, finding_id AS id, title, rule_id || ' · ' || object_key AS subtitle FROM f_state WHERE title ILIKE '%low%' OR rule_id ILIKE '%low%' OR object_key ILIKE '%low%'
 ORDER BY CASE status WHEN 'open' THEN 0 WHEN 'acknowledged' THEN 1 ELSE 2 END, CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 ELSE 4 END, finding_id LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'run', '', environment_id, run_id, 'Execução ' || substr(run_id, 1, 8), environment_id || ' · ' || profile || ' · ' || status FROM f_run WHERE profile ILIKE '%low%' OR status ILIKE '%low%' OR environment_id ILIKE '%low%' ORDER BY started_at DESC, run_id LIMIT 10)
 UNION ALL SELECT * FROM (SELECT 'inventory', 'tables', environment_id, 'tables:' || environment_id || ':' || database_name || '.' || schema_name || '.' || table_name, schema_name || '.' || table_name, database_name FROM f_table_snapshot SEMI JOIN {LATEST} l USING (environment_id, run_id) WHERE table_name ILIKE '%low%' ORDER BY lower(table_name) = 'low' DESC, length(table_name), table_name, environment_id, database_name, schema_name LIMIT 10)""",
)
def search(spark, folder):
    state = view(spark, folder, "f_state")
    parts = F.split("object_key", r"\.")
    findings = state.select("*", *[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(("database_name", "schema_name", "object_name"))])
    return sc.search("LOW", findings, view(spark, folder, "f_run"), {"tables": (view(spark, folder, "f_table_snapshot"), "table_name")})


@REGISTRY.add(
    "fnd23_table_assessment",
    derive.ctes("s_table", "s_column", "s_constraint", "s_index", "s_table_grant") + f""" SELECT {TABLE_SQL}, coalesce(c, 0) AS columns, coalesce(k, 0) AS constraints, coalesce(i, 0) AS indexes, coalesce(g, 0) AS grants FROM s_table
 LEFT JOIN (SELECT {TABLE_SQL}, count(*) AS c FROM s_column GROUP BY ALL) USING ({TABLE_SQL}) LEFT JOIN (SELECT {TABLE_SQL}, count(*) AS k FROM s_constraint GROUP BY ALL) USING ({TABLE_SQL}) LEFT JOIN (SELECT {TABLE_SQL}, count(*) AS i FROM s_index GROUP BY ALL) USING ({TABLE_SQL}) LEFT JOIN (SELECT {TABLE_SQL}, count(*) AS g FROM s_table_grant GROUP BY ALL) USING ({TABLE_SQL})""",
)
def assessment(spark, folder):
    related = {n: view(spark, folder, v) for n, v in {"columns": "s_column", "constraints": "s_constraint", "indexes": "s_index", "grants": "s_table_grant"}.items()}
    return sc.table_assessment(view(spark, folder, "s_table"), related)


@REGISTRY.add("fnd24_job_health", derive.ctes("s_job", "s_policy") + " SELECT environment_id, coalesce(j, 0) AS jobs_total, coalesce(s, 0) AS jobs_scheduled, coalesce(p, 0) AS policies_total FROM (SELECT environment_id, count(*) AS j, count(*) FILTER (WHERE scheduled) AS s FROM s_job GROUP BY 1) FULL JOIN (SELECT environment_id, count(*) AS p FROM s_policy GROUP BY 1) USING (environment_id)")
def job_health(spark, folder):
    return sc.job_health(view(spark, folder, "s_job"), view(spark, folder, "s_policy"))


@REGISTRY.add("fnd25_run_status", derive.ctes("f_coverage") + " SELECT environment_id, run_id, success, failed, skipped, CAST(0 AS BIGINT) AS cancelled, CASE WHEN failed = 0 AND success > 0 THEN 'success' WHEN failed > 0 AND success > 0 THEN 'partial_success' WHEN failed > 0 THEN 'failed' ELSE 'success' END AS run_status FROM (SELECT environment_id, run_id, count(*) FILTER (WHERE status = 'success') AS success, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'skipped') AS skipped FROM f_coverage GROUP BY ALL)")
def run_status(spark, folder):
    return sc.run_status(view(spark, folder, "f_coverage"))


@REGISTRY.add(
    "fnd26_table_score",
    derive.ctes("s_table", "s_index", "s_constraint") + f""" SELECT {TABLE_SQL}, coalesce(i, 0) AS invalid_indexes, coalesce(k, 0) AS unvalidated_constraints, CAST(greatest(0, 100 - CASE WHEN NOT is_partition AND relation_class <> 'foreign_table' AND NOT has_primary_key THEN 20 ELSE 0 END - 15 * least(2, coalesce(i, 0)) - 10 * least(2, coalesce(k, 0))
 - CASE WHEN n_live_tup + n_dead_tup < 1000 THEN 0 WHEN n_dead_tup / (n_live_tup + n_dead_tup) > 0.5 THEN 20 WHEN n_dead_tup / (n_live_tup + n_dead_tup) > 0.2 THEN 10 ELSE 0 END) AS BIGINT) AS score FROM s_table LEFT JOIN (SELECT {TABLE_SQL}, count(*) AS i FROM s_index WHERE NOT is_valid GROUP BY ALL) USING ({TABLE_SQL}) LEFT JOIN (SELECT {TABLE_SQL}, count(*) AS k FROM s_constraint WHERE NOT validated GROUP BY ALL) USING ({TABLE_SQL})""",
)
def table_score(spark, folder):
    return sc.table_score(view(spark, folder, "s_table"), view(spark, folder, "s_index"), view(spark, folder, "s_constraint"))


EDGE = "constraint_name, schema_name AS from_schema, table_name AS from_table, CASE WHEN referenced_schema = '' THEN schema_name ELSE referenced_schema END AS to_schema, referenced_table AS to_table"


@REGISTRY.add("fnd27_relationship_graph", derive.ctes("s_constraint") + f""" SELECT environment_id, run_id, database_name, 'out' AS direction, schema_name AS root_schema, table_name AS root_table, {EDGE} FROM s_constraint WHERE constraint_type = 'f' AND referenced_table <> ''
 UNION ALL SELECT environment_id, run_id, database_name, 'in', CASE WHEN referenced_schema = '' THEN schema_name ELSE referenced_schema END, referenced_table, {EDGE} FROM s_constraint WHERE constraint_type = 'f' AND referenced_table <> ''""")
def graph(spark, folder):
    return sc.relationship_graph(view(spark, folder, "s_constraint"))


@REGISTRY.add("fnd29_column_stats", derive.ctes("s_column") + " SELECT environment_id, database_name, schema_name, table_name, max(run_id) AS run_id, column_name, arg_max(average_width, run_id) AS average_width FROM s_column GROUP BY ALL")
def column_stats(spark, folder):
    columns = view(spark, folder, "s_column")
    runs = columns.select("environment_id", "run_id").distinct().withColumn("started_at", F.to_timestamp(F.substring("run_id", 4, 4), "yyyy"))
    return sc.latest_column_stats(columns, runs).select("environment_id", "database_name", "schema_name", "table_name", "run_id", "column_name", "average_width")


@REGISTRY.add("fnd29_table_workload", derive.ctes("s_query") + " SELECT environment_id, run_id, database_name, schema_name, table_name, fingerprint, calls, total_exec_ms, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY environment_id, run_id, database_name, schema_name, table_name ORDER BY total_exec_ms DESC, fingerprint) AS rank FROM (SELECT environment_id, run_id, database_name, 'public' AS schema_name, unnest(['a', 'b']) AS table_name, fingerprint, calls, total_exec_ms FROM s_query WHERE object_list LIKE '%,%')) WHERE rank <= 3")
def table_workload(spark, folder):
    queries = DerivedBundle(spark, folder)["queries"]
    tables = queries.select("environment_id", "run_id", "database_name").distinct().select(
        "*", F.lit("public").alias("schema_name"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("table_name")
    )
    return sc.table_workload(queries, tables, 3)


@REGISTRY.add("fnd30_recent_growth", derive.ctes("f_run", "f_table_snapshot") + " SELECT environment_id, run_id, started_at, CAST(place AS INTEGER) AS place, database_name, CAST(sum(total_size_bytes) AS BIGINT) AS bytes, count(*) AS tables FROM (SELECT environment_id, run_id, started_at, row_number() OVER (PARTITION BY environment_id ORDER BY started_at DESC) AS place FROM f_run WHERE status <> 'failed' QUALIFY place <= 6) JOIN (SELECT * EXCLUDE (started_at) FROM f_table_snapshot) USING (environment_id, run_id) GROUP BY ALL")
def growth(spark, folder):
    return sc.recent_growth(view(spark, folder, "f_table_snapshot").drop("started_at"), view(spark, folder, "f_run"))
