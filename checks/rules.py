"""One query per rule over the derived snapshot bundle."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry
from checks.bundle import NOW, DerivedBundle
from checks.facts import with_facts
from plumbline.operators import findings as fnd
from plumbline.operators.rules import indexes as index_rules, tables as table_rules
from plumbline.operators.rules.base import DEFAULTS, Settings
from plumbline.plans import analysis, derive

REGISTRY = Registry()
# Fixed values throughout: titles, severities, thresholds and evidence names of the findings, which feed their keys.
TABLE_KEY = "database_name || '.' || schema_name || '.' || table_name"
HYPERTABLE_KEY = "database_name || '.' || schema_name || '.' || hypertable_name"
JOIN_TABLE = "USING (environment_id, run_id, database_name, schema_name, table_name)"
JOIN_HYPER = "USING (environment_id, run_id, database_name, schema_name, hypertable_name)"
PREVIOUS_INDEX = """(SELECT i.*, p.idx_scan AS prev_scan, p.collected_at AS prev_at, sum(i.size_bytes) OVER (PARTITION BY i.environment_id, i.run_id, i.database_name, i.schema_name, i.table_name) AS total
 FROM f_index_snapshot i LEFT JOIN f_index_snapshot p ON p.environment_id = i.environment_id AND p.index_name = i.index_name AND p.schema_name = i.schema_name AND p.database_name = i.database_name AND year(p.collected_at) = year(i.collected_at) - 1)"""
UNCHANGED = "NOT is_unique AND NOT is_primary AND idx_scan = prev_scan AND NOT coalesce(stats_reset > prev_at, false)"
ONE_OBJECT = """(SELECT *, split_part(object_list, '.', 1) AS schema_name, split_part(object_list, '.', 2) AS table_name FROM s_query
 WHERE evidence_quality = 'object_reference' AND object_list NOT LIKE '%,%' AND object_list LIKE '%.%')"""
REVIEW = f"""(SELECT i.*, c.environment_id, c.status, c.due_at, d.decision, d.revoke_due_at, 'run1' AS run_id,
 CASE WHEN column_name <> '' THEN object_name || '.' || column_name ELSE object_name END AS shown, string_split(highlight_list, ',') AS hl
 FROM s_campaign_item i JOIN s_campaign c USING (campaign_id)
 LEFT JOIN (SELECT item_id, decision, revoke_due_at FROM s_decision x WHERE NOT EXISTS (SELECT 1 FROM s_decision y WHERE y.supersedes_id = x.decision_id)
            QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY decided_at DESC, decision_id DESC) = 1) d USING (item_id))"""
REVIEW_KEY = "account_name || '|' || shown || '|' || privilege || '|' || item_id"
PAIRS = """(SELECT a.environment_id, a.run_id, b.environment_id AS peer, b.run_id AS peer_run, b.name AS peer_name, {cols}
 FROM s_server a JOIN s_server b ON a.fleet = b.fleet AND a.environment_id <> b.environment_id {more})"""
INTERVAL = "(CASE WHEN {c} LIKE '%min' THEN CAST(split_part({c}, ' ', 1) AS DOUBLE) * 60 WHEN {c} LIKE '%hour%' THEN CAST(split_part({c}, ' ', 1) AS DOUBLE) * 3600 WHEN {c} LIKE '%day%' THEN CAST(split_part({c}, ' ', 1) AS DOUBLE) * 86400 WHEN {c} LIKE '%second%' THEN CAST(split_part({c}, ' ', 1) AS DOUBLE) WHEN {c} = '1h30m' THEN 5400 ELSE 0 END)"


def seconds(column: str) -> str:
    return INTERVAL.replace("{c}", column)


def finding_sql(
    rule_id, frm, when="true", severity="low", kind="table", key=TABLE_KEY, title=None, evidence=None, database="database_name",
    schema="schema_name", name="table_name", confidence="NULL", dedup=None, dedup_key=None, rule_sql=None,
):
    rule = rule_sql or f"'{rule_id}'"
    title = title or f"'{rule_id}: ' || {key}"
    shown = "'{}'"
    if isinstance(evidence, str):
        shown = evidence
    elif evidence:
        shown = "CAST(json_object(" + ", ".join(f"'{k}', {v}" for k, v in evidence.items()) + ") AS VARCHAR)"
    severity = severity if severity.startswith("CASE") else f"'{severity}'"
    kind = kind if " " in kind or kind.endswith("_type") else f"'{kind}'"
    return f"""SELECT environment_id, run_id, {rule} AS rule_id, {severity} AS severity, {kind} AS object_type, {key} AS object_key, {database} AS database_name,
{schema} AS schema_name, {name} AS object_name, {title} AS title, {shown} AS evidence, CAST({confidence} AS DOUBLE) AS confidence,
substr(sha256({rule} || '|' || ({dedup_key or key}) || '|' || ({dedup or title})), 1, 32) AS dedup_key FROM {frm} WHERE {when}"""


def rule(rule_id, views, frm, when="true", severity="low", **options):
    sql = f"{with_facts(views)} " + finding_sql(rule_id, frm, when, severity, **options)
    add(rule_id, sql)


def add(rule_id, sql):
    name = "rule_" + rule_id.replace(".", "_")

    @REGISTRY.add(name, sql)
    def run(spark, folder, rule_id=rule_id):
        return analysis.run_rule(DerivedBundle(spark, folder), rule_id)


# --- tables, columns and constraints ---------------------------------------------------------
rule("storage.large_table", "s_table", "s_table", "total_size_bytes >= 1073741824", title=f"'Large table: ' || {TABLE_KEY}",
     evidence={"size_bytes": "total_size_bytes", "threshold": "1073741824"})
rule("storage.top_consumer", "s_table",
     "(SELECT *, row_number() OVER (PARTITION BY environment_id, run_id ORDER BY total_size_bytes DESC, database_name, schema_name, table_name) AS rn FROM s_table)",
     "rn <= 5 AND total_size_bytes > 0", "info", title=f"'Top storage consumer: ' || {TABLE_KEY}", evidence={"size_bytes": "total_size_bytes", "rank": "rn"})
rule("integrity.missing_primary_key", "s_table", "s_table", "NOT has_primary_key AND NOT is_partition AND relation_class <> 'foreign_table'", "medium",
     evidence={"row_estimate": "row_estimate", "relation_class": "relation_class"})
rule("model.wide_table", "s_table", "s_table", "column_count >= 50", evidence={"column_count": "column_count", "threshold": "50"})
rule("model.undocumented_critical", "s_table", "s_table", "comment = '' AND (total_size_bytes >= 1073741824 OR row_estimate >= 1000000)",
     evidence={"size_bytes": "total_size_bytes", "row_estimate": "row_estimate"})
rule("maintenance.stale_analyze", "s_table", "s_table", "collected_at - last_analyze > INTERVAL 30 DAY AND row_estimate >= 10000",
     evidence={"row_estimate": "row_estimate", "threshold_days": "30"})
VACUUM = "(SELECT *, row_number() OVER (PARTITION BY environment_id, run_id ORDER BY n_dead_tup DESC, database_name, schema_name, table_name) AS rn FROM s_table WHERE schema_name <> '_timescaledb_internal')"
rule("maintenance.dead_tuple_pressure", "s_table", VACUUM, "n_dead_tup >= 10000 AND n_live_tup > 0 AND n_dead_tup / n_live_tup >= 0.2",
     evidence={"n_dead_tup": "n_dead_tup", "n_live_tup": "n_live_tup", "estimate_only": "true"})
rule("vacuum.high_dead_tuples", "s_table", VACUUM, "n_live_tup + n_dead_tup >= 1000 AND n_live_tup > 0 AND n_dead_tup / (n_live_tup + n_dead_tup) >= 0.2",
     "CASE WHEN n_dead_tup / (n_live_tup + n_dead_tup) >= 0.4 THEN 'medium' ELSE 'low' END", title=f"'High dead-tuple ratio: ' || {TABLE_KEY}",
     evidence={"n_live_tup": "n_live_tup", "n_dead_tup": "n_dead_tup", "dead_ratio": "round(n_dead_tup / (n_live_tup + n_dead_tup), 4)", "threshold": "CAST(0.2 AS DOUBLE)"})
rule("inactivity.possibly_inactive", "x_table", "x_table", "days_since_dml >= 90", title=f"'Possibly inactive table: ' || {TABLE_KEY}",
     evidence={"days_since_dml": "days_since_dml", "threshold_days": "90", "n_live_tup": "n_live_tup", "n_tup_ins": "n_tup_ins", "n_tup_upd": "n_tup_upd", "n_tup_del": "n_tup_del", "classification": "'POSSIBLY_INACTIVE'"})
rule("security.rls_disabled_hypothesis", "s_table", "s_table", "NOT rls_enabled AND NOT is_partition AND schema_name NOT LIKE 'pg\\_%' ESCAPE '\\'",
     title=f"'RLS disabled hypothesis: ' || {TABLE_KEY}", confidence="0.4")
COLUMN_KEY = f"{TABLE_KEY} || '.' || column_name"
COLUMN = dict(kind="column", key=COLUMN_KEY, name="table_name || '.' || column_name")
add("model.naming_inconsistent", derive.ctes("s_table", "s_column") + " " + finding_sql(
    "model.naming_inconsistent", "s_table", "NOT regexp_matches(table_name, '^[a-z][a-z0-9_]*$')", "info", evidence={"convention": "'snake_case'"}) + " UNION ALL " + finding_sql(
    "model.naming_inconsistent", "s_column", "NOT regexp_matches(column_name, '^[a-z][a-z0-9_]*$')", "info", evidence={"convention": "'snake_case'"}, **COLUMN))
rule("model.type_review", "s_column", "s_column", "data_type IN ('money', 'timestamp') OR (column_name LIKE '%\\_status' ESCAPE '\\' AND data_type LIKE '%character%')",
     evidence={"data_type": "data_type", "column": "column_name"}, **COLUMN)
rule("model.jsonb_critical", "s_table s_column", f"(SELECT c.*, t.row_estimate FROM s_column c JOIN s_table t {JOIN_TABLE})", "data_type = 'jsonb' AND row_estimate >= 100000",
     evidence={"row_estimate": "row_estimate", "column": "column_name"}, **COLUMN)
rule("model.repeated_columns", "s_column", f"(SELECT environment_id, run_id, database_name, schema_name, table_name, 'phone' AS prefix, count(*) AS n FROM s_column WHERE column_name IN ('phone_1', 'phone_2') AND nullable GROUP BY ALL)",
     "n >= 2", "info", key=f"{TABLE_KEY} || '.' || prefix", name="table_name || '.' || prefix", evidence={"prefix": "prefix", "count": "n"})
rule("model.implicit_relationship", "s_table s_column s_constraint",
     """(SELECT c.* FROM s_column c WHERE column_name LIKE '%\\_id' ESCAPE '\\'
 AND NOT EXISTS (SELECT 1 FROM s_constraint k WHERE k.constraint_type = 'f' AND k.environment_id = c.environment_id AND k.run_id = c.run_id AND k.database_name = c.database_name AND k.schema_name = c.schema_name AND k.table_name = c.table_name AND list_contains(string_split(k.column_list, ','), c.column_name))
 AND EXISTS (SELECT 1 FROM s_table t WHERE t.environment_id = c.environment_id AND t.run_id = c.run_id AND t.database_name = c.database_name AND t.schema_name = c.schema_name AND t.table_name IN (left(c.column_name, -3), left(c.column_name, -3) || 's')))""".replace("AND NOT EXISTS (SELECT 1 FROM s_constraint k WHERE k.constraint_type = 'f'", "AND NOT EXISTS (SELECT 1 FROM s_constraint k WHERE k.constraint_type = 'f'"),
     "true", "info", evidence={"column": "column_name", "confidence_note": "'naming-only hypothesis'"}, **COLUMN)
rule("integrity.constraint_unvalidated", "s_constraint", "s_constraint", "NOT validated AND constraint_type IN ('f', 'c')", "medium", kind="constraint",
     key=f"{TABLE_KEY} || '.' || constraint_name", name="table_name || '.' || constraint_name",
     evidence={"table": "table_name", "constraint_type": "constraint_type", "validated": "false"})
rule("integrity.fk_without_index", "s_constraint s_index",
     """(SELECT k.* FROM s_constraint k WHERE constraint_type = 'f' AND NOT EXISTS (SELECT 1 FROM s_index i WHERE i.environment_id = k.environment_id AND i.run_id = k.run_id AND i.database_name = k.database_name AND i.schema_name = k.schema_name AND i.table_name = k.table_name
 AND is_valid AND is_ready AND predicate = '' AND key_list <> 'payload' AND (i.key_list || ',') LIKE (k.column_list || ',%')))""",
     "true", "medium", kind="constraint", key=f"{TABLE_KEY} || '.' || constraint_name", name="table_name || '.' || constraint_name",
     evidence={"table": "table_name", "columns": "string_split(column_list, ',')", "referenced_schema": "referenced_schema", "referenced_table": "referenced_table"})
FAMILY_SQL = "CASE WHEN {c} = 'bigint' THEN 'number' WHEN {c} LIKE '%char%' THEN 'text' WHEN {c} LIKE '%time%' THEN 'time' ELSE {c} END"
rule("integrity.fk_type_mismatch", "s_constraint s_column",
     f"""(SELECT k.*, l.column_name, l.data_type, r.column_name AS r_column, r.data_type AS r_type
 FROM (SELECT *, unnest(string_split(column_list, ',')) AS cn, unnest(string_split(referenced_list, ',')) AS rn FROM s_constraint WHERE constraint_type = 'f') k
 JOIN s_column l ON l.environment_id = k.environment_id AND l.run_id = k.run_id AND l.database_name = k.database_name AND l.schema_name = k.schema_name AND l.table_name = k.table_name AND l.column_name = k.cn
 JOIN s_column r ON r.environment_id = k.environment_id AND r.run_id = k.run_id AND r.database_name = k.database_name AND r.schema_name = CASE WHEN k.referenced_schema = '' THEN k.schema_name ELSE k.referenced_schema END AND r.table_name = k.referenced_table AND r.column_name = k.rn)""",
     f"{FAMILY_SQL.replace('{c}', 'data_type')} <> {FAMILY_SQL.replace('{c}', 'r_type')}", kind="constraint", key=f"{TABLE_KEY} || '.' || constraint_name || '.' || column_name",
     name="table_name || '.' || constraint_name || '.' || column_name", evidence={"column": "column_name", "column_type": "data_type", "referenced_column": "r_column", "referenced_type": "r_type"})
rule("integrity.sequence_default_mismatch", "s_sequence s_column",
     """(SELECT c.*, q.schema_name || '.' || q.sequence_name AS sequence, q.owned_by_table, q.owned_by_column FROM s_column c JOIN s_sequence q ON q.environment_id = c.environment_id AND q.run_id = c.run_id AND q.database_name = c.database_name
 AND c.default_expr IN ('nextval(''' || q.sequence_name || '''::regclass)', 'nextval(''' || q.schema_name || '.' || q.sequence_name || '''::regclass)') WHERE q.owned_by_table <> '')""",
     "owned_by_table <> schema_name || '.' || table_name OR owned_by_column <> column_name", evidence={"sequence": "sequence", "owned_by_table": "owned_by_table", "owned_by_column": "owned_by_column"}, **COLUMN)
SEQUENCE = dict(kind="sequence", key="database_name || '.' || schema_name || '.' || sequence_name", name="sequence_name")
rule("integrity.orphan_sequence", "s_sequence s_column",
     "(SELECT q.* FROM s_sequence q WHERE owned_by_table = '' AND NOT EXISTS (SELECT 1 FROM s_column c WHERE c.environment_id = q.environment_id AND c.run_id = q.run_id AND c.database_name = q.database_name AND contains(c.default_expr, q.sequence_name) AND contains(c.default_expr, 'nextval(')))",
     evidence={"owned_by_table": "owned_by_table"}, **SEQUENCE)
rule("sequence.near_limit", "s_sequence", "s_sequence", "last_value IS NOT NULL AND max_value > 1000 AND last_value / max_value >= 0.7",
     "CASE WHEN last_value / max_value >= 0.8 AND data_type = 'integer' THEN 'high' ELSE 'medium' END", title="'Sequence near limit: ' || database_name || '.' || schema_name || '.' || sequence_name",
     evidence={"last_value": "last_value", "max_value": "max_value", "ratio": "round(last_value / max_value, 6)", "owned_by_table": "owned_by_table", "owned_by_column": "owned_by_column", "data_type": "data_type"}, **SEQUENCE)
rule("maintenance.growth_trend", "f_table_daily f_daily_run",
     """(SELECT t.*, p.total_size_bytes AS before, CASE WHEN p.total_size_bytes IS NULL THEN 'incomplete' WHEN p.stats_reset <> t.stats_reset THEN 'stats_reset'
 WHEN EXISTS (SELECT 1 FROM f_daily_run g WHERE g.environment_id = t.environment_id AND g.status <> 'success' AND g.started_at > r.prev_at AND g.started_at < t.started_at) OR t.collected_at - p.collected_at > INTERVAL 14 DAY THEN 'gap' ELSE 'complete' END AS coverage,
 epoch(t.collected_at - p.collected_at) / 86400.0 AS days
 FROM f_table_daily t JOIN (SELECT *, lag(run_id) OVER (PARTITION BY environment_id ORDER BY started_at) AS prev, lag(started_at) OVER (PARTITION BY environment_id ORDER BY started_at) AS prev_at FROM f_daily_run WHERE status = 'success') r
 ON r.environment_id = t.environment_id AND r.run_id = t.run_id AND r.prev IS NOT NULL
 LEFT JOIN f_table_daily p ON p.environment_id = t.environment_id AND p.run_id = r.prev AND p.database_name = t.database_name AND p.schema_name = t.schema_name AND p.table_name = t.table_name)""",
     "before IS NULL OR total_size_bytes - before >= total_size_bytes * 0.05", "CASE WHEN coverage = 'complete' THEN 'medium' ELSE 'info' END", title=f"'Tendência de manutenção: ' || {TABLE_KEY}",
     evidence="""CASE WHEN coverage = 'complete' THEN CAST(json_object('coverage', coverage, 'delta_bytes', total_size_bytes - before, 'bytes_per_day', CAST(round((total_size_bytes - before) / days) AS BIGINT)) AS VARCHAR) ELSE CAST(json_object('coverage', coverage) AS VARCHAR) END""",
     confidence="CASE WHEN coverage <> 'complete' THEN 0.2 WHEN days < 1 THEN 0.35 ELSE 0.55 END", dedup="'tendência'")


@REGISTRY.add("rule_model_duplicate_entity", derive.ctes("s_twin_column") + " " + finding_sql(
    "model.duplicate_entity",
    """(SELECT a.* FROM (SELECT *, lag(schema_name) OVER (PARTITION BY environment_id, run_id, database_name, table_name, s ORDER BY schema_name) AS other FROM sig) a WHERE other IS NOT NULL)""",
    "n >= 3", "info", evidence={"other_schema": "other", "column_count": "n"}).replace("FROM (SELECT a.*", """FROM (WITH sig AS (SELECT environment_id, run_id, database_name, schema_name, table_name, count(*) AS n,
 list_sort(list(column_name || ':' || CASE WHEN data_type IN ('integer', 'numeric(10,2)') THEN 'number' ELSE data_type END)) AS s FROM s_twin_column GROUP BY ALL) SELECT a.*"""))
def duplicate_entity(spark, folder):
    columns = derive.view(spark, folder, "s_twin_column")
    tables = columns.select("environment_id", "run_id", "database_name", "schema_name", "table_name").distinct()
    return table_rules.duplicate_entity({"columns": columns, "tables": tables}, DEFAULTS)


@REGISTRY.add("rule_index_write_burden", derive.ctes("s_table", "s_index", "s_policy_override") + " " + finding_sql(
    "index.write_burden",
    f"""(SELECT t.*, n, coalesce(s.min_indexes, e.min_indexes, 8) AS mi, coalesce(s.min_writes, e.min_writes, 100000) AS mw FROM s_table t JOIN (SELECT environment_id, run_id, database_name, schema_name, table_name, count(*) AS n FROM s_index GROUP BY ALL) i {JOIN_TABLE}
 LEFT JOIN s_policy_override e ON e.environment_id = t.environment_id AND e.schema_name = '' AND e.rule_id = 'index.write_burden' LEFT JOIN s_policy_override s ON s.environment_id = t.environment_id AND s.schema_name = t.schema_name AND s.rule_id = 'index.write_burden')""",
    "n >= mi AND n_tup_ins + n_tup_upd + n_tup_del >= mw AND collected_at - stats_reset >= INTERVAL 30 DAY", evidence={"index_count": "n", "writes_since_reset": "n_tup_ins + n_tup_upd + n_tup_del"}))
def write_burden(spark, folder):
    bundle = DerivedBundle(spark, folder)
    tables = fnd.with_parameters(bundle["tables"], policies(spark, folder))
    return table_rules.write_burden({"tables": tables, "indexes": bundle["indexes"]}, Settings(from_policies=True))


def policies(spark, folder):
    parameters = F.create_map(
        F.lit("min_indexes"), F.col("min_indexes").cast("string"), F.lit("min_writes"), F.col("min_writes").cast("string")
    )
    own = F.when(F.col("rule_id") == "index.write_burden", parameters).otherwise(F.create_map().cast("map<string,string>"))
    return derive.view(spark, folder, "s_policy_override").withColumn("parameters", own)


# --- indexes and workload ------------------------------------------------------------------------
INDEX = dict(kind="index", key="database_name || '.' || schema_name || '.' || index_name", name="index_name")
rule("index.invalid", "s_index", "s_index", "NOT is_valid OR NOT is_ready", "medium", evidence={"is_valid": "is_valid", "is_ready": "is_ready", "table": "table_name"}, **INDEX)
rule("index.overlap", "s_index", "(SELECT environment_id, run_id, database_name, schema_name, table_name, list_sort(list(index_name)) AS names FROM s_index WHERE is_valid AND is_ready GROUP BY environment_id, run_id, database_name, schema_name, table_name, is_unique, is_primary, key_list HAVING count(*) > 1)",
     kind="index", key="database_name || '.' || schema_name || '.dup:' || names[1]", title="'Possibly overlapping indexes on ' || schema_name || '.' || table_name", evidence={"index_names": "names"})
rule("index.prefix_overlap", "s_index", f"(SELECT a.*, b.index_name AS long_index FROM ok a JOIN ok b {JOIN_TABLE} WHERE b.key_list LIKE a.key_list || ',%')".replace("(SELECT a.*", "(WITH ok AS (SELECT * FROM s_index WHERE NOT is_unique AND NOT is_primary AND predicate = '' AND is_valid) SELECT a.*"),
     evidence={"table": "table_name", "short_index": "index_name", "long_index": "long_index", "prefix_columns": "string_split(key_list, ',')"}, **INDEX)
rule("index.unused", "f_index_snapshot", PREVIOUS_INDEX, UNCHANGED, "medium", title="'Possibly unused index: ' || database_name || '.' || schema_name || '.' || index_name",
     evidence={"table_name": "table_name", "current_idx_scan": "idx_scan", "previous_idx_scan": "prev_scan", "size_bytes": "size_bytes", "table_index_bytes": "CAST(total AS BIGINT)"}, **INDEX)
rule("cost.unused_index_waste", "f_index_snapshot", PREVIOUS_INDEX, f"{UNCHANGED} AND size_bytes >= 104857600", "CASE WHEN size_bytes >= 5368709120 THEN 'high' ELSE 'medium' END",
     title="'Desperdício de índice sem uso: ' || database_name || '.' || schema_name || '.' || index_name", evidence={"size_bytes": "size_bytes", "window_days": "date_diff('day', prev_at, collected_at)"}, **INDEX)


@REGISTRY.add("rule_index_investigate_missing", derive.ctes("s_query", "s_table", "s_index") + " " + finding_sql(
    "index.investigate_missing",
    f"""(SELECT t.environment_id, t.run_id, t.database_name, t.schema_name, t.table_name, min(fingerprint) AS fp, arg_min(calls, fingerprint) AS c, arg_min(shared_blocks_read, fingerprint) AS b
 FROM s_query q JOIN s_table t ON t.table_name = 'tbl_' || CAST(q.rows_total * 7 + 1 AS VARCHAR) ANTI JOIN (SELECT * FROM s_index WHERE is_primary) i
 ON i.environment_id = t.environment_id AND i.run_id = t.run_id AND i.database_name = t.database_name AND i.schema_name = t.schema_name AND i.table_name = t.table_name
 WHERE query_kind = 'select' AND calls >= 100 AND shared_blocks_read >= 1000 AND evidence_quality = 'object_reference' GROUP BY ALL)""",
    evidence={"query_fingerprint": "fp", "calls": "c", "shared_blocks_read": "b", "evidence_quality": "'object_reference'"}))
def investigate_missing(spark, folder):
    bundle = DerivedBundle(spark, folder)
    tables = bundle["tables"]
    named = derive.view(spark, folder, "s_query").withColumn(
        "table_name", F.concat(F.lit("tbl_"), (F.col("rows_total") * 7 + 1).cast("string"))
    )
    placed = named.drop("environment_id", "run_id", "database_name").join(
        tables.select("environment_id", "run_id", "database_name", "schema_name", "table_name"), "table_name"
    )
    queries = placed.withColumn("referenced_objects", F.array(F.concat_ws(".", "schema_name", "table_name"))).drop(
        "schema_name", "table_name"
    )
    parts = {"queries": queries, "tables": tables, "indexes": bundle["indexes"].where("is_primary")}
    return index_rules.investigate_missing(parts, DEFAULTS)


rule("index.candidate", "s_query s_index",
     """(SELECT environment_id, run_id, fingerprint, [w for w in words if NOT list_contains(['select', 'from', 'where', 'and'], w) AND NOT list_contains(coalesce(leads, []), w)] AS cols
 FROM (SELECT *, regexp_extract_all(fingerprint_text, '[a-z_][a-z0-9_]*') AS words FROM s_query) LEFT JOIN (SELECT environment_id, run_id, list(DISTINCT string_split(key_list, ',')[1]) AS leads FROM s_index GROUP BY ALL) USING (environment_id, run_id))""",
     "len(cols) > 0", kind="index", key="fingerprint", title="'Index candidate hypothesis ' || fingerprint", evidence={"fingerprint": "fingerprint", "columns": "cols"}, database="''", schema="''", name="''", confidence="0.4")
add("performance.workload", derive.ctes("s_query") + " " + " UNION ALL ".join(
    finding_sql(f"performance.workload_{k}", ONE_OBJECT, f"calls >= 10 AND {w}", key=f"{TABLE_KEY} || ':{k}:' || fingerprint", title=f"'Workload {k} pattern on ' || schema_name || '.' || table_name", dedup="''",
                evidence={"query_fingerprint": "fingerprint", "query_kind": "query_kind", "calls": "calls", "shared_blocks_read": "shared_blocks_read", "shared_blocks_hit": "shared_blocks_hit", "total_exec_ms": "total_exec_ms"})
    for k, w in {"scan": "query_kind = 'select' AND calls >= 100 AND shared_blocks_read >= 1000 AND shared_blocks_read > shared_blocks_hit", "write": "query_kind IN ('insert', 'update', 'delete') AND calls >= 1000", "cost": "total_exec_ms >= 60000"}.items()))
QUALIFIED = "(evidence_quality = 'object_reference' AND object_list NOT LIKE '%,%' AND object_list LIKE '%.%')"
rule("performance.slow_query", "s_query", "s_query", "mean_exec_ms >= 500 AND calls >= 10", kind=f"CASE WHEN {QUALIFIED} THEN 'table' ELSE 'query' END",
     key=f"CASE WHEN {QUALIFIED} THEN database_name || '.table:' || object_list || '.query:' || fingerprint ELSE database_name || '.query:' || fingerprint END",
     title=f"CASE WHEN {QUALIFIED} THEN 'Slow workload pattern on ' || object_list ELSE 'Slow query fingerprint on ' || database_name END",
     schema=f"CASE WHEN {QUALIFIED} THEN split_part(object_list, '.', 1) ELSE '' END", name=f"CASE WHEN {QUALIFIED} THEN split_part(object_list, '.', 2) ELSE fingerprint END",
     evidence={"query_fingerprint": "fingerprint", "calls": "calls", "mean_exec_ms": "mean_exec_ms", "total_exec_ms": "total_exec_ms", "rows": "rows_total"})
rule("performance.lock_wait", "s_lock", "s_lock", "NOT granted AND wait_seconds >= 30", "medium", kind="lock", key="database_name || '.lock:' || mode || ':' || pid", title="'Long lock wait on ' || database_name || ' (' || mode || ')'",
     schema="''", name="relation", evidence={"mode": "mode", "wait_age_seconds": "wait_seconds", "relation": "relation", "pid": "pid"})
rule("performance.high_connections", "s_connection", "s_connection", "max_connections > 0 AND connections > 0 AND connections / max_connections >= 0.8", "CASE WHEN connections / max_connections >= 0.95 THEN 'high' ELSE 'medium' END",
     kind="database", key="database_name || '.connections' || CASE WHEN role_name <> '' THEN ':' || role_name ELSE '' END", title="'High connection usage on ' || database_name", schema="''", name="role_name",
     evidence={"count": "connections", "max_connections": "max_connections", "usage_ratio": "round(connections / max_connections, 4)", "role_name": "role_name", "state": "state"})

# --- time-partitioned storage -------------------------------------------------------------------
HYPER = dict(kind="hypertable", key=HYPERTABLE_KEY, name="hypertable_name")


def no_policy(*kinds: str) -> str:
    names = ", ".join(f"'{k}'" for k in kinds)
    return f"(SELECT h.* FROM s_hypertable h ANTI JOIN (SELECT * FROM s_policy WHERE policy_type IN ({names})) p {JOIN_HYPER})"


rule("chunk.high_count", "s_hypertable", "s_hypertable", "num_chunks >= 500", "medium", title=f"'High chunk count: ' || {HYPERTABLE_KEY}", evidence={"num_chunks": "num_chunks", "threshold": "500", "size_bytes": "total_size_bytes"}, **HYPER)
rule("chunk.size_skew", "f_chunk", "(SELECT environment_id, run_id, database_name, schema_name, hypertable_name, count(*) AS n, max(total_size_bytes) AS mx, sum(total_size_bytes) / count(*) AS mean FROM f_chunk GROUP BY ALL)", "n >= 3 AND mx / mean >= 5",
     title=f"'Abnormal chunk size distribution: ' || {HYPERTABLE_KEY}", evidence={"chunk_count": "n", "max_bytes": "mx", "mean_bytes": "CAST(round(mean) AS BIGINT)", "ratio": "CAST(round(mx / mean, 1) AS DOUBLE)"}, **HYPER)
rule("chunk.inventory_truncated", "x_server", "x_server", "chunks_truncated", "medium", kind="environment", key="environment_id", title="'Chunk inventory truncated'", database="''", schema="''", name="''")
CAGG = dict(kind="continuous_aggregate", key="database_name || '.' || schema_name || '.' || view_name", name="view_name")
rule("cagg.missing_refresh_policy", "s_cagg", "s_cagg", "NOT has_refresh_policy", "high", title=f"'CAGG without refresh policy: ' || {CAGG['key']}", evidence={"materialization": "materialization_schema || '.' || materialization_hypertable", "materialized_only": "materialized_only"}, **CAGG)
rule("cagg.materialization_lag", "s_cagg", "s_cagg", f"has_refresh_policy AND {seconds('lag')} > 3600", "high", title=f"'CAGG materialization lag: ' || {CAGG['key']}", evidence={"lag": "lag"}, **CAGG)
rule("cagg.realtime_hypothesis", "s_cagg", "s_cagg", "NOT materialized_only", title=f"'CAGG real-time aggregation enabled: ' || {CAGG['key']}", evidence={"realtime": "true", "confidence": "'low'"}, **CAGG)
rule("cagg.overlap", "s_cagg", "(SELECT environment_id, run_id, view_definition, m[1].d AS database_name, m[1].s AS schema_name, m[1].v AS view_name, [x.s || '.' || x.v for x in m] AS names FROM (SELECT environment_id, run_id, view_definition, list_sort(list({'d': database_name, 's': schema_name, 'v': view_name})) AS m FROM s_cagg GROUP BY ALL HAVING count(*) > 1))",
     kind="continuous_aggregate", key="database_name || '.overlap:' || view_name", title="'Potentially overlapping CAGGs in ' || database_name", name="view_name", evidence={"views": "names", "definition": "view_definition"})
START, END = seconds("(config->>'start_offset')"), seconds("(config->>'end_offset')")
rule("cagg.refresh_window_exceeded", "s_policy", "s_policy", f"policy_type = 'refresh' AND {START} - {END} > {seconds('schedule_interval')}", "medium", kind="continuous_aggregate", key=HYPERTABLE_KEY, name="hypertable_name",
     title=f"'CAGG refresh window exceeds the job schedule: ' || {HYPERTABLE_KEY}", evidence={"window_seconds": f"CAST({START} - {END} AS BIGINT)", "schedule": "schedule_interval"})
rule("policy.job_failed", "s_policy", "s_policy", "last_run_status = 'Failed'", "high", kind="policy", key="database_name || '.policy.' || job_id", name="hypertable_name", title="'Policy job failing: ' || database_name || ' #' || job_id || ' (' || policy_type || ')'",
     evidence={"job_id": "job_id", "policy_type": "policy_type", "last_run_status": "last_run_status", "schedule_interval": "schedule_interval", "proc_name": "proc_name"})
JOB = dict(kind="job", key="database_name || '.job.' || job_id", schema="''", name="proc_name")
rule("job.unhealthy", "s_job", "s_job", "lower(trim(last_run_status)) IN ('error', 'crash') OR total_failures >= 3", "medium", title="'Background job unhealthy: ' || database_name || ' #' || job_id",
     evidence={"job_id": "job_id", "application": "application", "last_run_status": "last_run_status", "total_failures": "total_failures", "scheduled": "scheduled"}, **JOB)
rule("job.slo_exceeded", "s_job", "s_job", f"{seconds('schedule_interval')} > 0 AND {seconds('last_run_duration')} > {seconds('schedule_interval')}", "high", title="'Job slower than its schedule: ' || database_name || ' #' || job_id",
     evidence={"job_id": "job_id", "proc": "proc_name", "last_run_status": "last_run_status", "duration": "last_run_duration", "schedule_interval": "schedule_interval", "total_failures": "total_failures"}, **JOB)
rule("job.workers_saturated", "s_job", "(SELECT environment_id, run_id, count(*) FILTER (WHERE scheduled) AS n, max(max_background_workers) AS w FROM s_job GROUP BY ALL)", "w > 0 AND n > w", "high", kind="environment", key="environment_id",
     title="'Timescale background workers are saturated'", database="''", schema="''", name="''", evidence={"scheduled_jobs": "n", "max_background_workers": "w"})
rule("policy.missing_retention", "s_hypertable s_policy", no_policy("retention"), "total_size_bytes > 0", "medium", title=f"'Hypertable without retention policy: ' || {HYPERTABLE_KEY}", evidence={"size_bytes": "total_size_bytes", "num_chunks": "num_chunks"}, **HYPER)
rule("policy.missing_compression", "s_hypertable s_policy", no_policy("compression", "columnstore"), "total_size_bytes > 1073741824", title=f"'Large hypertable without compression policy: ' || {HYPERTABLE_KEY}", evidence={"size_bytes": "total_size_bytes"}, **HYPER)
RET_KEEP, RET_CHUNK = seconds("(config->>'drop_after')"), seconds("chunk_interval")
rule("policy.retention_chunk_mismatch", "s_hypertable s_policy", f"(SELECT p.*, h.chunk_interval FROM s_policy p JOIN s_hypertable h {JOIN_HYPER} WHERE policy_type = 'retention')", f"{RET_KEEP} < {RET_CHUNK} OR {RET_KEEP} % {RET_CHUNK} <> 0", "high",
     title=f"CASE WHEN {RET_KEEP} < {RET_CHUNK} THEN 'Retention does not cover a closed chunk: ' ELSE 'Retention drops later than the chunk boundary: ' END || {HYPERTABLE_KEY}", evidence={"retention": "config->>'drop_after'", "chunk_interval": "chunk_interval"}, **HYPER)
rule("policy.reorder_hypothesis", "x_hypertable s_policy", no_policy("reorder").replace("s_hypertable", "x_hypertable"), "reads_outside_time", title=f"'Reorder policy hypothesis: ' || {HYPERTABLE_KEY}", **HYPER)
rule("policy.compression_not_applied", "x_hypertable s_policy", f"(SELECT h.*, policy_type FROM x_hypertable h JOIN (SELECT * FROM s_policy WHERE policy_type = 'compression') p {JOIN_HYPER})", "uncompressed_closed_chunks >= 1", "medium",
     title=f"'Compression policy is not compressing closed chunks: ' || {HYPERTABLE_KEY}", evidence={"uncompressed_closed_chunks": "uncompressed_closed_chunks", "policy_type": "policy_type", "size_bytes": "total_size_bytes"}, **HYPER)
rule("policy.compression_ratio", "x_policy", "x_policy", "policy_type = 'compression' AND compression_ratio > 0 AND compression_ratio < 1.2", title=f"'Poor compression ratio: ' || {HYPERTABLE_KEY}", evidence={"ratio": "round(compression_ratio, 4)", "before_after": "true", "policy_type": "policy_type"}, **HYPER)
rule("policy.compression_settings", "s_policy", "s_policy", "policy_type = 'compression' AND config NOT LIKE '%segmentby%'", title=f"'Compression segmentby/orderby hypothesis: ' || {HYPERTABLE_KEY}", evidence={"policy_type": "policy_type", "segmentby": "''", "orderby": "''"}, **HYPER)
rule("timescale.chunk_dead_tuples", "f_chunk", "f_chunk", "dead_tuples >= 10000 OR (live_tuples > 0 AND dead_tuples / live_tuples > 0.2)", "medium", kind="chunk", key="database_name || '.' || schema_name || '.' || chunk_name", name="chunk_name",
     title="'Chunk has local dead-tuple pressure: ' || database_name || '.' || schema_name || '.' || chunk_name", evidence={"hypertable": "hypertable_name", "dead_tuples": "dead_tuples", "live_tuples": "live_tuples"})
rule("timescale.retention_missing", "x_hypertable s_policy", no_policy("retention").replace("s_hypertable", "x_hypertable"), "total_size_bytes >= 10737418240 AND oldest_chunk_days >= 365", title=f"'Retenção ausente em hypertable grande: ' || {HYPERTABLE_KEY}",
     evidence={"size_bytes": "total_size_bytes", "chunks_older_than_days": "oldest_chunk_days", "threshold_bytes": "10737418240"}, **HYPER)
rule("timescale.compression_missing", "x_hypertable s_policy", f"(SELECT h.*, coalesce(p.has, false) AS has FROM x_hypertable h LEFT JOIN (SELECT DISTINCT environment_id, run_id, database_name, schema_name, hypertable_name, true AS has FROM s_policy WHERE policy_type = 'compression') p {JOIN_HYPER})",
     "total_size_bytes >= 5368709120 AND (NOT has OR NOT compression_enabled) AND uncompressed_old_bytes / total_size_bytes >= 0.5", "medium", title=f"'Compressão ausente em hypertable grande: ' || {HYPERTABLE_KEY}",
     evidence={"size_bytes": "total_size_bytes", "uncompressed_old_bytes": "uncompressed_old_bytes", "uncompressed_old_share": "round(uncompressed_old_bytes / total_size_bytes, 3)", "compression_enabled": "compression_enabled", "has_compression_policy": "has"}, **HYPER)
rule("timescale.compression_ratio_low", "x_hypertable", "x_hypertable", "compressed_chunk_count >= 5 AND observed_ratio > 0 AND observed_ratio < 2", title=f"'Taxa de compressão baixa: ' || {HYPERTABLE_KEY}",
     evidence={"observed_ratio": "observed_ratio", "compressed_chunk_count": "compressed_chunk_count", "threshold": "CAST(2 AS DOUBLE)"}, **HYPER)
rule("timescale.retention_cagg_conflict", "s_hypertable s_policy x_cagg",
     f"""(SELECT h.*, CAST({RET_KEEP} / 86400 AS INTEGER) AS days, c.schema_name || '.' || c.view_name AS cagg, c.view_name, CASE WHEN refresh_window_days = 0 THEN CAST(floor({seconds('lag')} / 86400) AS INTEGER) ELSE refresh_window_days END AS win
 FROM s_hypertable h JOIN s_policy p {JOIN_HYPER} JOIN x_cagg c ON c.environment_id = h.environment_id AND c.run_id = h.run_id AND c.database_name = h.database_name AND c.source_schema = h.schema_name AND c.source_name = h.hypertable_name WHERE policy_type = 'retention' AND has_refresh_policy)""",
     "win > 0 AND days < win", "high", title="'Retenção conflita com CAGG ' || cagg", evidence={"retention_days": "days", "cagg": "cagg", "refresh_window_days": "win"}, dedup_key=f"{HYPERTABLE_KEY} || ':' || view_name", **HYPER)

# --- security -------------------------------------------------------------------------------------
FUNCTION = dict(kind="function", key="database_name || '.' || schema_name || '.' || function_name || CASE WHEN identity_args <> '' THEN '(' || identity_args || ')' ELSE '' END", name="function_name")
rule("security.security_definer", "s_function", "s_function", "is_security_definer", "medium", title=f"'SECURITY DEFINER function: ' || {FUNCTION['key']}", evidence={"is_security_definer": "true", "owner": "owner", "language": "language", "identity_arguments": "identity_args"}, **FUNCTION)
rule("security.definer_search_path", "s_function", "s_function", "is_security_definer AND NOT search_path_pinned AND config NOT ILIKE '%search_path=%'", "high", title=f"'Security definer without pinned search_path: ' || {FUNCTION['key']}",
     evidence={"identity_arguments": "identity_args", "search_path_pinned": "false"}, **FUNCTION)
AUDITOR = dict(kind="role", key="database_name || '.auditor:' || role_name", schema="''", name="role_name")
ROLE = dict(AUDITOR, key="database_name || '.role:' || role_name")
rule("security.auditor_privilege_unknown", "s_role", "s_role", "is_current AND privilege_check_failed", "medium", title="'Auditor privilege check incomplete: ' || role_name", **AUDITOR)
rule("security.auditor_not_readonly", "s_role", "s_role", "is_current AND NOT privilege_check_failed AND (can_write OR superuser OR create_role OR create_db)", "high", title="'Auditor connection is not read-only: ' || role_name",
     evidence={"superuser": "superuser", "can_write": "can_write", "createrole": "create_role"}, **AUDITOR)
rule("security.account_inactive_review", "s_role", "s_role", "NOT is_current AND login AND (coalesce(valid_until < collected_at, false) OR possibly_inactive)", title="'Revisar conta possivelmente inativa: ' || role_name",
     evidence={"sampled_inactive_window": "possibly_inactive", "expired": "coalesce(valid_until < collected_at, false)"}, dedup="'review'", **ROLE)
rule("security.powerful_role", "s_role", """(SELECT environment_id, run_id, database_name, role_name, bool_or(superuser) AS su, bool_or(bypass_rls) AS br, bool_or(replication) AS re, bool_or(create_role) AS cr, bool_or(login) AS lo,
 list_sort(list_distinct(flatten(list([x for x in string_split(inherited_list, ',') if x <> ''])))) AS inh, max(server_version) AS sv FROM s_role WHERE superuser OR bypass_rls OR replication OR create_role OR inherited_list <> '' GROUP BY ALL)""",
     severity="CASE WHEN su OR br OR re OR list_contains(inh, 'pg_read_all_data:reader') OR (sv LIKE '15%' AND (cr OR list_contains(inh, 'createrole:ops'))) THEN 'high' ELSE 'medium' END", title="'Powerful role: ' || role_name",
     evidence={"superuser": "su", "bypass_rls": "br", "replication": "re", "create_role": "cr", "login": "lo", "inherited": "array_to_string(inh, ',')"}, **ROLE)
rule("security.excessive_privilege", "s_grant", "(SELECT *, upper(unnest(string_split(privilege_list, ','))) AS p, upper(trim(grantee)) IN ('PUBLIC', '') AS pub FROM s_grant)", "pub OR p IN ('INSERT', 'TRUNCATE', 'ALL')",
     "CASE WHEN pub AND p IN ('ALL', 'INSERT') THEN 'medium' ELSE 'low' END", kind="object_type", key="database_name || '.' || schema_name || '.' || object_name || ':' || grantee || ':' || p", name="object_name",
     title="'Privilege review: ' || p || ' on ' || object_name || ' to ' || grantee", evidence={"grantee": "grantee", "privilege": "p", "grantable": "grantable", "is_public": "pub"})
rule("security.public_schema_create", "s_schema", "s_schema", "schema_name = 'public' AND (acl_list LIKE '%=C/%' OR acl_list LIKE '%=UC/%')", "medium", kind="schema", key="database_name || '.public'", name="''",
     title="'PUBLIC can create objects in schema public'", evidence={"acls": "string_split(acl_list, '|')"})

# --- environments -------------------------------------------------------------------------------
def drift(rule_id, views, frm, when, severity, informational="false"):
    rule(rule_id, views, frm, when, severity, kind="environment", key=f"peer || '|{rule_id}|' || n", title="'Drift ' || n || ' ' || environment_id || ' vs ' || peer_name", database="''", schema="''", name="''", dedup="n",
         evidence={"name": "n", "left": "l", "right": "r", "peer_environment_id": "peer", "peer_run_id": "peer_run", "informational": informational})


drift("config.version_drift", "s_server", "(" + PAIRS.format(cols="'postgres' AS n, a.server_version AS l, b.server_version AS r", more="") + " UNION ALL " + PAIRS.format(cols="'timescaledb', a.timescale_version, b.timescale_version", more="") + ")", "l <> '' AND r <> '' AND l <> r", "medium")
EXT = "(SELECT environment_id, extension, string_agg(DISTINCT version, ',' ORDER BY version) AS v FROM s_extension GROUP BY ALL)"
drift("config.extension_drift", "s_server s_extension",
      f"""(SELECT p.*, k.extension AS n, coalesce(x.v, '') AS l, coalesce(y.v, '') AS r, x.v IS NULL OR y.v IS NULL AS one FROM {PAIRS.format(cols="1 AS one_row", more="")} p
 JOIN (SELECT DISTINCT extension FROM s_extension) k ON true LEFT JOIN {EXT} x ON x.environment_id = p.environment_id AND x.extension = k.extension LEFT JOIN {EXT} y ON y.environment_id = p.peer AND y.extension = k.extension WHERE x.v IS DISTINCT FROM y.v)""",
      "true", "CASE WHEN one THEN 'low' ELSE 'medium' END")
drift("config.guc_drift", "s_server s_setting", PAIRS.format(cols="x.setting AS n, x.value AS l, y.value AS r", more="JOIN s_setting x ON x.environment_id = a.environment_id JOIN s_setting y ON y.environment_id = b.environment_id AND y.setting = x.setting AND x.setting <> 'other'"),
      "l <> '' AND r <> '' AND l <> r", "CASE WHEN n = 'shared_buffers' THEN 'info' ELSE 'medium' END", "n = 'shared_buffers'")
SERVER = dict(kind="", key="''", database="''", schema="''", name="''", dedup_key="environment_id")
rule("replication.lag_high", "s_server", "s_server", "expects_replica AND replay_lag_bytes > 67108864", "high", title="'Replica apply lag is above the threshold'", dedup="'lag'", **SERVER)
rule("replication.archive_stalled", "s_server", "s_server", "expects_replica AND ((last_failed_archive IS NOT NULL AND (last_archived IS NULL OR last_failed_archive > last_archived)) OR (archive_failed_count > 0 AND last_archived IS NULL))", "high", title="'WAL archive looks stalled'", dedup="'archive'", **SERVER)
DRILL = "(SELECT *, 'run1' AS run_id FROM (SELECT * FROM s_drill QUALIFY row_number() OVER (PARTITION BY environment_id ORDER BY performed_at DESC NULLS LAST, drill_id DESC) = 1))"
ENVIRONMENT = dict(kind="environment", key="environment_id", database="''", schema="''", name="''")
rule("backup.drill_overdue", "s_drill", DRILL, f"coalesce(NOT succeeded OR performed_at < TIMESTAMP '{NOW}' - INTERVAL 30 DAY, true)", "medium", title="'Ensaio de restauração do banco auditado em atraso'",
     evidence="CASE WHEN drill_id IS NULL THEN CAST(json_object('max_age_days', 30) AS VARCHAR) ELSE CAST(json_object('max_age_days', 30, 'last_succeeded', succeeded) AS VARCHAR) END", **ENVIRONMENT)
rule("backup.rto_exceeded", "s_drill", DRILL, "rto_seconds > 600", "high", title="'RTO do ensaio de restauração excedeu o alvo'", evidence={"rto_seconds": "rto_seconds", "rto_target_seconds": "600", "drill_id": "drill_id"}, **ENVIRONMENT)
ITEM = dict(kind="object_type", key=REVIEW_KEY, database="''", schema="''", name="shown")
REVIEW_VIEWS = "s_campaign s_campaign_item s_decision"
HELD = {"campaign_id": "campaign_id", "account": "account_name", "privilege": "privilege"}
rule("access_review.revocation_not_applied", REVIEW_VIEWS, REVIEW, f"decision = 'revoke' AND revoke_due_at < TIMESTAMP '{NOW}' AND still_present", "high", title="'Revogação não aplicada: ' || account_name || ' ' || privilege || ' em ' || shown", evidence={**HELD, "item_id": "item_id", "object": "shown"}, **ITEM)
rule("access_review.powerful_without_approve", REVIEW_VIEWS, REVIEW, "list_contains(hl, 'powerful_role') AND coalesce(decision, '') <> 'approve' AND status <> 'closed'", "high", title="'Papel poderoso sem aprovação: ' || account_name",
     evidence={"campaign_id": "campaign_id", "decision": "coalesce(decision, '')", "highlights": "[x for x in hl if x <> '']"}, **{**ITEM, "kind": "role", "name": "account_name"})
rule("access_review.inactive_with_write", REVIEW_VIEWS, REVIEW, "list_contains(hl, 'inactive_or_expired') AND privilege IN ('UPDATE', 'DELETE')", "medium", title="'Conta inativa com escrita: ' || account_name || ' em ' || shown",
     evidence={"campaign_id": "campaign_id", "inactive_days_threshold": "90", "privilege": "privilege"}, **ITEM)
rule("access_review.public_outside_public", REVIEW_VIEWS, REVIEW, "origin_kind = 'public' AND NOT starts_with(object_name, 'public.')", "medium", title="'Privilégio via PUBLIC fora de public: ' || shown", evidence=HELD, **ITEM)
rule("access_review.new_privilege_undecided", REVIEW_VIEWS, REVIEW, "list_contains(hl, 'new_since_previous') AND decision IS NULL", "medium", title="'Privilégio novo sem decisão: ' || account_name || ' ' || privilege || ' em ' || shown", evidence=HELD, **ITEM)
rule("access_review.campaign_overdue_pending", REVIEW_VIEWS, f"(SELECT environment_id, run_id, campaign_id, status, due_at, count(*) FILTER (WHERE decision IS NULL) * 100.0 / count(*) AS pct FROM {REVIEW} GROUP BY ALL)", f"due_at < TIMESTAMP '{NOW}' AND status <> 'closed' AND pct >= 10", "medium",
     kind="access_review_campaign", key="'campaign:' || campaign_id", name="campaign_id", title="'Campanha de revisão vencida com pendências'", database="''", schema="''",
     evidence={"campaign_id": "campaign_id", "pending_percent": "CAST(round(pct, 4) AS DOUBLE)", "threshold_percent": "10"})
rule("pii.column_detected", "s_pii_column", "s_pii_column", "confidence <> 'baixa'", "info", title=f"'Dado pessoal detectado: ' || {COLUMN_KEY} || ' (' || category || ')'",
     evidence={"category": "category", "confidence": "confidence", "read_accounts": "read_accounts", "has_rls": "has_rls", "access_level": "access_level"}, **COLUMN)
rule("pii.broad_read_access", "s_pii_column", "s_pii_column", "confidence = 'alta' AND read_accounts >= 5", "CASE WHEN category = 'cpf' THEN 'high' ELSE 'medium' END", title=f"'Acesso amplo a dado pessoal: ' || {COLUMN_KEY}",
     evidence={"category": "category", "confidence": "confidence", "read_accounts": "read_accounts", "threshold": "5", "access_level": "access_level"}, **COLUMN)
rule("pii.no_rls_hypothesis", "s_pii_column", "(SELECT * FROM s_pii_column WHERE confidence = 'alta' AND NOT has_rls AND read_accounts >= 2 QUALIFY row_number() OVER (PARTITION BY environment_id, run_id, database_name, schema_name, table_name ORDER BY position) = 1)",
     title=f"'Hipótese: dado pessoal sem RLS em ' || {TABLE_KEY}", evidence={"read_accounts": "read_accounts", "has_rls": "false", "hypothesis": "true", "sample_column": "column_name", "category": "category", "access_level": "access_level"})
BLOAT = f"""(SELECT t.*, greatest(0, total_size_bytes - (CAST(floor(row_estimate * (24 + w)) AS BIGINT) + 24)) AS waste FROM s_table t
 JOIN (SELECT environment_id, run_id, database_name, schema_name, table_name, round(sum(average_width * (1 - null_tenths / 10)), 6) AS w FROM s_column GROUP BY ALL) c {JOIN_TABLE})"""
rule("cost.bloat_recoverable", "s_table s_column", BLOAT, "waste / total_size_bytes >= 0.3 AND waste >= 1073741824 AND row_estimate > 0", "CASE WHEN waste >= 21474836480 THEN 'high' ELSE 'medium' END", title=f"'Bloat recuperável estimado: ' || {TABLE_KEY}",
     evidence={"bloat_ratio": "round(waste / total_size_bytes, 4)", "bloat_bytes": "waste", "table_bytes": "total_size_bytes"})
