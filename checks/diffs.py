"""Fingerprints, object sets, timelines, drift and reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, table
from checks.bundle import DerivedBundle
from checks.logs import replace_chain
from checks.rules import finding_sql
from plumbline.functions import text
from plumbline.operators import diff, reconcile
from plumbline.operators.rules import environments
from plumbline.operators.rules.base import DEFAULTS
from plumbline.plans import analysis, derive

REGISTRY = Registry()
TABLE_SQL = "environment_id, run_id, database_name, schema_name, table_name"
NORMAL_SQL = lambda c: "lower(trim(regexp_replace(trim(regexp_replace(" + replace_chain(c, [(r"(?s)/\*.*?\*/", " "), (r"--[^\n]*", " ")]) + ", '\\s+', ' ', 'g')), ';$', '')))"


@REGISTRY.add(
    "dif1_normalize",
    f"""SELECT doc_id, lower(trim(' ' || source || ' ')) AS name, CASE doc_id % 5 WHEN 0 THEN 'integer' WHEN 1 THEN 'timestamptz' WHEN 2 THEN 'varchar' WHEN 3 THEN 'character' ELSE 'jsonb' END AS type, {NORMAL_SQL("text || ' ; '")} AS definition FROM documents""",
)
def normalize(spark, folder):
    documents = table(spark, folder, "documents")
    kind = F.element_at(F.array(*[F.lit(t) for t in ("INT4", " timestamp with time zone", "Character Varying", "bpchar", "JSONB")]), (F.col("doc_id") % 5 + 1).cast("int"))
    return documents.select(
        "doc_id",
        text.normalize_name(F.concat(F.lit(" "), F.col("source"), F.lit(" "))).alias("name"),
        text.normalize_type(kind).alias("type"),
        text.normalize_sql(F.concat(F.col("text"), F.lit(" ; "))).alias("definition"),
    )


TYPE_SQL = "CASE data_type WHEN 'character varying' THEN 'varchar' WHEN 'timestamp with time zone' THEN 'timestamptz' ELSE data_type END"


@REGISTRY.add(
    "dif2_object_fingerprint",
    derive.ctes("s_table", "s_column", "s_constraint", "s_index") + f""" SELECT {TABLE_SQL}, sha256('{{"schema":"' || schema_name || '","name":"' || lower(table_name) || '","columns":[' || coalesce(c, '') || '],"constraints":[' || coalesce(k, '') || '],"indexes":[' || coalesce(i, '') || ']}}') AS fingerprint FROM s_table
 LEFT JOIN (SELECT {TABLE_SQL}, string_agg('{{"position":' || position || ',"name":"' || lower(column_name) || '","type":"' || {TYPE_SQL} || '","nullable":' || nullable || CASE WHEN default_expr <> '' THEN ',"default":"' || lower(default_expr) || '"' ELSE '' END || '}}', ',' ORDER BY position) AS c FROM s_column GROUP BY ALL) USING ({TABLE_SQL})
 LEFT JOIN (SELECT {TABLE_SQL}, string_agg('"' || d || '"', ',' ORDER BY d) AS k FROM (SELECT *, lower(constraint_type || ' (' || column_list || ')') AS d FROM s_constraint) GROUP BY ALL) USING ({TABLE_SQL})
 LEFT JOIN (SELECT {TABLE_SQL}, string_agg('"' || d || '"', ',' ORDER BY d) AS i FROM (SELECT *, lower(replace(definition, '  ', ' ')) AS d FROM s_index) GROUP BY ALL) USING ({TABLE_SQL})""",
)
def fingerprints(spark, folder):
    b = DerivedBundle(spark, folder)
    constraints = b["constraints"].withColumn("definition", F.concat(F.col("constraint_type"), F.lit(" ("), F.col("column_list"), F.lit(")")))
    return diff.table_fingerprints(b["tables"], b["columns"], constraints, b["indexes"])


MARK = "sha256(lower(trim({e})))"
ITEM_SQL = {
    "table": ("f_table_snapshot", "concat_ws('.', lower(database_name), lower(schema_name), lower(table_name))", "schema_name || '.' || table_name", "relkind || chr(31) || has_primary_key || chr(31) || column_count"),
    "index": ("s_index", "concat_ws('.', lower(database_name), lower(schema_name), lower(table_name), lower(index_name))", "schema_name || '.' || table_name || '.' || index_name", "replace(definition, '  ', ' ')"),
    "sequence": ("s_sequence", "concat_ws('.', lower(database_name), lower(schema_name), lower(sequence_name))", "schema_name || '.' || sequence_name", "data_type"),
    "function": ("s_function", "concat_ws('.', lower(database_name), lower(schema_name), lower(function_name), nullif(lower(identity_args), ''))", "schema_name || '.' || function_name || '.' || identity_args", "owner || ' ' || language"),
}


@REGISTRY.add(
    "dif3_build_items",
    derive.ctes("f_table_snapshot", "s_index", "s_sequence", "s_function") + " " + " UNION ALL ".join(
        f"SELECT environment_id, run_id, '{k}' AS object_type, CASE WHEN '{k}' = 'function' AND {key} = 'db0.public.fn_0' THEN 'db0.public.renamed' ELSE {key} END AS object_key, {name} AS object_name, {MARK.replace('{e}', mark)} AS fingerprint FROM {v}"
        for k, (v, key, name, mark) in ITEM_SQL.items()
    ),
)
def items(spark, folder):
    objects = {k: derive.view(spark, folder, v) for k, (v, *_) in ITEM_SQL.items()}
    objects["function"] = objects["function"].withColumn("definition", F.concat_ws(" ", "owner", "language"))
    mappings = table(spark, folder, "region").where("r_regionkey = 0").select(
        F.lit("Function").alias("object_type"), F.lit("DB0.public.fn_0").alias("source_key"), F.lit("db0.public.renamed").alias("target_key")
    )
    return diff.build_items(objects, mappings).drop("fields")


def sides(spark, folder):
    objects = derive.view(spark, folder, "f_object").withColumn(
        "fields",
        F.map_filter(F.create_map(F.lit("relkind"), F.col("relkind"), F.lit("column_count"), F.col("column_count")), lambda k, v: v.isNotNull()),
    )
    return objects.where("side = 'source'"), objects.where("side = 'target'")


DIFF_SQL = derive.ctes("f_object") + """, d AS (SELECT coalesce(s.object_type, t.object_type) AS object_type, coalesce(s.object_key, t.object_key) AS object_key, s.object_name AS source_name, t.object_name AS target_name, s.fingerprint AS source_fingerprint, t.fingerprint AS target_fingerprint,
 CASE WHEN s.object_key IS NULL OR t.object_key IS NULL THEN NULL WHEN s.fingerprint <> '' AND t.fingerprint <> '' THEN CASE WHEN s.fingerprint = t.fingerprint THEN '' ELSE 'fingerprint' END
  ELSE concat_ws(',', CASE WHEN s.column_count IS DISTINCT FROM t.column_count THEN 'column_count' END, CASE WHEN s.relkind IS DISTINCT FROM t.relkind THEN 'relkind' END) END AS changed_fields,
 s.fingerprint = '' AND t.fingerprint = '' AND s.relkind IS NULL AND t.relkind IS NULL AS bare
 FROM (SELECT * FROM f_object WHERE side = 'source') s FULL JOIN (SELECT * FROM f_object WHERE side = 'target') t ON s.object_type = t.object_type AND lower(s.object_key) = lower(t.object_key)),
 st AS (SELECT * EXCLUDE (bare), CASE WHEN target_name IS NULL THEN 'ONLY_SOURCE' WHEN source_name IS NULL THEN 'ONLY_TARGET' WHEN bare THEN 'UNKNOWN' WHEN changed_fields = '' THEN 'MATCH' ELSE 'DRIFT' END AS status FROM d)"""


@REGISTRY.add("dif4_compare_sets", DIFF_SQL + " SELECT * FROM st")
def compare(spark, folder):
    source, target = sides(spark, folder)
    found = diff.compare_sets(source, target)
    return found.withColumn("changed_fields", F.when(F.col("changed_fields").isNotNull(), F.concat_ws(",", "changed_fields")))


@REGISTRY.add("dif5_diff_summary", DIFF_SQL + " SELECT object_type, status, count(*) AS objects FROM st WHERE status IN ('DRIFT', 'UNKNOWN', 'ONLY_TARGET') AND object_type = 'view' GROUP BY ALL")
def summary(spark, folder):
    source, target = sides(spark, folder)
    kept = diff.filter_diffs(diff.compare_sets(source, target), ["drift ", "UNKNOWN", "only_target"], "VIEW")
    return diff.diff_summary(kept, "object_type")


REFS = """refs AS (SELECT side, CASE WHEN p % 10 = 1 AND side = 'source' THEN 'database' WHEN p % 10 = 1 THEN 'schema' ELSE 'table' END AS object_type, 'db' AS database_name, CASE WHEN p % 10 = 1 THEN '' ELSE object_type END AS schema_name, object_name, fingerprint FROM (SELECT *, CAST(split_part(object_name, '#', 2) AS BIGINT) AS p FROM f_object))"""


@REGISTRY.add(
    "dif6_suggest_mappings",
    derive.ctes("f_object") + f""", {REFS}, s AS (SELECT * FROM refs WHERE side = 'source'), t AS (SELECT * FROM refs WHERE side = 'target'),
 h AS (SELECT s.*, a.o AS a, b.o AS b, c.o AS c FROM s LEFT JOIN (SELECT lower(object_name) AS n, max(object_name) AS o FROM t WHERE object_type IN ('schema', 'database') GROUP BY 1) a ON a.n = lower(s.object_name) AND s.object_type = 'database'
  LEFT JOIN (SELECT fingerprint AS f, max({{'d': database_name, 's': schema_name, 't': object_type, 'n': object_name}}) AS o FROM t WHERE fingerprint <> '' GROUP BY 1) b ON b.f = s.fingerprint
  LEFT JOIN (SELECT schema_name AS sn, object_type AS ot, lower(object_name) AS n, max({{'d': database_name, 's': schema_name, 't': object_type, 'n': object_name}}) AS o FROM t GROUP BY 1, 2, 3) c ON c.sn = s.schema_name AND c.ot = s.object_type AND c.n = lower(s.object_name))
 SELECT database_name AS source_database_name, schema_name AS source_schema_name, object_type AS source_object_type, object_name AS source_object_name, CASE WHEN a IS NOT NULL THEN 'tsdb' ELSE coalesce(b.d, c.d) END AS target_database_name, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b.s ELSE c.s END AS target_schema_name,
 CASE WHEN a IS NOT NULL THEN 'schema' WHEN b IS NOT NULL THEN b.t ELSE c.t END AS target_object_type, CASE WHEN a IS NOT NULL THEN a WHEN b IS NOT NULL THEN b.n ELSE c.n END AS target_object_name, CASE WHEN a IS NOT NULL THEN 'database_to_schema' ELSE 'identical' END AS relation_type,
 CAST(CASE WHEN a IS NOT NULL THEN 0.85 WHEN b IS NOT NULL THEN 0.95 ELSE 0.7 END AS DOUBLE) AS confidence FROM h WHERE a IS NOT NULL OR b IS NOT NULL OR c IS NOT NULL""",
)
def mappings(spark, folder):
    objects = derive.view(spark, folder, "f_object")
    tenth = F.substring_index("object_name", "#", -1).cast("bigint") % 10 == 1
    refs = objects.select(
        "side",
        F.when(tenth & (F.col("side") == "source"), "database").when(tenth, "schema").otherwise("table").alias("object_type"),
        F.lit("db").alias("database_name"),
        F.when(tenth, "").otherwise(F.col("object_type")).alias("schema_name"),
        "object_name",
        "fingerprint",
    )
    return diff.suggest_mappings(refs.where("side = 'source'"), refs.where("side = 'target'"))


def timeline_pairs(spark, folder):
    return diff.timeline_pairs(derive.view(spark, folder, "f_run"), derive.view(spark, folder, "f_coverage"))


def table_items(spark, folder):
    return diff.build_items({"table": derive.view(spark, folder, "f_table_snapshot")})


PAIRS = derive.ctes("f_run", "f_coverage", "f_table_snapshot") + """, bad AS (SELECT DISTINCT environment_id, run_id FROM f_coverage WHERE status = 'failed'),
 rr AS (SELECT r.*, status = 'success' AND b.run_id IS NULL AS complete FROM f_run r LEFT JOIN bad b USING (environment_id, run_id)),
 pr AS (SELECT c.environment_id, c.run_id, c.started_at, c.status, c.complete, p.run_id AS pid, p.started_at AS pat, p.complete AS pc, l.run_id AS lid, l.started_at AS lat,
   (SELECT count(*) FROM rr x WHERE x.environment_id = c.environment_id AND x.started_at > p.started_at AND x.started_at < c.started_at AND x.status <> 'success') AS nb
  FROM rr c ASOF LEFT JOIN (SELECT * FROM rr WHERE status = 'success') p ON p.environment_id = c.environment_id AND p.profile = c.profile AND p.collector_version = c.collector_version AND c.started_at > p.started_at
  ASOF LEFT JOIN (SELECT * FROM rr WHERE status = 'success') l ON l.environment_id = c.environment_id AND c.started_at > l.started_at WHERE c.status IN ('success', 'partial_success')),
 tp AS (SELECT environment_id, run_id, started_at, CASE WHEN NOT complete THEN lid ELSE pid END AS previous_run_id, CASE WHEN NOT complete THEN lat ELSE pat END AS previous_started_at,
  CASE WHEN NOT complete THEN 'partial_run' WHEN pid IS NULL THEN '' WHEN NOT pc THEN 'prior_incomplete' WHEN nb > 0 THEN 'partial_between' ELSE '' END AS gap_reason FROM pr),
 it AS (SELECT *, lower(database_name) || '.' || schema_name || '.' || lower(table_name) AS object_key, sha256(relkind || chr(31) || has_primary_key || chr(31) || column_count) AS fp FROM f_table_snapshot),
 us AS (SELECT * FROM tp WHERE gap_reason = '' AND previous_run_id IS NOT NULL),
 ev AS (SELECT environment_id, run_id, 'table' AS object_type, object_key, CASE WHEN a IS NULL THEN 'added' WHEN b IS NULL THEN 'removed' ELSE 'modified' END AS change_kind, coalesce(a, '') AS prior_fingerprint, coalesce(b, '') AS current_fingerprint, CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN 'fingerprint' ELSE '' END AS changed_fields
  FROM (SELECT u.environment_id, u.run_id, object_key, fp AS a FROM us u JOIN it ON it.environment_id = u.environment_id AND it.run_id = u.previous_run_id) x FULL JOIN (SELECT u.environment_id, u.run_id, object_key, fp AS b FROM us u JOIN it USING (environment_id, run_id)) y USING (environment_id, run_id, object_key) WHERE a IS DISTINCT FROM b)"""


@REGISTRY.add("dif7_timeline_events", PAIRS + " SELECT * FROM ev")
def timeline(spark, folder):
    return diff.timeline_events(table_items(spark, folder), timeline_pairs(spark, folder))


@REGISTRY.add("dif8_timeline_gaps", PAIRS + " SELECT environment_id, previous_run_id, run_id, coalesce(previous_started_at, started_at) AS gap_from, started_at AS gap_to, gap_reason AS reason FROM tp WHERE gap_reason <> ''")
def gaps(spark, folder):
    return diff.timeline_gaps(timeline_pairs(spark, folder))


DEPLOY = """dp AS (SELECT concat('env', CAST(o_custkey % 2 AS VARCHAR)) AS environment_id, 'a' || CAST(min(o_orderkey) AS VARCHAR) AS annotation_id, min(o_orderdate) + INTERVAL 20 MINUTE AS created_at FROM orders GROUP BY o_custkey % 2, date_trunc('quarter', o_orderdate)),
 rg AS (SELECT environment_id, run_id, 'v' || CAST(year(started_at) * 4 + quarter(started_at) AS VARCHAR) AS latest_version, CASE WHEN month(started_at) % 4 = 0 THEN 'denied' ELSE 'ok' END AS access_state FROM f_run),
 co AS (SELECT u.environment_id, u.run_id, CASE WHEN h.a IS NOT NULL THEN 'deployment' WHEN g.access_state = 'ok' AND g.latest_version <> coalesce(o.latest_version, '') THEN 'migration_registry' WHEN g.access_state = 'denied' THEN 'not_verified' ELSE 'none' END AS correlation, coalesce(h.a, '') AS annotation_id, g.latest_version AS lv
  FROM us u LEFT JOIN (SELECT u.environment_id, u.run_id, arg_max(annotation_id, {'c': created_at, 'a': annotation_id}) AS a FROM us u JOIN dp ON dp.environment_id = u.environment_id AND dp.created_at BETWEEN u.previous_started_at - INTERVAL 30 MINUTE AND u.started_at + INTERVAL 30 MINUTE GROUP BY 1, 2) h USING (environment_id, run_id)
  JOIN rg g USING (environment_id, run_id) LEFT JOIN rg o ON o.environment_id = u.environment_id AND o.run_id = u.previous_run_id)"""


def correlated(spark, folder):
    environment = F.concat(F.lit("env"), (F.col("o_custkey") % 2).cast("string")).alias("environment_id")
    quarters = table(spark, folder, "orders").groupBy(environment, F.date_trunc("quarter", "o_orderdate"))
    deployments = quarters.agg(
        F.concat(F.lit("a"), F.min("o_orderkey").cast("string")).alias("annotation_id"),
        (F.min("o_orderdate") + F.expr("INTERVAL '20' MINUTE")).cast("timestamp").alias("created_at"),
    ).select("environment_id", "annotation_id", "created_at")
    started = F.col("started_at")
    registry = derive.view(spark, folder, "f_run").select(
        "environment_id",
        "run_id",
        F.concat(F.lit("v"), (F.year(started) * 4 + F.quarter(started)).cast("string")).alias("latest_version"),
        F.when(F.month(started) % 4 == 0, "denied").otherwise("ok").alias("access_state"),
    )
    return diff.correlate_deploy(timeline_pairs(spark, folder), deployments, registry)


@REGISTRY.add(
    "dif9_correlate_deploy",
    PAIRS + f", {DEPLOY} SELECT environment_id, run_id, correlation, CASE correlation WHEN 'migration_registry' THEN 'medium' WHEN 'not_verified' THEN 'low' ELSE 'high' END AS confidence, annotation_id, CASE WHEN correlation = 'migration_registry' THEN lv ELSE '' END AS registry_version FROM co",
)
def correlate(spark, folder):
    return correlated(spark, folder)


@REGISTRY.add(
    "rule_drift_out_of_pipeline",
    PAIRS + f", {DEPLOY}, sc AS (SELECT ev.*, correlation FROM ev JOIN co USING (environment_id, run_id)) " + finding_sql(
        "drift.out_of_pipeline", "sc", "correlation = 'none'", "CASE WHEN change_kind = 'added' THEN CASE WHEN environment_id = 'env0' THEN 'low' ELSE 'info' END WHEN environment_id = 'env0' THEN 'high' ELSE 'medium' END", kind="object_type", key="object_key",
        title="'Mudança de schema fora do pipeline: ' || change_kind || ' ' || object_key", database="''", schema="''", name="''", confidence="0.8", dedup="change_kind || '@' || run_id",
        evidence={"change_kind": "change_kind", "prior_fingerprint": "prior_fingerprint", "current_fingerprint": "current_fingerprint", "correlation": "correlation"}),
)
def out_of_pipeline(spark, folder):
    changes = timeline(spark, folder).join(correlated(spark, folder).select("environment_id", "run_id", "correlation"), ["environment_id", "run_id"])
    changes = changes.select("*", (F.col("environment_id") == "env0").alias("is_production"), F.lit(False).alias("is_security_definer"))
    return analysis.run_rule({"schema_changes": changes}, "drift.out_of_pipeline")


@REGISTRY.add(
    "dif10_out_of_pipeline_severity",
    """SELECT object_type, change_kind, definer, CASE WHEN object_type IN ('Table', 'column') THEN CASE WHEN change_kind = 'added' THEN 'low' ELSE 'high' END WHEN object_type = 'index' THEN 'medium' WHEN object_type IN ('function', 'view') THEN CASE WHEN definer THEN 'high' ELSE 'medium' END WHEN change_kind = 'added' THEN 'low' ELSE 'medium' END AS severity, count(*) AS changes
FROM (SELECT CASE p_partkey % 6 WHEN 0 THEN 'Table' WHEN 1 THEN 'column' WHEN 2 THEN 'index' WHEN 3 THEN 'function' WHEN 4 THEN 'view' ELSE 'trigger' END AS object_type, CASE p_size % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS change_kind, p_partkey % 4 = 0 AS definer FROM part) GROUP BY ALL""",
)
def severities(spark, folder):
    from plumbline.operators.rules.environments import out_of_pipeline_severity

    changes = table(spark, folder, "part").selectExpr(
        "CASE p_partkey % 6 WHEN 0 THEN 'Table' WHEN 1 THEN 'column' WHEN 2 THEN 'index' WHEN 3 THEN 'function' WHEN 4 THEN 'view' ELSE 'trigger' END AS object_type",
        "CASE p_size % 3 WHEN 0 THEN 'added' WHEN 1 THEN 'removed' ELSE 'modified' END AS change_kind",
        "p_partkey % 4 = 0 AS definer",
    )
    severity = out_of_pipeline_severity(F.col("object_type"), F.col("change_kind"), F.col("definer"))
    return changes.groupBy("object_type", "change_kind", "definer", severity.alias("severity")).agg(F.count(F.lit(1)).alias("changes"))


DIVERGE = PAIRS + """, lr AS (SELECT environment_id, arg_max(run_id, started_at) AS run_id, arg_max(prev, started_at) AS prev FROM (SELECT *, lag(run_id) OVER (PARTITION BY environment_id ORDER BY started_at) AS prev FROM f_run WHERE status = 'success') GROUP BY 1),
 k AS (SELECT coalesce(a.object_key, b.object_key) AS object_key FROM (SELECT object_key, fp FROM it JOIN lr USING (environment_id, run_id) WHERE environment_id = 'env0') a FULL JOIN (SELECT object_key, fp FROM it JOIN lr USING (environment_id, run_id) WHERE environment_id = 'env1') b USING (object_key) WHERE a.fp IS DISTINCT FROM b.fp
  INTERSECT SELECT coalesce(a.object_key, b.object_key) FROM (SELECT object_key, fp FROM it JOIN lr ON it.environment_id = lr.environment_id AND it.run_id = lr.prev WHERE it.environment_id = 'env0') a FULL JOIN (SELECT object_key, fp FROM it JOIN lr ON it.environment_id = lr.environment_id AND it.run_id = lr.prev WHERE it.environment_id = 'env1') b USING (object_key) WHERE a.fp IS DISTINCT FROM b.fp),
 dv AS (SELECT l.environment_id, l.run_id, p.environment_id AS peer_environment_id, p.run_id AS peer_run_id, 'table' AS object_type, object_key FROM lr l JOIN lr p ON l.environment_id <> p.environment_id CROSS JOIN k)"""


def divergences(spark, folder):
    from plumbline.sources.runs import previous_runs

    runs = previous_runs(derive.view(spark, folder, "f_run"))
    last = runs.groupBy("environment_id").agg(F.max_by(F.struct("run_id", "previous_run_id"), "started_at").alias("r")).select("environment_id", "r.*")
    peer = F.when(F.col("environment_id") == "env0", "env1").otherwise("env0")
    peers = last.select("environment_id", peer.alias("peer_environment_id"))
    return diff.environment_divergence(table_items(spark, folder), last, peers)


@REGISTRY.add("dif11_environment_divergence", DIVERGE + " SELECT * FROM dv")
def divergence(spark, folder):
    return divergences(spark, folder)


@REGISTRY.add(
    "rule_drift_environment_divergence",
    DIVERGE + " " + finding_sql("drift.environment_divergence", "dv", "true", "CASE WHEN environment_id = 'env0' THEN 'medium' ELSE 'low' END", kind="", key="object_key", title="'Divergência persistente entre ambientes: ' || object_key", database="''", schema="''", name="''", confidence="0.7", dedup="peer_environment_id", evidence={"peer_environment_id": "peer_environment_id"}),
)
def divergence_rule(spark, folder):
    found = divergences(spark, folder).withColumn("is_production", F.col("environment_id") == "env0")
    return analysis.run_rule({"divergences": found}, "drift.environment_divergence")


FACTS = """fx AS MATERIALIZED (SELECT environment_id, 'version' AS kind, 'postgres' AS name, server_version AS value FROM s_server UNION ALL SELECT environment_id, 'version', 'timescaledb', timescale_version FROM s_server WHERE timescale_version <> ''
 UNION ALL SELECT environment_id, 'extension', extension, string_agg(DISTINCT version, ',' ORDER BY version) FROM s_extension GROUP BY 1, 3 UNION ALL SELECT environment_id, 'guc', setting, value FROM s_setting WHERE setting <> 'other' AND value <> ''
 UNION ALL SELECT environment_id, 'hypertable', h, 'present' FROM hx UNION ALL SELECT environment_id, 'chunk_interval', h, chunk_interval FROM hx UNION ALL SELECT environment_id, 'policy', database_name || ' ' || policy_type || ' ' || schema_name || '.' || hypertable_name, config FROM s_policy
 UNION ALL SELECT environment_id, 'cagg', database_name || '.' || schema_name || '.' || view_name, 'lag=' || lag || ' realtime=' || (NOT materialized_only) || ' refresh=' || has_refresh_policy FROM s_cagg
 UNION ALL SELECT environment_id, 'critical', object_name || title, min(title) FROM f_finding_event WHERE severity = 'critical' GROUP BY environment_id, object_name || title)"""


@REGISTRY.add(
    "dif12_compare_servers",
    derive.ctes("s_server", "s_extension", "s_setting", "s_hypertable", "s_policy", "s_cagg", "f_finding_event") + f""", hx AS MATERIALIZED (SELECT *, database_name || '.' || schema_name || '.' || hypertable_name AS h FROM s_hypertable), {FACTS}, pp AS (SELECT environment_id AS l, 'env' || CAST(CAST(substr(environment_id, 4) AS BIGINT) + 1 AS VARCHAR) AS r FROM s_server)
 SELECT l AS left_environment_id, r AS right_environment_id, kind, name, coalesce(a, '') AS left_value, coalesce(b, '') AS right_value, CASE WHEN a IS NULL THEN 'only_right' WHEN b IS NULL THEN 'only_left' ELSE 'drift' END AS status, name = 'shared_buffers' AND a IS NOT NULL AND b IS NOT NULL AS informational
 FROM (SELECT l, r, kind, name, value AS a FROM pp JOIN fx ON environment_id = l) x FULL JOIN (SELECT l, r, kind, name, value AS b FROM pp JOIN fx ON environment_id = r) y USING (l, r, kind, name)
 WHERE a IS DISTINCT FROM b AND NOT (kind = 'chunk_interval' AND (a IS NULL OR b IS NULL)) AND NOT (kind = 'critical' AND a IS NOT NULL AND b IS NOT NULL)""",
)
def servers(spark, folder):
    b = DerivedBundle(spark, folder)
    critical = derive.view(spark, folder, "f_finding_event").where("severity = 'critical'").groupBy(
        "environment_id", F.concat("object_name", "title").alias("dedup_key")
    ).agg(F.min("title").alias("title"))
    facts = diff.server_facts(b["servers"], b["extensions"], b["settings"], b["hypertables"], b["policies"], b["caggs"], critical)
    following = F.concat(F.lit("env"), (F.substring("environment_id", 4, 20).cast("bigint") + 1).cast("string"))
    pairs = b["servers"].select(F.col("environment_id").alias("left_environment_id"), following.alias("right_environment_id"))
    return diff.compare_servers(facts, pairs)


@REGISTRY.add(
    "dif13_finding_diff",
    derive.ctes("f_finding_event") + """, e AS (SELECT * FROM f_finding_event QUALIFY row_number() OVER (PARTITION BY environment_id, run_id, object_name, title ORDER BY started_at DESC, database_name DESC, schema_name DESC, severity DESC) = 1),
 k AS (SELECT *, database_name || '.' || schema_name || '.' || object_name AS object_key FROM e)
 SELECT environment_id, 'd5' AS from_run_id, 'd20' AS to_run_id, CASE WHEN b.severity IS NULL THEN 'removed' WHEN a.severity IS NULL THEN 'added' ELSE 'unchanged' END AS change, object_key, title, coalesce(b.severity, a.severity) AS severity FROM (SELECT * FROM k WHERE run_id = 'd5') a FULL JOIN (SELECT * FROM k WHERE run_id = 'd20') b USING (environment_id, object_key, title)""",
)
def finding_diff(spark, folder):
    events = derive.view(spark, folder, "f_finding_event").withColumn("recorded_at", F.col("started_at"))
    pairs = events.select("environment_id", F.lit("d5").alias("from_run_id"), F.lit("d20").alias("to_run_id")).distinct()
    return diff.finding_diff(events, pairs)


@REGISTRY.add(
    "dif14_baseline_diff",
    derive.ctes("f_table_snapshot") + """, bs AS (SELECT * FROM (VALUES ('env0', 'env0-199603', '', '', ''), ('env1', 'env1-199701', 'BUILDING', 'public', '')) v(environment_id, baseline_run_id, scope_database, scope_schema, scope_table)),
 t AS (SELECT bs.*, t.* EXCLUDE (environment_id) FROM f_table_snapshot t JOIN bs USING (environment_id) WHERE (scope_database = '' OR scope_database = database_name) AND (scope_schema = '' OR scope_schema = schema_name)),
 b AS (SELECT * FROM t WHERE run_id = baseline_run_id), r AS (SELECT DISTINCT environment_id, baseline_run_id, run_id FROM t WHERE run_id <> baseline_run_id)
 SELECT bs.environment_id, bs.baseline_run_id, scope_database, scope_schema, scope_table, r.run_id, (SELECT count(*) FROM t WHERE t.environment_id = r.environment_id AND t.run_id = r.run_id AND NOT EXISTS (SELECT 1 FROM b WHERE b.environment_id = t.environment_id AND b.database_name = t.database_name AND b.schema_name = t.schema_name AND b.table_name = t.table_name)) AS added,
 (SELECT count(*) FROM b WHERE b.environment_id = r.environment_id AND NOT EXISTS (SELECT 1 FROM t WHERE t.run_id = r.run_id AND b.environment_id = t.environment_id AND b.database_name = t.database_name AND b.schema_name = t.schema_name AND b.table_name = t.table_name)) AS removed,
 (SELECT count(*) FROM b JOIN t USING (environment_id, database_name, schema_name, table_name) WHERE t.run_id = r.run_id AND b.environment_id = r.environment_id AND (b.relkind, b.has_primary_key, b.column_count) IS DISTINCT FROM (t.relkind, t.has_primary_key, t.column_count)) AS changed FROM r JOIN bs USING (environment_id)""",
)
def baseline(spark, folder):
    tables = derive.view(spark, folder, "f_table_snapshot")
    first = F.col("environment_id") == "env0"
    baselines = tables.select("environment_id").distinct().select(
        "environment_id",
        F.when(first, "env0-199603").otherwise("env1-199701").alias("baseline_run_id"),
        F.when(first, "").otherwise("BUILDING").alias("scope_database"),
        F.when(first, "").otherwise("public").alias("scope_schema"),
        F.lit("").alias("scope_table"),
    )
    return diff.baseline_diff(tables, baselines)


@REGISTRY.add("dif18_equivalent_keys", derive.ctes("s_constraint") + f" SELECT {TABLE_SQL}, u.constraint_name AS unique_constraint, u.column_list AS columns, p.constraint_name AS primary_key FROM s_constraint u JOIN s_constraint p USING ({TABLE_SQL}, column_list) WHERE u.constraint_type = 'u' AND p.constraint_type = 'p' AND column_list <> ''")
def equivalent(spark, folder):
    return diff.equivalent_keys(DerivedBundle(spark, folder)["constraints"])


COUNTED = """SELECT p_brand AS table_name, count(*) * 40 AS rows FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1"""
COUNTED_COPY = """SELECT p_brand AS table_name, count(*) FILTER (WHERE NOT (p_brand IN ('Brand#1', 'Brand#2') AND l_linenumber = 1)) * 40 + CASE WHEN p_brand = 'Brand#3' THEN 900 ELSE 0 END AS rows FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#4' GROUP BY 1"""


@REGISTRY.add(
    "dif2_definition_fingerprints",
    derive.ctes("s_function") + """ SELECT environment_id, run_id, database_name, function_name, sha256('{"schema_name":"' || schema_name || '","function_name":"' || function_name || '","owner":"' || lower(owner) || '","definition":"' || lower(trim(regexp_replace(config, ' +', ' ', 'g'))) || '"}') AS fingerprint FROM s_function""",
)
def definitions(spark, folder):
    functions = derive.view(spark, folder, "s_function").withColumnRenamed("config", "definition")
    found = diff.definition_fingerprints(functions, "schema_name", "function_name", "owner")
    return found.select("environment_id", "run_id", "database_name", "function_name", "fingerprint")


@REGISTRY.add(
    "dif15_reconcile_counts",
    f"""SELECT table_name, e.rows AS expected_rows, coalesce(a.rows, 0) AS actual_rows, CASE WHEN abs(e.rows - coalesce(a.rows, 0)) > 1000 AND abs(e.rows - coalesce(a.rows, 0)) / e.rows > 0.005 THEN 'diverged' ELSE 'ok' END AS status, 'medium' AS check_severity FROM ({COUNTED}) e LEFT JOIN ({COUNTED_COPY}) a USING (table_name)""",
)
def counts(spark, folder):
    derive.register_tables(spark, folder, ["lineitem", "part"])
    return reconcile.reconcile_counts(spark.sql(COUNTED), spark.sql(COUNTED_COPY), ["table_name"])


@REGISTRY.add("dif16_reconcile_inventory", derive.ctes("f_object") + " SELECT object_type, object_key, 'inventory' AS kind, 'high' AS check_severity FROM f_object s WHERE side = 'source' AND NOT EXISTS (SELECT 1 FROM f_object t WHERE t.side = 'target' AND t.object_type = s.object_type AND lower(t.object_key) = lower(s.object_key))")
def inventory(spark, folder):
    source, target = sides(spark, folder)
    return reconcile.reconcile_inventory(source.select("object_type", "object_key"), target)


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]
HASH_TEXT = "concat_ws(chr(31), " + ", ".join(f"CAST({c} AS VARCHAR)" for c in LINE_COLUMNS) + ")"


def hash_sql(where: str) -> str:
    return f"(SELECT l_linestatus, l_returnflag AS part_of, concat_ws('-', count(*), sum(('0x' || substr(h, 1, 15))::BIGINT), bit_xor(('0x' || substr(h, 17, 15))::BIGINT)) AS hash FROM (SELECT l_linestatus, l_returnflag, md5({HASH_TEXT}) AS h FROM lineitem WHERE {where}) GROUP BY ALL)"


@REGISTRY.add(
    "dif17_reconcile_sample_hash",
    f"SELECT l_linestatus, part_of, o.hash AS origin_hash, c.hash AS copy_hash, CASE WHEN o.hash IS NOT DISTINCT FROM c.hash THEN 'ok' ELSE 'diverged' END AS status, 'high' AS check_severity FROM {hash_sql('true')} o FULL JOIN {hash_sql('NOT (l_returnflag = $$A$$ AND l_partkey % 3 = 0)')} c USING (l_linestatus, part_of)",
)
def hashes(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("part_of", F.col("l_returnflag"))
    copy = lines.where("NOT (l_returnflag = 'A' AND l_partkey % 3 = 0)")
    return reconcile.reconcile_rows(lines, copy, ["l_linestatus", "part_of"], LINE_COLUMNS)


COPIED = "SELECT * REPLACE (CASE WHEN l_orderkey % 97 = 0 AND l_linenumber = 2 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity) FROM lineitem WHERE NOT (l_orderkey % 101 = 0 AND l_linenumber = 1) UNION ALL SELECT * REPLACE (l_orderkey + 90000000 AS l_orderkey) FROM lineitem WHERE l_orderkey % 103 = 0"
LINE_KEY = ["l_orderkey", "l_linenumber"]


@REGISTRY.add(
    "dif17_differing_keys",
    f"""WITH c AS ({COPIED}), o AS (SELECT l_orderkey, l_linenumber, list(l_quantity ORDER BY l_quantity) AS q FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey, l_linenumber, list(l_quantity ORDER BY l_quantity) AS q FROM c GROUP BY ALL)
 SELECT l_orderkey, l_linenumber, CASE WHEN k.q IS NULL THEN 'only_origin' WHEN o.q IS NULL THEN 'only_copy' ELSE 'changed' END AS state FROM o FULL JOIN k USING (l_orderkey, l_linenumber) WHERE o.q IS DISTINCT FROM k.q""",
)
def differing(spark, folder):
    lines = table(spark, folder, "lineitem")
    grown = F.when((F.col("l_orderkey") % 97 == 0) & (F.col("l_linenumber") == 2), F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    kept = lines.where(~((F.col("l_orderkey") % 101 == 0) & (F.col("l_linenumber") == 1))).withColumn("l_quantity", grown)
    added = lines.where(F.col("l_orderkey") % 103 == 0).withColumn("l_orderkey", F.col("l_orderkey") + 90000000)
    return reconcile.differing_keys(lines, kept.unionByName(added), LINE_KEY, lines.columns)


CHECKED = f"""rc AS (SELECT DISTINCT 'env' || (o_custkey % 5) AS environment_id, 'run1' AS run_id, 'drill' || o_orderkey AS drill_id, 'drill' AS kind, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'ok' END AS status, CAST(NULL AS VARCHAR) AS check_severity, '' AS checked_table FROM orders
 UNION ALL SELECT 'env0', 'run1', 'drill0', 'count', CASE WHEN abs(e.rows - coalesce(a.rows, 0)) > 1000 AND abs(e.rows - coalesce(a.rows, 0)) / e.rows > 0.005 THEN 'diverged' ELSE 'ok' END, 'medium', table_name FROM ({COUNTED}) e LEFT JOIN ({COUNTED_COPY}) a USING (table_name))"""
DRILL = dict(kind="environment", key="environment_id", database="''", schema="''", name="''")


def restore_rule(rule_id, when, severity, title, evidence):
    stored = f"'{rule_id}|' || environment_id || '|' || drill_id"
    sql = f"WITH {CHECKED} " + finding_sql(rule_id, "rc", when, severity, title=title, evidence=evidence, **DRILL)
    head, tail = sql.split("substr(sha256('" + rule_id)
    sql = head + stored + " AS dedup_key FROM rc" + tail.split("AS dedup_key FROM rc", 1)[1]

    @REGISTRY.add("rule_" + rule_id.replace(".", "_"), sql)
    def run(spark, folder):
        drills = table(spark, folder, "orders").select(
            F.concat(F.lit("env"), (F.col("o_custkey") % 5).cast("string")).alias("environment_id"),
            F.lit("run1").alias("run_id"),
            F.concat(F.lit("drill"), F.col("o_orderkey").cast("string")).alias("drill_id"),
            F.lit("drill").alias("kind"),
            F.when(F.col("o_orderstatus") == "P", "failed").otherwise("ok").alias("status"),
            F.lit(None).cast("string").alias("check_severity"),
            F.lit("").alias("checked_table"),
        )
        checks = counts(spark, folder).select(
            F.lit("env0").alias("environment_id"), F.lit("run1").alias("run_id"), F.lit("drill0").alias("drill_id"),
            F.lit("count").alias("kind"), "status", "check_severity", F.col("table_name").alias("checked_table"),
        )
        return analysis.run_rule({"restore_checks": drills.unionByName(checks)}, rule_id, DEFAULTS)


restore_rule("backup.restore_failed", "kind = 'drill' AND status = 'failed'", "critical", "'Ensaio de restauração falhou'", {"drill_id": "drill_id"})
restore_rule("backup.restore_divergence", "kind <> 'drill' AND status = 'diverged'", "CASE WHEN true THEN check_severity END", "'Divergência na restauração: ' || checked_table", {"drill_id": "drill_id", "table": "checked_table", "kind": "kind"})


FLEET_VALUES = """v AS (SELECT environment_id, 'postgres' AS name, server_version AS value FROM s_server UNION ALL SELECT environment_id, 'timescaledb', timescale_version FROM s_server
 UNION ALL SELECT environment_id, 'extension ' || extension, string_agg(DISTINCT version, ',' ORDER BY version) FROM s_extension WHERE extension <> '' GROUP BY ALL UNION ALL SELECT environment_id, 'setting ' || setting, value FROM s_setting WHERE setting <> 'other'),
 cl AS (SELECT fleet, v.name, value, count(DISTINCT environment_id) AS members, min(environment_id) AS example FROM s_server JOIN v USING (environment_id) WHERE value <> '' GROUP BY ALL),
 dc AS (SELECT *, count(*) OVER (PARTITION BY fleet, name) AS values_seen FROM cl QUALIFY values_seen > 1)"""


def fleet_values(b):
    servers = b["servers"]
    versions = F.explode(F.array(F.struct(F.lit("postgres").alias("name"), F.col("server_version").alias("value")), F.struct(F.lit("timescaledb").alias("name"), F.col("timescale_version").alias("value"))))
    found = servers.select("environment_id", versions.alias("v")).select("environment_id", "v.name", "v.value")
    named = environments.extension_versions(b["extensions"]).withColumn("name", F.concat(F.lit("extension "), "name"))
    settings = b["settings"].where(F.col("setting").isin(*environments.COMPARED_SETTINGS))
    return found.unionByName(named).unionByName(settings.select("environment_id", F.concat(F.lit("setting "), "setting").alias("name"), "value"))


@REGISTRY.add("config_drift_classes", derive.ctes("s_server", "s_extension", "s_setting") + f", {FLEET_VALUES} SELECT * FROM dc")
def drift_classes(spark, folder):
    b = DerivedBundle(spark, folder)
    return environments.drift_classes(b["servers"], fleet_values(b))


@REGISTRY.add(
    "config_drift_pairs",
    derive.ctes("s_server", "s_extension", "s_setting") + f", {FLEET_VALUES} SELECT dc.fleet, dc.name, o.value AS own, dc.value AS other, members, example FROM dc JOIN s_server s ON s.fleet = dc.fleet AND s.environment_id = 'env1' JOIN v o ON o.name = dc.name AND o.environment_id = 'env1' AND o.value <> dc.value",
)
def drift_pairs(spark, folder):
    b = DerivedBundle(spark, folder)
    values = fleet_values(b)
    return environments.drift_pairs(environments.drift_classes(b["servers"], values), b["servers"], values, "env1")
