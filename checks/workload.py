"""Run picking, workload windows, regressions and histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, scratch
from checks.bundle import DerivedBundle
from checks.logs import STRIPPED
from checks.rules import finding_sql
from plumbline.operators import workload as wl
from plumbline.operators.rules.base import DEFAULTS, match
from plumbline.plans import analysis, derive
from plumbline.plans.digest import compare_periods
from plumbline.sources import runs as run_source, snapshots

REGISTRY = Registry()
RUN_SQL = derive.ctes("f_run")
LATEST = "row_number() OVER (PARTITION BY environment_id ORDER BY started_at DESC, run_id DESC) = 1"


def runs(spark, folder):
    return derive.view(spark, folder, "f_run")


SELECTED = derive.ctes("f_table_snapshot") + " SELECT run_id, count(*) AS tables, CAST(sum(total_size_bytes) AS BIGINT) AS bytes FROM f_table_snapshot WHERE environment_id = 'env1' AND run_id IN ('env1-199601', 'env1-199602') GROUP BY ALL"


@REGISTRY.add("src1_read_snapshots", SELECTED)
def read_snapshots(spark, folder):
    wanted = snapshots.select_runs(
        derive.view(spark, folder, "f_table_snapshot"), environments=["env1"], runs=["env1-199601", "env1-199602"]
    )
    return wanted.groupBy("run_id").agg(F.count(F.lit(1)).alias("tables"), F.sum("total_size_bytes").alias("bytes"))


@REGISTRY.add("src1_read_partitions", SELECTED)
def read_partitions(spark, folder):
    """The snapshot table appended in the shared folder, of which only the wanted partitions are read."""
    root = scratch(spark, "snapshots")
    rows = derive.view(spark, folder, "f_table_snapshot")
    snapshots.append_snapshot(rows, root, "table_snapshot", ["environment_id", "run_id", "database_name", "schema_name", "table_name"])
    found = snapshots.read_snapshots(spark, root, ["table_snapshot"], ["env1"], ["env1-199601", "env1-199602"])["table_snapshot"]
    return found.groupBy("run_id").agg(F.count(F.lit(1)).alias("tables"), F.sum("total_size_bytes").alias("bytes"))


@REGISTRY.add("src7_latest_run", RUN_SQL + f" SELECT * FROM f_run WHERE status IN ('success', 'partial_success') QUALIFY {LATEST}")
def latest(spark, folder):
    return run_source.latest_run(runs(spark, folder))


@REGISTRY.add("src8_latest_complete_run", derive.ctes("f_run", "f_coverage") + f" SELECT * FROM f_run WHERE status = 'success' AND analysis_status = 'success' AND NOT EXISTS (SELECT 1 FROM f_coverage c WHERE c.run_id = f_run.run_id AND c.environment_id = f_run.environment_id AND c.status = 'failed') QUALIFY {LATEST}")
def latest_complete(spark, folder):
    return run_source.latest_complete_run(runs(spark, folder), derive.view(spark, folder, "f_coverage"))


PREVIOUS = """pairs AS (SELECT * EXCLUDE (b), coalesce(b > lag(b) OVER (PARTITION BY environment_id ORDER BY started_at), false) AS gap FROM (SELECT *, lag(run_id) OVER (PARTITION BY environment_id ORDER BY started_at) AS previous_run_id,
 lag(started_at) OVER (PARTITION BY environment_id ORDER BY started_at) AS previous_started_at, (SELECT count(*) FROM f_run x WHERE x.environment_id = r.environment_id AND x.status <> 'success' AND x.started_at < r.started_at) AS b FROM f_run r WHERE status = 'success'))"""


@REGISTRY.add("src9_previous_complete_run", RUN_SQL + f", {PREVIOUS} SELECT * FROM pairs")
def previous(spark, folder):
    return run_source.previous_runs(runs(spark, folder))


@REGISTRY.add("snk2_append_snapshot", derive.ctes("f_table_snapshot") + """ SELECT environment_id, run_id, table_name, database_name, schema_name FROM f_table_snapshot WHERE run_id = 'env0-199605' OR run_id = 'env0-199604' AND has_primary_key = false""")
def append(spark, folder):
    tables = derive.view(spark, folder, "f_table_snapshot").where("run_id IN ('env0-199604', 'env0-199605')")
    stored = tables.where("run_id = 'env0-199604' AND has_primary_key")
    fresh = snapshots.new_rows(tables, stored, ["environment_id", "run_id", "database_name", "schema_name", "table_name"])
    return fresh.select("environment_id", "run_id", "table_name", "database_name", "schema_name")


@REGISTRY.add("snk2_publish_snapshot", derive.ctes("f_table_snapshot") + """ SELECT DISTINCT environment_id, run_id, database_name, schema_name, table_name FROM f_table_snapshot WHERE run_id IN ('env0-199604', 'env0-199605')""")
def publish(spark, folder):
    """One writer dies before it publishes, one repeats its call, one comes too late with other rows."""
    root, keys = scratch(spark, "snapshots"), ["environment_id", "run_id", "database_name", "schema_name", "table_name"]
    tables = derive.view(spark, folder, "f_table_snapshot").select(*keys)
    first, second = (tables.where(F.col("run_id") == run) for run in ("env0-199604", "env0-199605"))
    snapshots.stage_runs(second.where("table_name LIKE '%1'"), root, "tables", keys)
    snapshots.publish_snapshot(first, root, "tables", keys)
    late = snapshots.stage_runs(second.where("table_name LIKE '%2'"), root, "tables", keys)
    for _ in range(2):
        snapshots.publish_snapshot(first.unionByName(second), root, "tables", keys)
    snapshots.publish_runs(spark, root, "tables", late)
    return snapshots.read_published(spark, root, "tables").select(*keys)


STATEMENT = """SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'SELECT a, 1.5 FROM Sales.Orders JOIN crm.people ON id = ' || CAST(user_id AS STRING) || ' -- note' WHEN 1 THEN 'UPDATE app.t' || CAST(user_id % 9 AS STRING) || ' SET x = ''it''''s'' /* c */ WHERE k=' || CAST(event_id AS STRING)
 WHEN 2 THEN 'insert into plain values (1,  2)' WHEN 3 THEN 'WITH q AS (select 1) SELECT * from q join app.t' || CAST(user_id % 9 AS STRING) ELSE 'delete from logs.rows where note = $tag$x 1$tag$' END AS query FROM events"""


@REGISTRY.add(
    "wl1_sql_fingerprint",
    f"""SELECT event_id, txt AS fingerprint_text, 'sha256:' || sha256(txt) AS fingerprint, CASE WHEN split_part(txt, ' ', 1) IN ('select', 'insert', 'update', 'delete') THEN split_part(txt, ' ', 1) ELSE 'other' END AS query_kind,
 array_to_string(list_sort(list_distinct(regexp_extract_all(txt, '\\b(?:from|join|update|into)\\s+([a-z_][\\w$]*\\.[a-z_][\\w$]*)', 1))), ',') AS objects FROM (SELECT event_id, {STRIPPED.replace('{c}', 'query')} AS txt FROM ({STATEMENT}))""",
)
def fingerprints(spark, folder):
    derive.register_tables(spark, folder, ["events"])
    found = wl.sql_fingerprint(spark.sql(STATEMENT))
    return found.select("event_id", "fingerprint_text", "fingerprint", "query_kind", F.concat_ws(",", "referenced_objects").alias("objects"))


def points(spark, folder):
    return derive.view(spark, folder, "f_workload_run")


EDGES = "edges AS (SELECT * FROM f_workload_run WHERE completeness = 'complete' AND run_status = 'success')"


@REGISTRY.add("wl2_complete_edges", derive.ctes("f_workload_run") + f", {EDGES} SELECT environment_id, run_id FROM edges")
def edges(spark, folder):
    return wl.complete_edges(points(spark, folder)).select("environment_id", "run_id")


def island_sql(source: str, name: str) -> str:
    return f"""{name}_m AS (SELECT *, CASE WHEN lag(run_id) OVER w IS NOT NULL AND (stats_reset IS DISTINCT FROM lag(stats_reset) OVER w OR workload_reset IS DISTINCT FROM lag(workload_reset) OVER w) THEN 1 ELSE 0 END AS r FROM {source} WINDOW w AS (PARTITION BY environment_id ORDER BY started_at)),
 {name}_i AS (SELECT environment_id, island, count(*) AS edges, arg_min(run_id, started_at) AS first_run_id, min(started_at) AS first_at, arg_max(run_id, started_at) AS last_run_id, max(started_at) AS last_at FROM (SELECT *, sum(r) OVER (PARTITION BY environment_id ORDER BY started_at) AS island FROM {name}_m) GROUP BY ALL HAVING count(*) >= 2),
 {name} AS (SELECT environment_id, edges, first_run_id, first_at, last_run_id, last_at FROM (SELECT *, row_number() OVER (PARTITION BY environment_id ORDER BY edges DESC, last_at DESC) AS p FROM {name}_i) WHERE p = 1)"""


@REGISTRY.add("wl3_reset_free_subwindow", derive.ctes("f_workload_run") + f", {EDGES}, {island_sql('edges', 'best')} SELECT * FROM best")
def subwindow(spark, folder):
    return wl.reset_free_window(wl.complete_edges(points(spark, folder)))


@REGISTRY.add(
    "wl4_window_gap",
    derive.ctes("f_workload_run") + f", {EDGES}, {island_sql('edges', 'best')} SELECT environment_id, edges, first_run_id, first_at, last_run_id, last_at, (SELECT count(*) FROM edges e WHERE e.environment_id = best.environment_id) AS all_edges, CASE WHEN last_at - first_at > INTERVAL 20 DAY THEN 'gap' ELSE '' END AS reason, edges < (SELECT count(*) FROM edges e WHERE e.environment_id = best.environment_id) AS used_subwindow FROM best",
)
def gaps(spark, folder):
    return wl.resolve_windows(points(spark, folder), max_gap_days=20.0)


HALVES = {"prior": "day(started_at) <= 15", "current": "day(started_at) > 15"}


def window_sql(name: str) -> str:
    half = HALVES[name]
    return f"""{name}_e AS (SELECT * FROM edges WHERE {half}), {island_sql(name + '_e', name + '_w')},
 {name}_d AS (SELECT environment_id, database_name, fingerprint, a.run_id IS NOT NULL AS in_first, b.run_id IS NOT NULL AS in_last,
  {', '.join(f"CASE WHEN b.run_id IS NULL THEN 0 ELSE b.{c} - coalesce(a.{c}, 0) END AS delta_{c}" for c in ('calls', 'total_us', 'blocks_read'))},
  {', '.join(f"coalesce({s}.{c}, 0) AS {n}_{c}" for s, n in (('a', 'first'), ('b', 'last')) for c in ('calls', 'total_us', 'blocks_read'))}
  FROM (SELECT w.* FROM f_workload w JOIN {name}_w x ON x.environment_id = w.environment_id AND x.first_run_id = w.run_id) a FULL JOIN (SELECT w.* FROM f_workload w JOIN {name}_w x ON x.environment_id = w.environment_id AND x.last_run_id = w.run_id) b USING (environment_id, database_name, fingerprint)),
 {name}_a AS (SELECT environment_id, database_name, fingerprint, CASE WHEN NOT in_last THEN first_calls ELSE delta_calls END AS calls, CASE WHEN NOT in_last THEN first_total_us ELSE delta_total_us END AS total_us, (sum(last_total_us) OVER (PARTITION BY environment_id)) AS window_us, delta_calls, in_last FROM {name}_d)"""


DIGEST = derive.ctes("f_workload_run", "f_workload") + f", {EDGES}, {window_sql('prior')}, {window_sql('current')}"
ACTIVE = "(SELECT * EXCLUDE (delta_calls, in_last), CASE WHEN calls > 0 AND total_us > 0 THEN total_us / calls ELSE 0 END AS mean_us FROM {n}_a WHERE NOT in_last OR calls > 0 OR total_us > 0)"
COMPARED = DIGEST + f""", p AS {ACTIVE.replace('{n}', 'prior')}, c AS {ACTIVE.replace('{n}', 'current')},
 m AS (SELECT environment_id, database_name, fingerprint, p.calls IS NOT NULL AS in_prior, c.calls IS NOT NULL AS in_current, coalesce(p.calls, 0) AS prior_calls, coalesce(p.total_us, 0) AS prior_total_us, coalesce(p.mean_us, 0) AS prior_mean_us,
   coalesce(c.calls, 0) AS current_calls, coalesce(c.total_us, 0) AS current_total_us, coalesce(c.mean_us, 0) AS current_mean_us, (SELECT max(window_us) FROM p p2 WHERE p2.environment_id = x.environment_id) AS pw, (SELECT max(window_us) FROM c c2 WHERE c2.environment_id = x.environment_id) AS cw
   FROM (SELECT environment_id, database_name, fingerprint FROM p UNION SELECT environment_id, database_name, fingerprint FROM c) x LEFT JOIN p USING (environment_id, database_name, fingerprint) LEFT JOIN c USING (environment_id, database_name, fingerprint)),
 r AS (SELECT * EXCLUDE (pw, cw), CAST(prior_total_us / pw AS DOUBLE) AS prior_share, CAST(current_total_us / cw AS DOUBLE) AS current_share, CASE WHEN prior_mean_us > 0 THEN (current_mean_us - prior_mean_us) / prior_mean_us ELSE 0 END AS mean_change, CASE WHEN prior_total_us > 0 THEN (current_total_us - prior_total_us) / prior_total_us ELSE 0 END AS total_change FROM m),
 f AS (SELECT *, CASE WHEN in_current AND NOT in_prior AND current_share >= 0.005 THEN 'new' WHEN in_prior AND NOT in_current AND prior_share >= 0.0005 THEN 'gone' WHEN in_prior AND in_current AND prior_calls >= 2 AND current_calls >= 2 AND mean_change >= 0.5 AND current_mean_us - prior_mean_us >= 10000 THEN 'regression' WHEN in_prior AND in_current AND prior_calls >= 2 AND current_calls >= 2 AND mean_change <= -0.3 THEN 'improvement' ELSE 'stable' END AS classification FROM r),
 k AS (SELECT *, CASE classification WHEN 'regression' THEN CASE WHEN total_change >= 1 AND current_share >= 0.002 THEN 'high' ELSE 'medium' END WHEN 'new' THEN 'medium' ELSE 'info' END AS severity FROM f)"""
LIMITS = wl.DigestThresholds(min_calls=2, high_share=0.002, new_share=0.005, gone_share=0.0005)
BY_SIX = [("prior_mean_us", "current_mean_us", "prior_share", "current_share", "mean_change", "total_change")][0]


def deltas(spark, folder, name):
    half = points(spark, folder).where(HALVES[name])
    windows = wl.resolve_windows(half, max_gap_days=wl.digest_max_gap(15))
    return wl.counter_deltas(derive.view(spark, folder, "f_workload"), windows)


def compared(spark, folder):
    workload = derive.view(spark, folder, "f_workload")
    return compare_periods(points(spark, folder), workload, HALVES["prior"], HALVES["current"], 15, thresholds=LIMITS)


def rounded(df):
    for name in BY_SIX:
        df = df.withColumn(name, F.round(name, 6))
    return df


@REGISTRY.add("wl5_counter_deltas", DIGEST + " SELECT * FROM current_d")
def counter_deltas(spark, folder):
    return deltas(spark, folder, "current")


ROUNDED = ", ".join(f"round({c}, 6) AS {c}" for c in BY_SIX)
KEYS = "environment_id, database_name, fingerprint, in_prior, in_current, prior_calls, prior_total_us, current_calls, current_total_us"


@REGISTRY.add("wl6_compare_windows", COMPARED + f" SELECT {KEYS}, {ROUNDED} FROM k")
def compare(spark, folder):
    return rounded(compared(spark, folder)).drop("classification", "severity")


@REGISTRY.add("wl7_classify_query", COMPARED + " SELECT environment_id, classification, severity, count(*) AS statements, CAST(sum(current_total_us) AS BIGINT) AS current_us FROM k GROUP BY ALL")
def classified(spark, folder):
    return compared(spark, folder).groupBy("environment_id", "classification", "severity").agg(
        F.count(F.lit(1)).alias("statements"), F.sum("current_total_us").alias("current_us")
    )


@REGISTRY.add(
    "wl8_top_per_class",
    COMPARED + """ SELECT environment_id, classification, fingerprint, database_name, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY environment_id, classification ORDER BY CASE classification WHEN 'regression' THEN mean_change WHEN 'new' THEN current_total_us WHEN 'gone' THEN prior_total_us ELSE -mean_change END DESC, current_total_us DESC, database_name, fingerprint) AS rank FROM k WHERE classification <> 'stable')
 WHERE rank <= CASE WHEN classification IN ('regression', 'new') THEN 10 ELSE 5 END""",
)
def tops(spark, folder):
    return wl.top_per_class(compared(spark, folder), t=LIMITS).select("environment_id", "classification", "fingerprint", "database_name", "rank")


QUERY_DELTAS = DIGEST + """, q AS (SELECT environment_id, database_name, fingerprint, 'now' AS run_id, delta_calls, delta_total_us, sum(last_total_us) OVER (PARTITION BY environment_id) AS w FROM current_d)"""


@REGISTRY.add(
    "rule_cost_query_expensive",
    QUERY_DELTAS + " " + finding_sql("cost.query_expensive", "q", "delta_total_us / w >= 0.01 AND delta_calls >= 3", "CASE WHEN delta_total_us / w >= 0.025 THEN 'medium' ELSE 'low' END", kind="fingerprint", key="fingerprint", title="'Consulta cara na janela: ' || fingerprint",
     schema="''", name="fingerprint", evidence={"fingerprint": "fingerprint", "share_of_time": "CAST(round(delta_total_us / w, 4) AS DOUBLE)", "delta_calls": "delta_calls"}),
)
def expensive(spark, folder):
    from dataclasses import replace

    from plumbline.functions.keys import ratio

    found = deltas(spark, folder, "current")
    totals = found.groupBy("environment_id").agg(F.sum("last_total_us").alias("window_total_us"))
    rows = found.join(totals, "environment_id").select("*", F.lit("now").alias("run_id"))
    (rule,) = analysis.row_rules(DEFAULTS, "cost.query_expensive")
    share = ratio(F.col("delta_total_us"), F.col("window_total_us"))
    # A tenth of the usual shares, because the derived workload is spread over many statements.
    scaled = replace(
        rule,
        when=(share >= 0.01) & (F.col("delta_calls") >= 3),
        severity=F.when(share >= 0.025, "medium").otherwise("low"),
    )
    return match(rows, scaled)


@REGISTRY.add(
    "wl9_pair_comparable",
    RUN_SQL + f""", {PREVIOUS} SELECT environment_id, run_id, previous_run_id, reason, reason = '' AS comparable FROM (SELECT p.*, CASE WHEN gap THEN 'intermediate_incomplete_run' WHEN previous_started_at IS NULL OR p.started_at - previous_started_at > INTERVAL 40 DAY THEN 'gap_window'
 WHEN p.stats_reset IS DISTINCT FROM o.stats_reset THEN 'stats_reset' ELSE '' END AS reason FROM pairs p LEFT JOIN f_run o ON o.environment_id = p.environment_id AND o.run_id = p.previous_run_id)""",
)
def comparable(spark, folder):
    all_runs = runs(spark, folder)
    before = all_runs.select("environment_id", F.col("run_id").alias("previous_run_id"), F.col("stats_reset").alias("previous_stats_reset"))
    pairs = run_source.previous_runs(all_runs).join(before, ["environment_id", "previous_run_id"], "left")
    return wl.pair_comparable(pairs, max_gap_days=40.0).select("environment_id", "run_id", "previous_run_id", "reason", "comparable")


EVENTS = derive.ctes("f_finding_event") + """, ev AS (SELECT DISTINCT environment_id, run_id, started_at, database_name || '.' || object_name || '/' || title AS dedup_key, severity FROM f_finding_event),
 rn AS (SELECT environment_id, run_id, min(started_at) AS started_at, lag(run_id) OVER (PARTITION BY environment_id ORDER BY min(started_at)) AS previous_run_id FROM ev GROUP BY 1, 2),
 strong AS (SELECT DISTINCT environment_id, run_id, dedup_key FROM ev WHERE severity IN ('high', 'critical')),
 met AS (SELECT environment_id, run_id, count(*) AS strong_findings, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM strong b WHERE b.environment_id = s.environment_id AND b.run_id = 'd3' AND b.dedup_key = s.dedup_key)) AS new_keys FROM strong s GROUP BY ALL)"""


def finding_events(spark, folder):
    key = F.concat_ws("/", F.concat_ws(".", "database_name", "object_name"), "title")
    return derive.view(spark, folder, "f_finding_event").withColumn("dedup_key", key)


def event_pairs(spark, folder):
    found = derive.view(spark, folder, "f_finding_event").groupBy("environment_id", "run_id").agg(F.min("started_at").alias("started_at"))
    return run_source.previous_runs(found, F.lit(True))


def baseline(spark, folder):
    found = derive.view(spark, folder, "f_finding_event").select("environment_id").distinct()
    return found.select("environment_id", F.lit("d3").alias("baseline_run_id"))


@REGISTRY.add("wl10_regressed_findings", EVENTS + " SELECT * FROM met")
def regressed(spark, folder):
    return wl.regressed_findings(finding_events(spark, folder), baseline(spark, folder))


@REGISTRY.add(
    "wl10_persistent_regression",
    EVENTS + """ SELECT *, previous > base AND current > base AS persistent FROM (SELECT r.environment_id, r.run_id, r.previous_run_id, 'd3' AS baseline_run_id, coalesce(b.strong_findings, 0) AS base, coalesce(p.strong_findings, 0) AS previous, coalesce(c.strong_findings, 0) AS current
 FROM rn r LEFT JOIN met b ON b.environment_id = r.environment_id AND b.run_id = 'd3' LEFT JOIN met p ON p.environment_id = r.environment_id AND p.run_id = r.previous_run_id LEFT JOIN met c ON c.environment_id = r.environment_id AND c.run_id = r.run_id WHERE r.previous_run_id IS NOT NULL)""",
)
def persistent(spark, folder):
    base = baseline(spark, folder)
    metric = wl.regressed_findings(finding_events(spark, folder), base)
    return wl.persistent_regression(metric, event_pairs(spark, folder), base)


@REGISTRY.add("wl11_persistent_keys", EVENTS + " SELECT DISTINCT s.environment_id, s.run_id, s.dedup_key AS regression_key FROM strong s JOIN rn USING (environment_id, run_id) JOIN strong p ON p.environment_id = s.environment_id AND p.run_id = rn.previous_run_id AND p.dedup_key = s.dedup_key")
def keys(spark, folder):
    strong = finding_events(spark, folder).where("severity IN ('high', 'critical')")
    return wl.persistent_keys(strong.select("environment_id", "run_id", F.col("dedup_key").alias("regression_key")), event_pairs(spark, folder))


STRUCTURE = """SELECT environment_id, run_id, regression_key FROM (
 SELECT e.environment_id, e.run_id, CASE WHEN c.table_name IS NULL THEN 'table_removed:' ELSE 'table_changed:' END || b.database_name || '.' || b.schema_name || '.' || b.table_name AS regression_key FROM b JOIN rr e USING (environment_id) LEFT JOIN t c ON c.environment_id = b.environment_id AND c.run_id = e.run_id AND c.database_name = b.database_name AND c.schema_name = b.schema_name AND c.table_name = b.table_name
  WHERE c.table_name IS NULL OR (b.relkind, b.has_primary_key, b.column_count) IS DISTINCT FROM (c.relkind, c.has_primary_key, c.column_count)
 UNION ALL SELECT c.environment_id, c.run_id, 'table_added_without_pk:' || c.database_name || '.' || c.schema_name || '.' || c.table_name FROM t c SEMI JOIN rr USING (environment_id, run_id) WHERE NOT c.has_primary_key AND NOT EXISTS (SELECT 1 FROM b WHERE b.environment_id = c.environment_id AND b.database_name = c.database_name AND b.schema_name = c.schema_name AND b.table_name = c.table_name) AND EXISTS (SELECT 1 FROM b WHERE b.environment_id = c.environment_id AND b.database_name = c.database_name)
 UNION ALL SELECT e.environment_id, e.run_id, 'index_removed:' || b.database_name || '.' || b.schema_name || '.pk_' || b.table_name FROM b JOIN rr e USING (environment_id) WHERE b.has_primary_key AND NOT EXISTS (SELECT 1 FROM t c WHERE c.has_primary_key AND c.environment_id = b.environment_id AND c.run_id = e.run_id AND c.database_name = b.database_name AND c.schema_name = b.schema_name AND c.table_name = b.table_name) AND EXISTS (SELECT 1 FROM t c WHERE c.environment_id = b.environment_id AND c.run_id = e.run_id AND c.database_name = b.database_name))"""


@REGISTRY.add(
    "wl12_structure_regression_keys",
    derive.ctes("f_table_snapshot") + """, t AS (SELECT * FROM f_table_snapshot), b AS (SELECT * FROM t WHERE run_id = environment_id || '-199603'), rr AS (SELECT DISTINCT environment_id, run_id FROM t WHERE run_id <> environment_id || '-199603') """ + STRUCTURE,
)
def structure(spark, folder):
    tables = derive.view(spark, folder, "f_table_snapshot").withColumn("is_partition", F.lit(False))
    indexes = tables.where("has_primary_key").select(
        "environment_id", "run_id", "database_name", "schema_name", F.concat(F.lit("pk_"), F.col("table_name")).alias("index_name")
    )
    base = tables.select("environment_id").distinct().withColumn("baseline_run_id", F.concat(F.col("environment_id"), F.lit("-199603")))
    return wl.structure_regression_keys(tables, indexes, base)


@REGISTRY.add(
    "wl13_regression_dedup",
    EVENTS + """, cand AS (SELECT environment_id, run_id, started_at, list_sort(list(dedup_key)) AS keys, count(*) AS current FROM strong JOIN rn USING (environment_id, run_id) GROUP BY ALL),
 last AS (SELECT environment_id, keys, current FROM cand WHERE run_id = 'd10'), healed AS (SELECT DISTINCT c.environment_id FROM cand c JOIN last l USING (environment_id) WHERE c.started_at > TIMESTAMP '2024-01-10' AND c.started_at < TIMESTAMP '2024-01-13' AND len(list_intersect(c.keys, l.keys)) = 0)
 SELECT environment_id, run_id, c.current, CASE WHEN environment_id IN (SELECT * FROM healed) OR len(list_filter(c.keys, lambda k: NOT list_contains(l.keys, k))) > 0 THEN 'recorded' ELSE 'deduplicated' END AS outcome FROM (SELECT * FROM cand UNION ALL SELECT environment_id, 'again', started_at, keys[1:3], 3 FROM cand WHERE run_id = 'd10') c JOIN last l USING (environment_id)""",
)
def dedup(spark, folder):
    strong = finding_events(spark, folder).where("severity IN ('high', 'critical')").select("environment_id", "run_id", "dedup_key", "started_at").distinct()
    cand = strong.groupBy("environment_id", "run_id").agg(
        F.min("started_at").alias("started_at"), F.array_sort(F.collect_list("dedup_key")).alias("keys"), F.count(F.lit(1)).alias("current")
    ).select("*", F.lit("d3").alias("baseline_run_id"), F.lit("workload").alias("category"))
    last = cand.where("run_id = 'd10'")
    alerts = last.select("environment_id", "baseline_run_id", "category", F.col("started_at").alias("created_at"), "current", "keys")
    marked = last.select("environment_id", "baseline_run_id", "category", F.col("started_at").alias("alert_at"), F.lit(0).alias("base_count"), "keys")
    recovered = wl.recovered_regressions(marked, cand.where("started_at < '2024-01-13'"))
    again = last.select("*").withColumn("run_id", F.lit("again")).withColumn("keys", F.slice("keys", 1, 3)).withColumn("current", F.lit(3).cast("bigint"))
    return wl.regression_alerts(cand.unionByName(again), alerts, recovered).select("environment_id", "run_id", "current", "outcome")


@REGISTRY.add(
    "wl14_table_history",
    derive.ctes("f_table_daily", "f_daily_run") + """, p AS (SELECT t.*, r.status, date_trunc('week', collected_at) AS bucket, n_tup_ins + n_tup_upd + n_tup_del AS dml FROM f_table_daily t JOIN f_daily_run r USING (environment_id, run_id)
   QUALIFY row_number() OVER (PARTITION BY environment_id, database_name, schema_name, table_name, date_trunc('week', collected_at) ORDER BY collected_at DESC, run_id DESC) = 1),
 l AS (SELECT *, status = 'success' AND coalesce(lag(status) OVER w = 'success', false) AS ok, lag(total_size_bytes) OVER w AS ps, lag(row_estimate) OVER w AS pr, lag(seq_scan) OVER w AS pq, lag(dml) OVER w AS pd, lag(stats_reset) OVER w AS px FROM p WINDOW w AS (PARTITION BY environment_id, database_name, schema_name, table_name ORDER BY bucket))
 SELECT environment_id, database_name, schema_name, table_name, bucket, run_id, status AS run_status, total_size_bytes, row_estimate, CASE WHEN ok THEN total_size_bytes - ps END AS size_delta, CASE WHEN ok THEN row_estimate - pr END AS row_delta,
 CASE WHEN ok AND NOT z THEN seq_scan - pq END AS seq_scan_delta, CASE WHEN ok AND NOT z THEN dml - pd END AS dml_delta, ok AND z AS counters_reset FROM (SELECT *, coalesce(px IS DISTINCT FROM stats_reset OR seq_scan < pq OR dml < pd, true) AS z FROM l)""",
)
def history(spark, folder):
    return wl.table_history(derive.view(spark, folder, "f_table_daily"), derive.view(spark, folder, "f_daily_run"), "week")


@REGISTRY.add(
    "wl15_storage_history",
    derive.ctes("f_table_snapshot", "f_run") + """, x AS (SELECT t.*, bucket FROM f_table_snapshot t JOIN (SELECT environment_id, run_id, date_trunc('quarter', started_at) AS bucket FROM f_run WHERE status = 'success' QUALIFY row_number() OVER (PARTITION BY environment_id, date_trunc('quarter', started_at) ORDER BY started_at DESC) = 1) r USING (environment_id, run_id))
 """ + " UNION ALL ".join(
        f"SELECT environment_id, bucket, '{s}' AS scope, {e} AS label, CAST(sum(total_size_bytes) AS BIGINT) AS total_size_bytes, CAST(sum(row_estimate) AS BIGINT) AS row_estimate FROM x GROUP BY ALL"
        for s, e in {"environment": "'environment'", "database": "database_name", "schema": "database_name || '.' || schema_name", "table": "database_name || '.' || schema_name || '.' || table_name"}.items()
    ),
)
def storage(spark, folder):
    return wl.storage_history(derive.view(spark, folder, "f_table_snapshot"), runs(spark, folder), "quarter")


@REGISTRY.add("wl16_query_kind_rules", derive.ctes("s_query") + """ SELECT query_kind, count(*) FILTER (WHERE mean_exec_ms >= 500 AND calls >= 10) AS slow, count(*) FILTER (WHERE o AND calls >= 10 AND query_kind = 'select' AND calls >= 100 AND shared_blocks_read >= 1000 AND shared_blocks_read > shared_blocks_hit) AS scan,
 count(*) FILTER (WHERE o AND query_kind IN ('insert', 'update') AND calls >= 1000) AS write, count(*) FILTER (WHERE o AND calls >= 10 AND total_exec_ms >= 60000) AS cost FROM (SELECT *, evidence_quality = 'object_reference' AND object_list NOT LIKE '%,%' AND object_list LIKE '%.%' AS o FROM s_query) GROUP BY ALL""")
def kinds(spark, folder):
    queries = DerivedBundle(spark, folder)["queries"]
    bundle = {"queries": queries, "indexes": None, "tables": None}
    slow = analysis.run_rule(bundle, "performance.slow_query")
    patterns = analysis.run_rule(bundle, "performance.workload")
    found = slow.select("rule_id", "evidence").unionByName(patterns.select("rule_id", "evidence"))
    named = found.select("rule_id", F.get_json_object("evidence", "$.query_fingerprint").alias("fingerprint"))
    joined = queries.select("fingerprint", "query_kind").join(named, "fingerprint", "left")
    return joined.groupBy("query_kind").agg(
        *[
            F.count_if(F.col("rule_id") == rule).alias(name)
            for name, rule in {
                "slow": "performance.slow_query",
                "scan": "performance.workload_scan",
                "write": "performance.workload_write",
                "cost": "performance.workload_cost",
            }.items()
        ]
    )
