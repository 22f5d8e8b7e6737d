"""Cost, retention what-if and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, table, scratch
from checks.bundle import DerivedBundle
from checks.rules import BLOAT
from checks.workload import DIGEST, deltas
from plumbline.operators import cost, retention as ret
from plumbline.operators.rules.environments import bloat
from plumbline.plans import derive
from plumbline.sources.export import export_csv, export_rows

REGISTRY = Registry()
NOW = "1999-07-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def prices(spark, folder):
    cents = {"storage_gb_month": "storage_cents", "instance_month": "instance_cents", "io_gb": "io_gb_cents", "vcpu_hour": "vcpu_hour_cents"}
    found = derive.view(spark, folder, "s_price")
    for name, source in cents.items():
        found = found.withColumn(name, F.col(source) / F.lit(100.0))
    return found.withColumn("io_million", F.lit(None).cast("double")).drop(*cents.values())


PRICES = "pv AS (SELECT environment_id, version, currency, storage_cents / 100 AS sp, instance_cents / 100 AS ip, io_gb_cents / 100 AS gp, vcpu_hour_cents / 100 AS vp, effective_from FROM s_price QUALIFY row_number() OVER (PARTITION BY environment_id ORDER BY version DESC) = 1)"


@REGISTRY.add("cst1_current_price", derive.ctes("s_price") + f", {PRICES} SELECT environment_id, CAST(version AS BIGINT) AS version, currency, sp AS storage_gb_month, ip AS instance_month, gp AS io_gb, effective_from FROM pv")
def current_price(spark, folder):
    return cost.current_price(prices(spark, folder)).select("environment_id", "version", "currency", "storage_gb_month", "instance_month", "io_gb", "effective_from")


@REGISTRY.add(
    "cst1_price_as_of",
    derive.ctes("f_run", "s_price") + """ SELECT environment_id, run_id, version AS price_version, storage_cents / 100 AS price_storage_gb_month FROM (SELECT r.environment_id, r.run_id, version, storage_cents, row_number() OVER (PARTITION BY r.environment_id, r.run_id ORDER BY effective_from DESC, version DESC) AS p FROM f_run r LEFT JOIN s_price p ON p.environment_id = r.environment_id AND p.effective_from <= r.started_at) WHERE p = 1""",
)
def as_of(spark, folder):
    runs = derive.view(spark, folder, "f_run").select("environment_id", "run_id", "started_at")
    return cost.price_as_of(runs, prices(spark, folder), "started_at").select("environment_id", "run_id", "price_version", "price_storage_gb_month")


MONEY = "round({e} * 100) / 100"
TABLE_KEY = "database_name || '.' || schema_name || '.' || table_name"


def item_sql(kind, frm, key, size, where="true"):
    amount = MONEY.replace("{e}", f"({size}) / CAST(1e9 AS DOUBLE) * sp")
    return f"SELECT environment_id, run_id, '{kind}' AS cost_type, {key} AS object_key, CAST({size} AS BIGINT) AS size_bytes, {amount} AS month_amount, currency FROM {frm} LEFT JOIN pv USING (environment_id) WHERE {where}"


STORAGE = item_sql("storage", "s_table", TABLE_KEY, "total_size_bytes")
BLOATED = item_sql("bloat", BLOAT, TABLE_KEY, "waste", "waste / total_size_bytes >= 0.3 AND waste >= 1073741824 AND row_estimate > 0")
UNUSED = item_sql("unused_index", "f_index_snapshot", "index_name", "size_bytes", "size_bytes >= 104857600 AND NOT is_unique")
QUERY = """SELECT environment_id, 'now' AS run_id, 'query' AS cost_type, fingerprint AS object_key, CAST(0 AS BIGINT) AS size_bytes, CASE WHEN currency IS NOT NULL THEN round((coalesce(ip * sh, vp * 730 * sh, 0) + coalesce(delta_blocks_read * 8192 / CAST(1e9 AS DOUBLE) * gp, 0)) * 100) / 100 END AS month_amount, currency
 FROM (SELECT *, CASE WHEN delta_total_us > 0 THEN delta_total_us / (sum(last_total_us) OVER (PARTITION BY environment_id)) ELSE 0 END AS sh FROM current_d) LEFT JOIN pv USING (environment_id)"""


@REGISTRY.add("cst2_storage_cost", derive.ctes("s_table", "s_price") + f", {PRICES} {STORAGE}")
def storage(spark, folder):
    return cost.storage_cost(derive.view(spark, folder, "s_table"), prices(spark, folder))


@REGISTRY.add("cst3_bloat_estimate", derive.ctes("s_table", "s_column", "s_price") + f", {PRICES} {BLOATED}")
def bloated(spark, folder):
    b = DerivedBundle(spark, folder)
    return cost.bloat_cost(bloat(b["tables"], b["column_stats"]), prices(spark, folder))


def unused(spark, folder):
    usage = derive.view(spark, folder, "f_index_snapshot").where("NOT is_unique")
    seen = usage.select(
        "environment_id", "run_id", F.col("index_name").alias("object_key"), "size_bytes",
        F.lit("2000-01-01").cast("timestamp").alias("first_seen_at"), F.lit("2000-02-01").cast("timestamp").alias("last_seen_at"),
    )
    return cost.unused_index_cost(seen, prices(spark, folder))


def query_items(spark, folder):
    found = deltas(spark, folder, "current").withColumn("run_id", F.lit("now"))
    return cost.query_cost(found, prices(spark, folder))


@REGISTRY.add("cst4_query_cost", DIGEST.replace("WITH ", derive.ctes("s_price") + ", ", 1) + f", {PRICES} {QUERY}")
def query(spark, folder):
    return query_items(spark, folder)


ITEMS = derive.ctes("s_table", "s_column", "s_price", "f_index_snapshot") + f", {PRICES}, items AS ({STORAGE} UNION ALL {BLOATED} UNION ALL {UNUSED})"


def items(spark, folder):
    return storage(spark, folder).unionByName(bloated(spark, folder)).unionByName(unused(spark, folder))


@REGISTRY.add("cst5_cost_ranking", ITEMS + " SELECT *, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY environment_id, run_id ORDER BY month_amount DESC NULLS LAST, size_bytes DESC, cost_type, object_key) AS rank FROM items) WHERE rank <= 10".replace("SELECT *, CAST(rank AS INTEGER) AS rank FROM", "SELECT * REPLACE (CAST(rank AS INTEGER) AS rank) FROM"))
def ranking(spark, folder):
    return cost.cost_ranking(items(spark, folder))


SUMS = ", ".join(f"CAST(coalesce(sum(CAST(round(month_amount * 100) AS BIGINT)) FILTER (WHERE cost_type = '{t}'), 0) AS BIGINT) / 100 AS {t}_month" for t in cost.COST_TYPES)


@REGISTRY.add("cst5_cost_totals", ITEMS + f" SELECT environment_id, {SUMS}, bool_or(month_amount IS NOT NULL) AS priced FROM items GROUP BY environment_id")
def totals(spark, folder):
    return cost.cost_totals(items(spark, folder), "environment_id")


@REGISTRY.add(
    "cst6_cost_series",
    derive.ctes("f_table_snapshot", "f_run", "s_price") + f", {PRICES}, items AS ({item_sql('storage', '(SELECT * EXCLUDE (started_at) FROM f_table_snapshot)', TABLE_KEY, 'total_size_bytes')}) SELECT environment_id, run_id, started_at, {SUMS}, bool_or(month_amount IS NOT NULL) AS priced FROM items JOIN f_run USING (environment_id, run_id) WHERE started_at BETWEEN TIMESTAMP '1999-05-15' - INTERVAL 90 DAY AND TIMESTAMP '1999-05-15' GROUP BY ALL",
)
def series(spark, folder):
    found = cost.storage_cost(derive.view(spark, folder, "f_table_snapshot"), prices(spark, folder))
    return cost.cost_series(found, derive.view(spark, folder, "f_run"), F.lit("1999-05-15"))


HYPER = "environment_id, run_id, database_name, schema_name, hypertable_name"
RATIO = f"rt AS (SELECT {HYPER}, coalesce(sum(before_bytes) FILTER (WHERE is_compressed) / sum(after_bytes) FILTER (WHERE is_compressed), 5) AS ratio, count(*) FILTER (WHERE is_compressed) > 0 AS observed FROM f_chunk GROUP BY ALL)"


def chunks(spark, folder):
    return derive.view(spark, folder, "f_chunk").withColumn("integer_range", F.col("hypertable_name").endswith("9"))


@REGISTRY.add("ret1_compression_ratio", derive.ctes("f_chunk") + f", {RATIO} SELECT {HYPER}, CAST(ratio AS DOUBLE) AS observed_ratio, observed FROM rt")
def ratio(spark, folder):
    return ret.compression_ratio(chunks(spark, folder))


AGE = f"greatest(0, CAST(floor(epoch(TIMESTAMP '{NOW}' - range_end) / 86400) AS BIGINT))"


@REGISTRY.add("ret2_age_buckets", derive.ctes("f_chunk") + f" SELECT {HYPER}, CASE WHEN {AGE} <= 7 THEN '0-7d' WHEN {AGE} <= 30 THEN '7-30d' WHEN {AGE} <= 90 THEN '30-90d' WHEN {AGE} <= 365 THEN '90-365d' ELSE '>365d' END AS age_band, count(*) AS chunks, CAST(sum(total_size_bytes) AS BIGINT) AS bytes FROM f_chunk GROUP BY ALL")
def ages(spark, folder):
    return ret.age_buckets(chunks(spark, folder), now())


SCENARIOS = (ret.Scenario("keep", 0, 0), ret.Scenario("year", 365, 30), ret.Scenario("quarter", 90, 7), ret.Scenario("squeeze", 0, 7), ret.Scenario("wrong", -1, 7), ret.Scenario("half", 180, 14))
CASES = "sn AS (SELECT * FROM (VALUES " + ", ".join(f"('{s.label}', {s.retention_days}, {s.compress_after_days})" for s in SCENARIOS) + ") v(label, retention_days, compress_after_days))"
OLD = "hypertable_name NOT LIKE '%9' AND retention_days >= 0 AND {d} > 0 AND range_end <= TIMESTAMP '" + NOW + "' - to_days(CAST({d} AS INTEGER))"
DROPPED, SQUEEZED = OLD.replace("{d}", "retention_days"), "NOT is_compressed AND " + OLD.replace("{d}", "compress_after_days")
GROWTH = "gr AS (SELECT *, CASE WHEN hypertable_name LIKE '%1' THEN 1000000 ELSE 0 END AS g FROM (SELECT DISTINCT " + HYPER + " FROM f_chunk))"
CHUNKS_X = f"cx AS (SELECT c.*, sn.*, ratio, observed, {DROPPED} AS gone, {SQUEEZED} AS sq FROM f_chunk c JOIN rt USING ({HYPER}) CROSS JOIN sn)"


@REGISTRY.add(
    "ret3_simulate_retention",
    derive.ctes("f_chunk") + f""", {RATIO}, {CASES}, {GROWTH}, {CHUNKS_X} SELECT *, greatest(0, current_bytes - bytes_after) AS bytes_saved, bytes_after + g * 30 AS projection_30_bytes, bytes_after + g * 90 AS projection_90_bytes, bytes_after + g * 180 AS projection_180_bytes FROM (SELECT {HYPER}, label, retention_days, compress_after_days, CAST(sum(total_size_bytes) AS BIGINT) AS current_bytes,
 CAST(sum(CASE WHEN gone THEN 0 WHEN sq THEN CAST(round(total_size_bytes / ratio) AS BIGINT) ELSE total_size_bytes END) AS BIGINT) AS bytes_after FROM cx GROUP BY ALL) JOIN gr USING ({HYPER})""".replace("SELECT *, greatest", "SELECT * EXCLUDE (g), greatest"),
)
def simulate(spark, folder):
    rate = F.when(F.col("hypertable_name").endswith("1"), 1000000).otherwise(0).cast("bigint")
    growth = chunks(spark, folder).select(*ret.HYPERTABLE).distinct().withColumn("growth_per_day", rate)
    return ret.simulate_retention(chunks(spark, folder), growth, SCENARIOS, now())


DEPENDENT = "dp AS (SELECT environment_id, run_id, database_name, source_schema AS schema_name, source_name AS hypertable_name, view_name, has_refresh_policy, refresh_window_days * 10 AS w FROM s_cagg)"


@REGISTRY.add(
    "ret3_scenario_risks",
    derive.ctes("f_chunk", "s_cagg") + f""", {RATIO}, {CASES}, {CHUNKS_X}, {DEPENDENT} SELECT {HYPER}, label, CASE WHEN has_refresh_policy THEN 'retention_cagg_conflict:' ELSE 'retention_cagg_no_refresh:' END || view_name AS risk FROM dp CROSS JOIN sn WHERE retention_days > 0 AND (NOT has_refresh_policy OR (w > 0 AND retention_days < w))
 UNION SELECT {HYPER}, label, 'compress_active_write:' || chunk_name FROM cx WHERE sq AND NOT gone AND dead_tuples > 0 UNION SELECT {HYPER}, label, 'low_confidence_ratio' FROM cx WHERE compress_after_days > 0 AND NOT observed UNION SELECT {HYPER}, label, 'invalid_scenario' FROM cx WHERE label = 'wrong'""",
)
def risks(spark, folder):
    dependents = derive.view(spark, folder, "s_cagg").select(
        "environment_id", "run_id", "database_name", F.col("source_schema").alias("schema_name"), F.col("source_name").alias("hypertable_name"),
        "view_name", "has_refresh_policy", (F.col("refresh_window_days") * 10).alias("refresh_window_days"),
    )
    return ret.scenario_risks(chunks(spark, folder), dependents, SCENARIOS, now())


@REGISTRY.add(
    "ret4_growth_per_day",
    derive.ctes("f_table_daily", "f_daily_run") + """ SELECT environment_id, run_id, database_name, schema_name, table_name AS hypertable_name, CASE WHEN d BETWEEN 0.5 AND 14 AND total_size_bytes > p THEN CAST(floor((total_size_bytes - p) / d) AS BIGINT) ELSE 0 END AS growth_per_day FROM (SELECT t.*, lag(total_size_bytes) OVER w AS p, epoch(t.started_at - lag(t.started_at) OVER w) / 86400 AS d FROM f_table_daily t JOIN f_daily_run r USING (environment_id, run_id) WHERE r.status = 'success' WINDOW w AS (PARTITION BY environment_id, database_name, schema_name, table_name ORDER BY t.started_at))""",
)
def growth(spark, folder):
    sizes = derive.view(spark, folder, "f_table_daily").withColumnRenamed("table_name", "hypertable_name").drop("started_at")
    return ret.growth_per_day(sizes, derive.view(spark, folder, "f_daily_run"))


@REGISTRY.add(
    "ret5_unscanned_chunks",
    derive.ctes("f_chunk") + f""" SELECT {HYPER}, chunk_name, CASE WHEN live_tuples % 50 = 0 THEN 'not_collected' WHEN live_tuples % 70 = 0 THEN 'stats_reset' WHEN seq_scan = 3 THEN 'counter_regression' WHEN seq_scan = 0 AND n_write = 0 THEN 'unscanned' ELSE 'in_use' END AS verdict FROM f_chunk WHERE live_tuples % 110 <> 0""",
)
def unscanned(spark, folder):
    base = chunks(spark, folder)
    zero, none = F.lit(0).cast("bigint"), F.lit(None).cast("bigint")
    shared = [*ret.HYPERTABLE, "chunk_name"]
    known = base.where("live_tuples % 110 <> 0")
    mark = F.lit("2001-01-01").cast("timestamp")
    before = known.select(*shared, F.when(F.col("seq_scan") == 3, 9).otherwise(zero).cast("bigint").alias("seq_scan"), zero.alias("idx_scan"), zero.alias("n_tup_ins"), zero.alias("n_tup_upd"), zero.alias("n_tup_del"), mark.alias("stats_reset"))
    after = base.select(
        *shared, F.when(F.col("live_tuples") % 50 != 0, F.col("seq_scan")).alias("seq_scan"), zero.alias("idx_scan"), F.col("n_write").alias("n_tup_ins"), none.alias("n_tup_upd"), zero.alias("n_tup_del"),
        F.when(F.col("live_tuples") % 70 == 0, F.lit("2001-02-01").cast("timestamp")).otherwise(mark).alias("stats_reset"),
    )
    return ret.unscanned_chunks(before, after)


@REGISTRY.add(
    "ret6_purge_plan",
    f"""SELECT scope, days AS retention_days, (SELECT count(*) FROM orders WHERE o_orderpriority = scope AND days > 0 AND o_orderdate < TIMESTAMP '{NOW}' - to_days(days)) AS eligible_rows,
 concat_ws(',', CASE WHEN k % 3 = 0 THEN 'not_approved' WHEN k % 3 = 1 THEN 'changed_after_approval' END, 'restore_drill_too_old') AS blockers, false AS allowed FROM (SELECT scope, k, CAST(CASE WHEN k = 4 THEN 0 ELSE 365 + k END AS INTEGER) AS days FROM (SELECT DISTINCT o_orderpriority AS scope, CAST(substr(o_orderpriority, 1, 1) AS BIGINT) AS k FROM orders))""",
)
def purge(spark, folder):
    rows = table(spark, folder, "orders").select(F.col("o_orderpriority").alias("scope"), F.col("o_orderdate").alias("created_at"))
    k = F.substring("scope", 1, 1).cast("int")
    approved = F.lit("1999-06-01").cast("timestamp")
    policies = rows.select("scope").distinct().select(
        "scope",
        F.when(k == 4, 0).otherwise(k + 365).alias("retention_days"),
        F.when(k % 3 != 0, approved).alias("approved_at"),
        F.lit("owner").alias("approved_by"),
        F.when(k % 3 == 1, F.lit("1999-06-02").cast("timestamp")).otherwise(approved).alias("updated_at"),
    )
    evidence = rows.select(
        F.when(F.col("scope").startswith("1"), "backup_verified").otherwise("restore_drill").alias("kind"),
        F.when(F.col("scope").startswith("1"), F.lit("1999-06-28")).otherwise(F.lit("1999-05-01")).cast("timestamp").alias("performed_at"),
    ).distinct()
    return ret.purge_plan(policies, rows, evidence, now())


EXPORTED = derive.ctes("s_pii_column") + """ SELECT database_name || '.' || schema_name || '.' || table_name || '.' || column_name AS coluna_qualificada, category AS categoria, confidence AS confianca, 'nome' AS metodo, '' AS pct_validado, '' AS amostra, CAST(read_accounts AS VARCHAR) AS contas_leitura, CASE WHEN has_rls THEN 'sim' ELSE 'nao' END AS rls, access_level AS nivel_acesso FROM s_pii_column"""


@REGISTRY.add("snk1_export_csv", EXPORTED)
def export(spark, folder):
    return export_rows(pii_rows(spark, folder), "pii_map")


@REGISTRY.add("snk1_export_files", EXPORTED)
def export_files(spark, folder):
    """The CSV files of the export, read again."""
    path = scratch(spark, "export")
    export_csv(pii_rows(spark, folder), "pii_map", path)
    return spark.read.option("header", True).option("escape", chr(34)).csv(path).na.fill("")  # no value and empty text are one in CSV


def pii_rows(spark, folder):
    none = F.lit(None)
    return derive.view(spark, folder, "s_pii_column").select(
        F.concat_ws(".", "database_name", "schema_name", "table_name", "column_name").alias("qualified"), "category", "confidence",
        F.lit("nome").alias("method"), none.cast("double").alias("valid_percent"), none.cast("bigint").alias("sample_size"), "read_accounts", "has_rls", "access_level",
    )
