"""Contracts and probes on the plain tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from checks.base import Registry, table, with_views
from plumbline.operators import contracts as c, probes
from plumbline.plans import derive

REGISTRY = Registry()
NOW = "2001-08-02 00:00:00"
NOW_SQL = f"TIMESTAMP '{NOW}'"

CHECKS = {
    "nulls": c.Check("nulls", "o_custkey", max_null_pct=0.0, critical=True),
    "uniqueness": c.Check("uniqueness", columns=("o_custkey", "o_orderdate")),
    "orphan": c.Check("orphan", "o_custkey", ref_schema="sales", ref_table="customer", ref_column="c_custkey"),
    "domain": c.Check("domain", "o_orderstatus", allowed=("F", "O"), tolerance_pct=5.0),
    "freshness": c.Check("freshness", "o_orderdate", max_age_hours=12.0),
}
LEVELS = c.Check("domain", "o_totalprice", min=2000.0, max=450000.0)
PERIOD = c.Check("domain", "o_orderdate", min_date="1996-01-01", max_date="2001-06-30", tolerance_pct=50.0)
KEY = c.Check("uniqueness", "o_orderkey")
MISSING = c.Check("nulls", "o_comment", max_null_pct=1.0)
VOLUME = c.Check("volume", max_change_pct=20.0)

CONTRACT = c.Contract(
    "shop",
    "sales",
    "orders",
    (*CHECKS.values(), LEVELS, PERIOD, KEY, MISSING, VOLUME),
)


def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders")


def now():
    return F.lit(NOW).cast("timestamp")


def customers(spark: SparkSession, folder: str) -> DataFrame:
    """All customers, those of one nation under another key, so that their orders are orphans."""
    key = F.when(F.col("c_nationkey") == 4, -F.col("c_custkey")).otherwise(F.col("c_custkey"))
    return table(spark, folder, "customer").withColumn("c_custkey", key)


def run(spark: SparkSession, folder: str) -> DataFrame:
    references = {"sales.customer": customers(spark, folder)}
    return c.run_contract(orders(spark, folder), CONTRACT, references, now(), volume=(1300, 1000))


def one(key, kind, column, result, reason, severity, count, pct, size, method, age="NULL"):
    return (
        f"SELECT '{key}' AS check_key, '{kind}' AS check_type, '{column}' AS column_name, {result} AS result, "
        f"{reason} AS reason, {severity} AS severity, CAST({count} AS BIGINT) AS observed_count, "
        f"CAST({pct} AS DOUBLE) AS observed_pct, CAST({size} AS BIGINT) AS sample_size, "
        f"'{method}' AS sample_method, CAST({age} AS DOUBLE) AS freshness_age_hours"
    )


NULLS_SQL = one(
    "nulls:o_custkey", "nulls", "o_custkey", "CASE WHEN n > 0 THEN 'violated' ELSE 'passed' END",
    "CASE WHEN n > 0 THEN printf('%.2f%% nulos > máximo %.2f%%', n * 100.0 / t, 0.0) END", "'high'",
    "n", "n * 100.0 / t", "t", "exact",
) + " FROM (SELECT count(*) FILTER (WHERE o_custkey IS NULL) AS n, count(*) AS t FROM orders)"
DUPLICATES_SQL = (
    "(SELECT coalesce(sum(n) FILTER (WHERE n > 1), 0) AS d, sum(n) AS t "
    "FROM (SELECT count(*) AS n FROM orders GROUP BY {keys}))"
)


def uniqueness_sql(columns: str) -> str:
    return one(
        f"uniqueness:{columns}", "uniqueness", columns, "CASE WHEN d >= 1 THEN 'violated' ELSE 'passed' END",
        "CASE WHEN d >= 1 THEN 'duplicata na amostra' ELSE 'sem duplicata na amostra' END", "'high'", "d", "NULL", "t", "exact",
    ) + " FROM " + DUPLICATES_SQL.format(keys=columns)


ORPHAN_SQL = one(
    "orphan:o_custkey->sales.customer.c_custkey", "orphan", "o_custkey", "CASE WHEN n >= 1 THEN 'violated' ELSE 'passed' END",
    "CASE WHEN n >= 1 THEN 'órfã na amostra' END", "'medium'", "n", "NULL", "t", "exact",
) + """ FROM (SELECT count(*) AS t, count(*) FILTER (WHERE o_custkey IS NOT NULL AND o_custkey NOT IN
 (SELECT CASE WHEN c_nationkey = 4 THEN -c_custkey ELSE c_custkey END FROM customer)) AS n FROM orders)"""


def domain_sql(column: str, bad: str, tolerance: str) -> str:
    return one(
        f"domain:{column}", "domain", column, f"CASE WHEN n * 100.0 / t > {tolerance} THEN 'violated' ELSE 'passed' END",
        f"CASE WHEN n * 100.0 / t > {tolerance} THEN printf('%.2f%% fora do domínio (tolerância %.2f%%)', n * 100.0 / t, {tolerance}) END",
        "'medium'", "n", "n * 100.0 / t", "t", "exact",
    ) + f" FROM (SELECT count(*) AS t, count(*) FILTER (WHERE {bad}) AS n FROM orders)"


STATUS_SQL = domain_sql("o_orderstatus", "o_orderstatus NOT IN ('F', 'O')", "CAST(5 AS DOUBLE)")
FRESH_SQL = one(
    "freshness:o_orderdate", "freshness", "o_orderdate", "CASE WHEN h > 12 THEN 'violated' ELSE 'passed' END",
    "CASE WHEN h > 12 THEN printf('%.0f h > máximo %.0f h', h, 12.0) ELSE printf('%.0f h', h) END", "'high'", "NULL", "NULL", "NULL",
    "aggregate_max", "h",
) + f" FROM (SELECT epoch({NOW_SQL} - max(o_orderdate)) / 3600.0 AS h FROM orders)"
CONTRACT_SQL = " UNION ALL ".join(
    [
        NULLS_SQL,
        uniqueness_sql("o_custkey,o_orderdate"),
        ORPHAN_SQL,
        STATUS_SQL,
        FRESH_SQL,
        domain_sql("o_totalprice", "o_totalprice < 2000 OR o_totalprice > 450000", "CAST(0 AS DOUBLE)"),
        domain_sql("o_orderdate", "o_orderdate < TIMESTAMP '1996-01-01' OR o_orderdate > TIMESTAMP '2001-06-30'", "CAST(50 AS DOUBLE)"),
        uniqueness_sql("o_orderkey"),
        one("nulls:o_comment", "nulls", "o_comment", "'not_executed'", "'coluna ausente'", "'info'", "NULL", "NULL", "NULL", ""),
        one("volume", "volume", "", "'violated'", "'variação estimada 30.0% fora de ±20.0% (confiança baixa)'", "'low'", "1300", "30.0", "NULL", "estimated_rows"),
    ]
)


@REGISTRY.add("dq1_check_nulls", NULLS_SQL)
def nulls(spark, folder):
    return c.scan_checks(orders(spark, folder), [CHECKS["nulls"]], now())


@REGISTRY.add("dq2_check_uniqueness", uniqueness_sql("o_custkey,o_orderdate"))
def uniqueness(spark, folder):
    return c.check_uniqueness(orders(spark, folder), CHECKS["uniqueness"])


@REGISTRY.add("dq3_check_orphan", ORPHAN_SQL)
def orphan(spark, folder):
    return c.check_orphan(
        orders(spark, folder), CHECKS["orphan"], customers(spark, folder)
    )


@REGISTRY.add("dq4_check_domain", STATUS_SQL)
def domain(spark, folder):
    return c.scan_checks(orders(spark, folder), [CHECKS["domain"]], now())


@REGISTRY.add("dq5_check_freshness", FRESH_SQL)
def freshness(spark, folder):
    return c.scan_checks(orders(spark, folder), [CHECKS["freshness"]], now())


VOLUME_SQL = with_views(
    """SELECT s.environment_id, s.run_id, s.database_name, s.schema_name, s.table_name, 'volume' AS check_key, 'volume' AS check_type, '' AS column_name,
CASE WHEN p.row_estimate IS NULL THEN 'not_executed' WHEN abs(s.row_estimate - p.row_estimate) * 100.0 / p.row_estimate > 20 THEN 'violated' ELSE 'passed' END AS result,
CASE WHEN p.row_estimate IS NULL THEN 'sem coleta anterior comparável'
     WHEN abs(s.row_estimate - p.row_estimate) * 100.0 / p.row_estimate > 20 THEN printf('variação estimada %.1f%% fora de ±%.1f%% (confiança baixa)', round_even(abs(s.row_estimate - p.row_estimate) * 100.0 / p.row_estimate, 1), CAST(20 AS DOUBLE))
     ELSE printf('variação estimada %.1f%% (confiança baixa)', round_even(abs(s.row_estimate - p.row_estimate) * 100.0 / p.row_estimate, 1)) END AS reason,
'low' AS severity, CASE WHEN p.row_estimate IS NOT NULL THEN s.row_estimate END AS observed_count,
CAST(abs(s.row_estimate - p.row_estimate) * 100.0 / p.row_estimate AS DOUBLE) AS observed_pct, CAST(NULL AS BIGINT) AS sample_size, 'estimated_rows' AS sample_method, CAST(NULL AS DOUBLE) AS freshness_age_hours
FROM f_table_snapshot s JOIN pairs USING (environment_id, run_id)
LEFT JOIN f_table_snapshot p ON p.environment_id = s.environment_id AND p.run_id = pairs.prev AND p.database_name = s.database_name AND p.schema_name = s.schema_name AND p.table_name = s.table_name""",
    "f_table_snapshot",
    "f_run",
    extra="pairs AS (SELECT environment_id, run_id, lag(run_id) OVER (PARTITION BY environment_id ORDER BY started_at, run_id) AS prev FROM f_run WHERE status = 'success')",
)


@REGISTRY.add("dq6_check_volume", VOLUME_SQL)
def volume(spark, folder):
    return c.check_volume(derive.view(spark, folder, "f_table_snapshot"), derive.view(spark, folder, "f_run"), 20.0)


@REGISTRY.add("dq7_run_contract", CONTRACT_SQL)
def contract(spark, folder):
    return run(spark, folder)


@REGISTRY.add(
    "dq7_contract_status",
    f"""SELECT check_type, CASE WHEN count(*) FILTER (WHERE result = 'not_executed') > 0 THEN 'partial_success' ELSE 'success' END AS status,
CASE WHEN count(*) FILTER (WHERE result = 'not_executed') > 0 THEN 'partial' ELSE 'complete' END AS coverage,
count(*) FILTER (WHERE result = 'violated') AS violated, count(*) FILTER (WHERE result = 'not_executed') AS not_executed, count(*) AS checks
FROM ({CONTRACT_SQL}) GROUP BY check_type""",
)
def status(spark, folder):
    return c.contract_status(run(spark, folder), "check_type")


PROPOSE_SQL = with_views(
    """SELECT environment_id, run_id, database_name, schema_name, table_name, check_type, column_name, check_key, max_null_pct, max_age_hours, CAST(ordinal AS INTEGER) AS ordinal
FROM (SELECT *, row_number() OVER (PARTITION BY environment_id, run_id, database_name, schema_name, table_name ORDER BY stage, place, check_type, check_key) AS ordinal FROM (
SELECT environment_id, run_id, database_name, schema_name, table_name, 'nulls' AS check_type, column_name, 'nulls:' || column_name AS check_key, CAST(0 AS DOUBLE) AS max_null_pct, CAST(NULL AS DOUBLE) AS max_age_hours, 0 AS stage, lpad(CAST(position AS VARCHAR), 9, '0') AS place FROM cols WHERE NOT nullable
UNION ALL SELECT environment_id, run_id, database_name, schema_name, table_name, 'uniqueness', column_list, 'uniqueness:' || column_list, NULL, NULL, 1, min(constraint_name) FROM s_constraint WHERE constraint_type IN ('p', 'u') GROUP BY 1, 2, 3, 4, 5, 7
UNION ALL SELECT environment_id, run_id, database_name, schema_name, table_name, 'orphan', column_list, 'orphan:' || column_list || '->' || referenced_schema || '.' || referenced_table || '.' || referenced_list, NULL, NULL, 1, constraint_name FROM s_constraint WHERE constraint_type = 'f' AND column_list NOT LIKE '%,%'
UNION ALL SELECT environment_id, run_id, database_name, schema_name, table_name, 'freshness', min(column_name), 'freshness:' || min(column_name), NULL, 24, 2, '' FROM cols WHERE column_name = 'updated_at' AND data_type LIKE 'timestamp%' GROUP BY 1, 2, 3, 4, 5
))""",
    "s_column",
    "s_constraint",
    extra="cols AS (SELECT * REPLACE (CASE WHEN column_name = 'CreatedAt' THEN 'updated_at' ELSE column_name END AS column_name) FROM s_column)",
)


@REGISTRY.add("dq9_propose_contract", PROPOSE_SQL)
def propose(spark, folder):
    columns = derive.view(spark, folder, "s_column").replace("CreatedAt", "updated_at", "column_name")
    constraints = derive.view(spark, folder, "s_constraint")
    for name in ("column", "referenced"):
        target = {"column": "key_columns", "referenced": "referenced_columns"}[name]
        text = F.col(f"{name}_list")
        constraints = constraints.withColumn(target, F.filter(F.split(text, ","), lambda x: x != ""))
    return c.propose_contracts(columns, constraints)


SEVERITY_SQL = f"SELECT check_key, severity FROM ({CONTRACT_SQL}) WHERE result <> 'not_executed'"


@REGISTRY.add("dq10_contract_severity", SEVERITY_SQL)
def severity(spark, folder):
    return run(spark, folder).where("result <> 'not_executed'").select("check_key", "severity")


@REGISTRY.add(
    "dq11_contract_gate",
    f"""SELECT check_type, CAST(CASE WHEN count(*) FILTER (WHERE result = 'violated' AND severity = 'high') > 0 THEN 1
WHEN count(*) FILTER (WHERE result = 'not_executed') > 0 THEN 3 ELSE 0 END AS INTEGER) AS exit_code FROM ({CONTRACT_SQL}) GROUP BY check_type""",
)
def gate(spark, folder):
    return c.contract_gate(run(spark, folder), "high", "check_type")


def history(spark, folder):
    """Volume results of all runs with the run time and coverage as a contract history."""
    runs = derive.view(spark, folder, "f_run").select(
        "environment_id", "run_id", F.col("started_at").alias("finished_at"),
        F.when(F.col("profile") == "weekly", "partial").otherwise("complete").alias("coverage"),
    )
    return volume(spark, folder).join(runs, ["environment_id", "run_id"])


@REGISTRY.add(
    "dq12_contract_trend",
    VOLUME_SQL.replace("SELECT s.environment_id", "SELECT * EXCLUDE (started_at, profile), started_at AS finished_at, CASE WHEN profile = 'weekly' THEN 'partial' ELSE 'complete' END AS coverage, profile = 'weekly' OR result = 'not_executed' AS gap FROM (SELECT s.environment_id", 1)
    + ") JOIN (SELECT environment_id, run_id, started_at, profile FROM f_run) USING (environment_id, run_id) WHERE started_at BETWEEN TIMESTAMP '2001-01-31' - INTERVAL 90 DAY AND TIMESTAMP '2001-01-31'",
)
def trend(spark, folder):
    return c.contract_trend(history(spark, folder), F.lit("2001-01-31"), 90)


@REGISTRY.add(
    "dq13_bounded_sample",
    """SELECT o_orderkey, o_custkey FROM orders
WHERE CAST(('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 7)) AS BIGINT) < CAST(floor(least(100, greatest(0.1, 1000 * 4 / CAST(150000 AS DOUBLE) * 100)) / 100 * 268435456) AS BIGINT)""",
)
def sample(spark, folder):
    picked = probes.sample_rows(orders(spark, folder), probes.sample_share(1000, 150_000), key=["o_orderkey"])
    return picked.select("o_orderkey", "o_custkey")


@REGISTRY.add(
    "dq14_probe_nulls",
    """WITH d AS (SELECT nullif(n_chars % 7, 0) AS chars, nullif(lang, 'fr') AS lang FROM documents)
SELECT 'null' AS kind, 'chars' AS column_name, count(*) - count(chars) AS affected_rows, count(*) AS sampled_rows FROM d
UNION ALL SELECT 'null', 'lang', count(*) - count(lang), count(*) FROM d""",
)
def null_probe(spark, folder):
    documents = table(spark, folder, "documents").select(
        F.nullif(F.col("n_chars") % 7, F.lit(0)).alias("chars"), F.nullif("lang", F.lit("fr")).alias("lang")
    )
    return probes.probe_nulls(documents, ["chars", "lang"])


LINES = ["l_orderkey", "l_partkey", "l_returnflag"]


@REGISTRY.add(
    "dq15_probe_duplicates",
    " UNION ALL ".join(
        f"SELECT 'duplicate' AS kind, '{n}' AS column_name, count({n}) - count(DISTINCT {n}) AS affected_rows, count(*) AS sampled_rows FROM lineitem"
        for n in LINES
    ),
)
def duplicate_probe(spark, folder):
    return probes.probe_duplicates(table(spark, folder, "lineitem"), LINES)


@REGISTRY.add(
    "dq16_probe_distribution",
    " UNION ALL ".join(
        f"""SELECT 'distribution' AS kind, '{n}' AS column_name, max(c) AS affected_rows, CAST(sum(c) AS BIGINT) AS sampled_rows
FROM (SELECT {n}, count(*) AS c FROM (SELECT l_linenumber, l_linenumber > 1 AS later FROM lineitem) GROUP BY 1)
HAVING sum(c) >= 30 AND max(c) FILTER (WHERE {n} IS NOT NULL) * 100 >= 80 * sum(c) FILTER (WHERE {n} IS NOT NULL)"""
        for n in ("l_linenumber", "later")
    ),
)
def distribution_probe(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_linenumber", (F.col("l_linenumber") > 1).alias("later"))
    return probes.probe_distribution(lines, ["l_linenumber", "later"])


@REGISTRY.add(
    "dq17_probe_date_range",
    """SELECT 'date_range' AS kind, 'l_shipdate' AS column_name, count(*) FILTER (WHERE l_shipdate < TIMESTAMP '1996-01-01' OR l_shipdate > TIMESTAMP '2001-06-30') AS affected_rows, count(*) AS sampled_rows FROM lineitem""",
)
def date_probe(spark, folder):
    return probes.probe_date_range(table(spark, folder, "lineitem"), {"l_shipdate": ("1996-01-01", "2001-06-30")})


@REGISTRY.add(
    "dq18_probe_orphans",
    """SELECT 'orphan' AS kind, 'l_partkey' AS column_name, count(*) FILTER (WHERE l_partkey NOT IN (SELECT CASE WHEN p_size < 40 THEN p_partkey ELSE -p_partkey END FROM part)) AS affected_rows, count(*) AS sampled_rows FROM lineitem
UNION ALL SELECT 'orphan', 'l_suppkey', count(*) FILTER (WHERE l_suppkey NOT IN (SELECT CASE WHEN s_nationkey > 3 THEN s_suppkey ELSE -s_suppkey END FROM supplier)), count(*) FROM lineitem""",
)
def orphan_probe(spark, folder):
    relations = {
        "l_partkey": (table(spark, folder, "part").selectExpr("CASE WHEN p_size < 40 THEN p_partkey ELSE -p_partkey END AS p_partkey"), "p_partkey"),
        "l_suppkey": (table(spark, folder, "supplier").selectExpr("CASE WHEN s_nationkey > 3 THEN s_suppkey ELSE -s_suppkey END AS s_suppkey"), "s_suppkey"),
    }
    return probes.probe_orphans(table(spark, folder, "lineitem"), relations)


@REGISTRY.add(
    "dq19_violation_findings",
    f"""SELECT 'env0' AS environment_id, 'run0' AS run_id, 'quality.contract_violation' AS rule_id, severity, 'table' AS object_type, 'shop.sales.orders' AS object_key,
'shop' AS database_name, 'sales' AS schema_name, 'orders' AS object_name, 'Violação de contrato: ' || check_key || ' em shop.sales.orders' AS title,
'{{"check_key":"' || check_key || '","check_type":"' || check_type || '","result":"violated"' || coalesce(',"observed_count":' || CAST(observed_count AS VARCHAR), '') || coalesce(',"sample_size":' || CAST(sample_size AS VARCHAR), '') || '}}' AS evidence,
CAST(0.7 AS DOUBLE) AS confidence, 'quality.contract_violation|c1|v1|' || check_key AS dedup_key FROM ({CONTRACT_SQL}) WHERE result = 'violated'""",
)
def violations(spark, folder):
    results = run(spark, folder).select(
        "*",
        F.lit("env0").alias("environment_id"),
        F.lit("run0").alias("run_id"),
        F.lit("shop").alias("database_name"),
        F.lit("sales").alias("schema_name"),
        F.lit("orders").alias("table_name"),
        F.lit("c1").alias("contract_id"),
        F.lit("v1").alias("version_id"),
    )
    return c.violation_findings(results)
