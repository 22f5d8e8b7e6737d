"""Personal data: names, content, readers and the map."""

from __future__ import annotations


from pyspark.sql import functions as F

from checks.base import Registry
from checks.bundle import words
from plumbline.functions import detectors
from plumbline.operators import pii
from plumbline.plans import derive

REGISTRY = Registry()
COLUMN_SQL = ", ".join(pii.COLUMN)
TABLE_SQL = ", ".join(pii.TABLE)
ENTRIES = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(pii.DICTIONARY))
MATCH = f"""dict AS (SELECT * FROM (VALUES {ENTRIES}) d(pos, pattern, category)),
named AS MATERIALIZED (SELECT *, trim(regexp_replace(lower(trim(column_name)), '[^a-z0-9]+', '_', 'g'), '_') AS norm FROM s_pii_column),
matched AS MATERIALIZED (SELECT * EXCLUDE (category, confidence, norm), d.category FROM (SELECT n.* EXCLUDE (category), d.category, row_number() OVER (PARTITION BY {TABLE_SQL}, column_name ORDER BY (norm = pattern OR list_contains(string_split(norm, '_'), pattern)) DESC, length(pattern) DESC, pos) AS best
  FROM named n JOIN dict d ON contains(n.norm, d.pattern)) d WHERE best = 1)"""
CLASSIFIED = MATCH + f""", ranked AS (SELECT DISTINCT {TABLE_SQL}, dense_rank() OVER (PARTITION BY environment_id, run_id ORDER BY database_name, schema_name, table_name) AS place FROM matched),
classified AS (SELECT {COLUMN_SQL}, data_type, category, CASE WHEN regexp_matches(lower(data_type), CASE WHEN category IN ('cpf', 'rg', 'cep', 'telefone') THEN 'char|text|name|uuid|int|numeric|decimal|double|real' ELSE 'char|text|name|uuid' END) THEN 'media' ELSE 'baixa' END AS confidence,
  'nome' AS method, true AS scanned FROM matched JOIN ranked USING ({TABLE_SQL}))"""


def columns(spark, folder):
    return derive.view(spark, folder, "s_pii_column").drop("category", "confidence")


@REGISTRY.add("pii1_match_column_dictionary", derive.ctes("s_pii_column") + f", {MATCH} SELECT {COLUMN_SQL}, category FROM matched")
def matched(spark, folder):
    named = columns(spark, folder).withColumn("category", pii.match_category(F.col("column_name")))
    return named.where("category IS NOT NULL").select(*pii.COLUMN, "category")


@REGISTRY.add("pii2_classify_metadata", derive.ctes("s_pii_column") + f", {CLASSIFIED} SELECT * FROM classified")
def classified(spark, folder):
    return pii.classify_metadata(columns(spark, folder))


CONTACT = {"cpf": "cpf", "cnpj": "cnpj", "email": "email", "phone": "telefone", "cep": "cep", "pix": "pix"}


def digit(text: str, i: int) -> str:
    return f"(ascii(substr({text}, {i + 1}, 1)) - 48)"


def check_sql(text: str, weights) -> str:
    total = " + ".join(f"{digit(text, i)} * {w}" for i, w in enumerate(weights))
    return f"(CASE WHEN ({total}) % 11 < 2 THEN 0 ELSE 11 - ({total}) % 11 END)"


CPF_SQL = f"(length(d) = 11 AND d <> repeat(substr(d, 1, 1), 11) AND {digit('d', 9)} = {check_sql('d', range(10, 1, -1))} AND {digit('d', 10)} = {check_sql('d', range(11, 1, -1))})"
CNPJ_SQL = f"(regexp_matches(a, '^[0-9A-Z]{{12}}[0-9]{{2}}$') AND {digit('a', 12)} = {check_sql('a', [5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])} AND {digit('a', 13)} = {check_sql('a', [6, 5, 4, 3, 2, 9, 8, 7, 6, 5, 4, 3, 2])})"
EMAIL_SQL = "regexp_matches(trim(v), '^[a-z0-9]+@example.com$')"
PHONE_SQL = "regexp_matches(d, '^(?:55[1-9][1-9](?:[0-9]{8}|9[0-9]{8})|[1-9][1-9](?:[0-9]{8}|9[0-9]{8}))$')"
UUID_SQL = "regexp_matches(trim(v), '^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$')"
VALID_SQL = f"""CASE category WHEN 'cpf' THEN {CPF_SQL} WHEN 'cnpj' THEN {CNPJ_SQL} WHEN 'email' THEN {EMAIL_SQL} WHEN 'telefone' THEN {PHONE_SQL} WHEN 'cep' THEN length(d) = 8
 ELSE {CPF_SQL} OR {CNPJ_SQL} OR {EMAIL_SQL} OR {PHONE_SQL} OR {UUID_SQL} END"""
VALUES_SQL = " UNION ALL ".join(f"SELECT contact_id, '{c}' AS column_name, '{k}' AS category, {c} AS v FROM s_contact" for c, k in CONTACT.items())
CHECKED = f"checked AS (SELECT *, v IS NOT NULL AND trim(v) <> '' AS filled, coalesce({VALID_SQL}, false) AS valid FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d, upper(regexp_replace(v, '[./\\s-]', '', 'g')) AS a FROM ({VALUES_SQL})))"
CONTENT = f"{CHECKED}, content AS (SELECT column_name, category, count(*) AS sample_size, count(*) FILTER (WHERE filled) AS non_null_count, count(*) FILTER (WHERE filled AND valid) AS valid_count FROM checked GROUP BY ALL)"


@REGISTRY.add("pii3_detect_content", derive.ctes("s_contact") + f", {CONTENT} SELECT * FROM content")
def content(spark, folder):
    return pii.detect_content(derive.view(spark, folder, "s_contact"), CONTACT)


@REGISTRY.add("pii4_detectors", derive.ctes("s_contact") + f", {CHECKED} SELECT contact_id, column_name, valid FROM checked")
def detected(spark, folder):
    contacts = derive.view(spark, folder, "s_contact")
    values = [
        F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("category"), F.col(c).alias("value"))
        for c, k in CONTACT.items()
    ]
    spread = contacts.select("contact_id", F.explode(F.array(*values)).alias("r")).select("contact_id", "r.*")
    return detectors.with_validity(spread, "category", "value").select("contact_id", "column_name", "valid")


@REGISTRY.add(
    "pii5_content_confidence",
    derive.ctes("s_contact") + f""", {CONTENT} SELECT column_name, category, CASE WHEN column_name = 'email' THEN 'baixa' ELSE 'media' END AS by_name,
 CASE WHEN column_name = 'email' THEN c ELSE CASE WHEN c = 'alta' THEN 'alta' ELSE 'media' END END AS confidence,
 CASE WHEN c = 'baixa' AND valid_count = 0 THEN 'nome' WHEN column_name = 'email' AND c <> 'baixa' THEN 'conteudo' ELSE 'ambos' END AS method, round(valid_count * 100.0 / non_null_count, 6) AS valid_percent
 FROM (SELECT *, CASE WHEN non_null_count >= 50 AND valid_count * 100.0 / non_null_count >= 90 THEN 'alta' WHEN non_null_count >= 50 AND valid_count * 100.0 / non_null_count >= 50 THEN 'media' ELSE 'baixa' END AS c FROM content)""",
)
def confidence(spark, folder):
    counted = content(spark, folder)
    place = [F.lit("x").alias(c) for c in pii.TABLE]
    keyed = counted.select(*place, "*")
    named = counted.select(
        *place,
        "column_name",
        F.lit("text").alias("data_type"),
        "category",
        F.when(F.col("column_name") == "email", "baixa").otherwise("media").alias("confidence"),
        F.lit("nome").alias("method"),
        F.lit(True).alias("scanned"),
    )
    merged = pii.merge_content(named, keyed)
    return merged.select(
        "column_name",
        "category",
        F.when(F.col("column_name") == "email", "baixa").otherwise("media").alias("by_name"),
        "confidence",
        "method",
        F.round("valid_percent", 6).alias("valid_percent"),
    )


READERS = f"""bycol AS (SELECT DISTINCT {COLUMN_SQL}, account_name AS reader, 'nivel_coluna' AS level FROM s_column_grant SEMI JOIN s_pii_column USING ({COLUMN_SQL}) WHERE privilege = 'select'),
bytab AS (SELECT DISTINCT {COLUMN_SQL}, grantee AS reader, 'nivel_tabela' AS level FROM (SELECT * FROM s_pii_column ANTI JOIN bycol USING ({COLUMN_SQL})) JOIN s_table_grant USING ({TABLE_SQL}) WHERE privilege_list <> 'INSERT'),
acc AS (SELECT {COLUMN_SQL}, min(level) AS access_level, count(*) FILTER (WHERE can_login) AS l, count(*) AS a, list_sort(list(reader) FILTER (WHERE can_login)) AS ln, list_sort(list(reader)) AS an FROM (SELECT * FROM bycol UNION ALL SELECT * FROM bytab) r
 LEFT JOIN (SELECT * FROM s_login_role WHERE can_login) g ON g.environment_id = r.environment_id AND g.run_id = r.run_id AND g.role_name = r.reader GROUP BY r.environment_id, r.run_id, database_name, schema_name, table_name, column_name)"""


@REGISTRY.add(
    "pii6_access",
    derive.ctes("s_pii_column", "s_column_grant", "s_table_grant", "s_login_role")
    + f""", {READERS.replace('SELECT ' + COLUMN_SQL + ', min(level)', 'SELECT r.environment_id, r.run_id, database_name, schema_name, table_name, column_name, min(level)')}
 SELECT {COLUMN_SQL}, CAST(coalesce(CASE WHEN l > 0 THEN l ELSE a END, 0) AS BIGINT) AS read_accounts, coalesce(array_to_string(CASE WHEN l > 0 THEN ln ELSE an END, ','), '') AS readers, coalesce(acc.access_level, 'nivel_tabela') AS access_level, has_rls FROM s_pii_column p LEFT JOIN acc USING ({COLUMN_SQL})""",
)
def access(spark, folder):
    results = derive.view(spark, folder, "s_pii_column")
    grants = derive.view(spark, folder, "s_table_grant").withColumn("privileges", words("privilege_list"))
    found = pii.pii_access(
        results.select(*pii.COLUMN, "category"),
        derive.view(spark, folder, "s_column_grant"),
        grants,
        derive.view(spark, folder, "s_login_role"),
        results.where("has_rls").select(*pii.TABLE),
    )
    return found.select(*pii.COLUMN, "read_accounts", F.concat_ws(",", "read_names").alias("readers"), "access_level", "has_rls")


SCANS = "scans AS (SELECT DISTINCT environment_id, run_id AS scan_id, CASE WHEN run_id = 'run2001' THEN 'failed' WHEN run_id = 'run2000' THEN 'partial_success' ELSE 'success' END AS status, make_timestamp(CAST(substr(run_id, 4) AS BIGINT), 1, 1, 0, 0, 0.0) AS started_at FROM s_pii_column)"


def scans(spark, folder):
    run = F.col("run_id")
    status = F.when(run == "run2001", "failed").when(run == "run2000", "partial_success").otherwise("success")
    return derive.view(spark, folder, "s_pii_column").select(
        "environment_id", run.alias("scan_id"), status.alias("status"), F.to_timestamp(F.substring(run, 4, 4), "yyyy").alias("started_at")
    ).distinct()


def mapped(spark, folder):
    results = derive.view(spark, folder, "s_pii_column").withColumnRenamed("run_id", "scan_id")
    reviews = results.where("read_accounts = 3").select(
        "environment_id", *pii.COLUMN[2:], F.lit("confirmed").alias("decision")
    ).distinct()
    return pii.pii_map(results, scans(spark, folder), reviews, confidence="alta")


MAP_SQL = derive.ctes("s_pii_column") + """ SELECT environment_id, database_name, schema_name, table_name, column_name, category, confidence, read_accounts, CASE WHEN read_accounts = 3 THEN 'confirmed' ELSE '' END AS review_decision FROM s_pii_column WHERE run_id = 'run2000' AND confidence = 'alta'"""


@REGISTRY.add("pii7_map", MAP_SQL)
def pii_map(spark, folder):
    return mapped(spark, folder).select(
        "environment_id", *pii.COLUMN[2:], "category", "confidence", "read_accounts", "review_decision"
    )


@REGISTRY.add("pii8_totals", f"SELECT environment_id, category, count(*) AS columns FROM ({MAP_SQL}) GROUP BY ALL")
def totals(spark, folder):
    return pii.pii_totals(mapped(spark, folder))
