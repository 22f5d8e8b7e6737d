from pyspark.sql import functions as F

from plumbline.functions.text import normalize_sql
from plumbline.operators import diff, logs, pii
from plumbline.sources import logs as source


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_read_as_json_once_also_when_filtered(spark):
    good = '{"timestamp":"2024-01-01 10:00:00.250 UTC","error_severity":"ERROR","message":"m","user":" u "}'
    lines = spark.createDataFrame([(good,), (" \t",), ("no json",), ('{"timestamp":"yesterday"}',), (None,)], "value string")
    found = source.log_events(source.parse_lines(lines))
    assert optimized(found).count("from_json(") == 1
    assert [(str(r["ts"]), r["level"], r["message"], r["role_name"]) for r in found.collect()] == [("2024-01-01 10:00:00.250000", "error", "m", "u")]
    assert sorted(r["status"] for r in source.parse_lines(lines).collect()) == ["blank", "invalid", "invalid", "invalid", "parsed"]


def test_messages_are_masked_once_also_when_tested(spark):
    events = spark.createDataFrame([("s", "login of a@b.com"), ("s", "12 34"), ("s", None)], "source string, message string")
    found = logs.template_events(events)
    assert optimized(found).count("a-z0-9._%+") == 1
    assert [r["template"] for r in found.collect()] == ["login of <*>"]


def test_parts_of_a_table_are_gathered_in_one_grouping(spark):
    key = "environment_id string, run_id string, database_name string, schema_name string, table_name string"
    tables = spark.createDataFrame([("e", "r", "d", "s", "T"), ("e", "r", "d", "s", "T"), ("e", "r", "d", "s", None), ("e", "r", "d", "s", "u")], key)
    columns = spark.createDataFrame([("e", "r", "d", "s", "T", 2, "B", "int4", True, ""), ("e", "r", "d", "s", "T", 1, "a", "bool", None, "X")], key + ", position int, column_name string, data_type string, nullable boolean, default_expr string")
    rules = spark.createDataFrame([("e", "r", "d", "s", "T", "P (a) ;"), ("e", "r", "d", "s", "T", None), ("e", "r", "d", "s", None, "x")], key + ", definition string")
    found = diff.table_fingerprints(tables, columns, rules, rules.where("false"))
    assert optimized(found).count("Join ") == 1
    full = '{"schema":"s","name":"t","columns":[{"position":1,"name":"a","type":"boolean","default":"x"},{"position":2,"name":"b","type":"integer","nullable":true}],"constraints":["p (a)"],"indexes":[]}'
    bare = '{"schema":"s",%s"columns":[],"constraints":[],"indexes":[]}'
    want = spark.createDataFrame([("T", full), ("T", full), (None, bare % ""), ("u", bare % '"name":"u",')], "t string, p string").select("t", F.sha2("p", 256).alias("f"))
    assert sorted((r["table_name"] or "", r["fingerprint"]) for r in found.collect()) == sorted((r["t"] or "", r["f"]) for r in want.collect())


def test_definitions_lose_comments_and_one_semicolon(spark):
    rows = spark.createDataFrame([("A /* x\n */ B--c\n ; ",), ("a;b;;",), (None,), ("  Plain ",)], "d string")
    assert [r[0] for r in rows.select(normalize_sql(F.col("d"))).collect()] == ["a b", "a;b;", None, "plain"]


def test_readers_are_gathered_by_table(spark):
    key = "environment_id string, run_id string, database_name string, schema_name string, table_name string"
    results = spark.createDataFrame([("e", "r", "d", "s", "t", c, "k") for c in ("a", "b", "c", None)], key + ", column_name string, category string")
    columns = spark.createDataFrame([("e", "r", "d", "s", "t", "a", "x", "select"), ("e", "r", "d", "s", "t", "a", None, "select"), ("e", "r", "d", "s", "t", "b", "y", "update")], key + ", column_name string, account_name string, privilege string")
    tables = spark.createDataFrame([("e", "r", "d", "s", "t", g, ["select"]) for g in ("x", "y", "y", "z")], key + ", grantee string, privileges array<string>")
    roles = spark.createDataFrame([("e", "r", "y", True), ("e", "r", "y", True), ("e", "r", "x", False)], "environment_id string, run_id string, role_name string, can_login boolean")
    found = pii.pii_access(results, columns, tables, roles, results.select(*pii.TABLE).where("false"))
    assert optimized(found).count("Join ") == 4
    got = {r["column_name"]: (r["read_accounts"], r["read_names"], r["access_level"], r["has_rls"]) for r in found.collect()}
    by_table = (1, ["y"], "nivel_tabela", False)
    assert got == {"a": (2, ["x"], "nivel_coluna", False), "b": by_table, "c": by_table, None: (0, [], "nivel_tabela", False)}
