from pyspark.sql import functions as F

from plumbline.operators.rules import environments as env
from plumbline.operators.rules.base import DEFAULTS

SERVER = "fleet string, environment_id string, run_id string, name string, server_version string, timescale_version string"


def pairs(found):
    return sorted((r["environment_id"], r["object_key"]) for r in found.collect())


def test_side_by_side_is_the_join_dealt_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(env, "PAIR_BLOCK", 3)
    left = spark.range(20).select((F.col("id") % 2).alias("k"), F.col("id").alias("a"))
    right = spark.range(10).select((F.col("id") % 3).alias("k"), F.col("id").alias("b"))
    plain = left.join(right, "k")
    assert sorted(map(tuple, env.side_by_side(left, right, ["k"]).collect())) == sorted(map(tuple, plain.collect()))


def test_only_servers_with_a_value_are_paired(spark):
    servers = spark.createDataFrame([("f", f"e{n}", "r", f"s{n}", "15", "") for n in range(4)], SERVER)
    values = spark.createDataFrame([("e0", "work_mem", "1MB"), ("e3", "work_mem", "2MB"), ("e9", "work_mem", "2MB")], "environment_id string, name string, value string")
    left, right = env.known_sides(servers, values)
    assert {r[0] for r in left.select("environment_id").collect()} == {r[0] for r in right.select("peer_environment_id").collect()} == {"e0", "e3"}
    settings = values.withColumnRenamed("name", "setting")
    found = env.setting_drift({"servers": servers, "settings": settings}, DEFAULTS)
    assert pairs(found) == [("e0", "e3|config.guc_drift|work_mem"), ("e3", "e0|config.guc_drift|work_mem")]


def test_repeated_and_nameless_servers_keep_their_findings(spark):
    rows = [("f", "a", "r", "s", "15", ""), ("f", "a", "r", "s", "15", ""), ("f", "b", "r", None, "16", ""), ("f", "c", "r", "", "16", "")]
    servers = spark.createDataFrame(rows, SERVER)
    found = env.version_drift({"servers": servers}, DEFAULTS)
    # a is listed twice: two equal pairs on each side of the join, times two values of a
    assert [k for k in pairs(found)] == [("a", "c|config.version_drift|postgres")] * 8 + [("b", "a|config.version_drift|postgres")] * 8 + [("c", "a|config.version_drift|postgres")] * 8
    row = found.where("environment_id = 'c'").first()
    assert row["evidence"] == '{"name":"postgres","left":"16","right":"15","peer_environment_id":"a","peer_run_id":"r","informational":false}'
    assert {r["title"] for r in found.where("environment_id = 'a'").collect()} == {"Drift postgres vs c"}
    extensions = spark.createDataFrame([("b", "x", "1"), ("c", "x", "1"), ("c", "x", "2")], "environment_id string, extension string, version string")
    drift = env.extension_drift({"servers": servers, "extensions": extensions}, DEFAULTS)
    sides = sorted((r["environment_id"], r["severity"], r["object_key"].split("|")[0]) for r in drift.collect())
    assert sides == [("a", "low", "b")] * 2 + [("a", "low", "c")] * 2 + [("b", "low", "a")] * 2 + [("b", "medium", "c")] + [("c", "low", "a")] * 2 + [("c", "low", "b")] * 2
