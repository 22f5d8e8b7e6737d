from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks.bundle import DerivedBundle
from plumbline.functions.intervals import interval_days, interval_seconds
from plumbline.operators import access, diff, findings, reconcile, retention, scores, workload
from plumbline.operators.rules import tables as table_rules
from plumbline.operators.rules.base import DEFAULTS
from plumbline.operators.rules.catalog import RULE_IDS, catalog
from plumbline.plans import analysis
from plumbline.sources.runs import previous_runs
from plumbline.sources.snapshots import append_snapshot, read_snapshots

FOLDER = "/root/testdata/sf0.001"


def day(n):
    return datetime(2024, 1, n)


def test_intervals(spark):
    rows = [("7 days", 604800.0, 7), ("36 hours", 129600.0, 1), ("1h30m", 5400.0, 0), ("2 weeks", 0.0, 14), ("", 0.0, 0), ("soon", 0.0, 0), ("1.5 min", 90.0, 0)]
    frame = spark.createDataFrame(rows, "t string, s double, d int")
    assert not frame.where((interval_seconds(F.col("t")) != F.col("s")) | (interval_days(F.col("t")) != F.col("d"))).collect()


def test_every_rule_is_registered(spark):
    names = set(analysis.function_rules()) - {"performance.workload"}
    for family in analysis.FAMILIES:
        for rule_ids, _ in family.builders:
            names |= set(rule_ids)
    names |= {f"performance.workload_{k}" for k in ("scan", "write", "cost")}
    assert names == set(RULE_IDS)
    assert catalog(spark).count() == len(RULE_IDS)


def test_one_scan_gives_what_single_rules_give(spark):
    bundle = DerivedBundle(spark, FOLDER)
    part = {"tables": bundle["tables"]}
    together = {tuple(r) for r in analysis.analyze(part).collect()}
    ids = {r.rule_id for r in analysis.row_rules() if r.source == "tables"} | {"storage.top_consumer"}
    alone = {tuple(r) for i in ids for r in analysis.run_rule({**part, "columns": bundle["columns"]}, i).where("object_type = 'table'").collect()}
    assert together == alone


def test_rules_apply_to_their_engine(spark):
    found = spark.createDataFrame([("e1", "chunk.high_count"), ("e1", "model.wide_table"), ("e2", "model.wide_table"), ("e3", "chunk.high_count")], "environment_id string, rule_id string")
    engines = spark.createDataFrame([("e1", "postgresql", False), ("e2", "mongodb", False), ("e3", None, True)], "environment_id string, engine string, partitioned_storage boolean")
    kept = {tuple(r) for r in analysis.applicable(found, engines).select("environment_id", "rule_id").collect()}
    assert kept == {("e1", "model.wide_table"), ("e3", "chunk.high_count")}


def test_orphan_sequence_counts_any_mention(spark):
    columns = spark.createDataFrame([("e", "r", "d", "s", "t", "id", "nextval('s.seq_12'::regclass)"), ("e", "r", "d", "s", "t", "x", "seq_3")], "environment_id string, run_id string, database_name string, schema_name string, table_name string, column_name string, default_expr string")
    sequences = spark.createDataFrame([("e", "r", "d", "s", n, "") for n in ("seq_1", "seq_12", "seq_3")], "environment_id string, run_id string, database_name string, schema_name string, sequence_name string, owned_by_table string")
    found = table_rules.orphan_sequence({"columns": columns, "sequences": sequences}, DEFAULTS)
    assert [r["object_name"] for r in found.collect()] == ["seq_3"]


def test_reset_free_window_takes_null_to_value_as_reset(spark):
    points = [(n, f"r{n}", "complete", "success", "success", None if n < 4 else "a", None) for n in range(1, 7)]
    frame = spark.createDataFrame([("e", r, day(n), c, s, a, x, y) for n, r, c, s, a, x, y in points], "environment_id string, run_id string, started_at timestamp, completeness string, run_status string, analysis_status string, stats_reset string, workload_reset string")
    row = workload.reset_free_window(workload.complete_edges(frame)).first()
    assert (row["first_run_id"], row["last_run_id"], row["edges"]) == ("r4", "r6", 3)  # the later one of two equal stretches
    alone = workload.resolve_windows(frame.where("run_id = 'r1'")).first()
    assert alone["reason"] == "too_few_edges"


def test_query_classes(spark):
    base = dict(in_prior=True, in_current=True, prior_calls=100, current_calls=100, prior_mean_us=20000.0, current_mean_us=20000.0, current_total_us=1, prior_total_us=1, prior_share=0.5, current_share=0.5, mean_change=0.0, total_change=0.0)
    cases = {
        "stable": {},
        "regression/high": dict(current_mean_us=31000.0, mean_change=0.55, total_change=1.0),
        "regression/medium": dict(current_mean_us=31000.0, mean_change=0.55, total_change=0.9),
        "few calls": dict(current_mean_us=31000.0, mean_change=0.55, current_calls=99),
        "small step": dict(prior_mean_us=10.0, current_mean_us=20.0, mean_change=1.0),
        "improvement": dict(current_mean_us=13000.0, mean_change=-0.35),
        "new": dict(in_prior=False),
        "gone": dict(in_current=False),
    }
    frame = spark.createDataFrame([{"name": n, **base, **c} for n, c in cases.items()])
    got = {r["name"]: (r["classification"], r["severity"]) for r in workload.classify_queries(frame).collect()}
    assert got == {
        "stable": ("stable", "info"), "regression/high": ("regression", "high"), "regression/medium": ("regression", "medium"), "few calls": ("stable", "info"),
        "small step": ("stable", "info"), "improvement": ("improvement", "info"), "new": ("new", "medium"), "gone": ("gone", "info"),
    }


def test_object_sets(spark):
    schema = "object_type string, object_key string, object_name string, fingerprint string, fields map<string,string>"
    source = spark.createDataFrame([("table", "A", "a", "1", {}), ("table", "b", "b", "", {"x": "1", "y": "2"}), ("table", "c", "c", "", {}), ("table", "d", "d", "", {})], schema)
    target = spark.createDataFrame([("TABLE", "a ", "a", "2", {}), ("table", "b", "b", "9", {"x": "1", "z": "3"}), ("table", "c", "c", "", {}), ("table", "e", "e", "", {})], schema)
    found = {r["object_key"]: (r["status"], r["changed_fields"]) for r in diff.compare_sets(source, target).collect()}
    assert found == {"A": ("DRIFT", ["fingerprint"]), "b": ("DRIFT", ["y", "z"]), "c": ("UNKNOWN", []), "d": ("ONLY_SOURCE", None), "e": ("ONLY_TARGET", None)}


def test_count_tolerance(spark):
    cases = [(1_000_000, 1_005_000, False), (1_000_000, 1_005_001, True), (10_000, 11_000, False), (10_000, 11_001, True), (0, 1000, False), (0, 1001, True)]
    frame = spark.createDataFrame(cases, "e long, a long, want boolean")
    assert not frame.where(reconcile.count_diverges(F.col("e"), F.col("a")) != F.col("want")).collect()


def test_group_digest_matches_brute_force(spark):
    import hashlib

    rows = [("hot" if i % 3 else "cold", i) for i in range(500)]
    frame = spark.createDataFrame(rows, "g string, v int")
    got = {r["g"]: r["digest"] for r in reconcile.group_digest(frame, ["g"], ["v"]).collect()}
    for group in ("hot", "cold"):
        hashes = [hashlib.md5(str(v).encode()).hexdigest() for g, v in rows if g == group]
        folded = 0
        for h in hashes:
            folded ^= int(h[16:31], 16)
        assert got[group] == f"{len(hashes)}-{sum(int(h[:15], 16) for h in hashes)}-{folded}"


def test_any_changed_row_diverges(spark):
    rows = [("hot", i) for i in range(3000)]
    origin = spark.createDataFrame(rows, "g string, v int")
    same = {r["status"] for r in reconcile.reconcile_rows(origin, origin.orderBy(F.desc("v")), ["g"], ["v"]).collect()}
    assert same == {"ok"}
    for changed in ([*rows[:-1], ("hot", -1)], rows[:-1], [*rows, rows[0]]):
        copy = spark.createDataFrame(changed, "g string, v int")
        assert {r["status"] for r in reconcile.reconcile_rows(origin, copy, ["g"], ["v"]).collect()} == {"diverged"}


def test_role_cycles_end(spark):
    edges = spark.createDataFrame([("u", "a"), ("a", "b"), ("b", "a"), ("b", "c")], "member string, granted string")
    logins = spark.createDataFrame([("u",)], "login string")
    got = {(r["granted"], r["depth"]) for r in access.membership_reach(edges, logins).collect()}
    assert got == {("a", 1), ("b", 2), ("c", 3)}
    chain = spark.createDataFrame([(f"r{i}", f"r{i + 1}") for i in range(20)], "member string, granted string")
    start = spark.createDataFrame([("r0",)], "login string")
    assert access.membership_reach(chain, start).count() == 20
    assert access.membership_reach(chain, start, max_depth=3).count() == 3


def test_integer_ranges_are_never_dropped_and_ratio_defaults(spark):
    rows = [("ht", "c1", datetime(2020, 1, 1), False, 1000, 0, 0, 1, False), ("ht", "c2", day(30), False, 1000, 0, 0, 0, False), ("num", "c3", datetime(2020, 1, 1), False, 1000, 0, 0, 0, True)]
    frame = spark.createDataFrame([("e", "r", "d", "s", *r) for r in rows], "environment_id string, run_id string, database_name string, schema_name string, hypertable_name string, chunk_name string, range_end timestamp, is_compressed boolean, total_size_bytes long, before_bytes long, after_bytes long, dead_tuples long, integer_range boolean")
    growth = spark.createDataFrame([("e", "r", "d", "s", "ht", 10)], "environment_id string, run_id string, database_name string, schema_name string, hypertable_name string, growth_per_day long")
    cases = (retention.Scenario("drop", 30, 0), retention.Scenario("squeeze", 0, 30))
    now = F.lit("2024-02-01").cast("timestamp")
    got = {(r["hypertable_name"], r["label"]): (r["bytes_after"], r["projection_30_bytes"]) for r in retention.simulate_retention(frame, growth, cases, now).collect()}
    assert got == {("ht", "drop"): (1000, 1300), ("ht", "squeeze"): (1200, 1500), ("num", "drop"): (1000, 1000), ("num", "squeeze"): (1000, 1000)}


def test_scope_score_golden(spark):
    tables = spark.createDataFrame([("e", "r", True), ("e", "r", False)], "environment_id string, run_id string, has_primary_key boolean")
    found = spark.createDataFrame([("e", "r", "security", "critical")] * 5 + [("e", "r", "integrity", "low"), ("e", "r", "index", "medium")], "environment_id string, run_id string, category string, severity string")
    row = scores.scope_score(found, tables).first()
    assert (row["security_score"], row["performance_score"], row["structure_score"], row["maintenance_score"]) == (0, 92, 87, 100)
    assert row["score"] == (92 * 30 + 87 * 20 + 100 * 15) // 100


def test_priority_needs_a_measure_for_the_top(spark):
    schema = "environment_id string, finding_id string, rule_id string, severity string, confidence double, impact_level string"
    rows = [("e", "1", "cost.query_expensive", "critical", 1.0, "alto"), ("e", "2", "cost.query_expensive", "critical", 1.0, None), ("e", "3", "unknown.rule", "low", None, None)]
    got = {r["finding_id"]: r["score"] for r in findings.priority_score(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"1": 7.5, "2": 4.0, "3": 0.32}


def test_discard_holds_until_evidence_or_term_changes(spark):
    cases = [("open", "x", "x", None, "proceed"), ("discarded", "x", "x", None, "hold"), ("discarded", "x", "y", None, "reopen"), ("discarded", "x", "x", day(1), "reopen"), ("discarded", "x", "x", day(30), "hold"), ("discarded", None, "x", None, "reopen")]
    frame = spark.createDataFrame(cases, "s string, a string, b string, u timestamp, want string")
    got = findings.discard_decision(F.col("s"), F.col("a"), F.col("b"), F.col("u"), F.lit("2024-01-15").cast("timestamp"))
    assert not frame.where(got != F.col("want")).collect()


def test_signature_ignores_order_and_basis(spark):
    frame = spark.createDataFrame([('{"b":1,"a":"x"}',), ('{"a":"x","impact_basis":{"k":2},"b":1}',)], "e string")
    assert len({r[0] for r in frame.select(findings.evidence_signature(F.col("e"))).collect()}) == 1


def test_previous_runs_mark_gaps(spark):
    rows = [("e", "a", day(1), "success"), ("e", "b", day(2), "failed"), ("e", "c", day(3), "success"), ("e", "d", day(4), "success")]
    frame = spark.createDataFrame(rows, "environment_id string, run_id string, started_at timestamp, status string")
    got = {r["run_id"]: (r["previous_run_id"], r["gap"]) for r in previous_runs(frame).collect()}
    assert got == {"a": (None, False), "c": ("a", True), "d": ("c", False)}


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("e", "r1", "t1"), ("e", "r1", "t1"), ("e", "r1", "t2")], "environment_id string, run_id string, table_name string")
    keys = ["environment_id", "run_id", "table_name"]
    for _ in range(2):
        append_snapshot(rows, str(tmp_path), "table_snapshot", keys)
    append_snapshot(rows.withColumn("run_id", F.lit("r2")), str(tmp_path), "table_snapshot", keys)
    stored = read_snapshots(spark, str(tmp_path), ["table_snapshot"], runs=["r1"])["table_snapshot"]
    assert stored.count() == 2
    assert read_snapshots(spark, str(tmp_path), ["table_snapshot"])["table_snapshot"].count() == 4
