"""Registered queries against their SQL where every one has rows; PLUMBLINE_ALL=1 runs all of them, in some 12 minutes."""

import os

import pytest

from __spark_entry__ import entry
from checks import registries
from compare import connect, differences

FOLDER = os.environ.get("PLUMBLINE_FOLDER", "/root/testdata/sf0.01")
QUERIES = {name: query for registry in registries() for name, query in registry.queries.items()}
SQL = {name: sql for registry in registries() for name, sql in registry.sql.items()}
SAMPLE = [
    "dq7_run_contract", "dq9_propose_contract", "dq12_contract_trend", "dq18_probe_orphans", "src3_profile_pg_json", "src5_parse_time_any",
    "log1_mask_message", "log6_baseline_stats", "log13_anomaly_summary", "pii1_match_column_dictionary", "pii4_detectors", "pii6_access",
    "rule_storage_top_consumer", "rule_integrity_fk_without_index", "rule_integrity_orphan_sequence", "rule_index_candidate", "rule_maintenance_growth_trend",
    "rule_security_powerful_role", "rule_config_extension_drift", "rule_timescale_retention_cagg_conflict", "wl3_reset_free_subwindow", "wl8_top_per_class",
    "wl12_structure_regression_keys", "wl14_table_history", "dif4_compare_sets", "dif7_timeline_events", "dif9_correlate_deploy", "dif17_reconcile_sample_hash",
    "fnd1_enrich_findings", "fnd3_upsert_findings", "fnd6_finding_events", "fnd10_priority", "fnd12_scope_aggregates", "fnd22_search",
    "cst1_price_as_of", "cst5_cost_ranking", "ret3_simulate_retention", "ret3_scenario_risks", "acc1_membership_reach", "acc3_grant_origin", "acc6_campaign_diff",
]
CHOSEN = list(QUERIES) if os.environ.get("PLUMBLINE_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", CHOSEN)
def test_same_rows_as_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], SQL[name], FOLDER) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry_runs(spark):
    rows = {r["check_key"]: r["result"] for r in entry(spark).collect()}
    assert rows["uniqueness:o_orderkey"] == "passed"
    assert rows["nulls:o_comment"] == "not_executed"
