"""Merging into stored findings: the same rows as merging all, untouched files elsewhere, no shuffle of what is stored."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from plumbline.operators import findings
from plumbline.operators.findings import merge_findings
from plumbline.plans import derive
from plumbline.sources.findings_store import FindingStore
from plumbline.sources.staging import cut_lineage

FOLDER = "/root/testdata/sf0.001"


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(df, columns):
    return sorted(map(repr, df.select(*columns).collect()))


def test_merge_of_one_environment(spark, tmp_path, monkeypatch):
    now = F.lit("2024-01-20 00:00:00")
    state = derive.view(spark, FOLDER, "f_state").drop("k")
    observed = derive.view(spark, FOLDER, "f_observed").where("run_id = 'd20'").withColumn("rule_version", F.lit("1.0.0"))
    actions = derive.view(spark, FOLDER, "f_action").withColumn("evidence_sha256", F.sha2("signed_evidence", 256))
    environments = sorted(r[0] for r in state.select("environment_id").union(observed.select("environment_id")).distinct().collect())
    assert len(environments) > 1
    news = observed.where(F.col("environment_id") == environments[0])
    store = FindingStore(spark, "one_environment", str(tmp_path), buckets=3)
    store.create(state)
    assert rows(store.state(), state.columns) == rows(state, state.columns)
    before = files(tmp_path / "state")

    def dies(self, *args, **kwargs):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(DataFrameWriter, "insertInto", dies)
        with pytest.raises(RuntimeError):
            store.merge(news, actions, now)
    assert files(tmp_path / "state") == before
    store.merge(news, actions, now)
    want = merge_findings(state, news, actions, now)
    assert rows(store.state(), state.columns) == rows(want.state, state.columns)
    assert rows(store.events(), want.events.columns) == rows(want.events, want.events.columns)
    after = files(tmp_path / "state")
    others = {p for p in before if f"={environments[0]}{os.sep}" not in p}
    assert others and all(after.get(p) == before[p] for p in others)
    assert {p for p in after if p not in before} and not {p for p in before if p not in others} & set(after)

    store.merge(observed.limit(0), actions, now)
    assert files(tmp_path / "state") == after
    with pytest.raises(ValueError):
        store.merge(news.withColumn("environment_id", F.lit(None).cast("string")), actions, now)


def test_stored_side_is_not_shuffled(spark, tmp_path, monkeypatch):
    store = FindingStore(spark, "not_shuffled", str(tmp_path), buckets=3)
    store.create(derive.view(spark, FOLDER, "f_state").drop("k").limit(0))
    observed = derive.view(spark, FOLDER, "f_observed").where("run_id = 'd20'").withColumn("rule_version", F.lit("1.0.0"))
    actions = derive.view(spark, FOLDER, "f_action").withColumn("evidence_sha256", F.sha2("signed_evidence", 256)).limit(0)
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut_lineage(df)

    monkeypatch.setattr(findings, "cut_lineage", seen)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store.merge(observed, actions, F.lit("2024-01-20 00:00:00"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    (plan,) = plans
    stored = plan[plan.rindex("FullOuter", 0, plan.index("not_shuffled_state")) : plan.index("not_shuffled_state")]
    assert "Exchange" not in stored and "Bucketed: true" in plan, plan
