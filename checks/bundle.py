"""The snapshot bundle behind the rule queries, shaped from the plain tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.operators import facts
from plumbline.operators.rules.environments import last_drills
from plumbline.operators.rules.indexes import with_index_columns
from plumbline.operators.rules.tables import vacuum_scope
from plumbline.plans import derive
from plumbline.sources.runs import as_previous, previous_runs, table_pairs

NOW = "2001-07-01 00:00:00"


def words(column: str) -> Column:
    """List column from comma-separated text; empty text is an empty list."""
    return F.filter(F.split(column, ","), lambda x: x != "")


class DerivedBundle(Mapping):
    """Snapshot tables built when a rule asks for them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self._built: dict[str, DataFrame] = {}

    def view(self, name: str) -> DataFrame:
        return derive.view(self.spark, self.folder, name)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._built:
            self._built[name] = getattr(self, f"_{name}", lambda: self.view(SIMPLE[name]))()
        return self._built[name]

    def __iter__(self):
        return iter((*SIMPLE, *BUILT))

    def __len__(self) -> int:
        return len(SIMPLE) + len(BUILT)

    def _tables(self):
        return facts.activity_facts(self.view("s_table"))

    def _hypertables(self):
        known = facts.chunk_facts(self.view("s_hypertable"), self["chunks"], F.lit(NOW))
        workload = self.view("s_ht_query").withColumn("referenced_objects", words("object_list"))
        return facts.outside_reads(known, self.view("s_dimension"), workload)

    def _policies(self):
        return facts.policy_ratios(self.view("s_policy"), self["chunks"])

    def _caggs(self):
        return facts.refresh_windows(self.view("s_cagg"), self.view("s_refresh_policy"))

    def _servers(self):
        return facts.truncated_runs(self.view("s_server"), self.view("s_coverage"))

    def _vacuum(self):
        return vacuum_scope(self["tables"])

    def _constraints(self):
        df = self.view("s_constraint")
        return df.withColumn("key_columns", words("column_list")).withColumn("referenced_columns", words("referenced_list"))

    def _indexes(self):
        return with_index_columns(self.view("s_index").withColumn("index_columns", words("key_list")))

    def _previous_indexes(self):
        usage = self["index_usage"]
        runs = usage.groupBy("environment_id", "run_id").agg(F.min("collected_at").alias("started_at"))
        return as_previous(usage, previous_runs(runs, F.lit(True)))

    def _queries(self):
        return self.view("s_query").withColumn("referenced_objects", words("object_list"))

    def _roles(self):
        return self.view("s_role").withColumn("inherited", words("inherited_list"))

    def _grants(self):
        return self.view("s_grant").withColumn("privileges", words("privilege_list"))

    def _schemas(self):
        return self.view("s_schema").withColumn("acls", F.split("acl_list", r"\|"))

    def _drills(self):
        drills = self.view("s_drill")
        return last_drills(drills, drills).select(
            "*",
            F.lit("run1").alias("run_id"),
            F.lit(NOW).cast("timestamp").alias("now"),
            F.lit(30).alias("max_age_days"),
            F.lit(600).alias("rto_target_seconds"),
        )

    def _review_items(self):
        decisions = self.view("s_decision")
        superseded = decisions.select(F.col("supersedes_id").alias("decision_id")).where("decision_id IS NOT NULL")
        latest = (
            decisions.join(superseded, "decision_id", "left_anti")
            .groupBy("item_id")
            .agg(F.max_by(F.struct("decision", "revoke_due_at"), F.struct("decided_at", "decision_id")).alias("d"))
            .select("item_id", "d.*")
        )
        campaigns = self.view("s_campaign").withColumnRenamed("status", "campaign_status")
        items = self.view("s_campaign_item").withColumn("highlights", words("highlight_list"))
        return (
            items.join(campaigns, "campaign_id")
            .join(latest, "item_id", "left")
            .withColumn("run_id", F.lit("run1"))
            .withColumn("now", F.lit(NOW).cast("timestamp"))
        )

    def _column_stats(self):
        return self["columns"].withColumn("null_fraction", F.col("null_tenths") / F.lit(10.0))

    def _table_pairs(self):
        return table_pairs(self.view("f_table_daily"), self.view("f_daily_run"))


SIMPLE = {
    "tables": "s_table",
    "columns": "s_column",
    "index_usage": "f_index_snapshot",
    "sequences": "s_sequence",
    "locks": "s_lock",
    "connections": "s_connection",
    "functions": "s_function",
    "servers": "s_server",
    "extensions": "s_extension",
    "settings": "s_setting",
    "hypertables": "s_hypertable",
    "chunks": "f_chunk",
    "caggs": "s_cagg",
    "policies": "s_policy",
    "jobs": "s_job",
    "pii_columns": "s_pii_column",
}
BUILT = (
    "vacuum",
    "constraints",
    "indexes",
    "previous_indexes",
    "queries",
    "roles",
    "grants",
    "schemas",
    "drills",
    "review_items",
    "column_stats",
    "table_pairs",
)
