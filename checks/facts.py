"""Facts of snapshots, and their SQL, on which the oracles of the rules rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry
from checks.bundle import NOW, words
from plumbline.operators import facts
from plumbline.plans import derive

REGISTRY = Registry()
KEY = "environment_id, run_id, database_name, schema_name, hypertable_name"
AGE = f"(epoch(TIMESTAMP '{NOW}') - epoch(range_end)) / 86400"
#: name: (the derived views it reads, its SQL)
SQL = {
    "x_hypertable": (
        "s_hypertable f_chunk s_dimension s_ht_query",
        f"""SELECT h.*, coalesce(c.closed, 0) AS uncompressed_closed_chunks, CAST(coalesce(greatest(round(c.age), 0), 0) AS BIGINT) AS oldest_chunk_days,
 CAST(coalesce(c.old_bytes, 0) AS BIGINT) AS uncompressed_old_bytes, coalesce(c.packed, 0) AS compressed_chunk_count, CAST(coalesce(c.ratio, 0) AS DOUBLE) AS observed_ratio,
 EXISTS (SELECT 1 FROM s_dimension d JOIN s_ht_query w USING (environment_id, run_id, database_name)
  WHERE d.environment_id = h.environment_id AND d.run_id = h.run_id AND d.database_name = h.database_name AND d.schema_name = h.schema_name AND d.hypertable_name = h.hypertable_name
  AND d.column_name <> '' AND calls > 0 AND (list_contains(string_split(object_list, ','), h.schema_name || '.' || h.hypertable_name) OR contains(lower(fingerprint_text), lower(h.hypertable_name)))
  AND NOT contains(lower(fingerprint_text), lower(d.column_name))) AS reads_outside_time
 FROM s_hypertable h LEFT JOIN (SELECT {KEY}, count(*) FILTER (WHERE NOT is_compressed AND {AGE} > 1) AS closed, max({AGE}) AS age,
  sum(total_size_bytes) FILTER (WHERE NOT is_compressed AND {AGE} > 30) AS old_bytes, count(*) FILTER (WHERE is_compressed AND before_bytes > 0 AND after_bytes > 0) AS packed,
  sum(before_bytes) FILTER (WHERE is_compressed AND before_bytes > 0 AND after_bytes > 0) / sum(after_bytes) FILTER (WHERE is_compressed AND before_bytes > 0 AND after_bytes > 0) AS ratio
  FROM f_chunk GROUP BY ALL) c USING ({KEY})""",
    ),
    "x_policy": (
        "s_policy f_chunk",
        f"""SELECT p.*, CAST(coalesce(r.ratio, 0) AS DOUBLE) AS compression_ratio FROM s_policy p LEFT JOIN (SELECT {KEY}, sum(before_bytes) / sum(after_bytes) AS ratio FROM f_chunk
 WHERE before_bytes > 0 AND after_bytes > 0 GROUP BY ALL) r USING ({KEY})""",
    ),
    "x_table": (
        "s_table",
        "SELECT *, CASE WHEN n_tup_ins = 0 AND n_tup_upd = 0 AND n_tup_del = 0 AND stats_reset IS NOT NULL THEN CAST(floor((epoch(collected_at) - epoch(stats_reset)) / 86400) AS BIGINT) END AS days_since_dml FROM s_table",
    ),
    "x_cagg": (
        "s_cagg s_refresh_policy",
        """SELECT c.* REPLACE (CAST(coalesce((SELECT CASE WHEN o LIKE '%week%' THEN 7 * CAST(split_part(o, ' ', 1) AS INT) WHEN o LIKE '%day%' THEN CAST(split_part(o, ' ', 1) AS INT) ELSE 0 END
  FROM (SELECT min_by(config, job_id)->>'start_offset' AS o FROM s_refresh_policy p WHERE p.policy_type = 'refresh' AND p.environment_id = c.environment_id AND p.run_id = c.run_id AND p.database_name = c.database_name
   AND ((p.schema_name = c.schema_name AND p.hypertable_name = c.view_name) OR (p.schema_name = c.materialization_schema AND p.hypertable_name = c.materialization_hypertable)))), 0) AS BIGINT) AS refresh_window_days) FROM s_cagg c""",
    ),
    "x_server": (
        "s_server s_coverage",
        "SELECT s.*, EXISTS (SELECT 1 FROM s_coverage v WHERE v.environment_id = s.environment_id AND v.run_id = s.run_id AND v.warning ILIKE '%truncated%') AS chunks_truncated FROM s_server s",
    ),
}


def with_facts(names: str) -> str:
    """``WITH`` clause of derived views and facts."""
    wanted = names.split()
    raw = [v for n in wanted for v in (SQL[n][0].split() if n in SQL else [n])]
    return ",\n".join([derive.ctes(*raw), *[f"{n} AS ({SQL[n][1]})" for n in wanted if n in SQL]])


@REGISTRY.add("src10_hypertable_facts", with_facts("x_hypertable") + " SELECT * EXCLUDE (reads_outside_time) FROM x_hypertable")
def hypertables(spark, folder):
    view = lambda name: derive.view(spark, folder, name)
    return facts.chunk_facts(view("s_hypertable"), view("f_chunk"), F.lit(NOW))


@REGISTRY.add("src11_outside_reads", with_facts("x_hypertable") + f" SELECT {KEY}, reads_outside_time FROM x_hypertable")
def outside(spark, folder):
    view = lambda name: derive.view(spark, folder, name)
    workload = view("s_ht_query").withColumn("referenced_objects", words("object_list"))
    found = facts.outside_reads(view("s_hypertable"), view("s_dimension"), workload)
    return found.select(*facts.HYPERTABLE, "reads_outside_time")


@REGISTRY.add("src12_policy_ratios", with_facts("x_policy") + f" SELECT {KEY}, job_id, compression_ratio FROM x_policy")
def ratios(spark, folder):
    found = facts.policy_ratios(derive.view(spark, folder, "s_policy"), derive.view(spark, folder, "f_chunk"))
    return found.select(*facts.HYPERTABLE, "job_id", "compression_ratio")


@REGISTRY.add("src13_activity_facts", with_facts("x_table") + " SELECT environment_id, run_id, database_name, schema_name, table_name, days_since_dml FROM x_table")
def activity(spark, folder):
    found = facts.activity_facts(derive.view(spark, folder, "s_table"))
    return found.select("environment_id", "run_id", "database_name", "schema_name", "table_name", "days_since_dml")


@REGISTRY.add("src14_refresh_windows", with_facts("x_cagg") + " SELECT environment_id, run_id, database_name, schema_name, view_name, refresh_window_days FROM x_cagg")
def refresh(spark, folder):
    found = facts.refresh_windows(derive.view(spark, folder, "s_cagg"), derive.view(spark, folder, "s_refresh_policy"))
    return found.select("environment_id", "run_id", "database_name", "schema_name", "view_name", "refresh_window_days")


@REGISTRY.add("src15_truncated_runs", with_facts("x_server") + " SELECT environment_id, run_id, chunks_truncated FROM x_server")
def truncated(spark, folder):
    found = facts.truncated_runs(derive.view(spark, folder, "s_server"), derive.view(spark, folder, "s_coverage"))
    return found.select("environment_id", "run_id", "chunks_truncated")
