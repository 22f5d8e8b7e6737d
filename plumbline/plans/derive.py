"""Snapshot tables derived from plain business tables.

A snapshot table describes objects of many databases over many collection runs.
Where no collector fills such tables, these views shape ordinary tables into the
same layout, so every operator can be run at any scale.  The text is plain SQL
that more than one engine can read.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession

SOURCE_TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

_ENV_ORDERS = "concat('env', CAST(o_custkey % 2 AS STRING))"
_DB_ORDERS = "concat('db', CAST(o_custkey % 3 AS STRING))"
_RUN_ORDERS = "concat('run', CAST(year(o_orderdate) AS STRING))"
_SCHEMA_ORDERS = "CASE o_orderstatus WHEN 'F' THEN 'public' WHEN 'O' THEN 'sales' ELSE 'pg_stage' END"
_TABLE_ORDERS = "concat(CASE WHEN o_orderkey % 11 = 0 THEN 'Tbl_' ELSE 'tbl_' END, CAST(o_orderkey AS STRING))"
_PRICE = "CAST(round(o_totalprice) AS BIGINT)"
_OBJECT = f"""{_ENV_ORDERS} AS environment_id, {_RUN_ORDERS} AS run_id, {_DB_ORDERS} AS database_name,
       {_SCHEMA_ORDERS} AS schema_name, {_TABLE_ORDERS} AS table_name"""

#: name -> SQL text; a view may read views that stand before it.
VIEWS: dict[str, str] = {
    "f_log_event": """
SELECT event_id, ts,
       CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'LOG' END AS error_severity,
       concat(CASE WHEN event_type = 'view' THEN 'connection' ELSE event_type END, ' authorized: user=',
              CAST(user_id % 12 AS STRING), ' took ', CAST(CAST(round(value * 100) AS BIGINT) AS STRING),
              ' for ', CASE WHEN user_id % 10 = 3 AND ts >= TIMESTAMP '2024-01-30 12:00:00' THEN 'canary' WHEN user_id % 10 = 4 AND ts < TIMESTAMP '2024-01-29 00:00:00' THEN 'legacy' WHEN user_id % 7 = 0 THEN 'batch' ELSE 'web' END) AS message,
       concat('s', CAST(user_id % 2 AS STRING)) AS source,
       CASE WHEN user_id % 5 = 0 THEN '' ELSE concat('u', CAST(user_id AS STRING)) END AS role_name
FROM events""",
    "f_log_line": """
SELECT event_id, source,
       CASE WHEN event_id % 29 = 0 THEN concat('not json ', message)
            WHEN event_id % 31 = 0 THEN '   '
            ELSE concat('{"timestamp":"',
                 CASE WHEN event_id % 23 = 0 THEN 'yesterday' ELSE substr(CAST(ts AS STRING), 1, 19) END,
                 CASE WHEN event_id % 23 = 0 THEN '' WHEN event_id % 3 = 0 THEN '.250 UTC' WHEN event_id % 3 = 1 THEN ' -03' ELSE '' END,
                 '","error_severity":"', error_severity, '","level":"', lower(error_severity),
                 '","message":"', message, '","user":"', role_name, '"}') END AS value
FROM f_log_event""",
    "f_run": """
SELECT concat('env', CAST(o_custkey % 2 AS STRING)) AS environment_id,
       concat('env', CAST(o_custkey % 2 AS STRING), '-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING)) AS run_id,
       CAST(min(date_trunc('month', o_orderdate)) AS TIMESTAMP) AS started_at,
       CASE WHEN month(max(o_orderdate)) = 6 THEN 'partial_success' WHEN month(max(o_orderdate)) = 10 THEN 'failed' ELSE 'success' END AS status,
       CASE WHEN year(max(o_orderdate)) < 1998 THEN 'c1' ELSE 'c2' END AS collector_version,
       CASE WHEN month(max(o_orderdate)) = 12 THEN 'weekly' ELSE 'daily' END AS profile,
       CASE WHEN month(max(o_orderdate)) = 9 THEN 'failed' ELSE 'success' END AS analysis_status,
       CASE WHEN year(max(o_orderdate)) >= 1999 THEN 'reset-2' WHEN year(max(o_orderdate)) >= 1996 THEN 'reset-1' END AS stats_reset,
       'rules-1' AS rules_hash
FROM orders
GROUP BY concat('env', CAST(o_custkey % 2 AS STRING)),
         concat('env', CAST(o_custkey % 2 AS STRING), '-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING))""",
    "f_coverage": """
SELECT environment_id, run_id, database_name, collector,
       CASE WHEN m = 3 AND k % 5 = 0 THEN 'failed' WHEN m = 4 AND k % 3 = 0 THEN 'skipped' WHEN m = 5 THEN 'failed' ELSE 'success' END AS status
FROM (SELECT concat('env', CAST(o_custkey % 2 AS STRING)) AS environment_id,
             concat('env', CAST(o_custkey % 2 AS STRING), '-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING)) AS run_id,
             c_mktsegment AS database_name, n_name AS collector, min(month(o_orderdate)) AS m, min(o_orderkey) AS k
      FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
      GROUP BY 1, 2, c_mktsegment, n_name) t""",
    "f_table_snapshot": """
SELECT environment_id, run_id, started_at, database_name, schema_name, table_name,
       CAST(sum(n) OVER (PARTITION BY environment_id, database_name, table_name ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_estimate,
       CAST(sum(b) OVER (PARTITION BY environment_id, database_name, table_name ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_size_bytes,
       n AS n_dead_tup,
       CASE WHEN n % 7 = 0 THEN 'p' ELSE 'r' END AS relkind,
       n % 3 <> 0 AS has_primary_key,
       n % 4 AS column_count,
       CASE WHEN year(started_at) >= 1999 THEN 'reset-2' ELSE 'reset-1' END AS stats_reset
FROM (SELECT concat('env', CAST(o_custkey % 2 AS STRING)) AS environment_id,
             concat('env', CAST(o_custkey % 2 AS STRING), '-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING)) AS run_id,
             CAST(min(date_trunc('month', o_orderdate)) AS TIMESTAMP) AS started_at,
             c_mktsegment AS database_name, CASE WHEN c_nationkey % 2 = 0 THEN 'public' ELSE 'sales' END AS schema_name,
             concat(o_orderpriority, '/', CAST(c_nationkey AS STRING)) AS table_name,
             count(*) AS n, sum(CAST(round(o_totalprice) AS BIGINT)) * 1000 AS b
      FROM orders JOIN customer ON c_custkey = o_custkey
      GROUP BY 1, 2, c_mktsegment, CASE WHEN c_nationkey % 2 = 0 THEN 'public' ELSE 'sales' END, concat(o_orderpriority, '/', CAST(c_nationkey AS STRING))) t""",
    "f_table_daily": """
SELECT environment_id, run_id, started_at, started_at AS collected_at, database_name, schema_name, table_name,
       CAST(sum(n) OVER (PARTITION BY environment_id, database_name, table_name ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS row_estimate,
       CAST(sum(b) OVER (PARTITION BY environment_id, database_name, table_name ORDER BY started_at ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_size_bytes,
       n AS n_tup_ins, n % 5 AS n_tup_upd, n % 3 AS n_tup_del, n AS seq_scan,
       CASE WHEN day(started_at) >= 10 AND n % 2 = 0 THEN 'reset-2' ELSE 'reset-1' END AS stats_reset
FROM (SELECT concat('env', CAST(user_id % 2 AS STRING)) AS environment_id, concat('d', CAST(day(ts) AS STRING)) AS run_id,
             CAST(min(date_trunc('day', ts)) AS TIMESTAMP) AS started_at, concat('db', CAST(user_id % 3 AS STRING)) AS database_name,
             CASE WHEN user_id % 4 = 0 THEN 'public' ELSE 'sales' END AS schema_name,
             concat('t', CAST(user_id AS STRING)) AS table_name,
             count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) * 100000 AS b
      FROM events
      GROUP BY 1, 2, 4, 5, 6) t""",
    "f_daily_run": """
SELECT environment_id, run_id, min(started_at) AS started_at,
       CASE WHEN day(min(started_at)) % 8 = 0 THEN 'partial_success' WHEN day(min(started_at)) = 13 AND environment_id = 'env1' THEN 'failed' ELSE 'success' END AS status
FROM f_table_daily GROUP BY environment_id, run_id""",
    "f_workload": """
SELECT environment_id, run_id, day AS started_at, database_name, fingerprint,
       CAST(sum(c) OVER (PARTITION BY environment_id, database_name, fingerprint ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS calls,
       CAST(sum(ms) OVER (PARTITION BY environment_id, database_name, fingerprint ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS total_us,
       CAST(sum(c * 3) OVER (PARTITION BY environment_id, database_name, fingerprint ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS blocks_read
FROM (SELECT concat('env', CAST(user_id % 2 AS STRING)) AS environment_id,
             concat('d', CAST(day(ts) AS STRING)) AS run_id, CAST(min(date_trunc('day', ts)) AS TIMESTAMP) AS day,
             concat('db', CAST(user_id % 3 AS STRING)) AS database_name,
             concat(event_type, ':', CAST((user_id + CASE WHEN day(ts) > 20 AND event_type = 'error' THEN 100 ELSE 0 END) % 200 AS STRING)) AS fingerprint,
             count(*) AS c, sum(CAST(round(value * CASE WHEN day(ts) > 15 AND user_id % 4 = 0 THEN 3000 WHEN day(ts) > 15 AND user_id % 4 = 1 THEN 300 ELSE 1000 END) AS BIGINT)) AS ms
      FROM events
      GROUP BY 1, 2, 4, 5) t""",
    "f_workload_run": """
SELECT concat('env', CAST(user_id % 2 AS STRING)) AS environment_id, concat('d', CAST(day(ts) AS STRING)) AS run_id,
       CAST(min(date_trunc('day', ts)) AS TIMESTAMP) AS started_at,
       CASE WHEN day(min(ts)) = 9 THEN 'partial' ELSE 'complete' END AS completeness,
       CASE WHEN day(min(ts)) = 12 AND user_id % 2 = 0 THEN 'partial_success' ELSE 'success' END AS run_status,
       'success' AS analysis_status,
       CASE WHEN day(min(ts)) >= 6 AND user_id % 2 = 1 THEN 'r1' END AS stats_reset,
       CASE WHEN day(min(ts)) >= 26 AND user_id % 2 = 1 THEN 'w1' END AS workload_reset
FROM events GROUP BY user_id % 2, concat('env', CAST(user_id % 2 AS STRING)), concat('d', CAST(day(ts) AS STRING))""",
    "f_index_snapshot": """
SELECT environment_id, run_id, database_name, schema_name, table_name, index_name,
       CAST(sum(n) OVER (PARTITION BY environment_id, database_name, table_name, index_name ORDER BY yr ROWS UNBOUNDED PRECEDING) AS BIGINT) AS idx_scan,
       sz AS size_bytes, yr % 5 = 0 AND sk % 7 = 0 AS is_unique, false AS is_primary,
       collected_at, CASE WHEN sk % 12 = 0 THEN collected_at END AS stats_reset
FROM (SELECT concat('env', CAST(l_suppkey % 2 AS STRING)) AS environment_id, concat('run', CAST(year(l_shipdate) AS STRING)) AS run_id,
             'db0' AS database_name, 'public' AS schema_name, p_brand AS table_name, concat('ix_', p_brand, '_', CAST(l_suppkey AS STRING)) AS index_name,
             year(l_shipdate) AS yr, l_suppkey AS sk,
             CAST(min(date_trunc('year', l_shipdate)) AS TIMESTAMP) AS collected_at,
             sum(CASE WHEN l_suppkey % 4 = 0 THEN 0 ELSE 1 END) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) * 4000000 AS BIGINT) AS sz
      FROM lineitem JOIN part ON p_partkey = l_partkey
      GROUP BY l_suppkey, year(l_shipdate), p_brand) t""",
    "f_object": """
SELECT 'source' AS side, CASE WHEN p_partkey % 4 = 0 THEN 'view' ELSE 'table' END AS object_type, concat('db.', lower(trim(p_name)), '.', CAST(p_partkey AS STRING)) AS object_key,
       concat(p_name, '#', CAST(p_partkey AS STRING)) AS object_name,
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE md5(concat(p_type, '|', CAST(p_size AS STRING))) END AS fingerprint,
       CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_type END AS relkind, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE CAST(p_size AS STRING) END AS column_count
FROM part WHERE p_partkey % 10 <> 0
UNION ALL
SELECT 'target', CASE WHEN p_partkey % 4 = 0 THEN 'view' ELSE 'table' END, concat('DB.', lower(trim(p_name)), '.', CAST(p_partkey AS STRING)),
       concat(p_name, '#', CAST(p_partkey AS STRING)),
       CASE WHEN p_partkey % 3 = 0 THEN '' ELSE md5(concat(CASE WHEN p_partkey % 6 = 1 THEN 'changed' ELSE p_type END, '|', CAST(p_size AS STRING))) END,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 6 = 0 THEN 'changed' ELSE p_type END,
       CASE WHEN p_partkey % 9 = 0 THEN NULL WHEN p_partkey % 12 = 3 THEN NULL ELSE CAST(p_size AS STRING) END
FROM part WHERE p_partkey % 7 <> 0""",
    "f_chunk": """
SELECT environment_id, run_id, database_name, schema_name, hypertable_name, chunk_name, range_start, range_end, is_compressed,
       total_size_bytes, CAST(CASE WHEN is_compressed THEN total_size_bytes / 10 * (11 + 15 * (slot % 3)) ELSE 0 END AS BIGINT) AS before_bytes,
       CASE WHEN is_compressed THEN total_size_bytes ELSE 0 END AS after_bytes,
       n_rows * 10 AS live_tuples, dead AS dead_tuples, seq_scan, n_write
FROM (SELECT concat('env', CAST(l_suppkey % 2 AS STRING)) AS environment_id, 'run2001' AS run_id,
             concat('db', CAST(l_suppkey % 3 AS STRING)) AS database_name, 'public' AS schema_name,
             concat('ht_', l_returnflag, l_linestatus, '_', CAST(l_suppkey % 10 AS STRING)) AS hypertable_name,
             concat('_hyper_', l_returnflag, l_linestatus, '_', CAST(l_suppkey % 10 AS STRING), '_', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING), '_', CAST(l_suppkey % 2 AS STRING), CAST(l_suppkey % 3 AS STRING)) AS chunk_name,
             CAST(min(date_trunc('month', l_shipdate)) AS TIMESTAMP) AS range_start,
             CAST(min(date_trunc('month', l_shipdate)) AS TIMESTAMP) + INTERVAL '30' DAY AS range_end,
             year(min(l_shipdate)) < 1998 AND l_suppkey % 10 < 7 AS is_compressed,
             CAST(sum(CAST(round(l_extendedprice) AS BIGINT)) * CASE WHEN month(min(l_shipdate)) = 7 THEN 4000 ELSE 100 END AS BIGINT) AS total_size_bytes,
             count(*) AS n_rows, count(*) * (l_suppkey % 10) AS dead,
             CAST(sum(CASE WHEN l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS seq_scan,
             CAST(sum(CASE WHEN l_quantity > 48 THEN 1 ELSE 0 END) AS BIGINT) AS n_write, l_suppkey % 10 AS slot
      FROM lineitem
      GROUP BY l_suppkey % 2, l_suppkey % 3, l_suppkey % 10, l_returnflag, l_linestatus, year(l_shipdate) * 100 + month(l_shipdate),
               concat('env', CAST(l_suppkey % 2 AS STRING)), concat('db', CAST(l_suppkey % 3 AS STRING)),
               concat('ht_', l_returnflag, l_linestatus, '_', CAST(l_suppkey % 10 AS STRING)),
               concat('_hyper_', l_returnflag, l_linestatus, '_', CAST(l_suppkey % 10 AS STRING), '_', CAST(year(l_shipdate) * 100 + month(l_shipdate) AS STRING), '_', CAST(l_suppkey % 2 AS STRING), CAST(l_suppkey % 3 AS STRING))) t""",
    "f_role_edge": """
SELECT concat('u', CAST(c_custkey AS STRING)) AS member, concat('n', CAST(c_nationkey AS STRING)) AS granted FROM customer
UNION
SELECT concat('n', CAST(n_nationkey AS STRING)), concat('r', CAST(n_regionkey AS STRING)) FROM nation
UNION
SELECT concat('r', CAST(r_regionkey AS STRING)), CASE WHEN r_regionkey % 2 = 0 THEN 'pg_read_all_data' ELSE 'pg_monitor' END FROM region""",
    "f_acl": """
SELECT DISTINCT 'db0' AS database_name, CASE WHEN p_size % 5 = 0 THEN 'public' ELSE 'app' END AS schema_name, 'table' AS object_type,
       replace(p_brand, '#', '_') AS object_name,
       CASE WHEN p_size % 9 = 0 THEN 'PUBLIC' WHEN p_size % 2 = 0 THEN concat('r', CAST(p_partkey % 5 AS STRING)) ELSE concat('n', CAST(p_partkey % 25 AS STRING)) END AS grantee,
       CASE WHEN p_size % 3 = 0 THEN 'SELECT' WHEN p_size % 3 = 1 THEN 'UPDATE' ELSE 'DELETE' END AS privilege,
       concat('u', CAST(p_size AS STRING)) AS owner
FROM part""",
    "f_finding_event": """
SELECT DISTINCT concat('env', CAST(user_id % 2 AS STRING)) AS environment_id, concat('d', CAST(day(ts) AS STRING)) AS run_id,
       CAST(date_trunc('day', ts) AS TIMESTAMP) AS started_at, concat('db', CAST(user_id % 3 AS STRING)) AS database_name,
       CASE WHEN user_id % 4 = 0 THEN 'public' ELSE 'sales' END AS schema_name,
       concat('t', CAST(user_id % 40 AS STRING)) AS object_name,
       CASE event_type WHEN 'error' THEN 'security' WHEN 'click' THEN 'index' WHEN 'view' THEN 'storage' ELSE 'integrity' END AS category,
       CASE event_type WHEN 'error' THEN 'security.powerful_role' WHEN 'click' THEN 'index.unused' WHEN 'view' THEN 'storage.large_table' ELSE 'integrity.fk_without_index' END AS rule_id,
       CASE WHEN value > 60 THEN 'critical' WHEN value > 30 THEN 'high' WHEN value > 10 THEN 'medium' ELSE 'low' END AS severity,
       event_type AS title
FROM events""",
    "s_table": f"""
SELECT {_OBJECT},
       {_PRICE} * 60000 AS total_size_bytes, {_PRICE} * 5 AS row_estimate, o_custkey % 80 AS column_count,
       o_orderkey % 5 <> 0 AS has_primary_key, o_orderkey % 7 = 0 AS is_partition,
       CASE WHEN o_orderkey % 13 = 0 THEN 'foreign_table' ELSE 'table' END AS relation_class,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE o_orderpriority END AS comment,
       CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE {_PRICE} END AS n_tup_ins, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE {_PRICE} % 1000 END AS n_tup_upd,
       CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE {_PRICE} % 300 END AS n_tup_del,
       {_PRICE} AS n_live_tup,
       {_PRICE} * (o_orderkey % 8) AS n_dead_tup,
       CASE WHEN o_orderkey % 4 <> 0 THEN o_orderdate END AS last_analyze,
       CASE WHEN o_orderkey % 6 = 0 THEN NULL WHEN o_custkey % 14 = 0 THEN o_orderdate - INTERVAL '60' DAY ELSE o_orderdate - INTERVAL '40' DAY END AS stats_reset,
       CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate + INTERVAL '45' DAY ELSE o_orderdate + INTERVAL '10' DAY END AS collected_at,
       o_custkey % 4 = 0 AS rls_enabled
FROM orders""",
    "s_column": f"""
SELECT {_OBJECT},
       CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN concat('tbl_', CAST(o_orderkey - 32 AS STRING), '_id') WHEN 3 THEN 'phone_1'
            WHEN 4 THEN 'phone_2' WHEN 5 THEN 'order_status' WHEN 6 THEN 'payload' ELSE 'CreatedAt' END AS column_name,
       CASE WHEN l_linenumber IN (1, 2) THEN CASE WHEN pk % 6 = 0 THEN 'uuid' ELSE 'bigint' END
            WHEN l_linenumber < 6 THEN 'character varying' WHEN l_linenumber = 6 THEN 'jsonb'
            WHEN pk % 3 = 0 THEN 'timestamp' WHEN pk % 3 = 1 THEN 'timestamp with time zone' ELSE 'money' END AS data_type,
       l_linenumber > 1 AND pk % 5 <> 0 AS nullable,
       CASE WHEN l_linenumber = 1 AND pk % 2 = 0 THEN concat('nextval(''', CASE WHEN pk % 4 = 0 THEN '' ELSE concat({_SCHEMA_ORDERS}, '.') END, 'seq_', CAST(o_orderkey AS STRING), '''::regclass)') ELSE '' END AS default_expr,
       l_linenumber AS position, CAST(4 + pk % 60 AS BIGINT) AS average_width, pk % 10 AS null_tenths
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN orders ON o_orderkey = l_orderkey""",
    "s_constraint": f"""
SELECT {_OBJECT},
       concat('con_', CAST(l_linenumber AS STRING)) AS constraint_name,
       CASE WHEN l_linenumber = 1 THEN 'p' WHEN l_linenumber = 3 THEN 'u' WHEN l_linenumber = 4 OR (l_linenumber = 2 AND pk % 3 <> 0) THEN 'f' ELSE 'c' END AS constraint_type,
       pk % 5 <> 0 AS validated,
       CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN concat('tbl_', CAST(o_orderkey - 32 AS STRING), '_id') WHEN 3 THEN 'id' WHEN 4 THEN 'phone_1,phone_2' ELSE '' END AS column_list,
       CASE WHEN l_linenumber = 2 AND pk % 4 <> 0 THEN {_SCHEMA_ORDERS} ELSE '' END AS referenced_schema,
       CASE WHEN l_linenumber IN (2, 4) THEN {_TABLE_ORDERS} ELSE '' END AS referenced_table,
       CASE l_linenumber WHEN 2 THEN 'id' WHEN 4 THEN 'id,phone_2' ELSE '' END AS referenced_list
FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem WHERE l_linenumber <= 5 GROUP BY l_orderkey, l_linenumber) l
JOIN orders ON o_orderkey = l_orderkey""",
    "s_index": f"""
SELECT environment_id, run_id, database_name, schema_name, table_name, index_name, key_list, is_unique, is_primary, is_valid, is_ready, has_validity, predicate, size_bytes,
       concat('CREATE INDEX ', index_name, '  ON ', schema_name, '.', table_name, ' USING ', CASE WHEN key_list = 'payload' THEN 'gin' ELSE 'btree' END, ' (', key_list, ')') AS definition
FROM (SELECT {_OBJECT}, concat('ix_', CAST(o_orderkey AS STRING), '_', CAST(l_linenumber AS STRING)) AS index_name,
       CASE l_linenumber WHEN 1 THEN 'id' WHEN 2 THEN 'phone_1,phone_2' WHEN 3 THEN 'phone_1' WHEN 4 THEN 'phone_1' WHEN 5 THEN 'order_status' WHEN 6 THEN 'payload' ELSE 'id' END AS key_list,
       l_linenumber = 1 AND pk % 2 = 0 AS is_unique, l_linenumber = 1 AND pk % 3 = 0 AS is_primary,
       pk % 17 <> 0 AS is_valid, pk % 19 <> 0 AS is_ready, true AS has_validity,
       CASE WHEN pk % 13 = 0 THEN 'id > 0' ELSE '' END AS predicate, pk * 100000 AS size_bytes
      FROM (SELECT l_orderkey, l_linenumber, min(l_partkey) AS pk FROM lineitem GROUP BY l_orderkey, l_linenumber) l
      JOIN orders ON o_orderkey = l_orderkey) t""",
    "s_sequence": f"""
SELECT {_ENV_ORDERS} AS environment_id, {_RUN_ORDERS} AS run_id, {_DB_ORDERS} AS database_name, {_SCHEMA_ORDERS} AS schema_name,
       concat('seq_', CAST(o_orderkey AS STRING)) AS sequence_name,
       CASE WHEN o_orderkey % 2 = 0 THEN 'integer' ELSE 'bigint' END AS data_type,
       CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE concat({_SCHEMA_ORDERS}, '.', {_TABLE_ORDERS}) END AS owned_by_table,
       CASE WHEN o_orderkey % 3 = 0 THEN '' WHEN o_orderkey % 3 = 1 THEN 'id' ELSE 'phone_1' END AS owned_by_column,
       CASE WHEN o_orderkey % 10 <> 0 THEN {_PRICE} END AS last_value,
       CAST(CASE WHEN o_orderkey % 17 = 0 THEN 1000 ELSE 500000 END AS BIGINT) AS max_value
FROM orders""",
    "s_query": """
SELECT concat('env', CAST(user_id % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + user_id % 7 AS STRING)) AS run_id,
       concat('db', CAST(user_id % 3 AS STRING)) AS database_name,
       CASE event_type WHEN 'view' THEN 'select' WHEN 'click' THEN 'select' WHEN 'purchase' THEN 'update' WHEN 'signup' THEN 'insert' ELSE 'other' END AS query_kind,
       concat('fp-', event_type, '-', CAST(event_id AS STRING)) AS fingerprint,
       concat('select phone_1, order_status from tbl_', CAST(event_id % 977 AS STRING), ' where id = ? and owner_', CAST(user_id % 9 AS STRING), ' = ?') AS fingerprint_text,
       CAST(round(value * 40) AS BIGINT) AS calls, CAST(round(value * 400) AS BIGINT) AS shared_blocks_read,
       CAST(round(value * 100) AS BIGINT) * (user_id % 8) AS shared_blocks_hit,
       CAST(round(value * 3000) AS BIGINT) AS total_exec_ms, CAST(round(value * 30) AS BIGINT) AS mean_exec_ms, event_id % 50 AS rows_total,
       CASE WHEN event_id % 6 = 0 THEN 'public.a,public.b' WHEN event_id % 6 = 1 THEN 'nodot' ELSE concat(CASE WHEN event_id % 2 = 0 THEN 'public' ELSE 'sales' END, '.tbl_', CAST(event_id AS STRING)) END AS object_list,
       CASE WHEN event_id % 9 = 0 THEN 'text_only' ELSE 'object_reference' END AS evidence_quality
FROM events""",
    "s_hypertable": """
SELECT environment_id, run_id, database_name, schema_name, hypertable_name,
       count(*) * 40 AS num_chunks, CAST(sum(total_size_bytes) * (1 + max(live_tuples) / 10 % 2 * 4) AS BIGINT) AS total_size_bytes,
       CASE WHEN min(dead_tuples) % 2 = 0 THEN '7 days' ELSE '36 hours' END AS chunk_interval,
       max(dead_tuples) % 4 <> 0 AS compression_enabled
FROM f_chunk GROUP BY environment_id, run_id, database_name, schema_name, hypertable_name""",
    "s_dimension": """
SELECT environment_id, run_id, database_name, schema_name, hypertable_name,
       CASE WHEN hypertable_name LIKE '%9' THEN '' ELSE 'time_col' END AS column_name
FROM s_hypertable""",
    "s_ht_query": """
SELECT concat('env', CAST(p_partkey % 2 AS STRING)) AS environment_id, 'run2001' AS run_id, concat('db', CAST(p_partkey % 3 AS STRING)) AS database_name,
       concat('select avg(v) from ', CASE WHEN p_partkey % 4 = 0 THEN 'x' ELSE concat('HT_', CASE p_size % 4 WHEN 0 THEN 'AF' WHEN 1 THEN 'NF' WHEN 2 THEN 'NO' ELSE 'RF' END, '_', CAST(p_partkey % 10 AS STRING)) END,
              CASE WHEN p_size % 3 = 0 OR p_partkey % 10 < 6 THEN ' where TIME_COL > ?' ELSE ' where device = ?' END) AS fingerprint_text,
       CAST(p_size % 5 AS BIGINT) AS calls,
       CASE WHEN p_partkey % 4 = 0 THEN concat('public.y,public.ht_AF_', CAST(p_partkey % 10 AS STRING)) ELSE '' END AS object_list
FROM part""",
    "s_refresh_policy": """
SELECT concat('env', CAST(s_suppkey % 2 AS STRING)) AS environment_id, 'run2001' AS run_id, concat('db', CAST(s_suppkey % 3 AS STRING)) AS database_name,
       CASE WHEN s_nationkey % 2 = 0 THEN 'public' ELSE '_timescaledb_internal' END AS schema_name,
       concat(CASE WHEN s_nationkey % 2 = 0 THEN 'cagg_' ELSE '_mat_' END, CAST(s_suppkey AS STRING)) AS hypertable_name,
       s_suppkey AS job_id, CASE WHEN s_nationkey % 7 = 0 THEN 'retention' ELSE 'refresh' END AS policy_type,
       CASE s_nationkey % 4 WHEN 0 THEN '{"start_offset": "12 days"}' WHEN 1 THEN '{"start_offset": "2 weeks"}' WHEN 2 THEN '{}' ELSE '{"start_offset": "3 hours"}' END AS config
FROM supplier WHERE s_suppkey % 8 <> 3""",
    "s_coverage": """
SELECT concat('env', CAST(s_suppkey AS STRING)) AS environment_id, concat('run', CAST(s_suppkey AS STRING)) AS run_id,
       CASE WHEN s_suppkey % 6 = 0 THEN 'chunk list Truncated at the cap' ELSE 'slow catalog' END AS warning
FROM supplier WHERE s_suppkey % 5 <> 0
UNION ALL
SELECT concat('env', CAST(s_suppkey AS STRING)), concat('run', CAST(s_suppkey AS STRING)), 'partial' FROM supplier WHERE s_suppkey % 2 = 0""",
    "s_policy": """
SELECT environment_id, run_id, database_name, schema_name, hypertable_name, min(n) AS job_id, policy_type,
       concat('policy_', policy_type) AS proc_name,
       CASE WHEN min(n) % 7 < 3 THEN '12 hours' ELSE '1 day' END AS schedule_interval,
       CASE policy_type WHEN 'retention' THEN concat('{"drop_after": "', CASE WHEN min(n) % 3 = 0 THEN '1 day' WHEN min(n) % 3 = 1 THEN '10 days' ELSE '14 days' END, '"}')
            WHEN 'compression' THEN CASE WHEN min(n) % 3 = 0 THEN '{"compress_after": "7 days"}' ELSE '{"compress_after": "7 days", "compress_segmentby": "device"}' END
            WHEN 'refresh' THEN CASE WHEN min(n) % 3 = 0 THEN '{"start_offset": "3 days", "end_offset": "1 hour"}' ELSE '{"start_offset": "2 hours", "end_offset": "1 hour"}' END
            ELSE '' END AS config,
       true AS scheduled, CASE WHEN min(n) % 5 = 0 THEN 'Failed' ELSE 'Success' END AS last_run_status
FROM (SELECT environment_id, run_id, database_name, schema_name, hypertable_name, dead_tuples + live_tuples AS n,
             CASE (dead_tuples + live_tuples) % 4 WHEN 0 THEN 'retention' WHEN 1 THEN 'compression' WHEN 2 THEN 'refresh' ELSE 'reorder' END AS policy_type
      FROM f_chunk WHERE live_tuples % 3 <> 0) t
WHERE NOT (policy_type = 'retention' AND hypertable_name LIKE '%3') AND NOT (policy_type = 'compression' AND hypertable_name LIKE '%4') AND NOT (policy_type = 'reorder' AND hypertable_name LIKE '%5')
GROUP BY environment_id, run_id, database_name, schema_name, hypertable_name, policy_type""",
    "s_cagg": """
SELECT concat('env', CAST(s_suppkey % 2 AS STRING)) AS environment_id, 'run2001' AS run_id, concat('db', CAST(s_suppkey % 3 AS STRING)) AS database_name,
       'public' AS schema_name, concat('cagg_', CAST(s_suppkey AS STRING)) AS view_name,
       '_timescaledb_internal' AS materialization_schema, concat('_mat_', CAST(s_suppkey AS STRING)) AS materialization_hypertable,
       s_suppkey % 4 <> 0 AS materialized_only, s_suppkey % 5 <> 0 AS has_refresh_policy,
       concat('SELECT ', CAST(s_nationkey AS STRING)) AS view_definition,
       CASE s_suppkey % 4 WHEN 0 THEN '2 hours' WHEN 1 THEN '30 min' WHEN 2 THEN '20 days' ELSE '' END AS lag,
       'public' AS source_schema, concat('ht_AF_', CAST(s_suppkey % 10 AS STRING)) AS source_name,
       CAST(CASE WHEN s_suppkey % 2 = 0 THEN 12 ELSE 0 END AS BIGINT) AS refresh_window_days
FROM supplier""",
    "s_job": """
SELECT concat('env', CAST(c_custkey % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + c_custkey % 7 AS STRING)) AS run_id,
       concat('db', CAST(c_custkey % 3 AS STRING)) AS database_name, c_custkey AS job_id, c_name AS application, lower(c_mktsegment) AS proc_name,
       c_custkey % 3 <> 0 AS scheduled,
       CASE c_custkey % 8 WHEN 0 THEN ' ERROR ' WHEN 1 THEN 'crash' ELSE 'success' END AS last_run_status,
       CAST(c_nationkey % 6 AS BIGINT) AS total_failures,
       CASE c_custkey % 4 WHEN 0 THEN '1 hour' WHEN 1 THEN '30 min' WHEN 2 THEN '' ELSE '1 day' END AS schedule_interval,
       CASE c_custkey % 5 WHEN 0 THEN '45 min' WHEN 1 THEN '2 hours' WHEN 2 THEN '1h30m' ELSE '10 seconds' END AS last_run_duration,
       CAST(16 AS BIGINT) AS max_background_workers
FROM customer""",
    "s_lock": """
SELECT concat('env', CAST(user_id % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + user_id % 7 AS STRING)) AS run_id,
       concat('db', CAST(user_id % 3 AS STRING)) AS database_name, event_type AS mode, concat('rel_', CAST(user_id AS STRING)) AS relation,
       event_id AS pid, event_id % 3 = 0 AS granted, CAST(round(value) AS BIGINT) AS wait_seconds
FROM events""",
    "s_connection": """
SELECT concat('env', CAST(c_custkey % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + c_custkey % 7 AS STRING)) AS run_id,
       concat('db', CAST(c_custkey % 3 AS STRING)) AS database_name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS role_name, lower(c_mktsegment) AS state,
       CAST(round(c_acctbal / 100) AS BIGINT) AS connections, CAST(CASE WHEN c_custkey % 10 = 0 THEN 0 ELSE 100 END AS BIGINT) AS max_connections
FROM customer""",
    "s_role": """
SELECT concat('env', CAST(c_custkey % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + c_custkey % 7 AS STRING)) AS run_id,
       concat('db', CAST(c_custkey % 3 AS STRING)) AS database_name, concat('role_', CAST(c_custkey - c_custkey % 2 AS STRING)) AS role_name,
       c_nationkey = 3 AS superuser, c_nationkey = 5 AS bypass_rls, c_nationkey = 7 AS replication, c_nationkey IN (3, 9, 10) AS create_role, c_nationkey = 11 AS create_db,
       c_custkey % 5 <> 0 AS login, c_custkey % 9 = 0 AS is_current, c_nationkey = 12 AS can_write, c_nationkey = 13 AS privilege_check_failed,
       CASE WHEN c_custkey % 6 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' END AS valid_until, TIMESTAMP '2001-06-01 00:00:00' AS collected_at,
       c_custkey % 7 = 0 AS possibly_inactive,
       CASE WHEN c_nationkey = 14 THEN 'createrole:ops,pg_monitor:watch' WHEN c_nationkey = 15 THEN 'pg_read_all_data:reader' ELSE '' END AS inherited_list,
       CASE WHEN c_custkey % 2 = 0 THEN '15.8' ELSE '16.4 (Debian)' END AS server_version
FROM customer""",
    "s_function": """
SELECT concat('env', CAST(p_partkey % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + p_partkey % 7 AS STRING)) AS run_id,
       concat('db', CAST(p_partkey % 3 AS STRING)) AS database_name, CASE WHEN p_partkey % 4 = 0 THEN 'public' ELSE 'app' END AS schema_name,
       concat('fn_', CAST(p_partkey AS STRING)) AS function_name, CASE WHEN p_size % 3 = 0 THEN '' ELSE 'a integer' END AS identity_args,
       p_size % 2 = 0 AS is_security_definer, p_brand AS owner, lower(p_type) AS language,
       CASE p_size % 5 WHEN 0 THEN 'work_mem=4MB, SEARCH_PATH=app' WHEN 1 THEN 'work_mem=4MB' ELSE '' END AS config, p_size % 7 = 0 AS search_path_pinned
FROM part""",
    "s_grant": """
SELECT concat('env', CAST(p_partkey % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + p_partkey % 7 AS STRING)) AS run_id,
       concat('db', CAST(p_partkey % 3 AS STRING)) AS database_name, CASE WHEN p_partkey % 4 = 0 THEN 'public' ELSE 'app' END AS schema_name, 'table' AS object_type,
       concat('t_', CAST(p_partkey AS STRING)) AS object_name,
       CASE p_size % 6 WHEN 0 THEN 'PUBLIC' WHEN 1 THEN ' public ' WHEN 2 THEN '' ELSE concat('app_', CAST(p_size AS STRING)) END AS grantee,
       CASE p_partkey % 5 WHEN 0 THEN 'SELECT,INSERT' WHEN 1 THEN 'SELECT' WHEN 2 THEN 'truncate' WHEN 3 THEN 'USAGE' ELSE 'ALL' END AS privilege_list,
       p_partkey % 8 = 0 AS grantable
FROM part""",
    "s_schema": """
SELECT concat('env', CAST(c_custkey % 2 AS STRING)) AS environment_id, concat('run', CAST(1995 + c_custkey % 7 AS STRING)) AS run_id,
       concat('db', CAST(c_custkey AS STRING)) AS database_name, CASE WHEN c_custkey % 3 = 0 THEN 'public' ELSE 'app' END AS schema_name,
       CASE c_nationkey % 4 WHEN 0 THEN 'owner=UC/owner' WHEN 1 THEN 'owner=UC/owner|=U/owner' WHEN 2 THEN 'a=U/b' ELSE '=C/owner' END AS acl_list
FROM customer""",
    "s_server": """
SELECT concat('env', CAST(s_suppkey AS STRING)) AS environment_id, concat('run', CAST(s_suppkey AS STRING)) AS run_id, s_name AS name, concat('fleet', CAST(s_suppkey % 20 AS STRING)) AS fleet,
       CASE WHEN s_nationkey % 3 = 0 THEN '15.8' ELSE '16.4' END AS server_version, CASE WHEN s_nationkey % 4 = 0 THEN '' WHEN s_nationkey % 4 = 1 THEN '2.17.0' ELSE '2.18.1' END AS timescale_version,
       s_suppkey % 3 <> 0 AS expects_replica, CAST(round(s_acctbal * 20000) AS BIGINT) AS replay_lag_bytes,
       CASE WHEN s_suppkey % 4 = 0 THEN TIMESTAMP '2001-01-02 00:00:00' END AS last_archived, CASE WHEN s_suppkey % 5 = 0 THEN TIMESTAMP '2001-01-03 00:00:00' END AS last_failed_archive,
       CAST(s_suppkey % 2 AS BIGINT) AS archive_failed_count
FROM supplier""",
    "s_extension": """
SELECT DISTINCT concat('env', CAST(c_nationkey * 4 + c_custkey % 4 AS STRING)) AS environment_id,
       concat('fleet', CAST((c_nationkey * 4 + c_custkey % 4) % 20 AS STRING)) AS fleet,
       concat('db', CAST(c_custkey % 3 AS STRING)) AS database_name, concat('ext', CAST(c_custkey % 7 AS STRING)) AS extension,
       concat('1.', CAST(c_nationkey % 2 + c_custkey % 2 AS STRING)) AS version
FROM customer""",
    "s_setting": """
SELECT environment_id, fleet, setting,
       CASE WHEN v % 7 = 0 THEN '' WHEN setting = 'shared_buffers' THEN concat(CAST(4 + v % 3 AS STRING), 'GB')
            WHEN setting = 'work_mem' THEN concat(CAST(1024 + v % 30 AS STRING), CASE WHEN v % 2 = 0 THEN 'MB' ELSE 'kB' END) ELSE CAST(100 + v % 20 AS STRING) END AS value
FROM (SELECT concat('env', CAST(c_nationkey * 4 + c_custkey % 4 AS STRING)) AS environment_id,
             concat('fleet', CAST((c_nationkey * 4 + c_custkey % 4) % 20 AS STRING)) AS fleet,
             CASE (c_custkey + c_nationkey) % 5 WHEN 0 THEN 'shared_buffers' WHEN 1 THEN 'work_mem' WHEN 2 THEN 'max_connections' WHEN 3 THEN 'timescaledb.max_background_workers' ELSE 'other' END AS setting,
             max(c_custkey) AS v
      FROM customer GROUP BY 1, 2, 3) t""",
    "s_campaign": """
SELECT concat('env', CAST(n_nationkey % 2 AS STRING)) AS environment_id, concat('camp', CAST(n_nationkey AS STRING)) AS campaign_id,
       CASE n_nationkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'closed' ELSE 'in_review' END AS status,
       CASE WHEN n_nationkey % 2 = 0 THEN TIMESTAMP '2001-01-01 00:00:00' ELSE TIMESTAMP '2001-12-01 00:00:00' END AS due_at,
       CASE WHEN n_nationkey % 5 = 0 THEN TIMESTAMP '2001-02-01 00:00:00' END AS closed_at
FROM nation""",
    "s_campaign_item": """
SELECT concat('camp', CAST(c_nationkey AS STRING)) AS campaign_id, concat('i', CAST(c_custkey AS STRING)) AS item_id, concat('u', CAST(c_custkey % 700 AS STRING)) AS account_name, 'table' AS object_type,
       CASE WHEN c_custkey % 4 = 0 THEN concat('public.t', CAST(c_custkey % 90 AS STRING)) ELSE concat('app.t', CAST(c_custkey % 90 AS STRING)) END AS object_name,
       CASE WHEN c_custkey % 6 = 0 THEN 'email' ELSE '' END AS column_name,
       CASE c_custkey % 3 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'UPDATE' ELSE 'DELETE' END AS privilege,
       CASE c_custkey % 5 WHEN 0 THEN 'public' WHEN 1 THEN 'direct' ELSE 'role' END AS origin_kind,
       concat(CASE WHEN c_custkey % 7 = 0 THEN 'powerful_role,' ELSE '' END, CASE WHEN c_custkey % 8 = 0 THEN 'inactive_or_expired,' ELSE '' END, CASE WHEN c_custkey % 5 = 1 THEN 'new_since_previous' ELSE '' END) AS highlight_list,
       c_custkey % 2 = 0 AS still_present
FROM customer""",
    "s_decision": """
SELECT concat('i', CAST(o_custkey AS STRING)) AS item_id, concat('d', CAST(o_orderkey AS STRING)) AS decision_id,
       CASE o_orderkey % 4 WHEN 0 THEN 'approve' WHEN 1 THEN 'keep' ELSE 'revoke' END AS decision, o_orderdate AS decided_at,
       CASE WHEN o_orderkey % 4 > 1 THEN o_orderdate + INTERVAL '30' DAY END AS revoke_due_at,
       CASE WHEN o_orderkey % 6 = 0 THEN concat('d', CAST(o_orderkey - 1 AS STRING)) END AS supersedes_id
FROM orders WHERE o_custkey % 3 <> 1""",
    "s_pii_column": f"""
SELECT {_OBJECT}, CASE l_linenumber WHEN 1 THEN 'nr_cpf' WHEN 2 THEN 'EmailAddress' WHEN 3 THEN 'phone_1' WHEN 4 THEN 'Endereco-Cobranca' WHEN 5 THEN 'zip code' WHEN 6 THEN 'hotmailbox' ELSE 'x_rg' END AS column_name,
       CASE WHEN l_linenumber IN (1, 2) THEN 'character varying' WHEN l_linenumber = 3 THEN 'bigint' WHEN l_linenumber = 4 THEN 'jsonb' ELSE 'TEXT' END AS data_type,
       l_linenumber AS position, CAST(l_quantity AS BIGINT) % 9 AS read_accounts, o_custkey % 4 = 0 AS has_rls,
       CASE WHEN l_quantity > 30 THEN 'alta' WHEN l_quantity > 15 THEN 'media' ELSE 'baixa' END AS confidence,
       CASE l_linenumber WHEN 1 THEN 'cpf' WHEN 2 THEN 'email' WHEN 3 THEN 'telefone' WHEN 4 THEN 'endereco' WHEN 5 THEN 'cep' WHEN 6 THEN 'email' ELSE 'rg' END AS category,
       CASE WHEN o_custkey % 2 = 0 THEN 'nivel_tabela' ELSE 'nivel_coluna' END AS access_level
FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY l_orderkey, l_linenumber) l
JOIN orders ON o_orderkey = l_orderkey""",
    "s_contact": """
SELECT c_custkey AS contact_id,
       concat(lpad(CAST(c_custkey % 999 AS STRING), 3, '0'), '.', lpad(CAST(c_custkey * 7 % 1000 AS STRING), 3, '0'), '.247-', lpad(CAST(c_nationkey * 4 AS STRING), 2, '0')) AS cpf,
       concat(CASE WHEN c_custkey % 3 = 0 THEN '04252011' ELSE '12ABC345' END, CASE WHEN c_custkey % 3 = 0 THEN '0001' ELSE '01DE' END, CASE WHEN c_custkey % 5 = 0 THEN '35' ELSE '10' END) AS cnpj,
       CASE WHEN c_custkey % 10 = 0 THEN ' ' WHEN c_custkey % 10 = 1 THEN 'no mail' ELSE concat(lower(c_mktsegment), CAST(c_custkey AS STRING), '@example.com') END AS email,
       CASE WHEN c_nationkey = 0 THEN NULL WHEN c_nationkey % 4 = 0 THEN concat('+55 ', CAST(11 + c_nationkey AS STRING), ' 9', lpad(CAST(c_custkey % 10000 AS STRING), 4, '1'), '-5678') ELSE concat(CAST(10 + c_nationkey AS STRING), ' 34', lpad(CAST(c_custkey % 100 AS STRING), 2, '0'), '-7890') END AS phone,
       concat(lpad(CAST(c_custkey % 100000 AS STRING), 5, '0'), '-', CASE WHEN c_custkey % 6 = 0 THEN '10' ELSE '100' END) AS cep,
       CASE WHEN c_custkey % 2 = 0 THEN concat('550e8400-e29b-41d4-a716-', lpad(CAST(c_custkey AS STRING), 12, '0')) ELSE CAST(c_custkey AS STRING) END AS pix
FROM customer""",
    "s_column_grant": f"""
SELECT DISTINCT {_OBJECT}, 'nr_cpf' AS column_name, concat('role_', CAST(l_suppkey AS STRING)) AS account_name, CASE WHEN l_suppkey % 5 = 0 THEN 'update' ELSE 'select' END AS privilege
FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1 AND l_suppkey % 3 = 0""",
    "s_table_grant": f"""
SELECT {_OBJECT}, concat('role_', CAST(l_suppkey AS STRING)) AS grantee, CASE WHEN min(l_partkey) % 4 = 0 THEN 'INSERT' WHEN min(l_partkey) % 4 = 1 THEN 'insert,all' ELSE 'Select' END AS privilege_list
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
GROUP BY {_ENV_ORDERS}, {_RUN_ORDERS}, {_DB_ORDERS}, {_SCHEMA_ORDERS}, {_TABLE_ORDERS}, l_suppkey""",
    "s_login_role": """
SELECT DISTINCT concat('env', CAST(o_custkey % 2 AS STRING)) AS environment_id, concat('run', CAST(year(o_orderdate) AS STRING)) AS run_id,
       concat('role_', CAST(s_suppkey AS STRING)) AS role_name, s_suppkey % 2 = 0 AS can_login
FROM orders JOIN supplier ON s_suppkey = o_orderkey % 100""",
    "s_twin_column": """
SELECT DISTINCT concat('env', CAST(p_partkey % 2 AS STRING)) AS environment_id, 'run1' AS run_id, 'db0' AS database_name,
       concat('s', CAST(p_partkey % 11 AS STRING)) AS schema_name, concat(replace(p_name, ' ', '_'), '_', CAST(p_size AS STRING)) AS table_name, column_name,
       CASE WHEN column_name = 'id' AND p_partkey % 4 < 2 THEN 'integer' WHEN column_name = 'id' THEN 'numeric(10,2)' WHEN column_name = 'kind' AND p_partkey % 6 = 0 THEN 'uuid' ELSE 'text' END AS data_type
FROM (SELECT p_partkey, p_name, p_size, 'id' AS column_name FROM part
      UNION ALL SELECT p_partkey, p_name, p_size, 'name' FROM part
      UNION ALL SELECT p_partkey, p_name, p_size, 'kind' FROM part WHERE p_size % 5 <> 0) c""",
    "s_policy_override": """
SELECT environment_id, schema_name, rule_id, k % 7 <> 1 AS enabled, 3 + k % 2 AS min_indexes, 1000 * (1 + k % 3) AS min_writes
FROM (SELECT concat('env', CAST(c_custkey % 2 AS STRING)) AS environment_id, CASE WHEN c_custkey % 3 = 0 THEN '' WHEN c_custkey % 3 = 1 THEN 'sales' ELSE 'public' END AS schema_name,
             CASE WHEN c_custkey % 5 = 0 THEN 'model.type_review' ELSE 'index.write_burden' END AS rule_id, min(c_custkey) AS k
      FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0 GROUP BY 1, 2, 3) t""",
    "f_observed": """
SELECT environment_id, run_id, min(started_at) AS started_at, database_name, schema_name, object_name, rule_id, category, title,
       concat(database_name, '.', schema_name, '.', object_name) AS object_key,
       concat(database_name, '.', object_name, '/', title) AS dedup_key, max(severity) AS severity,
       concat('{"s":"', max(severity), '"}') AS evidence, CAST(CAST(substr(object_name, 2) AS INT) AS BIGINT) AS k,
       CAST(0.5 AS DOUBLE) AS confidence
FROM f_finding_event
GROUP BY environment_id, run_id, database_name, schema_name, object_name, rule_id, category, title""",
    "f_state": """
SELECT environment_id, dedup_key, CASE WHEN k % 6 = 5 THEN '0.9.0' ELSE '1.0.0' END AS rule_version, md5(concat(environment_id, dedup_key)) AS finding_id,
       rule_id, object_key, run_id, severity, title, evidence, confidence,
       CASE k % 5 WHEN 0 THEN 'resolved' WHEN 1 THEN 'suppressed' WHEN 2 THEN 'suppressed' WHEN 3 THEN 'acknowledged' ELSE 'open' END AS status,
       TIMESTAMP '2024-01-05 00:00:00' AS first_seen_at, TIMESTAMP '2024-01-05 00:00:00' AS last_seen_at,
       CASE WHEN k % 5 = 0 THEN TIMESTAMP '2024-01-06 00:00:00' END AS resolved_at, CAST(k % 3 AS INT) AS recurrence_count,
       CASE k % 5 WHEN 1 THEN TIMESTAMP '2024-01-10 00:00:00' WHEN 2 THEN TIMESTAMP '2024-03-01 00:00:00' END AS suppressed_until,
       CAST(NULL AS STRING) AS superseded_by, k
FROM f_observed WHERE run_id = 'd5'""",
    "f_action": """
SELECT environment_id, dedup_key, rule_version, CASE WHEN k % 4 = 0 THEN 'discarded' ELSE 'in_review' END AS action_status,
       CASE WHEN k % 8 = 0 THEN evidence ELSE '{"s":"high"}' END AS signed_evidence,
       CASE WHEN k % 3 = 0 THEN TIMESTAMP '2024-01-15 00:00:00' WHEN k % 3 = 1 THEN TIMESTAMP '2024-02-15 00:00:00' END AS suppress_until
FROM f_state WHERE k % 2 = 0""",
    "s_database": """
SELECT environment_id, run_id, database_name, CAST(sum(total_size_bytes) AS BIGINT) AS size_bytes, database_name = 'MACHINERY' AS is_template
FROM f_table_snapshot WHERE run_id NOT LIKE '%9911' GROUP BY environment_id, run_id, database_name""",
    "s_collector": """
SELECT environment_id, run_id, database_name, CASE CAST(substr(collector, 8) AS INT) % 4 WHEN 0 THEN 'postgres.tables' WHEN 1 THEN 'postgres.columns' WHEN 2 THEN 'postgres.constraints' ELSE 'postgres.indexes' END AS collector, min(status) AS status
FROM f_coverage GROUP BY 1, 2, 3, 4""",
    "s_monthly_finding": """
SELECT concat('env', CAST(o_custkey % 2 AS STRING)) AS environment_id, concat('env', CAST(o_custkey % 2 AS STRING), '-', CAST(year(o_orderdate) * 100 + month(o_orderdate) AS STRING)) AS run_id,
       c_mktsegment AS database_name, CASE WHEN c_nationkey % 2 = 0 THEN 'public' ELSE 'sales' END AS schema_name,
       CASE o_orderkey % 6 WHEN 0 THEN 'security' WHEN 1 THEN 'index' WHEN 2 THEN 'vacuum' WHEN 3 THEN 'integrity' WHEN 4 THEN 'config' ELSE 'performance' END AS category,
       CASE o_orderkey % 5 WHEN 0 THEN 'critical' WHEN 1 THEN 'high' WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE 'info' END AS severity
FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 9 = 0""",
    "s_drill": """
SELECT concat('env', CAST(c_custkey AS STRING)) AS environment_id, CASE WHEN o_orderkey IS NOT NULL THEN concat('drill', CAST(o_orderkey AS STRING)) END AS drill_id, o_orderstatus <> 'P' AS succeeded,
       CASE WHEN o_orderkey % 3 <> 0 THEN CAST(round(o_totalprice / 400) AS BIGINT) END AS rto_seconds, o_orderdate AS performed_at, o_orderkey
FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderkey % 2 = 0""",
    "s_price": """
SELECT DISTINCT concat('env', CAST(s_suppkey % 4 AS STRING)) AS environment_id, CAST(s_nationkey AS BIGINT) AS version, 'BRL' AS currency,
       CAST(s_nationkey + 1 AS BIGINT) AS storage_cents, CASE WHEN s_nationkey % 2 = 0 THEN CAST(50000 + s_nationkey AS BIGINT) END AS instance_cents,
       CASE WHEN s_nationkey % 3 = 0 THEN CAST(s_nationkey + 7 AS BIGINT) END AS io_gb_cents,
       CAST(s_nationkey + 30 AS BIGINT) AS vcpu_hour_cents, TIMESTAMP '1995-01-01 00:00:00' + INTERVAL '100' DAY * s_nationkey AS effective_from
FROM supplier""",
}


def register_tables(spark: SparkSession, folder: str, names: list[str]) -> None:
    """Make plain tables of a folder readable by SQL, one Parquet file or directory each."""
    for name in names:
        spark.read.parquet(os.path.join(folder, f"{name}.parquet")).createOrReplaceTempView(name)


def _words(name: str) -> set[str]:
    return set(re.findall(r"\w+", VIEWS[name]))


def required(*names: str) -> list[str]:
    """The views behind some views, in reading order."""
    wanted = set(names)
    order = list(VIEWS)
    for name in reversed(order):
        if name in wanted:
            wanted |= {other for other in order if other != name and other in _words(name)}
    return [name for name in order if name in wanted]


def ctes(*names: str) -> str:
    """``WITH`` clause that defines the views for a single statement."""
    return "WITH " + ",\n".join(f"{name} AS ({VIEWS[name]})" for name in required(*names))


def view(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One derived snapshot table over the tables of a folder."""
    used = set().union(*[_words(v) for v in required(name)])
    register_tables(spark, folder, [t for t in SOURCE_TABLES if t in used])
    return spark.sql(f"{ctes(name)} SELECT * FROM {name}")
