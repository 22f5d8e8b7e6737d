"""Deep pages of the queue and the inventory, and search over postings."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, scratch
from checks.findings import QUEUE
from checks.scores import REGISTRY as SCORES
from plumbline.operators import findings as fnd
from plumbline.operators import pages, trigrams
from plumbline.operators import scores as sc
from plumbline.plans import derive

REGISTRY = Registry()
OPEN = "status IN ('open', 'acknowledged')"
OFFSET, LIMIT = 45, 40


def opened(spark, folder):
    return derive.view(spark, folder, "f_state").where(OPEN)


def queue_keys():
    return [*fnd.queue_keys(), (F.col("environment_id"), True)]


QUEUE_SQL = derive.ctes("f_state") + f" SELECT environment_id, finding_id, severity, status, row_number() OVER (ORDER BY {QUEUE}, environment_id DESC) AS position FROM f_state WHERE {OPEN} ORDER BY position LIMIT {LIMIT} OFFSET {OFFSET}"


@REGISTRY.add("fnd7_queue_page_at", QUEUE_SQL)
def queue_page(spark, folder):
    path = scratch(spark, "queue")
    pages.write_rank_index(opened(spark, folder), queue_keys(), path)
    return pages.page_at(spark, path, OFFSET, LIMIT).select("environment_id", "finding_id", "severity", "status", F.col("position").cast("bigint").alias("position"))


@REGISTRY.add("fnd7_queue_after", f"SELECT * EXCLUDE (position) FROM ({QUEUE_SQL})")
def queue_after(spark, folder):
    """The page after the row that ends the pages before it."""
    rows, keys = opened(spark, folder), queue_keys()
    last = pages.page_after(rows, keys, limit=OFFSET).orderBy(*pages.ordering([(k, not falls) for k, falls in keys]))
    return pages.page_after(rows, keys, pages.cursor_of(keys, last), LIMIT).select("environment_id", "finding_id", "severity", "status")


TABLE_ORDER = "total_size_bytes DESC, run_id, environment_id, database_name, schema_name, table_name"


@REGISTRY.add(
    "fnd21_inventory_page_at",
    derive.ctes("s_table") + f" SELECT environment_id, run_id, database_name, schema_name, table_name, total_size_bytes FROM s_table WHERE schema_name = 'sales' ORDER BY {TABLE_ORDER} LIMIT 50 OFFSET 300",
)
def inventory_page(spark, folder):
    path = scratch(spark, "inventory")
    names = ("run_id", "environment_id", "database_name", "schema_name", "table_name")
    rows = derive.view(spark, folder, "s_table").where("schema_name = 'sales'").select(*names, "total_size_bytes")
    pages.write_rank_index(rows, [(F.col("total_size_bytes"), True), *[(F.col(n), False) for n in names]], path)
    return pages.page_at(spark, path, 300, 50).select(*names, "total_size_bytes")


@REGISTRY.add("fnd22_search_indexed", SCORES.sql["fnd22_search"])
def search(spark, folder):
    """The same search, each kind narrowed to the rows that the postings of its text give."""
    text = "LOW"
    state = derive.view(spark, folder, "f_state")
    parts = F.split("object_key", r"\.")
    findings = state.select("*", *[F.element_at(parts, i + 1).alias(n) for i, n in enumerate(("database_name", "schema_name", "object_name"))])
    runs, tables = derive.view(spark, folder, "f_run"), derive.view(spark, folder, "f_table_snapshot")

    def found(rows, key, fields):
        path = scratch(spark, "postings")
        trigrams.write_postings(rows, key, fields, path)
        return trigrams.narrowed(rows, trigrams.candidates(spark, path, key, text), key)

    kept = found(findings, ["environment_id", "finding_id"], ["title", "rule_id", "object_name", "object_key", "schema_name", "database_name"])
    seen = found(tables, ["environment_id", "run_id", "database_name", "schema_name", "table_name"], ["table_name"])
    # latest runs must be told from all runs, so those are searched whole: there is one row for each
    return sc.search(text, kept, runs, {"tables": (seen, "table_name")})
