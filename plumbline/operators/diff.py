"""Comparing inventories: fingerprints, object sets, timelines, drift and mappings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import changed, dotted, key_for
from plumbline.functions.text import (
    field_fingerprint,
    fingerprint,
    normalize_name,
    normalize_sql,
    normalize_type,
)
from plumbline.operators.rules.environments import COMPARED_SETTINGS, extension_versions

TABLE = ["environment_id", "run_id", "database_name", "schema_name", "table_name"]


def table_fingerprints(tables: DataFrame, columns: DataFrame, constraints: DataFrame, indexes: DataFrame) -> DataFrame:
    """Structural hash of every table: columns by position, sorted constraints and indexes, gathered in one grouping.

    ``columns``: position, column_name, data_type, nullable, default_expr.
    ``constraints`` and ``indexes``: definition.
    """
    default = F.when(F.col("default_expr") == "", None).otherwise(normalize_sql(F.col("default_expr")))
    part = F.struct(
        F.col("position").cast("int").alias("position"),
        normalize_name(F.col("column_name")).alias("name"),
        normalize_type(F.col("data_type")).alias("type"),
        F.col("nullable").alias("nullable"),
        default.alias("default"),
    )
    definition = normalize_sql(F.col("definition"))
    parts = (
        columns.select(*TABLE, part.alias("column"))
        .unionByName(constraints.select(*TABLE, definition.alias("constraint")), allowMissingColumns=True)
        .unionByName(indexes.select(*TABLE, definition.alias("index")), allowMissingColumns=True)
    )
    keyed = ["_hash", *TABLE]  # a number first: rows are sorted by it, names are compared only where it is equal
    hashed = F.xxhash64(*TABLE).alias("_hash")
    shaped = parts.select(hashed, "*").groupBy(*keyed).agg(
        *[F.array_sort(F.collect_list(kind)).alias(name) for kind, name in (("column", "columns"), ("constraint", "constraints"), ("index", "indexes"))]
    )
    joined = tables.select(hashed, *TABLE).join(shaped, keyed, "left")
    payload = F.struct(
        normalize_name(F.col("schema_name")).alias("schema"),
        normalize_name(F.col("table_name")).alias("name"),
        F.coalesce("columns", F.array()).alias("columns"),
        F.coalesce("constraints", F.array().cast("array<string>")).alias("constraints"),
        F.coalesce("indexes", F.array().cast("array<string>")).alias("indexes"),
    )
    return joined.select(*TABLE, F.sha2(F.to_json(payload), 256).alias("fingerprint"))


def definition_fingerprints(objects: DataFrame, *names: str) -> DataFrame:
    """Structural hash of functions and views: the named attributes lower-cased, and the definition."""
    parts = [normalize_name(F.col(n)).alias(n) for n in names]
    payload = F.struct(*parts, normalize_sql(F.col("definition")).alias("definition"))
    return objects.withColumn("fingerprint", F.sha2(F.to_json(payload), 256))


# --- object sets -------------------------------------------------------------------------------
#: Per object type the name parts of its key and the attributes that make its fingerprint.
ITEM_TYPES: Mapping[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "table": (("table_name",), ("relkind", "has_primary_key", "column_count")),
    "column": (("table_name", "column_name"), ("data_type", "is_nullable", "default_fingerprint", "is_generated")),
    "index": (("table_name", "index_name"), ()),
    "constraint": (("table_name", "constraint_name"), ()),
    "view": (("view_name",), ()),
    "function": (("function_name", "identity_args"), ()),
    "trigger": (("table_name", "trigger_name"), ()),
    "sequence": (("sequence_name",), ("data_type",)),
    "hypertable": (("hypertable_name",), ("num_dimensions", "compression_enabled")),
    "policy": (("table_name", "policy_name"), ()),
}


def build_items(objects: Mapping[str, DataFrame], mappings: DataFrame | None = None) -> DataFrame:
    """Comparable items of all object types: object_type, object_key, object_name, fingerprint, fields.

    Types without attributes of their own bring a ``definition``, which is only
    kept as its fingerprint.  ``mappings`` (object_type, source_key, target_key)
    rewrites keys so that renamed objects meet.
    """
    union = None
    for kind, frame in objects.items():
        names, attributes = ITEM_TYPES[kind]
        if attributes:
            values = {a: F.coalesce(F.col(a).cast("string"), F.lit("")) for a in attributes}
            mark = field_fingerprint(*[F.col(a) for a in attributes])
        else:
            mark = fingerprint(F.col("definition"))
            values = {"definition_fp": mark}
        place = [F.col("database_name"), F.col("schema_name"), *[F.col(n) for n in names]]
        fields = F.map_filter(
            F.create_map(*[x for name, value in values.items() for x in (F.lit(name), value)]),
            lambda k, v: (v != "") | (k != "default_fingerprint"),
        )
        items = frame.select(
            "environment_id",
            "run_id",
            F.lit(kind).alias("object_type"),
            key_for(*place).alias("object_key"),
            F.concat_ws(".", "schema_name", *names).alias("object_name"),
            mark.alias("fingerprint"),
            fields.alias("fields"),
        )
        union = items if union is None else union.unionByName(items)
    if mappings is None:
        return union
    renamed = mappings.select(
        F.lower("object_type").alias("object_type"), normalize_name(F.col("source_key")).alias("object_key"), "target_key"
    )
    return union.join(renamed, ["object_type", "object_key"], "left").withColumn(
        "object_key", F.coalesce("target_key", "object_key")
    ).drop("target_key")


def _side(items: DataFrame, name: str, by: Sequence[str]) -> DataFrame:
    return items.select(
        *by,
        F.lower("object_type").alias("match_type"),
        normalize_name(F.col("object_key")).alias("match_key"),
        F.struct("object_type", "object_key", "object_name", "fingerprint", "fields").alias(name),
    )


def compare_sets(source: DataFrame, target: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Objects of two sets with their status and the fields that differ.

    Two fingerprints decide alone; without them the fields do, and objects with
    neither are UNKNOWN.  ``by`` names columns both sides share, to compare many
    pairs of sets at once.
    """
    by = list(by)
    keys = [*by, "match_type", "match_key"]
    both = _side(source, "s", by).join(_side(target, "t", by), keys, "full")
    s, t = F.col("s"), F.col("t")
    empty_map = F.create_map().cast("map<string,string>")
    left, right = F.coalesce(s["fields"], empty_map), F.coalesce(t["fields"], empty_map)
    marked = (F.coalesce(s["fingerprint"], F.lit("")) != "") & (F.coalesce(t["fingerprint"], F.lit("")) != "")
    bare = (
        (F.coalesce(s["fingerprint"], F.lit("")) == "")
        & (F.coalesce(t["fingerprint"], F.lit("")) == "")
        & (F.size(left) == 0)
        & (F.size(right) == 0)
    )
    differing = F.map_filter(F.map_zip_with(left, right, lambda k, a, b: ~a.eqNullSafe(b)), lambda k, d: d)
    fields = F.when(marked, F.when(s["fingerprint"] != t["fingerprint"], F.array(F.lit("fingerprint"))).otherwise(F.array().cast("array<string>"))).otherwise(
        F.array_sort(F.map_keys(differing))
    )
    status = (
        F.when(t.isNull(), "ONLY_SOURCE")
        .when(s.isNull(), "ONLY_TARGET")
        .when(~marked & bare, "UNKNOWN")
        .when(F.size(fields) == 0, "MATCH")
        .otherwise("DRIFT")
    )
    return both.select(
        *by,
        F.coalesce(s["object_type"], t["object_type"]).alias("object_type"),
        F.coalesce(s["object_key"], t["object_key"]).alias("object_key"),
        status.alias("status"),
        s["object_name"].alias("source_name"),
        t["object_name"].alias("target_name"),
        F.when(s.isNotNull(), F.coalesce(s["fingerprint"], F.lit(""))).alias("source_fingerprint"),
        F.when(t.isNotNull(), F.coalesce(t["fingerprint"], F.lit(""))).alias("target_fingerprint"),
        F.when(s.isNotNull() & t.isNotNull(), fields).alias("changed_fields"),
    )


def diff_summary(diffs: DataFrame, *by: str) -> DataFrame:
    """Objects per status."""
    return diffs.groupBy(*by, "status").agg(F.count(F.lit(1)).alias("objects"))


def filter_diffs(diffs: DataFrame, statuses: Sequence[str] = (), object_type: str = "") -> DataFrame:
    kept = diffs
    if statuses:
        kept = kept.where(F.col("status").isin(*[s.strip().upper() for s in statuses]))
    if object_type.strip():
        kept = kept.where(F.lower("object_type") == object_type.lower())
    return kept


def suggest_mappings(source: DataFrame, target: DataFrame, default_database: str = "tsdb") -> DataFrame:
    """Likely counterpart of every source object; the first rule that fits wins.

    A database with a schema of its name (0.85), an equal fingerprint (0.95), or
    an equal schema, type and name (0.7).  Of several targets the last by name stands.
    Inputs: database_name, schema_name, object_type, object_name, fingerprint.
    """
    columns = ["database_name", "schema_name", "object_type", "object_name", "fingerprint"]
    shape = F.struct(*columns)

    def pick(df: DataFrame, *keys: Column) -> DataFrame:
        return df.groupBy(*keys).agg(F.max(shape).alias("t"))

    name_key = normalize_name(F.col("object_name")).alias("name_key")
    schemas = pick(target.where(F.col("object_type").isin("schema", "database")), name_key).withColumnRenamed("t", "schema_hit")
    marks = pick(target.where(F.col("fingerprint") != ""), F.col("fingerprint")).withColumnRenamed("t", "mark_hit")
    full = [
        normalize_name(F.col("schema_name")).alias("schema_key"),
        F.lower("object_type").alias("type_key"),
        name_key,
    ]
    names = pick(target, *full).withColumnRenamed("t", "name_hit")
    joined = (
        source.select(*columns, *full)
        .join(schemas, "name_key", "left")
        .join(marks, "fingerprint", "left")
        .join(names, ["schema_key", "type_key", "name_key"], "left")
    )
    as_schema = (F.col("object_type") == "database") & F.col("schema_hit").isNotNull()
    as_same = F.col("mark_hit").isNotNull()
    hit = F.when(as_schema, F.col("schema_hit")).when(as_same, F.col("mark_hit")).otherwise(F.col("name_hit"))
    found = joined.withColumn("hit", hit).where(F.col("hit").isNotNull())
    return found.select(
        *[F.col(c).alias(f"source_{c}") for c in columns[:4]],
        F.when(as_schema, default_database).otherwise(F.col("hit.database_name")).alias("target_database_name"),
        F.when(as_schema, F.col("hit.object_name")).otherwise(F.col("hit.schema_name")).alias("target_schema_name"),
        F.when(as_schema, "schema").otherwise(F.col("hit.object_type")).alias("target_object_type"),
        F.col("hit.object_name").alias("target_object_name"),
        F.when(as_schema, "database_to_schema").otherwise("identical").alias("relation_type"),
        F.when(as_schema, 0.85).when(as_same, 0.95).otherwise(0.7).alias("confidence"),
    )


# --- timelines ---------------------------------------------------------------------------------
def timeline_pairs(runs: DataFrame, coverage: DataFrame) -> DataFrame:
    """Every finished run with the run its schema is compared with, and the gap that forbids it.

    ``gap_reason`` is empty when the pair may be compared, else partial_run,
    prior_incomplete or partial_between; NULL previous_run_id with an empty
    reason means there is nothing to compare yet.
    """
    broken = coverage.where(F.lower("status") == "failed").select("environment_id", "run_id").distinct()
    marked = runs.join(broken.withColumn("broken", F.lit(True)), ["environment_id", "run_id"], "left")
    success = F.col("status") == "success"
    complete = success & F.col("broken").isNull()
    order = W.partitionBy("environment_id").orderBy("started_at", "run_id")
    seen = marked.withColumn("complete", complete).withColumn(
        "bad_so_far",
        F.sum(F.col("status").isin("partial_success", "failed", "cancelled").cast("int")).over(
            order.rowsBetween(W.unboundedPreceding, W.currentRow)
        ),
    )
    mark = F.struct("run_id", "started_at", "complete", "bad_so_far")
    alike = W.partitionBy("environment_id", "profile", "collector_version", "status").orderBy("started_at", "run_id")
    before = W.partitionBy("environment_id").orderBy("started_at", "run_id").rowsBetween(W.unboundedPreceding, -1)
    paired = seen.withColumn("prior", F.lag(mark).over(alike)).withColumn(
        "last_success", F.last(F.when(success, F.struct("run_id", "started_at")), ignorenulls=True).over(before)
    )
    partial = (F.col("status") == "partial_success") | (success & ~F.col("complete"))
    between = F.col("bad_so_far") > F.col("prior.bad_so_far")
    reason = (
        F.when(partial, "partial_run")
        .when(F.col("prior").isNull(), "")
        .when(~F.col("prior.complete"), "prior_incomplete")
        .when(between, "partial_between")
        .otherwise("")
    )
    return paired.where(success | (F.col("status") == "partial_success")).select(
        "environment_id",
        "run_id",
        "started_at",
        F.when(partial, F.col("last_success.run_id")).otherwise(F.col("prior.run_id")).alias("previous_run_id"),
        F.when(partial, F.col("last_success.started_at")).otherwise(F.col("prior.started_at")).alias("previous_started_at"),
        reason.alias("gap_reason"),
    )


def timeline_gaps(pairs: DataFrame) -> DataFrame:
    """Runs whose schema could not be compared, and why."""
    return pairs.where(F.col("gap_reason") != "").select(
        "environment_id",
        "previous_run_id",
        "run_id",
        F.coalesce("previous_started_at", "started_at").alias("gap_from"),
        F.col("started_at").alias("gap_to"),
        F.col("gap_reason").alias("reason"),
    )


def timeline_events(items: DataFrame, pairs: DataFrame) -> DataFrame:
    """Objects added, removed or modified between each run and the run before it, all runs at once.

    ``items`` is the result of ``build_items`` for all runs.
    """
    usable = pairs.where((F.col("gap_reason") == "") & F.col("previous_run_id").isNotNull())
    current = items.join(usable.select("environment_id", "run_id"), ["environment_id", "run_id"])
    shift = usable.select("environment_id", F.col("previous_run_id").alias("run_id"), F.col("run_id").alias("next_run_id"))
    before = items.join(shift, ["environment_id", "run_id"]).drop("run_id").withColumnRenamed("next_run_id", "run_id")
    diffs = compare_sets(before, current, ["environment_id", "run_id"])
    kind = (
        F.when(F.col("status") == "ONLY_TARGET", "added")
        .when(F.col("status") == "ONLY_SOURCE", "removed")
        .when(F.col("status") == "DRIFT", "modified")
    )
    return diffs.withColumn("change_kind", kind).where(F.col("change_kind").isNotNull()).select(
        "environment_id",
        "run_id",
        "object_type",
        "object_key",
        "change_kind",
        F.coalesce("source_fingerprint", F.lit("")).alias("prior_fingerprint"),
        F.coalesce("target_fingerprint", F.lit("")).alias("current_fingerprint"),
        F.concat_ws(",", "changed_fields").alias("changed_fields"),
    )


def correlate_deploy(pairs: DataFrame, deployments: DataFrame, registry: DataFrame, tolerance_minutes: int = 30) -> DataFrame:
    """Pipeline evidence for the changes of each run.

    A deployment noted within the period wins, then a changed migration
    version, then an unreadable registry.  ``deployments``: environment_id,
    annotation_id, created_at.  ``registry``: environment_id, run_id,
    latest_version, access_state.  The deployments are matched by hour buckets,
    so the range join stays an equality join.
    """
    tolerance = F.make_dt_interval(F.lit(0), F.lit(0), F.lit(tolerance_minutes))
    low = F.col("previous_started_at") - tolerance
    high = F.col("started_at") + tolerance
    day = 86_400
    usable = pairs.where((F.col("gap_reason") == "") & F.col("previous_run_id").isNotNull()).select(
        "environment_id", "run_id", "previous_run_id", low.alias("low"), high.alias("high")
    )

    def day_of(moment: Column) -> Column:
        return F.floor(F.unix_seconds(moment.cast("timestamp")) / day)

    spread = usable.withColumn("day", F.explode(F.sequence(day_of(F.col("low")), day_of(F.col("high")))))
    noted = deployments.withColumn("day", day_of(F.col("created_at")))
    hits = (
        spread.join(noted, ["environment_id", "day"])
        .where(F.col("created_at").between(F.col("low"), F.col("high")))
        .groupBy("environment_id", "run_id")
        .agg(F.max_by("annotation_id", F.struct("created_at", "annotation_id")).alias("annotation_id"))
    )
    now = registry.select("environment_id", "run_id", "latest_version", "access_state")
    then = registry.select(
        "environment_id", F.col("run_id").alias("previous_run_id"), F.col("latest_version").alias("prior_version")
    )
    joined = (
        usable.join(hits, ["environment_id", "run_id"], "left")
        .join(now, ["environment_id", "run_id"], "left")
        .join(then, ["environment_id", "previous_run_id"], "left")
    )
    state = F.coalesce("access_state", F.lit("ok"))
    deployed = F.col("annotation_id").isNotNull()
    version = F.coalesce("latest_version", F.lit(""))
    moved = (state == "ok") & (version != "") & (version != F.coalesce("prior_version", F.lit("")))
    blind = state.isin("missing", "denied", "error")
    return joined.select(
        "environment_id",
        "run_id",
        F.when(deployed, "deployment").when(moved, "migration_registry").when(blind, "not_verified").otherwise("none").alias("correlation"),
        F.when(deployed, "high").when(moved, "medium").when(blind, "low").otherwise("high").alias("confidence"),
        F.coalesce("annotation_id", F.lit("")).alias("annotation_id"),
        F.when(~deployed & moved, version).otherwise("").alias("registry_version"),
    )


def environment_divergence(items: DataFrame, run_pairs: DataFrame, peers: DataFrame) -> DataFrame:
    """Objects that differ between two environments in the current and in the previous runs of both.

    ``run_pairs``: environment_id, run_id, previous_run_id of the runs to judge.
    ``peers``: environment_id, peer_environment_id with validated mappings.
    """
    mine = peers.join(run_pairs, "environment_id").join(
        run_pairs.select(
            F.col("environment_id").alias("peer_environment_id"),
            F.col("run_id").alias("peer_run_id"),
            F.col("previous_run_id").alias("peer_previous_run_id"),
        ),
        "peer_environment_id",
    )
    mine = mine.where(F.col("previous_run_id").isNotNull() & F.col("peer_previous_run_id").isNotNull())
    pair = ["environment_id", "run_id", "peer_environment_id", "peer_run_id"]
    content = items.drop("environment_id", "run_id").columns

    def side(environment: str, run: str) -> DataFrame:
        at = mine.select(*[F.col(c).alias(f"p_{c}") for c in pair], F.col(environment).alias("environment_id"), F.col(run).alias("run_id"))
        return items.join(at, ["environment_id", "run_id"]).select(*[F.col(f"p_{c}").alias(c) for c in pair], *content)

    def differing(own: str, other: str) -> DataFrame:
        diffs = compare_sets(side("environment_id", own), side("peer_environment_id", other), pair)
        return diffs.where(F.col("status") != "MATCH").select(*pair, "object_type", "object_key")

    now = differing("run_id", "peer_run_id")
    before = differing("previous_run_id", "peer_previous_run_id")
    return now.join(before, [*pair, "object_type", "object_key"], "left_semi")


# --- servers, findings, baselines, keys --------------------------------------------------------
def server_facts(servers: DataFrame, extensions: DataFrame, settings: DataFrame, hypertables: DataFrame, policies: DataFrame, caggs: DataFrame, critical: DataFrame) -> DataFrame:
    """Everything two servers are compared by, one row per fact (environment_id, kind, name, value)."""

    def facts(df: DataFrame, kind: str, name: Column, value: Column) -> DataFrame:
        return df.select("environment_id", F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))

    versions = servers.select(
        "environment_id",
        F.explode(F.create_map(F.lit("postgres"), F.col("server_version"), F.lit("timescaledb"), F.col("timescale_version"))).alias("name", "value"),
    ).where(F.col("value") != "")
    flags = F.concat(
        F.lit("lag="), F.col("lag"), F.lit(" realtime="), (~F.col("materialized_only")).cast("string"), F.lit(" refresh="), F.col("has_refresh_policy").cast("string")
    )
    parts = [
        facts(versions, "version", F.col("name"), F.col("value")),
        facts(extension_versions(extensions), "extension", F.col("name"), F.col("value")),
        facts(
            settings.where(F.col("setting").isin(*COMPARED_SETTINGS) & (F.col("value") != "")),
            "guc",
            F.col("setting"),
            F.col("value"),
        ),
        facts(hypertables, "hypertable", dotted("database_name", "schema_name", "hypertable_name"), F.lit("present")),
        facts(hypertables, "chunk_interval", dotted("database_name", "schema_name", "hypertable_name"), F.col("chunk_interval")),
        facts(
            policies,
            "policy",
            F.concat(F.col("database_name"), F.lit(" "), F.col("policy_type"), F.lit(" "), dotted("schema_name", "hypertable_name")),
            F.col("config"),
        ),
        facts(caggs, "cagg", dotted("database_name", "schema_name", "view_name"), flags),
        facts(critical, "critical", F.col("dedup_key"), F.col("title")),
    ]
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    return union


def compare_servers(facts: DataFrame, pairs: DataFrame) -> DataFrame:
    """Facts that differ between the two servers of each pair (left_environment_id, right_environment_id)."""
    pair = ["left_environment_id", "right_environment_id"]

    def side(name: str) -> DataFrame:
        return pairs.join(facts.withColumnRenamed("environment_id", f"{name}_environment_id"), f"{name}_environment_id").select(
            *pair, "kind", "name", F.col("value").alias(f"{name}_value")
        )

    both = side("left").join(side("right"), [*pair, "kind", "name"], "full")
    left, right = F.col("left_value"), F.col("right_value")
    hidden = (F.col("kind") == "chunk_interval") & (left.isNull() | right.isNull())
    status = F.when(left.isNull(), "only_right").when(right.isNull(), "only_left").otherwise("drift")
    return (
        both.where(changed(left, right) & ~hidden)
        .where((F.col("kind") != "critical") | left.isNull() | right.isNull())
        .select(
            *pair,
            "kind",
            "name",
            F.coalesce(left, F.lit("")).alias("left_value"),
            F.coalesce(right, F.lit("")).alias("right_value"),
            status.alias("status"),
            ((F.col("name") == "shared_buffers") & (status == "drift")).alias("informational"),
        )
    )


def finding_diff(events: DataFrame, pairs: DataFrame) -> DataFrame:
    """Findings removed, added or unchanged between two runs; the latest row per object and title counts.

    ``events``: environment_id, run_id, database_name, schema_name, object_name,
    title, severity, recorded_at.  ``pairs``: environment_id, from_run_id, to_run_id.
    """
    pair = ["environment_id", "from_run_id", "to_run_id"]

    def side(column: str, name: str) -> DataFrame:
        at = pairs.select(*pair, F.col(column).alias("run_id"))
        rows = events.join(at, ["environment_id", "run_id"])
        shown = F.struct(dotted("database_name", "schema_name", "object_name").alias("object_key"), F.col("severity").alias(name))
        latest = rows.groupBy(*pair, "object_name", "title").agg(
            F.max_by(shown, F.struct("recorded_at", "database_name", "schema_name", "severity")).alias("r")
        )
        return latest.select(*pair, "title", "r.*")

    both = side("from_run_id", "old").join(side("to_run_id", "new"), [*pair, "object_key", "title"], "full")
    change = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("unchanged")
    return both.select(*pair, change.alias("change"), "object_key", "title", F.coalesce("new", "old").alias("severity"))


def baseline_diff(tables: DataFrame, baselines: DataFrame) -> DataFrame:
    """Tables added, removed and changed in every run against the baseline of its scope.

    ``baselines``: environment_id, baseline_run_id, scope_database, scope_schema,
    scope_table, where an empty name means all.
    """
    scope = ["environment_id", "baseline_run_id", "scope_database", "scope_schema", "scope_table"]
    names = ["database_name", "schema_name", "table_name"]
    shape = F.struct("relkind", "has_primary_key", "column_count")
    inside = F.lit(True)
    for kind in ("database", "schema", "table"):
        wanted = F.col(f"scope_{kind}")
        inside = inside & ((wanted == "") | (wanted == F.col(f"{kind}_name")))
    rows = tables.join(baselines, "environment_id").where(inside)
    base = rows.where(F.col("run_id") == F.col("baseline_run_id")).select(*scope, *names, shape.alias("before"))
    others = rows.where(F.col("run_id") != F.col("baseline_run_id")).select(*scope, "run_id", *names, shape.alias("after"))
    runs = others.select(*scope, "run_id").distinct()
    both = base.join(runs, scope).join(others, [*scope, "run_id", *names], "full")
    before, after = F.col("before"), F.col("after")
    return both.groupBy(*scope, "run_id").agg(
        F.count_if(before.isNull()).alias("added"),
        F.count_if(after.isNull()).alias("removed"),
        F.count_if(before.isNotNull() & after.isNotNull() & changed(before, after)).alias("changed"),
    )


def equivalent_keys(constraints: DataFrame) -> DataFrame:
    """Unique constraints over the same ordered columns as the primary key of their table."""
    listed = constraints.where(F.size("key_columns") > 0).withColumn("key_list", F.concat_ws("\u0000", "key_columns"))
    primary = listed.where(F.col("constraint_type") == "p").select(
        *TABLE, "key_list", F.col("constraint_name").alias("primary_key")
    )
    unique = listed.where(F.col("constraint_type") == "u").select(
        *TABLE, "key_list", F.col("constraint_name").alias("unique_constraint"), F.concat_ws(",", "key_columns").alias("columns")
    )
    return unique.join(primary, [*TABLE, "key_list"]).drop("key_list")
