"""Rules over whole environments: peers, replication, backups, reviews, personal data, cost."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.detectors import IDENTITY_CATEGORIES
from plumbline.functions.keys import dedup_key, dotted, downgrade, ratio
from plumbline.operators.rules.base import GIB, MIB, RUN, TABLE, Bundle, Family, RowRule, Settings, match, table_key

FAMILY = Family()
#: The settings that are compared between environments.
COMPARED_SETTINGS = ("shared_buffers", "work_mem", "max_connections", "timescaledb.max_background_workers")
WRITE_PRIVILEGES = ("INSERT", "UPDATE", "DELETE", "TRUNCATE", "CREATE")
ROW_OVERHEAD_BYTES = 24


def setting_number(value: Column) -> Column:
    """Number behind a setting such as ``4GB``; NULL when it is none."""
    text = F.lower(F.trim(value))
    scale = (
        F.when(text.endswith("tb"), 1 << 40)
        .when(text.endswith("gb"), 1 << 30)
        .when(text.endswith("mb"), 1 << 20)
        .when(text.endswith("kb"), 1 << 10)
        .otherwise(1)
    )
    return F.trim(F.regexp_replace(text, "(?:[tgmk]?b)$", "")).try_cast("double") * scale


#: How many rows of one side a task pairs with the other side of their key.
PAIR_BLOCK = 1024


def side_by_side(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """The join of two sides on few keys with many rows: the left side is dealt into blocks, the right side goes to each block of its key."""
    blocks = left.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / PAIR_BLOCK).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64(*left.columns), F.col("blocks")).cast("int").alias("block")
    dealt = left.join(blocks, on).select(*left.columns, block)
    spread = right.join(blocks, on).select(*right.columns, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    return dealt.join(spread, [*on, "block"]).drop("block")


def known_sides(servers: DataFrame, values: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides of the pairs of a fleet's environments that know a name, to be put side by side on ``fleet, name``.

    A fleet is the group of environments that are compared with each other; its
    size is what an operator runs side by side, not the number of all environments.
    Only servers with a value enter. A pair without a run or a peer's name has no match;
    a server that is listed n times counts n * n times in its pairs.
    """
    listed = servers.dropna(subset=["fleet", "environment_id", "run_id"])
    often = F.explode(F.array_repeat(F.lit(0), (F.col("n") * F.col("n")).cast("int"))).alias("again")

    def known(listed: DataFrame, *columns: str) -> DataFrame:
        counted = listed.groupBy("fleet", "environment_id", "run_id", *columns).agg(F.count(F.lit(1)).alias("n"))
        return counted.select("*", often).drop("n", "again").join(values, "environment_id")

    peers = known(listed.withColumnRenamed("name", "peer_name").dropna(subset=["peer_name"]), "peer_name")
    renamed = {"environment_id": "peer_environment_id", "run_id": "peer_run_id", "value": "right"}
    return known(listed).withColumnRenamed("value", "left"), peers.withColumnsRenamed(renamed)


def _drifting(servers: DataFrame, values: DataFrame, rule_id: str, severity: Column | str, informational: Column, differs: Column) -> DataFrame:
    """Findings of the pairs that both know a name; what one side alone decides is made before the sides are paired."""
    left, right = known_sides(servers, values.where(F.col("value") != ""))
    own = F.to_json(F.struct("name", "left"))
    peer = F.to_json(F.struct("right", "peer_environment_id", "peer_run_id", informational.alias("informational")))
    key = _drift_key(rule_id)
    left = left.withColumn("own_evidence", F.substring(own, F.lit(1), F.length(own) - 1)).withColumn("number", setting_number(F.col("left")))
    right = (
        right.withColumn("peer_evidence", F.concat(F.lit(","), F.substring(peer, F.lit(2), F.length(peer))))
        .withColumn("peer_number", setting_number(F.col("right")))
        .withColumn("key", key)
        .withColumn("stored", dedup_key(F.lit(rule_id), key, F.col("name")))
    )
    pairs = side_by_side(left, right, ["fleet", "name"]).where(
        (F.col("environment_id") != F.col("peer_environment_id")) & (F.col("left") != F.col("right")) & differs
    )
    evidence = F.concat("own_evidence", "peer_evidence")
    return match(pairs, replace(_drift_rule(rule_id, severity, evidence), object_key=F.col("key"), stored_key=F.col("stored")))


def drift_classes(servers: DataFrame, values: DataFrame) -> DataFrame:
    """Drift of whole fleets in one row for each value: ``fleet, name, value, members, example, values_seen``.

    ``values``: environment_id, name, value; empty and null values are left out. Only names on which a fleet differs are kept. The rows
    grow with the environments, not with their pairs; ``example`` is the first environment that has the value.
    """
    known = values.where(F.coalesce(F.col("value"), F.lit("")) != "")
    seen = servers.select("fleet", "environment_id").distinct().join(known, "environment_id")
    classes = seen.groupBy("fleet", "name", "value").agg(
        F.count_distinct("environment_id").alias("members"), F.min("environment_id").alias("example")
    )
    spread = classes.groupBy("fleet", "name").agg(F.count(F.lit(1)).alias("values_seen")).where(F.col("values_seen") > 1)
    return classes.join(spread, ["fleet", "name"])


def drift_pairs(classes: DataFrame, servers: DataFrame, values: DataFrame, environment: str) -> DataFrame:
    """The pairs of one environment with the classes of its fleet it is not in: ``fleet, name, own, other, members, example``.

    ``servers`` and ``values`` as given to ``drift_classes``.
    """
    mine = values.where(F.col("environment_id") == environment).join(servers.select("fleet", "environment_id").distinct(), "environment_id")
    return classes.join(mine.select("fleet", "name", F.col("value").alias("own")), ["fleet", "name"]).where(F.col("value") != F.col("own")).select(
        "fleet", "name", "own", F.col("value").alias("other"), "members", "example"
    )


def _drift_key(rule_id: str) -> Column:
    return F.concat(F.col("peer_environment_id"), F.lit("|" + rule_id + "|"), F.col("name"))


def _drift_rule(rule_id: str, severity: Column | str, evidence: Mapping[str, Column] | Column) -> RowRule:
    title = F.when(
        F.col("peer_name") == "",
        F.concat(F.lit("Drift "), F.col("name"), F.lit(" vs "), F.col("peer_environment_id")),
    ).otherwise(
        F.concat(F.lit("Drift "), F.col("name"), F.lit(" "), F.col("environment_id"), F.lit(" vs "), F.col("peer_name"))
    )
    return RowRule(
        rule_id,
        "servers",
        F.lit(True),
        severity,
        "environment",
        _drift_key(rule_id),
        title,
        evidence,
        F.lit(""),
        dedup_title=F.col("name"),
    )


@FAMILY.rule("config.version_drift", "servers")
def version_drift(b: Bundle, s: Settings) -> DataFrame:
    servers = b["servers"]
    kinds = F.explode(
        F.array(
            F.struct(F.lit("postgres").alias("name"), F.col("server_version").alias("value")),
            F.struct(F.lit("timescaledb").alias("name"), F.col("timescale_version").alias("value")),
        )
    )
    values = servers.select("environment_id", kinds.alias("v")).select(
        "environment_id", F.col("v.name").alias("name"), F.col("v.value").alias("value")
    )
    return _drifting(servers, values, "config.version_drift", "medium", F.lit(False), F.lit(True))


def extension_versions(extensions: DataFrame) -> DataFrame:
    """All versions of an extension in an environment as one sorted text."""
    return (
        extensions.where(F.col("extension") != "")
        .groupBy("environment_id", F.col("extension").alias("name"))
        .agg(F.concat_ws(",", F.array_sort(F.collect_set("version"))).alias("value"))
    )


@FAMILY.rule("config.extension_drift", "servers", "extensions")
def extension_drift(b: Bundle, s: Settings) -> DataFrame:
    """Each pair's names that one side or both know; only servers that know a name meet the whole fleet."""
    servers = b["servers"].select("fleet", "environment_id", "run_id", "name").where(F.col("fleet").isNotNull() & F.col("environment_id").isNotNull())
    values = extension_versions(b["extensions"])
    left, right = known_sides(servers, values)
    both = side_by_side(left, right, ["fleet", "name"]).where((F.col("environment_id") != F.col("peer_environment_id")) & (F.col("left") != F.col("right")))
    known = values.groupBy("environment_id").agg(F.collect_set("name").alias("names"))
    members = servers.join(known, "environment_id", "left").withColumn("names", F.coalesce("names", F.array().cast("array<string>")))
    peer = members.select(
        "fleet",
        F.col("environment_id").alias("peer_environment_id"),
        F.col("run_id").alias("peer_run_id"),
        F.col("name").alias("peer_name"),
        F.col("names").alias("peer_names"),
    )
    mine = servers.drop("name").join(values, "environment_id").withColumnRenamed("value", "left")
    theirs = servers.withColumnsRenamed({"environment_id": "peer_environment_id", "run_id": "peer_run_id", "name": "peer_name"}).join(
        values.withColumnsRenamed({"environment_id": "peer_environment_id", "value": "right"}), "peer_environment_id"
    )
    other = F.col("environment_id") != F.col("peer_environment_id")
    nameless = F.col("run_id").isNull() | F.col("peer_run_id").isNull() | F.col("peer_name").isNull()
    only_left = side_by_side(mine, peer, ["fleet"]).where(other & (nameless | ~F.array_contains("peer_names", F.col("name"))))
    only_right = side_by_side(theirs, members.drop("name").withColumnRenamed("names", "own_names"), ["fleet"]).where(
        other & (nameless | ~F.array_contains("own_names", F.col("name")))
    )
    shown = ["environment_id", "run_id", "peer_environment_id", "peer_run_id", "peer_name", "name", "left", "right", "one_sided"]
    differs = (
        both.withColumn("one_sided", F.lit(False)).select(*shown)
        .unionByName(only_left.withColumn("right", F.lit("")).withColumn("one_sided", F.lit(True)).select(*shown))
        .unionByName(only_right.withColumn("left", F.lit("")).withColumn("one_sided", F.lit(True)).select(*shown))
    )
    evidence = {c: F.col(c) for c in ("name", "left", "right", "peer_environment_id", "peer_run_id")} | {"informational": F.lit(False)}
    return match(differs, _drift_rule("config.extension_drift", F.when(F.col("one_sided"), "low").otherwise("medium"), evidence))


@FAMILY.rule("config.guc_drift", "settings", "servers")
def setting_drift(b: Bundle, s: Settings) -> DataFrame:
    values = b["settings"].where(F.col("setting").isin(*COMPARED_SETTINGS)).select(
        "environment_id", F.col("setting").alias("name"), "value"
    )
    info = F.col("name") == "shared_buffers"
    a, c = F.col("number"), F.col("peer_number")
    tolerance = s.number("config.guc_drift", "numeric_tolerance", 0.0)
    close = (tolerance > 0) & (a != 0) & (c != 0) & (F.abs(a - c) / F.greatest(a, c) <= tolerance)
    differs = info | ~F.coalesce(close, F.lit(False))
    return _drifting(b["servers"], values, "config.guc_drift", F.when(info, "info").otherwise("medium"), info, differs)


@FAMILY.rows(
    "replication.lag_high",
    "replication.archive_stalled",
)
def replication_rules(s: Settings) -> list[RowRule]:
    stalled = F.coalesce(
        F.col("last_failed_archive").isNotNull()
        & (F.col("last_archived").isNull() | (F.col("last_failed_archive") > F.col("last_archived"))),
        F.lit(False),
    ) | ((F.col("archive_failed_count") > 0) & F.col("last_archived").isNull())
    environment = F.col("environment_id")
    return [
        RowRule(
            "replication.lag_high",
            "servers",
            F.col("expects_replica") & (F.col("replay_lag_bytes") > 64 * MIB),
            "high",
            "",
            F.lit(""),
            "Replica apply lag is above the threshold",
            {},
            dedup_title="lag",
            dedup_key=environment,
        ),
        RowRule(
            "replication.archive_stalled",
            "servers",
            F.col("expects_replica") & stalled,
            "high",
            "",
            F.lit(""),
            "WAL archive looks stalled",
            {},
            dedup_title="archive",
            dedup_key=environment,
        ),
    ]


def last_drills(drills: DataFrame, environments: DataFrame) -> DataFrame:
    """Every environment with its latest restore drill, if any."""
    latest = drills.where(F.col("drill_id").isNotNull()).groupBy("environment_id").agg(
        F.max_by(F.struct("drill_id", "succeeded", "rto_seconds", "performed_at"), F.struct("performed_at", "drill_id")).alias("d")
    )
    return environments.select("environment_id").distinct().join(latest, "environment_id", "left").select(
        "environment_id", "d.*"
    )


@FAMILY.rows(
    "backup.drill_overdue",
    "backup.rto_exceeded",
)
def backup_rules(s: Settings) -> list[RowRule]:
    environment = F.col("environment_id")
    overdue = F.coalesce(
        ~F.col("succeeded")
        | (F.col("performed_at").cast("timestamp") < F.col("now") - F.make_dt_interval(F.col("max_age_days"))),
        F.lit(True),
    )
    return [
        RowRule(
            "backup.drill_overdue",
            "drills",
            overdue,
            "medium",
            "environment",
            environment,
            "Ensaio de restauração do banco auditado em atraso",
            {"max_age_days": F.col("max_age_days"), "last_succeeded": F.col("succeeded")},
        ),
        RowRule(
            "backup.rto_exceeded",
            "drills",
            (F.col("rto_target_seconds") > 0) & (F.col("rto_seconds") > F.col("rto_target_seconds")),
            "high",
            "environment",
            environment,
            "RTO do ensaio de restauração excedeu o alvo",
            {
                "rto_seconds": F.col("rto_seconds"),
                "rto_target_seconds": F.col("rto_target_seconds"),
                "drill_id": F.col("drill_id"),
            },
        ),
    ]


@FAMILY.rows(
    "access_review.revocation_not_applied",
    "access_review.powerful_without_approve",
    "access_review.inactive_with_write",
    "access_review.public_outside_public",
    "access_review.new_privilege_undecided",
)
def review_rules(s: Settings) -> list[RowRule]:
    """Rules on review items joined with their campaign and latest decision (``review_items``)."""
    shown = F.when(F.col("column_name") != "", dotted("object_name", "column_name")).otherwise(F.col("object_name"))
    account, privilege = F.col("account_name"), F.col("privilege")
    decision = F.coalesce(F.col("decision"), F.lit(""))
    key = F.concat_ws("|", account, shown, privilege, F.col("item_id"))
    campaign = F.col("campaign_id")

    def has(highlight: str) -> Column:
        return F.array_contains("highlights", highlight)

    def rule(rule_id, when, severity, title, evidence, object_type=F.col("object_type"), name=shown):
        return RowRule(rule_id, "review_items", when, severity, object_type, key, title, evidence, name)

    held = {"campaign_id": campaign, "account": account, "privilege": privilege}
    return [
        rule(
            "access_review.revocation_not_applied",
            (decision == "revoke") & (F.col("revoke_due_at") < F.col("now")) & F.col("still_present"),
            "high",
            F.concat(F.lit("Revogação não aplicada: "), account, F.lit(" "), privilege, F.lit(" em "), shown),
            {**held, "item_id": F.col("item_id"), "object": shown},
        ),
        rule(
            "access_review.powerful_without_approve",
            has("powerful_role") & decision.isin("", "keep", "revoke") & (F.col("campaign_status") != "closed"),
            "high",
            F.concat(F.lit("Papel poderoso sem aprovação: "), account),
            {"campaign_id": campaign, "decision": decision, "highlights": F.col("highlights")},
            F.lit("role"),
            account,
        ),
        rule(
            "access_review.inactive_with_write",
            has("inactive_or_expired") & privilege.isin(*WRITE_PRIVILEGES),
            "medium",
            F.concat(F.lit("Conta inativa com escrita: "), account, F.lit(" em "), shown),
            {"campaign_id": campaign, "inactive_days_threshold": F.lit(90), "privilege": privilege},
        ),
        rule(
            "access_review.public_outside_public",
            (F.col("origin_kind") == "public")
            & ~F.col("object_name").startswith("public.")
            & (F.col("object_name") != "public"),
            "medium",
            F.concat(F.lit("Privilégio via PUBLIC fora de public: "), shown),
            held,
        ),
        rule(
            "access_review.new_privilege_undecided",
            has("new_since_previous") & (decision == ""),
            "medium",
            F.concat(F.lit("Privilégio novo sem decisão: "), account, F.lit(" "), privilege, F.lit(" em "), shown),
            held,
        ),
    ]


@FAMILY.rule("access_review.campaign_overdue_pending", "review_items")
def campaign_overdue(b: Bundle, s: Settings) -> DataFrame:
    """Campaigns past their due time with a tenth or more of their items undecided."""
    totals = b["review_items"].groupBy(*RUN, "campaign_id", "campaign_status", "due_at", "now").agg(
        F.count(F.lit(1)).alias("total_items"),
        F.count_if(F.coalesce("decision", F.lit("")) == "").alias("pending_items"),
    )
    share = F.col("pending_items") * F.lit(100.0) / F.col("total_items")
    late = (F.col("campaign_status") == "overdue") | (F.col("now") > F.col("due_at"))
    return match(
        totals,
        RowRule(
            "access_review.campaign_overdue_pending",
            "review_items",
            late & (F.col("campaign_status") != "closed") & (share >= 10),
            "medium",
            "access_review_campaign",
            F.concat(F.lit("campaign:"), F.col("campaign_id")),
            "Campanha de revisão vencida com pendências",
            {
                "campaign_id": F.col("campaign_id"),
                "pending_percent": F.round(share, 4),
                "threshold_percent": F.lit(10),
            },
            F.col("campaign_id"),
        ),
    )


@FAMILY.rows(
    "pii.column_detected",
    "pii.broad_read_access",
)
def personal_data_rules(s: Settings) -> list[RowRule]:
    key = F.concat(table_key(), F.lit("."), F.col("column_name"))
    name = dotted("table_name", "column_name")
    confidence, category = F.col("confidence"), F.col("category")
    return [
        RowRule(
            "pii.column_detected",
            "pii_columns",
            confidence.isin("alta", "media"),
            "info",
            "column",
            key,
            F.concat(F.lit("Dado pessoal detectado: "), key, F.lit(" ("), category, F.lit(")")),
            {
                "category": category,
                "confidence": confidence,
                "read_accounts": F.col("read_accounts"),
                "has_rls": F.col("has_rls"),
                "access_level": F.col("access_level"),
            },
            name,
        ),
        RowRule(
            "pii.broad_read_access",
            "pii_columns",
            (confidence == "alta") & (F.col("read_accounts") >= 5),
            F.when(category.isin(*IDENTITY_CATEGORIES), "high").otherwise("medium"),
            "column",
            key,
            F.concat(F.lit("Acesso amplo a dado pessoal: "), key),
            {
                "category": category,
                "confidence": confidence,
                "read_accounts": F.col("read_accounts"),
                "threshold": F.lit(5),
                "access_level": F.col("access_level"),
            },
            name,
        ),
    ]


@FAMILY.rule("pii.no_rls_hypothesis", "pii_columns")
def no_rls(b: Bundle, s: Settings) -> DataFrame:
    """Tables with sure personal data, several readers and no row security; the first column stands for the table."""
    exposed = b["pii_columns"].where(
        (F.col("confidence") == "alta") & ~F.col("has_rls") & (F.col("read_accounts") >= 2)
    )
    first = exposed.groupBy(*TABLE).agg(
        F.min_by(F.struct("column_name", "category", "read_accounts", "access_level"), F.struct("position", "column_name")).alias("c")
    )
    key = table_key()
    return match(
        first,
        RowRule(
            "pii.no_rls_hypothesis",
            "pii_columns",
            F.lit(True),
            "low",
            "table",
            key,
            F.concat(F.lit("Hipótese: dado pessoal sem RLS em "), key),
            {
                "read_accounts": F.col("c.read_accounts"),
                "has_rls": F.lit(False),
                "hypothesis": F.lit(True),
                "sample_column": F.col("c.column_name"),
                "category": F.col("c.category"),
                "access_level": F.col("c.access_level"),
            },
        ),
    )


def bloat(tables: DataFrame, column_stats: DataFrame) -> DataFrame:
    """Statistical bloat per table: size minus rows times the expected row width.

    ``column_stats`` has the table keys, average_width and null_fraction.
    """
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("null_fraction")))
    width = F.greatest(F.col("average_width"), F.lit(0)) * (F.lit(1.0) - share)
    widths = column_stats.groupBy(*TABLE).agg(F.round(F.sum(width), 6).alias("row_width"))
    size, rows = F.col("total_size_bytes"), F.col("row_estimate")
    known = (size > 0) & (rows > 0) & F.col("row_width").isNotNull()
    expected = F.when(
        known, F.floor(rows * (F.lit(float(ROW_OVERHEAD_BYTES)) + F.col("row_width"))).cast("bigint") + ROW_OVERHEAD_BYTES
    )
    joined = tables.join(widths, TABLE, "left").withColumn("estimated_data_bytes", F.coalesce(expected, F.lit(0)))
    waste = F.when(known, F.greatest(F.lit(0), size - F.col("estimated_data_bytes"))).otherwise(0).cast("bigint")
    return joined.withColumn("bloat_bytes", waste).withColumn("bloat_ratio", ratio(F.col("bloat_bytes"), size))


@FAMILY.rule("cost.bloat_recoverable", "tables", "column_stats")
def bloat_recoverable(b: Bundle, s: Settings) -> DataFrame:
    key = table_key()
    waste = F.col("bloat_bytes")
    return match(
        bloat(b["tables"], b["column_stats"]),
        RowRule(
            "cost.bloat_recoverable",
            "tables",
            (F.col("bloat_ratio") >= 0.3) & (waste >= GIB),
            F.when(waste >= 20 * GIB, "high").otherwise("medium"),
            "table",
            key,
            F.concat(F.lit("Bloat recuperável estimado: "), key),
            {
                "bloat_ratio": F.round("bloat_ratio", 4),
                "bloat_bytes": waste,
                "table_bytes": F.col("total_size_bytes"),
            },
        ),
    )


@FAMILY.rows(
    "cost.query_expensive",
)
def query_cost_rules(s: Settings) -> list[RowRule]:
    """On ``query_deltas``: window deltas per statement with the window's total time."""
    share = ratio(F.col("delta_total_us"), F.col("window_total_us"))
    fingerprint = F.col("fingerprint")
    return [
        RowRule(
            "cost.query_expensive",
            "query_deltas",
            (share >= 0.10) & (F.col("delta_calls") >= 1000),
            F.when(share >= 0.25, "medium").otherwise("low"),
            "fingerprint",
            fingerprint,
            F.concat(F.lit("Consulta cara na janela: "), fingerprint),
            {"fingerprint": fingerprint, "share_of_time": F.round(share, 4), "delta_calls": F.col("delta_calls")},
            fingerprint,
        )
    ]


@FAMILY.rows(
    "backup.restore_failed",
    "backup.restore_divergence",
)
def restore_rules(s: Settings) -> list[RowRule]:
    """On ``restore_checks``: one row per failed drill and per diverged reconciliation check."""
    environment, kind = F.col("environment_id"), F.col("kind")

    def stored(rule_id: str) -> Column:
        return F.concat_ws("|", F.lit(rule_id), environment, F.col("drill_id"))

    return [
        RowRule(
            "backup.restore_failed",
            "restore_checks",
            (kind == "drill") & (F.col("status") == "failed"),
            "critical",
            "environment",
            environment,
            "Ensaio de restauração falhou",
            {"drill_id": F.col("drill_id")},
            stored_key=stored("backup.restore_failed"),
        ),
        RowRule(
            "backup.restore_divergence",
            "restore_checks",
            (kind != "drill") & (F.col("status") == "diverged"),
            F.coalesce(F.col("check_severity"), F.lit("medium")),
            "environment",
            environment,
            F.concat(F.lit("Divergência na restauração: "), F.col("checked_table")),
            {"drill_id": F.col("drill_id"), "table": F.col("checked_table"), "kind": kind},
            stored_key=stored("backup.restore_divergence"),
        ),
    ]


@FAMILY.rows(
    "drift.out_of_pipeline",
)
def schema_change_rules(s: Settings) -> list[RowRule]:
    """On ``schema_changes``: timeline events with their pipeline correlation."""
    severity = out_of_pipeline_severity(F.col("object_type"), F.col("change_kind"), F.col("is_security_definer"))
    return [
        RowRule(
            "drift.out_of_pipeline",
            "schema_changes",
            F.col("correlation").isin("none", ""),
            F.when(F.col("is_production"), severity).otherwise(downgrade(severity)),
            F.col("object_type"),
            F.col("object_key"),
            F.concat(F.lit("Mudança de schema fora do pipeline: "), F.col("change_kind"), F.lit(" "), F.col("object_key")),
            {
                "change_kind": F.col("change_kind"),
                "prior_fingerprint": F.col("prior_fingerprint"),
                "current_fingerprint": F.col("current_fingerprint"),
                "correlation": F.col("correlation"),
            },
            F.lit(""),
            confidence=0.8,
            dedup_title=F.concat(F.col("change_kind"), F.lit("@"), F.col("run_id")),
        )
    ]


def out_of_pipeline_severity(object_type: Column, change_kind: Column, security_definer: Column) -> Column:
    """Severity of an unexplained change in production."""
    kind, change = F.lower(object_type), F.lower(change_kind)
    return (
        F.when(kind.isin("table", "column"), F.when(change.isin("removed", "modified"), "high").otherwise("low"))
        .when(kind == "index", "medium")
        .when(kind.isin("function", "view"), F.when(security_definer, "high").otherwise("medium"))
        .when(change == "added", "low")
        .otherwise("medium")
    )


@FAMILY.rows(
    "drift.environment_divergence",
)
def divergence_rules(s: Settings) -> list[RowRule]:
    """On ``divergences``: objects that differ from a paired environment in two runs of each side."""
    return [
        RowRule(
            "drift.environment_divergence",
            "divergences",
            F.lit(True),
            F.when(F.col("is_production"), "medium").otherwise("low"),
            "",
            F.col("object_key"),
            F.concat(F.lit("Divergência persistente entre ambientes: "), F.col("object_key")),
            {"peer_environment_id": F.col("peer_environment_id")},
            F.lit(""),
            confidence=0.7,
            dedup_title=F.col("peer_environment_id"),
        )
    ]
