"""Rules over roles, grants, functions and schema privileges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import dotted
from plumbline.operators.rules.base import RUN, Bundle, Family, RowRule, Settings, match

FAMILY = Family()
#: Privileges that are reviewed whoever holds them.
BROAD_PRIVILEGES = (
    "ALL",
    "SUPERUSER",
    "CREATE",
    "TRUNCATE",
    "REFERENCES",
    "TRIGGER",
    "EXECUTE",
    "INSERT",
    "UPDATE",
    "DELETE",
)
#: Inherited privileges that rate a role high.
HIGH_PRIVILEGES = (
    "superuser",
    "bypass_rls",
    "replication",
    "pg_execute_server_program",
    "pg_read_server_files",
    "pg_write_server_files",
    "pg_read_all_data",
    "pg_write_all_data",
)


def function_key() -> Column:
    arguments = F.when(F.col("identity_args") != "", F.concat(F.lit("("), F.col("identity_args"), F.lit(")"))).otherwise("")
    return F.concat(dotted("database_name", "schema_name", "function_name"), arguments)


@FAMILY.rows(
    "security.security_definer",
    "security.definer_search_path",
)
def function_rules(s: Settings) -> list[RowRule]:
    key, name = function_key(), F.col("function_name")
    pinned = F.lower("config").rlike(r"(?:^|,)\s*search_path=")
    return [
        RowRule(
            "security.security_definer",
            "functions",
            F.col("is_security_definer"),
            "medium",
            "function",
            key,
            F.concat(F.lit("SECURITY DEFINER function: "), key),
            {
                "is_security_definer": F.lit(True),
                "owner": F.col("owner"),
                "language": F.col("language"),
                "identity_arguments": F.col("identity_args"),
            },
            name,
        ),
        RowRule(
            "security.definer_search_path",
            "functions",
            F.col("is_security_definer") & ~F.col("search_path_pinned") & ~pinned,
            "high",
            "function",
            key,
            F.concat(F.lit("Security definer without pinned search_path: "), key),
            {"identity_arguments": F.col("identity_args"), "search_path_pinned": F.lit(False)},
            name,
        ),
    ]


@FAMILY.rows(
    "security.auditor_privilege_unknown",
    "security.auditor_not_readonly",
    "security.account_inactive_review",
)
def role_rules(s: Settings) -> list[RowRule]:
    name, current = F.col("role_name"), F.col("is_current")
    auditor = F.concat(F.col("database_name"), F.lit(".auditor:"), name)
    expired = F.coalesce(F.col("valid_until") < F.col("collected_at"), F.lit(False))
    return [
        RowRule(
            "security.auditor_privilege_unknown",
            "roles",
            current & F.col("privilege_check_failed"),
            "medium",
            "role",
            auditor,
            F.concat(F.lit("Auditor privilege check incomplete: "), name),
            {},
            name,
        ),
        RowRule(
            "security.auditor_not_readonly",
            "roles",
            current
            & ~F.col("privilege_check_failed")
            & (F.col("can_write") | F.col("superuser") | F.col("create_role") | F.col("create_db")),
            "high",
            "role",
            auditor,
            F.concat(F.lit("Auditor connection is not read-only: "), name),
            {"superuser": F.col("superuser"), "can_write": F.col("can_write"), "createrole": F.col("create_role")},
            name,
        ),
        RowRule(
            "security.account_inactive_review",
            "roles",
            ~current & F.col("login") & (expired | F.col("possibly_inactive")),
            "low",
            "role",
            F.concat(F.col("database_name"), F.lit(".role:"), name),
            F.concat(F.lit("Revisar conta possivelmente inativa: "), name),
            {"sampled_inactive_window": F.col("possibly_inactive"), "expired": expired},
            name,
            dedup_title="review",
        ),
    ]


def possibly_inactive(accounts: DataFrame) -> DataFrame:
    """Accounts never seen active in two or more snapshots that reach back 30 days or more.

    ``accounts`` has environment_id, run_id, database_name, role_name, collected_at, sampled_active.
    """
    seconds = F.unix_micros(F.col("collected_at").cast("timestamp"))
    day = 86_400_000_000
    recent = (
        W.partitionBy("environment_id", "database_name", "role_name").orderBy(seconds).rangeBetween(-90 * day, W.currentRow)
    )
    idle = (
        (F.count(F.lit(1)).over(recent) >= 2)
        & (F.min(seconds).over(recent) <= seconds - 30 * day)
        & ~F.bool_or("sampled_active").over(recent)
    )
    return accounts.withColumn("possibly_inactive", F.coalesce(idle, F.lit(False)))


@FAMILY.rule("security.powerful_role", "roles")
def powerful_role(b: Bundle, s: Settings) -> DataFrame:
    """One finding per database and role that merges its own and its inherited powers."""
    own = ["superuser", "bypass_rls", "replication", "create_role", "login"]
    strong = b["roles"].where(
        F.col("superuser") | F.col("bypass_rls") | F.col("replication") | F.col("create_role") | (F.size("inherited") > 0)
    )
    merged = strong.groupBy(*RUN, "database_name", "role_name").agg(
        *[F.bool_or(c).alias(c) for c in own],
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("inherited")))).alias("inherited"),
        F.max("server_version").alias("server_version"),
    )
    privileges = F.transform("inherited", lambda e: F.substring_index(e, ":", 1))
    major = F.regexp_extract("server_version", r"^\s*([0-9]+)", 1).try_cast("int")
    grants_any = F.coalesce((major > 0) & (major < 16), F.lit(False)) & (
        F.col("create_role") | F.array_contains(privileges, "createrole")
    )
    high = (
        F.col("superuser")
        | F.col("bypass_rls")
        | F.col("replication")
        | F.arrays_overlap(privileges, F.array(*[F.lit(p) for p in HIGH_PRIVILEGES]))
        | grants_any
    )
    name = F.col("role_name")
    return match(
        merged,
        RowRule(
            "security.powerful_role",
            "roles",
            F.lit(True),
            F.when(high, "high").otherwise("medium"),
            "role",
            F.concat(F.col("database_name"), F.lit(".role:"), name),
            F.concat(F.lit("Powerful role: "), name),
            {**{c: F.col(c) for c in own}, "inherited": F.concat_ws(",", "inherited")},
            name,
        ),
    )


@FAMILY.rule("security.excessive_privilege", "grants")
def excessive_privilege(b: Bundle, s: Settings) -> DataFrame:
    """PUBLIC grants and broad privileges, one finding per granted privilege."""
    granted = b["grants"].withColumn("privilege", F.explode("privileges"))
    privilege = F.upper(F.trim("privilege"))
    grantee = F.upper(F.trim("grantee"))
    public = grantee.isin("PUBLIC", "")
    key = F.concat(
        dotted("database_name", "schema_name", "object_name"), F.lit(":"), F.col("grantee"), F.lit(":"), privilege
    )
    return match(
        granted,
        RowRule(
            "security.excessive_privilege",
            "grants",
            public | privilege.isin(*BROAD_PRIVILEGES),
            F.when(public & privilege.isin("ALL", "INSERT", "UPDATE", "DELETE"), "medium").otherwise("low"),
            F.col("object_type"),
            key,
            F.concat(
                F.lit("Privilege review: "), privilege, F.lit(" on "), F.col("object_name"), F.lit(" to "), F.col("grantee")
            ),
            {"grantee": F.col("grantee"), "privilege": privilege, "grantable": F.col("grantable"), "is_public": public},
            F.col("object_name"),
        ),
    )


@FAMILY.rows(
    "security.public_schema_create",
)
def schema_rules(s: Settings) -> list[RowRule]:
    open_acl = F.exists("acls", lambda a: a.contains("=C/") | a.contains("=UC/"))
    return [
        RowRule(
            "security.public_schema_create",
            "schemas",
            (F.col("schema_name") == "public") & open_acl,
            "medium",
            "schema",
            F.concat(F.col("database_name"), F.lit(".public")),
            "PUBLIC can create objects in schema public",
            {"acls": F.col("acls")},
        )
    ]
