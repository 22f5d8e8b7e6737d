"""Role reach, privilege origins and access review campaigns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.keys import changed
from plumbline.operators.rules.environments import WRITE_PRIVILEGES
from plumbline.sources.staging import cut_lineage

PRIVILEGE = ["database_name", "object_type", "object_name", "privilege"]
ITEM = ["database_name", "account_name", "object_type", "object_name", "column_name", "privilege"]
#: Predefined roles that give access to table data.
READ_ALL, WRITE_ALL = "pg_read_all_data", "pg_write_all_data"


def membership_reach(edges: DataFrame, logins: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Every role a login reaches through memberships (login, granted, depth: the fewest memberships on the way).

    ``edges``: member, granted.  Paths between roles are doubled: a round joins the paths of up to n memberships with
    themselves and the logins' paths with those, and keeps the shortest of each pair.  So it takes about log2 of the role
    graph's depth rounds, whatever cycles it has; each round is written to the shared folder.  Logins travel only at the
    start of a path, so that their number does not enter into the paths between roles.  Null members, repeated edges and
    memberships in oneself do not count.  With ``max_depth`` memberships further away are left out.
    """
    steps = edges.where("member <> granted").select("member", "granted").distinct()
    one = F.lit(1).alias("depth")
    start = logins.select(F.col("login").alias("member")).distinct().join(steps, "member").select(F.col("member").alias("login"), "granted", one)
    reached = cut_lineage(start if max_depth is None or max_depth > 0 else start.limit(0))
    inner = steps.join(steps.select(F.col("granted").alias("member")).distinct(), "member").select("member", "granted", one)
    known, found = -1, reached.count()
    while found > known:
        between = cut_lineage(inner)
        further = between.select(F.col("member").alias("granted"), F.col("granted").alias("to"), F.col("depth").alias("more"))

        def longer(paths: DataFrame, first: str) -> DataFrame:
            joined = paths.join(further, "granted").select(first, F.col("to").alias("granted"), (F.col("depth") + F.col("more")).alias("depth"))
            both = paths.unionByName(joined.where(F.col(first) != F.col("granted")))
            near = both if max_depth is None else both.where(F.col("depth") <= max_depth)
            return near.groupBy(first, "granted").agg(F.min("depth").alias("depth"))

        reached = cut_lineage(longer(reached, "login"))
        inner = longer(between, "member")
        known, found = found, reached.count()
    return reached


def role_sets(reach: DataFrame, roles: DataFrame) -> DataFrame:
    """The ``roles`` (column ``granted``) each login reaches as one sorted array: login, roles; logins that reach none are left out."""
    met = reach.select("login", "granted").join(roles.select("granted").distinct(), "granted", "left_semi")
    return met.groupBy("login").agg(F.array_sort(F.collect_set("granted")).alias("roles"))


def expand_privileges(effective: DataFrame, acls: DataFrame, reach: DataFrame) -> DataFrame:
    """Effective privileges plus those of every reachable role.

    ``effective``: account_name and the privilege columns.  ``acls``: the
    privilege columns, grantee ('' for PUBLIC) and owner.

    Logins that reach the same roles hold the same privileges, so these are made distinct once for each set of roles.
    """
    granted = acls.where(F.col("grantee") != "").select(*PRIVILEGE, F.col("grantee").alias("granted")).distinct()
    sets = role_sets(reach, granted)
    kinds = sets.select("roles").distinct()
    held = kinds.select("roles", F.explode("roles").alias("granted")).join(granted, "granted").select("roles", *PRIVILEGE).distinct()
    through = sets.join(held, "roles").select(F.col("login").alias("account_name"), *PRIVILEGE)
    own = effective.select("account_name", *PRIVILEGE).distinct()
    both = own.join(sets, F.col("account_name").eqNullSafe(F.col("login"))).drop("login").alias("o").join(
        held.alias("h"),
        _all_equal([("o.roles", "h.roles"), *[(f"o.{c}", f"h.{c}") for c in PRIVILEGE]]),
        "left_semi",
    ).select("account_name", *PRIVILEGE)
    rest = own.alias("o").join(both.alias("b"), _all_equal([(f"o.{c}", f"b.{c}") for c in ("account_name", *PRIVILEGE)]), "left_anti")
    return through.unionByName(rest)


def _all_equal(pairs: list[tuple[str, str]]) -> Column:
    """Nulls are equal."""
    tests = [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]
    return reduce(lambda x, y: x & y, tests)


def grant_origin(privileges: DataFrame, acls: DataFrame, reach: DataFrame) -> DataFrame:
    """Where each privilege comes from: direct, public, predefined or role, with the role it comes through.

    Owner or direct grant first, then PUBLIC, then a predefined role, then the
    first reachable role of the ACL by name, then the owner's role.  The first role is
    found once for each set of roles that logins reach.
    """
    owner = acls.groupBy(*PRIVILEGE).agg(F.min("owner").alias("owner"), F.bool_or(F.col("grantee") == "").alias("public"))
    base = privileges.join(owner, PRIVILEGE, "left")
    own = acls.where(F.col("grantee") != "").select(*PRIVILEGE, F.col("grantee").alias("account_name")).distinct().withColumn("granted_directly", F.lit(True))
    roles = acls.where(F.col("grantee") != "").select(*PRIVILEGE, F.col("grantee").alias("granted")).distinct()
    asked = roles.select("granted").unionByName(acls.select(F.col("owner").alias("granted")))
    fixed = reach.sparkSession.range(1).select(F.explode(F.array(F.lit(READ_ALL), F.lit(WRITE_ALL))).alias("granted"))
    sets = role_sets(reach, asked.unionByName(fixed)).withColumnRenamed("login", "account_name")
    kinds = sets.select("roles").distinct().select("roles", F.explode("roles").alias("granted"))
    first_role = kinds.join(roles, "granted").groupBy("roles", *PRIVILEGE).agg(F.min("granted").alias("acl_role"))
    joined = (
        base.join(own, ["account_name", *PRIVILEGE], "left")
        .join(sets, "account_name", "left")
        .join(first_role, ["roles", *PRIVILEGE], "left")
    )
    for name, role in (("reads_all", F.lit(READ_ALL)), ("writes_all", F.lit(WRITE_ALL)), ("reaches_owner", F.col("owner"))):
        joined = joined.withColumn(name, F.when(F.array_contains("roles", role), True))
    direct = F.coalesce(F.col("owner") == F.col("account_name"), F.lit(False)) | F.col("granted_directly").isNotNull()
    conferring = F.when((F.col("privilege") == "SELECT") & F.col("reads_all"), READ_ALL).when(
        F.col("privilege").isin("INSERT", "UPDATE", "DELETE") & F.col("writes_all"), WRITE_ALL
    )
    public = F.coalesce("public", F.lit(False))
    kind = (
        F.when(direct, "direct")
        .when(public, "public")
        .when(conferring.isNotNull(), "predefined")
        .when(F.col("acl_role").isNotNull() | F.col("reaches_owner").isNotNull(), "role")
        .otherwise("direct")
    )
    via = F.when(direct | public, "").otherwise(
        F.coalesce(conferring, F.col("acl_role"), F.when(F.col("reaches_owner"), F.col("owner")), F.lit(""))
    )
    return joined.select("account_name", *PRIVILEGE, kind.alias("origin_kind"), via.alias("via_role"))


def campaign_items(origins: DataFrame, accounts: DataFrame, previous: DataFrame, now: Column) -> DataFrame:
    """Privileges under review with what stands out about each.

    ``origins``: item columns and origin_kind.  ``accounts``: account_name,
    powerful, sampled_active, valid_until, one row per login.  ``previous``:
    item columns of the campaign before; nothing counts as new without one.
    """
    before = previous.select(*ITEM).distinct().withColumn("known", F.lit(True))
    any_before = before.limit(1).agg(F.count(F.lit(1)).alias("n_before")).withColumn("_one", F.lit(1))
    joined = (
        origins.join(accounts, "account_name", "left")
        .join(before, ITEM, "left")
        .withColumn("_one", F.lit(1))
        .join(any_before, "_one", "left")
        .drop("_one")
    )
    schema = F.substring_index("object_name", ".", 1)
    foreign = F.col("privilege").isin(*WRITE_PRIVILEGES) & (schema != "public") & ~F.lower(schema).contains(F.lower("account_name"))
    idle = F.col("sampled_active").isNotNull() & (
        ~F.col("sampled_active") | F.coalesce(F.col("valid_until") < now.cast("timestamp"), F.lit(False))
    )
    exposed = (F.col("origin_kind") == "public") & ~F.col("object_name").startswith("public.") & (F.col("object_name") != "public")
    highlights = F.array_compact(
        F.array(
            F.when(F.coalesce("powerful", F.lit(False)), "powerful_role"),
            F.when(idle, "inactive_or_expired"),
            F.when(foreign, "cross_app_write"),
            F.when(exposed, "public_outside_public"),
            F.when(F.col("known").isNull() & (F.col("n_before") > 0), "new_since_previous"),
        )
    )
    return joined.select(*ITEM, "origin_kind", highlights.alias("highlights"))


def latest_decision(decisions: DataFrame) -> DataFrame:
    """The newest decision of every item that no other one supersedes."""
    gone = decisions.where(F.col("supersedes_id").isNotNull()).select(F.col("supersedes_id").alias("decision_id"))
    kept = decisions.join(gone, "decision_id", "left_anti")
    names = [c for c in decisions.columns if c != "item_id"]
    return kept.groupBy("item_id").agg(F.max_by(F.struct(*names), F.struct("decided_at", "decision_id")).alias("d")).select(
        "item_id", "d.*"
    )


def campaign_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """New and removed privileges and changed decisions (``change``), with the decisions of both sides.

    Inputs: item columns and decision (NULL while pending).
    """
    old = previous.select(*ITEM, F.lit(True).alias("was"), F.col("decision").alias("previous_decision"))
    new = current.select(*ITEM, F.lit(True).alias("is"), F.col("decision").alias("current_decision"))
    both = old.join(new, ITEM, "full")
    change = (
        F.when(F.col("was").isNull(), "new_privilege")
        .when(F.col("is").isNull(), "removed_privilege")
        .when(changed(F.col("previous_decision"), F.col("current_decision")), "changed_decision")
    )
    return both.withColumn("change", change).where(F.col("change").isNotNull()).drop("was", "is")


def account_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Accounts only one of two campaigns has."""
    old = previous.select("account_name").distinct().withColumn("was", F.lit(True))
    new = current.select("account_name").distinct().withColumn("is", F.lit(True))
    both = old.join(new, "account_name", "full").where(F.col("was").isNull() | F.col("is").isNull())
    return both.select("account_name", F.when(F.col("was").isNull(), "new_account").otherwise("removed_account").alias("change"))


def campaign_status(campaigns: DataFrame, items: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """closed, overdue, in_review or open, with decided and pending items."""
    decided = latest_decision(decisions).select("item_id", F.lit(1).alias("decided"))
    counted = items.join(decided, "item_id", "left").groupBy("campaign_id").agg(
        F.count(F.lit(1)).alias("total_items"), F.count("decided").alias("decided_items")
    )
    joined = campaigns.join(counted, "campaign_id", "left").na.fill(0, ["total_items", "decided_items"])
    pending = F.col("total_items") - F.col("decided_items")
    status = (
        F.when(F.col("status") == "closed", "closed")
        .when(now.cast("timestamp") > F.col("due_at"), "overdue")
        .when((pending < F.col("total_items")) & (pending > 0) & (F.col("status") == "open"), "in_review")
        .otherwise(F.col("status"))
    )
    return joined.select(
        "environment_id", "campaign_id", status.alias("effective_status"), "total_items", "decided_items", pending.alias("pending_items")
    )
