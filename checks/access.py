"""Role reach, privilege origins and review campaigns."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, table
from plumbline.operators import access as ac
from plumbline.plans import derive
from plumbline.sources.staging import cut_lineage

REGISTRY = Registry()
NOW = "2001-07-01 00:00:00"


def now():
    return F.lit(NOW).cast("timestamp")


def reach(spark, folder):
    edges = derive.view(spark, folder, "f_role_edge")
    logins = edges.where("member LIKE 'u%'").select(F.col("member").alias("login")).distinct()
    return ac.membership_reach(edges, logins)


def recursive(*names):
    return derive.ctes(*names).replace("WITH", "WITH RECURSIVE", 1)


REACH = """walk(login, granted, depth) AS (SELECT DISTINCT member, granted, 1 FROM f_role_edge WHERE member LIKE 'u%' AND member <> granted
 UNION SELECT walk.login, e.granted, walk.depth + 1 FROM walk JOIN f_role_edge e ON e.member = walk.granted WHERE e.granted <> walk.login AND walk.depth < 60),
 rc AS (SELECT login, granted, min(depth) AS depth FROM walk GROUP BY login, granted)"""


@REGISTRY.add("acc1_membership_reach", recursive("f_role_edge") + f", {REACH} SELECT login, granted, depth FROM rc")
def membership(spark, folder):
    return reach(spark, folder)


def acls(spark, folder):
    return derive.view(spark, folder, "f_acl").select(
        *ac.PRIVILEGE, F.when(F.col("grantee") == "PUBLIC", "").otherwise(F.col("grantee")).alias("grantee"), "owner"
    )


def effective(entries):
    """Each owner holds the privileges on its objects."""
    return entries.select(F.col("owner").alias("account_name"), *ac.PRIVILEGE).distinct()


EXPANDED = f"""{REACH}, al AS (SELECT DISTINCT database_name, object_type, object_name, privilege, CASE WHEN grantee = 'PUBLIC' THEN '' ELSE grantee END AS grantee, owner FROM f_acl),
 ex AS (SELECT owner AS account_name, database_name, object_type, object_name, privilege FROM al UNION SELECT login, database_name, object_type, object_name, privilege FROM al JOIN rc ON granted = grantee)"""


@REGISTRY.add("acc2_expand_privileges", recursive("f_role_edge", "f_acl") + f", {EXPANDED} SELECT * FROM ex")
def expand(spark, folder):
    entries = cut_lineage(acls(spark, folder))
    return ac.expand_privileges(effective(entries), entries, reach(spark, folder))


@REGISTRY.add(
    "acc3_grant_origin",
    recursive("f_role_edge", "f_acl") + f""", {EXPANDED}, j AS (SELECT ex.*, o.owner, o.pub, r.role, (SELECT count(*) FROM rc WHERE login = account_name AND granted = 'pg_read_all_data') > 0 AS ra, (SELECT count(*) FROM rc WHERE login = account_name AND granted = o.owner) > 0 AS ro
   FROM ex JOIN (SELECT database_name, object_type, object_name, privilege, min(owner) AS owner, bool_or(grantee = '') AS pub FROM al GROUP BY ALL) o USING (database_name, object_type, object_name, privilege)
   LEFT JOIN (SELECT login AS account_name, database_name, object_type, object_name, privilege, min(grantee) AS role FROM al JOIN rc ON granted = grantee GROUP BY ALL) r USING (account_name, database_name, object_type, object_name, privilege))
 SELECT account_name, database_name, object_type, object_name, privilege, CASE WHEN owner = account_name THEN 'direct' WHEN pub THEN 'public' WHEN privilege = 'SELECT' AND ra THEN 'predefined' WHEN role IS NOT NULL OR ro THEN 'role' ELSE 'direct' END AS origin_kind,
 CASE WHEN owner = account_name OR pub THEN '' WHEN privilege = 'SELECT' AND ra THEN 'pg_read_all_data' ELSE coalesce(role, CASE WHEN ro THEN owner END, '') END AS via_role FROM j""",
)
def origin(spark, folder):
    roles = reach(spark, folder)
    entries = cut_lineage(acls(spark, folder))  # derived once, read by both steps
    held = ac.expand_privileges(effective(entries), entries, roles)
    return ac.grant_origin(held, entries, roles)


def items(spark, folder):
    return derive.view(spark, folder, "s_campaign_item").withColumn("database_name", F.lit("db0"))


ACCOUNTS = "ac AS (SELECT 'u' || CAST(c_custkey AS VARCHAR) AS account_name, c_nationkey = 3 AS powerful, c_custkey % 3 <> 0 AS active, CASE WHEN c_custkey % 11 = 0 THEN TIMESTAMP '2001-01-01' END AS valid_until FROM customer)"
ITEM = "database_name, account_name, object_type, object_name, column_name, privilege"
WRITE = "privilege IN ('UPDATE', 'DELETE')"


@REGISTRY.add(
    "acc4_campaign_items",
    derive.ctes("s_campaign_item") + f""", {ACCOUNTS}, it AS (SELECT 'db0' AS database_name, * FROM s_campaign_item), cu AS (SELECT DISTINCT {ITEM}, origin_kind FROM it), pv AS (SELECT DISTINCT {ITEM} FROM it WHERE campaign_id IN ('camp1', 'camp2', 'camp3', 'camp4', 'camp5', 'camp6', 'camp7'))
 SELECT {ITEM}, origin_kind, concat_ws(',', CASE WHEN powerful THEN 'powerful_role' END, CASE WHEN NOT active OR valid_until < TIMESTAMP '{NOW}' THEN 'inactive_or_expired' END, CASE WHEN {WRITE} AND object_name NOT LIKE 'public.%' THEN 'cross_app_write' END, CASE WHEN origin_kind = 'public' AND object_name NOT LIKE 'public.%' THEN 'public_outside_public' END,
 CASE WHEN NOT EXISTS (SELECT 1 FROM pv WHERE (pv.database_name, pv.account_name, pv.object_type, pv.object_name, pv.column_name, pv.privilege) = (cu.database_name, cu.account_name, cu.object_type, cu.object_name, cu.column_name, cu.privilege)) THEN 'new_since_previous' END) AS highlights FROM cu LEFT JOIN ac USING (account_name)""",
)
def campaign(spark, folder):
    accounts = table(spark, folder, "customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("account_name"),
        (F.col("c_nationkey") == 3).alias("powerful"),
        (F.col("c_custkey") % 3 != 0).alias("sampled_active"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit("2001-01-01").cast("timestamp")).alias("valid_until"),
    )
    current = items(spark, folder)
    previous = current.where(F.col("campaign_id").isin(*[f"camp{i}" for i in range(1, 8)]))
    found = ac.campaign_items(current.select(*ac.ITEM, "origin_kind").distinct(), accounts, previous, now())
    return found.withColumn("highlights", F.concat_ws(",", "highlights"))


DECIDED = "ld AS (SELECT item_id, decision_id, decision, decided_at FROM s_decision d WHERE NOT EXISTS (SELECT 1 FROM s_decision x WHERE x.supersedes_id = d.decision_id) QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY decided_at DESC, decision_id DESC) = 1)"


@REGISTRY.add("acc5_latest_decision", derive.ctes("s_decision") + f", {DECIDED} SELECT item_id, decision_id, decision, decided_at FROM ld")
def latest(spark, folder):
    return ac.latest_decision(derive.view(spark, folder, "s_decision")).select("item_id", "decision_id", "decision", "decided_at")


def decided(spark, folder):
    return items(spark, folder).join(ac.latest_decision(derive.view(spark, folder, "s_decision")).select("item_id", "decision"), "item_id", "left")


SIDES = f"""{DECIDED}, it AS (SELECT 'db0' AS database_name, i.*, decision FROM s_campaign_item i LEFT JOIN ld USING (item_id)),
 o AS (SELECT {ITEM}, max(decision) AS decision FROM it GROUP BY ALL), n AS (SELECT {ITEM}, min(decision) AS decision FROM (SELECT * REPLACE (CASE WHEN CAST(substr(item_id, 2) AS BIGINT) % 5 = 0 THEN account_name || '_new' ELSE account_name END AS account_name) FROM it) GROUP BY ALL)"""


def sides(spark, folder):
    number = F.expr("CAST(substring(item_id, 2) AS BIGINT)")
    found = decided(spark, folder)
    old = found.groupBy(*ac.ITEM).agg(F.max("decision").alias("decision"))
    renamed = F.when(number % 5 == 0, F.concat("account_name", F.lit("_new"))).otherwise(F.col("account_name"))
    return old, found.withColumn("account_name", renamed).groupBy(*ac.ITEM).agg(F.min("decision").alias("decision"))


@REGISTRY.add(
    "acc6_campaign_diff",
    derive.ctes("s_campaign_item", "s_decision") + f""", {SIDES} SELECT * EXCLUDE (a, b), CASE WHEN a IS NULL THEN 'new_privilege' WHEN b IS NULL THEN 'removed_privilege' ELSE 'changed_decision' END AS change FROM (SELECT {ITEM}, o.a, n.b, o.decision AS previous_decision, n.decision AS current_decision FROM (SELECT *, 1 AS a FROM o) o FULL JOIN (SELECT *, 1 AS b FROM n) n USING ({ITEM})) WHERE a IS NULL OR b IS NULL OR previous_decision IS DISTINCT FROM current_decision""",
)
def campaign_diff(spark, folder):
    return ac.campaign_diff(*sides(spark, folder))


@REGISTRY.add("acc6_account_changes", derive.ctes("s_campaign_item", "s_decision") + f", {SIDES} SELECT account_name, 'new_account' AS change FROM (SELECT account_name FROM n EXCEPT SELECT account_name FROM o) UNION ALL SELECT account_name, 'removed_account' FROM (SELECT account_name FROM o EXCEPT SELECT account_name FROM n)")
def accounts(spark, folder):
    return ac.account_changes(*sides(spark, folder))


@REGISTRY.add(
    "acc7_campaign_status",
    derive.ctes("s_campaign", "s_campaign_item", "s_decision") + f""", {DECIDED} SELECT environment_id, campaign_id, CASE WHEN status = 'closed' THEN 'closed' WHEN due_at < TIMESTAMP '{NOW}' THEN 'overdue' WHEN d > 0 AND d < t AND status = 'open' THEN 'in_review' ELSE status END AS effective_status, t AS total_items, d AS decided_items, t - d AS pending_items
 FROM s_campaign JOIN (SELECT campaign_id, count(*) AS t, count(ld.item_id) AS d FROM s_campaign_item i LEFT JOIN ld USING (item_id) GROUP BY 1) USING (campaign_id)""",
)
def status(spark, folder):
    return ac.campaign_status(derive.view(spark, folder, "s_campaign"), items(spark, folder), derive.view(spark, folder, "s_decision"), now())
