from plumbline.operators import access

ACL = "database_name string, object_type string, object_name string, privilege string, grantee string, owner string"
REACH = "login string, granted string, depth int"


def test_logins_with_the_same_roles_share_one_set(spark):
    reach = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "b", 1), ("u2", "a", 1), ("u3", "z", 1)], REACH)
    sets = access.role_sets(reach, spark.createDataFrame([("a",), ("b",), ("a",)], "granted string"))
    assert sorted((r["login"], r["roles"]) for r in sets.collect()) == [("u1", ["a", "b"]), ("u2", ["a", "b"])]


def test_expanded_once_also_with_nulls_and_own_privileges(spark):
    acls = spark.createDataFrame([("d", "table", None, "SELECT", "a", "u1"), ("d", "table", None, "SELECT", "b", "u1"), ("d", "table", "t", "SELECT", "", "u9"), ("d", "table", "t", "UPDATE", "a", "u9")], ACL)
    reach = spark.createDataFrame([("u1", "a", 1), ("u1", "b", 2), ("u2", "b", 1)], REACH)
    effective = acls.selectExpr("owner AS account_name", "database_name", "object_type", "object_name", "privilege")
    held = access.expand_privileges(effective, acls, reach)
    got = sorted((r["account_name"], r["object_name"] or "", r["privilege"]) for r in held.collect())
    assert got == [("u1", "", "SELECT"), ("u1", "t", "UPDATE"), ("u2", "", "SELECT"), ("u9", "t", "SELECT"), ("u9", "t", "UPDATE")]
    origin = {(r["account_name"], r["object_name"] or "", r["privilege"]): (r["origin_kind"], r["via_role"]) for r in access.grant_origin(held, acls, reach).collect()}
    assert origin["u1", "t", "UPDATE"] == ("role", "a") and origin["u9", "t", "SELECT"] == ("direct", "")
