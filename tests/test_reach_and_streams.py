"""Role reach on deep and cyclic graphs, and tables that streams write batch by batch."""

import collections
import random

from plumbline.operators import access
from plumbline.sources.staging import cut_lineage
from plumbline.streaming import tables


def shortest(edges, logins):
    out = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            out[a].add(b)
    found = set()
    for login in logins:
        depth, seen, near = 0, {login}, {login}
        while near:
            depth += 1
            near = {b for a in near for b in out[a]} - seen
            seen |= near
            found |= {(login, b, depth) for b in near}
    return found


def reach(spark, edges, logins, **more):
    edge_rows = spark.createDataFrame(edges, "member string, granted string").repartition(3)
    return {tuple(r) for r in access.membership_reach(edge_rows, spark.createDataFrame([(x,) for x in logins], "login string"), **more).collect()}


def test_a_chain_of_200_roles_takes_logarithmic_rounds(spark, monkeypatch):
    chain = [("u", "r000"), *((f"r{i:03}", f"r{i + 1:03}") for i in range(199))]
    cuts = []
    monkeypatch.setattr(access, "cut_lineage", lambda df: cuts.append(1) or cut_lineage(df))
    assert reach(spark, chain, ["u"]) == shortest(chain, ["u"])
    assert len(cuts) <= 2 * 10 + 1


def test_cycles_branches_and_odd_edges(spark):
    rng = random.Random(3)
    ring = [(f"c{i}", f"c{(i + 1) % 7}") for i in range(7)]
    web = [(f"w{rng.randrange(25)}", f"w{rng.randrange(25)}") for _ in range(45)]
    edges = ring + web + [("u1", "c3"), ("u1", "w1"), ("u2", "w1"), ("u2", "u2"), ("w3", "c0"), (None, "c1"), ("c1", "u1"), ("u1", "c3")]
    assert reach(spark, edges, ["u1", "u2", "u3", "u1"]) == shortest(edges, ["u1", "u2", "u3"])
    assert reach(spark, edges, ["u1", "u2"], max_depth=2) == {x for x in shortest(edges, ["u1", "u2"]) if x[2] <= 2}
    assert reach(spark, edges, ["u1"], max_depth=0) == set()
    assert reach(spark, edges, ["nobody"]) == set() and reach(spark, [], ["u"]) == set()


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.create(spark, path, "n int")
    assert tables.read_batches(spark, path).count() == 0 and tables.read_newest(spark, path).count() == 0
    frame = lambda *n: spark.createDataFrame([(x,) for x in n], "n int")
    values = lambda df: sorted(r["n"] for r in df.collect())
    tables.replace_batch(frame(1, 2), path, 0)
    tables.replace_batch(frame(3, 4), path, 1)
    tables.replace_batch(frame(5), path, 1)
    assert values(tables.read_batches(spark, path)) == [1, 2, 5]
    assert values(tables.read_batches(spark, path, before=1)) == [1, 2]
    assert values(tables.read_newest(spark, path)) == [5]
