"""Where two copies differ, and runs that appear whole or not at all."""

import random

from plumbline.operators import reconcile
from plumbline.sources import snapshots


def test_keys_that_differ(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(300)]), f"v{rng.randrange(9)}") for _ in range(900)]
    other = [r for r in rows if rng.random() > 0.03] + [(1000 + i, "new") for i in range(5)] + [(7, "more"), (None, "x")]

    def groups(items):
        out = {}
        for k, v in items:
            out.setdefault(k, []).append(v)
        return {k: sorted(v) for k, v in out.items()}

    a, b = groups(rows), groups(other)
    want = {(k, "only_copy" if k not in a else "only_origin" if k not in b else "changed") for k in {*a, *b} if a.get(k) != b.get(k)}
    frames = [spark.createDataFrame(x, "k int, v string").repartition(3) for x in (rows, other)]
    assert {tuple(r) for r in reconcile.differing_keys(*frames, ["k"], ["k", "v"]).collect()} == want
    assert reconcile.differing_keys(frames[0], frames[0].repartition(5), ["k"], ["k", "v"]).count() == 0
    assert reconcile.differing_keys(frames[0].limit(0), frames[0], ["k"], ["k", "v"]).count() == len(a)


def test_no_half_run_is_ever_seen(spark, tmp_path):
    root = str(tmp_path)
    keys = ["environment_id", "run_id", "name"]
    run = lambda r, *names: spark.createDataFrame([("e", r, n) for n in names], "environment_id string, run_id string, name string")
    seen = lambda: sorted((r["run_id"], r["name"]) for r in snapshots.read_published(spark, root, "t").collect())
    snapshots.stage_runs(run("r1", "a"), root, "t", keys)  # dies before publishing
    assert seen() == []
    snapshots.publish_snapshot(run("r1", "a", "b", "b"), root, "t", keys)
    assert seen() == [("r1", "a"), ("r1", "b")]
    rival = snapshots.stage_runs(run("r2", "x"), root, "t", keys)
    snapshots.publish_snapshot(run("r1", "z").union(run("r2", "c")), root, "t", keys)
    snapshots.publish_runs(spark, root, "t", rival)
    assert seen() == [("r1", "a"), ("r1", "b"), ("r2", "c")]
