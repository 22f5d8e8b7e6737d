"""The value that holds most rows, against counting."""

import random
from collections import Counter

from plumbline.operators import probes


def test_distribution_against_counting(spark):
    rng = random.Random(3)
    shares = {"all null": (0, 1.0), "79": (0.79, 0), "80 of few": (0.8, 0.97), "flat": (0.001, 0), "hot": (0.95, 0.3), "x`y": (0.85, 0.5)}
    size = 3000
    columns = {}
    for name, (hot, null) in shares.items():
        known = round(size * (1 - null))
        top = -(-known * 80 // 100) if hot == 0.8 else round(known * hot)
        values = [-1] * top + [rng.randrange(10**9) for _ in range(known - top)] + [None] * (size - known)
        rng.shuffle(values)
        columns[name] = values
    schema = ", ".join("`" + c.replace("`", "``") + "` bigint" for c in columns)
    table = spark.createDataFrame(list(zip(*columns.values())), schema).repartition(7)
    want = set()
    for name, values in columns.items():
        known = [v for v in values if v is not None]
        top = Counter(known).most_common(1)[0][1] if known else 0
        if known and top * 100 >= len(known) * 80:
            want.add(("distribution", name, top, size))
    found = probes.probe_distribution(table, list(columns))
    assert {tuple(r) for r in found.collect()} == want and len(want) == 3
    assert probes.probe_distribution(table.limit(29), list(columns)).count() == 0
    assert probes.probe_distribution(table.limit(0), list(columns)).count() == 0
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()


def test_distribution_of_other_types(spark):
    rows = [(True, "é" * 2000, 0.0, None)] * 40 + [(False, "", float("nan"), b"x")] * 5
    table = spark.createDataFrame(rows, "a boolean, b string, c double, d binary")
    assert {(r[1], r[2], r[3]) for r in probes.probe_distribution(table, list("abcd")).collect()} == {("a", 40, 45), ("b", 40, 45), ("c", 40, 45), ("d", 5, 45)}
