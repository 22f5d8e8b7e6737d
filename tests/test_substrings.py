"""Names found in texts by their rarest grams, against plain containment."""

import random

from plumbline.operators.substrings import occurrences


def test_occurrences_against_plain_containment(spark):
    rng = random.Random(11)
    word = lambda low, high: "".join(rng.choice("abß'x") for _ in range(rng.randint(low, high)))
    names = [(rng.choice("pq"), word(0, 6)) for _ in range(60)] + [("p", None), (None, "ab"), ("r", "abc"), ("p", "ab"), ("p", "ab")]
    texts = [(rng.choice("pq"), word(0, 40)) for _ in range(150)] + [("p", None), (None, "abab"), ("s", "abc"), ("q", ""), ("q", "a" * 50_000 + "bxb")]
    want = {(p, n, t) for p, n in names for q, t in texts if p == q and None not in (p, n, t) and n in t}
    frames = [spark.createDataFrame(r, f"place string, {c} string").repartition(3) for r, c in ((names, "name"), (texts, "text"))]
    got = [tuple(r) for r in occurrences(*frames, ["place"], "name", "text").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert occurrences(frames[0].limit(0), frames[1], ["place"], "name", "text").count() == 0
    assert occurrences(frames[0], frames[1].limit(0), ["place"], "name", "text").count() == 0
