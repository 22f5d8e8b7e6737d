"""Hard negatives, vector codes and secret scans against plain Python."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import codes, negatives, secrets, vectors

VECTORS = "vec_id long, embedding array<float>, label int"


def unsound(rng):
    """Clustered vectors with ties, copies, null and repeated ids, a third of the rows alike, and rows that take no part."""
    centres = rng.normal(size=(4, 32))
    rows = [(i, (centres[i % 4] + rng.normal(size=32) * 0.3).tolist(), i % 3) for i in range(200)]
    rows += [(200 + i, rows[0][1], 0) for i in range(100)]
    rows += [rows[50], rows[50], (50, rows[1][1], 2), (None, rows[4][1], 1), (400, None, 1), (450, rows[0][1], None)]
    rows += [(500, [float("nan")] * 32, 0), (550, [float("inf"), *[0.0] * 31], 0), (600, [None, *[0.0] * 31], 0)]
    rows += [(650, [], 0), (700, [1.0] * 16, 0), (750, [0.0] * 32, 7), (800, [-1e30, *[1.0] * 31], 1)]
    return rows


def sound(rows):
    return [
        (i, [max(-(1 << 24), min(1 << 24, int(np.floor(256 * float(np.float32(x)))))) for x in v], label)
        for i, v, label in rows
        if v is not None and len(v) == 32 and all(x is not None and np.isfinite(np.float32(x)) for x in v)
    ]


def mined(rows):
    first = lambda scores: sorted(scores, key=lambda x: (-x[0], x[1] is None, x[1] or 0))
    found = []
    rows = [r for r in sound(rows) if r[2] is not None]
    for a, (anchor, v, label) in enumerate(rows):
        if anchor is None or anchor % 50:
            continue
        scores = [(sum(x * y for x, y in zip(v, w, strict=True)), i, own == label) for b, (i, w, own) in enumerate(rows) if b != a]
        for p, positive, _ in first([s for s in scores if s[2]])[:5]:
            near = first([s for s in scores if not s[2] and 50 * p <= 100 * s[0] <= 95 * p])[:3]
            found += [(anchor, positive, rank, i, p, n) for rank, (n, i, _) in enumerate(near, 1)]
    return found


@pytest.mark.parametrize("block", [4096, 3])
def test_hard_negatives(spark, monkeypatch, block):
    monkeypatch.setattr(negatives, "BLOCK", block)
    monkeypatch.setattr(negatives, "ROWS", 37)
    rows = unsound(np.random.default_rng(4))
    docs = spark.createDataFrame(rows, VECTORS).selectExpr("*", "1 AS k", "2 AS score", "'x' AS vector").repartition(3)
    found = negatives.mine(docs, F.col("vec_id") % 50 == 0)
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, mined(rows)))
    assert found.count() > 20
    none = negatives.mine(docs.limit(0), F.col("vec_id") % 50 == 0)
    assert none.columns == found.columns and none.count() == 0


def test_intervals_hold_every_score():
    rng = np.random.default_rng(6)
    anchors, rows = rng.integers(-900, 900, (60, 16)), rng.integers(-900, 900, (80, 16))
    tree = negatives.spanning_tree(anchors, np.arange(60), np.zeros(60))
    assert sorted(tree.order) == list(range(60)) and (tree.parent >= 0).sum() == 59
    seen = []

    def wanted(k, labels, low, high):
        exact = rows @ anchors[k]
        assert ((low <= exact) & (exact <= high)).all()
        seen.append(k)
        return exact % 3 == 0

    negatives.walk(tree, rows, np.arange(80), np.zeros(80), wanted, lambda *_: None)
    assert seen == tree.order


def coded(rows):
    """Plain k-means of the parts, and the codes."""
    kept = sound(rows)
    by_id = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, [float(x) for x in r[1]]))
    part = lambda v, p: v[2 * p : 2 * p + 2]
    books = [[part(v, p) for _, v, _ in by_id[:64]] for p in range(16)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), k) for k, y in enumerate(books[p]))
    for _ in range(2):
        for p in range(16):
            groups = collections.defaultdict(list)
            for _, v, _ in kept:
                groups[near(p, part(v, p))[1]].append(part(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[k], strict=True)] if k in groups else y for k, y in enumerate(books[p])]
    found = []
    for i, v, label in kept:
        each = [near(p, part(v, p)) for p in range(16)]
        found.append((i, label, bytes(k for _, k in each), sum(d for d, _ in each)))
    totals = collections.Counter()
    for _, label, _, error in found:
        totals[label] += error
    return [(*r, totals[r[1]]) for r in found], books


@pytest.mark.parametrize("some", [400, 20, 0])
def test_vector_codes(spark, some):
    rows = unsound(np.random.default_rng(5))
    rows = (rows[-12:] + rows)[:some]
    docs = spark.createDataFrame(rows, VECTORS).selectExpr("*", "'x' AS vector", "'y' AS code", "3 AS error").repartition(3)
    found, books = codes.compress(docs)
    want, plain = coded(rows)
    got = [(r["vec_id"], r["label"], bytes(r["code"]), r["error"], r["label_error"]) for r in found.collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    text = ",".join(str(x) for book in plain for entry in book for x in entry)
    assert codes.fingerprint(books) == hashlib.sha256(text.encode()).hexdigest()


def test_masks_leave_few_candidates():
    rng = np.random.default_rng(2)
    book, points = rng.integers(-200, 200, (64, 4)), rng.integers(-300, 300, (5000, 4))
    slices = codes.Slices(book)
    apart = ((points[:, None, :] - book) ** 2).sum(axis=2)
    entry, best = slices.nearest(points)
    assert (entry == apart.argmin(axis=1)).all() and (best == apart.min(axis=1)).all()
    assert np.bitwise_count(slices.candidates(points)).mean() < 20


def spans(text, rules=secrets.RULES):
    found = []
    for place, rule in enumerate(rules):
        for m in re.finditer(rule.pattern, text or "", re.ASCII):
            if len(m[rule.group]) >= rule.least:
                found.append((m.start(), place, rule.kind, m.end()))
    return [(start, end, kind) for start, _, kind, end in sorted(found)]


SECRETS = [
    "password=hunter22",
    "PASSWD : \"abc.def-1\" x api_key='0123456' APIKEY=/+/+/+/",
    "secret=token: abcdefgh and secret = short token=token=token=",
    "x AKIA" + "Q7" * 8 + " AKIAAKIA" + "Z" * 12 + " AKIA123",
    "0" * 23 + " " + "f" * 24 + "g" + "0a" * 20,
    "😀é token=ünï token=" + "a" * 6 + "😀 password:password:password:",
    "-----BEGIN RSA PRIVATE KEY----- -----BEGIN PRIVATE KEY----- -----BEGIN  KEY-----",
    "ghp_" + "aB3" * 12 + " gho_short xoxb-1234567890-abc eyJhbGciOi.eyJzdWIiOiIx.SflKxwRJSMeK eyJ.a.b",
    "tok\nen=abcdefgh pass word=abcdefgh to ken swdpas tokenkey",
]


def test_secret_spans(make, awkward):
    long = " ".join(f"word{i} token={i:06d}" for i in range(3000))
    texts = [*SECRETS, SECRETS[0], "", None, long, "deadbeef " * 5000 + "c" * 30]
    rows = [*awkward, *[(100 + i, t) for i, t in enumerate(texts)], (100, SECRETS[0]), (100, SECRETS[3]), (None, SECRETS[0]), (None, SECRETS[0])]
    docs = make([r[:2] for r in rows], clashing=True).selectExpr("*", "'x' AS kinds", "'y' AS trigram", "'z' AS spans")
    found = secrets.scan(docs.repartition(3)).collect()
    got = sorted((str(r["row"]["doc_id"]), str(r["row"]["text"]), str([(s["start"], s["end"], s["kind"]) for s in r["spans"]])) for r in found)
    assert got == sorted((str(r[0]), str(r[1]), str(spans(r[1]))) for r in rows)
    assert secrets.scan(make([])).count() == 0
    assert secrets.digest(make([(1, None)])).first()["base_sha256"] == hashlib.sha256(b"").hexdigest()


def test_queries_from_patterns():
    assert secrets.trigram_query("[0-9a-f]+") is None
    assert secrets.trigram_query("ab|cde") is None
    assert secrets.trigram_query("x*abcde") == (frozenset({"abc", "cde"}),)
    assert set(secrets.trigram_query("(abc|xyz)+_[kK]ey")) == {frozenset({"abc", "_ke", "key"}), frozenset({"xyz", "_ke", "key"})}
    for rule in secrets.RULES:
        for text in SECRETS:
            for m in re.finditer(rule.pattern, text, re.ASCII):
                query = secrets.trigram_query(rule.pattern)
                assert query is None or any(all(t in m[0].lower() for t in part) for part in query)


def test_rules_without_trigrams_search_all(make):
    rule = secrets.Rule("digits", "[0-9]+", 0, 4)
    docs = make([(1, "12 3456"), (2, "x")])
    assert secrets.build_index(docs, (rule,)).count() == 0
    assert {r["row"]["doc_id"]: len(r["spans"]) for r in secrets.scan(docs, (rule,)).collect()} == {1: 1, 2: 0}


def test_width_is_that_of_the_first(spark):
    rows = [(3, [1.0, 2.0], 0), (1, [1.0], 0), (2, None, 0)]
    assert [r["vec_id"] for r in vectors.sound(spark.createDataFrame(rows, VECTORS)).collect()] == [1]
