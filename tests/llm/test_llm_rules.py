"""Quality rules and extendible hashing against plain Python and SQL."""

import collections
import hashlib
import re

from plumbline.llm import extendible, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def expected(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = {w for w, n in collections.Counter(windows).items() if n > 1}
    covered = {i + k for i, w in enumerate(windows) if w in often for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {
        "n_words": len(words),
        "word_chars": sum(map(len, words)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(covered),
    }


def test_measurements_and_bits(make, awkward):
    rows = quality.ledger(make(awkward, clashing=True)).collect()
    assert len(rows) == len(awkward)
    for r in rows:
        want = expected(r["row"]["text"])
        assert {k: r[k] for k in want} == want
        assert bool(r["fail_bits"] & 1) == (r["n_words"] < 10)
        assert bool(r["fail_bits"] & 2) == (100 * r["n_repeat_words"] > 20 * r["n_words"])


def test_policies_and_ablation(make, awkward):
    entries = quality.ledger(make(awkward))
    rows = entries.collect()
    found = {(r["policy"], r["rule"]): r for r in quality.ablation(entries, (quality.BASE, quality.FULL)).collect()}
    bits = [r["fail_bits"] for r in rows]
    for policy in (quality.BASE, quality.FULL):
        for rule in quality.RULES:
            if rule.name in policy.rules:
                r = found[policy.name, rule.name]
                assert r["n_failed"] == sum(bool(b & rule.mask()) for b in bits)
                assert r["n_only"] == sum((b & policy.mask()) == rule.mask() for b in bits)
                assert r["n_rejected"] == sum(bool(b & policy.mask()) for b in bits)
    kept = quality.keep_good(make(awkward, clashing=True))
    assert kept.columns == make(awkward, clashing=True).columns
    assert kept.count() == sum(b == 0 for b in bits)


def test_no_documents(make):
    assert quality.ledger(make([])).count() == 0
    assert quality.keep_good(make([])).count() == 0
    assert extendible.shard(make([]), 100).count() == 0


def test_shards_split_only_where_needed(make, awkward):
    limit = 3000
    rows = extendible.shard(make(awkward, clashing=True), limit).collect()
    assert len(rows) == len(awkward)
    size = collections.Counter()
    for r in rows:
        size[r["shard"]] += r["n_bytes"]
        value = int(hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()[:15], 16)
        assert format(value, "060b").startswith(r["shard"]) and len(r["shard"]) == r["depth"]
    for r in rows:
        assert r["shard_bytes"] == size[r["shard"]]
        assert r["oversize"] == (r["shard_bytes"] > limit)
        assert not r["oversize"] or r["depth"] == extendible.BITS
        if r["shard"]:  # the bucket above was too large
            assert sum(n for s, n in size.items() if s.startswith(r["shard"][:-1])) > limit
    assert {r["shard"] for r in extendible.shard(make(awkward), 10**9).collect()} == {""}
