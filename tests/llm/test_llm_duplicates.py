"""Near-duplicates, substrings and benchmark items against brute force."""

import collections
import hashlib
import os
import random
import subprocess
import sys

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import xxhash
from pyspark import cloudpickle

from plumbline.llm import containment, fm_index, rolling, similar, simhash, substring
from plumbline.llm.components import components
from plumbline.llm.fm_index import FMIndex


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, radius=2):
    """The smallest doc_id reachable from each fingerprint."""
    group = {fp: fp for fp in fps}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    own = sorted(fps)
    for i, a in enumerate(own):
        for b in own[:i]:
            if (a ^ b).bit_count() <= radius:
                group[find(a)] = find(b)
    least = {}
    for fp, ids in fps.items():
        known = [i for i in ids if i is not None]
        if known:
            least[find(fp)] = min(known + ([least[find(fp)]] if find(fp) in least else []))
    return {fp: least.get(find(fp)) for fp in fps}


def test_fingerprints_and_classes(make, awkward):
    rows = simhash.near_duplicates(make(awkward, clashing=True)).collect()
    assert len(rows) == len(awkward)
    text = {d: t for d, t, *_ in awkward if d is not None}
    fps = collections.defaultdict(list)
    for d, t, *_ in awkward:
        fps[fingerprint(t)].append(d)
    want = classes(fps)
    for r in rows:
        fp = r["fp"] & (1 << 64) - 1
        assert r["doc_id"] is None or fp == fingerprint(text[r["doc_id"]])
        assert r["component_id"] == want[fp]
    assert simhash.near_duplicates(make([])).count() == 0


@pytest.mark.parametrize("crowd", ["spread", "low half", "both halves"])
def test_links_are_all_pairs_within_the_radius(spark, crowd):
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    free = {"spread": range(64), "low half": range(12), "both halves": [*range(6), *range(40, 46)]}[crowd]
    fps = {centre ^ sum(1 << b for b in rng.sample(list(free), rng.randint(0, 4))) for _ in range(300)}
    distinct = spark.createDataFrame([(fp - (1 << 64) if fp >> 63 else fp, i) for i, fp in enumerate(fps)], "fp long, first long")
    found = {frozenset(r) for r in simhash.links(distinct, simhash.plan(distinct)).collect()}
    signed = [fp - (1 << 64) if fp >> 63 else fp for fp in fps]
    want = {
        frozenset((a, b)) for i, a in enumerate(signed) for b in signed[:i] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    }
    assert found == want


def test_allocation_covers_the_radius():
    rng = np.random.default_rng(5)
    fps = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    parts = simhash.partition_bits(fps)
    assert sorted(b for p in parts for b in p) == list(range(64))
    layout = simhash.Layout(parts, rng.integers(0, 50, (2, simhash.CELLS)).astype(np.float32))
    assert (simhash.allocate(layout, layout.values(fps)).sum(axis=0) == simhash.RADIUS + 1).all()


def test_components_of_paths_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(100)] + [(200, i) for i in range(201, 300)] + [(400, 400), (500, 501), (501, 500)]
    found = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 101)}, **{i: 200 for i in range(201, 300)}, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def five_word_shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(b" ".join(words[i : i + 5]) for i in range(len(words) - 4)) or frozenset([b" ".join(words)])


def survivors(rows):
    """The smallest doc_id of each component of pairs with a Jaccard similarity of 4/5 or more, and the similarities."""
    sets = {}
    for d, t, *_ in rows:
        if d is not None:
            sets.setdefault(d, five_word_shingles(t))
    group = {d: d for d in sets}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    ids, seen = sorted(sets), []
    for i, a in enumerate(ids):
        for b in ids[:i]:
            shared = len(sets[a] & sets[b])
            if 5 * shared >= 4 * len(sets[a] | sets[b]):
                seen.append(shared / len(sets[a] | sets[b]))
                x, y = sorted((find(a), find(b)))
                group[y] = x
    return sorted({find(d) for d in ids}), seen


def near_copies():
    """Originals with copies of few to many changed words, a large group of them, a line that very many documents have."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnop", k=6))
    prose = lambda n: [word() for _ in range(n)]

    def changed(words, n):
        places = set(rng.sample(range(len(words)), n))
        return [word() if i in places else w for i, w in enumerate(words)]

    line = prose(12)
    found = []
    for _ in range(60):
        base = prose(rng.randint(40, 400))
        found += [base, changed(base, rng.randint(0, len(base) // 25)), changed(base, rng.randint(0, len(base) // 25))]
    crowd = prose(140)
    found += [changed(crowd, rng.randint(0, 7)) for _ in range(150)]
    found += [line + prose(rng.randint(20, 60)) for _ in range(150)]
    found += [prose(n) for n in (1, 2, 3, 4, 5, 6)] * 2
    rng.shuffle(found)
    return [(100 + i, " ".join(w)) for i, w in enumerate(found)]


def test_pipeline_keeps_one_of_all_texts_with_a_jaccard_similarity_of_four_fifths(spark, make, awkward):
    rows = [(d, t) for d, t, *_ in awkward] + near_copies()
    want, seen = survivors(rows)
    assert all(sum(low <= x < low + 0.05 for x in seen) > 5 for low in (0.8, 0.85, 0.9, 0.95))
    docs = make(rows, clashing=True)
    kept = corpus_pipeline.near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == want
    assert ids.count(None) == 1
    assert corpus_pipeline.near_duplicates(spark, make([]), "").count() == 0


@pytest.mark.parametrize("partitions", [1, 2, 7])
def test_rows_of_one_doc_id_with_different_texts_all_count(make, partitions):
    base = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(1, "alpha " * 3), (1, "one two"), (1, "one two"), (1, base), (1, other), (2, base + " end"), (2, "two"), (0, other + " end"), (3, "alpha " * 3)]
    docs = make(rows + [(4, "x y", "en", "a"), (4, "x y", "de", "a")]).repartition(partitions)
    kept = corpus_pipeline.near_duplicates(None, docs, "")
    want = [(0, other + " end", None), (1, "alpha " * 3, None), (1, base, None), (1, "one two", None), (2, "two", None), (4, "x y", "de")]
    assert sorted(((r["doc_id"], r["text"], r["lang"]) for r in kept.collect()), key=str) == sorted(want, key=str)


def test_counts_are_of_all_documents(make, awkward):
    counts = np.zeros(similar.COUNTS, int)
    for _, text, *_ in awkward:
        counts[np.unique(similar.cells(similar.shingles(text or "")))] += 1
    assert (similar.shingle_levels(make(awkward).repartition(5)) == similar.levels(counts)).all()
    assert not similar.shingle_levels(make([])).any()


def test_parities_never_exceed_the_difference():
    rng = np.random.default_rng(2)
    pool = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    for _ in range(50):
        a, b = (np.unique(rng.choice(pool, 200)) for _ in range(2))
        bits = sum((int(x) ^ int(y)).bit_count() for x, y in zip(similar.parities(a).view(np.uint64), similar.parities(b).view(np.uint64), strict=True))
        assert bits <= len(np.setxor1d(a, b))


def deduplicated(rows):
    least = {}
    words = [(d, (t or "").encode().split()) for d, t, *_ in rows]
    for d, w in words:
        for i in range(len(w) - 49):
            key = tuple(w[i : i + 50])
            if d is not None:
                least[key] = min(d, least.get(key, d))
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - 49):
            if d is not None and least[tuple(w[i : i + 50])] < d:
                gone.update(range(i, i + 50))
        out.append((d, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return out


def order(rows):
    return sorted(rows, key=str)


@pytest.mark.parametrize("hot", [64, 0])
def test_substrings(make, awkward, monkeypatch, hot):
    """Also where every shared minimizer is hot and windows are dealt one by one."""
    monkeypatch.setattr(substring, "HOT_LEAST", hot)
    found = [tuple(r) for r in substring.digest(make(awkward, clashing=True)).collect()]
    assert order(found) == order(deduplicated(awkward))
    assert sum(r[2] for r in found) > 0


def test_substrings_of_many_near_copies(make, monkeypatch):
    monkeypatch.setattr(substring, "HOT_LEAST", 4)
    monkeypatch.setattr(substring, "INDEX_WORDS", 500)
    rng = random.Random(11)
    base = [rng.choice(["the", "of", "and", f"w{rng.randint(0, 99)}"]) for _ in range(260)]
    rows = []
    for d in rng.sample(range(1000), 60):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randint(0, 5)}"
        cut = rng.randint(0, 80)
        rows.append((d, " ".join(w[cut : len(w) - rng.randint(0, 80)])))
    found = [tuple(r) for r in substring.digest(make(rows)).collect()]
    assert order(found) == order(deduplicated(rows))
    assert substring.digest(make([])).count() == 0


def test_texts_lose_repeated_passages(make, awkward):
    docs = make(awkward, clashing=True)
    left = substring.drop_repeats(docs)
    assert left.columns == docs.columns
    texts = collections.Counter((r["doc_id"], hashlib.sha256(b" ".join((r["text"] or "").encode().split())).hexdigest()) for r in left.collect())
    assert texts == collections.Counter((d, h) for d, _, _, h in deduplicated(awkward))
    assert all(r["n_chars"] == len(r["text"]) for r in left.collect() if r["text"] is not None)


@pytest.mark.parametrize(("width", "symbols"), [(2, 2), (3, 3), (5, 2), (33, 2), (50, 40)])
def test_index_finds_the_least_owner(width, symbols):
    rng = np.random.default_rng(width)
    stem = rng.integers(1, symbols + 1, 60)
    texts = [np.concatenate((stem[: rng.integers(0, 50)], rng.integers(1, symbols + 1, rng.integers(width, width + 30)))) for _ in range(120)]
    owners = rng.integers(0, 1000, len(texts))
    least = {}
    for t, o in zip(texts, owners, strict=True):
        for i in range(len(t) - width + 1):
            key = tuple(t[i : i + width])
            least[key] = min(o, least.get(key, o))
    for t, found in zip(texts, FMIndex(texts, owners, width).least_owners(texts), strict=True):
        assert found.tolist() == [least[tuple(t[i : i + width])] for i in range(len(t) - width + 1)]


def test_index_asks_for_two_ranks_a_word_and_level(monkeypatch):
    rng = np.random.default_rng(4)
    texts = [rng.integers(1, 101, 80) for _ in range(50)]
    index = FMIndex(texts, np.arange(50), 50)
    asked = []
    rank = fm_index.Bits.rank
    monkeypatch.setattr(fm_index.Bits, "rank", lambda self, at: (asked.append(at.size), rank(self, at))[1])
    index.least_owners(texts)
    assert sum(asked) == 2 * 50 * 80 * 7


@pytest.mark.parametrize("limit", [1 << 10, 1 << 30])
def test_pairs_are_ordered_by_both_numbers(limit):
    """Also where a pair and its place don't fit a number."""
    rng = np.random.default_rng(5)
    high, low = rng.integers(0, 9, (2, 500))
    order, ranks = fm_index.ordered(high, low, limit)
    assert order.tolist() == sorted(range(500), key=lambda i: (high[i], low[i]))
    kinds = sorted(set(zip(high.tolist(), low.tolist(), strict=True)))
    assert ranks.tolist() == [kinds.index((a, b)) for a, b in zip(high, low, strict=True)]


class Batches:
    """Stands for documents and gives what is mapped over their batches."""

    def select(self, *_):
        return self

    filter = select

    def mapInArrow(self, run, _):  # noqa: N802
        return run


@pytest.mark.parametrize("part", [1, 1 << 12, 1 << 30])
def test_short_texts_are_hashed_together(spark, monkeypatch, part):
    """Passages are those of each text by itself, wherever parts of a batch begin."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "bb", "\u00e9", "w\u4e00"]) + str(rng.randint(0, 9)) for _ in range(rng.choice([0, 3, 49, 50, 51, 300]))) for _ in range(200)]
    texts += [None, "", " \t\n", texts[5], " " + texts[5] + "\r\n"]
    calls = []
    hashed = rolling.word_hashes
    monkeypatch.setattr(rolling, "word_hashes", lambda *a: (calls.append(1), hashed(*a))[1])
    monkeypatch.setattr(substring, "PART", part, raising=False)

    def found(numbers, hot):
        ids = pa.array(numbers, pa.int64())
        batch = pa.RecordBatch.from_arrays([ids, pc.add(ids, 1000), pa.array([texts[i] for i in numbers], pa.string())], ["doc_id", "uid", "text"])
        run = substring.segments(Batches(), hot)
        return [tuple(r.values()) for b in run(iter([batch])) for r in b.to_pylist()]

    for hot in (np.zeros(0, dtype=np.uint64), None):
        if hot is None:
            hot = np.unique(np.array([r[0] for r in alone], dtype=np.int64).view(np.uint64)[::3])
        alone = [r for i in range(len(texts)) for r in found([i], hot)]
        calls.clear()
        assert sorted(found(range(len(texts)), hot)) == sorted(alone)
        if part == 1 << 30:
            assert len(calls) == 1
    assert all(r[4] == r[3] + 1000 for r in alone)
    assert any(r[7] for r in alone) and not all(r[7] for r in alone)
    covered = collections.Counter()
    for r in alone:
        covered[r[3]] += r[6]
    assert dict(covered) == {i: n - 49 for i, n in enumerate(len((t or "").split()) for t in texts) if n >= 50}


def test_passages_are_found_where_the_package_is_missing(spark, tmp_path):
    """Tasks bring the code along; nothing in it may be found by its module's name."""
    assert rolling.powers(rolling.BASE, 3).tolist() == [pow(int(rolling.BASE), k, 1 << 64) for k in range(4)]
    run = cloudpickle.dumps(substring.segments(Batches(), np.zeros(0, dtype=np.uint64)))
    assert len(run) < 200_000  # without the tables of powers of this process
    code = """import pickle, sys, pyarrow as pa
run = pickle.load(sys.stdin.buffer)
batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([2]), pa.array([" ".join(map(str, range(60)))])], ["doc_id", "uid", "text"])
print(sum(sum(b.column(6).to_pylist()) for b in run(iter([batch]))))
"""
    bare = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], input=run, capture_output=True, cwd=tmp_path, env=bare, timeout=100)
    assert done.stdout.split() == [b"11"], done.stderr[-500:]


def test_word_hashes_depend_on_the_word_alone():
    data = b"alpha beta alpha\tgamma  beta\nab ba a"
    starts, ends = rolling.words(data)
    assert [data[a:b] for a, b in zip(starts, ends, strict=True)] == data.split()
    hashes = rolling.word_hashes(data, starts, ends).tolist()
    assert len(set(hashes)) == len(set(data.split()))
    assert len(rolling.window_hashes(np.zeros(3, dtype=np.uint64), 5)) == 0


def leaks(docs, items):
    shingles = lambda t: containment.shingles((t or "").encode())
    out = []
    for d, t, *_ in docs:
        own = shingles(t)
        for i, x in items:
            wanted = shingles(x)
            if wanted and len(own & wanted) >= 0.8 * len(wanted):
                out.append((d, i, len(own & wanted), len(wanted)))
    return out


def test_benchmark_items(spark, make, awkward, monkeypatch):
    rng = random.Random(2)
    long = next(t for d, t, *_ in awkward if d == 8).split()
    items = [(1, " ".join(long[500:540])), (2, " ".join(long[9:16])), (3, "too short here"), (4, None), (None, " ".join(long[800:812]).upper())]
    changed = long[20_000:20_100]
    changed[50] = "changed"
    items += [(5, " ".join(changed)), (6, "not in any of the documents at all"), (7, ""), (7, " ".join(long[4:9]))]
    items += [(100 + i, " ".join(rng.sample(long, 30))) for i in range(20)]
    table = spark.createDataFrame([(*x, "extra") for x in items], "item_id long, text string, doc_id string")
    docs = make(awkward, clashing=True)
    for block in (20_000, 4):  # all items at once, and block by block
        monkeypatch.setattr(containment, "BLOCK_ITEMS", block)
        found = [tuple(r) for r in containment.find_leaks(docs, table).collect()]
        assert order(found) == order(leaks(awkward, items))
        assert {r[1] for r in found} >= {1, 2, 5, 7, None}
        clean = containment.drop_leaked(docs, table)
        assert clean.columns == docs.columns
        bad = {r[0] for r in found}
        assert order(r["doc_id"] for r in clean.collect()) == order(d for d, *_ in awkward if d not in bad)
    assert containment.find_leaks(make([]), table).count() == 0
    assert containment.find_leaks(docs, table.limit(0)).count() == 0
    assert containment.drop_leaked(docs, table.limit(0)).count() == len(awkward)


def test_bands_keep_the_chance_of_a_miss_small():
    for size in range(12):
        rows = containment.band_rows(1 << size, 4 << size)
        jaccard = 0.8 / (1 + 4 - 0.8)
        assert (1 - jaccard**rows) ** (containment.HASHES // rows) <= containment.MISS


def test_repeated_items_match_each(spark, make):
    text = " ".join(f"w{i}" for i in range(40))
    items = spark.createDataFrame([(1, text)] * 5 + [(1, text + " x"), (2, text), (None, text), (None, text)], "item_id long, text string")
    found = [tuple(r) for r in containment.find_leaks(make([(7, "a " + text + " b")]), items).collect()]
    assert collections.Counter(r[1] for r in found) == {1: 6, 2: 1, None: 2}
