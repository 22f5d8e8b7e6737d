"""Language spans, revisit records, the registered queries and the pipeline."""

import itertools
import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from compare import connect, differences
from plumbline.llm import language, warc
from plumbline.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


def test_viterbi_finds_the_best_labels():
    rng = np.random.default_rng(1)
    sizes = np.array([3, 0, 5, 1, 4])
    scores = rng.integers(-10, 1, (sizes.sum(), 3)).astype(np.float32)
    labels = language.viterbi(scores, sizes, penalty=4.0)
    worth = lambda path, s: sum(s[t, k] for t, k in enumerate(path)) - 4.0 * sum(a != b for a, b in itertools.pairwise(path))
    start = 0
    for n in sizes:
        own = scores[start : start + n]
        best = max((worth(p, own) for p in itertools.product(range(3), repeat=int(n))), default=0)
        assert worth(labels[start : start + n].tolist(), own) == best
        start += n


def test_scripts_narrow_and_spans_are_found(make):
    latin = ["the cat sat on the mat with his hat", "le chat est sur la table avec une souris"]
    docs = [(i, " ".join([latin[i % 2]] * 5), ("en", "fr")[i % 2], None) for i in range(20)]
    docs += [(20 + i, "кошка сидит на столе и ест рыбу " * 5, "ru", None) for i in range(10)]
    model = language.learn(make(docs))
    assert model.languages == ["en", "fr", "ru"]
    texts = [
        (1, f"{latin[0]} {latin[0]}. {latin[1]} {latin[1]} {latin[1]}"),
        (2, None),
        (3, "12 ... !"),
        (4, "неизвестное слово"),
        (5, ""),
        (6, "日本語"),
    ]
    found = {r["doc_id"]: r for r in language.label(make(texts, clashing=True), model).collect()}
    assert found[1]["lang_pred"] == "fr"
    assert [s["lang"] for s in found[1]["spans"]] == ["en", "fr"]
    assert found[1]["spans"][0]["n_words"] == 18
    assert 0.5 < found[1]["score"] < 0.7
    for i in (2, 3, 5):
        assert (found[i]["lang_pred"], found[i]["score"], found[i]["spans"]) == ("und", 0.0, [])
    assert (found[4]["lang_pred"], found[4]["score"]) == ("ru", 1.0)
    assert language.label(make([]), model).count() == 0
    assert {r["lang_pred"] for r in language.label(make(texts), language.learn(make([]))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    folder = FOLDER.replace("0.001", "0.01")
    found = QUERIES["op5_language_id"](spark, folder)
    rows = found.join(spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    held = [r["lang"] == r["lang_pred"] for r in rows if r["held_out"]]
    assert sum(held) >= 0.98 * len(held)


def test_canonical_urls(spark):
    same = [
        "http://www.Example.org/a/",
        "https://example.org:443/a",
        "HTTP://example.org:80/a?utm_source=x",
        "https://example.org/a?ref=1&utm_medium=2#top",
    ]
    other = ["https://example.org/A", "https://example.org/a?page=2", None, ""]
    df = spark.createDataFrame([(u,) for u in same + other], "url string").select(warc.canonical("url").alias("key"))
    keys = [r["key"] for r in df.collect()]
    assert set(keys[: len(same)]) == {"example.org/a"}
    assert keys[len(same) :] == ["example.org/A", "example.org/a?page=2", None, ""]


RECORDS = (
    "record_id long, url string, ts long, kind string, status int, headers array<struct<name string, value string>>, "
    "payload string, key string, target long"
)


def resolved(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], RECORDS)
    return {r["record_id"]: r for r in warc.resolve(df).collect()}


def test_revisits(spark):
    tag = lambda v, *more: [("ETag", v), *more]
    rows = [
        (1, "http://a.org/x", 10, "response", 200, tag('"1"', ("Server", "s"), ("Date", "old")), "body"),
        (2, "https://www.a.org/x/", 20, "revisit", 304, tag('W/"1"', ("Server", "t"), ("date", "new")), None),
        (3, "http://a.org/x", 30, "revisit", 304, tag('"2"'), None),
        (4, "http://a.org/x", 10, "revisit", 304, tag('"1"'), None),
        (5, "http://a.org/x", 40, "response", 404, None, "gone"),
        (6, "http://a.org/x", 50, "response", 200, [("Last-Modified", "d")], "two"),
        (7, "http://a.org/x", 50, "response", 200, [("last-modified", "d"), ("ETag", '"3"')], "three"),
        (8, "http://a.org/x", 60, "revisit", 304, [("Last-Modified", "d")], None),
        (9, "http://a.org/x", 61, "revisit", 304, None, None),
        (10, None, 70, "revisit", 304, tag('"1"'), None),
        (11, "http://a.org/x", None, "revisit", 304, tag('"1"'), None),
        (12, "http://b.org/", 5, "revisit", 304, tag('"1"'), None),
        (13, None, 1, "response", 200, None, None),
        (14, "http://a.org/x", 15, None, None, None, None),
    ]
    found = resolved(spark, rows)
    assert {i: (r["state"], r["target"]) for i, r in found.items()} == {
        1: ("full", None), 2: ("resolved", 1), 3: ("mismatch", 1), 4: ("no_response", None), 5: ("other", None), 6: ("full", None),
        7: ("full", None), 8: ("resolved", 7), 9: ("mismatch", 7), 10: ("no_response", None), 11: ("no_response", None),
        12: ("no_response", None), 13: ("full", None), 14: ("other", None),
    }
    assert [tuple(h) for h in found[2]["headers"]] == [("Server", "s"), ("ETag", 'W/"1"'), ("date", "new")]
    assert found[2]["payload_bytes"] == 4
    assert resolved(spark, []) == {}


def test_a_hot_url_is_matched_slice_by_slice(spark):
    rng = random.Random(9)
    rows = []
    for i in range(600):
        url = "http://hot.org/" if i % 3 else f"http://cold.org/{i % 7}"
        full = rng.random() < 0.2
        rows.append((i, url, rng.randrange(3000), "response" if full else "revisit", 200, [("ETag", "t")], None))
    found = resolved(spark, rows)
    for i, url, ts, kind, *_ in rows:
        if kind == "revisit":
            earlier = [(r[2], r[0]) for r in rows if r[3] == "response" and r[1] == url and r[2] < ts]
            assert found[i]["target"] == (max(earlier)[1] if earlier else None)


def test_repeated_records_count_each(spark):
    full = (1, "http://a.org/", 10, "response", 200, [("ETag", "t")], "body")
    revisit = (2, "http://a.org/", 20, "revisit", 304, [("etag", "t")], None)
    rows = [full] * 3 + [revisit] * 2 + [(None, "http://a.org/", 30, "revisit", 304, [("etag", "t")], None)] * 2
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], RECORDS).repartition(3)
    found = warc.resolve(df).collect()
    assert sorted((str(r["record_id"]), r["state"], r["target"]) for r in found) == [("1", "full", None)] * 3 + [("2", "resolved", 1)] * 2 + [("None", "resolved", 1)] * 2


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, name):
    assert differences(spark, connect(FOLDER), QUERIES[name], SQL[name], FOLDER) is None


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(queries())
    assert set(SQL) <= set(oracle_sql())


def test_pipeline_stages(spark, tmp_path):
    """Every stage against plain Python on what it is given."""
    from test_llm_duplicates import deduplicated, leaks, survivors
    from test_llm_rules import expected
    from test_llm_tokens import check_pieces

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    held = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        before = {r["doc_id"]: r for r in docs.collect()}
        docs = spark.read.parquet(str(tmp_path / name))
        held.append((before, docs.collect()))
    assert all(set(rows[0].asDict()) == {"doc_id", "text", "lang", "source", "n_chars"} for _, rows in held[:-1])
    (raw, good), (_, single), (_, cut), (_, clean), (_, pieces) = held
    kept = {r["doc_id"] for r in good}
    for d, r in raw.items():
        m = expected(r["text"])
        if m["n_words"] < 10 or 100 * m["n_repeat_words"] > 20 * m["n_words"] or 10 * m["n_symbols"] > m["n_words"]:
            assert d not in kept
    assert sorted(r["doc_id"] for r in single) == survivors([(r["doc_id"], r["text"]) for r in good])[0]
    words = {d: h for d, _, _, h in deduplicated([(r["doc_id"], r["text"]) for r in single])}
    import hashlib

    assert {r["doc_id"]: hashlib.sha256(b" ".join(r["text"].encode().split())).hexdigest() for r in cut} == words
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
    bad = {r[0] for r in leaks([(r["doc_id"], r["text"]) for r in cut], items)}
    assert bad
    assert {r["doc_id"] for r in clean} == set(words) - bad
    check_pieces(pieces, [(r["doc_id"], r["text"]) for r in clean], 2048)
    whole = corpus_pipeline.run(spark, FOLDER)
    assert sorted(map(str, whole.collect())) == sorted(map(str, pieces))


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace

    from plumbline.llm.common import shared_folder

    context = SimpleNamespace(master="spark://somewhere:7077", getCheckpointDir=lambda: None)
    session = SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda *_: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(session)
