"""Deep pages and trigram candidates against plain sorting and ILIKE."""

import random

from pyspark.sql import functions as F

from plumbline.operators import pages, trigrams
from plumbline.operators.scores import like_pattern

SCHEMA = "a int, b string, id int"


def rows_of(spark):
    rng = random.Random(8)
    rows = [(rng.choice([None, 1, 2, 3]), rng.choice([None, "x", "y", "zz"]), i) for i in range(500)]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(5)


KEYS = [(lambda: F.col("a"), True), (lambda: F.col("b"), False), (lambda: F.col("id"), True)]


def keys():
    return [(k(), falls) for k, falls in KEYS]


def sorted_rows(rows):
    return sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] is not None, r[1] or "", -r[2]))


def test_cursors_give_every_row_once(spark):
    rows, frame = rows_of(spark)
    seen, cursor = [], ()
    while True:
        page = [tuple(r) for r in pages.page_after(frame, keys(), cursor, 130).collect()]
        if not page:
            break
        seen += page
        cursor = page[-1]
    assert seen == sorted_rows(rows)


def test_numbered_pages_read_their_parts_only(spark, tmp_path):
    rows, frame = rows_of(spark)
    path = str(tmp_path / "rank")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        pages.write_rank_index(frame, keys(), path)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{path}/parts").count() > 2
    want = sorted_rows(rows)
    for offset, limit in ((0, 10), (123, 45), (490, 50), (900, 10), (0, 500)):
        page = pages.page_at(spark, path, offset, limit).collect()
        assert [tuple(r)[:3] for r in page] == want[offset : offset + limit]
        assert [r["position"] for r in page] == list(range(offset + 1, min(500, offset + limit) + 1))
    some = pages.page_at(spark, path, 0, 1)
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "(part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    pages.write_rank_index(frame.limit(0), keys(), str(tmp_path / "none"))
    assert pages.page_at(spark, str(tmp_path / "none"), 0, 5).count() == 0


def test_candidates_hold_every_hit(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcXÉ_%", k=rng.randint(0, 9)))
    rows = [(i, rng.choice([None, word()]), word()) for i in range(400)]
    frame = spark.createDataFrame(rows, "id int, title string, name string")
    path = str(tmp_path / "postings")
    trigrams.write_postings(frame, ["id"], ["title", "name"], path)
    for text in ("abc", "AbCa", "a", "", "É_%", "xxxxxxxx", "bab"):
        like = like_pattern(text)
        hit = F.col("title").ilike(like) | F.col("name").ilike(like)
        found = trigrams.candidates(spark, path, ["id"], text)
        narrow = trigrams.narrowed(frame, found, ["id"])
        assert sorted(r["id"] for r in narrow.where(hit).collect()) == sorted(r["id"] for r in frame.where(hit).collect())
        assert found is None or found.count() <= 100
