from pyspark.sql import functions as F

from plumbline.operators import substrings


def test_names_that_differ_in_a_few_characters_meet_few_texts(spark, monkeypatch):
    met = []
    inner = substrings._candidates
    monkeypatch.setattr(substrings, "_candidates", lambda *a: met.append(inner(*a)) or met[-1])
    rows = spark.range(10_000, 10_300).select(F.lit("p").alias("place"), F.concat(F.lit("seq_"), "id").alias("name"))
    texts = rows.select("place", F.concat(F.lit("nextval('"), "name", F.lit("'::regclass)")).alias("text"))
    assert substrings.occurrences(rows, texts, ["place"], "name", "text").count() == 300
    assert met[0].count() == 300
