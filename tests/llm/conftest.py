import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may bring them along.
CLASHING = ("row", "words", "n_words", "fail_bits", "runs", "uid", "part", "shard", "fp", "key", "anchor", "d", "u")


@pytest.fixture(scope="session")
def make(spark):
    """Documents from ``(doc_id, text)`` or ``(doc_id, text, lang, source)``, with columns of clashing names if wanted."""

    def documents(rows, clashing=False):
        full = [(r[0], r[1], *(r[2:] or (None, None)), None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, SCHEMA)
        for name in CLASHING if clashing else ():
            df = df.selectExpr("*", f"'x' AS {name}")
        return df

    return documents


@pytest.fixture(scope="session")
def awkward():
    """Null and empty texts, a very long one, copies, near copies, a null doc_id, a repeated row, odd characters."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choices(vocabulary, k=n))
    shared = prose(70)
    long = prose(30_000)
    base = prose(300)
    rows = [
        (1, None),
        (2, ""),
        (3, " \n\t "),
        (4, "one"),
        (5, base),
        (6, base),
        (7, base + " more"),
        (8, long),
        (None, base),
        (9, "repeated row with a few words in it to count here"),
        (9, "repeated row with a few words in it to count here"),
        (10, prose(40) + " " + shared + "\n" + prose(30)),
        (11, prose(60) + "\n\n" + shared + "  " + prose(10)),
        (12, shared),
        (13, "Ünïcödé — “quotes” 日本語 текст 😀 <|endoftext|> don't stop"),
        (14, "a\nb c\na\n \na\nb c"),
        (15, " ".join(["same words again and"] * 40)),
        (16, prose(20) + " " + " ".join(long.split()[1000:1080])),
        (-3, prose(55)),
    ]
    return [(d, t, "en" if i % 2 else None, None if i % 5 == 0 else f"src{i % 3}") for i, (d, t) in enumerate(rows)]
