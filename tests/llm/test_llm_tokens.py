"""Token counts, packing and token files against the tokenizers library itself."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import elias_fano, packing, token_files, tokens

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "a <|endoftext|> b",
    "<|ENDOFTEXT|>x<|startoftext|>",
    "É é ﬁ Σας ΑΣ ÀÇ",
    "  two  spaces\n\n x ",
    "don't 'S we'LL 12345 ½ ²",
    "日本語 текст \x1c a\x1cb \x85 c",
    "tab\t\tx\r\ny \t ",
    "a b c",
    "😀 b!!… c",
    " ",
    "\n",
    " a",
    "a ",
    "İstanbul K",
    "é a ́b",
    "x" * 3000,
    "?!.,;: (a) [b] {c}",
]


@pytest.mark.parametrize("size", [tokens.SEGMENT, 7])
@pytest.mark.parametrize(("path", "form"), [(BYTES, tokens.BYTE_LEVEL), (WORDS, tokens.WORD_LEVEL)])
def test_pieces_give_the_ids_of_the_library(path, form, size, awkward, monkeypatch):
    """Also where texts are cut at the first safe boundary after a few characters."""
    monkeypatch.setattr(tokens.segments, "__defaults__", (size,))
    texts = ODD + [t or "" for _, t, *_ in awkward]
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert list(tokens.lengths(tokens.Encoder(path, form), texts)) == [len(w) for w in want]
    found = list(tokens.joined(tokens.Encoder(path, form, 4), texts))
    assert [np.frombuffer(f, "<u4").tolist() for f in found] == want


def test_memory_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY", 3)
    monkeypatch.setattr(tokens, "BATCH", 10)
    encoder = tokens.Encoder(BYTES, tokens.BYTE_LEVEL)
    texts = [f"word{i} other{i} and {i}" for i in range(50)]
    library = Tokenizer.from_file(BYTES)
    assert list(tokens.lengths(encoder, texts)) == [len(library.encode(t).ids) for t in texts]


def test_counts(make, awkward):
    library = Tokenizer.from_file(BYTES)
    found = tokens.count_tokens(make(awkward, clashing=True), BYTES, tokens.BYTE_LEVEL).collect()
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "").ids), n > 512) for d, t, *_ in awkward]
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert tokens.count_tokens(make([]), BYTES, tokens.BYTE_LEVEL).count() == 0


def ids_of(text):
    return np.array([*Tokenizer.from_file(WORDS).encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], list(range(1000)), [3, 3, 10**9, 10**12, 10**12]])
def test_elias_fano(values):
    data = elias_fano.encode(np.array(values, dtype=np.uint64))
    code = elias_fano.EliasFano(data)
    assert code.all().tolist() == values
    assert [code[i] for i in range(len(code))] == values
    with pytest.raises(IndexError):
        code[len(values)]
    places = np.array([*range(len(values))] * 2, dtype=np.int64)[::-1]
    assert code.at(places).tolist() == [values[i] for i in places]
    with pytest.raises(IndexError):
        code.at(np.array([len(values)]))


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(1).integers(1, 1500, 50_000)).astype(np.uint64)
    data = elias_fano.encode(values)
    assert len(data) * 8 / len(values) < 2 + np.log2(int(values[-1]) / len(values)) + 1.5
    code = elias_fano.EliasFano(data)
    assert [code[i] for i in range(0, 50_000, 997)] == values[::997].tolist()


def test_images_read_one_document_at_a_time():
    ids = [np.arange(n, dtype="<u2") for n in (3, 0, 70, 1)]
    image = token_files.Image(token_files.write_image([None, -4, 7, 7], [len(x) for x in ids], b"".join(x.tobytes() for x in ids), 2))
    assert [image.doc_id(i) for i in range(len(image))] == [None, -4, 7, 7]
    assert [image.start(i) for i in range(len(image))] == [0, 3, 3, 73]
    assert [image.ids(i).tolist() for i in range(len(image))] == [x.tolist() for x in ids]
    with pytest.raises(ValueError, match="token image"):
        token_files.Image(b"x" * 100)


def test_token_files(spark, make, awkward, tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "IMAGE_IDS", 500)
    folder = str(tmp_path / "tokens")
    token_files.write_tokens(make(awkward, clashing=True), folder, WORDS, tokens.WORD_LEVEL, 1)
    found = sorted(token_files.read_tokens(spark, folder).collect(), key=lambda r: r["start"])
    ids = collections.defaultdict(list)
    for d, t, *_ in awkward:
        ids[d].append(zlib.crc32(ids_of(t).tobytes()))
    assert [r["doc_id"] for r in found] == sorted((d for d, *_ in awkward), key=lambda d: (d is not None, d or 0))
    start = 0
    for r in found:
        assert r["start"] == start
        assert r["ids_crc32"] in ids[r["doc_id"]]
        start += r["n_tokens"]
    assert start == sum(len(ids_of(t)) for _, t, *_ in awkward)
    token_files.write_tokens(make([]), str(tmp_path / "none"), WORDS, tokens.WORD_LEVEL, 1)
    assert token_files.read_tokens(spark, str(tmp_path / "none")).count() == 0


def check_pieces(rows, docs, window):
    ids = collections.defaultdict(list)
    for d, t, *_ in docs:
        ids[d].append(ids_of(t))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    assert set(by_doc) == set(ids)
    for d, pieces in by_doc.items():
        assert sum(p["length"] for p in pieces) == sum(map(len, ids[d]))
        if len(ids[d]) == 1:
            start = 0
            for p in sorted(pieces, key=lambda p: p["start"]):
                assert (p["start"], p["doc_tokens"]) == (start, len(ids[d][0]))
                assert p["ids_crc32"] == zlib.crc32(ids[d][0][start : start + p["length"]].tobytes())
                start += p["length"]
    for pieces in by_sequence.values():
        offset = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == offset
            offset += p["length"]
        assert offset == window or (offset < window and offset & (offset - 1) == 0)


@pytest.mark.parametrize("part_bytes", [1 << 22, 2000])
def test_packing(make, awkward, monkeypatch, part_bytes):
    monkeypatch.setattr(packing, "PART_BYTES", part_bytes)
    monkeypatch.setattr(packing, "LANE", 3)
    docs = make(awkward, clashing=True)
    check_pieces(packing.pack(docs, WORDS, tokens.WORD_LEVEL, 1).collect(), awkward, 2048)
    rows = packing.pack(docs, WORDS, tokens.WORD_LEVEL, 1, shares={"src1": 0.7, "src2": 0.3}, window=64, least=8).collect()
    check_pieces(rows, awkward, 64)


def test_nothing_to_pack(make):
    assert packing.pack(make([]), WORDS, tokens.WORD_LEVEL, 1).count() == 0


def test_windows_hold_the_wanted_proportions():
    rng = random.Random(4)
    queues = {s: [(f"{s}{i}", rng.randint(1, 3000)) for i in range(400)] for s in "abc"}
    shares = {"a": 0.5, "b": 0.3, "c": 0.2}
    pieces = packing.deal(queues, shares, {}, 2048, 128)
    sequences = collections.defaultdict(collections.Counter)
    for name, _, length, sequence, _ in pieces:
        sequences[sequence][name[0]] += length
    for upto in (1, 5, 20, 100):
        total = sum((sequences[i] for i in range(upto)), collections.Counter())
        for s, share in shares.items():
            assert abs(total[s] - share * 2048 * upto) <= 256  # a deficit never grows
    starved = packing.deal(queues, shares, {"c": 5000.0}, 2048, 128)
    assert {name[0] for name, _, _, sequence, _ in starved if sequence == 0} == {"c"}


def test_parts_carry_what_those_before_owe(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(9), s, rng.randint(1, 50)) for s in ["a"] * 60 + ["b"] * 25 + ["c"] * 3]
    encoded = spark.createDataFrame(rows, "part int, source string, n long")
    total, of = sum(r[2] for r in rows), collections.Counter()
    for _, s, n in rows:
        of[s] += n
    for r in packing.carried(encoded).collect():
        before = [x for x in rows if x[0] < r["part"]]
        owed = of[r["source"]] / total * sum(x[2] for x in before) - sum(x[2] for x in before if x[1] == r["source"])
        assert r["share"] == pytest.approx(of[r["source"]] / total)
        assert r["owed"] == pytest.approx(owed)


def test_rows_of_one_or_no_doc_id_spread(make, spark, monkeypatch):
    """A third of the rows without doc_id, a third with one: parts stay small and everything is packed and written."""
    monkeypatch.setattr(packing, "PART_BYTES", 2000)
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} " + "with words " * (i % 9)) for i in range(300)]
    docs = make(rows)
    path = public_tokenizers.path("word_bpe_49k.json")
    parts = packing.encode(docs, path, tokens.WORD_LEVEL, 1, 6).groupBy("part").count().collect()
    assert len(parts) == 6 and max(r["count"] for r in parts) < 100
    check_pieces(packing.pack(docs, path, tokens.WORD_LEVEL, 1).collect(), rows, 2048)
    folder = token_files.new_folder(spark)
    token_files.write_tokens(docs.repartition(4), folder, path, tokens.WORD_LEVEL, 1)
    found = token_files.read_tokens(spark, folder).orderBy("start").collect()
    assert sorted(str(r["doc_id"]) for r in found) == sorted(str(r[0]) for r in rows)
    at = 0
    for r in found:
        assert r["start"] == at
        at += r["n_tokens"]
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
