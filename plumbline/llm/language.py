"""Language identification of mixed text: script ranges, word scores, and Viterbi with a penalty for switching.

A word's letters tell its script, which leaves the languages that use that script; trigrams score those. The best labels of
a document's words, where each change of language costs a penalty, give its spans.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells into which trigrams are hashed.
CELLS = 1 << 14
#: Labelled documents of each language that the model learns from, about.
SAMPLE = 2000
#: What a change of language costs, and the most that one word says against a language, in nats.
PENALTY = 12.0
MOST = 10.0
#: The share of a language's training letters from which on it uses a script.
USES = 0.01
#: Words x languages labelled at once, and words remembered by a task.
AT_ONCE = 12_000_000
MEMORY = 400_000
UNKNOWN = "und"

#: First code points of ranges, and the script from there on (0: none or another).
RANGES = (
    (0x0000, 0),
    (0x0041, 1),  # Latin
    (0x0250, 0),
    (0x0370, 2),  # Greek
    (0x0400, 3),  # Cyrillic
    (0x0530, 4),  # Armenian
    (0x0590, 5),  # Hebrew
    (0x0600, 6),  # Arabic
    (0x0780, 0),
    (0x0900, 7),  # Devanagari
    (0x0980, 8),  # Bengali
    (0x0A00, 0),
    (0x0B80, 9),  # Tamil
    (0x0C00, 0),
    (0x0E00, 10),  # Thai
    (0x0E80, 0),
    (0x10A0, 11),  # Georgian
    (0x1100, 12),  # Hangul
    (0x1200, 0),
    (0x1E00, 1),  # Latin
    (0x1F00, 2),  # Greek
    (0x2000, 0),
    (0x3040, 13),  # Kana
    (0x3100, 0),
    (0x3400, 14),  # Han
    (0xA000, 0),
    (0xAC00, 12),  # Hangul
    (0xD7B0, 0),
    (0xF900, 14),  # Han
    (0xFB00, 0),
)
SCRIPTS = 15


@dataclass
class Words:
    """What is counted of a list of words: trigram cells by letter, and letters by script for each word."""

    cells: np.ndarray
    starts: np.ndarray
    scripts: np.ndarray


def inspect(words: list[str]) -> Words:
    """Trigrams around each character of each word, word ends included, and the letters of each script."""
    points = np.frombuffer(("\x01" + "\x01".join(words) + "\x01").encode("utf-32-le", "surrogatepass"), dtype="<u4")
    points = points.astype(np.uint64)
    inner = np.flatnonzero(points[1:-1] != 1) + 1
    mixed = (points[inner - 1] * np.uint64(0x9E3779B97F4A7C15) + points[inner]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed = (mixed + points[inner + 1]) * np.uint64(0x94D049BB133111EB)
    cells = (mixed >> np.uint64(64 - CELLS.bit_length() + 1)).astype(np.int64)
    own, inverse = np.unique(points[inner], return_inverse=True)
    place = np.searchsorted([r[0] for r in RANGES], own, side="right") - 1
    script = np.array([r[1] for r in RANGES])[place]
    letter = np.array([chr(int(p)).isalpha() for p in own], dtype=bool)
    kind = np.where(letter, script + 1, 0)[inverse]
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(words)), lengths)
    scripts = np.bincount(of * (SCRIPTS + 1) + kind, minlength=len(words) * (SCRIPTS + 1))
    return Words(cells, starts, scripts.reshape(len(words), SCRIPTS + 1)[:, 1:])


def split(text: str) -> list[str]:
    """The words of a text in lower case, without the mark that stands between words."""
    return text.lower().replace("\x01", " ").split()


@dataclass
class Model:
    """Log-probabilities of trigram cells by language, and the scripts that each language uses."""

    languages: list[str]
    logs: np.ndarray
    uses: np.ndarray

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """What each word says against each language (0 for the best, down to -MOST), and its letters."""
        seen = inspect(words)
        sums = np.add.reduceat(self.logs[seen.cells], seen.starts, axis=0)
        letters = seen.scripts.sum(axis=1)
        allowed = self.uses[:, seen.scripts.argmax(axis=1)].T
        narrowed = np.where(allowed, sums, -np.inf)
        best = narrowed.max(axis=1, keepdims=True)
        against = np.maximum(narrowed - np.where(np.isfinite(best), best, 0), -MOST)
        against[~allowed.any(axis=1) | (letters == 0)] = 0
        return against.astype(np.float32), letters


def learn(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from ``text`` and ``lang`` of labelled documents (both not null): about ``sample`` of each language by hash.

    The hash is of doc_id and text, so that copies of a text are drawn one by one. At most languages x cells rows reach the
    driver.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("lang", "text", "doc_id")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((CELLS, 0), dtype=np.float32), np.zeros((0, SCRIPTS), dtype=bool))
    shares = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, sample / v))])
    chance = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    picked = known.filter(chance < F.element_at(shares, F.col("lang"))).select("lang", "text")

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            by_language: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_language.setdefault(lang, []).extend(split(text))
            for lang, words in by_language.items():
                if words:
                    seen = inspect(words)
                    counts = np.concatenate((np.bincount(seen.cells, minlength=CELLS), seen.scripts.sum(axis=0)))
                    cell = np.flatnonzero(counts)
                    columns = [pa.array([lang] * len(cell)), pa.array(cell.astype(np.int32)), pa.array(counts[cell])]
                    yield pa.RecordBatch.from_arrays(columns, ["lang", "cell", "n"])

    counted = picked.mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros((len(languages), CELLS + SCRIPTS))
    row = np.array([languages.index(x) for x in counted.column("lang").to_pylist()], dtype=np.int64)
    counts[row, counted.column("cell").to_numpy()] = counted.column("n").to_numpy()
    grams, letters = counts[:, :CELLS] + 0.5, counts[:, CELLS:]
    logs = np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32)
    return Model(languages, np.ascontiguousarray(logs), letters >= np.maximum(1, USES * letters.sum(axis=1, keepdims=True)))


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
    """The best labels of words: ``scores`` of the words of all documents, one document after the other.

    Documents go forward in step, the longest first, so each step is one operation on those that still have words.
    """
    if not len(scores):
        return np.zeros(0, dtype=np.int16)
    starts = np.cumsum(sizes) - sizes
    turn = np.argsort(-sizes, kind="stable")
    starts, lengths = starts[turn], sizes[turn]
    n_labels = scores.shape[1]
    live = np.searchsorted(-lengths, -np.arange(1, int(lengths.max(initial=0)) + 1), side="right")
    moved = np.zeros(scores.shape, dtype=bool)
    source = np.zeros(len(scores), dtype=np.int16)
    total = np.zeros((len(sizes), n_labels), dtype=np.float32)
    for t, n in enumerate(live.tolist()):
        at = starts[:n] + t
        held = total[:n]
        if t:
            best = held.argmax(axis=1)
            switch = held[np.arange(n), best] - np.float32(penalty)
            held -= switch[:, None]  # only differences count: this also keeps the sums small
            moved[at] = held < 0
            source[at] = best
            np.maximum(held, 0, out=held)
        held += scores[at]
    labels = np.zeros(len(scores), dtype=np.int16)
    state = total.argmax(axis=1).astype(np.int16)
    for t in reversed(range(len(live))):
        n = int(live[t])
        at = starts[:n] + t
        labels[at] = state[:n]
        if t:
            state[:n] = np.where(moved[at, state[:n]], source[at], state[:n])
    return labels


SPANS = "doc_id long, lang_pred string, score double, spans array<struct<lang:string,first:int,n_words:int,letters:long>>"
SPAN_TYPE = pa.list_(
    pa.struct([("lang", pa.string()), ("first", pa.int32()), ("n_words", pa.int32()), ("letters", pa.int64())])
)


def label(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` of each document, from its text alone.

    ``spans``: runs of words of one language. ``lang_pred`` is the language with most letters in them (of equal ones the
    first by name), ``score`` its share of the letters. Null text, text without a letter, or a model without languages give
    'und', 0 and no spans. Repeated rows are labelled each; an empty table gives no row.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[str, int] = {}
        table = np.zeros((0, len(model.languages)), dtype=np.float32)
        letters = np.zeros(0, dtype=np.int64)

        def answer(names: list, held: list[list[str]]) -> pa.RecordBatch:
            nonlocal number, table, letters
            if len(number) > MEMORY:
                number, table, letters = {}, table[:0], letters[:0]
            new = list(set().union(*held).difference(number))
            if new:
                number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                scores, n = model.scores(new)
                table, letters = np.concatenate((table, scores)), np.concatenate((letters, n))
            sizes = np.array([len(w) for w in held], dtype=np.int64)
            ids = np.fromiter((number[w] for words in held for w in words), dtype=np.int64, count=int(sizes.sum()))
            labels = viterbi(table[ids], sizes)
            weight = letters[ids]
            columns: list[list] = [names, [], [], []]
            for start, size in zip((np.cumsum(sizes) - sizes).tolist(), sizes.tolist(), strict=True):
                own, w = labels[start : start + size], weight[start : start + size]
                total = int(w.sum())
                if not total:
                    for column, value in zip(columns[1:], (UNKNOWN, 0.0, []), strict=True):
                        column.append(value)
                    continue
                first = np.flatnonzero(np.diff(own, prepend=-1))
                sums = np.add.reduceat(w, first)
                by_language = np.bincount(own[first], weights=sums, minlength=len(model.languages))
                best = int(by_language.argmax())
                columns[1].append(model.languages[best])
                columns[2].append(float(by_language[best]) / total)
                n = np.diff(np.append(first, size))
                fields = zip(own[first].tolist(), first.tolist(), n.tolist(), sums.tolist(), strict=True)
                columns[3].append([{"lang": model.languages[a], "first": b, "n_words": c, "letters": d} for a, b, c, d in fields])
            kinds = [pa.int64(), pa.string(), pa.float64(), SPAN_TYPE]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, ["doc_id", "lang_pred", "score", "spans"])

        for batch in rows:
            names, held, size = [], [], 0
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split(text or "") if model.languages else []
                names.append(name)
                held.append(words)
                size += len(words) * len(model.languages)
                if size >= AT_ONCE:
                    yield answer(names, held)
                    names, held, size = [], [], 0
            if names:
                yield answer(names, held)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SPANS)


def held_out(doc_id: Column) -> Column:
    """Whether the CRC-32 of a doc_id as text leaves 1 when divided by 3; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
