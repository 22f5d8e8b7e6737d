"""Token ids and token counts of whole texts by the tokenizers library.

Texts are cut where no token can cross, and each distinct piece is encoded once by the library. In text of plain
characters the pieces are the tokenizer's own pre-tokens; other text is cut at safe blanks only and those pieces go through
the whole library pipeline, normalisation and special strings included.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import texts

#: Characters of a text handled at once; longer texts are cut at the first safe boundary from here on.
SEGMENT = 1 << 20
#: Bytes of text (about) whose distinct pieces are encoded together.
BATCH = 4 << 20
#: Pieces kept with their ids by a Python worker, over all its tasks; beyond it the memory starts anew.
MEMORY = 700_000

#: Text in which Python's patterns and the library's agree: ASCII without controls, and the letters of Latin-1.
PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"


@dataclass(frozen=True)
class Form:
    """How a family of tokenizers cuts text.

    ``safe`` finds boundaries that no token crosses: a segment ends before each. ``pretokens`` finds the pre-tokens of plain
    text; ``lower`` says that they are lower-cased first.
    """

    safe: str
    pretokens: str
    lower: bool


#: The pre-token patterns of the two public tokenizers, over plain characters.
BYTE_LEVEL = Form(
    r"(?<=\S) (?=\S)",
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+",
    lower=False,
)
WORD_LEVEL = Form(
    r"[\t-\r ]",
    rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s0-9{LETTERS}]+",
    lower=True,
)


def segments(text: str, safe: re.Pattern, size: int = SEGMENT) -> Iterator[str]:
    """A text in parts of about ``size`` characters, cut at safe boundaries only."""
    start = 0
    while len(text) - start > size:
        found = safe.search(text, start + size)
        if not found:
            break
        yield text[start : found.start()]
        start = found.start()
    yield text[start:]


class Encoder:
    """Encodes texts piece by piece; of the ids of a piece their number is kept, or their bytes if ``width`` is given."""

    def __init__(self, path: str, form: Form, width: int | None = None) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        apart = pre_tokenizers.Split("\0", "removed")
        self.pieces = Tokenizer(self.library.model)
        self.pieces.pre_tokenizer = pre_tokenizers.Sequence(
            [apart, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.safe = re.compile(form.safe)
        self.pretokens = re.compile(form.pretokens).findall
        self.lower = form.lower
        self.width = width
        self.known: dict[str | bytes, object] = {}

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and "<|" not in text

    def keys(self, text: str) -> list[str | bytes]:
        """The pieces of a text: pre-tokens as text, others as bytes."""
        if self.plain(text):
            return self.pretokens(text.lower() if self.lower else text)
        found: list[str | bytes] = []
        for part in segments(text, self.safe, 1):
            if self.plain(part):
                found.extend(self.pretokens(part.lower() if self.lower else part))
            else:
                found.append(part.encode("utf-8", "surrogatepass"))
        return found

    def learn(self, wanted: set[str | bytes]) -> None:
        new = wanted - self.known.keys()
        odd = [k for k in new if isinstance(k, bytes)]
        for k in odd:
            ids = self.library.encode(k.decode("utf-8", "surrogatepass"), add_special_tokens=False).ids
            self.known[k] = np.array(ids, dtype=f"<u{self.width}").tobytes() if self.width else len(ids)
        plain = list(new.difference(odd))
        for start in range(0, len(plain), 4096):
            some = plain[start : start + 4096]
            encoded = self.pieces.encode("\0".join(some), add_special_tokens=False)
            at = np.searchsorted(np.array(encoded.word_ids), np.arange(len(some) + 1))
            if self.width:
                data = np.array(encoded.ids, dtype=f"<u{self.width}").tobytes()
                edges = (at * self.width).tolist()
                self.known.update(zip(some, [data[i:j] for i, j in zip(edges, edges[1:], strict=False)], strict=True))
            else:
                self.known.update(zip(some, np.diff(at).tolist(), strict=True))

    def run(self, rows: Iterable[str]) -> Iterator[list]:
        """The values of the pieces of each text, one list for each segment, None after the last of a text."""
        held: list[list | None] = []
        size = 0

        def flush() -> Iterator[list]:
            if len(self.known) > MEMORY:
                self.known.clear()
            self.learn(set().union(*[k for k in held if k]))
            known = self.known
            for keys in held:
                yield None if keys is None else list(map(known.__getitem__, keys))

        for text in rows:
            for part in segments(text, self.safe):
                held.append(self.keys(part))
                size += len(part)
                if size >= BATCH:
                    yield from flush()
                    held, size = [], 0
            held.append(None)
        yield from flush()


def encoder_of_worker(path: str, form: Form, width: int | None = None) -> Encoder:
    """An encoder that stays in the Python worker, so that its next tasks know the pieces of the last ones."""
    held = sys.modules.setdefault("_plumbline_encoders", SimpleNamespace(by={}))
    key = (path, form.safe, form.pretokens, form.lower, width)
    if key not in held.by:
        held.by.clear()
        held.by[key] = Encoder(path, form, width)
    return held.by[key]


def lengths(encoder: Encoder, rows: Iterable[str]) -> Iterator[int]:
    """The number of tokens of each text, for an encoder without width."""
    total = 0
    for values in encoder.run(rows):
        if values is None:
            yield total
            total = 0
        else:
            total += sum(values)


def joined(encoder: Encoder, rows: Iterable[str]) -> Iterator[bytes]:
    """The ids of each text as little-endian bytes, for an encoder with width."""
    parts: list[bytes] = []
    for values in encoder.run(rows):
        if values is None:
            yield b"".join(parts)
            parts = []
        else:
            parts.append(b"".join(values))


def count_tokens(docs: DataFrame, path: str, form: Form, limit: int = 512) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for each document: lengths only, no ids leave a task.

    Begin, end and added special tokens are left out; special strings inside a text are read as the library does by
    default. Null text counts as empty: no bytes, no tokens. Long texts are cut at safe boundaries, so memory depends on the
    longest text, not on its tokens. Repeated rows are counted each; an empty table gives no row.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of_worker(path, form)
        for batch in rows:
            found = texts(batch)
            n = np.fromiter(lengths(encoder, found), dtype=np.int64, count=len(found))
            size = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in found), dtype=np.int64, count=len(found))
            columns = [batch.column(0), pa.array(size), pa.array(n), pa.array(n > limit)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    schema = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
