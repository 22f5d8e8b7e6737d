"""Secret scans over a trigram inverted index, in DataFrame functions only.

Every rule's pattern is turned into a Boolean query: alternatives, each a set of trigrams that a matching text must hold.
The index has a posting list for each trigram of the queries; lists of an alternative are intersected, alternatives united,
and only those candidates are searched by the pattern. Rules whose pattern has no mandatory trigram search every text.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, let

#: Postings in a shard of the index, about; a shard's lists are held by one row.
SHARD_POSTINGS = 20_000
#: Shards at least.
LEAST_SHARDS = 64
#: Classes of so many characters, or fewer, are written out as alternatives.
CLASS = 4
#: Alternatives of a query; a pattern with more searches every text.
ALTERNATIVES = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its matches count if ``group`` has ``least`` code points or more.

    Patterns mean the same in Java, RE2 and Python, match no empty text, and are found leftmost first, without overlaps.
    """

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The kinds every scan reports, in this order.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
#: Kinds that this operator adds.
ADDED = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("hosting", r"gh[opsu]_[A-Za-z0-9]+", 0, 40),
    Rule("chat", r"xox[abps]-[A-Za-z0-9-]+", 0, 15),
    Rule("signed", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 30),
)
RULES = BASE + ADDED


def _grown(found: list[tuple[frozenset, str]], item: tuple) -> list[tuple[frozenset, str]]:
    """Alternatives (finished literals, literal that may go on) after one more item of a parsed pattern."""
    kind, what = item
    done = lambda alternatives: list({(a | {b}, "") for a, b in alternatives})
    if kind is sre.LITERAL:
        return [(a, b + chr(what).lower()) for a, b in found]
    if kind is sre.IN and all(k is sre.LITERAL for k, _ in what) and len(what) <= CLASS:
        return list(dict.fromkeys((a, b + chr(c).lower()) for a, b in found for _, c in what))
    if kind is sre.SUBPATTERN:
        return reduce(_grown, what[3], found)
    if kind is sre.BRANCH:
        return [x for branch in what[1] for x in reduce(_grown, branch, found)]
    if kind is sre.MAX_REPEAT:
        least, most, body = what
        if (least, most) == (0, 1) and body[0][0] is sre.LITERAL:
            return found + reduce(_grown, body, found)
        return done(reduce(_grown, body, found)) if least else done(found)
    return found if kind is sre.AT else done(found)


def trigram_query(pattern: str) -> tuple[frozenset[str], ...] | None:
    """Alternatives of lower-case trigrams, one of which every match holds whole; None if a match may do without any.

    Of a mandatory literal every third trigram is asked for, and the last, so that each of its characters is in one.
    """
    found = reduce(_grown, parser.parse(pattern), [(frozenset(), "")])
    if len(found) > ALTERNATIVES:
        return None
    wanted = set()
    for done, rest in found:
        literals = [x for x in (*done, rest) if len(x) >= 3]
        wanted.add(frozenset(x[i : i + 3] for x in literals for i in {*range(0, len(x) - 2, 3), len(x) - 3}))
    return tuple(sorted(wanted, key=sorted)) if all(wanted) else None


def row_key(docs: DataFrame) -> Column:
    """The key of a row in the index. A clash only makes one candidate more, which is then searched in vain."""
    return F.xxhash64(F.struct(*[F.col(f"row.{x}") for x in ("doc_id", "text") if x in docs.columns]))


def _rows(docs: DataFrame) -> DataFrame:
    """``row`` (all columns), its key, and the text, null as empty."""
    rows = docs.select(F.struct("*").alias("row"))
    return rows.select("row", row_key(docs).alias("key"), F.coalesce(F.col("row.text"), F.lit("")).alias("text"))


def build_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``shard, trigram, keys``: sorted keys of the documents whose lower-cased text holds a trigram of a rule's query.

    Shards are parts of the keys, about ``SHARD_POSTINGS`` postings each, so that no list grows with the table. Repeated
    rows have one key. Null and empty texts are in no list; an empty table or rules without trigrams give no rows.
    """
    wanted = sorted({t for r in rules for part in trigram_query(r.pattern) or () for t in part})
    rows = _rows(docs)
    if not wanted:
        return rows.limit(0).selectExpr("0 AS shard", "'' AS trigram", "array(key) AS keys")
    held = let(F.lower("text"), lambda low: F.array_compact(F.array(*[F.when(F.contains(low, F.lit(t)), t) for t in wanted])))
    postings = cut(rows.select("key", F.explode(held).alias("trigram")).distinct())
    shards = max(LEAST_SHARDS, postings.count() // SHARD_POSTINGS)
    shard = F.pmod(F.col("key"), F.lit(shards)).cast("int").alias("shard")
    return postings.groupBy(shard, "trigram").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def _tagged(keys: Column, kind: str) -> Column:
    return F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(kind).alias("kind")))


def candidates(index: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``key, kinds``: keys that an index gives for the queries of the rules that have one, each with its rules' kinds."""
    lists = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("m"))
    none = F.array().cast("array<bigint>")
    found = []
    for rule in rules:
        parts = []
        for part in trigram_query(rule.pattern) or ():
            each = [F.coalesce(F.col("m")[t], none) for t in sorted(part)]
            parts.append(reduce(F.array_intersect, each))
        if parts:
            keys = reduce(F.array_union, parts)
            found.append(_tagged(keys, rule.kind))
    if not found:
        return index.limit(0).selectExpr("0L AS key", "array('') AS kinds")
    hits = lists.select(F.explode(F.concat(*found)).alias("hit")).select("hit.*")
    return hits.groupBy("key").agg(F.sort_array(F.collect_set("kind")).alias("kinds"))


SPANS = "array<struct<start: int, end: int, kind: string, place: int>>"


def matches(text: Column, rule: Rule, place: int) -> Column:
    """Spans (code points, end exclusive) of a rule's matches that are long enough, in order.

    What lies between matches and the matches themselves add up to their places.
    """
    pattern = F.lit(rule.pattern)
    length = lambda items: F.transform(items, lambda x: F.length(x))
    parts = F.arrays_zip(
        length(F.split(text, rule.pattern, -1)).alias("gap"),
        length(F.regexp_extract_all(text, pattern, F.lit(0))).alias("size"),
        length(F.regexp_extract_all(text, pattern, F.lit(rule.group))).alias("value"),
    )

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + x["gap"]
        end = start + x["size"]
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(rule.kind).alias("kind"), F.lit(place).alias("place"))
        more = F.when(x["value"] >= rule.least, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(F.coalesce(end, state["at"]).alias("at"), more.alias("spans"))

    first = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))
    return F.aggregate(parts, first, step, lambda state: state["spans"])


def likely(rule: Rule) -> str:
    """A pattern that is quick to search and found wherever the rule has a match that is long enough."""
    run = re_run(rule.pattern)
    return f"{run}{{{rule.least}}}" if run and rule.least > 1 else rule.pattern


def re_run(pattern: str) -> str | None:
    """The class that a pattern repeats, if it is nothing else."""
    parsed = list(parser.parse(pattern))
    alone = len(parsed) == 1 and parsed[0][0] is sre.MAX_REPEAT and len(parsed[0][1][2]) == 1
    return pattern[:-1] if alone and pattern.startswith("[") and pattern.endswith("]+") else None


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, index: DataFrame | None = None) -> DataFrame:
    """``row`` (all columns of the document) and ``spans`` of every rule's matches, by start, then rule order.

    Input: ``text`` and, if there is one, ``doc_id``, among any columns, which stay inside ``row``. ``index`` is that of the
    same documents; without it one is built. Null and empty texts have no spans, repeated rows each their own entry; whole
    texts of any length are searched; an empty table gives no rows. Every document is joined with its key's candidate
    entry, if it has one: an equality join that Spark splits where a key is hot.
    """
    known = candidates(build_index(docs, rules) if index is None else index, rules)
    rows = _rows(docs).join(known, "key", "left")
    none = F.array().cast(SPANS)
    found = []
    for place, rule in enumerate(rules):
        text = F.col("text")
        asked = F.rlike(text, F.lit(likely(rule)))
        if trigram_query(rule.pattern) is not None:
            asked = F.coalesce(F.array_contains("kinds", rule.kind), F.lit(False)) & asked
        found.append(F.when(asked, matches(text, rule, place)).otherwise(none))
    ordered = F.array_sort(
        F.concat(*found),
        lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["place"] - b["place"]),
    )
    return rows.select("row", ordered.alias("spans"))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the base kinds, a hash of their spans, and all spans, of each row."""
    found = scan(docs)
    kinds = F.array(*[F.lit(r.kind) for r in BASE])
    base = F.filter("spans", lambda s: F.array_contains(kinds, s["kind"]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("row.doc_id", *[count(r.kind) for r in BASE], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
