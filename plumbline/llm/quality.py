"""Quality rules as a ledger of failure bits, with policies applied afterwards.

Every rule is evaluated once for each document. Its measurements and one bit per failed rule are stored; a policy is a
mask of rules with a version, and applying, comparing or ablating policies reads the bits only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import BLANKS, let, once, without, word_array

SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WINDOW = 5

MEASURES = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_lines",
    "n_dup_lines",
    "n_repeat_words",
    "n_capitals",
    "n_exclamations",
)


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` (of the measurements) is true; ``bit`` is its fixed place in the ledger."""

    bit: int
    name: str
    fails: Column | str

    def mask(self) -> int:
        return 1 << self.bit


RULES = (
    Rule(0, "few_words", "n_words < 10"),
    Rule(1, "repeated_words", "100 * n_repeat_words > 20 * n_words"),
    Rule(2, "symbols", "10 * n_symbols > n_words"),
    Rule(3, "repeated_lines", "100 * n_dup_lines > 60 * n_lines"),
    Rule(4, "word_length", "word_chars < 2 * n_words OR word_chars > 15 * n_words"),
    Rule(5, "capitals", "2 * n_capitals > word_chars"),
    Rule(6, "exclamations", "10 * n_exclamations > 3 * n_words"),
)


@dataclass(frozen=True)
class Policy:
    """Rejects a document if one of its rules failed."""

    name: str
    version: int
    rules: tuple[str, ...]

    def mask(self, rules: tuple[Rule, ...] = RULES) -> int:
        known = {r.name: r.mask() for r in rules}
        return sum(known[name] for name in self.rules)


BASE = Policy("base", 1, ("few_words", "repeated_words"))
FULL = Policy("full", 1, tuple(r.name for r in RULES))


def repeated_words(words: Column) -> Column:
    """Words covered by windows of five words that occur twice or more in the same text.

    Windows are compared as text. Sorted, equal windows are neighbours; a covered word is counted once.
    """
    last = F.size(words) - WINDOW
    windows = F.transform(
        F.sequence(F.lit(0), last),
        lambda i: F.struct(F.array_join(F.slice(words, i + 1, WINDOW), " ").alias("w"), i.alias("at")),
    )

    def repeated(s: Column) -> Column:
        same = lambda x, i: F.coalesce((F.get(s, i)["w"] == x["w"]), F.lit(False))
        return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["at"]))

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda total, step: total + step)

    return let(F.sort_array(windows), lambda s: let(repeated(s), covered))


def measure(docs: DataFrame) -> DataFrame:
    """``row`` (all columns of the document) and the measurements as longs; null text counts as empty.

    A hash of each window tells which texts may repeat one; only those sort their windows.
    """
    text = F.coalesce(F.col("row.text"), F.lit(""))
    first = docs.select(F.struct("*").alias("row")).select("row", text.alias("text"), word_array(text).alias("words"))
    hashes = F.transform(
        F.sequence(F.lit(0), F.size("words") - WINDOW),
        lambda i: F.xxhash64(*[F.get(F.col("words"), i + k) for k in range(WINDOW)]),
    )
    lines = F.filter(F.split("text", "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != "")
    second = first.select(
        "row",
        "words",
        F.size("words").alias("n_words"),
        without(F.col("text"), BLANKS).alias("word_chars"),
        (F.length("text") - without(F.col("text"), SYMBOLS)).alias("n_symbols"),
        (F.length("text") - without(F.col("text"), CAPITALS)).alias("n_capitals"),
        (F.length("text") - without(F.col("text"), "!")).alias("n_exclamations"),
        lines.alias("lines"),
        F.when(F.size("words") > WINDOW, hashes).alias("hashes"),
    )
    hinted = F.coalesce(F.size("hashes") > F.size(F.array_distinct("hashes")), F.lit(False))
    third = second.select(
        "row",
        once(F.col("n_words")).alias("n_words"),
        "word_chars",
        "n_symbols",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.when(hinted, repeated_words(F.col("words"))).otherwise(0).alias("n_repeat_words"),
        "n_capitals",
        "n_exclamations",
    )
    return third.select("row", *[F.col(m).cast("long").alias(m) for m in MEASURES])


def ledger(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``row``, the measurements and ``fail_bits``: every rule evaluated once, for each document.

    Input: ``text`` among any columns, which stay inside ``row``, so no name can clash. Null and empty texts have zero
    measurements and fail ``few_words``. Repeated rows each get their own entry; an empty table gives an empty ledger.
    """
    bits = F.lit(0).cast("long")
    for rule in rules:
        fails = F.expr(rule.fails) if isinstance(rule.fails, str) else rule.fails
        bits = bits.bitwiseOR(F.when(fails, F.lit(rule.mask()).cast("long")).otherwise(F.lit(0).cast("long")))
    return measure(docs).withColumn("fail_bits", bits)


def rejected(policy: Policy, rules: tuple[Rule, ...] = RULES) -> Column:
    """Whether a policy rejects a ledger entry."""
    return F.col("fail_bits").bitwiseAND(F.lit(policy.mask(rules)).cast("long")) != 0


def ablation(entries: DataFrame, policies: tuple[Policy, ...], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """For each policy and each of its rules: documents that fail it, and documents that only it rejects.

    The ledger is first counted by its bits, at most 2 to the number of rules rows, so the rest is tiny.
    """
    counted = entries.groupBy("fail_bits").agg(F.count("*").alias("n"))
    known = {r.name: r.mask() for r in rules}
    pairs = F.array(
        *[
            F.struct(
                F.lit(p.name).alias("policy"),
                F.lit(p.version).alias("version"),
                F.lit(name).alias("rule"),
                F.lit(p.mask(rules)).cast("long").alias("mask"),
                F.lit(known[name]).cast("long").alias("bit"),
            )
            for p in policies
            for name in p.rules
        ]
    )
    each = counted.select("fail_bits", "n", F.inline(pairs))
    failed = F.col("fail_bits").bitwiseAND(F.col("mask"))
    return each.groupBy("policy", "version", "rule").agg(
        F.sum(F.when(failed.bitwiseAND(F.col("bit")) != 0, F.col("n")).otherwise(0)).alias("n_failed"),
        F.sum(F.when(failed == F.col("bit"), F.col("n")).otherwise(0)).alias("n_only"),
        F.sum(F.when(failed != 0, F.col("n")).otherwise(0)).alias("n_rejected"),
    )


def keep_good(docs: DataFrame, policy: Policy = FULL) -> DataFrame:
    """The documents that a policy accepts, with their own columns.

    Null and empty texts fail ``few_words``; very long ones are measured whole; repeated rows stay or go together; an empty
    table stays empty. Other columns may have any names.
    """
    return ledger(docs).filter(~rejected(policy)).select("row.*")
