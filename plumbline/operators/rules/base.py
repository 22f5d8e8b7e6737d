"""Shared shape of the rules over snapshots.

A rule turns one run's snapshot rows into findings.  Rules that only look at
one row are declared as ``RowRule`` values, so all of them that read the same
snapshot table can be answered in a single scan.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.keys import dedup_key, dotted

RUN = ["environment_id", "run_id"]
TABLE = [*RUN, "database_name", "schema_name", "table_name"]
GIB = 1 << 30
MIB = 1 << 20

Bundle = Mapping[str, DataFrame]

FINDING_COLUMNS = (
    "environment_id",
    "run_id",
    "rule_id",
    "severity",
    "object_type",
    "object_key",
    "database_name",
    "schema_name",
    "object_name",
    "title",
    "evidence",
    "confidence",
    "dedup_key",
)


@dataclass(frozen=True)
class Settings:
    """Rule parameters; read from the policy columns when the rows carry them."""

    from_policies: bool = False

    def number(self, rule_id: str, name: str, default: float) -> Column:
        value = self._text(rule_id, name).try_cast("double") if self.from_policies else F.lit(None).cast("double")
        return F.when(value > 0, value).otherwise(F.lit(float(default)))

    def flag(self, rule_id: str, name: str, default: bool) -> Column:
        value = self._text(rule_id, name).try_cast("boolean") if self.from_policies else F.lit(None).cast("boolean")
        return F.coalesce(value, F.lit(default))

    def word(self, rule_id: str, name: str, default: str) -> Column:
        value = self._text(rule_id, name) if self.from_policies else F.lit(None).cast("string")
        return F.coalesce(value, F.lit(default))

    @staticmethod
    def _text(rule_id: str, name: str) -> Column:
        key = f"{rule_id}|{name}"
        return F.coalesce(F.col("schema_parameters")[key], F.col("environment_parameters")[key])


DEFAULTS = Settings()


@dataclass(frozen=True)
class RowRule:
    """A rule decided by one row of ``source``."""

    rule_id: str
    source: str
    when: Column
    severity: Column | str
    object_type: Column | str
    object_key: Column
    title: Column | str
    evidence: Mapping[str, Column] | Column
    object_name: Column | None = None
    schema_name: Column | None = None
    confidence: Column | float | None = None
    dedup_title: Column | str | None = None
    dedup_key: Column | None = None
    stored_key: Column | None = None


def _column(value: Column | str) -> Column:
    return F.lit(value) if isinstance(value, str) else value


def finding_fields(df_columns: Sequence[str], rule: RowRule) -> list[Column]:
    """The finding of a matching row as columns in ``FINDING_COLUMNS`` order."""

    def own(name: str) -> Column:
        return F.col(name) if name in df_columns else F.lit("")

    title = _column(rule.title)
    rule_id = F.lit(rule.rule_id)
    if isinstance(rule.evidence, Column):  # JSON text already
        evidence = rule.evidence
    else:
        evidence = F.to_json(F.struct(*[c.alias(k) for k, c in rule.evidence.items()])) if rule.evidence else F.lit("{}")
    seed = title if rule.dedup_title is None else _column(rule.dedup_title)
    key = rule.stored_key
    if key is None:
        key = dedup_key(rule_id, rule.object_key if rule.dedup_key is None else rule.dedup_key, seed)
    return [
        F.col("environment_id"),
        F.col("run_id"),
        rule_id.alias("rule_id"),
        _column(rule.severity).alias("severity"),
        _column(rule.object_type).alias("object_type"),
        rule.object_key.alias("object_key"),
        own("database_name").alias("database_name"),
        (own("schema_name") if rule.schema_name is None else rule.schema_name).alias("schema_name"),
        (own("table_name") if rule.object_name is None else rule.object_name).alias("object_name"),
        title.alias("title"),
        evidence.alias("evidence"),
        (rule.confidence if isinstance(rule.confidence, Column) else F.lit(rule.confidence)).cast("double").alias("confidence"),
        key.alias("dedup_key"),
    ]


def match(df: DataFrame, rule: RowRule) -> DataFrame:
    """Findings of one row rule; the predicate stays a plain filter that can be pushed down."""
    return df.where(rule.when).select(*finding_fields(df.columns, rule))


def match_all(df: DataFrame, rules: Sequence[RowRule]) -> DataFrame:
    """Findings of several row rules over the same rows in one scan."""
    if len(rules) == 1:
        return match(df, rules[0])
    hits = F.array(*[F.when(r.when, F.struct(*finding_fields(df.columns, r))) for r in rules])
    return df.select(F.explode(F.filter(hits, lambda h: h.isNotNull())).alias("f")).select("f.*")


def structural(
    rule_id: str,
    source: str,
    when: Column,
    object_type: str,
    object_name: Column,
    severity: str,
    evidence: Mapping[str, Column],
) -> RowRule:
    """A rule whose key is ``database.schema.object`` and whose title repeats it."""
    key = dotted("database_name", "schema_name", object_name)
    return RowRule(
        rule_id, source, when, severity, object_type, key, F.concat(F.lit(rule_id + ": "), key), evidence, object_name
    )


def table_key() -> Column:
    return dotted("database_name", "schema_name", "table_name")


RuleFunction = Callable[[Bundle, Settings], DataFrame]


class Family:
    """The rules of one family: row rules and rules that need more than one row.

    Rules are registered by id and built when asked for, so running one rule
    does not build the expressions of all others.
    """

    def __init__(self) -> None:
        self.builders: list[tuple[tuple[str, ...], Callable[[Settings], list[RowRule]]]] = []
        self.functions: dict[str, RuleFunction] = {}
        self.inputs: dict[str, tuple[str, ...]] = {}

    def rows(self, *rule_ids: str):
        """Register a builder of the named row rules."""

        def register(build: Callable[[Settings], list[RowRule]]):
            self.builders.append((rule_ids, build))
            return build

        return register

    def rule(self, rule_id: str, *inputs: str):
        """Register a rule with the snapshot tables it reads."""

        def register(function: RuleFunction) -> RuleFunction:
            self.functions[rule_id] = function
            self.inputs[rule_id] = inputs
            return function

        return register

    def row_rules(self, settings: Settings, rule_id: str | None = None) -> list[RowRule]:
        """All row rules of the family, or those of one id."""
        chosen = [build for rule_ids, build in self.builders if rule_id is None or rule_id in rule_ids]
        return [rule for build in chosen for rule in build(settings) if rule_id in (None, rule.rule_id)]
