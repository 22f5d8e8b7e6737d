"""All rules over a snapshot bundle, as one plan per snapshot table."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.rules import environments, hypertables, indexes, security, tables
from plumbline.operators.rules.base import (
    DEFAULTS,
    FINDING_COLUMNS,
    Bundle,
    RowRule,
    RuleFunction,
    Settings,
    match,
    match_all,
)

FAMILIES = (tables.FAMILY, indexes.FAMILY, hypertables.FAMILY, security.FAMILY, environments.FAMILY)
#: Rule families that only apply where time-partitioned storage was seen.
PARTITIONED_FAMILIES = ("chunk", "cagg", "policy", "job", "timescale")
RELATIONAL_ENGINES = ("", "postgresql", "timescaledb")


def row_rules(settings: Settings = DEFAULTS, rule_id: str | None = None) -> list[RowRule]:
    """Row rules of all families, or those of one id."""
    return [rule for family in FAMILIES for rule in family.row_rules(settings, rule_id)]


def function_rules() -> Mapping[str, RuleFunction]:
    return {rule_id: function for family in FAMILIES for rule_id, function in family.functions.items()}


def _union(parts: Iterable[DataFrame]) -> DataFrame | None:
    union = None
    for part in parts:
        union = part if union is None else union.unionByName(part)
    return union


def run_rule(bundle: Bundle, rule_id: str, settings: Settings = DEFAULTS) -> DataFrame:
    """Findings of one rule."""
    parts = [match(bundle[r.source], r) for r in row_rules(settings, rule_id)]
    function = function_rules().get(rule_id)
    if function is not None:
        parts.append(function(bundle, settings))
    if not parts:
        raise KeyError(rule_id)
    return _union(parts)


def analyze(bundle: Bundle, settings: Settings = DEFAULTS) -> DataFrame:
    """Findings of all rules whose inputs the bundle holds.

    Row rules that read the same snapshot table share its scan.
    """
    by_source: dict[str, list[RowRule]] = {}
    for rule in row_rules(settings):
        if rule.source in bundle:
            by_source.setdefault(rule.source, []).append(rule)
    parts = [match_all(bundle[source], rules) for source, rules in by_source.items()]
    for family in FAMILIES:
        for rule_id, function in family.functions.items():
            if all(name in bundle for name in family.inputs[rule_id]):
                parts.append(function(bundle, settings))
    return _union(parts).select(*FINDING_COLUMNS)


def applicable(findings: DataFrame, environments_table: DataFrame) -> DataFrame:
    """Findings that apply to the engine of their environment.

    ``environments_table`` has environment_id, engine and partitioned_storage.
    """
    family = F.substring_index("rule_id", ".", 1)
    fits = F.coalesce("engine", F.lit("")).isin(*RELATIONAL_ENGINES) & (
        ~family.isin(*PARTITIONED_FAMILIES) | F.col("partitioned_storage")
    )
    known = environments_table.select("environment_id", "engine", "partitioned_storage")
    return findings.join(known, "environment_id").where(fits).drop("engine", "partitioned_storage")
