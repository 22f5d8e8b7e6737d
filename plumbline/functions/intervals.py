"""Interval text such as ``7 days`` as seconds, and JSON policy settings."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_TEXT = r"^([+-]?[0-9]+(?:\.[0-9]+)?)\s+([a-z]+)"
_CLOCK = r"^(?:([0-9]+(?:\.[0-9]+)?)h)?(?:([0-9]+(?:\.[0-9]+)?)m)?(?:([0-9]+(?:\.[0-9]+)?)s)?$"


def _number(text: Column) -> Column:
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def interval_seconds(value: Column) -> Column:
    """Seconds of ``<n> <unit>`` (sec, min, hour/hr, day) or of ``1h30m``; 0 if unreadable."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    amount = _number(F.regexp_extract(text, _TEXT, 1))
    unit = F.regexp_extract(text, _TEXT, 2)
    scale = (
        F.when(unit.startswith("min"), 60)
        .when(unit.startswith("hour") | unit.startswith("hr"), 3600)
        .when(unit.startswith("day"), 86400)
        .when(unit.startswith("sec"), 1)
        .otherwise(0)
    )
    clock = (
        _number(F.regexp_extract(text, _CLOCK, 1)) * 3600
        + _number(F.regexp_extract(text, _CLOCK, 2)) * 60
        + _number(F.regexp_extract(text, _CLOCK, 3))
    )
    return F.when(text.rlike(_TEXT), amount * scale).otherwise(clock)


def interval_days(value: Column) -> Column:
    """Whole days of an interval text; weeks are understood here only."""
    text = F.lower(F.trim(F.coalesce(value, F.lit(""))))
    weeks = _number(F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)\s+week", 1))
    days = F.when(text.rlike(r"^[0-9.]+\s+week"), weeks * 7).otherwise(
        interval_seconds(value) / 86400.0
    )
    return days.cast("int")


def policy_term(config: Column) -> Column:
    """``drop_after`` of a policy's JSON settings, else ``compress_after``, else empty."""
    return F.coalesce(
        F.get_json_object(config, "$.drop_after"),
        F.get_json_object(config, "$.compress_after"),
        F.lit(""),
    )
