"""Identity, severity and small numeric helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

#: Severities from the weakest to the strongest.
SEVERITIES = ("info", "low", "medium", "high", "critical")


def severity_rank(severity: Column) -> Column:
    """0 for info up to 4 for critical; anything unknown ranks as medium."""
    name = F.lower(F.trim(severity))
    rank = F.when(name == "info", 0)
    for position, value in enumerate(SEVERITIES[1:], start=1):
        rank = rank.when(name == value, position)
    return rank.otherwise(2)


def downgrade(severity: Column) -> Column:
    """One severity level down; info stays info."""
    return (
        F.when(severity == "critical", "high")
        .when(severity == "high", "medium")
        .when(severity == "medium", "low")
        .otherwise("info")
    )


def dedup_key(finding_type: Column, object_key: Column, title: Column) -> Column:
    """First 16 bytes of the SHA-256 of ``type|object|title`` as hex text."""
    return F.substring(F.sha2(F.concat_ws("|", finding_type, object_key, title), 256), 1, 32)


def dotted(*names: str | Column) -> Column:
    """``a.b.c`` from columns that are never NULL."""
    parts = [F.col(n) if isinstance(n, str) else n for n in names]
    pieces: list[Column] = [parts[0]]
    for part in parts[1:]:
        pieces += [F.lit("."), part]
    return F.concat(*pieces)


def key_for(*parts: Column) -> Column:
    """Comparison key: normalised parts joined with dots, empty parts left out."""
    return F.concat_ws(".", *[F.nullif(F.lower(F.trim(p)), F.lit("")) for p in parts])


def ratio(numerator: Column, denominator: Column, otherwise: float = 0.0) -> Column:
    """Double division that answers ``otherwise`` when the denominator is not positive."""
    return F.when(denominator > 0, numerator.cast("double") / denominator.cast("double")).otherwise(
        F.lit(otherwise)
    )


def changed(left: Column, right: Column) -> Column:
    """NULL-aware inequality, so NULL -> value counts as a change."""
    return ~left.eqNullSafe(right)


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours with microsecond precision."""
    return micros_between(start, end) / F.lit(3_600_000_000.0)


def micros_between(start: Column, end: Column) -> Column:
    return F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))
