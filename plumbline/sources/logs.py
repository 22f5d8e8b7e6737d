"""Log lines in JSON: reading, field profiles, time and level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plumbline.functions.text import once

_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})"
_CLOCK = r"([0-9]{2}:[0-9]{2}:[0-9]{2}(?:[.,][0-9]+)?)"
_ISO = rf"^{_DATE}T{_CLOCK}(Z|[+-][0-9]{{2}}:[0-9]{{2}})$"
_SPACED = rf"^{_DATE} {_CLOCK}(?: ([^ ]+))?$"
_OFFSET = r"^([+-][0-9]{2})([0-9]{2})?$"

#: Severities and their bucket.
ERROR_LEVELS = ("ERROR", "FATAL", "PANIC", "CRITICAL", "ALERT", "EMERG", "EMERGENCY")
WARNING_LEVELS = ("WARNING", "WARN")
INFO_LEVELS = ("LOG", "INFO", "NOTICE", "DEBUG", "DEBUG1", "DEBUG2", "DEBUG3", "DEBUG4", "DEBUG5", "TRACE")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of log files (.json, .jsonl, .log, .txt) as a ``value`` column."""
    return spark.read.option("pathGlobFilter", "*.{json,jsonl,log,txt}").text(path)


def stream_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same lines as an unbounded stream of arriving files."""
    return spark.readStream.option("pathGlobFilter", "*.{json,jsonl,log,txt}").text(path)


def parse_time_any(text: Column) -> Column:
    """UTC time of the usual log layouts, NULL when it is none of them.

    A zone name or any other last word that is no offset counts as UTC.
    """
    text = F.trim(text)
    iso = text.rlike(_ISO)

    def part(group: int) -> Column:
        return F.when(iso, F.regexp_extract(text, _ISO, group)).otherwise(F.regexp_extract(text, _SPACED, group))

    zone = part(3)
    offset = (
        F.when(iso, F.replace(zone, F.lit("Z"), F.lit("+00:00")))
        .when(
            zone.rlike(_OFFSET),
            F.concat(
                F.regexp_extract(zone, _OFFSET, 1),
                F.lit(":"),
                F.coalesce(F.nullif(F.regexp_extract(zone, _OFFSET, 2), F.lit("")), F.lit("00")),
            ),
        )
        .otherwise("+00:00")
    )
    stamp = F.concat(part(1), F.lit("T"), F.replace(part(2), F.lit(","), F.lit(".")), offset)
    return F.when(iso | text.rlike(_SPACED), stamp.try_cast("timestamp"))


def level_bucket(severity: Column) -> Column:
    """error, warning or info."""
    name = F.upper(F.trim(F.coalesce(severity, F.lit(""))))
    return (
        F.when(name.isin(*ERROR_LEVELS), "error")
        .when(name.isin(*WARNING_LEVELS), "warning")
        .when(name.isin(*INFO_LEVELS), "info")
        .when(name.contains("ERR") | name.contains("FATAL") | name.contains("PANIC"), "error")
        .when(name.contains("WARN"), "warning")
        .otherwise("info")
    )


def parse_lines(
    lines: DataFrame, time_field: str = "timestamp", level_field: str = "error_severity", message_field: str = "message", role_field: str | None = "user",
    max_bytes: int | None = None,
) -> DataFrame:
    """One row per line: status, ts, level, message and role_name.

    A line is trimmed, read as JSON and its time parsed once each, also where the status is filtered.

    ``status`` is blank, invalid (no JSON object, or no readable time), parsed
    or, with ``max_bytes``, oversized.  The default fields are those of the PostgreSQL JSON log.
    """
    kept = [c for c in lines.columns if c != "value"]
    text = F.col("_text")
    oversized = F.octet_length("value") > max_bytes if max_bytes else F.lit(False)
    trimmed = F.trim(F.regexp_replace("value", r"^[ \t\r]+|[ \t\r]+$", ""))
    raw = lines.select(*kept, oversized.alias("oversized"), once(trimmed).alias("_text"))
    fields = F.from_json(text, "map<string,string>")
    read = raw.withColumn("fields", once(F.when(~F.col("oversized") & (text != ""), fields)))
    stamp = read.withColumn("_time", once(F.trim(F.col("fields")[time_field])))
    shaped = stamp.withColumn("ts", once(parse_time_any(F.col("_time"))))
    role = F.trim(F.col("fields")[role_field]) if role_field else F.lit("")
    status = (
        F.when(F.col("oversized"), "oversized")
        .when(text == "", "blank")
        .when(F.col("fields").isNull() | F.col("ts").isNull(), "invalid")
        .otherwise("parsed")
    )
    return shaped.select(
        *kept,
        status.alias("status"),
        "ts",
        level_bucket(F.col("fields")[level_field]).alias("level"),
        F.coalesce(F.col("fields")[message_field], F.lit("")).alias("message"),
        F.coalesce(role, F.lit("")).alias("role_name"),
    )


def parse_generic(lines: DataFrame, time_field: str, message_field: str, level_field: str = "level") -> DataFrame:
    """Lines with user-named fields; they carry no role."""
    return parse_lines(lines, time_field, level_field, message_field, role_field=None)


def read_stats(parsed: DataFrame, *by: str) -> DataFrame:
    """Lines read, parsed, invalid and oversized, and the share that could not be used."""
    status = F.col("status")
    invalid, oversized = F.count_if(status == "invalid"), F.count_if(status == "oversized")
    total = F.count(F.lit(1))
    return parsed.groupBy(*by).agg(
        total.alias("lines_read"),
        F.count_if(status == "parsed").alias("lines_parsed"),
        invalid.alias("lines_invalid"),
        oversized.alias("lines_oversized"),
        ((invalid + oversized) / total).alias("invalid_ratio"),
    )


def log_events(parsed: DataFrame) -> DataFrame:
    """The usable lines."""
    return parsed.where(F.col("status") == "parsed").drop("status")
