"""Log templates, window counts and anomalies.

Row-level work ends at ``window_counts``: one partially aggregated shuffle by
window and template.  Everything after it works on counts per log source.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from plumbline.functions.keys import severity_rank
from plumbline.functions.text import has_fixed_token, mask_message, once, template_id, template_pattern

OTHERS = "others"
OTHERS_PATTERN = "outros"
#: Order in which equal level counts are decided.
LEVELS = ("error", "warning", "info")


@dataclass(frozen=True)
class Thresholds:
    """The usual limits of the anomaly rules."""

    window: str = "5 minutes"
    baseline_windows: int = 12
    min_baseline_windows: int = 6
    spike_z: float = 3.0
    spike_min_count: int = 20
    strong_factor: float = 8.0
    strong_min_count: int = 50
    new_min_count: int = 10
    error_spike_factor: float = 5.0
    missing_base_share: float = 0.5
    missing_absent_windows: int = 3
    invalid_line_ratio: float = 0.10


def template_events(events: DataFrame) -> DataFrame:
    """Events with template_id and template in place of the message.

    Messages without any fixed word are dropped; they count nowhere.  A message is masked once, not again for each test of it.
    """
    masked = events.withColumn("masked", once(mask_message(F.col("message"))))
    kept = masked.where((F.col("masked") != "") & has_fixed_token(F.col("masked")))
    return (
        kept.withColumn("template", template_pattern(F.col("masked")))
        .withColumn("template_id", template_id(F.col("template")))
        .drop("masked", "message")
    )


def cap_templates(events: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` templates of each source by arrival; later ones count as ``others``.

    The events themselves are all kept.
    """
    first = events.groupBy("source", "template_id").agg(F.min("ts").alias("first_ts"))
    order = W.partitionBy("source").orderBy("first_ts", "template_id")
    kept = (
        first.withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= limit)
        .select("source", "template_id", F.lit(True).alias("kept"))
    )
    known = F.col("kept").isNotNull()
    marked = events.join(kept, ["source", "template_id"], "left")
    return (
        marked.withColumn("template", F.when(known, F.col("template")).otherwise(OTHERS_PATTERN))
        .withColumn("template_id", F.when(known, F.col("template_id")).otherwise(OTHERS))
        .drop("kept")
    )


def window_counts(events: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Events per source, window, template and level; windows are aligned to the epoch."""
    return (
        events.groupBy("source", F.window("ts", window).alias("w"), "template_id", "level")
        .agg(F.count(F.lit(1)).alias("events"), F.min("template").alias("template"))
        .select("source", F.col("w.start").alias("window_start"), "template_id", "template", "level", "events")
    )


def split_windows(counts: DataFrame, k: int = 12, since: str | None = None, until: str | None = None) -> DataFrame:
    """Role of each observed window: ``baseline`` or ``analysis`` (source, window_start, role).

    By default the last window of a source is analysed against up to ``k``
    windows before it.  With a period, the windows in [since, until) are the
    baseline and those from ``until`` on are analysed.
    """
    windows = counts.select("source", "window_start").distinct()
    if since is not None or until is not None:
        start = F.col("window_start").cast("timestamp")
        late = F.lit(False) if until is None else start >= F.lit(until).cast("timestamp")
        early = F.lit(False) if since is None else start < F.lit(since).cast("timestamp")
        base_end = F.max(F.when(~late & ~early, start)).over(W.partitionBy("source"))
        anything_late = F.max(late.cast("int")).over(W.partitionBy("source")) == 1
        role = (
            F.when(late, "analysis")
            .when(~early, "baseline")
            .when(~anything_late & (start > base_end), "analysis")
        )
        return windows.withColumn("role", role).where(F.col("role").isNotNull())
    newest = W.partitionBy("source").orderBy(F.desc("window_start"))
    return (
        windows.withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= k + 1)
        .select("source", "window_start", F.when(F.col("place") == 1, "analysis").otherwise("baseline").alias("role"))
    )


def _spread(total: Column, squares: Column, n: Column) -> tuple[Column, Column]:
    mean = total / n
    return mean, F.sqrt(F.greatest(squares / n - mean * mean, F.lit(0.0)))


def baseline_stats(counts: DataFrame, roles: DataFrame, minimum: int = 6) -> DataFrame:
    """Mean and population deviation of the counts per template (kind ``template``) and level (kind ``level``).

    A window without the template counts as zero.
    """
    base = roles.where(F.col("role") == "baseline")
    sizes = base.groupBy("source").agg(F.count(F.lit(1)).alias("windows"))
    rows = counts.join(base, ["source", "window_start"])

    def stats(kind: str, key: str) -> DataFrame:
        per_window = rows.groupBy("source", "window_start", F.col(key).alias("name")).agg(F.sum("events").alias("c"))
        c = F.col("c").cast("double")
        grouped = per_window.groupBy("source", "name").agg(
            F.sum(c).alias("total"), F.sum(c * c).alias("squares"), F.count(F.lit(1)).alias("windows_with")
        )
        mean, deviation = _spread(F.col("total"), F.col("squares"), F.col("windows"))
        return grouped.join(sizes, "source").select(
            "source",
            F.lit(kind).alias("kind"),
            "name",
            mean.alias("mean"),
            deviation.alias("deviation"),
            "windows_with",
            "windows",
            (F.col("windows") < minimum).alias("insufficient"),
        )

    return stats("template", "template_id").unionByName(stats("level", "level"))


def z_score(count: Column, mean: Column, deviation: Column) -> Column:
    count = count.cast("double")
    return (
        F.when(deviation > 1e-9, (count - mean) / deviation)
        .when(count == mean, F.lit(0.0))
        .when(mean == 0, count)
        .otherwise((count - mean) / F.greatest(mean * 0.1, F.lit(1.0)))
    )


def factor(count: Column, mean: Column) -> Column:
    count = count.cast("double")
    return F.when(mean < 1e-9, count).otherwise(count / mean)


def round2(value: Column) -> Column:
    return F.round(value * 100) / 100


def template_levels(counts: DataFrame) -> DataFrame:
    """Most frequent level of each template over all windows; ties go to the graver level."""
    per_level = counts.where(F.col("template_id") != OTHERS).groupBy("source", "template_id", "level").agg(
        F.sum("events").alias("n")
    )
    rank = F.when(F.col("level") == "error", 2).when(F.col("level") == "warning", 1).otherwise(0)
    return per_level.groupBy("source", "template_id").agg(F.max_by("level", F.struct("n", rank)).alias("template_level"))


def _observed(counts: DataFrame, roles: DataFrame) -> DataFrame:
    """Counts per template of the analysed windows with the template's usual level and baseline."""
    analysed = roles.where(F.col("role") == "analysis").select("source", "window_start")
    return (
        counts.join(analysed, ["source", "window_start"])
        .groupBy("source", "window_start", "template_id")
        .agg(F.sum("events").alias("observed"), F.min("template").alias("template"))
        .join(template_levels(counts), ["source", "template_id"], "left")
    )


def _insufficient(roles: DataFrame, minimum: int) -> DataFrame:
    return roles.groupBy("source").agg(
        (F.count_if(F.col("role") == "baseline") < minimum).alias("insufficient"),
    )


def _anomaly(kind: Column | str, severity: Column, confidence: Column | str, expected: Column, fac: Column, z: Column) -> list[Column]:
    def column(value):
        return F.lit(value) if isinstance(value, str) else value

    return [
        F.col("source"),
        column(kind).alias("kind"),
        severity.alias("severity"),
        column(confidence).alias("confidence"),
        F.col("template_id"),
        F.col("template"),
        F.col("level"),
        F.col("window_start"),
        F.col("observed"),
        expected.cast("double").alias("expected"),
        fac.cast("double").alias("factor"),
        z.cast("double").alias("z_score"),
    ]


def detect_templates(counts: DataFrame, roles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """New templates, spikes and strong spikes of the analysed windows."""
    stats = baseline_stats(counts, roles, t.min_baseline_windows).where(F.col("kind") == "template")
    seen = (
        _observed(counts, roles)
        .join(_insufficient(roles, t.min_baseline_windows), "source")
        .join(stats.select("source", F.col("name").alias("template_id"), "mean", "deviation"), ["source", "template_id"], "left")
        .withColumn("level", F.coalesce("template_level", F.lit("")))
    )
    count, mean = F.col("observed"), F.col("mean")
    error = F.col("level") == "error"
    new = mean.isNull() & (count >= t.new_min_count)
    fac, z = factor(count, mean), z_score(count, mean, F.col("deviation"))
    judged = mean.isNotNull() & ~F.col("insufficient")
    strong = judged & (fac >= t.strong_factor) & (count >= t.strong_min_count)
    spike = judged & (z >= t.spike_z) & (count >= t.spike_min_count)
    kind = F.when(new, "new_template").when(strong, "strong_spike").when(spike, "spike")
    severity = (
        F.when(F.col("kind") == "strong_spike", F.when(error, "high").otherwise("medium")).otherwise(
            F.when(error, "medium").otherwise("low")
        )
    )
    confidence = F.when(F.col("kind") != "new_template", "high").when(F.col("insufficient"), "low").otherwise("medium")
    known = F.col("kind") != "new_template"
    return seen.withColumn("kind", kind).where(F.col("kind").isNotNull()).select(
        *_anomaly(
            F.col("kind"),
            severity,
            confidence,
            F.when(known, round2(mean)).otherwise(0.0),
            F.when(known, round2(fac)),
            F.when(known, round2(z)),
        )
    )


def detect_error_spike(counts: DataFrame, roles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Analysed windows whose error volume is a multiple of the baseline."""
    stats = baseline_stats(counts, roles, t.min_baseline_windows).where(
        (F.col("kind") == "level") & (F.col("name") == "error")
    )
    analysed = roles.where(F.col("role") == "analysis").select("source", "window_start")
    errors = (
        counts.where(F.col("level") == "error")
        .join(analysed, ["source", "window_start"])
        .groupBy("source", "window_start")
        .agg(F.sum("events").alias("observed"))
    )
    mean = F.coalesce("mean", F.lit(0.0))
    fac = factor(F.col("observed"), mean)
    found = (
        errors.join(_insufficient(roles, t.min_baseline_windows).where(~F.col("insufficient")), "source")
        .join(stats.select("source", "mean"), "source", "left")
        .where(fac >= t.error_spike_factor)
        .withColumn("template_id", F.lit(""))
        .withColumn("template", F.lit(""))
        .withColumn("level", F.lit("error"))
    )
    return found.select(*_anomaly("error_spike", F.lit("high"), "high", round2(mean), round2(fac), F.lit(None)))


def detect_missing(counts: DataFrame, roles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Templates of half the baseline windows that the last three observed windows lack."""
    newest = W.partitionBy("source").orderBy(F.desc("window_start"))
    last = (
        counts.select("source", "window_start")
        .distinct()
        .withColumn("place", F.row_number().over(newest))
        .where(F.col("place") <= t.missing_absent_windows)
    )
    enough = last.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("window_start").alias("window_start"))
    enough = enough.where(F.col("n") == t.missing_absent_windows).drop("n")
    recent = counts.join(last.select("source", "window_start"), ["source", "window_start"]).select("source", "template_id")
    stats = baseline_stats(counts, roles, t.min_baseline_windows).where(
        (F.col("kind") == "template")
        & ~F.col("insufficient")
        & (F.col("windows_with") / F.col("windows") >= t.missing_base_share)
    )
    patterns = counts.groupBy("source", "template_id").agg(F.min("template").alias("template"))
    gone = (
        stats.withColumnRenamed("name", "template_id")
        .join(recent, ["source", "template_id"], "left_anti")
        .join(enough, "source")
        .join(patterns, ["source", "template_id"])
        .withColumn("observed", F.lit(0).cast("bigint"))
        .withColumn("level", F.lit(""))
    )
    none = F.lit(None)
    return gone.select(*_anomaly("missing_template", F.lit("info"), "medium", round2(F.col("mean")), none, none))


def detect_anomalies(counts: DataFrame, roles: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    return (
        detect_templates(counts, roles, t)
        .unionByName(detect_error_spike(counts, roles, t))
        .unionByName(detect_missing(counts, roles, t))
    )


def anomaly_order() -> list[Column]:
    return [F.desc(severity_rank(F.col("severity"))), F.asc("window_start"), F.asc("kind"), F.asc("template_id")]


def anomaly_summary(
    anomalies: DataFrame, sources: DataFrame, fail_on: str = "high", t: Thresholds = Thresholds()
) -> DataFrame:
    """Anomalies per severity, the highest one and the exit code of every source.

    ``sources`` has source, invalid_ratio and insufficient.  The code is 3 when
    too many lines were invalid or the baseline is too short, 1 when an anomaly
    reaches ``fail_on``, else 0.
    """
    severity = F.col("severity")
    counted = anomalies.groupBy("source").agg(
        *[F.count_if(severity == s).alias(s) for s in ("info", "low", "medium", "high", "critical")],
        F.count(F.lit(1)).alias("total"),
        F.max_by("severity", severity_rank(severity)).alias("highest"),
        F.max(severity_rank(severity)).alias("top"),
    )
    joined = sources.join(counted, "source", "left")
    code = (
        F.when((F.col("invalid_ratio") > t.invalid_line_ratio) | F.col("insufficient"), 3)
        .when(F.coalesce(F.col("top") >= severity_rank(F.lit(fail_on)), F.lit(False)), 1)
        .otherwise(0)
    )
    zero = F.lit(0).cast("bigint")
    return joined.select(
        "source",
        *[F.coalesce(s, zero).alias(s) for s in ("info", "low", "medium", "high", "critical", "total")],
        F.coalesce("highest", F.lit("info")).alias("highest"),
        code.alias("exit_code"),
    )


def connection_roles(events: DataFrame) -> DataFrame:
    """Role and time of every authorised connection, nothing else of the line."""
    message = F.col("message")
    written = F.regexp_extract(message, r"(?i)user=([^ ,\t]*)", 1)
    role = F.trim(F.regexp_replace(F.coalesce(F.nullif(F.trim("role_name"), F.lit("")), written), r"^\t+|\t+$", ""))
    return (
        events.where(F.lower(message).contains("connection authorized"))
        .select(role.alias("role"), "ts")
        .where((F.col("role") != "") & F.col("ts").isNotNull())
    )


def last_login(events: DataFrame) -> DataFrame:
    """Latest authorised connection of every role."""
    return connection_roles(events).groupBy("role").agg(F.max("ts").alias("last_login_at"))


def merge_last_login(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Stored and fresh logins merged; the later one stays."""
    both = stored.select("role", "last_login_at").unionByName(fresh.select("role", "last_login_at"))
    return both.groupBy("role").agg(F.max("last_login_at").alias("last_login_at"))
