"""Log analysis from events to anomalies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from plumbline.operators.logs import (
    Thresholds,
    anomaly_summary,
    cap_templates,
    detect_anomalies,
    split_windows,
    template_events,
    window_counts,
)
from plumbline.sources.staging import cut_lineage


@dataclass(frozen=True)
class LogAnalysis:
    counts: DataFrame
    roles: DataFrame
    anomalies: DataFrame
    summary: DataFrame


def analyze_events(
    events: DataFrame,
    line_stats: DataFrame | None = None,
    thresholds: Thresholds = Thresholds(),
    since: str | None = None,
    until: str | None = None,
    max_templates: int | None = None,
    fail_on: str = "high",
) -> LogAnalysis:
    """Window counts, anomalies and summary of log events (source, ts, level, message).

    The masked events are read once; everything else works on the window counts,
    which are staged because five steps read them.  ``line_stats`` is the result
    of ``read_stats`` by source.
    """
    templates = template_events(events)
    if max_templates:
        templates = cap_templates(templates, max_templates)
    counts = cut_lineage(window_counts(templates, thresholds.window))
    roles = split_windows(counts, thresholds.baseline_windows, since, until)
    anomalies = detect_anomalies(counts, roles, thresholds)
    short = F.count_if(F.col("role") == "baseline") < thresholds.min_baseline_windows
    sources = roles.groupBy("source").agg(short.alias("insufficient"))
    if line_stats is None:
        sources = sources.withColumn("invalid_ratio", F.lit(0.0))
    else:
        sources = sources.join(line_stats.select("source", "invalid_ratio"), "source", "left").na.fill(0.0, ["invalid_ratio"])
    return LogAnalysis(counts, roles, anomalies, anomaly_summary(anomalies, sources, fail_on, thresholds))
