"""Digest of two workload windows: what got slower, faster, new or went away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from plumbline.operators.workload import (
    DigestThresholds,
    compare_windows,
    counter_deltas,
    digest_max_gap,
    resolve_windows,
    window_activity,
)
from plumbline.sources.staging import cut_lineage


def compare_periods(
    points: DataFrame,
    workload: DataFrame,
    prior: Column | str,
    current: Column | str,
    window_days: float,
    by: Sequence[str] = ("environment_id",),
    thresholds: DigestThresholds = DigestThresholds(),
) -> DataFrame:
    """Statements of two periods with their class.

    ``prior`` and ``current`` select the collection points of each period.  The
    activity of a period is staged, because the comparison reads it twice.
    """

    def activity(period: Column | str) -> DataFrame:
        windows = cut_lineage(resolve_windows(points.where(period), by, digest_max_gap(window_days)))
        return cut_lineage(window_activity(counter_deltas(workload, windows, by), by))

    return compare_windows(activity(prior), activity(current), by, thresholds)
