"""Log windows, anomalies and last logins on Structured Streaming.

The stream shares its expressions with the batch operators.  A watermark closes
the windows and bounds the state; lines later than it are dropped and counted by
Spark's own state metrics.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery, StreamingQueryListener

from plumbline.operators.logs import (
    Thresholds,
    connection_roles,
    detect_anomalies,
    merge_last_login,
    template_events,
)
from plumbline.sources.staging import cut_lineage


def stream_window_counts(events: DataFrame, window: str = "5 minutes", lateness: str = "10 minutes") -> DataFrame:
    """Closed windows with their counts, in the shape of the batch ``window_counts``."""
    grouped = (
        template_events(events)
        .withWatermark("ts", lateness)
        .groupBy("source", F.window("ts", window).alias("w"), "template_id", "level")
        .agg(F.count(F.lit(1)).alias("events"), F.min("template").alias("template"))
    )
    return grouped.select(
        "source", F.col("w.start").alias("window_start"), "template_id", "template", "level", "events"
    )


def stream_last_login(events: DataFrame) -> DataFrame:
    """Latest login per role so far; run it in update mode."""
    return connection_roles(events).groupBy("role").agg(F.max("ts").alias("last_login_at"))


class LateRows(StreamingQueryListener):
    """Adds up the rows that the watermark dropped, over all batches of the queries it hears of.

    Register it with ``spark.streams.addListener`` before the query starts; it keeps one number, not the progress.
    """

    def __init__(self) -> None:
        self.total = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.total += sum(int(state.numRowsDroppedByWatermark) for state in event.progress.stateOperators)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def judge_windows(history: DataFrame, fresh: DataFrame, thresholds: Thresholds = Thresholds()) -> DataFrame:
    """Anomalies of every fresh window, each judged as the batch operator judges a newest window.

    Window counts of a source are numbered in time; a fresh window takes the
    ``baseline_windows`` before it, stored or fresh, under a name of its own, so
    all are judged in one pass.  Of the history only the last windows before the
    batch are read.  A window that is in both counts as fresh.
    """
    k = thresholds.baseline_windows
    new = fresh.select("source", "window_start").distinct()
    first = new.groupBy(F.col("source").alias("fresh_source")).agg(F.min("window_start").alias("first_start"))
    stored = history.join(first, F.col("source") == F.col("fresh_source"))
    stored = stored.where(F.col("window_start") < F.col("first_start")).select(*fresh.columns)
    newest = W.partitionBy("source").orderBy(F.desc("window_start"))
    kept = stored.select("source", "window_start").distinct().withColumn("place", F.row_number().over(newest)).where(F.col("place") <= k)
    windows = kept.select("source", "window_start", F.lit(False).alias("fresh")).unionByName(new.withColumn("fresh", F.lit(True)))
    numbered = windows.withColumn("number", F.row_number().over(W.partitionBy("source").orderBy("window_start")))
    name = F.concat_ws("\u001f", F.col("window_start").cast("string"), F.col("source"))
    sets = numbered.where("fresh").select(
        "source", name.alias("judged"), F.col("number").alias("own"), F.explode(F.sequence(F.greatest(F.lit(1), F.col("number") - k), F.col("number"))).alias("number")
    )
    role = F.when(F.col("number") == F.col("own"), "analysis").otherwise("baseline").alias("role")
    member = cut_lineage(sets.join(numbered.select("source", "number", "window_start"), ["source", "number"]).select("source", "window_start", "judged", role))
    renamed = [c for c in fresh.columns if c != "source"]
    counts = stored.unionByName(fresh).join(member.drop("role"), ["source", "window_start"]).select(F.col("judged").alias("source"), *renamed)
    roles = member.select(F.col("judged").alias("source"), "window_start", "role")
    found = detect_anomalies(counts, roles, thresholds)
    return found.withColumn("source", F.expr("substring(source, instr(source, '\u001f') + 1)"))


def start_count_stream(counts: DataFrame, append_counts: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Hand on the closed windows of each batch with the batch's id. ``trigger``: arguments of ``writeStream.trigger``."""
    writer = counts.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
    return _triggered(writer, trigger).foreachBatch(append_counts).start()


def _triggered(writer: DataStreamWriter, trigger: dict | None) -> DataStreamWriter:
    return writer.trigger(**trigger) if trigger else writer


def start_anomaly_stream(
    counts: DataFrame,
    read_history: Callable[[], DataFrame],
    append_counts: Callable[[DataFrame, int], None],
    write_anomalies: Callable[[DataFrame, int], None],
    checkpoint: str,
    thresholds: Thresholds = Thresholds(),
    trigger: dict | None = None,
) -> StreamingQuery:
    """Judge every closed window of a batch against the windows before it.

    The batch is staged, because it is read several times.

    ``append_counts`` and ``write_anomalies`` get the batch id, so a batch that
    is repeated after a lost executor can replace what it wrote before.
    """

    def judge(batch: DataFrame, batch_id: int) -> None:
        fresh = cut_lineage(batch)
        write_anomalies(judge_windows(read_history(), fresh, thresholds), batch_id)
        append_counts(fresh, batch_id)

    return start_count_stream(counts, judge, checkpoint, trigger)


def start_last_login_stream(
    events: DataFrame,
    read_stored: Callable[[], DataFrame],
    write_stored: Callable[[DataFrame, int], None],
    checkpoint: str,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Keep a stored table of last logins up to date."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        write_stored(merge_last_login(read_stored(), batch), batch_id)

    writer = stream_last_login(events).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return _triggered(writer, trigger).foreachBatch(merge).start()
