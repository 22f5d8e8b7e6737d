"""The log as a stream: three arrivals of files, some lines late, each read by a query that goes on from its checkpoint."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, scratch
from checks.logs import EVENT_SQL, LOGIN_SQL, T
from plumbline.plans import derive
from plumbline.sources.logs import level_bucket
from plumbline.streaming import logs as stream
from plumbline.streaming import tables

REGISTRY = Registry()
ARRIVALS = (1, 2, 3)
LATENESS = "1 day"
ONCE = {"availableNow": True}


def arriving(spark, folder):
    """Events with the number of the arrival that brings them: by time, but some of the first come with the second or third."""
    rows = derive.view(spark, folder, "f_log_event").withColumn("s", F.expr("unix_seconds(CAST(ts AS TIMESTAMP))"))
    low, high = rows.agg(F.min("s"), F.max("s")).first()
    third = ((high or 0) - (low or 0)) // 3
    early = F.col("s") < F.lit((low or 0) + third)
    arrival = (
        F.when(early & (F.col("event_id") % 17 == 0), 3)
        .when(early & (F.col("event_id") % 13 == 0), 2)
        .when(early, 1)
        .when(F.col("s") < F.lit((low or 0) + 2 * third), 2)
        .otherwise(3)
    )
    level = level_bucket(F.col("error_severity")).alias("level")
    return rows.select("source", F.col("ts").cast("timestamp").alias("ts"), level, "message", "role_name", arrival.alias("arrival"))


def play(spark, folder, start):
    """Add the files of each arrival, then let the query read what is new and end; the next one goes on from its checkpoint."""
    path = scratch(spark, "arrivals")
    rows = arriving(spark, folder)
    for k in ARRIVALS:
        rows.where(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(path)
        query = start(spark.readStream.schema(rows.drop("arrival").schema).parquet(path))
        query.awaitTermination()
    return query


def plain(rows, column):
    """A stream's times as the plain times that the events have."""
    return rows.withColumn(column, F.col(column).cast("timestamp_ntz"))


COUNT_SCHEMA = "source string, window_start timestamp, template_id string, template string, level string, events long"
ANOMALY_SCHEMA = (
    "source string, kind string, severity string, confidence string, template_id string, template string, level string,"
    " window_start timestamp, observed long, expected double, factor double, z_score double"
)

ARRIVED = EVENT_SQL + """, bounds AS (SELECT CAST(floor(epoch(min(ts))) AS BIGINT) AS low, (CAST(floor(epoch(max(ts))) AS BIGINT) - CAST(floor(epoch(min(ts))) AS BIGINT)) // 3 AS third FROM ev),
 arr AS (SELECT ev.*, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT)) AS window_start, CASE WHEN floor(epoch(ts)) < low + third THEN CASE WHEN event_id % 17 = 0 THEN 3 WHEN event_id % 13 = 0 THEN 2 ELSE 1 END WHEN floor(epoch(ts)) < low + 2 * third THEN 2 ELSE 3 END AS arrival FROM ev, bounds),
 marks AS (SELECT k, (SELECT max(ts) FROM arr WHERE arrival <= k) - INTERVAL 1 DAY AS mark FROM (VALUES (0), (1), (2), (3)) v(k)),
 fate AS (SELECT arr.*, coalesce(window_start + INTERVAL 12 HOUR <= p.mark, false) AS late, window_start + INTERVAL 12 HOUR <= e.mark AS closed FROM arr JOIN marks p ON p.k = arrival - 1 JOIN marks e ON e.k = 3),
 shut AS (SELECT source, window_start, substr(sha256(template), 1, 16) AS template_id, template, level, count(*) AS events FROM fate WHERE closed AND NOT late GROUP BY ALL)"""


@REGISTRY.add(
    "str1_stream_window_counts",
    ARRIVED + " SELECT shut.*, late_rows FROM shut JOIN (SELECT source, count(*) FILTER (WHERE late) AS late_rows FROM fate GROUP BY source) USING (source)",
)
def window_counts(spark, folder):
    """Closed windows, and how many lines of each source came after their windows had closed."""
    out, checkpoint = scratch(spark, "windows"), scratch(spark, "checkpoint")
    tables.create(spark, out, COUNT_SCHEMA)
    append = lambda rows, batch: tables.replace_batch(rows, out, batch)
    counted = lambda events: stream.stream_window_counts(events, T.window, LATENESS)
    query = play(spark, folder, lambda events: stream.start_count_stream(counted(events), append, checkpoint, ONCE))
    closed = tables.read_batches(spark, out)
    mark = F.lit(query.lastProgress["eventTime"]["watermark"]).cast("timestamp")
    arrived = arriving(spark, folder).select("source", (F.window("ts", T.window)["end"] <= mark).alias("closed"))
    seen = arrived.where("closed").groupBy("source").agg(F.count("*").alias("due"))
    kept = closed.groupBy("source").agg(F.sum("events").alias("kept"))
    late = seen.join(kept, "source", "left").select("source", (F.col("due") - F.coalesce("kept", F.lit(0))).alias("late_rows"))
    return plain(closed.join(late, "source"), "window_start")


JUDGED = ARRIVED + """, wins AS (SELECT source, window_start, row_number() OVER (PARTITION BY source ORDER BY window_start) AS w FROM (SELECT DISTINCT source, window_start FROM shut)),
 mem AS (SELECT j.source, j.w AS j, b.window_start, j.window_start AS aw, b.w = j.w AS own, j.w - b.w AS back, least(j.w - 1, 12) AS windows FROM wins j JOIN wins b ON b.source = j.source AND b.w BETWEEN j.w - 12 AND j.w),
 c AS (SELECT shut.*, j, aw, own, back, windows FROM shut JOIN mem USING (source, window_start)),
 cells AS (SELECT source, j, windows, window_start, k.kind, CASE k.kind WHEN 'template' THEN template_id ELSE level END AS name, sum(events)::DOUBLE AS n FROM c CROSS JOIN (VALUES ('template'), ('level')) k(kind) WHERE NOT own GROUP BY ALL),
 stats AS (SELECT source, j, kind, name, sum(n) / windows AS mean, sqrt(greatest(sum(n * n) / windows - (sum(n) / windows) * (sum(n) / windows), 0)) AS deviation, count(*) AS windows_with, windows FROM cells GROUP BY source, j, kind, name, windows),
 lv AS (SELECT source, j, template_id, level AS tl FROM (SELECT source, j, template_id, level, sum(events) AS n FROM c GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY source, j, template_id ORDER BY n DESC, CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) = 1),
 obs AS (SELECT source, j, aw, windows, template_id, min(template) AS template, sum(events)::BIGINT AS observed FROM c WHERE own GROUP BY ALL),
 seen AS (SELECT o.*, mean, tl, CASE WHEN mean < 1e-9 THEN observed ELSE observed / mean END AS f,
   CASE WHEN deviation > 1e-9 THEN (observed - mean) / deviation WHEN observed = mean THEN 0 WHEN mean = 0 THEN observed ELSE (observed - mean) / greatest(mean * 0.1, 1) END AS z
   FROM obs o JOIN lv USING (source, j, template_id) LEFT JOIN stats s ON s.source = o.source AND s.j = o.j AND s.kind = 'template' AND s.name = o.template_id),
 tpl AS (SELECT *, CASE WHEN mean IS NULL AND observed >= 2 THEN 'new_template' WHEN windows >= 6 AND f >= 1.4 AND observed >= 12 THEN 'strong_spike' WHEN windows >= 6 AND z >= 1 AND observed >= 5 THEN 'spike' END AS kind FROM seen),
 err AS (SELECT c.source, c.j, c.aw, sum(events)::BIGINT AS observed, coalesce(min(mean), 0) AS mean FROM c LEFT JOIN stats s ON s.source = c.source AND s.j = c.j AND s.kind = 'level' AND s.name = 'error' WHERE own AND level = 'error' AND c.windows >= 6 GROUP BY ALL),
 lack AS (SELECT s.*, (SELECT min(template) FROM c WHERE c.source = s.source AND c.j = s.j AND c.template_id = s.name) AS template, (SELECT min(window_start) FROM mem WHERE mem.source = s.source AND mem.j = s.j AND back <= 2) AS since
   FROM stats s WHERE kind = 'template' AND windows >= 6 AND windows_with / windows >= 0.5 AND NOT EXISTS (SELECT 1 FROM c WHERE c.source = s.source AND c.j = s.j AND c.template_id = s.name AND back <= 2))
 SELECT source, kind, CASE WHEN kind = 'strong_spike' THEN CASE WHEN tl = 'error' THEN 'high' ELSE 'medium' END WHEN tl = 'error' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN kind <> 'new_template' THEN 'high' WHEN windows < 6 THEN 'low' ELSE 'medium' END AS confidence,
   template_id, template, tl AS level, aw AS window_start, observed, CASE WHEN kind <> 'new_template' THEN round(mean * 100) / 100 ELSE 0 END AS expected, CASE WHEN kind <> 'new_template' THEN round(f * 100) / 100 END AS factor, CASE WHEN kind <> 'new_template' THEN round(z * 100) / 100 END AS z_score FROM tpl WHERE kind IS NOT NULL
 UNION ALL SELECT source, 'error_spike', 'high', 'high', '', '', 'error', aw, observed, round(mean * 100) / 100, round((CASE WHEN mean < 1e-9 THEN observed ELSE observed / mean END) * 100) / 100, NULL FROM err WHERE CASE WHEN mean < 1e-9 THEN observed ELSE observed / mean END >= 0.5
 UNION ALL SELECT source, 'missing_template', 'info', 'medium', name, template, '', since, 0, round(mean * 100) / 100, NULL, NULL FROM lack"""


@REGISTRY.add("str2_stream_anomalies", JUDGED)
def anomalies(spark, folder):
    """Every closed window judged against the twelve before it, whichever batch closed them."""
    counts, found, checkpoint = (scratch(spark, name) for name in ("windows", "anomalies", "checkpoint"))
    tables.create(spark, counts, COUNT_SCHEMA)
    tables.create(spark, found, ANOMALY_SCHEMA)

    def start(events):
        return stream.start_anomaly_stream(
            stream.stream_window_counts(events, T.window, LATENESS),
            lambda: tables.read_batches(spark, counts),
            lambda rows, batch: tables.replace_batch(rows, counts, batch),
            lambda rows, batch: tables.replace_batch(rows, found, batch),
            checkpoint,
            T,
            ONCE,
        )

    play(spark, folder, start)
    return plain(tables.read_batches(spark, found), "window_start")


@REGISTRY.add("str3_stream_last_login", LOGIN_SQL + " SELECT role, last_login_at FROM login")
def last_login(spark, folder):
    """The stored logins after all arrivals: late lines count as well."""
    stored, checkpoint = scratch(spark, "logins"), scratch(spark, "checkpoint")
    tables.create(spark, stored, "role string, last_login_at timestamp")

    def start(events):
        return stream.start_last_login_stream(
            events, lambda: tables.read_newest(spark, stored), lambda rows, batch: tables.replace_batch(rows, stored, batch), checkpoint, ONCE
        )

    play(spark, folder, start)
    return plain(tables.read_newest(spark, stored), "last_login_at")
