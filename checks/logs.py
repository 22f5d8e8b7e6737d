"""Log reading, templates, windows and anomalies on the derived log."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.base import Registry, table, scratch
from plumbline.functions.text import has_fixed_token, mask_message, template_id, template_pattern
from plumbline.operators import logs
from plumbline.plans import derive
from plumbline.plans.logs import analyze_events
from plumbline.sources import logs as source
from plumbline.sources.staging import cut_lineage

REGISTRY = Registry()
T = logs.Thresholds(
    window="12 hours",
    spike_z=1.0,
    spike_min_count=5,
    strong_factor=1.4,
    strong_min_count=12,
    new_min_count=2,
    error_spike_factor=0.5,
)


def parsed(spark, folder):
    return source.parse_lines(derive.view(spark, folder, "f_log_line").select("source", "value"))


def events(spark, folder):
    return derive.view(spark, folder, "f_log_event").select(
        "source", "ts", source.level_bucket(F.col("error_severity")).alias("level"), "message", "role_name"
    )


def counts(spark, folder):
    return logs.window_counts(logs.template_events(events(spark, folder)), T.window)


def staged_counts(spark, folder):
    return cut_lineage(counts(spark, folder))


LINES_SQL = derive.ctes("f_log_line") + """, parsed AS (SELECT source, event_id, CASE WHEN trim(value) = '' THEN 'blank' WHEN event_id % 29 = 0 OR event_id % 23 = 0 THEN 'invalid' ELSE 'parsed' END AS status,
 CASE WHEN trim(value) <> '' AND event_id % 29 <> 0 AND event_id % 23 <> 0 THEN strptime(substr(value, 15, 19), '%Y-%m-%d %H:%M:%S') + CASE event_id % 3 WHEN 0 THEN INTERVAL 250 MILLISECOND WHEN 1 THEN INTERVAL 3 HOUR ELSE INTERVAL 0 HOUR END END AS ts,
 CASE WHEN trim(value) = '' OR event_id % 29 = 0 THEN '{}' ELSE value END AS j FROM f_log_line)"""
LEVEL_SQL = "CASE coalesce(j->>'error_severity', '') WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END"


@REGISTRY.add(
    "src2_read_log_jsonl",
    LINES_SQL + """ SELECT source, count(*) AS lines_read, count(*) FILTER (WHERE status = 'parsed') AS lines_parsed, count(*) FILTER (WHERE status = 'invalid') AS lines_invalid,
 CAST(0 AS BIGINT) AS lines_oversized, count(*) FILTER (WHERE status = 'invalid') / count(*) AS invalid_ratio FROM parsed GROUP BY source""",
)
def line_stats(spark, folder):
    return source.read_stats(parsed(spark, folder), "source")


@REGISTRY.add(
    "src2_read_log_files",
    LINES_SQL + """ SELECT count(*) AS lines_read, count(*) FILTER (WHERE status = 'parsed') AS lines_parsed, count(*) FILTER (WHERE status = 'invalid') AS lines_invalid,
 CAST(0 AS BIGINT) AS lines_oversized, count(*) FILTER (WHERE status = 'invalid') / count(*) AS invalid_ratio FROM parsed""",
)
def file_stats(spark, folder):
    """The lines written as text files to the shared folder and read from there."""
    path = scratch(spark, "logs")
    derive.view(spark, folder, "f_log_line").select("value").write.text(path)
    return source.read_stats(source.parse_lines(source.read_log_lines(spark, path)))


@REGISTRY.add(
    "src3_profile_pg_json",
    LINES_SQL + f" SELECT source, ts, {LEVEL_SQL} AS level, coalesce(j->>'message', '') AS message, coalesce(j->>'user', '') AS role_name FROM parsed WHERE status = 'parsed'",
)
def postgres_profile(spark, folder):
    return source.log_events(parsed(spark, folder))


@REGISTRY.add(
    "src4_profile_generic",
    LINES_SQL + f" SELECT source, ts, {LEVEL_SQL} AS level, coalesce(j->>'message', '') AS message FROM parsed WHERE status = 'parsed'",
)
def generic_profile(spark, folder):
    lines = derive.view(spark, folder, "f_log_line").select("source", "value")
    return source.log_events(source.parse_generic(lines, "timestamp", "message")).drop("role_name")


TIMES = {
    "iso": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", "date_trunc('second', ts)"),
    "iso_offset": ("date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'-03:00'\")", "ts + INTERVAL 3 HOUR"),
    "plain": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "date_trunc('second', ts)"),
    "zone": ("date_format(ts, \"yyyy-MM-dd HH:mm:ss.SSS' UTC'\")", "date_trunc('millisecond', ts)"),
    "short_offset": ("date_format(ts, \"yyyy-MM-dd HH:mm:ss' +0530'\")", "date_trunc('second', ts) - INTERVAL 330 MINUTE"),
    "day": ("date_format(ts, 'yyyy-MM-dd')", "CAST(NULL AS TIMESTAMP)"),
}


@REGISTRY.add(
    "src5_parse_time_any",
    " UNION ALL ".join(f"SELECT event_id, '{n}' AS layout, {s} AS ts FROM events" for n, (_, s) in TIMES.items()),
)
def times(spark, folder):
    raw = table(spark, folder, "events")
    forms = F.array(*[F.struct(F.lit(n).alias("layout"), F.expr(e).alias("text")) for n, (e, _) in TIMES.items()])
    spread = raw.select("event_id", F.explode(forms).alias("f"))
    return spread.select("event_id", F.col("f.layout").alias("layout"), source.parse_time_any(F.col("f.text")).alias("ts"))


@REGISTRY.add(
    "src6_level_bucket",
    """SELECT s AS severity, CASE WHEN upper(trim(s)) IN ('ERROR', 'FATAL', 'PANIC') OR upper(s) LIKE '%ERR%' THEN 'error' WHEN upper(s) LIKE '%WARN%' THEN 'warning' ELSE 'info' END AS level, count(*) AS events
FROM (SELECT CASE event_id % 7 WHEN 0 THEN 'error ' WHEN 1 THEN 'PANIC' WHEN 2 THEN 'my_err' WHEN 3 THEN 'warnings' WHEN 4 THEN event_type WHEN 5 THEN 'DEBUG1' ELSE 'Fatal' END AS s FROM events) GROUP BY ALL""",
)
def levels(spark, folder):
    text = "CASE event_id % 7 WHEN 0 THEN 'error ' WHEN 1 THEN 'PANIC' WHEN 2 THEN 'my_err' WHEN 3 THEN 'warnings' WHEN 4 THEN event_type WHEN 5 THEN 'DEBUG1' ELSE 'Fatal' END"
    named = table(spark, folder, "events").select(F.expr(text).alias("severity"))
    return named.groupBy("severity", source.level_bucket(F.col("severity")).alias("level")).agg(F.count(F.lit(1)).alias("events"))


def replace_chain(column: str, steps) -> str:
    for pattern, replacement in steps:
        quoted = pattern.replace("'", "''")
        column = f"regexp_replace({column}, '{quoted}', '{replacement}', 'g')"
    return column


#: The shapes of an IPv6 address, of the text masked in a message and of the literals stripped from SQL.
IPV6_FORMS = (
    r"(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}",
    r"(?:[0-9a-f]{1,4}:){1,7}:",
    r"(?:[0-9a-f]{1,4}:){1,6}:[0-9a-f]{1,4}",
    r"(?:[0-9a-f]{1,4}:){1,5}(?::[0-9a-f]{1,4}){1,2}",
    r"(?:[0-9a-f]{1,4}:){1,4}(?::[0-9a-f]{1,4}){1,3}",
    r"(?:[0-9a-f]{1,4}:){1,3}(?::[0-9a-f]{1,4}){1,4}",
    r"(?:[0-9a-f]{1,4}:){1,2}(?::[0-9a-f]{1,4}){1,5}",
    r"[0-9a-f]{1,4}:(?::[0-9a-f]{1,4}){1,6}",
    r":(?::[0-9a-f]{1,4}){1,7}",
)
MASK_SQL = [
    (r"(?s)\$[A-Za-z_0-9]*\$.*?\$[A-Za-z_0-9]*\$", "<*>"),
    (r"""'(?:''|[^'])*'|"(?:\\.|[^"\\])*\"""", "<*>"),
    (r"(?i)\b[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}\b", "<*>"),
    (r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", "<*>"),
    (rf"(?i)\b(?:{'|'.join(IPV6_FORMS)})\b", "<*>"),
    (r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d?\d)\b", "<*>"),
    (r"\b[0-9a-fA-F]{32,64}\b", "<*>"),
    (r"""(?i)\b[A-Z]:\\(?:[^\s"'<>|]+\\)*[^\s"'<>|]+""", "<*>"),
    (r"""([ ="'(:,])(?:/[A-Za-z0-9._\-]+(?:/[A-Za-z0-9._\-]+)+)""", r"\1<*>"),
    (r"(?:^|[\t\n\f\r])(?:/[A-Za-z0-9._\-]+(?:/[A-Za-z0-9._\-]+)+)", "<*>"),
    (r"(?i)\b(user|database|dbname|application_name|app|host|remote_host|password|pwd)=([^\s,]+)", r"\1=<*>"),
    (r"\b\d+(?:\.\d+)?\b", "<*>"),
]
STRIP_SQL = [
    (r"(?s)/\*.*?\*/", " "),
    (r"--[^\n]*", " "),
    (r"(?s)\$[A-Za-z_0-9]*\$.*?\$[A-Za-z_0-9]*\$", "?"),
    (r"'(?:''|[^'])*'", "?"),
    (r"\b\d+(?:\.\d+)?\b", "?"),
]
STRIPPED = f"trim(regexp_replace(lower({replace_chain('{c}', STRIP_SQL)}), '\\s+', ' ', 'g'))"
REDACTED = replace_chain("text", MASK_SQL)
MASKED = f"trim(regexp_replace(replace({STRIPPED.replace('{c}', REDACTED)}, '?', '<*>'), '\\s+', ' ', 'g'))"
DOCUMENTS = "(SELECT doc_id, text FROM documents UNION ALL SELECT 100000000 + conv_id * 100 + turn, text FROM conversations)"


def texts(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "text")
    talks = table(spark, folder, "conversations").select(
        (F.lit(100000000) + F.col("conv_id") * 100 + F.col("turn")).alias("doc_id"), "text"
    )
    return documents.unionByName(talks)


@REGISTRY.add("log1_mask_message", f"SELECT doc_id, {MASKED} AS masked FROM {DOCUMENTS}")
def masked(spark, folder):
    return texts(spark, folder).select("doc_id", mask_message(F.col("text")).alias("masked"))


@REGISTRY.add("pii9_redact_text", f"SELECT doc_id, {REDACTED} AS text FROM {DOCUMENTS}")
def redacted(spark, folder):
    from plumbline.operators.pii import redact_column

    return redact_column(texts(spark, folder), "text")


LINE_TEXT = "(SELECT line, unnest(string_split(text, chr(10))) AS text FROM (SELECT doc_id AS line, text FROM documents))"


@REGISTRY.add(
    "log2_template_id",
    f"""SELECT template, substr(sha256(template), 1, 16) AS template_id, count(*) AS lines FROM (
 SELECT regexp_replace(masked, '(^| )<\\*>(?: <\\*>)+( |$)', '\\1<*>\\2', 'g') AS template FROM (SELECT {MASKED} AS masked FROM {LINE_TEXT})
 WHERE masked <> '' AND regexp_matches(replace(masked, '<*>', chr(1)), '(?:^|\\s)[="''(),.;:\\[\\]{{}}]*[^\\s\\x01="''(),.;:\\[\\]{{}}]')) GROUP BY ALL""",
)
def template_ids(spark, folder):
    lines = table(spark, folder, "documents").select(F.explode(F.split("text", "\n")).alias("text"))
    masked_lines = lines.select(mask_message(F.col("text")).alias("masked"))
    kept = masked_lines.where((F.col("masked") != "") & has_fixed_token(F.col("masked")))
    pattern = kept.select(template_pattern(F.col("masked")).alias("template"))
    return pattern.groupBy("template", template_id(F.col("template")).alias("template_id")).agg(F.count(F.lit(1)).alias("lines"))


EVENT_SQL = derive.ctes("f_log_event") + """, ev AS (SELECT source, ts, event_id, role_name, message, CASE error_severity WHEN 'ERROR' THEN 'error' WHEN 'WARNING' THEN 'warning' ELSE 'info' END AS level,
 split_part(message, ' ', 1) || ' authorized: user=<*> took <*> for ' || split_part(message, ' for ', 2) AS template FROM f_log_event)"""
COUNTS = """(SELECT source, TIMESTAMP '1970-01-01' + to_seconds(CAST(floor(epoch(ts) / 43200) * 43200 AS BIGINT)) AS window_start, substr(sha256(template), 1, 16) AS template_id, template, level, count(*) AS events FROM ev GROUP BY ALL)"""
LOG_SQL = EVENT_SQL + f""", c AS {COUNTS},
 roles AS (SELECT source, window_start, CASE WHEN place = 1 THEN 'analysis' ELSE 'baseline' END AS role FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY window_start DESC) AS place FROM (SELECT DISTINCT source, window_start FROM c)) WHERE place <= 13),
 sizes AS (SELECT source, count(*) FILTER (WHERE role = 'baseline') AS windows FROM roles GROUP BY source),
 cells AS (SELECT c.source, window_start, k.kind, CASE k.kind WHEN 'template' THEN template_id ELSE level END AS name, sum(events) AS n FROM c JOIN roles USING (source, window_start) CROSS JOIN (VALUES ('template'), ('level')) k(kind) WHERE role = 'baseline' GROUP BY ALL),
 stats AS (SELECT source, kind, name, sum(n) / windows AS mean, sqrt(greatest(sum(n * n) / windows - (sum(n) / windows) * (sum(n) / windows), 0)) AS deviation, count(*) AS windows_with, windows, windows < 6 AS insufficient FROM cells JOIN sizes USING (source) GROUP BY source, kind, name, windows),
 lv AS (SELECT source, template_id, level AS tl FROM (SELECT *, row_number() OVER (PARTITION BY source, template_id ORDER BY n DESC, CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END) AS p FROM (SELECT source, template_id, level, sum(events) AS n FROM c GROUP BY 1, 2, 3)) WHERE p = 1),
 obs AS (SELECT source, window_start, template_id, min(template) AS template, CAST(sum(events) AS BIGINT) AS observed FROM c JOIN roles USING (source, window_start) WHERE role = 'analysis' GROUP BY ALL),
 seen AS (SELECT o.*, mean, deviation, tl, coalesce(observed / mean, 0) AS f, (observed - mean) / deviation AS z FROM obs o JOIN lv USING (source, template_id) LEFT JOIN stats s ON s.source = o.source AND s.kind = 'template' AND s.name = o.template_id),
 tpl AS (SELECT source, CASE WHEN mean IS NULL AND observed >= 2 THEN 'new_template' WHEN f >= 1.4 AND observed >= 12 THEN 'strong_spike' WHEN z >= 1 AND observed >= 5 THEN 'spike' END AS kind,
   template_id, template, tl AS level, window_start, observed, mean, f, z FROM seen),
 anomalies AS (SELECT source, kind, CASE WHEN kind = 'strong_spike' THEN CASE WHEN level = 'error' THEN 'high' ELSE 'medium' END WHEN level = 'error' THEN 'medium' ELSE 'low' END AS severity, CASE WHEN kind = 'new_template' THEN 'medium' ELSE 'high' END AS confidence,
   template_id, template, level, window_start, observed, coalesce(round(mean * 100) / 100, 0) AS expected, CASE WHEN mean IS NOT NULL THEN round(f * 100) / 100 END AS factor, CASE WHEN mean IS NOT NULL THEN round(z * 100) / 100 END AS z_score FROM tpl WHERE kind IS NOT NULL
  UNION ALL SELECT c.source, 'error_spike', 'high', 'high', '', '', 'error', c.window_start, CAST(sum(events) AS BIGINT), round(min(mean) * 100) / 100, round(sum(events) / min(mean) * 100) / 100, NULL FROM c JOIN roles USING (source, window_start) JOIN stats s ON s.source = c.source AND s.kind = 'level' AND s.name = 'error' WHERE role = 'analysis' AND level = 'error' GROUP BY c.source, c.window_start HAVING sum(events) / min(mean) >= 0.5
  UNION ALL SELECT source, 'missing_template', 'info', 'medium', name, (SELECT min(template) FROM c WHERE c.template_id = s.name), '', l3.w, 0, round(mean * 100) / 100, NULL, NULL FROM stats s JOIN (SELECT source, min(window_start) AS w FROM (SELECT DISTINCT source, window_start FROM c QUALIFY dense_rank() OVER (PARTITION BY source ORDER BY window_start DESC) <= 3) GROUP BY source) l3 USING (source)
   WHERE kind = 'template' AND windows_with / windows >= 0.5 AND NOT EXISTS (SELECT 1 FROM c WHERE c.source = s.source AND c.template_id = s.name AND c.window_start >= l3.w))"""


@REGISTRY.add(
    "log3_cap_templates",
    EVENT_SQL + """ SELECT source, coalesce(k.template, 'outros') AS template, CASE WHEN k.template IS NULL THEN 'others' ELSE substr(sha256(k.template), 1, 16) END AS template_id, count(*) AS events FROM ev
 LEFT JOIN (SELECT source, template FROM (SELECT source, template, row_number() OVER (PARTITION BY source ORDER BY f, substr(sha256(template), 1, 16)) AS p FROM (SELECT source, template, min(ts) AS f FROM ev GROUP BY 1, 2)) WHERE p <= 6) k USING (source, template) GROUP BY ALL""",
)
def capped(spark, folder):
    limited = logs.cap_templates(logs.template_events(events(spark, folder)), 6)
    return limited.groupBy("source", "template", "template_id").agg(F.count(F.lit(1)).alias("events"))


@REGISTRY.add("log4_window_counts", EVENT_SQL + f" SELECT * FROM {COUNTS}")
def windows(spark, folder):
    return counts(spark, folder)


@REGISTRY.add("log5_split_windows", LOG_SQL + " SELECT source, window_start, role FROM roles")
def roles(spark, folder):
    return logs.split_windows(counts(spark, folder), T.baseline_windows)


@REGISTRY.add(
    "log5_split_windows_period",
    EVENT_SQL + f""", c AS {COUNTS} SELECT DISTINCT source, window_start, CASE WHEN window_start >= TIMESTAMP '2024-01-20' THEN 'analysis' ELSE 'baseline' END AS role FROM c WHERE window_start >= TIMESTAMP '2024-01-05'""",
)
def period_roles(spark, folder):
    return logs.split_windows(counts(spark, folder), since="2024-01-05", until="2024-01-20")


@REGISTRY.add("log6_baseline_stats", LOG_SQL + " SELECT source, kind, name, round(mean, 6) AS mean, round(deviation, 6) AS deviation, windows_with, windows, insufficient FROM stats")
def stats(spark, folder):
    c = staged_counts(spark, folder)
    found = logs.baseline_stats(c, logs.split_windows(c, T.baseline_windows))
    return found.withColumn("mean", F.round("mean", 6)).withColumn("deviation", F.round("deviation", 6))


@REGISTRY.add("log7_z_score", LOG_SQL + " SELECT source, template_id, observed, CASE WHEN mean IS NULL THEN CAST(observed AS DOUBLE) ELSE round(f, 6) END AS factor, CASE WHEN mean IS NULL THEN CAST(observed AS DOUBLE) ELSE round(z, 6) END AS z_score FROM seen")
def scores(spark, folder):
    c = staged_counts(spark, folder)
    split = logs.split_windows(c, T.baseline_windows)
    base = logs.baseline_stats(c, split).where("kind = 'template'").select("source", F.col("name").alias("template_id"), "mean", "deviation")
    seen = (
        c.join(split.where("role = 'analysis'"), ["source", "window_start"])
        .groupBy("source", "template_id")
        .agg(F.sum("events").alias("observed"))
        .join(base, ["source", "template_id"], "left")
        .na.fill(0.0, ["mean", "deviation"])
    )
    return seen.select(
        "source",
        "template_id",
        "observed",
        F.round(logs.factor(F.col("observed"), F.col("mean")), 6).alias("factor"),
        F.round(logs.z_score(F.col("observed"), F.col("mean"), F.col("deviation")), 6).alias("z_score"),
    )


def one_kind(name, kinds):
    listed = ", ".join(f"'{k}'" for k in kinds)

    @REGISTRY.add(name, LOG_SQL + f" SELECT * FROM anomalies WHERE kind IN ({listed})")
    def run(spark, folder):
        c = staged_counts(spark, folder)
        split = logs.split_windows(c, T.baseline_windows)
        if kinds == ("error_spike",):
            return logs.detect_error_spike(c, split, T)
        if kinds == ("missing_template",):
            return logs.detect_missing(c, split, T)
        return logs.detect_templates(c, split, T).where(F.col("kind").isin(*kinds))


one_kind("log8_detect_spikes", ("strong_spike", "spike"))
one_kind("log9_detect_new_templates", ("new_template",))
one_kind("log10_detect_error_spike", ("error_spike",))
one_kind("log11_detect_missing", ("missing_template",))


@REGISTRY.add("log12_template_level", LOG_SQL + " SELECT source, template_id, tl AS template_level FROM lv")
def template_levels(spark, folder):
    return logs.template_levels(counts(spark, folder))


@REGISTRY.add(
    "log13_anomaly_summary",
    LOG_SQL
    + """ SELECT source, count(*) FILTER (WHERE severity = 'info') AS info, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'critical') AS critical,
 count(*) AS total, arg_max(severity, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END) AS highest, CAST(CASE WHEN count(*) FILTER (WHERE severity = 'high') > 0 THEN 1 ELSE 0 END AS INTEGER) AS exit_code FROM anomalies GROUP BY source""",
)
def summary(spark, folder):
    return analyze_events(events(spark, folder), thresholds=T).summary


LOGIN_SQL = EVENT_SQL + ", login AS (SELECT CASE WHEN role_name <> '' THEN role_name ELSE regexp_extract(message, 'user=(\\d+)', 1) END AS role, max(ts) AS last_login_at FROM ev WHERE message LIKE 'connection authorized%' GROUP BY 1)"


@REGISTRY.add("log14_last_login", LOGIN_SQL + " SELECT role, last_login_at FROM login")
def logins(spark, folder):
    return logs.last_login(events(spark, folder))


@REGISTRY.add("log14_merge_last_login", LOGIN_SQL + " SELECT role, greatest(last_login_at, CASE WHEN role LIKE 'u%' THEN TIMESTAMP '2024-01-29' ELSE last_login_at END) AS last_login_at FROM login")
def merged_logins(spark, folder):
    fresh = logs.last_login(events(spark, folder))
    stored = fresh.where("role LIKE 'u%'").select("role", F.lit("2024-01-29").cast("timestamp_ntz").alias("last_login_at"))
    return logs.merge_last_login(stored, fresh)
