from datetime import datetime, timedelta

from pyspark.sql import functions as F

from plumbline.functions.text import has_fixed_token, mask_message, normalize_sql, strip_literals, template_pattern
from plumbline.operators import logs
from plumbline.plans.logs import analyze_events
from plumbline.sources import logs as source
from plumbline.streaming import logs as stream

START = datetime(2024, 1, 1)


def masked(spark, *texts):
    frame = spark.createDataFrame([(t,) for t in texts], "m string")
    return [r[0] for r in frame.select(mask_message(F.col("m"))).collect()]


def test_mask_leaves_no_secret(spark):
    line = "login of ana@corp.io from 10.1.2.3 and 2001:db8::1 id 550e8400-e29b-41d4-a716-446655440000 file /etc/app/secret.key password=hunter2 'literal' 4711"
    text = masked(spark, line)[0]
    for secret in ("ana", "10.1", "db8", "550e", "secret", "hunter2", "literal", "4711"):
        assert secret not in text
    assert text.startswith("login of <*> from <*>") and "password=<*>" in text


def test_unterminated_quotes_and_accents(spark):
    assert masked(spark, "it's é12 3é", "x''y' z", "a\t/b/c d") == ["it's é<*> <*>é", "x<*>y' z", "a<*> d"]


def test_long_quoted_text_does_not_overflow(spark):
    assert masked(spark, "say '" + "ab''" * 50_000 + "' done") == ["say <*> done"]


def test_templates(spark):
    frame = spark.createDataFrame([("<*> <*> a <*> <*> <*>",), ("<*> <*>",), ("user=<*>",), ("(<*>)",)], "m string")
    rows = frame.select(template_pattern(F.col("m")).alias("p"), has_fixed_token(F.col("m")).alias("f")).collect()
    assert [r["p"] for r in rows][:2] == ["<*> a <*>", "<*>"]
    assert [r["f"] for r in rows] == [True, False, True, False]


def test_sql_normalisation(spark):
    frame = spark.createDataFrame([("SELECT /* x */ 1, 'a''b' -- c\n FROM T ;",)], "q string")
    row = frame.select(strip_literals(F.col("q")).alias("s"), normalize_sql(F.col("q")).alias("n")).first()
    assert (row["s"], row["n"]) == ("select ?, ? from t ;", "select 1, 'a''b' from t")


def test_lines_are_counted(spark):
    good = '{"timestamp":"2024-01-01 00:00:01.500 -03","error_severity":"FATAL","message":"m","user":" ana "}'
    lines = [good, "[1]", "{", " ", "x" * 65_537, '{"timestamp":"soon","message":"m"}']
    parsed = source.parse_lines(spark.createDataFrame([(v,) for v in lines], "value string"), max_bytes=65_536)
    stats = source.read_stats(parsed).first()
    assert (stats["lines_read"], stats["lines_parsed"], stats["lines_invalid"], stats["lines_oversized"]) == (6, 1, 3, 1)
    event = source.log_events(parsed).first()
    assert event["ts"] == datetime(2024, 1, 1, 3, 0, 1, 500000) and (event["level"], event["role_name"]) == ("error", "ana")


def test_z_score_fallbacks(spark):
    cases = [(5, 5.0, 0.0, 0.0), (5, 0.0, 0.0, 5.0), (30, 10.0, 0.0, 20.0), (300, 100.0, 0.0, 20.0), (14, 10.0, 2.0, 2.0)]
    frame = spark.createDataFrame(cases, "n int, mean double, sd double, z double")
    assert not frame.where(logs.z_score(F.col("n"), F.col("mean"), F.col("sd")) != F.col("z")).collect()


def events(spark, plan):
    """plan: window number -> {(message, level): count}"""
    rows = [
        ("s", START + timedelta(minutes=5 * window, seconds=i % 240), level, message, "")
        for window, messages in plan.items()
        for (message, level), count in messages.items()
        for i in range(count)
    ]
    return spark.createDataFrame(rows, "source string, ts timestamp, level string, message string, role_name string")


def test_spikes_new_and_missing_templates(spark):
    plan = {w: {("steady state", "info"): 10, ("old job done", "info"): 5 if w < 7 else 0, ("disk failed", "error"): 2} for w in range(10)}
    plan[10] = {("steady state", "info"): 100, ("disk failed", "error"): 60, ("brand new", "warning"): 12}
    found = analyze_events(events(spark, plan))
    kinds = {(r["kind"], r["template"]): r["severity"] for r in found.anomalies.collect()}
    assert kinds == {
        ("strong_spike", "steady state"): "medium",
        ("strong_spike", "disk failed"): "high",
        ("new_template", "brand new"): "low",
        ("error_spike", ""): "high",
        ("missing_template", "old job done"): "info",
    }
    summary = found.summary.first()
    assert (summary["total"], summary["highest"], summary["exit_code"]) == (5, "high", 1)


def test_short_baseline_only_reports_new_templates(spark):
    plan = {0: {("steady", "info"): 1}, 1: {("steady", "info"): 500, ("fresh", "error"): 10}}
    found = analyze_events(events(spark, plan))
    rows = [(r["kind"], r["severity"], r["confidence"]) for r in found.anomalies.collect()]
    assert rows == [("new_template", "medium", "low")]
    assert found.summary.first()["exit_code"] == 3


def test_single_window_has_no_baseline(spark):
    assert analyze_events(events(spark, {0: {("only", "info"): 3}})).summary.first()["exit_code"] == 3


def run(query_frame, name, mode):
    query = query_frame.writeStream.outputMode(mode).format("memory").queryName(name).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()


def test_stream_gives_the_batch_result(spark, tmp_path):
    frame = events(spark, {w: {("job a", "info"): 3, ("connection authorized: user=ana", "info"): 2} for w in range(4)})
    frame.repartition(1).write.parquet(str(tmp_path / "in"))
    # A later event closes all windows above it.
    events(spark, {50: {("job a", "info"): 1}}).write.mode("append").parquet(str(tmp_path / "in"))
    source_stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    run(stream.stream_window_counts(source_stream), "closed_windows", "append")
    columns = ["source", "window_start", "template_id", "template", "level", "events"]
    streamed = {tuple(r) for r in spark.table("closed_windows").select(columns).collect()}
    batch = {tuple(r) for r in logs.window_counts(logs.template_events(frame)).select(columns).collect()}
    assert streamed == batch

    run(stream.stream_last_login(source_stream), "logins", "complete")
    expected = {tuple(r) for r in logs.last_login(frame).collect()}
    assert {tuple(r) for r in spark.table("logins").collect()} == expected


def test_anomaly_stream_judges_against_history(spark, tmp_path):
    plan = {w: {("steady", "info"): 10} for w in range(8)}
    history = logs.window_counts(logs.template_events(events(spark, plan)))
    fresh = events(spark, {8: {("steady", "info"): 100}, 60: {("steady", "info"): 1}})
    fresh.repartition(1).write.parquet(str(tmp_path / "in"))
    counts = stream.stream_window_counts(spark.readStream.schema(fresh.schema).parquet(str(tmp_path / "in")))
    found, stored = [], []
    query = stream.start_anomaly_stream(
        counts,
        lambda: history,
        lambda df, i: stored.extend(df.collect()),
        lambda df, i: found.extend((r["kind"], r["observed"]) for r in df.collect()),
        str(tmp_path / "checkpoint"),
    )
    query.processAllAvailable()
    query.stop()
    assert ("strong_spike", 100) in found and len(stored) == 1


def test_every_closed_window_is_judged(spark):
    """A batch that closes five windows per source gives what the batch operator says of each of them in turn."""
    plan = {w: {("steady", "info"): 10, ("often", "info"): 5} for w in range(10)}
    plan |= {10: {("steady", "info"): 100}, 11: {("steady", "info"): 100, ("fresh", "error"): 15}, 12: {("steady", "info"): 10}, 13: {("fresh", "error"): 60}, 14: {("steady", "info"): 10}}
    counts = logs.window_counts(logs.template_events(events(spark, plan))).cache()
    starts = sorted(r["window_start"] for r in counts.select("window_start").distinct().collect())
    history, fresh = counts.where(F.col("window_start") < F.lit(starts[10])), counts.where(F.col("window_start") >= F.lit(starts[10]))
    thresholds = logs.Thresholds(baseline_windows=8)
    judged = {tuple(r) for r in stream.judge_windows(history, fresh, thresholds).collect()}
    want = set()
    for i in range(10, 15):
        seen = counts.where(F.col("window_start").between(F.lit(starts[i - 8]), F.lit(starts[i])))
        want |= {tuple(r) for r in logs.detect_anomalies(seen, logs.split_windows(seen, 8), thresholds).collect()}
    assert judged == want
    assert {r["window_start"] for r in stream.judge_windows(history, fresh, thresholds).collect()} >= {starts[10], starts[11], starts[13]}
