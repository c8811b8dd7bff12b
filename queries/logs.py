"""Log analytics, alarms and state questions over the events table."""

from pyspark.sql import functions as F

from queries.base import log_events, query, table, with_events
from tillworks.operators import logs, state
from tillworks.operators.logs import Alarm
from tillworks.plans import retention
from tillworks.session import scratch
from tillworks.sources.events import parse_events
from tillworks.streaming import alarms
from tillworks.streaming.ingest import dedup_stream

DAY = "yyyy-MM-dd HH:mm:ss"


def events(spark, sf_dir):
    return log_events(table(spark, sf_dir, "events"))


def stream(spark, sf_dir):
    """The events table as a file stream."""
    schema = table(spark, sf_dir, "events").schema
    return log_events(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(
        f"{sf_dir}/[e]vents.parquet"))


def text_times(df):
    return df.withColumns({c: F.date_format(c, DAY) for c in ("window_start", "window_end") if c in df.columns})


@query("s19_log_scan", with_events("""SELECT event_id, event_type, level, job_run_id, table_name, k AS records_passed,
  error_type FROM log_events"""))
def s19(spark, sf_dir):
    source = events(spark, sf_dir)
    lines = source.select(F.concat(F.lit("INFO "), F.to_json(F.struct(
        "timestamp", "level", "job_run_id", F.col("event_id").cast("string").alias("message"), "event_type", "details",
        "error"))).alias("value"))
    return parse_events(lines).select(
        F.col("message").cast("bigint").alias("event_id"), "event_type", "level", "job_run_id", "details.table_name",
        F.col("details.records_passed").cast("int").alias("records_passed"), F.col("error.type").alias("error_type"))


@query("f13_recent_activity", with_events("""SELECT event_id, event_type, job_run_id FROM log_events
WHERE event_type IN ('DATA_CHANGE', 'JOB_INIT', 'JOB_SUMMARY', 'ERROR', 'QUALITY_ALERT')
ORDER BY ts DESC, event_id LIMIT 100"""))
def f13(spark, sf_dir):
    return logs.latest_events(events(spark, sf_dir), 100, *logs.ACTIVITY).select("event_id", "event_type", "job_run_id")


@query("f13b_audit_trail", with_events("SELECT event_id, event_type FROM log_events ORDER BY ts, event_id LIMIT 500"))
def f13b(spark, sf_dir):
    return logs.latest_events(events(spark, sf_dir), 500, descending=False).select("event_id", "event_type")


@query("a29_changes_by_table", with_events("""SELECT table_name, change_type, operation, COUNT(*) AS change_count
FROM log_events WHERE event_type = 'DATA_CHANGE' GROUP BY ALL"""))
def a29(spark, sf_dir):
    return logs.changes_by_table(events(spark, sf_dir))


@query("a29b_changes_by_run", with_events("""SELECT job_run_id, COUNT(*) AS change_count FROM log_events
WHERE event_type = 'DATA_CHANGE' GROUP BY ALL"""))
def a29b(spark, sf_dir):
    return logs.changes_by_run(events(spark, sf_dir))


@query("a29c_errors_by_type", with_events("""SELECT error_type, COUNT(*) AS error_count FROM log_events
WHERE level = 'ERROR' GROUP BY ALL"""))
def a29c(spark, sf_dir):
    return logs.errors_by_type(events(spark, sf_dir))


@query("a29d_issues_by_flags", with_events("""SELECT quality_flags, COUNT(*) AS issue_count FROM log_events
WHERE quality_flags != '' GROUP BY ALL"""))
def a29d(spark, sf_dir):
    return logs.issues_by_flags(events(spark, sf_dir))


@query("a30_duration_by_day", with_events("""SELECT CAST(ts AS DATE) AS day, ROUND(AVG(value), 6) AS avg_duration,
  MIN(value) AS min_duration, MAX(value) AS max_duration FROM log_events WHERE event_type = 'JOB_SUMMARY' GROUP BY 1"""))
def a30(spark, sf_dir):
    return logs.duration_by_day(events(spark, sf_dir)).withColumn("avg_duration", F.round("avg_duration", 6))


@query("a30b_score_by_day", with_events("""SELECT CAST(ts AS DATE) AS day, ROUND(AVG(k / 100.0), 6) AS avg_score,
  ROUND(AVG((100 - k) / 100.0), 6) AS avg_pass_rate FROM log_events WHERE event_type = 'JOB_SUMMARY' GROUP BY 1"""))
def a30b(spark, sf_dir):
    out = logs.score_by_day(events(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("avg_score", "avg_pass_rate")})


@query("a30c_tiers_by_day", with_events("""SELECT CAST(ts AS DATE) AS day, CAST(SUM(k) AS BIGINT) AS total_passed,
  CAST(SUM(k % 7) AS BIGINT) AS total_warned, CAST(SUM(k % 5) AS BIGINT) AS total_failed
FROM log_events WHERE event_type = 'JOB_SUMMARY' GROUP BY 1"""))
def a30c(spark, sf_dir):
    return logs.tiers_by_day(events(spark, sf_dir))


@query("a31_latest_request_state", """SELECT user_id, event_type AS status, event_id FROM events
QUALIFY ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def a31(spark, sf_dir):
    requests = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("status"), "ts", "event_id")
    return state.latest_state(requests, ["user_id"], ["ts", "event_id"]).drop("ts")


@query("a31b_merged_request_state", """SELECT user_id,
  (max_by(event_id, (ts, event_id)) FILTER (event_type = 'error')) AS last_error,
  (max_by(event_id, (ts, event_id)) FILTER (event_type = 'purchase')) AS last_purchase FROM events GROUP BY user_id""")
def a31b(spark, sf_dir):
    kind = F.col("event_type")
    updates = table(spark, sf_dir, "events").select(
        "user_id", "ts", "event_id", F.when(kind == "error", F.col("event_id")).alias("last_error"),
        F.when(kind == "purchase", F.col("event_id")).alias("last_purchase"))
    return state.merged_state(updates, ["user_id"], ["ts", "event_id"]).select("user_id", "last_error", "last_purchase")


# the cache holds one entry per purchase of a user, each living for six hours; requests are the clicks
NOW = "2024-01-20 12:00:00"
CACHE_SQL = f"""cache AS (SELECT user_id, epoch(ts) // 1 + 6 * 3600 AS ttl, event_id FROM events
  WHERE event_type = 'purchase'),
live AS (SELECT user_id, max_by(event_id, ttl) AS payload FROM cache WHERE ttl > epoch(TIMESTAMP '{NOW}') GROUP BY user_id),
requests AS (SELECT event_id, user_id FROM events WHERE event_type = 'click')"""


def cache_and_requests(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    cache = state.with_ttl(rows.where("event_type = 'purchase'").withColumn("ts", F.col("ts").cast("timestamp")), "ts",
                           state.CACHE_HOURS).select("user_id", "ttl_expiry", F.col("event_id").alias("payload"))
    return cache, rows.where("event_type = 'click'").select("event_id", "user_id")


@query("j06_cache_lookup", f"""WITH {CACHE_SQL} SELECT event_id, r.user_id, payload, payload IS NOT NULL AS hit
FROM requests r LEFT JOIN live USING (user_id)""")
def j06(spark, sf_dir):
    cache, requests = cache_and_requests(spark, sf_dir)
    return state.cache_lookup(requests, cache, "user_id", F.lit(NOW).cast("timestamp"))


@query("j06b_cache_misses", f"""WITH {CACHE_SQL} SELECT event_id, user_id FROM requests
WHERE user_id NOT IN (SELECT user_id FROM live)""")
def j06b(spark, sf_dir):
    cache, requests = cache_and_requests(spark, sf_dir)
    return state.cache_misses(requests, cache, "user_id", F.lit(NOW).cast("timestamp"))


@query("st5_expired_entries", f"""WITH {CACHE_SQL} SELECT user_id, event_id AS payload FROM cache
WHERE ttl <= epoch(TIMESTAMP '{NOW}')""")
def st5(spark, sf_dir):
    cache, _ = cache_and_requests(spark, sf_dir)
    return state.expired(cache, "ttl_expiry", F.lit(NOW).cast("timestamp")).select("user_id", "payload")


@query("st5b_retention_plan", """SELECT zone, action, COUNT(*) AS folders FROM (
SELECT 'raw' AS zone, CASE WHEN d < DATE '2001-11-04' - 365 THEN 'expire' WHEN d < DATE '2001-11-04' - 90 THEN 'archive'
  ELSE 'keep' END AS action FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
UNION ALL SELECT 'curated', CASE WHEN d < DATE '2001-11-04' - 180 THEN 'archive' ELSE 'keep' END
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)
UNION ALL SELECT 'error', CASE WHEN d < DATE '2001-11-04' - 30 THEN 'expire' ELSE 'keep' END
  FROM (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem)) GROUP BY ALL""")
def st5b(spark, sf_dir):
    from queries.base import CFG
    folders = table(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("landing_date")).distinct()
    plans = [state.retention_plan(folders, z, CFG).select(F.lit(z).alias("zone"), "action")
             for z in ("raw", "curated", "error")]
    return plans[0].unionByName(plans[1]).unionByName(plans[2]).groupBy("zone", "action").agg(
        F.count(F.lit(1)).alias("folders"))


@query("st5c_retention_carried_out", """SELECT CASE WHEN d < DATE '2001-11-04' - 365 THEN 'gone' WHEN d < DATE '2001-11-04' - 90
  THEN 'archive' ELSE 'live' END AS place, COUNT(*) AS records, COUNT(DISTINCT d) AS folders, 0::BIGINT AS open, 0 AS again FROM (
SELECT CAST(date_trunc('month', l_shipdate) + INTERVAL 36 MONTH AS DATE) AS d FROM lineitem) GROUP BY 1""")
def st5c(spark, sf_dir):
    """Rows by where they are after a run: live, archived, or gone with a folder that the log names."""
    from queries.base import CFG
    root = scratch(spark, "retention")
    day = F.add_months(F.trunc("l_shipdate", "month"), 36)
    rows = table(spark, sf_dir, "lineitem").select(day.alias("landing_date"), "l_orderkey")
    rows.repartition("landing_date").write.partitionBy("landing_date").parquet(f"{root}/raw")
    retention.carry_out(spark, root, ["raw"], CFG)
    again = retention.carry_out(spark, root, ["raw"], CFG)
    places = [("live", f"{root}/raw"), ("archive", f"{root}/{retention.ARCHIVE}/raw")]
    kept = [spark.read.schema("l_orderkey bigint, landing_date date").parquet(path).withColumn("place", F.lit(place)) for place, path in places]
    expired = retention.retention_log(spark, root).where("state = 'done' and action = 'expire'").select("landing_date", F.lit("gone").alias("place"))
    found = kept[0].unionByName(kept[1]).select("landing_date", "place").unionByName(rows.join(expired, "landing_date").select("landing_date", "place"))
    return found.groupBy("place").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("landing_date").alias("folders")).withColumns({
        "open": F.lit(retention.unfinished(spark, root).count()).cast("bigint"), "again": F.lit(again)})


METRICS = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, metric, COUNT(*) AS events FROM (
SELECT ts, unnest(list_filter([CASE WHEN event_type = 'DATA_CHANGE' THEN 'DataChangeCount' END,
  CASE WHEN level = 'ERROR' THEN 'ErrorCount' END, CASE WHEN event_type = 'QUALITY_ALERT' THEN 'QualityAlertCount' END,
  CASE WHEN event_type = 'QUALITY_ALERT' AND alert_type = 'QUALITY_SCORE_LOW' THEN 'LowQualityScoreCount' END,
  CASE WHEN event_type = 'QUALITY_ALERT' AND alert_type = 'ERROR_RATE_HIGH' THEN 'HighErrorRateCount' END,
  CASE WHEN event_type = 'JOB_SUMMARY' THEN 'JobCompletionCount' END,
  CASE WHEN event_type = 'ETL_STEP' THEN 'ETLStepCount' END], lambda x: x IS NOT NULL)) AS metric FROM log_events)
GROUP BY 1, 2"""
TIMES = "strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, strftime(s + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS window_end"
#: windows a stream has closed: their end is not after the newest event minus the watermark
CLOSED = "s + INTERVAL 1 HOUR <= (SELECT MAX(ts) FROM events) - INTERVAL 10 MINUTE"


@query("st1_metric_filters", with_events(f"SELECT {TIMES}, metric, events FROM ({METRICS})"))
def st1(spark, sf_dir):
    return text_times(logs.metric_counts(events(spark, sf_dir)))


@query("st1b_metric_filters_stream", with_events(f"SELECT {TIMES}, metric, events FROM ({METRICS}) WHERE {CLOSED}"))
def st1b(spark, sf_dir):
    out = scratch(spark, "metric-windows")
    counts = alarms.stream_metric_counts(stream(spark, sf_dir), "1 hour", "10 minutes")
    alarms.write_windows(counts, f"{out}/table", f"{out}/checkpoint")
    return text_times(spark.read.parquet(f"{out}/table").drop("batch_id"))


SCORES = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, SUM(k) / COUNT(k) AS value, COUNT(*) AS n
FROM log_events WHERE event_type = 'JOB_SUMMARY' GROUP BY 1"""


@query("st2_window_alarm", with_events(f"SELECT {TIMES}, value FROM ({SCORES}) WHERE value < 40"))
def st2(spark, sf_dir):
    alarm = Alarm("avg_score_low", "avg", "<", 40, "1 hour")
    windows = logs.alarm_windows(logs.of_type(events(spark, sf_dir), "JOB_SUMMARY"), alarm, F.col("k"))
    return text_times(logs.consecutive(windows, alarm.periods)).drop("breach")


@query("st2b_error_count_alarm_stream", with_events(f"""SELECT {TIMES}, value FROM (
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, COUNT(*) AS value FROM log_events WHERE level = 'ERROR' GROUP BY 1)
WHERE value > 3 AND {CLOSED}"""))
def st2b(spark, sf_dir):
    alarm = Alarm("error_count", "sum", ">", 3, "1 hour")
    out = scratch(spark, "alarm-windows")
    errors = stream(spark, sf_dir).where("level = 'ERROR'")
    alarms.write_windows(alarms.stream_alarm_windows(errors, alarm, F.lit(1).cast("bigint"), "10 minutes"),
                         f"{out}/table", f"{out}/checkpoint")
    return text_times(alarms.fired(spark, f"{out}/table", alarm)).drop("breach")


RUNS = """SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, SUM(k) / COUNT(k) AS value FROM log_events GROUP BY 1"""


@query("st3_three_windows_in_a_row", with_events(f"""SELECT {TIMES}, value FROM (
SELECT *, LAG(s, 2) OVER (ORDER BY s) AS first FROM ({RUNS}) WHERE value > 50) WHERE s - first = INTERVAL 2 HOUR"""))
def st3(spark, sf_dir):
    alarm = Alarm("high_latency", "avg", ">", 50, "1 hour", 3)
    windows = logs.alarm_windows(events(spark, sf_dir), alarm, F.col("k"))
    return text_times(logs.consecutive(windows, alarm.periods)).drop("breach")


@query("st3b_three_windows_in_a_row_stream", with_events(f"""SELECT {TIMES}, value FROM (
SELECT *, LAG(s, 2) OVER (ORDER BY s) AS first FROM ({RUNS}) WHERE value > 50 AND {CLOSED})
WHERE s - first = INTERVAL 2 HOUR"""))
def st3b(spark, sf_dir):
    alarm = Alarm("high_latency", "avg", ">", 50, "1 hour", 3)
    out = scratch(spark, "alarm-windows")
    windows = alarms.stream_alarm_windows(stream(spark, sf_dir), alarm, F.col("k"), "10 minutes")
    alarms.write_windows(alarms.consecutive_stream(windows, alarm), f"{out}/table", f"{out}/checkpoint")
    return text_times(spark.read.parquet(f"{out}/table").drop("batch_id", "breach"))


@query("st3c_rows_of_windows_by_key_stream", with_events(f"""SELECT {TIMES}, event_type, value FROM (
SELECT *, LAG(s, 1) OVER (PARTITION BY event_type ORDER BY s) AS first FROM (
  SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, event_type, MAX(k) AS value FROM log_events GROUP BY ALL) WHERE value > 80 AND {CLOSED})
WHERE s - first = INTERVAL 1 HOUR"""))
def st3c(spark, sf_dir):
    alarm = Alarm("high_concurrency", "max", ">", 80, "1 hour", 2)
    out = scratch(spark, "alarm-windows")
    windows = alarms.stream_alarm_windows(stream(spark, sf_dir), alarm, F.col("k"), "10 minutes", ["event_type"])
    alarms.write_windows(alarms.consecutive_stream(windows, alarm, ["event_type"]), f"{out}/table", f"{out}/checkpoint")
    return text_times(spark.read.parquet(f"{out}/table").drop("batch_id", "breach"))


@query("st4_ratio_alarm", with_events(f"""SELECT {TIMES}, value FROM (
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, COUNT(*) FILTER (level = 'ERROR') * CAST(100 AS DOUBLE) / COUNT(*) AS value
FROM log_events GROUP BY 1) WHERE value > 30"""))
def st4(spark, sf_dir):
    alarm = Alarm("error_ratio", "avg", ">", 30, "1 hour")
    windows = logs.ratio_windows(events(spark, sf_dir), F.col("level") == "ERROR", F.lit(True), alarm)
    return text_times(logs.consecutive(windows, 1)).drop("breach")


@query("st4b_ratio_alarm_stream", with_events(f"""SELECT {TIMES}, value FROM (
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS s, COUNT(*) FILTER (level = 'ERROR') * CAST(100 AS DOUBLE) / COUNT(*) AS value
FROM log_events GROUP BY 1) WHERE value > 30 AND {CLOSED}"""))
def st4b(spark, sf_dir):
    alarm = Alarm("error_ratio", "avg", ">", 30, "1 hour")
    out = scratch(spark, "ratio-windows")
    windows = alarms.stream_ratio_windows(stream(spark, sf_dir), F.col("level") == "ERROR", F.lit(True), alarm, "10 minutes")
    alarms.write_windows(windows, f"{out}/table", f"{out}/checkpoint")
    return text_times(alarms.fired(spark, f"{out}/table", alarm)).drop("breach")


@query("st7_stream_dedup", """SELECT user_id, event_type, COUNT(*) AS n FROM (
SELECT DISTINCT user_id, event_type FROM events) GROUP BY ALL""")
def st7(spark, sf_dir):
    # the watermark is longer than the table, so the first of every key survives
    out = scratch(spark, "stream-dedup")
    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).parquet(f"{sf_dir}/[e]vents.parquet")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    once = dedup_stream(rows, ["user_id", "event_type"], "ts", "400 days")

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    alarms.run_batches(once, write, f"{out}/checkpoint")
    return spark.read.parquet(f"{out}/table").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
