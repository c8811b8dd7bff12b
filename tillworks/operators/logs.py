"""Log analytics and windowed alarms in batch form; ``tillworks.streaming.alarms`` runs the same aggregates on streams."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.operators.quality import mean

# Event types listed as recent activity.
ACTIVITY = ["DATA_CHANGE", "JOB_INIT", "JOB_SUMMARY", "ERROR", "QUALITY_ALERT"]
ALARM_STATS = {"avg": mean, "sum": F.sum, "max": F.max, "min": F.min, "count": F.count}
OPERATORS = {">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}


@dataclass(frozen=True)
class Alarm:
    """Statistic of a metric per window against a limit; fires after ``periods`` breaching windows in a row."""

    name: str
    statistic: str
    operator: str
    threshold: float
    window: str
    periods: int = 1


# The standing alarms.
ALARMS = {
    "avg_score_low": Alarm("avg_score_low", "avg", "<", 0.80, "1 hour"),
    "error_rate_high": Alarm("error_rate_high", "avg", ">", 5, "1 hour"),
    "quality_alert": Alarm("quality_alert", "sum", ">", 0, "1 hour"),
    "error_count": Alarm("error_count", "sum", ">", 10, "1 hour"),
    "failed_tasks": Alarm("failed_tasks", "sum", ">", 0, "5 minutes"),
    "high_latency": Alarm("high_latency", "avg", ">", 30_000, "5 minutes", 3),
    "error_ratio": Alarm("error_ratio", "avg", ">", 5, "5 minutes", 2),
    "high_concurrency": Alarm("high_concurrency", "max", ">", 80, "5 minutes", 2),
    "server_errors": Alarm("server_errors", "sum", ">", 5, "5 minutes", 2),
}


def of_type(events: DataFrame, *types: str) -> DataFrame:
    return events.where(F.col("event_type").isin(*types))


def log_counts(events: DataFrame, keys: Sequence[str | Column], alias: str) -> DataFrame:
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias(alias))


def changes_by_table(events: DataFrame) -> DataFrame:
    return log_counts(of_type(events, "DATA_CHANGE"),
                      ["details.table_name", "details.change_type", "details.operation"], "change_count")


def changes_by_run(events: DataFrame) -> DataFrame:
    return log_counts(of_type(events, "DATA_CHANGE"), ["job_run_id"], "change_count")


def errors_by_type(events: DataFrame) -> DataFrame:
    return log_counts(events.where("level = 'ERROR'"), [F.col("error.type").alias("error_type")], "error_count")


def issues_by_flags(events: DataFrame) -> DataFrame:
    flags = F.col("details.quality_flags")
    return log_counts(events.where(flags != ""), [flags.alias("quality_flags")], "issue_count")


def latest_events(events: DataFrame, k: int, *types: str, descending: bool = True) -> DataFrame:
    """Newest (or oldest) k events, optionally of some types."""
    chosen = of_type(events, *types) if types else events
    at = F.col("timestamp").desc() if descending else F.col("timestamp").asc()
    return chosen.orderBy(at, *[F.col(c).asc_nulls_last() for c in ("event_id",) if c in chosen.columns]).limit(k)


def daily_bins(events: DataFrame, measures: Sequence[Column], at: str = "timestamp") -> DataFrame:
    return events.groupBy(F.to_date(at).alias("day")).agg(*measures)


def duration_by_day(events: DataFrame) -> DataFrame:
    seconds = F.col("details.duration_seconds")
    return daily_bins(of_type(events, "JOB_SUMMARY"), [
        F.avg(seconds).alias("avg_duration"), F.min(seconds).alias("min_duration"),
        F.max(seconds).alias("max_duration")])


def score_by_day(events: DataFrame) -> DataFrame:
    return daily_bins(of_type(events, "JOB_SUMMARY"), [
        F.avg("details.avg_quality_score").alias("avg_score"), F.avg("details.pass_rate").alias("avg_pass_rate")])


def tiers_by_day(events: DataFrame) -> DataFrame:
    return daily_bins(of_type(events, "JOB_SUMMARY"), [
        F.sum(f"details.records_{t}").alias(f"total_{t}") for t in ("passed", "warned", "failed")])


def metric_kind() -> Column:
    """Names of the metric filters an event counts for; an alert counts in general and by its alert type."""
    alert = F.col("event_type") == "QUALITY_ALERT"
    kind = F.col("details.alert_type")
    tests = {
        "DataChangeCount": F.col("event_type") == "DATA_CHANGE",
        "ErrorCount": F.col("level") == "ERROR",
        "QualityAlertCount": alert,
        "LowQualityScoreCount": alert & (kind == "QUALITY_SCORE_LOW"),
        "HighErrorRateCount": alert & (kind == "ERROR_RATE_HIGH"),
        "JobCompletionCount": F.col("event_type") == "JOB_SUMMARY",
        "ETLStepCount": F.col("event_type") == "ETL_STEP",
    }
    return F.array_compact(F.array(*[F.when(t, F.lit(n)) for n, t in tests.items()]))


def windowed(events: DataFrame, window: str, measures: Sequence[Column], keys: Sequence[str] = (),
             at: str = "timestamp") -> DataFrame:
    """Tumbling windows; the same call works on a stream that has a watermark."""
    out = events.groupBy(F.window(at, window).alias("w"), *keys).agg(*measures)
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys,
                      *[c for c in out.columns if c != "w" and c not in keys])


def metric_counts(events: DataFrame, window: str = "1 hour") -> DataFrame:
    """All metric filters at once: events per window and filter."""
    named = events.select("timestamp", F.explode(metric_kind()).alias("metric"))
    return windowed(named, window, [F.count(F.lit(1)).alias("events")], ["metric"])


def alarm_windows(events: DataFrame, alarm: Alarm, metric: Column, keys: Sequence[str] = (), at: str = "timestamp"
                  ) -> DataFrame:
    """Statistic per window and whether it breaches; windows without data do not exist, hence do not breach."""
    measured = events.withColumn("_metric", metric)
    out = windowed(measured, alarm.window, [ALARM_STATS[alarm.statistic](F.col("_metric")).alias("value")], keys, at)
    return out.withColumn("breach", F.coalesce(OPERATORS[alarm.operator](F.col("value"), F.lit(alarm.threshold)),
                                               F.lit(False)))


def ratio_windows(events: DataFrame, numerator: Column, denominator: Column, alarm: Alarm, keys: Sequence[str] = (),
                  at: str = "timestamp") -> DataFrame:
    """Percentage of two counts per window, both from one pass."""
    part, whole = F.count_if(numerator), F.count_if(denominator)
    out = windowed(events, alarm.window, [F.try_divide(part * 100.0, whole).cast("double").alias("value")], keys, at)
    return out.withColumn("breach", F.coalesce(OPERATORS[alarm.operator](F.col("value"), F.lit(alarm.threshold)),
                                               F.lit(False)))


def consecutive(windows: DataFrame, periods: int, keys: Sequence[str] = ()) -> DataFrame:
    """Windows that complete ``periods`` breaching windows in a row.  A missing window breaks the row.  The frame holds
    one row per window and key, so a group is as long as the calendar, not as the log."""
    if periods == 1:
        return windows.where("breach")
    order = Window.partitionBy(*keys).orderBy("window_start")
    breaching = windows.where("breach")
    first = F.lag("window_start", periods - 1).over(order)
    span = (F.col("window_end").cast("double") - F.col("window_start").cast("double")) * (periods - 1)
    return breaching.withColumn("_first", first).where(
        F.col("window_start").cast("double") - F.col("_first").cast("double") == span).drop("_first")
