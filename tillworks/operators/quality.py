"""Tiers, run counters, quality report, alerts and checks.

Counters weigh each folded row by the copies it stands for, so one aggregate over the folded table gives every number
of a run; nothing is counted twice or re-read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import Config
from tillworks.schema import ERRORS, FLAGS, LINEAGE, QUALITY_REPORT, QUARANTINE, SCORE

# Alert names.
LOW_SCORE = "QUALITY_SCORE_LOW"
HIGH_ERRORS = "ERROR_RATE_HIGH"
# Lower bounds of the rating of a period, and of the health band of a report.
RATING = [("0.95", "Excellent"), ("0.80", "Good"), ("0.70", "Acceptable")]
HEALTH = [("0.95", "excellent"), ("0.90", "good"), ("0.80", "acceptable")]


def mean(c: Column) -> Column:
    """Average as DOUBLE of an exact sum: the same digits on any engine and in any order of addition."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c))


def band(c: Column, bounds: Sequence[tuple[str, str]], otherwise: str, upper: bool = False) -> Column:
    """Label of the first boundary passed; boundaries are lower limits, or exclusive upper limits with ``upper``."""
    out = None
    for bound, label in bounds:
        limit = F.lit(bound).cast("decimal(18,4)")
        test = c < limit if upper else c >= limit
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise(otherwise)


def has_flag(c: Column, flag: str) -> Column:
    """Whole-flag test on the comma list."""
    return F.array_contains(F.split(c, ","), flag)


def tier(cfg: Config) -> Column:
    score = F.col("data_quality_score")
    return (F.when(score >= F.lit(cfg.pass_threshold), "pass")
             .when(score >= F.lit(cfg.warn_threshold), "warn").otherwise("fail"))


def is_anomaly(cfg: Config) -> Column:
    return ((F.col("revenue_usd") > F.lit(cfg.anomaly_revenue_max))
            | (F.col("item_sold") > F.lit(cfg.anomaly_items_max)))


def with_tier(df: DataFrame, cfg: Config) -> DataFrame:
    """``tier`` = pass / warn / fail and ``anomaly``; every sink filters on these."""
    return df.withColumns({"tier": tier(cfg), "anomaly": is_anomaly(cfg)})


def quarantine_rows(df: DataFrame, reason: str) -> DataFrame:
    names = [f.name for f in QUARANTINE if f.name != "quarantine_reason"]
    return df.select(F.lit(reason).alias("quarantine_reason"), *names)


def malformed_errors(corrupt: DataFrame, cfg: Config) -> DataFrame:
    return corrupt.select(F.lit("MALFORMED_CSV").alias("error_reason"), F.col("_corrupt_record").alias("raw_record"),
                          F.lit(cfg.executed_at).cast("timestamp").alias("error_timestamp")).to(ERRORS)


#: Prefix of the counter columns of single rules.
COUNTED = "n_"


def corrupt_rows(df: DataFrame) -> Column:
    """Rows of a run that could not be read as CSV; frames without the counter had none."""
    return F.coalesce(F.col("records_corrupt"), F.lit(0)) if "records_corrupt" in df.columns else F.lit(0)


def run_counters(df: DataFrame, rows: Column | None = None, kept: Column | None = None,
                 flag_names: Sequence[str] = FLAGS) -> DataFrame:
    """One row of counters over a tiered frame.  ``rows`` is how many input rows a row stands for, ``kept`` how many
    of them survive; both are 1 for a plain frame.  ``flag_names`` are the rules to count, own ones included."""
    rows = F.lit(1) if rows is None else rows
    kept = F.lit(1) if kept is None else kept

    def weigh(test: Column) -> Column:
        return F.coalesce(F.sum(F.when(test, kept)), F.lit(0)).cast("bigint")

    everything = F.lit(True)
    flags = F.col("quality_flags")
    return df.agg(
        F.coalesce(F.sum(rows), F.lit(0)).cast("bigint").alias("records_read"),
        weigh(everything).alias("records_distinct"),
        F.coalesce(F.sum(rows - kept), F.lit(0)).cast("bigint").alias("records_duplicates"),
        weigh(F.col("tier") == "pass").alias("records_passed"),
        weigh(F.col("tier") == "warn").alias("records_warned"),
        weigh(F.col("tier") == "fail").alias("records_failed"),
        weigh(F.col("anomaly")).alias("records_anomalies"),
        F.sum(F.col("data_quality_score") * kept).alias("score_sum"),
        F.min("data_quality_score").alias("min_quality_score"),
        F.max("data_quality_score").alias("max_quality_score"),
        *[weigh(has_flag(flags, f)).alias(f"{COUNTED}{f}") for f in flag_names],
    )


def derive_metrics(counters: DataFrame) -> DataFrame:
    """Rates and issue map of a counter row.  ``pass_rate`` and ``error_rate`` are over rows read, rows that are no CSV
    among the errors; ``tier_error_pct`` is over the sum of tiers and duplicates; a zero denominator gives 0."""
    def rate(part: Column, whole: Column) -> Column:
        return F.coalesce(F.round(F.try_divide(part.cast("decimal(20,0)"), whole.cast("decimal(20,0)")), 4),
                          F.lit(0)).cast("decimal(7,4)")

    bad = F.col("records_failed") + F.col("records_duplicates")
    classified = F.col("records_passed") + F.col("records_warned") + bad
    counted = [c for c in counters.columns if c.startswith(COUNTED)]
    issues = F.filter(F.array(*[F.struct(F.lit(c.removeprefix(COUNTED)).alias("key"), F.col(c).alias("value"))
                                for c in counted]), lambda x: x["value"] > 0)
    average = F.round(F.try_divide(F.col("score_sum"), F.col("records_distinct").cast("decimal(20,0)")), 4)
    return counters.withColumns({
        "quality_issues": F.map_from_entries(issues),
        "avg_quality_score": F.coalesce(average, F.lit(0)).cast(SCORE),
        "pass_rate": rate(F.col("records_passed"), F.col("records_read")).cast(SCORE),
        "error_rate": rate(bad + corrupt_rows(counters), F.col("records_read")),
        "tier_error_pct": rate(bad * 100, classified),
    }).drop("score_sum", *counted)


def issue_counts(df: DataFrame) -> DataFrame:
    """Rows per flag, all flags in one pass; flags that never occur are absent."""
    return (df.select(F.explode(F.split("quality_flags", ",")).alias("flag")).where("flag != ''")
            .groupBy("flag").agg(F.count(F.lit(1)).alias("records")))


def throughput(rows: Column, seconds: Column) -> Column:
    """Rows per second; runs under one second count as one."""
    return rows / F.greatest(seconds.cast("double"), F.lit(1.0))


def alerts(metrics: DataFrame, cfg: Config) -> DataFrame:
    """Fired alerts of a metric frame, one row each."""
    def alert(name: str, limit, actual: str, fired: Column) -> Column:
        return F.when(fired, F.struct(F.lit(name).alias("alert_type"),
                                      F.lit(limit).cast("decimal(7,4)").alias("threshold"),
                                      F.col(actual).cast("decimal(7,4)").alias("actual_value")))

    fired = F.array_compact(F.array(
        alert(LOW_SCORE, cfg.alert_min_score, "avg_quality_score",
              F.col("avg_quality_score") < F.lit(cfg.alert_min_score)),
        alert(HIGH_ERRORS, cfg.alert_max_error_rate, "error_rate",
              F.col("error_rate") > F.lit(cfg.alert_max_error_rate))))
    keep = [c for c in ("job_run_id",) if c in metrics.columns]
    return metrics.select(*keep, F.explode(fired).alias("a")).select(*keep, "a.*")


def quality_report(metrics: DataFrame, cfg: Config, source: str) -> DataFrame:
    """The one-row report of a run."""
    return metrics.withColumns({
        "job_run_id": F.lit(cfg.run_id),
        "execution_timestamp": F.lit(cfg.executed_at).cast("timestamp"),
        "source_file": F.lit(source),
        "total_records": F.col("records_read"),
        "records_corrupt": corrupt_rows(metrics),
        "transformation_version": F.lit(cfg.version),
    }).select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUALITY_REPORT])


def lineage(metrics: DataFrame, cfg: Config, source: str, target: str) -> DataFrame:
    out = metrics.select(
        F.lit(source).alias("source_file_path"),
        F.lit(target).alias("target_file_path"),
        F.lit(cfg.job_name).alias("job_name"),
        F.lit(cfg.run_id).alias("job_run_id"),
        F.lit(cfg.executed_at).cast("timestamp").alias("transformation_timestamp"),
        F.col("records_read").alias("records_in"),
        (F.col("records_passed") + F.col("records_warned")).alias("records_out"),
        (F.col("records_failed") + F.col("records_duplicates") + corrupt_rows(metrics)).alias("records_error"))
    return out.select(*[F.col(f.name).cast(f.dataType) for f in LINEAGE])


def change_metrics(inserts: Column, updates: Column, deletes: Column) -> Column:
    return F.struct(inserts.alias("inserts"), updates.alias("updates"), deletes.alias("deletes"),
                    (inserts + updates + deletes).alias("total_changes"))


def report_health(df: DataFrame) -> DataFrame:
    """Health band of each report: both the pass rate and the average score must reach the bound."""
    return df.withColumn("health", band(F.least("pass_rate", "avg_quality_score"), HEALTH, "poor"))


def validate_report(df: DataFrame, minimum: str = "0.95") -> DataFrame:
    """Report checks as columns: required fields, targets, issue map, and tiers that add up."""
    required = [f.name for f in QUALITY_REPORT if not f.nullable]
    present = F.lit(True)
    for name in required:
        present = present & (F.col(name).isNotNull() if name in df.columns else F.lit(False))
    limit = F.lit(minimum).cast(SCORE)
    sums = (F.col("records_passed") + F.col("records_warned") + F.col("records_failed")
            + F.col("records_duplicates") + corrupt_rows(df)) == F.col("total_records")
    return df.select("job_run_id", present.alias("has_required"),
                     (F.col("pass_rate") >= limit).alias("pass_rate_ok"),
                     (F.col("avg_quality_score") >= limit).alias("avg_score_ok"),
                     F.col("quality_issues").isNotNull().alias("issues_present"),
                     F.coalesce(sums, F.lit(False)).alias("tiers_add_up"))


def tier_totals_check(trends: DataFrame) -> DataFrame:
    """Periods of the quality trend whose tier counts do not add up or whose score leaves 0..1; empty when sound."""
    parts = F.col("high_quality_count") + F.col("medium_quality_count") + F.col("low_quality_count")
    return trends.withColumns({"tiers_ok": F.col("total_records") == parts,
                               "score_ok": F.col("avg_quality_score").between(0, 1)})
