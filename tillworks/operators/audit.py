"""Audit entries, snapshot differences and reconciliation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.config import Config
from tillworks.operators.quality import corrupt_rows, throughput


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], columns: Sequence[str] | None = None
                  ) -> DataFrame:
    """One row per changed key: change_type INSERT / UPDATE / DELETE with the states before and after.

    Both snapshots are stacked and grouped once.  Repeated keys fold to their largest state in the map tasks, where a
    full outer join would pair every copy with every copy."""
    columns = list(columns or [c for c in new.columns if c not in keys])
    state = F.struct(*columns)

    def side(df: DataFrame, name: str) -> DataFrame:
        other = "after" if name == "before" else "before"
        empty = F.lit(None).cast(df.select(state.alias("s")).schema["s"].dataType)
        return df.select(*keys, state.alias(name), empty.alias(other)).select(*keys, "before", "after")

    pairs = side(old, "before").unionByName(side(new, "after")).groupBy(*keys).agg(
        F.max("before").alias("before"), F.max("after").alias("after"))
    change = (F.when(F.col("before").isNull(), "INSERT").when(F.col("after").isNull(), "DELETE")
              .when(~F.col("before").eqNullSafe(F.col("after")), "UPDATE"))
    return pairs.withColumn("change_type", change).where("change_type is not null")


def change_counts(diff: DataFrame) -> DataFrame:
    """Inserts, updates, deletes and their total."""
    def n(kind: str) -> Column:
        return F.count_if(F.col("change_type") == kind)

    out = diff.agg(n("INSERT").alias("inserts"), n("UPDATE").alias("updates"), n("DELETE").alias("deletes"))
    return out.withColumn("total_changes", F.col("inserts") + F.col("updates") + F.col("deletes"))


def _head(cfg: Config) -> dict[str, Column]:
    return {"timestamp": F.lit(cfg.executed_at).cast("timestamp"), "job_run_id": F.lit(cfg.run_id),
            "request_id": F.lit(cfg.run_id)}


def audit_events(diff: DataFrame, cfg: Config, table: str, keys: Sequence[str], operation: str = "MERGE",
                 metadata: Mapping[str, str] | None = None) -> DataFrame:
    """One audit entry per changed record.  Written as JSON, absent states and metadata leave no field."""
    record_id = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    meta = F.create_map(*[F.lit(x) for kv in metadata.items() for x in kv]) if metadata else \
        F.lit(None).cast("map<string,string>")
    return diff.select(*[c.alias(n) for n, c in _head(cfg).items()], "change_type", F.lit(table).alias("table_name"),
                       F.lit(operation).alias("operation"), record_id.alias("record_id"), "before", "after",
                       meta.alias("metadata"))


def audit_batch(events: DataFrame, cfg: Config, summary: Column | None = None) -> DataFrame:
    """One entry per batch: the changes by table, type and operation with their counts, a summary and the total.  The
    list holds one item per kind of change; the single changes stay rows of ``audit_events``."""
    kinds = events.groupBy("table_name", "change_type", "operation").agg(F.count(F.lit(1)).alias("record_count"))
    item = F.struct("change_type", "table_name", "operation", "record_count")
    out = kinds.agg(F.sort_array(F.collect_list(item)).alias("changes"),
                    F.coalesce(F.sum("record_count"), F.lit(0)).cast("bigint").alias("total_changes"))
    summary = F.lit(None).cast("map<string,string>") if summary is None else summary
    return out.select(*[c.alias(n) for n, c in _head(cfg).items()], F.lit("BATCH_AUDIT").alias("log_type"),
                      summary.alias("summary"), "changes", "total_changes")


def audit_summary(metrics: DataFrame, cfg: Config, source: str, target: str, duration_seconds: Column | None = None,
                  tables: Sequence[str] = ("curated_sales", "quarantine_sales", "error_sales")) -> DataFrame:
    """Summary entry of a run.  ``data_changes`` lists only tables that received rows."""
    written = [F.col("records_passed") + F.col("records_warned"), F.col("records_failed"),
               F.col("records_duplicates") + corrupt_rows(metrics)]
    changes = F.array(*[F.struct(F.lit("INSERT").alias("change_type"), F.lit(t).alias("table_name"),
                                 F.lit("BATCH_INSERT").alias("operation"), n.alias("record_count"))
                        for t, n in zip(tables, written, strict=True)])
    quality = F.struct("records_passed", "records_warned", "records_failed", "records_duplicates",
                       "records_anomalies", "avg_quality_score", "pass_rate")
    duration = F.lit(None).cast("double") if duration_seconds is None else duration_seconds
    issues = F.when(F.size("quality_issues") > 0, F.col("quality_issues"))
    return metrics.select(
        *[c.alias(n) for n, c in _head(cfg).items()], F.lit("ETL_AUDIT_SUMMARY").alias("log_type"),
        F.struct(F.lit(source).alias("path"), F.col("records_read").alias("records_count")).alias("source"),
        F.struct(F.lit(target).alias("path"), written[0].alias("records_count")).alias("target"),
        quality.alias("quality_metrics"),
        F.filter(changes, lambda x: x["record_count"] > 0).alias("data_changes"),
        duration.alias("duration_seconds"), issues.alias("quality_issues"))


def change_log(metrics: DataFrame, cfg: Config) -> DataFrame:
    """One entry per sink of a run that received rows: what was put where, and how many rows."""
    written = F.col("records_passed") + F.col("records_warned")
    sinks = [("error_sales", "MALFORMED", corrupt_rows(metrics)), ("error_sales", "DUPLICATE", F.col("records_duplicates")),
             ("quarantine_sales", "LOW_QUALITY", F.col("records_failed")),
             ("quarantine_sales", "ANOMALY", F.col("records_anomalies")), ("curated_sales", "CURATED", written)]
    items = F.array(*[F.struct(F.lit("INSERT").alias("change_type"), F.lit(t).alias("table_name"),
                               F.lit("BATCH_INSERT").alias("operation"), F.lit(why).alias("reason"),
                               n.cast("bigint").alias("record_count")) for t, why, n in sinks])
    return metrics.select(*[c.alias(n) for n, c in _head(cfg).items()], F.lit("DATA_CHANGE").alias("log_type"),
                          F.inline(F.filter(items, lambda x: x["record_count"] > 0)))


def job_metrics(metrics: DataFrame, cfg: Config, duration_seconds: float) -> DataFrame:
    """Duration, rows read and written and rows per second of a run."""
    seconds = F.lit(float(duration_seconds))
    written = F.col("records_passed") + F.col("records_warned")
    return metrics.select(*[c.alias(n) for n, c in _head(cfg).items()], F.lit(cfg.job_name).alias("job_name"),
                          seconds.alias("duration_seconds"), F.col("records_read"), written.alias("records_written"),
                          throughput(F.col("records_read"), seconds).alias("records_per_second"))


def reconcile(left: DataFrame, right: DataFrame, key: str, exact: Sequence[str], near: Sequence[str] = (),
              tolerance: str = "0.0001") -> DataFrame:
    """Two metric frames side by side, one row per run of either: counts must be equal, ratios may differ by the
    tolerance.  Each side must hold one row per key (see ``latest_state``)."""
    both = left.select(key, *[F.col(c).alias(f"l_{c}") for c in [*exact, *near]], F.lit(True).alias("_l")).join(
        right.select(key, *[F.col(c).alias(f"r_{c}") for c in [*exact, *near]], F.lit(True).alias("_r")),
        key, "full_outer")
    checks = {f"{c}_ok": F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in exact}
    limit = F.lit(tolerance).cast("decimal(10,6)")
    checks |= {f"{c}_ok": F.coalesce(F.abs(F.col(f"l_{c}") - F.col(f"r_{c}")) <= limit, F.lit(False)) for c in near}
    matched = F.col("_l").isNotNull() & F.col("_r").isNotNull()
    everything = matched
    for c in checks.values():
        everything = everything & c
    return both.select(key, matched.alias("in_both"), *[c.alias(n) for n, c in checks.items()],
                       everything.alias("reconciled"))
