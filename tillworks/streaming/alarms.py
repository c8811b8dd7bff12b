"""Windowed metrics and alarms over a log stream.

A window is written once, when the watermark passes its end.  The window table is partitioned by micro-batch and a
repeated batch overwrites its own folder, so a restart after a lost executor or driver changes nothing.

Alarms over several windows keep a counter per key in the state store (``consecutive_stream``): the end of the key's last
breaching window and how many breached in a row up to it.  Closed windows come from the aggregate of the same query, so
rows of the log stay in the JVM, and no window is read twice.  A timer drops a counter that no coming window can carry
on, so the state holds the keys that breached lately, not all keys ever seen.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tillworks.operators import logs
from tillworks.operators.logs import Alarm
from tillworks.session import share_code


def with_watermark(events: DataFrame, delay: str, at: str = "timestamp") -> DataFrame:
    return events.withWatermark(at, delay)


def write_windows(windows: DataFrame, path: str, checkpoint: str, wait: bool = True):
    """Append closed windows to a Parquet table; reads everything that has arrived, then stops.  A batch without windows
    leaves no file behind, so the columns come first, in a batch of their own without rows: a table of a quiet log can be read."""
    columns = T.StructType([T.StructField(f.name, f.dataType) for f in windows.schema])
    windows.sparkSession.createDataFrame([], columns).write.mode("ignore").parquet(f"{path}/batch_id=-1")

    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))

    query = (windows.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).foreachBatch(write).start())
    if wait:
        query.awaitTermination()
    return query


def stream_metric_counts(events: DataFrame, window: str, delay: str) -> DataFrame:
    return logs.metric_counts(with_watermark(events, delay), window)


def stream_alarm_windows(events: DataFrame, alarm: Alarm, metric: Column, delay: str, keys: Sequence[str] = (),
                         at: str = "timestamp") -> DataFrame:
    return logs.alarm_windows(with_watermark(events, delay, at), alarm, metric, keys, at)


def stream_ratio_windows(events: DataFrame, numerator: Column, denominator: Column, alarm: Alarm, delay: str,
                         at: str = "timestamp") -> DataFrame:
    return logs.ratio_windows(with_watermark(events, delay, at), numerator, denominator, alarm, (), at)


class BreachCounter(StatefulProcessor):
    """Breaching windows in a row of one key.  Windows come closed and, for a key, batch after batch in order of time."""

    STATE = "until bigint, n int"

    def __init__(self, periods: int, fields: Sequence[str]):
        self.periods, self.fields = periods, list(fields)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.row = handle.getValueState("row", self.STATE)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        until, n = self.row.get() if self.row.exists() else (None, 0)
        before = until
        for r in sorted(rows, key=lambda r: r["_start"]):
            if not r["breach"]:
                continue  # its end does not become ``until``, so the next window starts a new row
            n = n + 1 if until == r["_start"] else 1
            until = r["_end"]
            if n >= self.periods:
                yield Row(**{f: r[f] for f in self.fields})
        if until != before:
            if before is not None:
                self.handle.deleteTimer(self._expiry(before))
            self.row.update((until, n))
            self.handle.registerTimer(self._expiry(until))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """The watermark has passed the window that could carry on: it was closed in an earlier batch or does not exist."""
        self.row.clear()
        return iter(())

    def close(self) -> None:
        pass

    def _expiry(self, until: int) -> int:
        return until // 1000 + self.width_ms

    width_ms = 0


def consecutive_stream(windows: DataFrame, alarm: Alarm, keys: Sequence[str] = ()) -> DataFrame:
    """Closed windows (window_start, window_end, keys, value, breach) that complete ``alarm.periods`` breaching windows in a row, as
    a stream: the counter of a key is state, kept in the checkpoint across restarts."""
    use_keyed_state(windows.sparkSession)
    if alarm.periods == 1:
        return windows.where("breach")
    marked = windows.withColumns({"_start": F.unix_micros("window_start"), "_end": F.unix_micros("window_end"),
                                  "_all": F.lit(0)})
    fields = [f.name for f in marked.schema.fields if f.name not in ("window_start", "window_end", "_all")]
    schema = T.StructType([T.StructField(f, marked.schema[f].dataType) for f in fields])
    counter = BreachCounter(alarm.periods, fields)
    # a timer fires in the batch whose watermark passes it; the next window closes at twice the width after ``until`` at the latest
    counter.width_ms = 2 * window_ms(windows.sparkSession, alarm.window)
    fired_rows = marked.groupBy(*(keys or ["_all"])).transformWithState(counter, schema, "append", "eventTime")
    back = [F.timestamp_micros(c).alias(n) for c, n in (("_start", "window_start"), ("_end", "window_end"))]
    return fired_rows.select(*back, *[f for f in fields if f not in ("_start", "_end")])


def window_ms(spark: SparkSession, window: str) -> int:
    """Length of a window in milliseconds."""
    second = spark.range(1).select(F.timestamp_seconds(F.lit(0)).alias("t"))
    return second.select(F.unix_millis(F.col("t") + F.expr(f"interval {window}"))).first()[0]


def use_keyed_state(spark: SparkSession) -> None:
    """Keyed state with timers needs the RocksDB store, and Python workers that know this module."""
    share_code(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def fired(spark, path: str, alarm: Alarm, keys: Sequence[str] = (), since: datetime | None = None) -> DataFrame:
    """Alarms of the window table written so far; with ``since`` those of windows from then on, for which only the windows
    that can complete them are read."""
    windows = spark.read.parquet(path).drop("batch_id")
    if since is None:
        return logs.consecutive(windows, alarm.periods, keys)
    back = F.expr(f"interval {alarm.window}") * F.lit(alarm.periods - 1)
    recent = windows.where(F.col("window_start") >= F.lit(since) - back)
    return logs.consecutive(recent, alarm.periods, keys).where(F.col("window_start") >= F.lit(since))


def late_rows(batch: DataFrame, newest_before: DataFrame, delay: str, at: str = "timestamp") -> DataFrame:
    """Rows of a micro-batch older than the newest event of earlier batches minus the delay: the rows a watermark would
    drop, for a side table.  ``newest_before`` holds the maximum kept per batch (column ``newest``)."""
    limit = newest_before.agg(F.max("newest") - F.expr(f"interval {delay}")).scalar()
    return batch.where(F.coalesce(F.col(at) < limit, F.lit(False)))


def run_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
             .foreachBatch(handle).start())
    query.awaitTermination()
