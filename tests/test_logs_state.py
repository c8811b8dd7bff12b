import json
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tillworks.operators import audit, logs, state
from tillworks.operators.analytics import partition_gaps, top_k_per
from tillworks.operators.logs import Alarm
from tillworks.sources.events import read_events, stream_events
from tillworks.streaming import alarms

T0 = datetime(2024, 1, 1)


def write_log(path, rows):
    with open(path, "w") as f:
        for minutes, kind, details in rows:
            f.write(json.dumps({"timestamp": (T0 + timedelta(minutes=minutes)).isoformat(), "level": "INFO",
                                "job_run_id": "r", "event_type": kind, "details": details}) + "\n")
        f.write("not a log line\n")


def test_scan_and_alarm_stream_equal_batch(spark, folder, tmp_path):
    (tmp_path / "log").mkdir()
    values = [50, 10, 50, 50, 50, 10, 50, 50, 50, 50]
    rows = [(5 * i + 1, "JOB_SUMMARY", {"duration_seconds": v}) for i, v in enumerate(values) if i != 2]
    write_log(tmp_path / "log" / "a.json", [*rows, (500, "ETL_STEP", {"step_name": "end"})])
    alarm = Alarm("slow", "avg", ">", 30, "5 minutes", 3)
    seconds = F.col("details.duration_seconds")
    events = read_events(spark, str(tmp_path / "log"))
    assert events.count() == 10
    batch = logs.consecutive(logs.alarm_windows(logs.of_type(events, "JOB_SUMMARY"), alarm, seconds), 3)
    want = [T0 + timedelta(minutes=5 * i) for i in (8, 9)]  # the missing window and the low one break the row
    assert sorted(r.window_start for r in batch.collect()) == want
    live = stream_events(spark, str(tmp_path / "log"))
    windows = alarms.stream_alarm_windows(live, alarm, seconds, "1 minute")
    for _ in range(2):  # a restart writes nothing twice
        alarms.write_windows(windows, f"{folder}/w", f"{folder}/c")
    assert sorted(r.window_start for r in alarms.fired(spark, f"{folder}/w", alarm).collect()) == want


def test_late_rows(spark):
    batch = spark.createDataFrame([(T0,), (T0 + timedelta(hours=2),)], "timestamp timestamp")
    newest = spark.createDataFrame([(T0 + timedelta(hours=2),)], "newest timestamp")
    assert alarms.late_rows(batch, newest, "1 hour").count() == 1


def test_latest_and_merged_state(spark):
    df = spark.createDataFrame([("a", 1, "processing", "u"), ("a", 2, "completed", None), ("b", 1, "processing", "v")],
                               "id string, t int, status string, user string")
    latest = {r.id: (r.status, r.user) for r in state.latest_state(df, ["id"], ["t"]).collect()}
    assert latest == {"a": ("completed", None), "b": ("processing", "v")}
    merged = {r.id: (r.status, r.user) for r in state.merged_state(df, ["id"], ["t"]).collect()}
    assert merged == {"a": ("completed", "u"), "b": ("processing", "v")}


def test_snapshot_diff_with_copies(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "a"), (2, "x"), (4, "d")], "k int, v string")
    diff = audit.snapshot_diff(old.union(old), new.union(new), ["k"])
    assert {(r.k, r.change_type) for r in diff.collect()} == {(2, "UPDATE"), (3, "DELETE"), (4, "INSERT")}
    counts = audit.change_counts(diff).first()
    assert (counts.inserts, counts.updates, counts.deletes, counts.total_changes) == (1, 1, 1, 3)


def test_rank_keeps_all_ties_of_a_large_group(spark):
    df = spark.range(3000).select(F.lit("x").alias("k"), F.when(F.col("id") < 1000, 9).otherwise(
        F.col("id") % 5).alias("v"), "id")
    got = top_k_per(df, ["k"], [("v", "desc")], 5, method="rank")
    assert got.count() == 1000 and got.agg(F.max("revenue_rank")).first()[0] == 1
    got = top_k_per(df, ["k"], [("v", "desc")], 1001, method="rank")
    assert got.count() == 1400


def test_gaps(spark):
    df = spark.createDataFrame([(2024, 11), (2025, 2), (None, None)], "year int, month_num int")
    assert sorted((r.year, r.month_num) for r in partition_gaps(df).collect()) == [(2024, 12), (2025, 1)]


def test_recent_alarms_are_those_of_the_whole_table(spark, folder):
    from datetime import datetime, timedelta

    from tillworks.operators.logs import Alarm
    from tillworks.streaming import alarms
    start = datetime(2024, 1, 1)
    rows = [(start + timedelta(hours=i), start + timedelta(hours=i + 1), 1.0, i % 7 != 0, i // 5) for i in range(60)]
    spark.createDataFrame(rows, "window_start timestamp, window_end timestamp, value double, breach boolean, batch_id int"
                          ).write.partitionBy("batch_id").parquet(f"{folder}/w")
    alarm = Alarm("x", "avg", ">", 0, "1 hour", 3)
    everything = {r.window_start for r in alarms.fired(spark, f"{folder}/w", alarm).collect()}
    for hours in (0, 9, 30, 59):
        since = start + timedelta(hours=hours)
        got = {r.window_start for r in alarms.fired(spark, f"{folder}/w", alarm, since=since).collect()}
        assert got == {t for t in everything if t >= since} and everything


def _put(spark, folder, n, rows):
    spark.createDataFrame(rows, "timestamp timestamp, host string, k double").coalesce(1).write.parquet(f"{folder}/in/part={n}")


def _fired(spark, folder, alarm, table="out"):
    rows = spark.readStream.schema("timestamp timestamp, host string, k double").option("recursiveFileLookup", "true").parquet(
        f"{folder}/in")
    windows = alarms.stream_alarm_windows(rows, alarm, F.col("k"), "5 minutes", ["host"])
    alarms.write_windows(alarms.consecutive_stream(windows, alarm, ["host"]), f"{folder}/{table}", f"{folder}/checkpoint")
    return sorted((r.host, int((r.window_start - T0).total_seconds() // 600)) for r in spark.read.schema(
        "window_start timestamp, host string").parquet(f"{folder}/{table}").collect())


def test_counters_outlive_restarts_and_late_rows(spark, folder):
    """Three breaching windows in a row that arrive in three runs; a late row changes no window and no counter."""
    from tillworks.operators.logs import Alarm
    alarm = Alarm("busy", "max", ">", 10, "10 minutes", 3)

    def rows(host, *windows, k=20.0):
        return [(T0 + timedelta(minutes=10 * w + 1), host, k) for w in windows]

    _put(spark, folder, 0, rows("a", 0, 1) + rows("b", 0, 2) + rows("c", 0, 1, 2, 3) + rows("d", 0, 1) + rows("d", 2, k=1.0) + rows("z", 4))
    assert _fired(spark, folder, alarm) == [("c", 2)]  # window 3 is still open
    _put(spark, folder, 1, rows("a", 2) + rows("b", 3, 4) + rows("c", 9) + rows("d", 3, 4))
    assert _fired(spark, folder, alarm) == [("b", 4), ("c", 2), ("c", 3)]  # a's third window is late
    _put(spark, folder, 2, rows("c", 10, 11, 12, k=30.0) + rows("b", 5) + rows("a", 10, 11, 12) + rows("z", 14))
    assert _fired(spark, folder, alarm) == [("a", 12), ("b", 4), ("c", 2), ("c", 3), ("c", 11), ("c", 12)]  # b's sixth is late


def test_counters_equal_the_batch_form(spark, folder):
    import random

    from tillworks.operators import logs
    from tillworks.operators.logs import Alarm
    rng = random.Random(3)
    alarm = Alarm("busy", "max", ">", 10, "10 minutes", 2)
    for part in range(3):
        _put(spark, folder, part, [(T0 + timedelta(minutes=300 * part + rng.randrange(300)), rng.choice("xyz"), rng.choice([1.0, 20.0]))
                                   for _ in range(120)])
    _put(spark, folder, 3, [(T0 + timedelta(days=2), "end", 1.0)])
    got = _fired(spark, folder, alarm)
    events = spark.read.option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    want = logs.consecutive(logs.alarm_windows(events, alarm, F.col("k"), ["host"]), 2, ["host"]).collect()
    assert got == sorted((r.host, int((r.window_start - T0).total_seconds() // 600)) for r in want) and len(got) > 20


def test_quiet_log_gives_an_empty_table(spark, folder):
    from queries.logs import st2b, st3b, st3c
    rows = [(i, T0 + timedelta(minutes=20 * i), 1, "view", 1.0, '{"k": 10}') for i in range(30)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(
        1).write.parquet(f"{folder}/events.parquet")
    for query, columns in ((st3b, []), (st3c, ["event_type"]), (st2b, [])):  # no three windows in a row, no error at all
        found = query(spark, folder)
        assert found.columns == ["window_start", "window_end", *columns, "value"] and found.collect() == []
