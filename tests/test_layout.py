"""Retention, versions of a table and event sinks on folders."""

from dataclasses import replace
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tillworks.config import Config
from tillworks.operators import analytics as an
from tillworks.operators import audit
from tillworks.plans import retention
from tillworks.sources import folders, tables

CFG = Config(run_id="r1", as_of=date(2024, 6, 30))


def days(spark, path):
    return {(CFG.as_of - d).days for _, d in folders.dated(spark, path, "landing_date")}


@pytest.fixture()
def zone(spark, folder):
    rows = [(i, CFG.as_of - timedelta(days=d)) for i, d in enumerate([0, 30, 89, 90, 91, 200, 365, 366, 900])]
    spark.createDataFrame(rows, "id int, landing_date date").write.partitionBy("landing_date").parquet(f"{folder}/raw")
    return folder


def test_retention(spark, zone):
    assert retention.carry_out(spark, zone, ["raw", "error"], CFG) == 5
    assert days(spark, f"{zone}/raw") == {0, 30, 89, 90}
    assert days(spark, f"{zone}/{retention.ARCHIVE}/raw") == {91, 200, 365}
    assert spark.read.parquet(f"{zone}/{retention.ARCHIVE}/raw").count() == 3
    assert retention.unfinished(spark, zone).count() == 0
    assert retention.carry_out(spark, zone, ["raw", "error"], CFG) == 0
    later = replace(CFG, run_id="r2", as_of=CFG.as_of + timedelta(days=10))
    assert retention.carry_out(spark, zone, ["raw"], later) == 3  # 89 and 90 are archived, 365 expires there
    assert days(spark, f"{zone}/{retention.ARCHIVE}/raw") == {89, 90, 91, 200}
    done = retention.retention_log(spark, zone).where("state = 'done'")
    assert done.groupBy("run_id").count().orderBy("run_id").collect() == [("r1", 5), ("r2", 3)]


@pytest.mark.parametrize("next_run", ["r1", "r2"])
def test_retention_after_a_crash(spark, zone, monkeypatch, next_run):
    whole, count = retention._act, []

    def dies(*a):
        count.append(a)
        if len(count) == 3:
            raise RuntimeError("lost")
        whole(*a)

    monkeypatch.setattr(retention, "_act", dies)
    with pytest.raises(RuntimeError):
        retention.carry_out(spark, zone, ["raw"], CFG)
    assert retention.unfinished(spark, zone).count() == 5
    monkeypatch.setattr(retention, "_act", whole)
    assert retention.carry_out(spark, zone, ["raw"], replace(CFG, run_id=next_run)) == 5
    assert days(spark, f"{zone}/raw") == {0, 30, 89, 90} and days(spark, f"{zone}/{retention.ARCHIVE}/raw") == {91, 200, 365}
    assert retention.unfinished(spark, zone).count() == 0


def test_files_join_a_folder_that_exists(spark, folder):
    spark.range(2).write.parquet(f"{folder}/a")
    spark.range(3).write.parquet(f"{folder}/b")
    folders.delete(spark, f"{folder}/a/_SUCCESS")
    folders.delete(spark, f"{folder}/a/._SUCCESS.crc")
    folders.move(spark, f"{folder}/a", f"{folder}/b")
    folders.move(spark, f"{folder}/a", f"{folder}/b")
    assert spark.read.parquet(f"{folder}/b").count() == 5 and not folders.exists(spark, f"{folder}/a")


def test_readers_see_one_version(spark, folder):
    rows = spark.range(60).select("id", F.lit(2024).alias("year"), (F.col("id") % 3).cast("int").alias("month_num"))
    rows.repartition(5).write.partitionBy("year", "month_num").parquet(f"{folder}/one")
    tables.publish(spark, folder, "one")
    open_reader = tables.read_live(spark, folder)
    half = f"{folder}/half"  # a compaction that dies before it publishes
    tables.compact(spark, tables.live_folder(spark, folder), half)
    assert tables.live_folder(spark, folder) == f"{folder}/one"
    new = tables.compact_live(spark, folder)
    assert tables.live_folder(spark, folder) == f"{folder}/{new}"
    assert sorted(r.id for r in open_reader.collect()) == sorted(r.id for r in tables.read_live(spark, folder).collect()) == [*range(60)]
    assert tables.drop_versions(spark, folder) == [] and tables.drop_versions(spark, folder, keep=1) == ["one"]
    assert tables.read_live(spark, folder).count() == 60


def test_events_are_there_once(spark, folder):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(1, "x"), (3, "c")], "k int, v string")
    events = audit.audit_events(audit.snapshot_diff(old, new, ["k"]), CFG, "t", ["k"])
    for _ in range(2):  # a retry replaces its own part
        tables.write_events(events, folder, CFG, "t")
    tables.write_events(events.where("change_type = 'INSERT'"), folder, replace(CFG, run_id="r2"), "t")
    assert tables.read_events(spark, folder).count() == 4
    assert {(r.record_id, r.change_type) for r in tables.read_events(spark, folder, "t", "r1").collect()} == {
        ("1", "UPDATE"), ("2", "DELETE"), ("3", "INSERT")}
    assert tables.read_events(spark, folder, "other").count() == 0


def test_distinct_counts_copy_no_rows(spark):
    df = spark.createDataFrame([("a", 1, "x", 1), ("a", 1, "y", 2), ("a", None, "x", 3), (None, 2, "x", 4), (None, 3, None, 5)],
                               "k string, p int, s string, n int")
    out = an.grouped(df, ["k"], [F.sum("n").alias("n")], {"ps": "p", "ss": "s"})
    assert {tuple(r) for r in out.select("k", "n", "ps", "ss").collect()} == {("a", 6, 1, 2), (None, 9, 2, 1)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()
