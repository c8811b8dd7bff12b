import os
from dataclasses import replace
from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillworks import Config
from tillworks.functions import bits
from tillworks.operators import analytics, cleaning, dedup, quality
from tillworks.plans import load as plan
from tillworks.schema import CURATED, DEDUP_KEYS, RAW_COLUMNS
from tillworks.sources import raw, tables
from tillworks.streaming.ingest import ingest_incremental

HEADER = ",".join(RAW_COLUMNS)
CFG = Config(run_id="r1", as_of=date(2024, 5, 1), executed_at=datetime(2024, 5, 1, 2))

MALFORMED = """4/01/2024,1.72938E+18,Brush,Shop A,Care,Hair,Combs,"24,157","$305,785.10",$12.66,-42%
invalid-date,bad-id,Product with Issues,,,,,-100,$-50.00,$0.00,5000%
,,,Shop only,,,,,,,
4/01/2024,9.87654E+17,Copy,Shop B,Care,Makeup,Tools,100,$1000.00,$10.00,5%
4/01/2024,9.87654E+17,Copy,Shop B,Care,Makeup,Tools,100,$1000.00,$10.00,5%"""


def land(folder, day, body, name=None):
    path = f"{folder}/landing/{day:%Y/%m/%d}"
    os.makedirs(path, exist_ok=True)
    with open(f"{path}/{name or f'sales_{day:%Y%m%d}.csv'}", "w") as f:
        f.write(f"{HEADER}\n{body}\n")
    return f"{folder}/landing"


def numbered(first, n, month="1/19/2026"):
    return "\n".join(f'{month},{first + i},Item {i},Shop {(first + i) % 3},L1,L2,L3,"1,00{i % 10}","$2,000.00 ",$2.0 ,{i}%'
                     for i in range(n))


@pytest.mark.parametrize(("strict", "average"), [(True, "0.6250"), (False, "0.6125")])
def test_malformed_file(spark, folder, strict, average):
    source = land(folder, date(2024, 4, 1), MALFORMED)
    got = plan.run(spark, source, f"{folder}/out", replace(CFG, strict_reference=strict))
    m = got.metrics
    assert (m.records_read, m.records_duplicates, m.records_passed, m.records_warned, m.records_failed,
            m.records_anomalies) == (5, 1, 2, 0, 2, 0)
    assert m.pass_rate == Decimal("0.4") and m.avg_quality_score == Decimal(average)
    issues = {"INVALID_DATE": 2, "SYNTHETIC_PRODUCT_ID": 2, "MISSING_PRODUCT_NAME": 1, "INVALID_REVENUE": 2,
              "INVALID_AVG_PRICE": 1, "MISSING_ITEMS": 2}
    assert m.quality_issues == (issues if strict else issues | {"SUSPICIOUS_GROWTH": 1})
    assert [a.alert_type for a in got.alerts] == ["QUALITY_SCORE_LOW", "ERROR_RATE_HIGH"]
    curated = tables.read_table(spark, f"{folder}/out", "curated_sales")
    assert {r.product_id for r in curated.collect()} == {1729380000000000000, 987654000000000000}
    assert [f.name for f in curated.drop("run_id").schema] == [f.name for f in CURATED]
    errors = tables.read_table(spark, f"{folder}/out", "error_sales").collect()
    assert [e.raw_record for e in errors] == ["product_id=987654000000000000, month=2024-04-01, shop_name=Shop B"]
    low = {r.data_quality_score for r in tables.read_table(spark, f"{folder}/out", "quarantine_sales").collect()}
    assert low == {Decimal("0.40") if strict else Decimal("0.35"), Decimal("0.10")}
    line = tables.read_table(spark, f"{folder}/out", "transformation_lineage").first()
    assert (line.records_in, line.records_out, line.records_error) == (5, 2, 3)


def test_rerun_replaces_its_rows_and_corrupt_rows_are_kept(spark, folder):
    body = MALFORMED + "\nmalformed row with missing columns\n4/01/2024,1,729,too,many,a,b,c,1,$2,$3,4%,5"
    source = land(folder, date(2024, 4, 1), body)
    for _ in range(2):
        got = plan.run(spark, source, f"{folder}/out", CFG)
    m = got.metrics
    assert (m.records_read, m.records_corrupt) == (7, 2)
    assert m.records_read == (m.records_corrupt + m.records_duplicates + m.records_passed + m.records_warned
                              + m.records_failed)
    reasons = [r.error_reason for r in tables.read_table(spark, f"{folder}/out", "error_sales").collect()]
    assert sorted(reasons) == ["DUPLICATE_RECORD", "MALFORMED_CSV", "MALFORMED_CSV"]
    assert tables.read_table(spark, f"{folder}/out", "curated_sales").count() == 2


@pytest.mark.parametrize(("legacy", "kept"), [(False, 80), (True, 3)])
def test_long_ids(spark, folder, legacy, kept):
    # 80 neighbouring 19-digit ids inside one block of 256: as DOUBLE all are one number, told apart by shop only
    source = land(folder, date(2026, 1, 19), numbered(1729383941730701600, 80))
    m = plan.run(spark, source, f"{folder}/out", replace(CFG, legacy_float_ids=legacy)).metrics
    assert m.records_read == 80
    if legacy:
        ids = {int(float(1729383941730701600 + i)) for i in range(80)}
        kept = len({(int(float(1729383941730701600 + i)), (1729383941730701600 + i) % 3) for i in range(80)})
        assert len(ids) < 3
    assert m.records_distinct == kept


def test_incremental_ingest_takes_each_file_once(spark, folder):
    source = land(folder, date(2026, 1, 19), numbered(1000, 10))
    args = (spark, source, f"{folder}/out", f"{folder}/checkpoint", replace(CFG, run_id="s"))
    ingest_incremental(*args)
    ingest_incremental(*args)
    assert tables.read_curated(spark, f"{folder}/out").count() == 10
    land(folder, date(2026, 1, 20), numbered(1005, 10))  # five known keys, five new ones
    ingest_incremental(*args)
    assert tables.read_curated(spark, f"{folder}/out").count() == 15


def test_backfill_of_a_range_and_rows_without_id(spark, folder):
    blank = "\n".join(["1/5/2026,,Nameless,Shop,L1,L2,L3,5,$2.00,$2.00,1%"] * 4)
    source = land(folder, date(2026, 1, 5), blank)
    land(folder, date(2026, 2, 5), numbered(1, 3))
    first = plan.backfill(spark, source, f"{folder}/out", replace(CFG, run_id="a"), date(2026, 1, 1), date(2026, 1, 31))
    assert first.metrics.records_warned == 4  # equal rows without id stay apart
    again = plan.backfill(spark, source, f"{folder}/out", replace(CFG, run_id="b"), date(2026, 1, 1), date(2026, 2, 28))
    assert again.metrics.records_known == 4 and again.metrics.records_read == 3
    ids = [r.product_id for r in tables.read_curated(spark, f"{folder}/out").collect()]
    assert len(ids) == len(set(ids)) == 7
    assert plan.backfill(spark, source, f"{folder}/out", CFG, date(2030, 1, 1), date(2030, 1, 2)) is None


def test_path_check(spark, folder):
    source = land(folder, date(2026, 1, 5), numbered(1, 1))
    land(folder, date(2026, 1, 6), numbered(1, 1), name="sales_20260107.csv")
    bad = plan.check_paths(spark, source).collect()
    assert len(bad) == 1 and bad[0].source_file.endswith("/2026/01/06/sales_20260107.csv")


def test_hot_keys_fold_exactly(spark, monkeypatch):
    """A third of all rows share one key, a third have no id and equal content; chunks are cut small on purpose."""
    monkeypatch.setattr(dedup.repeat_rows, "__defaults__", (7,))
    rows = [("f", f"k{i % 50:02d}", 1 if i < 1000 else None if i < 2000 else i, date(2024, 1, 1), "s")
            for i in range(3000)]
    rows += [("f", "same", None, None, None)] * 500
    df = spark.createDataFrame(rows, "source_file string, record_key string, product_id long, month date, shop_name string")
    folded = dedup.fold_copies(df)
    kept, extra = dedup.kept_rows(folded), dedup.duplicate_keys(folded)
    assert kept.count() == 1 + 1000 + 1000 + 500
    assert kept.select("product_id").distinct().count() == 2501
    assert extra.count() == 999 and extra.distinct().count() == 1
    assert kept.where("product_id = 1").first().record_key == "k00"


def test_dedup_is_idempotent_and_matches_a_window(spark):
    df = spark.range(2000).select((F.col("id") % 300).alias("k"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    kept, extra = dedup.dedup(df, ["k"], ["o"])
    best = {}
    for r in df.collect():
        best[r.k] = min(best.get(r.k, (r.o, r.v)), (r.o, r.v))
    assert {(r.k, r.o, r.v) for r in kept.collect()} == {(k, *b) for k, b in best.items()}
    assert extra.count() == 1700
    assert dedup.dedup(kept, ["k"], ["o"])[1].count() == 0


def test_fold_of_a_stored_table_equals_the_fold_of_all_rows(spark, folder):
    """Copies of NULL keys, ties in the order, equal rows; a set of 16 bits, in which most keys are taken for repeated."""
    df = spark.range(4000).select(
        F.when(F.col("id") % 7 > 0, F.when(F.col("id") < 1300, 1).otherwise(F.col("id") % 2500)).alias("k"),
        F.when(F.col("id") % 3 > 0, F.lit("s")).alias("s"), (F.col("id") % 2).alias("o"), F.lit("v").alias("v"))
    df.write.parquet(f"{folder}/t")
    rows = spark.read.parquet(f"{folder}/t")
    whole = dedup.first_per_key(rows, ["k", "s"], ["o"])
    narrow = dedup.first_per_key(rows, ["k", "s"], ["o"], stored=True)
    assert narrow.schema == whole.schema and sorted(map(str, narrow.collect())) == sorted(map(str, whole.collect()))
    assert dedup.first_per_key(rows.where("k < 0"), ["k"], ["o"], stored=True).count() == 0
    kept, extra = dedup.dedup(rows, ["k", "s"], ["o"], stored=True)
    assert kept.count() + extra.count() == 4000
    found = bits.bit_set(rows.select(F.xxhash64("k").alias("h")).where("h % 3 = 0"), "h", 16)
    sure = bits.maybe_in(rows, F.xxhash64("k"), found, "may", 16).where("not may")
    assert sure.where(F.xxhash64("k") % 3 == 0).count() == 0


def test_rows_without_copies_are_not_shuffled(spark, folder):
    spark.range(1000).select("id", F.lit("v").alias("v"), F.lit(1).alias("o")).write.parquet(f"{folder}/t")
    rows = spark.read.parquet(f"{folder}/t")
    alone = bits.maybe_in(rows, F.xxhash64("id"), dedup.repeated_hashes(rows, ["id"]), "again").where("not again")
    probe, counting = plan_of(alone).split("BroadcastExchange", 1)
    assert "Exchange" not in probe and "Sort" not in probe
    assert "HashAggregate(keys=[_hash" in counting and "ReadSchema: struct<id:bigint>" in counting
    assert alone.count() == 1000


def test_new_keys_sees_null_keys_and_reads_only_touched_months(spark, folder):
    old = spark.createDataFrame([(1, date(2024, 1, 5), "s", 2024, 1, "r0"), (2, None, None, None, None, "r0"),
                                 (9, date(2023, 1, 5), "s", 2023, 1, "r0")],
                                "product_id long, month date, shop_name string, year int, month_num int, run_id string")
    old.write.partitionBy("year", "month_num").parquet(f"{folder}/t")
    stored = spark.read.parquet(f"{folder}/t")
    fresh = spark.createDataFrame([(1, date(2024, 1, 5), "s", 2024, 1), (2, None, None, None, None),
                                   (3, None, None, None, None)], old.drop("run_id").schema)
    left = dedup.new_keys(fresh, stored)
    assert [r.product_id for r in left.collect()] == [3]
    assert dedup.new_keys(fresh, stored, own_run="r0").count() == 3
    assert "PartitionFilters: [" in left._jdf.queryExecution().executedPlan().toString()


def test_score_is_one_minus_the_penalties_of_its_flags(spark):
    from tillworks.schema import PENALTIES
    rows = [tuple("" if (n >> i) & 1 else good for i, good in enumerate(
        ["1/2/2024", "7", "name", "$1.00", "$2.00", "3"])) + ("5000%" if n >> 6 & 1 else "5%",) for n in range(128)]
    names = ["month_raw", "product_id_raw", "product_name_raw", "revenue_raw", "avg_unit_price_raw", "item_sold_raw",
             "mom_growth_raw"]
    out = cleaning.clean(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), CFG)
    got = quality.with_tier(out.withColumn("revenue_usd", F.col("revenue_usd")), CFG).collect()
    assert len({r.quality_flags for r in got}) == 128
    for r in got:
        score = 1 - sum((PENALTIES[f] for f in r.quality_flags.split(",") if f), Decimal(0))
        assert r.data_quality_score == score
        assert r.tier == ("pass" if score >= Decimal("0.95") else "warn" if score >= Decimal("0.70") else "fail")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, folder):
    source = land(folder, date(2024, 4, 1), MALFORMED)
    df = plan.clean_landing(raw.read_raw(spark, source), CFG)
    text = plan_of(dedup.fold_copies(df))
    assert "Python" not in text and "ArrowEval" not in text
    assert text.count("Exchange hashpartitioning") == 1
    rows = spark.createDataFrame([(1, "n", "s", "c", 2.0, 0.1, 3, Decimal("1.0"), 2024, 1)],
                                 "product_id long, product_name string, shop_name string, l2_category string, "
                                 "revenue_usd double, mom_growth_pct double, item_sold int, "
                                 "data_quality_score decimal(5,4), year int, month_num int")
    rows.write.partitionBy("year", "month_num").parquet(f"{folder}/t")
    stored = spark.read.parquet(f"{folder}/t")
    top = plan_of(analytics.top_products(stored, "c"))
    assert "dynamicpruning" in top and "PushedFilters: [IsNotNull(data_quality_score)" in top
    per = plan_of(analytics.top_k_per(stored, ["l2_category"], [("revenue_usd", "desc"), ("product_id", "asc")], 3))
    assert per.count("WindowGroupLimit") == 2  # groups are cut before the shuffle as well


def test_generator_is_reproducible(spark):
    from tillworks.sources.generator import generate_sales
    days = [date(2026, 1, 1), date(2026, 2, 1)]
    a, b = (generate_sales(spark, days, ["Skincare", "Pet Food", "Empty "], skip=["empty"]) for _ in range(2))
    assert a.count() == 2 * 2 * 8 and a.exceptAll(b).isEmpty()
    cleaned = cleaning.clean(a, CFG)
    assert cleaned.where("quality_flags != ''").isEmpty() and cleaned.select(*DEDUP_KEYS).distinct().count() == 32


def test_calendar_bounds_reach_the_partitions(spark, folder):
    rows = [(i, "n", "s", "c", "f", 1.0, -0.5, 3, "1.0", "MISSING_ITEMS", date(2024, m, 2), 2024, m)
            for i, m in enumerate(range(1, 13))]
    names = ("product_id long, product_name string, shop_name string, l2_category string, source_file string, "
             "revenue_usd double, mom_growth_pct double, item_sold int, data_quality_score string, quality_flags string, "
             "month date, year int, month_num int")
    df = spark.createDataFrame(rows, names).withColumn("data_quality_score", F.col("data_quality_score").cast("decimal(5,4)"))
    df.write.partitionBy("year", "month_num").parquet(f"{folder}/t")
    stored = spark.read.parquet(f"{folder}/t")
    cfg = replace(CFG, as_of=date(2024, 12, 31))
    for got, n in ((analytics.since(stored, cfg, months=2), 2), (analytics.since(stored, cfg, days=3), 0),
                   (analytics.declining(stored, cfg, "-0.2", 3), 3),
                   (analytics.flag_drilldown(stored, "MISSING_ITEMS", ["month"], "2024-06-01"), 7),
                   (analytics.current_and_previous_month(stored, cfg), 2)):
        text = plan_of(got)
        assert "PartitionFilters: [isnotnull(year" in text or "(year#" in text.split("PartitionFilters: [")[1].split("]")[0]
        assert got.count() == n
    listing = tables.partitions(spark, f"{folder}/t")
    newest = analytics.latest_partition(listing)
    assert newest.collect() == [(2024, 12)]
    assert "binaryFile" in plan_of(newest) and "ReadSchema: struct<>" in plan_of(newest)
    assert analytics.in_latest_partition(stored, listing).count() == 1


def test_own_rules_count_and_weigh(spark, folder):
    source = land(folder, date(2026, 1, 19), numbered(1000, 9))
    rule = cleaning.Rule("SHOP_ON_WATCH", F.col("shop_name") == "Shop 1", Decimal("0.40"))
    got = plan.run(spark, source, f"{folder}/out", CFG, own_rules=[rule])
    assert got.metrics.quality_issues == {"SHOP_ON_WATCH": 3}
    assert (got.metrics.records_passed, got.metrics.records_failed) == (6, 3)
    low = tables.read_published(spark, f"{folder}/out", "quarantine_sales").collect()
    assert {(r.quality_flags, r.data_quality_score) for r in low} == {("SHOP_ON_WATCH", Decimal("0.60"))}


def test_unfinished_runs_stay_unseen(spark, folder):
    source = land(folder, date(2026, 1, 19), numbered(1000, 5))
    plan.run(spark, source, f"{folder}/out", CFG)
    whole = tables.read_table(spark, f"{folder}/out", "curated_sales")
    tables.write_curated(whole.drop("run_id"), f"{folder}/out", replace(CFG, run_id="half"))
    assert tables.read_table(spark, f"{folder}/out", "curated_sales").count() == 10
    seen = tables.read_curated(spark, f"{folder}/out")
    assert seen.count() == 5
    names = plan.views(seen)
    assert spark.table("vw_quality_dashboard").count() == 1 and len(names) == 6
    # what only the broken run wrote is not known to a later one
    later = plan.load(spark, raw.read_raw(spark, source), f"{folder}/out", replace(CFG, run_id="next"), incremental=True)
    assert later.metrics.records_known == 5


def test_logs_of_a_run(spark, folder):
    source = land(folder, date(2024, 4, 1), MALFORMED + "\nno row")
    plan.run(spark, source, f"{folder}/out", CFG)
    log = {(r.table_name, r.reason): r.record_count for r in spark.read.json(f"{folder}/out/change-logs").collect()}
    assert log == {("error_sales", "MALFORMED"): 1, ("error_sales", "DUPLICATE"): 1, ("quarantine_sales", "LOW_QUALITY"): 2,
                   ("curated_sales", "CURATED"): 2}
    took = spark.read.json(f"{folder}/out/job-metrics").first()
    assert took.duration_seconds > 0 and (took.records_read, took.records_written) == (6, 2)
    line = tables.read_table(spark, f"{folder}/out", "transformation_lineage").first()
    assert (line.records_in, line.records_out, line.records_error) == (6, 2, 4)
    assert quality.validate_report(tables.read_table(spark, f"{folder}/out", "data_quality_metrics")).first().tiers_add_up


def test_discovery_updates_the_catalog(spark, folder):
    name = f"found_{os.path.basename(folder).replace('-', '_')}"
    path = f"{folder}/t"
    spark.range(3).selectExpr("id", "1 AS part").write.partitionBy("part").option("path", path).saveAsTable(name)
    spark.range(2).selectExpr("id", "'x' AS extra", "2 AS part").write.mode("append").partitionBy("part").parquet(path)
    diff = tables.discover(spark, path, spark.table(name).schema, "UPDATE", name)
    assert [(r.column_name, r.change) for r in diff.collect()] == [("extra", "added")]
    spark.catalog.refreshTable(name)
    assert spark.table(name).where("extra = 'x'").count() == 2
    spark.sql(f"DROP TABLE {name}")


def test_months_by_flag(spark):
    df = spark.createDataFrame([("MISSING_ITEMS", date(2024, 1, 1), 2024, 1)], "quality_flags string, month date, year int, "
                               "month_num int")
    row = analytics.flag_matrix(df).first()
    assert row.missing_items == 1 and row.invalid_date == 0
    total = df.select(quality.change_metrics(F.lit(1), F.lit(2), F.lit(3)).alias("c")).first().c
    assert total.total_changes == 6
