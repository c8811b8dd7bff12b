"""What is sorted, shuffled and written by the folds and the partitioned writes."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from queries import base, cleaning, sources
from tillworks.config import Config
from tillworks.operators import dedup
from tillworks.plans import load as plan
from tillworks.session import open_writers
from tillworks.sources import tables


@pytest.fixture()
def sales(spark, folder):
    """A few lines of every kind, some twice, over several months."""
    spark.createDataFrame([(i, f"name {i}", f"Brand#{i}", "SMALL", i + 1, 9.0) for i in range(5)],
                          "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"
                          ).write.parquet(f"{folder}/part.parquet")
    spark.createDataFrame([(i, f"shop {i}", i, 1.0) for i in range(3)],
                          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double").write.parquet(f"{folder}/supplier.parquet")
    spark.createDataFrame([(i, f"nation {i}", 0) for i in range(3)], "n_nationkey int, n_name string, n_regionkey int"
                          ).write.parquet(f"{folder}/nation.parquet")
    spark.createDataFrame([(0, "region")], "r_regionkey int, r_name string").write.parquet(f"{folder}/region.parquet")
    lines = [(i // 2, i % 5, i % 3, i % 7 + 1, float(i % 50), 10.0 + i, 0.01, 0.02, "ANR"[i % 3], "O",
              datetime(1998 + i % 3, i % 12 + 1, 1)) for i in range(600)]
    spark.createDataFrame(lines + lines[:40], """l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double,
      l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp"""
                          ).write.parquet(f"{folder}/lineitem.parquet")
    return folder


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def below(text, node):
    """The plan under the first line that names ``node``."""
    return text[re.search(node, text).end():].split("\n", 1)[1]


def test_sales_are_dealt_out_before_columns_are_derived(spark, sales):
    dealt = base.sales_by_month(spark, sales)
    under = below(optimized(dealt), "RebalancePartitions")
    assert not re.search("source_file|quality_flags|transformation_version|processed_timestamp", under)
    assert dealt.exceptAll(base.sales_curated(spark, sales)).count() == 0
    assert dealt.count() == base.sales_stored(spark, sales).count() == 640


def test_partitioned_write_without_sort_and_setting_restored(spark, folder):
    key, rows = "spark.sql.maxConcurrentOutputFileWriters", spark.range(1000).withColumn("p", F.col("id") % 40)
    before = spark.conf.get(key)
    with pytest.raises(ZeroDivisionError), open_writers(spark):
        assert spark.conf.get(key) == "16"
        rows.write.partitionBy("p").parquet(f"{folder}/out")  # more partitions than open files: the rest is sorted
        raise ZeroDivisionError
    assert spark.conf.get(key) == before
    assert sorted(map(tuple, spark.read.parquet(f"{folder}/out").collect())) == [(i, i % 40) for i in range(1000)]


def test_fold_carries_each_column_once(spark):
    rows = spark.createDataFrame([(1, "b", 2, "x"), (1, "a", 3, "y"), (1, "a", 3, "z"), (None, "c", 1, None), (None, None, 5, "w")],
                                 "k int, o string, p int, v string")
    folded = dedup.first_per_key(rows, ["k"], ["o", "p"])
    assert folded.columns == ["k", "o", "p", "v", "copies"]
    assert optimized(folded).count("struct(o") == 1
    assert {tuple(r) for r in folded.collect()} == {(1, "a", 3, "y", 3), (None, None, 5, "w", 2)}


def test_fold_of_columns_without_an_order(spark):
    rows = spark.createDataFrame([(1, 2, {"a": 1}, [({"b": 1},)]), (1, 1, {"c": 2}, None)],
                                 "k int, o int, m map<string,int>, s array<struct<m:map<string,int>>>")
    assert [tuple(r) for r in dedup.first_per_key(rows, ["k"], ["o"]).collect()] == [(1, 1, {"c": 2}, None, 2)]


@pytest.mark.parametrize("frame", ["metrics", "issues", "kept"])
def test_folds_take_the_columns_they_need(spark, sales, frame):
    made = {"metrics": cleaning.run_metrics, "issues": cleaning.a16, "kept": cleaning.w02}[frame](spark, sales)
    under = below(optimized(made), r"min(_by)?\(")
    whole = optimized(made)[:-len(under)]
    assert "l3_category" not in whole and "product_name" not in whole.split("min(")[1].split(" AS ")[0]


def test_source_columns_are_counted_in_stated_partitions(spark, sales):
    counted = sources.s02(spark, sales)
    assert "RepartitionByExpression" in optimized(counted)
    assert tuple(counted.first()) == (640, 640, 640)


def test_curated_columns_are_added_after_the_spread(spark, folder):
    cfg = Config(run_id="r", executed_at=datetime(2020, 1, 1))
    rows = spark.createDataFrame([(1, "n", "s", "a", "b", "c", 3, 5.0, 2.0, 0.1, 1.0, "", 2020, 1, "f", 7)], """product_id long,
      product_name string, shop_name string, l1_category string, l2_category string, l3_category string, item_sold int, revenue_usd double,
      avg_unit_price_usd double, mom_growth_pct double, data_quality_score double, quality_flags string, year int, month_num int,
      source_file string, source_record_number long""").withColumn("month", F.lit("2020-01-01").cast("date"))
    made = plan.finish(tables.by_month(rows), cfg)
    assert "record_hash" not in below(optimized(made), "RebalancePartitions")
    tables.write_curated(made, folder, cfg, spread=True)
    tables.write_curated(plan.finish(rows, cfg), f"{folder}/plain", cfg)
    once, plain = (tables.read_table(spark, f, "curated_sales").collect() for f in (folder, f"{folder}/plain"))
    assert once == plain and len(once) == 1


def test_each_raw_number_is_trimmed_once(spark):
    from tillworks.operators import cleaning as op
    raw = [r for _, r in op.MAPPING.values()]
    rows = spark.createDataFrame([("2/29/00", "1,0", "n", "s", "a", "b", "c", "7", "$1,5", "€2", "9%"), ("2/29/99", *["x"] * 10),
                                  ("0/1/2024", *[None] * 10), ("31/12/2024", *[""] * 10)], ", ".join(f"{c} string" for c in raw))
    made = op.parse_columns(rows.hint("rebalance"), Config())
    # one for each character that is dropped; nested, they were repeated wherever the parser named its text
    assert len(re.findall(r"(?<![a-z_])replace\(", optimized(made))) == 11
    got = [tuple(r) for r in made.select("month", "product_id", "item_sold", "revenue_usd", "avg_unit_price_usd", "growth_points").collect()]
    assert sorted(map(str, (r[0] for r in got))) == ["2000-02-29", "2024-12-31", "None", "None"]
    assert [tuple(map(int, r[1:])) for r in got if r[1] is not None] == [(10, 7, 15, 2, 9)]


def test_only_rows_that_may_be_known_meet_the_curated_keys(spark, sales, folder):
    from queries.jobs import untidy
    root = f"{folder}/tables"
    rows = untidy(spark, sales)
    cfg = Config(run_id="one", executed_at=datetime(2020, 1, 1))
    first = plan.load(spark, rows, root, cfg, "landing", incremental=True)
    assert spark.read.parquet(f"{first.staging}/new").count() == 0  # nothing curated: no row is shuffled nor staged again
    again = plan.load(spark, rows, root, Config(run_id="two", executed_at=datetime(2020, 1, 1)), "landing", incremental=True)
    failed = first.metrics["records_failed"]
    assert first.metrics["records_known"] == 0 and again.metrics["records_failed"] == failed
    curated = tables.read_curated(spark, root)
    assert curated.where("run_id = 'two'").count() == 0 and curated.count() > 50


@pytest.mark.parametrize("bits", [1 << 15, 1 << 28])
def test_rows_of_known_keys_go_whatever_the_bits_say(spark, folder, monkeypatch, bits):
    monkeypatch.setattr(dedup, "KNOWN_BITS", bits)
    rows = spark.range(40_000).selectExpr("id", "IF(id % 7 = 0, NULL, id) AS product_id", "md5(cast(id AS string)) AS record_key",
                                          "IF(id % 5 = 0, NULL, DATE'2024-01-05') AS month", "IF(id % 3 = 0, NULL, 's') AS shop_name")
    rows.unionByName(rows.where("id < 100")).write.parquet(f"{folder}/rows")
    rows = spark.read.parquet(f"{folder}/rows")
    probe = {"product_id": dedup.first_id()}
    old = rows.where("id % 2 = 0").select(probe["product_id"].alias("product_id"), "month", "shop_name")
    stored = {}

    def store(df, name):
        df.write.parquet(f"{folder}/{name}")
        stored[name] = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
        return stored[name]

    left = dedup.unknown_rows(rows, old, store, probe=probe)
    assert sorted(r.id for r in left.select("id").collect()) == sorted([*range(1, 40_000, 2), *range(1, 100, 2)])
    assert stored["new_keys"].columns == ["product_id", "month", "shop_name"]
    # with few bits many rows are taken for known at first
    assert (stored["new"].count() > 1000) == (bits == 1 << 15)


def test_known_rows_are_neither_folded_nor_staged_again(spark, sales, folder):
    from queries.jobs import untidy
    rows = untidy(spark, sales)
    first = plan.load(spark, rows, f"{folder}/t", Config(run_id="one", executed_at=datetime(2020, 1, 1)), incremental=True)
    again = plan.load(spark, rows, f"{folder}/t", Config(run_id="two", executed_at=datetime(2020, 1, 1)), incremental=True)
    failed = again.metrics["records_read"]  # rows that are not curated are no known ones
    assert again.metrics["records_known"] + failed == first.metrics["records_read"]
    assert spark.read.parquet(f"{again.staging}/folded").agg(F.sum("copies")).first()[0] == failed
    # the fingerprint stays where it is still needed: it names rows without an id
    folded = spark.read.parquet(f"{first.staging}/folded")
    assert folded.where("product_id is null and record_key is null or product_id is not null and record_key is not null").count() == 0
    assert folded.where("record_key is not null").count() > 0


def test_compressed_landing_files_are_read_where_asked_for(spark, sales, folder):
    from queries.base import sales_raw
    from tillworks.sources import raw
    path = sources.landing(spark, sales, "packed", **sources.GZIP)
    assert raw.list_files(spark, path).count() == 0 and raw.read_raw(spark, path).count() == 0
    assert raw.list_files(spark, path, "*.csv.gz").count() > 0
    names = sources.RAW_NAMES
    empty = [F.nullif(c, F.lit("")).alias(c) for c in names]  # an empty text comes back as no text
    back = raw.read_raw(spark, path, pattern="*.csv.gz").select(*empty)
    assert sorted(map(str, back.collect())) == sorted(map(str, sales_raw(spark, sales).select(*empty).collect()))
    cfg = Config(run_id="r", executed_at=datetime(2020, 1, 1))
    day = datetime(2001, 11, 4).date()
    assert plan.backfill(spark, path, f"{folder}/t", cfg, day, day) is None
    got = plan.backfill(spark, path, f"{folder}/t", cfg, day, day, "*.csv.gz")
    assert got.metrics["records_read"] == back.count() and got.metrics["records_corrupt"] == 0
    dated = spark.createDataFrame([("landing/sales_20240105.csv.gz",)], "source_file string")
    assert raw.landing_date(dated, None).first()["landing_date"].isoformat() == "2024-01-05"


def test_shuffle_files_go_with_the_write(spark, folder):
    import time

    from tillworks.sources.tables import write_parts

    def files() -> int:
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return sum(found.apply(i).getName().endswith(".data") for i in range(found.size()))

    rows = spark.range(10_000).withColumn("k", F.col("id") % 3).repartition(5, "id")
    before, until = files(), time.time() + 20
    write_parts(rows, f"{folder}/out", ["k"])
    while files() > before and time.time() < until:
        time.sleep(0.2)
    assert files() <= before
    assert spark.read.parquet(f"{folder}/out").count() == 10_000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
