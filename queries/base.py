"""Given tables as engine inputs, in Spark and in SQL, and the query registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillworks import Config
from tillworks.session import open_writers, scratch, tune
from tillworks.sources.tables import partitions

AS_OF = date(2001, 11, 4)
YEAR = 2000
CFG = Config(run_id="check", as_of=AS_OF, executed_at=datetime(2001, 11, 4, 2, 0, 0))


@dataclass(frozen=True)
class Entry:
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        assert name not in REGISTRY, name
        REGISTRY[name] = Entry(lambda spark, sf_dir: fn(tune(spark), sf_dir), oracle)
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    supplier = table(spark, sf_dir, "supplier")
    lines = table(spark, sf_dir, "lineitem")
    return lines.join(part, lines.l_partkey == part.p_partkey).join(supplier, lines.l_suppkey == supplier.s_suppkey)


def _sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    return _lines(spark, sf_dir).join(nation, F.col("s_nationkey") == nation.n_nationkey).join(
        region, nation.n_regionkey == region.r_regionkey)


def sales_curated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored sales rows; flags and scores follow the line number, versions the return flag."""
    return _scored(_sales(spark, sf_dir))


def _scored(sales: DataFrame) -> DataFrame:
    line = F.col("l_linenumber")
    score = F.lit(1.00)
    flags = F.lit("")
    for number, (value, names) in SCORES.items():
        score = F.when(line == number, value).otherwise(score)
        flags = F.when(line == number, names).otherwise(flags)
    version = F.when(F.col("l_returnflag") == "A", "v1.0.0").when(F.col("l_returnflag") == "N", "v1.1.0").otherwise(
        "v2.0.0")
    day = F.to_date("l_shipdate")
    return sales.select(
        day.alias("month"), F.col("l_partkey").alias("product_id"), F.col("p_name").alias("product_name"),
        F.col("s_name").alias("shop_name"), F.col("r_name").alias("l1_category"), F.col("p_type").alias("l2_category"),
        F.col("p_brand").alias("l3_category"), F.col("l_quantity").cast("int").alias("item_sold"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("revenue_usd"),
        (F.col("p_size") * F.lit(1.25).cast("decimal(3,2)")).cast("decimal(10,2)").alias("avg_unit_price_usd"),
        (F.col("l_tax").cast("decimal(5,4)") - F.col("l_discount").cast("decimal(5,4)")).cast("decimal(5,4)")
        .alias("mom_growth_pct"),
        score.cast("decimal(5,4)").alias("data_quality_score"), flags.alias("quality_flags"),
        F.year(day).alias("year"), F.month(day).alias("month_num"),
        F.timestamp_add("HOUR", line, day.cast("timestamp")).alias("processed_timestamp"),
        version.alias("transformation_version"),
        F.concat(F.lit("landing/sales_"), F.date_format(day, "yyyyMMdd"), F.lit(".csv")).alias("source_file"),
        (F.col("l_orderkey") * 10 + line).alias("source_record_number"),
        "l_orderkey", "l_linenumber", "l_suppkey")


def sales_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored sales rows dealt out by calendar month, before the derived columns are made: those would double what is
    shuffled."""
    day = F.to_date("l_shipdate")
    months = {"_year": F.year(day), "_month": F.month(day)}
    return _scored(_sales(spark, sf_dir).withColumns(months).hint("rebalance", *[F.col(c) for c in months]))


_STORED: dict[tuple[str, str], str] = {}


def sales_folder(spark: SparkSession, sf_dir: str) -> str:
    """The scored sales rows as a table partitioned by calendar month, written once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _STORED:
        folder = scratch(spark, "sales")
        with open_writers(spark):
            sales_by_month(spark, sf_dir).write.partitionBy("year", "month_num").parquet(folder)
        _STORED[key] = folder
    return _STORED[key]


def sales_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(sales_folder(spark, sf_dir))


def sales_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return partitions(spark, sales_folder(spark, sf_dir))


# line number -> score, flags
SCORES = {
    3: (0.95, "SUSPICIOUS_GROWTH"),
    4: (0.90, "MISSING_ITEMS"),
    5: (0.80, "INVALID_DATE"),
    6: (0.75, "INVALID_REVENUE,MISSING_ITEMS"),
    7: (0.55, "INVALID_DATE,SYNTHETIC_PRODUCT_ID,INVALID_AVG_PRICE"),
}

CURATED_SQL = """sales_curated AS (
SELECT CAST(l.l_shipdate AS DATE) AS month, l.l_partkey AS product_id, p.p_name AS product_name,
  s.s_name AS shop_name, r.r_name AS l1_category, p.p_type AS l2_category, p.p_brand AS l3_category,
  CAST(l.l_quantity AS INT) AS item_sold, CAST(l.l_extendedprice AS DECIMAL(18,2)) AS revenue_usd,
  CAST(p.p_size * 1.25 AS DECIMAL(10,2)) AS avg_unit_price_usd,
  CAST(CAST(l.l_tax AS DECIMAL(5,4)) - CAST(l.l_discount AS DECIMAL(5,4)) AS DECIMAL(5,4)) AS mom_growth_pct,
  CAST(CASE l.l_linenumber WHEN 3 THEN 0.95 WHEN 4 THEN 0.90 WHEN 5 THEN 0.80 WHEN 6 THEN 0.75 WHEN 7 THEN 0.55
    ELSE 1.00 END AS DECIMAL(5,4)) AS data_quality_score,
  CASE l.l_linenumber WHEN 3 THEN 'SUSPICIOUS_GROWTH' WHEN 4 THEN 'MISSING_ITEMS' WHEN 5 THEN 'INVALID_DATE'
    WHEN 6 THEN 'INVALID_REVENUE,MISSING_ITEMS' WHEN 7 THEN 'INVALID_DATE,SYNTHETIC_PRODUCT_ID,INVALID_AVG_PRICE'
    ELSE '' END AS quality_flags,
  CAST(year(l.l_shipdate) AS INT) AS year, CAST(month(l.l_shipdate) AS INT) AS month_num,
  CAST(CAST(l.l_shipdate AS DATE) AS TIMESTAMP) + to_hours(l.l_linenumber) AS processed_timestamp,
  CASE l.l_returnflag WHEN 'A' THEN 'v1.0.0' WHEN 'N' THEN 'v1.1.0' ELSE 'v2.0.0' END AS transformation_version,
  'landing/sales_' || strftime(l.l_shipdate, '%Y%m%d') || '.csv' AS source_file,
  l.l_orderkey * 10 + l.l_linenumber AS source_record_number,
  l.l_orderkey, l.l_linenumber, l.l_suppkey
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""


def sales_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Untidy text rows as a landing file would hold them."""
    order, line = F.col("l_orderkey"), F.col("l_linenumber")
    price = (F.col("p_size") * F.lit(1.25).cast("decimal(3,2)")).cast("decimal(10,2)").cast("string")

    def at(n: int, r: int):
        return order % n == r

    return _lines(spark, sf_dir).select(
        F.when(at(40, 0), "invalid-date").when(at(40, 1), F.to_date("l_shipdate").cast("string"))
        .otherwise(F.date_format("l_shipdate", "M/d/yyyy")).alias("month_raw"),
        F.when(at(30, 0), "bad-id").when(at(30, 1), "").when(at(30, 2), "1.72938E+18")
        .otherwise((F.lit(1729383941730701675) + F.col("l_partkey")).cast("string")).alias("product_id_raw"),
        F.when(at(25, 0), "   ").otherwise(F.concat(F.lit("  "), "p_name", F.lit("   x "))).alias("product_name_raw"),
        F.col("s_name").alias("shop_name_raw"),
        F.lit("Catalog").alias("l1_category_raw"),
        F.when(at(50, 0), "").otherwise(F.col("p_type")).alias("l2_category_raw"),
        F.col("p_brand").alias("l3_category_raw"),
        F.when(at(20, 0), "-100").otherwise(F.concat(F.lit("1,"), F.lpad(
            F.col("l_quantity").cast("int").cast("string"), 3, "0"))).alias("item_sold_raw"),
        F.when(at(35, 0), "$-50.00").otherwise(F.concat(F.lit("$"), F.col("l_extendedprice").cast("decimal(18,2)")
                                                        .cast("string"), F.lit(" "))).alias("revenue_raw"),
        F.when(at(45, 0), "n/a").otherwise(F.concat(F.lit("$"), price)).alias("avg_unit_price_raw"),
        F.when(at(15, 0), "#DIV/0!").when(at(15, 1), "5000%").otherwise(
            F.concat((line * 10 - 40).cast("string"), F.lit("%"))).alias("mom_growth_raw"),
        F.lit("landing/sales.csv").alias("source_file"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity")


#: a total order of the raw rows
RAW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity"]

RAW_SQL = """sales_raw AS (
SELECT CASE WHEN l.l_orderkey % 40 = 0 THEN 'invalid-date'
    WHEN l.l_orderkey % 40 = 1 THEN CAST(CAST(l.l_shipdate AS DATE) AS VARCHAR)
    ELSE strftime(l.l_shipdate, '%-m/%-d/%Y') END AS month_raw,
  CASE WHEN l.l_orderkey % 30 = 0 THEN 'bad-id' WHEN l.l_orderkey % 30 = 1 THEN ''
    WHEN l.l_orderkey % 30 = 2 THEN '1.72938E+18'
    ELSE CAST(1729383941730701675 + l.l_partkey AS VARCHAR) END AS product_id_raw,
  CASE WHEN l.l_orderkey % 25 = 0 THEN '   ' ELSE CONCAT('  ', p.p_name, '   x ') END AS product_name_raw,
  s.s_name AS shop_name_raw, 'Catalog' AS l1_category_raw,
  CASE WHEN l.l_orderkey % 50 = 0 THEN '' ELSE p.p_type END AS l2_category_raw, p.p_brand AS l3_category_raw,
  CASE WHEN l.l_orderkey % 20 = 0 THEN '-100'
    ELSE CONCAT('1,', LPAD(CAST(CAST(l.l_quantity AS INT) AS VARCHAR), 3, '0')) END AS item_sold_raw,
  CASE WHEN l.l_orderkey % 35 = 0 THEN '$-50.00'
    ELSE CONCAT('$', CAST(CAST(l.l_extendedprice AS DECIMAL(18,2)) AS VARCHAR), ' ') END AS revenue_raw,
  CASE WHEN l.l_orderkey % 45 = 0 THEN 'n/a'
    ELSE CONCAT('$', CAST(CAST(p.p_size * 1.25 AS DECIMAL(10,2)) AS VARCHAR)) END AS avg_unit_price_raw,
  CASE WHEN l.l_orderkey % 15 = 0 THEN '#DIV/0!' WHEN l.l_orderkey % 15 = 1 THEN '5000%'
    ELSE CONCAT(CAST(l.l_linenumber * 10 - 40 AS VARCHAR), '%') END AS mom_growth_raw,
  'landing/sales.csv' AS source_file,
  l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_quantity
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
parsed AS (
SELECT *, CAST(COALESCE(try_strptime(month_raw, '%m/%d/%Y'), try_strptime(month_raw, '%Y-%m-%d')) AS DATE) AS month,
  CASE WHEN product_id_raw = '1.72938E+18' THEN 1729380000000000000
    ELSE TRY_CAST(product_id_raw AS BIGINT) END AS id,
  NULLIF(trim(regexp_replace(product_name_raw, '\\s+', ' ', 'g')), '') AS product_name,
  shop_name_raw AS shop_name, NULLIF(l2_category_raw, '') AS l2,
  TRY_CAST(replace(item_sold_raw, ',', '') AS INT) AS items0,
  TRY_CAST(trim(replace(replace(revenue_raw, '$', ''), ',', '')) AS DECIMAL(18,2)) AS revenue0,
  TRY_CAST(replace(avg_unit_price_raw, '$', '') AS DECIMAL(18,2)) AS price0,
  TRY_CAST(replace(mom_growth_raw, '%', '') AS DECIMAL(30,6)) AS points
FROM sales_raw),
ranged AS (
SELECT *, CASE WHEN items0 BETWEEN 0 AND 10000000 THEN items0 END AS items,
  CASE WHEN revenue0 BETWEEN 0 AND 100000000 THEN revenue0 END AS revenue,
  CASE WHEN price0 BETWEEN 0 AND 100000000 THEN price0 END AS price,
  COALESCE(points > 1000 OR points < -100, FALSE) AS wild
FROM parsed),
scored AS (
SELECT *, array_to_string(list_filter([CASE WHEN month IS NULL THEN 'INVALID_DATE' END,
    CASE WHEN id IS NULL THEN 'SYNTHETIC_PRODUCT_ID' END, CASE WHEN product_name IS NULL THEN 'MISSING_PRODUCT_NAME' END,
    CASE WHEN revenue IS NULL THEN 'INVALID_REVENUE' END, CASE WHEN price IS NULL THEN 'INVALID_AVG_PRICE' END,
    CASE WHEN items IS NULL THEN 'MISSING_ITEMS' END, CASE WHEN wild THEN 'SUSPICIOUS_GROWTH' END],
    lambda x: x IS NOT NULL), ',') AS quality_flags,
  CAST(1.0 - CASE WHEN month IS NULL THEN 0.20 ELSE 0 END - CASE WHEN id IS NULL THEN 0.15 ELSE 0 END
    - CASE WHEN product_name IS NULL THEN 0.20 ELSE 0 END - CASE WHEN revenue IS NULL THEN 0.15 ELSE 0 END
    - CASE WHEN price IS NULL THEN 0.10 ELSE 0 END - CASE WHEN items IS NULL THEN 0.10 ELSE 0 END
    - CASE WHEN wild THEN 0.05 ELSE 0 END AS DECIMAL(5,4)) AS data_quality_score,
  COALESCE(l2, 'Uncategorized') AS l2_category, COALESCE(items, 0) AS item_sold,
  COALESCE(revenue, 0) AS revenue_usd, COALESCE(price, 0) AS avg_unit_price_usd,
  CASE WHEN points BETWEEN -100 AND 1000 THEN CAST(points / 100 AS DECIMAL(5,4)) END AS mom_growth_pct,
  CAST(year(month) AS INT) AS year, CAST(month(month) AS INT) AS month_num,
  md5(concat_ws(chr(31), source_file, month_raw, product_id_raw, product_name_raw, shop_name_raw, l1_category_raw,
    l2_category_raw, l3_category_raw, item_sold_raw, revenue_raw, avg_unit_price_raw, mom_growth_raw)) AS record_key
FROM ranged),
tiered AS (
SELECT *, CASE WHEN data_quality_score >= 0.95 THEN 'pass' WHEN data_quality_score >= 0.70 THEN 'warn' ELSE 'fail' END
  AS tier, (revenue_usd > 10000000 OR item_sold > 1000000) AS anomaly FROM scored)"""


def with_curated(sql: str) -> str:
    return f"WITH {CURATED_SQL}\n{sql}"


def with_raw(sql: str) -> str:
    return f"WITH {RAW_SQL}\n{sql}"


def with_both(sql: str) -> str:
    return f"WITH {CURATED_SQL},\n{RAW_SQL}\n{sql}"


def dmean(c: str) -> str:
    return f"(CAST(SUM({c}) AS DOUBLE) / COUNT({c}))"


REV = "CAST(SUM(revenue_usd) AS DECIMAL(28,2))"
UNITS = "CAST(SUM(item_sold) AS BIGINT)"

EVENT_TYPES = {"error": "ERROR", "purchase": "JOB_SUMMARY", "click": "ETL_STEP", "view": "DATA_CHANGE",
               "signup": "QUALITY_ALERT"}


def log_events(events: DataFrame) -> DataFrame:
    """The events table (batch or stream) as structured log events."""
    k = F.get_json_object("props", "$.k").cast("int")
    kind = F.col("event_type")
    mapped = F.lit(None).cast("string")
    for old, new in EVENT_TYPES.items():
        mapped = F.when(kind == old, new).otherwise(mapped)
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (n % len(names) + 1).cast("int"))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"),
        F.when(kind == "error", "ERROR").otherwise("INFO").alias("level"),
        F.concat(F.lit("run-"), F.col("user_id").cast("string")).alias("job_run_id"), mapped.alias("event_type"),
        F.col("value").cast("double").alias("value"), k.alias("k"),
        F.struct(
            pick(["INSERT", "UPDATE", "DELETE"], k).alias("change_type"),
            pick(["curated_sales", "error_sales"], k).alias("table_name"),
            pick(["BATCH_INSERT", "MERGE"], F.floor(k / 2)).alias("operation"),
            pick(["QUALITY_SCORE_LOW", "ERROR_RATE_HIGH"], k).alias("alert_type"),
            k.cast("bigint").alias("records_passed"), (k % 7).cast("bigint").alias("records_warned"),
            (k % 5).cast("bigint").alias("records_failed"),
            (k / F.lit(100.0)).alias("avg_quality_score"), ((100 - k) / F.lit(100.0)).alias("pass_rate"),
            F.col("value").cast("double").alias("duration_seconds"),
            pick(["", "MISSING_ITEMS", "INVALID_DATE,MISSING_ITEMS"], k).alias("quality_flags")).alias("details"),
        F.when(kind == "error", F.struct(pick(["ValueError", "KeyError", "IOError"], k).alias("type"),
                                         F.concat(F.lit("k="), k.cast("string")).alias("message"))).alias("error"))


EVENTS_SQL = """log_events AS (
SELECT *, CASE kind WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'JOB_SUMMARY' WHEN 'click' THEN 'ETL_STEP'
    WHEN 'view' THEN 'DATA_CHANGE' WHEN 'signup' THEN 'QUALITY_ALERT' END AS event_type,
  CASE WHEN kind = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, 'run-' || user_id AS job_run_id,
  ['INSERT', 'UPDATE', 'DELETE'][k % 3 + 1] AS change_type, ['curated_sales', 'error_sales'][k % 2 + 1] AS table_name,
  ['BATCH_INSERT', 'MERGE'][(k // 2) % 2 + 1] AS operation,
  ['QUALITY_SCORE_LOW', 'ERROR_RATE_HIGH'][k % 2 + 1] AS alert_type,
  ['', 'MISSING_ITEMS', 'INVALID_DATE,MISSING_ITEMS'][k % 3 + 1] AS quality_flags,
  CASE WHEN kind = 'error' THEN ['ValueError', 'KeyError', 'IOError'][k % 3 + 1] END AS error_type
FROM (SELECT event_id, ts, user_id, event_type AS kind, value, CAST(json_extract_string(props, '$.k') AS INT) AS k
      FROM events))"""


def with_events(sql: str) -> str:
    return f"WITH {EVENTS_SQL}\n{sql}"
