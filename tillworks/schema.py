"""Table schemas, the penalty registry and the other fixed values of the data model."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import types as T

SCORE = T.DecimalType(5, 4)
MONEY = T.DecimalType(18, 2)
PRICE = T.DecimalType(10, 2)

# Header names of a landing file, in file order, with the snake-case name used from the first step on.
# (Column names are case-insensitive in Spark: adding a parsed "month" beside a raw "Month" would replace it.)
RAW_COLUMNS = {
    "Month": "month_raw",
    "Product Id": "product_id_raw",
    "Product Name": "product_name_raw",
    "Shop Name": "shop_name_raw",
    "L1 category": "l1_category_raw",
    "L2 category": "l2_category_raw",
    "L3 category": "l3_category_raw",
    "Item Sold": "item_sold_raw",
    "Revenue": "revenue_raw",
    "Avg. Unit Price": "avg_unit_price_raw",
    "MoM Growth %": "mom_growth_raw",
}
CORRUPT = "_corrupt_record"

RAW_SCHEMA = T.StructType([T.StructField(name, T.StringType()) for name in RAW_COLUMNS]
                          + [T.StructField(CORRUPT, T.StringType())])

# Quality flags in the order they are listed, each with the penalty it takes off a score of 1.
PENALTIES = {
    "INVALID_DATE": Decimal("0.20"),
    "SYNTHETIC_PRODUCT_ID": Decimal("0.15"),
    "MISSING_PRODUCT_NAME": Decimal("0.20"),
    "INVALID_REVENUE": Decimal("0.15"),
    "INVALID_AVG_PRICE": Decimal("0.10"),
    "MISSING_ITEMS": Decimal("0.10"),
    "SUSPICIOUS_GROWTH": Decimal("0.05"),
}
FLAGS = list(PENALTIES)
UNCATEGORIZED = "Uncategorized"

DEDUP_KEYS = ["product_id", "month", "shop_name"]
PARTITIONS = ["year", "month_num"]


def _struct(spec: list[tuple[str, T.DataType, bool]]) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in spec])


CURATED = _struct([
    ("month", T.DateType(), True),
    ("product_id", T.LongType(), False),
    ("product_name", T.StringType(), True),
    ("shop_name", T.StringType(), True),
    ("l1_category", T.StringType(), False),
    ("l2_category", T.StringType(), False),
    ("l3_category", T.StringType(), False),
    ("item_sold", T.IntegerType(), False),
    ("revenue_usd", MONEY, False),
    ("avg_unit_price_usd", PRICE, True),
    ("mom_growth_pct", SCORE, True),
    ("source_file", T.StringType(), False),
    ("source_record_number", T.LongType(), False),
    ("processed_timestamp", T.TimestampType(), False),
    ("transformation_version", T.StringType(), False),
    ("data_quality_score", SCORE, False),
    ("quality_flags", T.StringType(), False),
    ("created_by", T.StringType(), False),
    ("record_hash", T.StringType(), False),
    ("year", T.IntegerType(), True),
    ("month_num", T.IntegerType(), True),
])

ERRORS = _struct([
    ("error_reason", T.StringType(), False),
    ("raw_record", T.StringType(), True),
    ("error_timestamp", T.TimestampType(), False),
])

QUARANTINE = _struct([
    ("quarantine_reason", T.StringType(), False),
    ("data_quality_score", SCORE, False),
    ("quality_flags", T.StringType(), True),
    ("product_id", T.LongType(), True),
    ("product_name", T.StringType(), True),
    ("month", T.DateType(), True),
    ("revenue_usd", MONEY, True),
    ("item_sold", T.IntegerType(), True),
])

QUALITY_REPORT = _struct([
    ("job_run_id", T.StringType(), False),
    ("execution_timestamp", T.TimestampType(), False),
    ("source_file", T.StringType(), True),
    ("total_records", T.LongType(), False),
    ("records_passed", T.LongType(), False),
    ("records_warned", T.LongType(), False),
    ("records_failed", T.LongType(), False),
    ("records_duplicates", T.LongType(), True),
    ("records_corrupt", T.LongType(), True),
    ("records_anomalies", T.LongType(), True),
    ("pass_rate", SCORE, False),
    ("quality_issues", T.MapType(T.StringType(), T.LongType()), False),
    ("avg_quality_score", SCORE, False),
    ("min_quality_score", SCORE, True),
    ("max_quality_score", SCORE, True),
    ("transformation_version", T.StringType(), False),
])

LINEAGE = _struct([
    ("source_file_path", T.StringType(), True),
    ("target_file_path", T.StringType(), True),
    ("job_name", T.StringType(), False),
    ("job_run_id", T.StringType(), False),
    ("transformation_timestamp", T.TimestampType(), False),
    ("records_in", T.LongType(), False),
    ("records_out", T.LongType(), False),
    ("records_error", T.LongType(), False),
])

LOG_EVENT = _struct([
    ("timestamp", T.TimestampType(), True),
    ("level", T.StringType(), True),
    ("domain", T.StringType(), True),
    ("job_run_id", T.StringType(), True),
    ("request_id", T.StringType(), True),
    ("message", T.StringType(), True),
    ("event_type", T.StringType(), True),
    ("details", T.StructType([
        T.StructField("change_type", T.StringType()),
        T.StructField("table_name", T.StringType()),
        T.StructField("operation", T.StringType()),
        T.StructField("record_count", T.LongType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("actual_value", T.DoubleType()),
        T.StructField("step_number", T.IntegerType()),
        T.StructField("step_name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("total_records", T.LongType()),
        T.StructField("records_passed", T.LongType()),
        T.StructField("records_warned", T.LongType()),
        T.StructField("records_failed", T.LongType()),
        T.StructField("records_duplicates", T.LongType()),
        T.StructField("records_anomalies", T.LongType()),
        T.StructField("avg_quality_score", T.DoubleType()),
        T.StructField("pass_rate", T.DoubleType()),
        T.StructField("duration_seconds", T.DoubleType()),
        T.StructField("quality_flags", T.StringType()),
    ]), True),
    ("error", T.StructType([
        T.StructField("type", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("traceback", T.StringType()),
    ]), True),
])
