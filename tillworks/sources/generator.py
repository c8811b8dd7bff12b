"""Reproducible sample sales in landing-file form."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillworks.functions.text import match_key

# First product id, growth cycle in percent, amounts and shop count.
FIRST_ID = 1729383941730701675
GROWTH_CYCLE = [-42, 10, 23, -12, 67, 8, -24, 39]
ROWS = 8


def _numbered(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct values with their place in order; for short lists such as days or categories."""
    return df.select(F.col(column).alias(name)).distinct().select(
        name, (F.row_number().over(Window.orderBy(name)) - 1).cast("bigint").alias(f"{name}_no"))


def generate_sales(spark: SparkSession, dates: Sequence[date] | DataFrame, categories: Sequence[str] | DataFrame,
                   rows: int = ROWS, seed: int = 0, l3_by_l2: Mapping[str, str] | None = None,
                   l1: str = "General", shops: Sequence[str] = ("Shop A", "Shop B", "Shop C"),
                   skip: Sequence[str] = ()) -> DataFrame:
    """``rows`` sales of every category on every date (frames: their first columns).  The sales are numbered by a range that
    Spark splits; day, category and place follow from the number, ids count up with it.  ``skip`` names categories left
    empty on purpose (case and blanks ignored).  Amounts vary by a hash of category and seed, so the same call always gives
    the same rows."""
    if not isinstance(dates, DataFrame):
        dates = spark.createDataFrame([(d,) for d in dates], "day date")
    if not isinstance(categories, DataFrame):
        categories = spark.createDataFrame([(c,) for c in categories], "l2 string")
    empty = [s.strip().lower() for s in skip]
    kept = categories.where(~match_key(F.col(categories.columns[0])).isin(empty)) if empty else categories
    days, kinds = _numbered(dates, dates.columns[0], "day"), _numbered(kept, kept.columns[0], "l2")
    n_kinds = kinds.count()
    number = spark.range(days.count() * n_kinds * rows)
    per_day = max(1, n_kinds * rows)
    grid = (number.select("id", F.floor(F.col("id") / per_day).alias("day_no"),
                          F.floor(F.col("id") % per_day / rows).alias("l2_no"), (F.col("id") % rows).cast("int").alias("i"))
            .join(days, "day_no").join(kinds, "l2_no"))
    noise = F.pmod(F.xxhash64(F.col("l2"), F.lit(seed)), F.lit(20000))
    revenue = F.lit(50000) + F.col("i") * 15000 + noise
    items = F.lit(1000) + F.col("i") * 500 + F.pmod(noise, F.lit(500))
    l3 = F.lit("Other")
    for name, value in (l3_by_l2 or {}).items():
        l3 = F.when(F.col("l2") == name, value).otherwise(l3)
    shop_list = F.array(*[F.lit(s) for s in shops])
    cycle = F.array(*[F.lit(g) for g in GROWTH_CYCLE])
    return grid.select(
        F.date_format("day", "M/d/yyyy").alias("month_raw"),
        (F.lit(FIRST_ID) + F.col("id")).cast("string").alias("product_id_raw"),
        F.concat(F.lit("Sample Product "), F.substring("l2", 1, 20), F.lit(" #"), (F.col("i") + 1).cast("string"))
        .alias("product_name_raw"),
        F.element_at(shop_list, (F.pmod(F.col("i"), F.lit(len(shops))) + 1).cast("int")).alias("shop_name_raw"),
        F.lit(l1).alias("l1_category_raw"), F.col("l2").alias("l2_category_raw"), l3.alias("l3_category_raw"),
        F.format_number(items, 0).alias("item_sold_raw"),
        F.concat(F.lit("$"), F.format_number(revenue, 0), F.lit(".00 ")).alias("revenue_raw"),
        F.concat(F.lit("$"), F.round(revenue / items, 2).cast("decimal(18,2)").cast("string"), F.lit(" "))
        .alias("avg_unit_price_raw"),
        F.concat(F.element_at(cycle, (F.pmod(F.col("i"), F.lit(len(GROWTH_CYCLE))) + 1).cast("int")).cast("string"),
                 F.lit("%")).alias("mom_growth_raw"))
