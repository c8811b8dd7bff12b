"""Views and saved queries over the curated sales table.

Every aggregate starts with Spark's map-side partial step, so a category or shop that holds a third of the table
arrives at the reducers already folded.  Windows run only over aggregates whose size the calendar or ``k`` bounds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import Config
from tillworks.functions.text import match_key
from tillworks.operators.quality import RATING, band, has_flag, mean
from tillworks.schema import FLAGS, SCORE
from tillworks.session import stage

#: Parts that the rows of one key are ranked in first.
SALTS = 64

# Exclusive upper price limits of the tiers.
PRICE_TIERS = [("10", "Budget (<$10)"), ("25", "Mid-Range ($10-$25)"), ("50", "Premium ($25-$50)")]
TOP_TIER = "Luxury (>$50)"

LISTING = ["month", "product_id", "product_name", "shop_name", "l1_category", "l2_category", "l3_category",
           "item_sold", "revenue_usd", "avg_unit_price_usd", "mom_growth_pct", "data_quality_score",
           "processed_timestamp"]


# -- building blocks -------------------------------------------------------------------------------------------------

def total(name: str) -> Column:
    return F.sum(name).cast("decimal(28,2)")


def units() -> Column:
    return F.sum("item_sold").cast("bigint")


def count_rows() -> Column:
    return F.count(F.lit(1))


def min_quality(df: DataFrame, threshold: str) -> DataFrame:
    return df.where(F.col("data_quality_score") >= F.lit(threshold).cast(SCORE))


def since(df: DataFrame, cfg: Config, months: int = 0, days: int = 0, column: str = "month") -> DataFrame:
    """Rows not older than ``as_of`` minus a number of months and days."""
    return not_before(df, F.date_sub(F.add_months(F.lit(cfg.as_of), -months), days), column)


def not_before(df: DataFrame, start: Column, column: str = "month") -> DataFrame:
    """Rows of a day or later.  On a table with calendar partitions the same bound, to the month, is put on them as well:
    older folders are not read."""
    chosen = df.where(F.col(column) >= start)
    if not {"year", "month_num"} <= set(df.columns):
        return chosen
    return chosen.where(F.col("year") * 12 + F.col("month_num") >= F.year(start) * 12 + F.month(start))


def current_and_previous_month(df: DataFrame, cfg: Config, back: int = 1) -> DataFrame:
    """Partitions of the as-of month and the ``back`` months before it; January reaches into December."""
    index = cfg.as_of.year * 12 + cfg.as_of.month
    return df.where((F.col("year") * 12 + F.col("month_num")).between(index - back, index))


def eq_ci(df: DataFrame, column: str, value: str) -> DataFrame:
    """Equality that ignores case and outer blanks; the value is a bound literal, never part of SQL text."""
    return df.where(match_key(F.col(column)) == match_key(F.lit(value)))


def non_empty(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull() & (F.btrim(column) != ""))


def ordered(df: DataFrame, spec: Sequence[tuple[str, str]]) -> DataFrame:
    """Sort with NULLs last in both directions."""
    return df.orderBy(*_order(spec))


def _order(spec: Sequence[tuple[str, str]]) -> list[Column]:
    return [F.col(c).desc_nulls_last() if d == "desc" else F.col(c).asc_nulls_last() for c, d in spec]


def top_k(df: DataFrame, spec: Sequence[tuple[str, str]], k: int) -> DataFrame:
    """Each task keeps its k best rows and only those meet: no full sort.  End the spec with a unique column."""
    return ordered(df, spec).limit(k)


def top_k_per(df: DataFrame, keys: Sequence[str], spec: Sequence[tuple[str, str]], k: int,
              method: str = "row_number", rank_as: str = "revenue_rank") -> DataFrame:
    """k best rows of each key.  ``row_number`` ends on a unique order; Spark cuts each group to k in the map tasks
    already, so a large key never meets in one task.  ``rank`` keeps ties, however many there are."""
    if method == "row_number":
        window = Window.partitionBy(*keys).orderBy(*_order(spec))
        return df.withColumn(rank_as, F.row_number().over(window)).where(F.col(rank_as) <= k)
    return _rank_per(df, keys, spec, k, rank_as)


def _rank_per(df: DataFrame, keys: Sequence[str], spec: Sequence[tuple[str, str]], k: int, rank_as: str) -> DataFrame:
    """RANK without a window over all rows of a key.  Rows are dealt to ``SALTS`` parts of their key; what ranks over k in
    its part ranks over k in the key, and is cut in the map tasks already.  The few rows left are written, so ``df`` is
    read once; among them equal order values fold to counts, the k best values of a key are ranked by the rows before
    them, and the rows meet their value.  Ties of any number stay spread."""
    values = [c for c, _ in spec]
    part = Window.partitionBy(*keys, "_salt").orderBy(*_order(spec))
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(F.spark_partition_id(), *df.columns), F.lit(SALTS)))
    few = stage(salted.withColumn("_rank", F.rank().over(part)).where(F.col("_rank") <= k).drop("_salt", "_rank"), "ranked")
    best = top_k_per(few.groupBy(*keys, *values).agg(count_rows().alias("_rows")), keys, spec, k, rank_as="_position")
    before = F.sum("_rows").over(Window.partitionBy(*keys).orderBy("_position").rowsBetween(
        Window.unboundedPreceding, -1))
    best = best.withColumn(rank_as, F.coalesce(before, F.lit(0)) + 1).where(F.col(rank_as) <= k)
    best = best.select(rank_as, *[F.col(c).alias(f"_v_{c}") for c in [*keys, *values]])
    same = F.lit(True)
    for c in [*keys, *values]:
        same = same & F.col(c).eqNullSafe(F.col(f"_v_{c}"))
    return few.join(best, same).select(*df.columns, rank_as)


def latest_partition(df: DataFrame) -> DataFrame:
    """The one-row frame (year, month_num) of the newest partition; rows without a date do not count.  ``df`` is the table,
    or better its list of partitions (``tables.partitions``), which opens no file."""
    newest = df.where("year is not null").agg(F.max(F.struct("year", "month_num")).alias("p"))
    # a comparison rather than a NULL test: only then does Spark prune the files of the joined table at run time
    return newest.select("p.year", "p.month_num").where("year > 0")


def in_latest_partition(df: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Rows of the newest partition: a one-row broadcast, which also prunes the files of a partitioned table.  The newest
    one comes from ``listing``, the table's partitions, where given."""
    newest = latest_partition(df if listing is None else listing)
    return df.join(F.broadcast(newest), ["year", "month_num"])


def share_of_total(df: DataFrame, measure: str, alias: str) -> DataFrame:
    """Percent of the grand total.  The total is a scalar subquery: a window over everything would move all rows into
    one task."""
    grand = df.agg(F.sum(measure).cast("double")).scalar()
    return df.withColumn(alias, F.round(F.try_divide(F.col(measure).cast("double") * 100, grand), 2))


def lag_by(df: DataFrame, order: Sequence[str], columns: Mapping[str, str], keys: Sequence[str] = ()) -> DataFrame:
    """Previous value per key.  Only for frames already folded to one row per key and period: then a group is no longer
    than the calendar."""
    window = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in order])
    return df.withColumns({alias: F.lag(c).over(window) for alias, c in columns.items()})


def with_group_count(df: DataFrame, keys: Sequence[str], counted: DataFrame, alias: str) -> DataFrame:
    """Size of each row's group in ``counted``, by join with the aggregate."""
    return df.join(counted.groupBy(*keys).agg(count_rows().alias(alias)), list(keys))


def grouped(df: DataFrame, keys: Sequence[str], measures: Sequence[Column], distinct: Mapping[str, str]) -> DataFrame:
    """Measures and exact distinct counts (name to column) per group.  Several distinct counts in one aggregate copy every row once
    for each of them before the shuffle; here the first one shares the aggregate of the measures, each further one folds the
    keys and its own column only, and the groups meet again in a join that treats NULL keys as equal."""
    (name, column), *others = distinct.items()
    out = df.groupBy(*keys).agg(F.countDistinct(column).alias(name), *measures)
    for name, column in others:
        counted = df.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.countDistinct(column).alias(name))
        same = F.lit(True)
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"_{k}"))
        out = out.join(counted, same).drop(*[f"_{k}" for k in keys])
    return out


# -- views -----------------------------------------------------------------------------------------------------------

def high_quality_products(df: DataFrame) -> DataFrame:
    return ordered(min_quality(df, "0.95").select(*LISTING), [("month", "desc"), ("revenue_usd", "desc")])


def sales_by_category_month(df: DataFrame) -> DataFrame:
    keys = ["year", "month_num", "month", "l1_category", "l2_category", "l3_category"]
    out = grouped(min_quality(df, "0.70"), keys, [
        units().alias("total_items_sold"),
        total("revenue_usd").alias("total_revenue_usd"),
        mean(F.col("avg_unit_price_usd")).alias("avg_product_price"),
        mean(F.col("data_quality_score")).alias("avg_quality_score")],
        {"unique_products": "product_id", "unique_shops": "shop_name"})
    out = out.select(*keys, "unique_products", "unique_shops", "total_items_sold", "total_revenue_usd", "avg_product_price",
                     "avg_quality_score")
    return ordered(out, [("year", "desc"), ("month_num", "desc"), ("total_revenue_usd", "desc")])


def quality_trends(df: DataFrame, keys: Sequence[str] = ("year", "month_num", "month")) -> DataFrame:
    score = F.col("data_quality_score")
    out = df.groupBy(*keys).agg(
        count_rows().alias("total_records"),
        F.count_if(score >= F.lit("0.95").cast(SCORE)).alias("high_quality_count"),
        F.count_if((score >= F.lit("0.70").cast(SCORE)) & (score < F.lit("0.95").cast(SCORE)))
        .alias("medium_quality_count"),
        F.count_if(score < F.lit("0.70").cast(SCORE)).alias("low_quality_count"),
        mean(score).alias("avg_quality_score"),
        F.min(score).alias("min_quality_score"),
        F.max(score).alias("max_quality_score"),
        F.countDistinct("transformation_version").alias("transformation_versions"))
    return ordered(out, [(k, "desc") for k in keys])


def product_performance(df: DataFrame) -> DataFrame:
    out = min_quality(df, "0.70").groupBy("product_id", "product_name", "shop_name", "l1_category", "l2_category").agg(
        F.countDistinct("month").alias("months_on_market"),
        units().alias("lifetime_items_sold"),
        total("revenue_usd").alias("lifetime_revenue_usd"),
        mean(F.col("avg_unit_price_usd")).alias("avg_price"),
        mean(F.col("mom_growth_pct")).alias("avg_mom_growth"),
        F.max("revenue_usd").alias("peak_monthly_revenue"),
        mean(F.col("data_quality_score")).alias("avg_quality_score"))
    return ordered(out.where("lifetime_revenue_usd > 0"), [("lifetime_revenue_usd", "desc")])


def shop_leaderboard(df: DataFrame) -> DataFrame:
    out = grouped(min_quality(df, "0.70"), ["shop_name"], [
        units().alias("total_items_sold"),
        total("revenue_usd").alias("total_revenue_usd"),
        mean(F.col("revenue_usd")).alias("avg_monthly_revenue"),
        mean(F.col("data_quality_score")).alias("avg_data_quality")],
        {"product_count": "product_id", "category_diversity": "l2_category"})
    return ordered(out, [("total_revenue_usd", "desc")])


# -- saved queries ---------------------------------------------------------------------------------------------------

def _product_totals(df: DataFrame) -> DataFrame:
    return df.groupBy("product_name", "shop_name", "l2_category").agg(
        total("revenue_usd").alias("total_revenue"),
        units().alias("total_units_sold"),
        mean(F.col("avg_unit_price_usd")).alias("avg_price"))


_BY_REVENUE = [("total_revenue", "desc"), ("product_name", "asc"), ("shop_name", "asc"), ("l2_category", "asc")]


def top_products_recent(df: DataFrame, cfg: Config, months: int = 6, k: int = 10) -> DataFrame:
    return top_k(_product_totals(min_quality(since(df, cfg, months=months), "0.95")), _BY_REVENUE, k)


def top_products_of_year(df: DataFrame, year: int, k: int = 20) -> DataFrame:
    chosen = min_quality(df.where(F.col("year") == year), "0.95")
    return top_k(_product_totals(chosen).drop("avg_price"), _BY_REVENUE, k)


def monthly_totals(df: DataFrame, keys: Sequence[str] = ("year", "month_num")) -> DataFrame:
    """Revenue and items per calendar month (dates inside a month are folded, or a lag would compare days)."""
    return min_quality(df, "0.70").groupBy(*keys).agg(
        total("revenue_usd").alias("total_revenue"), units().alias("total_items"))


def growth_percent(now: Column, before: Column) -> Column:
    now, before = now.cast("double"), before.cast("double")
    return F.round(F.try_divide(now - before, before) * 100, 2)


def mom_growth(df: DataFrame) -> DataFrame:
    months = lag_by(monthly_totals(df), ["year", "month_num"],
                    {"prev_month_revenue": "total_revenue", "prev_month_items": "total_items"})
    out = months.where("prev_month_revenue is not null").select(
        "year", "month_num", "total_revenue", "total_items", "prev_month_revenue",
        growth_percent(F.col("total_revenue"), F.col("prev_month_revenue")).alias("revenue_growth_pct"),
        growth_percent(F.col("total_items"), F.col("prev_month_items")).alias("volume_growth_pct"))
    return ordered(out, [("year", "desc"), ("month_num", "desc")])


def category_comparison(df: DataFrame, year: int) -> DataFrame:
    out = min_quality(df.where(F.col("year") == year), "0.70").groupBy("l1_category", "l2_category").agg(
        F.countDistinct("product_id").alias("product_count"),
        total("revenue_usd").alias("total_revenue"),
        mean(F.col("avg_unit_price_usd")).alias("avg_price_point"),
        units().alias("total_units_sold"))
    return ordered(share_of_total(out, "total_revenue", "revenue_share_pct"), [("total_revenue", "desc")])


def quality_issue_combinations(df: DataFrame) -> DataFrame:
    out = non_empty(df, "quality_flags").groupBy("quality_flags").agg(
        count_rows().alias("record_count"),
        mean(F.col("data_quality_score")).alias("avg_score"),
        mean(F.col("revenue_usd")).alias("avg_revenue"),
        total("revenue_usd").alias("total_revenue_affected"))
    return ordered(out, [("record_count", "desc"), ("quality_flags", "asc")])


def declining(df: DataFrame, cfg: Config, growth_below: str = "-0.20", months: int = 3, k: int = 50) -> DataFrame:
    chosen = min_quality(since(df, cfg, months=months), "0.90").where(
        F.col("mom_growth_pct") < F.lit(growth_below).cast(SCORE))
    columns = ["product_id", "product_name", "shop_name", "month", "revenue_usd", "mom_growth_pct",
               "data_quality_score"]
    return top_k(chosen.select(*columns), [("mom_growth_pct", "asc"), ("revenue_usd", "desc"), ("product_id", "asc"),
                                           ("shop_name", "asc"), ("month", "asc")], k)


def shop_category_matrix(df: DataFrame, year: int, minimum: int = 10000) -> DataFrame:
    out = min_quality(df.where(F.col("year") == year), "0.70").groupBy("shop_name", "l2_category").agg(
        F.countDistinct("product_id").alias("products"),
        units().alias("units_sold"),
        total("revenue_usd").alias("total_revenue"),
        mean(F.col("data_quality_score")).alias("avg_quality"))
    return ordered(out.where(F.col("total_revenue") > minimum), [("shop_name", "asc"), ("total_revenue", "desc")])


def freshness(df: DataFrame, keys: Sequence[str] = ("transformation_version",)) -> DataFrame:
    """Newest load and newest month, by version or (no keys) for the whole table."""
    return df.groupBy(*keys).agg(
        F.max("processed_timestamp").alias("last_load_time"),
        F.max("month").alias("latest_data_month"),
        count_rows().alias("total_records_loaded"),
        mean(F.col("data_quality_score")).alias("avg_quality_score")).transform(
        ordered, [("last_load_time", "desc"), *[(k, "asc") for k in keys]])


def quarantine_summary(df: DataFrame) -> DataFrame:
    out = df.groupBy("quarantine_reason").agg(
        count_rows().alias("record_count"), mean(F.col("data_quality_score")).alias("avg_quality_score"))
    return ordered(out, [("record_count", "desc"), ("quarantine_reason", "asc")])


def price_tier(c: Column) -> Column:
    return band(c, PRICE_TIERS, TOP_TIER, upper=True)


def price_tier_analysis(df: DataFrame, year: int) -> DataFrame:
    chosen = min_quality(df.where(F.col("year") == year), "0.90")
    out = chosen.withColumn("price_tier", price_tier(F.col("avg_unit_price_usd"))).groupBy(
        "l2_category", "price_tier").agg(
        F.countDistinct("product_id").alias("product_count"),
        units().alias("total_units"),
        total("revenue_usd").alias("total_revenue"),
        mean(F.col("avg_unit_price_usd")).alias("avg_price"))
    return ordered(out, [("l2_category", "asc"), ("avg_price", "asc")])


def quality_metrics_report(reports: DataFrame, k: int = 10) -> DataFrame:
    """Latest k run reports of the report table with three issue counts out of the issue map."""
    def issue(name: str) -> Column:
        return F.try_element_at("quality_issues", F.lit(name)).cast("bigint")

    out = reports.select(
        issue("INVALID_DATE").alias("invalid_dates"), issue("SYNTHETIC_PRODUCT_ID").alias("synthetic_ids"),
        issue("MISSING_PRODUCT_NAME").alias("missing_names"), "total_records", "records_passed", "records_warned",
        "records_failed", "pass_rate", "avg_quality_score", "execution_timestamp", "transformation_version")
    return top_k(out, [("execution_timestamp", "desc")], k)


# -- investigation queries -------------------------------------------------------------------------------------------

def flag_trend(df: DataFrame, flags: Mapping[str, str]) -> DataFrame:
    """Rows per month and flag; ``flags`` = output column -> flag."""
    out = non_empty(df, "quality_flags").groupBy("year", "month_num", "month").agg(
        *[F.count_if(has_flag(F.col("quality_flags"), f)).alias(c) for c, f in flags.items()])
    return ordered(out, [("year", "desc"), ("month_num", "desc")])


def quality_drops(df: DataFrame, threshold: str = "0.05") -> DataFrame:
    """Months whose average score fell by more than the threshold."""
    months = quality_trends(df, ["year", "month_num"]).select("year", "month_num", "avg_quality_score")
    lagged = lag_by(months, ["year", "month_num"], {"prev_score": "avg_quality_score"})
    change = F.col("avg_quality_score") - F.col("prev_score")
    return ordered(lagged.where(change < -float(threshold))
                   .withColumn("score_change_pct", F.round(change * 100, 2)), [("year", "desc"), ("month_num", "desc")])


def quality_issues_since(df: DataFrame, start: str, k: int = 20) -> DataFrame:
    out = non_empty(not_before(df, F.lit(start).cast("date")), "quality_flags").groupBy(
        "quality_flags").agg(count_rows().alias("record_count"), mean(F.col("data_quality_score")).alias("avg_score"),
                             total("revenue_usd").alias("total_revenue_affected"))
    return top_k(out, [("record_count", "desc"), ("quality_flags", "asc")], k)


def quarantine_review(quarantine: DataFrame, start: str, k: int = 100) -> DataFrame:
    """The k lowest scores with the size of their reason group; the groups are counted, not windowed."""
    chosen = not_before(quarantine, F.lit(start).cast("date"))
    lowest = top_k(chosen.select("quarantine_reason", "data_quality_score", "product_id", "product_name", "month"),
                   [("data_quality_score", "asc"), ("product_id", "asc"), ("month", "asc"), ("product_name", "asc"),
                    ("quarantine_reason", "asc")], k)
    return with_group_count(lowest, ["quarantine_reason"], chosen, "count_by_reason")


def flag_drilldown(df: DataFrame, flag: str, columns: Sequence[str], start: str | None = None,
                   k: int | None = None, order: Sequence[tuple[str, str]] = ()) -> DataFrame:
    """Rows that carry a flag; with ``k`` the first k of the given order."""
    chosen = df.where(has_flag(F.col("quality_flags"), flag))
    if start is not None:
        chosen = not_before(chosen, F.lit(start).cast("date"))
    chosen = chosen.select(*columns)
    return chosen if k is None else top_k(chosen, order, k)


def id_collisions(df: DataFrame) -> DataFrame:
    """Product ids that carry more than one name."""
    return df.groupBy("product_id").agg(
        count_rows().alias("occurrence_count"), F.countDistinct("product_name").alias("unique_products")
    ).where("unique_products > 1")


def revenue_loss(df: DataFrame, flag: str = "INVALID_REVENUE") -> DataFrame:
    worth = F.col("avg_unit_price_usd") * F.col("item_sold")
    return df.where(has_flag(F.col("quality_flags"), flag)).agg(
        count_rows().alias("affected_records"),
        (count_rows() * mean(worth)).alias("estimated_lost_revenue"))


def suspicious_growth_review(df: DataFrame, year: int, flag: str = "SUSPICIOUS_GROWTH", k: int = 50) -> DataFrame:
    """Flagged rows by absolute growth, each with the revenue of its product's flagged row before it.

    The k rows are chosen first; then the flagged rows of their products meet a broadcast of k rows, and each task folds
    what lies before a chosen row to the latest of it.  No product's rows are sorted in one task, as a lag would."""
    chosen = df.where((F.col("year") == year) & has_flag(F.col("quality_flags"), flag))
    order = ["month", "shop_name", "revenue_usd", "mom_growth_pct", "source_record_number"]
    chosen = chosen.select("product_id", "product_name", *order, F.struct(*order).alias("_at"),
                           F.abs("mom_growth_pct").alias("_size"))
    top = top_k(chosen, [("_size", "desc"), ("product_id", "asc"), *[(c, "asc") for c in order]], k)
    marks = top.select(F.col("product_id").alias("_product"), F.col("_at").alias("_mark"))
    before = chosen.join(F.broadcast(marks), (F.col("product_id") == F.col("_product")) & (F.col("_at") < F.col("_mark")))
    previous = before.groupBy("_product", "_mark").agg(F.max_by("revenue_usd", "_at").alias("prev_month_revenue"))
    return (top.join(previous, (F.col("product_id") == F.col("_product")) & (F.col("_at") == F.col("_mark")), "left")
            .select("product_name", "shop_name", "month", "revenue_usd", "mom_growth_pct", "prev_month_revenue"))


def pass_rate_by_month(df: DataFrame) -> DataFrame:
    return quality_trends(df).withColumn("pass_rate_pct", _pass_rate())


def _pass_rate() -> Column:
    return F.round(F.col("high_quality_count").cast("double") * 100 / F.col("total_records"), 2)


def quality_dashboard(df: DataFrame, from_year: int | None = None) -> DataFrame:
    trends = quality_trends(df if from_year is None else df.where(F.col("year") >= from_year))
    return trends.select("month", "total_records", _pass_rate().alias("pass_rate_pct"),
                         # through DECIMAL: 0.83125 has no exact DOUBLE and would round down
                         F.round(F.col("avg_quality_score").cast("decimal(20,10)"), 4).cast(SCORE).alias("avg_score"),
                         band(F.col("avg_quality_score"), RATING, "Poor").alias("quality_rating"))


def partition_counts(df: DataFrame) -> DataFrame:
    out = df.groupBy("year", "month_num").agg(
        count_rows().alias("record_count"), F.max("processed_timestamp").alias("last_processed"))
    return ordered(out, [("year", "desc"), ("month_num", "desc")])


def partition_gaps(df: DataFrame) -> DataFrame:
    """Calendar months between the first and the last partition that hold no row."""
    first_day = F.make_date("year", "month_num", F.lit(1))
    present = df.where("year is not null").groupBy("year", "month_num").agg(F.lit(1).alias("x")).drop("x")
    span = present.agg(F.min(first_day).alias("lo"), F.max(first_day).alias("hi")).where("lo is not null")
    expected = span.select(F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("d")).select(
        F.year("d").alias("year"), F.month("d").alias("month_num"))
    return expected.join(present, ["year", "month_num"], "left_anti")


def category_availability(df: DataFrame) -> DataFrame:
    out = min_quality(df, "0.95").groupBy("l2_category").agg(
        count_rows().alias("products"), F.max("month").alias("latest_month"))
    return ordered(out, [("products", "desc"), ("l2_category", "asc")])


def distinct_categories(df: DataFrame, listing: DataFrame | None = None) -> DataFrame:
    """Category names of the newest partition, one per case-insensitive spelling."""
    chosen = non_empty(min_quality(in_latest_partition(df, listing), "0.95"), "l2_category")
    out = chosen.groupBy(match_key(F.col("l2_category")).alias("k")).agg(
        F.min(F.btrim("l2_category")).alias("l2_category")).select("l2_category")
    return ordered(out, [("l2_category", "asc")])


def population_rate(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Filled rows and percentage for each column, all in one pass."""
    counted = df.agg(count_rows().alias("n"), *[F.count(c).alias(c) for c in columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("populated")) for c in columns])
    return counted.select(F.col("n").alias("total_records"), F.inline(pairs)).withColumn(
        "population_pct", F.round(F.try_divide(F.col("populated").cast("double") * 100, F.col("total_records")), 2))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(count_rows().alias("records"))


def totals(df: DataFrame) -> DataFrame:
    return df.agg(count_rows().alias("total_records"), mean(F.col("data_quality_score")).alias("avg_quality_score"))


def low_score_flags(df: DataFrame, below: str = "0.70") -> DataFrame:
    out = df.where(F.col("data_quality_score") < F.lit(below).cast(SCORE)).groupBy("quality_flags").agg(
        count_rows().alias("records"))
    return ordered(out, [("records", "desc"), ("quality_flags", "asc")])


def without_flag(df: DataFrame, flag: str, threshold: str = "0.90") -> DataFrame:
    """Rows of good quality that do not carry a flag; rows without flags stay."""
    return min_quality(df, threshold).where(~F.coalesce(has_flag(F.col("quality_flags"), flag), F.lit(False)))


def near_threshold(quarantine: DataFrame, score: str = "0.65", revenue: int = 10000) -> DataFrame:
    """Quarantined rows just under the limit and of high value, for manual release."""
    return quarantine.where((F.col("quarantine_reason") == "LOW_QUALITY_SCORE")
                            & (F.col("data_quality_score") >= F.lit(score).cast(SCORE))
                            & (F.col("revenue_usd") > revenue))


# -- trending products -----------------------------------------------------------------------------------------------

def best_row_per_product(df: DataFrame, grain: str = "row") -> DataFrame:
    """One row per product, name, shop and category: the one with the highest revenue, then growth (NULL lowest).
    ``grain='month'`` adds the rows of the period up instead of picking one."""
    keys = ["product_id", "product_name", "shop_name"]
    groups = df.groupBy(*keys, match_key(F.col("l2_category")).alias("category_key"))
    if grain == "month":
        return groups.agg(F.min("l2_category").alias("l2_category"), total("revenue_usd").alias("revenue_usd"),
                          F.max("mom_growth_pct").alias("mom_growth_pct"), units().alias("item_sold"))
    best = F.max(F.struct("revenue_usd", "mom_growth_pct", "item_sold", "l2_category"))
    return groups.agg(best.alias("b")).select(
        *keys, "category_key", "b.l2_category", "b.revenue_usd", "b.mom_growth_pct", "b.item_sold")


_TRENDING = [("revenue_usd", "desc"), ("mom_growth_pct", "desc"), ("product_id", "asc"), ("shop_name", "asc"),
             ("product_name", "asc")]


def with_revenue_rank(top: DataFrame) -> DataFrame:
    """Rank of an already limited frame."""
    return top.withColumn("revenue_rank", F.row_number().over(Window.orderBy(*_order(_TRENDING))).cast("bigint"))


def top_products(df: DataFrame, category: str, k: int = 5, grain: str = "row", listing: DataFrame | None = None
                 ) -> DataFrame:
    """The k best products of a category in the newest partition."""
    chosen = eq_ci(min_quality(in_latest_partition(df, listing), "0.95"), "l2_category", category)
    return with_revenue_rank(top_k(best_row_per_product(chosen, grain).drop("category_key"), _TRENDING, k))


def top_products_per_category(df: DataFrame, k: int = 5, grain: str = "row", listing: DataFrame | None = None
                              ) -> DataFrame:
    """``top_products`` for every category at once."""
    best = best_row_per_product(min_quality(in_latest_partition(df, listing), "0.95"), grain)
    return top_k_per(best, ["category_key"], _TRENDING, k).drop("category_key")


def trending_ranked(df: DataFrame, k: int) -> DataFrame:
    """Rows ranked by revenue inside their category, ties kept."""
    return top_k_per(min_quality(df, "0.95").select("l2_category", "product_name", "shop_name", "revenue_usd",
                                                    "mom_growth_pct"),
                     ["l2_category"], [("revenue_usd", "desc")], k, method="rank")


def top_rows_of_category(df: DataFrame, category: str, k: int = 5) -> DataFrame:
    """The k best single rows of one category over all periods."""
    chosen = min_quality(df.where(F.col("l2_category") == category), "0.95")
    return top_k(chosen.select("product_id", "l2_category", "product_name", "shop_name", "month", "revenue_usd",
                               "mom_growth_pct", "item_sold"),
                 [("revenue_usd", "desc"), ("product_id", "asc"), ("shop_name", "asc"), ("month", "asc"),
                  ("item_sold", "asc"), ("mom_growth_pct", "asc")], k)


def compat_view(df: DataFrame, renames: Mapping[str, str], casts: Mapping[str, tuple[str, str]] | None = None
                ) -> DataFrame:
    """New names beside the stored ones: ``renames`` old -> new, ``casts`` new -> (old, type).  A projection only."""
    extra = [F.col(old).cast(t).alias(new) for new, (old, t) in (casts or {}).items()]
    return df.select(*extra, *[F.col(c).alias(renames.get(c, c)) for c in df.columns])


def flag_matrix(df: DataFrame) -> DataFrame:
    """Rows per month with one column for each standard flag."""
    return flag_trend(df, {f.lower(): f for f in FLAGS})
