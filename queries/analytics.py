"""Views and saved queries."""

from queries.base import (CFG, REV, UNITS, YEAR, dmean, query, sales_curated, sales_stored, table, with_curated)
from pyspark.sql import functions as F

from tillworks.operators import analytics as an
from tillworks.operators import quality

Q70 = "data_quality_score >= 0.70"


@query("a01_high_quality_products", with_curated("""SELECT month, product_id, product_name, shop_name, l1_category,
  l2_category, l3_category, item_sold, revenue_usd, avg_unit_price_usd, mom_growth_pct, data_quality_score,
  strftime(processed_timestamp, '%Y-%m-%d %H:%M:%S') AS processed_timestamp
FROM sales_curated WHERE data_quality_score >= 0.95 ORDER BY month DESC, revenue_usd DESC"""))
def a01(spark, sf_dir):
    out = an.high_quality_products(sales_curated(spark, sf_dir))
    return out.withColumn("processed_timestamp", F.date_format("processed_timestamp", "yyyy-MM-dd HH:mm:ss"))


@query("a02_sales_by_category_month", with_curated(f"""SELECT year, month_num, month, l1_category, l2_category,
  l3_category, COUNT(DISTINCT product_id) AS unique_products, COUNT(DISTINCT shop_name) AS unique_shops,
  {UNITS} AS total_items_sold, {REV} AS total_revenue_usd, {dmean("avg_unit_price_usd")} AS avg_product_price,
  {dmean("data_quality_score")} AS avg_quality_score
FROM sales_curated WHERE {Q70} GROUP BY ALL"""))
def a02(spark, sf_dir):
    return an.sales_by_category_month(sales_curated(spark, sf_dir))


TRENDS = f"""SELECT year, month_num, month, COUNT(*) AS total_records,
  COUNT(*) FILTER (data_quality_score >= 0.95) AS high_quality_count,
  COUNT(*) FILTER (data_quality_score >= 0.70 AND data_quality_score < 0.95) AS medium_quality_count,
  COUNT(*) FILTER (data_quality_score < 0.70) AS low_quality_count,
  {dmean("data_quality_score")} AS avg_quality_score, MIN(data_quality_score) AS min_quality_score,
  MAX(data_quality_score) AS max_quality_score, COUNT(DISTINCT transformation_version) AS transformation_versions
FROM sales_curated GROUP BY year, month_num, month"""


@query("a03_quality_trends", with_curated(TRENDS))
def a03(spark, sf_dir):
    return an.quality_trends(sales_curated(spark, sf_dir))


@query("a04_product_performance", with_curated(f"""SELECT product_id, product_name, shop_name, l1_category, l2_category,
  COUNT(DISTINCT month) AS months_on_market, {UNITS} AS lifetime_items_sold, {REV} AS lifetime_revenue_usd,
  {dmean("avg_unit_price_usd")} AS avg_price, {dmean("mom_growth_pct")} AS avg_mom_growth,
  MAX(revenue_usd) AS peak_monthly_revenue, {dmean("data_quality_score")} AS avg_quality_score
FROM sales_curated WHERE {Q70} GROUP BY product_id, product_name, shop_name, l1_category, l2_category
HAVING SUM(revenue_usd) > 0"""))
def a04(spark, sf_dir):
    return an.product_performance(sales_curated(spark, sf_dir))


@query("a05_shop_leaderboard", with_curated(f"""SELECT shop_name, COUNT(DISTINCT product_id) AS product_count,
  COUNT(DISTINCT l2_category) AS category_diversity, {UNITS} AS total_items_sold, {REV} AS total_revenue_usd,
  {dmean("revenue_usd")} AS avg_monthly_revenue, {dmean("data_quality_score")} AS avg_data_quality
FROM sales_curated WHERE {Q70} GROUP BY shop_name"""))
def a05(spark, sf_dir):
    return an.shop_leaderboard(sales_curated(spark, sf_dir))


@query("a06_top_products_recent", with_curated(f"""SELECT product_name, shop_name, l2_category, {REV} AS total_revenue,
  {UNITS} AS total_units_sold, {dmean("avg_unit_price_usd")} AS avg_price
FROM sales_curated WHERE month >= DATE '2001-11-04' - INTERVAL 6 MONTH AND data_quality_score >= 0.95
GROUP BY product_name, shop_name, l2_category
ORDER BY total_revenue DESC, product_name, shop_name, l2_category LIMIT 10"""))
def a06(spark, sf_dir):
    return an.top_products_recent(sales_stored(spark, sf_dir), CFG)


@query("a06b_top_products_of_year", with_curated(f"""SELECT product_name, shop_name, l2_category, {REV} AS total_revenue,
  {UNITS} AS total_units_sold
FROM sales_curated WHERE year = {YEAR} AND data_quality_score >= 0.95 GROUP BY product_name, shop_name, l2_category
ORDER BY total_revenue DESC, product_name, shop_name, l2_category LIMIT 20"""))
def a06b(spark, sf_dir):
    return an.top_products_of_year(sales_stored(spark, sf_dir), YEAR)


MONTHS = f"""SELECT year, month_num, {REV} AS total_revenue, {UNITS} AS total_items FROM sales_curated
WHERE {Q70} GROUP BY year, month_num"""


@query("a07_monthly_totals", with_curated(MONTHS))
def a07(spark, sf_dir):
    return an.monthly_totals(sales_curated(spark, sf_dir))


@query("a08_category_comparison", with_curated(f"""SELECT l1_category, l2_category,
  COUNT(DISTINCT product_id) AS product_count, {REV} AS total_revenue,
  {dmean("avg_unit_price_usd")} AS avg_price_point, {UNITS} AS total_units_sold,
  ROUND(CAST({REV} AS DOUBLE) * 100 / CAST(SUM({REV}) OVER () AS DOUBLE), 2) AS revenue_share_pct
FROM sales_curated WHERE year = {YEAR} AND {Q70} GROUP BY l1_category, l2_category"""))
def a08(spark, sf_dir):
    return an.category_comparison(sales_stored(spark, sf_dir), YEAR)


@query("a09_quality_issue_combinations", with_curated(f"""SELECT quality_flags, COUNT(*) AS record_count,
  {dmean("data_quality_score")} AS avg_score, {dmean("revenue_usd")} AS avg_revenue, {REV} AS total_revenue_affected
FROM sales_curated WHERE quality_flags IS NOT NULL AND quality_flags != '' GROUP BY quality_flags"""))
def a09(spark, sf_dir):
    return an.quality_issue_combinations(sales_curated(spark, sf_dir))


@query("a09b_quality_issues_since", with_curated(f"""SELECT quality_flags, COUNT(*) AS record_count,
  {dmean("data_quality_score")} AS avg_score, {REV} AS total_revenue_affected
FROM sales_curated WHERE quality_flags != '' AND month >= DATE '1999-04-01' GROUP BY quality_flags
ORDER BY record_count DESC, quality_flags LIMIT 20"""))
def a09b(spark, sf_dir):
    return an.quality_issues_since(sales_stored(spark, sf_dir), "1999-04-01")


@query("a10_shop_category_matrix", with_curated(f"""SELECT shop_name, l2_category, COUNT(DISTINCT product_id) AS products,
  {UNITS} AS units_sold, {REV} AS total_revenue, {dmean("data_quality_score")} AS avg_quality
FROM sales_curated WHERE year = {YEAR} AND {Q70} GROUP BY shop_name, l2_category HAVING SUM(revenue_usd) > 10000"""))
def a10(spark, sf_dir):
    return an.shop_category_matrix(sales_stored(spark, sf_dir), YEAR)


def _fresh(keys: str) -> str:
    group = f"GROUP BY {keys}" if keys else ""
    return f"""SELECT {keys + ',' if keys else ''}
  strftime(MAX(processed_timestamp), '%Y-%m-%d %H:%M:%S') AS last_load_time, MAX(month) AS latest_data_month,
  COUNT(*) AS total_records_loaded, {dmean("data_quality_score")} AS avg_quality_score FROM sales_curated {group}"""


@query("a11_freshness_by_version", with_curated(_fresh("transformation_version")))
def a11(spark, sf_dir):
    out = an.freshness(sales_curated(spark, sf_dir))
    return out.withColumn("last_load_time", F.date_format("last_load_time", "yyyy-MM-dd HH:mm:ss"))


@query("a11b_freshness_overall", with_curated(_fresh("")))
def a11b(spark, sf_dir):
    out = an.freshness(sales_curated(spark, sf_dir), [])
    return out.withColumn("last_load_time", F.date_format("last_load_time", "yyyy-MM-dd HH:mm:ss"))


def quarantine(spark, sf_dir):
    """Low scores and anomalies of the sales table, a row of both kinds twice; the limits fit the table."""
    from dataclasses import replace
    cfg = replace(CFG, anomaly_revenue_max=90000, anomaly_items_max=49)
    sales = quality.with_tier(sales_curated(spark, sf_dir), cfg)
    return quality.quarantine_rows(sales.where("tier = 'fail'"), "LOW_QUALITY_SCORE").unionByName(
        quality.quarantine_rows(sales.where("anomaly"), "ANOMALY_DETECTED"))


QUARANTINE_SQL = """quarantine AS (
SELECT 'LOW_QUALITY_SCORE' AS quarantine_reason, data_quality_score, quality_flags, product_id, product_name, month,
  revenue_usd, item_sold FROM sales_curated WHERE data_quality_score < 0.70
UNION ALL SELECT 'ANOMALY_DETECTED', data_quality_score, quality_flags, product_id, product_name, month,
  revenue_usd, item_sold FROM sales_curated WHERE revenue_usd > 90000 OR item_sold > 49)"""


def with_quarantine(sql: str) -> str:
    from queries.base import CURATED_SQL
    return f"WITH {CURATED_SQL},\n{QUARANTINE_SQL}\n{sql}"


@query("a12_quarantine_summary", with_quarantine(f"""SELECT quarantine_reason, COUNT(*) AS record_count,
  {dmean("data_quality_score")} AS avg_quality_score FROM quarantine GROUP BY quarantine_reason"""))
def a12(spark, sf_dir):
    return an.quarantine_summary(quarantine(spark, sf_dir))


PRICE_CASE = """CASE WHEN avg_unit_price_usd < 10 THEN 'Budget (<$10)' WHEN avg_unit_price_usd < 25
  THEN 'Mid-Range ($10-$25)' WHEN avg_unit_price_usd < 50 THEN 'Premium ($25-$50)' ELSE 'Luxury (>$50)' END"""


@query("a13_price_tier_analysis", with_curated(f"""SELECT l2_category, {PRICE_CASE} AS price_tier,
  COUNT(DISTINCT product_id) AS product_count, {UNITS} AS total_units, {REV} AS total_revenue,
  {dmean("avg_unit_price_usd")} AS avg_price
FROM sales_curated WHERE data_quality_score >= 0.90 AND year = {YEAR} GROUP BY 1, 2"""))
def a13(spark, sf_dir):
    return an.price_tier_analysis(sales_stored(spark, sf_dir), YEAR)


def run_reports(spark, sf_dir):
    """One report per run: each calendar month of the sales table counts as a run."""
    sales = quality.with_tier(sales_curated(spark, sf_dir), CFG)
    has = lambda f: F.count_if(quality.has_flag(F.col("quality_flags"), f))
    out = sales.groupBy("year", "month_num").agg(
        F.count(F.lit(1)).alias("total_records"), F.count_if(F.col("tier") == "pass").alias("records_passed"),
        F.count_if(F.col("tier") == "warn").alias("records_warned"),
        F.count_if(F.col("tier") == "fail").alias("records_failed"), F.lit(0).cast("bigint").alias("records_duplicates"),
        F.sum("data_quality_score").alias("s"), F.min("transformation_version").alias("transformation_version"),
        has("INVALID_DATE").alias("d"), has("SYNTHETIC_PRODUCT_ID").alias("i"))
    total = F.col("total_records").cast("decimal(20,0)")
    return out.select(
        F.format_string("run-%04d-%02d", "year", "month_num").alias("job_run_id"),
        F.make_date("year", "month_num", F.lit(1)).cast("timestamp").alias("execution_timestamp"),
        F.lit("landing").alias("source_file"), "total_records", "records_passed", "records_warned", "records_failed",
        "records_duplicates", F.round(F.col("records_passed") / total, 4).cast("decimal(5,4)").alias("pass_rate"),
        F.map_filter(F.create_map(F.lit("INVALID_DATE"), F.col("d"), F.lit("SYNTHETIC_PRODUCT_ID"), F.col("i")),
                     lambda _, n: n > 0).alias("quality_issues"),
        F.round(F.col("s") / total, 4).cast("decimal(5,4)").alias("avg_quality_score"), "transformation_version")


REPORTS_SQL = """reports AS (
SELECT printf('run-%04d-%02d', year, month_num) AS job_run_id, make_date(year, month_num, 1) AS execution_date,
  COUNT(*) AS total_records, COUNT(*) FILTER (data_quality_score >= 0.95) AS records_passed,
  COUNT(*) FILTER (data_quality_score >= 0.70 AND data_quality_score < 0.95) AS records_warned,
  COUNT(*) FILTER (data_quality_score < 0.70) AS records_failed,
  CAST(ROUND(COUNT(*) FILTER (data_quality_score >= 0.95) / COUNT(*), 4) AS DECIMAL(5,4)) AS pass_rate,
  CAST(ROUND(CAST(SUM(data_quality_score) AS DOUBLE) / COUNT(*), 4) AS DECIMAL(5,4)) AS avg_quality_score,
  MIN(transformation_version) AS transformation_version,
  COUNT(*) FILTER (quality_flags LIKE '%INVALID_DATE%') AS d,
  COUNT(*) FILTER (quality_flags LIKE '%SYNTHETIC_PRODUCT_ID%') AS i
FROM sales_curated GROUP BY year, month_num)"""


def with_reports(sql: str) -> str:
    from queries.base import CURATED_SQL
    return f"WITH {CURATED_SQL},\n{REPORTS_SQL}\n{sql}"


@query("a14_quality_metrics_report", with_reports("""SELECT NULLIF(d, 0) AS invalid_dates,
  NULLIF(i, 0) AS synthetic_ids, CAST(NULL AS BIGINT) AS missing_names, total_records, records_passed,
  records_warned, records_failed, pass_rate, avg_quality_score, execution_date AS execution_timestamp,
  transformation_version FROM reports ORDER BY execution_timestamp DESC LIMIT 10"""))
def a14(spark, sf_dir):
    out = an.quality_metrics_report(run_reports(spark, sf_dir))
    return out.withColumn("execution_timestamp", F.to_date("execution_timestamp"))


@query("w01_mom_growth", with_curated(f"""SELECT year, month_num, total_revenue, total_items, prev_month_revenue,
  ROUND((CAST(total_revenue AS DOUBLE) - CAST(prev_month_revenue AS DOUBLE)) / CAST(prev_month_revenue AS DOUBLE) * 100, 2)
    AS revenue_growth_pct,
  ROUND((CAST(total_items AS DOUBLE) - CAST(prev_items AS DOUBLE)) / CAST(prev_items AS DOUBLE) * 100, 2)
    AS volume_growth_pct
FROM (SELECT *, LAG(total_revenue) OVER (ORDER BY year, month_num) AS prev_month_revenue,
  LAG(total_items) OVER (ORDER BY year, month_num) AS prev_items FROM ({MONTHS})) WHERE prev_month_revenue IS NOT NULL"""))
def w01(spark, sf_dir):
    return an.mom_growth(sales_curated(spark, sf_dir))


@query("w07_share_of_total", with_curated(f"""SELECT shop_name, {REV} AS revenue,
  ROUND(CAST({REV} AS DOUBLE) * 100 / CAST(SUM({REV}) OVER () AS DOUBLE), 2) AS share_pct
FROM sales_curated GROUP BY shop_name"""))
def w07(spark, sf_dir):
    shops = sales_curated(spark, sf_dir).groupBy("shop_name").agg(an.total("revenue_usd").alias("revenue"))
    return an.share_of_total(shops, "revenue", "share_pct")


@query("f03_quality_thresholds", with_curated("""SELECT '0.95' AS threshold, COUNT(*) AS records FROM sales_curated
WHERE data_quality_score >= 0.95 UNION ALL SELECT '0.90', COUNT(*) FROM sales_curated WHERE data_quality_score >= 0.90
UNION ALL SELECT '0.70', COUNT(*) FROM sales_curated WHERE data_quality_score >= 0.70"""))
def f03(spark, sf_dir):
    sales = sales_curated(spark, sf_dir)
    parts = [an.min_quality(sales, t).agg(an.count_rows().alias("records")).select(F.lit(t).alias("threshold"), "records")
             for t in ("0.95", "0.90", "0.70")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("f06_relative_windows", with_curated(f"""SELECT 'months' AS span, COUNT(*) AS records FROM sales_curated
WHERE month >= DATE '2001-11-04' - INTERVAL 6 MONTH UNION ALL
SELECT 'days', COUNT(*) FROM sales_curated WHERE month >= DATE '2001-11-04' - 7 UNION ALL
SELECT 'year', COUNT(*) FROM sales_curated WHERE year = 2001"""))
def f06(spark, sf_dir):
    sales = sales_stored(spark, sf_dir)
    spans = {"months": an.since(sales, CFG, months=6), "days": an.since(sales, CFG, days=7),
             "year": sales.where(F.col("year") == CFG.as_of.year)}
    counted = [d.agg(an.count_rows().alias("records")).select(F.lit(n).alias("span"), "records")
               for n, d in spans.items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


@query("f07_current_and_previous_month", with_curated("""SELECT year, month_num, COUNT(*) AS records FROM sales_curated
WHERE year * 12 + month_num BETWEEN 2001 * 12 + 10 AND 2001 * 12 + 11 GROUP BY year, month_num"""))
def f07(spark, sf_dir):
    recent = an.current_and_previous_month(sales_stored(spark, sf_dir), CFG)
    return recent.groupBy("year", "month_num").agg(an.count_rows().alias("records"))


@query("f12_declining_products", with_curated("""SELECT product_id, product_name, shop_name, month, revenue_usd,
  mom_growth_pct, data_quality_score FROM sales_curated
WHERE mom_growth_pct < -0.05 AND data_quality_score >= 0.90 AND month >= DATE '2001-11-04' - INTERVAL 3 MONTH
ORDER BY mom_growth_pct, revenue_usd DESC, product_id, shop_name, month LIMIT 50"""))
def f12(spark, sf_dir):
    return an.declining(sales_stored(spark, sf_dir), CFG, "-0.05")


@query("o01_ordered_output", with_curated("""SELECT l1_category, l2_category, MAX(mom_growth_pct) AS best
FROM sales_curated GROUP BY l1_category, l2_category ORDER BY best DESC NULLS LAST, l1_category, l2_category"""))
def o01(spark, sf_dir):
    best = sales_curated(spark, sf_dir).groupBy("l1_category", "l2_category").agg(F.max("mom_growth_pct").alias("best"))
    return an.ordered(best, [("best", "desc"), ("l1_category", "asc"), ("l2_category", "asc")])


@query("o02_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def o02(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return an.top_k(orders, [("o_totalprice", "desc"), ("o_orderkey", "asc")], 100)


@query("o03_union_all", with_curated("""SELECT tier, COUNT(*) AS records FROM (
SELECT 'pass' AS tier FROM sales_curated WHERE data_quality_score >= 0.95 UNION ALL
SELECT 'warn' FROM sales_curated WHERE data_quality_score >= 0.70 AND data_quality_score < 0.95) GROUP BY tier"""))
def o03(spark, sf_dir):
    sales = quality.with_tier(sales_curated(spark, sf_dir), CFG)
    both = sales.where("tier = 'pass'").unionByName(sales.where("tier = 'warn'"))
    return both.groupBy("tier").agg(an.count_rows().alias("records"))


@query("o04_distinct_partitions", with_curated("SELECT DISTINCT year, month_num FROM sales_curated"))
def o04(spark, sf_dir):
    return sales_curated(spark, sf_dir).select("year", "month_num").distinct()
