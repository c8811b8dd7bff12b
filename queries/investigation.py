"""Data-quality investigation, freshness, schema and change questions."""

from dataclasses import replace

from pyspark.sql import functions as F

from queries.analytics import (TRENDS, quarantine, run_reports, with_quarantine, with_reports)
from queries.base import CFG, YEAR, dmean, query, sales_curated, sales_stored, table, with_curated
from tillworks.operators import analytics as an
from tillworks.operators import audit, quality
from tillworks.schema import CURATED
from tillworks.session import scratch, stage
from tillworks.sources import tables


@query("a21_flag_trend", with_curated("""SELECT year, month_num, month,
  COUNT(*) FILTER (list_contains(string_split(quality_flags, ','), 'INVALID_DATE')) AS invalid_date_count,
  COUNT(*) FILTER (list_contains(string_split(quality_flags, ','), 'SYNTHETIC_PRODUCT_ID')) AS synthetic_id_count,
  COUNT(*) FILTER (list_contains(string_split(quality_flags, ','), 'MISSING_PRODUCT_NAME')) AS missing_name_count,
  COUNT(*) FILTER (list_contains(string_split(quality_flags, ','), 'INVALID_REVENUE')) AS invalid_revenue_count
FROM sales_curated WHERE quality_flags IS NOT NULL AND trim(quality_flags) != '' GROUP BY year, month_num, month"""))
def a21(spark, sf_dir):
    return an.flag_trend(sales_curated(spark, sf_dir), {
        "invalid_date_count": "INVALID_DATE", "synthetic_id_count": "SYNTHETIC_PRODUCT_ID",
        "missing_name_count": "MISSING_PRODUCT_NAME", "invalid_revenue_count": "INVALID_REVENUE"})


@query("a22_id_collisions", with_curated("""SELECT product_id % 100 AS product_id, COUNT(*) AS occurrence_count,
  COUNT(DISTINCT product_name) AS unique_products FROM sales_curated GROUP BY 1
HAVING COUNT(DISTINCT product_name) > 1"""))
def a22(spark, sf_dir):
    sales = sales_curated(spark, sf_dir)
    return an.id_collisions(sales.withColumn("product_id", F.col("product_id") % 100))


@query("a23_revenue_loss", with_curated(f"""SELECT COUNT(*) AS affected_records,
  COUNT(*) * {dmean("avg_unit_price_usd * item_sold")} AS estimated_lost_revenue FROM sales_curated
WHERE list_contains(string_split(quality_flags, ','), 'INVALID_REVENUE')"""))
def a23(spark, sf_dir):
    return an.revenue_loss(sales_curated(spark, sf_dir))


@query("a24_quality_dashboard", with_curated(f"""SELECT month, total_records,
  ROUND(CAST(high_quality_count AS DOUBLE) * 100 / total_records, 2) AS pass_rate_pct,
  CAST(ROUND(CAST(avg_quality_score AS DECIMAL(20,10)), 4) AS DECIMAL(5,4)) AS avg_score,
  CASE WHEN avg_quality_score >= 0.95 THEN 'Excellent' WHEN avg_quality_score >= 0.80 THEN 'Good'
    WHEN avg_quality_score >= 0.70 THEN 'Acceptable' ELSE 'Poor' END AS quality_rating
FROM ({TRENDS}) WHERE year >= 1998"""))
def a24(spark, sf_dir):
    return an.quality_dashboard(sales_curated(spark, sf_dir), 1998)


@query("a24b_pass_rate_by_month", with_curated(f"""SELECT *,
  ROUND(CAST(high_quality_count AS DOUBLE) * 100 / total_records, 2) AS pass_rate_pct FROM ({TRENDS})"""))
def a24b(spark, sf_dir):
    return an.pass_rate_by_month(sales_curated(spark, sf_dir))


@query("a25_partition_counts", with_curated("""SELECT year, month_num, COUNT(*) AS record_count,
  strftime(MAX(processed_timestamp), '%Y-%m-%d %H:%M:%S') AS last_processed
FROM sales_curated GROUP BY year, month_num"""))
def a25(spark, sf_dir):
    out = an.partition_counts(sales_curated(spark, sf_dir))
    return out.withColumn("last_processed", F.date_format("last_processed", "yyyy-MM-dd HH:mm:ss"))


@query("a25b_partition_gaps", with_curated("""SELECT CAST(year(d) AS INT) AS year, CAST(month(d) AS INT) AS month_num FROM (
  SELECT unnest(generate_series(MIN(make_date(year, month_num, 1)), MAX(make_date(year, month_num, 1)),
    INTERVAL 1 MONTH)) AS d FROM sales_curated WHERE month_num % 5 != 0) g
WHERE NOT EXISTS (SELECT 1 FROM sales_curated s WHERE s.month_num % 5 != 0 AND s.year = year(g.d)
  AND s.month_num = month(g.d))"""))
def a25b(spark, sf_dir):
    # May and October are taken out so that there are gaps to find
    return an.partition_gaps(sales_curated(spark, sf_dir).where("month_num % 5 != 0"))


@query("a26_category_availability", with_curated("""SELECT l2_category, COUNT(*) AS products, MAX(month) AS latest_month
FROM sales_curated WHERE data_quality_score >= 0.95 GROUP BY l2_category"""))
def a26(spark, sf_dir):
    return an.category_availability(sales_curated(spark, sf_dir))


@query("a28_population_rate", with_curated("""SELECT total_records, c AS column_name, populated,
  ROUND(CAST(populated AS DOUBLE) * 100 / total_records, 2) AS population_pct FROM (
  SELECT COUNT(*) AS total_records, [{'c': 'shop_name', 'n': COUNT(shop_name)},
    {'c': 'mom_growth_pct', 'n': COUNT(NULLIF(mom_growth_pct, 0))},
    {'c': 'quality_flags', 'n': COUNT(NULLIF(quality_flags, ''))}] AS items FROM sales_curated) t,
  LATERAL (SELECT i.c AS c, i.n AS populated FROM (SELECT unnest(t.items) AS i)) u"""))
def a28(spark, sf_dir):
    sales = sales_curated(spark, sf_dir).withColumns({
        "mom_growth_pct": F.nullif("mom_growth_pct", F.lit(0)), "quality_flags": F.nullif("quality_flags", F.lit(""))})
    return an.population_rate(sales, ["shop_name", "mom_growth_pct", "quality_flags"])


@query("a28b_value_counts", with_curated("SELECT l3_category, COUNT(*) AS records FROM sales_curated GROUP BY l3_category"))
def a28b(spark, sf_dir):
    return an.value_counts(sales_curated(spark, sf_dir), "l3_category")


@query("a32_tier_totals_check", with_curated(f"""SELECT year, month_num, month,
  total_records = high_quality_count + medium_quality_count + low_quality_count AS tiers_ok,
  avg_quality_score BETWEEN 0 AND 1 AS score_ok FROM ({TRENDS})"""))
def a32(spark, sf_dir):
    checked = quality.tier_totals_check(an.quality_trends(sales_curated(spark, sf_dir)))
    return checked.select("year", "month_num", "month", "tiers_ok", "score_ok")


@query("a33_totals", with_curated(f"""SELECT COUNT(*) AS total_records, {dmean("data_quality_score")} AS avg_quality_score
FROM sales_curated"""))
def a33(spark, sf_dir):
    return an.totals(sales_curated(spark, sf_dir))


@query("a33b_low_score_flags", with_curated("""SELECT quality_flags, COUNT(*) AS records FROM sales_curated
WHERE data_quality_score < 0.70 GROUP BY quality_flags"""))
def a33b(spark, sf_dir):
    return an.low_score_flags(sales_curated(spark, sf_dir))


@query("a34_report_validator", with_reports("""SELECT job_run_id, TRUE AS has_required, pass_rate >= 0.95 AS pass_rate_ok,
  avg_quality_score >= 0.95 AS avg_score_ok, TRUE AS issues_present,
  records_passed + records_warned + records_failed = total_records AS tiers_add_up FROM reports"""))
def a34(spark, sf_dir):
    return quality.validate_report(run_reports(spark, sf_dir))


@query("f10_report_health_bands", with_reports("""SELECT job_run_id, CASE
  WHEN LEAST(pass_rate, avg_quality_score) >= 0.95 THEN 'excellent' WHEN LEAST(pass_rate, avg_quality_score) >= 0.90
  THEN 'good' WHEN LEAST(pass_rate, avg_quality_score) >= 0.80 THEN 'acceptable' ELSE 'poor' END AS health
FROM reports"""))
def f10(spark, sf_dir):
    return quality.report_health(run_reports(spark, sf_dir)).select("job_run_id", "health")


@query("f08_flag_contains", with_curated("""SELECT COUNT(*) AS records FROM sales_curated
WHERE list_contains(string_split(quality_flags, ','), 'MISSING_ITEMS')"""))
def f08(spark, sf_dir):
    chosen = sales_curated(spark, sf_dir).where(quality.has_flag(F.col("quality_flags"), "MISSING_ITEMS"))
    return chosen.agg(an.count_rows().alias("records"))


@query("f08b_without_flag", with_curated("""SELECT product_id, month, shop_name, revenue_usd, quality_flags
FROM sales_curated WHERE data_quality_score >= 0.90
  AND NOT list_contains(string_split(quality_flags, ','), 'MISSING_ITEMS')"""))
def f08b(spark, sf_dir):
    return an.without_flag(sales_curated(spark, sf_dir), "MISSING_ITEMS").select(
        "product_id", "month", "shop_name", "revenue_usd", "quality_flags")


@query("f09_non_empty", with_curated("SELECT quality_flags FROM sales_curated WHERE trim(quality_flags) != ''"))
def f09(spark, sf_dir):
    return an.non_empty(sales_curated(spark, sf_dir), "quality_flags").select("quality_flags")


@query("f11_flag_drilldown_dates", with_curated("""SELECT source_file, source_record_number, month, quality_flags,
  data_quality_score FROM sales_curated WHERE list_contains(string_split(quality_flags, ','), 'INVALID_DATE')
ORDER BY source_record_number, month, source_file, data_quality_score LIMIT 50"""))
def f11(spark, sf_dir):
    return an.flag_drilldown(
        sales_stored(spark, sf_dir), "INVALID_DATE",
        ["source_file", "source_record_number", "month", "quality_flags", "data_quality_score"], k=50,
        order=[("source_record_number", "asc"), ("month", "asc"), ("source_file", "asc"),
               ("data_quality_score", "asc")])


@query("f11b_flag_drilldown_ids", with_curated("""SELECT product_id, product_name, shop_name, quality_flags,
  data_quality_score FROM sales_curated WHERE list_contains(string_split(quality_flags, ','), 'SYNTHETIC_PRODUCT_ID')
  AND month >= DATE '1999-04-01'"""))
def f11b(spark, sf_dir):
    return an.flag_drilldown(sales_stored(spark, sf_dir), "SYNTHETIC_PRODUCT_ID",
                             ["product_id", "product_name", "shop_name", "quality_flags", "data_quality_score"],
                             "1999-04-01")


@query("f11c_flag_drilldown_revenue", with_curated("""SELECT product_name, revenue_usd, avg_unit_price_usd, item_sold,
  quality_flags FROM sales_curated WHERE list_contains(string_split(quality_flags, ','), 'INVALID_REVENUE')
  AND month >= DATE '1999-04-01'"""))
def f11c(spark, sf_dir):
    return an.flag_drilldown(sales_curated(spark, sf_dir), "INVALID_REVENUE",
                             ["product_name", "revenue_usd", "avg_unit_price_usd", "item_sold", "quality_flags"],
                             "1999-04-01")


@query("f14_compat_view", with_curated("""SELECT CAST(product_id AS VARCHAR) AS product_id_old, product_id, shop_name,
  l1_category AS category_level_1, l2_category AS category_level_2, l3_category AS category_level_3
FROM sales_curated"""))
def f14(spark, sf_dir):
    sales = sales_curated(spark, sf_dir).select("product_id", "shop_name", "l1_category", "l2_category", "l3_category")
    return an.compat_view(sales, {f"l{i}_category": f"category_level_{i}" for i in (1, 2, 3)},
                          {"product_id_old": ("product_id", "string")})


@query("w08_quality_drops", with_curated("""SELECT year, month_num, avg_quality_score, prev_score,
  ROUND((avg_quality_score - prev_score) * 100, 2) AS score_change_pct FROM (
  SELECT *, LAG(avg_quality_score) OVER (ORDER BY year, month_num) AS prev_score FROM (
    SELECT year, month_num, CAST(SUM(data_quality_score) AS DOUBLE) / COUNT(*) AS avg_quality_score
    FROM sales_curated GROUP BY year, month_num))
WHERE avg_quality_score - prev_score < -0.002"""))
def w08(spark, sf_dir):
    return an.quality_drops(sales_curated(spark, sf_dir), "0.002")


@query("w09_quarantine_review", with_quarantine("""SELECT * FROM (SELECT quarantine_reason, data_quality_score, product_id,
  product_name, month, COUNT(*) OVER (PARTITION BY quarantine_reason) AS count_by_reason FROM quarantine
  WHERE month >= DATE '1999-04-01')
ORDER BY data_quality_score, product_id, month, product_name, quarantine_reason LIMIT 100"""))
def w09(spark, sf_dir):
    return an.quarantine_review(stage(quarantine(spark, sf_dir), "quarantine"), "1999-04-01")


@query("w09b_near_threshold", with_quarantine("""SELECT * FROM quarantine WHERE quarantine_reason = 'LOW_QUALITY_SCORE'
  AND data_quality_score >= 0.50 AND revenue_usd > 90000"""))
def w09b(spark, sf_dir):
    return an.near_threshold(quarantine(spark, sf_dir), "0.50", 90000)


@query("w10_suspicious_growth_review", with_curated(f"""SELECT product_name, shop_name, month, revenue_usd, mom_growth_pct,
  LAG(revenue_usd) OVER (PARTITION BY product_id ORDER BY month, shop_name, revenue_usd, mom_growth_pct,
    source_record_number) AS prev_month_revenue
FROM sales_curated WHERE list_contains(string_split(quality_flags, ','), 'SUSPICIOUS_GROWTH') AND year = {YEAR}
ORDER BY abs(mom_growth_pct) DESC, product_id, month, shop_name, revenue_usd, mom_growth_pct, source_record_number
LIMIT 50"""))
def w10(spark, sf_dir):
    return an.suspicious_growth_review(sales_stored(spark, sf_dir), YEAR)


# -- changes between snapshots ---------------------------------------------------------------------------------------

def snapshots(spark, sf_dir):
    """Orders as two states: one in seven is missing before, one in eleven after, one in five changed its status."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority")
    key = F.col("o_orderkey")
    changed = F.when(key % 5 == 0, "X").otherwise(F.col("o_orderstatus"))
    return orders.where(key % 7 != 0), orders.where(key % 11 != 0).withColumn("o_orderstatus", changed)


DIFF_SQL = """diff AS (SELECT COALESCE(b.o_orderkey, a.o_orderkey) AS o_orderkey, b.o_orderstatus AS status_before,
  a.o_orderstatus AS status_after, CASE WHEN b.o_orderkey IS NULL THEN 'INSERT' WHEN a.o_orderkey IS NULL THEN 'DELETE'
  WHEN a.o_orderstatus != b.o_orderstatus THEN 'UPDATE' END AS change_type
FROM (SELECT * FROM orders WHERE o_orderkey % 7 != 0) b FULL JOIN (SELECT o_orderkey, o_orderpriority,
  CASE WHEN o_orderkey % 5 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders WHERE o_orderkey % 11 != 0) a
ON a.o_orderkey = b.o_orderkey)"""


@query("j04_snapshot_diff", f"WITH {DIFF_SQL} SELECT * FROM diff WHERE change_type IS NOT NULL")
def j04(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    diff = audit.snapshot_diff(old, new, ["o_orderkey"])
    return diff.select("o_orderkey", F.col("before.o_orderstatus").alias("status_before"),
                       F.col("after.o_orderstatus").alias("status_after"), "change_type")


@query("j04b_change_metrics", f"""WITH {DIFF_SQL} SELECT COUNT(*) FILTER (change_type = 'INSERT') AS inserts,
  COUNT(*) FILTER (change_type = 'UPDATE') AS updates, COUNT(*) FILTER (change_type = 'DELETE') AS deletes,
  COUNT(change_type) AS total_changes FROM diff""")
def j04b(spark, sf_dir):
    old, new = snapshots(spark, sf_dir)
    return audit.change_counts(audit.snapshot_diff(old, new, ["o_orderkey"]))


def logged_events(spark, sf_dir):
    """Change events of two runs, the second one written twice, and the batch entry of each."""
    old, new = snapshots(spark, sf_dir)
    root = scratch(spark, "events")
    diff = audit.snapshot_diff(old, new, ["o_orderkey"])
    for run, part in (("first", diff.where("change_type = 'DELETE'")), ("second", diff.where("change_type <> 'DELETE'")), ("second", diff.where(
            "change_type <> 'DELETE'"))):
        cfg = replace(CFG, run_id=run)
        tables.write_events(audit.audit_events(part, cfg, "orders", ["o_orderkey"], metadata={"source": "snapshot"}), root, cfg, "orders")
        tables.write_log(audit.audit_batch(tables.read_events(spark, root, run=run), cfg), root, "audit-batches", cfg)
    return root


@query("s11_audit_events", f"""WITH {DIFF_SQL} SELECT change_type, 'orders' AS table_name, 'MERGE' AS operation,
  CAST(o_orderkey AS VARCHAR) AS record_id, status_before, status_after, CASE change_type WHEN 'DELETE' THEN 'first' ELSE 'second' END
  AS job_run_id FROM diff WHERE change_type IS NOT NULL""")
def s11(spark, sf_dir):
    events = tables.read_events(spark, logged_events(spark, sf_dir), "orders")
    return events.select("change_type", "table_name", "operation", "record_id",
                         F.col("before.o_orderstatus").alias("status_before"),
                         F.col("after.o_orderstatus").alias("status_after"), "job_run_id")


@query("s12_audit_batch", f"""WITH {DIFF_SQL}, kinds AS (SELECT CASE change_type WHEN 'DELETE' THEN 'first' ELSE 'second' END AS job_run_id,
  change_type, COUNT(*) AS record_count FROM diff WHERE change_type IS NOT NULL GROUP BY ALL)
SELECT 'BATCH_AUDIT' AS log_type, job_run_id, change_type, 'orders' AS table_name, 'MERGE' AS operation, record_count,
  CAST(SUM(record_count) OVER (PARTITION BY job_run_id) AS BIGINT) AS total_changes FROM kinds""")
def s12(spark, sf_dir):
    batches = spark.read.json(f"{logged_events(spark, sf_dir)}/audit-batches")
    return batches.select("log_type", "job_run_id", "total_changes", F.inline("changes")).select(
        "log_type", "job_run_id", "change_type", "table_name", "operation", "record_count", "total_changes")


@query("j02_reconciliation", with_reports("""SELECT job_run_id, TRUE AS in_both, TRUE AS total_records_ok,
  d % 2 = 0 AS records_passed_ok, TRUE AS pass_rate_ok, i % 2 = 0 AS avg_quality_score_ok,
  d % 2 = 0 AND i % 2 = 0 AS reconciled FROM reports"""))
def j02(spark, sf_dir):
    reports = run_reports(spark, sf_dir)
    n = lambda f: F.coalesce(F.try_element_at("quality_issues", F.lit(f)), F.lit(0))
    # a second frame with a wrong count, a ratio inside and a ratio outside the tolerance
    other = reports.withColumns({
        "records_passed": F.col("records_passed") + n("INVALID_DATE") % 2,
        "pass_rate": F.col("pass_rate") - F.lit(0.0001).cast("decimal(5,4)"),
        "avg_quality_score": F.col("avg_quality_score") - F.lit(0.0002).cast("decimal(5,4)")
        * (n("SYNTHETIC_PRODUCT_ID") % 2)})
    return audit.reconcile(reports, other, "job_run_id", ["total_records", "records_passed"],
                           ["pass_rate", "avg_quality_score"])


def schema_change_sql(table_name: str, changed: str) -> str:
    """Columns that differ between a table and a changed select of it, from what DuckDB says of both."""
    return f"""WITH a AS (SELECT column_name, column_type FROM (DESCRIBE SELECT * FROM {table_name})),
b AS (SELECT column_name, column_type FROM (DESCRIBE {changed}))
SELECT coalesce(a.column_name, b.column_name) AS column_name, CASE WHEN b.column_name IS NULL THEN 'missing'
  WHEN a.column_name IS NULL THEN 'added' ELSE 'type_changed' END AS change
FROM a FULL JOIN b ON a.column_name = b.column_name WHERE a.column_type IS DISTINCT FROM b.column_type"""


@query("o05_schema_diff", schema_change_sql("orders", """SELECT * EXCLUDE (o_custkey)
  REPLACE (CAST(o_totalprice AS DECIMAL(18,2)) AS o_totalprice), CAST(o_orderkey AS VARCHAR) AS o_name FROM orders"""))
def o05(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    found = orders.drop("o_custkey").withColumns({"o_totalprice": F.col("o_totalprice").cast("decimal(18,2)"),
                                                  "o_name": F.col("o_orderkey").cast("string")})
    diff = tables.schema_diff(tables.schema_frame(spark, orders.schema), tables.schema_frame(spark, found.schema))
    return diff.select("column_name", "change")


@query("f01_tier_routing", with_curated("""SELECT CASE WHEN data_quality_score >= 0.95 THEN 'pass'
  WHEN data_quality_score >= 0.70 THEN 'warn' ELSE 'fail' END AS tier, COUNT(*) AS records FROM sales_curated GROUP BY 1"""))
def f01(spark, sf_dir):
    return quality.with_tier(sales_curated(spark, sf_dir), CFG).groupBy("tier").agg(an.count_rows().alias("records"))


@query("f02_anomalies", with_curated("""SELECT product_id, month, revenue_usd, item_sold FROM sales_curated
WHERE revenue_usd > 90000 OR item_sold > 49"""))
def f02(spark, sf_dir):
    cfg = replace(CFG, anomaly_revenue_max=90000, anomaly_items_max=49)
    return sales_curated(spark, sf_dir).where(quality.is_anomaly(cfg)).select(
        "product_id", "month", "revenue_usd", "item_sold")


