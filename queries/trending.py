"""Newest-period ranking and category questions."""

from queries.base import (CURATED_SQL, query, sales_curated, sales_partitions, sales_stored, with_curated)
from tillworks.operators import analytics as an
from tillworks.operators import responses

LATEST = f"""{CURATED_SQL}, latest AS (
SELECT year, month_num FROM (SELECT DISTINCT year, month_num, ROW_NUMBER() OVER (ORDER BY year DESC, month_num DESC) AS rn
  FROM (SELECT DISTINCT year, month_num FROM sales_curated WHERE year IS NOT NULL)) WHERE rn = 1),
latest_data AS (SELECT p.* FROM sales_curated p JOIN latest USING (year, month_num) WHERE p.data_quality_score >= 0.95),
best AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY product_id, product_name, shop_name, lower(l2_category)
  ORDER BY revenue_usd DESC, mom_growth_pct DESC, item_sold DESC) AS rn FROM latest_data) WHERE rn = 1)"""
ORDER = "revenue_usd DESC, mom_growth_pct DESC, product_id, shop_name, product_name"


@query("w03_latest_partition", f"WITH {LATEST} SELECT year, month_num FROM latest")
def w03(spark, sf_dir):
    return an.latest_partition(sales_partitions(spark, sf_dir))


@query("f04_in_latest_partition", f"""WITH {LATEST} SELECT product_id, shop_name, month, revenue_usd FROM sales_curated
JOIN latest USING (year, month_num)""")
def f04(spark, sf_dir):
    return an.in_latest_partition(sales_stored(spark, sf_dir), sales_partitions(spark, sf_dir)).select("product_id", "shop_name", "month", "revenue_usd")


@query("w04_best_row_per_product", f"""WITH {LATEST} SELECT product_id, product_name, shop_name, l2_category, revenue_usd,
  mom_growth_pct, item_sold FROM best""")
def w04(spark, sf_dir):
    chosen = an.min_quality(an.in_latest_partition(sales_stored(spark, sf_dir), sales_partitions(spark, sf_dir)), "0.95")
    return an.best_row_per_product(chosen).drop("category_key")


@query("w04b_product_totals_of_period", f"""WITH {LATEST} SELECT product_id, product_name, shop_name,
  MIN(l2_category) AS l2_category, CAST(SUM(revenue_usd) AS DECIMAL(28,2)) AS revenue_usd,
  MAX(mom_growth_pct) AS mom_growth_pct, CAST(SUM(item_sold) AS BIGINT) AS item_sold
FROM latest_data GROUP BY product_id, product_name, shop_name, lower(l2_category)""")
def w04b(spark, sf_dir):
    chosen = an.min_quality(an.in_latest_partition(sales_stored(spark, sf_dir), sales_partitions(spark, sf_dir)), "0.95")
    return an.best_row_per_product(chosen, grain="month").drop("category_key")


@query("j01_w05_top_products_of_category", f"""WITH {LATEST} SELECT product_id, product_name, shop_name, l2_category,
  revenue_usd, mom_growth_pct, item_sold, ROW_NUMBER() OVER (ORDER BY {ORDER}) AS revenue_rank FROM best
WHERE lower(trim(l2_category)) = 'economy' QUALIFY revenue_rank <= 5""")
def j01(spark, sf_dir):
    return an.top_products(sales_stored(spark, sf_dir), "  Economy ", 5, listing=sales_partitions(spark, sf_dir))


@query("w06_top_products_per_category", f"""WITH {LATEST} SELECT product_id, product_name, shop_name, l2_category,
  revenue_usd, mom_growth_pct, item_sold, CAST(ROW_NUMBER() OVER (PARTITION BY lower(l2_category) ORDER BY {ORDER}) AS INT)
  AS revenue_rank FROM best QUALIFY revenue_rank <= 5""")
def w06(spark, sf_dir):
    return an.top_products_per_category(
        sales_stored(spark, sf_dir), 5, listing=sales_partitions(spark, sf_dir))


@query("w06b_rank_per_category", with_curated("""SELECT l2_category, product_name, shop_name, revenue_usd, mom_growth_pct,
  RANK() OVER (PARTITION BY l2_category ORDER BY revenue_usd DESC) AS revenue_rank FROM sales_curated
WHERE data_quality_score >= 0.95 QUALIFY revenue_rank <= 5"""))
def w06b(spark, sf_dir):
    return an.trending_ranked(sales_curated(spark, sf_dir), 5)


@query("w06c_top_rows_of_category", with_curated("""SELECT product_id, l2_category, product_name, shop_name, month,
  revenue_usd, mom_growth_pct, item_sold FROM sales_curated WHERE l2_category = 'ECONOMY' AND data_quality_score >= 0.95
ORDER BY revenue_usd DESC, product_id, shop_name, month, item_sold, mom_growth_pct LIMIT 5"""))
def w06c(spark, sf_dir):
    return an.top_rows_of_category(sales_curated(spark, sf_dir), "ECONOMY")


@query("f05_equality_ignoring_case", with_curated("""SELECT COUNT(*) AS records FROM sales_curated
WHERE lower(trim(l2_category)) = lower(trim(' ProMo '))"""))
def f05(spark, sf_dir):
    return an.eq_ci(sales_curated(spark, sf_dir), "l2_category", " ProMo ").agg(an.count_rows().alias("records"))


@query("a27_distinct_categories", f"""WITH {LATEST} SELECT MIN(trim(l2_category)) AS l2_category FROM latest_data
WHERE trim(l2_category) != '' GROUP BY lower(trim(l2_category))""")
def a27(spark, sf_dir):
    return an.distinct_categories(sales_stored(spark, sf_dir), sales_partitions(spark, sf_dir))




@query("t09_market_context", f"""WITH {LATEST}, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lower(l2_category)
  ORDER BY {ORDER}) AS r FROM best QUALIFY r <= 5)
SELECT l2_category, string_agg(r || '. ' || product_name || ' | Shop: ' || shop_name || ' | Revenue: $' ||
  format('{{:,}}', CAST(CASE WHEN revenue_usd % 1 = 0.5 AND CAST(floor(revenue_usd) AS BIGINT) % 2 = 0
    THEN floor(revenue_usd) ELSE ROUND(revenue_usd, 0) END AS BIGINT)) || ' | Growth: ' ||
  printf('%.1f', mom_growth_pct * 100) || '% | Items sold: ' || format('{{:,}}', item_sold), chr(10) ORDER BY r) AS context
FROM ranked GROUP BY l2_category""")
def t09(spark, sf_dir):
    return responses.market_context(an.top_products_per_category(
        sales_stored(spark, sf_dir), 5, listing=sales_partitions(spark, sf_dir)))


@query("t09b_short_descriptions", f"""WITH {LATEST}, ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lower(l2_category)
  ORDER BY {ORDER}) AS r FROM best QUALIFY r <= 5)
SELECT product_id, 'Top seller at ' || shop_name || '. $' || format('{{:,}}', CAST(CASE WHEN revenue_usd % 1 = 0.5
    AND CAST(floor(revenue_usd) AS BIGINT) % 2 = 0 THEN floor(revenue_usd) ELSE ROUND(revenue_usd, 0) END AS BIGINT))
  || ' revenue, ' || printf('%.1f', mom_growth_pct * 100) || '% growth (Last 30 Days).' AS short_description
FROM ranked""")
def t09b(spark, sf_dir):
    top = an.top_products_per_category(
        sales_stored(spark, sf_dir), 5, listing=sales_partitions(spark, sf_dir))
    return top.select("product_id", responses.short_description().alias("short_description"))


