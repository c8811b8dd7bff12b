"""Cleaning of untidy sales rows."""

from dataclasses import replace
from decimal import Decimal

from pyspark.sql import functions as F

from queries.base import CFG, RAW_ORDER, query, sales_raw, table, with_curated, with_raw, sales_curated
from tillworks.functions import parse, text
from tillworks.operators import analytics as an
from tillworks.operators import cleaning, dedup, quality
from tillworks.session import stage

KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def cleaned(spark, sf_dir, cfg=CFG):
    return quality.with_tier(cleaning.clean(sales_raw(spark, sf_dir), cfg), cfg)


def cleaned_stored(spark, sf_dir, cfg=CFG):
    """The cleaned rows as a written table, as a load stages them."""
    return stage(cleaned(spark, sf_dir, cfg), "cleaned")


@query("p01_dates", with_raw(f"SELECT {KEYS}, month FROM parsed"))
def p01(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(*KEY, parse.parse_date(F.col("month_raw")).alias("month"))


@query("p02_product_ids", with_raw(f"SELECT {KEYS}, id FROM parsed"))
def p02(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(*KEY, parse.parse_id(F.col("product_id_raw")).alias("id"))


@query("p02b_product_ids_via_double", with_raw(f"""SELECT {KEYS}, CASE WHEN id IS NOT NULL
  THEN CAST(TRY_CAST(product_id_raw AS DOUBLE) AS BIGINT) END AS id FROM parsed"""))
def p02b(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(*KEY, parse.parse_id(F.col("product_id_raw"), via_double=True).alias("id"))


@query("p03_text", with_raw(f"SELECT {KEYS}, left(product_name, 9) AS product_name, shop_name, l2 FROM parsed"))
def p03(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(
        *KEY, parse.parse_text(F.col("product_name_raw"), 9).alias("product_name"),
        parse.parse_text(F.col("shop_name_raw")).alias("shop_name"),
        parse.parse_text(F.col("l2_category_raw")).alias("l2"))


@query("p03b_text_of_documents", """SELECT doc_id,
  NULLIF(left(regexp_replace(trim(regexp_replace(text, '[\\s\\x1c-\\x1f\\x85\\p{Z}]+', ' ', 'g')), '[\\x00-\\x1f]', '', 'g'),
    200), '') AS clean_text FROM documents""")
def p03b(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", parse.parse_text(F.col("text"), 200).alias("clean_text"))


@query("p04_money", with_raw(f"SELECT {KEYS}, revenue, price FROM ranged"))
def p04(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(*KEY, parse.parse_money(F.col("revenue_raw")).alias("revenue"),
                                           parse.parse_money(F.col("avg_unit_price_raw")).alias("price"))


@query("p05_percent", with_raw(f"""SELECT {KEYS}, CASE WHEN points BETWEEN -100 AND 1000
  THEN CAST(points / 100 AS DECIMAL(6,4)) END AS growth FROM parsed"""))
def p05(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(*KEY, parse.parse_percent(F.col("mom_growth_raw")).alias("growth"))


@query("p06_integers", with_raw(f"SELECT {KEYS}, items FROM ranged"))
def p06(spark, sf_dir):
    return sales_raw(spark, sf_dir).select(*KEY, parse.parse_int(F.col("item_sold_raw")).alias("items"))


@query("p07_default_fill", with_raw(f"""SELECT {KEYS}, l2_category, revenue_usd, avg_unit_price_usd, item_sold, shop_name,
  mom_growth_pct FROM scored"""))
def p07(spark, sf_dir):
    return cleaned(spark, sf_dir).select(*KEY, "l2_category", "revenue_usd", "avg_unit_price_usd", "item_sold",
                                         "shop_name", "mom_growth_pct")


@query("p08_synthetic_ids", with_raw("""SELECT month, shop_name, COUNT(*) AS records, COUNT(*) AS ids FROM scored
WHERE id IS NULL GROUP BY month, shop_name"""))
def p08(spark, sf_dir):
    # every row without an id gets one of its own, equal rows included
    rows = dedup.kept_rows(dedup.fold_copies(cleaned(spark, sf_dir).where("product_id is null")))
    return rows.groupBy("month", "shop_name").agg(an.count_rows().alias("records"),
                                                  F.countDistinct("product_id").alias("ids"))


@query("p09_quality_flags", with_raw(f"SELECT {KEYS}, quality_flags FROM scored"))
def p09(spark, sf_dir):
    return cleaned(spark, sf_dir).select(*KEY, "quality_flags")


@query("p10_quality_score", with_raw("""SELECT data_quality_score, quality_flags, COUNT(*) AS records FROM scored
GROUP BY data_quality_score, quality_flags"""))
def p10(spark, sf_dir):
    return cleaned(spark, sf_dir).groupBy("data_quality_score", "quality_flags").agg(an.count_rows().alias("records"))


@query("p10b_quality_score_strict", with_raw("""SELECT CAST(data_quality_score + CASE WHEN wild THEN 0.05 ELSE 0 END
  AS DECIMAL(5,4)) AS data_quality_score, COUNT(*) AS records FROM scored GROUP BY 1"""))
def p10b(spark, sf_dir):
    return cleaned(spark, sf_dir, replace(CFG, strict_reference=True)).groupBy("data_quality_score").agg(
        an.count_rows().alias("records"))


@query("p11_governance", with_raw("""SELECT transformation_version, created_by, run_time, COUNT(*) AS records FROM (
SELECT 'v1.0.0' AS transformation_version, 'tillworks' AS created_by, '2001-11-04 02:00:00' AS run_time FROM scored)
GROUP BY ALL"""))
def p11(spark, sf_dir):
    stamped = cleaning.add_governance(cleaned(spark, sf_dir), CFG)
    return stamped.groupBy("transformation_version", "created_by", F.date_format(
        "processed_timestamp", "yyyy-MM-dd HH:mm:ss").alias("run_time")).agg(an.count_rows().alias("records"))


@query("p12_record_hash", with_curated("""SELECT source_record_number, product_id, md5(concat_ws('||',
  CAST(product_id AS VARCHAR), CAST(month AS VARCHAR), shop_name, product_name, CAST(revenue_usd AS VARCHAR)))
  AS record_hash FROM sales_curated"""))
def p12(spark, sf_dir):
    return sales_curated(spark, sf_dir).select("source_record_number", "product_id",
                                               cleaning.record_hash(CFG).alias("record_hash"))


@query("p13_record_key", with_raw(f"SELECT {KEYS}, record_key FROM scored"))
def p13(spark, sf_dir):
    return cleaned(spark, sf_dir).select(*KEY, "record_key")


@query("p14_partition_columns", with_raw("SELECT year, month_num, COUNT(*) AS records FROM scored GROUP BY year, month_num"))
def p14(spark, sf_dir):
    return cleaned(spark, sf_dir).groupBy("year", "month_num").agg(an.count_rows().alias("records"))


@query("p15_typed_projection", with_raw("""SELECT month, product_name, shop_name, l2_category, item_sold, revenue_usd,
  CAST(avg_unit_price_usd AS DECIMAL(10,2)) AS avg_unit_price_usd, mom_growth_pct, data_quality_score, quality_flags,
  year, month_num FROM scored"""))
def p15(spark, sf_dir):
    stamped = cleaning.add_governance(cleaned(spark, sf_dir), CFG).withColumn("source_record_number", F.lit(0))
    return cleaning.to_curated(stamped).select(
        "month", "product_name", "shop_name", "l2_category", "item_sold", "revenue_usd", "avg_unit_price_usd",
        "mom_growth_pct", "data_quality_score", "quality_flags", "year", "month_num")


@query("p16_numeric_repair", with_raw(f"""SELECT {KEYS}, COALESCE(TRY_CAST(trim(product_id_raw) AS DECIMAL(20,0)), 0)
  AS product_id, COALESCE(TRY_CAST(trim(avg_unit_price_raw) AS DOUBLE), 0) AS price FROM sales_raw"""))
def p16(spark, sf_dir):
    raw = sales_raw(spark, sf_dir).select(*KEY, F.col("product_id_raw").alias("product_id"),
                                          F.col("avg_unit_price_raw").alias("price"))
    return cleaning.repair_numeric(raw, {"product_id": "decimal(20,0)", "price": "double"})


@query("w02_dedup_kept", with_raw("""SELECT id, month, shop_name, l_orderkey, l_linenumber, revenue_usd, quality_flags
FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, month, shop_name ORDER BY l_orderkey, l_linenumber, l_partkey,
  l_suppkey, l_shipdate, l_quantity) AS n FROM scored) WHERE n = 1"""))
def w02(spark, sf_dir):
    rows = cleaned(spark, sf_dir).withColumnRenamed("product_id", "id")
    rows = rows.select("id", "month", "shop_name", *RAW_ORDER, "revenue_usd", "quality_flags")
    kept, _ = dedup.dedup(rows, ["id", "month", "shop_name"], RAW_ORDER)
    return kept.select("id", "month", "shop_name", "l_orderkey", "l_linenumber", "revenue_usd", "quality_flags")


@query("w02c_dedup_stored", with_raw("""SELECT id, month, shop_name, l_orderkey, l_linenumber, revenue_usd, quality_flags,
  copies FROM (SELECT *, COUNT(*) OVER (PARTITION BY id, month, shop_name) AS copies,
  ROW_NUMBER() OVER (PARTITION BY id, month, shop_name ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
  l_quantity) AS n FROM scored) WHERE n = 1"""))
def w02c(spark, sf_dir):
    rows = cleaned_stored(spark, sf_dir).withColumnRenamed("product_id", "id")
    folded = dedup.first_per_key(rows, ["id", "month", "shop_name"], RAW_ORDER, stored=True)
    return folded.select("id", "month", "shop_name", "l_orderkey", "l_linenumber", "revenue_usd", "quality_flags", "copies")


@query("w02b_dedup_by_month", with_raw("""SELECT id, year, month_num, shop_name, COUNT(*) - 1 AS dropped FROM scored
GROUP BY id, year, month_num, shop_name HAVING COUNT(*) > 1"""))
def w02b(spark, sf_dir):
    rows = cleaned(spark, sf_dir).withColumnRenamed("product_id", "id")
    keys = ["id", "year", "month_num", "shop_name"]
    _, extra = dedup.dedup(rows, keys, RAW_ORDER)
    return extra.groupBy(*keys).agg(an.count_rows().alias("dropped"))


@query("s08_duplicate_errors", with_raw("""SELECT 'DUPLICATE_RECORD' AS error_reason, concat_ws(', ',
  'product_id=' || id, 'month=' || month, 'shop_name=' || shop_name) AS raw_record FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY id, month, shop_name) AS n FROM scored WHERE id IS NOT NULL) WHERE n > 1"""))
def s08(spark, sf_dir):
    folded = dedup.fold_copies(cleaned(spark, sf_dir))
    return dedup.duplicates_to_errors(dedup.duplicate_keys(folded), CFG).drop("error_timestamp")


@query("own_rule_small_sales", with_raw(f"""SELECT {KEYS}, concat_ws(',', NULLIF(quality_flags, ''),
  CASE WHEN items < 5 THEN 'SMALL_SALE' END) AS quality_flags,
  CAST(data_quality_score - CASE WHEN items < 5 THEN 0.10 ELSE 0 END AS DECIMAL(5,4)) AS data_quality_score FROM scored"""))
def own_rule(spark, sf_dir):
    rule = cleaning.Rule("SMALL_SALE", F.col("item_sold") < 5, Decimal("0.10"))
    rows = cleaning.clean(sales_raw(spark, sf_dir), CFG, own_rules=[rule])
    return rows.select(*KEY, "quality_flags", "data_quality_score")


FOLDED = """folded AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, month, shop_name
  ORDER BY record_key) AS n FROM tiered WHERE id IS NOT NULL) WHERE n = 1
UNION ALL SELECT *, 1 AS n FROM tiered WHERE id IS NULL)"""


def with_folded(sql: str) -> str:
    from queries.base import RAW_SQL
    return f"WITH {RAW_SQL},\n{FOLDED}\n{sql}"


#: what tells copies apart, and what is counted: a fold sorts and shuffles every column that comes in
COUNTED = ["product_id", "month", "shop_name", "source_file", "record_key", "tier", "anomaly", "quality_flags",
           "data_quality_score"]


def run_metrics(spark, sf_dir):
    folded = dedup.fold_copies(cleaned(spark, sf_dir).select(*COUNTED))
    weight = F.when(F.col("product_id").isNull(), F.col("copies")).otherwise(F.lit(1))
    return quality.derive_metrics(quality.run_counters(folded, F.col("copies"), weight)).withColumn(
        "job_run_id", F.lit(CFG.run_id))


@query("a15_a17_a18_run_metrics", with_folded("""SELECT r AS records_read, CAST(t AS BIGINT) AS records_distinct,
  r - t AS records_duplicates, p AS records_passed, w AS records_warned, f AS records_failed, a AS records_anomalies,
  lo AS min_quality_score, hi AS max_quality_score, CAST(ROUND(s / t, 4) AS DECIMAL(5,4)) AS avg_quality_score,
  CAST(ROUND(p / r, 4) AS DECIMAL(5,4)) AS pass_rate, CAST(ROUND((f + r - t) / r, 4) AS DECIMAL(7,4)) AS error_rate,
  CAST(ROUND(CAST(f + r - t AS DOUBLE) * 100 / (p + w + f + r - t), 4) AS DECIMAL(7,4)) AS tier_error_pct FROM (
SELECT (SELECT COUNT(*) FROM scored) AS r, COUNT(*) AS t, COUNT(*) FILTER (tier = 'pass') AS p,
  COUNT(*) FILTER (tier = 'warn') AS w, COUNT(*) FILTER (tier = 'fail') AS f, COUNT(*) FILTER (anomaly) AS a,
  MIN(data_quality_score) AS lo, MAX(data_quality_score) AS hi, CAST(SUM(data_quality_score) AS DOUBLE) AS s
FROM folded)"""))
def a15(spark, sf_dir):
    return run_metrics(spark, sf_dir).drop("quality_issues", "job_run_id")


@query("a16_issue_counts", with_folded("""SELECT flag, COUNT(*) AS records FROM (
SELECT unnest(string_split(quality_flags, ',')) AS flag FROM folded) WHERE flag != '' GROUP BY flag"""))
def a16(spark, sf_dir):
    rows = dedup.kept_rows(dedup.fold_copies(cleaned(spark, sf_dir).select(*COUNTED)))
    return quality.issue_counts(rows)


@query("a16b_issue_map", with_folded("""SELECT flag, COUNT(*) AS records FROM (
SELECT unnest(string_split(quality_flags, ',')) AS flag FROM folded) WHERE flag != '' GROUP BY flag"""))
def a16b(spark, sf_dir):
    return run_metrics(spark, sf_dir).select(F.explode("quality_issues").alias("flag", "records"))


@query("a19_throughput", """SELECT event_type, COUNT(*) AS events,
  COUNT(*) / GREATEST(MAX(value) - 400, CAST(1 AS DOUBLE)) AS per_second FROM events GROUP BY event_type""")
def a19(spark, sf_dir):
    runs = table(spark, sf_dir, "events").groupBy("event_type").agg(
        an.count_rows().alias("events"), (F.max("value") - 400).alias("seconds"))
    return runs.select("event_type", "events", quality.throughput(F.col("events"), F.col("seconds")).alias("per_second"))


@query("a20_alerts", with_folded("""SELECT * FROM (SELECT 'check' AS job_run_id, 'QUALITY_SCORE_LOW' AS alert_type,
  CAST(0.95 AS DECIMAL(7,4)) AS threshold,
  CAST(ROUND(CAST(SUM(data_quality_score) AS DOUBLE) / COUNT(*), 4) AS DECIMAL(7,4)) AS actual_value FROM folded)
WHERE actual_value < threshold UNION ALL
SELECT * FROM (SELECT 'check', 'ERROR_RATE_HIGH', CAST(0.001 AS DECIMAL(7,4)) AS threshold, CAST(ROUND(
  (COUNT(*) FILTER (tier = 'fail') + (SELECT COUNT(*) FROM scored) - COUNT(*)) / (SELECT COUNT(*) FROM scored), 4)
  AS DECIMAL(7,4)) AS actual_value FROM folded) WHERE actual_value > threshold"""))
def a20(spark, sf_dir):
    cfg = replace(CFG, alert_min_score="0.95", alert_max_error_rate="0.001")
    return quality.alerts(run_metrics(spark, sf_dir), cfg)


@query("s09_quality_report", with_folded("""SELECT 'check' AS job_run_id, '2001-11-04 02:00:00' AS execution_timestamp,
  'landing' AS source_file, (SELECT COUNT(*) FROM scored) AS total_records, COUNT(*) FILTER (tier = 'pass')
  AS records_passed, COUNT(*) FILTER (tier = 'warn') AS records_warned, COUNT(*) FILTER (tier = 'fail') AS records_failed,
  (SELECT COUNT(*) FROM scored) - COUNT(*) AS records_duplicates, CAST(0 AS BIGINT) AS records_corrupt,
  COUNT(*) FILTER (anomaly) AS records_anomalies, 'v1.0.0' AS transformation_version FROM folded"""))
def s09(spark, sf_dir):
    report = quality.quality_report(run_metrics(spark, sf_dir), CFG, "landing")
    return report.withColumn("execution_timestamp", F.date_format("execution_timestamp", "yyyy-MM-dd HH:mm:ss")).drop(
        "pass_rate", "quality_issues", "avg_quality_score", "min_quality_score", "max_quality_score")


@query("s10_lineage", with_folded("""SELECT 'in' AS source_file_path, 'out' AS target_file_path,
  'tillworks-load' AS job_name, 'check' AS job_run_id, (SELECT COUNT(*) FROM scored) AS records_in,
  COUNT(*) FILTER (tier != 'fail') AS records_out,
  COUNT(*) FILTER (tier = 'fail') + (SELECT COUNT(*) FROM scored) - COUNT(*) AS records_error FROM folded"""))
def s10(spark, sf_dir):
    return quality.lineage(run_metrics(spark, sf_dir), CFG, "in", "out").drop("transformation_timestamp")


@query("s13_audit_summary", with_folded("""SELECT log_type, records_in, unnest([{'t': 'curated_sales', 'n': ok},
  {'t': 'quarantine_sales', 'n': bad}, {'t': 'error_sales', 'n': dup}], recursive := true) FROM (
SELECT 'ETL_AUDIT_SUMMARY' AS log_type, (SELECT COUNT(*) FROM scored) AS records_in, COUNT(*) FILTER (tier != 'fail')
  AS ok, COUNT(*) FILTER (tier = 'fail') AS bad, (SELECT COUNT(*) FROM scored) - COUNT(*) AS dup FROM folded)"""
  .replace("SELECT log_type, records_in, unnest", "SELECT log_type, records_in, t AS table_name, n AS record_count FROM (SELECT log_type, records_in, unnest")
  + ") WHERE n > 0"))
def s13(spark, sf_dir):
    from tillworks.operators import audit
    summary = audit.audit_summary(run_metrics(spark, sf_dir), CFG, "in", "out")
    return summary.select("log_type", F.col("source.records_count").alias("records_in"), F.inline("data_changes")).drop(
        "change_type", "operation")


@query("j05_new_keys", with_raw("""SELECT id AS product_id, month, shop_name, COUNT(*) AS records FROM scored n
WHERE id IS NOT NULL AND l_orderkey % 3 = 0 AND NOT EXISTS (SELECT 1 FROM scored o WHERE o.l_orderkey % 3 != 0
  AND o.id = n.id AND o.month IS NOT DISTINCT FROM n.month AND o.shop_name IS NOT DISTINCT FROM n.shop_name)
GROUP BY ALL"""))
def j05(spark, sf_dir):
    rows = cleaned(spark, sf_dir).where("product_id is not null")
    fresh, stored = rows.where("l_orderkey % 3 = 0"), rows.where("l_orderkey % 3 != 0")
    return dedup.new_keys(fresh, stored).groupBy("product_id", "month", "shop_name").agg(
        an.count_rows().alias("records"))


@query("p17_ascii_punctuation", """SELECT doc_id, replace(translate(t, '’‘“”—–', '''''""--'), '…', '...') AS t FROM (
SELECT doc_id, '‘' || text || '’ — “' || source || '”… – x' AS t FROM documents)""")
def p17(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    quoted = F.concat(F.lit("‘"), "text", F.lit("’ — “"), "source", F.lit("”… – x"))
    return docs.select("doc_id", text.ascii_punctuation(quoted).alias("t"))


@query("p18_title_list", with_curated("""SELECT quality_flags, array_to_string(list_transform(string_split(
  lower(replace(quality_flags, '_', '-')), ','), lambda item: array_to_string(list_transform(string_split(item, '-'),
  lambda w: upper(left(w, 1)) || substr(w, 2)), '-')), ', ') AS titles, COUNT(*) AS records
FROM sales_curated GROUP BY quality_flags"""))
def p18(spark, sf_dir):
    titles = text.title_list(F.translate("quality_flags", "_", "-"))
    return sales_curated(spark, sf_dir).groupBy("quality_flags").agg(an.count_rows().alias("records")).select(
        "quality_flags", titles.alias("titles"), "records")
