"""Readers, writers and table upkeep: data goes through the shared folder and is read back."""

from datetime import date

from pyspark.sql import functions as F

from queries.base import CFG, query, sales_curated, sales_raw, table, with_curated, with_raw
from queries.cleaning import KEY, cleaned
from queries.investigation import schema_change_sql
from tillworks.operators import analytics as an
from tillworks.operators import dedup, quality
from tillworks.plans import load as plan
from tillworks.schema import RAW_COLUMNS
from tillworks.session import passing_shuffles, scratch
from tillworks.sources import generator, raw, tables

RAW_NAMES = list(RAW_COLUMNS.values())
CSV = {"header": True, "quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


#: a gzip file is read by one task: files of some 20 MB of text, packed by the fastest level
GZIP = {"compression": "gzip", "zlib.compress.level": "BEST_SPEED", "maxRecordsPerFile": 200_000}


def landing(spark, sf_dir, name, **options):
    """The untidy rows as landing files."""
    path = scratch(spark, name)
    rows = sales_raw(spark, sf_dir).select(*[F.col(c).alias(h) for h, c in RAW_COLUMNS.items()])
    with passing_shuffles(spark):
        rows.write.options(**CSV, **options).csv(f"{path}/2001/11/04")
    return path


@query("s01_csv_scan", with_raw("""SELECT month_raw, NULLIF(product_id_raw, '') AS product_id_raw, product_name_raw,
  shop_name_raw, l1_category_raw, NULLIF(l2_category_raw, '') AS l2_category_raw, l3_category_raw, item_sold_raw,
  revenue_raw, avg_unit_price_raw, mom_growth_raw FROM sales_raw"""))
def s01(spark, sf_dir):
    scan = raw.read_raw(spark, landing(spark, sf_dir, "scan"))
    return scan.select(*[F.nullif(c, F.lit("")).alias(c) for c in RAW_NAMES])


@query("s02_source_columns", with_raw("""SELECT COUNT(*) AS records, COUNT(*) AS numbered, COUNT(*) AS in_folder
FROM sales_raw"""))
def s02(spark, sf_dir):
    scan = raw.read_raw(spark, landing(spark, sf_dir, "meta"))
    # a stated number of partitions: paths shuffle to next to nothing, so adaptive execution would merge them by their few
    # bytes and let one task hold the keys of all
    scan = scan.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "source_file", "source_record_number")
    return scan.agg(an.count_rows().alias("records"), F.countDistinct("source_file", "source_record_number")
                    .alias("numbered"), F.count_if(F.col("source_file").contains("/2001/11/04/")).alias("in_folder"))


def paths(spark, sf_dir):
    """A landing path for each line; the name of one order in 97 carries the next day."""
    day = F.to_date("l_shipdate")
    named = F.when(F.col("l_orderkey") % 97 == 0, F.date_add(day, 1)).otherwise(day)
    return table(spark, sf_dir, "lineitem").select(F.concat(
        F.lit("landing/"), F.date_format(day, "yyyy/MM/dd"), F.lit("/sales_"), F.date_format(named, "yyyyMMdd"),
        F.lit(".csv")).alias("source_file"), day.alias("day"))


PATHS = """SELECT 'landing/' || strftime(d, '%Y/%m/%d') || '/sales_' || strftime(n, '%Y%m%d') || '.csv' AS source_file,
  d, n FROM (SELECT CAST(l_shipdate AS DATE) AS d, CASE WHEN l_orderkey % 97 = 0 THEN CAST(l_shipdate + INTERVAL 1 DAY AS DATE)
  ELSE CAST(l_shipdate AS DATE) END AS n FROM lineitem)"""


@query("s03_path_mismatches", f"SELECT DISTINCT source_file FROM ({PATHS}) WHERE d != n")
def s03(spark, sf_dir):
    return raw.find_path_mismatches(paths(spark, sf_dir))


@query("s17_landing_dates", f"""SELECT landing_date, COUNT(*) AS records FROM (
SELECT CASE WHEN year(d) % 3 = 0 THEN d WHEN year(d) % 3 = 1 THEN n ELSE DATE '1990-01-01' END AS landing_date
FROM ({PATHS})) GROUP BY 1""")
def s17(spark, sf_dir):
    # a third of the years keeps folders, a third only file names, a third neither
    path = F.col("source_file")
    year = F.year("day") % 3
    cut = F.when(year == 0, path).when(year == 1, F.regexp_replace(path, "^landing/.*/", "landing/")).otherwise("x.csv")
    dated = raw.landing_date(paths(spark, sf_dir).withColumn("source_file", cut), date(1990, 1, 1))
    return dated.groupBy("landing_date").agg(an.count_rows().alias("records"))


@query("s04_corrupt_rows", """SELECT COUNT(*) FILTER (l_orderkey % 61 != 0 AND l_orderkey % 61 != 1) AS good,
  COUNT(*) FILTER (l_orderkey % 61 = 0 OR l_orderkey % 61 = 1) AS corrupt,
  COUNT(DISTINCT CASE WHEN l_orderkey % 61 = 0 THEN '1/1/2001,' || l_orderkey END) AS short_lines FROM lineitem""")
def s04(spark, sf_dir):
    path = scratch(spark, "corrupt")
    key = F.col("l_orderkey")
    full = F.concat(F.lit("1/1/2001,"), key.cast("string"), F.lit(",n,s,a,b,c,1,$2,$3,4%"))
    line = F.when(key % 61 == 0, F.concat(F.lit("1/1/2001,"), key.cast("string"))).when(
        key % 61 == 1, F.concat(full, F.lit(",5,6"))).otherwise(full)
    # a text line without commas would be taken for the header of its file
    lines = table(spark, sf_dir, "lineitem").select(line.alias("value"))
    lines.write.option("header", False).option("lineSep", "\n").text(f"{path}/2001/01/01")
    scan = spark.read.schema(raw.RAW_SCHEMA).options(**raw.CSV_OPTIONS).option("header", False).option(
        "pathGlobFilter", "*.txt").csv(path)
    good, bad = raw.split_corrupt(raw.snake_case(raw.with_source_meta(scan)))
    errors = quality.malformed_errors(bad, CFG)
    counted = errors.agg(an.count_rows().alias("corrupt"), F.countDistinct(F.when(
        ~F.col("raw_record").contains("$"), F.col("raw_record"))).alias("short_lines"))
    return good.agg(F.count("month_raw").alias("good")).withColumns({
        c: counted.select(c).scalar() for c in ("corrupt", "short_lines")})


def stored(spark, sf_dir, name):
    """Cleaned and de-duplicated rows written to the curated table of a fresh root."""
    root = scratch(spark, name)
    rows = cleaned(spark, sf_dir).withColumn("source_record_number", F.lit(0).cast("bigint"))
    folded = dedup.fold_copies(rows.drop(*KEY, "l_shipdate", "l_quantity"))
    kept = tables.by_month(dedup.kept_rows(folded.where("tier != 'fail'")))
    tables.write_curated(plan.finish(kept, CFG), root, CFG, spread=True)
    return root


STORED = """stored AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY id, month, shop_name ORDER BY record_key)
  AS n FROM tiered WHERE id IS NOT NULL) WHERE n = 1 AND tier != 'fail'
UNION ALL SELECT *, 1 AS n FROM tiered WHERE id IS NULL AND tier != 'fail')"""


def with_stored(sql: str) -> str:
    from queries.base import RAW_SQL
    return f"WITH {RAW_SQL},\n{STORED}\n{sql}"


@query("s05_curated_sink", with_stored("""SELECT year, month_num, COUNT(*) AS records,
  CAST(SUM(revenue_usd) AS DECIMAL(28,2)) AS revenue, COUNT(DISTINCT l2_category) AS categories,
  MIN(data_quality_score) AS lowest, 'check' AS run_id FROM stored GROUP BY year, month_num"""))
def s05(spark, sf_dir):
    out = tables.read_table(spark, stored(spark, sf_dir, "curated"), "curated_sales")
    return out.groupBy("year", "month_num", "run_id").agg(
        an.count_rows().alias("records"), an.total("revenue_usd").alias("revenue"),
        F.countDistinct("l2_category").alias("categories"), F.min("data_quality_score").alias("lowest"))


@query("s06_s07_quarantine_sink", with_curated("""SELECT quarantine_reason, product_id, month, revenue_usd, item_sold,
  quality_flags, run_id FROM (
SELECT 'LOW_QUALITY_SCORE' AS quarantine_reason, *, 'check' AS run_id FROM sales_curated WHERE data_quality_score < 0.70
UNION ALL SELECT 'ANOMALY_DETECTED', *, 'check' FROM sales_curated WHERE revenue_usd > 90000 OR item_sold > 49)"""))
def s06(spark, sf_dir):
    from queries.analytics import quarantine
    root = scratch(spark, "quarantine")
    rows = quarantine(spark, sf_dir)
    tables.write_quarantine(rows, root, CFG)
    tables.write_quarantine(rows, root, CFG)  # a repeated run replaces its own rows
    return tables.read_table(spark, root, "quarantine_sales").select(
        "quarantine_reason", "product_id", "month", "revenue_usd", "item_sold", "quality_flags", "run_id")


@query("s14_registered_tables", with_stored("SELECT COUNT(*) AS records, COUNT(DISTINCT month) AS months FROM stored"))
def s14(spark, sf_dir):
    import uuid
    root = stored(spark, sf_dir, "registry")
    database = f"check_{uuid.uuid4().hex}"
    tables.register_tables(spark, root, database)
    return spark.table(f"{database}.curated_sales").agg(
        an.count_rows().alias("records"), F.countDistinct("month").alias("months"))


@query("s15_discovery", schema_change_sql("lineitem", """SELECT * EXCLUDE (l_tax)
  REPLACE (CAST(l_quantity AS INTEGER) AS l_quantity), 1 AS extra FROM lineitem"""))
def s15(spark, sf_dir):
    root = scratch(spark, "discovery")
    lines = table(spark, sf_dir, "lineitem")
    changed = lines.drop("l_tax").withColumns({"l_quantity": F.col("l_quantity").cast("int"), "extra": F.lit(1)})
    changed.write.partitionBy("l_returnflag").parquet(root)
    return tables.discover(spark, root, lines.schema).select("column_name", "change")


@query("s18_j03_generator", """SELECT l2, COUNT(*) AS records, COUNT(DISTINCT d) AS days FROM (
SELECT DISTINCT o_orderdate AS d FROM orders) CROSS JOIN (SELECT DISTINCT p_type AS l2 FROM part WHERE p_type != 'PROMO')
CROSS JOIN range(8) GROUP BY l2""")
def s18(spark, sf_dir):
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    made = generator.generate_sales(spark, days, table(spark, sf_dir, "part").select("p_type"), skip=[" promo "])
    return made.groupBy(F.col("l2_category_raw").alias("l2")).agg(
        an.count_rows().alias("records"), F.countDistinct("month_raw").alias("days"))


@query("s20_table_rebuild", with_curated("""SELECT year, COUNT(*) AS records, FALSE AS has_flags FROM sales_curated
GROUP BY year"""))
def s20(spark, sf_dir):
    import uuid
    mark = uuid.uuid4().hex
    live, new, old = (f"sales_{n}_{mark}" for n in ("live", "new", "old"))
    root = scratch(spark, "rebuild")
    rows = sales_curated(spark, sf_dir).select("year", "month_num", "product_id", "revenue_usd", "quality_flags")
    rows.write.partitionBy("year", "month_num").option("path", f"{root}/live").saveAsTable(live)
    tables.ctas(spark.table(live), new, drop=["quality_flags"], path=f"{root}/new")
    tables.swap(spark, live, new, old)
    rebuilt = spark.table(live)
    return rebuilt.groupBy("year").agg(an.count_rows().alias("records")).withColumn(
        "has_flags", F.lit("quality_flags" in rebuilt.columns))


@query("s21_compaction", with_curated("""SELECT year, COUNT(*) AS records, CAST(SUM(revenue_usd) AS DECIMAL(28,2)) AS revenue,
  COUNT(DISTINCT month_num) AS files FROM sales_curated GROUP BY year"""))
def s21(spark, sf_dir):
    root = scratch(spark, "compact")
    rows = sales_curated(spark, sf_dir).select("year", "month_num", "product_id", "revenue_usd")
    rows.repartition(8, "product_id").write.partitionBy("year", "month_num").parquet(f"{root}/many")
    tables.compact(spark, f"{root}/many", f"{root}/few")
    few = spark.read.parquet(f"{root}/few").withColumn("f", F.col("_metadata.file_path"))
    return few.groupBy("year").agg(an.count_rows().alias("records"), an.total("revenue_usd").alias("revenue"),
                                   F.countDistinct("f").alias("files"))


@query("s21b_compaction_swap", with_curated("""SELECT year, COUNT(*) AS records, CAST(SUM(revenue_usd) AS DECIMAL(28,2)) AS revenue,
  COUNT(*) AS records_of_open_reader, COUNT(DISTINCT month_num) AS files, TRUE AS old_gone FROM sales_curated GROUP BY year"""))
def s21b(spark, sf_dir):
    """A reader that was open before the compaction, one after it, and the clearing of the old version."""
    root = scratch(spark, "compact")
    rows = sales_curated(spark, sf_dir).select("year", "month_num", "product_id", "revenue_usd")
    rows.repartition(8, "product_id").write.partitionBy("year", "month_num").parquet(f"{root}/v-first")
    tables.publish(spark, root, "v-first")
    before = tables.read_live(spark, root)
    tables.compact_live(spark, root)
    after = tables.read_live(spark, root).withColumn("f", F.col("_metadata.file_path"))
    told = after.groupBy("year").agg(an.count_rows().alias("records"), an.total("revenue_usd").alias("revenue"),
                                     F.countDistinct("f").alias("files"))
    read = staged_rows(before.groupBy("year").agg(an.count_rows().alias("records_of_open_reader")), f"{root}-read")
    gone = tables.drop_versions(spark, root, keep=1)
    return told.join(read, "year").withColumn("old_gone", F.lit(gone == ["v-first"]))


def staged_rows(df, path):
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
