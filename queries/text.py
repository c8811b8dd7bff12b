"""Text and scalar-function questions over documents, conversations and the sales table."""

from pyspark.sql import functions as F

from queries.base import query, sales_curated, table, with_curated
from tillworks.functions import text
from tillworks.operators import analytics as an
from tillworks.operators import responses


@query("t10_question_category", """SELECT conv_id, turn, CASE WHEN strpos(q, ' in ') > 0 THEN COALESCE(NULLIF(trim(rtrim(
  substr(q, strpos(q, ' in ') + 4), '?')), ''), q) ELSE q END AS category FROM (
SELECT conv_id, turn, NULLIF(trim('What sells in ' || text || '?', ' ' || chr(10)), '') AS q
FROM conversations)""")
def t10(spark, sf_dir):
    asked = F.concat(F.lit("What sells in "), "text", F.lit("?"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.question_category(asked).alias("category"))


@query("t11_token_estimate", "SELECT doc_id, CAST(length(text) // 4 AS BIGINT) AS tokens FROM documents")
def t11(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("t12_slug", """SELECT DISTINCT replace(replace(lower(p_name || ' & ' || p_type), ' & ', '-'), ' ', '-') AS slug
FROM part""")
def t12(spark, sf_dir):
    name = F.concat("p_name", F.lit(" & "), "p_type")
    return table(spark, sf_dir, "part").select(text.slug(name).alias("slug")).distinct()


LIST_SQL = r"""SELECT doc_id, list_slice(list_concat(CASE WHEN len(items) >= 3 THEN items
  ELSE list_concat(items, paragraphs) END, ['Market trend analysis unavailable.', 'Market trend analysis unavailable.',
  'Market trend analysis unavailable.', 'Market trend analysis unavailable.', 'Market trend analysis unavailable.']), 1, 5)
  AS trends FROM (
SELECT doc_id, list_filter(list_transform(list_slice(string_split_regex(t, '\d+\.\s+'), 2, 1000000),
    lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x != '') AS items,
  list_filter(list_transform(list_transform(string_split_regex(regexp_replace(t, '^\s+|\s+$', '', 'g'), '\n\n+'),
    lambda p: regexp_replace(p, '^\s+|\s+$', '', 'g')),
    lambda p: CASE WHEN strpos(p, chr(10)) > 0 THEN
      CASE WHEN len(string_split_regex(trim(split_part(p, chr(10), 1)), '\s+')) BETWEEN 2 AND 15
        AND length(regexp_replace(substr(p, strpos(p, chr(10)) + 1), '^\s+|\s+$', '', 'g')) > 20
      THEN trim(split_part(p, chr(10), 1)) || chr(10) ||
        regexp_replace(substr(p, strpos(p, chr(10)) + 1), '^\s+|\s+$', '', 'g') END
      WHEN length(p) > 50 THEN p END), lambda p: p IS NOT NULL) AS paragraphs
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '1. ' || replace(text, '. ', chr(10) || '2. ') ELSE text END AS t
  FROM documents))"""


@query("t08_numbered_items", LIST_SQL)
def t08(spark, sf_dir):
    # every third document becomes a numbered list of its sentences
    numbered = F.concat(F.lit("1. "), F.replace(F.col("text"), F.lit(". "), F.lit("\n2. ")))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(F.col("doc_id") % 3 == 0, numbered).otherwise(F.col("text")).alias("t"))
    return responses.numbered_items(docs, "t").select("doc_id", "trends")


@query("t07_normalised_responses", r"""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN '' ELSE source END AS intro,
  list_slice(list_concat(CASE doc_id % 4
    WHEN 0 THEN CASE WHEN length(ltrim(a)) < 80
      THEN [trim(a) || ' => ' || CASE WHEN trim(b) = '' THEN trim(a) ELSE trim(b) END, '=> ', trim(a) || ' => ' || trim(a)]
      ELSE [' => ' || trim(a || ': ' || b), '=> ', ' => ' || trim(a || ':')] END
    WHEN 1 THEN [trim(a) || ' => ' || trim(b), ' => '] ELSE [] END, [' => ', ' => ', ' => ', ' => ', ' => ']), 1, 5) AS trends
FROM (SELECT doc_id, source, regexp_replace(left(text, length(text) // 2), '[^a-zA-Z]+', ' ', 'g') AS a,
  regexp_replace(substr(text, length(text) // 2 + 1), '[^a-zA-Z]+', ' ', 'g') AS b FROM documents)
""".replace("'=> '", "' => plain text'"))
def t07(spark, sf_dir):
    # answers in four shapes: list of texts, list of objects in a code fence, empty list, no JSON at all
    docs = table(spark, sf_dir, "documents")
    half = F.floor(F.length("text") / 2).cast("int")
    a = F.regexp_replace(F.substring("text", F.lit(1), half), r"[^a-zA-Z]+", " ")
    b = F.regexp_replace(F.substring("text", half + 1, F.length("text")), r"[^a-zA-Z]+", " ")
    intro = F.col("source").alias("supporting_trends_intro")
    kind = F.col("doc_id") % 4

    def answer(items):
        return F.to_json(F.struct(intro, items.alias("supporting_trends")))

    texts = answer(F.array(F.concat(a, F.lit(": "), b), F.lit("plain text"), F.concat(a, F.lit(":"))))
    objects = answer(F.array(F.struct(a.alias("title"), b.alias("description")),
                             F.struct(F.lit("").alias("title"), F.lit("").alias("description"))))
    empty = answer(F.array().cast("array<string>"))
    made = docs.select("doc_id", F.when(kind == 0, texts).when(
        kind == 1, F.concat(F.lit("```json\n"), objects, F.lit("\n```\n"))).when(kind == 2, empty).otherwise(
        F.col("text")).alias("response"))
    out = responses.normalise_responses(made)
    shown = F.transform("trends", lambda t: F.concat(t["title"], F.lit(" => "), t["description"]))
    return out.select("doc_id", "intro", shown.alias("trends"))


@query("t07b_product_ideas", """SELECT doc_id, CAST(1 AS INT) AS idea,
  CASE doc_id % 3 WHEN 0 THEN source WHEN 1 THEN 'Concept Product' ELSE 'Concept Product' END AS product_name,
  CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS description,
  CASE WHEN doc_id % 3 = 0 THEN CAST(n_chars AS DOUBLE) ELSE 0 END AS estimated_price_usd,
  CASE WHEN doc_id % 3 = 0 THEN lang || ' => ' || source ELSE ' => ' END AS first_trend FROM documents""")
def t07b(spark, sf_dir):
    # answers with one product, with an empty list, and without JSON
    docs = table(spark, sf_dir, "documents")
    product = F.struct(
        F.col("source").alias("product_name"), F.col("text").alias("description"),
        F.col("n_chars").alias("estimated_price_usd"),
        F.array(F.struct(F.col("lang").alias("title"), F.col("source").alias("description"))).alias("supporting_trends"))
    kind = F.col("doc_id") % 3
    answer = F.when(kind == 0, F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(product).alias("products"))),
                                        F.lit("\n```"))).when(kind == 1, '{"products": []}').otherwise(F.col("text"))
    ideas = responses.product_ideas(docs.select("doc_id", answer.alias("response")))
    first = F.get("supporting_trends", F.lit(0))
    return ideas.select("doc_id", "idea", "product_name", "description", "estimated_price_usd",
                        F.concat(first["title"], F.lit(" => "), first["description"]).alias("first_trend"))


@query("t09c_insight_digest", r"""SELECT conv_id, 'Web search insights (trends, pain points, competitors):' || chr(10) ||
  concat_ws(chr(10), '- Trends: ' || string_agg(part, ' | ' ORDER BY turn) FILTER (role = 'user' AND r <= 3),
  '- Pain points: ' || string_agg(part, ' | ' ORDER BY turn) FILTER (role = 'assistant' AND r <= 3)) || chr(10) || chr(10) AS digest
FROM (SELECT conv_id, turn, role, left(regexp_replace(text, '^\s+|\s+$', '', 'g'), 120) AS part,
  ROW_NUMBER() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r FROM conversations) GROUP BY conv_id
HAVING COUNT(*) FILTER (role IN ('user', 'assistant')) > 0""")
def t09c(spark, sf_dir):
    # three turns of each role are all a digest shows, so no list grows with the conversation
    turns = an.top_k_per(table(spark, sf_dir, "conversations").where(F.col("role").isin("user", "assistant")),
                         ["conv_id", "role"], [("turn", "asc")], responses.DIGEST_ITEMS)

    def found(role):
        item = F.when(F.col("role") == role, F.struct(F.col("turn"), F.lit("").alias("title"),
                                                      F.col("text").alias("snippet")))
        return F.sort_array(F.collect_list(item))

    lists = turns.groupBy("conv_id").agg(found("user").alias("trends"), found("assistant").alias("pain_points"))
    lists = lists.withColumn("competitors", F.slice("trends", 1, 0))
    return responses.insight_digest(lists).select("conv_id", "digest")


# -- scalar function families ----------------------------------------------------------------------------------------

@query("fn_string", with_curated(r"""SELECT source_record_number, product_id, lower(trim('  ' || product_name || ' ')) AS name,
  concat_ws('||', shop_name, l2_category) AS joined, regexp_extract(source_file, '_(\d{8})', 1) AS digits,
  regexp_replace(shop_name, '#0+', '-') AS short, quality_flags LIKE '%ITEMS%' AS has_items,
  CAST(product_id AS VARCHAR) AS id_text FROM sales_curated"""))
def fn_string(spark, sf_dir):
    return sales_curated(spark, sf_dir).select(
        "source_record_number", "product_id",
        F.lower(F.trim(F.concat(F.lit("  "), "product_name", F.lit(" ")))).alias("name"),
        F.concat_ws("||", "shop_name", "l2_category").alias("joined"),
        F.regexp_extract("source_file", r"_(\d{8})", 1).alias("digits"),
        F.regexp_replace("shop_name", "#0+", "-").alias("short"),
        F.col("quality_flags").contains("ITEMS").alias("has_items"), F.col("product_id").cast("string").alias("id_text"))


@query("fn_date", """SELECT o_orderkey, CAST(year(d) AS INT) AS y, CAST(month(d) AS INT) AS m,
  CAST(d - INTERVAL 6 MONTH AS DATE) AS six_months_back, CAST(d - 7 AS DATE) AS week_back,
  CAST(date_trunc('month', d) AS DATE) AS month_start,
  strftime(o_orderdate, '%B %d, %Y at %I:%M %p') AS shown
FROM (SELECT *, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def fn_date(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.year(d).alias("y"), F.month(d).alias("m"), F.add_months(d, -6).alias("six_months_back"),
        F.date_sub(d, 7).alias("week_back"), F.trunc(d, "month").alias("month_start"),
        text.display_time(F.col("o_orderdate")).alias("shown"))


@query("fn_math", with_curated("""SELECT product_id, source_record_number, abs(mom_growth_pct) AS size,
  CAST(ROUND(avg_unit_price_usd * 3, 1) AS DECIMAL(13,1)) AS rounded, CAST(item_sold AS DOUBLE) / 3 AS third,
  CASE WHEN item_sold % 5 = 0 THEN NULL ELSE 100.0 / CAST(item_sold % 5 AS DOUBLE) END AS safe FROM sales_curated"""))
def fn_math(spark, sf_dir):
    return sales_curated(spark, sf_dir).select(
        "product_id", "source_record_number", F.abs("mom_growth_pct").alias("size"),
        F.round(F.col("avg_unit_price_usd") * 3, 1).cast("decimal(13,1)").alias("rounded"),
        (F.col("item_sold").cast("double") / 3).alias("third"),
        F.try_divide(F.lit(100.0), (F.col("item_sold") % 5).cast("double")).alias("safe"))


@query("fn_conditional_price_tier", with_curated("""SELECT CASE WHEN avg_unit_price_usd < 10 THEN 'Budget (<$10)'
  WHEN avg_unit_price_usd < 25 THEN 'Mid-Range ($10-$25)' WHEN avg_unit_price_usd < 50 THEN 'Premium ($25-$50)'
  ELSE 'Luxury (>$50)' END AS price_tier, COUNT(*) AS records FROM sales_curated GROUP BY 1"""))
def fn_conditional(spark, sf_dir):
    return sales_curated(spark, sf_dir).groupBy(an.price_tier(F.col("avg_unit_price_usd")).alias("price_tier")).agg(
        an.count_rows().alias("records"))


@query("fn_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("fn_array_map", with_curated("""SELECT shop_name, flag, COUNT(*) AS records FROM (SELECT shop_name,
  unnest(string_split(quality_flags, ',')) AS flag FROM sales_curated) WHERE flag != '' GROUP BY shop_name, flag"""))
def fn_array_map(spark, sf_dir):
    flags = sales_curated(spark, sf_dir).select("shop_name", F.explode(F.split("quality_flags", ",")).alias("flag"))
    counted = flags.where("flag != ''").groupBy("shop_name", "flag").agg(an.count_rows().alias("n"))
    maps = counted.groupBy("shop_name").agg(F.map_from_entries(F.collect_list(F.struct("flag", "n"))).alias("issues"))
    return maps.select("shop_name", F.explode("issues").alias("flag", "records"))


@query("fn_hash", "SELECT doc_id, md5(text) AS digest FROM documents")
def fn_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("digest"))


@query("fn_url", r"""SELECT page_id, regexp_extract(lower(url), '^https?://([^/?#]*)', 1) AS host,
  split_part(regexp_replace(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), '^www\.', ''), '.', 1) AS label,
  list_extract(string_split(regexp_extract(lower(url), '^https?://([^/?#]*)', 1), '.'), -2) AS site,
  regexp_extract(regexp_replace(regexp_replace(url, '^https?://', ''), '^www\.', ''), '^([^/?]*)', 1) AS domain,
  CASE WHEN length(url) <= 30 THEN url ELSE rtrim(left(url, 27), '/') || '...' END AS short FROM pages""")
def fn_url(spark, sf_dir):
    url = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", text.authority(url).alias("host"), text.host_label(url).alias("label"),
        text.site_label(url).alias("site"), text.display_domain(url).alias("domain"), text.short_url(url, 30).alias("short"))


@query("fn_formatting", with_curated("""SELECT source_record_number, product_id, '$' || format('{:,}', item_sold * 1000) AS money,
  printf('%.1f', CAST(mom_growth_pct AS DOUBLE) * 100) || '%' AS growth FROM sales_curated"""))
def fn_formatting(spark, sf_dir):
    return sales_curated(spark, sf_dir).select(
        "source_record_number", "product_id", text.dollars(F.col("item_sold") * 1000).alias("money"),
        text.ratio_as_percent(F.col("mom_growth_pct")).alias("growth"))
