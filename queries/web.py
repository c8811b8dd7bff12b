"""Pages, shops and search results."""

from pyspark.sql import functions as F

from queries.base import query, table
from tillworks.operators import web


def _shown(html: str) -> str:
    """The text that a piece of HTML shows, in SQL: no tags, characters for the references that the pages hold, trimmed."""
    out = f"regexp_replace({html}, '<[^>]*>', '', 'g')"
    for name, character in {"copy": "©", "middot": "·", "lt": "<", "gt": ">", "quot": '"'}.items():
        out = f"replace({out}, '&{name};', '{character}')"
    return f"regexp_replace(regexp_replace({out}, '&amp;?', '&', 'g'), '^\\s+|\\s+$', '', 'g')"


#: What is put into the head and the body of the given pages, by number: descriptions, trend sections, images.
HEADS = """CASE page_id % 5 WHEN 0 THEN '<meta name="description" content="Caf&eacute; &amp; page &#35;' || page_id || ' ">'
  WHEN 1 THEN '<meta name="description" content=""><meta content="Graph &quot;' || page_id || '&quot;" property="og:description">'
  WHEN 2 THEN '<!-- <meta name="description" content="no"> -->' ELSE '' END ||
  CASE page_id % 7 WHEN 0 THEN '<meta property="og:image" content="//img.example.org/' || page_id || '.png">'
  WHEN 1 THEN '<meta property="og:image" content="../pics/./' || page_id || '.png?a=1&amp;b=2">'
  WHEN 2 THEN '<meta property="og:image" content="https://i5.walmartimages.com/' || page_id || '.png">' ELSE '' END"""
BODIES = """CASE page_id % 4 WHEN 0 THEN '<div class="box Hot-Trends"><b>Section ' || page_id || '</b> tells of <i>many</i> new things that people like &lt;now&gt; </div>'
  WHEN 1 THEN '<section class="insight">short ' || page_id || '</section>' ELSE '' END ||
  CASE page_id % 7 WHEN 3 THEN '<img src="data:x" itemprop="image"><img data-src="/p/' || page_id || '.jpg" itemprop=image>'
  WHEN 4 THEN '<img src="https://cdn.example.org/l.png" alt="Our LOGO"><img src="/other.png"><img alt=x src="/product/' || page_id || '.jpg"/>'
  ELSE '' END"""

# paragraphs of the article; one that is not closed lasts to the end of the article
PAGES_SQL = rf"""WITH rich AS (SELECT page_id, url, replace(replace(html, '<head>', '<head>' || {HEADS}), '<body>', '<body>' || {BODIES})
  AS html, split_part(split_part(url, '#', 1), '?', 1) AS plain FROM pages),
bare AS (SELECT page_id, url, plain, regexp_replace(regexp_extract(html, '(?s)<body[^>]*>(.*?)(</body>|$)', 1),
  '(?s)<!--.*?-->|<script>.*?</script>|<style>.*?</style>', '', 'g') AS body FROM rich),
parts AS (SELECT *, string_split(split_part(regexp_extract(body, '(?s)<article>(.*)', 1), '</article>', 1), '<p>') AS ps
  FROM bare),
told AS (SELECT *, list_filter(list_transform(range(2, len(ps) + 1), lambda i: {_shown(
    "CASE WHEN contains(ps[i], '</p>') THEN split_part(ps[i], '</p>', 1) ELSE array_to_string(ps[i:], '') END")}),
  lambda t: length(t) > 30) AS texts, regexp_extract(plain, '^[a-z]+://[^/]*', 0) AS host,
  string_split(regexp_extract(plain, '^[a-z]+://[^/]*/(.*)', 1), '/') AS steps FROM parts)
SELECT page_id, url, left(CASE page_id % 5 WHEN 0 THEN 'Café & page #' || page_id WHEN 1 THEN 'Graph "' || page_id || '"'
  ELSE coalesce(texts[1], '') END, 500) AS description,
  CASE WHEN page_id % 4 = 0 THEN 'Section ' || page_id || ' tells of many new things that people like <now>'
    ELSE left(regexp_replace({_shown("body")}, '\s+', ' ', 'g'), 2000) END AS trends_text,
  CASE page_id % 7 WHEN 0 THEN 'https://img.example.org/' || page_id || '.png'
    WHEN 1 THEN host || '/' || array_to_string(list_concat(steps[1:len(steps) - 2], ['pics', page_id || '.png?a=1&b=2']), '/')
    WHEN 3 THEN host || '/p/' || page_id || '.jpg' WHEN 4 THEN host || '/product/' || page_id || '.jpg' ELSE '' END AS image_url FROM told"""


def rich_pages(spark, sf_dir):
    """The given pages with descriptions, trend sections and images put in."""
    pages = table(spark, sf_dir, "pages")
    return pages.withColumn("html", F.replace(F.replace("html", F.lit("<head>"), F.concat(F.lit("<head>"), F.expr(HEADS))), F.lit("<body>"), F.concat(F.lit("<body>"), F.expr(BODIES))))


@query("t01_t02_t03_page_fields", PAGES_SQL)
def t01(spark, sf_dir):
    return web.page_fields(rich_pages(spark, sf_dir))


@query("t04_brand_slugs", """SELECT s_suppkey, list_distinct([n]) AS first_slug, len(list_distinct(list_filter([replace(r, ' ', ''),
  replace(r, ' ', '-'), regexp_replace(r, '[& ]+', '', 'g'), CASE WHEN split_part(r, ' ', 1) NOT IN ('the', 'a', 'an')
  THEN split_part(r, ' ', 1) END], lambda x: x IS NOT NULL AND x != ''))) AS slugs
FROM (SELECT *, replace(r, ' ', '') AS n FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'the ' || lower(s_name)
  WHEN 1 THEN lower(s_name) || ' & sons' ELSE lower(s_name) || ' company' END AS r FROM supplier))""")
def t04(spark, sf_dir):
    kind = F.col("s_suppkey") % 3
    shop = F.when(kind == 0, F.concat(F.lit("The "), "s_name", F.lit("  Store"))).when(
        kind == 1, F.concat("s_name", F.lit(" &  Sons Inc "))).otherwise(F.concat("s_name", F.lit(" Company Official")))
    slugs = table(spark, sf_dir, "supplier").select("s_suppkey", web.brand_slugs(shop).alias("s"))
    return slugs.select("s_suppkey", F.slice("s", 1, 1).alias("first_slug"), F.size("s").cast("bigint").alias("slugs"))


def results(spark, sf_dir):
    """Pages as search results, five to a product; some links point to known sites."""
    n = F.col("page_id")
    link = F.when(n % 9 == 0, F.concat(F.lit("https://www.amazon.com/dp/"), n.cast("string"))).when(
        n % 9 == 1, F.concat(F.lit("https://www.trustpilot.com/"), n.cast("string"))).when(
        n % 9 == 2, F.concat(F.lit("ftp://files.example.com/"), n.cast("string"))).when(
        n % 9 == 3, F.concat(F.lit("https://www.supplier"), (n % 7).cast("string"), F.lit(".com/products/1"))).otherwise(
        F.col("url"))
    return table(spark, sf_dir, "pages").select(
        (F.floor(n / 5) + 1).alias("product_id"), n.alias("position"), link.alias("href"),
        F.regexp_extract("html", r"<title>([^<]*)", 1).alias("title"), F.col("html").alias("body"))


def products(spark, sf_dir):
    """Every part with a supplier, parts being dealt round the suppliers."""
    part, supplier = table(spark, sf_dir, "part"), table(spark, sf_dir, "supplier")
    shop = F.concat(F.lit("Supplier"), (F.col("s_suppkey") % 7).cast("string"), F.lit(" Inc"))
    dealt = F.col("p_partkey") % supplier.agg(F.count(F.lit(1))).scalar() + 1
    return part.withColumn("of", dealt).join(supplier, F.col("of") == supplier.s_suppkey).select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), shop.alias("shop_name"))


RESULTS_SQL = r"""results AS (SELECT page_id // 5 + 1 AS product_id, page_id AS position, CASE page_id % 9
  WHEN 0 THEN 'https://www.amazon.com/dp/' || page_id WHEN 1 THEN 'https://www.trustpilot.com/' || page_id
  WHEN 2 THEN 'ftp://files.example.com/' || page_id WHEN 3 THEN 'https://www.supplier' || (page_id % 7) || '.com/products/1'
  ELSE url END AS href, regexp_extract(html, '<title>([^<]*)', 1) AS title, html AS body FROM pages)"""


@query("t06_shaped_results", f"""WITH {RESULTS_SQL} SELECT product_id, position, href, left(title, 300) AS title,
  left(body, 500) AS body FROM results WHERE href LIKE 'http://%' OR href LIKE 'https://%'
QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY position) <= 3""")
def t06(spark, sf_dir):
    return web.shape_results(results(spark, sf_dir), 3, "product_id")


@query("t05_best_urls", f"""WITH {RESULTS_SQL}, named AS (SELECT r.*, lower(href) AS h, lower(p_name) AS name,
  'supplier' || (s_suppkey % 7) AS slug, regexp_extract(lower(href), '^https?://([^/?#]*)', 1) AS host
  FROM results r JOIN part ON p_partkey = product_id
    JOIN supplier ON s_suppkey = p_partkey % (SELECT COUNT(*) FROM supplier) + 1
  WHERE (href LIKE 'http://%' OR href LIKE 'https://%') AND NOT regexp_matches(lower(href), 'myprosandcons|trustpilot|yelp\\.com|g2\\.com|capterra|sitejabber|consumeraffairs|reviews\\.io|resellerratings|wikipedia\\.org|youtube\\.com|facebook\\.com|twitter\\.com|instagram\\.com|pinterest\\.com')),
scored AS (SELECT *, CASE WHEN list_extract(string_split(host, '.'), -2) = slug THEN 35
    WHEN contains(label, slug) OR contains(slug, label) THEN 25 ELSE 0 END
  + CASE WHEN regexp_matches(h, '/dp/|/gp/product/|/product/|/p/|/ip/|/products/') THEN 20 ELSE 0 END
  + CASE WHEN regexp_matches(h, 'amazon\\.com|sephora\\.com|walmart\\.com|ulta\\.com|target\\.com') THEN 10 ELSE 0 END
  + CASE WHEN contains(lower(title), left(name, 20)) THEN 5 ELSE 0 END
  + CASE WHEN contains(lower(body), left(name, 20)) THEN 3 ELSE 0 END
  + CASE WHEN contains(lower(title), left(slug || ' inc', 15)) THEN 3 ELSE 0 END AS points
  FROM (SELECT *, split_part(regexp_replace(host, '^www\\.', ''), '.', 1) AS label FROM named))
SELECT product_id, href AS url, points FROM scored
QUALIFY ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY points DESC, position) = 1""")
def t05(spark, sf_dir):
    return web.best_urls(results(spark, sf_dir), products(spark, sf_dir))
