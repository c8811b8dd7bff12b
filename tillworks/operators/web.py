"""Page fields, brand slugs and search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.functions import html, text
from tillworks.functions.parse import strip

# Name endings that are not part of a brand, in the order they are taken off.
NAME_ENDINGS = [" store", " shop", " inc", " llc", " co", " company", " official"]
ARTICLES = ["the", "a", "an"]
# Product path parts, retailers and review sites.
PRODUCT_PATHS = ["/dp/", "/gp/product/", "/product/", "/p/", "/ip/", "/products/"]
RETAILERS = ["amazon.com", "sephora.com", "walmart.com", "ulta.com", "target.com"]
REVIEW_SITES = [
    "myprosandcons", "trustpilot", "yelp.com", "g2.com", "capterra", "sitejabber",
    "consumeraffairs", "reviews.io", "resellerratings", "wikipedia.org", "youtube.com",
    "facebook.com", "twitter.com", "instagram.com", "pinterest.com",
]
# Points of a search result.
POINTS = {"brand_site": 35, "brand_part": 25, "product_path": 20, "retailer": 10, "name_in_title": 5,
          "name_in_body": 3, "shop_in_title": 3}
TITLE_LENGTH = 300
BODY_LENGTH = 500
RESULTS = 10


def page_fields(pages: DataFrame) -> DataFrame:
    """Description, trend snippet and product image of each page, as columns: no shuffle, no Python worker."""
    read = html.with_elements(pages)
    tags, texts, elements = F.col("_tags"), F.col("_texts"), F.col("_elements")
    return read.select(
        *[c for c in pages.columns if c != "html"], html.description(tags, texts, elements).alias("description"),
        html.trend_snippet(texts, elements).alias("trends_text"),
        html.product_image(tags, F.coalesce("url", F.lit(""))).alias("image_url"))


def brand_slugs(shop: Column) -> Column:
    """Host-name spellings of a brand: joined, hyphenated, joined without &, first word."""
    def without(name: Column, ending: Column) -> Column:
        return F.when(F.endswith(name, ending), strip(F.left(name, F.length(name) - F.length(ending)))).otherwise(name)

    raw = F.aggregate(F.array(*[F.lit(e) for e in NAME_ENDINGS]), strip(F.lower(shop)), without)
    raw = text.collapse_space(raw)
    first = F.split_part(raw, F.lit(" "), F.lit(1))
    found = F.array(F.translate(raw, " ", ""), F.translate(raw, " ", "-"), F.translate(raw, "& ", ""),
                    F.when(~first.isin(ARTICLES), first))
    slugs = F.filter(F.array_distinct(F.array_compact(found)), lambda s: s != "")
    return F.coalesce(slugs, F.array().cast("array<string>"))


def _contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def is_web_address(c: Column) -> Column:
    return F.startswith(c, F.lit("http://")) | F.startswith(c, F.lit("https://"))


def shape_results(results: DataFrame, n: int = RESULTS, key: str = "query_id") -> DataFrame:
    """Web addresses only, title and body cut, the first n of each query."""
    shaped = results.withColumns({"href": strip(F.coalesce("href", F.lit(""))),
                                  "title": F.substring(F.coalesce("title", F.lit("")), 1, TITLE_LENGTH),
                                  "body": F.substring(F.coalesce("body", F.lit("")), 1, BODY_LENGTH)})
    shaped = shaped.where(is_web_address(F.col("href")))
    ranked = shaped.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("position")))
    return ranked.where(F.col("_n") <= n).drop("_n")


def result_points() -> Column:
    """Points of a search result for a product (columns href, title, body, product_name, shop_name)."""
    href, title, body = F.lower("href"), F.lower("title"), F.lower("body")
    slugs = F.col("_slugs")
    host, site = F.col("_host"), F.col("_site")
    product, shop = F.lower(F.coalesce("product_name", F.lit(""))), F.lower(F.coalesce("shop_name", F.lit("")))

    def points(name: str, test: Column) -> Column:
        return F.when(test, POINTS[name]).otherwise(0)

    part = F.exists(slugs, lambda s: host.contains(s) | s.contains(host))
    brand = F.when((host == "") | (F.size(slugs) == 0), 0).when(
        (site != "") & F.array_contains(slugs, site), POINTS["brand_site"]).when(part, POINTS["brand_part"]).otherwise(0)
    return (brand + points("product_path", _contains_any(href, PRODUCT_PATHS))
            + points("retailer", _contains_any(href, RETAILERS))
            + points("name_in_title", (product != "") & title.contains(F.substring(product, 1, 20)))
            + points("name_in_body", (product != "") & body.contains(F.substring(product, 1, 20)))
            + points("shop_in_title", (shop != "") & title.contains(F.substring(shop, 1, 15))))


def best_urls(results: DataFrame, products: DataFrame, key: str = "product_id") -> DataFrame:
    """Best address per product; review sites never win, the earlier result wins ties.  Results fold to one per product in
    the map tasks."""
    usable = results.withColumn("href", strip(F.col("href")))
    usable = usable.where(is_web_address(F.col("href")) & ~_contains_any(F.lower("href"), REVIEW_SITES))
    named = usable.join(products.select(key, "product_name", "shop_name"), key)
    scored = (named.withColumns({"_slugs": brand_slugs(F.col("shop_name")), "_host": text.host_label(F.col("href")),
                                 "_site": text.site_label(F.col("href")),
                                 "title": F.coalesce("title", F.lit("")), "body": F.coalesce("body", F.lit(""))})
              .withColumn("points", result_points()))
    best = scored.groupBy(key).agg(F.max(F.struct("points", (-F.col("position")).alias("p"), "href")).alias("b"))
    return best.select(key, F.col("b.href").alias("url"), F.col("b.points").alias("points"))
