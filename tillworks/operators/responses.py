"""Model answers and trend texts to rows, and digest texts from rows; built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions.parse import strip
from tillworks.functions.text import dollars, ratio_as_percent

# List sizes, lengths and default texts.
ITEMS = 5
TITLE_LENGTH = 80
DIGEST_ITEMS = 3
DIGEST_LENGTH = 120
NO_TREND = "Market trend analysis unavailable."
DIGEST_HEAD = "Web search insights (trends, pain points, competitors):"
DIGEST_LABELS = {"trends": "Trends", "pain_points": "Pain points", "competitors": "Competitors"}

# Number of product ideas of an answer and what stands for a missing one.
IDEAS = 1
DEFAULT_IDEA = {"product_name": "Concept Product", "description": "", "why_it_would_sell": "",
                "competitive_advantage": "", "image_prompt": "Product bottle or package, clean background"}

TREND = "struct<title:string,description:string>"


def strip_fences(c: Column) -> Column:
    """Answer text without a surrounding Markdown code fence."""
    t = strip(c)
    inner = strip(F.regexp_replace(F.regexp_replace(t, r"^```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    return F.coalesce(F.when(F.startswith(t, F.lit("```")), inner).otherwise(t), F.lit(""))


def _trend(title: Column, description: Column) -> Column:
    return F.struct(title.alias("title"), description.alias("description")).cast(TREND)


def _empty() -> Column:
    return _trend(F.lit(""), F.lit(""))


def _object_trend(item: Column) -> Column:
    parsed = F.from_json(item, TREND)
    fields = _trend(strip(F.coalesce(parsed["title"], F.lit(""))), strip(F.coalesce(parsed["description"], F.lit(""))))
    return F.when(F.startswith(item, F.lit("{")), fields).otherwise(_empty())


def _text_trend(item: Column) -> Column:
    """``Title: text`` where the title is short, else all of it as description; a title alone is its own description."""
    s = strip(item)
    at = F.locate(":", s)
    title = strip(F.substring(s, F.lit(1), at - 1))
    rest = strip(F.substring(s, at + 1, F.length(s)))
    split = (at > 0) & (at - 1 < TITLE_LENGTH)
    return F.when(split, _trend(title, F.when(rest != "", rest).otherwise(title))).otherwise(_trend(F.lit(""), s))


def trend_list(items: Column) -> Column:
    """Exactly five trends.  The first item decides whether the list holds objects or texts; short lists are padded."""
    first = F.get(items, F.lit(0))
    head = F.slice(items, 1, ITEMS)
    objects = F.startswith(first, F.lit("{"))
    chosen = F.when(objects, F.transform(head, _object_trend)).otherwise(F.transform(head, _text_trend))
    chosen = F.coalesce(chosen, F.array().cast(f"array<{TREND}>"))
    return F.slice(F.concat(chosen, F.array_repeat(_empty(), ITEMS)), 1, ITEMS)


def normalise_responses(df: DataFrame, column: str = "response", list_field: str = "supporting_trends",
                        intro_field: str = "supporting_trends_intro") -> DataFrame:
    """One row per answer: introduction text and five trends; answers that are not JSON get the defaults."""
    body = strip_fences(F.col(column))
    raw_items = F.from_json(F.get_json_object("_body", f"$.{list_field}"), "array<string>")
    intro = F.get_json_object("_body", f"$.{intro_field}")
    quoted = F.col("_body").rlike(rf'"{intro_field}"\s*:\s*"')
    out = df.withColumn("_body", body).withColumns({
        "intro": F.when(quoted, F.coalesce(intro, F.lit(""))).otherwise(""), "trends": trend_list(raw_items)})
    return out.drop("_body", column)


def product_ideas(df: DataFrame, column: str = "response", n: int = IDEAS) -> DataFrame:
    """The ``products`` list of each answer: n rows per answer, ``idea`` from 1, each with its texts, price, ingredients,
    introduction and five trends.  Missing ideas, and answers that are no JSON, give the default idea."""
    rest = [c for c in df.columns if c != column]
    items = F.from_json(F.get_json_object("_body", "$.products"), "array<string>")
    objects = F.coalesce(F.slice(items, 1, n), F.array().cast("array<string>"))
    padded = F.slice(F.concat(objects, F.array_repeat(F.lit(None).cast("string"), n)), 1, n)
    ideas = df.withColumn("_body", strip_fences(F.col(column))).select(*rest, F.posexplode(padded).alias("idea", "_item"))
    found = F.startswith("_item", F.lit("{"))

    def text_of(field: str, default: str) -> Column:
        return F.when(found, F.get_json_object("_item", f"$.{field}")).otherwise(default)

    price = F.when(found, F.get_json_object("_item", "$.estimated_price_usd").try_cast("double")).otherwise(F.lit(0.0))
    ingredients = F.from_json(F.get_json_object("_item", "$.key_ingredients"), "array<string>")
    intro = F.get_json_object("_item", "$.supporting_trends_intro")
    quoted = F.col("_item").rlike(r'"supporting_trends_intro"\s*:\s*"')
    trends = trend_list(F.from_json(F.get_json_object("_item", "$.supporting_trends"), "array<string>"))
    return ideas.select(
        *rest, (F.col("idea") + 1).alias("idea"), *[text_of(f, d).alias(f) for f, d in DEFAULT_IDEA.items()],
        price.alias("estimated_price_usd"),
        F.coalesce(ingredients, F.array().cast("array<string>")).alias("key_ingredients"),
        F.when(quoted, F.coalesce(intro, F.lit(""))).otherwise("").alias("supporting_trends_intro"),
        trends.alias("supporting_trends"))


def numbered_items(df: DataFrame, column: str, n: int = ITEMS) -> DataFrame:
    """``trends``: the items of a numbered list; under three of them, paragraphs with a title line or of some length are
    added; the list is padded to n."""
    listed = F.filter(F.transform(F.regexp_extract_all(
        F.col(column), F.lit(r"(?s)\d+\.\s+(.+?)(?=\d+\.\s+|\z)"), 1), strip), lambda x: x != "")

    def paragraph(p: Column) -> Column:
        lines = F.locate("\n", p)
        title = strip(F.substring(p, F.lit(1), lines - 1))
        rest = strip(F.substring(p, lines + 1, F.length(p)))
        words = F.size(F.split(title, r"\s+"))
        titled = F.when(words.between(2, 15) & (title != "") & (F.length(rest) > 20), F.concat(title, F.lit("\n"), rest))
        return F.when(lines > 0, titled).when(F.length(p) > 50, p)

    sections = F.transform(F.split(strip(F.col(column)), r"\n\n+"), strip)
    paragraphs = F.array_compact(F.transform(sections, paragraph))
    none = F.array().cast("array<string>")
    found = F.when(F.size(listed) >= 3, listed).otherwise(
        F.concat(F.coalesce(listed, none), F.coalesce(paragraphs, none)))
    padded = F.slice(F.concat(found, F.array_repeat(F.lit(NO_TREND), n)), 1, n)
    return df.withColumn("trends", padded)


def market_line(rank: Column) -> Column:
    """``1. name | Shop: s | Revenue: $1,234 | Growth: 18.7% | Items sold: 5,678``; growth is a ratio shown as percent."""
    return F.concat(
        rank.cast("string"), F.lit(". "), F.coalesce(F.nullif("product_name", F.lit("")), F.lit("Unknown")),
        F.lit(" | Shop: "), F.coalesce("shop_name", F.lit("")),
        F.lit(" | Revenue: "), dollars(F.coalesce("revenue_usd", F.lit(0))),
        F.lit(" | Growth: "), ratio_as_percent(F.coalesce("mom_growth_pct", F.lit(0))),
        F.lit(" | Items sold: "), F.format_number(F.coalesce("item_sold", F.lit(0)), 0))


def short_description() -> Column:
    """One sentence on a top product."""
    numbers = F.concat(dollars(F.coalesce("revenue_usd", F.lit(0))), F.lit(" revenue, "),
                       ratio_as_percent(F.coalesce("mom_growth_pct", F.lit(0))), F.lit(" growth (Last 30 Days)."))
    return F.when(F.coalesce("shop_name", F.lit("")) != "",
                  F.concat(F.lit("Top seller at "), F.col("shop_name"), F.lit(". "), numbers)).otherwise(numbers)


def market_context(ranked: DataFrame, key: str = "l2_category", rank: str = "revenue_rank") -> DataFrame:
    """Ranked lines of each category in one text.  ``ranked`` holds at most k rows per category."""
    lines = ranked.select(key, rank, market_line(F.col(rank)).alias("line"))
    listed = F.sort_array(F.collect_list(F.struct(rank, "line")))
    return lines.groupBy(key).agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\n").alias("context"))


def insight_digest(df: DataFrame) -> DataFrame:
    """Digest of search results held as arrays of (title, snippet) in the columns trends, pain_points, competitors."""
    def line(column: str, label: str) -> Column:
        items = F.slice(F.col(column), 1, DIGEST_ITEMS)
        parts = F.transform(items, lambda x: F.coalesce(
            F.nullif(strip(x["title"]), F.lit("")), F.substring(strip(x["snippet"]), 1, DIGEST_LENGTH), F.lit("")))
        return F.when(F.size(items) > 0, F.concat(F.lit(f"- {label}: "), F.array_join(parts, " | ")))

    lines = F.array_compact(F.array(*[line(c, label) for c, label in DIGEST_LABELS.items()]))
    digest = F.concat(F.lit(DIGEST_HEAD + "\n"), F.array_join(lines, "\n"), F.lit("\n\n"))
    return df.withColumn("digest", F.when(F.size(lines) > 0, digest).otherwise(""))
