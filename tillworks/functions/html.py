"""Fields of HTML pages as columns.

A page is cut into an array of tokens, tags and texts, after comments and the bodies of scripts and styles are gone.  Its tags
are folded over a stack of open elements: an end tag closes all elements down to its own, so what an element holds is
a range of tokens even where end tags are missing.  Only elements that a field asks for leave the fold; their texts are
slices of the token array, put together when a field needs them.  Everything is built-in functions on arrays: no shuffle, no
Python worker.

Character references: the named ones of HTML 4 and all numeric ones.  Cases: NULL pages and addresses count as empty; a page
without body has no snippet; an element left open lasts to the end of what encloses it.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillworks.functions.parse import strip
from tillworks.functions.text import collapse_space

# Limits, class words, image hints and blocked image hosts.
DESCRIPTION_LENGTH = 500
SNIPPET_LENGTH = 2000
MIN_PARAGRAPH = 30
MIN_SECTION = 50
TREND_CLASS = "(?i)trend|popular|insight"
IMAGE_HINTS = ["/product", "cdn.", "images.", "shopify", "amazon.com/images"]
TRACKERS = ["pixel", "1x1"]
BLOCKED_IMAGE_HOSTS = ["walmartimages.com", "i5.walmartimages.com", "i2.walmartimages.com"]
VOID = "area base br col embed hr img input link meta param source track wbr".split()
HIDDEN = ["template", "rt", "rp"]

#: What shows no text and holds no tags, whichever begins first.
OPAQUE = r"(?is)<!--.*?(?:-->|\z)|<(script|style)\b[^>]*+>.*?(?:</\1\s*>|\z)"
#: A tag with quoted values, a run of text, or a stray opening bracket.
TOKEN = r"""<[!/?a-zA-Z][^"'>]*+(?:(?:"[^"]*+"|'[^']*+')[^"'>]*+)*+>|[^<]++|<"""
TAG_NAME = r"^</?([a-zA-Z][^\s/>]*)"
ATTRIBUTE = r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>][^\s>]*))?"""
REFERENCE = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*);?|[^&]+|&"

ELEMENT = "struct<mark:string,start:int,stop:int>"
OPEN = "struct<name:string,mark:string,start:int>"


def _empty(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _named_characters() -> Column:
    """Name to character, as one literal."""
    listed = "\x02".join(f"{name}\x01{chr(code)}" for name, code in sorted(name2codepoint.items()))
    return F.str_to_map(F.lit(listed), F.lit("\x02"), F.lit("\x01"))


def _character(reference: Column) -> Column:
    """The character of a reference, or the reference itself where there is none."""
    def shown(number: Column) -> Column:
        bad = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF) | number.isNull()
        return F.when(bad, F.lit("\ufffd")).otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))

    def read(name: Column) -> Column:
        digits = F.when(F.rlike(name, F.lit("^#[xX]")), F.conv(F.substring(name, 3, 9), 16, 10)).otherwise(F.substring(name, 2, 10))
        return F.when(F.startswith(name, F.lit("#")), _let(digits.cast("bigint"), shown)).otherwise(
            F.coalesce(F.element_at(_named_characters(), name), reference))

    return _let(F.regexp_replace(reference, "^&|;$", ""), read)


def unescape(text: Column) -> Column:
    def read(t: Column) -> Column:
        parts = F.transform(F.regexp_extract_all(t, F.lit(REFERENCE), 0), lambda p: F.when(
            F.startswith(p, F.lit("&")) & (F.length(p) > 1), _character(p)).otherwise(p))
        return F.when(F.contains(t, F.lit("&")), F.array_join(parts, "")).otherwise(t)

    return _let(text, read)


def tokens(page: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.coalesce(page, F.lit("")), OPAQUE, ""), F.lit(TOKEN), 0)


def is_tag(token: Column) -> Column:
    return F.rlike(token, F.lit("^<[!/?a-zA-Z]"))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute of a tag, the last one if it repeats; NULL without it."""
    def read(inside: Column) -> Column:
        names = F.reverse(F.transform(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 1), F.lower))
        values = F.reverse(F.regexp_extract_all(inside, F.lit(ATTRIBUTE), 2))
        return _let(F.array_position(names, name).cast("int"), lambda at: F.when(at > 0, unescape(F.regexp_replace(
            F.get(values, at - 1), """^["']|["']$""", ""))))

    return _let(F.regexp_replace(tag, r"^<[^\s/>]+|/?>$", ""), read)


def tags(token_list: Column) -> Column:
    """(at, name, closing, tag) of the tags; void elements and those that end themselves are no elements with content."""
    def read(token: Column, at: Column) -> Column:
        name = F.when(F.startswith(token, F.lit("<")), F.lower(F.regexp_extract(token, TAG_NAME, 1))).otherwise("")
        return F.struct(at.alias("at"), name.alias("name"), F.startswith(token, F.lit("</")).alias("closing"), token.alias("tag"))

    return F.filter(F.transform(token_list, read), lambda t: t["name"] != "")


def elements(tag_list: Column, n_tokens: Column) -> Column:
    """(mark, start, stop): ranges of tokens inside paragraphs (``p``), the first body, sections of a trend class in it and
    elements that show no text (``hidden``)."""
    holds = F.filter(tag_list, lambda t: ~t["name"].isin(VOID) & ~F.endswith(t["tag"], F.lit("/>")))

    def mark(t: Column, acc: Column) -> Column:
        inside = F.exists(acc["open"], lambda o: F.coalesce(o["mark"], F.lit("")) == "body")
        trend = t["name"].isin("section", "div") & inside & F.coalesce(F.rlike(attribute(t["tag"], "class"), F.lit(TREND_CLASS)), F.lit(False))
        return (F.when(t["name"] == "p", "p").when((t["name"] == "body") & ~acc["seen"], "body")
                .when(t["name"].isin(HIDDEN), "hidden").when(trend, "trend"))

    def opened(acc: Column, t: Column) -> Column:
        entry = F.struct(t["name"].alias("name"), mark(t, acc).alias("mark"), t["at"].alias("start"))
        return F.struct(F.concat(acc["open"], F.array(entry)).alias("open"), acc["done"].alias("done"),
                        (acc["seen"] | (t["name"] == "body")).alias("seen"))

    def closed(acc: Column, t: Column) -> Column:
        n = F.array_position(F.reverse(F.transform(acc["open"], lambda o: o["name"])), t["name"]).cast("int")
        size = F.size(acc["open"])
        gone = F.slice(acc["open"], size - n + 1, n)
        return F.when(n == 0, acc).otherwise(F.struct(
            F.slice(acc["open"], F.lit(1), size - n).alias("open"), F.concat(acc["done"], ended(gone, t["at"])).alias("done"),
            acc["seen"].alias("seen")))

    def ended(gone: Column, at: Column) -> Column:
        return F.transform(F.filter(gone, lambda o: o["mark"].isNotNull()), lambda o: F.struct(
            o["mark"].alias("mark"), o["start"].alias("start"), at.alias("stop")))

    zero = F.struct(_empty(OPEN).alias("open"), _empty(ELEMENT).alias("done"), F.lit(False).alias("seen"))
    found = F.aggregate(holds, zero, lambda acc, t: F.when(t["closing"], closed(acc, t)).otherwise(opened(acc, t)),
                        lambda acc: F.concat(acc["done"], ended(acc["open"], n_tokens)))
    return F.array_sort(found, lambda a, b: a["start"] - b["start"])


def shown_texts(token_list: Column, element_list: Column) -> Column:
    """The text of each token, empty for tags and inside hidden elements."""
    hidden = F.filter(element_list, lambda e: e["mark"] == "hidden")
    seen = F.transform(token_list, lambda t: F.when(is_tag(t), "").otherwise(unescape(t)))
    return F.when(F.size(hidden) == 0, seen).otherwise(F.transform(seen, lambda t, i: F.when(
        F.exists(hidden, lambda e: (e["start"] < i) & (i < e["stop"])), "").otherwise(t)))


def text_of(texts: Column, element: Column) -> Column:
    return F.array_join(F.slice(texts, element["start"] + 2, element["stop"] - element["start"] - 1), "")


def first_longer(texts: Column, element_list: Column, mark: str, least: int) -> Column:
    """Text of the first element of a mark with more than ``least`` characters, NULL without one; later ones are not read."""
    return F.aggregate(F.filter(element_list, lambda e: e["mark"] == mark), F.lit(None).cast("string"), lambda acc, e: F.when(
        acc.isNotNull(), acc).otherwise(_let(strip(text_of(texts, e)), lambda t: F.when(F.length(t) > least, t))))


def _filled(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def meta(tag_list: Column, key: str, value: str) -> Column:
    """Content of the first meta tag whose attribute ``key`` is ``value``; NULL if it is empty."""
    found = F.filter(tag_list, lambda t: (t["name"] == "meta") & ~t["closing"] & F.coalesce(attribute(t["tag"], key) == value, F.lit(False)))
    return _filled(attribute(F.get(found, F.lit(0))["tag"], "content"))


def description(tag_list: Column, texts: Column, element_list: Column) -> Column:
    """Meta description, else og:description, else the first paragraph with some length."""
    found = F.coalesce(meta(tag_list, "name", "description"), meta(tag_list, "property", "og:description"),
                       first_longer(texts, element_list, "p", MIN_PARAGRAPH), F.lit(""))
    return F.substring(strip(found), 1, DESCRIPTION_LENGTH)


def trend_snippet(texts: Column, element_list: Column) -> Column:
    """First section or div of a trend class with some length, else the body text with single blanks."""
    body = F.get(F.filter(element_list, lambda e: e["mark"] == "body"), F.lit(0))
    whole = F.when(body.isNotNull(), collapse_space(strip(text_of(texts, body))))
    found = F.coalesce(first_longer(texts, element_list, "trend", MIN_SECTION), whole, F.lit(""))
    return F.substring(found, 1, SNIPPET_LENGTH)


def absolute(base: Column, link: Column) -> Column:
    """A link of the page at ``base``, resolved: other schemes stay, ``//host`` is taken as https, dot segments are folded."""
    def folded(steps: Column) -> Column:
        # a last dot segment stands for its folder
        whole = F.when(F.element_at(steps, -1).isin(".", ".."), F.concat(steps, F.array(F.lit("")))).otherwise(steps)
        return F.array_join(F.aggregate(whole, _empty("string"), lambda acc, s: F.when(s == ".", acc).when(
            s == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(
                F.concat(acc, F.array(s)))), "/")

    def joined(p: Column) -> Column:
        path = F.substring(p["plain"], F.length(p["host"]) + 1, F.length(p["plain"]))
        folder = F.regexp_extract(path, "(?s)^(.*/)", 1)
        folder = _let(folder, lambda f: F.when((f == "") & (p["host"] != ""), "/").otherwise(f))
        whole = F.when(F.startswith(p["target"], F.lit("/")), p["target"]).otherwise(F.concat(folder, p["target"]))
        own = F.when(F.startswith(p["rest"], F.lit("?")), p["plain"]).otherwise(p["page"])
        return (F.when(F.startswith(p["link"], F.lit("//")), F.concat(F.lit("https:"), p["link"]))
                .when(F.rlike(p["link"], F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), p["link"])
                .when(p["target"] == "", F.concat(own, p["rest"]))
                .otherwise(F.concat(p["host"], _let(F.split(whole, "/"), folded), p["rest"])))

    def parts(b: Column, x: Column) -> Column:
        return F.struct(
            x.alias("link"), F.regexp_replace(b, "[?#].*$", "").alias("plain"), F.regexp_replace(b, "#.*$", "").alias("page"),
            F.regexp_extract(b, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1).alias("host"),
            F.regexp_extract(x, r"(?s)^([^?#]*)", 1).alias("target"), F.regexp_extract(x, r"(?s)^[^?#]*(.*)$", 1).alias("rest"))

    return _let(F.struct(base.alias("b"), link.alias("x")), lambda v: _let(parts(v["b"], v["x"]), joined))


def _any_of(c: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(c, F.lit(p)) for p in parts])


def product_image(tag_list: Column, base: Column) -> Column:
    """og:image, else an itemprop image, else the first image that looks like a product; empty on a blocked host."""
    def source(t: Column) -> Column:
        return strip(F.coalesce(_filled(attribute(t["tag"], "src")), attribute(t["tag"], "data-src"), F.lit("")))

    images = F.transform(F.filter(tag_list, lambda t: (t["name"] == "img") & ~t["closing"]), lambda t: F.struct(
        source(t).alias("src"), F.coalesce(attribute(t["tag"], "itemprop") == "image", F.lit(False)).alias("named"),
        F.lower(F.coalesce(attribute(t["tag"], "alt"), F.lit(""))).alias("alt")))
    images = F.filter(images, lambda i: (i["src"] != "") & ~F.startswith(F.lower(i["src"]), F.lit("data:")))

    def likely(i: Column) -> Column:
        low = F.lower(i["src"])
        return ~F.contains(i["alt"], F.lit("logo")) & ~F.contains(low, F.lit("tracking")) & ~_any_of(i["src"], TRACKERS) & _any_of(low, IMAGE_HINTS)

    def first(of: Column, test) -> Column:
        return F.get(F.filter(of, test), F.lit(0))["src"]

    def allowed(link: Column) -> Column:
        host = F.lower(F.regexp_extract(link, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
        return F.when(_let(host, lambda h: _any_of(h, BLOCKED_IMAGE_HOSTS)), "").otherwise(link)

    chosen = F.coalesce(strip(meta(tag_list, "property", "og:image")),
                        _let(images, lambda of: F.coalesce(first(of, lambda i: i["named"]), first(of, likely))))
    return _let(F.coalesce(absolute(base, chosen), F.lit("")), allowed)


def with_elements(pages: DataFrame, html: str = "html") -> DataFrame:
    """Adds ``_tokens``, ``_tags``, ``_elements`` and ``_texts`` of each page."""
    out = pages.withColumn("_tokens", tokens(F.col(html)))
    out = out.withColumn("_tags", tags(F.col("_tokens")))
    out = out.withColumn("_elements", elements(F.col("_tags"), F.size("_tokens")))
    return out.withColumn("_texts", shown_texts(F.col("_tokens"), F.col("_elements")))
