"""Text, URL and display functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillworks.functions.parse import WHITESPACE, strip

# Typographic characters and their ASCII forms.
PUNCTUATION = {
    "\u2019": "'",
    "\u2018": "'",
    "\u201c": '"',
    "\u201d": '"',
    "\u2014": "-",
    "\u2013": "-",
    "\u2026": "...",
}
URL_DISPLAY_LENGTH = 80


def match_key(c: Column) -> Column:
    """Key for comparisons that ignore case and outer blanks."""
    return F.lower(F.btrim(c))


def ascii_punctuation(c: Column) -> Column:
    single = {k: v for k, v in PUNCTUATION.items() if len(v) == 1}
    out = F.translate(c, "".join(single), "".join(single.values()))
    for char, text in PUNCTUATION.items():
        if char not in single:
            out = F.replace(out, F.lit(char), F.lit(text))
    return out


def title_case(c: Column) -> Column:
    """Capital after every non-letter (``skin-care`` -> ``Skin-Care``), the rest in lower case."""
    runs = F.regexp_extract_all(c, F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, F.initcap), "")


def title_list(c: Column) -> Column:
    """Title case for each item of a comma list; blank items go."""
    items = F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
    return F.array_join(F.transform(items, title_case), ", ")


def slug(c: Column) -> Column:
    return F.replace(F.replace(F.lower(c), F.lit(" & "), F.lit("-")), F.lit(" "), F.lit("-"))


def token_estimate(c: Column) -> Column:
    """Four characters to a token, rounded down."""
    return F.floor(F.length(c) / 4).cast("bigint")


def question_category(c: Column) -> Column:
    """Text after the first `` in `` without trailing question marks; the whole question where that leaves nothing."""
    question = F.nullif(strip(c), F.lit(""))
    at = F.locate(" in ", question)
    tail = F.rtrim(question.substr(at + F.lit(4), F.length(question)), F.lit("?"))
    tail = F.nullif(strip(tail), F.lit(""))
    return F.when(at > 0, F.coalesce(tail, question)).otherwise(question)


def authority(url: Column) -> Column:
    """Host with port of an http(s) address, lower case."""
    return F.lower(F.regexp_extract(url, r"^(?i:https?)://([^/?#]*)", 1))


def host_label(url: Column) -> Column:
    """First label of the host without ``www.``: https://www.shop.example.com/x -> shop."""
    return F.split_part(F.regexp_replace(authority(url), r"^www\.", ""), F.lit("."), F.lit(1))


def site_label(url: Column) -> Column:
    """Label in front of the last dot: shop.example.com -> example; the host label where there is none."""
    host = authority(url)
    label = F.when(host.contains("."), F.split_part(host, F.lit("."), F.lit(-2)))
    return F.coalesce(F.nullif(label, F.lit("")), host_label(url))


def display_domain(url: Column) -> Column:
    """Scheme, ``www.``, path and query dropped; letter case kept."""
    bare = F.regexp_replace(strip(url), r"^(?i:https?:///*)", "")
    bare = F.regexp_replace(bare, r"^(?i:www\.)", "")
    return F.coalesce(F.regexp_extract(bare, r"^([^/?]*)", 1), F.lit(""))


def short_url(url: Column, max_length: int = URL_DISPLAY_LENGTH) -> Column:
    cut = F.concat(F.rtrim(F.substring(url, 1, max_length - 3), F.lit("/")), F.lit("..."))
    return F.coalesce(F.when(F.length(url) <= max_length, url).otherwise(cut), F.lit(""))


def dollars(c: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(c, 0))


def ratio_as_percent(c: Column) -> Column:
    """0.187 -> 18.7%"""
    return F.concat(F.format_number(c * 100, 1), F.lit("%"))


def display_time(c: Column) -> Column:
    """January 26, 2026 at 10:05 AM"""
    return F.date_format(c, "MMMM dd, yyyy 'at' hh:mm a")


def collapse_space(c: Column) -> Column:
    return F.regexp_replace(c, f"[{WHITESPACE}]+", " ")
