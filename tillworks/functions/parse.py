"""Parsers from messy text to typed values.  Anything unreadable becomes NULL, never an error.

Numbers are read as DECIMAL, not DOUBLE: a 19-digit product id survives, and text such as ``nan`` or ``inf`` is
rejected by the cast itself.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every character counted as white space around a field.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Accepted ranges.
MAX_ID = 2**63 - 1
MAX_MONEY = 100_000_000
MAX_ITEMS = 10_000_000
PERCENT_RANGE = (-100, 1000)
#: 20 digits before the point hold every accepted value; ranges are tested, and fractions cut, before digits are lost.
EXACT = "decimal(38,18)"
POINTS = "decimal(30,6)"
# Characters dropped from ids and counts, money and percentages.
ID_DROPS, MONEY_DROPS, POINTS_DROPS = ",", "$€£,", "%"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def strip(c: Column) -> Column:
    """Trim any white space."""
    return F.btrim(c, F.lit(WHITESPACE))


def quick_strip(c: Column) -> Column:
    """``strip`` for stored columns.  Trimming a set of characters is slow; text that starts and ends with a visible
    ASCII character after the plain trim is done.  (The input appears several times: do not nest.)"""
    t = F.btrim(c)
    done = F.substring(t, 1, 1).between("!", "~") & F.substring(t, -1, 1).between("!", "~")
    return F.when(done, t).otherwise(strip(t))


def parse_date(c: Column) -> Column:
    """M/D/YYYY, then M/D/YY, then YYYY-M-D, then D/M/YYYY; the first reading that is a real day wins."""
    return date_of(quick_strip(c))


def date_of(s: Column) -> Column:
    """``parse_date`` of stripped text.  The parts are put together as a date literal: its cast takes a fraction of the time of
    a pattern, and rejects the same days."""
    one, two = F.substring_index(s, "/", 1), F.substring_index(F.substring_index(s, "/", 2), "/", -1)

    def day(year: Column, month: Column, number: Column) -> Column:
        return F.concat_ws("-", year, month, number).try_cast("date")

    long, short = F.substring(s, -4, 4), F.substring(s, -2, 2)
    # two-digit years 69..99 belong to the 1900s
    century = F.concat(F.when(short >= "69", "19").otherwise("20"), short)
    return (F.when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), F.coalesce(day(long, one, two), day(long, two, one)))
             .when(s.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), s.try_cast("date"))
             .when(s.rlike(r"^\d{1,2}/\d{1,2}/\d{2}$"), day(century, one, two)))


def number_text(c: Column, drop: str) -> Column:
    """Numeric text without some characters and without blanks around it."""
    for char in drop:
        c = F.replace(c, F.lit(char), F.lit(""))
    return F.btrim(c)


def number_of(t: Column, type_name: str = EXACT) -> Column:
    """``number_text`` to DECIMAL.  A failing cast is costly, so text that cannot start a number is not cast; the cast itself
    trims ASCII blanks."""
    first = F.substring(t, 1, 1)
    usual = is_ascii(t) & first.between("+", "9")
    rare_blank = ~is_ascii(t) | ((first < "!") & (first != ""))
    return F.when(usual, t.try_cast(type_name)).when(rare_blank, strip(t).try_cast(type_name))


def _number(c: Column, drop: str, type_name: str) -> Column:
    return number_of(number_text(c, drop), type_name)


def parse_id(c: Column, via_double: bool = False) -> Column:
    """Thousands commas and scientific notation allowed; fraction cut off; 0 .. 2^63-1."""
    number = _number(c, ID_DROPS, EXACT)
    if via_double:
        number = F.when(number.isNotNull(), strip(F.replace(c, F.lit(","), F.lit(""))).try_cast("double"))
        # the largest id is no DOUBLE: its reading is one more and out of range
        number = F.when(number < float(MAX_ID), number)
    return id_of(number)


def id_of(number: Column) -> Column:
    whole = number.try_cast("bigint")
    return F.when(whole >= 0, whole)


def parse_text(c: Column, max_length: int = 500) -> Column:
    """Trim, one blank for each run of white space, no control characters, at most ``max_length`` characters."""
    one_blank = F.btrim(F.regexp_replace(c, r"[\s\x1c-\x1f\x85\p{Z}]+", " "))
    tidy = is_ascii(c) & ~c.contains("  ") & ~c.rlike(r"[\x00-\x1f]")
    clean = F.when(tidy, F.btrim(c)).otherwise(F.regexp_replace(one_blank, r"[\x00-\x1f]", ""))
    return F.nullif(F.substring(clean, 1, max_length), F.lit(""))


def parse_money(c: Column) -> Column:
    """Dollar, euro and pound signs and commas dropped; 0 .. 100 000 000; two decimals."""
    return money_of(_number(c, MONEY_DROPS, EXACT))


def money_of(value: Column) -> Column:
    return F.when(value.between(0, MAX_MONEY), F.round(value.cast("decimal(28,18)"), 2).cast("decimal(18,2)"))


def percent_points(c: Column) -> Column:
    """The number in front of a percent sign.  Spreadsheet error texts (#DIV/0!, #N/A ...) fail the cast: NULL."""
    return _number(c, POINTS_DROPS, POINTS)


def in_percent_range(points: Column) -> Column:
    return points.between(*PERCENT_RANGE)


def as_ratio(points: Column) -> Column:
    """Percent points in the accepted range to a ratio with four decimals; NULL outside."""
    narrow = points.try_cast("decimal(10,6)")
    return F.when(in_percent_range(points), F.round(narrow * F.lit(0.01).cast("decimal(3,2)"), 4))


def parse_percent(c: Column) -> Column:
    """Always divided by 100; NULL outside -100..1000 percent."""
    return as_ratio(percent_points(c)).cast("decimal(6,4)")


def parse_int(c: Column) -> Column:
    """Commas dropped, fraction cut off, 0 .. 10 000 000."""
    return items_of(_number(c, ID_DROPS, EXACT))


def items_of(number: Column) -> Column:
    whole = number.try_cast("bigint")
    return F.when(whole.between(0, MAX_ITEMS), whole.cast("int"))


def number_or_zero(c: Column, type_name: str) -> Column:
    """Missing, blank or unreadable numbers become 0."""
    return F.coalesce(strip(c.cast("string")).try_cast(type_name), F.lit(0).cast(type_name))
