from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillworks.functions import parse, text


def values(spark, fn, inputs):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], "i int, v string")
    return [r["o"] for r in df.select("i", fn(F.col("v")).alias("o")).orderBy("i").collect()]


def test_dates(spark):
    cases = {
        "4/01/2024": date(2024, 4, 1), "12/25/2024": date(2024, 12, 25), " 1/2/24 ": date(2024, 1, 2),
        "2024-4-1": date(2024, 4, 1), "13/02/2024": date(2024, 2, 13), "2/3/2024": date(2024, 2, 3),
        "2/30/2024": None, "invalid-date": None, "": None, None: None, "1/1/70": date(1970, 1, 1),
        "1/1/68": date(2068, 1, 1), "\t4/1/2024 ": date(2024, 4, 1), "13/02/24": None, "004/1/2024": None,
    }
    assert values(spark, parse.parse_date, cases) == list(cases.values())


def test_ids(spark):
    cases = {
        "1.72938E+18": 1729380000000000000, "1,72938E+18": None, "1,72938E+12": 172938 * 10**12,
        "123456789": 123456789, "1729383941730701675": 1729383941730701675, "-12345": None, "": None, None: None,
        "bad-id": None, "12.9": 12, "-0.5": 0, "9223372036854775807": 2**63 - 1, "9223372036854775808": None,
        " 77 ": 77, "nan": None, "inf": None, "1,234": 1234,
    }
    assert values(spark, parse.parse_id, cases) == list(cases.values())


def test_ids_via_double_lose_digits(spark):
    got = values(spark, lambda c: parse.parse_id(c, via_double=True), ["1729383941730701675", "1729383941730701676", "x"])
    assert got[0] == got[1] == int(float("1729383941730701675")) and got[2] is None
    far = values(spark, lambda c: parse.parse_id(c, via_double=True), ["9223372036854775807", "9223372036854774784"])
    assert far == [None, 9223372036854774784]


def test_text(spark):
    cases = {
        "  Product Name  ": "Product Name", "Product    Name": "Product Name", "": None, "   ": None, None: None,
        "a\x01b": "ab", "a\tb\n c": "a b c", "café x": "café x", "A" * 1000: "A" * 500, "\x00": None,
        "a \x01 b": "a  b",
    }
    assert values(spark, parse.parse_text, cases) == list(cases.values())
    assert values(spark, lambda c: parse.parse_text(c, 100), ["A" * 1000]) == ["A" * 100]


def test_money(spark):
    cases = {
        "$305,785.10": "305785.10", "12.66": "12.66", "1,234,567.89": "1234567.89", "-100.00": None, "": None,
        None: None, "€ 12": "12.00", "100000000": "100000000.00", "100000000.01": None, "n/a": None,
        "$228,510.00 ": "228510.00", "1e3": "1000.00", "$": None,
        "-0.0000001": None, "100000000.0000001": None, "0.0049999": "0.00", "0.005": "0.01",
    }
    want = [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, parse.parse_money, cases) == want


def test_percent(spark):
    cases = {"-42%": "-0.42", "15%": "0.15", "25": "0.25", "": None, None: None, "5000%": None, "1000%": "10",
             "-100%": "-1", "#DIV/0!": None, "#n/a": None, "18.7 %": "0.187", "-100.01": None}
    want = [None if v is None else Decimal(v) for v in cases.values()]
    assert values(spark, parse.parse_percent, cases) == want


def test_integers(spark):
    cases = {"24,157": 24157, "12345": 12345, "-100": None, "": None, None: None, "-0.5": 0, "7.9": 7,
             "10000000": 10_000_000, "10000001": None, "x": None, "9999999.9999999": 9_999_999}
    assert values(spark, parse.parse_int, cases) == list(cases.values())


def test_number_or_zero(spark):
    got = values(spark, lambda c: parse.number_or_zero(c, "bigint"), ["5", " 6 ", "", None, "x"])
    assert got == [5, 6, 0, 0, 0]


@pytest.mark.parametrize(("fn", "given", "want"), [
    (text.title_list, "skin-care, o'neil,, BOLD idea", "Skin-Care, O'Neil, Bold Idea"),
    (text.ascii_punctuation, "‘a’ “b” —– …", "'a' \"b\" -- ..."),
    (text.slug, "Skin & Hair Care", "skin-hair-care"),
    (text.question_category, "What are the top products in Skincare?", "Skincare"),
    (text.question_category, "Skincare", "Skincare"),
    (text.question_category, "  what is in ?", "what is in ?"),
    (text.display_domain, "https://www.Reddit.com/r/x?y", "Reddit.com"),
    (text.short_url, "https://e.com/" + "a" * 100, "https://e.com/" + "a" * 63 + "..."),
    (text.host_label, "https://www.shop.example.com/x", "shop"),
    (text.site_label, "https://www.shop.example.com/x", "example"),
])
def test_text_functions(spark, fn, given, want):
    assert values(spark, fn, [given]) == [want]
