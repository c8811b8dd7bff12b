import json
import random
from html.parser import HTMLParser
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from tillworks.functions import html
from tillworks.operators import responses, web

PAGE = """<html><head><title>t</title>{head}<script>var t="<p>a script is not a paragraph, however long it is</p>";</script>
</head><body><p>short</p><p>This paragraph has more than thirty characters.</p>{body}</body></html>"""


def fields(spark, page, url="https://e.com/"):
    pages = spark.createDataFrame([(1, url, page)], "page_id int, url string, html string")
    return tuple(web.page_fields(pages).first())[2:]


@pytest.mark.parametrize(("head", "body", "want"), [
    ('<meta name="description" content=" Meta text ">', "", "Meta text"),
    ('<meta name="description" content=""><meta property="og:description" content="Graph">', "", "Graph"),
    ("<META content='Caf&eacute; &#x1D11E;&#38;&nosuch;&lt' NAME=description />", "", "Café 𝄞&&nosuch;<"),
    ("<!-- <meta name='description' content='hidden'> -->", "", "This paragraph has more than thirty characters."),
    ("<meta alt='name=description' name='x' content='no'>", "", "This paragraph has more than thirty characters."),
    ("", "", "This paragraph has more than thirty characters."),
])
def test_description(spark, head, body, want):
    assert fields(spark, PAGE.format(head=head, body=body))[0] == want


def test_snippet(spark):
    section = '<div class="Hot-Trends">' + "x" * 60 + "<script>no</script></div>"
    assert fields(spark, PAGE.format(head="", body=section))[1] == "x" * 60
    assert fields(spark, PAGE.format(head="", body='<div class="trend">tiny</div>'))[1] == \
        "shortThis paragraph has more than thirty characters.tiny"
    assert fields(spark, '<div class="trend">' + "outside the body " * 5 + "</div><body>in</body>")[1] == "in"
    assert fields(spark, "<p>no body element at all, but a long paragraph</p>")[1] == ""
    assert len(fields(spark, f"<body>{'word ' * 3000}</body>")[1]) == 2000
    assert fields(spark, "<body>a<template>b<p>c</p></template> &amp; 1 < 2<style>x</style></body>")[1] == "a & 1 < 2"


@pytest.mark.parametrize(("head", "body", "want"), [
    ('<meta property="og:image" content="//c.com/a.png">', "", "https://c.com/a.png"),
    ('<meta property="og:image" content="/a.png">', "", "https://e.com/a.png"),
    ("", '<img src="data:x" itemprop="image"><img data-src="b.png" itemprop="image">', "https://e.com/p/b.png"),
    ("", '<img src="https://cdn.x.com/l.png" alt="Our LOGO"><img src="https://cdn.x.com/pixel.gif">'
         '<img src="/other/c.png"><img src="/product/c.png">', "https://e.com/product/c.png"),
    ('<meta property="og:image" content="https://i5.walmartimages.com/a.png">', "", ""),
    ("", '<img src="/other/c.png">', ""),
    ("", '<img itemprop=image src="../../x/./y/../z.png?a=1&amp;b=2#c">', "https://e.com/x/z.png?a=1&b=2#c"),
])
def test_image(spark, head, body, want):
    assert fields(spark, PAGE.format(head=head, body=body), "https://e.com/p/x")[2] == want


def test_links_resolve_as_in_the_standard_library(spark):
    bases = ["http://a.b/c/d;p?q#f", "https://e.com", "https://e.com/", "http://h/x/y/"]
    links = ["g", "./g", "g/", "/g", "?y", "g?y", "#s", "g#s", "..", "../", "../g", "../../g", "../../../g", ".", "./", "g/./h",
             "g/../h", "http://z/x", "ftp://z/y", "mailto:x", "g;x=1/./y"]
    df = spark.createDataFrame([(b, x) for b in bases for x in links], "b string, l string")
    got = {(r.b, r.l): r.u for r in df.select("b", "l", html.absolute(F.col("b"), F.col("l")).alias("u")).collect()}
    assert {k: v for k, v in got.items() if v != urljoin(*k)} == {}


class Reader(HTMLParser):
    """Texts of paragraphs and of the body, read tag by tag."""

    VOID = "area base br col embed hr img input link meta param source track wbr".split()

    def __init__(self, page):
        super().__init__()
        self.open, self.texts = [], []
        self.feed(page)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag not in self.VOID:
            self.open.append((tag, [tag, ""]))
            if tag in ("p", "body"):
                self.texts.append(self.open[-1][1])

    def handle_endtag(self, tag):
        if tag in [t for t, _ in self.open]:
            while self.open.pop()[0] != tag:
                pass

    def handle_data(self, data):
        if not any(t in ("script", "style") for t, _ in self.open):
            for _, entry in self.open:
                entry[1] += data


def test_elements_against_a_reader(spark):
    """Any order of tags, closed or not."""
    rng = random.Random(4)
    parts = ["<p>", "</p>", "<div class='a'>", "</div>", "<b>", "</b>", "<br>", "one ", "two", "<script>if (a<b) '<p>'</script>",
             "<!-- <p> no -->", "&amp;", "<li>", "</ul>", "<ul>", "<img src='x>y'>", "three &lt; ", "</body>"]
    pages = [(i, "", "<body>" + "".join(rng.choice(parts) for _ in range(rng.randint(0, 60)))) for i in range(200)]
    df = html.with_elements(spark.createDataFrame(pages, "page_id int, url string, html string"))
    shown = F.transform("_elements", lambda e: F.struct(e["mark"].alias("m"), html.text_of(F.col("_texts"), e).alias("t")))
    got = {r.page_id: [tuple(e) for e in r.found] for r in df.select("page_id", shown.alias("found")).collect()}
    for i, _, page in pages:
        assert got[i] == [tuple(t) for t in Reader(page).texts], page


def test_page_fields_need_no_python(spark):
    pages = spark.createDataFrame([(1, "u", "<p>")], "page_id int, url string, html string")
    plan = web.page_fields(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_page_fields_operator(spark):
    pages = spark.createDataFrame([(1, "https://e.com/", PAGE.format(head="", body="")), (2, None, None)],
                                  "page_id int, url string, html string")
    got = {r.page_id: r for r in web.page_fields(pages).collect()}
    assert got[1].description.startswith("This paragraph") and got[2].description == ""


@pytest.mark.parametrize(("shop", "want"), [
    ("The Ordinary Store", ["theordinary", "the-ordinary"]),
    ("Ben & Jerry  Inc", ["ben&jerry", "ben-&-jerry", "benjerry", "ben"]),
    ("Acme", ["acme"]), ("", []), (None, []), ("x company official", ["xcompany", "x-company", "x"]),
])
def test_brand_slugs(spark, shop, want):
    df = spark.createDataFrame([(shop,)], "s string")
    assert df.select(web.brand_slugs(F.col("s"))).first()[0] == want


def test_best_url(spark):
    products = spark.createDataFrame([(1, "Night Serum", "Acme Store"), (2, "Soap", "Nobody")],
                                     "product_id int, product_name string, shop_name string")
    found = [
        (1, 0, "https://trustpilot.com/acme", "Night Serum", ""), (1, 1, "https://other.com/p/1", "night serum", ""),
        (1, 2, "https://www.acme.com/", "", ""), (1, 3, "https://shop-acme.net/x", "", "night serum"),
        (2, 0, "https://x1.com/", "", ""), (2, 1, "https://x2.com/", "", ""), (2, 2, "mailto:x", "", ""),
    ]
    results = spark.createDataFrame(found, "product_id int, position int, href string, title string, body string")
    got = {r.product_id: (r.url, r.points) for r in web.best_urls(results, products).collect()}
    assert got == {1: ("https://www.acme.com/", 35), 2: ("https://x1.com/", 0)}


def normalise(text):
    """Plain reading of the rules, for comparison."""
    empty = {"title": "", "description": ""}
    try:
        data = json.loads(text.strip().removeprefix("```json").removesuffix("```"))
    except ValueError:
        data = {}
    items, out = data.get("supporting_trends") or [], []
    for x in items[:5]:
        if isinstance(items[0], dict):
            out.append({k: str(x.get(k) or "").strip() for k in empty} if isinstance(x, dict) else empty)
        elif ":" in x and len(x.split(":")[0]) < 80:
            title, rest = (p.strip() for p in x.split(":", 1))
            out.append({"title": title, "description": rest or title})
        else:
            out.append({"title": "", "description": x.strip()})
    intro = data.get("supporting_trends_intro")
    return intro if isinstance(intro, str) else "", (out + [empty] * 5)[:5]


@pytest.mark.parametrize("answer", [
    {"supporting_trends_intro": "Hi", "supporting_trends": [{"title": " a ", "description": "b"}, "stray", {"title": "c"}]},
    {"supporting_trends": ["A: b", "no colon", "x" * 90 + ": y", "only:", "5: five", "sixth: gone"]},
    {"supporting_trends_intro": 7, "supporting_trends": []}, {"other": 1}, "not json",
])
@pytest.mark.parametrize("fence", ["{}", "```json\n{}\n```  "])
def test_responses(spark, answer, fence):
    text = fence.format(answer if isinstance(answer, str) else json.dumps(answer))
    row = responses.normalise_responses(spark.createDataFrame([(text,)], "response string")).first()
    assert (row.intro, [t.asDict() for t in row.trends]) == normalise(text)


def test_numbered_items(spark):
    texts = ["1. One thing\n2. Two\n 3. Three", "Plain", "Some Title\n" + "word " * 10 + "\n\n" + "y" * 60, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.trends for r in responses.numbered_items(df, "t").collect()]
    pad = responses.NO_TREND
    assert got[0] == ["One thing", "Two", "Three", pad, pad]
    assert got[1] == [pad] * 5
    assert got[2] == ["Some Title\n" + ("word " * 10).strip(), "y" * 60, pad, pad, pad]
    assert got[3] == [pad] * 5


def test_product_ideas(spark):
    answer = {"products": [{"product_name": "P", "estimated_price_usd": 12.5, "key_ingredients": ["a", "b"],
                            "supporting_trends": ["T: d"], "supporting_trends_intro": "Hi"}, {"product_name": "second"}]}
    rows = [(1, "```json\n" + json.dumps(answer) + "\n```"), (2, '{"products": []}'), (3, "no json"), (4, None),
            (5, '{"products": "x"}')]
    df = spark.createDataFrame(rows, "id int, response string")
    got = {r.id: r for r in responses.product_ideas(df).collect()}
    assert len(got) == 5
    assert (got[1].product_name, got[1].estimated_price_usd, got[1].key_ingredients) == ("P", 12.5, ["a", "b"])
    assert (got[1].supporting_trends_intro, got[1].supporting_trends[0]) == ("Hi", ("T", "d"))
    assert len(got[1].supporting_trends) == 5
    for i in (2, 3, 4, 5):
        assert (got[i].product_name, got[i].estimated_price_usd) == ("Concept Product", 0.0)
        assert got[i].image_prompt == responses.DEFAULT_IDEA["image_prompt"]
        assert [tuple(t) for t in got[i].supporting_trends] == [("", "")] * 5
    assert responses.product_ideas(df, n=2).where("id = 1").select("product_name").collect()[1][0] == "second"
