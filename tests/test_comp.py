"""Pay: annualising, prose bands, HTML to text, band text."""

import pytest
from pyspark.sql import functions as F

from tests.conftest import one


@pytest.mark.parametrize("value,interval,expected,scaled", [
    (150000.0, "1 YEAR", 150000, False),
    (10000.0, "1 MONTH", 120000, True),
    (2000.0, "1 WEEK", 104000, True),
    (500.0, "1 DAY", 130000, True),
    (60.0, "1 HOUR", 124800, True),
    (60.0, " 1 hour ", 124800, True),
    (123456.0, "per-decade", 123456, False),
    (2.5, None, 2, False),          # half-even: 2.5 -> 2
    (3.5, "1 YEAR", 4, False),      # half-even: 3.5 -> 4
])
def test_annualize(spark, value, interval, expected, scaled):
    from hirefold.functions.comp import annualize
    r = one(spark, annualize(F.col("v"), F.col("i")), v=value, i=interval)
    assert (r["value"], r["scaled"]) == (expected, scaled)


@pytest.mark.parametrize("text,expected", [
    ("The base salary range is $150,000 - $190,000 per year.", (150000, 190000, "USD", [])),
    ("Compensation: $185k to $220k.", (185000, 220000, "USD", [])),
    ("We pay $62.50 per hour for this role.", (130000, 130000, "USD",
                                               ["comp-hourly-annualized", "comp-single-value"])),
    ("OTE is $240,000 with a 50/50 split.", (240000, 240000, "USD", ["comp-ote", "comp-single-value"])),
    ("A $10,000 signing bonus. Salary range: $140,000 to $160,000 CAD.", (140000, 160000, "CAD", [])),
    ("Annual stipend of $500 and a $1,200 laptop budget.", (1200, 1200, "USD", ["comp-single-value"])),
    ("A $5,000 relocation bonus is available.", None),
    ("$145K - $210K", None),
    # "ote" is a plain substring: it fires inside "remote" too.
    ("This remote role pays $150,000 to $180,000.", (150000, 180000, "USD", ["comp-ote"])),
    ("First line has no money\nSecond: salary $90k", (90000, 90000, "USD", ["comp-single-value"])),
    ("", None),
])
def test_parse_salary_prose(spark, text, expected):
    from hirefold.functions.comp import parse_salary_prose
    r = one(spark, parse_salary_prose(F.col("t")), t=text)
    if expected is None:
        assert r is None
    else:
        assert (r["min"], r["max"], r["currency"], list(r["flags"])) == expected


@pytest.mark.parametrize("raw,expected", [
    ("&lt;p&gt;Hello&amp;nbsp;world&lt;/p&gt;", "Hello world"),
    ("<div>One</div>\n<div>Two &amp; three</div>", "One \n Two & three"),
    ("plain\t\ttext   here", "plain text here"),
    ("", None),
    (None, None),
])
def test_html_to_text(spark, raw, expected):
    from hirefold.functions.comp import html_to_text
    assert one(spark, html_to_text(F.col("h")), h=raw) == expected


def test_band_text(spark):
    from hirefold.functions.comp import band_text, comp_struct
    def band(lo, hi, cur, src):
        return one(spark, band_text(comp_struct(F.lit(lo).cast("bigint"), F.lit(hi).cast("bigint"),
                                                F.lit(cur).cast("string"), F.lit(src))), x=1)
    assert band(150000, 190000, "USD", "structured") == "$150,000 to $190,000"
    assert band(150000, None, "USD", "parsed") == "from $150,000"
    assert band(None, 90000, "EUR", "parsed") == "up to EUR 90,000"
    assert band(None, None, None, "none") == "not published"
    assert band(150000, 190000, "USD", "none") == "not published"


def test_html_to_text_many_keeps_items_apart(spark):
    from hirefold.functions.comp import html_to_text_many
    df = spark.createDataFrame([(["<b>one", "two</b> &amp; three", "", None, "<p></p>", "four&nbsp;",
                                  "a < b", "c > d"],)], "a array<string>")
    got = df.select(html_to_text_many(F.col("a"))).first()[0]
    # each item on its own: an unclosed "<" never pairs with a later item's ">"
    assert list(got) == ["one", "two & three", "four", "a < b", "c > d"]
