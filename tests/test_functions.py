import pytest
from pyspark.sql import functions as F

from filingloom.functions import names, numbers, text


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("shown", "sign", "want"),
    [("1,234", "", 1234.0), ("(5)", "", -5.0), ("-5", "-", 5.0), ("-5", "", -5.0), ("5", "-", -5.0), ("&#8212;", "", None), ("", "", None), ("<b>7</b>&#160;", "", 7.0), ("1.2.3", "", None), ("(1,234.50)", "-", -1234.5)],
)
def test_numbers(spark, shown, sign, want):
    assert one(spark, numbers.parsed_number(F.lit(shown), F.lit(sign))) == want


@pytest.mark.parametrize(("words", "want"), [("No", 0), ("Forty-two", 42), ("one million two hundred thousand", 1200000), ("nineteen hundred and four", 1904), ("not a number", None), ("hundred", 100), ("", None)])
def test_number_words(spark, words, want):
    assert one(spark, numbers.number_from_words(F.lit(words))) == want


@pytest.mark.parametrize(
    ("form", "raw", "want"),
    [("ixt:fixed-zero", "&#8212;", "0"), ("ixt:num-comma-decimal", "0,12", "0.12"), ("ixt:num-comma-decimal", "1.234.567,89", "1234567.89"), ("ixt-sec:numwordsen", "Forty-two", "42"), ("ixt-sec:numwordsen", "apples", ""), ("", "raw", "raw"), ("ixt:numcommadecimal", "(1.234,56)", "(1234.56)")],
)
def test_displayed(spark, form, raw, want):
    assert one(spark, numbers.displayed(F.lit(form), F.lit(raw))) == want


def test_small_numbers(spark):
    assert one(spark, numbers.decimals(F.lit("INF"))) is None and one(spark, numbers.decimals(F.lit("-6"))) == -6
    assert one(spark, numbers.cell_number(F.lit("(1,234)"))) == -1234 and one(spark, numbers.cell_number(F.lit("N/A"))) == 0 and one(spark, numbers.cell_number(F.lit("x"))) is None
    assert one(spark, numbers.percent(F.lit("51%"))) == 51 and one(spark, numbers.percent(F.lit("101"))) is None
    assert one(spark, numbers.months(F.to_date(F.lit("2024-01-01")), F.to_date(F.lit("2024-04-01")))) == 3
    assert one(spark, numbers.looks_financial(F.lit("$ 5"))) and not one(spark, numbers.looks_financial(F.lit("a5")))


def test_names(spark):
    for given in ("320193", "  320193 "):
        assert one(spark, names.cik(F.lit(given))) == "0000320193"
    for bad in ("", "32a193", "123456789012"):
        with pytest.raises(Exception, match="filer number"):
            one(spark, names.cik(F.lit(bad)))
    assert [tuple(r) for r in one(spark, names.page_ranges(F.lit("4-7, 9-11, (a), 25")))] == [(4, 7), (9, 11), (25, 25)]
    assert one(spark, names.page_ranges(F.lit("Not applicable"))) == []
    assert one(spark, names.concept_of_href(F.lit("x.xsd#us-gaap_Net_Income"))) == "us-gaap:Net_Income"
    assert one(spark, names.concept_of_reference(F.lit("defref_us-gaap_Assets"))) == "us-gaap:Assets"
    assert one(spark, names.role_key(F.lit("http://x/role/Statement-Of Profit"))) == "statementofprofit"
    assert one(spark, names.entity_name(F.lit("Apple Inc.  (AAPL)  (CIK 0000320193)"))) == "Apple Inc."
    assert one(spark, names.entity_name(F.lit("Plain Name"))) == "Plain Name"
    assert one(spark, names.report_category(F.lit("0002 - Statement - BALANCE SHEETS"))) == "statement"
    assert one(spark, names.roman(F.lit("xiv"))) == 14 and one(spark, names.roman(F.lit("q"))) is None
    assert one(spark, names.bulk_entry(F.lit("Prod223_4245_99999999_20251231.html"))["number"]) == "99999999"
    assert one(spark, names.item_order(F.lit("II"), F.lit("7A"))) == 200701 and one(spark, names.item_order(F.lit(None).cast("string"), F.lit("1"))) == 100
    assert one(spark, names.section_title(F.lit("Item 1A. Risk Factors\nmore"))) == "Risk Factors"
    assert one(spark, names.selection_slug(F.lit("a-1"), F.lit("div#x > p"), F.lit("table"))) == "a-1_div-x-p"
    day = lambda d: F.to_date(F.lit(d))
    assert one(spark, names.frame_of(day("2022-01-01"), day("2022-12-31"), F.lit(False))) == "CY2022"
    assert one(spark, names.frame_of(F.lit(None).cast("date"), day("2022-09-30"), F.lit(True))) == "CY2022Q3I"


def test_text(spark):
    page = '<html><BODY class="x"><script>var a="</p>";</script><p>A&nbsp;&amp; B &#233;<br>next</p><div> </div><ul><li>one<li>two</ul></body></html>'
    assert one(spark, text.paragraphs(F.lit(page))) == ["A & B é", "next", "one", "two"]
    assert one(spark, text.html_to_text(F.lit("<body><p>a&amp;b</p><style>x</style> c</body>tail"))) == "a&amp;b c"
    assert one(spark, text.clean_text(F.lit("x &amp;lt; &#39;y&#39;&mdash;z"))) == "x &lt; 'y'—z"
    assert one(spark, text.similarity(F.lit(" Kitten"), F.lit("sitting"))) == pytest.approx(1 - 3 / 7)
    assert one(spark, text.similarity(F.lit(""), F.lit(" "))) == 1.0
    docs = spark.createDataFrame([(1, page), (2, "<p>nothing</p>")], "id int, html string")
    assert [tuple(r) for r in text.find_paragraphs(docs, "NEXT", keep=["id"], html_col="html").collect()] == [(1, 2, "next")]
    assert text.find_paragraphs(docs, "NEXT", keep=["id"], html_col="html", ignore_case=False).count() == 0
