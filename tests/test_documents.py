import pytest
from pyspark.sql import functions as F

from filingloom.functions import styles, text
from filingloom.operators import exhibits, forms, headings, html_tree, sections, windows
from filingloom.operators.html_tree import blocks, grid, parse, table_type


def docs(spark, *contents):
    return spark.createDataFrame([(f"d{i}", c) for i, c in enumerate(contents)], "ref string, content string")


def test_tree_repairs_markup():
    root = parse("<?xml version='1.0'?><p>one<b>two<p>three<div>four</div><ul><li>a<li>b</ul><table><tr><td>x<td>y<tr><td>z</table>tail<script>if (a<b) '</p>'</script>")
    assert [b[:2] for b in blocks(root)] == [("text", "onetwo"), ("text", "three"), ("text", "four"), ("list", "a\nb"), ("table", "x  y\n-  -\nz"), ("text", "tail")]
    assert [c.text() for c in root.all("td")] == ["x", "y", "z"]
    deep = "<div>" * 5000 + "x" + "</div>" * 5000
    assert [b[1] for b in blocks(parse(deep))] == ["x"]


def test_spans_and_types():
    (table,) = html_tree.tables(parse("<table><tr><th rowspan=2>A</th><th colspan=2>B</th></tr><tr><td>1</td><td>2</td></tr><tr><td>t</td><td>$</td><td>(5)</td></tr></table>"))
    assert grid(table) == [["A", "B", ""], ["", "1", "2"], ["t", "$", "(5)"]]
    assert table_type([["Total assets", "$5"], ["Cash", "7"]]) == "FINANCIAL"
    assert table_type([["Item 1", "3"], ["Item 2", "5"], ["Item 3", "6"], ["Item 4", "9"]]) == "TOC"
    assert table_type([["a", "b"]]) == "GENERAL" and table_type([["Exhibit No.", "x"]]) == "EXHIBIT_INDEX"
    assert [html_tree.amount(t) for t in ("—", "$1,234", "(5.5)", "12%", "x", "", "US$7")] == [0.0, 1234.0, -5.5, 12.0, None, None, 7.0]


def test_figures_over_two_columns():
    head = "<tr><th>a</th><th>b</th></tr>" * 2
    shown = lambda cell: grid(html_tree.tables(parse(f"<table>{head}<tr>{cell}<td>z</td></tr></table>"))[0])[2]
    assert shown("<td colspan=2>1,234</td>") == ["", "1,234", "z"]
    for cell in ("$1,234", "1234", "May 5, 2024", "about 1,234 in all", ""):
        assert shown(f"<td colspan=2>{cell}</td>") == [cell, "", "z"]
    assert grid(html_tree.tables(parse("<table><tr><td colspan=2>1,234</td></tr></table>"))[0]) == [["1,234", ""]]


def test_rows_of_documents(spark):
    page = "<html><body><h2 id='t'>Title</h2><p>Some <b>text</b> <a href='#x'>link</a></p><table><tr><td>Total</td><td>5</td></tr></table></body></html>"
    table = docs(spark, page, None, "")
    nodes = html_tree.nodes(table).collect()
    assert {(n.type, n.text) for n in nodes} >= {("heading", "Title"), ("paragraph", "Some text link"), ("link", "link"), ("table", "Total5")}
    assert next(n for n in nodes if n.type == "heading").anchor == "t" and next(n for n in nodes if n.type == "link").href == "#x"
    cells = html_tree.cells(table)
    assert [(c.row, c.col, c.text, c.value) for c in cells.orderBy("row", "col").collect()] == [(0, 0, "Total", None), (0, 1, "5", 5.0)]
    assert html_tree.total_rows(cells).count() == 1
    assert html_tree.document_tables(table).first().type == "FINANCIAL"
    assert html_tree.document_text(table).first().text.startswith("Title\n\nSome text link")


LINKED = """<html><body><table><tr><td><a href="#i6">Item 6.</a></td><td><a href="#i6">Selected Data</a></td><td>3</td></tr><tr><td><a href="#i7">Item 7.</a></td><td><a href="#i7">Management's Discussion</a></td></tr>
<tr><td><a href="#i7s">Overview</a></td></tr><tr><td><a href="#i8">Item 8.</a></td><td><a href="#i8">Financial Statements</a></td></tr></table>
<div id="i6"><p>Item 6. Selected Data</p><p>six text</p></div><div id="i7"><p>Item 7. Management's Discussion</p></div><p>seven text</p><div id="i7s"><h3>Overview</h3></div><p>sub text</p><div id="i8">Item 8. Financial Statements</div><p>eight text</p></body></html>"""


def test_contents_and_names(spark):
    table = docs(spark, LINKED, "<p>nothing</p>", None)
    found = {r.item: r.text for r in sections.contents_sections(table).collect()}
    assert list(found) == ["6", "7", "8"] and "seven text" in found["7"] and "sub text" in found["7"] and "eight" not in found["7"]
    named = {r.name: r.text for r in sections.extract_sections(table, ["Item 7", "Selected Data", "Overview", "no such part at all"]).collect()}
    assert set(named) == {"Item 7", "Selected Data", "Overview"}
    assert "sub text" in named["Item 7"] and "eight text" not in named["Item 7"] and named["Overview"].endswith("sub text")
    plain = sections.named_sections("<body><p>Alpha beta</p><p>Legal   Proceedings none</p></body>", ["legal proceedings"])
    assert plain == {"legal proceedings": "Legal Proceedings none"}


def test_links_into_other_files(spark):
    main = docs(spark, '<body><a href="other.html#x">Item 9. Controls</a></body>')
    siblings = spark.createDataFrame([("d0", "other.html", "<body><h2>Item 9. Controls</h2><p>found</p></body>")], "ref string, document string, content string")
    assert sections.extract_sections(main, ["Item 9"], siblings).first().text == "Item 9. Controls found"


CHUNKED = "<body><p>{toc}</p><p>PART I</p><p>Item 1. Business</p><p>We do things.</p><p>More things.</p><table><tr><td>a</td><td>1</td></tr></table><p>Item 1A. Risk Factors</p><p>Risks.</p><p>PART II</p><p>ITEM 7. MD&amp;A</p><p>Talk.</p><p>SIGNATURES</p><p>Signed by.</p></body>"


def test_chunks(spark):
    page = CHUNKED.format(toc=" ".join(f"Item {i}" for i in range(1, 14)))
    labelled = windows.chunk_labels(sections.chunks(docs(spark, page))).orderBy("chunk").collect()
    assert labelled[0].toc and labelled[0].item == ""
    found = {r.item: (r.title, r.text) for r in sections.item_sections(docs(spark, page)).collect()}
    assert list(sorted(found)) == ["Item 1", "Item 1a", "Item 7"]
    assert found["Item 1"][0] == "Business" and "More things." in found["Item 1"][1] and "a  1" in found["Item 1"][1]
    assert "Signed" not in found["Item 7"][1]


def test_patterns_and_views(spark):
    page = CHUNKED.format(toc="Contents")
    got = {r.item: r.method for r in sections.sections(docs(spark, page)).collect()}
    assert got == {"1": "pattern", "1A": "pattern", "7": "pattern"}
    table = docs(spark, page, LINKED, "<p>none</p>")
    assert {r.ref: r.text for r in sections.section(table, "mda").collect()}.keys() == {"d0", "d1"}
    assert "Risks." in sections.section(table, "Item 1A").first().text and not sections.section(table, "1A").first().text.rstrip().endswith("PART II")
    with pytest.raises(ValueError, match="unknown"):
        sections.section(table, "nonsense")
    eight = docs(spark, "<p><b>Item 2.02 Results of Operations</b></p><p>Good.</p><p><b>Item 9.01 Exhibits</b></p><p>List.</p>")
    assert sorted(r.item for r in sections.pattern_sections(eight, "8-K").collect()) == ["2.02", "9.01"]
    prospectus = docs(spark, "<p>RISK FACTORS</p><p>x</p><p>USE OF PROCEEDS</p><p>y</p>")
    assert [r.item for r in sections.pattern_sections(prospectus, "424B5").orderBy("place").collect()] == ["Risk Factors", "Use of Proceeds"]
    assert forms.item_title("10-K", "Item 7A").startswith("Quantitative") and forms.item_title("20-F", "16K", "IV") == "Cybersecurity" and forms.item_number("risk_factors") == "1A"
    quarter = docs(spark, "<p>PART I</p><p><b>Item 1. Financial Statements</b></p><p>a</p><p>PART II</p><p><b>Item 1. Legal Proceedings</b></p><p>b</p>")
    assert sorted((r.part, r.item) for r in sections.pattern_sections(quarter, "10-Q").collect()) == [("I", "1"), ("II", "1")]


def test_sections_read_a_document_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = sections.sections(docs(spark, "<p>x</p>"))._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert not any("content" in line for line in plan.splitlines() if "Exchange" in line)


def test_each_document_goes_its_own_way(spark):
    carried = "<p>Item 3. Legal things</p><p>None.</p><p>more</p><p>Item 4. Mine</p><p>deep</p>"
    long = "word " * 60
    short = f'<a href="#a">Item 1. Business</a><a href="#b">Item 7. Talk</a><div id="a"></div><div id="b"></div><p>Item 7. Talk</p><p>{long}</p><p><b>Item 1. Business</b></p><p>found behind {long}</p>'
    got = {}
    for r in sections.sections(docs(spark, CHUNKED.format(toc="Contents"), LINKED, carried.replace("Item 3", "Item 33").replace("Item 4", "Item 44"), short, "<p>none</p>", None)).collect():
        got.setdefault(r.ref, {})[r.item] = (r.method, r.text)
    assert set(got) == {"d0", "d1", "d2", "d3"}
    assert {m for m, _ in got["d0"].values()} == {"pattern"} and {m for m, _ in got["d2"].values()} == {"chunks"}
    assert got["d2"]["33"][1].endswith("None.\nmore")
    # the contents point at nothing for item 1: its heading further down is looked for
    assert got["d3"]["1"][0] == "pattern" and "found behind" in got["d3"]["1"][1] and got["d3"]["7"][0] == "toc"


def test_cross_reference_index(spark):
    page = """<p>front</p><hr style="page-break-after: always"/><p>page two</p><div style="page-break-after:always"></div><p>page three</p><hr style="page-break-after:always">
<p>FORM 10-K CROSS-REFERENCE INDEX</p><table><tr><td>Part I</td></tr><tr><td>Item 1.</td><td>Business</td><td>2</td></tr><tr><td>1A.</td><td>Risk Factors</td><td>2&#8211;3</td></tr><tr><td>4, (a)</td></tr></table>"""
    (one, two) = sections.cross_reference_index(docs(spark, page, "<p>x</p>")).orderBy("place").collect()
    assert (one.item, one.title, one.part) == ("1", "Business", "I") and [tuple(p) for p in two.pages] == [(2, 3)]
    found = {r.item: r.text for r in sections.cross_reference_sections(docs(spark, page)).collect()}
    assert found == {"1": "page two", "1A": "page two\n\npage three"}


def test_annual_information_form(spark):
    page = "<p>" + "front matter " * 500 + "</p><p>see RISK FACTORS</p><h2>CORPORATE STRUCTURE</h2><p>" + "body " * 100 + "</p><h2>RISK FACTORS</h2><p>risky</p>"
    got = sections.aif_sections(docs(spark, page)).orderBy("place").collect()
    assert [r.item for r in got] == ["Corporate Structure", "Risk Factors"] and got[1].text.endswith("risky")


def test_subsidiaries(spark):
    four = "<table><tr><td>Name of Subsidiary</td><td></td><td>% Owned</td><td>Jurisdiction</td></tr><tr><td>U.S. Subsidiaries:</td></tr><tr><td>Alpha LLC (1)</td><td></td><td>100%</td><td>Delaware</td></tr><tr><td>Beta Inc.*</td><td></td><td>51</td><td>Nevada</td></tr></table>"
    two = "<table><tr><td>Gamma GmbH</td><td>Germany</td></tr></table>"
    rows = exhibits.subsidiaries(docs(spark, four + two, None, "<p>none</p>"), html="content").collect()
    assert sorted((r.name, r.jurisdiction, r.ownership) for r in rows) == [("Alpha LLC", "Delaware", 100.0), ("Beta Inc.", "Nevada", 51.0), ("Gamma GmbH", "Germany", None)]


def test_subsidiaries_of_other_layouts(spark):
    header = "<tr><th>Legal name</th><th>State or other jurisdiction</th></tr>"
    tight = "<tr><td>U.S.Subsidiaries:</td><td></td></tr><tr><td>Delta, Inc. (1)(2)</td><td>Ohio</td></tr><tr><td>Epsilon 2001 LLC **</td><td>Texas</td></tr>"
    nested = "<table><tr><td>Zeta SA</td><td>France<table><tr><td>not</td><td>this</td></tr></table></td></tr></table>"
    middle = "<table><tr><td>Eta</td><td>75.5%</td><td></td><td>Peru</td></tr><tr><td>Theta</td><td></td><td></td><td>Chile</td></tr><tr><td>Iota</td><td>101%</td><td></td><td>Cuba</td></tr><tr><td>Kappa</td><td>.5</td><td></td><td>Iran</td></tr></table>"
    third = "<table><tr><td>Lambda</td><td>held by Mu</td><td>Oman</td></tr></table>"
    rows = exhibits.subsidiaries(docs(spark, f"<table>{header}{tight}</table>", nested, middle, third, "<table><tr><td>ALONE</td></tr></table>", ""), html="content").collect()
    assert sorted((r.ref, r.name, r.jurisdiction, r.ownership) for r in rows) == [
        ("d0", "Delta, Inc.", "Ohio", None), ("d0", "Epsilon 2001 LLC", "Texas", None), ("d1", "Zeta SA", "Francenotthis", None),
        ("d2", "Eta", "Peru", 75.5), ("d2", "Iota", "Cuba", None), ("d2", "Kappa", "Iran", 0.5), ("d2", "Theta", "Chile", None), ("d3", "Lambda", "Oman", None),
    ]


def test_paragraphs_close_at_any_depth():
    deep = "<p>one" + "<b>" * 30 + "two<div>three</div>"
    assert [b[:2] for b in blocks(parse(deep))] == [("text", "onetwo"), ("text", "three")]


def test_rendered_tables_show_what_tells():
    lines = [["a" * i if i else "" for i in range(12)] for _ in range(3)]
    assert html_tree.telling_columns(lines) == [3, 4, 5, 6, 7, 8, 9, 10]
    assert html_tree.render_table([["Sales", "$", "5", ")"], ["Costs", "$", "(7", ")"]]) == "Sales   $5)\n-----  ----\nCosts  $(7)"
    assert html_tree.render_table([]) == "" and html_tree.render_table([["", ""], ["-", ""]]) == ""


def test_covers(spark):
    page = "<p>Commission File Number: 001-14948</p><p>For the month of April 2024</p><p>Form 20-F [X] Form 40-F [ ]</p><p>Material Contained in this Report: Press release on results</p><p>SIGNATURES</p>"
    (row, empty) = exhibits.sixk_covers(docs(spark, page, "<p>x</p>")).orderBy("ref").collect()
    assert tuple(row)[1:] == ("001-14948", "April 2024", "20-F", "Press release on results") and tuple(empty)[1:] == (None,) * 4
    agents = docs(spark, "<!-- Created with the Workiva Platform -->", "<!-- dfinsolutions -->", "<p>").select("ref", exhibits.filing_agent(F.col("content")).alias("agent"))
    assert [r.agent for r in agents.orderBy("ref").collect()] == ["Workiva", "Donnelley", None]


def test_windows(spark):
    lines = spark.createDataFrame([("a", i, t) for i, t in enumerate("x n x n y n x".split())], "ref string, at int, line string")
    assert [r.at for r in windows.navigation_lines(lines, by=["ref"], order="at", line="line", least=3, keep=1).orderBy("at").collect()] == [0, 1, 4]
    spans = spark.createDataFrame([("a", i, n) for i, n in enumerate([3, 4, 5, 9, 2, 3])], "ref string, at int, n int")
    assert [r.at for r in windows.page_runs(spans, by=["ref"], order="at", number="n").orderBy("at").collect()] == [0, 1, 2, 4, 5]
    votes = spark.createDataFrame([("a", 1, 0.8, 0.3), ("a", 2, 0.9, 0.4), ("a", 1, 0.5, 0.2)], "ref string, level int, confidence double, weight double")
    (vote,) = windows.vote(votes, by=["ref"]).collect()
    assert vote.level == 2 and vote.confidence == pytest.approx((0.24 + 0.36 + 0.1) / 0.9)
    marks = spark.createDataFrame([("a", 5, 100), ("a", 20, 100)], "ref string, offset int, length int")
    assert [r.stop for r in windows.ends_before_next(marks, by="ref").orderBy("offset").collect()] == [20, 100]


def test_headings(spark):
    page = "<body><h2>Overview</h2><p style='font-weight:bold;text-align:center'>Item 1A. Risk Factors</p><p>" + "long text " * 30 + ".</p><p>an ordinary sentence, in lower case, that ends.</p></body>"
    got = {r.text: r for r in headings.headings(docs(spark, page)).collect()}
    assert set(got) == {"Overview", "Item 1A. Risk Factors"} and got["Item 1A. Risk Factors"].level == 1 and got["Overview"].method == "combined"
    rows = spark.createDataFrame([("a", 0, 100, 1.0), ("a", 80, 200, 1.0), ("a", 500_000, 500_100, 1.0)], "ref string, start long, stop long, confidence double")
    assert [tuple(r)[1:] for r in headings.without_overlap(rows).orderBy("start").collect()] == [(0, 90, 0.9), (90, 200, 0.9), (500_000, 500_100, 0.9)]


def test_styles_and_clean_up(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(styles.declarations(F.lit("Color: RED; margin:1px;color:blue"))) == {"margin": "1px", "color": "blue"}
    assert [one(styles.pixels(F.lit(v))) for v in ("12pt", "1.5em", "0", "50%", "auto", "-2px")] == [pytest.approx(15.996), 24.0, 0.0, None, None, -2.0]
    assert tuple(one(styles.box(F.lit("1px 2px 3px")))) == (1.0, 2.0, 3.0, 2.0)
    assert one(styles.colour(F.lit("#AbC"))) == "#aabbcc" and one(styles.weight(F.lit("bold"))) == 700
    assert one(styles.merged(styles.declarations(F.lit("a:1;b:2")), styles.declarations(F.lit("b:3")))) == {"a": "1", "b": "3"}
    assert one(text.without_page_marks(F.lit("a\n12\nPART II\nItem 7\nb\n13\nTable of Contents\n"))) == "a\n\nb"
    assert one(text.without_page_marks(F.lit("a\nItem 8.\n"))) == "a" and one(text.without_page_marks(F.lit("a\n 44 "))) == "a"
    assert one(text.shortened(F.lit("One two. Three four five"), 10)) == "One two..." and one(text.shortened(F.lit("abcdefgh. ijkl"), 10)) == "abcdefgh."
    assert one(text.punctuated(F.lit("a—b ,c;d end.Next 5.Then 7%more"))) == "a - b, c; d end. Next 5. Then 7% more"
    assert one(text.preprocessed(F.lit("<?xml version='1.0'?><ix:hidden>x</ix:hidden>a&nbsp;<!-- c -->b\x01<script>s</script>"))) == "a b"


def test_decimal_items(spark):
    page = "<p>Item 2.02 Results</p><p>Good.</p><p>Item 9.01. Exhibits</p><p>List.</p>"
    assert sorted(r.item for r in sections.item_sections(docs(spark, page), item_label=windows.DECIMAL_LABEL).collect()) == ["Item 2.02", "Item 9.01"]
