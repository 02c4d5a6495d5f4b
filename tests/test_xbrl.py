import re
import time

import pytest

from filingloom.operators import classify, linkbase, standardize, warehouse, xbrl
from filingloom.schemas import FACT_COLUMNS, FILING
from filingloom.sources import facts_json

INLINE = """<html><xbrli:context id="c1"><xbrli:period><xbrli:instant>2024-01-31</xbrli:instant></xbrli:period></xbrli:context>
<xbrli:context id="c2"><xbrli:entity><xbrli:segment><xbrldi:explicitMember dimension="us-gaap:B">us-gaap:M</xbrldi:explicitMember>
<xbrldi:explicitMember dimension="us-gaap:A"> us-gaap:N </xbrldi:explicitMember><xbrldi:typedMember dimension="x:T"><x:t>1</x:t></xbrldi:typedMember></xbrli:segment></xbrli:entity>
<xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate><xbrli:endDate>2024-03-31</xbrli:endDate></xbrli:period></xbrli:context>
<xbrli:context id="bad"><xbrli:period><xbrli:startDate>2024-01-01</xbrli:startDate></xbrli:period></xbrli:context>
<xbrli:unit id="u"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="v"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator>
<xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>
<ix:nonFraction name="us-gaap:Assets" contextRef="c1" unitRef="u" scale="6" decimals="-6">1,234</ix:nonFraction>
<ix:nonFraction name="us-gaap:Assets" contextRef="c1" unitRef="u" scale="6">999</ix:nonFraction>
<ix:nonFraction name="us-gaap:EPS" contextRef="c2" unitRef="v" decimals="2" sign="-">(0.12)</ix:nonFraction>
<ix:nonFraction name="us-gaap:Dash" contextRef="c2" unitRef="u" format="ixt:fixed-zero">&#8212;</ix:nonFraction>
<ix:nonFraction name="us-gaap:Nil" contextRef="c2" unitRef="u">&#8212;</ix:nonFraction>
<ix:nonFraction name="us-gaap:NoContext" contextRef="none" unitRef="u">1</ix:nonFraction>
<ix:nonFraction name="us-gaap:NoEnd" contextRef="bad" unitRef="u">1</ix:nonFraction>
<ix:nonFraction name="us-gaap:NoUnit" contextRef="c1" unitRef="zz"><span>5</span></ix:nonFraction></html>"""
CLASSIC = """<xbrl><context id="i"><period><instant>2020-12-31</instant></period></context><unit id="U"><measure>iso4217:EUR</measure></unit>
<ifrs-full:Assets contextRef="i" unitRef="U" decimals="0">-15</ifrs-full:Assets><ifrs-full:Name contextRef="i">text</ifrs-full:Name><xbrli:x contextRef="i" unitRef="U">3</xbrli:x>
<ifrs-full:Note contextRef="i" unitRef="U"><p>4</p></ifrs-full:Note></xbrl>"""


def filing(spark, *rows):
    return spark.createDataFrame([("sec", "cik", "0000000001", ref, f"{ref}.htm", f"http://x/{ref}.htm", kind, content) for ref, kind, content in rows], FILING)


def test_facts(spark):
    rows = xbrl.facts(filing(spark, ("a", "ixbrl", INLINE), ("b", "xbrl", CLASSIC), ("c", "ixbrl", None), ("d", "ixbrl", "")), standardizer={"us-gaap:Assets": "Total"})
    assert rows.columns == FACT_COLUMNS
    got = {(r.accession, r.concept): r for r in rows.collect()}
    assert set(got) == {("a", "us-gaap:Assets"), ("a", "us-gaap:EPS"), ("a", "us-gaap:Dash"), ("a", "us-gaap:NoUnit"), ("b", "ifrs-full:Assets")}
    assets, eps = got[("a", "us-gaap:Assets")], got[("a", "us-gaap:EPS")]
    assert (assets.value, assets.unit, assets.decimals, assets.is_instant, assets.standard_concept, assets.dimensions) == (1.234e9, "USD", -6, True, "Total", "{}")
    assert (eps.value, eps.unit, str(eps.period_start), str(eps.period_end), eps.dimensions) == (-0.12, "USD/shares", "2024-01-01", "2024-03-31", '{"us-gaap:A":"us-gaap:N","us-gaap:B":"us-gaap:M"}')
    assert got[("a", "us-gaap:Dash")].value == 0 and got[("a", "us-gaap:NoUnit")].unit == ""
    assert (got[("b", "ifrs-full:Assets")].value, got[("b", "ifrs-full:Assets")].unit) == (-15.0, "EUR")


def test_extraction_needs_no_shuffle_of_content(spark):
    plan = xbrl.facts(filing(spark, ("a", "ixbrl", INLINE)))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    exchanged = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanged and not any("content" in line for line in exchanged)


def test_duplicate_context_ids_keep_the_last(spark):
    twice = '<context id="i"><instant>2020-12-31</instant></context><context id="i"><instant>2021-12-31</instant></context><unit id="U"><measure>x:EUR</measure></unit><a:B contextRef="i" unitRef="U">1</a:B>'
    assert str(xbrl.facts(filing(spark, ("a", "xbrl", twice))).first().period_end) == "2021-12-31"


def test_repeated_ids_cost_no_more(spark):
    many = 10_000
    instance = "".join(f'<context id="c{i}"><instant>2020-12-31</instant></context>' for i in range(many))
    again = '<context id="c7"><instant>2021-12-31</instant></context>'
    facts = "".join(f'<a:B{i} contextRef="c{i}" unitRef="U">{i}</a:B{i}>' for i in range(many))
    unit = '<unit id="U"><measure>x:EUR</measure></unit>'
    table = lambda text: filing(spark, ("a", "xbrl", unit + text + facts))
    took = []
    for text in (instance, instance, instance + again):
        began = time.time()
        rows = xbrl.facts(table(text)).groupBy("period_end").count().collect()
        took.append(time.time() - began)
    assert {str(r.period_end): r["count"] for r in rows} == {"2020-12-31": many - 1, "2021-12-31": 1}
    assert took[2] < 3 * took[1] + 5


def test_richer(spark):
    inline = xbrl.facts(filing(spark, ("a", "ixbrl", INLINE), ("b", "ixbrl", "<p/>")))
    instance = xbrl.facts(filing(spark, ("a", "xbrl", CLASSIC), ("b", "xbrl", CLASSIC)))
    assert {r.accession: r["count"] for r in xbrl.richer(inline, instance).groupBy("accession").count().collect()} == {"a": 4, "b": 1}


ROLES = [
    ("http://x/role/ConsolidatedBalanceSheets", [], "", False, "BalanceSheet"),
    ("http://x/role/BalanceSheetsParenthetical", [], "", False, ""),
    ("http://x/role/BalanceSheetsParenthetical", [], "", True, "BalanceSheet"),
    ("ConsolidatedStatementsOfComprehensiveIncomeStatements", [], "", False, "ComprehensiveIncome"),
    ("StatementsOfOperationsAndComprehensiveIncome", [], "", False, "IncomeStatement"),
    ("http://x/role/R2", ["us-gaap:StatementOfFinancialPositionAbstract", "us-gaap:Cash"], "", False, "BalanceSheet"),
    ("http://x/role/StockholdersEquity", ["us-gaap:XTextBlock"], "", False, ""),
    ("Income Statements", [], "disclosure", False, ""),
    ("Income Statements", [], "statement", False, "IncomeStatement"),
    ("http://x/role/Opaque", ["us-gaap:InvestmentOwnedAtFairValue", "us-gaap:InvestmentOwnedAtCost", "us-gaap:InvestmentOwnedBalanceShares"], "", False, "ScheduleOfInvestments"),
    ("uk", ["uk-core:Equity", "uk-core:NetAssetsLiabilities", "uk-core:ShareholderFunds"], "", False, "BalanceSheet"),
]


@pytest.mark.parametrize(("role", "concepts", "category", "relaxed", "want"), ROLES)
def test_roles(spark, role, concepts, category, relaxed, want):
    row = spark.createDataFrame([(role, concepts, category)], "role string, concepts array<string>, category string")
    assert row.select(classify.classify(row.role, row.concepts, row.category, relaxed).alias("x")).first().x == want


PRE = """<link:presentationLink xlink:role="http://x/role/IncomeStatements"><link:loc xlink:href="a.xsd#us-gaap_NetIncomeLoss" xlink:label="n"/><link:loc xlink:href="a.xsd#us-gaap_Costs" xlink:label="c"/>
<link:presentationArc xlink:from="r" xlink:to="c" preferredLabel="http://www.xbrl.org/2009/role/negatedTerseLabel"/><link:presentationArc xlink:from="r" xlink:to="n"/></link:presentationLink>
<link:presentationLink xlink:role="http://x/role/StatementsOfCashFlows"><link:loc xlink:href="a.xsd#us-gaap_NetIncomeLoss" xlink:label="n"/><link:presentationArc xlink:to="n" preferredLabel="x/negatedLabel"/></link:presentationLink>
<link:presentationLink xlink:role="http://x/role/StockholdersEquityDetails"><link:loc xlink:href="a.xsd#us-gaap_Note" xlink:label="t"/></link:presentationLink>"""
LAB = """<link:loc xlink:href="a.xsd#us-gaap_X" xlink:label="lx"/><link:loc xlink:href="a.xsd#us-gaap_Y" xlink:label="ly"/>
<link:labelArc xlink:from="lx" xlink:to="rx"/><link:labelArc xlink:from="ly" xlink:to="ry"/><link:labelArc xlink:from="gone" xlink:to="rz"/>
<link:label xlink:label="rx" xlink:role="http://www.xbrl.org/2003/role/terseLabel">Short</link:label><link:label xlink:label="rx" xlink:role="http://www.xbrl.org/2003/role/label">Net &amp; sales</link:label>
<link:label xlink:label="ry" xlink:role="http://www.xbrl.org/2003/role/documentation">long</link:label><link:label xlink:label="ry" xlink:role="http://www.xbrl.org/2003/role/verboseLabel">Verbose</link:label>"""
CAL = """<link:calculationLink xlink:role="http://x/role/StatementsOfIncome"><link:loc xlink:href="a#us-gaap_P" xlink:label="p"/><link:loc xlink:href="a#us-gaap_C" xlink:label="c"/>
<link:calculationArc xlink:from="p" xlink:to="c" weight="-1.0"/><link:calculationArc xlink:from="p" xlink:to="c"/><link:calculationArc xlink:from="p" xlink:to="none"/></link:calculationLink>"""


def test_linkbases(spark):
    books = spark.createDataFrame([("a", "pre", PRE), ("a", "lab", LAB), ("a", "cal", CAL), ("b", "pre", ""), ("b", "lab", None)], "ref string, suffix string, xml string")
    assert {r.concept: r.statements for r in linkbase.statement_rows(books).collect()} == {"us-gaap:NetIncomeLoss": ["IncomeStatement", "CashFlow"], "us-gaap:Costs": ["IncomeStatement"]}
    assert [r.concept for r in linkbase.negation_rows(books).collect()] == ["us-gaap:Costs"]
    assert {r.concept: r.label for r in linkbase.label_rows(books).collect()} == {"us-gaap:X": "Net sales", "us-gaap:Y": "Verbose"}
    standard = spark.createDataFrame([("a", "us-gaap:X", "other"), ("a", "us-gaap:Z", "Zed")], "ref string, concept string, label string")
    assert {r.concept: r.label for r in linkbase.label_rows(books, standard).collect()}["us-gaap:Z"] == "Zed"
    assert sorted((r.statement, r.parent, r.child, r.weight) for r in linkbase.calculation_rows(books).collect()) == [("IncomeStatement", "us-gaap:P", "us-gaap:C", -1.0), ("IncomeStatement", "us-gaap:P", "us-gaap:C", 1.0)]
    two = filing(spark, ("a", "ixbrl", INLINE), ("b", "ixbrl", INLINE))
    mapped = linkbase.statement_map(two, books)
    assert {r.ref: r.n for r in mapped.groupBy("ref").agg({"concept": "count"}).withColumnRenamed("count(concept)", "n").collect()}["b"] == len(classify.anchors())
    rows = xbrl.facts(two, statements=mapped)
    assert {(r.accession, r.statement) for r in rows.where("concept = 'us-gaap:Assets'").collect()} == {("a", ""), ("b", "BalanceSheet")}


def test_notes_and_reports(spark):
    books = spark.createDataFrame([("a", "pre", PRE.replace("us-gaap_Note", "us-gaap_Assets"))], "ref string, suffix string, xml string")
    rows = linkbase.from_notes(xbrl.facts(filing(spark, ("a", "ixbrl", INLINE))), books, "Equity").collect()
    assert [(r.concept, r.statement, r.source_selector) for r in rows] == [("us-gaap:Assets", "Equity", "reconstructed:StockholdersEquityDetails")]
    summary = "<Report><HtmlFileName>R2.htm</HtmlFileName><LongName>0002 - Statement - BALANCE SHEETS</LongName><Role>http://x/role/BalanceSheets</Role></Report><Report><HtmlFileName>R9.htm</HtmlFileName><LongName>9 - Disclosure - Income</LongName><ShortName>Income Statements</ShortName></Report>"
    summaries = spark.createDataFrame([("a", summary)], "ref string, xml string")
    assert [(r.statement, r.file) for r in linkbase.summary_reports(summaries).collect()] == [("BalanceSheet", "R2.htm")]
    pages = spark.createDataFrame([("a", "R2.htm", 'x("defref_us-gaap_Assets") defref_us-gaap_Assets defref_x_Y'), ("a", "R9.htm", "defref_us-gaap_Z")], "ref string, file string, html string")
    assert {r.concept: r.statements for r in linkbase.report_statements(summaries, pages).collect()} == {"us-gaap:Assets": ["BalanceSheet"], "x:Y": ["BalanceSheet"]}


def test_select_statement(spark):
    rows = spark.createDataFrame([("d", "IncomeStatement", "x"), ("d", "Equity", "y"), ("f", "ComprehensiveIncome", "us-gaap:ProfitLoss"), ("g", "ComprehensiveIncome", "oci"), ("g", "Equity", "us-gaap:Revenues"), ("h", "ComprehensiveIncome", "oci")], "accession string, statement string, concept string")
    assert sorted((r.accession, r.concept) for r in classify.select_statement(rows, "IncomeStatement").collect()) == [("d", "x"), ("f", "us-gaap:ProfitLoss"), ("g", "us-gaap:Revenues")]


def test_standardizers(spark, tmp_path):
    rows = spark.createDataFrame([("us-gaap:Revenues",), ("x:y",)], "concept string")
    assert [r.standard_concept for r in standardize.standardized(rows, lambda c: "R" if "Rev" in c else None).orderBy("concept").collect()] == ["R", None]
    assert standardize.standardized(rows, None).where("standard_concept is null").count() == 2
    (tmp_path / "map.json").write_text('{"_comment_x": "no", "Revenue": ["us-gaap_Revenues", "us-gaap_SalesRevenueNet"], "Other": "text"}')
    mapping = standardize.mapping_of(spark, str(tmp_path / "map.json"))
    assert {r.concept: r.standard_concept for r in mapping.collect()} == {"us-gaap:Revenues": "Revenue", "us-gaap:SalesRevenueNet": "Revenue"}
    assert standardize.standardized(rows, mapping).where("standard_concept = 'Revenue'").count() == 1


def test_warehouse(spark, tmp_path):
    store = warehouse.Warehouse(spark, f"file://{tmp_path}/store")
    filings = filing(spark, ("a", "ixbrl", INLINE))
    assert store.archive(filings) == {"filings": 1, "documents": 1, "facts": 4}
    assert store.archive(filings) == {"filings": 1, "documents": 0, "facts": 0}
    assert store.table("facts").count() == 4 and store.table("extractions").count() == 1
    again = facts_json.read_facts(store.table("extractions").withColumnRenamed("facts_json", "json"))
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, xbrl.facts(filings).collect()), key=str)
    view = warehouse.statement_view(store.table("facts"), consolidated=False)
    assert view.columns == ["concept", "label", "dimensions", "2024-03-31", "2024-01-31"]
    assert [r["2024-01-31"] for r in view.where("concept = 'us-gaap:Assets'").collect()] == [1.234e9]
    assert warehouse.statement_view(store.table("facts"), accession="none").count() == 0
    three = warehouse.statement_view(store.table("facts"), months=3, consolidated=False)
    assert three.count() == 4 and warehouse.statement_view(store.table("facts"), months=9).count() == 2
    with pytest.raises(ValueError, match="concept"):
        warehouse.statement_view(store.table("facts"), by="x")


def test_picks(spark):
    pick = '{"version":1,"provenance":{"cik":"1","accession":"a","url":"u"},"selector":"#t","kind":"table","text":"x","table":{"header":["","Item","$"],"rows":[["","",""],["","A|b","$"," 1 "]]},"facts":[{"concept":"c","value":"1,234","scale":3,"sign":"-","contextRef":"x","unitRef":"u","periodEnd":"2024-01-31","isInstant":true,"decimals":"INF"},{"concept":"c","value":"9","contextRef":"x","unitRef":"u","periodEnd":"2024-01-31"}]}'
    picks = facts_json.read_picks(spark.createDataFrame([(pick,)], "json string"))
    (fact,) = facts_json.pick_facts(picks).collect()
    assert (fact.value, fact.decimals, fact.dimensions, fact.source_selector) == (-1234000.0, None, "{}", "#t")
    assert facts_json.pick_markdown(picks, provenance=False).first().markdown == "| Item |  |\n| --- | --- |\n| A\\|b | 1 |"
    assert facts_json.pick_markdown(picks).first().markdown.startswith("> Source: CIK 1, accession a (table)\n> URL: u\n")
    with pytest.raises(Exception, match="unsupported selection payload version 2"):
        facts_json.read_picks(spark.createDataFrame([(pick.replace('"version":1', '"version":2'),)], "json string")).collect()


def test_each_document_is_read_and_indexed_once(spark):
    """No projection is merged into a lambda that runs for each part of an index, and no pattern is searched twice."""
    plan = xbrl.raw_facts(filing(spark, ("a", "ixbrl", "")), ["ref"])._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"map_from_entries\((?:transform\()?filter\((?:transform|zip_with)\(", plan)
    assert plan.count("explicitMember\\b[^>]*") == 1


@pytest.mark.parametrize("n", [1, 8, 9, 700])
def test_every_context_is_found(spark, n):
    """Facts of n contexts, each written twice with the last one counting, as a plain tag and as tags that only the full pattern reads."""
    context = '<context id="c{0}"><period><instant>20{1}-01-01</instant></period><segment><explicitMember dimension="b:Y">y{0}</explicitMember><explicitMember dimension="a:X"> x{0} </explicitMember></segment></context>'
    tags = ['<ix:nonFraction name="t:A" name="t:Z" contextRef="c{0}" scale="1">{0}</ix:nonFraction>', '<ix:nonFraction name = "t:B" title="contextRef=" contextRef="c{0}">(<b>{0}</b>)</IX:nonFraction>', "<ix:nonFraction name=\"t:C\" x='1' contextRef=\"c{0}\">{0}</ix:nonFraction>"]
    body = "".join(context.format(i, year) for year in (19, 20) for i in range(n)) + "".join(t.format(i) for i in range(n) for t in tags)
    rows = xbrl.facts(filing(spark, ("a", "ixbrl", body))).collect()
    assert sorted((r.concept, r.context_ref, r.value) for r in rows) == sorted((c, f"c{i}", v) for i in range(n) for c, v in (("t:A", i * 10.0), ("t:B", -float(i)), ("t:C", float(i))))
    assert all(str(r.period_end) == "2020-01-01" and r.dimensions == '{"a:X":"x%s","b:Y":"y%s"}' % ((r.context_ref[1:],) * 2) for r in rows)
