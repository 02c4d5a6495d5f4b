"""Filings rendered from ordinary tables, for queries and tests.

The supplied tables hold no filings.  Rendering a table as XBRL or HTML,
reading it back with the engine and comparing with the table itself tests the
readers against an oracle that never parses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def join_lines(lines: Column) -> Column:
    return F.array_join(F.sort_array(lines), "\n")


UNITS = '<xbrli:unit id="usd"><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unit><xbrli:unit id="eps"><xbrli:divide><xbrli:unitNumerator><xbrli:measure>iso4217:USD</xbrli:measure></xbrli:unitNumerator><xbrli:unitDenominator><xbrli:measure>xbrli:shares</xbrli:measure></xbrli:unitDenominator></xbrli:divide></xbrli:unit>'


def instant(id_: Column, day: Column, dimensions: Column | str = "") -> Column:
    return text('<xbrli:context id="', id_, '"><xbrli:entity><xbrli:identifier scheme="http://www.sec.gov/CIK">1</xbrli:identifier>', dimensions, "</xbrli:entity><xbrli:period><xbrli:instant>", day, "</xbrli:instant></xbrli:period></xbrli:context>")


def duration(id_: Column, start: Column, end: Column) -> Column:
    return text('<xbrli:context id="', id_, '"><xbrli:entity/><xbrli:period><xbrli:startDate>', start, "</xbrli:startDate><xbrli:endDate>", end, "</xbrli:endDate></xbrli:period></xbrli:context>")


def filings(rows: DataFrame, kind: str = "ixbrl") -> DataFrame:
    """Rows (ref, lines) as filings of one document each."""
    content = text("<html><body>", UNITS, join_lines(F.col("lines")), "</body></html>")
    return rows.select(
        F.lit("sec").alias("system"), F.lit("cik").alias("entity_scheme"), F.lpad("ref", 10, "0").alias("entity_value"), F.col("ref").cast("string").alias("ref"),
        text(F.col("ref").cast("string"), ".htm").alias("document"), text("file:///", F.col("ref").cast("string"), ".htm").alias("url"), F.lit(kind).alias("kind"), content.alias("content"),
    )


def day(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


def cents(col: Column) -> Column:
    """A price in whole cents, with thousands commas."""
    return F.regexp_replace(F.format_number(F.round(col * 100), 0), "^$", "0")


LINE_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]


def line_key() -> Column:
    """The columns that tell line items apart."""
    return F.concat_ws("-", *LINE_KEY)


def per_order(lines: DataFrame, line: Column, columns: list[str]) -> DataFrame:
    """(ref, lines): the distinct rendered lines of each order; only the ``columns`` that ``line`` reads are dealt out, not the text."""
    dealt = lines.select(F.col("l_orderkey").cast("string").alias("ref"), *columns).repartition("ref")
    return dealt.select("ref", line.alias("line")).groupBy("ref").agg(F.collect_set("line").alias("lines"))


def inline_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One inline document per order: the prices of its line items, in cents with scale -2, at their ship days."""
    lines = table(spark, sf_dir, "lineitem")
    context = text("c", F.date_format("l_shipdate", "yyyyMMdd"))
    fact = text('<ix:nonFraction name="tpch:Price', line_key(), '" contextRef="', context, '" unitRef="usd" scale="-2" decimals="2">', cents(F.col("l_extendedprice")), "</ix:nonFraction>")
    line = F.concat(instant(context, day(F.col("l_shipdate"))), fact)
    return filings(per_order(lines, line, [*LINE_KEY, "l_shipdate", "l_extendedprice"]))


def classic_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One classic instance per customer: order totals with the sign in the text, over the order's month."""
    orders = table(spark, sf_dir, "orders")
    id_ = F.col("o_orderkey").cast("string")
    start = day(F.trunc("o_orderdate", "month"))
    context = duration(text("d", id_), start, day(F.last_day("o_orderdate")))
    value = F.when(F.col("o_orderstatus") == "F", text("-", F.format_number("o_totalprice", 2))).otherwise(F.format_number("o_totalprice", 2))
    fact = text("<tpch:Total", id_, ' contextRef="d', id_, '" unitRef="usd" decimals="INF">', value, "</tpch:Total", id_, ">")
    rows = orders.select(F.col("o_custkey").cast("string").alias("ref"), F.concat(context, fact).alias("line"))
    return filings(rows.groupBy("ref").agg(F.collect_set("line").alias("lines")), "xbrl")


def dimensional_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inline documents per order whose contexts carry the part and, for even parts, the supplier as dimensions."""
    lines = table(spark, sf_dir, "lineitem")
    member = lambda axis, value: text('<xbrldi:explicitMember dimension="tpch:', axis, 'Axis">tpch:', axis, value, "</xbrldi:explicitMember>")
    part = member("Part", F.col("l_partkey").cast("string"))
    supplier = F.when(F.col("l_partkey") % 2 == 0, member("Supplier", F.col("l_suppkey").cast("string"))).otherwise("")
    id_ = text("x", line_key(), "-", F.format_number("l_quantity", 0))
    fact = text('<ix:nonFraction name="tpch:Quantity" contextRef="', id_, '" unitRef="usd" decimals="0">', F.format_number("l_quantity", 0), "</ix:nonFraction>")
    line = F.concat(instant(id_, F.lit("2024-12-31"), text("<xbrli:segment>", supplier, part, "</xbrli:segment>")), fact)
    return filings(per_order(lines, line, [*LINE_KEY, "l_quantity"]))


def label_linkbases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A label linkbase per region: its nations' names as standard (even keys) or terse labels, with a documentation label for each."""
    nations = table(spark, sf_dir, "nation").withColumn("k", F.col("n_nationkey").cast("string"))
    role = F.when(F.col("n_nationkey") % 2 == 0, "http://www.xbrl.org/2003/role/label").otherwise("http://www.xbrl.org/2003/role/terseLabel")
    resource = lambda role_, words: text('<link:label xlink:type="resource" xlink:label="r', F.col("k"), '" xlink:role="', role_, '" xml:lang="en">', words, "</link:label>")
    line = text(
        '<link:loc xlink:type="locator" xlink:href="tpch.xsd#tpch_Nation', F.col("k"), '" xlink:label="l', F.col("k"), '"/>',
        '<link:labelArc xlink:type="arc" xlink:from="l', F.col("k"), '" xlink:to="r', F.col("k"), '"/>',
        resource("http://www.xbrl.org/2003/role/documentation", F.lit("about it")), resource(role, text(" <b>", F.col("n_name"), "</b> ")),
    )
    books = nations.select(F.col("n_regionkey").cast("string").alias("ref"), line.alias("line")).groupBy("ref").agg(F.collect_list("line").alias("lines"))
    return books.select("ref", F.lit("lab").alias("suffix"), text("<link:linkbase>", join_lines(F.col("lines")), "</link:linkbase>").alias("xml"))


def calculation_linkbases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculation linkbase per order: its line items sum to the order, weighted -1 for returned ones."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", line_key().alias("k"), "l_returnflag").distinct()
    weight = F.when(F.col("l_returnflag") == "R", "-1.0").otherwise("1.0")
    line = text('<link:loc xlink:href="t.xsd#tpch_Price', F.col("k"), '" xlink:label="i', F.col("k"), '"/><link:calculationArc xlink:from="total" xlink:to="i', F.col("k"), '" weight="', weight, '"/>')
    books = lines.select(F.col("l_orderkey").cast("string").alias("ref"), line.alias("line")).groupBy("ref").agg(F.collect_list("line").alias("lines"))
    xml = text('<link:calculationLink xlink:role="http://x/role/StatementOfIncome"><link:loc xlink:href="t.xsd#tpch_Total" xlink:label="total"/>', join_lines(F.col("lines")), "</link:calculationLink>")
    return books.select("ref", F.lit("cal").alias("suffix"), xml.alias("xml"))


def presentation_linkbases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A presentation linkbase per order: a balance sheet and, for every third order, a note; even parts are shown negated."""
    preferred = F.when(F.col("l_partkey") % 2 == 0, "http://www.xbrl.org/2009/role/negatedLabel").otherwise("http://www.xbrl.org/2003/role/label")
    line = text('<link:loc xlink:href="t.xsd#tpch_Price', line_key(), '" xlink:label="i', line_key(), '"/><link:presentationArc xlink:from="root" xlink:to="i', line_key(), '" preferredLabel="', preferred, '"/>')
    books = per_order(table(spark, sf_dir, "lineitem"), line, LINE_KEY)
    role = F.when(F.col("ref").cast("bigint") % 3 == 0, "http://x/role/NoteDetails").otherwise("http://x/role/ConsolidatedBalanceSheets")
    xml = text('<link:presentationLink xlink:role="', role, '"><link:loc xlink:href="t.xsd#us-gaap_Root" xlink:label="root"/>', join_lines(F.col("lines")), "</link:presentationLink>")
    return books.select("ref", F.lit("pre").alias("suffix"), xml.alias("xml"))


def subsidiary_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An EX-21 table per nation: supplier, nation and, for even nations, a share; with header, section and spacer rows."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    share = F.when(F.col("n_nationkey") % 2 == 0, text("<td>", (F.col("s_suppkey") % 100 + 1).cast("string"), "%</td>")).otherwise("")
    row = text("<tr><td>", F.col("s_name"), " (1)</td><td></td><td>", F.col("n_name"), "</td>", share, "</tr>")
    tables = rows.select("n_nationkey", row.alias("line")).groupBy("n_nationkey").agg(F.collect_list("line").alias("lines"))
    head = F.when(F.col("n_nationkey") % 2 == 0, "<td>Percent owned</td>").otherwise("")
    html = text("<html><body><table><tr><td>Name of Subsidiary</td><td></td><td>Jurisdiction of Incorporation</td>", head, "</tr><tr><td>U.S. Subsidiaries:</td></tr><tr><td>&nbsp;</td></tr>", join_lines(F.col("lines")), "</table></body></html>")
    return tables.select(F.col("n_nationkey").cast("string").alias("ref"), html.alias("html"))


#: Items "1.00" to "98.99"; the paragraphs from the last one on stand under it together.
ITEMS = 9_800


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ref, paragraphs, shown): every line of a document that isn't blank, spaces collapsed and nothing else changed, and the same as HTML text."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda p: F.trim(F.regexp_replace(p, " +", " "))), lambda p: p != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ref"), rest_in_last(lines, ITEMS).alias("paragraphs"))
    escaped = lambda p: F.replace(F.replace(F.replace(p, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return docs.where(F.size("paragraphs") > 0).withColumn("shown", F.transform("paragraphs", escaped))


def rest_in_last(paragraphs: Column, most: int) -> Column:
    """At most so many paragraphs: those from the last place on are one, joined by spaces."""
    rest = F.array_join(F.slice(paragraphs, F.lit(most), F.greatest(F.size(paragraphs), F.lit(1))), " ")
    return F.when(F.size(paragraphs) <= most, paragraphs).otherwise(F.concat(F.slice(paragraphs, 1, most - 1), F.array(rest)))


def item_number(i: Column) -> Column:
    """"1.00", "1.01" and so on, of places from 0."""
    return F.concat((F.floor(i / 100) + 1).cast("string"), F.lit("."), F.lpad((i % 100).cast("string"), 2, "0"))
