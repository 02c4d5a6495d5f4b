"""Registered queries of listing, text, section and table operators, with the SQL that gives their rows.

As in ``queries``, tables are rendered as payloads or markup, read back by the
operator, and compared with the table's own columns.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions import names, numbers, styles
from filingloom.functions import text as texts
from filingloom.operators import exhibits, headings, html_tree, linkbase, listing, parity, sections, standardize, warehouse, windows, xbrl
from filingloom.plans import render
from filingloom.plans.queries import LINE_FACTS, line_facts, query
from filingloom.plans.render import table, text
from filingloom.sources import export, facts_json, landing, packages
from filingloom.storage import scratch_dir

# -- listings and files --------------------------------------------------------------


@query("""SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m-%d') AS filed, o_orderstatus = 'F' AS "isXBRL" FROM orders""")
def older_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", F.col("o_orderkey").cast("string").alias("a"), F.col("o_orderpriority").alias("f"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), (F.col("o_orderstatus") == "F").cast("int").alias("x")).alias("o"))
    page = orders.groupBy("o_custkey").agg(F.array_sort(F.collect_list("o")).alias("o"))
    body = F.to_json(F.struct(F.col("o.a").alias("accessionNumber"), F.col("o.f").alias("form"), F.col("o.d").alias("filingDate"), F.col("o.x").alias("isXBRL"), *[F.col("o.a").alias(c) for c in ("reportDate", "acceptanceDateTime", "primaryDocument")], *[F.col("o.x").alias(c) for c in ("isInlineXBRL", "isXBRLNumeric")]))
    return listing.older_filings(page.select(F.col("o_custkey").alias("cik"), body.alias("json"))).select("cik", "accession", "form", "filed", "isXBRL")


@query("""SELECT lpad(CAST(o_custkey AS VARCHAR), 10, '0') AS cik, CAST(o_orderkey AS VARCHAR) AS accession, round(o_totalprice, 2) AS value FROM orders WHERE o_custkey = 7 AND o_orderpriority = '1-URGENT'""")
def company_concept(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    value = F.struct(F.lit("1999-12-31").alias("end"), F.col("o_totalprice").alias("val"), F.col("o_orderkey").cast("string").alias("accn"))
    units = orders.groupBy("o_custkey", "o_orderpriority").agg(F.struct(F.create_map(F.lit("USD"), F.collect_list(value)).alias("units")).alias("t"))
    tags = units.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderpriority", "t"))).alias("tags"))
    payloads = tags.select(F.to_json(F.struct(F.col("o_custkey").alias("cik"), F.create_map(F.lit("tpch"), F.col("tags")).alias("facts"))).alias("json"))
    return listing.company_concept(listing.company_facts(payloads), "7", "tpch", "1-URGENT").select("cik", "accession", F.round("value", 2).alias("value"))


def _stored_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five files for each supplier, in turn: linkbases, a plain instance and, for even suppliers, one beside the HTML."""
    key = F.col("s_suppkey").cast("string")
    files = F.array(text("x", key, "_pre.xml"), text("x", key, "_lab.xml"), text("y", key, ".xml"), F.when(F.col("s_suppkey") % 2 == 0, text("z", key, "_htm.xml")), text("z", key, ".htm"))
    rows = table(spark, sf_dir, "supplier").select(key.alias("ref"), F.posexplode(files).alias("place", "name")).where("name is not null")
    return rows.withColumn("content", text("of ", F.col("name")))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 'z' || s_suppkey || '_htm.xml' ELSE 'y' || s_suppkey || '.xml' END AS instance, 'x' || s_suppkey || '_lab.xml' AS labels,
  'https://www.sec.gov/Archives/edgar/data/' || s_suppkey || '/0001' || s_suppkey AS folder FROM supplier""")
def filing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _stored_files(spark, sf_dir)
    both = listing.instance_file(files).join(listing.linkbase_file(files, "lab").withColumnRenamed("file", "labels"), "ref")
    return both.withColumn("folder", listing.archive_folder(F.lpad("ref", 10, "0"), text("0001-", F.col("ref"))))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, CASE s_suppkey % 3 WHEN 0 THEN 'ixbrl' WHEN 1 THEN 'xbrl' ELSE 'html' END AS kind,
  'of ' || CASE WHEN s_suppkey % 3 <> 1 THEN 'z' || s_suppkey || '.htm' WHEN s_suppkey % 2 = 0 THEN 'z' || s_suppkey || '_htm.xml' ELSE 'y' || s_suppkey || '.xml' END AS content FROM supplier""")
def archive_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    listed = table(spark, sf_dir, "supplier").select(F.lpad(key, 10, "0").alias("cik"), key.alias("accession"), text("z", key, ".htm").alias("document"), (F.col("s_suppkey") % 3 == 0).alias("isInlineXBRL"), (F.col("s_suppkey") % 3 <= 1).alias("isXBRL"))
    return landing.archive_filings(_stored_files(spark, sf_dir), listed).select("ref", "kind", "content")


def _zipped(rows: DataFrame) -> DataFrame:
    """(path, content): ZIP files of rows (path, entries array<struct<name, body>>)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for entries in batch.column(1).to_pylist():
                data = io.BytesIO()
                with zipfile.ZipFile(data, "w") as z:
                    for e in entries:
                        z.writestr(e["name"], e["body"])
                packed.append(data.getvalue())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["path", "content"])

    return rows.select("path", "entries").mapInArrow(run, "path string, content binary")


def _packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    instance = text('<xbrl><identifier scheme="http://standards.iso.org/iso/17442">LEI', key, "</identifier></xbrl>")
    entry = lambda name, body: F.struct(text(name).alias("name"), body.alias("body"))
    report = F.struct(F.when(F.col("s_suppkey") % 2 == 0, "p/reports/b.xhtml").otherwise("p/reports/b.xbrl").alias("name"), instance.alias("body"))
    entries = F.array(entry("p/META-INF/c.xml", F.lit("no")), entry("p/reports/a.xbrl", F.lit("classic")), report, entry("p/t_pre.xml", text("PRE", key)), entry("p/t_lab-en.xml", text("LAB", key)))
    return _zipped(table(spark, sf_dir, "supplier").select(text("file:/landing/", key, ".zip").alias("path"), entries.alias("entries")))


@query("""SELECT s_suppkey || '.zip' AS ref, CASE WHEN s_suppkey % 2 = 0 THEN 'LEI' || s_suppkey ELSE '' END AS entity_value, CASE WHEN s_suppkey % 2 = 0 THEN 'b.xhtml' ELSE 'a.xbrl' END AS document, CASE WHEN s_suppkey % 2 = 0 THEN 'ixbrl' ELSE 'xbrl' END AS kind FROM supplier""")
def package_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landing.read_filings(_packages(spark, sf_dir), "esef").select("ref", "entity_value", "document", "kind")


@query("""SELECT s_suppkey || '.zip' AS ref, suffix, upper(suffix) || s_suppkey AS xml FROM supplier CROSS JOIN (VALUES ('pre'), ('lab')) v(suffix)""")
def package_linkbases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.package_linkbases(_packages(spark, sf_dir))


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive per nation with its customers' accounts; every fifth is a PDF, and a note that is none of them."""
    number = F.lpad(F.col("c_custkey").cast("string"), 8, "0")
    body = F.when(F.col("c_custkey") % 5 == 0, "%PDF-1.4").otherwise(text('<html><identifier scheme="http://www.companieshouse.gov.uk/">', number, "</identifier></html>"))
    entry = F.struct(text("Prod223_1_", number, "_2023", F.lpad((F.col("c_custkey") % 12 + 1).cast("string"), 2, "0"), "28.html").alias("name"), body.alias("body"))
    rows = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg(F.sort_array(F.collect_list(entry)).alias("entries"))
    note = F.array(F.struct(F.lit("readme.txt").alias("name"), F.lit("x").alias("body")))
    return _zipped(rows.select(text("file:/d/", F.col("c_nationkey").cast("string"), ".zip").alias("path"), F.concat("entries", note).alias("entries")))


ACCOUNTS = "SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS entity_value, CAST('2023-' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '-28' AS DATE) AS period_end, 'Prod223_1_' || lpad(CAST(c_custkey AS VARCHAR), 8, '0') || '_2023' || lpad(CAST(c_custkey % 12 + 1 AS VARCHAR), 2, '0') || '28.html' AS ref, c_custkey, c_nationkey FROM customer"


@query(f"SELECT entity_value, period_end, ref, 'file:/d/' || c_nationkey || '.zip' AS url FROM ({ACCOUNTS})")
def bulk_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.bulk_handles(_daily(spark, sf_dir)).select("entity_value", "period_end", "ref", "url")


@query(f"SELECT entity_value, ref, CASE WHEN c_custkey % 5 = 0 THEN 'pdf' ELSE 'ixbrl' END AS kind FROM ({ACCOUNTS})")
def bulk_filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packages.bulk_filings(_daily(spark, sf_dir)).select("entity_value", "ref", "kind")


@query(f"SELECT entity_value, ref FROM ({ACCOUNTS}) ORDER BY 'file:/d/' || c_nationkey || '.zip', ref LIMIT 40")
def first_bulk_handles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The limit is the operator's own."""
    return packages.bulk_handles(_daily(spark, sf_dir), limit=40).select("entity_value", "ref")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS ref, 'LEI' || n_nationkey AS lei, CASE WHEN n_nationkey % 2 = 0 THEN '2023-03-' || lpad(CAST(n_nationkey + 1 AS VARCHAR), 2, '0') END AS taxonomy_date, CASE WHEN n_nationkey % 2 = 0 THEN n_name END AS label FROM nation""")
def published_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").withColumn("ref", F.col("n_nationkey").cast("string"))
    day = text("2023-03-", F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"))
    schema = F.when(F.col("n_nationkey") % 2 == 0, text('<schemaRef href="http://xbrl.ifrs.org/taxonomy/', day, '/full.xsd"/>')).otherwise("")
    content = text(schema, '<identifier scheme="http://standards.iso.org/iso/17442"> LEI', F.col("ref"), "</identifier>")
    filings = nation.select("ref", content.alias("content"))
    books = nation.select(day.alias("taxonomy_date"), F.lit("ifrs-full:Equity").alias("concept"), F.col("n_name").alias("label"))
    read = filings.select("ref", xbrl.identifier(F.col("content"), "17442").alias("lei"), packages.taxonomy_date(F.col("content")).alias("taxonomy_date"))
    return read.join(packages.standard_labels(filings, books).select("ref", "label"), "ref", "left")


def _attached(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of a submission for each customer, their types and descriptions by the key."""
    key = F.col("c_custkey").cast("string")
    kinds = F.array(F.lit("10-K"), F.lit("EX-99.1"), F.lit("GRAPHIC"), F.when(F.col("c_custkey") % 2 == 0, "EX-21"))
    rows = table(spark, sf_dir, "customer").select("c_custkey", key.alias("ref"), F.posexplode(kinds).alias("place", "type")).where("type is not null")
    file = text("d", key, "-", F.col("place").cast("string"), F.when(F.col("type") == "GRAPHIC", ".jpg").otherwise(".htm"))
    return rows.select("ref", "place", "type", file.alias("filename"), F.when((F.col("type") == "EX-21") & (F.col("c_custkey") % 4 == 0), "NEWS RELEASE").otherwise("").alias("description"), (F.col("c_custkey") * 100).cast("int").alias("size"))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ref, 'd' || c_custkey || '-' || n AS filename, n FROM (SELECT c_custkey, unnest(CASE WHEN c_custkey % 4 = 0 THEN ['1.htm', '3.htm'] ELSE ['1.htm'] END) AS n FROM customer)""".replace(", n FROM (", " FROM ("))
def press_releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.press_releases(_attached(spark, sf_dir)).select("ref", "filename")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ref, unnest(CASE WHEN c_custkey % 2 = 0 THEN ['EX-99.1', 'EX-21'] ELSE ['EX-99.1'] END) AS type FROM customer""")
def attached_exhibits(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _attached(spark, sf_dir)
    primary = documents.where("type = '10-K'").select("ref", F.col("filename").alias("document"))
    return listing.exhibits(documents, primary).select("ref", "type")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ref, CASE c_custkey % 6 WHEN 0 THEN 'first.htm' WHEN 1 THEN 'about.htm' WHEN 2 THEN 'xaif.htm' WHEN 3 THEN 'annual.htm' WHEN 4 THEN 'main.htm' ELSE 'big.htm' END AS filename, (CASE c_custkey % 6 WHEN 4 THEN 6 WHEN 5 THEN 7 ELSE c_custkey % 6 + 1 END)::INTEGER AS rank FROM customer""")
def annual_information_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("c_custkey") % 6
    doc = lambda kind, file, about, size=5: F.struct(F.lit(kind).alias("type"), F.lit(file).alias("filename"), F.lit(about).alias("description"), F.lit(size).alias("size"))
    main, plain, big = doc("40-F", "main.htm", ""), doc("EX-23", "consent.htm", ""), doc("EX-99.9", "big.htm", "", 200_000)
    chosen = (
        F.when(case == 0, F.array(main, big, doc("EX-1", "first.htm", ""))).when(case == 1, F.array(main, doc("EX-5", "about.htm", "annual information form"))).when(case == 2, F.array(main, doc("EX-99.2", "xaif.htm", ""), doc("EX-99.1", "annual.htm", "")))
        .when(case == 3, F.array(main, big, doc("EX-99.1", "annual.htm", ""))).when(case == 4, F.array(plain, main)).otherwise(F.array(plain, big))
    )
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ref"), F.posexplode(chosen).alias("place", "d")).select("ref", "place", "d.*")
    return listing.annual_information_form(rows)


@query("""SELECT CAST(p_partkey AS VARCHAR) AS ref, unnest(['i' || p_partkey || '.png', 's.css']) AS asset FROM part""")
def document_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    page = text('<img src="./i', key, '.png?v=1"><link href="s.css"><a href="https://x/y.png"></a><a href="other.htm">x</a><IMG SRC=\'./i', key, ".png'>")
    return listing.assets(table(spark, sf_dir, "part").select(key.alias("ref"), page.alias("content")))


# -- warehouse, labels, selections -------------------------------------------------------


@query("""SELECT lpad(CAST(s_suppkey AS VARCHAR), 10, '0') AS cik, CAST(s_suppkey AS VARCHAR) AS accession, 1::BIGINT AS documents, 1::BIGINT AS facts, 1::BIGINT AS snapshots FROM supplier""")
def warehouse_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filings archived twice: documents, facts and snapshots are stored once."""
    key = F.col("s_suppkey").cast("string")
    fact = text('<ix:nonFraction name="t:Balance" contextRef="c" unitRef="usd">', F.format_number(F.abs("s_acctbal"), 2), "</ix:nonFraction>")
    lines = F.array(text(render.instant(F.lit("c"), F.lit("2023-12-31")), fact))
    filings = render.filings(table(spark, sf_dir, "supplier").select(key.alias("ref"), lines.alias("lines")))
    store = warehouse.Warehouse(spark, scratch_dir(spark, "archive"))
    store.archive(filings)
    store.archive(filings)
    count = lambda name: store.table(name).groupBy("cik", "accession").agg(F.count("*").alias(name))
    both = count("documents").join(count("facts"), ["cik", "accession"], "full_outer").join(count("extractions").withColumnRenamed("extractions", "snapshots"), ["cik", "accession"], "full_outer")
    return both


@query(f"""{LINE_FACTS} SELECT accession, period_end, count(*) AS n FROM facts WHERE accession = '0000000007' AND dimensions = '{{}}' GROUP BY ALL""")
def one_filing_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warehouse.view_rows(line_facts(spark, sf_dir), accession="0000000007")
    return rows.groupBy("accession", "period_end").agg(F.count("*").alias("n"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS accession, CASE WHEN s_suppkey % 3 = 0 THEN s_name ELSE '' END AS label FROM supplier""")
def facts_with_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    lines = F.array(text(render.instant(F.lit("c"), F.lit("2023-12-31")), '<ix:nonFraction name="t:Balance" contextRef="c" unitRef="usd">5</ix:nonFraction>'))
    supplier = table(spark, sf_dir, "supplier")
    labels = supplier.where("s_suppkey % 3 = 0").select(key.alias("ref"), F.lit("t:Balance").alias("concept"), F.col("s_name").alias("label"))
    return xbrl.facts(render.filings(supplier.select(key.alias("ref"), lines.alias("lines"))), labels=labels).select("accession", "label")


def _picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey").cast("string")
    provenance = F.struct(key.alias("cik"), text("a-", key).alias("accession"), F.lit("u").alias("url"))
    fact = lambda concept: F.struct(F.lit(concept).alias("concept"), F.format_number(F.abs("s_acctbal"), 2).alias("value"), F.lit("x").alias("contextRef"), F.lit("usd").alias("unitRef"), F.lit("2024-01-31").alias("periodEnd"))
    body = F.struct(F.lit(1).alias("version"), provenance.alias("provenance"), text("#t", key, " > td").alias("selector"), F.lit("prose").alias("kind"), text("one\n \n\n", F.col("s_name")).alias("text"), F.lit("<p>x</p>").alias("html"), F.array(fact("t:Known"), fact("t:Note")).alias("facts"))
    return facts_json.read_picks(table(spark, sf_dir, "supplier").select(F.to_json(body).alias("json")))


@query("""SELECT 'a-' || s_suppkey AS accession, concept, CASE WHEN concept = 't:Known' AND s_suppkey % 2 = 0 THEN 'IncomeStatement' ELSE '' END AS statement, round(abs(s_acctbal), 2) AS value FROM supplier CROSS JOIN (VALUES ('t:Known'), ('t:Note')) v(concept)""")
def picked_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(text("a-", F.col("s_suppkey").cast("string")).alias("ref"), F.lit("t:Known").alias("concept"), F.array(F.lit("IncomeStatement"), F.lit("Equity")).alias("statements"))
    rows = facts_json.classified_facts(facts_json.pick_facts(_picks(spark, sf_dir)), known)
    return rows.select("accession", "concept", "statement", F.round("value", 2).alias("value"))


@query("""SELECT 'a-' || s_suppkey || '_t' || s_suppkey || '-td.md' AS name, '> Source: CIK ' || s_suppkey || ', accession a-' || s_suppkey || ' (prose)' || chr(10) || '> URL: u' || chr(10) || '> Selector: `#t' || s_suppkey || ' > td`' || chr(10) || chr(10) || 'one' || chr(10) || chr(10) || s_name AS content FROM supplier""")
def exported_selections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export.exported(_picks(spark, sf_dir), "markdown")


@query("""SELECT CAST(n_nationkey AS VARCHAR) AS ref, unnest(CASE n_nationkey % 2 WHEN 0 THEN ['BalanceSheet'] ELSE ['CashFlow'] END) AS statement FROM nation WHERE n_nationkey % 3 < 2""")
def statement_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The presentation linkbase decides, then rendered reports; the anchored concepts of filings without either aren't listed here."""
    nation = table(spark, sf_dir, "nation").withColumn("ref", F.col("n_nationkey").cast("string"))
    role = F.when(F.col("n_nationkey") % 2 == 0, "ConsolidatedBalanceSheets").otherwise("ConsolidatedStatementsOfCashFlows")
    xml = text('<link:presentationLink xlink:role="http://x/role/', role, '"><link:loc xlink:href="t.xsd#tpch_N" xlink:label="i"/></link:presentationLink>')
    books = nation.where("n_nationkey % 3 = 0").select("ref", F.lit("pre").alias("suffix"), xml.alias("xml"))
    own = F.when(F.col("n_nationkey") % 2 == 0, F.array(F.lit("BalanceSheet"))).otherwise(F.array(F.lit("CashFlow")))
    reports = nation.where("n_nationkey % 3 < 2").select("ref", F.lit("tpch:N").alias("concept"), own.alias("statements"))
    found = linkbase.statement_map(nation.select("ref"), books, reports).where("concept = 'tpch:N'")
    return found.select("ref", F.explode("statements").alias("statement"))


@query("""SELECT 'us-gaap:Revenues' AS concept, 'Revenue' AS standard_concept, count(*) AS n FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax', 'Contract Revenue', count(*) FROM nation WHERE n_nationkey % 3 = 1 UNION ALL SELECT 'xx:Unmapped', NULL, count(*) FROM nation WHERE n_nationkey % 3 = 2""")
def shipped_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    concept = F.element_at(F.array(F.lit("us-gaap:Revenues"), F.lit("us-gaap:RevenueFromContractWithCustomerExcludingAssessedTax"), F.lit("xx:Unmapped")), (F.col("n_nationkey") % 3 + 1).cast("int"))
    rows = standardize.standardized(table(spark, sf_dir, "nation").select(concept.alias("concept")), standardize.shipped())
    return rows.groupBy("concept", "standard_concept").agg(F.count("*").alias("n"))


# -- comparison ---------------------------------------------------------------------------


@query(f"""{LINE_FACTS}, asked AS (SELECT DISTINCT accession, concept, unit, period_end + CAST(CAST(right(accession, 1) AS INTEGER) % 3 AS INTEGER) AS period_end FROM facts),
own AS (SELECT accession, concept, period_end, arg_min(value, context_ref) AS value FROM facts WHERE dimensions = '{{}}' GROUP BY ALL)
SELECT a.accession, a.concept, CAST(a.period_end AS DATE) AS period_end, round(o.value, 2) AS value, o.value IS NOT NULL AND abs(o.value - 1000.0) <= 1e-4 * 1000.0 AS match FROM asked a LEFT JOIN own o ON o.accession = a.accession AND o.concept = a.concept AND abs(a.period_end - o.period_end) <= 1""")
def reference_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = line_facts(spark, sf_dir)
    shifted = F.date_add("period_end", (F.right("accession", F.lit(1)).cast("int") % 3).cast("int"))
    asked = facts.select("accession", "concept", text("iso4217:", F.col("unit")).alias("unit"), shifted.alias("period_end"), F.lit(1000.0).alias("value")).distinct()
    return parity.against_reference(facts, asked).select("accession", "concept", "period_end", F.round("value", 2).alias("value"), "match")


@query(f"""{LINE_FACTS}, own AS (SELECT cik, CASE concept WHEN 'tpch:AF' THEN 1 WHEN 'tpch:RF' THEN 2 END AS place, period_end, period_start, context_ref, value FROM facts WHERE dimensions = '{{}}' AND NOT is_instant AND concept IN ('tpch:AF', 'tpch:RF') AND period_end - period_start > 300),
best AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY place, period_end DESC, context_ref, value) AS r FROM own)
SELECT c.cik, 'sales' AS metric, b.period_end, round(b.value, 2) AS value, coalesce(b.value > 0 AND (year(b.period_end) % 2 = 0), false) AS match FROM (SELECT DISTINCT cik FROM facts) c LEFT JOIN (SELECT * FROM best WHERE r = 1) b USING (cik)""")
def metric_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = line_facts(spark, sf_dir)
    metrics = spark.createDataFrame([("sales", "tpch:AF", 1, False), ("sales", "tpch:RF", 2, False)], "metric string, concept string, place int, instant boolean")
    first = parity.metric_check(facts, metrics, spark.createDataFrame([], "cik string, metric string, year int, value double"))
    # the other source agrees within half a per cent in even years, and is a tenth off in odd ones
    given = first.where("value is not null").select("cik", "metric", F.year("period_end").alias("year"), (F.col("value") * F.when(F.year("period_end") % 2 == 0, 1.005).otherwise(1.1)).alias("value"))
    return parity.metric_check(facts, metrics, given).select("cik", "metric", "period_end", F.round("value", 2).alias("value"), "match")


@query("""SELECT event_id, CAST(ts AS DATE) AS period_end FROM events""")
def interchange_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.date_format("ts", "yyyy-MM-dd")
    period = F.when(F.col("event_id") % 3 == 0, day).when(F.col("event_id") % 3 == 1, text(day, "T00:00:00")).otherwise(text("2001-01-01T00:00:00/", day, "T00:00:00"))
    return table(spark, sf_dir, "events").select("event_id", parity.period_end(period).alias("period_end"))


# -- windows -----------------------------------------------------------------------------


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, coalesce((SELECT min(pos) FROM m b WHERE b.l_orderkey = a.l_orderkey AND b.pos > a.pos AND b.level <= a.level), 1000)::BIGINT AS stop FROM m a""".replace("SELECT l_orderkey", "WITH m AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos, l_partkey % 6 + 1 AS level FROM lineitem) SELECT l_orderkey", 1))
def ends_at_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")).cast("bigint")
    marks = table(spark, sf_dir, "lineitem").withColumns({"offset": place, "level": (F.col("l_partkey") % 6 + 1).cast("int"), "length": F.lit(1000).cast("bigint")})
    return windows.ends_at_level(marks, by="l_orderkey").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "stop")


@query("""SELECT event_id, coalesce(lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id), 1000000000)::BIGINT AS stop FROM events""")
def ends_before_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = table(spark, sf_dir, "events").select("event_id", "user_id", F.lit(1_000_000_000).cast("bigint").alias("length"))
    return windows.ends_before_next(marks, by="user_id", order="event_id").select("event_id", "stop")


@query("""SELECT user_id, round(sum(c * w) / sum(w), 6) AS confidence, (SELECT level FROM (SELECT level, sum(c * w) AS v FROM e b WHERE b.user_id = a.user_id GROUP BY level) ORDER BY v DESC, level LIMIT 1)::INTEGER AS level FROM e a GROUP BY user_id""".replace("SELECT user_id, round", "WITH e AS (SELECT user_id, event_id % 3 + 1 AS level, (event_id % 4 + 1) / 4.0 AS c, (event_id % 2 + 1) / 2.0 AS w FROM events) SELECT user_id, round", 1))
def weighted_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", (i % 3 + 1).cast("int").alias("level"), ((i % 4 + 1) / 4).alias("confidence"), ((i % 2 + 1) / 2).alias("weight"))
    return windows.vote(rows, by=["user_id"]).select("user_id", F.round("confidence", 6).alias("confidence"), "level")


@query("""SELECT user_id, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS share FROM events GROUP BY 1""")
def ratio_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.round(windows.share(F.col("event_type") == "error"), 6).alias("share"))


@query("""WITH s AS (SELECT event_id, user_id, event_id * 10 AS a, event_id * 10 + 5 + event_id % 30 AS b FROM events), n AS (SELECT *, lag(b) OVER w AS before, lead(a) OVER w AS after FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a, b))
SELECT event_id, CASE WHEN a < before THEN (before + a) // 2 ELSE a END::BIGINT AS start, CASE WHEN after < b THEN (b + after) // 2 ELSE b END::BIGINT AS stop, round(CASE WHEN a < before OR a - before > 100000 THEN 0.9 ELSE 1.0 END * CASE WHEN after < b THEN 0.9 ELSE 1.0 END, 6)::DOUBLE AS confidence FROM n""")
def overlap_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", (i * 10).alias("start"), (i * 10 + 5 + i % 30).alias("stop"), F.lit(1.0).alias("confidence"))
    return headings.without_overlap(rows, by="user_id").select("event_id", "start", "stop", F.round("confidence", 6).alias("confidence"))


@query("""WITH r AS (SELECT user_id, event_type AS item, event_id, value, CASE event_id % 3 WHEN 0 THEN 'toc' WHEN 1 THEN 'pattern' ELSE 'chunks' END AS method, CASE event_id % 3 WHEN 0 THEN 0.9 WHEN 1 THEN 0.7 ELSE 0.6 END AS c FROM events),
g AS (SELECT user_id, item, count(DISTINCT method) AS methods, max(c) AS c FROM r GROUP BY ALL), b AS (SELECT *, row_number() OVER (PARTITION BY user_id, item ORDER BY c DESC, event_id) AS k FROM r)
SELECT g.user_id::VARCHAR AS ref, g.item, b.event_id AS place, b.method, round(CASE WHEN methods > 1 THEN least(g.c * 1.15, 1.0) ELSE g.c END, 6)::DOUBLE AS confidence FROM g JOIN b ON b.user_id = g.user_id AND b.item = g.item AND b.k = 1 WHERE CASE WHEN methods > 1 THEN least(g.c * 1.15, 1.0) ELSE g.c END >= 0.7""")
def best_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 3
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("ref"), F.col("event_type").alias("item"), F.lit(None).cast("string").alias("part"), F.col("event_id").alias("place"), F.lit("t").alias("title"), F.lit("x").alias("text"),
        F.when(kind == 0, "toc").when(kind == 1, "pattern").otherwise("chunks").alias("method"), F.when(kind == 0, 0.9).when(kind == 1, 0.7).otherwise(0.6).alias("confidence"),
    )
    return sections.best_sections(rows).where("confidence >= 0.7").select("ref", "item", "place", "method", F.round("confidence", 6).alias("confidence"))


# -- notations ----------------------------------------------------------------------------


@query("""SELECT p_partkey, p_size + 1 AS roman, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS cik, (CASE p_partkey % 3 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 9 END * 100000 + p_size * 100 + p_partkey % 3)::INTEGER AS item_order,
  CAST(p_size AS VARCHAR) || CASE p_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'A' ELSE 'B' END AS item, CASE p_partkey % 3 WHEN 0 THEN 'I' WHEN 1 THEN 'II' ELSE 'X' END AS part, 'Title ' || p_partkey AS title FROM part""")
def item_notations(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, n = F.col("p_partkey"), F.col("p_size")
    tens = lambda v, one, five, ten: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), (v % 10 + 1).cast("int"))
    numeral = F.concat(F.repeat(F.lit("C"), F.floor((n + 1) / 100).cast("int")), tens(F.floor((n + 1) / 10), "X", "L", "C"), tens(n + 1, "I", "V", "X"))
    item = F.concat(n.cast("string"), F.when(key % 3 == 0, "").when(key % 3 == 1, "A").otherwise("B"))
    part = F.when(key % 3 == 0, "I").when(key % 3 == 1, "II").otherwise("X")
    heading = text("PART ", F.lower(part), ", Item ", F.lower(item), ". Title ", key.cast("string"))
    rows = table(spark, sf_dir, "part").select("p_partkey", names.roman(F.lower(numeral)).alias("roman"), names.cik(key).alias("cik"), names.item_of(heading).alias("item"), names.part_of(heading).alias("part"), names.section_title(text("Item 12A. Title ", key.cast("string"), "\nmore")).alias("title"))
    return rows.withColumn("item_order", names.item_order(F.col("part"), F.col("item")).cast("int"))


@query("""SELECT CAST(p_partkey AS VARCHAR) AS ref, CASE p_partkey % 3 WHEN 0 THEN 'Item 2.0' || p_partkey % 10 WHEN 1 THEN p_name ELSE p_brand END AS label FROM part""")
def section_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    title = F.when(key % 3 == 0, text("Item 2.0", (key % 10).cast("string"), " Results")).when(key % 3 == 1, text(F.col("p_name"), " - ", F.col("p_type"))).otherwise(F.col("p_brand"))
    return sections.items_of(table(spark, sf_dir, "part").select(key.cast("string").alias("ref"), title.alias("title")), "(Item\\s+\\d+\\.\\s*\\d+)").select("ref", "label")


@query("""SELECT p_partkey, round(CASE p_partkey % 3 WHEN 0 THEN p_retailprice WHEN 1 THEN -p_retailprice ELSE 0 END, 2)::DOUBLE AS cell, p_partkey % 3 <> 2 AS amount, CASE WHEN p_size <= 100 THEN p_size::DOUBLE END AS percent, round(p_size * 1.333, 4)::DOUBLE AS pixels FROM part""")
def table_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("p_partkey"), F.format_number("p_retailprice", 2)
    cell = F.when(key % 3 == 0, text("$ ", price)).when(key % 3 == 1, text("(", price, ")")).otherwise("—")
    size = F.col("p_size").cast("string")
    return table(spark, sf_dir, "part").select("p_partkey", F.round(numbers.cell_number(cell), 2).alias("cell"), numbers.looks_financial(cell).alias("amount"), numbers.percent(text(" ", size, "% ")).alias("percent"), F.round(styles.pixels(text(size, "pt")), 4).alias("pixels"))


@query("""SELECT p_partkey, p_size::DOUBLE AS top, 2.0::DOUBLE AS "right", p_size::DOUBLE AS bottom, 'bold' AS weight, CASE WHEN p_partkey % 2 = 0 THEN '#aabbcc' ELSE 'red' END AS colour FROM part""")
def style_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = styles.declarations(text("Margin: ", F.col("p_size").cast("string"), "px 2px; color: RED; font-weight: normal"))
    own = styles.declarations(text("font-weight: bold;", F.when(F.col("p_partkey") % 2 == 0, "color:#ABC").otherwise("")))
    rows = table(spark, sf_dir, "part").select("p_partkey", styles.merged(base, own).alias("s"))
    sides = styles.box(F.col("s")["margin"])
    return rows.select("p_partkey", sides["top"].alias("top"), sides["right"].alias("right"), sides["bottom"].alias("bottom"), F.col("s")["font-weight"].alias("weight"), styles.colour(F.col("s")["color"]).alias("colour"))


@query("""SELECT p_partkey, p_name || ' - x, ' || p_brand || '. Next' AS punctuated, p_name || chr(10) || 'end' AS without_marks, CASE WHEN length(p_name || ' ' || p_type) <= 12 THEN p_name || ' ' || p_type ELSE 'cut' END AS shortened, p_name || ' & ' || p_brand AS decoded, 'A' || p_name AS prepared FROM part""")
def text_clean_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    name, brand = F.col("p_name"), F.col("p_brand")
    short = texts.shortened(text(name, " ", F.col("p_type")), 12)
    return table(spark, sf_dir, "part").select(
        "p_partkey", texts.punctuated(text(name, "—x ,", brand, " .Next")).alias("punctuated"), texts.without_page_marks(text(name, "\nend\n 12 ")).alias("without_marks"),
        F.when(F.length(text(name, " ", F.col("p_type"))) <= 12, short).when(F.length(short) <= 15, "cut").alias("shortened"),
        xbrl.decoded(text("<b>", name, "</b> &#x26;&#32;", brand)).alias("decoded"), texts.preprocessed(text("<?xml version='1'?><!-- c --><script>x</script>A", name)).alias("prepared"),
    )


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, CASE s_suppkey % 4 WHEN 0 THEN 'Workiva' WHEN 1 THEN 'Donnelley' WHEN 2 THEN 'Toppan Merrill' END AS agent FROM supplier""")
def filing_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.element_at(F.array(F.lit("Workiva Platform"), F.lit("dfinsolutions.com"), F.lit("Toppan"), F.lit("hand")), (F.col("s_suppkey") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), text("<!-- by ", mark, " --><p>", F.col("s_name"), "</p>").alias("content"))
    return rows.select("ref", exhibits.filing_agent(F.col("content")).alias("agent"))


# -- documents and sections --------------------------------------------------------------------


def _nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page per region: a heading, a paragraph and a link for each nation, in a section."""
    line = text("<h2>", F.col("n_name"), "</h2><p>About <b>", F.col("n_nationkey").cast("string"), "</b></p><a href='#n", F.col("n_nationkey").cast("string"), "'>to</a>")
    body = F.array_join(F.array_sort(F.collect_list(line)), "")
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text("<html><body><section>", body, "</section></body></html>").alias("content"))
    return rows.select(F.col("n_regionkey").cast("string").alias("ref"), "content")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, unnest(['heading', 'paragraph', 'link']) AS type, unnest([n_name, 'About ' || n_nationkey, 'to']) AS text, unnest([2, 0, 0])::INTEGER AS level, unnest([NULL, NULL, '#n' || n_nationkey]) AS href FROM nation""")
def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = html_tree.nodes(_nation_pages(spark, sf_dir)).where("type in ('heading', 'paragraph', 'link')")
    return found.select("ref", "type", "text", "level", "href")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, string_agg(n_name || chr(10) || chr(10) || 'About ' || n_nationkey || chr(10) || chr(10) || 'to', chr(10) || chr(10) ORDER BY '<h2>' || n_name || '</h2>') AS text FROM nation GROUP BY 1""")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only five nations share a region, so "to" is no navigation line: it would go from its third place on."""
    found = html_tree.text_blocks(_nation_pages(spark, sf_dir))
    whole = found.groupBy("ref").agg(F.array_join(F.array_sort(F.collect_list(F.struct("block", "text")))["text"], "\n\n").alias("text"))
    return whole


@query("""WITH l AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS k, count(*) OVER (PARTITION BY user_id, event_type) AS n FROM events)
SELECT CAST(user_id AS VARCHAR) AS ref, string_agg(event_type, chr(10) || chr(10) ORDER BY event_id) AS text FROM l WHERE n < 5 OR k <= 2 GROUP BY 1""")
def text_without_navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.struct("event_id", text("<p>", F.col("event_type"), "</p>").alias("p"))
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(line))["p"], "").alias("content"))
    return html_tree.document_text(pages.select(F.col("user_id").cast("string").alias("ref"), "content"))


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, n_name AS text, 2::INTEGER AS level FROM nation""")
def tagged_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return headings.headings(_nation_pages(spark, sf_dir)).where("text like 'NATION%'").select("ref", "text", F.lit(2).alias("level"))


def _wide_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table per supplier with ten columns that tell a different amount, a row for each of three items."""
    cell = lambda i: F.when(F.col("s_suppkey") % 10 == i, "").when(F.lit(i % 4 == 3), "x").otherwise(text("c", F.lit(str(i)), "-", F.col("s_suppkey").cast("string")))
    row = text("<tr>", *[x for i in range(10) for x in ("<td>", cell(i), "</td>")], "</tr>")
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), text("<table>", row, row, row, "</table>").alias("content"))


@query("""WITH c AS (SELECT s_suppkey, i, CASE WHEN s_suppkey % 10 = i THEN 0 WHEN i % 4 = 3 THEN 3 ELSE 9 END AS total FROM supplier CROSS JOIN range(10) t(i)), r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY total DESC, i) AS k FROM c WHERE total >= 1.5)
SELECT CAST(s_suppkey AS VARCHAR) AS ref, i::INTEGER AS col, total::INTEGER AS total FROM r WHERE k <= 8""")
def telling_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.shown_columns(html_tree.cells(_wide_tables(spark, sf_dir))).select("ref", "col", "total")


@query("""WITH c AS (SELECT s_suppkey, i, CASE WHEN s_suppkey % 10 = i THEN 0 WHEN i % 4 = 3 THEN 3 ELSE 9 END AS total, CASE WHEN i % 4 = 3 THEN 'x' ELSE 'c' || i || '-' || s_suppkey END AS t FROM supplier CROSS JOIN range(10) t(i)),
r AS (SELECT *, row_number() OVER (PARTITION BY s_suppkey ORDER BY total DESC, i) AS k FROM c WHERE total >= 1.5), l AS (SELECT s_suppkey, string_agg(t, '  ' ORDER BY i) AS line, string_agg(repeat('-', length(t)), '  ' ORDER BY i) AS rule FROM r WHERE k <= 8 GROUP BY 1)
SELECT CAST(s_suppkey AS VARCHAR) AS ref, 'GENERAL' AS type, line || chr(10) || rule || chr(10) || line || chr(10) || line AS text FROM l""")
def rendered_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.document_tables(_wide_tables(spark, sf_dir)).select("ref", "type", "text")


@query("""SELECT CAST(n_regionkey AS VARCHAR) AS ref, 'Total ' || n_name AS label FROM nation""")
def table_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = text("<tr><td>", F.col("n_name"), "</td><td>1</td></tr><tr><td>Total ", F.col("n_name"), "</td><td>$ 5</td></tr>")
    pages = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(text("<table>", F.array_join(F.collect_list(row), ""), "</table>").alias("content"))
    return html_tree.total_rows(html_tree.cells(pages.select(F.col("n_regionkey").cast("string").alias("ref"), "content"))).select("ref", "label")


def _annual_reports(spark: SparkSession, sf_dir: str, way: str) -> DataFrame:
    """A report per customer with items 1 and 7: by headings, by a linked table of contents, or by neither."""
    key = F.col("c_custkey").cast("string")
    item = lambda n, title, body: text("<p", f' id="i{n}"' if way == "contents" else "", "><b>Item ", n, ". ", title, "</b></p><p>", body, "</p>")
    links = '<table><tr><td><a href="#i1">Item 1.</a></td><td><a href="#i1">Business</a></td></tr><tr><td><a href="#i7">Item 7.</a></td><td><a href="#i7">Discussion</a></td></tr></table>' if way == "contents" else ""
    page = text("<html><body>", links, item("1", "Business", text("We sell to ", F.col("c_name"))), item("7", "Discussion", text("Segment ", F.col("c_mktsegment"))), "</body></html>")
    return table(spark, sf_dir, "customer").select(key.alias("ref"), page.alias("content"))


SECTIONS = "SELECT CAST(c_custkey AS VARCHAR) AS ref, unnest(['1', '7']) AS item, unnest(['Item 1. Business' || chr(10) || 'We sell to ' || c_name, 'Item 7. Discussion' || chr(10) || 'Segment ' || c_mktsegment]) AS text FROM customer"


@query(f"SELECT *, 'pattern' AS method FROM ({SECTIONS})")
def sections_by_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(_annual_reports(spark, sf_dir, "headings")).select("ref", "item", "text", "method")


@query(f"SELECT *, 'toc' AS method FROM ({SECTIONS})")
def sections_by_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.sections(_annual_reports(spark, sf_dir, "contents")).select("ref", "item", "text", "method")


@query(SECTIONS)
def pattern_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.pattern_sections(_annual_reports(spark, sf_dir, "headings")).select("ref", "item", "text")


@query(f"SELECT ref, text FROM ({SECTIONS}) WHERE item = '7'")
def section_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.section(_annual_reports(spark, sf_dir, "contents"), "mda")


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ref, unnest(['I', 'II']) AS part, '1' AS item, unnest(['Item 1. Financial Statements' || chr(10) || c_name, 'Item 1. Legal Proceedings' || chr(10) || c_mktsegment]) AS text FROM customer""")
def quarterly_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = text("<p>PART I</p><p><b>Item 1. Financial Statements</b></p><p>", F.col("c_name"), "</p><p>PART II</p><p><b>Item 1. Legal Proceedings</b></p><p>", F.col("c_mktsegment"), "</p>")
    found = sections.pattern_sections(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("ref"), page.alias("content")), "10-Q")
    return found.select("ref", "part", "item", F.regexp_replace("text", "\nPART II$", "").alias("text"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, unnest(['Corporate Structure', 'Risk Factors']) AS item, unnest(['CORPORATE STRUCTURE ' || s_name || repeat(' word', 60), 'RISK FACTORS risk ' || s_suppkey]) AS text FROM supplier""")
def aif_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    front = "front matter " * 500
    page = text("<p>", F.lit(front), "</p><p>see RISK FACTORS</p><h2>CORPORATE STRUCTURE</h2><p>", F.col("s_name"), F.lit(" word" * 60), "</p><h2>RISK FACTORS</h2><p>risk ", F.col("s_suppkey").cast("string"), "</p>")
    return sections.aif_sections(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("ref"), page.alias("content"))).select("ref", "item", "text")


@query("""SELECT CAST(p_partkey AS VARCHAR) AS ref, CASE WHEN p_retailprice >= 1000 THEN 1 ELSE 0 END::INTEGER AS col, [0, 0, p_size::INTEGER] AS indents FROM part WHERE p_size > 0""")
def numeric_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A figure with a thousands comma over two columns stands in the second one; rows are indented as their first cell is."""
    price = F.format_number("p_retailprice", 2)
    page = text("<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr><tr><td colspan=2>", F.repeat(F.lit(" "), F.col("p_size")), price, "</td><td>z</td></tr></table>")
    found = html_tree.document_tables(table(spark, sf_dir, "part").where("p_size > 0").select(F.col("p_partkey").cast("string").alias("ref"), page.alias("content")))
    return found.select("ref", F.when(F.get(F.get("grid", F.lit(2)), F.lit(0)) == "", 1).otherwise(0).alias("col"), "indents")


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS ref, 'First of ' || s_suppkey || '.' AS text FROM supplier""")
def shortened_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without tables, cut behind the first sentence, which ends in the last fifth of what fits; 13 characters hold keys of three digits, longer ones get room for theirs."""
    key = F.col("s_suppkey").cast("string")
    page = text("<table><tr><td>left out</td></tr></table><p>First of ", key, ". ", F.lit("second part and more " * 5), "</p>")
    return html_tree.document_text(table(spark, sf_dir, "supplier").select(key.alias("ref"), page.alias("content")), tables=False, most=F.greatest(F.lit(13), F.length("ref") + 10))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS ref, 2::INTEGER AS entries, true AS before_sections FROM customer""")
def contents_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _annual_reports(spark, sf_dir, "contents")
    first = sections.contents_sections(docs).groupBy("ref").agg(F.min("place").alias("first"))
    return sections.contents_bounds(docs).join(first, "ref").select("ref", "entries", (F.col("start") < F.col("stop")).alias("ordered"), (F.col("stop") <= F.col("first")).alias("before")).select("ref", "entries", F.expr("ordered and before").alias("before_sections"))
