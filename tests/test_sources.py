import io
import json
import zipfile

from filingloom.operators import listing, xbrl
from filingloom.operators.warehouse import Warehouse
from filingloom.schemas import FILING
from filingloom.sources import landing, packages
from filingloom.streaming.ingest import filing_stream, ingest

UK = """<html xmlns:ns5="http://xbrl.frc.org.uk/fr/2023-01-01/core" xmlns:b="http://xbrl.frc.org.uk/cd/2023-01-01/business"><xbrli:identifier scheme="http://www.companieshouse.gov.uk/">99999999</xbrli:identifier>
<xbrli:context id="c"><xbrli:period><xbrli:instant>2023-12-31</xbrli:instant></xbrli:period></xbrli:context><xbrli:unit id="u"><xbrli:measure>iso4217:GBP</xbrli:measure></xbrli:unit>
<ix:nonFraction name="ns5:Equity" contextRef="c" unitRef="u" format="ixt2:numdotdecimal">1,000</ix:nonFraction></html>"""


def archive(entries):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return data.getvalue()


def test_report_packages(spark, tmp_path):
    instance = '<xbrl><identifier scheme="http://standards.iso.org/iso/17442">506700GE1G29325QX363</identifier></xbrl>'
    (tmp_path / "one.zip").write_bytes(archive({"p/META-INF/x.xml": "no", "p/reports/a.xbrl": "classic", "p/reports/b.xhtml": instance, "p/tax/t_pre.xml": "PRE", "p/tax/t_lab-en.xml": "LAB"}))
    (tmp_path / "two.zip").write_bytes(archive({"reports/c.xbrl": instance}))
    (tmp_path / "bad.zip").write_bytes(b"not a zip")
    files = packages.binary_files(spark, str(tmp_path))
    got = {r.ref: r for r in packages.report_filings(files).collect()}
    assert set(got) == {"one.zip", "two.zip"}
    assert (got["one.zip"].document, got["one.zip"].kind, got["one.zip"].entity_value) == ("b.xhtml", "ixbrl", "506700GE1G29325QX363") and got["two.zip"].kind == "xbrl"
    assert {(r.ref, r.suffix, r.xml) for r in packages.package_linkbases(files).collect()} == {("one.zip", "pre", "PRE"), ("one.zip", "lab", "LAB")}
    assert landing.read_filings(files, "esef").count() == 2


def test_uk_accounts(spark, tmp_path):
    (tmp_path / "day.zip").write_bytes(archive({"Prod223_4245_99999999_20251231.html": UK, "readme.txt": "x", "Prod223_4245_11111111_20250630.html": "%PDF-1.4"}))
    files = packages.binary_files(spark, str(tmp_path))
    handles = packages.bulk_handles(files).orderBy("ref").collect()
    assert [(h.entity_value, str(h.period_end)) for h in handles] == [("11111111", "2025-06-30"), ("99999999", "2025-12-31")]
    assert packages.bulk_handles(files, company_number=" 99999999 ", limit=5).count() == 1
    filings = packages.bulk_filings(files)
    assert {(r.entity_value, r.kind) for r in filings.collect()} == {("99999999", "ixbrl"), ("11111111", "pdf")}
    facts = packages.canonical_concepts(xbrl.facts(filings), filings).collect()
    assert [(f.concept, f.value, f.unit) for f in facts] == [("uk-core:Equity", 1000.0, "GBP")]
    books = spark.createDataFrame([("2023-01-01", "uk-core:Equity", "Equity")], "taxonomy_date string, concept string, label string")
    assert packages.standard_labels(filings, books, "xbrl.frc.org.uk/fr").first().label == "Equity"


def test_index_source(spark, tmp_path):
    rows = [{"system": "sec", "entity_value": "1", "ref": "a", "period_end": "2024-01-31"}, {"system": "esef", "entity_value": "2", "ref": "b"}]
    paths = []
    for i, r in enumerate(rows):
        (tmp_path / f"{i}.jsonl").write_text(json.dumps(r) + "\n\n")
        paths.append(str(tmp_path / f"{i}.jsonl"))
    landing.register_sources(spark)
    index = spark.read.format("filings_index").option("paths", ",".join(paths)).load()
    assert spark.read.format("filings_index").option("paths", f"file:{paths[0]},file://{paths[1]}").load().count() == 2
    assert index.count() == 2 and [r.ref for r in index.where("system = 'esef'").collect()] == ["b"]


def test_stored_sec_filings(spark):
    files = spark.createDataFrame([("a", 0, "x_htm.xml", "I"), ("a", 1, "x.htm", "H"), ("a", 2, "x_pre.xml", "P"), ("b", 0, "y_lab.xml", "L"), ("b", 1, "y.xml", "Y"), ("b", 2, "y.htm", "H")], "ref string, place int, name string, content string")
    listed = spark.createDataFrame([("0000000001", "a", "x.htm", True, True), ("0000000001", "b", "y.htm", False, True)], "cik string, accession string, document string, isInlineXBRL boolean, isXBRL boolean")
    got = {r.ref: (r.kind, r.document, r.content) for r in landing.archive_filings(files, listed).collect()}
    assert got == {"a": ("ixbrl", "x.htm", "H"), "b": ("xbrl", "y.xml", "Y")}
    assert listing.linkbase_file(files, "pre").first().file == "x_pre.xml"


def test_stream_ingests_once(spark, tmp_path):
    row = ("companies_house", "companies_house", "99999999", "r1", "r1.html", "u", "ixbrl", UK)
    source, store = f"{tmp_path}/in", f"file://{tmp_path}/store"
    spark.createDataFrame([row], FILING).write.mode("append").parquet(source)
    for _ in range(2):
        spark.createDataFrame([row, (*row[:3], "r2", *row[4:])], FILING).write.mode("append").parquet(source)
        query = ingest(filing_stream(spark, source, files_per_batch=1), store, f"{tmp_path}/checkpoint")
        query.awaitTermination(120)
    kept = Warehouse(spark, store)
    assert kept.table("documents").count() == 2 and kept.table("facts").count() == 2


def test_a_batch_that_fails_leaves_the_table(spark, tmp_path):
    from pyspark.sql import functions as F

    store = Warehouse(spark, f"file://{tmp_path}/store")
    row = ("companies_house", "companies_house", "99999999", "r1", "r1.html", "u", "ixbrl", UK)
    filings = spark.createDataFrame([row], FILING)
    assert store.add_documents(filings) == 1 and store.add_documents(filings) == 0
    more = spark.createDataFrame([(*row[:3], f"r{i}", *row[4:]) for i in range(2, 40)], FILING).repartition(8, "ref")
    broken = more.withColumn("document", F.when(F.col("ref") == "r31", F.raise_error(F.lit("lost"))).otherwise(F.col("document")))
    before = sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet"))
    try:
        store.add_documents(broken)
        raise AssertionError("the batch should have failed")
    except Exception as e:
        assert "lost" in str(e)
    assert sorted(str(p) for p in (tmp_path / "store").rglob("*.parquet")) == before and store.table("documents").count() == 1
    assert store.add_documents(more) == 38 and store.table("documents").count() == 39 and not list((tmp_path / "store").glob("_staged*"))


def test_schema_marker(spark, tmp_path):
    store = Warehouse(spark, f"file://{tmp_path}/store")
    row = ("companies_house", "companies_house", "99999999", "r1", "r1.html", "u", "ixbrl", UK)
    assert store.version() is None and store.add_documents(spark.createDataFrame([row], FILING)) == 1
    assert store.version() == Warehouse(spark, f"file://{tmp_path}/store").version() is not None
    (tmp_path / "store" / "_schema" / "999").mkdir()
    try:
        store.add_documents(spark.createDataFrame([row], FILING))
        raise AssertionError("another version should be refused")
    except ValueError as e:
        assert "999" in str(e)


def test_other_sources(spark):
    from filingloom.operators import parity

    day = "date'2024-12-31'"
    facts = spark.sql(f"""select * from values ('a', 'c:X', 'USD', {day}, '{{}}', 'k1', 'u', 100.0), ('a', 'c:X', 'USD', date_add({day}, 1), '{{}}', 'k0', 'u', 7.0), ('a', 'c:Y', 'USD/shares', {day}, '{{}}', 'k', 'u', 0.5),
      ('a', 'c:Z', 'USD', {day}, '{{"d":"m"}}', 'k', 'u', 3.0) as t(accession, concept, unit, period_end, dimensions, context_ref, unit_ref, value)""")
    asked = spark.sql(f"""select * from values ('a', 'c:X', 'iso4217:USD', {day}, 100.005), ('a', 'c:X', 'USD', date_add({day}, 2), 7.5), ('a', 'c:Y', 'iso4217:USD/xbrli:shares', null, 0.50001), ('a', 'c:Z', 'USD', {day}, 3.0), ('b', 'c:X', 'USD', {day}, 1.0)
      as t(accession, concept, unit, period_end, value)""")
    got = {(r.accession, r.concept, str(r.period_end)): (r.value, r.match) for r in parity.against_reference(facts, asked).collect()}
    assert got == {("a", "c:X", "2024-12-31"): (100.0, True), ("a", "c:X", "2025-01-02"): (7.0, False), ("a", "c:Y", "None"): (0.5, True), ("a", "c:Z", "2024-12-31"): (None, False), ("b", "c:X", "2024-12-31"): (None, False)}


def test_listings(spark):
    hits = '{"hits":{"hits":[{"_id":"0001-24-1:doc.htm","_score":2.5,"_source":{"ciks":["0000000001"],"display_names":["Acme Corp  (ACM)  (CIK 0000000001)"],"form":"10-K","period_ending":"2024-01-31","file_date":"2024-03-01","adsh":"0001-24-1"}}]}}'
    (hit,) = listing.search_hits(spark.createDataFrame([(hits,)], "json string")).collect()
    assert (hit.entity, hit.document, hit.score) == ("Acme Corp", "doc.htm", 2.5)
    index = '{"data":[{"id":"9","attributes":{"package_url":"/x.zip","period_end":"2023-12-31","fxo_id":"F","country":"FI"},"relationships":{"entity":{"data":{"id":"e"}}}},{"id":"8","attributes":{"package_url":""}}],"included":[{"type":"entity","id":"e","attributes":{"identifier":"LEI"}}]}'
    rows = listing.report_handles(spark.createDataFrame([(index,)], "json string"), year=2023, base="http://b").collect()
    assert [(r.entity_value, r.ref, r.url) for r in rows] == [("LEI", "F", "http://b/x.zip")]
    docs = spark.createDataFrame([("a", i, *d) for i, d in enumerate([("40-F", "m.htm", "", 10), ("EX-99.1", "x1.htm", "FINANCIALS", 200_000), ("EX-99.2", "aif2024.htm", "", 5), ("GRAPHIC", "g.jpg", "", 1)])], "ref string, place int, type string, filename string, description string, size int")
    assert listing.annual_information_form(docs).first().filename == "aif2024.htm"
    assert listing.exhibits(docs, spark.createDataFrame([("a", "m.htm")], "ref string, document string")).count() == 2
    filing = spark.createDataFrame([("a", '<img src="./logo.PNG"><a href="http://x/y.png"><link href="s.css"><img src="logo.png?x"><img src="./logo.PNG">')], "ref string, content string")
    assert sorted(r.asset for r in listing.assets(filing).collect()) == ["logo.PNG", "logo.png", "s.css"]


def test_exports(spark, tmp_path):
    from filingloom.sources import export, facts_json

    pick = '{"version":1,"provenance":{"cik":"1","accession":"a-1","url":"u"},"selector":"#t > td","kind":"prose","text":"one\\n \\n\\n two","html":"<p>x</p>","facts":[{"concept":"c","value":"5","contextRef":"x","unitRef":"u","periodEnd":"2024-01-31"}]}'
    picks = facts_json.read_picks(spark.createDataFrame([(pick,)], "json string"))
    assert tuple(export.exported(picks, "ixbrl").first()) == ("a-1_t-td.ixbrl.html", "<p>x</p>")
    assert export.exported(picks, "markdown").first().content.endswith("\n\none\n\ntwo")
    assert json.loads(export.exported(picks, "facts").first().content)["facts"][0]["value"] == 5.0
    assert export.save(picks, "markdown", f"{tmp_path}/out") == 1 and (tmp_path / "out" / "name=a-1_t-td.md").is_dir()
    assert export.save(picks, "warehouse", f"{tmp_path}/store") == 1 and export.save(picks, "warehouse", f"{tmp_path}/store") == 0
