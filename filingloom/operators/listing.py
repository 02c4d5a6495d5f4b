"""Listings of filings and filers: JSON endpoints' payloads and search.

The engine fetches nothing: payloads lie in a landing folder and are read as
text or JSON.  Each function takes the payload table and returns rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import names

RECENT = "accessionNumber array<string>, reportDate array<string>, filingDate array<string>, acceptanceDateTime array<string>, form array<string>, primaryDocument array<string>, isXBRL array<int>, isInlineXBRL array<int>, isXBRLNumeric array<int>"
SUBMISSIONS = (
    "cik string, name string, entityType string, sic string, sicDescription string, fiscalYearEnd string, stateOfIncorporation string, tickers array<string>, exchanges array<string>, "
    f"ein string, category string, website string, description string, formerNames array<struct<name: string>>, filings struct<recent: struct<{RECENT.replace(' array', ': array').replace(', ', ', ')}>, files: array<struct<name: string>>>"
)
PROFILE = ["name", "entityType", "sic", "sicDescription", "fiscalYearEnd", "stateOfIncorporation", "ein", "category", "website", "description"]
FIRST_DAY, LAST_DAY = "2001-01-01", "2099-12-31"


def profile(submissions: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per filer; missing texts are empty, missing lists too."""
    d = submissions.select(F.from_json(F.col(json_col), SUBMISSIONS).alias("d")).select("d.*")
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in PROFILE]
    lists = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("tickers", "exchanges")]
    former = F.coalesce(F.transform("formerNames", lambda n: F.coalesce(n["name"], F.lit(""))), F.array().cast("array<string>")).alias("formerNames")
    return d.select(names.cik(F.col("cik")).alias("cik"), *texts, *lists, former)


def recent_filings(submissions: DataFrame, json_col: str = "json") -> DataFrame:
    """One row per filing of the recent window: cik, accession, dates, form, document and XBRL flags."""
    d = submissions.select(F.from_json(F.col(json_col), SUBMISSIONS).alias("d"))
    arrays = [c.split()[0] for c in RECENT.split(", ")]
    rows = d.select(F.col("d.cik").alias("cik"), F.explode(F.arrays_zip(*[F.col(f"d.filings.recent.{a}").alias(a) for a in arrays])).alias("f"))
    return _filing_columns(rows.select(names.cik(F.col("cik")).alias("cik"), "f.*"))


def older_filings(pages: DataFrame, json_col: str = "json") -> DataFrame:
    """The same rows from overflow pages (cik, json)."""
    arrays = [c.split()[0] for c in RECENT.split(", ")]
    rows = pages.select("cik", F.from_json(F.col(json_col), RECENT).alias("p"))
    rows = rows.select("cik", F.explode(F.arrays_zip(*[F.col(f"p.{a}").alias(a) for a in arrays])).alias("f"))
    return _filing_columns(rows.select(names.cik(F.col("cik")).alias("cik"), "f.*"))


def _filing_columns(rows: DataFrame) -> DataFrame:
    flag = lambda c: (F.col(c) == 1).alias(c)
    return rows.select("cik", "form", "reportDate", F.col("filingDate").alias("filed"), "acceptanceDateTime", F.col("accessionNumber").alias("accession"), F.col("primaryDocument").alias("document"), flag("isXBRL"), flag("isInlineXBRL"), flag("isXBRLNumeric"))


def document_kind(inline: Column, xbrl: Column) -> Column:
    """The document that stands for a filing: inline XBRL, else the classic instance, else plain HTML."""
    return F.when(F.coalesce(inline, F.lit(False)), "ixbrl").when(F.coalesce(xbrl, F.lit(False)), "xbrl").otherwise("html")


def archive_folder(cik: Column, accession: Column) -> Column:
    return F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), cik.cast("bigint").cast("string"), F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")))


def instance_file(files: DataFrame, *, ref: str = "ref", name: str = "name") -> DataFrame:
    """The classic instance among a filing's files: an .xml that is no linkbase, one ending _htm.xml before others."""
    low = F.lower(name)
    rows = files.where(low.endswith(".xml") & ~low.rlike("_(cal|def|lab|pre|ref)\\.xml$"))
    place = "place" if "place" in files.columns else name
    return rows.groupBy(ref).agg(F.min_by(name, F.struct((~low.endswith("_htm.xml")).alias("plain"), F.col(place))).alias("instance"))


def linkbase_file(files: DataFrame, suffix: str, *, ref: str = "ref", name: str = "name") -> DataFrame:
    """The first file of a filing that ends _<suffix>.xml."""
    place = "place" if "place" in files.columns else name
    return files.where(F.lower(name).endswith(f"_{suffix}.xml")).groupBy(ref).agg(F.min_by(name, place).alias("file"))


def search_hits(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """Rows of a search response: cik, entity, form, reportDate, filed, accession, document, score."""
    source = "struct<ciks: array<string>, display_names: array<string>, form: string, period_ending: string, file_date: string, adsh: string>"
    schema = f"hits struct<hits: array<struct<_id: string, _score: double, _source: {source}>>>"
    hits = payloads.select(F.posexplode(F.from_json(F.col(json_col), schema)["hits"]["hits"]).alias("place", "h"))
    text = lambda c: F.coalesce(F.col(f"h._source.{c}"), F.lit(""))
    head = lambda c: F.coalesce(F.get(F.col(f"h._source.{c}"), F.lit(0)), F.lit(""))
    return hits.select("place", head("ciks").alias("cik"), names.entity_name(head("display_names")).alias("entity"), text("form").alias("form"), text("period_ending").alias("reportDate"), text("file_date").alias("filed"), text("adsh").alias("accession"), F.substring_index("h._id", ":", -1).alias("document"), F.col("h._score").alias("score"))


def filings_of(hits: DataFrame, filings: DataFrame) -> DataFrame:
    """A filer's hits with the submissions' fields; null for filings that aren't listed there."""
    known = filings.groupBy("accession").agg(*[F.first(c).alias(c) for c in ("acceptanceDateTime", "isXBRL", "isInlineXBRL", "isXBRLNumeric")])
    return hits.join(known, "accession", "left").select("form", "reportDate", "filed", "acceptanceDateTime", "accession", "document", "isXBRL", "isInlineXBRL", "isXBRLNumeric")


def between(day: Column, start: str | None, end: str | None) -> Column:
    """Date filter; one bound alone is completed by the edge of the coverage."""
    if start is None and end is None:
        return F.lit(True)
    return day.between(start or FIRST_DAY, end or LAST_DAY)


def full_text_search(docs: DataFrame, query: str, *, exact: bool = True, forms: list[str] | None = None, start: str | None = None, end: str | None = None, offset: int = 0, page: int | None = 100, text_col: str = "text", form_col: str = "form", day_col: str = "filed", order: str = "doc_id") -> DataFrame:
    """Documents that hold the phrase (or, not exact, all its words), with the number of occurrences as score.

    Pages are ordered by score, then by ``order``; page=None returns all.
    """
    low = F.lower(F.col(text_col))
    phrase = query.strip('"').lower()
    if exact:
        occurrences = (F.length(low) - F.length(F.replace(low, F.lit(phrase), F.lit("")))) / F.lit(max(1, len(phrase)))
        rows = docs.where(F.contains(low, F.lit(phrase))).withColumn("score", occurrences.cast("double"))
    else:
        words = phrase.split()
        found = F.lit(True)
        score = F.lit(0.0)
        for w in words:
            found = found & F.contains(low, F.lit(w))
            score = score + (F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / F.lit(len(w))
        rows = docs.where(found).withColumn("score", score)
    if forms:
        rows = rows.where(F.col(form_col).isin(*forms))
    if start or end:
        rows = rows.where(between(F.col(day_col), start, end))
    return rows if page is None else rows.orderBy(F.desc("score"), order).offset(offset).limit(page)


def tickers(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """(entity, ticker, cik) of the ticker file."""
    rows = payloads.select(F.explode(F.map_values(F.from_json(F.col(json_col), "map<string, struct<cik_str: string, ticker: string, title: string>>"))).alias("v"))
    return rows.select(F.col("v.title").alias("entity"), F.col("v.ticker").alias("ticker"), names.cik(F.col("v.cik_str")).alias("cik"))


def lookup(table: DataFrame, entity: str, by: str = "any") -> DataFrame:
    """Filers whose name holds the text, or whose ticker equals it, without case."""
    text = entity.strip()
    by_name = F.contains(F.lower("entity"), F.lit(text.lower()))
    by_ticker = F.upper("ticker") == text.upper()
    if by not in ("any", "name", "ticker"):
        raise ValueError("`by` is any, name or ticker")
    return table.where({"any": by_name | by_ticker, "name": by_name, "ticker": by_ticker}[by])


def company_facts(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """Every reported value of filers: cik, taxonomy, tag, label, unit and the value's fields."""
    value = "struct<`start`: string, `end`: string, val: double, accn: string, fy: int, fp: string, form: string, filed: string, frame: string>"
    schema = f"cik bigint, entityName string, facts map<string, map<string, struct<label: string, description: string, units: map<string, array<{value}>>>>>"
    rows = payloads.select(F.from_json(F.col(json_col), schema).alias("d")).select(names.cik(F.col("d.cik")).alias("cik"), F.explode("d.facts").alias("taxonomy", "tags"))
    rows = rows.select("cik", "taxonomy", F.explode("tags").alias("tag", "t"))
    rows = rows.select("cik", "taxonomy", "tag", F.coalesce("t.label", F.lit("")).alias("label"), F.explode("t.units").alias("unit", "values"))
    rows = rows.select("cik", "taxonomy", "tag", "label", "unit", F.explode("values").alias("v"))
    date = lambda c: F.try_to_date(F.col(f"v.{c}"))
    return rows.select("cik", "taxonomy", "tag", "label", "unit", date("start").alias("period_start"), date("end").alias("period_end"), F.col("v.val").alias("value"), F.col("v.accn").alias("accession"), F.col("v.fy").alias("fy"), F.col("v.fp").alias("fp"), F.col("v.form").alias("form"), date("filed").alias("filed"), F.col("v.frame").alias("frame"))


def company_concept(facts: DataFrame, cik: str, taxonomy: str, tag: str) -> DataFrame:
    return facts.where((F.col("cik") == f"{int(cik):010d}") & (F.col("taxonomy") == taxonomy) & (F.col("tag") == tag))


def frames(facts: DataFrame, taxonomy: str, tag: str, unit: str, period: str) -> DataFrame:
    """One value per filer for a calendar frame; of several filings the last filed counts."""
    rows = facts.where((F.col("taxonomy") == taxonomy) & (F.col("tag") == tag) & (F.col("unit") == unit))
    rows = rows.withColumn("frame", names.frame_of(F.col("period_start"), F.col("period_end"), F.col("period_start").isNull())).where(F.col("frame") == period)
    return rows.groupBy("cik", "frame").agg(F.max_by("value", F.struct("filed", "accession")).alias("value"), F.max(F.struct("filed", "accession"))["accession"].alias("accession"))


def report_handles(payloads: DataFrame, *, year: int | None = None, base: str = "", json_col: str = "json") -> DataFrame:
    """Handles (schema HANDLE) of a report index's pages: filings left-joined with the entities they include."""
    schema = (
        "data array<struct<id: string, attributes: struct<package_url: string, period_end: string, fxo_id: string, country: string>, "
        "relationships: struct<entity: struct<data: struct<id: string>>>>>, included array<struct<type: string, id: string, attributes: struct<identifier: string>>>"
    )
    d = payloads.select(F.from_json(F.col(json_col), schema).alias("d"))
    entities = d.select(F.explode("d.included").alias("e")).where("e.type = 'entity'").groupBy(F.col("e.id").alias("entity_id")).agg(F.max("e.attributes.identifier").alias("identifier"))
    filings = d.select(F.explode("d.data").alias("f")).select(F.col("f.relationships.entity.data.id").alias("entity_id"), "f.id", "f.attributes.*").where("coalesce(package_url, '') <> ''")
    period = F.try_to_date("period_end")
    rows = filings.join(entities, "entity_id", "left")
    if year is not None:
        rows = rows.where(F.year(period) == year)
    return rows.select(F.lit("esef").alias("system"), F.lit("lei").alias("entity_scheme"), F.coalesce("identifier", F.lit("")).alias("entity_value"), F.coalesce("fxo_id", "id").alias("ref"), F.concat(F.lit(base), "package_url").alias("url"), period.alias("period_end"), F.coalesce("country", F.lit("")).alias("country")).orderBy(F.desc_nulls_last("period_end"), "ref")


def account_handles(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """Handles of a registrar's filing history (company_number, json): the period is the made-up date, else the action's, else the item's."""
    item = "struct<transaction_id: string, action_date: string, date: string, category: string, description_values: struct<made_up_date: string>, links: struct<document_metadata: string>>"
    rows = payloads.select("company_number", F.explode(F.from_json(F.col(json_col), f"items array<{item}>")["items"]).alias("i")).where("coalesce(i.links.document_metadata, '') <> ''")
    period = F.coalesce(*[F.try_to_date(F.col(f"i.{c}")) for c in ("description_values.made_up_date", "action_date", "date")])
    return rows.select(F.lit("companies_house").alias("system"), F.lit("companies_house").alias("entity_scheme"), F.trim("company_number").alias("entity_value"), F.coalesce("i.transaction_id", F.lit("")).alias("ref"), F.col("i.links.document_metadata").alias("url"), period.alias("period_end"), F.lit("GB").alias("country")).orderBy(F.desc_nulls_last("period_end"), "ref")


def submission_documents(texts: DataFrame, sizes: DataFrame | None = None, *, ref: str = "ref", text_col: str = "text") -> DataFrame:
    """Documents of full submission texts: ref, place, type, filename, description, size."""
    blocks = F.regexp_extract_all(F.col(text_col), F.lit("(?is)<DOCUMENT>.*?(?:</DOCUMENT>|$)"), F.lit(0))
    rows = texts.select(ref, F.posexplode(blocks).alias("place", "block"))
    part = lambda tag: F.trim(F.regexp_extract("block", f"(?im)^<{tag}>([^\\r\\n<]*)", 1))
    rows = rows.select(ref, "place", part("TYPE").alias("type"), part("FILENAME").alias("filename"), F.upper(part("DESCRIPTION")).alias("description")).where("filename <> ''")
    if sizes is None:
        return rows.withColumn("size", F.lit(0))
    return rows.join(sizes.select(ref, F.col("name").alias("filename"), "size"), [ref, "filename"], "left").withColumn("size", F.coalesce("size", F.lit(0))).select(ref, "place", "type", "filename", "description", "size")


def exhibits(documents: DataFrame, primary: DataFrame, *, ref: str = "ref") -> DataFrame:
    """Attached documents but graphics and the primary one (ref, document)."""
    rows = documents.where("type <> '' and type <> 'GRAPHIC'")
    return rows.join(primary.select(ref, F.col("document").alias("filename")), [ref, "filename"], "left_anti")


def press_releases(documents: DataFrame) -> DataFrame:
    """HTML documents that are described as a release or filed as EX-99, EX-99.1 or EX-99.01."""
    return documents.where(F.col("filename").endswith(".htm") & (F.contains("description", F.lit("RELEASE")) | F.col("type").isin("EX-99.1", "EX-99", "EX-99.01")))


def assets(filings: DataFrame) -> DataFrame:
    """(ref, asset): relative references of a document to files that a browser shows, each once."""
    found = F.transform(F.regexp_extract_all(F.col("content"), F.lit("(?i)(?:src|href)\\s*=\\s*[\"']([^\"'#?]+)"), F.lit(1)), F.trim)
    rows = filings.select("ref", F.explode(F.array_distinct(found)).alias("asset"))
    elsewhere = F.col("asset").rlike("^(?:https?://|//|data:|mailto:)")
    known = F.lower("asset").rlike("\\.(?:jpe?g|png|gif|svg|webp|bmp|ico|css|js)$")
    return rows.where((F.col("asset") != "") & ~elsewhere & known).withColumn("asset", F.regexp_replace("asset", "^\\./", ""))


MAJOR_BYTES = 100_000
"""Size beyond which an exhibit counts as a major one."""


def annual_information_form(documents: DataFrame, heads: DataFrame | None = None, *, ref: str = "ref") -> DataFrame:
    """(ref, filename, rank): the document that holds a 40-F's annual information form.

    Asked in this order: an EX-1, a description that names the form, an EX-99
    named after it (aif before annual), a major EX-99 whose text shows the
    form's headings, the 40-F itself, the first major document.  The texts are
    only asked where ``heads`` (ref, filename, head) is given.
    """
    from filingloom.operators.forms import ANNUAL_INFORMATION

    rows = documents.where(F.col("filename").rlike("(?i)\\.x?html?$"))
    shown = F.lit(False)
    if heads is not None:
        rows = rows.join(heads.select(ref, "filename", "head"), [ref, "filename"], "left")
        shown = F.coalesce(F.col("head").rlike(f"(?i)(?:{'|'.join(ANNUAL_INFORMATION)})"), F.lit(False))
    supplement, major = F.col("type").startswith("EX-99"), F.col("size") > MAJOR_BYTES
    about, file = F.upper("description"), F.lower("filename")
    rank = (
        F.when(F.col("type").isin("EX-1", "EX-1.1", "EX-1.2"), 1)
        .when(F.contains(about, F.lit("ANNUAL INFORMATION")) | about.rlike("\\bAIF\\b"), 2)
        .when(supplement & F.contains(file, F.lit("aif")), 3)
        .when(supplement & F.contains(file, F.lit("annual")), 4)
        .when(supplement & major & shown, 5)
        .when(F.col("type").isin("40-F", "40-F/A"), 6)
        .when(major, 7)
    )
    return rows.withColumn("rank", rank).where("rank is not null").groupBy(ref).agg(F.min_by("filename", F.struct("rank", "place")).alias("filename"), F.min("rank").alias("rank"))
