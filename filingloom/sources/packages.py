"""Archives and report packages: ZIP files read through Spark's binary reader.

An archive is one row, of 2 GB at most (Spark's binary reader refuses larger
files); its entries leave it one at a time.  Nothing is fetched: files lie in a
landing folder.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions.names import bulk_entry
from filingloom.operators.xbrl import identifier

ENTRY = "archive string, place int, name string, content binary"


def binary_files(spark: SparkSession, path: str, glob: str = "*.zip") -> DataFrame:
    """(path, content) of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "content")


def entries(files: DataFrame, pattern: str = "", *, with_content: bool = True) -> DataFrame:
    """Entries (schema ENTRY) of ZIP files (path, content) whose names match; folders and damaged archives give none.

    ``with_content=False`` lists names only and leaves the entries packed.
    """
    wanted = re.compile(pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                path, data = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                try:
                    archive = zipfile.ZipFile(io.BytesIO(data or b""))
                except zipfile.BadZipFile:
                    continue
                for place, info in enumerate(archive.infolist()):
                    if not info.is_dir() and wanted.search(info.filename):
                        content = archive.read(info) if with_content else None
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([place], pa.int32()), pa.array([info.filename]), pa.array([content], pa.binary())], ["archive", "place", "name", "content"])

    return files.select("path", "content").mapInArrow(run, ENTRY)


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def report_filings(files: DataFrame) -> DataFrame:
    """Filings of report packages: of the files under reports/ the first inline one, else the first instance."""
    found = entries(files, r"(?i)(?:^|/)reports/[^/].*\.(?:xhtml|html|xbrl|xml)$")
    inline = F.lower("name").rlike("\\.x?html$")
    first = found.groupBy("archive").agg(F.min_by(F.struct("name", "content"), F.struct((~inline).alias("later"), "place")).alias("r"))
    content = F.decode(F.col("r.content"), "UTF-8")
    rows = first.select("archive", "r.name", content.alias("content"))
    return rows.select(
        F.lit("esef").alias("system"), F.lit("lei").alias("entity_scheme"), identifier(F.col("content"), "17442").alias("entity_value"), base_name(F.col("archive")).alias("ref"),
        base_name(F.col("name")).alias("document"), F.col("archive").alias("url"), F.when(F.lower("name").rlike("\\.x?html$"), "ixbrl").otherwise("xbrl").alias("kind"), "content",
    )


def package_linkbases(files: DataFrame) -> DataFrame:
    """(ref, suffix, xml): the first presentation, label and calculation linkbase of each package."""
    found = entries(files, r"(?i)_(?:pre|lab|cal)(?:-[a-z]+)?\.xml$")
    suffix = F.regexp_extract(F.lower("name"), "_(pre|lab|cal)(?:-[a-z]+)?\\.xml$", 1)
    rows = found.select(base_name(F.col("archive")).alias("ref"), suffix.alias("suffix"), "place", "content")
    first = rows.groupBy("ref", "suffix").agg(F.min_by("content", "place").alias("content"))
    return first.select("ref", "suffix", F.decode("content", "UTF-8").alias("xml"))


# -- UK accounts -----------------------------------------------------------------

#: Canonical prefixes of the FRC taxonomy's namespaces, by their last segment.
CANONICAL = {"core": "uk-core", "business": "uk-bus", "direp": "uk-direp", "aurep": "uk-aurep", "countries": "uk-countries", "currencies": "uk-curr", "languages": "uk-lang"}


def canonical_prefixes(content: Column) -> Column:
    """map<prefix, canonical prefix> of the FRC namespaces that a document declares."""
    declared = F.regexp_extract_all(content, F.lit('xmlns:([A-Za-z0-9._-]+)\\s*=\\s*"[^"]*xbrl\\.frc\\.org\\.uk[^"]*/(?:core|business|direp|aurep|countries|currencies|languages)"'), F.lit(1))
    ends = F.regexp_extract_all(content, F.lit('xmlns:[A-Za-z0-9._-]+\\s*=\\s*"[^"]*xbrl\\.frc\\.org\\.uk[^"]*/(core|business|direp|aurep|countries|currencies|languages)"'), F.lit(1))
    known = F.create_map(*[F.lit(x) for item in CANONICAL.items() for x in item])
    from filingloom.operators.xbrl import small_map

    return small_map(F.zip_with(declared, ends, lambda p, e: F.struct(p.alias("key"), F.element_at(known, e).alias("value"))))


def canonical_concepts(facts: DataFrame, filings: DataFrame) -> DataFrame:
    """Facts whose concepts carry the canonical prefixes of their filing: concepts are told apart by namespace, not by the filer's prefix.

    Only the narrow concept column changes; documents aren't rewritten.
    """
    prefixes = filings.select(F.col("ref").alias("accession"), F.explode(canonical_prefixes(F.col("content"))).alias("prefix", "canonical")).distinct()
    split = facts.withColumn("prefix", F.substring_index("concept", ":", 1))
    joined = split.join(prefixes, ["accession", "prefix"], "left")
    concept = F.when(F.col("canonical").isNotNull(), F.concat("canonical", F.lit(":"), F.substring_index("concept", ":", -1))).otherwise(F.col("concept"))
    return joined.withColumn("concept", concept).select(facts.columns)


def account_filings(files: DataFrame) -> DataFrame:
    """Filings of accounts documents (path, content): a PDF becomes a filing without content, everything else is inline XBRL."""
    pdf = F.substring("content", 1, 4) == F.lit(b"%PDF")
    text = F.when(pdf, F.lit("")).otherwise(F.decode("content", "UTF-8"))
    return files.select(
        F.lit("companies_house").alias("system"), F.lit("companies_house").alias("entity_scheme"), identifier(text, "companieshouse").alias("entity_value"), base_name(F.col("path")).alias("ref"),
        base_name(F.col("path")).alias("document"), F.col("path").alias("url"), F.when(pdf, "pdf").otherwise("ixbrl").alias("kind"), text.alias("content"),
    )


def bulk_handles(files: DataFrame, *, company_number: str | None = None, limit: int | None = None) -> DataFrame:
    """Handles of the accounts documents in daily archives, without unpacking them."""
    rows = entries(files, r"(?i)\.html$", with_content=False).select("archive", "place", "name", bulk_entry(F.col("name")).alias("m")).where("m.number is not null")
    if company_number is not None:
        rows = rows.where(F.col("m.number") == company_number.strip())
    rows = rows.select(F.lit("companies_house").alias("system"), F.lit("companies_house").alias("entity_scheme"), F.col("m.number").alias("entity_value"), F.col("name").alias("ref"), F.col("archive").alias("url"), F.col("m.period_end").alias("period_end"), F.lit("GB").alias("country"))
    return rows if limit is None else rows.orderBy("url", "ref").limit(limit)


def bulk_filings(files: DataFrame) -> DataFrame:
    """Filings of all accounts documents in daily archives."""
    found = entries(files, r"(?i)_[A-Za-z0-9]+_\d{8}\.html$")
    rows = account_filings(found.select(F.col("name").alias("path"), "content", "archive"))
    number = bulk_entry(F.col("document"))["number"]
    return rows.withColumn("entity_value", F.coalesce(F.nullif("entity_value", F.lit("")), number))


def taxonomy_date(content: Column, host: str = "xbrl.ifrs.org/taxonomy") -> Column:
    """The date of the taxonomy that a document declares; null without one.  Label books are kept by this date."""
    found = F.regexp_extract(content, f"https?://{host}/(\\d{{4}}-\\d{{2}}-\\d{{2}})/", 1)
    return F.when(found != "", found)


def standard_labels(filings: DataFrame, books: DataFrame, host: str = "xbrl.ifrs.org/taxonomy") -> DataFrame:
    """(ref, concept, label): published labels (taxonomy_date, concept, label) for the taxonomy that each filing declares."""
    dated = filings.select("ref", taxonomy_date(F.col("content"), host).alias("taxonomy_date")).where("taxonomy_date is not null")
    return dated.join(books, "taxonomy_date").select("ref", "concept", "label")
