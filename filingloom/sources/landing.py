"""Filings in a landing folder: what a fetcher has stored, as the engine's tables.

``filings_index`` is a Python data source over an index of stored documents,
one JSON object a line; Spark's filters on system and kind reach the reader,
and each index file is a partition.  Adapters for other systems register under
their name.
"""

from __future__ import annotations

import datetime
import io
import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from filingloom.operators.listing import document_kind, instance_file
from filingloom.schemas import FILING, HANDLE

Adapter = Callable[[DataFrame], DataFrame]
_ADAPTERS: dict[str, Adapter] = {}


def register(system: str, adapter: Adapter) -> None:
    """Name the function that turns stored files (path, content) of a system into filings."""
    _ADAPTERS[system] = adapter


def adapters() -> dict[str, Adapter]:
    from filingloom.sources import packages

    return {"esef": packages.report_filings, "companies_house": packages.account_filings} | _ADAPTERS


def read_filings(files: DataFrame, system: str) -> DataFrame:
    """Filings of a system from its stored files."""
    known = adapters()
    if system not in known:
        raise ValueError(f"no adapter for {system!r}; there are {sorted(known)}")
    return known[system](files)


class IndexPartition(InputPartition):
    def __init__(self, path: str) -> None:
        super().__init__(path)
        self.path = path


class IndexReader(DataSourceReader):
    """Reads handles from JSON lines; equality filters drop rows before they reach Spark."""

    def __init__(self, options: dict[str, str]) -> None:
        self.paths = [p for p in options.get("paths", options.get("path", "")).split(",") if p]
        self.equal: dict[str, object] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in ("system", "entity_value", "country"):
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        return [IndexPartition(p) for p in self.paths]

    def read(self, partition: IndexPartition) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in HANDLE.split(", ")]
        kinds = [pa.date32() if n == "period_end" else pa.string() for n in names]
        rows: list[list] = []
        for line in lines_of(partition.path):
            r = json.loads(line) if line.strip() else None
            if r and all(r.get(k) == v for k, v in self.equal.items()):
                r["period_end"] = datetime.date.fromisoformat(r["period_end"]) if r.get("period_end") else None
                rows.append([r.get(n) for n in names])
            if len(rows) == BATCH_ROWS:
                yield _batch(rows, names, kinds)
                rows = []
        if rows:
            yield _batch(rows, names, kinds)


BATCH_ROWS = 4_096


def _batch(rows: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def lines_of(path: str) -> Iterator[str]:
    """Lines of a file on any file system that Arrow opens by its address (local, hdfs, s3 and others)."""
    address = re.sub("^file:/+", "file:///", path)
    system, name = fs.FileSystem.from_uri(address) if re.match("[a-z0-9]+://", address) else (fs.LocalFileSystem(), path)
    with system.open_input_stream(name) as stream, io.TextIOWrapper(stream, encoding="utf-8") as text:
        yield from text


class FilingsIndex(DataSource):
    """``spark.read.format("filings_index").option("paths", "a.jsonl,b.jsonl")``"""

    @classmethod
    def name(cls) -> str:
        return "filings_index"

    def schema(self) -> str:
        return HANDLE

    def reader(self, schema: object) -> DataSourceReader:
        return IndexReader(self.options)


def register_sources(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilingsIndex)


def archive_filings(files: DataFrame, listing: DataFrame) -> DataFrame:
    """SEC filings from stored documents (ref, name, place, content) and their listing (cik, accession, document, flags).

    A listed inline document is taken, else the classic instance among the
    filing's files, else the plain document.
    """
    wanted = listing.select("cik", F.col("accession").alias("ref"), "document", document_kind(F.col("isInlineXBRL"), F.col("isXBRL")).alias("kind"))
    instances = instance_file(files)
    named = wanted.join(instances, "ref", "left").withColumn("name", F.when(F.col("kind") == "xbrl", F.col("instance")).otherwise(F.col("document")))
    rows = named.join(files.select("ref", "name", "content"), ["ref", "name"])
    columns = {"system": F.lit("sec"), "entity_scheme": F.lit("cik"), "entity_value": F.col("cik"), "document": F.col("name"), "url": F.concat(F.lit("landing:///"), F.col("ref"), F.lit("/"), F.col("name"))}
    return rows.withColumns(columns).select([c.split()[0] for c in FILING.split(", ")])


def save_filings(filings: DataFrame, path: str) -> None:
    """Documents as Parquet under the folder, by system and kind."""
    filings.write.mode("append").partitionBy("system", "kind").parquet(path)
