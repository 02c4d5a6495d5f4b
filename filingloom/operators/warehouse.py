"""The fact warehouse: idempotent appends and statement views.

Tables are Parquet folders, dealt to buckets by filer.  An append removes
duplicates within the batch, anti-joins the keys that are stored already and
writes the rest; only keys of the buckets that the batch touches are read.
The number of new rows is counted from what was written.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingloom.functions.numbers import months as months_of
from filingloom.operators.xbrl import first_of
from filingloom.schemas import WAREHOUSE_DOCUMENT, WAREHOUSE_EXTRACTION, WAREHOUSE_FACT

SCHEMA_VERSION = 4
MARKER = "_schema"
KEYS = {"facts": ["fact_key"], "documents": ["accession", "document"], "extractions": ["accession", "selector"]}
SCHEMAS = {"facts": WAREHOUSE_FACT, "documents": WAREHOUSE_DOCUMENT, "extractions": WAREHOUSE_EXTRACTION}


def fact_key() -> Column:
    """Identity of a fact whatever its source: filer, filing, concept, unit, period and dimensions."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat_ws("|", *[text(c) for c in ("cik", "accession", "concept", "unit", "period_start", "period_end", "is_instant", "dimensions")])


def fact_rows(facts: DataFrame, source: str = "picker") -> DataFrame:
    """Facts as warehouse rows; form, fy, fp and frame stay null for filings."""
    none = {"form": "string", "fy": "int", "fp": "string", "frame": "string"}
    rows = facts.withColumn("fact_key", fact_key()).withColumn("source", F.lit(source))
    for name, kind in none.items():
        if name not in rows.columns:
            rows = rows.withColumn(name, F.lit(None).cast(kind))
    return rows.select([c.split()[0] for c in WAREHOUSE_FACT.split(", ")])


FILER_BUCKETS = 256
"""Folders that a stored table is dealt to by filer."""


def bucket_of(cik: Column) -> Column:
    return F.pmod(F.xxhash64(cik), F.lit(FILER_BUCKETS)).cast("int")


def new_rows(batch: DataFrame, stored: DataFrame | None, keys: Sequence[str], order: Sequence[str | Column] = ()) -> DataFrame:
    """Rows of a batch whose keys aren't stored; of equal keys the first in the given order."""
    one = first_of(batch, list(keys), list(order) or [F.monotonically_increasing_id()])
    return one if stored is None else one.join(stored.select(*keys), list(keys), "left_anti")


class Warehouse:
    """Fact, document and extraction tables under one folder."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def version(self) -> int | None:
        """The schema version that the folder was written with; None for a new one."""
        marker = self._path(f"{self.path}/{MARKER}")
        if not self._fs.exists(marker):
            return None
        names = [f.getPath().getName() for f in self._fs.listStatus(marker)]
        return max(int(n) for n in names)

    def _mark(self) -> None:
        """Marks a new folder with the schema version; another version than this is an error."""
        found = self.version()
        if found is None:
            self._fs.mkdirs(self._path(f"{self.path}/{MARKER}/{SCHEMA_VERSION}"))
        elif found != SCHEMA_VERSION:
            raise ValueError(f"the warehouse has schema version {found}, this engine writes {SCHEMA_VERSION}")

    def _path(self, path: str) -> object:
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.path}/{name}"))

    def _stored(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{SCHEMAS[name]}, bucket int").parquet(f"{self.path}/{name}")

    def table(self, name: str) -> DataFrame:
        return self._stored(name).drop("bucket") if self._exists(name) else self.spark.createDataFrame([], SCHEMAS[name])

    def append(self, name: str, batch: DataFrame, order: Sequence[str | Column] = ()) -> int:
        """Add the rows that aren't there yet and return their number.

        The new rows are written to a folder of the batch beside the table first;
        its files then move into the table one by one, a rename each.  So a batch
        that fails while it is worked out leaves the table as it was.  Rows of
        filers that the batch doesn't hold aren't read: stored tables lie by filer
        bucket.
        """
        from pyspark.sql import Observation

        self._mark()
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ")]
        rows = batch.select(columns).withColumn("bucket", bucket_of(F.col("cik")))
        stored = None
        if self._exists(name):
            buckets = [r["bucket"] for r in rows.select("bucket").distinct().collect()]  # FILER_BUCKETS at most
            stored = self._stored(name).where(F.col("bucket").isin(*buckets)) if buckets else self._stored(name).limit(0)
        fresh = new_rows(rows, stored, KEYS[name], order)
        seen = Observation()
        staged = f"{self.path}/_staged-{name}-{uuid.uuid4().hex}"
        try:
            fresh.select(*columns, "bucket").observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy("bucket").parquet(staged)
            self._move(staged, f"{self.path}/{name}")
        finally:
            self._fs.delete(self._path(staged), True)
        return int(seen.get["rows"])

    def _move(self, staged: str, table: str) -> None:
        """Moves the files of a finished batch into the table."""
        files = self._fs.listFiles(self._path(staged), True)
        self._fs.mkdirs(self._path(table))
        start = len(self._path(staged).toUri().getPath()) + 1
        while files.hasNext():
            file = files.next().getPath()
            below = file.toUri().getPath()[start:]
            if below.endswith(".parquet"):
                target = self._path(f"{table}/{below}")
                self._fs.mkdirs(target.getParent())
                if not self._fs.rename(file, target):
                    raise OSError(f"{below} can't be moved into {table}")

    def add_facts(self, facts: DataFrame, source: str = "picker") -> int:
        return self.append("facts", fact_rows(facts, source), ["fact_key", "context_ref", "unit_ref", "value"])

    def add_documents(self, filings: DataFrame) -> int:
        rows = filings.select(F.col("entity_value").alias("cik"), F.col("ref").alias("accession"), "document", "url", "kind", F.current_timestamp().alias("fetched_at"), "content")
        return self.append("documents", rows, ["url"])

    def add_extractions(self, documents: DataFrame) -> int:
        """Facts JSON snapshots (cik, accession, selector, kind, facts_json); those without an accession are left out."""
        return self.append("extractions", documents.where("accession <> ''").withColumn("created_at", F.current_timestamp()), ["facts_json"])

    def archive(self, filings: DataFrame, *, facts: bool = True, **options) -> dict[str, int]:
        """Store filings, their facts and a Facts JSON snapshot of each; returns the numbers of new rows."""
        from filingloom.operators.xbrl import facts as extract
        from filingloom.sources.facts_json import facts_documents

        done = {"filings": filings.select("ref").distinct().count(), "documents": self.add_documents(filings), "facts": 0}
        if facts:
            rows = extract(filings, **options)
            done["facts"] = self.add_facts(rows, "filing")
            snapshot = facts_documents(rows, filings.select(F.col("ref").alias("accession"), "url"))
            self.add_extractions(snapshot.withColumnRenamed("json", "facts_json").withColumns({"selector": F.lit(""), "kind": F.lit("filing")}))
        return done


def view_rows(facts: DataFrame, *, statement: str | None = None, accession: str | None = None, consolidated: bool = True, months: int | None = None, by: str = "concept") -> DataFrame:
    """The facts that a statement view shows."""
    if by not in ("concept", "standard_concept"):
        raise ValueError("`by` is concept or standard_concept")
    rows = facts
    if consolidated:
        rows = rows.where("dimensions = '{}'")
    if accession is not None:
        rows = rows.where(F.col("accession") == accession)
    if statement is not None:
        rows = rows.where((F.col("statement") == statement) | F.array_contains(F.from_json("statements", "array<string>"), statement))
    if months is not None:
        rows = rows.where(F.col("is_instant") | (months_of(F.col("period_start"), F.col("period_end")) == months))
    return rows.where("standard_concept is not null") if by == "standard_concept" else rows


def statement_view(facts: DataFrame, *, periods: Sequence[str] | None = None, by: str = "concept", consolidated: bool = True, **choice) -> DataFrame:
    """One row per concept and label, one column per period end, newest first.

    Of several values for a cell the one of the last accession counts, then the
    one that starts last.  Without ``periods`` the distinct ones are read first
    (one row each); given ones spare that pass.
    """
    rows = view_rows(facts, by=by, consolidated=consolidated, **choice)
    keys = ["standard_concept"] if by == "standard_concept" else ["concept", "label"] if consolidated else ["concept", "label", "dimensions"]
    if periods is None:
        periods = [str(r["period_end"]) for r in rows.select("period_end").distinct().orderBy(F.desc("period_end")).collect()]
    if not periods:
        return rows.select(*keys).limit(0)
    last = F.max_by("value", F.struct("accession", "period_start", "context_ref", "unit_ref", "value"))
    shown = rows.withColumn("period", F.col("period_end").cast("string")).groupBy(*keys).pivot("period", list(periods)).agg(last)
    return shown.orderBy(*keys)
