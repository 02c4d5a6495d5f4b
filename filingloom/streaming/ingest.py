"""Streaming ingest: filings that arrive in a landing folder go to the warehouse once.

Each micro-batch is appended idempotently, so a batch that is run again after a
failure adds nothing twice.  Pivoted views stay batch queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from filingloom.operators.warehouse import Warehouse
from filingloom.schemas import FILING


def filing_stream(spark: SparkSession, path: str, *, files_per_batch: int = 64) -> DataFrame:
    """Filings as they arrive as Parquet files."""
    return spark.readStream.schema(FILING).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def ingest(filings: DataFrame, warehouse: str, checkpoint: str, **options) -> StreamingQuery:
    """Archive every arriving filing; stops when what is there has been taken in."""

    def batch(rows: DataFrame, _: int) -> None:
        held = rows.persist()
        try:
            Warehouse(rows.sparkSession, warehouse).archive(held, **options)
        finally:
            held.unpersist()

    return filings.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_day(documents: DataFrame, *, time_col: str = "fetched_at", delay: str = "1 day") -> DataFrame:
    """Arrivals per system and day; days close when the watermark has passed them."""
    return documents.withWatermark(time_col, delay).groupBy(F.window(time_col, "1 day"), "system").agg(F.count("*").alias("n"))
