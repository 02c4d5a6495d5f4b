"""Helpers shared by the operators: table access, shared storage, Arrow batches."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from filingloom.storage import shared_dir

WORD_PATTERN = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the supplied tables through Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


BATCH_SETTING, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def prepare(spark: SparkSession) -> None:
    """Let Python workers on this host import the package, wherever the driver was started.

    Also bounds the Arrow batches between the JVM and Python, which by default
    hold 64 MB of texts for each task, on either side and in both directions.
    """
    if spark.conf.get(BATCH_SETTING) == "67108864b":  # Spark's default; a chosen size stays
        spark.conf.set(BATCH_SETTING, f"{BATCH_BYTES}b")
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    parts = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in parts:
        env["PYTHONPATH"] = os.pathsep.join([root, *parts])


class Scratch:
    """Tables written to the shared folder to cut lineage.

    A lost executor costs a re-read of these files, never a recomputation of
    the whole job.  ``drop`` removes a table that no plan reads any more; the
    rest go when the session's JVM ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
        self._n = 0
        path = spark._jvm.org.apache.hadoop.fs.Path(self.root)
        self._fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.deleteOnExit(path)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """The table as read back; ``rows`` gives its number of rows, observed while it was written."""
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{name}"
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path, out._scratch_rows = path, int(seen.get["rows"])
        return out

    @staticmethod
    def rows(df: DataFrame) -> int:
        return df._scratch_rows

    def drop(self, df: DataFrame) -> None:
        path = getattr(df, "_scratch_path", None)
        if path:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)


HOT_KEYS, LEAST_HOT = 4_096, 1_000


def join_by_size(rows: DataFrame, small: DataFrame, key: str, *, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` with the one row of ``small`` for their key, hot keys split over many tasks.

    ``small`` holds one row a key and in ``size`` its number of rows, which sum
    to ``total``.  A key with more than one in ``HOT_KEYS`` of all rows (and more than
    ``LEAST_HOT``) is cut into parts of that size: its row in ``small`` is
    repeated for each, and the rows are dealt to the parts by a hash of their
    columns.  So at most ``HOT_KEYS`` keys and numbers are broadcast, and ``small``
    grows by as many rows at most.  ``size`` isn't passed on.  A null key
    matches nothing (``how`` is inner or left).
    """
    part = max(LEAST_HOT, -(-total // HOT_KEYS))
    sized = small.withColumn("_parts", F.ceil(F.col(size) / part).cast("int")).drop(size)
    hot = sized.where("_parts > 1").select(key, "_parts")
    dealt = F.when(F.col("_parts").isNotNull(), F.pmod(F.xxhash64(*[rows[c] for c in rows.columns]), F.col("_parts")).cast("int")).otherwise(0)
    spread = rows.join(F.broadcast(hot), key, "left").withColumn("_part", dealt).drop("_parts")
    copies = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_parts"), F.lit(1)) - 1))).drop("_parts")
    return spread.join(copies, [key, "_part"], how).drop("_part")


def range_bucket(value: Column, splits: list[int]) -> Column:
    """Number of ``splits`` (ascending) that are <= value; 0 for null.  A native binary search."""
    if not splits:
        return F.lit(0)
    steps = [1 << i for i in reversed(range(len(splits).bit_length()))]
    array = F.array(*[F.lit(int(s)) for s in splits])

    def step(position: Column, width: Column) -> Column:
        fits = F.coalesce(F.get(array, position + width - 1) <= value, F.lit(False))
        return F.when(fits, position + width).otherwise(position)

    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def slices(batch: pa.RecordBatch, column: int, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows whose strings in ``column`` hold about ``max_bytes`` at most."""
    lengths = [0 if n is None else n for n in pc.binary_length(batch.column(column)).to_pylist()]
    start = held = 0
    for i, n in enumerate(lengths):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(lengths):
        yield batch.slice(start)


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str, *, column: int, max_bytes: int = 4 << 20) -> DataFrame:
    """``mapInArrow`` over bounded runs of rows, so that memory doesn't follow the batch size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, max_bytes):
                yield function(part)

    return df.mapInArrow(run, schema)
