"""Connected components of an edge table, by alternating large and small stars.

Every step is a partially aggregated minimum per node and a join, so a node
with very many neighbours costs no single task its whole list at once.  Steps
are written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from filingloom.llm.common import Scratch, join_by_size


def _written(edges: DataFrame, name: str, scratch: Scratch) -> tuple[DataFrame, tuple]:
    """The edges as written, and their number and hash, observed while writing."""
    seen = Observation()
    kept = scratch.write(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), name)
    return kept, (seen.get["n"], seen.get["h"])


def _large(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size")).select("u", F.least("u", "m").alias("m"), "size")
    return join_by_size(both.where("v > u"), least, "u", size="size", total=2 * total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame, total: int) -> DataFrame:
    # Edges point from the larger node u to the smaller v.
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("size"))
    moved = join_by_size(edges, least, "u", size="size", total=total).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """``node, component`` (its smallest node) for each node that has an edge to another."""
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    now, before = _written(now, "edges", scratch)
    while before[0]:
        last, seen = now, before
        now, before = _written(_small(scratch.write(_large(last, seen[0]), "large"), seen[0]), "star", scratch)
        scratch.drop(last)
        if before == seen:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
