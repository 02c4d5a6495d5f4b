"""Comparison of extracted facts with independent sources: fact by fact, and metric by metric.

Both look values up by equal keys only: a tolerance in days becomes one row for
each day it covers, so no range is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.operators.xbrl import first_of

RELATIVE, DAYS = 1e-4, 1
"""Difference of values, as a share of the reference (of 1 at least), and of period ends that still agree."""
ANNUAL_DAYS, METRIC_SHARE = 300, 0.01


def plain_unit(unit: Column) -> Column:
    """A unit without the namespace prefixes of currencies and shares."""
    return F.replace(F.replace(unit, F.lit("iso4217:"), F.lit("")), F.lit("xbrli:"), F.lit(""))


def period_end(period: Column) -> Column:
    """The date of an interchange period: an instant, or the end of "start/end"; null where neither can be read."""
    end = F.substring_index(period, "/", -1)
    return F.coalesce(F.try_to_date(end, "yyyy-MM-dd'T'HH:mm:ss"), F.try_to_date(end, "yyyy-MM-dd"))


def _relative(found: Column, reference: Column) -> Column:
    return F.when(found.isNull(), F.lit(float("inf"))).otherwise(F.abs(found - reference) / F.greatest(F.abs(reference), F.lit(1.0)))


def against_reference(facts: DataFrame, reference: DataFrame, *, by: list[str] | None = None, days: int = DAYS, tolerance: float = RELATIVE) -> DataFrame:
    """(by, concept, unit, period_end, value, reference, rel_diff, match) of each reference fact (by, concept, unit, period_end, value).

    The fact that answers has the concept and unit, no dimensions, and ends at
    most ``days`` days off (the nearest end first, then the first by place:
    context, unit and value); a reference without an end takes any.
    """
    by = ["accession"] if by is None else by
    named = [*by, "concept", "unit"]
    own = facts.where("dimensions in ('{}', '')").select(*named[:-1], plain_unit(F.col("unit")).alias("unit"), "period_end", "context_ref", "unit_ref", "value")
    asked = reference.select(*named[:-1], plain_unit(F.col("unit")).alias("unit"), F.col("period_end").alias("asked"), F.col("value").alias("reference")).distinct()
    near = F.explode(F.sequence(F.lit(-days), F.lit(days)))
    dated = asked.where("asked is not null").withColumn("off", near).withColumn("period_end", F.date_add("asked", F.col("off")))
    order = ["_off", "context_ref", "unit_ref", "value"]
    hits = dated.join(own, [*named, "period_end"]).withColumn("_off", F.struct(F.abs("off").alias("far"), F.col("off").alias("off"))).select(*named, "asked", "reference", *order)
    hits = hits.unionByName(asked.where("asked is null").join(own, named).withColumn("_off", F.struct(F.lit(0).alias("far"), F.lit(0).alias("off"))).select(*named, "asked", "reference", *order))
    best = first_of(hits, [*named, "asked", "reference"], order).select(*named, "asked", "reference", F.col("value").alias("found"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in [*named, "asked", "reference"]]
    joined = asked.alias("a").join(best.alias("b"), same, "left").select(*[f"a.{c}" for c in named], F.col("a.asked").alias("period_end"), F.col("b.found").alias("value"), "a.reference")
    difference = _relative(F.col("value"), F.col("reference"))
    return joined.withColumn("rel_diff", difference).withColumn("match", F.col("rel_diff") <= tolerance)


def metric_check(facts: DataFrame, metrics: DataFrame, reference: DataFrame, *, by: str = "cik", tolerance: float = METRIC_SHARE) -> DataFrame:
    """(by, metric, period_end, value, reference, rel_diff, match) of each filer and metric.

    ``metrics`` (metric, concept, place, instant) lists a metric's concepts in
    order; ``reference`` (by, metric, year, value) the other source's values.  A
    filer's value is the latest consolidated one of the first concept that it
    states, over more than 300 days where it isn't an instant; a filer without any
    has a row without a value.
    """
    own = facts.where("dimensions in ('{}', '')").select(by, "concept", "is_instant", "period_start", "period_end", "context_ref", "unit_ref", "value")
    fits = (F.col("is_instant") == F.col("instant")) & (F.col("instant") | (F.datediff("period_end", "period_start") > ANNUAL_DAYS))
    hits = own.join(F.broadcast(metrics), "concept").where(F.coalesce(fits, F.lit(False)))
    best = first_of(hits, [by, "metric"], ["place", F.desc("period_end"), "context_ref", "unit_ref", "value"]).select(by, "metric", "period_end", "value")
    every = facts.select(by).distinct().withColumn("metric", F.explode(F.lit(sorted(r["metric"] for r in metrics.select("metric").distinct().collect()))))
    joined = every.join(best, [by, "metric"], "left").withColumn("year", F.year("period_end"))
    given = reference.where("value <> 0").groupBy(by, "metric", "year").agg(F.min("value").alias("reference"))
    joined = joined.join(given, [by, "metric", "year"], "left")
    difference = F.when(F.col("reference").isNull(), F.lit(float("inf"))).otherwise(_relative(F.col("value"), F.col("reference")))
    return joined.select(by, "metric", "period_end", "value", "reference", difference.alias("rel_diff"), (difference <= tolerance).alias("match"))
