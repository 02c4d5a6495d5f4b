"""Inline styles: column functions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Pixels of a unit, as filings' software counts them.
UNITS = {"": 1.0, "px": 1.0, "pt": 1.333, "em": 16.0, "rem": 16.0, "in": 96.0, "cm": 37.8, "mm": 3.78}
SIDES = ("top", "right", "bottom", "left")


def declarations(style: Column) -> Column:
    """map<property, value> of a style attribute, lower case; of a repeated property the last counts."""
    from filingloom.operators.xbrl import small_map

    parts = F.filter(F.split(F.lower(F.coalesce(style, F.lit(""))), ";"), lambda p: F.contains(p, F.lit(":")))
    return small_map(F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("key"), F.trim(F.regexp_replace(p, "^[^:]*:", "")).alias("value"))))


def pixels(value: Column) -> Column:
    """A length in pixels; null for percentages, keywords and unknown units."""
    text = F.lower(F.trim(value))
    known = F.create_map(*[F.lit(x) for item in UNITS.items() for x in item])
    number = F.regexp_extract(text, "^(-?\\d*\\.?\\d+)\\s*([a-z%]*)$", 1).try_cast("double")
    return number * F.try_element_at(known, F.regexp_extract(text, "^(-?\\d*\\.?\\d+)\\s*([a-z%]*)$", 2))


def box(value: Column) -> Column:
    """struct<top, right, bottom, left> of a margin or padding shorthand."""
    lengths = F.filter(F.transform(F.split(F.trim(value), "\\s+"), pixels), lambda p: p.isNotNull())
    at = lambda i, *others: F.coalesce(F.get(lengths, F.lit(i)), *[F.get(lengths, F.lit(o)) for o in others])
    return F.struct(at(0).alias("top"), at(1, 0).alias("right"), at(2, 0).alias("bottom"), at(3, 1, 0).alias("left"))


def weight(value: Column) -> Column:
    """A font weight as a number."""
    text = F.lower(F.trim(value))
    return F.when(text == "normal", 400).when(text == "bold", 700).when(text == "bolder", 800).when(text == "lighter", 300).otherwise(text.try_cast("int"))


def colour(value: Column) -> Column:
    """A colour in lower case, three-digit codes doubled."""
    text = F.lower(F.trim(value))
    return F.when(text.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(text, "([0-9a-f])", "$1$1")).otherwise(text)


def merged(base: Column, override: Column) -> Column:
    """Two maps of declarations; the second's values win."""
    left = F.map_filter(base, lambda k, _: ~F.map_contains_key(override, k))
    return F.map_concat(left, override)
