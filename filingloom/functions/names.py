"""Identifiers, names and small notations: column functions, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Notations of names, reports, items and archive entries.
DISPLAY_NAME = "^(.*?)\\s*(?:\\([^()]*\\)\\s*)?\\(CIK\\s+\\d+\\)\\s*$"
REPORT_NAME = "^\\s*[^-]*-\\s*([^-]+?)\\s*-"
ITEM_HEAD = "(?i)^\\s*item\\s+\\d{1,2}[A-Z]?\\s*[.\\-—:]*\\s*"
BULK_ENTRY = "_([A-Za-z0-9]+)_(\\d{8})\\.(?i:html)$"


def cik(col: Column) -> Column:
    """Ten-digit filer number; an error on empty, non-digit or longer input."""
    text = F.trim(col.cast("string"))
    problem = (
        F.when(text == "", "the filer number is empty")
        .when(~text.rlike("^[0-9]+$"), "the filer number holds something else than digits")
        .when(F.length(text) > 10, "the filer number has more than 10 digits")
    )
    return F.when(problem.isNull(), F.lpad(text, 10, "0")).otherwise(F.raise_error(problem))


def first_colon(col: Column) -> Column:
    """The first underscore as a colon: an element id as a concept name."""
    return F.regexp_replace(col, "^([^_]*)_", "$1:")


def concept_of_href(href: Column, last: bool = False) -> Column:
    """The concept that a locator's fragment names; null without a fragment."""
    fragment = F.substring_index(href, "#", -1) if last else F.regexp_extract(href, "^[^#]*#(.*)$", 1)
    return F.when(F.contains(href, F.lit("#")), first_colon(fragment))


def concept_of_reference(token: Column) -> Column:
    """The concept of a rendered report's reference anchor."""
    return first_colon(F.regexp_replace(token, "^defref_", ""))


def role_key(role: Column) -> Column:
    """Last path segment, letters and digits only, lower case."""
    return F.lower(F.regexp_replace(F.substring_index(role, "/", -1), "[^A-Za-z0-9]", ""))


def local_name(measure: Column) -> Column:
    return F.substring_index(measure, ":", -1)


def entity_name(shown: Column) -> Column:
    """A search hit's display name without its ticker and filer number."""
    bare = F.regexp_extract(shown, DISPLAY_NAME, 1)
    return F.trim(F.when(shown.rlike("\\(CIK\\s+\\d+\\)\\s*$"), bare).otherwise(shown))


def report_category(long_name: Column) -> Column:
    """The middle part of "code - Category - Title", lower case."""
    return F.lower(F.trim(F.regexp_extract(long_name, REPORT_NAME, 1)))


def page_ranges(col: Column) -> Column:
    """"4-7, 9-11, (a), 25" as array<struct<start, stop>>; parts that aren't pages are left out."""
    text = F.replace(F.replace(col, F.lit("&#8211;"), F.lit("-")), F.lit("–"), F.lit("-"))
    parts = F.transform(F.split(text, ","), lambda p: F.trim(F.regexp_replace(p, "\\([^)]*\\)", "")))
    parts = F.transform(parts, lambda p: F.struct(F.trim(F.regexp_extract(p, "^([^-]*)", 1)).try_cast("int").alias("start"), F.trim(F.regexp_extract(p, "^[^-]*-?(.*)$", 1)).alias("rest"), F.contains(p, F.lit("-")).alias("ranged")))
    parts = F.transform(parts, lambda p: F.struct(p["start"].alias("start"), F.when(p["ranged"], p["rest"].try_cast("int")).otherwise(p["start"]).alias("stop")))
    found = F.filter(parts, lambda p: p["start"].isNotNull() & p["stop"].isNotNull())
    empty = F.slice(found, 1, 0)
    return F.when((F.lower(F.trim(col)) == "not applicable") | (col == ""), empty).otherwise(found)


def roman(col: Column) -> Column:
    """Value of a Roman numeral, subtractive; null with other letters."""
    values = F.create_map(*[F.lit(x) for item in {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100, "D": 500, "M": 1000}.items() for x in item])
    digits = F.transform(F.split(F.upper(F.trim(col)), ""), lambda c: F.try_element_at(values, c))
    signed = F.transform(digits, lambda v, i: F.when(F.coalesce(F.get(digits, i + 1), F.lit(0)) > v, -v).otherwise(v))
    return F.when(F.trim(col).rlike("^(?i)[IVXLCDM]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def item_of(label: Column) -> Column:
    """"Item 7A. Quantitative…" as 7A; null without an item."""
    found = F.upper(F.regexp_extract(label, "(?i)\\bitem\\s+(\\d+[a-z]?)\\b", 1))
    return F.when(found != "", found)


def part_of(label: Column) -> Column:
    """"PART II" as II; null without a part."""
    found = F.upper(F.regexp_extract(label, "(?i)\\bpart\\s+([ivx]+)\\b", 1))
    return F.when(found != "", found)


def item_order(part: Column, item: Column) -> Column:
    """Sort key of an item: part, then number, then letter; unknown parts and items come last."""
    place = F.create_map(*[F.lit(x) for i, p in enumerate(["I", "II", "III", "IV", "V"], 1) for x in (p, i)])
    of_part = F.when(part.isNull(), 0).otherwise(F.coalesce(F.try_element_at(place, F.upper(part)), F.lit(9)))
    number, letter = F.regexp_extract(item, "(\\d+)([A-Za-z]?)", 1), F.upper(F.regexp_extract(item, "(\\d+)([A-Za-z]?)", 2))
    of_item = F.when(number != "", number.try_cast("int") * 100 + F.when(letter != "", F.ascii(letter) - 64).otherwise(0))
    return of_part * 100_000 + F.coalesce(of_item, F.lit(9_999))


def bulk_entry(name: Column) -> Column:
    """struct(number, period_end) of a bulk archive's entry name; null number when it isn't an accounts document."""
    number, day = F.regexp_extract(name, BULK_ENTRY, 1), F.regexp_extract(name, BULK_ENTRY, 2)
    return F.struct(F.when(number != "", number).alias("number"), F.try_to_date(F.when(day != "", day), "yyyyMMdd").alias("period_end"))


def selection_slug(accession: Column, selector: Column, kind: Column) -> Column:
    """File name of an exported selection, without extension."""
    slug = F.regexp_replace(F.regexp_replace(selector, "[^A-Za-z0-9]+", "-"), "^-+|-+$", "")
    slug = F.left(F.when(slug == "", kind).otherwise(slug), F.lit(48))
    return F.concat(F.when(accession == "", "selection").otherwise(accession), F.lit("_"), slug)


def section_title(text: Column) -> Column:
    """First line without its "Item N", at most 100 characters; the second line where nothing is left."""
    lines = F.split(text, "\n")
    first = F.trim(F.regexp_replace(lines[0], ITEM_HEAD, ""))
    second = F.trim(F.coalesce(F.get(lines, F.lit(1)), F.lit("")))
    return F.left(F.when(first == "", second).otherwise(first), F.lit(100))


def frame_of(start: Column, end: Column, instant: Column) -> Column:
    """Calendar frame of a period: CY2022, CY2022Q3 or, for an instant, CY2022Q3I; null for other lengths."""
    days = F.datediff(end, start)
    quarter = F.concat(F.lit("CY"), F.year(end), F.lit("Q"), F.quarter(end))
    return F.when(instant, F.concat(quarter, F.lit("I"))).when(days.between(340, 390), F.concat(F.lit("CY"), F.year(F.date_sub(end, 45)))).when(days.between(70, 115), quarter)
