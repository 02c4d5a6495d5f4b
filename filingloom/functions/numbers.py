"""Numbers as filings write them: column functions, all native.

Values are doubles, as in the data model; there is no decimal type.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English cardinals and scales of the number-word transform.
NUMBER_WORDS = {
    "zero": 0, "no": 0, "none": 0, "nil": 0, "null": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5,
    "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13,
    "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20,
    "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}
NUMBER_SCALES = {"thousand": 10**3, "million": 10**6, "billion": 10**9, "trillion": 10**12}


def strip_markup(col: Column) -> Column:
    """Text without tags and entities (entities are removed, not decoded), white space collapsed."""
    bare = F.regexp_replace(F.regexp_replace(col, "<[^>]*>", " "), "(?U)&#?\\w+;", " ")
    # most texts have neither, which one search tells
    return F.when(col.rlike("(?U)[<&\\s]"), F.trim(F.regexp_replace(bare, "(?U)\\s+", " "))).otherwise(col)


def without_brackets(shown: Column) -> Column:
    """The inside of a text in parentheses, or the text."""
    return F.when(shown.startswith("(") & shown.endswith(")"), F.substring(shown, F.lit(2), F.length(shown) - 2)).otherwise(shown)


def signed(shown: Column, inner: Column, sign: Column) -> Column:
    """Value of a cleaned text (and its inside without parentheses), or null.

    Parentheses or a ``-`` sign attribute make it negative; a leading minus
    toggles, so ``sign="-"`` with ``-5`` is 5.
    """
    marked = (F.coalesce(sign, F.lit("")) == "-") | (shown.startswith("(") & shown.endswith(")"))
    size = F.regexp_replace(inner, "[^0-9.]", "").try_cast("double")
    return F.when(marked != inner.startswith("-"), -size).otherwise(size)


def parsed_number(text: Column, sign: Column) -> Column:
    """Signed value of a displayed number, or null."""
    shown = strip_markup(text)
    return signed(shown, without_brackets(shown), sign)


def number_from_words(text: Column) -> Column:
    """Value of an English cardinal in words as a long; null if any word is not a number word."""
    words = F.filter(F.split(F.lower(F.regexp_replace(text, "[-,]", " ")), "(?U)\\s+"), lambda w: (w != "") & (w != "and"))
    units = F.create_map(*[F.lit(x) for item in NUMBER_WORDS.items() for x in item])
    scales = F.create_map(*[F.lit(x) for item in NUMBER_SCALES.items() for x in item])
    long = lambda c: c.cast("bigint")
    start = F.struct(long(F.lit(0)).alias("total"), long(F.lit(0)).alias("group"), F.lit(True).alias("known"))

    def add(state: Column, word: Column) -> Column:
        unit, scale = F.try_element_at(units, word), F.try_element_at(scales, word)
        at_least_one = F.greatest(state["group"], long(F.lit(1)))
        total = F.when(scale.isNotNull(), state["total"] + at_least_one * scale).otherwise(state["total"])
        group = F.when(unit.isNotNull(), state["group"] + unit).when(word == "hundred", at_least_one * 100).when(scale.isNotNull(), F.lit(0)).otherwise(state["group"])
        known = state["known"] & (unit.isNotNull() | (word == "hundred") | scale.isNotNull())
        return F.struct(long(total).alias("total"), long(group).alias("group"), known.alias("known"))

    found = F.aggregate(words, start, add)
    return F.when((F.size(words) > 0) & found["known"], found["total"] + found["group"])


def displayed(format_: Column, raw: Column) -> Column:
    """The text to read a number from, under an inline transform format.

    A format with ``zero`` is 0 whatever is shown; number words become digits
    (or null); decimal-comma formats become decimal-point; others stay.
    """
    of = F.lower(F.coalesce(format_, F.lit("")))
    comma = F.regexp_replace(F.regexp_replace(strip_markup(raw), "(?U)[.\\s\\u00A0]", ""), ",", ".")
    return (
        F.when(F.contains(of, F.lit("zero")), F.lit("0"))
        .when(F.contains(of, F.lit("numwords")), F.coalesce(number_from_words(strip_markup(raw)).cast("string"), F.lit("")))
        .when(F.contains(of, F.lit("comma-decimal")) | F.contains(of, F.lit("commadecimal")), comma)
        .otherwise(raw)
    )


def decimals(col: Column) -> Column:
    """Reported precision; null for INF or none."""
    return F.when(F.upper(col) != "INF", col.try_cast("int"))


def scaled(number: Column, scale: Column, negated: Column) -> Column:
    """number x 10**scale, turned about where the presentation negates the concept."""
    value = number * F.pow(F.lit(10.0), F.coalesce(scale.try_cast("int"), F.lit(0)))
    return F.when(F.coalesce(negated, F.lit(False)), -value).otherwise(value)


def cell_number(col: Column) -> Column:
    """Value of a table cell: placeholders are 0, currency signs and commas are dropped, parentheses negate."""
    text = F.trim(F.regexp_replace(col, "(?U)\\s+", " "))
    bare = F.regexp_replace(text, "[$€£¥,%\\s]", "")
    enclosed = bare.rlike("^\\(.*\\)$")
    size = F.regexp_replace(bare, "[()]", "").try_cast("double")
    return F.when(F.upper(bare).isin("—", "–", "-", "--", "N/A", "NA", "NM", "N/M"), F.lit(0.0)).when(enclosed, -size).otherwise(size)


def looks_financial(col: Column) -> Column:
    """Whether a cell starts like an amount: an optional currency sign, bracket or minus, then a digit."""
    return F.trim(col).rlike("^[$€£(-]?\\s{0,2}\\d")


def percent(col: Column) -> Column:
    """A percentage between 0 and 100, or null."""
    value = F.regexp_replace(F.trim(col), "%+$", "").try_cast("double")
    return F.when(value.between(0, 100), value)


def months(start: Column, end: Column) -> Column:
    """Length of a period in months of 30.44 days, rounded half away from zero."""
    return F.round(F.datediff(end, start).cast("double") / F.lit(30.44)).cast("int")
