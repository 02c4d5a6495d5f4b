"""Numeric facts of XBRL documents.

A document is read once: contexts, units and fact elements are cut out of its
text by regular expressions, facts find their context and unit in an index built
from the same row (its cost follows the number of contexts, repeated ids or not), and only narrow fact rows leave the scan.  So extraction
needs no join and no shuffle, and ``content`` never enters an exchange.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.functions import numbers
from filingloom.functions.names import local_name
from filingloom.operators.standardize import standardized
from filingloom.schemas import FACT_COLUMNS

#: Elements that carry numeric facts, inline and in classic instances; any prefix is taken.
PREFIX = "(?:\\w+:)?"
INLINE_FACT = "(?is)<ix:nonFraction\\b[^>]*>.*?</ix:nonFraction>"
ATTRIBUTE = '([\\w:.-]+)\\s*=\\s*"([^"]*)"'
#: Start tags whose attributes plain searches find: single spaces between them, no equals sign in a value.
PLAIN_TAG = '^<[^\\s"\'<>=]++(?: [\\w:.-]++="[^"=]*+")*+ ?/?>$'
INLINE_END = "</ix:nonFraction>"
WHITE = " \t\n\x0b\f\r"
CLASSIC_FACT = '(?is)<([\\w-]+:[\\w.-]+)\\b[^>]*\\bcontextRef="[^"]+"[^>]*>[^<]*</\\1>'


def attribute(tag: Column, name: str) -> Column:
    """A double-quoted attribute of a start tag; empty when absent."""
    return F.regexp_extract(tag, f'(?<![\\w:.-]){name}\\s*=\\s*"([^"]*)"', 1)


def start_tag(element: Column) -> Column:
    """The start tag that an element begins with."""
    return F.concat(F.substring_index(element, ">", 1), F.lit(">"))


def _elements(content: Column, name: str) -> Column:
    return F.regexp_extract_all(content, F.lit(f"(?is)<{PREFIX}{name}\\b[^>]*>.*?</{PREFIX}{name}>"), F.lit(0))


def _inner(element: Column, name: str) -> Column:
    """Text of the first child of that name without white space in it; empty when absent."""
    return F.regexp_extract(element, f"(?is)<{PREFIX}{name}>\\s*([^<\\s]+)\\s*</{PREFIX}{name}>", 1)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often the body names it and wherever a projection is merged into."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def last_of_key(entries: Column) -> Column:
    """Of struct(key, ...) entries the last of each key; in the order of the keys if any is repeated."""

    def lasts(entries: Column) -> Column:
        places = F.array_sort(F.transform(entries, lambda e, i: F.struct(e["key"].alias("key"), i.alias("at"))))
        after = lambda places: F.slice(places, F.lit(2), F.greatest(F.size(places), F.lit(1)))
        kept = let(places, lambda p: F.filter(F.zip_with(p, after(p), lambda x, y: F.when(~x["key"].eqNullSafe(y["key"]), x["at"])), lambda at: at.isNotNull()))
        return F.transform(kept, lambda at: F.get(entries, at))

    return let(entries, lambda e: F.when(F.size(F.array_distinct(e["key"])) == F.size(e), e).otherwise(lasts(e)))


def small_map(entries: Column) -> Column:
    """Map of a few struct(key, value) entries; of equal keys the last one counts."""
    keys = entries["key"]
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), e["key"]))
    return F.map_from_entries(F.when(F.size(F.array_distinct(keys)) == F.size(keys), entries).otherwise(last))


#: A search reads one of up to ``PARTS`` maps, of about ``PART`` entries where that is enough.
PARTS, PART = 64, 8


def indexed(entries: Column) -> Column:
    """Maps of struct(key, value) entries with distinct keys, dealt by a hash of the key, so that a search reads one small map."""
    entry = lambda e: F.struct(e["key"], e["value"])
    parts = lambda entries: F.least(F.greatest(F.ceil(F.size(entries) / PART).cast("int"), F.lit(1)), F.lit(PARTS))
    dealt = lambda entries, n: F.transform(F.sequence(F.lit(0), n - 1), lambda part: F.map_from_entries(F.filter(entries, lambda e: F.pmod(F.hash(e["key"]), n) == part)))
    return let(F.transform(entries, entry), lambda e: F.when(F.size(e) <= PART, F.array(F.map_from_entries(e))).otherwise(let(parts(e), lambda n: dealt(e, n))))


def found_in(index: Column, key: Column) -> Column:
    """The value of a key in ``indexed`` entries, or null."""
    return F.try_element_at(F.get(index, F.when(F.size(index) > 1, F.pmod(F.hash(key), F.size(index))).otherwise(0)), key)


def dimensions_of(context: Column) -> Column:
    """Explicit dimensions as a map in key order; typed members are left out."""
    members = F.regexp_extract_all(context, F.lit(f'(?is)<{PREFIX}explicitMember\\b[^>]*\\bdimension="[^"]+"[^>]*>\\s*[^<]+?\\s*</{PREFIX}explicitMember>'), F.lit(0))
    member = lambda m: F.btrim(F.substring_index(F.substring(m, F.length(start_tag(m)) + 1, F.length(m)), "<", 1), F.lit(WHITE))
    entries = F.transform(members, lambda m: F.struct(attribute(start_tag(m), "dimension").alias("key"), member(m).alias("value")))
    # most contexts have none, which a plain search tells
    # a context has few dimensions; one that it names twice keeps the greatest member
    later = lambda ordered: F.slice(ordered, F.lit(2), F.greatest(F.size(ordered), F.lit(1)))
    kept = let(F.sort_array(entries), lambda o: F.filter(F.zip_with(o, later(o), lambda x, y: F.when(~x["key"].eqNullSafe(y["key"]), x)), lambda x: x.isNotNull()))
    return F.when(F.contains(F.lower(context), F.lit("explicitmember")), F.map_from_entries(kept)).otherwise(F.create_map().cast("map<string, string>"))


def contexts(content: Column) -> Column:
    """Entries (key, struct<instant, start, stop, dimensions>) of a document, repeats included; absent dates and those beside an instant are empty."""
    # an instant leaves no start and end to look for
    period = lambda c: let(_inner(c, "instant"), lambda i: F.struct(i.alias("instant"), *[F.when(i == "", _inner(c, name)).otherwise("").alias(alias) for name, alias in (("startDate", "start"), ("endDate", "stop"))], dimensions_of(c).alias("dimensions")))
    found = F.transform(_elements(content, "context"), lambda c: F.struct(attribute(start_tag(c), "id").alias("key"), period(c).alias("value")))
    return F.filter(found, lambda e: e["key"] != "")


def units(content: Column) -> Column:
    """Entries (key, unit) of a document, repeats included: a measure's local name, or numerator/denominator."""

    def measure(block: Column) -> Column:
        return local_name(F.regexp_extract(block, f"(?is)<{PREFIX}measure>\\s*([^<]+?)\\s*</{PREFIX}measure>", 1))

    def side(block: Column, name: str) -> Column:
        return measure(F.regexp_extract(block, f"(?is)<{PREFIX}{name}>(.*?)</{PREFIX}{name}>", 1))

    def unit(block: Column) -> Column:
        quotient = F.concat(side(block, "unitNumerator"), F.lit("/"), side(block, "unitDenominator"))
        return F.when(block.rlike(f"(?is)<{PREFIX}divide>"), quotient).otherwise(measure(block))

    found = F.transform(_elements(content, "unit"), lambda u: F.struct(attribute(start_tag(u), "id").alias("key"), unit(u).alias("value")))
    return F.filter(found, lambda e: e["key"] != "")


def inline_elements(content: Column) -> Column:
    return F.regexp_extract_all(content, F.lit(INLINE_FACT), F.lit(0))


def classic_elements(content: Column) -> Column:
    """Elements of an instance that carry a context; text with markup in it is no number."""
    return F.regexp_extract_all(content, F.lit(CLASSIC_FACT), F.lit(0))


def raw_facts(filings: DataFrame, keep: list[str]) -> DataFrame:
    """Facts resolved within their document: ``keep`` columns, ordinal and the fact's parts.

    ``number`` is null where an element is no fact: no number, or no end of
    its period.
    """
    classic = F.col("kind") == "xbrl"
    found = F.when(classic, classic_elements(F.col("content"))).otherwise(inline_elements(F.col("content")))
    held = [*keep, "classic", "elements"]
    parts = filings.select(*keep, classic.alias("classic"), found.alias("elements"), contexts(F.col("content")).alias("contexts"), units(F.col("content")).alias("units"))
    parts = parts.select(*held, *[indexed(last_of_key(F.col(c))).alias(c) for c in ("contexts", "units")])

    # Each step reads a part of an element once; they stand in the generator, which no projection is merged into.
    tags = F.transform("elements", lambda e: F.struct(e.alias("element"), start_tag(e).rlike(PLAIN_TAG).alias("plain")))
    listed = lambda t, group: F.when(~t["plain"], F.regexp_extract_all(start_tag(t["element"]), F.lit(ATTRIBUTE), F.lit(group)))
    tags = F.transform(tags, lambda t: F.struct(t["element"].alias("element"), listed(t, 1).alias("names"), listed(t, 2).alias("values")))
    tags = F.transform(tags, lambda t: F.struct(t.alias("t"), _attribute_of(t, "contextRef").alias("context_ref"), _attribute_of(t, "unitRef").alias("unit_ref")))
    tags = F.transform(tags, lambda t: F.struct(t["t"].alias("t"), t["context_ref"].alias("context_ref"), t["unit_ref"].alias("unit_ref"), found_in(F.col("contexts"), t["context_ref"]).alias("context"), found_in(F.col("units"), t["unit_ref"]).alias("unit")))
    rows = parts.select(*keep, "classic", F.posexplode(F.filter(tags, lambda t: t["context"].isNotNull())).alias("ordinal", "e"))
    rows = rows.select(*keep, "classic", "ordinal", "e.*")
    of = lambda name: _attribute_of(F.col("t"), name)
    tag = start_tag(F.col("t.element"))
    inside = F.substring(F.col("t.element"), F.length(tag) + 1, F.length("t.element") - F.length(tag))
    text = F.when(F.col("classic"), F.substring_index(inside, "<", 1)).otherwise(F.left(inside, F.length(inside) - len(INLINE_END)))
    date = lambda c: F.try_to_date(c, "yyyy-MM-dd")
    is_instant = F.col("context.instant") != ""
    # Each step is a projection of its own, so that no expression is worked out twice.
    rows = rows.select(
        *keep,
        "classic",
        "ordinal",
        F.when(F.col("classic"), F.regexp_extract(tag, "(?s)^<([^\\s/>]+)", 1)).otherwise(of("name")).alias("concept"),
        (~F.col("classic") | _has(F.col("t"), "unitRef")).alias("numeric"),
        F.when(F.col("classic"), F.lit("")).otherwise(of("format")).alias("format"),
        numbers.strip_markup(text).alias("bare"),
        of("sign").alias("sign"),
        of("scale").alias("scale"),
        numbers.decimals(of("decimals")).alias("decimals"),
        F.coalesce("unit", F.lit("")).alias("unit"),
        F.when(~is_instant, date(F.col("context.start"))).alias("period_start"),
        date(F.when(is_instant, F.col("context.instant")).otherwise(F.col("context.stop"))).alias("period_end"),
        is_instant.alias("is_instant"),
        F.col("context.dimensions").alias("dimensions"),
        F.coalesce("context_ref", F.lit("")).alias("context_ref"),
        F.coalesce("unit_ref", F.lit("")).alias("unit_ref"),
    ).where("concept <> '' and numeric and not (classic and lower(concept) like 'xbrli:%')")
    rows = rows.withColumn("shown", numbers.displayed(F.col("format"), F.col("bare")))
    rows = rows.withColumn("inner", numbers.without_brackets(F.col("shown")))
    number = numbers.signed(F.col("shown"), F.col("inner"), F.col("sign"))
    return rows.withColumn("number", F.when(F.col("period_end").isNotNull(), number)).drop("classic", "numeric", "format", "bare", "shown", "inner", "sign")


def _attribute_of(t: Column, name: str) -> Column:
    """The first attribute of a name in a struct(element, names, values); empty when absent. Plain tags have no names listed."""
    tag, mark = start_tag(t["element"]), f' {name}="'
    at = F.instr(tag, mark)
    plain = F.when(at > 0, F.substring_index(F.substring(tag, at + len(mark), F.length(tag)), '"', 1)).otherwise("")
    listed = F.coalesce(F.get(t["values"], F.array_position(t["names"], name).cast("int") - 1), F.lit(""))
    return F.when(t["names"].isNull(), plain).otherwise(listed)


def _has(t: Column, name: str) -> Column:
    return F.when(t["names"].isNull(), F.contains(start_tag(t["element"]), F.lit(f' {name}="'))).otherwise(F.array_contains(t["names"], name))


def first_of(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order."""
    ranked = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("_place = 1").drop("_place")


def facts(filings: DataFrame, *, statements: DataFrame | None = None, negations: DataFrame | None = None, labels: DataFrame | None = None, standardizer: DataFrame | dict | Callable | None = None, deduplicate: bool = True) -> DataFrame:
    """Fact rows (schema FACT) of filings.

    ``statements`` (ref, concept, statements), ``negations`` (ref, concept) and
    ``labels`` (ref, concept, label) come from linkbases; each is joined on
    the filing and concept.  Of several facts with one concept, context and
    unit in a filing the first in document order stays.
    """
    rows = raw_facts(filings, ["entity_value", "ref"])
    if statements is not None:
        rows = rows.join(statements.select("ref", "concept", "statements"), ["ref", "concept"], "left")
    else:
        rows = rows.withColumn("statements", F.lit(None).cast("array<string>"))
    if negations is not None:
        rows = rows.join(negations.select("ref", "concept").distinct().withColumn("negated", F.lit(True)), ["ref", "concept"], "left")
    else:
        rows = rows.withColumn("negated", F.lit(False))
    rows = rows.join(labels.select("ref", "concept", "label"), ["ref", "concept"], "left") if labels is not None else rows.withColumn("label", F.lit(""))
    if deduplicate:
        # elements that are no facts come last and go after the choice: a filter below it would work the number out twice
        rows = first_of(rows, ["ref", "concept", "context_ref", "unit_ref"], [F.col("number").isNull(), "ordinal"])
    rows = rows.where("number is not null")
    member = F.coalesce("statements", F.array().cast("array<string>"))
    rows = rows.select(
        F.col("entity_value").alias("cik"),
        F.col("ref").alias("accession"),
        F.coalesce(F.get(member, F.lit(0)), F.lit("")).alias("statement"),
        F.to_json(member).alias("statements"),
        "concept",
        F.coalesce("label", F.lit("")).alias("label"),
        numbers.scaled(F.col("number"), F.col("scale"), F.col("negated")).alias("value"),
        "unit",
        "period_start",
        "period_end",
        "is_instant",
        F.to_json("dimensions").alias("dimensions"),
        "decimals",
        "context_ref",
        "unit_ref",
        F.lit("").alias("source_selector"),
    )
    return standardized(rows, standardizer).select(FACT_COLUMNS)


def richer(inline: DataFrame, instance: DataFrame) -> DataFrame:
    """For each filing the instance's facts if they are strictly more, else the inline ones."""
    counted = lambda df, n: df.groupBy("accession").agg(F.count("*").alias(n))
    better = counted(instance, "b").join(counted(inline, "a"), "accession", "left").where("b > coalesce(a, 0)").select("accession")
    return inline.join(better, "accession", "left_anti").unionByName(instance.join(better, "accession", "left_semi"))


def dei_text(content: Column, name: str) -> Column:
    """A cover-page fact's text: the first inline element of that name, else the plain element; empty when absent.

    A fixed-true or fixed-false format stands for its value.
    """
    text: Column = F.lit("")
    plain = F.regexp_extract(content, f"(?is)<{name}\\b[^>]*>([^<]*)</{name}>", 1)
    choices = []
    for tag in ("nonNumeric", "nonFraction"):
        own = F.regexp_extract(content, f'(?is)<ix:{tag}\\b[^>]*(?<![\\w:.-])name\\s*=\\s*"{name}"[^>]*>.*?</ix:{tag}>', 0)
        head = F.regexp_extract(own, "(?s)^<[^>]*>", 0)
        format_ = attribute(head, "format")
        inner = F.regexp_extract(own, "(?s)^<[^>]*>(.*)</[^>]*>$", 1)
        choices.append(F.when(own != "", F.when(F.contains(format_, F.lit("fixed-true")), "true").when(F.contains(format_, F.lit("fixed-false")), "false").otherwise(decoded(inner))))
    return F.coalesce(*choices, decoded(plain), text)


def decoded(col: Column) -> Column:
    """Text without tags, character references and six named entities decoded, white space collapsed."""
    from filingloom.functions.text import decode_numeric

    text = F.regexp_replace(col, "(?s)<[^>]*>", " ")
    text = decode_numeric(text)
    codes = F.regexp_extract_all(text, F.lit("(?i)&#x([0-9a-f]+);"), F.lit(1))
    letters = F.transform(codes, lambda c: F.decode(F.unhex(F.lpad(c, 8, "0")), "UTF-32"))
    text = F.when(F.size(codes) == 0, text).otherwise(F.array_join(F.zip_with(F.split(text, "(?i)&#x[0-9a-f]+;"), letters, lambda t, l: F.concat(t, F.coalesce(l, F.lit("")))), ""))
    for entity, letter in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(letter))
    return F.trim(F.regexp_replace(text, "(?U)\\s+", " "))


def identifier(content: Column, scheme: str) -> Column:
    """The first entity identifier whose scheme holds a text (17442 for LEIs, companieshouse for UK companies)."""
    return F.regexp_extract(content, f'(?is)<{PREFIX}identifier\\b[^>]*\\bscheme="[^"]*{scheme}[^"]*"[^>]*>\\s*([^<\\s]+)', 1)
