"""Facts JSON documents and picked selections: JSON in, fact rows out, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.schemas import FACT_COLUMNS, FACTS_DOCUMENT, PICK

VERSION = 1


def facts_documents(facts: DataFrame, provenance: DataFrame) -> DataFrame:
    """(cik, accession, json): one Facts JSON document per filing.

    Facts are sorted, so equal facts give an equal text.
    """
    fact = F.struct(
        "concept", "standard_concept", "label", "value", "unit", "statement", F.from_json("statements", "array<string>").alias("statements"),
        F.col("period_start").cast("string").alias("period_start"), F.col("period_end").cast("string").alias("period_end"), "is_instant",
        F.from_json("dimensions", "map<string, string>").alias("dimensions"), "decimals", "context_ref", "unit_ref", "source_selector",
    )
    text = F.to_json(fact, {"ignoreNullFields": "false"})
    grouped = facts.groupBy("cik", "accession").agg(F.array_sort(F.collect_list(F.struct("concept", "context_ref", "unit_ref", text.alias("text"))))["text"].alias("texts"))
    named = grouped.join(provenance.groupBy("accession").agg(F.min("url").alias("url")), "accession", "left")
    head = F.to_json(F.struct(F.lit(VERSION).alias("version"), "cik", "accession", F.coalesce("url", F.lit("")).alias("url"), F.lit("").alias("selector"), F.lit("filing").alias("kind")))
    document = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"facts":['), F.array_join("texts", ","), F.lit("]}"))
    return named.select("cik", "accession", document.alias("json"))


def read_facts(documents: DataFrame, json_col: str = "json") -> DataFrame:
    """Fact rows of Facts JSON texts; missing fields get their defaults."""
    parsed = documents.select(F.from_json(F.col(json_col), FACTS_DOCUMENT).alias("d")).select("d.cik", "d.accession", F.col("d.selector").alias("picked"), F.explode("d.facts").alias("f"))
    text = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit("")).alias(c)
    rows = parsed.select(
        "cik", "accession", text("statement"), F.to_json(F.coalesce("f.statements", F.array().cast("array<string>"))).alias("statements"), F.col("f.concept").alias("concept"),
        F.col("f.standard_concept").alias("standard_concept"), text("label"), F.col("f.value").alias("value"), text("unit"),
        F.try_to_date(F.nullif("f.period_start", F.lit(""))).alias("period_start"), F.to_date("f.period_end").alias("period_end"), F.coalesce("f.is_instant", F.lit(False)).alias("is_instant"),
        dimensions_json(F.col("f.dimensions")).alias("dimensions"), F.col("f.decimals").alias("decimals"), text("context_ref"), text("unit_ref"),
        F.coalesce("f.source_selector", "picked", F.lit("")).alias("source_selector"),
    )
    return rows.select(FACT_COLUMNS)


def dimensions_json(dimensions: Column) -> Column:
    """A map as JSON with its keys in order; {} for null."""
    entries = F.array_sort(F.map_entries(F.coalesce(dimensions, F.create_map().cast("map<string, string>"))))
    return F.to_json(F.map_from_entries(entries))


def read_picks(payloads: DataFrame, json_col: str = "json") -> DataFrame:
    """Selections of picked regions: one row per payload, facts as an array; another version than 1 is an error."""
    parsed = payloads.select(F.from_json(F.col(json_col), PICK).alias("p"))
    known = F.coalesce(F.col("p.version"), F.lit(-1)) == VERSION
    checked = F.when(known, F.col("p")).otherwise(F.raise_error(F.concat(F.lit("unsupported selection payload version "), F.coalesce(F.col("p.version").cast("string"), F.lit("missing")))))
    return payloads.select(F.from_json(F.col(json_col), PICK).alias("p")).withColumn("p", checked).select("p.*")


def pick_facts(picks: DataFrame) -> DataFrame:
    """Fact rows of selections: value = number x 10**scale x sign; the first of equal keys stays."""
    rows = picks.select(F.col("provenance.cik").alias("cik"), F.col("provenance.accession").alias("accession"), "selector", F.posexplode("facts").alias("at", "f"))
    number = F.regexp_replace(F.trim("f.value"), ",", "").cast("double") * F.pow(F.lit(10.0), F.coalesce("f.scale", F.lit(0)))
    value = F.when(F.col("f.sign") == "-", -number).otherwise(number)
    text = lambda c: F.coalesce(F.col(f"f.{c}"), F.lit(""))
    out = rows.select(
        "cik", "accession", "at", text("statement").alias("statement"), F.lit("[]").alias("statements"), F.col("f.concept").alias("concept"), F.lit(None).cast("string").alias("standard_concept"),
        text("label").alias("label"), value.alias("value"), text("unit").alias("unit"), F.try_to_date(F.nullif("f.periodStart", F.lit(""))).alias("period_start"), F.to_date("f.periodEnd").alias("period_end"),
        F.coalesce("f.isInstant", F.lit(False)).alias("is_instant"), dimensions_json(F.col("f.dimensions")).alias("dimensions"), F.when(F.col("f.decimals") != "INF", F.col("f.decimals").try_cast("int")).alias("decimals"),
        text("contextRef").alias("context_ref"), text("unitRef").alias("unit_ref"), F.coalesce("selector", F.lit("")).alias("source_selector"),
    )
    from filingloom.operators.xbrl import first_of

    return first_of(out, ["accession", "concept", "context_ref", "unit_ref"], ["at"]).select(FACT_COLUMNS)


def classified_facts(facts: DataFrame, statements: DataFrame) -> DataFrame:
    """Picked facts with the statement that ``statements`` (ref, concept, statements) names first for their filing and concept; others stay as they are."""
    first = statements.where(F.size("statements") > 0).groupBy(F.col("ref").alias("accession"), "concept").agg(F.min(F.col("statements")[0]).alias("_named"))
    rows = facts.join(first, ["accession", "concept"], "left")
    named = F.col("_named").isNotNull()
    rows = rows.withColumns({"statement": F.coalesce("_named", "statement"), "statements": F.when(named, F.to_json(F.array("_named"))).otherwise(F.col("statements"))})
    return rows.select(FACT_COLUMNS)


def markdown_cell(col: Column) -> Column:
    return F.replace(F.regexp_replace(F.trim(col), "(?U)\\s+", " "), F.lit("|"), F.lit("\\|"))


def table_markdown(header: Column, rows: Column) -> Column:
    """A Markdown table: blank and lone-$ cells dropped, rows packed to the left, the first row as header."""
    grid = F.concat(F.when(F.size(header) > 0, F.array(header)).otherwise(F.array().cast("array<array<string>>")), rows)
    packed = F.filter(F.transform(grid, lambda r: F.filter(r, lambda c: ~F.trim(c).isin("", "$"))), lambda r: F.size(r) > 0)
    width = F.array_max(F.transform(packed, lambda r: F.size(r)))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.concat(F.transform(r, markdown_cell), F.array_repeat(F.lit(""), width - F.size(r))), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), width), " | "), F.lit(" |"))
    lines = F.transform(packed, line)
    return F.when(F.size(packed) == 0, "").otherwise(F.array_join(F.concat(F.slice(lines, 1, 1), F.array(rule), F.slice(lines, F.lit(2), F.greatest(F.size(lines), F.lit(1)))), "\n"))


def pick_markdown(picks: DataFrame, provenance: bool = True) -> DataFrame:
    """(accession, selector, markdown) of selections."""
    from filingloom.functions.text import prose_markdown

    body = F.when(F.col("table").isNull(), prose_markdown(F.col("text"))).otherwise(table_markdown(F.col("table.header"), F.col("table.rows")))
    head = F.concat(
        F.lit("> Source: CIK "), F.col("provenance.cik"), F.lit(", accession "), F.col("provenance.accession"), F.lit(" ("), F.col("kind"), F.lit(")\n> URL: "),
        F.col("provenance.url"), F.lit("\n> Selector: `"), F.col("selector"), F.lit("`"),
    )
    shown = F.when(body == "", head).otherwise(F.concat(head, F.lit("\n\n"), body)) if provenance else body
    return picks.select(F.col("provenance.accession").alias("accession"), "selector", shown.alias("markdown"))
