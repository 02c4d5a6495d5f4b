"""Picked selections written out: their markup, Markdown or Facts JSON, or their facts into a warehouse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.functions.names import selection_slug
from filingloom.operators.warehouse import Warehouse
from filingloom.sources import facts_json

ENDINGS = {"ixbrl": ".ixbrl.html", "markdown": ".md", "facts": ".facts.json"}


def exported(picks: DataFrame, format_: str) -> DataFrame:
    """(name, content) of each selection in a format: ixbrl, markdown or facts."""
    if format_ not in ENDINGS:
        raise ValueError(f"the format is one of {sorted(ENDINGS)} or warehouse")
    name = F.concat(selection_slug(F.col("provenance.accession"), F.coalesce("selector", F.lit("")), F.coalesce("kind", F.lit("prose"))), F.lit(ENDINGS[format_]))
    named = picks.withColumns({"name": name, "accession": F.col("provenance.accession")})
    if format_ == "ixbrl":
        return named.select("name", F.coalesce("html", F.lit("")).alias("content"))
    if format_ == "markdown":
        shown = facts_json.pick_markdown(picks).withColumnRenamed("markdown", "content")
    else:
        provenance = picks.select(F.col("provenance.accession").alias("accession"), F.col("provenance.url").alias("url"))
        shown = facts_json.facts_documents(facts_json.pick_facts(picks), provenance).withColumnRenamed("json", "content").join(named.select("accession", "selector").distinct(), "accession")
    return named.select("name", "accession", "selector").join(shown.select("accession", "selector", "content"), ["accession", "selector"]).select("name", "content")


def save(picks: DataFrame, format_: str, path: str) -> int:
    """Write selections below a folder, one file folder by name, or append their facts to a warehouse; returns the number of files or new facts."""
    if format_ == "warehouse":
        return Warehouse(picks.sparkSession, path).add_facts(facts_json.pick_facts(picks))
    rows = exported(picks, format_)
    rows.repartition("name").write.mode("append").partitionBy("name").text(path)
    return rows.select("name").distinct().count()
