"""Headings in filings that mark them by looks only: four signals and a weighted vote.

Python reads the markup into one row per short block with its signals; the
scores, the vote and the threshold are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.functions import styles
from filingloom.operators.html_tree import BLOCK, SKIPPED, Element, fold, parse, per_document

WEIGHTS = {"style": 0.3, "pattern": 0.4, "structural": 0.2, "contextual": 0.1}
LEAST = 0.6
#: Fixed values: (pattern, level, confidence) of heading texts, asked in this order, whatever their case.
PATTERNS = (
    ("^Item\\s+\\d+[A-Z]?[.\\s]+.+$", 1, 0.95), ("^Part\\s+[IVX]+[.\\s]*$", 1, 0.9), ("^(?:Business|Risk Factors|Properties|Legal Proceedings)$", 2, 0.85), ("^(?:Management'?s?\\s+Discussion|MD&A)", 2, 0.85),
    ("^(?:Consolidated\\s+)?Financial\\s+Statements$", 2, 0.85), ("^\\d+\\.\\s+[A-Z][A-Z\\s]+$", 3, 0.7), ("^[A-Z]\\.\\s+[A-Z][A-Z\\s]+$", 3, 0.7), ("^\\([a-z]\\)\\s+[A-Z][A-Z\\s]+$", 4, 0.6), ("^[A-Z][A-Z\\s]+[A-Z]$", 3, 0.5),
)
SIGNAL = "block int, tag string, text string, style string, centred boolean, bold boolean, siblings int, next_tag string, next_length int, previous string"


def signal_rows(html: str) -> list[tuple]:
    out = []
    for e in parse(html).walk():
        if e.tag in SKIPPED or e.tag not in BLOCK or any(isinstance(c, Element) and c.tag in BLOCK for c in e.children):
            continue
        text = e.text()
        if not text or len(text) > 200 or e.parent is None:
            continue
        around = [c for c in e.parent.children if isinstance(c, Element)]
        at = next(i for i, c in enumerate(around) if c is e)
        following = around[at + 1] if at + 1 < len(around) else None
        before = fold(around[at - 1].text())[:200] if at else ""
        inner = [c for c in e.children if isinstance(c, Element) or c.strip()]
        style = e.attrs.get("style", "") or next((c.attrs.get("style", "") for c in inner if isinstance(c, Element)), "")
        strong = all(isinstance(c, Element) and (c.tag in ("b", "strong") or c.style().get("font-weight") in ("bold", "700")) for c in inner) or e.style().get("font-weight") in ("bold", "700")
        centred = e.style().get("text-align") == "center" or e.attrs.get("align", "").lower() == "center"
        out.append((len(out), e.tag, text, style, centred, strong, len(around), following.tag if following else None, len(following.text()) if following else 0, before))
    return out


def _titled(text: Column) -> Column:
    return text.rlike("^[A-Z]") & ~text.rlike("[.!?;]\\s*$") & (F.size(F.split(text, "\\s+")) <= 15)


def headings(docs: DataFrame, *, base_size: float = 10.0, least: float = LEAST, **columns: str) -> DataFrame:
    """(ref, block, text, level, confidence, method) of blocks that look like headings."""
    rows = per_document(docs, signal_rows, SIGNAL, **columns)
    own = styles.declarations(F.col("style"))
    ratio = styles.pixels(F.try_element_at(own, F.lit("font-size"))) / F.lit(base_size * styles.UNITS["pt"])
    text, words = F.col("text"), F.size(F.split("text", "\\s+"))
    capitals = (text == F.upper(text)) & text.rlike("[A-Z]")
    size_score = F.when(ratio >= 2, 0.8).when(ratio >= 1.5, 0.7).when(ratio >= 1.2, 0.5).when(ratio >= 1.1, 0.3).otherwise(0.0)
    margin = lambda side, limit: F.when(F.coalesce(styles.pixels(F.try_element_at(own, F.lit(f"margin-{side}"))), F.lit(0.0)) > limit, 0.1).otherwise(0.0)
    flag = lambda c, v: F.when(c, v).otherwise(0.0)
    style = F.least(F.lit(1.0), size_score + flag(F.col("bold"), 0.3) + flag(F.col("centred"), 0.2) + flag(capitals & (words <= 10), 0.2) + margin("top", 20) + margin("bottom", 10))
    style_level = F.when(ratio >= 2, 1).when(ratio >= 1.5, 2).when((ratio >= 1.1) & (ratio < 1.2), 4).when(F.col("bold"), 2).otherwise(3)
    few_dots = F.length(text) - F.length(F.replace(text, F.lit("."), F.lit(""))) <= 2
    pattern, pattern_level = F.lit(0.0), F.lit(3)
    for expression, level, confidence in reversed(PATTERNS):
        hit = text.rlike(f"(?i){expression}") & few_dots
        pattern, pattern_level = F.when(hit, confidence).otherwise(pattern), F.when(hit, level).otherwise(pattern_level)
    pattern = F.when(pattern > 0, F.least(F.lit(1.0), pattern + flag(F.col("siblings") == 1, 0.1) + flag(F.col("next_length") > 100, 0.1))).otherwise(0.0)
    tagged = F.col("tag").rlike("^h[1-6]$")
    structural = F.when(tagged, 1.0).otherwise(F.least(F.lit(1.0), flag(F.col("siblings") <= 3, 0.3) + flag(F.col("bold"), 0.3) + flag(F.col("centred"), 0.2) + flag(F.col("next_tag").isin("p", "div", "table", "ul", "ol"), 0.2) + flag(words <= 10, 0.1)))
    structural_level = F.when(tagged, F.substring("tag", 2, 1).cast("int")).otherwise(3)
    contextual = F.least(F.lit(1.0), flag(_titled(text), 0.4) + flag((F.col("previous") != "") & _titled(F.col("previous")), 0.3) + flag(F.col("next_length") > 3 * F.length(text), 0.3))
    votes = [("style", style, style_level, 0.4), ("pattern", pattern, pattern_level, 0.0), ("structural", structural, structural_level, 0.5), ("contextual", contextual, F.lit(3), 0.5)]
    made = F.array(*[F.named_struct(F.lit("c"), c.cast("double"), F.lit("l"), level, F.lit("w"), F.lit(WEIGHTS[m]), F.lit("m"), F.lit(m), F.lit("ok"), c > limit) for m, c, level, limit in votes])
    rows = rows.withColumn("votes", F.filter(made, lambda v: v["ok"])).where(F.size("votes") > 0)
    total = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["c"] * v["w"])
    shares = F.aggregate("votes", F.lit(0.0), lambda a, v: a + v["w"])
    levels = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.named_struct(F.lit("v"), F.aggregate(F.filter("votes", lambda v: v["l"] == i), F.lit(0.0), lambda a, v: a + v["c"] * v["w"]), F.lit("i"), -i))
    method = F.when(F.size("votes") > 1, "combined").otherwise(F.get("votes", F.lit(0))["m"])
    found = rows.select("ref", "block", "text", (-F.array_max(levels)["i"]).alias("level"), F.round(total / shares, 6).alias("confidence"), method.alias("method"))
    return found.where(F.col("confidence") >= least)


def without_overlap(sections: DataFrame, *, by: str = "ref") -> DataFrame:
    """Sections (start, stop, confidence) whose bounds don't cross: neighbours meet half way, at a tenth less confidence.

    A gap of more than 100,000 before a section costs it as much.
    """
    from pyspark.sql import Window

    window = Window.partitionBy(by).orderBy("start", "stop")
    rows = sections.withColumns({"_before": F.lag("stop").over(window), "_after": F.lead("start").over(window)})
    early, late = F.col("start") < F.col("_before"), F.col("_after") < F.col("stop")
    far = F.col("start") - F.col("_before") > 100_000
    half = lambda a, b: F.floor((F.col(a) + F.col(b)) / 2)
    factor = F.when(early, 0.9).when(far, 0.9).otherwise(1.0) * F.when(late, 0.9).otherwise(1.0)
    moved = {"start": F.when(early, half("_before", "start")).otherwise(F.col("start")), "stop": F.when(late, half("stop", "_after")).otherwise(F.col("stop")), "confidence": F.col("confidence") * factor}
    return rows.withColumns(moved).drop("_before", "_after")
