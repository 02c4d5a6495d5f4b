"""Order-dependent steps over chunks and lines, as window functions inside a document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: How filings label items, parts and signatures.
ITEM_LABEL = "(?im)^(Item\\s{1,3}[0-9]{1,2}[A-Z]?)\\.?"
DECIMAL_LABEL = "(?im)^(Item\\s{1,3}[0-9]{1,2}\\.[0-9]{2})\\.?"
PART_LABEL = "(?im)^\\b(PART\\s+[IVXLC]+)\\b"
SIGNATURE_START, SIGNED = "(?i)^SIGNATURE", "to be signed on its behalf by the undersigned"
CONTENTS_CHUNKS, CONTENTS_WORD, CONTENTS_COUNT = 100, "(?i)item", 10


def forward_fill(rows: DataFrame, columns: list[str], *, by: list[str], order: str) -> DataFrame:
    """Each null takes the last value before it in its group."""
    window = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumns({c: F.last(c, ignorenulls=True).over(window) for c in columns})


def chunk_labels(chunks: DataFrame, *, by: str = "ref", order: str = "chunk", text: str = "text", item_label: str = ITEM_LABEL) -> DataFrame:
    """Chunks with their item and part carried down; ``item_label`` is the pattern of an item's label (DECIMAL_LABEL for current reports).

    A table-of-contents chunk (of the first 100, with more than ten times
    "item") resets the item; from the first signature on there is none.
    """
    found = lambda pattern: F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))
    item = found(item_label)
    part = F.upper(F.regexp_replace(found(PART_LABEL), "\\s+", " "))
    toc = (F.col(order) < CONTENTS_CHUNKS) & (F.regexp_count(text, F.lit(CONTENTS_WORD)) > CONTENTS_COUNT)
    signature = F.col(text).rlike(SIGNATURE_START) | F.contains(text, F.lit(SIGNED))
    rows = chunks.withColumns({"toc": toc, "signature": signature, "item": F.when(toc, F.lit("")).otherwise(item), "part": part})
    rows = forward_fill(rows, ["item", "part"], by=[by], order=order)
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ended = F.max(F.col("signature")).over(before)
    shown = lambda c: F.initcap(F.trim(F.regexp_replace(c, "\\s+", " ")))
    return rows.withColumns({"item": F.when(ended, F.lit("")).otherwise(F.coalesce(shown(F.col("item")), F.lit(""))), "part": F.coalesce(shown(F.col("part")), F.lit(""))})


def sections_of_chunks(labelled: DataFrame, *, by: str = "ref", order: str = "chunk", text: str = "text") -> DataFrame:
    """(ref, item, place, text): an item's chunks in order, without contents and empty chunks."""
    rows = labelled.where((F.col("item") != "") & ~F.col("toc") & (F.trim(text) != ""))
    grouped = rows.groupBy(by, "item").agg(F.min(order).alias("place"), F.array_sort(F.collect_list(F.struct(order, text)))[text].alias("parts"))
    return grouped.select(by, "item", "place", F.array_join("parts", "\n").alias("text"))


def ends_before_next(marks: DataFrame, *, by: str, order: str = "offset", end: str = "length") -> DataFrame:
    """Each mark's end: where the next one begins, else the document's length."""
    window = Window.partitionBy(by).orderBy(order)
    return marks.withColumn("stop", F.coalesce(F.lead(order).over(window), F.col(end)))


def ends_at_other_item(marks: DataFrame, *, by: str, order: str = "offset", item: str = "item", end: str = "length") -> DataFrame:
    """Each mark's end: the next mark that names a different item.

    Marks without an item are skipped over; runs of one item share their end.
    """
    named = marks.where(F.col(item).isNotNull())
    window = Window.partitionBy(by).orderBy(order)
    changes = named.withColumn("starts", (F.lag(item).over(window).isNull() | (F.lag(item).over(window) != F.col(item))).cast("int"))
    starts = changes.where("starts = 1").select(by, F.col(order).alias("next"), F.lag(order).over(window).alias("from"))
    spans = starts.where("`from` is not null")
    joined = marks.alias("m").join(spans.alias("s"), (F.col(f"m.{by}") == F.col(f"s.{by}")) & (F.col(f"m.{order}") >= F.col("s.from")) & (F.col(f"m.{order}") < F.col("s.next")), "left")
    return joined.select("m.*", F.coalesce("s.next", F.col(f"m.{end}")).alias("stop"))


def ends_at_level(marks: DataFrame, *, by: str, order: str = "offset", level: str = "level", end: str = "length", levels: int = 6) -> DataFrame:
    """Each heading's end: the next heading of its level or a higher one (a smaller number), else the document's length."""
    after = Window.partitionBy(by).orderBy(order).rowsBetween(1, Window.unboundedFollowing)
    nearest = F.array(*[F.min(F.when(F.col(level) <= i, F.col(order))).over(after) for i in range(1, levels + 1)])
    return marks.withColumn("stop", F.coalesce(F.get(nearest, F.col(level) - 1), F.col(end)))


def page_runs(spans: DataFrame, *, by: list[str], order: str, number: str) -> DataFrame:
    """Numbers that belong to a run of at least two, each one more than the one before: page numbers."""
    window = Window.partitionBy(*by).orderBy(order)
    rows = spans.withColumn("_step", F.when(F.col(number) == F.lag(number).over(window) + 1, 0).otherwise(1))
    rows = rows.withColumn("run", F.sum("_step").over(window.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    size = F.count("*").over(Window.partitionBy(*by, "run"))
    return rows.withColumn("run_size", size).where("run_size > 1").drop("_step")


def navigation_lines(lines: DataFrame, *, by: list[str], order: str, line: str, least: int = 5, keep: int = 2) -> DataFrame:
    """Lines without the repetitions of navigation text.

    A line that is repeated at least ``least`` times in a document stays only
    the first ``keep`` times.
    """
    same = Window.partitionBy(*by, line)
    rows = lines.withColumns({"_count": F.count("*").over(same), "_place": F.row_number().over(same.orderBy(order))})
    return rows.where((F.col("_count") < least) | (F.col("_place") <= keep)).drop("_count", "_place")


def most_common(rows: DataFrame, *, by: list[str], value: str, order: str) -> DataFrame:
    """The commonest value of each group; of equally common ones the first to appear."""
    counts = rows.groupBy(*by, value).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return counts.groupBy(*by).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value), F.max("n").alias("n"))


def vote(rows: DataFrame, *, by: list[str]) -> DataFrame:
    """Weighted mean of confidences, and the level with the largest vote (the lowest of equal ones)."""
    levels = rows.groupBy(*by, "level").agg(F.sum(F.col("confidence") * F.col("weight")).alias("v"), F.sum("weight").alias("w"))
    return levels.groupBy(*by).agg((F.sum("v") / F.sum("w")).alias("confidence"), F.max_by("level", F.struct("v", -F.col("level"))).alias("level"))


def share(flag: Column) -> Column:
    """Share of rows for which a condition holds."""
    return F.avg(flag.cast("double"))


def parity(found: DataFrame, expected: DataFrame, *, keys: list[str], value: str, by: str = "statement", tolerance: float = 1e-6) -> DataFrame:
    """Matched and expected facts of each statement, against an independent source."""
    both = expected.join(found.select(*keys, F.col(value).alias("_found")), keys, "left")
    matched = F.abs(F.col(value) - F.col("_found")) <= tolerance * F.greatest(F.abs(F.col(value)), F.lit(1.0))
    return both.groupBy(by).agg(F.count_if(F.coalesce(matched, F.lit(False))).alias("matched"), F.count("*").alias("expected"))
