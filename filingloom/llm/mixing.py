"""Mixing sources to target weights with a low-discrepancy schedule.

Targets: sources in code-point order (null last) weigh 5, 2, 1, repeating, and
share all words; no target exceeds ``MOST`` times its source's size, and the
excess is shared again by weight until none does (which is a water level: the
target is the lesser of weight x level and the limit).

Each source's documents are shuffled by a hash of their id and laid end to end;
the line is cut into blocks of ``block`` words.  The schedule is one slot per
block of output: slot i is the golden-ratio point i * phi mod 1, which falls into
one source's share of the cumulative targets.  Slots are ranked per source,
and the r-th slot takes block r modulo the source's number of blocks, so each
pass goes through all its blocks in shuffled order before the next begins.
Points are evenly spread, so every stretch of the schedule, and every source's
number of slots, keeps the shares.

Slots are too coarse for a source of few blocks, so it is settled by words: its
line is taken in whole passes and once more up to the word that makes its
rounded target; its pieces share slots of the schedule, evenly spread.

Everything is DataFrame functions.  Offsets within a source and ranks within
the schedule are sums over bounded buckets plus windows inside a bucket, so a
source of a third of all rows, or a long schedule, never meets in one task.

Defined cases: a null text has size 0; size-0 documents are taken 0 times;
a null source is a source of its own; null ids shuffle as one id; repeated
rows are separate; equal (id, size) rows of a source are interchangeable;
extra columns are ignored; without words nothing is taken.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.common import WORD_PATTERN, Scratch

WEIGHTS = (5, 2, 1)
MOST = 3
BLOCK = 128
"""Words of a block."""
FEW, FEW_OUT = 16, 8
"""Sources of fewer blocks, or with targets of fewer, are settled by words."""
CELLS = 4096
"""Parts of the circle of points."""
CHUNK = 65_536
"""Slots ranked together."""
#: The golden ratio's fraction times 2**31, made odd: a full-period integer step.
STEP, PERIOD = 1_327_217_885, 1 << 31


def size_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def shuffled(key: Column) -> Column:
    """60 bits of a digest of an id: the shuffled order, whose top bits are the bucket."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``source, n (place), weight, source_size, target`` from (source, source_size) rows, one per source."""
    everyone = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("n", F.row_number().over(everyone) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("n", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("limit", F.col("source_size") * most)
    # In order of limit / weight the sources up to some place are at their limits; the level is set by the rest.
    before = Window.orderBy(F.col("limit") / F.col("weight"), "n").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy(F.col("limit") / F.col("weight"), "n").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    level = (total - F.coalesce(F.sum("limit").over(before), F.lit(0))) / F.sum("weight").over(rest)
    ranked = ranked.withColumn("level", level)
    held = F.min(F.when(F.col("level") * F.col("weight") <= F.col("limit"), F.struct(F.col("limit") / F.col("weight"), "n", "level"))).over(Window.partitionBy())
    ranked = ranked.withColumn("final", held["level"])
    target = F.least(F.col("weight") * F.col("final"), F.col("limit").cast("double"))
    return ranked.select("source", "n", "weight", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


BUCKET_ROWS = 100_000


def bucket_bits(count: int) -> int:
    """Bits of the order that tell buckets apart: at least 10, and so many that a source of all ``count`` rows has few in each."""
    return min(24, max(10, (count // BUCKET_ROWS).bit_length()))


def lines(rows: DataFrame, bits: int = 10) -> DataFrame:
    """Adds ``start``: each document's first place on its source's line.  Needs n, order, size."""
    rows = rows.withColumn("bucket", F.shiftright("order", 60 - bits))
    sums = rows.groupBy("n", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("n").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("n", "bucket", F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("base"))
    inside = Window.partitionBy("n", "bucket").orderBy("order", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("offset", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["n", "bucket"])
    return placed.withColumn("start", F.col("base") + F.col("offset")).drop("bucket", "offset", "base")


def schedule(shares: DataFrame, slots: int) -> DataFrame:
    """``slot, n, rank`` (within the source, from 0) for each slot.

    ``shares`` has one row per source: place n, target.  Sources take stretches
    of a circle of PERIOD points; the circle is cut into CELLS so that points
    find their stretch by an equality join.
    """
    upto = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("target").over(Window.partitionBy())
    bound = lambda part: F.floor(F.coalesce(part, F.lit(0.0)) / total * PERIOD + 0.5).cast("bigint")
    width = PERIOD // CELLS
    stretches = shares.where("target > 0").select("n", bound(F.sum("target").over(before)).alias("lo"), bound(F.sum("target").over(upto)).alias("hi")).where("lo < hi")
    stretches = stretches.withColumn("cell", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))))
    slot = shares.sparkSession.range(slots).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(PERIOD)) * STEP, F.lit(PERIOD)).alias("point"))
    slot = slot.withColumn("cell", F.floor(F.col("point") / width))
    found = slot.join(stretches, "cell").where("lo <= point and point < hi").select("slot", "n", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    counts = found.groupBy("chunk", "n").agg(F.count("*").alias("of"))
    earlier = Window.partitionBy("n").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("chunk", "n", F.coalesce(F.sum("of").over(earlier), F.lit(0)).alias("base"))
    inside = F.row_number().over(Window.partitionBy("chunk", "n").orderBy("slot")) - 1
    return found.withColumn("inside", inside).join(bases, ["chunk", "n"]).select("slot", "n", (F.col("base") + F.col("inside")).alias("rank"))


class Mix:
    """The parts of a mix over ``docs``; ``keep`` columns travel with each document."""

    def __init__(self, docs: DataFrame, keep: list[str], write: Callable[[DataFrame, str], DataFrame], *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block: int = BLOCK) -> None:
        kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
        rows = docs.select(*kept, F.col(source_col).alias("source"), size_of(F.col(text_col)).alias("size"), shuffled(F.col(id_col)).alias("order"))
        self.rows = write(rows, "sizes")
        self.bits = bucket_bits(Scratch.rows(self.rows))
        totals = self.rows.groupBy("source").agg(F.sum("size").alias("source_size"))
        self.targets = write(targets(totals, weights, most), "targets")
        self.block = block
        self.most = most
        self.keep = keep
        self.few = (F.col("source_size") < FEW * block) | (F.col("target") < FEW_OUT * block)
        sums = self.targets.agg(F.sum("source_size").alias("words"), F.sum(F.when(self.few, F.round("target"))).alias("few")).first()
        self.slots = -(-max(0, int(sums["words"] or 0) - int(sums["few"] or 0)) // block)
        self.schedule = schedule(self.targets.where(~self.few).select("n", "target"), self.slots)
        # whole passes of a source settled by words, and where its last one ends
        goal = F.round("target").cast("bigint")
        self.passes = F.floor(goal / F.col("source_size"))
        self.end = F.pmod(goal, "source_size")

    def placed(self) -> DataFrame:
        """Documents with words, laid on their source's line: ``n, order, start, size`` and the kept columns."""
        named = self.rows.alias("r").join(self.targets.select("source", "n", "source_size", "target").alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).drop(F.col("t.source"))
        return lines(named, self.bits).where("size > 0")

    def block_at(self, place: Column) -> Column:
        """The block that holds a place of a line; settled sources have two, up to their last pass's end and from there."""
        return F.when(self.few, (place >= self.end).cast("bigint")).otherwise(F.floor(place / self.block))

    def begin(self) -> Column:
        """The first place of ``block``."""
        return F.when(self.few, F.col("block") * self.end).otherwise(F.col("block") * self.block)

    def pieces(self) -> DataFrame:
        """Documents cut at block bounds: ``n, block, order, start, size, words`` and the kept columns."""
        placed = self.placed()
        cut = placed.withColumn("block", F.explode(F.sequence(self.block_at(F.col("start")), self.block_at(F.col("start") + F.col("size") - 1))))
        stop = F.when(self.few, F.when(F.col("block") == 0, self.end).otherwise(F.col("source_size"))).otherwise((F.col("block") + 1) * self.block)
        own = F.least(F.col("start") + F.col("size"), stop) - F.greatest(F.col("start"), self.begin())
        return cut.withColumn("words", own)

    def settled(self) -> DataFrame:
        """``slot, n, pass, block`` of the sources settled by words."""
        few = self.targets.where(self.few & (F.col("source_size") > 0))
        both = few.select("n", self.passes.alias("passes"), self.end.alias("end"), F.explode(F.sequence(F.lit(0).cast("bigint"), self.passes)).alias("pass"))
        both = both.withColumn("block", F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))))
        both = both.where(F.when(F.col("block") == 0, F.col("end") > 0).otherwise(F.col("pass") < F.col("passes")))
        phase = F.pmod(F.pmod("n", F.lit(PERIOD)) * STEP, F.lit(PERIOD)) / PERIOD
        place = (F.col("pass") + (F.col("block") + phase) / 2) / (F.col("passes") + 1)
        return both.select(F.floor(place * max(1, self.slots)).alias("slot"), "n", "pass", "block")

    def turns(self) -> DataFrame:
        """How often the schedule takes each block: ``n, block, times``.  The limit holds for every block."""
        blocks = self.targets.select("n", F.ceil(F.col("source_size") / self.block).alias("blocks"))
        ranked = self.schedule.join(blocks, "n").where(F.col("rank") < self.most * F.col("blocks"))
        turns = ranked.select("n", F.pmod("rank", "blocks").alias("block")).unionByName(self.settled().select("n", "block"))
        return turns.groupBy("n", "block").agg(F.count("*").alias("times"))

    def scheduled(self) -> DataFrame:
        """The mix itself: ``slot, pass, n, block``, words [from, to) of which document."""
        blocks = self.targets.select("n", F.ceil(F.col("source_size") / self.block).alias("blocks"))
        ranked = self.schedule.join(blocks, "n").where(F.col("rank") < self.most * F.col("blocks"))
        taken = ranked.select("slot", "n", F.floor(F.col("rank") / F.col("blocks")).alias("pass"), F.pmod("rank", "blocks").alias("block")).unionByName(self.settled())
        kept = [F.col(f"k{i}").alias(c) for i, c in enumerate(self.keep)]
        begin = F.greatest(self.begin() - F.col("start"), F.lit(0))
        return self.pieces().withColumn("from", begin).join(taken, ["n", "block"]).select("slot", "pass", "source", *kept, "from", (F.col("from") + F.col("words")).alias("to"))

    def taken(self) -> DataFrame:
        """One row per document: the kept columns, size, source_size, target and the words taken."""
        kept = [f"k{i}" for i in range(len(self.keep))]
        group = ["n", "start", "size", "source_size", "target", *kept]
        some = self.pieces().join(self.turns(), ["n", "block"], "left")
        some = some.groupBy(*group).agg(F.coalesce(F.sum(F.col("words") * F.col("times")), F.lit(0)).alias("taken"))
        named = self.rows.where("size = 0").alias("r").join(self.targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source")))
        none = named.select(*kept, "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"))
        both = some.select(*kept, "size", "source_size", "target", F.col("taken").cast("bigint").alias("taken")).unionByName(none)
        return both.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(self.keep)], "size", "source_size", "target", "taken")
