"""Near-duplicate documents from bottom-k sketches of one hash function.

1. A text's set is its distinct word shingles, hashed once.  Texts with equal
   sets form a class; only classes go on.
2. A class's sketch is the ``k`` smallest values of its set.  Inverted lists
   map each retained value to its classes.  Two sets that are alike share at
   least half of their sketches, so a class is listed under as many of its
   rarest values only as make a common list certain then (``k//2 + 1``): a
   passage that thousands of documents share is not among the rarest values of
   any of them, a value with one holder makes no list, and a class whose
   rarest values all stand alone has no partner.
3. Within a list the overlap is generated against a hub (the class whose values
   have most holders, then others by a seeded order) for a few rounds; the sketch of the union estimates the
   similarity, and what passes is verified by exact Jaccard on full sets.
   Verified links merge classes, and lists whose classes have all merged are
   finished.  What is left, pairs of unmerged classes in a common list, is
   compared completely, block of a list against block, with the estimate
   computed in the block from finer sketches, so no list's pairs are ever emitted.
4. Components of the verified links give the result.

No link between different classes is lost but with the probability that two
sketches of alike sets share less than half (8e-7 a pair at k = 48 and similarity 0.8: fewer
than 24 of 48 draws that succeed with 0.8) or that a union sketch is off by more than ``SLACK`` (five
standard errors).

Defined cases: without words or text a row has an empty set, size 0 and is its
own component; rows with a null id are listed, but link nothing and are their own
(null) component, kept; rows that share an id are one document (each text's links
count for the id); repeated rows are equal and share component and kept
flag; extra input columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingloom.llm import shingles
from filingloom.llm.common import Scratch, join_by_size, slices
from filingloom.llm.components import connected

K = 48
SLACK = 0.3
"""How far an estimate may lie below: five standard errors of the coarse sketch, as many of the fine one."""
FINE = 256
"""Values of the sketch that the complete comparison uses, 32 bits each."""
BLOCK = 128
"""Classes of a list in one block of the complete comparison."""
HUB_ROUNDS = 1
NOWHERE = np.iinfo(np.int64).max
MIN_FILTER_BITS, MAX_FILTER_BITS = 1 << 20, 1 << 27
"""Size of the filter on ids for the second reading: 16 MB at most."""


def key_of(members: np.ndarray) -> bytes | None:
    """A digest of a whole set; None for the empty one."""
    return hashlib.blake2b(members.tobytes(), digest_size=16).digest() if len(members) else None


def signatures(docs: DataFrame, *, id_col: str, text_col: str, width: int, k: int) -> DataFrame:
    """``id, n, key, sketch`` of each row; key is a digest of the whole set, null when empty."""
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                found = shingles.sets(part.column(1).to_pylist(), width)
                keys = [key_of(s) for s in found]
                heads = [s[:k].astype(np.int64) for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in found], pa.int64()), pa.array(keys, pa.binary()), pa.array(heads, pa.list_(pa.int64()))], ["id", "n", "key", "sketch"])

    return source.mapInArrow(run, "id bigint, n bigint, key binary, sketch array<bigint>")


def filter_bits(count: int) -> int:
    """Size of a filter for so many ids: about 16 bits each, between the bounds."""
    bits = MIN_FILTER_BITS
    while bits < 16 * count and bits < MAX_FILTER_BITS:
        bits *= 2
    return bits


def bit_filter(ids: DataFrame, bits: int) -> np.ndarray:
    """A bitmap over a hash of the ids: 4 KB pieces built on the executors, bounded in size."""
    hashed = ids.select(F.pmod(F.xxhash64(F.col("id").cast("bigint")), F.lit(bits)).alias("h"))
    rows = hashed.groupBy((F.col("h") / 32768).cast("int").alias("piece")).agg(F.expr("bitmap_construct_agg(h % 32768)").alias("bits")).collect()
    out = np.zeros(bits // 8, np.uint8)
    for r in rows:
        out[r["piece"] * 4096 : (r["piece"] + 1) * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return out


def may_hold(bitmap: np.ndarray, id_: Column) -> Column:
    """Whether the filter may hold an id; False is certain, and for a null id.

    A vectorised function of the hash alone: as a literal the bitmap would
    stand in every description of the plan that the driver keeps.
    """

    @F.pandas_udf("boolean")
    def held(h: pd.Series) -> pd.Series:
        at = h.fillna(0).to_numpy(np.int64)
        return pd.Series((bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool) & h.notna().to_numpy())

    return held(F.when(id_.isNotNull(), F.pmod(F.xxhash64(id_.cast("bigint")), F.lit(len(bitmap) * 8))))


def full_sets(docs: DataFrame, wanted: DataFrame, count: int, *, id_col: str, text_col: str, width: int) -> DataFrame:
    """``id, members`` (full sets) of the ``count`` classes in ``wanted`` (id, key), from a second reading of their texts.

    A bounded bitmap of the wanted ids keeps most other texts from being
    hashed again; the join on id and key then is exact.
    """
    bits = filter_bits(count)
    bitmap = bit_filter(wanted, bits)
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("bigint")), F.lit(bits)).alias("h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((bitmap[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))
            for part in slices(batch, 1, 2 << 20):
                found = shingles.sets(part.column(1).to_pylist(), width)
                keys = [key_of(s) for s in found]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array([s.astype(np.int64) for s in found], pa.list_(pa.int64()))], ["id", "key", "members"])

    found = source.mapInArrow(run, "id bigint, key binary, members array<bigint>")
    return found.join(wanted, ["id", "key"], "left_semi").groupBy("id", "key").agg(F.first("members").alias("members")).select("id", "members")


def estimate(k: int) -> Column:
    """Similarity by the union's sketch, from columns na, sa, nb, sb (whole sets where both fit)."""
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    common = F.array_intersect("sa", "sb")
    return F.size(F.array_intersect(common, union)) / F.size(union)


def short_values(values: Column) -> Column:
    """The upper 32 of 63 bits of ascending values, as little-endian bytes."""
    four = F.transform(values, lambda v: F.substring(F.hex(F.shiftright(v, 31)), -8, 8))
    padded = F.transform(four, lambda h: F.lpad(h, 8, "0"))
    turned = F.transform(padded, lambda h: F.concat(F.substring(h, 7, 2), F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))
    return F.unhex(F.array_join(turned, ""))


GROUP = 64
"""Candidates that meet one copy of a hub's set."""


def _verified(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int, k: int, scratch: Scratch) -> DataFrame:
    """Of pairs (a, b) of classes, those whose sets are alike.

    Of a pair's classes the one with more pairs is the hub.  A candidate's set
    moves to its pairs, a hub's set once for each group of ``GROUP`` candidates; a class
    with very many pairs is spread over tasks.
    """
    pairs = scratch.write(pairs, "pairs")
    total = scratch.rows(pairs)
    near = pairs
    for side in "ab":
        counted = pairs.groupBy(side).agg(F.count("*").alias("pairs")).withColumn(f"p{side}", F.col("pairs"))
        own = counted.join(classes.select(F.col("id").alias(side), F.col("n").alias(f"n{side}"), F.col("sketch").alias(f"s{side}")), side)
        near = join_by_size(near, own, side, size="pairs", total=total)
    near = near.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).where(estimate(k) >= percent / 100 - SLACK)
    hub, other = (F.when(F.col("pa") >= F.col("pb"), F.col(x)).otherwise(F.col(y)) for x, y in ("ab", "ba"))
    near = near.select(hub.alias("hub"), other.alias("other"))
    near = scratch.write(near, "near")
    total = scratch.rows(near)
    hubs = near.groupBy("hub").agg(F.count("*").alias("pairs")).withColumn("groups", F.ceil(F.col("pairs") / GROUP).cast("int"))
    near = join_by_size(near, hubs, "hub", size="pairs", total=total).withColumn("group", F.pmod(F.xxhash64("other"), F.col("groups")).cast("int"))
    held = near.groupBy("other").agg(F.count("*").alias("pairs")).join(sets.select(F.col("id").alias("other"), F.col("members").alias("mo")), "other")
    moved = join_by_size(near.select("hub", "other", "group"), held, "other", size="pairs", total=total)
    centres = hubs.join(sets.select(F.col("id").alias("hub"), F.col("members").alias("mh")), "hub")
    centres = centres.select("hub", "mh", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("group"))
    both = moved.join(centres, ["hub", "group"]).select("hub", "other", (F.size("mh") + F.size("mo")).alias("total"), F.size(F.array_intersect("mh", "mo")).alias("common"))
    both = both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common")))
    return both.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b")).distinct()


def inverted(classes: DataFrame, total: int) -> DataFrame:
    """``value, id, weight, listed``: each class under its rarest retained values, without values of one holder.

    ``total`` is about the number of retained values.  ``listed`` repeats all the class's values here.  ``weight`` is the sum of
    the logarithms of its values' holders: copies of one text each hold a few
    values of their own, the text that they were made from holds none, so the
    heaviest class of a list is its natural hub.
    """
    held = classes.select("id", F.explode("sketch").alias("value"))
    common = held.groupBy("value").agg(F.count("*").alias("holders")).where("holders > 1")
    held = join_by_size(held, common.withColumn("size", F.col("holders")), "value", size="size", total=total)
    grouped = held.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("holders", "value"))).alias("own"))
    grouped = grouped.join(classes.select("id", F.size("sketch").alias("size")), "id")
    # size - size(own) values stand alone; they are the rarest and take their part of the prefix.
    taken = F.col("size") - F.ceil(F.col("size") / 2) + 1 - (F.col("size") - F.size("own"))
    weight = F.aggregate("own", F.lit(0.0), lambda total, x: total + F.log(x["holders"])) / F.col("size")
    few = grouped.where(taken > 0).select("id", F.round(weight, 6).alias("weight"), F.slice("own", F.lit(1), F.greatest(taken, F.lit(0)).cast("int"))["value"].alias("listed"))
    return few.select(F.explode("listed").alias("value"), "id", "weight", "listed")


def _unfinished(lists: DataFrame, total: int) -> DataFrame:
    """Rows of lists that hold more than one component; ``total`` is the number of rows."""
    ends = lists.groupBy("value").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi")
    return join_by_size(lists, ends.select("value", "size"), "value", size="size", total=total)


def _blocks(lists: DataFrame, classes: DataFrame, percent: int, total: int) -> DataFrame:
    """Every pair (a, b) of one list and two components that passes the estimate, block against block.

    Within a list the classes outside its largest component are compared with
    all others.  A pair is compared only in the first of the lists it shares.
    """
    parts = lists.groupBy("value", "component").agg(F.count("*").alias("m"))
    main = parts.groupBy("value").agg(F.max(F.struct("m", "component"))["component"].alias("main"), F.sum("m").alias("all"), F.max("m").alias("most"))
    rows = join_by_size(lists, main.withColumn("size", F.col("all")), "value", size="size", total=total).join(classes.select("id", "n", "fine"), "id")
    row = F.struct("id", "component", "n", "fine", "listed")

    def cut(part: DataFrame, size: Column, block: str, rows_: str) -> DataFrame:
        blocks = F.ceil(size / BLOCK).cast("int")
        part = part.withColumn(block, F.pmod(F.xxhash64("id", "value"), blocks).cast("int"))
        return part.groupBy("value", block).agg(F.collect_list(row).alias(rows_), F.first(F.ceil(F.col("all") / BLOCK).cast("int")).alias("blocks"))

    left = cut(rows.where("component <> main"), F.col("all") - F.col("most"), "i", "x")
    left = left.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = cut(rows, F.col("all"), "j", "y").drop("blocks")
    tasks = left.join(right, ["value", "j"]).select("value", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in range(batch.num_rows):
                value, x, y = (batch.column(c)[t].as_py() for c in range(3))
                minor = {r["id"] for r in x}
                fine = [np.frombuffer(s["fine"], "<u4") for s in y]
                grid = np.full((len(y), max(map(len, fine))), 0xFFFFFFFF, np.uint32)
                for q, f in enumerate(fine):
                    grid[q, : len(f)] = f
                sizes = np.array([s["n"] for s in y])
                ends = np.array([f[-1] if len(f) < s["n"] else 0xFFFFFFFE for f, s in zip(fine, y, strict=True)], np.uint32)
                whole = np.array([len(f) == s["n"] for f, s in zip(fine, y, strict=True)])
                of = np.array([s["component"] for s in y])
                widest = max(len(s["listed"]) for s in y)
                lists_ = np.full((len(y), widest), NOWHERE, np.int64)
                for q, s in enumerate(y):
                    lists_[q, : len(s["listed"])] = s["listed"]
                a, b = [], []
                for r in x:
                    may = (100 * np.minimum(sizes, r["n"]) >= percent * np.maximum(sizes, r["n"])) & (of != r["component"])
                    # each pair once: in the first list of both, and from the smaller id where both sides hold both
                    first = np.where(np.isin(lists_, r["listed"]), lists_, NOWHERE).min(axis=1)
                    may &= first == value
                    if not may.any():
                        continue
                    own = np.frombuffer(r["fine"], "<u4")
                    full = len(own) == r["n"]
                    upto = np.minimum(ends[may], 0xFFFFFFFE if full else own[-1])
                    part = grid[may]
                    at = np.searchsorted(own, part)
                    at[at == len(own)] = 0
                    below = part <= upto[:, None]
                    common = ((own[at] == part) & below).sum(axis=1)
                    union = below.sum(axis=1) + np.searchsorted(own, upto, "right") - common
                    slack = np.where(whole[may] & full, 0.001, np.minimum(SLACK, 2 / np.sqrt(union)))
                    for q in np.flatnonzero(may)[common >= (percent / 100 - slack) * union].tolist():
                        other = y[q]["id"]
                        if other > r["id"] or other not in minor:
                            a.append(r["id"])
                            b.append(other)
                if a:
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return tasks.mapInArrow(run, "a bigint, b bigint").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """``id, n_shingles, component_id, kept`` for each row of docs."""
    scratch = Scratch(docs.sparkSession, "neardup")
    columns = {"id_col": id_col, "text_col": text_col, "width": width}
    signed = scratch.write(signatures(docs, k=k, **columns), "signatures")
    held = signed.where("key is not null and id is not null")
    classes = scratch.write(held.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")), "classes")
    lists = inverted(classes, k * scratch.rows(classes)).withColumn("component", F.col("id"))
    active = scratch.write(lists, "lists")
    small = scratch.write(classes.join(active.select("id").distinct(), "id", "left_semi"), "listed")
    sets = scratch.write(full_sets(docs, small.select("id", "key"), scratch.rows(small), **columns), "sets")
    fine = sets.select("id", F.size("members").cast("bigint").alias("n"), short_values(F.slice("members", 1, FINE)).alias("fine"))
    labels = links = None
    for round_ in range(HUB_ROUNDS + 1):
        total = scratch.rows(active)
        if not total:
            break
        if round_ < HUB_ROUNDS:
            order = -F.col("weight") if round_ == 0 else F.xxhash64("id", F.lit(round_)).cast("double")
            hubs = active.groupBy("value").agg(F.min(F.struct(order.alias("order"), "id", "component")).alias("hub"), F.count("*").alias("size"))
            pairs = join_by_size(active, hubs, "value", size="size", total=total).where(F.col("component") != F.col("hub.component"))
            pairs = pairs.select(F.least("id", "hub.id").alias("a"), F.greatest("id", "hub.id").alias("b")).distinct()
        else:
            pairs = _blocks(active, fine, percent, total)
        found = scratch.write(_verified(pairs, small, sets, percent, k, scratch), "links")
        links = found if links is None else links.unionByName(found)
        labels = scratch.write(connected(links, "a", "b", scratch), "labels")
        if round_ < HUB_ROUNDS:
            again = active.drop("component").join(labels, F.col("id") == F.col("node"), "left").withColumn("component", F.coalesce("component", "id")).drop("node")
            after = scratch.write(_unfinished(again, total), "active")
            scratch.drop(active)
            active = after
    first = classes.select("key", F.col("id").alias("first"), "copies")
    if labels is not None:
        first = first.join(labels, F.col("first") == F.col("node"), "left").select("key", F.coalesce("component", "first").alias("first"), "copies")
    # a group of copies is one key: its rows are spread
    own = join_by_size(signed.select("id", "n", "key"), first, "key", size="copies", total=scratch.rows(signed), how="left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("first", "id"))
    return own.select("id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
