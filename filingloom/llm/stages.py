"""The operators as stages over a table of documents.

Each stage takes and returns the columns of its input, whatever they are;
``doc_id``, ``text``, ``lang`` and ``source`` must be among them.  No stage
bounds a text's length, and an empty table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm import langid, mixing, neardup, pii
from filingloom.llm.common import Scratch


KNOWN = 0.4


def keep_languages(docs: DataFrame, *, languages: Collection[str] | None = None, known: float = KNOWN, least: float = 0.0, identifier: langid.LanguageIdentifier | None = None) -> DataFrame:
    """Keep documents that are recognised as one of ``languages`` (all learned ones by default).

    Recognised is a text whose predicted label is among them with a score of at
    least ``least``, and of whose n-grams the model's landmarks hold at least the
    share ``known``.  So texts in scripts or languages that no label stands for
    go, and null texts and texts without a letter.  A document's own label plays
    no part, but that the model is fitted on the labels (unless ``identifier`` is
    given).  Without any labelled text nothing can be recognised, and then every
    document that has a letter stays.  Texts of any length are scored whole; rows
    that repeat are judged alike; an empty table gives an empty one.
    """
    identifier = identifier or langid.LanguageIdentifier.fit(docs)
    if identifier.model is None:
        return docs.where(F.col("text").rlike("\\p{L}"))
    names = [f"x{i}" for i in range(len(docs.columns))]
    text = names[docs.columns.index("text")]
    judged = identifier.predict(docs.toDF(*names), names, text_col=text)
    kept = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("known") >= known) & (F.col("score") >= least)
    if languages is not None:
        kept = kept & F.col("lang_pred").isin(*languages)
    return judged.where(kept).select(*names).toDF(*docs.columns)


def drop_near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80) -> DataFrame:
    """Keep the document with the smallest id of each group of near duplicates.

    Rows that repeat a kept id leave one row.  Rows with a null id stay.
    """
    scratch = Scratch(docs.sparkSession, "dedup")
    found = scratch.write(neardup.components(docs, width=width, percent=percent).select("id", "kept"), "kept")
    counted = found.where("id is not null").groupBy("id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    # ids with more to do than passing their row on: dropped ones and repeated ones
    marked = scratch.write(counted.where("not kept or rows > 1"), "marked")
    names = [f"x{i}" for i in range(len(docs.columns))]
    key, text = (names[docs.columns.index(c)] for c in ("doc_id", "text"))
    rows = docs.toDF(*names)
    bitmap = neardup.bit_filter(marked, neardup.filter_bits(scratch.rows(marked)))
    may = neardup.may_hold(bitmap, F.col(key))
    # Only texts that the filter may hold are moved; the join is exact, and the same at every size.
    looked = rows.where(may).join(marked.hint("merge"), F.col(key) == F.col("id"), "left")
    single = looked.where(F.col("id").isNull()).select(*names)
    several = looked.where("kept and rows > 1").withColumn("order", F.to_json(F.struct(F.xxhash64(text).alias("hash"), *[F.col(n).cast("string") for n in names])))
    # of rows that repeat a kept id the one with the smallest text hash stays
    several = several.groupBy(key).agg(F.min_by(F.struct(*names), "order").alias("row")).select("row.*")
    return rows.where(~may).unionByName(single).unionByName(several.select(*names)).toDF(*docs.columns)


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """Replace personal data in the texts by its kind."""
    return pii.mask(docs)


def mix_sources(docs: DataFrame) -> DataFrame:
    """Take documents as often as the schedule takes the block that holds their middle word: 0 to 3 times.

    A document is never cut, so a source's words come within a few documents
    of its target.  Documents without words are never taken.
    """
    scratch = Scratch(docs.sparkSession, "mixed")
    mix = mixing.Mix(docs, ["doc_id", "source"], scratch.write)
    turns = mix.turns()
    middle = mix.block_at(F.col("start") + F.floor(F.col("size") / 2))
    placed = mix.placed().withColumn("block", middle).join(turns, ["n", "block"])
    # Rows equal in id, source and size share their turns evenly.
    copies = placed.groupBy(F.col("k0").alias("k0"), F.col("k1").alias("k1"), F.col("size").alias("words")).agg(F.round(F.sum("times") / F.count("*")).cast("int").alias("copies"))
    copies = scratch.write(copies, "copies")
    names = [f"x{i}" for i in range(len(docs.columns))]
    of = dict(zip(docs.columns, names, strict=True))
    rows = docs.toDF(*names).withColumn("words", mixing.size_of(F.col(of["text"])))
    same = F.col(of["doc_id"]).eqNullSafe(F.col("k0")) & F.col(of["source"]).eqNullSafe(F.col("k1")) & (rows["words"] == copies["words"])
    taken = rows.join(copies.hint("merge"), same).withColumn("turn", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return taken.select(*names).toDF(*docs.columns)
