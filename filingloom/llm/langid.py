"""Language identification with string kernels.

Two texts are compared by the blended spectrum presence kernel: the number of
distinct character n-grams (n = 1..3, over letters, everything else a space)
that both hold, divided by the root of the product of their numbers.  A
Nyström map over landmark texts turns the kernel into features, and one kernel
ridge regression per language (one versus the rest) is fitted on them.  A
batch of texts is scored by two matrix products: presence by landmarks gives
the kernel values, kernel values by coefficients give the scores.

The classifier is fitted on a bounded sample: ``per_class`` labelled texts for
each label, the first by a hash of their id.  Scoring reads whole texts.

Defined cases: a null text, or one without a letter, is ``und`` with score 0;
a null label isn't learned from; without any labelled text every prediction is
``und``; with one label every text with a letter gets it; of labels with equal
scores the first by name is taken; a very long text is read block by block;
repeated rows get equal answers; extra input columns are ignored.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingloom.llm.common import slices

UNDETERMINED = "und"
PER_CLASS = 200
"""Texts drawn for each label: the bound of the fit."""
LANDMARKS_PER_CLASS, LANDMARKS = 32, 512
"""Landmarks of a label at most, and of all labels: a worker holds a dense matrix of landmarks by their n-grams, 4 bytes each."""
SAMPLE_CHARS = 20_000
"""Texts up to this length are drawn first, so that the sample stays small."""
MAX_CLASSES = 256
RIDGE = 1e-2
BLOCK_CHARS = 1 << 18
BATCH = 64


@lru_cache(maxsize=1)
def folding() -> np.ndarray:
    """For each code point its lower-case letter, or a space if it is no letter or mark."""
    out = np.full(0x110000, 32, np.uint32)
    for code in [*range(0x32400), *range(0xE0100, 0xE01F0)]:
        letter = chr(code)
        if unicodedata.category(letter)[0] in "LM":
            out[code] = ord(letter.lower()[0])
    return out


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    out = np.zeros(0x110000, bool)
    for code in range(0x32400):
        out[code] = chr(code).isalpha()
    return out


def grams(text: str | None) -> np.ndarray | None:
    """The distinct 1- to 3-grams of a text, packed and sorted; None if it has no letter."""
    if not text:
        return None
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    found: np.ndarray | None = None
    any_letter = False
    for at in range(0, len(codes), BLOCK_CHARS):
        block = codes[max(0, at - 2) : at + BLOCK_CHARS]
        any_letter = any_letter or bool(letters()[block].any())
        a = folding()[block]
        space = a == 32
        if at == 0:
            a, space = np.concatenate([[np.uint64(32)], a]), np.concatenate([[True], space])
        if at + BLOCK_CHARS >= len(codes):
            a, space = np.concatenate([a, [np.uint64(32)]]), np.concatenate([space, [True]])
        keep = np.ones(len(a), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        a = a[keep].astype(np.uint64)
        two = a[:-1] << np.uint64(21) | a[1:]
        three = two[:-1] << np.uint64(21) | a[2:]
        own = np.unique(np.concatenate([a, two, three]))
        found = own if found is None else np.union1d(found, own)
    return found if any_letter else None


@dataclass
class Model:
    """Landmarks' n-grams and the coefficients of each label's regression."""

    labels: list[str]
    vocabulary: np.ndarray
    landmarks: list[np.ndarray]
    sizes: np.ndarray
    coefficients: np.ndarray

    def presence(self) -> np.ndarray:
        """Landmarks by vocabulary, each row divided by the root of its number of n-grams."""
        out = np.zeros((len(self.landmarks), len(self.vocabulary)), np.float32)
        for i, columns in enumerate(self.landmarks):
            out[i, columns] = 1 / np.sqrt(self.sizes[i])
        return out


def rows_of(model: Model, sets: list[np.ndarray]) -> np.ndarray:
    """Texts (by their n-grams) by vocabulary, each row divided by the root of the text's number of n-grams."""
    block = np.zeros((len(sets), len(model.vocabulary)), np.float32)
    for i, own in enumerate(sets):
        at = np.searchsorted(model.vocabulary, own)
        at[at == len(model.vocabulary)] = 0
        block[i, at[model.vocabulary[at] == own]] = 1 / np.sqrt(len(own))
    return block


def kernel(model: Model, presence: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Kernel values of texts against the landmarks."""
    return rows_of(model, sets) @ presence.T


def fit(sample: list[tuple[str, np.ndarray]], landmarks_per_class: int = LANDMARKS_PER_CLASS, ridge: float = RIDGE) -> Model | None:
    """Fit on (label, n-grams) rows; their order decides the landmarks."""
    if not sample:
        return None
    labels = sorted({label for label, _ in sample})
    landmarks_per_class = max(1, min(landmarks_per_class, LANDMARKS // len(labels)))
    marks: list[np.ndarray] = []
    for label in labels:
        marks += [g for lab, g in sample if lab == label][:landmarks_per_class]
    vocabulary = np.unique(np.concatenate(marks))
    model = Model(labels, vocabulary, [np.searchsorted(vocabulary, g) for g in marks], np.array([len(g) for g in marks], np.float64), np.zeros((0, 0)))
    presence = model.presence()
    among = kernel(model, presence, marks).astype(np.float64)
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    held = values > 1e-6 * values.max()
    root = vectors[:, held] / np.sqrt(values[held])
    rows = [kernel(model, presence, [g for _, g in sample[i : i + BATCH]]) for i in range(0, len(sample), BATCH)]
    features = np.concatenate(rows).astype(np.float64) @ root
    features = np.concatenate([features, np.ones((len(features), 1))], axis=1)
    targets = np.where(np.array([label for label, _ in sample])[:, None] == np.array(labels)[None, :], 1.0, -1.0)
    penalty = ridge * np.eye(features.shape[1]) * len(sample) / 100
    weights = np.linalg.solve(features.T @ features + penalty, features.T @ targets)
    model.coefficients = np.concatenate([root @ weights[:-1], weights[-1:]])
    return model


def scores(model: Model, presence: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Regression values, texts by labels, and each text's share of n-grams that a landmark holds."""
    rows = rows_of(model, sets)
    values = (rows @ presence.T).astype(np.float64) @ model.coefficients[:-1] + model.coefficients[-1]
    return values, np.einsum("ij,ij->i", rows, rows)


def draw(docs: DataFrame, id_col: str, text_col: str, label_col: str, per_class: int) -> list[tuple[str, np.ndarray]]:
    """The sample: for each label the first ``per_class`` texts by length class and a hash of the id.

    Labels are counted first (one row each); a hash threshold from the counts
    then lets only a few times the sample into the sort, whatever the input's
    size or its commonest label.
    """
    source = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(label_col).alias("label")).where("label is not null and text is not null")
    source = source.withColumn("at", F.xxhash64(F.coalesce("id", F.lit(""))))
    counts = {r["label"]: r["count"] for r in source.groupBy("label").count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} labels")
    if not counts:
        return []
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col("label") == label, F.lit(min(1 << 30, (8 * per_class << 30) // n + 1))).otherwise(share)
    few = source.where(F.pmod("at", F.lit(1 << 30)) < share)
    order = Window.partitionBy("label").orderBy((F.length("text") > SAMPLE_CHARS).cast("int"), "at", F.xxhash64("text"))
    few = few.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_class).select("label", "rank", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, 4 << 20):
                found = [grams(t) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([None if g is None else g.tobytes() for g in found], pa.binary())], ["label", "rank", "grams"])

    rows = few.mapInArrow(run, "label string, rank int, grams binary").where("grams is not null").collect()
    rows.sort(key=lambda r: (r["label"], r["rank"]))
    return [(r["label"], np.frombuffer(bytes(r["grams"]), np.uint64)) for r in rows]


class LanguageIdentifier:
    """A fitted classifier over DataFrames."""

    def __init__(self, model: Model | None) -> None:
        self.model = model

    @classmethod
    def fit(cls, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_class: int = PER_CLASS, landmarks_per_class: int = LANDMARKS_PER_CLASS) -> LanguageIdentifier:
        return cls(fit(draw(docs, id_col, text_col, label_col, per_class), landmarks_per_class))

    def predict_texts(self, texts: list[str | None], presence: np.ndarray | None = None) -> list[tuple[str, float, float]]:
        """(label, score, known) of each text; of labels with equal scores the first by name."""
        out: list[tuple[str, float, float]] = [(UNDETERMINED, 0.0, 0.0)] * len(texts)
        if self.model is None:
            return out
        presence = self.model.presence() if presence is None else presence
        for start in range(0, len(texts), BATCH):
            held = [(i, g) for i in range(start, min(start + BATCH, len(texts))) if (g := grams(texts[i])) is not None]
            if not held:
                continue
            values, known = scores(self.model, presence, [g for _, g in held])
            best = values.argmax(axis=1)
            top = np.clip((values[np.arange(len(best)), best] + 1) / 2, 0, 1)
            for (i, _), b, v, k in zip(held, best, top, known, strict=True):
                out[i] = (self.model.labels[b], float(v), min(1.0, float(k)))
        return out

    def predict(self, docs: DataFrame, keep: list[str], *, text_col: str = "text") -> DataFrame:
        """``keep`` columns with ``lang_pred``, ``score`` and ``known``, which may not be among them.  No shuffle.

        ``known`` is the share of the text's n-grams that some landmark holds:
        near 0 for a language or script that no label stands for.
        """
        taken = [F.col(c).alias(f"c{i}") for i, c in enumerate(keep)]
        source = docs.select(*taken, F.col(text_col).alias("text"))
        schema = ", ".join(f"c{i} {source.schema[f'c{i}'].dataType.simpleString()}" for i in range(len(keep)))
        at = len(keep)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            presence = None if self.model is None else self.model.presence()
            for batch in batches:
                for part in slices(batch, at, 4 << 20):
                    got = self.predict_texts(part.column(at).to_pylist(), presence)
                    columns = [part.column(i) for i in range(at)] + [pa.array([g[0] for g in got], pa.string()), *[pa.array([g[i] for g in got], pa.float64()) for i in (1, 2)]]
                    yield pa.RecordBatch.from_arrays(columns, [*(f"c{i}" for i in range(at)), "lang_pred", "score", "known"])

        out = source.mapInArrow(run, f"{schema}{', ' if keep else ''}lang_pred string, score double, known double")
        return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "lang_pred", "score", "known")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept from the fit: crc32 of its id as text, modulo 4, is 2.  A null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def identify(docs: DataFrame) -> DataFrame:
    """Fit on the rows that aren't held out and predict every row."""
    model = LanguageIdentifier.fit(docs.where(~held_out()))
    return model.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), ["doc_id", "held_out"])
