"""Homomorphic multiset fingerprints of documents.

Each paragraph (line that isn't empty) is hashed to a wide vector of
lanes; a document's fingerprint is the lanewise sum modulo 2**32.  Paragraphs
may thus be added or taken away without reading the rest, and their order
doesn't matter.  The vector has two parts: ``EXACT`` lanes from SHAKE-128 of
the paragraph, by which equal multisets are told from different ones, and
``LIKE`` lanes, a signed sketch of the paragraph's 16-byte windows, whose cosine
estimates how much text two documents share.  A lane of the sketch is a signed
number; no text that fits a row repeats a window often enough to wrap it.

Defined cases: a null text counts as empty, and an empty text's fingerprint is
all zeros; two zero fingerprints are alike (1), a zero and another aren't (0).
In ``chain`` the order is by id, null first, then text; rows that repeat an id
follow each other; the last row's next is the first, a single row's next is
itself.  Extra input columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import range_bucket, slices

EXACT = 64
LIKE = 256
WINDOW = 16
BLOCK = 1 << 18
BUCKET_BYTES = 16 << 20
"""Text that one sorted run of documents holds, about."""
MAX_BUCKETS = 1 << 15
#: Odd multipliers of the window hash, from the fractions of square roots of primes.
MIX = [np.uint64(int((p**0.5 % 1) * 2**64) | 1) for p in (2, 3, 5)]

State = np.ndarray
"""EXACT + LIKE lanes of uint32."""


def zero() -> State:
    return np.zeros(EXACT + LIKE, np.uint32)


def _windows(data: np.ndarray) -> np.ndarray:
    """Counts by sign and lane of the 16-byte windows that hold no line end."""
    out = np.zeros(2 * LIKE, np.int64)
    for at in range(0, max(1, len(data) - WINDOW + 1), BLOCK):
        part = data[at : at + BLOCK + WINDOW - 1]
        n = len(part) - WINDOW + 1
        if n <= 0:
            break
        ends = np.concatenate([[0], np.cumsum(part == 10, dtype=np.int32)])
        inside = ends[WINDOW:] == ends[:-WINDOW]
        words = np.ndarray((len(part) - 7,), "<u8", np.ascontiguousarray(part).data, 0, (1,))
        mixed = words[:n] * MIX[0] ^ (words[8 : 8 + n] * MIX[1])
        mixed ^= mixed >> np.uint64(29)
        mixed *= MIX[2]
        out += np.bincount((mixed[inside] >> np.uint64(55)).astype(np.int64), minlength=2 * LIKE)
    return out


def paragraphs(text: str) -> list[bytes]:
    return [p for p in text.encode("utf-8", "surrogatepass").split(b"\n") if p]


def fingerprint(text: str | None) -> State:
    """The fingerprint of a whole text."""
    out = zero()
    if not text:
        return out
    data = text.encode("utf-8", "surrogatepass")
    own = [p for p in data.split(b"\n") if p]
    for i in range(0, len(own), 4096):
        digests = b"".join([hashlib.shake_128(p).digest(2 * EXACT) for p in own[i : i + 4096]])
        out[:EXACT] += np.frombuffer(digests, "<u2").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)
    counts = _windows(np.frombuffer(data, np.uint8))
    if short := [p for p in own if len(p) < WINDOW]:  # a short paragraph is one window of its own
        counts += _windows(np.frombuffer(b"\n".join(p.ljust(WINDOW, b"\0") for p in short), np.uint8))
    out[EXACT:] = (counts[LIKE:] - counts[:LIKE]).astype(np.uint32)
    return out


def insert(state: State, text: str) -> State:
    """The fingerprint after adding the paragraphs of ``text``."""
    return state + fingerprint(text)


def delete(state: State, text: str) -> State:
    """The fingerprint after taking away the paragraphs of ``text``."""
    return state - fingerprint(text)


def likeness(a: State, b: State) -> float:
    """1 for equal multisets of paragraphs, else the clipped cosine of the sketches, below 1."""
    if np.array_equal(a, b):
        return 1.0
    x, y = a[EXACT:].view(np.int32).astype(np.float64), b[EXACT:].view(np.int32).astype(np.float64)
    norm = float(np.sqrt((x @ x) * (y @ y)))
    return min(max(float(x @ y) / norm, 0.0), 0.999999) if norm else 0.0


def to_text(state: State) -> str:
    return base64.b64encode(state.astype("<u4").tobytes()).decode()


def from_text(text: str) -> State:
    return np.frombuffer(base64.b64decode(text), "<u4").astype(np.uint32)


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, fingerprint`` of every row, without a shuffle."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([to_text(fingerprint(t)) for t in part.column(1).to_pylist()], pa.string())], ["id", "fingerprint"])

    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, fingerprint string")


def chain(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows in runs sorted by id, each run closed by a copy of the row that follows it.

    Returns ``bucket, closing, id, text``: one partition per run, sorted.  The
    runs are ranges of ids from quantiles, so no task holds more than its
    range, and texts move once.
    """
    source = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    total = source.agg(F.count("id").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    wanted = min(MAX_BUCKETS, max(source.sparkSession.sparkContext.defaultParallelism, int((total["bytes"] or 0) / bucket_bytes)))
    ids = source.select("id")
    marks = ids.select(F.percentile_approx("id", [i / wanted for i in range(1, wanted)] or [0.5], 10 * wanted).alias("marks")).first()["marks"]
    splits = sorted({int(m) for m in marks or []})
    keyed = source.withColumn("bucket", range_bucket(F.col("id"), splits))
    # At most one row per bucket comes to the driver: the ids that start them.
    firsts = sorted((r["bucket"], r["first"]["id"]) for r in ids.withColumn("bucket", range_bucket(F.col("id"), splits)).groupBy("bucket").agg(F.min(F.struct("id")).alias("first")).collect())
    count = len(splits) + 1
    if not firsts:
        return keyed.select("bucket", F.lit(0).alias("closing"), "id", "text")
    spark = source.sparkSession
    before = [(firsts[i - 1][0], first) for i, (_, first) in enumerate(firsts)]
    starts = spark.createDataFrame(before, "bucket int, first bigint")
    closing = source.join(F.broadcast(starts), F.col("id").eqNullSafe(F.col("first")))
    closing = closing.groupBy("bucket", "id").agg(F.min(F.struct("text"))["text"].alias("text"))
    both = keyed.select("bucket", F.lit(0).alias("closing"), "id", "text").unionByName(closing.select("bucket", F.lit(1).alias("closing"), "id", "text"))
    return both.repartitionById(count, F.col("bucket")).sortWithinPartitions("closing", "id", "text")


def edited(text: str, following: str) -> str:
    """The text with its last quarter replaced by as much of the start of the next."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


CHAIN_SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document, of its edited text and how near the next document is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        names = [f.split()[0] for f in CHAIN_SCHEMA.split(", ")]
        held: tuple | None = None
        ended = False
        for batch in batches:
            for part in slices(batch, 3, 4 << 20):
                rows = []
                for closing, i, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    if ended:
                        continue
                    text = text or ""
                    own = fingerprint(text)
                    if held is not None:
                        j, before, state = held
                        changed = edited(before, text)
                        other = fingerprint(changed)
                        digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
                        rows.append((j, len(before), digest, to_text(state), to_text(other), likeness(state, other), likeness(state, own)))
                    held, ended = (i, text, own), bool(closing)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return chain(docs).mapInArrow(run, CHAIN_SCHEMA)
