"""Byte-level BPE by tree concatenation.

A long text is cut into halves, and these again, down to leaves that are
encoded on their own; neighbours are then joined pairwise.  An encoded part keeps
its ids by segments, which end where its own split into words has a boundary.
At a join the segments around the cut are encoded again, in a window that grows
by a segment of the right side at a time until that segment's end is a boundary in
the window too.  From such a boundary on the splitter, which looks back at
nothing, goes the same way in both, so the joined ids are exactly those of the
whole text.

One unbroken word (no boundary to meet) is treated likewise one level down:
its bytes are merged in halves and a window of tokens around the join is
merged again until its first and last tokens are those that the two sides
hold.  A token sequence in which every adjacent pair is what merging the pair's
own bytes gives is the sequence that merging the whole gives, so agreement on
both edges settles the rest.

Texts over ``PIECE_CHARS`` are spread: their pieces are rows, encoded in as many
tasks, and joined by the digest of their text, so a text that many documents
hold is encoded once.  Joining takes a document's ids in one task, as the document
itself was one row before.

Defined cases: a null or empty text has no tokens; special tokens of the
vocabulary file are cut out first and keep their ids (texts that hold any are
encoded in one task, whatever their length); equal texts have equal ids; rows
that repeat, or share an id, each get their row; an empty table gives an empty
one; extra columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import Scratch, join_by_size, slices

LEAF_CHARS = 16_384
"""Texts over this length are cut and joined."""
WORD_BYTES = 4_096
"""Unbroken words over this length are merged by halves."""
SEGMENT_CHARS = 1_024
"""Least length of a segment, but of a long word, which is one itself."""
PIECE_CHARS = 1 << 18
"""Texts over this length are encoded by several tasks."""
WINDOW = 64
"""Characters that a window reaches beyond the boundary it is to meet; eight times the first width of a join of tokens."""
#: A boundary so near to a text's end can still move when text follows (the splitter looks 3 characters ahead at most).
MARGIN = 4

#: How byte-level vocabularies split text into words.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in a byte-level vocabulary, from its rule.

    Printable Latin-1 bytes stand for themselves; the others take the code
    points from 256 on, in order.
    """
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


@dataclass
class Part:
    """An encoded stretch of text: its segments' ends, ids, and whether each is one long word."""

    text: str
    ends: list[int]
    ids: list[list[int]]
    long: list[bool]

    def tokens(self) -> list[int]:
        return [t for own in self.ids for t in own]


class TreeBPE:
    """Encoder and decoder for a byte-level BPE vocabulary file."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, word_bytes: int = WORD_BYTES, window: int = WINDOW, segment_chars: int = SEGMENT_CHARS) -> None:
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of: dict[int, bytes] = {}
        ranks: dict[bytes, int] = {}
        for token, i in spec["model"]["vocab"].items():
            if token not in self.special:
                ranks[bytes(letters[c] for c in token)] = i
        self.bytes_of = {i: b for b, i in ranks.items()} | {i: t.encode() for t, i in self.special.items()}
        self.core = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.special_pattern = regex.compile("|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(SPLIT)
        self.leaf_chars, self.word_bytes, self.window, self.segment_chars = leaf_chars, word_bytes, window, segment_chars

    # -- words ---------------------------------------------------------------

    def _word(self, data: bytes) -> list[int]:
        """Ids of one word's bytes; long words by halves."""
        if len(data) <= self.word_bytes:
            return self.core._encode_single_piece(data)
        middle = len(data) // 2
        return self._join_tokens(self._word(data[:middle]), self._word(data[middle:]))

    def _join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        width = max(2, self.window // 8)
        while True:
            i, j = max(0, len(left) - width), min(len(right), width)
            again = self.core._encode_single_piece(b"".join(self.bytes_of[t] for t in left[i:] + right[:j]))
            if (i == 0 or again[0] == left[i]) and (j == len(right) or again[-1] == right[j - 1]):
                return left[:i] + again + right[j:]
            width *= 2

    # -- texts ---------------------------------------------------------------

    def _split(self, text: str) -> list[int]:
        """Ends of the words of ``text``."""
        return [m.end() for m in self.words.finditer(text)]

    def _segments(self, text: str, start: int, ends: list[int], known: dict[tuple[int, int], list[int]] | None = None) -> Part:
        """The words of ``text`` from ``start`` on, which end at ``ends``, encoded by segments; ``known`` long words aren't merged again."""
        out = Part(text, [], [], [])
        solid = at = start  # ends of the last word that doesn't end in white space, and of the last word
        first = start
        blank: list[int] = []

        def close() -> None:
            if at > first:
                # White space at a text's end is split otherwise than before a word, so it goes word by word.
                ids = self.core.encode_ordinary(text[first:solid]) if solid > first else []
                for a, b in zip([solid, *blank], blank):
                    ids = ids + self.core._encode_single_piece(text[a:b].encode())
                out.ends.append(at)
                out.ids.append(ids)
                out.long.append(False)

        for end in ends:
            if end - at > self.word_bytes:
                close()
                ids = (known or {}).get((at, end))
                out.ends.append(end)
                out.ids.append(self._word(text[at:end].encode()) if ids is None else ids)
                out.long.append(True)
                first = solid = at = end
                blank = []
                continue
            if text[end - 1].isspace():
                blank.append(end)
            else:
                solid, blank = end, []
            at = end
            if at - first >= self.segment_chars:
                close()
                first = solid = at
                blank = []
        close()
        return out

    def part(self, text: str) -> Part:
        """A text without special tokens, encoded by halves."""
        if len(text) <= self.leaf_chars:
            return self._segments(text, 0, self._split(text))
        middle = len(text) // 2
        return self.join(self.part(text[:middle]), self.part(text[middle:]))

    def join(self, left: Part, right: Part) -> Part:
        """Two neighbours as one: what lies around their join is encoded again until both sides agree."""
        text, middle = left.text + right.text, len(left.text)
        keep = len(left.ends)  # segments of the left side whose end what follows can't move
        while keep and left.ends[keep - 1] > middle - MARGIN:
            keep -= 1
        begin = left.ends[keep - 1] if keep else 0
        known = {}
        if left.long and right.long and left.long[-1] and right.long[0]:
            start = left.ends[-2] if len(left.ends) > 1 else 0
            known[start, middle + right.ends[0]] = (left.ids[-1], right.ids[0])
        for j, e in enumerate(right.ends):
            end, stop = middle + e, min(len(text), middle + e + self.window)
            words = [begin + w for w in self._split(text[begin:stop])]
            if end in words and (end <= stop - MARGIN or stop == len(text)):
                words = words[: words.index(end) + 1]
                whole = {(a, b): self._join_tokens(*known[a, b]) for a, b in zip([begin, *words], words) if (a, b) in known}
                again = self._segments(text, begin, words, whole)
                return Part(text, left.ends[:keep] + again.ends + [middle + x for x in right.ends[j + 1 :]], left.ids[:keep] + again.ids + right.ids[j + 1 :], left.long[:keep] + again.long + right.long[j + 1 :])
        return left if not right.text else right  # one side is empty: the last end of a text is always met

    def _plain(self, text: str) -> list[int]:
        """Ids of a text without special tokens."""
        return self.core.encode_ordinary(text) if len(text) <= self.leaf_chars else self.part(text).tokens()

    def plain(self, text: str) -> bool:
        """Whether a text holds no special token."""
        return self.special_pattern is None or not self.special_pattern.search(text)

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text."""
        if not text:
            return []
        if self.plain(text):
            return self._plain(text)
        out: list[int] = []
        at = 0
        for m in self.special_pattern.finditer(text):
            out += self._plain(text[at : m.start()]) if m.start() > at else []
            out.append(self.special[m[0]])
            at = m.end()
        return out + (self._plain(text[at:]) if at < len(text) else [])

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes_of
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        """Number of ids, digest of the decimal ids joined by commas, digest of the decoded text."""
        decimals = self.decimals
        return len(ids), hashlib.sha256(b",".join([decimals[i] for i in ids])).hexdigest(), hashlib.sha256(self.decode(ids).encode()).hexdigest()

    @property
    def decimals(self) -> dict[int, bytes]:
        if not hasattr(self, "_decimals"):
            self._decimals = {i: b"%d" % i for i in self.bytes_of}
        return self._decimals


@lru_cache(maxsize=4)
def tree_bpe(path: str) -> TreeBPE:
    """One encoder a worker and file."""
    return TreeBPE(path)


def encode_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids and decoded text of each row: ``id, ids array<int>, decoded string``.

    No shuffle: rows stay in their partitions.  ``path`` is the vocabulary
    file, which every worker must be able to open.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                decoded = [bpe.decode(i) for i in ids]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["id", "ids", "decoded"])

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(run, f"id {source.schema['id'].dataType.simpleString()}, ids array<int>, decoded string")


DIGESTS = ["n_tokens", "ids_sha256", "decoded_sha256"]
DIGEST_TYPES = [pa.int64(), pa.string(), pa.string()]


def digest_documents(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text", piece_chars: int = PIECE_CHARS) -> DataFrame:
    """Digests of the encoding of each row, without moving the ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    One reading of the documents encodes all texts of up to ``piece_chars``
    characters and writes their digests, and the pieces of longer ones; what is
    moved after that is these pieces alone.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    names = ["doc_id", *DIGESTS, "key", "pieces"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        for batch in batches:
            for part in slices(batch, 1, 2 << 20):
                rows = []
                for text in part.column(1).to_pylist():
                    if text and len(text) > piece_chars and bpe.plain(text):
                        key = hashlib.sha256(text.encode()).hexdigest()
                        rows.append((None, None, None, key, [text[i : i + piece_chars] for i in range(0, len(text), piece_chars)]))
                    else:
                        rows.append((*bpe.digests(bpe.encode(text)), None, None))
                columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), [*DIGEST_TYPES, pa.string(), pa.list_(pa.string())], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names)

    kind = source.schema["doc_id"].dataType.simpleString()
    scratch = Scratch(docs.sparkSession, "bpe")
    read = scratch.write(source.mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, key string, pieces array<string>"), "read")
    long = read.where("key is not null")
    pieces = long.select("key", F.posexplode("pieces").alias("at", "piece")).groupBy("key", "at").agg(F.first("piece").alias("piece"))
    digests = _joined(_encoded(pieces, path), path).join(long.groupBy("key").agg(F.count("*").alias("copies")), "key")
    told = join_by_size(long.select("doc_id", "key"), digests, "key", size="copies", total=scratch.rows(read))
    return read.where("key is null").select("doc_id", *DIGESTS).unionByName(told.select("doc_id", *DIGESTS))


def _encoded(pieces: DataFrame, path: str) -> DataFrame:
    """Pieces (key, at, piece) with the segments of each: their ends, numbers of ids, ids, and whether they are long words."""
    names = ["key", "at", "piece", "ends", "counts", "ids", "long"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tree_bpe(path)
        for batch in batches:
            for part in slices(batch, 2, 2 << 20):
                own = [bpe.part(t) for t in part.column(2).to_pylist()]
                columns = [[p.ends for p in own], [[len(x) for x in p.ids] for p in own], [p.tokens() for p in own]]
                arrays = [pa.array(c, pa.list_(pa.int32())) for c in columns]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), *arrays, pa.array([p.long for p in own], pa.list_(pa.bool_()))], names)

    return pieces.select("key", "at", "piece").mapInArrow(run, "key string, at int, piece string, ends array<int>, counts array<int>, ids array<int>, long array<boolean>")


def _joined(encoded: DataFrame, path: str) -> DataFrame:
    """(key, DIGESTS) of each text from its encoded pieces, joined as a tree."""

    def run(table: pa.Table) -> pa.Table:
        bpe = tree_bpe(path)
        parts = []
        for row in table.sort_by("at").to_pylist():
            cuts = [0]
            for n in row["counts"]:
                cuts.append(cuts[-1] + n)
            parts.append(Part(row["piece"], row["ends"], [row["ids"][a:b] for a, b in zip(cuts, cuts[1:])], row["long"]))
        while len(parts) > 1:
            parts = [reduce(bpe.join, parts[i : i + 2]) for i in range(0, len(parts), 2)]
        told = bpe.digests(parts[0].tokens())
        return pa.table([table.column("key").slice(0, 1), *[pa.array([v], t) for v, t in zip(told, DIGEST_TYPES, strict=True)]], names=["key", *DIGESTS])

    return encoded.groupBy("key").applyInArrow(run, "key string, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
