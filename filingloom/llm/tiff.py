"""TIFF pages as rows.

``write`` stores 8-bit samples as a TIFF of one or more pages; ``pages`` walks
the image directories of any baseline file of either byte order, decodes its
strips or tiles (plain, PackBits, LZW, deflate), undoes the horizontal
predictor and yields one page after another, so that a file's pages are never
all held at once.

Defined cases: null or empty content gives one row with ``error`` set; a
directory that points back to an earlier one ends the walk with an error row; a
damaged page gives its own error row and the walk goes on, and so does one that
declares more than its strips or tiles could hold by their compression, or than
the 2 GB of a row; repeated rows give repeated pages; extra input columns are
ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingloom.llm.common import slices

#: Tags, field types and compression numbers of the TIFF 6.0 specification and its technical notes.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD_TYPES = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 6: ("b", 1), 7: ("B", 1), 8: ("h", 2), 9: ("i", 4), 13: ("I", 4)}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}

ROW = 64
"""Samples in a row of a stored text."""
PAGE_ROWS = 16_384
"""Rows of a page of a stored text; longer ones take more pages."""
STRIP_ROWS = 1_024
ROW_BYTES = 1 << 31
"""A row's binary value ends here, and so does a page that is one."""
#: How many bytes a stored byte can stand for at most, by the formats' own limits: runs of 128, matches of 258 in two bits, strings of 4,096.
EXPANSION = {NONE: 1, PACKBITS: 64, DEFLATE: 1032, OLD_DEFLATE: 1032, LZW: 4096}


class Damaged(ValueError):
    """The file breaks the format."""


def packbits_decode(data: bytes, size: int) -> bytes:
    out = bytearray()
    at = 0
    while at < len(data) and len(out) < size:
        n = data[at]
        at += 1
        if n < 128:
            out += data[at : at + n + 1]
            at += n + 1
        elif n > 128:
            out += data[at : at + 1] * (257 - n)
            at += 1
    return bytes(out)


def packbits_encode(data: bytes) -> bytes:
    out = bytearray()
    at = 0
    literal = bytearray()

    def flush() -> None:
        for i in range(0, len(literal), 128):
            part = literal[i : i + 128]
            out.append(len(part) - 1)
            out.extend(part)
        literal.clear()

    while at < len(data):
        run = 1
        while run < 128 and at + run < len(data) and data[at + run] == data[at]:
            run += 1
        if run >= 3:
            flush()
            out.append(257 - run)
            out.append(data[at])
        else:
            literal += data[at : at + run]
        at += run
    flush()
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, most significant first; the width grows one code early."""
    out = bytearray()
    entries: list[bytes] = []
    width, held, bits = 9, 0, 0
    before: bytes | None = None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257 or len(out) >= size:
            break
        if code == 256:
            entries = [bytes([i]) for i in range(256)] + [b"", b""]
            width, before = 9, None
            continue
        if not entries:
            raise Damaged("LZW data without a clear code")
        if before is None:
            entry = entries[code] if code < 256 else None
        elif code < len(entries):
            entry = entries[code]
        else:
            entry = before + before[:1] if code == len(entries) else None
        if entry is None:
            raise Damaged("LZW code out of range")
        out += entry
        if before is not None:
            entries.append(before + entry[:1])
        before = entry
        width = 12 if len(entries) >= 2047 else 11 if len(entries) >= 1023 else 10 if len(entries) >= 511 else 9
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    codes: dict[bytes, int] = {bytes([i]): i for i in range(256)}
    out = bytearray()
    held, bits, width, free = 256, 9, 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held = held << width | code
        bits += width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    out.append(held >> 1 & 255)
    held, bits = held & 1, 1
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = free
        free += 1
        width = 12 if free >= 2048 else 11 if free >= 1024 else 10 if free >= 512 else 9
        if free == 4094:
            put(256)
            codes = {bytes([j]): j for j in range(256)}
            width, free = 9, 258
        word = data[i : i + 1]
    if word:
        put(codes[word])
        free += 1
        width = 12 if free >= 2048 else 11 if free >= 1024 else 10 if free >= 512 else 9
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def _encode(data: bytes, compression: int) -> bytes:
    if compression == DEFLATE:
        return zlib.compress(data, 1)
    return {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode}[compression](data)


def _decode(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise Damaged(str(e)) from e
    if compression == LZW:
        return lzw_decode(data, size)
    if compression == PACKBITS:
        return packbits_decode(data, size)
    raise Damaged(f"compression {compression}")


def write(samples: bytes, width: int = ROW, *, compression: int = DEFLATE, predictor: int = 2, page_rows: int = PAGE_ROWS, strip_rows: int = STRIP_ROWS, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """A grey TIFF of 8-bit ``samples``; its length is a multiple of ``width``."""
    rows = np.frombuffer(samples, np.uint8).reshape(-1, width)
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for top in range(0, max(1, len(rows)), page_rows):
        page = rows[top : top + page_rows]
        chunks = []
        if tile:
            for y in range(0, len(page), tile[1]):
                for x in range(0, width, tile[0]):
                    block = np.zeros((tile[1], tile[0]), np.uint8)
                    part = page[y : y + tile[1], x : x + tile[0]]
                    block[: part.shape[0], : part.shape[1]] = part
                    chunks.append(block)
        else:
            chunks = [page[y : y + strip_rows] for y in range(0, len(page), strip_rows)]
        places, counts = [], []
        for block in chunks:
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((len(block), 1), np.uint8))
            data = _encode(block.astype(np.uint8).tobytes(), compression)
            places.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = {WIDTH: (4, [width]), LENGTH: (4, [len(page)]), BITS: (3, [8]), COMPRESSION: (3, [compression]), PHOTOMETRIC: (3, [1]), SAMPLES: (3, [1]), PREDICTOR: (3, [predictor])}
        fields |= {TILE_WIDTH: (4, [tile[0]]), TILE_LENGTH: (4, [tile[1]]), TILE_OFFSETS: (4, places), TILE_COUNTS: (4, counts)} if tile else {STRIP_OFFSETS: (4, places), ROWS_PER_STRIP: (4, [strip_rows]), STRIP_COUNTS: (4, counts)}
        entries = b""
        for tag, (kind, values) in sorted(fields.items()):
            value = struct.pack(f"{order}{len(values)}{FIELD_TYPES[kind][0]}", *values)
            if len(value) > 4:
                at = len(out)
                out += value + b"\0" * (len(value) & 1)
                value = struct.pack(f"{order}I", at)
            entries += struct.pack(f"{order}HHI", tag, kind, len(values)) + value.ljust(4, b"\0")
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(fields)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int = 0
    height: int = 0
    samples: int = 0
    bits: int = 0
    compression: str | None = None
    layout: str | None = None
    predictor: int = 1
    data: bytes | None = None
    error: str | None = None


def _fields(data: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    if at + 2 > len(data):
        raise Damaged("directory beyond the file's end")
    (n,) = struct.unpack_from(f"{order}H", data, at)
    if at + 2 + 12 * n + 4 > len(data):
        raise Damaged("directory beyond the file's end")
    found = {}
    for i in range(n):
        entry = at + 2 + 12 * i
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, entry)
        if kind not in FIELD_TYPES or kind == 2:
            continue
        letter, size = FIELD_TYPES[kind]
        place = entry + 8 if count * size <= 4 else struct.unpack_from(f"{order}I", data, entry + 8)[0]
        if place + count * size > len(data):
            raise Damaged(f"tag {tag} beyond the file's end")
        found[tag] = list(struct.unpack_from(f"{order}{count}{letter}", data, place))
    (link,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return found, link


def _page(data: bytes, order: str, tags: dict[int, list[int]], page: Page) -> None:
    one = lambda tag, default=None: tags.get(tag, [default])[0]
    page.width, page.height, page.samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    page.bits, page.predictor, compression = one(BITS, 1), one(PREDICTOR, 1), one(COMPRESSION, 1)
    page.compression = NAMES.get(compression, str(compression))
    page.layout = "tiles" if TILE_OFFSETS in tags else "strips"
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    per = page.samples // planes
    line = lambda width: (width * per * page.bits + 7) // 8
    if line(page.width) * planes * page.height >= ROW_BYTES:
        raise Damaged("page beyond the 2 GB of a row")
    if page.layout == "tiles":
        across, down = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)
        places, counts = tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
    else:
        across, down = page.width, min(one(ROWS_PER_STRIP, page.height) or page.height, max(page.height, 1))
        places, counts = tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, [])
    if page.height and page.width and (across <= 0 or down <= 0):
        raise Damaged("empty strips or tiles")
    columns = -(-page.width // across) if across else 0
    rows = -(-page.height // down) if down else 0
    if len(places) < columns * rows * planes or len(counts) < len(places):
        raise Damaged("too few strips or tiles")
    if line(page.width) * planes * page.height > EXPANSION.get(compression, 1) * sum(counts[: columns * rows * planes]):
        raise Damaged("strips or tiles too short for the page")
    if columns > 1 and (across * per * page.bits) % 8:
        raise Damaged("tiles off byte bounds")
    out = np.zeros((planes, page.height, line(page.width)), np.uint8)
    for i in range(columns * rows * planes):
        plane, k = divmod(i, columns * rows)
        y, x = divmod(k, columns)
        tall = down if page.layout == "tiles" else min(down, page.height - y * down)
        size = tall * line(across)
        block = _decode(data[places[i] : places[i] + counts[i]], compression, size)
        if len(block) < size:
            raise Damaged("short strip or tile")
        grid = np.frombuffer(block, np.uint8, size).reshape(tall, line(across))
        if page.predictor == 2:
            if page.bits not in (8, 16):
                raise Damaged(f"predictor over {page.bits} bits")
            kind = np.dtype(np.uint8 if page.bits == 8 else f"{order}u2")
            values = grid.view(kind).reshape(tall, across, per)
            grid = np.cumsum(values, axis=1, dtype=kind.newbyteorder("=")).astype(kind).reshape(tall, -1).view(np.uint8)
        elif page.predictor != 1:
            raise Damaged(f"predictor {page.predictor}")
        left = x * line(across)
        part = out[plane, y * down : y * down + tall, left : left + line(across)]
        part[:] = grid[: part.shape[0], : part.shape[1]]
    page.data = out.tobytes()


def pages(data: bytes | None) -> Iterator[Page]:
    """The pages of a file, in directory order."""
    order = {b"II": "<", b"MM": ">"}.get((data or b"")[:2])
    if not data or order is None or len(data) < 8 or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        yield Page(0, error="not a TIFF")
        return
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    seen: set[int] = set()
    while at:
        page = Page(len(seen))
        if at in seen:
            page.error = "directories form a loop"
            yield page
            return
        seen.add(at)
        try:
            tags, at = _fields(data, order, at)
        except (Damaged, struct.error) as e:
            page.error = str(e)
            yield page
            return
        try:
            _page(data, order, tags, page)
        except (Damaged, KeyError, struct.error) as e:
            page.error = str(e) or type(e).__name__
        yield page


PAGE_SCHEMA = "page int, width int, height int, samples int, bits int, compression string, layout string, predictor int, data binary, error string"


def tiff_pages(files: DataFrame, *, id_col: str = "path", content_col: str = "content") -> DataFrame:
    """One row per page of each file: ``id`` and PAGE_SCHEMA."""
    source = files.select(F.col(id_col).alias("id"), F.col(content_col).alias("content"))
    schema = f"id {source.schema['id'].dataType.simpleString()}, {PAGE_SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int32()] * 5 + [pa.string(), pa.string(), pa.int32(), pa.binary(), pa.string()]
        names = ["id", "page", "width", "height", "samples", "bits", "compression", "layout", "predictor", "data", "error"]
        for batch in batches:
            for i in range(batch.num_rows):
                for p in pages(batch.column(1)[i].as_py()):
                    values = [p.number, p.width, p.height, p.samples, p.bits, p.compression, p.layout, p.predictor, p.data, p.error]
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *[pa.array([v], k) for v, k in zip(values, kinds, strict=True)]], names)

    return source.mapInArrow(run, schema)


# -- texts as pictures --------------------------------------------------------


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 padded with zero bytes to a positive multiple of 64, and the length before that."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return data.ljust(max(ROW, -(-len(data) // ROW) * ROW), b"\0"), len(data)


class Features:
    """Histogram figures of samples that come in runs, the same for any cut into runs."""

    def __init__(self) -> None:
        self.counts = np.zeros(256, np.int64)
        self.pages = self.rows = 0

    def add(self, page: Page) -> None:
        self.counts += np.bincount(np.frombuffer(page.data, np.uint8), minlength=256)
        self.pages += 1
        self.rows += page.height

    def text(self) -> str:
        n = int(self.counts.sum())
        p = self.counts[self.counts > 0] / n
        values = np.arange(256)
        mean = float((values * self.counts).sum() / n)
        deviation = float(max(0.0, (values * values * self.counts).sum() / n - mean * mean) ** 0.5)
        octaves = "-".join(map(str, self.counts.reshape(8, 32).sum(axis=1).tolist()))
        return f"pages={self.pages};rows={self.rows};mean={mean:.4f};deviation={deviation:.4f};entropy={abs(float(-(p * np.log2(p)).sum())):.4f};distinct={len(p)};octaves={octaves}"


def stored(payload: bytes) -> bytes:
    """The file that holds a payload."""
    return write(payload)


STORED_SCHEMA = "n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def text_pictures(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as a TIFF, read the file back page by page and describe what was read.

    A null text counts as empty; equal texts give equal rows.  No shuffle.
    """
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for part in slices(batch, 1, 4 << 20):
                rows = []
                for text in part.column(1).to_pylist():
                    payload, n = payload_of(text)
                    media = stored(payload)
                    read, size, tail, features = hashlib.sha256(), 0, b"", Features()
                    for page in pages(media):
                        if page.error:
                            raise Damaged(page.error)
                        read.update(page.data)
                        size += len(page.data)
                        tail = page.data[-ROW:]
                        features.add(page)
                    rows.append((n, size, read.hexdigest(), zlib.crc32(tail), len(media), hashlib.sha256(media).hexdigest(), features.text()))
                columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]], names)

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {STORED_SCHEMA}")
