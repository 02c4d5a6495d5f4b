import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from filingloom.llm import tiff


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("tile", [None, (16, 16), (48, 32)])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
def test_round_trip(compression, predictor, tile, order):
    rng = random.Random(compression)
    data = bytes(rng.choice([0, 0, 0, 7, rng.randrange(256)]) for _ in range(64 * 150))
    file = tiff.write(data, compression=compression, predictor=predictor, tile=tile, page_rows=70, strip_rows=33, order=order)
    got = list(tiff.pages(file))
    assert [p.height for p in got] == [70, 70, 10] and not any(p.error for p in got)
    assert b"".join(p.data for p in got) == data
    assert {p.layout for p in got} == {"tiles" if tile else "strips"}


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=600))
def test_codecs(data):
    assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_widths():
    data = bytes(np.random.default_rng(1).integers(0, 256, 30_000, dtype=np.uint8)) + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_packbits_of_the_specification():
    # The worked example of the format's description.
    packed = bytes.fromhex("FE AA 02 80 00 2A FD AA 03 80 00 2A 22 F7 AA".replace(" ", ""))
    plain = bytes.fromhex("AA AA AA 80 00 2A AA AA AA AA 80 00 2A 22 AA AA AA AA AA AA AA AA AA AA".replace(" ", ""))
    assert tiff.packbits_decode(packed, len(plain)) == plain


def fields(order, entries):
    out = struct.pack(f"{order}H", len(entries))
    for tag, kind, value in entries:
        out += struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}I", value) if kind == 4 else struct.pack(f"{order}HH", value, 0))
    return out + b"\0\0\0\0"


def lzw_codes(codes):
    """Codes as the format packs them: nine bits each, the highest first."""
    bits = "".join(f"{c:09b}" for c in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


@pytest.mark.parametrize("order", ["<", ">"])
def test_lzw_of_the_specification(order):
    # The format's worked example of a string and its codes.
    plain = bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])
    body = lzw_codes([256, 7, 258, 8, 8, 258, 6, 6, 257])
    assert tiff.lzw_decode(body, 9) == plain
    file = struct.pack(f"{order}2sHI", {"<": b"II", ">": b"MM"}[order], 42, 8 + len(body)) + body
    file += fields(order, [(256, 4, 3), (257, 4, 3), (258, 3, 8), (259, 3, 5), (322, 4, 3), (323, 4, 3), (324, 4, 8), (325, 4, len(body))])
    (page,) = tiff.pages(file)
    assert (page.error, page.layout, page.data) == (None, "tiles", plain)


def test_pages_that_declare_too_much():
    body = zlib.compress(b"x" * 100)
    for height, want in ((10, None), (1_000_000, "too short"), (2**31, "2 GB")):
        file = struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + fields("<", [(256, 4, 10), (257, 4, height), (258, 3, 8), (259, 3, 8), (273, 4, 8), (278, 4, height), (279, 4, len(body))])
        (page,) = tiff.pages(file)
        assert (page.error is None) if want is None else want in page.error


def test_sixteen_bit_predictor_and_colour():
    values = np.random.default_rng(2).integers(0, 65536, (5, 4, 3), dtype=np.uint16)
    diff = np.diff(values, axis=1, prepend=np.zeros((5, 1, 3), np.uint16)).astype(">u2").tobytes()
    body = zlib.compress(diff)
    fields = [(256, 4, 4), (257, 4, 5), (258, 3, 16), (259, 3, 8), (273, 4, 8), (277, 3, 3), (278, 4, 5), (279, 4, len(body)), (317, 3, 2)]
    start = 8 + len(body)
    file = struct.pack(">2sHI", b"MM", 42, start) + body + struct.pack(">H", len(fields))
    for tag, kind, value in fields:
        file += struct.pack(">HHI", tag, kind, 1) + (struct.pack(">I", value) if kind == 4 else struct.pack(">HH", value, 0))
    (page,) = tiff.pages(file + b"\0\0\0\0")
    assert page.error is None and page.data == values.astype(">u2").tobytes()


def test_damaged_files():
    good = tiff.write(b"x" * 640)
    assert [p.error for p in tiff.pages(None)] == ["not a TIFF"]
    assert [p.error for p in tiff.pages(b"")] == ["not a TIFF"]
    assert list(tiff.pages(good[:20]))[0].error
    loop = bytearray(good)
    struct.pack_into("<I", loop, len(loop) - 4, struct.unpack_from("<I", loop, 4)[0])
    assert [bool(p.error) for p in tiff.pages(bytes(loop))] == [False, True]
    broken = bytearray(good)
    broken[8:20] = b"\xff" * 12
    assert next(tiff.pages(bytes(broken))).error


def test_pages_of_files(spark):
    two = tiff.write(b"a" * 64 * 20, page_rows=10)
    files = spark.createDataFrame([("x", two, 1), ("y", None, 1), ("z", b"", 1), ("x", two, 1)], "path string, content binary, page int")
    got = tiff.tiff_pages(files)
    assert got.count() == 6 and got.where("error is null").count() == 4
    assert tiff.tiff_pages(files.limit(0)).count() == 0


def test_texts(spark):
    texts = [None, "", "é", "x" * 64, "x" * 65, "word " * 300_000, "x" * 64]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, feature int")
    rows = {r.doc_id: r for r in tiff.text_pictures(docs).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        payload = data + b"\0" * (-len(data) % 64 if data else 64)
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes) == (len(data), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest()
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
        assert r.media_bytes == len(tiff.stored(payload))
        counts = np.array([payload.count(bytes([v])) for v in range(256)])
        share = counts[counts > 0] / len(payload)
        mean = sum(v * int(c) for v, c in enumerate(counts)) / len(payload)
        told = dict(f.split("=") for f in r.feature.split(";"))
        assert (int(told["rows"]), int(told["distinct"])) == (len(payload) // 64, len(share)) and told["octaves"] == "-".join(str(counts[k : k + 32].sum()) for k in range(0, 256, 32))
        assert float(told["mean"]) == pytest.approx(mean, abs=1e-3) and float(told["entropy"]) == pytest.approx(-(share * np.log2(share)).sum(), abs=1e-3)
        assert float(told["deviation"]) == pytest.approx(np.sqrt((counts * (np.arange(256) - mean) ** 2).sum() / len(payload)), abs=1e-3)
        assert r.media_sha256 == hashlib.sha256(tiff.stored(payload)).hexdigest()
    assert rows[3][1:] == rows[6][1:] and rows[0][1:] == rows[1][1:]
    assert "pages=2" in rows[5].feature
    assert tiff.text_pictures(docs.limit(0)).count() == 0
