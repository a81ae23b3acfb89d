import hashlib
import math
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from paginal.llm import tiff


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs(data):
    assert tiff.unpack_bits(tiff.pack_bits(data)) == data
    assert tiff.lzw_unpack(tiff.lzw_pack(data)) == data


def test_codecs_over_table_resets():
    r = np.random.default_rng(0)
    for data in (bytes(200_000), r.integers(0, 256, 60_000).astype(np.uint8).tobytes(), b"abcab" * 20_000, r.integers(0, 3, 90_000).astype(np.uint8).tobytes()):
        assert tiff.lzw_unpack(tiff.lzw_pack(data)) == data
        assert tiff.unpack_bits(tiff.pack_bits(data)) == data


def test_known_forms():
    """The worked examples of the format's description."""
    packed = bytes([0xFE, 0xAA, 0x02, 0x80, 0x00, 0x2A, 0xFD, 0xAA, 0x03, 0x80, 0x00, 0x2A, 0x22, 0xF7, 0xAA])
    plain = bytes([0xAA, 0xAA, 0xAA, 0x80, 0x00, 0x2A, 0xAA, 0xAA, 0xAA, 0xAA, 0x80, 0x00, 0x2A, 0x22] + [0xAA] * 10)
    assert tiff.unpack_bits(packed) == plain
    codes = [256, 7, 258, 8, 8, 258, 6, 6, 257]
    bits = "".join(f"{c:09b}" for c in codes)
    raw = int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")
    assert tiff.lzw_pack(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == raw and tiff.lzw_unpack(raw) == bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])


@pytest.mark.parametrize("compression", [tiff.PLAIN, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("predictor", [False, True])
@pytest.mark.parametrize("tile", [None, (16, 16), (32, 48)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_files(compression, predictor, tile, order):
    r = np.random.default_rng(1)
    pages = [r.integers(0, 256, (h, w, c)).astype(np.uint8) for h, w, c in ((1, 1, 1), (37, 50, 3), (100, 64, 3))]
    data = tiff.write_tiff(pages, compression, predictor, tile, order, strip_rows=9)
    got = list(tiff.read_pages(data))
    assert len(got) == 3 and all((p.samples == q).all() and p.compression == compression for p, q in zip(got, pages))


def test_damaged_files():
    data = tiff.write_tiff([np.zeros((4, 64, 3), np.uint8)])
    for bad in (b"", b"II*\0", b"PNG" + data, data[:-20], data[:8] + b"\xff" * 40 + data[48:]):
        with pytest.raises(ValueError):
            list(tiff.read_pages(bad))
    loop = bytearray(data)
    loop[-4:] = data[4:8]
    with pytest.raises(ValueError):
        list(tiff.read_pages(bytes(loop)))


TEXTS = [None, "", "a", "x" * 192, "x" * 193, "é😀" * 500, "long " * 300_000, "a", "퟿\n\0"]


def test_round_trip(docs):
    media = tiff.text_to_media(docs(TEXTS).selectExpr("*", "'old' as media"))
    rows = {r["doc_id"]: r for r in tiff.media_digest(media).collect()}
    for k, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
        r = rows[k]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r["tail_crc32"] == zlib.crc32(payload[-16:])
        shares = [c / len(payload) for c in Counter(payload).values()]
        entropy = round(-1000 * sum(p * math.log2(p) for p in shares))
        # Rows of 64 pixels of three samples: each sample against that of the pixel before.
        dx = sum(abs(payload[i] - payload[i - 3]) for i in range(len(payload)) if i % 192 >= 3) if len(payload) < 10_000 else None
        start, _, end = r["feature"].rpartition(";dx=")
        assert start == f"n={len(payload)};sum={sum(payload)};min={min(payload)};max={max(payload)};entropy={entropy}"
        assert dx is None or int(end) == dx
    assert {k: v for k, v in rows[2].asDict().items() if k != "doc_id"} == {k: v for k, v in rows[7].asDict().items() if k != "doc_id"}
    assert rows[6]["pages"] == 2
    assert tiff.media_digest(tiff.text_to_media(docs(["a"]).limit(0))).count() == 0


def test_every_form_is_used(docs):
    """The query's files take all compressions, in strips and in tiles, and all read back."""
    media = tiff.text_to_media(docs([f"text {k} " * (k % 90) for k in range(200)])).cache()
    seen = set()
    for r in media.collect():
        tags, _ = tiff._directory(bytes(r["media"]), struct.unpack_from("<I", r["media"], 4)[0], "<")
        seen.add((tags[tiff.COMPRESSION][0], tags[tiff.PREDICTOR][0], tiff.TILE_OFFSETS in tags))
    assert len(seen) == len(tiff.FORMS) == 8
    rows = tiff.media_digest(media).collect()
    assert len(rows) == 200 and all(r["error"] is None for r in rows)
    for r in rows:
        k = r["doc_id"]
        assert r["payload_sha256"] == hashlib.sha256(tiff.padded(f"text {k} " * (k % 90))[0]).hexdigest()


def test_null_and_huge_files(spark):
    """No file, a header that claims 300,000 x 300,000 samples, and no directory keep their rows with a reason."""
    good = tiff.write_tiff([np.full((2, 3, 1), 7, np.uint8)])
    huge = bytearray(good)
    (at,) = struct.unpack_from("<I", good, 4)
    for e in range(struct.unpack_from("<H", good, at)[0]):
        place = at + 2 + 12 * e
        if struct.unpack_from("<H", good, place)[0] in (tiff.WIDTH, tiff.HEIGHT, tiff.ROWS_PER_STRIP):
            struct.pack_into("<I", huge, place + 8, 300_000)
    bare = b"II" + struct.pack("<HI", 42, 0)
    rows = [(1, good), (2, None), (3, bytes(huge)), (4, bare), (1, good)]
    df = spark.createDataFrame([(i, m, len(m or b""), "x") for i, m in rows], "doc_id long, media binary, n_bytes long, __text string").coalesce(1)
    got = tiff.media_digest(df).collect()
    assert [(r["doc_id"], r["pages"], r["payload_bytes"], r["error"] is None) for r in got] == [(1, 1, 6, True), (2, 0, 0, False), (3, 1, 0, False), (4, 0, 0, False), (1, 1, 6, True)]
    assert got[1]["media_bytes"] is None and "300000" in got[2]["error"]
    named = tiff.text_to_media(spark.createDataFrame([(1, "a", "b", "c")], "doc_id long, __text string, Media string, text string"))
    assert named.columns == ["doc_id", "__text", "text", "media", "n_bytes"] and tiff.media_digest(named).first()["n_bytes"] == 1


def test_one_row_per_page(spark):
    two = tiff.write_tiff([np.full((2, 3, 1), 7, np.uint8), np.full((1, 1, 3), 9, np.uint8)], tiff.LZW)
    df = spark.createDataFrame([(1, two, "x"), (2, None, "y"), (3, b"junk", "z")], "id int, media binary, page string")
    rows = sorted(tiff.media_pages(df).collect(), key=lambda r: (r["id"], r["page"]))
    assert [(r["id"], r["page"], r["pages"], r["width"], r["height"]) for r in rows] == [(1, 0, 2, 3, 2), (1, 1, 2, 1, 1), (2, 0, 0, None, None), (3, 0, 0, None, None)]
    assert bytes(rows[0]["pixels"]) == bytes([7] * 6) and rows[0]["error"] is None and rows[3]["error"]


def test_good_pages_beside_a_bad_one(spark):
    """A page of 16-bit samples, and a chain that breaks off, cost no other page."""
    data = tiff.write_tiff([np.full((2, 2, 1), k, np.uint8) for k in (5, 6, 7)])
    order = {b"II": "<", b"MM": ">"}[data[:2]]
    starts, (at,) = [], struct.unpack_from(order + "I", data, 4)
    while at:
        starts.append(at)
        _, at = tiff._directory(data, at, order)
    entries = {k: struct.unpack_from(order + "H", data, k)[0] for k in starts}
    deep, broken = bytearray(data), bytearray(data)
    for e in range(entries[starts[1]]):
        place = starts[1] + 2 + 12 * e
        if struct.unpack_from(order + "H", data, place)[0] == tiff.BITS:
            struct.pack_into(order + "H", deep, place + 8, 16)
    struct.pack_into(order + "I", broken, starts[1] + 2 + 12 * entries[starts[1]], len(data) + 100)
    df = spark.createDataFrame([(1, bytes(deep)), (2, bytes(broken))], "id int, media binary")
    rows = sorted(tiff.media_pages(df).collect(), key=lambda r: (r["id"], r["page"]))
    assert [(r["id"], r["page"], r["pages"], r["pixels"] and r["pixels"][0], r["error"] is None) for r in rows] == [
        (1, 0, 3, 5, True), (1, 1, 3, None, False), (1, 2, 3, 7, True), (2, 0, 2, 5, True), (2, 1, 2, 6, True), (2, 2, 2, None, False),
    ]
    assert "8 bits" in rows[1]["error"]
