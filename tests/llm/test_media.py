"""Media columns: exact round trips, other decoders' formats, area means by hand."""

import hashlib
import io
import random
import struct
import zlib

import numpy as np
import pytest

from attesta.llm import media

rng = random.Random(5)
TEXTS = [None, "", "a", "é" * 32, "x" * 64, "y" * 65, "\x00z", "😀 long " * 9000, "a"]


def test_every_text_comes_back(spark, documents, folder):
    got = {r.doc_id: r for r in media.query(spark, folder(documents(list(enumerate(TEXTS))))).collect()}
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        padded = raw + bytes((-len(raw)) % 64 if raw else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes) == (len(raw), len(padded))
        assert r.payload_sha256 == hashlib.sha256(padded).hexdigest()
        assert r.tail_crc32 == zlib.crc32(padded[-64:])
        stored = media.stored_form(padded)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert len(r.feature) == 16
    assert {got[2][c] for c in ("feature", "media_sha256")} == {got[8][c] for c in ("feature", "media_sha256")}
    assert {r.format for r in got.values()} == {"bmp", "pgm"}
    assert media.media_digests(documents([])).count() == 0


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (7, 64), (130, 33)])
def test_round_trips(shape):
    image = np.random.default_rng(1).integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_pgm(image)) == image).all()
    assert (media.decode(media.encode_bmp(image)) == image).all()
    whole = np.zeros(shape, np.uint8)
    for y, x, tile in media.npy_tiles(image):
        part = np.load(io.BytesIO(tile))
        whole[y * 64 : y * 64 + part.shape[0], x * 64 : x * 64 + part.shape[1]] = part
    assert (whole == image).all()


def test_netpbm_kinds():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n011").tolist() == [[0, 1, 0], [1, 0, 0]]
    assert media.decode(b"P4 10 1\n\x80\x40").tolist() == [[0, 1, 1, 1, 1, 1, 1, 1, 1, 0]]
    assert media.decode(b"P2 2 1 255 7 200").tolist() == [[7, 200]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n\x01\x02").tolist() == [[258]]
    assert media.decode(b"P6 1 1 255\n\x01\x02\x03").tolist() == [[[1, 2, 3]]]
    with pytest.raises(ValueError):
        media.decode(b"P5 4 4 255\nxx")


@pytest.mark.parametrize("bits", [24, 32])
def test_colour_bmp_rows_from_the_top(bits):
    pixel = b"\x03\x02\x01" + b"\xff" * (bits == 32)
    row = (pixel + b"\x06\x05\x04" + b"\xff" * (bits == 32)).ljust(8, b"\0")
    data = struct.pack("<2sIHHI", b"BM", 0, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 2, -1, 1, bits, 0, 0, 0, 0, 0, 0) + row
    assert media.decode(data).tolist() == [[[1, 2, 3], [4, 5, 6]]]


def test_area_resize_means():
    image = np.arange(24, dtype=float).reshape(4, 6)
    assert np.allclose(media.area_resize(image, 2, 3), image.reshape(2, 2, 3, 2).mean((1, 3)))
    assert np.allclose(media.area_resize(np.array([[0.0, 3.0, 6.0]]), 1, 2), [[1.0, 5.0]])
    assert np.allclose(media.area_resize(image, 8, 12)[::2, ::2], image)


def test_tiles_of_a_column(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5 1 1 255\n\x05")), (2, None), (3, bytearray(b"junk")), (3, bytearray(b"BM"))], "id long, media binary")
    got = sorted(media.decoded_tiles(df, "id", "media").collect(), key=lambda r: (r.id, r.error or ""))
    assert [(r.id, r.error is None) for r in got] == [(1, True), (2, False), (3, False), (3, False)]
