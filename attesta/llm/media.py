"""Media columns: Netpbm and BMP images to numpy arrays, area resize, NPY tiles and difference hashes.

Decoders take the plain and raw Netpbm formats (P1 to P6, 8 and 16 bits a sample) and uncompressed BMP (8-bit palette,
24 and 32 bits, either row order). An image is resized by area through its integral image: a cell's mean is four
lookups, whatever its size, with fractional edges interpolated exactly.

Work is per row, in Arrow batches and without a shuffle, so a lost executor costs only its own batches.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import read_table
from .textvec import buffers

WIDTH = 64
TILE = 64
_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([0-9]+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw 8-bit PGM of a (height, width) array."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + np.ascontiguousarray(samples, np.uint8).tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit BMP with a grey palette, rows from the bottom up and padded to four bytes."""
    height, width = samples.shape
    stride = -(-width // 4) * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy()
    palette[:, 3] = 0
    start = 14 + 40 + 1024
    return (
        struct.pack("<2sIHHI", b"BM", start + rows.size, 0, 0, start)
        + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 256)
        + palette.tobytes()
        + rows.tobytes()
    )


def decode_netpbm(data: bytes) -> np.ndarray:
    """(height, width) or (height, width, 3) samples; bitmaps give 0 for black and 1 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, numbers = 2, []
    while len(numbers) < (2 if kind in (b"P1", b"P4") else 3):
        found = _TOKEN.match(data, at)
        if not found:
            raise ValueError("Netpbm header cut short")
        numbers.append(int(found[1]))
        at = found.end()
    width, height, most = (*numbers, 1)[:3]
    depth = 3 if kind in (b"P3", b"P6") else 1
    count = width * height * depth
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|[^01#]", b"", data[at:]), np.uint8)[:count]
        values = 1 - (bits - 48)
    elif kind in (b"P2", b"P3"):
        text = re.sub(rb"#[^\n]*", b"", data[at:]).split()[:count]
        values = np.array(text, dtype=np.int64).astype(np.uint8 if most < 256 else np.uint16)
    elif kind == b"P4":
        stride = -(-width // 8)
        packed = np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride)
        values = 1 - np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        values = np.frombuffer(data, np.uint8 if most < 256 else ">u2", count, at + 1)
    if len(values) != count:
        raise ValueError("Netpbm samples cut short")
    return values.reshape((height, width, 3) if depth == 3 else (height, width))


def decode_bmp(data: bytes) -> np.ndarray:
    """(height, width) for a grey palette, else (height, width, 3) in red, green, blue."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, header, width, height, _, bits, compression = struct.unpack_from("<I4xI", data, 10)[0], *struct.unpack_from("<IiiHHI", data, 14)
    if compression or bits not in (8, 24, 32):
        raise ValueError("only uncompressed BMP of 8, 24 or 32 bits")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if bits > 8:
        return np.ascontiguousarray(raw[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    palette = np.frombuffer(data, np.uint8, min(1024, start - 14 - header), 14 + header).reshape(-1, 4)[:, 2::-1]
    indexes = raw[:, :width]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][indexes]
    return palette[indexes]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means of equal areas, float64; works for shrinking and stretching alike."""
    integral = np.zeros((image.shape[0] + 1, image.shape[1] + 1))
    np.cumsum(np.cumsum(image, axis=0, dtype=np.float64), axis=1, out=integral[1:, 1:])
    for axis, n in ((0, height), (1, width)):
        edges = np.arange(n + 1) * (image.shape[axis] / n)
        low = np.minimum(edges.astype(np.int64), image.shape[axis] - 1)
        part = (edges - low).reshape((-1, 1) if axis == 0 else (1, -1))
        integral = np.take(integral, low, axis) * (1 - part) + np.take(integral, low + 1, axis) * part
    return np.diff(np.diff(integral, axis=0), axis=1) / ((image.shape[0] / height) * (image.shape[1] / width))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, in hex: whether each cell of an 8 x 9 resize is darker than its right neighbour."""
    small = area_resize(grey(image), 8, 9)
    return np.packbits(small[:, 1:] - small[:, :-1] > 1e-9).tobytes().hex()


def npy_tiles(image: np.ndarray, side: int = TILE) -> list[tuple[int, int, bytes]]:
    """(row, column, NPY file) of the tiles of at most ``side`` x ``side`` that cover an image."""
    out = []
    for y in range(0, image.shape[0], side):
        for x in range(0, image.shape[1], side):
            file = io.BytesIO()
            np.save(file, np.ascontiguousarray(image[y : y + side, x : x + side]), allow_pickle=False)
            out.append((y // side, x // side, file.getvalue()))
    return out


def decoded_tiles(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """Images to tiles: (id, row, col, npy, dhash, error), one row per tile.

    A null or unreadable image gives one row whose ``error`` says why; an image without pixels gives no tiles.
    Repeated rows are decoded each; other columns are ignored.
    """

    def work(batches):
        for batch in batches:
            ids, rows = [], []
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    if data is None:
                        raise ValueError("null")
                    image = decode(data)
                    mark = difference_hash(image) if image.size else None
                    tiles = [(y, x, t, mark, None) for y, x, t in npy_tiles(image)]
                except (ValueError, struct.error, IndexError) as e:
                    tiles = [(None, None, None, None, str(e)[:200])]
                ids += [key] * len(tiles)
                rows += tiles
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(0).type), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()), strict=True))],
                names=[id_col, "row", "col", "npy", "dhash", "error"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, media_col).mapInArrow(work, f"{id_col} {kind}, row int, col int, npy binary, dhash string, error string")


def payload(text: bytes) -> bytes:
    """Bytes 0 appended up to a positive multiple of WIDTH."""
    return text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))


def stored_form(data: bytes) -> bytes:
    """A payload as an image of WIDTH samples a row; its checksum picks PGM or BMP, so equal texts get equal files."""
    samples = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    return encode_pgm(samples) if zlib.crc32(data) % 2 else encode_bmp(samples)


RESULT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, format string, n_tiles int, tiles_sha256 string"


def _features(text: bytes) -> tuple:
    media = stored_form(payload(text))
    image = decode(media)
    back = image.tobytes()
    digest = hashlib.sha256()
    tiles = npy_tiles(image)
    for _, _, tile in tiles:
        digest.update(tile)
    return (
        len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(),
        difference_hash(image), "bmp" if media[:2] == b"BM" else "pgm", len(tiles), digest.hexdigest(),
    )


def _digests(batches):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("format", pa.string()), ("n_tiles", pa.int32()), ("tiles_sha256", pa.string())])
    for batch in batches:
        data, at = buffers(batch.column(1))
        rows = [_features(data[at[i] : at[i + 1]].tobytes()) for i in range(batch.num_rows)]
        columns = list(zip(*rows, strict=True)) or [()] * 10
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:], strict=True))], schema=schema)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every text as an image, reads it back and describes what came back.

    Null counts as empty (one row of zero samples). Repeated rows are stored each, equal texts with equal values; no
    rows give no rows; other columns are ignored.
    """
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_digests, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(read_table(spark, sf_dir, "documents"))
