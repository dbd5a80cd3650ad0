"""Media columns: Netpbm and BMP bytes to numpy arrays, area-resized by integral images, NPY tiles, difference hashes.

Defined cases: null media gives null columns; bytes that aren't a supported image give a null
array and the reason in `problem`; a null text is empty; rows that repeat an id are images of their
own; a text of any length is one image, as tall as it needs; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm import common

WIDTH = 64


def encode_pgm(pixels: np.ndarray) -> bytes:
    """8-bit grey (height, width) or RGB (height, width, 3) as binary Netpbm."""
    kind = b"P5" if pixels.ndim == 2 else b"P6"
    return kind + b"\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + np.ascontiguousarray(pixels, np.uint8).tobytes()


def encode_bmp(pixels: np.ndarray) -> bytes:
    """8-bit grey with a grey palette, or RGB with 24 bits, as BMP with rows from the bottom."""
    grey = pixels.ndim == 2
    height, width = pixels.shape[:2]
    stride = -(-width * (1 if grey else 3) // 4) * 4
    body = np.zeros((height, stride), np.uint8)
    flat = pixels if grey else pixels[:, :, ::-1].reshape(height, -1)
    body[:, : flat.shape[1]] = flat
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).copy() if grey else np.zeros((0, 4), np.uint8)
    palette[:, 3] = 0
    at = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", at + body.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8 if grey else 24, 0, body.size, 2835, 2835, len(palette), 0)
    return head + palette.tobytes() + body[::-1].tobytes()


def _netpbm(media: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < (2 if media[:2] in (b"P1", b"P4") else 3):
        while media[at : at + 1].isspace() or media[at : at + 1] == b"#":
            at = media.index(b"\n", at) + 1 if media[at : at + 1] == b"#" else at + 1
        end = at
        while media[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("a Netpbm header lacks a number")
        fields.append(int(media[at:end]))
        at = end
    at += 1  # one white space ends the header
    width, height, most = (*fields, 1)[:3]
    planes = 3 if media[1:2] in b"36" else 1
    shape = (height, width, 3) if planes == 3 else (height, width)
    count = width * height * planes
    if media[1:2] == b"4":
        packed = np.frombuffer(media, np.uint8, -(-width // 8) * height, at).reshape(height, -1)
        return (1 - np.unpackbits(packed, axis=1)[:, :width]) * np.uint8(255)
    if media[1:2] in b"56":
        wide = most > 255
        pixels = np.frombuffer(media, ">u2" if wide else np.uint8, count, at)
    elif media[1:2] == b"1":
        pixels = 1 - np.frombuffer(b"".join(media[at - 1 :].split()), np.uint8)[:count].astype(np.int64) + 48
    else:
        pixels = np.array(media[at - 1 :].split()[:count], np.int64)
    if len(pixels) < count or most < 1:
        raise ValueError("a Netpbm image is cut short")
    return (pixels if most == 255 else pixels.astype(np.int64) * 255 // most).astype(np.uint8).reshape(shape)


def _bmp(media: bytes) -> np.ndarray:
    at = struct.unpack_from("<I", media, 10)[0]
    size, width, height, _, bits, packing = struct.unpack_from("<IiiHHI", media, 14)
    if packing or bits not in (1, 4, 8, 24, 32):
        raise ValueError(f"BMP with {bits} bits, packing {packing}")
    rows, stride = abs(height), -(-width * bits // 32) * 4
    body = np.frombuffer(media, np.uint8, rows * stride, at).reshape(rows, stride)
    body = body[::-1] if height > 0 else body
    if bits >= 24:
        return np.ascontiguousarray(body[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    used = struct.unpack_from("<I", media, 46)[0] or 1 << bits
    palette = np.zeros((1 << bits, 3), np.uint8)
    palette[:used] = np.frombuffer(media, np.uint8, 4 * used, 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits < 8:
        per = 8 // bits
        shifts = np.arange(per - 1, -1, -1) * bits
        body = (body[:, :, None] >> shifts & ((1 << bits) - 1)).reshape(rows, -1)
    index = body[:, :width]
    if (palette == palette[:, :1]).all():
        return palette[:, 0][index]
    return palette[index]


def decode(media: bytes) -> np.ndarray:
    """The pixels of a P1 to P6 Netpbm or an uncompressed BMP, as uint8, (height, width) or (height, width, 3)."""
    if media[:1] == b"P" and media[1:2] in b"123456" and len(media) > 2:
        return _netpbm(media)
    if media[:2] == b"BM":
        return _bmp(media)
    raise ValueError("neither Netpbm nor BMP")


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that each target pixel covers, fractions of pixels among them, by an integral image."""
    x = pixels.astype(np.float64)
    if x.ndim == 3:
        return np.stack([area_resize(x[:, :, c], height, width) for c in range(x.shape[2])], 2)
    total = np.zeros((x.shape[0] + 1, x.shape[1] + 1))
    np.cumsum(np.cumsum(x, 0), 1, out=total[1:, 1:])

    def along(table: np.ndarray, n: int, to: int) -> np.ndarray:
        edge = np.arange(to + 1) * (n / to)
        low = np.minimum(edge.astype(np.int64), n - 1)
        part = (edge - low)[:, None]
        return table[low] * (1 - part) + table[low + 1] * part

    corners = along(along(total, x.shape[0], height).T, x.shape[1], width).T
    sums = corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]
    return sums * (height / x.shape[0]) * (width / x.shape[1])


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits, whether each of 8 x 9 area means is under the one right of it, as 16 hex digits; colours are averaged."""
    grey = pixels.mean(2) if pixels.ndim == 3 else pixels
    small = np.rint(area_resize(grey, 8, 9) * 1024)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(pixels: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, np.ascontiguousarray(pixels), allow_pickle=False)
    return out.getvalue()


def tile(media: bytes, height: int = 32, width: int = 32) -> bytes:
    """The image at a fixed size as an NPY file of uint8."""
    return npy(np.rint(area_resize(decode(media), height, width)).astype(np.uint8))


def tiles(df: DataFrame, media_column: str = "media", id_column: str = "id", height: int = 32, width: int = 32) -> DataFrame:
    """id_column, height, width, tile (NPY bytes), dhash, problem: a row for each row of df."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "media"):
            rows = []
            for media in batch.column("media").to_pylist():
                if media is None:
                    rows.append((None,) * 5)
                    continue
                try:
                    pixels = decode(media)
                    if not pixels.size:
                        raise ValueError("no pixels")
                    rows.append((*pixels.shape[:2], npy(np.rint(area_resize(pixels, height, width)).astype(np.uint8)), difference_hash(pixels), None))
                except (ValueError, struct.error, IndexError) as error:
                    rows.append((None, None, None, None, str(error)))
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "height", "width", "tile", "dhash", "problem"])

    kind = df.schema[id_column].dataType.simpleString()
    out = df.select(F.col(id_column).alias("id"), F.col(media_column).cast("binary").alias("media")).mapInArrow(run, f"id {kind}, height int, width int, tile binary, dhash string, problem string")
    return out.withColumnRenamed("id", id_column)


def write_tiles(df: DataFrame, path: str, **options) -> None:
    """tiles() as Parquet under a path that all executors share."""
    tiles(df, **options).write.mode("overwrite").parquet(path)


def store(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id_column, n_bytes, media: each text's bytes, zeros up to a multiple of 64 (64 at least), as an image 64 wide.

    An even number of rows is stored as PGM, an odd number as BMP, so equal texts are stored equally.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "text"):
            data, offsets = common.texts(batch.column("text"))
            found = []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                pixels = np.zeros((max(1, -(-(b - a) // WIDTH)), WIDTH), np.uint8)
                pixels.reshape(-1)[: b - a] = data[a:b]
                found.append(encode_bmp(pixels) if len(pixels) % 2 else encode_pgm(pixels))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.diff(offsets)), pa.array(found, pa.binary())], ["id", "n_bytes", "media"])

    kind = docs.schema[id_column].dataType.simpleString()
    out = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text")).mapInArrow(run, f"id {kind}, n_bytes long, media binary")
    return out.withColumnRenamed("id", id_column)


def read_back(stored: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """id_column, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature (difference hash and
    the SHA-256 of the tile), tile (16 x 16, as NPY), all from the stored bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.pieces(batches, "media"):
            rows = []
            for media in batch.column("media").to_pylist():
                pixels = decode(media)
                payload = pixels.tobytes()
                small = npy(np.rint(area_resize(pixels, 16, 16)).astype(np.uint8))
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"{difference_hash(pixels)}:{hashlib.sha256(small).hexdigest()}", small))
            names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], ["id", "n_bytes", *names])

    kind = stored.schema[id_column].dataType.simpleString()
    out = stored.select(F.col(id_column).alias("id"), "n_bytes", "media").mapInArrow(run, f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")
    return out.withColumnRenamed("id", id_column)
