"""GeoTIFF rasters: plain, LZW and Deflate; strips and tiles; predictors 1 and 2. One file is one row, its cells many.

Files are read by Spark's binaryFile source, so they can lie in any store. A file that can't be read
gives no cells and its reason (problems()).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# TIFF tags and the sizes and formats of TIFF's field types.
WIDTH, LENGTH, BITS, COMPRESSION, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PREDICTOR = 256, 257, 258, 259, 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILES, TILE_SIZES, FORMAT, SCALE, TIE, NODATA = 322, 323, 324, 325, 339, 33550, 33922, 42113
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q", 17: "q"}


def unpack_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits, the most significant bit first; 256 clears the table, 257 ends."""
    out, table, width, held, bits, last = bytearray(), [], 9, 0, 0, None
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("an LZW code out of order")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
        out += entry
        last = entry
    return bytes(out)


def _fields(data: bytes) -> tuple[str, dict[int, tuple]]:
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack_from(order + "I", data, 4)[0]
    found = {}
    for i in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
        if kind not in TYPES:
            continue
        form = TYPES[kind]
        size = struct.calcsize("=" + form) * n
        place = at + 10 + 12 * i if size <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
        found[tag] = (data[place : place + n],) if form == "s" else struct.unpack_from(f"{order}{form * n if len(form) > 1 else f'{n}{form}'}", data, place)
    return order, found


def decode(data: bytes) -> tuple[np.ndarray, dict[str, float], float | None]:
    """The first band's cells, the affine from (col, row) to map (a, b, c, d, e, f), and the value for no data, if there is one."""
    order, tags = _fields(data)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    width, length, samples = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, kind = one(BITS, 1), one(FORMAT, 1)
    if samples != 1 or bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise ValueError(f"{samples} bands of {bits} bits, format {kind}")
    dtype = np.dtype(f"{order}{ {1: 'u', 2: 'i', 3: 'f'}[kind] }{bits // 8}")
    packing, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    if packing not in (1, 5, 8, 32946) or predictor not in (1, 2) or predictor == 2 and kind == 3:
        raise ValueError(f"compression {packing}, predictor {predictor}")
    tiled = TILES in tags
    high, wide = (one(TILE_LENGTH, 0), one(TILE_WIDTH, 0)) if tiled else (min(one(STRIP_ROWS, length), length), width)
    starts, sizes = (tags[TILES], tags[TILE_SIZES]) if tiled else (tags[STRIPS], tags[STRIP_SIZES])
    out = np.zeros((length, width), dtype.newbyteorder("="))
    across = -(-width // wide)
    for i, (start, size) in enumerate(zip(starts, sizes, strict=True)):
        raw = data[start : start + size]
        raw = unpack_lzw(raw) if packing == 5 else zlib.decompress(raw) if packing != 1 else raw
        row, col = i // across * high, i % across * wide
        rows = high if tiled else min(high, length - row)
        block = np.frombuffer(raw, dtype, rows * wide).reshape(rows, wide).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, 1, dtype=out.dtype)
        part = out[row : row + high, col : col + wide]
        part[:] = block[: part.shape[0], : part.shape[1]]
    sx, sy = tags.get(SCALE, (1.0, 1.0))[:2]
    i, j, _, x, y, _ = tags.get(TIE, (0.0,) * 6)[:6]
    affine = {"a": sx, "b": 0.0, "c": x - i * sx, "d": 0.0, "e": -sy, "f": y + j * sy}
    empty = tags.get(NODATA, (b"",))[0].strip(b"\0 ")
    return out, affine, float(empty) if empty else None


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
            try:
                cells, affine, empty = decode(data)
            except (ValueError, KeyError, struct.error, zlib.error):
                continue
            for top in range(0, len(cells), 256):  # so many rows of the raster at a time
                part = cells[top : top + 256]
                row, col = np.indices(part.shape, np.int32)
                z = part.astype(np.float64).reshape(-1)
                gone = np.isnan(z) if empty is None else np.isnan(z) | (z == empty)
                n = part.size
                yield pa.RecordBatch.from_arrays([pa.array([path] * n), pa.array(row.reshape(-1) + np.int32(top)), pa.array(col.reshape(-1)), pa.array(z, mask=gone), *(pa.array(np.full(n, affine[k])) for k in "abcdef")], ["path", "row", "col", "z", *"abcdef"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """path, row, col, z (null where the file says that there is no data) and the affine's a to f, of the files' first bands."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(_cells, "path string, row int, col int, z double, " + ", ".join(f"{k} double" for k in "abcdef"))


def problems(spark: SparkSession, path: str) -> DataFrame:
    """path, problem of the files that can't be read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    decode(data)
                except (ValueError, KeyError, struct.error, zlib.error) as error:
                    found.append((name, str(error)))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.string()) for i in (0, 1)], ["path", "problem"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, problem string").where(F.col("path").isNotNull())
