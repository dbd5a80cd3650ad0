"""Readers and writers. Files are opened by Spark's own readers, so any store that Spark knows will do; bytes are decoded on executors."""

from __future__ import annotations

import gzip
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SOUP = "mesh_id string, fid long, " + ", ".join(f"{c}{k} double" for c in "abc" for k in "xyz")
_NAME = r"([^/\\]+?)(\.[A-Za-z.]+)?$"


def _files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.regexp_extract("path", _NAME, 1).alias("name"), "content")


def tile_list(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of a list, without margins; blank ones dropped."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> ''")


def capitals(spark: SparkSession, path: str) -> DataFrame:
    """country, city, lon, lat out of a JSON object of objects; entries without a position have nulls."""
    whole = spark.read.text(path, wholetext=True)
    table = F.from_json("value", "map<string,struct<city:string,lon:double,lat:double>>")
    return whole.select(F.explode(table).alias("country", "c")).select("country", "c.city", "c.lon", "c.lat")


def stl(spark: SparkSession, path: str) -> DataFrame:
    """mesh_id, fid, ax to cz of binary or text STL files; vertices aren't merged."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame.name, frame.content, strict=True):
                corners = stl_corners(content).reshape(-1, 9).astype(float)
                out = pd.DataFrame(corners, columns=[f"{c}{k}" for c in "abc" for k in "xyz"])
                out.insert(0, "fid", np.arange(len(out)))
                out.insert(0, "mesh_id", name)
                yield out

    return _files(spark, path, "*.stl").mapInPandas(run, SOUP)


def stl_corners(content: bytes) -> np.ndarray:
    """(faces, 3, 3) corners of an STL file. Raises ValueError where the file is cut short."""
    if len(content) >= 84:
        n = struct.unpack_from("<I", content, 80)[0]
        if len(content) == 84 + 50 * n:
            return np.frombuffer(content, np.dtype([("v", "<f4", 12), ("a", "<u2")]), n, 84)["v"][:, 3:].reshape(n, 3, 3)
    if content.lstrip()[:5] == b"solid":
        found = [line.split()[1:4] for line in content.splitlines() if line.split()[:1] == [b"vertex"]]
        if len(found) % 3 == 0:
            return np.array(found, float).reshape(-1, 3, 3)
    raise ValueError("not a whole STL file")


def stl_bytes(corners: np.ndarray) -> bytes:
    """A binary STL file of (faces, 3, 3) corners, with normals."""
    c = np.asarray(corners, "<f4").reshape(-1, 3, 3)
    normal = np.cross(c[:, 1] - c[:, 0], c[:, 2] - c[:, 0])
    size = np.linalg.norm(normal, axis=1, keepdims=True)
    out = np.zeros(len(c), np.dtype([("v", "<f4", 12), ("a", "<u2")]))
    out["v"] = np.hstack((normal / np.where(size > 0, size, 1), c.reshape(-1, 9)))
    return bytes(80) + struct.pack("<I", len(c)) + out.tobytes()


def stl_name(country: Column, suffix: str = "solid") -> Column:
    """'_solid', '_starup', '_with_islands' or '_with_states' after the name with its spaces replaced."""
    return F.concat(F.replace(country, F.lit(" "), F.lit("_")), F.lit(f"_{suffix}.stl"))


def pack_stl(soup: DataFrame, suffix: str = "solid") -> DataFrame:
    """name, content: an STL file for each mesh of faces (mesh_id, ax to cz)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"mesh_id": [rows.mesh_id.iloc[0]], "content": [stl_bytes(rows[[f"{c}{k}" for c in "abc" for k in "xyz"]].to_numpy(float))]})

    return soup.groupBy("mesh_id").applyInPandas(run, "mesh_id string, content binary").select(stl_name(F.col("mesh_id"), suffix).alias("name"), "content")


def write_files(named: DataFrame, folder: str) -> None:
    """Writes each row's content under its name in a folder that all executors share (a path or a URI that Arrow knows)."""

    def run(rows) -> None:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(root, recursive=True)
        for row in rows:
            with store.open_output_stream(f"{root}/{row['name']}") as out:
                out.write(bytes(row["content"]))

    named.select("name", "content").foreachPartition(run)


def png(pixels: np.ndarray) -> bytes:
    """8-bit grey (height, width) or RGB (height, width, 3) as PNG."""
    height, width = pixels.shape[:2]
    lines = np.ascontiguousarray(pixels, np.uint8).reshape(height, -1)
    raw = np.hstack((np.zeros((height, 1), np.uint8), lines)).tobytes()
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 0 if pixels.ndim == 2 else 2, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def pack_png(cells: DataFrame, name: str, border: DataFrame | None = None) -> DataFrame:
    """name, content: one picture of cells (row, col, byte), with the cells of `border` red. A picture is one group."""
    own = cells.select("row", "col", "byte", F.lit(False).alias("red"))
    if border is not None:
        own = own.unionByName(border.select("row", "col", F.lit(0).alias("byte"), F.lit(True).alias("red")))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        grey = np.zeros((int(rows.row.max()) + 1, int(rows.col.max()) + 1), np.uint8)
        plain, red = rows[~rows.red], rows[rows.red]
        grey[plain.row, plain.col] = plain.byte.fillna(0)
        out = np.repeat(grey[:, :, None], 3, 2)
        out[red.row, red.col] = (255, 0, 0)
        return pd.DataFrame({"name": [f"{name}.png"], "content": [png(out)]})

    return own.groupBy(F.lit(name).alias("k")).applyInPandas(run, "name string, content binary")


def hgt(spark: SparkSession, path: str) -> DataFrame:
    """tile, row, col, z of square-degree height files (.hgt, also gzipped), row 0 in the north; voids (-32768) are null."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, content in zip(frame.name, frame.content, strict=True):
                raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                side = int((len(raw) // 2) ** 0.5)
                z = np.frombuffer(raw, ">i2", side * side).astype(float)
                for a in range(0, side, 256):  # so many rows at a time
                    part = z[a * side : (a + 256) * side]
                    r, c = np.divmod(np.arange(len(part)) + a * side, side)
                    yield pd.DataFrame({"tile": name, "row": r.astype(np.int32), "col": c.astype(np.int32), "z": np.where(part == -32768, np.nan, part)})

    out = _files(spark, path, "*.hgt*").mapInPandas(run, "tile string, row int, col int, z double")
    return out.withColumn("z", F.nullif(F.nanvl("z", F.lit(-32768.0)), F.lit(-32768.0)))


def shapefile_rings(content: bytes) -> list[list[list[list[tuple]]]]:
    """For each record of a .shp file of polygons: parts, of rings, of points. Outer rings are clockwise there; a hole goes to
    the part before it. Records of no shape are empty."""
    out, at = [], 100
    while at + 12 <= len(content):
        size = struct.unpack_from(">i", content, at + 4)[0] * 2
        kind = struct.unpack_from("<i", content, at + 8)[0]
        parts: list = []
        if kind in (5, 15, 25):
            n_rings, n_points = struct.unpack_from("<ii", content, at + 44)
            first = [*struct.unpack_from(f"<{n_rings}i", content, at + 52), n_points]
            points = np.frombuffer(content, "<f8", 2 * n_points, at + 52 + 4 * n_rings).reshape(-1, 2)
            for a, b in zip(first, first[1:]):
                ring = [tuple(p) for p in points[a : b - 1].tolist()]
                x, y = points[a:b, 0], points[a:b, 1]
                if (x[:-1] * y[1:] - x[1:] * y[:-1]).sum() < 0 or not parts:
                    parts.append([ring])
                else:
                    parts[-1].append(ring)
        out.append(parts)
        at += 8 + size
    return out


def dbf_rows(content: bytes, encoding: str = "utf-8") -> list[dict[str, str]]:
    """The records of a .dbf file as text, without margins."""
    n, head, size = struct.unpack_from("<IHH", content, 4)
    fields, at, place = [], 32, 1
    while content[at] != 13:
        width = content[at + 16]
        fields.append((content[at : at + 11].split(b"\0")[0].decode(), place, width))
        place += width
        at += 32
    rows = (content[head + i * size : head + (i + 1) * size] for i in range(n))
    return [{name: r[a : a + w].decode(encoding, "replace").strip("\0 ") for name, a, w in fields} for r in rows]


def shapefile(spark: SparkSession, path: str, name_field: str = "ADMIN") -> DataFrame:
    """feature, attributes (map), part, ring, seq, x, y of shapefiles under a path: .shp and .dbf of one name."""
    files = spark.read.format("binaryFile").load(path).where(F.col("path").rlike(r"(?i)\.(shp|dbf)$"))
    both = files.groupBy(F.regexp_replace("path", r"\.[A-Za-z]+$", "").alias("base")).agg(F.max(F.when(F.col("path").rlike("(?i)shp$"), F.col("content"))).alias("shp"), F.max(F.when(F.col("path").rlike("(?i)dbf$"), F.col("content"))).alias("dbf"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shp, dbf in zip(frame.shp, frame.dbf, strict=True):
                shapes = shapefile_rings(shp)
                rows = dbf_rows(dbf) if dbf is not None else [{} for _ in shapes]
                for i, (parts, row) in enumerate(zip(shapes, rows, strict=True)):
                    name = row.get(name_field) or str(i)
                    found = [(name, row, p, r, s, x, y) for p, rings in enumerate(parts) for r, ring in enumerate(rings) for s, (x, y) in enumerate(ring)]
                    yield pd.DataFrame(found, columns=["feature", "attributes", "part", "ring", "seq", "x", "y"])

    return both.where("shp IS NOT NULL").mapInPandas(run, "feature string, attributes map<string,string>, part int, ring int, seq int, x double, y double")


def write_cells(cells: DataFrame, path: str, tile: int = 512) -> None:
    """Cells as compressed Parquet, in folders of tile x tile cells, which readers prune by tile_row and tile_col."""
    keyed = cells.withColumns({"tile_row": F.floor(F.col("row") / tile).cast("int"), "tile_col": F.floor(F.col("col") / tile).cast("int")})
    keyed.repartition("tile_row", "tile_col").sortWithinPartitions("row", "col").write.partitionBy("tile_row", "tile_col").option("compression", "zstd").mode("overwrite").parquet(path)


def read_cells(spark: SparkSession, path: str, box: tuple[int, int, int, int] | None = None, tile: int = 512) -> DataFrame:
    """Cells that write_cells() wrote; with a box (first row, last row, first col, last col) only its tiles are opened."""
    cells = spark.read.parquet(path)
    if box:
        r0, r1, c0, c1 = box
        cells = cells.where(F.col("tile_row").between(r0 // tile, r1 // tile) & F.col("tile_col").between(c0 // tile, c1 // tile) & F.col("row").between(r0, r1) & F.col("col").between(c0, c1))
    return cells.drop("tile_row", "tile_col")


_COORDINATES = "array<array<array<array<double>>>>"


def write_features(features: DataFrame, rings: DataFrame, path: str) -> None:
    """GeoJSON, a feature a line: features (feature, attributes as a map of strings) with their rings as a MultiPolygon."""
    point = F.struct("seq", F.array("x", "y").alias("at"))
    ring = rings.groupBy("feature", "part", "ring").agg(F.array_sort(F.collect_list(point)).alias("points"))
    ring = ring.select("feature", "part", F.struct("ring", F.concat(F.transform("points", lambda p: p["at"]), F.array(F.col("points")[0]["at"])).alias("closed")).alias("r"))
    part = ring.groupBy("feature", "part").agg(F.array_sort(F.collect_list("r")).alias("rs")).select("feature", F.struct("part", F.transform("rs", lambda r: r["closed"]).alias("rings")).alias("p"))
    shape = part.groupBy("feature").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("feature", F.transform("ps", lambda p: p["rings"]).alias("coordinates"))
    row = F.struct(F.lit("Feature").alias("type"), F.col("feature").alias("id"), F.col("attributes").alias("properties"), F.struct(F.lit("MultiPolygon").alias("type"), F.col("coordinates")).alias("geometry"))
    write_lines(features.join(shape, "feature").select(F.to_json(row).alias("value")), path)


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """What write_features() wrote: features and rings. Lines that aren't MultiPolygon features are left out."""
    row = F.from_json("value", f"struct<id:string,properties:map<string,string>,geometry:struct<type:string,coordinates:{_COORDINATES}>>")
    found = spark.read.text(path).select(row.alias("f")).where("f.geometry.type = 'MultiPolygon'").select(F.col("f.id").alias("feature"), F.col("f.properties").alias("attributes"), F.col("f.geometry.coordinates").alias("parts"))
    parts = found.select("feature", F.posexplode("parts").alias("part", "rings"))
    each = parts.select("feature", "part", F.posexplode("rings").alias("ring", "points"))
    points = each.select("feature", "part", "ring", F.posexplode(F.slice("points", 1, F.size("points") - 1)).alias("seq", "at"))
    return found.select("feature", "attributes"), points.select("feature", "part", "ring", "seq", F.col("at")[0].alias("x"), F.col("at")[1].alias("y"))


def write_lines(lines: DataFrame, path: str, column: str = "value") -> None:
    lines.select(F.col(column).alias("value")).write.mode("overwrite").text(path)


def output_folder(base: str, when: Column | None = None, commit: str | None = None) -> Column:
    """base_yyyyMMdd_HHmmss_commit; 'nogit' where there is no commit."""
    stamp = F.date_format(F.current_timestamp() if when is None else when, "yyyyMMdd_HHmmss")
    return F.concat_ws("_", F.lit(base), stamp, F.lit(commit or "nogit"))
