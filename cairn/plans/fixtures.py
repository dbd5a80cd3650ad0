"""Inputs of the registered queries: a raster out of the order lines, and literal shapes, capitals and tiles.

The literals are kept once; values() writes them as SQL for the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.params import DEFAULT

SIDE = 64
#: For small rasters: components of 50 cells stay.
SMALL = DEFAULT.with_(min_component_pixels=50)
GRID = "SELECT cast(l_orderkey % 64 AS int) AS row, cast(l_partkey % 64 AS int) AS col, count(*) AS n, cast(floor(max(l_extendedprice)) AS bigint) % 3000 - 500 AS z FROM lineitem GROUP BY 1, 2"

_POINTS = {
    ("ALPHA", 0, 0): [(4.25, 4.25), (44.25, 6.25), (50.25, 40.25), (20.25, 52.25), (6.25, 36.25)],
    ("ALPHA", 0, 1): [(20.25, 20.25), (30.25, 20.25), (30.25, 30.25), (20.25, 30.25)],
    ("ALPHA", 1, 0): [(54.25, 8.25), (60.25, 8.25), (60.25, 14.25), (54.25, 14.25)],
    ("BETA", 0, 0): [(44.25, 6.25), (62.25, 24.25), (50.25, 40.25)],
}
_LAKES = {
    ("LAKE_1", 0, 0): [(10.25, 10.25), (24.25, 12.25), (16.25, 24.25)],
    ("LAKE_2", 0, 0): [(46.25, 20.25), (54.25, 22.25), (48.25, 32.25)],
    ("LAKE_3", 0, 0): [(2.25, 58.25), (4.25, 58.25), (4.25, 60.25), (2.25, 60.25)],
}
RINGS = [(f, p, r, i, x, y) for (f, p, r), pts in _POINTS.items() for i, (x, y) in enumerate(pts)]
LAKES = [(f, p, r, i, x, y) for (f, p, r), pts in _LAKES.items() for i, (x, y) in enumerate(pts)]
RING_COLUMNS = ("feature", "part", "ring", "seq", "x", "y")
RING_SCHEMA = "feature string, part int, ring int, seq int, x double, y double"
BRIDGE = [("BRIDGE", 0, 0, i, x, y) for i, (x, y) in enumerate([(46.25, 9.25), (55.25, 9.25), (55.25, 12.25), (46.25, 12.25)])]
STAIRS = [("STAIR", 0, 0, i, float(-(-i // 2)), float(i // 2)) for i in range(41)] + [("STAIR", 0, 0, 41, 0.0, 20.0)]

# Positions of cities; the second table corrects the first.
CAPITALS = [("ALPHA", "Alphaville", 26.5, 27.5), ("BETA", "Betatown", 70.5, 20.5), ("GAMMA", "Gamma", 10.0, 10.0), ("NATION_3", "Three", 3.25, 4.75)]
MORE_CAPITALS = [("GAMMA", "New Gamma", 11.5, 12.25), ("DELTA", "Delta", -58.5, -34.75), ("NATION_5", "Five", 44.75, 41.5)]
CAPITAL_COLUMNS = ("country", "city", "lon", "lat")
CAPITAL_SCHEMA = "country string, city string, lon double, lat double"
COASTAL = ("ALPHA", "GAMMA", "NATION_5", "NATION_7")
AFFINE = {"a": 2.0, "b": 0.25, "c": -10.0, "d": -0.125, "e": -1.5, "f": 90.0}
BOUNDS = [("caucasus", 40.0, 38.4, 50.9, 43.6), ("west", -2.5, -1.5, 1.2, 0.7)]
ODD_TILES = ["Copernicus_DSM_COG_10_N38_00_E052_00_DEM", "Copernicus_DSM_COG_10_S35_00_W018_00_DEM", "Copernicus_DSM_COG_10_N39_00_E010_00_DEM", "Copernicus_DSM_COG_10_N5_00_E010_00_DEM", "  Copernicus_DSM_COG_10_N05_00_E010_00_DEM ", "", "readme"]


def values(name: str, rows: list[tuple], columns: tuple[str, ...]) -> str:
    """'name(columns) AS (VALUES ...)' for a WITH clause."""
    lit = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v}::DOUBLE" if isinstance(v, float) else str(v)
    return f"{name}({', '.join(columns)}) AS (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    cell = lambda c: (F.col(c) % SIDE).cast("int")
    return lines.groupBy(cell("l_orderkey").alias("row"), cell("l_partkey").alias("col")).agg(F.count("*").alias("n"), (F.floor(F.max("l_extendedprice")) % 3000 - 500).alias("z"))


def masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid's cells that count as land in queries on masks."""
    return grid(spark, sf_dir).where("n % 5 < 3")


def rings(spark: SparkSession, rows: list[tuple] | None = None) -> DataFrame:
    return spark.createDataFrame(RINGS if rows is None else rows, RING_SCHEMA)


def capitals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CAPITALS, CAPITAL_SCHEMA)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """admin (null for every fourth), name, continent: the nations as features."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(key.alias("id"), F.when(key % 4 != 0, F.col("n_name")).alias("admin"), F.concat(F.lit("ALT_"), key.cast("string")).alias("name"), F.col("r_name").alias("continent"))


FEATURES = "features AS (SELECT n_nationkey AS id, CASE WHEN n_nationkey % 4 <> 0 THEN n_name END AS admin, 'ALT_' || n_nationkey AS name, r_name AS continent FROM nation JOIN region ON n_regionkey = r_regionkey)"
CELLS = f"grid AS ({GRID})"
SHAPES = values("rings", RINGS, RING_COLUMNS)
WATERS = values("lakes", LAKES, RING_COLUMNS)


def edges_of(name: str, out: str) -> str:
    """A WITH entry: the edges of a table of rings."""
    w = "(PARTITION BY feature, part, ring ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    return f"{out} AS (SELECT feature, part, ring, seq, x, y, coalesce(lead(x) OVER (PARTITION BY feature, part, ring ORDER BY seq), first_value(x) OVER {w}) AS x2, coalesce(lead(y) OVER (PARTITION BY feature, part, ring ORDER BY seq), first_value(y) OVER {w}) AS y2 FROM {name})"


def cells_in(edges: str, out: str) -> str:
    """A WITH entry: feature, row, col of the cells of a full grid whose centre is inside, by counting crossings to the right."""
    full = f"(SELECT r.i AS row, c.i AS col FROM range({SIDE}) r(i), range({SIDE}) c(i))"
    return f"{out} AS (SELECT feature, row::INTEGER AS row, col::INTEGER AS col FROM {full} g JOIN {edges} e ON (e.y > row + 0.5) <> (e.y2 > row + 0.5) AND col + 0.5 < e.x + (row + 0.5 - e.y) * (e.x2 - e.x) / (e.y2 - e.y) GROUP BY feature, row, col HAVING count(*) % 2 = 1)"


def measured(edges: str, out: str) -> str:
    """A WITH entry: a row for each ring with its area, moments and bounds."""
    return f"{out} AS (SELECT feature, part, ring, count(*) AS points, abs(sum(x * y2 - x2 * y)) / 2 AS area, sum((x + x2) * (x * y2 - x2 * y)) / 6 * sign(sum(x * y2 - x2 * y)) AS mx, sum((y + y2) * (x * y2 - x2 * y)) / 6 * sign(sum(x * y2 - x2 * y)) AS my, min(x) AS minx, min(y) AS miny, max(x) AS maxx, max(y) AS maxy FROM {edges} GROUP BY feature, part, ring)"
