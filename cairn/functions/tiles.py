"""Tile names and the boxes of regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Inclusive boxes of degrees (south, north, west, east).
BOXES = {"africa": (-35, 38, -18, 52), "asia": (0, 60, 25, 150), "europe": (35, 72, -25, 60), "north_central_america": (7, 72, -170, -52), "south_america": (-60, 15, -82, -34)}
# Equal-area conics of the regions (lat_1, lat_2, lat_0, lon_0) and the target cell in metres.
CONICS = {
    "south_america": (-5, -42, -32, -60, 1000), "north_central_america": (20, 60, 40, -96, 1000), "africa": (20, -23, 0, 25, 1000), "africa_2km": (20, -23, 0, 25, 2000), "asia": (15, 45, 30, 95, 1000),
    "asia_2km": (15, 45, 30, 95, 2000), "caucasus": (39, 43, 41, 45, 2000), "europe": (43, 62, 50, 10, 2000), "middle_east": (20, 40, 30, 48, 1000),
}
NAME = r"^Copernicus_DSM_COG_10_([NS])(\d{2})_00_([EW])(\d{3})_00_DEM$"


def parsed(names: DataFrame, column: str = "value") -> DataFrame:
    """tile, lat, lon: names without their margins, empty ones dropped; lat and lon null where a name isn't a tile's."""
    tile = F.trim(F.regexp_replace(F.col(column), r"[\t\r\n]", " "))
    part = lambda i: F.regexp_extract("tile", NAME, i)
    signed = lambda way, number, minus: F.when(part(way) != "", F.when(part(way) == minus, -1).otherwise(1) * part(number).try_cast("int"))
    return names.select(tile.alias("tile")).where("tile <> ''").withColumns({"lat": signed(1, 2, "S"), "lon": signed(3, 4, "W")})


def in_box(lat: Column, lon: Column, box: tuple[int, int, int, int]) -> Column:
    return F.coalesce(lat.between(box[0], box[1]) & lon.between(box[2], box[3]), F.lit(False))


def counted(tiles: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """total and kept."""
    return tiles.agg(F.count("*").alias("total"), F.count_if(in_box(F.col("lat"), F.col("lon"), box)).alias("kept"))


def url(tile: Column, root: str = "s3://copernicus-dem-30m") -> Column:
    return F.concat(F.lit(f"{root}/"), tile, F.lit("/"), tile, F.lit(".tif"))


def square_name(lat: Column, lon: Column) -> Column:
    """N07W012 and the like."""
    return F.format_string("%s%02d%s%03d", F.when(lat >= 0, "N").otherwise("S"), F.abs(lat), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon))


def squares(bounds: DataFrame) -> DataFrame:
    """The bounds' columns (minx, miny, maxx, maxy) and lat, lon, tile: each square degree from the bounds, cut towards zero, to one
    beyond them."""
    cut = lambda c: F.col(c).cast("int")
    return bounds.withColumn("lat", F.explode(F.sequence(cut("miny"), cut("maxy") + 1))).withColumn("lon", F.explode(F.sequence(cut("minx"), cut("maxx") + 1))).withColumn("tile", F.concat(square_name(F.col("lat"), F.col("lon")), F.lit(".hgt.gz")))


def to_fetch(wanted: DataFrame, present: DataFrame, key: str = "tile") -> DataFrame:
    """What isn't there yet."""
    return wanted.join(present.select(key), key, "left_anti")
