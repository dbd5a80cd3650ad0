"""Plane geometry as column expressions and relational steps.

Rings are rows (feature, part, ring, seq, x, y) without a closing vertex; ring 0 is a part's exterior,
the others its holes. Part and ring measures are sums over edges, so rings of any length spread.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RING = ("feature", "part", "ring")


def edges(rings: DataFrame) -> DataFrame:
    """Each vertex with the next one of its ring, the first after the last: feature, part, ring, seq, x, y, x2, y2."""
    order = Window.partitionBy(*RING).orderBy("seq")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(whole))
    return rings.select(*RING, "seq", "x", "y", after("x").alias("x2"), after("y").alias("y2"))


def ring_measures(rings: DataFrame) -> DataFrame:
    """A row for each ring: points, area (unsigned), mx, my (centroid times area), bounds."""
    cross = F.col("x") * F.col("y2") - F.col("x2") * F.col("y")
    sums = edges(rings).groupBy(*RING).agg(
        F.count("*").alias("points"), F.sum(cross).alias("twice"), F.sum((F.col("x") + F.col("x2")) * cross).alias("sx"), F.sum((F.col("y") + F.col("y2")) * cross).alias("sy"),
        F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"),
    )
    way = F.signum("twice")
    return sums.select(*RING, "points", F.abs(F.col("twice") / 2).alias("area"), (F.col("sx") / 6 * way).alias("mx"), (F.col("sy") / 6 * way).alias("my"), "minx", "miny", "maxx", "maxy")


def measures(rings: DataFrame, by: tuple[str, ...] = ("feature",)) -> DataFrame:
    """area, cx, cy, bounds and holes of each feature (or part, with by=('feature', 'part')): exteriors less holes."""
    sign = F.when(F.col("ring") == 0, 1).otherwise(-1)
    outer = lambda c: F.when(F.col("ring") == 0, F.col(c))
    got = ring_measures(rings).groupBy(*by).agg(
        F.sum(sign * F.col("area")).alias("area"), F.sum(sign * F.col("mx")).alias("mx"), F.sum(sign * F.col("my")).alias("my"), F.min(outer("minx")).alias("minx"), F.min(outer("miny")).alias("miny"),
        F.max(outer("maxx")).alias("maxx"), F.max(outer("maxy")).alias("maxy"), F.count_if(F.col("ring") > 0).alias("holes"), F.max(outer("points")).alias("points"),
    )
    return got.select(*by, "area", (F.col("mx") / F.nullif("area", F.lit(0.0))).alias("cx"), (F.col("my") / F.nullif("area", F.lit(0.0))).alias("cy"), "minx", "miny", "maxx", "maxy", "holes", "points")


def segment_distance(px: Column, py: Column, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """From a point to a segment; of no length, to its end."""
    dx, dy = x2 - x, y2 - y
    along = F.coalesce(((px - x) * dx + (py - y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
    return F.sqrt(F.pow(px - x - t * dx, F.lit(2)) + F.pow(py - y - t * dy, F.lit(2)))


def crosses(px: Column, py: Column, x: Column, y: Column, x2: Column, y2: Column) -> Column:
    """Whether a ray from the point towards greater x meets the edge; an odd number of them means inside."""
    return ((y > py) != (y2 > py)) & (px < x + (py - y) * (x2 - x) / F.nullif(y2 - y, F.lit(0.0)))


def points_in(points: DataFrame, rings: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """keys, feature: the features that each point (keys, x, y) lies in, by even-odd crossings. Points and edges meet by
    unit rows of y, which bounds what each point is compared with."""
    e = edges(rings).select("feature", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    low, high = F.floor(F.least("y1", "y2")), F.floor(F.greatest("y1", "y2"))
    e = e.withColumn("band", F.explode(F.sequence(low, high)))
    p = points.select(*keys, F.col("x").alias("px"), F.col("y").alias("py"), F.floor("y").alias("band"))
    hit = crosses(F.col("px"), F.col("py"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    return p.join(e, "band").where(hit).groupBy(*keys, "feature").agg(F.count("*").alias("k")).where("k % 2 = 1").select(*keys, "feature")


def star(cx: Column, cy: Column, radius: float, inner: float, points: int, start_degrees: float = 0.0) -> Column:
    """The 2 * points vertices of a star as an array of (seq, x, y), outer and inner in turn."""
    def vertex(i: Column) -> Column:
        angle = F.lit(math.radians(start_degrees)) + F.lit(2 * math.pi) * i / F.lit(2 * points)
        r = F.when(i % 2 == 0, F.lit(float(radius))).otherwise(F.lit(radius * inner))
        return F.struct(i.alias("seq"), (cx + r * F.cos(angle)).alias("x"), (cy + r * F.sin(angle)).alias("y"))

    return F.transform(F.sequence(F.lit(0), F.lit(2 * points - 1)), vertex)


# WGS84, fixed values.
MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
E2 = FLATTENING * (2 - FLATTENING)
ECC = math.sqrt(E2)


def _q(sin):
    """Snyder 3-12, for a number or a column."""
    log = math.log if isinstance(sin, float) else F.ln
    return (1 - E2) * (sin / (1 - E2 * sin * sin) - (1 / (2 * ECC)) * log((1 - ECC * sin) / (1 + ECC * sin)))


def albers_constants(lat_1: float, lat_2: float, lat_0: float) -> tuple[float, float, float]:
    """n, C and rho0 of the ellipsoidal equal-area conic (Snyder 14-3 to 14-15), lengths in major axes."""
    a, b, o = (math.sin(math.radians(x)) for x in (lat_1, lat_2, lat_0))
    m1, m2 = (math.cos(math.radians(x)) ** 2 / (1 - E2 * s * s) for x, s in ((lat_1, a), (lat_2, b)))
    n = (m1 - m2) / (_q(b) - _q(a)) if lat_1 != lat_2 else a
    c = m1 + n * _q(a)
    return n, c, math.sqrt(c - n * _q(o)) / n


def albers(lon: Column, lat: Column, lat_1: float, lat_2: float, lat_0: float, lon_0: float) -> tuple[Column, Column]:
    """Metres east and north of degrees, on WGS84."""
    n, c, rho0 = albers_constants(lat_1, lat_2, lat_0)
    sin = F.sin(F.radians(lat))
    rho = F.sqrt(F.greatest(F.lit(0.0), F.lit(c) - n * _q(sin))) / F.lit(n)
    theta = F.lit(n) * F.radians(lon - F.lit(lon_0))
    return F.lit(MAJOR) * rho * F.sin(theta), F.lit(MAJOR) * (F.lit(rho0) - rho * F.cos(theta))


def equal_area_cylinder(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Metres in the cylindrical equal-area projection with true scale at 30 degrees, for areas."""
    k0 = math.cos(math.radians(30)) / math.sqrt(1 - E2 * 0.25)
    return F.lit(MAJOR * k0) * F.radians(lon), F.lit(MAJOR / (2 * k0)) * _q(F.sin(F.radians(lat)))


def forward(row: Column, col: Column, t: dict[str, float]) -> tuple[Column, Column]:
    """Affine: pixel to map. t holds a, b, c, d, e, f."""
    return t["c"] + col * t["a"] + row * t["b"], t["f"] + col * t["d"] + row * t["e"]


def inverse(x: Column, y: Column, t: dict[str, float]) -> tuple[Column, Column]:
    """Affine: map to fractional (row, col)."""
    det = t["a"] * t["e"] - t["b"] * t["d"]
    col = ((x - t["c"]) * t["e"] - (y - t["f"]) * t["b"]) / F.lit(det)
    row = ((y - t["f"]) * t["a"] - (x - t["c"]) * t["d"]) / F.lit(det)
    return row, col


def to_mm(rings: DataFrame, t: dict[str, float], mm_per_pixel: float, snap: bool = False) -> DataFrame:
    """Rings in map units become rings in mm: fractional pixels times mm; with snap, whole pixels."""
    row, col = inverse(F.col("x"), F.col("y"), t)
    if snap:
        row, col = F.floor(row), F.floor(col)
    return rings.withColumns({"x": col * mm_per_pixel, "y": row * mm_per_pixel})


def moved(rings: DataFrame, dx: float = 0.0, dy: float = 0.0, sx: float = 1.0, sy: float = 1.0) -> DataFrame:
    """Scaled, then shifted."""
    return rings.withColumns({"x": F.col("x") * sx + dx, "y": F.col("y") * sy + dy})


def exteriors(rings: DataFrame) -> DataFrame:
    """The parts without their holes."""
    return rings.where("ring = 0")


def boundary_lines(rings: DataFrame) -> DataFrame:
    """feature, line, x, y, x2, y2: every ring's edges as lines; shared borders are not dissolved."""
    return edges(rings).select("feature", F.concat_ws(":", "part", "ring").alias("line"), "seq", "x", "y", "x2", "y2")
