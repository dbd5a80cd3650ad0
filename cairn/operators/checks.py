"""Quality metrics of boundaries and meshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import crosses
from cairn.operators.raster import grade
from cairn.params import DEFAULT, Params


def overlap(boundary: DataFrame, footprint: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """feature, boundary, footprint, shared, missing, extra, coverage_pct, missing_pct, passed, grade: over cells (feature, row, col).

    coverage_pct is footprint over boundary and may pass 100; only what is missing decides.
    """
    keys = ["feature", "row", "col"]
    a, b = boundary.select(*keys, F.lit(1).alias("a")), footprint.select(*keys, F.lit(1).alias("b"))
    got = a.join(b, keys, "full").groupBy("feature").agg(F.count("a").alias("boundary"), F.count("b").alias("footprint"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared"))
    missing = F.col("boundary") - F.col("shared")
    pct = 100 * missing / F.nullif("boundary", F.lit(0))
    return got.select("feature", "boundary", "footprint", "shared", missing.alias("missing"), (F.col("footprint") - F.col("shared")).alias("extra"), (100 * F.col("footprint") / F.nullif("boundary", F.lit(0))).alias("coverage_pct"), pct.alias("missing_pct"), (pct <= p.max_missing_pct).alias("passed"), grade(100 - pct).alias("grade"))


def best_shift(boundary: DataFrame, footprint: DataFrame, reach: int) -> DataFrame:
    """feature, dx, dy, covered: the whole-cell shift of the boundary, up to reach either way, that covers most of it; the first
    in the order of dx, then dy, wins. The footprint would move the other way. A feature that no shift covers keeps (0, 0).

    A cell of one meets a cell of the other in just one shift, so one equi-join by row bands counts all
    shifts, and nothing is laid over anything 61 x 61 times.
    """
    a = boundary.select("feature", "row", F.col("col").alias("ac")).withColumn("dy", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).select("feature", (F.col("row") + F.col("dy")).alias("row"), "ac", "dy")
    b = footprint.select("feature", "row", F.col("col").alias("bc"))
    hits = a.join(b, ["feature", "row"]).withColumn("dx", F.col("bc") - F.col("ac")).where(F.col("dx").between(-reach, reach)).groupBy("feature", "dx", "dy").agg(F.count("*").alias("covered"))
    best = hits.groupBy("feature").agg(F.max(F.struct("covered", (-F.col("dx")).alias("x"), (-F.col("dy")).alias("y"))).alias("m")).select("feature", (-F.col("m.x")).alias("dx"), (-F.col("m.y")).alias("dy"), F.col("m.covered").alias("covered"))
    return boundary.select("feature").distinct().join(best, "feature", "left").select("feature", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("dx", "dy", "covered")))


def directions(edges: DataFrame, least: float = 0.1, tolerance: float = 5.0) -> DataFrame:
    """Edges longer than `least` with angle in [0, 360) and way: 'H', 'V' or null, within `tolerance` degrees."""
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    angle = F.pmod(F.degrees(F.atan2(dy, dx)), F.lit(360.0))
    near = lambda d: F.abs(F.col("angle") - d) < tolerance
    way = F.when(near(0) | (F.col("angle") > 360 - tolerance) | near(180), "H").when(near(90) | near(270), "V")
    return edges.where(F.sqrt(dx * dx + dy * dy) > least).withColumn("angle", angle).withColumn("way", way)


def stair_steps(edges: DataFrame, p: Params = DEFAULT, least: float = 0.1) -> DataFrame:
    """feature, total_boundary_edges, stair_step_count, stair_step_ratio, is_aliased, threshold: three edges in a row, in the
    order of the ring, that go H-V-H or V-H-V. A feature of fewer than three edges has ratio 0."""
    order = Window.partitionBy("feature", "part", "ring").orderBy("seq")
    d = directions(edges, least).select("feature", "way", F.lead("way", 1).over(order).alias("w1"), F.lead("way", 2).over(order).alias("w2"))
    step = F.coalesce((F.col("way") == F.col("w2")) & (F.col("way") != F.col("w1")), F.lit(False))
    got = d.groupBy("feature").agg(F.count("*").alias("total_boundary_edges"), F.count_if(step).alias("stair_step_count"))
    ratio = F.when(F.col("total_boundary_edges") > 2, F.col("stair_step_count") / F.nullif(F.col("total_boundary_edges") - 2, F.lit(0))).otherwise(F.lit(0.0))
    return got.withColumn("stair_step_ratio", ratio).withColumn("is_aliased", F.col("stair_step_ratio") > p.stair_threshold).withColumn("threshold", F.lit(p.stair_threshold))


def axis_aligned(edges: DataFrame, p: Params = DEFAULT, least: float = 0.01) -> DataFrame:
    """feature, edges, aligned, ratio, is_smooth: the share of edges along an axis, smooth under one half."""
    got = directions(edges, least).groupBy("feature").agg(F.count("*").alias("edges"), F.count("way").alias("aligned"))
    return got.withColumn("ratio", F.col("aligned") / F.col("edges")).withColumn("is_smooth", F.col("ratio") < p.smooth_threshold)


def in_section(points: DataFrame, segments: DataFrame) -> DataFrame:
    """name, crossings, in_solid: whether each point (name, x, y) is inside the outline that the segments (x0, y0, x1, y1) make."""
    hit = crosses(F.col("px"), F.col("py"), F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    band = lambda c: F.floor(c)
    s = segments.withColumn("band", F.explode(F.sequence(band(F.least("y0", "y1")), band(F.greatest("y0", "y1")))))
    p = points.select("name", F.col("x").alias("px"), F.col("y").alias("py"), band(F.col("y")).alias("band"))
    got = p.join(s, "band", "left").groupBy("name").agg(F.count_if(hit).alias("crossings"))
    return got.withColumn("in_solid", F.col("crossings") % 2 == 1)


def star_holes(points: DataFrame, segments: DataFrame) -> DataFrame:
    """name, has_hole, hole_coverage (0 or 100), message: a hole is where the point lies in no solid."""
    got = in_section(points, segments)
    hole = ~F.col("in_solid")
    return got.select("name", hole.alias("has_hole"), F.when(hole, 100.0).otherwise(0.0).alias("hole_coverage"), F.when(hole, "hole found").otherwise("solid at the capital").alias("message"))


def keep_sections(polygons: DataFrame, least: float = 0.01) -> DataFrame:
    """Section polygons (area) worth keeping."""
    return polygons.where(F.col("area") > least)
