"""Raster operators over cells (row, col, z and more), one row for each cell.

Cells without a value have z NULL. Several rasters can lie in one table: operators with `by`, which
names the columns that tell them apart, then work on all of them in one plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.geometry import edges, segment_distance
from cairn.operators import tiling
from cairn.params import DEFAULT, Params

CELL = ("row", "col")


def rasterize(rings: DataFrame) -> DataFrame:
    """feature, row, col: cells whose centre (col + 0.5, row + 0.5) is inside, by even-odd crossings.

    Each edge gives a crossing for each row of centres that it spans; sorted crossings pair into runs of
    cells. No cell is ever compared with an edge.
    """
    e = edges(rings).where("y <> y2")
    low, high = F.least("y", "y2"), F.greatest("y", "y2")
    first, last = F.ceil(low - 0.5).cast("int"), (F.ceil(high - 0.5) - 1).cast("int")
    e = e.withColumns({"first": first, "last": last}).where("first <= last")
    e = e.select("feature", "x", "y", "x2", "y2", F.explode(F.sequence("first", "last")).alias("row"))
    at = e.select("feature", "row", (F.col("x") + (F.col("row") + 0.5 - F.col("y")) * (F.col("x2") - F.col("x")) / (F.col("y2") - F.col("y"))).alias("at"))
    order = Window.partitionBy("feature", "row").orderBy("at")
    runs = at.select("feature", "row", "at", F.lead("at").over(order).alias("until"), F.row_number().over(order).alias("k")).where("k % 2 = 1 AND until IS NOT NULL")
    runs = runs.select("feature", "row", F.ceil(F.col("at") - 0.5).cast("int").alias("a"), (F.ceil(F.col("until") - 0.5) - 1).cast("int").alias("b")).where("a <= b")
    return runs.select("feature", "row", F.explode(F.sequence("a", "b")).alias("col"))


def clip(cells: DataFrame, rings: DataFrame) -> DataFrame:
    """feature, row, col, z, inside: the cells of each feature's box; outside the feature, z is 0."""
    mask = rasterize(rings).withColumn("inside", F.lit(True))
    box = mask.groupBy("feature").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"))
    # One row for each row of a box keeps the join an equi-join.
    rows = box.select("feature", "c0", "c1", F.explode(F.sequence("r0", "r1")).alias("row"))
    got = cells.select("row", "col", "z").join(rows, "row").where("col BETWEEN c0 AND c1").drop("c0", "c1").join(mask, ["feature", "row", "col"], "left")
    return got.select("feature", "row", "col", F.when(F.col("inside"), F.col("z")).otherwise(F.lit(0).cast(cells.schema["z"].dataType)).alias("z"), F.coalesce("inside", F.lit(False)).alias("inside"))


def sea_fill(z: Column, inside: Column, p: Params = DEFAULT) -> Column:
    """Nothing outside the mask; at or under the sea, and where there is no value, the padding."""
    return F.when(inside, F.when(z.isNull() | (z <= p.sea_level_m), F.lit(p.sea_padding_m)).otherwise(z))


def surface_mm(z: Column, p: Params = DEFAULT) -> Column:
    return F.lit(p.base_mm) + F.lit(p.z_mm_per_m) * z


def block_average(cells: DataFrame, size: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over blocks of size x size cells; blocks at the rim average what they have."""
    return cells.groupBy(*by, F.floor(F.col("row") / size).cast("int").alias("row"), F.floor(F.col("col") / size).cast("int").alias("col")).agg(F.avg("z").alias("z"), F.count("z").alias("n"))


def decimate(cells: DataFrame, step: int) -> DataFrame:
    """Every step-th row and column, numbered anew."""
    return cells.where((F.col("row") % step == 0) & (F.col("col") % step == 0)).withColumns({"row": F.expr(f"cast(row div {step} as int)"), "col": F.expr(f"cast(col div {step} as int)")})


def mosaic(layers: list[DataFrame], by: tuple[str, ...] = ()) -> DataFrame:
    """One raster of several; where they overlap, the last that has a value wins."""
    stacked = None
    for i, layer in enumerate(layers):
        own = layer.select(*by, "row", "col", "z").where("z IS NOT NULL").withColumn("layer", F.lit(i))
        stacked = own if stacked is None else stacked.unionByName(own)
    return stacked.groupBy(*by, *CELL).agg(F.max_by("z", "layer").alias("z"), F.max("layer").alias("layer"))


def kernel(sigma: float) -> list[float]:
    """Weights of a Gaussian cut at four sigma; their sum is 1."""
    r = int(4 * sigma + 0.5)
    w = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(w) for x in w]


def blur(cells: DataFrame, sigma: float, values: list[str], by: tuple[str, ...] = (), shape: tuple[int, int] | None = None) -> DataFrame:
    """Separable Gaussian blur of the value columns over a full grid from (0, 0), mirrored at the rim. Cells that are
    missing count as 0. One shuffle deals cells to tiles with halos."""
    return tiling.blur(cells, kernel(sigma), values, by, shape)


def masked_blur(cells: DataFrame, sigma: float, by: tuple[str, ...] = (), shape: tuple[int, int] | None = None) -> DataFrame:
    """row, col, z, weight, blurred: blur over the cells that have a value, renormalised; null where none is near."""
    return tiling.masked_blur(cells, kernel(sigma), by, shape)


def blend(raw: Column, blurred: Column, p: Params = DEFAULT) -> Column:
    """Mostly the blur; where the land stands over it by more than peak_m, mostly the land."""
    peak = F.lit(p.peak_keep) * raw + F.lit(1 - p.peak_keep) * blurred
    return F.when(raw - blurred > p.peak_m, peak).otherwise(F.lit(p.dem_blend) * blurred + F.lit(1 - p.dem_blend) * raw)


def label(mask: DataFrame, n_cols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """row, col, component of each cell of the mask: four neighbours, the least row * n_cols + col names a component."""
    return tiling.label(mask, n_cols, by)


def large_components(labelled: DataFrame, least: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The cells of components with at least that many."""
    sizes = labelled.groupBy(*by, "component").agg(F.count("*").alias("size")).where(F.col("size") >= least)
    return labelled.join(sizes, [*by, "component"])


def grid(n_rows: int, n_cols: int, spark) -> DataFrame:
    return spark.range(n_rows * n_cols).select(F.expr(f"cast(id div {n_cols} as int)").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"))


def fill_holes(mask: DataFrame, n_rows: int, n_cols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The mask and the cells outside of it from which no path of four neighbours leads to the rim."""
    full = grid(n_rows, n_cols, mask.sparkSession)
    if by:
        span = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
        full = mask.select(*by).distinct().withColumn("row", span(n_rows)).withColumn("col", span(n_cols))
    outside = full.join(mask.select(*by, *CELL), [*by, *CELL], "left_anti")
    labelled = label(outside, n_cols, by)
    rim = (F.col("row") == 0) | (F.col("col") == 0) | (F.col("row") == n_rows - 1) | (F.col("col") == n_cols - 1)
    open_ = labelled.where(rim).select(*by, "component").distinct()
    return mask.select(*by, *CELL).unionByName(labelled.join(open_, [*by, "component"], "left_anti").select(*by, *CELL))


CROSS = ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1))


def _crossed(mask: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """A row for each cell of the mask and each of the cross around it."""
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CROSS))
    return mask.select(*by, *CELL, F.explode(steps).alias("s")).select(*by, (F.col("row") + F.col("s.a")).alias("row"), (F.col("col") + F.col("s.b")).alias("col"))


def dilate(mask: DataFrame, times: int, n_rows: int, n_cols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The mask grown by a cross, as often."""
    for _ in range(times):
        mask = _crossed(mask, by).where(F.col("row").between(0, n_rows - 1) & F.col("col").between(0, n_cols - 1)).distinct()
    return mask


def close(mask: DataFrame, times: int, by: tuple[str, ...] = ()) -> DataFrame:
    """The mask grown by a cross, as often, and then shrunk as often: gaps of up to twice that width close, nothing is lost."""
    for _ in range(times):
        mask = _crossed(mask, by).distinct()
    for _ in range(times):
        mask = _crossed(mask, by).groupBy(*by, *CELL).agg(F.count("*").alias("k")).where(F.col("k") == len(CROSS)).drop("k")
    return mask


def line_mask(lines: DataFrame, reach: float, n_rows: int, n_cols: int) -> DataFrame:
    """row, col: cells of the grid whose centre lies within `reach` cells of a line (x, y, x2, y2): the lines' buffer, as cells.

    Lines are cut into pieces no longer than the reach (or a cell), so each meets only the few cells around it.
    """
    length = F.sqrt(F.pow(F.col("x2") - F.col("x"), F.lit(2)) + F.pow(F.col("y2") - F.col("y"), F.lit(2)))
    cut = lines.select("x", "y", "x2", "y2", F.greatest(F.lit(1), F.ceil(length / max(reach, 1.0))).cast("int").alias("k")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    at = lambda c, i: F.col(c) + (F.col(f"{c}2") - F.col(c)) * i / F.col("k")
    pieces = cut.select(*(at(c, F.col("i") + j).alias(f"{c}{j}") for c in "xy" for j in (0, 1)))
    first = lambda c: F.greatest(F.lit(0), F.ceil(F.least(f"{c}0", f"{c}1") - reach - 0.5).cast("int"))
    last = lambda c, n: F.least(F.lit(n - 1), F.floor(F.greatest(f"{c}0", f"{c}1") + reach - 0.5).cast("int"))
    boxed = pieces.withColumns({"r0": first("y"), "r1": last("y", n_rows), "c0": first("x"), "c1": last("x", n_cols)}).where("r0 <= r1 AND c0 <= c1")
    near = boxed.withColumn("row", F.explode(F.sequence("r0", "r1"))).withColumn("col", F.explode(F.sequence("c0", "c1")))
    return near.where(segment_distance(F.col("col") + 0.5, F.col("row") + 0.5, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")) <= reach).select(*CELL).distinct()


def smooth(cells: DataFrame, n_rows: int, n_cols: int, p: Params = DEFAULT, nodata: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """row, col, z: the whole smoother over a full grid. Components, small ones dropped, holes filled, mask softened, sea
    padded, masked blur, blend. z is null outside the softened mask."""
    at = [*by, *CELL]
    labelled = label(cells.where((F.col("z") != nodata) & F.col("z").isNotNull()), n_cols, by)
    mask = fill_holes(large_components(labelled, p.min_component_pixels, by), n_rows, n_cols, by)
    soft = blur(mask.withColumn("m", F.lit(1.0)), p.mask_sigma, ["m"], by, (n_rows, n_cols)).where(F.col("m") > p.mask_threshold).select(*at, F.lit(True).alias("inside"))
    raw = cells.select(*at, "z").join(soft, at, "left").select(*at, sea_fill(F.col("z"), F.coalesce("inside", F.lit(False)), p).cast("double").alias("z"))
    return masked_blur(raw, p.dem_sigma, by, (n_rows, n_cols)).select(*at, blend(F.col("z"), F.col("blurred"), p).alias("z"))


def coverage(cells: DataFrame, rings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """feature, total, with_data, missing, missing_pct, is_valid, grade: how much of each feature has values."""
    inside = rasterize(rings).join(cells.select(*CELL, "z"), list(CELL), "left").groupBy("feature").agg(F.count("*").alias("total"), F.count("z").alias("with_data"))
    pct = 100 * (F.col("total") - F.col("with_data")) / F.col("total")
    return inside.select("feature", "total", "with_data", (F.col("total") - F.col("with_data")).alias("missing"), pct.alias("missing_pct"), (pct < p.max_missing_pct).alias("is_valid"), grade(100 - pct).alias("grade"))


def grade(covered: Column) -> Column:
    """Bands from 98, 95 and 90 per cent."""
    return F.when(covered >= 98, "excellent").when(covered >= 95, "good").when(covered >= 90, "acceptable").otherwise("poor")


def to_byte(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """row, col, byte: z from least to greatest over 0 to 255, cut to whole numbers."""
    ends = cells.groupBy(*by).agg(F.min("z").alias("lo"), F.max("z").alias("hi"))
    share = (F.col("z") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    with_ends = cells.join(ends, list(by)) if by else cells.crossJoin(F.broadcast(ends))  # one row
    return with_ends.select(*by, *CELL, F.floor(255 * share).cast("int").alias("byte"))


def reproject_average(cells: DataFrame, x: Column, y: Column, size: float) -> DataFrame:
    """Cells whose centres fall at (x, y), averaged on squares of `size`: row (southward), col, z, n."""
    return cells.select(F.floor(x / size).cast("int").alias("col"), F.floor(-y / size).cast("int").alias("row"), "z").groupBy("row", "col").agg(F.avg("z").alias("z"), F.count("z").alias("n"))


def mark(cells: DataFrame, rings: DataFrame, n_rows: int, n_cols: int, p: Params = DEFAULT) -> DataFrame:
    """row, col, z, marked: cells under the features (grown twice) get the height that prints as bridge_height_mm."""
    height = (p.bridge_height_mm - p.base_mm) / p.z_mm_per_m
    under = dilate(rasterize(rings).select(*CELL).distinct(), 2, n_rows, n_cols).withColumn("marked", F.lit(True))
    return cells.join(under, list(CELL), "left").select(*CELL, F.when(F.col("marked"), F.lit(height)).otherwise(F.col("z").cast("double")).alias("z"), F.coalesce("marked", F.lit(False)).alias("marked"))


def boxes(rings: DataFrame, n_rows: int, n_cols: int) -> DataFrame:
    """feature, r0, r1, c0, c1, n: what each feature covers after growing twice."""
    under = dilate(rasterize(rings), 2, n_rows, n_cols, ("feature",))
    return under.groupBy("feature").agg(F.min("row").alias("r0"), F.max("row").alias("r1"), F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))
