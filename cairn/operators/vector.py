"""Feature operators: choosing features and parts, joining lakes and capitals, and bridging islands.

Features are rows with attributes; their shapes are rings (geometry.py). Every rule is a join or a
window over all features at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions import geometry
from cairn.functions.geometry import edges, measures, segment_distance
from cairn.operators import overlay
from cairn.params import DEFAULT, Params


def named(features: DataFrame, wanted: DataFrame, columns: tuple[str, ...] = ("admin", "name")) -> DataFrame:
    """wanted (want) with the feature whose first column that matches says so: want, status, and the feature's columns.

    The columns are tried in turn; a name that none has keeps its row with status 'not found'.
    """
    tries = F.filter(F.array(*(F.struct(F.lit(i).alias("turn"), F.col(c).alias("want")) for i, c in enumerate(columns))), lambda t: t["want"].isNotNull())
    keyed = features.withColumn("t", F.explode(tries)).withColumns({"want": F.col("t.want"), "turn": F.col("t.turn")}).drop("t")
    best = Window.partitionBy("want")
    hits = wanted.join(keyed, "want", "left").withColumn("least", F.min("turn").over(best)).where("turn IS NULL OR turn = least")
    return hits.withColumn("status", F.when(F.col("turn").isNull(), "not found").otherwise("ok")).drop("turn", "least")


def upsert(tables: list[DataFrame], key: str) -> DataFrame:
    """Rows of several tables; of one key, the row of the last table that has it."""
    stacked = None
    for i, table in enumerate(tables):
        own = table.withColumn("priority", F.lit(i))
        stacked = own if stacked is None else stacked.unionByName(own)
    row = Window.partitionBy(key).orderBy(F.col("priority").desc())
    return stacked.withColumn("rn", F.row_number().over(row)).where("rn = 1").drop("rn")


def with_capital(features: DataFrame, capitals: DataFrame, key: str = "country") -> DataFrame:
    """Features with city, lon and lat of their capital; without one, has_star is false. The table of capitals is a dimension."""
    return features.join(capitals, key, "left").withColumn("has_star", F.col("city").isNotNull())


def ranked_parts(rings: DataFrame) -> DataFrame:
    """feature, part, area, cx, cy, points, holes, rank: parts by area, the largest first, of equals the one with the least number."""
    order = Window.partitionBy("feature").orderBy(F.col("area").desc(), "part")
    return measures(rings, ("feature", "part")).withColumn("rank", F.row_number().over(order))


def keep_parts(rings: DataFrame, rules: DataFrame, default_top: int | None = None) -> DataFrame:
    """Rings of the parts that the rules keep: feature, top (so many of the largest), east_of (and all whose centroid is there),
    drop_holes. A null top keeps all parts; features without a rule have default_top."""
    parts = ranked_parts(rings).join(rules, "feature", "left")
    top = F.coalesce(F.col("top"), F.lit(default_top).cast("int"))
    keep = top.isNull() | (F.col("rank") <= top) | F.coalesce(F.col("cx") >= F.col("east_of"), F.lit(False))
    kept = parts.where(keep).select("feature", "part", F.coalesce("drop_holes", F.lit(False)).alias("drop_holes"))
    return rings.join(kept, ["feature", "part"]).where("NOT drop_holes OR ring = 0").drop("drop_holes")


def large_holes(rings: DataFrame, least: float) -> DataFrame:
    """feature, part, ring, area of interior rings of at least that area."""
    return geometry.ring_measures(rings).where((F.col("ring") > 0) & (F.col("area") >= least)).select("feature", "part", "ring", "area")


def box_bins(rings: DataFrame, size: float) -> DataFrame:
    """feature, minx, miny, maxx, maxy, bx, by: a row for each square of a grid that a feature's box meets."""
    box = rings.where("ring = 0").groupBy("feature").agg(F.min("x").alias("minx"), F.min("y").alias("miny"), F.max("x").alias("maxx"), F.max("y").alias("maxy"))
    span = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / size), F.floor(F.col(b) / size)))
    return box.withColumn("bx", span("minx", "maxx")).withColumn("by", span("miny", "maxy"))


def box_pairs(left: DataFrame, right: DataFrame, size: float = 16.0) -> DataFrame:
    """left, right: features whose boxes meet. They are joined by grid squares, so far features are never compared."""
    a, b = box_bins(left, size), box_bins(right, size)
    b = b.select("bx", "by", *(F.col(c).alias(f"r_{c}") for c in ("feature", "minx", "miny", "maxx", "maxy")))
    meet = (F.col("minx") <= F.col("r_maxx")) & (F.col("maxx") >= F.col("r_minx")) & (F.col("miny") <= F.col("r_maxy")) & (F.col("maxy") >= F.col("r_miny"))
    return a.join(b, ["bx", "by"]).where(meet).select(F.col("feature").alias("left"), F.col("r_feature").alias("right")).distinct()


def ring_distance(points: DataFrame, rings: DataFrame) -> DataFrame:
    """name, feature, distance: from each point (name, feature, x, y) to the exteriors of its feature."""
    e = edges(rings.where("ring = 0"))
    p = points.select("name", "feature", F.col("x").alias("px"), F.col("y").alias("py"))
    d = segment_distance(F.col("px"), F.col("py"), F.col("x"), F.col("y"), F.col("x2"), F.col("y2"))
    return p.join(e, "feature").groupBy("name", "feature").agg(F.min(d).alias("distance"))


def near_border(points: DataFrame, rings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """name, feature, km, is_near: distance to the border of the feature's largest part, in degrees times km_per_degree."""
    main = ranked_parts(rings).where("rank = 1").select("feature", "part")
    km = F.col("distance") * p.km_per_degree
    return ring_distance(points, rings.join(main, ["feature", "part"])).select("name", "feature", km.alias("km"), (km <= p.border_km).alias("is_near"))


def nearest_points(rings: DataFrame) -> DataFrame:
    """feature, part, ix, iy, mx, my, distance: for each part but the largest, its point and the largest part's point that lie
    nearest. Vertices of either side meet the edges of the other, inside a feature; of equals, the least coordinates win."""
    ranks = ranked_parts(rings).select("feature", "part", "rank")
    e = edges(rings.where("ring = 0")).join(ranks, ["feature", "part"])
    main = e.where("rank = 1").select("feature", *(F.col(c).alias(f"m_{c}") for c in ("x", "y", "x2", "y2")))
    isle = e.where("rank > 1").select("feature", "part", "x", "y", "x2", "y2")

    def foot(px: Column, py: Column, x: Column, y: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
        dx, dy = x2 - x, y2 - y
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(((px - x) * dx + (py - y) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0)), F.lit(0.0))))
        return x + t * dx, y + t * dy

    c = F.col
    fx, fy = foot(c("x"), c("y"), c("m_x"), c("m_y"), c("m_x2"), c("m_y2"))  # isle's vertex on the main part's edge
    gx, gy = foot(c("m_x"), c("m_y"), c("x"), c("y"), c("x2"), c("y2"))
    far = lambda ax, ay, bx, by: F.sqrt(F.pow(ax - bx, F.lit(2)) + F.pow(ay - by, F.lit(2)))
    pick = lambda d, ax, ay, bx, by: F.struct(d.alias("distance"), ax.alias("ix"), ay.alias("iy"), bx.alias("mx"), by.alias("my"))
    both = F.least(pick(far(c("x"), c("y"), fx, fy), c("x"), c("y"), fx, fy), pick(far(gx, gy, c("m_x"), c("m_y")), gx, gy, c("m_x"), c("m_y")))
    return isle.join(main, "feature").groupBy("feature", "part").agg(F.min(both).alias("best")).select("feature", "part", "best.*")


def bridges(rings: DataFrame, areas: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """feature, part, area_km2, km, status, and the line from island to mainland: islands of at least island_min_km2.

    areas: feature, part, area_km2. status: 'bridge', or 'too far' beyond bridge_max_km.
    """
    order = Window.partitionBy("feature").orderBy(F.col("area_km2").desc(), "part")
    isles = areas.withColumn("rank", F.row_number().over(order)).where((F.col("rank") > 1) & (F.col("area_km2") >= p.island_min_km2)).select("feature", "part", "area_km2")
    km = F.col("distance") * p.km_per_degree
    return isles.join(nearest_points(rings), ["feature", "part"]).select("feature", "part", "area_km2", km.alias("km"), F.when(km > p.bridge_max_km, "too far").otherwise("bridge").alias("status"), "ix", "iy", "mx", "my")


#: Degrees by which a bridge reaches into either shore, so that its end does not run along a border.
PAST = 0.001


def bridge_rings(lines: DataFrame, p: Params = DEFAULT, past: float = 0.0) -> DataFrame:
    """Each bridge as a ring of four points: the line with flat ends, bridge_width_km to either side (so twice as wide in all),
    longer by `past` at both ends."""
    half = F.lit(p.bridge_width_km / p.km_per_degree)
    dx, dy = F.col("mx") - F.col("ix"), F.col("my") - F.col("iy")
    length = F.nullif(F.sqrt(dx * dx + dy * dy), F.lit(0.0))
    lines = lines.withColumns({"ix": F.col("ix") - dx / length * past, "iy": F.col("iy") - dy / length * past, "mx": F.col("mx") + dx / length * past, "my": F.col("my") + dy / length * past}) if past else lines
    ox, oy = -dy / length * half, dx / length * half
    at = lambda i, x, y: F.struct(F.lit(i).alias("seq"), x.alias("x"), y.alias("y"))
    four = F.array(at(0, F.col("ix") + ox, F.col("iy") + oy), at(1, F.col("mx") + ox, F.col("my") + oy), at(2, F.col("mx") - ox, F.col("my") - oy), at(3, F.col("ix") - ox, F.col("iy") - oy))
    return lines.where("status = 'bridge'").select(F.concat_ws(":", "feature", "part").alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(four).alias("v")).select("feature", "part", "ring", "v.*").where("x IS NOT NULL")


def join_islands(rings: DataFrame, areas: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rings of each feature as one shape: its largest part, the islands that get a bridge, and the bridges. Other islands go.

    areas: feature, part, area_km2. All features in one plan; a feature is what one task must hold.
    """
    lines = bridges(rings, areas, p).where("status = 'bridge'")
    order = Window.partitionBy("feature").orderBy(F.col("area_km2").desc(), "part")
    main = areas.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("feature", "part")
    stay = main.unionByName(lines.select("feature", "part")).withColumn("piece", F.concat(F.lit("part "), F.col("part").cast("string")))
    land = rings.join(stay, ["feature", "part"]).select("feature", "piece", "part", "ring", "seq", "x", "y")
    named = lines.select("feature", F.concat_ws(":", "feature", "part").alias("bridge"))
    spans = bridge_rings(lines, p, PAST).withColumnRenamed("feature", "bridge").join(named, "bridge")
    return overlay.unite(land.unionByName(spans.select("feature", F.concat(F.lit("to "), F.col("bridge")).alias("piece"), "part", "ring", "seq", "x", "y")))


def equal_area_km2(rings: DataFrame) -> DataFrame:
    """feature, km2: areas of shapes in degrees, by a cylindrical equal-area projection."""
    x, y = geometry.equal_area_cylinder(F.col("x"), F.col("y"))
    flat = rings.select("feature", "part", "ring", "seq", x.alias("x"), y.alias("y"))
    return measures(flat).select("feature", (F.col("area") / 1e6).alias("km2"))


def merge_lakes(features: DataFrame, rings: DataFrame, lakes: DataFrame, least_km2: float = DEFAULT.merged_lake_min_km2) -> tuple[DataFrame, DataFrame]:
    """The features' rings without the lakes of at least least_km2 that meet them, and the features with lakes (cut) and holes
    (left in the result). Features without lakes stay as they are."""
    large = equal_area_km2(lakes).where(F.col("km2") >= least_km2).select(F.col("feature").alias("right"))
    near = box_pairs(rings, lakes).join(large, "right", "left_semi").withColumn("pair", F.concat_ws("\x1f", "left", "right"))
    shape = ["part", "ring", "seq", "x", "y"]
    mine = rings.join(near.withColumnRenamed("left", "feature"), "feature").select(F.col("pair").alias("feature"), *shape)
    other = lakes.join(near.withColumnRenamed("right", "feature"), "feature").select(F.col("pair").alias("feature"), *shape)
    met = overlay.combine(mine, other, near.select(F.col("pair").alias("left"), F.col("pair").alias("right")), "intersection").select("feature").distinct()
    pairs = met.select(F.split("feature", "\x1f")[0].alias("left"), F.split("feature", "\x1f")[1].alias("right"))
    merged = overlay.combine(rings, lakes, pairs, "difference")
    cut = pairs.groupBy(F.col("left").alias("feature")).agg(F.count("*").alias("lakes"))
    holes = merged.where("ring > 0").groupBy("feature").agg(F.countDistinct("part", "ring").alias("holes"))
    counts = features.join(cut, "feature", "left").join(holes, "feature", "left")
    return merged, counts.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lakes", "holes")})


def capital_mm(places: DataFrame, transform: dict[str, float], n_rows: int, n_cols: int, p: Params = DEFAULT, conic: tuple[float, ...] | None = None) -> DataFrame:
    """The places (lon, lat) with x_mm and y_mm of their cell on a print of every p.step-th cell; null outside the raster.

    conic: of a raster in an equal-area conic, its lat_1, lat_2, lat_0, lon_0; else the raster is in degrees.
    """
    x, y = (F.col("lon"), F.col("lat")) if conic is None else geometry.albers(F.col("lon"), F.col("lat"), *conic[:4])
    row, col = (F.floor(c) for c in geometry.inverse(x, y, transform))
    inside = row.between(0, n_rows - 1) & col.between(0, n_cols - 1)
    mm = lambda c: F.when(inside, F.floor(c / p.step) * (p.step * p.mm_per_pixel))
    return places.withColumns({"x_mm": mm(col), "y_mm": mm(row)})


def with_points(rings: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """feature, part, ring, points of exteriors with p.min_ring_points at least, the closing point counted."""
    return geometry.ring_measures(rings).where((F.col("ring") == 0) & (F.col("points") + 1 >= p.min_ring_points)).select("feature", "part", "ring", "points")
