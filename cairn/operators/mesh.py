"""Mesh operators over vertices (vid, x, y, z) and faces (fid, a, b, c). `mesh_id` columns, if there are any, go in `by`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.operators.raster import surface_mm
from cairn.params import DEFAULT, Params


def surface_vertices(cells: DataFrame, n_cols: int, step: int = 1, p: Params = DEFAULT, by: tuple[str, ...] = ()) -> DataFrame:
    """A vertex for each cell with a value; vid is row * n_cols + col, which stays the same whatever is missing."""
    size = p.mm_per_pixel * step
    return cells.where("z IS NOT NULL").select(*by, (F.col("row").cast("long") * n_cols + F.col("col")).alias("vid"), (F.col("col") * size).alias("x"), (F.col("row") * size).alias("y"), surface_mm(F.col("z"), p).alias("z"))


def surface_faces(cells: DataFrame, n_cols: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Two triangles for each square of four cells that all have values: fid, a, b, c.

    Every cell votes for its four squares; a square with four votes is whole. That is one shuffle with
    partial counts where the plain way would be three self-joins.
    """
    corners = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((0, 0), (0, 1), (1, 0), (1, 1))))
    votes = cells.where("z IS NOT NULL").select(*by, "row", "col", F.explode(corners).alias("s")).select(*by, (F.col("row") - F.col("s.a")).alias("r"), (F.col("col") - F.col("s.b")).alias("c"))
    whole = votes.groupBy(*by, "r", "c").agg(F.count("*").alias("k")).where("k = 4")
    i0 = F.col("r").cast("long") * n_cols + F.col("c")
    pair = F.array(F.struct((2 * i0).alias("fid"), i0.alias("a"), (i0 + 1).alias("b"), (i0 + n_cols).alias("c")), F.struct((2 * i0 + 1).alias("fid"), (i0 + 1).alias("a"), (i0 + n_cols + 1).alias("b"), (i0 + n_cols).alias("c")))
    return whole.select(*by, F.explode(pair).alias("f")).select(*by, "f.*")


def directed_edges(faces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    three = F.array(*(F.struct(F.col(x).alias("u"), F.col(y).alias("v")) for x, y in (("a", "b"), ("b", "c"), ("c", "a"))))
    return faces.select(*by, F.explode(three).alias("e")).select(*by, "e.u", "e.v")


def edge_counts(faces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """u < v and in how many faces the edge is."""
    return directed_edges(faces, by).groupBy(*by, F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count("*").alias("n"))


def boundary_edges(faces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The edges of one face, in the direction in which the face has them."""
    e = directed_edges(faces, by).withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v")})
    once = e.groupBy(*by, "lo", "hi").agg(F.count("*").alias("n"), F.min("u").alias("u"), F.min("v").alias("v")).where("n = 1")
    return once.select(*by, "u", "v")


def solid_vertices(top: DataFrame, shift: int, base_z: float = 0.0, by: tuple[str, ...] = ()) -> DataFrame:
    """The surface's vertices and as many on the base, whose vid is greater by shift."""
    return top.select(*by, "vid", "x", "y", "z").unionByName(top.select(*by, (F.col("vid") + shift).alias("vid"), "x", "y", F.lit(base_z).alias("z")))


def solid_faces(top: DataFrame, shift: int, by: tuple[str, ...] = ()) -> DataFrame:
    """kind, a, b, c: top, base (turned) and two wall triangles for each boundary edge, wound so that the solid is closed."""
    rim = boundary_edges(top, by)
    walls = F.array(F.struct(F.col("v").alias("a"), F.col("u").alias("b"), (F.col("u") + shift).alias("c")), F.struct(F.col("v").alias("a"), (F.col("u") + shift).alias("b"), (F.col("v") + shift).alias("c")))
    return (
        top.select(*by, F.lit("top").alias("kind"), "a", "b", "c")
        .unionByName(top.select(*by, F.lit("base").alias("kind"), (F.col("c") + shift).alias("a"), (F.col("b") + shift).alias("b"), (F.col("a") + shift).alias("c")))
        .unionByName(rim.select(*by, F.lit("wall").alias("kind"), F.explode(walls).alias("w")).select(*by, "kind", "w.*"))
    )


def soundness(faces: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """n_edges, is_watertight (each edge in two faces), is_oriented (each direction once), is_volume (both)."""
    e = directed_edges(faces, by).withColumns({"lo": F.least("u", "v"), "hi": F.greatest("u", "v"), "up": (F.col("u") < F.col("v")).cast("int")})
    per = e.groupBy(*by, "lo", "hi").agg(F.count("*").alias("n"), F.sum("up").alias("up"))
    got = per.groupBy(*by).agg(F.count("*").alias("n_edges"), F.coalesce(F.every(F.col("n") == 2), F.lit(False)).alias("is_watertight"), F.coalesce(F.every((F.col("up") <= 1) & (F.col("n") - F.col("up") <= 1)), F.lit(False)).alias("is_oriented"))
    return got.withColumn("is_volume", F.col("is_watertight") & F.col("is_oriented"))


def merge_vertices(vertices: DataFrame, faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices at one place become the one with the least vid; faces follow, and those that lose a side go."""
    place = vertices.groupBy("x", "y", "z").agg(F.min("vid").alias("keep"))
    to = vertices.join(place, ["x", "y", "z"]).select("vid", "keep")
    for c in ("a", "b", "c"):
        faces = faces.join(to.withColumnsRenamed({"vid": c, "keep": f"k{c}"}), c)
    kept = faces.select("fid", F.col("ka").alias("a"), F.col("kb").alias("b"), F.col("kc").alias("c")).where("a <> b AND b <> c AND a <> c")
    return place.select(F.col("keep").alias("vid"), "x", "y", "z"), kept


def distinct_faces(faces: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """One face for each set of corners, the one with the least fid; with vertices, faces of no area go too."""
    corners = F.array_sort(F.array("a", "b", "c"))
    one = faces.groupBy(corners.alias("corners")).agg(F.min(F.struct("fid", "a", "b", "c")).alias("f")).select("f.*")
    if vertices is None:
        return one
    return with_corners(one, vertices).where(_area2("x", "y", "z") > 0).select("fid", "a", "b", "c")


def with_corners(faces: DataFrame, vertices: DataFrame, keep: tuple[str, ...] = ("fid",)) -> DataFrame:
    """Faces with ax, ay, az and so on."""
    out = faces
    for c in ("a", "b", "c"):
        out = out.join(vertices.select(F.col("vid").alias(c), F.col("x").alias(f"{c}x"), F.col("y").alias(f"{c}y"), F.col("z").alias(f"{c}z")), c)
    return out


def _area2(*_: str) -> Column:
    u = [F.col(f"b{k}") - F.col(f"a{k}") for k in "xyz"]
    v = [F.col(f"c{k}") - F.col(f"a{k}") for k in "xyz"]
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return cross[0] * cross[0] + cross[1] * cross[1] + cross[2] * cross[2]


def scale_mirror(vertices: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """x and y scaled, x mirrored and moved so that it starts at 0. Faces must then be turned, see turned()."""
    top = vertices.agg(F.max("x").alias("most"))
    return vertices.crossJoin(F.broadcast(top)).select("vid", ((F.col("most") - F.col("x")) * p.global_scale).alias("x"), (F.col("y") * p.global_scale).alias("y"), "z")


def turned(faces: DataFrame) -> DataFrame:
    """Faces with the other winding, as a mirror needs."""
    return faces.withColumns({"b": F.col("c"), "c": F.col("b")})


def section(faces: DataFrame, vertices: DataFrame, z: float) -> DataFrame:
    """fid, x0, y0, x1, y1: the segment in which each face that reaches both over and under z meets the plane."""
    f = with_corners(faces, vertices)
    over = {c: F.col(f"{c}z") > z for c in "abc"}

    def cut(p: str, q: str) -> Column:
        t = (F.lit(z) - F.col(f"{p}z")) / (F.col(f"{q}z") - F.col(f"{p}z"))
        at = lambda k: F.col(f"{p}{k}") + t * (F.col(f"{q}{k}") - F.col(f"{p}{k}"))
        return F.when(over[p] != over[q], F.struct(at("x").alias("x"), at("y").alias("y")))

    ends = F.array_sort(F.filter(F.array(cut("a", "b"), cut("b", "c"), cut("c", "a")), lambda e: e.isNotNull()))
    got = f.withColumn("e", ends).where(F.size("e") == 2)
    return got.select("fid", *(F.col("e")[i][k].alias(f"{k}{i}") for i in (0, 1) for k in "xy"))


def lower_in_box(vertices: DataFrame, boxes: DataFrame, p: Params = DEFAULT, band: tuple[float, float] | None = None) -> DataFrame:
    """vid, x, y, z, lowered: vertices of the top in a box (r0, r1, c0, c1 in pixels) come down to bridge_height_mm.

    band: only z between these; else at or over the base's thickness. Boxes are bridges, few for each mesh; they meet the
    vertices by whole pixels of y.
    """
    rows = boxes.select((F.col("c0") * p.mm_per_pixel).alias("x0"), ((F.col("c1") + 1) * p.mm_per_pixel).alias("x1"), F.explode(F.sequence("r0", F.col("r1") + 1)).alias("pixel"), F.col("r0").alias("first"), (F.col("r1") + 1).alias("last"))
    pixel = F.floor(F.col("y") / p.mm_per_pixel).cast("int")
    inside = F.col("z") >= p.base_mm if band is None else F.col("z").between(*band)
    hit = vertices.withColumn("pixel", pixel).join(rows, "pixel").where(inside & F.col("x").between(F.col("x0"), F.col("x1")) & (F.col("y") <= F.col("last") * p.mm_per_pixel)).select("vid").distinct().withColumn("hit", F.lit(True))
    return vertices.join(hit, "vid", "left").select("vid", "x", "y", F.when(F.col("hit"), F.lit(p.bridge_height_mm)).otherwise(F.col("z")).alias("z"), F.coalesce("hit", F.lit(False)).alias("lowered"))


def cell_of(vertices: DataFrame, size_mm: float) -> DataFrame:
    """Vertices with the row and col that lie nearest, halves to the even one."""
    return vertices.withColumns({"row": F.bround(F.col("y") / size_mm).cast("int"), "col": F.bround(F.col("x") / size_mm).cast("int")})


def emboss(vertices: DataFrame, mask: DataFrame, size_mm: float, depth_mm: float, p: Params = DEFAULT) -> DataFrame:
    """vid, x, y, z, embossed: surface vertices on a cell of the mask come down by depth, not under the base's thickness.
    Vertices that aren't on the surface (base_mm + 0.1 at most) stay as they are."""
    on = mask.select("row", "col").distinct().withColumn("on", F.lit(True))
    got = cell_of(vertices, size_mm).join(on, ["row", "col"], "left")
    hit = F.coalesce("on", F.lit(False)) & (F.col("z") > p.base_mm + 0.1)
    return got.select("vid", "x", "y", F.when(hit, F.greatest(F.col("z") - depth_mm, F.lit(p.base_mm))).otherwise(F.col("z")).alias("z"), hit.alias("embossed"))


def star_heights(vertices: DataFrame, centres: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """name, cx, cy, near, bottom_z, top_z: how far a raised star at each centre (name, cx, cy, local_base) reaches.

    Only what lies within the radius is looked at; a centre without vertices near has no row. Centres are one per mesh.
    """
    least = vertices.agg(F.min("z").alias("floor"))
    d2 = F.pow(F.col("x") - F.col("cx"), F.lit(2)) + F.pow(F.col("y") - F.col("cy"), F.lit(2))
    band = lambda c: F.floor(F.col(c) / p.star_radius_mm).cast("int")
    reach = centres.withColumn("band", F.explode(F.sequence(band("cy") - 1, band("cy") + 1)))
    near = vertices.withColumn("band", band("y")).join(reach, "band").where(d2 <= p.star_radius_mm**2).groupBy("name", "cx", "cy", "local_base").agg(F.count("*").alias("near"), F.min("z").alias("lo"), F.max("z").alias("hi"))
    got = near.crossJoin(F.broadcast(least))
    bottom = F.when(F.col("local_base"), F.greatest(F.col("lo"), F.col("floor") + 2.0)).otherwise(F.col("floor"))
    return got.select("name", "cx", "cy", "near", bottom.alias("bottom_z"), (F.col("hi") + p.star_height_mm).alias("top_z"))


def extents(vertices: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Least, greatest and size in x, y and z."""
    got = vertices.groupBy(*by).agg(*(f(c).alias(f"{n}{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    return got.withColumns({f"size_{c}": F.col(f"max{c}") - F.col(f"min{c}") for c in "xyz"})


def ordered_faces(faces: DataFrame) -> DataFrame:
    """Faces numbered from 0 in the order of fid, by ranges of fid so that no task sorts them all."""
    by = faces.withColumn("range", F.floor(F.col("fid") / 100_000))
    before = by.groupBy("range").agg(F.count("*").alias("k")).select("range", F.coalesce(F.sum("k").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("range").orderBy("fid")) - 1
    return by.withColumn("own", own).join(before, "range").select((F.col("base") + F.col("own")).alias("number"), "fid", "a", "b", "c")
