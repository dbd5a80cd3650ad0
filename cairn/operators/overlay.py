"""The kernels run in Spark: a shape or a mesh is one group; what is large (faces against polygons) is joined by squares.

A prism stands upright in every boolean of this library, so a solid over a height field meets it in the
plane: its top's triangles are clipped by the polygon's triangles, with z interpolated, and the solid is
closed again below (mesh.solid_faces). What lies outside a polygon is what lies inside a box that has
the polygon for a hole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import kernels
from cairn.params import DEFAULT, Params

RINGS = "feature string, part int, ring int, seq int, x double, y double"


def _shape(rows: pd.DataFrame) -> list:
    rows = rows.sort_values(["part", "ring", "seq"])
    return [[list(zip(r.x, r.y, strict=True)) for _, r in p.groupby("ring", sort=True)] for _, p in rows.groupby("part", sort=True)]


def _rows(feature: str, shape: list) -> pd.DataFrame:
    out = [(feature, i, j, k, float(x), float(y)) for i, p in enumerate(shape) for j, r in enumerate(p) for k, (x, y) in enumerate(r)]
    return pd.DataFrame(out, columns=["feature", "part", "ring", "seq", "x", "y"])


def simplify(rings: DataFrame, tolerance: float) -> DataFrame:
    """Each ring with fewer points, none farther than the tolerance from the line it leaves."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        ring = kernels.simplify(list(zip(rows.x, rows.y, strict=True)), tolerance)
        out = pd.DataFrame(ring, columns=["x", "y"])
        return out.assign(feature=rows.feature.iloc[0], part=rows.part.iloc[0], ring=rows.ring.iloc[0], seq=range(len(out)))[["feature", "part", "ring", "seq", "x", "y"]]

    return rings.select("feature", "part", "ring", "seq", "x", "y").groupBy("feature", "part", "ring").applyInPandas(run, RINGS)


def combine(left: DataFrame, right: DataFrame, pairs: DataFrame, kind: str) -> DataFrame:
    """Each left feature with the right features that `pairs` (left, right) names, one after the other: 'difference', 'union' or 'intersection'.

    Features without a pair stay. A feature's rings and those of its pairs are one group; a feature is what one task must hold.
    """
    cols = ["feature", "part", "ring", "seq", "x", "y"]
    own = left.select(F.col("feature").alias("of"), F.lit("").alias("other"), *cols[1:])
    more = pairs.join(right, pairs["right"] == right["feature"]).select(F.col("left").alias("of"), F.col("right").alias("other"), *cols[1:])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shape = _shape(rows[rows.other == ""])
        for _, r in rows[rows.other != ""].groupby("other", sort=True):
            shape = kernels.boolean(shape, _shape(r), kind) if shape else shape
        return _rows(rows.of.iloc[0], shape)

    both = own.unionByName(more)
    return both.groupBy("of").applyInPandas(run, RINGS)


def intersect_box(rings: DataFrame, box: tuple[float, float, float, float]) -> DataFrame:
    """What of each feature lies in a box (minx, miny, maxx, maxy)."""
    x0, y0, x1, y1 = box
    frame = [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)]]]

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return _rows(rows.feature.iloc[0], kernels.boolean(_shape(rows), frame, "intersection"))

    return rings.select("feature", "part", "ring", "seq", "x", "y").groupBy("feature").applyInPandas(run, RINGS)


def dissolve(rings: DataFrame, into: str = "all") -> DataFrame:
    """One feature that covers what any of the features covers."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shape: list = []
        for _, r in rows.groupby("feature", sort=True):
            shape = kernels.boolean(shape, _shape(r), "union") if shape else _shape(r)
        return _rows(into, shape)

    return rings.select("feature", "part", "ring", "seq", "x", "y").groupBy(F.lit(into).alias("k")).applyInPandas(lambda rows: run(rows.drop(columns="k", errors="ignore")), RINGS)


def unite(pieces: DataFrame) -> DataFrame:
    """Each feature as one shape that covers what any of its pieces (feature, piece, part, ring, seq, x, y) covers. Features spread."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shape: list = []
        for _, r in rows.groupby("piece", sort=True):
            shape = kernels.boolean(shape, _shape(r), "union") if shape else _shape(r)
        return _rows(rows.feature.iloc[0], shape)

    return pieces.select("feature", "piece", "part", "ring", "seq", "x", "y").groupBy("feature").applyInPandas(run, RINGS)


def validity(rings: DataFrame) -> DataFrame:
    """feature, part, ring, crossings, is_valid: whether a ring has three points and never crosses itself."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        r = rows.sort_values("seq")
        n = kernels.crossings(list(zip(r.x, r.y, strict=True)))
        return pd.DataFrame({"feature": [r.feature.iloc[0]], "part": [r.part.iloc[0]], "ring": [r.ring.iloc[0]], "crossings": [n], "is_valid": [n == 0 and len(r) > 2]})

    return rings.groupBy("feature", "part", "ring").applyInPandas(run, "feature string, part int, ring int, crossings int, is_valid boolean")


def repair(rings: DataFrame) -> DataFrame:
    """Rings that cross themselves become simple ones; each is a part of its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shape = []
        for polygon in _shape(rows):
            shape += [[*p, *polygon[1:]] if i == 0 else p for i, p in enumerate(kernels.repaired(polygon[0]))]
        return _rows(rows.feature.iloc[0], shape)

    return rings.select("feature", "part", "ring", "seq", "x", "y").groupBy("feature").applyInPandas(run, RINGS)


#: Vertices of clipped meshes are named by hashes under this; a base's vertices by as much more.
SHIFT = 1 << 61
TRIANGLES = "feature string, tid long, ax double, ay double, bx double, by double, cx double, cy double"


def triangles(rings: DataFrame, around: float | None = None) -> DataFrame:
    """Triangles that fill each feature; with `around`, those that fill a box so much larger, outside the feature's exteriors."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shape = _shape(rows)
        if around is not None:
            x0, x1, y0, y1 = rows.x.min() - around, rows.x.max() + around, rows.y.min() - around, rows.y.max() + around
            shape = [[[(x0, y0), (x1, y0), (x1, y1), (x0, y1)], *(p[0] for p in shape)]]
        found = [t for p in shape for t in kernels.triangulate(p)]
        return pd.DataFrame([(rows.feature.iloc[0], i, *a, *b, *c) for i, (a, b, c) in enumerate(found)], columns=["feature", "tid", "ax", "ay", "bx", "by", "cx", "cy"])

    return rings.select("feature", "part", "ring", "seq", "x", "y").groupBy("feature").applyInPandas(run, TRIANGLES)


def clip_faces(faces: DataFrame, windows: DataFrame, size: float) -> DataFrame:
    """feature, fid, piece, corner, x, y, z: what of each face (fid, ax, ay, az and so on) lies in each window triangle, as fans.

    Faces meet windows by squares of `size`; a pair that shares several squares is clipped in its first.
    """
    ends = lambda k: (F.least(*(F.col(f"{c}{k}") for c in "abc")), F.greatest(*(F.col(f"{c}{k}") for c in "abc")))

    def placed(df: DataFrame) -> DataFrame:
        (x0, x1), (y0, y1) = ends("x"), ends("y")
        return df.withColumns({"x0": F.floor(x0 / size), "y0": F.floor(y0 / size), "x1": F.floor(x1 / size), "y1": F.floor(y1 / size)})

    def binned(df: DataFrame) -> DataFrame:
        return df.withColumn("gx", F.explode(F.sequence("x0", "x1"))).withColumn("gy", F.explode(F.sequence("y0", "y1")))

    f = placed(faces.select("fid", *(f"{c}{k}" for c in "abc" for k in "xyz")))
    # A window may be far larger than the surface; only squares that the surface reaches count.
    reach = f.agg(F.min("x0").alias("fx0"), F.max("x1").alias("fx1"), F.min("y0").alias("fy0"), F.max("y1").alias("fy1"))
    w = placed(windows).crossJoin(F.broadcast(reach))
    w = w.withColumns({"x0": F.greatest("x0", "fx0"), "x1": F.least("x1", "fx1"), "y0": F.greatest("y0", "fy0"), "y1": F.least("y1", "fy1")}).where("x0 <= x1 AND y0 <= y1")
    f, w = binned(f).drop("x1", "y1"), binned(w).drop("x1", "y1")
    w = w.select("feature", "tid", "gx", "gy", F.col("x0").alias("wx0"), F.col("y0").alias("wy0"), *(F.col(f"{c}{k}").alias(f"w{c}{k}") for c in "abc" for k in "xy"))
    met = f.join(w, ["gx", "gy"]).where((F.col("gx") == F.greatest("x0", "wx0")) & (F.col("gy") == F.greatest("y0", "wy0")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                face = [(r.ax, r.ay, r.az), (r.bx, r.by, r.bz), (r.cx, r.cy, r.cz)]
                flip = kernels.signed_area([p[:2] for p in face]) < 0
                got = kernels.clip_convex(face[::-1] if flip else face, ((r.wax, r.way), (r.wbx, r.wby), (r.wcx, r.wcy)))
                for i in range(1, len(got) - 1):
                    fan = (got[0], got[i], got[i + 1])
                    if abs(kernels.signed_area([p[:2] for p in fan])) > 1e-12:
                        out += [(r.feature, r.fid, r.tid * 16 + i, k, *p) for k, p in enumerate(fan[::-1] if flip else fan)]
            yield pd.DataFrame(out, columns=["feature", "fid", "piece", "corner", "x", "y", "z"])

    return met.mapInPandas(run, "feature string, fid long, piece long, corner int, x double, y double, z double")


def clipped_mesh(pieces: DataFrame, digits: int = 6) -> tuple[DataFrame, DataFrame]:
    """(vertices, faces) out of clip_faces(): corners that agree to so many digits are one vertex, named by its place."""
    at = lambda c: F.round(c, digits)
    own = pieces.withColumns({"x": at("x"), "y": at("y"), "z": at("z")}).withColumn("vid", F.pmod(F.xxhash64("x", "y", "z"), F.lit(SHIFT)))
    vertices = own.groupBy("vid").agg(*(F.first(c).alias(c) for c in "xyz"))
    corner = lambda k: F.max(F.when(F.col("corner") == k, F.col("vid")))
    faces = own.groupBy("feature", "fid", "piece").agg(corner(0).alias("a"), corner(1).alias("b"), corner(2).alias("c"))
    return vertices, faces.where("a <> b AND b <> c AND a <> c").select(F.xxhash64("feature", "fid", "piece").alias("fid"), "a", "b", "c")


def piece_areas(pieces: DataFrame) -> DataFrame:
    """feature, pieces, area in the plane and volume over z = 0 of what clip_faces() gave."""
    at = lambda k, c: F.max(F.when(F.col("corner") == k, F.col(c)))
    t = pieces.groupBy("feature", "fid", "piece").agg(*(at(k, c).alias(f"{c}{k}") for k in range(3) for c in "xyz"))
    area = F.abs((F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))) / 2
    t = t.select("feature", area.alias("area"), (area * (F.col("z0") + F.col("z1") + F.col("z2")) / 3).alias("volume"))
    return t.groupBy("feature").agg(F.count("*").alias("pieces"), F.sum("area").alias("area"), F.sum("volume").alias("volume"))


def extruded(rings: DataFrame, height: float) -> DataFrame:
    """feature, kind, ax to cz: the triangles of each feature's upright prism from z = 0."""
    caps = triangles(rings)
    up = caps.select("feature", F.lit("top").alias("kind"), "ax", "ay", F.lit(height).alias("az"), "bx", "by", F.lit(height).alias("bz"), "cx", "cy", F.lit(height).alias("cz"))
    down = caps.select("feature", F.lit("base").alias("kind"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.lit(0.0).alias("az"), "bx", "by", F.lit(0.0).alias("bz"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.lit(0.0).alias("cz"))
    from cairn.functions.geometry import edges

    e = edges(rings)
    turn = e.groupBy("feature", "part", "ring").agg((F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")) > 0).alias("left"))
    e = e.join(turn, ["feature", "part", "ring"])
    ahead = F.col("left") == (F.col("ring") == 0)  # the inside on the left
    p, q = (F.when(ahead, F.struct("x", "y")).otherwise(F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))), F.when(ahead, F.struct(F.col("x2").alias("x"), F.col("y2").alias("y"))).otherwise(F.struct("x", "y")))
    tri = lambda u, uz, v, vz, w, wz: F.struct(u["x"].alias("ax"), u["y"].alias("ay"), F.lit(uz).alias("az"), v["x"].alias("bx"), v["y"].alias("by"), F.lit(vz).alias("bz"), w["x"].alias("cx"), w["y"].alias("cy"), F.lit(wz).alias("cz"))
    walls = e.select("feature", F.lit("wall").alias("kind"), F.explode(F.array(tri(p, 0.0, q, 0.0, q, height), tri(p, 0.0, q, height, p, height))).alias("t")).select("feature", "kind", "t.*")
    return up.unionByName(down).unionByName(walls)


def _mesh_kernel(kernel):
    """kernel(vertices, faces) -> (vertices, faces), for each mesh_id of faces with their corners' coordinates."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        corners = rows[[f"{c}{k}" for c in "abc" for k in "xyz"]].to_numpy(float).reshape(-1, 3)
        places, index = np.unique(corners, axis=0, return_inverse=True)
        v, f = kernel(places, index.reshape(-1, 3))
        out = pd.DataFrame(v[f].reshape(len(f), 9), columns=[f"{c}{k}" for c in "abc" for k in "xyz"])
        out.insert(0, "mesh_id", rows.mesh_id.iloc[0])
        return out

    return run


SOUP = "mesh_id string, " + ", ".join(f"{c}{k} double" for c in "abc" for k in "xyz")


def decimate(soup: DataFrame, p: Params = DEFAULT, target: float | None = None) -> DataFrame:
    """Meshes (mesh_id, ax to cz) with `target` faces at most where that is possible; under 1 it is a share of each mesh's faces.
    A mesh is one group; meshes spread."""
    goal = p.target_faces if target is None else target

    def kernel(v: np.ndarray, f: np.ndarray):
        return kernels.decimate(v, f, int(len(f) * goal) if goal < 1 else int(goal))

    return soup.groupBy("mesh_id").applyInPandas(_mesh_kernel(kernel), SOUP)


def mend(soup: DataFrame) -> DataFrame:
    """Meshes with holes filled and faces turned to agree, outward."""

    def kernel(v: np.ndarray, f: np.ndarray):
        f = kernels.orient(kernels.fill_holes(kernels.orient(f)))
        return v, f[:, ::-1] if kernels.volume(v, f) < 0 else f

    return soup.groupBy("mesh_id").applyInPandas(_mesh_kernel(kernel), SOUP)


def raised(soup: DataFrame, star: DataFrame, base: float, top: float, size: float) -> DataFrame:
    """kind, ax to cz: the closed solid over base of a surface (fid, ax to cz) with one polygon (star rings) lifted to `top`.

    Outside the polygon the surface stays; inside it is cut along the same lines and lifted, so that both
    sides of the rim have the same points in the plane. Walls stand wherever the heights of the two sides
    of an edge differ, and to the base where there is no other side. The polygon must lie on the surface:
    where it reaches beyond, it is cut off, and at the two points where it leaves, a wall from top to base
    meets two walls one over the other, which checks for watertightness don't accept.
    """
    inside = clip_faces(soup, triangles(star), size).withColumn("z", F.lit(float(top)))
    outside = clip_faces(soup, triangles(star, around=1e4), size)
    both = inside.withColumn("up", F.lit(1)).unionByName(outside.withColumn("up", F.lit(0)))
    at = lambda k, c: F.round(F.max(F.when(F.col("corner") == k, F.col(c))), 6)
    t = both.groupBy("up", "feature", "fid", "piece").agg(*(at(k, c).alias(f"{n}{c}") for k, n in enumerate("abc") for c in "xyz"))
    e = t.select(F.explode(F.array(*(F.struct(*(F.col(f"{m}{c}").alias(f"p{c}") for c in "xyz"), *(F.col(f"{n}{c}").alias(f"q{c}") for c in "xyz")) for m, n in ("ab", "bc", "ca")))).alias("e")).select("e.*")
    o = e.select(F.col("qx").alias("px"), F.col("qy").alias("py"), F.col("px").alias("qx"), F.col("py").alias("qy"), F.col("qz").alias("pz2"), F.col("pz").alias("qz2"))
    rim = e.join(o, ["px", "py", "qx", "qy"], "left").withColumns({"pz2": F.coalesce("pz2", F.lit(float(base))), "qz2": F.coalesce("qz2", F.lit(float(base)))})
    rim = rim.where("(pz > pz2 OR qz > qz2)")
    cols = [f"{c}{k}" for c in "abc" for k in "xyz"]
    tri = lambda *p: F.struct(*(F.col(n).alias(c) for c, n in zip(cols, p, strict=True)))
    walls = rim.select(F.lit("wall").alias("kind"), F.explode(F.array(tri("qx", "qy", "qz", "px", "py", "pz", "px", "py", "pz2"), tri("qx", "qy", "qz", "px", "py", "pz2", "qx", "qy", "qz2"))).alias("t")).select("kind", "t.*")
    floor = t.select(F.lit("base").alias("kind"), F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.lit(float(base)).alias("az"), "bx", "by", F.lit(float(base)).alias("bz"), F.col("ax").alias("cx"), F.col("ay").alias("cy"), F.lit(float(base)).alias("cz"))
    return t.select(F.lit("top").alias("kind"), *cols).unionByName(floor).unionByName(walls)
