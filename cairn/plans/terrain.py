"""From rasters and borders to printable solids: the library's operators in their order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import geometry, regions, tiles
from cairn.functions.storage import written
from cairn.operators import mesh, overlay, raster, vector
from cairn.params import DEFAULT, Params
from cairn.sources import formats


#: Regions that share another one's projection.
PROJECTED_AS = {"caucasus_central_asia": "asia_2km", "central_america": "north_central_america"}


def region_rings(features: DataFrame, rings: DataFrame, region: str, p: Params = DEFAULT, only: list[str] | None = None) -> DataFrame:
    """Rings, in metres of the region's projection, of its countries: chosen, parts kept by rule, simplified, projected.

    features: feature, name, continent; rings in degrees. only: some of the countries.
    """
    wanted = regions.COUNTRIES[region]
    chosen = features.where(F.col("continent") == regions.CONTINENT[region]) if wanted is None else features.where(F.col("name").isin(wanted))
    own = rings.join(chosen.select("feature", "name"), "feature").select(F.col("name").alias("feature"), "part", "ring", "seq", "x", "y")
    for name, (whole, box) in regions.CUT_OUT.items() if region == "south_america" else ():
        source = rings.join(features.where(F.col("name") == whole).select("feature"), "feature")
        own = own.unionByName(overlay.intersect_box(source, box).withColumn("feature", F.lit(name)))
    if only is not None:
        own = own.where(F.col("feature").isin(only))
    kept = vector.keep_parts(own, regions.rules(own.sparkSession), regions.TOP_PARTS[region])
    few = overlay.simplify(kept, p.simplify_degrees)
    x, y = geometry.albers(F.col("x"), F.col("y"), *tiles.CONICS[PROJECTED_AS.get(region, region)][:4])
    return few.select("feature", "part", "ring", "seq", x.alias("x"), y.alias("y"))


@dataclass
class Solid:
    """A country's closed solid, or why there is none."""

    name: str
    ok: bool
    message: str
    vertices: DataFrame | None = None
    faces: DataFrame | None = None


def country_solid(name: str, cells: DataFrame, rings: DataFrame, n_rows: int, n_cols: int, p: Params = DEFAULT, star_at: tuple[float, float] | None = None, raise_star: bool = False, cut_lakes: bool = False, local_base: bool = False) -> Solid:
    """One country over a full grid of cells (row, col, z); rings in fractional pixels. Stages are written, so none runs twice.

    Order: coverage gate, clip, smooth, surface, cut by the border, lakes, star (cut out or raised), scale and mirror.
    star_at: in mm before scaling. A country that fails has ok false and a message; others aren't touched by that.
    """
    seen = raster.coverage(cells, rings, p).first()
    if seen is None or not seen.is_valid:
        return Solid(name, False, "no cells inside the border" if seen is None else f"{seen.missing_pct:.1f} % of the country has no data")
    blank = raster.grid(n_rows, n_cols, cells.sparkSession)
    clipped = blank.join(raster.clip(cells, rings).select("row", "col", F.col("z").cast("double").alias("z")), ["row", "col"], "left").select("row", "col", F.coalesce("z", F.lit(0.0)).alias("z"))
    land = written(raster.decimate(raster.smooth(written(clipped), n_rows, n_cols, p), p.step))
    width = -(-n_cols // p.step)
    surface = mesh.with_corners(mesh.surface_faces(land, width), mesh.surface_vertices(land, width, p.step, p))
    border = geometry.moved(rings, sx=p.mm_per_pixel, sy=p.mm_per_pixel).select("feature", "part", "ring", "seq", "x", "y")
    inner = border
    if not cut_lakes:  # the border's holes are lakes; they stay filled unless they are to be cut
        inner = geometry.exteriors(border)
    size = 16 * p.mm_per_pixel * p.step
    pieces = written(overlay.clip_faces(surface, overlay.triangles(inner), size))
    if pieces.isEmpty():
        return Solid(name, False, "nothing is left inside the border")
    corner = lambda k, c: F.max(F.when(F.col("corner") == k, F.col(c))).alias(f"{'abc'[k]}{c}")
    soup = pieces.groupBy("feature", "fid", "piece").agg(*(corner(k, c) for k in range(3) for c in "xyz")).withColumn("fid", F.xxhash64("feature", "fid", "piece")).drop("feature", "piece")
    if star_at is not None:
        points = cells.sparkSession.range(1).select(F.lit("star").alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(geometry.star(F.lit(star_at[0]), F.lit(star_at[1]), p.star_radius_mm, p.star_inner, p.star_points)).alias("v")).select("feature", "part", "ring", "v.*")
        if raise_star:
            spots = pieces.select(F.monotonically_increasing_id().alias("vid"), "x", "y", "z")
            centre = cells.sparkSession.createDataFrame([("star", *map(float, star_at), local_base)], "name string, cx double, cy double, local_base boolean")
            reach = mesh.star_heights(spots, centre, p).first()
            if reach is not None:
                return _finished(name, overlay.raised(soup, points, 0.0, reach.top_z, size), p)
        else:
            pieces = overlay.clip_faces(soup, overlay.triangles(points, around=1e4), size)
    vertices, faces = overlay.clipped_mesh(pieces)
    vertices, faces = mesh.solid_vertices(vertices, overlay.SHIFT), mesh.solid_faces(faces, overlay.SHIFT)
    return Solid(name, True, "ok", mesh.scale_mirror(vertices, p), mesh.turned(faces.withColumn("fid", F.xxhash64("a", "b", "c"))))


def _finished(name: str, soup: DataFrame, p: Params) -> Solid:
    """Vertices and faces of a closed soup of triangles, scaled and mirrored."""
    at = lambda c: F.pmod(F.xxhash64(*(F.round(f"{c}{k}", 6) for k in "xyz")), F.lit(overlay.SHIFT))
    rows = written(soup.select("kind", *(F.col(f"{c}{k}") for c in "abc" for k in "xyz"), *(at(c).alias(c) for c in "abc")))
    spots = None
    for c in "abc":
        own = rows.select(F.col(c).alias("vid"), *(F.col(f"{c}{k}").alias(k) for k in "xyz"))
        spots = own if spots is None else spots.unionByName(own)
    vertices = spots.groupBy("vid").agg(*(F.first(k).alias(k) for k in "xyz"))
    faces = rows.where("a <> b AND b <> c AND a <> c").select("kind", F.xxhash64("a", "b", "c").alias("fid"), "a", "b", "c")
    return Solid(name, True, "ok", mesh.scale_mirror(vertices, p), mesh.turned(faces))


def soup_of(solid: Solid) -> DataFrame:
    """mesh_id, ax to cz of a solid, as decimation and STL files take it."""
    return mesh.with_corners(solid.faces, solid.vertices).select(F.lit(solid.name).alias("mesh_id"), *(f"{c}{k}" for c in "abc" for k in "xyz"))


def export(solids: list[Solid], folder: str, p: Params = DEFAULT, suffix: str = "solid") -> None:
    """Decimates and writes the solids that there are as STL files in a shared folder."""
    for solid in solids:
        if solid.ok:
            formats.write_files(formats.pack_stl(overlay.decimate(soup_of(solid), p), suffix), folder)
