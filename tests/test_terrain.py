import io
import math
import struct
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.functions import regions, tiles
from cairn.operators import checks, kernels, mesh, overlay, raster, vector
from cairn.operators.graph import components
from cairn.params import DEFAULT
from cairn.plans import fixtures as fx
from cairn.plans import queries, terrain
from cairn.sources import formats


def cells_of(spark, z):
    return spark.createDataFrame([(r, c, None if v is None else float(v)) for r, row in enumerate(z) for c, v in enumerate(row)], "row int, col int, z double")


def test_kernel_weights_and_constant(spark):
    assert len(raster.kernel(4.5)) == 37 and len(raster.kernel(10.0)) == 81 and math.isclose(sum(raster.kernel(4.5)), 1)
    flat = cells_of(spark, [[7] * 5 for _ in range(4)])
    got = raster.blur(flat, 3.0, ["z"]).collect()
    assert len(got) == 20 and all(abs(r.z - 7) < 1e-9 for r in got)


def test_blur_against_numpy(spark):
    rng = np.random.default_rng(1)
    z = rng.random((9, 6))
    w = raster.kernel(1.7)
    r = len(w) // 2
    want = z
    for axis in (0, 1):
        padded = np.pad(want, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
        want = sum(w[k] * np.take(padded, range(k, k + z.shape[axis]), axis) for k in range(len(w)))
    got = np.zeros_like(z)
    for row in raster.blur(cells_of(spark, z), 1.7, ["z"]).collect():
        got[row.row, row.col] = row.z
    assert np.allclose(got, want)


def test_peaks_stay(spark):
    z = [[0.0] * 9 for _ in range(9)]
    z[4][4] = 1000.0
    got = raster.masked_blur(cells_of(spark, z), 1.5).select("row", "col", raster.blend(F.col("z"), F.col("blurred")).alias("z")).where("row = 4 AND col = 4").first()
    assert got.z > 800


def test_components_and_holes(spark):
    ring = [(r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)]
    mask = spark.createDataFrame([*ring, (6, 6), (6, 7), (8, 0)], "row int, col int")
    sizes = {r.component: r["count"] for r in raster.label(mask, 10).groupBy("component").count().collect()}
    assert sizes == {0: 16, 66: 2, 80: 1}
    filled = {(r.row, r.col) for r in raster.fill_holes(mask, 10, 10).collect()}
    assert filled == {(r, c) for r in range(5) for c in range(5)} | {(6, 6), (6, 7), (8, 0)}


def test_graph_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 102), (200, 200), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(path, "a int, b int")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200}


def test_mesh_counts(spark):
    flat = cells_of(spark, [[1] * 3] * 3)
    faces = mesh.surface_faces(flat, 3)
    assert faces.count() == 8 and mesh.boundary_edges(faces).count() == 8
    solid = mesh.solid_faces(faces, 9)
    assert solid.count() == 32
    sound = mesh.soundness(solid.select("a", "b", "c")).first()
    assert sound.is_volume and sound.n_edges == 48 and 18 - 48 + 32 == 2
    hole = cells_of(spark, [[None, 1, 1], [1, 1, 1], [1, 1, 1]])
    assert mesh.surface_faces(hole, 3).count() == 6
    assert mesh.surface_faces(cells_of(spark, [[1, 1, 1]]), 3).count() == 0


def test_mirror_keeps_winding(spark):
    flat = cells_of(spark, [[0, 5], [9, 2]])
    solid = mesh.solid_faces(mesh.surface_faces(flat, 2), 4).withColumn("fid", F.monotonically_increasing_id())
    v = mesh.solid_vertices(mesh.surface_vertices(flat, 2), 4)

    def volume(faces, vertices):
        f = np.array([[r.a, r.b, r.c] for r in faces.collect()])
        p = {r.vid: (r.x, r.y, r.z) for r in vertices.collect()}
        ids = sorted(p)
        return kernels.volume(np.array([p[i] for i in ids]), np.searchsorted(ids, f))

    assert volume(solid, v) * volume(mesh.turned(solid), mesh.scale_mirror(v)) > 0


def test_star_area():
    n, r, q = 8, 4.0, 0.45
    ring = [((r if i % 2 == 0 else r * q) * math.cos(2 * math.pi * i / n), (r if i % 2 == 0 else r * q) * math.sin(2 * math.pi * i / n)) for i in range(n)]
    assert math.isclose(kernels.signed_area(ring), 0.5 * n * r * r * q * math.sin(2 * math.pi / n), rel_tol=1e-12) and abs(kernels.signed_area(ring) - 20.364675) < 1e-6


def test_triangulation_fills_with_holes():
    poly = [[(0, 0), (10, 0), (10, 10), (0, 10)], [(2, 2), (4, 2), (4, 4), (2, 4)], [(6, 5), (8, 5), (7, 8)]]
    got = kernels.triangulate(poly)
    assert math.isclose(sum(kernels.signed_area(list(t)) for t in got), 100 - 4 - 3)
    assert all(kernels.signed_area(list(t)) > 0 for t in got)


def test_boolean_areas():
    sq = lambda x, y, s: [[[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]]
    a, b = sq(0, 0, 10), sq(5, 5, 10)
    assert math.isclose(kernels.shape_area(kernels.boolean(a, b, "union")), 175)
    assert math.isclose(kernels.shape_area(kernels.boolean(a, b, "intersection")), 25)
    assert math.isclose(kernels.shape_area(kernels.boolean(a, b, "difference")), 75)
    inner = kernels.boolean(a, sq(2, 2, 3), "difference")
    assert math.isclose(kernels.shape_area(inner), 91) and len(inner[0]) == 2
    beside = kernels.boolean(a, sq(10, 0, 10), "union")
    assert math.isclose(kernels.shape_area(beside), 200) and len(beside) == 1
    assert math.isclose(kernels.shape_area(kernels.boolean(a, sq(50, 50, 1), "union")), 101)


def test_simplify_and_validity(spark):
    ring = [(float(i), 0.001 * (i % 2)) for i in range(10)] + [(9.0, 5.0), (0.0, 5.0)]
    assert len(kernels.simplify(ring, 0.02)) == 4 and kernels.simplify(ring[:3], 0.5) == ring[:3]
    rows = [("bow", 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (9.0, 9.0), (9.0, 0.0), (0.0, 9.0)])]
    assert [r.is_valid for r in overlay.validity(fx.rings(spark, rows)).collect()] == [False]


def test_decimation_keeps_a_volume(spark):
    v, f = [], []
    n = 12
    for r in range(n):
        for c in range(n):
            v.append((c, r, 5 + math.sin(r / 3)))
    v += [(x, y, 0) for x, y, _ in v]
    for r in range(n - 1):
        for c in range(n - 1):
            i = r * n + c
            f += [(i, i + 1, i + n), (i + 1, i + n + 1, i + n)]
    rim = [(c, c + 1) for c in range(n - 1)] + [((r + 1) * n - 1, (r + 2) * n - 1) for r in range(n - 1)] + [(n * n - 1 - c, n * n - 2 - c) for c in range(n - 1)] + [((n - 1 - r) * n, (n - 2 - r) * n) for r in range(n - 1)]
    f += [(c + n * n, b + n * n, a + n * n) for a, b, c in f]
    for a, b in rim:
        f += [(b, a, a + n * n), (b, a + n * n, b + n * n)]
    v, f = np.array(v, float), np.array(f)
    before = kernels.volume(v, f)
    sv, sf = kernels.decimate(v, f, 150)
    assert len(sf) <= 150 and abs(kernels.volume(sv, sf) - before) < 0.05 * abs(before)
    broken = np.delete(sf, 3, 0)
    broken[::2] = broken[::2, ::-1]
    mended = kernels.orient(kernels.fill_holes(kernels.orient(broken)))
    edges = {}
    for t in mended.tolist():
        for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])):
            edges[a, b] = edges.get((a, b), 0) + 1
    assert all(n == 1 and (b, a) in edges for (a, b), n in edges.items())


def test_raised_star_is_closed(spark):
    flat = cells_of(spark, [[r + c for c in range(14)] for r in range(14)])
    surface = mesh.with_corners(mesh.surface_faces(flat, 14), mesh.surface_vertices(flat, 14, p=DEFAULT.with_(mm_per_pixel=1.0)))
    star = spark.range(1).select(F.explode(g.star(F.lit(6.37), F.lit(6.81), 4.0, 0.45, 4)).alias("v")).select(F.lit("s").alias("feature"), F.lit(0).alias("part"), F.lit(0).alias("ring"), "v.*")
    solid = overlay.raised(surface, star, 0.0, 9.0, 4.0)
    corner = lambda c: F.xxhash64(*(F.round(f"{c}{k}", 5) for k in "xyz")).alias(c)
    sound = mesh.soundness(solid.select(corner("a"), corner("b"), corner("c")).where("a <> b AND b <> c AND a <> c")).first()
    assert sound.is_watertight
    six = (F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")) + F.col("ay") * (F.col("bz") * F.col("cx") - F.col("bx") * F.col("cz")) + F.col("az") * (F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"))) / 6
    assert abs(solid.agg(F.sum(six)).first()[0]) > 13 * 13 * 2 + 20 * 6


def test_country_end_to_end(spark, tmp_path):
    side = 48
    cells = cells_of(spark, [[100 + 3 * r + 2 * c for c in range(side)] for r in range(side)])
    rings = fx.rings(spark, [("Land A", 0, 0, i, x, y) for i, (x, y) in enumerate([(4.3, 4.3), (44.3, 6.3), (40.3, 42.3), (6.3, 40.3)])])
    p = DEFAULT.with_(min_component_pixels=50, mask_sigma=2.0, dem_sigma=1.5, step=2, target_faces=400)
    for up in (False, True):
        solid = terrain.country_solid("Land A", cells, rings, side, side, p, star_at=(5.93, 5.71), raise_star=up)
        assert solid.ok
        sound = mesh.soundness(solid.faces.select("a", "b", "c")).first()
        assert sound.is_watertight, up
    terrain.export([solid], str(tmp_path), p, "starup")
    back = formats.stl(spark, str(tmp_path))
    assert {r.mesh_id for r in back.select("mesh_id").distinct().collect()} == {"Land_A_starup"} and back.count() > 50
    missing = terrain.country_solid("Land A", cells.where("row < 30"), rings, side, side, p)
    assert not missing.ok and "no data" in missing.message


def test_formats(spark, tmp_path):
    corners = np.arange(18, dtype=float).reshape(2, 3, 3)
    assert np.allclose(formats.stl_corners(formats.stl_bytes(corners)), corners)
    text = b"solid x\n facet normal 0 0 0\n outer loop\n vertex 0 0 0\n vertex 1 0 0\n vertex 0 1 0\n endloop\n endfacet\nendsolid"
    assert formats.stl_corners(text).shape == (1, 3, 3)
    with pytest.raises(ValueError):
        formats.stl_corners(b"nothing")
    picture = formats.png(np.arange(12, dtype=np.uint8).reshape(3, 4))
    assert picture[:8] == b"\x89PNG\r\n\x1a\n" and zlib.decompress(picture[41 : 41 + struct.unpack(">I", picture[33:37])[0]])[1:5] == bytes([0, 1, 2, 3])
    (tmp_path / "N01E002.hgt").write_bytes(np.array([[5, -32768], [7, 8]], ">i2").tobytes())
    got = {(r.row, r.col): r.z for r in formats.hgt(spark, str(tmp_path)).collect()}
    assert got == {(0, 0): 5.0, (0, 1): None, (1, 0): 7.0, (1, 1): 8.0}
    (tmp_path / "list.txt").write_text(" a \n\n b\n")
    assert [r.value for r in formats.tile_list(spark, str(tmp_path / "list.txt")).collect()] == ["a", "b"]
    (tmp_path / "caps.json").write_text('{"A": {"city": "x", "lon": 1, "lat": 2}}')
    assert formats.capitals(spark, str(tmp_path / "caps.json")).collect() == [("A", "x", 1.0, 2.0)]
    cells = cells_of(spark, [[1, 2], [3, 4]])
    formats.write_cells(cells, str(tmp_path / "cells"), 1)
    assert formats.read_cells(spark, str(tmp_path / "cells"), (1, 1, 0, 0), 1).collect() == [(1, 0, 3.0)]
    packed = formats.pack_png(raster.to_byte(cells), "p", cells.where("row = 0").select("row", "col"))
    assert packed.first().name == "p.png" and bytes(packed.first().content)[:4] == b"\x89PNG"
    assert spark.range(1).select(formats.output_folder("out", F.lit("2026-01-02 03:04:05").cast("timestamp"))).first()[0] == "out_20260102_030405_nogit"


def test_shapefile(spark, tmp_path):
    rings = [[(0, 0), (0, 4), (4, 4), (4, 0), (0, 0)], [(1, 1), (2, 1), (2, 2), (1, 2), (1, 1)]]
    body = struct.pack("<i4d2i", 5, 0, 0, 4, 4, 2, 10) + struct.pack("<2i", 0, 5) + b"".join(struct.pack("<2d", *p) for r in rings for p in r)
    (tmp_path / "c.shp").write_bytes(bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body)
    field = b"ADMIN".ljust(11, b"\0") + b"C" + bytes(4) + bytes([6, 0]) + bytes(14)
    head = struct.pack("<4BIHH", 3, 26, 1, 1, 1, 32 + 32 + 1, 7) + bytes(20)
    (tmp_path / "c.dbf").write_bytes(head + field + b"\r" + b" " + b"Land  ")
    got = formats.shapefile(spark, str(tmp_path)).orderBy("part", "ring", "seq").collect()
    assert {(r.feature, r.part, r.ring) for r in got} == {("Land", 0, 0), ("Land", 0, 1)} and len(got) == 8


def test_regions_and_tiles(spark):
    got = {r.country: r for r in regions.capitals(spark, "africa", "middle_east").collect()}
    assert got["Egypt"].priority == 1 and got["Kenya"].city == "Nairobi"
    lat_lon = tiles.parsed(spark.createDataFrame([(x,) for x in fx.ODD_TILES], "value string")).collect()
    assert len(lat_lon) == 6 and sum(r.lat is not None for r in lat_lon) == 4


def test_region_rings(spark):
    square = lambda f, part, x, y, s: [(f, part, 0, i, float(a), float(b)) for i, (a, b) in enumerate([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])]
    rings = fx.rings(spark, [*square("1", 0, 45, 40, 3), *square("1", 1, 40, 40, 1), *square("1", 2, 51, 40, 0.5), *square("1", 3, 48.5, 38, 0.2), *square("2", 0, 10, 10, 5)])
    features = spark.createDataFrame([("1", "Azerbaijan", "Asia"), ("2", "Elsewhere", "Asia")], "feature string, name string, continent string")
    got = terrain.region_rings(features, rings, "caucasus_central_asia")
    assert got.agg(F.max(F.abs("x"))).first()[0] < 5e6  # the region's own meridian is 95 degrees east
    with pytest.raises(KeyError):
        terrain.region_rings(features, rings, "atlantis")
    for region in regions.COUNTRIES:
        assert terrain.PROJECTED_AS.get(region, region) in tiles.CONICS
    assert {(r.feature, r.part) for r in got.collect()} == {("Azerbaijan", 0), ("Azerbaijan", 1), ("Azerbaijan", 2)}
    america = terrain.region_rings(spark.createDataFrame([("9", "France", "Europe")], features.schema), fx.rings(spark, square("9", 0, -60, 0, 70)), "south_america")
    assert {r.feature for r in america.collect()} == {"French Guiana"}


def test_vector_rules(spark):
    rings = fx.rings(spark)
    pairs = {(r.left, r.right) for r in vector.box_pairs(rings, fx.rings(spark, fx.LAKES)).collect()}
    assert pairs == {("ALPHA", "LAKE_1"), ("ALPHA", "LAKE_2"), ("BETA", "LAKE_2")}
    left = overlay.combine(rings, fx.rings(spark, fx.LAKES), spark.createDataFrame(list(pairs), "left string, right string"), "difference")
    areas = {r.feature: r.area for r in g.measures(left).collect()}
    shared = 46 - (1634 - 92 - areas["ALPHA"])
    assert math.isclose(areas["BETA"], 252 - shared, abs_tol=1e-6)


def test_checks(spark):
    stairs = checks.stair_steps(g.edges(fx.rings(spark, fx.STAIRS))).first()
    assert stairs.is_aliased
    circle = [("C", 0, 0, i, math.cos(2 * math.pi * i / 64) * 9, math.sin(2 * math.pi * i / 64) * 9) for i in range(64)]
    assert not checks.stair_steps(g.edges(fx.rings(spark, circle))).first().is_aliased
    assert checks.axis_aligned(g.edges(fx.rings(spark, circle))).first().is_smooth


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_decimate_mesh_takes_the_whole_grid(spark, monkeypatch, sf):
    sf_dir, seen = f"/root/testdata/{sf}", []
    run = overlay.decimate
    monkeypatch.setattr(queries.overlay, "decimate", lambda soup, *a, **k: seen.extend([soup, run(soup, *a, **k)]) or seen[1])
    got = queries.decimate_mesh(spark, sf_dir).first()
    assert got.reached and got.is_volume
    n, low, high = duckdb.sql(f"SELECT count(*), min(z), max(z) FROM ({fx.GRID.replace('lineitem', repr(sf_dir + '/lineitem.parquet'))})").fetchall()[0]
    if n < fx.SIDE**2:
        low, high = min(low, 0), max(high, 0)
    ends = [f(F.least(*(f"{c}{k}" for c in "abc")) if f is F.min else F.greatest(*(f"{c}{k}" for c in "abc"))) for f in (F.min, F.max) for k in "xyz"]
    before, after = (df.agg(F.count("*"), *ends).first() for df in seen)
    side = (fx.SIDE - 1) * DEFAULT.mm_per_pixel
    assert before[0] == 4 * (fx.SIDE - 1) ** 2 + 8 * (fx.SIDE - 1) == 16380
    assert low < 0 and np.allclose(before[1:], [0, 0, 0, side, side, 2 + 0.002 * high])
    assert 0 < after[0] <= 200 and np.allclose(after[1:6], before[1:6]) and 2 + 0.002 * low <= after[6] <= before[6]


def test_alignment_searches_thirty_cells_each_way(spark, sf_dir, monkeypatch):
    cells = lambda rows: spark.createDataFrame(rows, "feature string, row int, col int")
    block = [(r, c) for r in range(31, 35) for c in range(31, 36)]
    moves = {"far": (17, -30), "near": (-1, 2), "beyond": (31, 31)}
    boundary = [(f, r, c) for f in (*moves, "none") for r, c in block]
    footprint = [(f, r + dy, c + dx) for f, (dx, dy) in moves.items() for r, c in block if f != "beyond"] + [("beyond", 200, 200)]
    monkeypatch.setattr(queries, "_cells", lambda _: cells(boundary))
    monkeypatch.setattr(queries, "_footprint", lambda _: cells(footprint))
    got = {r.feature: (r.dx, r.dy, r.covered) for r in queries.alignment_grid_search(spark, sf_dir).collect()}
    assert got == {"far": (17, -30, 20), "near": (-1, 2, 20), "beyond": (0, 0, 0), "none": (0, 0, 0)}


def test_smoothing_with_production_kernels(spark):
    """Radius 40 and 18 over 64 x 64 cells, where one cell is mirrored at both rims; only small components differ from DEFAULT."""
    n, p = fx.SIDE, DEFAULT.with_(min_component_pixels=50)
    grid = fx.grid(spark, "/root/testdata/sf0.01").select("row", "col", F.when(F.col("n") % 5 < 3, F.col("z")).otherwise(0).cast("double").alias("z"))

    def blur(z, sigma):
        w = raster.kernel(sigma)
        r = len(w) // 2
        for axis in (0, 1):
            padded = np.pad(z, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            z = sum(w[k] * np.take(padded, range(k, k + n), axis) for k in range(len(w)))
        return z

    z, mask = np.zeros((n, n)), np.zeros((n, n))
    for r in grid.collect():
        z[r.row, r.col] = r.z
    for r in raster.fill_holes(raster.large_components(raster.label(grid.where("z <> 0"), n), 50), n, n).collect():
        mask[r.row, r.col] = 1
    inside = blur(mask, 10.0) > 0.3
    raw = np.where(z <= 0, -50.0, z)
    near = blur(np.where(inside, raw, 0), 4.5) / np.maximum(blur(inside.astype(float), 4.5), 1e-300)
    want = np.where(raw - near > 50, 0.8 * raw + 0.2 * near, 0.6 * near + 0.4 * raw)
    got = np.full((n, n), np.nan)
    for r in raster.smooth(grid, n, n, p).where("z IS NOT NULL").collect():
        got[r.row, r.col] = r.z
    assert len(raster.kernel(p.mask_sigma)) == 81 and len(raster.kernel(p.dem_sigma)) == 37 and inside.sum() > 2000
    assert (np.isnan(got) == ~inside).all() and np.allclose(got[inside], want[inside], atol=1e-6)


def test_tiles_agree_with_one_tile(spark):
    """Small tiles, whose halos and rims do all the work, against numpy."""
    from cairn.operators import tiling

    rng = np.random.default_rng(2)
    z = rng.random((23, 17)) * 100
    z[rng.random(z.shape) < 0.4] = np.nan
    w = np.array(raster.kernel(1.2))
    r = len(w) // 2

    def blur(x):
        for axis in (0, 1):
            padded = np.pad(x, [(r, r) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            x = sum(w[k] * np.take(padded, range(k, k + z.shape[axis]), axis) for k in range(len(w)))
        return x

    want = blur(np.nan_to_num(z)) / blur((~np.isnan(z)).astype(float))
    cells = cells_of(spark, [[None if np.isnan(v) else v for v in row] for row in z])
    size, tiling.TILE = tiling.TILE, 6
    try:
        own = tiling.sized(cells, (), None)
        work = lambda tile, table: dict(zip(("row", "col", "v"), (*tile.places(there := np.ones([b - a for a, b in zip(tile.low, tile.high)], bool)), tile.blurred(tile.field(np.nan_to_num(table.column("z").to_numpy().astype(float))), w)[there])))
        got = np.zeros(z.shape)
        for row in tiling.over_tiles(own, r, (), "row int, col int, v double", work, 6).collect():
            got[row.row, row.col] += row.v
        assert np.allclose(got, blur(np.nan_to_num(z)))
    finally:
        tiling.TILE = size
    for row in raster.masked_blur(cells, 1.2).collect():
        assert math.isclose(row.blurred, want[row.row, row.col], rel_tol=1e-9)
    mask = cells.where("z IS NOT NULL")
    names = [{(x.row, x.col): x.component for x in tiling.label(mask, 17, size=n).collect()} for n in (4, 256)]
    assert names[0] == names[1] and len(set(names[0].values())) > 5


def test_geotiff(spark, tmp_path):
    from cairn.sources import geotiff

    def lzw(data):
        """Codes of nine bits alone: the table is cleared before it grows out of them."""
        codes = []
        for i in range(0, len(data), 200):
            codes += [256, *data[i : i + 200]]
        bits = "".join(f"{c:09b}" for c in [*codes, 257])
        bits += "0" * (-len(bits) % 8)
        return int(bits, 2).to_bytes(len(bits) // 8, "big")

    def tiff(blocks, tags):
        """Little-endian TIFF of one directory; tags: number -> (type, values)."""
        sizes = {2: 1, 3: 2, 4: 4, 12: 8}
        tags = dict(tags)
        entries, extra, at = [], b"", 8 + 2 + 12 * (len(tags) + 2) + 4
        starts, body = [], b""
        where = at + sum(n for n in (len(v) * sizes[t] for t, v in tags.values()) if n > 4) + (8 * len(blocks) if len(blocks) > 1 else 0)
        for b in blocks:
            starts.append(where + len(body))
            body += b
        tiled = 322 in tags
        tags[324 if tiled else 273], tags[325 if tiled else 279] = (4, starts), (4, [len(b) for b in blocks])
        for tag, (kind, values) in sorted(tags.items()):
            raw = bytes(values) if kind == 2 else b"".join(struct.pack("<" + {3: "H", 4: "I", 12: "d"}[kind], v) for v in values)
            if len(raw) > 4:
                entries.append(struct.pack("<HHII", tag, kind, len(values), at + len(extra)))
                extra += raw
            else:
                entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        return b"II*\0" + struct.pack("<I", 8) + struct.pack("<H", len(entries)) + b"".join(entries) + bytes(4) + extra + body

    z = (np.arange(20 * 18).reshape(20, 18) * 7 % 501 - 100).astype("<i2")
    place = {33550: (12, [0.5, 0.25, 0]), 33922: (12, [0, 0, 0, 10, 50, 0]), 42113: (2, b"-93\0")}
    base = {256: (3, [18]), 257: (3, [20]), 258: (3, [16]), 277: (3, [1]), 339: (3, [2]), **place}
    strips = [z[i : i + 8].tobytes() for i in range(0, 20, 8)]
    steps = np.diff(z, axis=1, prepend=np.zeros((20, 1), "<i2")).astype("<i2")
    tiles_ = []
    for r in (0, 16):
        for c in (0, 16):
            block = np.zeros((16, 16), "<i2")
            part = z[r : r + 16, c : c + 16]
            block[: part.shape[0], : part.shape[1]] = part
            tiles_.append(zlib.compress(block.tobytes()))
    files = {
        "plain": tiff(strips, base | {259: (3, [1]), 278: (3, [8])}), "lzw": tiff([lzw(s) for s in strips], base | {259: (3, [5]), 278: (3, [8])}),
        "steps": tiff([zlib.compress(steps.tobytes())], base | {259: (3, [8]), 278: (3, [20]), 317: (3, [2])}), "tiles": tiff(tiles_, base | {259: (3, [8]), 322: (3, [16]), 323: (3, [16])}),
    }
    for name, data in files.items():
        (tmp_path / f"{name}.tif").write_bytes(data)
    (tmp_path / "broken.tif").write_bytes(b"II*\0junk")
    got = geotiff.read(spark, str(tmp_path)).collect()
    for name in files:
        own = {(r.row, r.col): r for r in got if r.path.endswith(f"/{name}.tif")}
        assert len(own) == 360, name
        assert all(own[r, c].z == (None if z[r, c] == -93 else z[r, c]) for r in range(20) for c in range(18)), name
        assert (own[0, 0].a, own[0, 0].c, own[0, 0].e, own[0, 0].f) == (0.5, 10.0, -0.25, 50.0)
    assert [r.path.rsplit("/", 1)[1] for r in geotiff.problems(spark, str(tmp_path)).collect()] == ["broken.tif"]
    text = bytes(np.random.default_rng(3).integers(0, 4, 9000).astype(np.uint8))
    assert geotiff.unpack_lzw(packed_lzw(text)) == text


def packed_lzw(data):
    """TIFF's LZW with widths that grow, one code early, and a cleared table when it is full."""
    bits, table, width, word = [f"{256:09b}"], {bytes([i]): i for i in range(256)}, 9, b""
    size = 258
    for byte in data:
        if word + bytes([byte]) in table:
            word += bytes([byte])
            continue
        bits.append(f"{table[word]:0{width}b}")
        table[word + bytes([byte])] = size
        size += 1
        word = bytes([byte])
        if size + 1 > 1 << width and width < 12:
            width += 1
        if size >= 4094:
            bits.append(f"{table[word]:0{width}b}")
            bits.append(f"{256:0{width}b}")
            table, width, word, size = {bytes([i]): i for i in range(256)}, 9, b"", 258
    if word:
        bits.append(f"{table[word]:0{width}b}")
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    bits.append(f"{257:0{width}b}")
    whole = "".join(bits)
    whole += "0" * (-len(whole) % 8)
    return int(whole, 2).to_bytes(len(whole) // 8, "big")


def test_outline_of_a_mesh(spark):
    from cairn.operators import outline

    hole = cells_of(spark, [[None if (r, c) in ((2, 2), (2, 3), (3, 2), (3, 3)) else 100.0 for c in range(7)] for r in range(7)])
    faces = mesh.surface_faces(hole, 7)
    solid = mesh.solid_faces(faces, 49).withColumn("fid", F.monotonically_increasing_id())
    vertices = mesh.solid_vertices(mesh.surface_vertices(hole, 7, p=DEFAULT.with_(mm_per_pixel=1.0)), 49)
    rings = outline.rings(mesh.section(solid, vertices, 0.05).withColumn("feature", F.lit("m")))
    areas = sorted(r.area for r in g.ring_measures(rings).collect())
    assert np.allclose(areas, [9, 36])
    assert outline.kept(rings, 10.0).select("part").distinct().count() == 1
    around = outline.turned_round(rings)
    assert around.agg(F.min("x"), F.min("y"), F.max("x")).first() == (0.0, 0.0, 6.0)
    assert outline.footprint(around, 0.5).count() == 144  # the hole counts as covered
    stairs = checks.stair_steps(g.edges(rings)).first()
    assert stairs.total_boundary_edges == 24 + 12 and not stairs.is_aliased  # two pieces a side, one of them too short to count


def test_raster_rules_by_raster(spark):
    one = cells_of(spark, [[1, 2], [3, 5]]).withColumn("r", F.lit("a")).unionByName(cells_of(spark, [[10, 30], [20, 50]]).withColumn("r", F.lit("b")))
    assert {(x.r, x.row, x.col): x.byte for x in raster.to_byte(one, ("r",)).collect()} == {("a", 0, 0): 0, ("a", 0, 1): 63, ("a", 1, 0): 127, ("a", 1, 1): 255, ("b", 0, 0): 0, ("b", 0, 1): 127, ("b", 1, 0): 63, ("b", 1, 1): 255}
    top = raster.mosaic([one, one.where("r = 'b'").withColumn("z", F.col("z") + 1)], ("r",))
    assert {(x.r, x.z) for x in top.where("row = 0 AND col = 0").collect()} == {("a", 1.0), ("b", 11.0)}
    ring = [("x", r, c) for r in range(5) for c in range(5) if r in (0, 4) or c in (0, 4)] + [("y", 2, 2)]
    mask = spark.createDataFrame(ring, "r string, row int, col int")
    assert {k["r"]: k["count"] for k in raster.fill_holes(mask, 6, 6, ("r",)).groupBy("r").count().collect()} == {"x": 25, "y": 1}
    both = cells_of(spark, [[50 + r + c for c in range(12)] for r in range(12)])
    p = DEFAULT.with_(min_component_pixels=5, mask_sigma=1.0, dem_sigma=1.0)
    alone = {(x.row, x.col): x.z for x in raster.smooth(both, 12, 12, p).collect()}
    pair = both.withColumn("r", F.lit(1)).unionByName(both.withColumn("r", F.lit(2)).withColumn("z", F.col("z") * 2))
    got = raster.smooth(pair, 12, 12, p, by=("r",)).collect()
    assert len(got) == 288 and all(abs(x.z - alone[x.row, x.col] * x.r) < 1e-6 for x in got)
