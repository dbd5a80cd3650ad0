"""More registered queries: lines, outlines of meshes, islands, lakes, several rasters at once, and round trips through files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.functions.storage import shared_folder
from cairn.operators import checks, mesh, outline, raster, vector
from cairn.params import DEFAULT
from cairn.plans import fixtures as fx
from cairn.plans import queries as q
from cairn.plans.queries import GRIDDED, MEASURES, NEAREST, QUADS, RECURSIVE, RIM, SHAPED, VERTICES, N, query, r6
from cairn.sources import formats

AF = {k: f"({v})" for k, v in fx.AFFINE.items()}
DET = f"({AF['a']} * {AF['e']} - {AF['b']} * {AF['d']})"


# ---- several rasters in one plan

PAIR = GRIDDED + ", land AS (SELECT row, col, CASE WHEN n % 5 < 3 THEN z::DOUBLE END AS z FROM grid), other AS (SELECT col AS row, row AS col, CASE WHEN n % 3 < 2 THEN 1000 - z::DOUBLE END AS z FROM grid),\n"
WEIGHED = {"zs": "coalesce(s.z, 0)", "ws": "CASE WHEN s.z IS NULL THEN 0 ELSE 1 END"}


def _pair(spark, sf_dir):
    """Two rasters in one table: the land, and another one across."""
    cells = raster.grid(N, N, spark).join(fx.grid(spark, sf_dir), ["row", "col"], "left")
    land = cells.select(F.lit("land").alias("raster"), "row", "col", F.when(F.col("n") % 5 < 3, F.col("z").cast("double")).alias("z"))
    return land.unionByName(cells.select(F.lit("other").alias("raster"), F.col("col").alias("row"), F.col("row").alias("col"), F.when(F.col("n") % 3 < 2, 1000 - F.col("z").cast("double")).alias("z")))


@query(PAIR + q.blur_sql("land", "b1", WEIGHED, 1.5) + ",\n" + q.blur_sql("other", "b2", WEIGHED, 1.5) + """
SELECT raster, row, col, round(ws, 6) AS weight, round(CASE WHEN ws > 0 THEN zs / ws END, 4) AS blurred FROM (SELECT 'land' AS raster, * FROM b1 UNION ALL SELECT 'other', * FROM b2)""")
def blur_of_two_rasters(spark, sf_dir):
    got = raster.masked_blur(_pair(spark, sf_dir), 1.5, ("raster",))
    return got.select("raster", "row", "col", r6("weight").alias("weight"), r6("blurred", 4).alias("blurred"))


TWO = RECURSIVE + "m1 AS (SELECT row, col FROM grid WHERE n % 5 < 3),\nm2 AS (SELECT col AS row, row AS col FROM grid WHERE n % 3 < 2),\n" + q.label_sql("m1", "l1") + ",\n" + q.label_sql("m2", "l2")


@query(TWO + " SELECT raster, component, count(*) AS size FROM (SELECT 'land' AS raster, * FROM l1 UNION ALL SELECT 'other', * FROM l2) GROUP BY raster, component HAVING count(*) >= 20")
def components_of_two_rasters(spark, sf_dir):
    labelled = raster.label(_pair(spark, sf_dir).where("z IS NOT NULL"), N, ("raster",))
    return raster.large_components(labelled, 20, ("raster",)).groupBy("raster", "component").agg(F.count("*").alias("size"))


CROSS = "(VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) s(a, b)"


@query(GRIDDED + f", m AS (SELECT row, col FROM grid WHERE n % 5 = 0 AND z > 500), d AS (SELECT DISTINCT row + a AS row, col + b AS col FROM m, {CROSS}) SELECT (row + a)::INT AS row, (col + b)::INT AS col FROM d, {CROSS} GROUP BY 1, 2 HAVING count(*) = 5")
def closing(spark, sf_dir):
    return raster.close(fx.grid(spark, sf_dir).where("n % 5 = 0 AND z > 500").select("row", "col"), 1)


# ---- lines

LINES = "seg AS (SELECT (s_suppkey * 637 % 6400) / 100.0 + 0.003 AS x, (s_suppkey * 853 % 6400) / 100.0 + 0.007 AS y, (s_suppkey * 637 % 6400) / 100.0 + 0.003 + s_suppkey % 7 - 3 AS x2, (s_suppkey * 853 % 6400) / 100.0 + 0.007 + s_suppkey * 3 % 5 - 2 AS y2 FROM supplier)"
MASKED_LINES = f"""spot AS (SELECT r.i AS row, c.i AS col, c.i + 0.5 AS px, r.i + 0.5 AS py, x, y, x2, y2, greatest(0, least(1, coalesce(((c.i + 0.5 - x) * (x2 - x) + (r.i + 0.5 - y) * (y2 - y)) / nullif((x2 - x) ** 2 + (y2 - y) ** 2, 0), 0))) AS t FROM range({N}) r(i), range({N}) c(i), seg),
mask AS (SELECT DISTINCT row::INT AS row, col::INT AS col FROM spot WHERE (px - x - t * (x2 - x)) ** 2 + (py - y - t * (y2 - y)) ** 2 <= 1)"""


def _lines(spark, sf_dir):
    key = F.col("s_suppkey")
    x, y = key * 637 % 6400 / 100.0 + 0.003, key * 853 % 6400 / 100.0 + 0.007
    return fx.table(spark, sf_dir, "supplier").select(x.alias("x"), y.alias("y"), (x + key % 7 - 3).alias("x2"), (y + key * 3 % 5 - 2).alias("y2"))


@query("WITH " + LINES + ",\n" + MASKED_LINES + " SELECT row, col FROM mask")
def line_mask(spark, sf_dir):
    return raster.line_mask(_lines(spark, sf_dir), 1.0, N, N)


@query(QUADS + VERTICES + ", " + LINES + ",\n" + MASKED_LINES + f" SELECT vid, round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN on_ THEN greatest(z - 0.5, 2.0) ELSE z END, 6) AS z, on_ AS embossed FROM (SELECT v.*, m.row IS NOT NULL AND v.z > 2.1 AS on_ FROM v LEFT JOIN mask m ON m.row = vid // {N} AND m.col = vid % {N})")
def emboss_border_lines(spark, sf_dir):
    mask = raster.line_mask(_lines(spark, sf_dir), 1.0, N, N)
    return mesh.emboss(q._vertices(spark, sf_dir), mask, DEFAULT.mm_per_pixel, 0.5).select("vid", *(r6(c).alias(c) for c in "xyz"), "embossed")


# ---- outlines of meshes


def _outline(spark, sf_dir):
    return outline.rings(mesh.section(*q._solid_mesh(spark, sf_dir), 0.5).withColumn("feature", F.lit("m")))


@query(QUADS + f" SELECT (i // {N})::INT AS row, (i % {N})::INT AS col FROM q")
def outline_cells(spark, sf_dir):
    """The rings of a solid's section enclose just the squares that it was made of."""
    return raster.rasterize(g.moved(_outline(spark, sf_dir), sx=1 / DEFAULT.mm_per_pixel, sy=1 / DEFAULT.mm_per_pixel).withColumns({"ring": F.col("part"), "part": F.lit(0)})).select("row", "col")


@query(RIM + " SELECT 'm' AS feature, 2 * count(*) AS edges, 2 * count(*) AS aligned, 1.0::DOUBLE AS ratio, false AS is_smooth FROM rim")
def outline_axis_aligned(spark, sf_dir):
    return checks.axis_aligned(g.edges(_outline(spark, sf_dir)))


# ---- places and shapes in mm


@query(f"""WITH p AS (SELECT c_custkey AS id, c_custkey * 13 % 360 - 180.0 + 0.3137 AS lon, c_custkey * 7 % 140 - 70.0 + 0.7731 AS lat FROM customer),
k AS (SELECT id, floor(((lat - {AF['f']}) * {AF['a']} - (lon - {AF['c']}) * {AF['d']}) / {DET}) AS row, floor(((lon - {AF['c']}) * {AF['e']} - (lat - {AF['f']}) * {AF['b']}) / {DET}) AS col FROM p), i AS (SELECT *, row BETWEEN 0 AND 63 AND col BETWEEN 0 AND 63 AS inside FROM k)
SELECT id, CASE WHEN inside THEN round(floor(col / 3) * 0.75, 6)::DOUBLE END AS x_mm, CASE WHEN inside THEN round(floor(row / 3) * 0.75, 6)::DOUBLE END AS y_mm FROM i""")
def capital_in_mm(spark, sf_dir):
    key = F.col("c_custkey")
    places = fx.table(spark, sf_dir, "customer").select(key.alias("id"), (key * 13 % 360 - 180.0 + 0.3137).alias("lon"), (key * 7 % 140 - 70.0 + 0.7731).alias("lat"))
    return vector.capital_mm(places, fx.AFFINE, N, N).select("id", r6("x_mm").alias("x_mm"), r6("y_mm").alias("y_mm"))


@query(SHAPED + f"SELECT feature, part, ring, seq, round(((x - {AF['c']}) * {AF['e']} - (y - {AF['f']}) * {AF['b']}) / {DET} * 0.25, 6)::DOUBLE AS x, round(((y - {AF['f']}) * {AF['a']} - (x - {AF['c']}) * {AF['d']}) / {DET} * 0.25, 6)::DOUBLE AS y FROM edges")
def rings_in_mm(spark, sf_dir):
    got = g.to_mm(fx.rings(spark), fx.AFFINE, DEFAULT.mm_per_pixel)
    return got.select("feature", "part", "ring", "seq", r6("x").alias("x"), r6("y").alias("y"))


# ---- lakes and islands

EQUAL = "k AS (SELECT 1 - (1 - 1 / 298.257223563::DOUBLE) ** 2 AS e2), c AS (SELECT *, sqrt(e2) AS e, cos(radians(30)) / sqrt(1 - e2 * 0.25) AS k0 FROM k)"
_Q = "((1 - e2) * (sin(radians({v})) / (1 - e2 * sin(radians({v})) ** 2) - ln((1 - e * sin(radians({v}))) / (1 + e * sin(radians({v})))) / (2 * e)))"
_FLAT = f"SELECT feature, 6378137 * k0 * radians(x) AS x, 6378137 / (2 * k0) * {_Q.replace('{v}', 'y')} AS y, 6378137 * k0 * radians(x2) AS x2, 6378137 / (2 * k0) * {_Q.replace('{v}', 'y2')} AS y2 FROM lake_edges, c"


@query(q.LAKE2 + f", {EQUAL}, f AS ({_FLAT}) SELECT feature, round(abs(sum(x * y2 - x2 * y)) / 2e6, 3) AS km2 FROM f GROUP BY feature")
def lake_areas(spark, sf_dir):
    return vector.equal_area_km2(fx.rings(spark, fx.LAKES)).select("feature", r6("km2", 3).alias("km2"))


GAMMA = [("GAMMA", 0, 0, i, x, y) for i, (x, y) in enumerate([(30.25, 55.25), (40.25, 55.25), (40.25, 62.25), (30.25, 62.25)])]
NAMES = [("ALPHA", "Land A"), ("BETA", None), ("GAMMA", "Land C")]


@query(q.LAKE2 + ", be AS (SELECT * FROM edges WHERE feature = 'BETA'), le AS (SELECT * FROM lake_edges WHERE feature = 'LAKE_2'),\n" + q._clip_area("be", "le") + """ SELECT * FROM (SELECT 'ALPHA' AS feature, 'Land A' AS name, 2::BIGINT AS lakes, 2::BIGINT AS holes, round(1634 - 92 - (46 - a), 6) AS area FROM area
UNION ALL SELECT 'BETA', NULL, 1, 0, round(252 - a, 6) FROM area UNION ALL SELECT 'GAMMA', 'Land C', 0, 0, 70.0)""")
def lakes_merged(spark, sf_dir):
    names = spark.createDataFrame(NAMES, "feature string, name string")
    rings, table = vector.merge_lakes(names, fx.rings(spark, [*fx.RINGS, *GAMMA]), fx.rings(spark, fx.LAKES), 100_000.0)
    area = g.measures(rings).select("feature", r6("area").alias("area"))
    return table.join(area, "feature").select("feature", "name", "lakes", "holes", "area")


FINE = 8
JOINED = NEAREST + """, b AS (SELECT feature, part, ix - (fx - ix) / d * 0.001 AS ix, iy - (fy - iy) / d * 0.001 AS iy, fx + (fx - ix) / d * 0.001 AS fx, fy + (fy - iy) / d * 0.001 AS fy, -(fy - iy) / d * 25 / 111 AS ox, (fx - ix) / d * 25 / 111 AS oy FROM near),
br AS (SELECT feature, 100 + part AS part, 0 AS ring, k::INT AS seq, CASE k WHEN 0 THEN ix + ox WHEN 1 THEN fx + ox WHEN 2 THEN fx - ox ELSE ix - ox END AS x, CASE k WHEN 0 THEN iy + oy WHEN 1 THEN fy + oy WHEN 2 THEN fy - oy ELSE iy - oy END AS y FROM b, range(4) r(k)),
""" + fx.edges_of("br", "bre") + f""", pieces AS (SELECT feature, part, x, y, x2, y2 FROM edges UNION ALL SELECT feature, part, x, y, x2, y2 FROM bre),
held AS (SELECT feature, part, r.i AS row, c.i AS col FROM range({FINE * N}) r(i), range({FINE * N}) c(i), pieces WHERE (y > (r.i + 0.5) / {FINE}) <> (y2 > (r.i + 0.5) / {FINE}) AND (c.i + 0.4863) / {FINE} < x + ((r.i + 0.5) / {FINE} - y) * (x2 - x) / (y2 - y) GROUP BY ALL HAVING count(*) % 2 = 1)
SELECT feature, count(*) AS cells, sum(row)::BIGINT AS rows, sum(col)::BIGINT AS cols FROM (SELECT DISTINCT feature, row, col FROM held) GROUP BY feature"""


@query(JOINED)
def islands_joined(spark, sf_dir):
    """Mainland, islands and bridges as one shape, counted on squares of an eighth of a cell."""
    areas = g.measures(fx.rings(spark), ("feature", "part")).select("feature", "part", F.col("area").alias("area_km2"))
    merged = vector.join_islands(fx.rings(spark), areas, q.ISLES)
    cells = raster.rasterize(g.moved(merged, dx=0.0137, sx=float(FINE), sy=float(FINE)))  # moved, so that no border meets a centre
    return cells.groupBy("feature").agg(F.count("*").alias("cells"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


@query(MEASURES + " SELECT feature, part, ring, points::BIGINT AS points FROM m WHERE ring = 0 AND points + 1 >= 5")
def rings_with_points(spark, sf_dir):
    """Exteriors of enough points, the closing one counted; the least is a parameter."""
    return vector.with_points(fx.rings(spark), DEFAULT.with_(min_ring_points=5)).select("feature", "part", "ring", "points")


# ---- files


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


@query(GRIDDED + "SELECT row, col, z::DOUBLE AS z FROM grid WHERE row BETWEEN 10 AND 50 AND col BETWEEN 3 AND 40")
def tiled_cells_round_trip(spark, sf_dir):
    """Tiles of 16 x 16 cells, written and read back through a box."""
    path = _folder(spark)
    formats.write_cells(fx.grid(spark, sf_dir).select("row", "col", F.col("z").cast("double").alias("z")), path, 16)
    return formats.read_cells(spark, path, (10, 50, 3, 40), 16).select("row", "col", "z")


@query(q._with(q.ODD, q.TILE_SQL) + "SELECT DISTINCT 's3://copernicus-dem-30m/' || tile || '/' || tile || '.tif' AS value FROM p WHERE lat IS NOT NULL")
def url_list_round_trip(spark, sf_dir):
    from cairn.functions import tiles

    path = _folder(spark)
    formats.write_lines(q._tiles(spark, sf_dir).where("lat IS NOT NULL").select(tiles.url(F.col("tile")).alias("value")).distinct(), path)
    return formats.tile_list(spark, path)


@query(QUADS + VERTICES + ", t AS (SELECT p.x AS ax, p.y AS ay, p.z AS az, q2.x AS bx, q2.y AS by_, q2.z AS bz, r.x AS cx, r.y AS cy, r.z AS cz FROM f JOIN v p ON p.vid = a JOIN v q2 ON q2.vid = b JOIN v r ON r.vid = f.c) SELECT 'm_solid' AS mesh_id, count(*) AS faces, round(sum(ax + bx + cx), 2) AS x, round(sum(ay + by_ + cy), 2) AS y, round(sum(az + bz + cz), 1) AS z FROM t")
def stl_round_trip(spark, sf_dir):
    path = _folder(spark)
    soup = mesh.with_corners(q._faces(spark, sf_dir), q._vertices(spark, sf_dir)).withColumn("mesh_id", F.lit("m"))
    formats.write_files(formats.pack_stl(soup, "solid"), path)
    back = formats.stl(spark, path)
    total = lambda k, n: r6(F.sum(sum(F.col(f"{c}{k}") for c in "abc")), n).alias(k)
    return back.groupBy("mesh_id").agg(F.count("*").alias("faces"), total("x", 2), total("y", 2), total("z", 1))


@query("SELECT n_name AS country, CASE WHEN n_nationkey % 5 > 0 THEN 'City ' || n_nationkey END AS city, (n_nationkey * 7.25 - 80)::DOUBLE AS lon, (n_nationkey * 3.5 - 40)::DOUBLE AS lat FROM nation")
def capitals_file(spark, sf_dir):
    """A JSON object of objects, one for each nation, written and read as capitals."""
    path, key = _folder(spark), F.col("n_nationkey")
    city = F.when(key % 5 > 0, F.concat(F.lit("City "), key.cast("string")))
    entry = F.struct(F.col("n_name").alias("key"), F.struct(city.alias("city"), (key * 7.25 - 80).alias("lon"), (key * 3.5 - 40).alias("lat")).alias("value"))
    whole = fx.table(spark, sf_dir, "nation").agg(F.map_from_entries(F.collect_list(entry)).alias("m"))  # a dimension: one row for each nation
    formats.write_lines(whole.select(F.to_json("m").alias("value")).coalesce(1), path)
    return formats.capitals(spark, path)


@query("SELECT o_orderkey, 'out_' || strftime(o_orderdate, '%Y%m%d_%H%M%S') || '_nogit' AS folder FROM orders")
def output_folders(spark, sf_dir):
    return fx.table(spark, sf_dir, "orders").select("o_orderkey", formats.output_folder("out", F.col("o_orderdate")).alias("folder"))


@query(QUADS + VERTICES + ", " + fx.values("b", q.BOX, ("r0", "r1", "c0", "c1")) + " SELECT vid, x, y, round(CASE WHEN hit THEN 1.5 ELSE z END, 6) AS z, hit AS lowered FROM (SELECT *, z BETWEEN 1.9 AND 2.5 AND EXISTS (SELECT 1 FROM b WHERE v.x BETWEEN c0 * 0.25 AND (c1 + 1) * 0.25 AND v.y BETWEEN r0 * 0.25 AND (r1 + 1) * 0.25) AS hit FROM v)")
def lower_bridge_in_band(spark, sf_dir):
    boxes = spark.createDataFrame(q.BOX, "r0 int, r1 int, c0 int, c1 int")
    return mesh.lower_in_box(q._vertices(spark, sf_dir), boxes, band=(1.9, 2.5)).withColumn("z", r6("z"))


@query(GRIDDED + "SELECT row, col, z::DOUBLE AS z FROM grid")
def features_file(spark, sf_dir):
    """Features written as GeoJSON lines and read back: here each cell is a square, named by its row and column."""
    path = _folder(spark)
    cells = fx.grid(spark, sf_dir).select(F.concat_ws(":", "row", "col").alias("feature"), "row", "col", F.col("z").cast("string").alias("z"))
    corner = F.array(*(F.struct(F.lit(i).alias("seq"), (F.col("col") + F.lit(a)).cast("double").alias("x"), (F.col("row") + F.lit(b)).cast("double").alias("y")) for i, (a, b) in enumerate([(0, 0), (1, 0), (1, 1), (0, 1)])))
    rings = cells.select("feature", F.lit(0).alias("part"), F.lit(0).alias("ring"), F.explode(corner).alias("v")).select("feature", "part", "ring", "v.*")
    formats.write_features(cells.select("feature", F.create_map(F.lit("z"), "z").alias("attributes")), rings, path)
    names, back = formats.read_features(spark, path)
    low = g.ring_measures(back).select("feature", F.col("miny").cast("int").alias("row"), F.col("minx").cast("int").alias("col"))
    return low.join(names, "feature").select("row", "col", F.col("attributes")["z"].cast("double").alias("z"))
