"""Registered terrain queries, and the SQL that each is held against in another engine."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import geometry as g
from cairn.functions import tiles
from cairn.functions.storage import written
from cairn.operators import checks, mesh, overlay, raster, vector
from cairn.params import DEFAULT
from cairn.plans import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
N = fx.SIDE


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def r6(c, digits: int = 6):
    return F.round(c, digits)


def _with(*entries: str) -> str:
    return "WITH " + ",\n".join(entries) + "\n"


EDGES = fx.edges_of("rings", "edges")
INSIDE = fx.cells_in("edges", "inside")
SHAPED = _with(fx.SHAPES, EDGES)
CLIPPED = _with(fx.CELLS, fx.SHAPES, EDGES, INSIDE)


# ---- clipping, and the flagship


@query(CLIPPED + """SELECT feature, count(*) AS vertices, round(min(v), 6) AS min_mm, round(max(v), 6) AS max_mm, round(avg(v), 6) AS avg_mm
FROM (SELECT feature, (2.0 + 0.002 * CASE WHEN z <= 0 THEN -50.0 ELSE z END)::DOUBLE AS v FROM inside JOIN grid USING (row, col)) GROUP BY feature""")
def clip_seafill_vertex_stats(spark, sf_dir):
    cells = raster.clip(fx.grid(spark, sf_dir), fx.rings(spark))
    v = cells.select("feature", raster.surface_mm(raster.sea_fill(F.col("z").cast("double"), F.col("inside"))).alias("v")).where("v IS NOT NULL")
    return v.groupBy("feature").agg(F.count("*").alias("vertices"), r6(F.min("v")).alias("min_mm"), r6(F.max("v")).alias("max_mm"), r6(F.avg("v")).alias("avg_mm"))


@query(CLIPPED + """, box AS (SELECT feature, min(row) AS r0, max(row) AS r1, min(col) AS c0, max(col) AS c1 FROM inside GROUP BY feature)
SELECT b.feature, g.row, g.col, CASE WHEN i.row IS NULL THEN 0 ELSE g.z END AS z, i.row IS NOT NULL AS inside FROM box b JOIN grid g ON g.row BETWEEN r0 AND r1 AND g.col BETWEEN c0 AND c1 LEFT JOIN inside i ON i.feature = b.feature AND i.row = g.row AND i.col = g.col""")
def point_in_polygon_cells(spark, sf_dir):
    return raster.clip(fx.grid(spark, sf_dir), fx.rings(spark))


# ---- tiles, names, tables

TILE_SQL = """ids AS (SELECT 'Copernicus_DSM_COG_10_' || CASE WHEN c_custkey % 180 - 90 >= 0 THEN 'N' ELSE 'S' END || lpad(abs(c_custkey % 180 - 90)::VARCHAR, 2, '0') || '_00_' || CASE WHEN c_custkey * 7 % 360 - 180 >= 0 THEN 'E' ELSE 'W' END || lpad(abs(c_custkey * 7 % 360 - 180)::VARCHAR, 3, '0') || '_00_DEM' AS value FROM customer UNION ALL SELECT value FROM odd),
t AS (SELECT trim(value) AS tile, regexp_extract(trim(value), '^Copernicus_DSM_COG_10_([NS])([0-9]{2})_00_([EW])([0-9]{3})_00_DEM$', ['ns', 'lat', 'ew', 'lon']) AS m FROM ids WHERE trim(value) <> ''),
p AS (SELECT tile, CASE WHEN m.ns <> '' THEN (CASE m.ns WHEN 'S' THEN -1 ELSE 1 END * try_cast(m.lat AS INT))::INT END AS lat, CASE WHEN m.ew <> '' THEN (CASE m.ew WHEN 'W' THEN -1 ELSE 1 END * try_cast(m.lon AS INT))::INT END AS lon FROM t)"""
ODD = fx.values("odd", [(t,) for t in fx.ODD_TILES], ("value",))
BOXES = fx.values("boxes", [(k, *v) for k, v in tiles.BOXES.items()], ("region", "south", "north", "west", "east"))


def _tiles(spark, sf_dir):
    lat, lon = (F.col("c_custkey") % 180 - 90).cast("int"), (F.col("c_custkey") * 7 % 360 - 180).cast("int")
    name = F.format_string("Copernicus_DSM_COG_10_%s%02d_00_%s%03d_00_DEM", F.when(lat >= 0, "N").otherwise("S"), F.abs(lat), F.when(lon >= 0, "E").otherwise("W"), F.abs(lon))
    odd = spark.createDataFrame([(t,) for t in fx.ODD_TILES], "value string")
    return tiles.parsed(fx.table(spark, sf_dir, "customer").select(name.alias("value")).unionByName(odd))


@query(_with(ODD, BOXES, TILE_SQL) + """SELECT region, tile, lat, lon, 's3://copernicus-dem-30m/' || tile || '/' || tile || '.tif' AS url FROM p JOIN boxes ON lat BETWEEN south AND north AND lon BETWEEN west AND east""")
def tile_filter_by_region(spark, sf_dir):
    found = _tiles(spark, sf_dir).withColumn("region", F.explode(F.array_compact(F.array(*(F.when(tiles.in_box(F.col("lat"), F.col("lon"), box), name) for name, box in tiles.BOXES.items())))))
    return found.select("region", "tile", "lat", "lon", tiles.url(F.col("tile")).alias("url"))


@query(_with(ODD, TILE_SQL) + "SELECT count(*) AS total, count(*) FILTER (lat BETWEEN -35 AND 38 AND lon BETWEEN -18 AND 52) AS kept FROM p")
def tile_counts(spark, sf_dir):
    return tiles.counted(_tiles(spark, sf_dir), tiles.BOXES["africa"])


@query(_with(fx.values("b", fx.BOUNDS, ("region", "minx", "miny", "maxx", "maxy"))) + """SELECT region, lat::INT AS lat, lon::INT AS lon, CASE WHEN lat >= 0 THEN 'N' ELSE 'S' END || lpad(abs(lat)::VARCHAR, 2, '0') || CASE WHEN lon >= 0 THEN 'E' ELSE 'W' END || lpad(abs(lon)::VARCHAR, 3, '0') || '.hgt.gz' AS tile
FROM b, LATERAL (SELECT unnest(range(trunc(miny)::BIGINT, trunc(maxy)::BIGINT + 2)) AS lat) a, LATERAL (SELECT unnest(range(trunc(minx)::BIGINT, trunc(maxx)::BIGINT + 2)) AS lon) o""")
def tile_grid_enumeration(spark, sf_dir):
    bounds = spark.createDataFrame(fx.BOUNDS, "region string, minx double, miny double, maxx double, maxy double")
    return tiles.squares(bounds).select("region", "lat", "lon", "tile")


@query(_with(ODD, TILE_SQL) + "SELECT DISTINCT tile FROM p WHERE lat IS NOT NULL AND tile NOT IN (SELECT tile FROM p WHERE lat > 0 AND lon > 0)")
def download_plan(spark, sf_dir):
    wanted = _tiles(spark, sf_dir).where("lat IS NOT NULL").select("tile").distinct()
    return tiles.to_fetch(wanted, _tiles(spark, sf_dir).where("lat > 0 AND lon > 0"))


CAPS = fx.values("caps", fx.CAPITALS, fx.CAPITAL_COLUMNS)
MORE = fx.values("more", fx.MORE_CAPITALS, fx.CAPITAL_COLUMNS)


@query(_with(CAPS, MORE) + "SELECT *, 1::INT AS priority FROM more UNION ALL SELECT *, 0::INT FROM caps WHERE country NOT IN (SELECT country FROM more)")
def capitals_upsert(spark, sf_dir):
    return vector.upsert([fx.capitals(spark), spark.createDataFrame(fx.MORE_CAPITALS, fx.CAPITAL_SCHEMA)], "country")


@query(_with(CAPS) + "SELECT n_name AS country, city, lon, lat, city IS NOT NULL AS has_star FROM nation LEFT JOIN caps ON n_name = country")
def capital_lookup_left_join(spark, sf_dir):
    return vector.with_capital(fx.table(spark, sf_dir, "nation").select(F.col("n_name").alias("country")), fx.capitals(spark))


COAST = ", ".join(f"'{c}'" for c in fx.COASTAL)


@query(f"SELECT flag, count(*) AS n, count(*) FILTER (flag OR n_name IN ({COAST})) AS extruded FROM nation, (VALUES (true), (false)) f(flag) GROUP BY flag")
def coastal_flag_count(spark, sf_dir):
    rows = fx.table(spark, sf_dir, "nation").withColumn("flag", F.explode(F.array(F.lit(True), F.lit(False))))
    return rows.groupBy("flag").agg(F.count("*").alias("n"), F.count_if(F.col("flag") | F.col("n_name").isin(*fx.COASTAL)).alias("extruded"))


WANTED = [("NATION_1",), ("ALT_1",), ("ALT_4",), ("NATION_4",), ("NOWHERE",)]


@query(_with(fx.FEATURES, fx.values("w", WANTED, ("want",))) + """, h AS (SELECT want, f.*, 0 AS turn FROM w JOIN features f ON admin = want UNION ALL SELECT want, f.*, 1 FROM w JOIN features f ON name = want)
SELECT w.want, id, admin, name, continent, CASE WHEN id IS NULL THEN 'not found' ELSE 'ok' END AS status FROM w LEFT JOIN (SELECT * FROM h QUALIFY turn = min(turn) OVER (PARTITION BY want)) h USING (want)""")
def feature_name_fallback(spark, sf_dir):
    return vector.named(fx.features(spark, sf_dir), spark.createDataFrame(WANTED, "want string")).select("want", "id", "admin", "name", "continent", "status")


@query(_with(fx.FEATURES) + """, k AS (SELECT *, row_number() OVER (ORDER BY name) AS rn, count(*) OVER () AS total FROM (SELECT DISTINCT replace(name, ' ', '_') || '_solid.stl' AS file, name FROM features WHERE continent IN (SELECT r_name FROM region WHERE r_regionkey < 4) AND name <> 'ALT_3'))
SELECT name, file, total - 10 AS others FROM k WHERE rn <= 10""")
def feature_filters(spark, sf_dir):
    from cairn.sources.formats import stl_name

    some = fx.table(spark, sf_dir, "region").where("r_regionkey < 4").select(F.col("r_name").alias("continent"))
    kept = fx.features(spark, sf_dir).join(some, "continent", "left_semi").where(~F.col("name").isin("ALT_3")).select("name", stl_name(F.col("name")).alias("file")).distinct()
    return kept.orderBy("name").limit(10).crossJoin(kept.agg((F.count("*") - 10).alias("others")))


# ---- plane geometry

MEASURES = SHAPED + ", " + fx.measured("edges", "m")


@query(MEASURES + """, f AS (SELECT feature, sum(CASE WHEN ring = 0 THEN area ELSE -area END) AS area, sum(CASE WHEN ring = 0 THEN mx ELSE -mx END) AS mx, sum(CASE WHEN ring = 0 THEN my ELSE -my END) AS my, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) FILTER (ring > 0) AS holes FROM m GROUP BY feature)
SELECT feature, round(area, 6) AS area, round(mx / area, 6) AS cx, round(my / area, 6) AS cy, minx, miny, maxx, maxy, holes FROM f""")
def polygon_area_centroid_bounds(spark, sf_dir):
    return g.measures(fx.rings(spark)).select("feature", r6("area").alias("area"), r6("cx").alias("cx"), r6("cy").alias("cy"), "minx", "miny", "maxx", "maxy", "holes")


POINTS = "pts AS (SELECT o_orderkey AS id, (o_custkey * 37 % 6400) / 100.0 + 0.003 AS x, (o_orderkey * 53 % 6400) / 100.0 + 0.007 AS y FROM orders)"


@query(_with(fx.SHAPES, EDGES, POINTS) + "SELECT feature, count(*) AS points, sum(id)::BIGINT AS ids FROM (SELECT p.id, e.feature FROM pts p JOIN edges e ON (e.y > p.y) <> (e.y2 > p.y) AND p.x < e.x + (p.y - e.y) * (e.x2 - e.x) / (e.y2 - e.y) GROUP BY p.id, e.feature HAVING count(*) % 2 = 1) GROUP BY feature")
def points_in_features(spark, sf_dir):
    points = fx.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") * 37 % 6400 / 100.0 + 0.003).alias("x"), (F.col("o_orderkey") * 53 % 6400 / 100.0 + 0.007).alias("y"))
    return g.points_in(points, fx.rings(spark), ("id",)).groupBy("feature").agg(F.count("*").alias("points"), F.sum("id").alias("ids"))


PLACES = "pl AS (SELECT c_custkey AS id, c_custkey * 13 % 360 - 180.0 AS lon, c_custkey * 7 % 140 - 70.0 AS lat FROM customer)"


@query(f"""WITH c AS (SELECT * FROM (VALUES {', '.join(f"('{k}', {v[0]}, {v[1]}, {v[2]}, {v[3]})" for k, v in tiles.CONICS.items())}) t(region, lat1, lat2, lat0, lon0)),
k AS (SELECT *, 1 - (1 - 1 / 298.257223563::DOUBLE) * (1 - 1 / 298.257223563::DOUBLE) AS e2 FROM c),
s AS (SELECT *, sqrt(e2) AS e, sin(radians(lat1)) AS s1, sin(radians(lat2)) AS s2, sin(radians(lat0)) AS s0, {PLACES[PLACES.index('(') + 1:-1].split(' FROM ')[0].replace('SELECT ', '')} FROM k, customer),
q AS (SELECT *, (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) AS q1, (1 - e2) * (s2 / (1 - e2 * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) AS q2, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0,
 (1 - e2) * (sin(radians(lat)) / (1 - e2 * sin(radians(lat)) ** 2) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) AS q, cos(radians(lat1)) ** 2 / (1 - e2 * s1 * s1) AS m1, cos(radians(lat2)) ** 2 / (1 - e2 * s2 * s2) AS m2 FROM s),
n AS (SELECT *, (m1 - m2) / (q2 - q1) AS n FROM q), r AS (SELECT *, sqrt(greatest(0, m1 + n * q1 - n * q)) / n AS rho, sqrt(m1 + n * q1 - n * q0) / n AS rho0 FROM n)
SELECT region, id, round(6378137 * rho * sin(n * radians(lon - lon0)), 3) AS x, round(6378137 * (rho0 - rho * cos(n * radians(lon - lon0))), 3) AS y FROM r""")
def albers_forward(spark, sf_dir):
    key = F.col("c_custkey")
    places = fx.table(spark, sf_dir, "customer").select(key.alias("id"), (key * 13 % 360 - 180.0).alias("lon"), (key * 7 % 140 - 70.0).alias("lat"))
    out = []
    for region, (lat_1, lat_2, lat_0, lon_0, _) in tiles.CONICS.items():
        x, y = g.albers(F.col("lon"), F.col("lat"), lat_1, lat_2, lat_0, lon_0)
        out.append(F.struct(F.lit(region).alias("region"), r6(x, 3).alias("x"), r6(y, 3).alias("y")))
    return places.select("id", F.explode(F.array(*out)).alias("p")).select("p.region", "id", "p.x", "p.y")


AF = {k: f"({v})" for k, v in fx.AFFINE.items()}


@query(_with(PLACES) + f"""SELECT id, round(px::DOUBLE, 6) AS px, round(py::DOUBLE, 6) AS py, floor(r)::BIGINT AS row, floor(c)::BIGINT AS col, round(c * 0.25, 6) AS x_mm, round(r * 0.25, 6) AS y_mm, floor(floor(c) / 3)::BIGINT * 0.75::DOUBLE AS x_step_mm, floor(floor(r) / 3)::BIGINT * 0.75::DOUBLE AS y_step_mm
FROM (SELECT id, {AF['c']} + lon * {AF['a']} + lat * {AF['b']} AS px, {AF['f']} + lon * {AF['d']} + lat * {AF['e']} AS py, ((lon + 0.3137 - {AF['c']}) * {AF['e']} - (lat + 0.7731 - {AF['f']}) * {AF['b']}) / ({AF['a']} * {AF['e']} - {AF['b']} * {AF['d']}) AS c, ((lat + 0.7731 - {AF['f']}) * {AF['a']} - (lon + 0.3137 - {AF['c']}) * {AF['d']}) / ({AF['a']} * {AF['e']} - {AF['b']} * {AF['d']}) AS r FROM pl)""")
def affine_roundtrip(spark, sf_dir):
    key = F.col("c_custkey")
    places = fx.table(spark, sf_dir, "customer").select(key.alias("id"), (key * 13 % 360 - 180.0).alias("lon"), (key * 7 % 140 - 70.0).alias("lat"))
    px, py = g.forward(F.col("lat"), F.col("lon"), fx.AFFINE)
    row, col = g.inverse(F.col("lon") + 0.3137, F.col("lat") + 0.7731, fx.AFFINE)
    step = lambda c: F.floor(F.floor(c) / DEFAULT.step) * (DEFAULT.step * DEFAULT.mm_per_pixel)
    return places.select("id", r6(px).alias("px"), r6(py).alias("py"), F.floor(row).alias("row"), F.floor(col).alias("col"), r6(col * DEFAULT.mm_per_pixel).alias("x_mm"), r6(row * DEFAULT.mm_per_pixel).alias("y_mm"), step(col).alias("x_step_mm"), step(row).alias("y_step_mm"))


NEAR = [("p1", "ALPHA", 26.5, 27.5), ("p2", "ALPHA", 57.0, 11.0), ("p3", "BETA", 70.0, 20.0), ("p4", "BETA", 50.25, 40.25)]
SEGMENT = "sqrt((px - x - t * (x2 - x)) ** 2 + (py - y - t * (y2 - y)) ** 2)"


@query(_with(fx.SHAPES, EDGES, fx.values("p", NEAR, ("name", "feature", "px", "py")), fx.measured("edges", "m")) + f""", main AS (SELECT feature, part FROM (SELECT feature, part, sum(CASE WHEN ring = 0 THEN area ELSE -area END) AS area FROM m GROUP BY feature, part) QUALIFY row_number() OVER (PARTITION BY feature ORDER BY area DESC, part) = 1),
t AS (SELECT p.*, e.*, greatest(0, least(1, ((px - x) * (x2 - x) + (py - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2))) AS t FROM p JOIN main USING (feature) JOIN edges e ON e.feature = p.feature AND e.part = main.part AND ring = 0)
SELECT name, feature, round(111 * d, 6) AS km, 111 * d <= 50 AS is_near FROM (SELECT name, p_feature AS feature, min({SEGMENT}) AS d FROM (SELECT *, feature AS p_feature FROM t) GROUP BY name, p_feature)""")
def point_to_ring_distance(spark, sf_dir):
    points = spark.createDataFrame(NEAR, "name string, feature string, x double, y double")
    return vector.near_border(points, fx.rings(spark)).select("name", "feature", r6("km").alias("km"), "is_near")


STAR = """SELECT kind, i::INT AS seq, round(cx + CASE WHEN i % 2 = 0 THEN r ELSE r * q END * cos(radians(s) + 2 * pi() * i / (2 * n)), 6) AS x, round(cy + CASE WHEN i % 2 = 0 THEN r ELSE r * q END * sin(radians(s) + 2 * pi() * i / (2 * n)), 6) AS y
FROM (VALUES ('print', 4.0, 0.45, 4, 0.0, 10.0, 20.0), ('check', 2.0, 0.382, 5, -90.0, 1.0, 2.0)) t(kind, r, q, n, s, cx, cy), LATERAL (SELECT unnest(range(2 * n)) AS i)"""


@query(STAR)
def star_polygon_vertices(spark, sf_dir):
    stars = F.array(F.struct(F.lit("print").alias("kind"), g.star(F.lit(10.0), F.lit(20.0), DEFAULT.star_radius_mm, DEFAULT.star_inner, DEFAULT.star_points).alias("v")), F.struct(F.lit("check").alias("kind"), g.star(F.lit(1.0), F.lit(2.0), 2.0, 0.382, 5, -90.0).alias("v")))
    rows = spark.range(1).select(F.explode(stars).alias("s")).select("s.kind", F.explode("s.v").alias("v"))
    return rows.select("kind", "v.seq", r6("v.x").alias("x"), r6("v.y").alias("y"))


# ---- parts and islands

PARTS = MEASURES + """, parts AS (SELECT feature, part, sum(CASE WHEN ring = 0 THEN area ELSE -area END) AS area, sum(CASE WHEN ring = 0 THEN mx ELSE -mx END) / sum(CASE WHEN ring = 0 THEN area ELSE -area END) AS cx, max(CASE WHEN ring = 0 THEN points END) AS points, count(*) FILTER (ring > 0) AS holes FROM m GROUP BY feature, part),
ranked AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY area DESC, part)::INT AS rank FROM parts)"""


@query(PARTS + " SELECT feature, part, rank, round(area, 6) AS area, round(cx, 6) AS cx FROM ranked WHERE rank = 1")
def mainland_part(spark, sf_dir):
    return vector.ranked_parts(fx.rings(spark)).where("rank = 1").select("feature", "part", "rank", r6("area").alias("area"), r6("cx").alias("cx"))


@query(PARTS + """ SELECT r.feature, r.part, r.ring, r.seq, r.x, r.y FROM rings r JOIN ranked k USING (feature, part) WHERE (feature = 'ALPHA' AND (rank <= 1 OR cx >= 50) AND ring = 0) OR (feature = 'BETA' AND rank <= 1)""")
def top2_plus_east_parts(spark, sf_dir):
    rules = spark.createDataFrame([("ALPHA", 1, 50.0, True)], "feature string, top int, east_of double, drop_holes boolean")
    return vector.keep_parts(fx.rings(spark), rules, default_top=1).select(*fx.RING_COLUMNS)


@query(MEASURES + " SELECT feature, part, ring, round(area, 6) AS area, (SELECT count(*) FROM m WHERE ring > 0) AS all_holes FROM m WHERE ring > 0 AND area >= 50")
def interior_ring_lakes(spark, sf_dir):
    holes = g.ring_measures(fx.rings(spark)).where("ring > 0").agg(F.count("*").alias("all_holes"))
    return vector.large_holes(fx.rings(spark), 50.0).select("feature", "part", "ring", r6("area").alias("area")).crossJoin(holes)


NEAREST = PARTS + """, v AS (SELECT i.feature, i.part, i.x, i.y, i.x2, i.y2, m.x AS mx, m.y AS my, m.x2 AS mx2, m.y2 AS my2 FROM edges i JOIN ranked ri ON ri.feature = i.feature AND ri.part = i.part AND ri.rank > 1 JOIN ranked rm ON rm.feature = i.feature AND rm.rank = 1 JOIN edges m ON m.feature = rm.feature AND m.part = rm.part WHERE i.ring = 0 AND m.ring = 0),
t AS (SELECT *, greatest(0, least(1, ((x - mx) * (mx2 - mx) + (y - my) * (my2 - my)) / ((mx2 - mx) ** 2 + (my2 - my) ** 2))) AS t, greatest(0, least(1, ((mx - x) * (x2 - x) + (my - y) * (y2 - y)) / ((x2 - x) ** 2 + (y2 - y) ** 2))) AS u FROM v),
f AS (SELECT feature, part, x AS ix, y AS iy, mx + t * (mx2 - mx) AS fx, my + t * (my2 - my) AS fy FROM t UNION ALL SELECT feature, part, x + u * (x2 - x), y + u * (y2 - y), mx, my FROM t),
near AS (SELECT feature, part, ix, iy, fx, fy, sqrt((ix - fx) ** 2 + (iy - fy) ** 2) AS d FROM f QUALIFY row_number() OVER (PARTITION BY feature, part ORDER BY d, ix, iy, fx, fy) = 1)"""
ISLES = DEFAULT.with_(island_min_km2=30.0, km_per_degree=111.0, bridge_max_km=1000.0)


@query(NEAREST + " SELECT n.feature, n.part, round(area, 6) AS area_km2, round(111 * d, 6) AS km, CASE WHEN 111 * d > 1000 THEN 'too far' ELSE 'bridge' END AS status, round(ix, 6) AS ix, round(iy, 6) AS iy, round(fx, 6) AS mx, round(fy, 6) AS my FROM near n JOIN ranked k USING (feature, part) WHERE area >= 30")
def island_bridge_candidates(spark, sf_dir):
    areas = g.measures(fx.rings(spark), ("feature", "part")).select("feature", "part", F.col("area").alias("area_km2"))
    got = vector.bridges(fx.rings(spark), areas, ISLES)
    return got.select("feature", "part", "status", *(r6(c).alias(c) for c in ("area_km2", "km", "ix", "iy", "mx", "my")))


@query(NEAREST + """, b AS (SELECT feature, part, ix, iy, fx, fy, -(fy - iy) / d * 25 / 111 AS ox, (fx - ix) / d * 25 / 111 AS oy FROM near)
SELECT feature || ':' || part AS feature, 0 AS part, 0 AS ring, k::INT AS seq, round(CASE k WHEN 0 THEN ix + ox WHEN 1 THEN fx + ox WHEN 2 THEN fx - ox ELSE ix - ox END, 6) AS x, round(CASE k WHEN 0 THEN iy + oy WHEN 1 THEN fy + oy WHEN 2 THEN fy - oy ELSE iy - oy END, 6) AS y FROM b, range(4) r(k)""")
def bridge_rectangle(spark, sf_dir):
    areas = g.measures(fx.rings(spark), ("feature", "part")).select("feature", "part", F.col("area").alias("area_km2"))
    rings = vector.bridge_rings(vector.bridges(fx.rings(spark), areas, ISLES), ISLES)
    return rings.select("feature", "part", "ring", "seq", r6("x").alias("x"), r6("y").alias("y"))


@query(PARTS + """, b AS (SELECT feature, part, count(*) AS lines, min(x) AS x0, max(y) AS y1 FROM edges GROUP BY feature, part)
SELECT feature, part, rank, round(area / 1e6, 12) AS area_km2, lines, round(x0 * 2 + 1, 6) AS x0, round(y1 * 2 - 1, 6) AS y1, points::BIGINT AS points, points >= 4 AS kept FROM ranked JOIN b USING (feature, part) WHERE area >= 30""")
def part_filters_and_flatten(spark, sf_dir):
    rings = fx.rings(spark)
    lines = g.boundary_lines(g.moved(rings, 1.0, -1.0, 2.0, 2.0)).withColumn("part", F.split("line", ":")[0].cast("int")).groupBy("feature", "part").agg(F.count("*").alias("lines"), F.min("x").alias("x0"), F.max("y").alias("y1"))
    parts = vector.ranked_parts(rings).where("area >= 30").join(lines, ["feature", "part"])
    return parts.select("feature", "part", "rank", r6(F.col("area") / 1e6, 12).alias("area_km2"), "lines", r6("x0").alias("x0"), r6("y1").alias("y1"), "points", (F.col("points") >= 4).alias("kept"))


# ---- rasters

GRIDDED = _with(fx.CELLS)


@query(GRIDDED + "SELECT floor(row / 5)::INT AS row, floor(col / 5)::INT AS col, round(avg(z), 6) AS z, count(z) AS n FROM grid GROUP BY 1, 2")
def block_average_resample(spark, sf_dir):
    return raster.block_average(fx.grid(spark, sf_dir), 5).select("row", "col", r6("z").alias("z"), "n")


@query(GRIDDED + "SELECT (row // 3)::INT AS row, (col // 3)::INT AS col, z FROM grid WHERE row % 3 = 0 AND col % 3 = 0")
def decimate_grid(spark, sf_dir):
    return raster.decimate(fx.grid(spark, sf_dir), 3).select("row", "col", "z")


def blur_sql(source: str, out: str, columns: dict[str, str], sigma: float, n: int = N) -> str:
    """WITH entries: value expressions over a source of (row, col, ...) on a full grid, blurred on both axes by gathering mirrored cells."""
    r = int(4 * sigma + 0.5)
    total = sum(math.exp(-k * k / (2 * sigma * sigma)) for k in range(-r, r + 1))
    at = lambda axis: f"CASE WHEN (({axis} + k) % {2 * n} + {2 * n}) % {2 * n} < {n} THEN (({axis} + k) % {2 * n} + {2 * n}) % {2 * n} ELSE {2 * n} - 1 - (({axis} + k) % {2 * n} + {2 * n}) % {2 * n} END"
    own = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    sums = lambda t: ", ".join(f"sum(w * {t}.{c}) AS {c}" for c in columns)
    full = f"(SELECT r.i::INT AS row, c.i::INT AS col FROM range({n}) r(i), range({n}) c(i))"
    return f"""{out}_w AS (SELECT k, exp(-k * k / {2 * sigma * sigma}) / {total!r} AS w FROM range({-r}, {r + 1}) t(k)),
{out}_0 AS (SELECT f.row, f.col, {own} FROM {full} f LEFT JOIN {source} s USING (row, col)),
{out}_1 AS (SELECT f.row, f.col, {sums('s')} FROM {full} f CROSS JOIN {out}_w JOIN {out}_0 s ON s.col = f.col AND s.row = {at('f.row')} GROUP BY f.row, f.col),
{out} AS (SELECT f.row, f.col, {sums('s')} FROM {full} f CROSS JOIN {out}_w JOIN {out}_1 s ON s.row = f.row AND s.col = {at('f.col')} GROUP BY f.row, f.col)"""


MASKED_BLUR = GRIDDED + ", land AS (SELECT row, col, CASE WHEN n % 5 < 3 THEN z::DOUBLE END AS z FROM grid),\n" + blur_sql("land", "bl", {"zs": "coalesce(s.z, 0)", "ws": "CASE WHEN s.z IS NULL THEN 0 ELSE 1 END"}, DEFAULT.dem_sigma)


def _land(spark, sf_dir):
    return raster.grid(N, N, spark).join(fx.grid(spark, sf_dir), ["row", "col"], "left").select("row", "col", F.when(F.col("n") % 5 < 3, F.col("z").cast("double")).alias("z"))


@query(MASKED_BLUR + " SELECT row, col, round(ws, 6) AS weight, round(CASE WHEN ws > 0 THEN zs / ws END, 4) AS blurred FROM bl")
def gaussian_blur_masked(spark, sf_dir):
    return raster.masked_blur(_land(spark, sf_dir), DEFAULT.dem_sigma).select("row", "col", r6("weight").alias("weight"), r6("blurred", 4).alias("blurred"))


@query(MASKED_BLUR + " SELECT row, col, round(CASE WHEN z - zs / ws > 50 THEN 0.8 * z + 0.2 * zs / ws ELSE 0.6 * zs / ws + 0.4 * z END, 4) AS z FROM land JOIN bl USING (row, col) WHERE z IS NOT NULL")
def blend_preserve_peaks(spark, sf_dir):
    got = raster.masked_blur(_land(spark, sf_dir), DEFAULT.dem_sigma).where("z IS NOT NULL")
    return got.select("row", "col", r6(raster.blend(F.col("z"), F.col("blurred")), 4).alias("z"))


def label_sql(mask: str, out: str, n: int = N) -> str:
    """WITH entries (of a recursive WITH): the component of each cell, by reaching."""
    return f"""{out}_c AS (SELECT row * {n} + col AS i, col FROM {mask}),
{out}_e AS MATERIALIZED (SELECT x.i AS a, y.i AS b FROM {out}_c x JOIN {out}_c y ON y.i = x.i + {n} UNION ALL SELECT y.i, x.i FROM {out}_c x JOIN {out}_c y ON y.i = x.i + {n} UNION ALL SELECT x.i, y.i FROM {out}_c x JOIN {out}_c y ON y.i = x.i + 1 AND y.col > 0 UNION ALL SELECT y.i, x.i FROM {out}_c x JOIN {out}_c y ON y.i = x.i + 1 AND y.col > 0),
{out}_r(a, b) AS (SELECT i, i FROM {out}_c UNION SELECT r.a, e.b FROM {out}_r r JOIN {out}_e e ON e.a = r.b),
{out} AS (SELECT (b // {n})::INT AS row, (b % {n})::INT AS col, min(a)::BIGINT AS component FROM {out}_r GROUP BY b)"""


RECURSIVE = "WITH RECURSIVE " + fx.CELLS + ",\n"
LAND = "m AS (SELECT row, col FROM grid WHERE n % 5 < 3)"


@query(RECURSIVE + LAND + ",\n" + label_sql("m", "l") + " SELECT row, col, component FROM l")
def connected_components(spark, sf_dir):
    return raster.label(fx.masked(spark, sf_dir), N)


@query(RECURSIVE + LAND + ",\n" + label_sql("m", "l") + " SELECT component, count(*) AS size, (SELECT count(DISTINCT component) FROM l) AS components FROM l GROUP BY component HAVING count(*) >= 50")
def drop_small_components(spark, sf_dir):
    labelled = raster.label(fx.masked(spark, sf_dir), N)
    total = labelled.agg(F.countDistinct("component").alias("components"))
    return raster.large_components(labelled, 50).groupBy("component").agg(F.count("*").alias("size")).crossJoin(total)


HOLES = f"o AS (SELECT r.i::INT AS row, c.i::INT AS col FROM range({N}) r(i), range({N}) c(i) EXCEPT SELECT row, col FROM {{mask}}),\n" + label_sql("o", "ol") + f",\nhf AS (SELECT row, col FROM {{mask}} UNION ALL SELECT row, col FROM ol WHERE component NOT IN (SELECT component FROM ol WHERE row IN (0, {N - 1}) OR col IN (0, {N - 1})))"


@query(RECURSIVE + LAND + ",\n" + HOLES.replace("{mask}", "m") + " SELECT row, col FROM hf")
def fill_holes(spark, sf_dir):
    return raster.fill_holes(fx.masked(spark, sf_dir), N, N)


@query(GRIDDED + f", m AS (SELECT row, col FROM grid WHERE n % 5 = 0 AND z > 1500), d AS (SELECT DISTINCT row + a AS row, col + b AS col FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (-2, 0), (0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)) s(a, b)) SELECT row::INT AS row, col::INT AS col FROM d WHERE row BETWEEN 0 AND {N - 1} AND col BETWEEN 0 AND {N - 1}")
def binary_dilation(spark, sf_dir):
    return raster.dilate(fx.grid(spark, sf_dir).where("n % 5 = 0 AND z > 1500").select("row", "col"), 2, N, N)


@query(CLIPPED + """, c AS (SELECT feature, count(*) AS total, count(g.row) AS with_data FROM inside i LEFT JOIN (SELECT row, col FROM grid WHERE n % 20 <> 0) g USING (row, col) GROUP BY feature)
SELECT feature, total, with_data, total - with_data AS missing, round(100.0 * (total - with_data) / total, 6) AS missing_pct, 100.0 * (total - with_data) / total < 5 AS is_valid, CASE WHEN 100.0 * with_data / total >= 98 THEN 'excellent' WHEN 100.0 * with_data / total >= 95 THEN 'good' WHEN 100.0 * with_data / total >= 90 THEN 'acceptable' ELSE 'poor' END AS grade FROM c""")
def dem_coverage_gate(spark, sf_dir):
    got = raster.coverage(fx.grid(spark, sf_dir).where("n % 20 <> 0"), fx.rings(spark))
    return got.withColumn("missing_pct", r6("missing_pct"))


@query(GRIDDED + "SELECT row, col, floor(255.0 * (z - (SELECT min(z) FROM grid)) / ((SELECT max(z) FROM grid) - (SELECT min(z) FROM grid)))::INT AS byte FROM grid")
def minmax_to_byte(spark, sf_dir):
    return raster.to_byte(fx.grid(spark, sf_dir))


@query(GRIDDED + "SELECT row, col, CASE WHEN col >= 24 THEN z + 7 ELSE z END AS z, CASE WHEN col >= 24 THEN 1 ELSE 0 END AS layer FROM grid WHERE col < 40 OR col >= 24")
def mosaic_last_wins(spark, sf_dir):
    cells = fx.grid(spark, sf_dir)
    return raster.mosaic([cells.where("col < 40"), cells.where("col >= 24").withColumn("z", F.col("z") + 7)])


@query(RECURSIVE + "full_ AS (SELECT r.i::INT AS row, c.i::INT AS col, coalesce(z, 0)::DOUBLE AS z, coalesce(n, 0) AS n FROM range(64) r(i), range(64) c(i) LEFT JOIN grid ON row = r.i AND col = c.i),\nsrc AS (SELECT row, col, CASE WHEN n % 5 < 3 THEN z ELSE 0 END AS z FROM full_),\nm AS (SELECT row, col FROM src WHERE z <> 0),\n" + label_sql("m", "l") + ",\nbig AS (SELECT row, col FROM l WHERE component IN (SELECT component FROM l GROUP BY component HAVING count(*) >= 50)),\n" + HOLES.replace("{mask}", "big") + ",\nhm AS (SELECT row, col, 1 AS one FROM hf),\n" + blur_sql("hm", "mb", {"v": "coalesce(s.one, 0)::DOUBLE"}, DEFAULT.mask_sigma) + ",\nraw AS (SELECT row, col, CASE WHEN v > 0.3 THEN CASE WHEN z <= 0 THEN -50.0 ELSE z END END AS z FROM src JOIN mb USING (row, col)),\n" + blur_sql("raw", "rb", {"zs": "coalesce(s.z, 0)", "ws": "CASE WHEN s.z IS NULL THEN 0 ELSE 1 END"}, DEFAULT.dem_sigma) + " SELECT row, col, round(CASE WHEN z - zs / ws > 50 THEN 0.8 * z + 0.2 * zs / ws ELSE 0.6 * zs / ws + 0.4 * z END, 3) AS z FROM raw JOIN rb USING (row, col) WHERE z IS NOT NULL")
def smooth_mask_and_dem_pipeline(spark, sf_dir):
    cells = raster.grid(N, N, spark).join(fx.grid(spark, sf_dir), ["row", "col"], "left").select("row", "col", F.when(F.coalesce("n", F.lit(0)) % 5 < 3, F.coalesce("z", F.lit(0))).otherwise(0).cast("double").alias("z"))
    return raster.smooth(cells, N, N, fx.SMALL).where("z IS NOT NULL").select("row", "col", r6("z", 3).alias("z"))


ORIGIN = (20.0, 10.0, 0.1)


@query(GRIDDED + """, k AS (SELECT 1 - (1 - 1 / 298.257223563::DOUBLE) * (1 - 1 / 298.257223563::DOUBLE) AS e2), c AS (SELECT *, sqrt(e2) AS e, sin(radians(20)) AS s1, sin(radians(-23)) AS s2, sin(radians(0)) AS s0, sin(radians(10.0 - (row + 0.5) * 0.1)) AS s, 20.0 + (col + 0.5) * 0.1 AS lon FROM grid, k),
q AS (SELECT *, (1 - e2) * (s1 / (1 - e2 * s1 * s1) - ln((1 - e * s1) / (1 + e * s1)) / (2 * e)) AS q1, (1 - e2) * (s2 / (1 - e2 * s2 * s2) - ln((1 - e * s2) / (1 + e * s2)) / (2 * e)) AS q2, (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q, cos(radians(20)) ** 2 / (1 - e2 * s1 * s1) AS m1, cos(radians(-23)) ** 2 / (1 - e2 * s2 * s2) AS m2 FROM c),
n AS (SELECT *, (m1 - m2) / (q2 - q1) AS nn FROM q), r AS (SELECT *, sqrt(m1 + nn * q1 - nn * q) / nn AS rho, sqrt(m1 + nn * q1 - nn * q0) / nn AS rho0 FROM n),
xy AS (SELECT z, 6378137 * rho * sin(nn * radians(lon - 25)) AS x, 6378137 * (rho0 - rho * cos(nn * radians(lon - 25))) AS y FROM r)
SELECT floor(-y / 40000)::INT AS row, floor(x / 40000)::INT AS col, round(avg(z), 6) AS z, count(z) AS n FROM xy GROUP BY 1, 2""")
def resample_to_albers(spark, sf_dir):
    lon0, lat0, size = ORIGIN
    cells = fx.grid(spark, sf_dir)
    x, y = g.albers(lon0 + (F.col("col") + 0.5) * size, lat0 - (F.col("row") + 0.5) * size, *tiles.CONICS["africa"][:4])
    return raster.reproject_average(cells, x, y, 40_000.0).select("row", "col", r6("z").alias("z"), "n")


BRIDGED = _with(fx.CELLS, fx.values("rings", fx.BRIDGE, fx.RING_COLUMNS), EDGES, INSIDE) + f", u AS (SELECT DISTINCT row + a AS row, col + b AS col FROM inside, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1), (2, 0), (-2, 0), (0, 2), (0, -2), (1, 1), (1, -1), (-1, 1), (-1, -1)) s(a, b)), under AS (SELECT * FROM u WHERE row BETWEEN 0 AND {N - 1} AND col BETWEEN 0 AND {N - 1})"


@query(BRIDGED + " SELECT g.row, g.col, round(CASE WHEN u.row IS NULL THEN g.z ELSE (1.5 - 2.0) / 0.002 END, 6) AS z, u.row IS NOT NULL AS marked FROM grid g LEFT JOIN under u USING (row, col)")
def mark_bridges(spark, sf_dir):
    return raster.mark(fx.grid(spark, sf_dir), fx.rings(spark, fx.BRIDGE), N, N).withColumn("z", r6("z"))


@query(BRIDGED + " SELECT 'BRIDGE' AS feature, min(row)::INT AS r0, max(row)::INT AS r1, min(col)::INT AS c0, max(col)::INT AS c1, count(*) AS n FROM under")
def bridge_boxes(spark, sf_dir):
    return raster.boxes(fx.rings(spark, fx.BRIDGE), N, N)


# ---- meshes

QUADS = GRIDDED + f", c AS (SELECT row, col, z FROM grid WHERE n % 5 < 3), q AS (SELECT a.row::BIGINT * {N} + a.col AS i FROM c a JOIN c b ON b.row = a.row AND b.col = a.col + 1 JOIN c d ON d.row = a.row + 1 AND d.col = a.col JOIN c e ON e.row = a.row + 1 AND e.col = a.col + 1), f AS (SELECT 2 * i AS fid, i AS a, i + 1 AS b, i + {N} AS c FROM q UNION ALL SELECT 2 * i + 1, i + 1, i + {N + 1}, i + {N} FROM q)"
DIRECTED = QUADS + ", e AS (SELECT a AS u, b AS v FROM f UNION ALL SELECT b, c FROM f UNION ALL SELECT c, a FROM f)"
RIM = DIRECTED + ", rim AS (SELECT u, v FROM e WHERE (v, u) NOT IN (SELECT u, v FROM e))"
SOLID = RIM + f", s AS (SELECT 'top' AS kind, a, b, c FROM f UNION ALL SELECT 'base', c + {N * N}, b + {N * N}, a + {N * N} FROM f UNION ALL SELECT 'wall', v, u, u + {N * N} FROM rim UNION ALL SELECT 'wall', v, u + {N * N}, v + {N * N} FROM rim)"
VERTICES = f", v AS (SELECT row::BIGINT * {N} + col AS vid, col * 0.25::DOUBLE AS x, row * 0.25::DOUBLE AS y, 2.0::DOUBLE + 0.002::DOUBLE * z AS z FROM c)"


def _faces(spark, sf_dir):
    return mesh.surface_faces(fx.masked(spark, sf_dir), N)


def _vertices(spark, sf_dir):
    return mesh.surface_vertices(fx.masked(spark, sf_dir), N)


def _solid(spark, sf_dir):
    return mesh.solid_faces(_faces(spark, sf_dir), N * N)


@query(QUADS + " SELECT fid, a, b, c FROM f")
def surface_faces(spark, sf_dir):
    return _faces(spark, sf_dir)


@query(RIM + " SELECT u, v FROM rim")
def boundary_edges(spark, sf_dir):
    return mesh.boundary_edges(_faces(spark, sf_dir))


@query(SOLID + " SELECT kind, a, b, c FROM s")
def solid_faces(spark, sf_dir):
    return _solid(spark, sf_dir)


@query(SOLID + """, d AS (SELECT kind <> '' AS solid, a AS u, b AS v FROM s UNION ALL SELECT true, b, c FROM s UNION ALL SELECT true, c, a FROM s UNION ALL SELECT false, u, v FROM e), k AS (SELECT solid, least(u, v) AS lo, greatest(u, v) AS hi, count(*) AS n, count(*) FILTER (u < v) AS up FROM d GROUP BY 1, 2, 3)
SELECT solid, count(*) AS n_edges, bool_and(n = 2) AS is_watertight, bool_and(up <= 1 AND n - up <= 1) AS is_oriented, bool_and(n = 2) AND bool_and(up <= 1 AND n - up <= 1) AS is_volume FROM k GROUP BY solid""")
def watertight_check(spark, sf_dir):
    both = _solid(spark, sf_dir).select(F.lit(True).alias("solid"), "a", "b", "c").unionByName(_faces(spark, sf_dir).select(F.lit(False).alias("solid"), "a", "b", "c"))
    return mesh.soundness(both, ("solid",))


@query(QUADS + VERTICES + " SELECT vid, round(((SELECT max(x) FROM v) - x) * 0.33, 6) AS x, round(y * 0.33, 6) AS y, round(z, 6) AS z FROM v")
def scale_mirror(spark, sf_dir):
    return mesh.scale_mirror(_vertices(spark, sf_dir)).select("vid", *(r6(c).alias(c) for c in "xyz"))


@query(QUADS + VERTICES + " SELECT vid, round(x, 6) AS x, round(y, 6) AS y, round(CASE WHEN on_ THEN greatest(z - 0.5, 2.0) ELSE z END, 6) AS z, on_ AS embossed FROM (SELECT *, vid // 64 % 8 = 0 AND z > 2.1 AS on_ FROM v)")
def emboss_lines(spark, sf_dir):
    lines = raster.grid(N, N, spark).where("row % 8 = 0")
    return mesh.emboss(_vertices(spark, sf_dir), lines, DEFAULT.mm_per_pixel, 0.5).select("vid", *(r6(c).alias(c) for c in "xyz"), "embossed")


BOX = [(8, 12, 44, 56), (10, 14, 50, 60), (30, 30, 0, 63)]


@query(QUADS + VERTICES + ", " + fx.values("b", BOX, ("r0", "r1", "c0", "c1")) + " SELECT vid, x, y, round(CASE WHEN hit THEN 1.5 ELSE z END, 6) AS z, hit AS lowered FROM (SELECT *, z >= 2.0 AND EXISTS (SELECT 1 FROM b WHERE v.x BETWEEN c0 * 0.25 AND (c1 + 1) * 0.25 AND v.y BETWEEN r0 * 0.25 AND (r1 + 1) * 0.25) AS hit FROM v)")
def lower_bridge(spark, sf_dir):
    boxes = spark.createDataFrame(BOX, "r0 int, r1 int, c0 int, c1 int")
    return mesh.lower_in_box(_vertices(spark, sf_dir), boxes).withColumn("z", r6("z"))


CENTRES = [("ALPHA", 6.6, 6.9, True), ("GAMMA", 2.5, 2.5, False), ("AWAY", 99.0, 99.0, False)]


@query(QUADS + VERTICES + ", " + fx.values("p", [(n, x, y, int(b)) for n, x, y, b in CENTRES], ("name", "cx", "cy", "b")) + " SELECT name, cx, cy, count(*) AS near, round(CASE WHEN b = 1 THEN greatest(min(z), (SELECT min(z) FROM v) + 2.0) ELSE (SELECT min(z) FROM v) END, 6) AS bottom_z, round(max(z) + 2.0, 6) AS top_z FROM p JOIN v ON (x - cx) ** 2 + (y - cy) ** 2 <= 16 GROUP BY name, cx, cy, b")
def star_heights(spark, sf_dir):
    centres = spark.createDataFrame(CENTRES, "name string, cx double, cy double, local_base boolean")
    return mesh.star_heights(_vertices(spark, sf_dir), centres).select("name", "cx", "cy", "near", r6("bottom_z").alias("bottom_z"), r6("top_z").alias("top_z"))


SOLID_V = SOLID + VERTICES + f", sv AS (SELECT vid, x, y, z FROM v UNION ALL SELECT vid + {N * N}, x, y, 0.0 FROM v), t AS (SELECT row_number() OVER () AS k, s.*, p.x AS px, p.y AS py, p.z AS pz, q.x AS qx, q.y AS qy, q.z AS qz, r.x AS rx, r.y AS ry, r.z AS rz FROM s JOIN sv p ON p.vid = a JOIN sv q ON q.vid = b JOIN sv r ON r.vid = c), h AS (SELECT k, px AS x0, py AS y0, pz AS z0, qx AS x1, qy AS y1, qz AS z1 FROM t UNION ALL SELECT k, qx, qy, qz, rx, ry, rz FROM t UNION ALL SELECT k, rx, ry, rz, px, py, pz FROM t), cut AS (SELECT k, x0 + (1.0 - z0) / (z1 - z0) * (x1 - x0) AS x, y0 + (1.0 - z0) / (z1 - z0) * (y1 - y0) AS y FROM h WHERE (z0 > 1.0) <> (z1 > 1.0)), seg AS (SELECT k, min((x, y)) AS p, max((x, y)) AS q FROM cut GROUP BY k)"


def _solid_mesh(spark, sf_dir):
    return _solid(spark, sf_dir).withColumn("fid", F.monotonically_increasing_id()), mesh.solid_vertices(_vertices(spark, sf_dir), N * N)


@query(SOLID_V + " SELECT count(*) AS segments, round(sum(sqrt((struct_extract(p, 1) - struct_extract(q, 1)) ** 2 + (struct_extract(p, 2) - struct_extract(q, 2)) ** 2)), 4) AS length, round(min(struct_extract(p, 1)), 6) AS minx, round(max(struct_extract(q, 1)), 6) AS maxx FROM seg")
def mesh_section(spark, sf_dir):
    s = mesh.section(*_solid_mesh(spark, sf_dir), 1.0)
    length = F.sqrt(F.pow(F.col("x0") - F.col("x1"), F.lit(2)) + F.pow(F.col("y0") - F.col("y1"), F.lit(2)))
    return s.agg(F.count("*").alias("segments"), r6(F.sum(length), 4).alias("length"), r6(F.min("x0")).alias("minx"), r6(F.max("x1")).alias("maxx"))


@query(QUADS + VERTICES + ", g AS (SELECT round(x * 2) AS x, round(y * 2) AS y, vid FROM (SELECT floor(x) / 2 AS x, floor(y) / 2 AS y, vid FROM v)), k AS (SELECT vid, min(vid) OVER (PARTITION BY x, y) AS keep FROM g), m AS (SELECT fid, ka.keep AS a, kb.keep AS b, kc.keep AS c FROM f JOIN k ka ON ka.vid = a JOIN k kb ON kb.vid = b JOIN k kc ON kc.vid = f.c), w AS (SELECT *, list_sort([a, b, c]) AS t FROM m WHERE a <> b AND b <> c AND a <> c) SELECT (SELECT count(DISTINCT keep) FROM k) AS vertices, count(*) AS faces, count(DISTINCT t) AS distinct_faces FROM w")
def vertex_merge_and_dedupe_faces(spark, sf_dir):
    coarse = _vertices(spark, sf_dir).select("vid", F.floor("x").cast("double").alias("x"), F.floor("y").cast("double").alias("y"), F.lit(0.0).alias("z"))
    vertices, faces = mesh.merge_vertices(coarse, _faces(spark, sf_dir))
    return vertices.agg(F.count("*").alias("vertices")).crossJoin(faces.agg(F.count("*").alias("faces"))).crossJoin(mesh.distinct_faces(faces).agg(F.count("*").alias("distinct_faces")))


@query(QUADS + VERTICES + " SELECT vid, round_even(y / 0.5, 0)::INT AS row, round_even(x / 0.5, 0)::INT AS col, z BETWEEN 1.9 AND 2.5 AS in_band FROM v")
def vertex_cell_lookup(spark, sf_dir):
    return mesh.cell_of(_vertices(spark, sf_dir), 0.5).select("vid", "row", "col", F.col("z").between(1.9, 2.5).alias("in_band"))


@query(SOLID_V + " SELECT round(min(x), 6) AS minx, round(max(x), 6) AS maxx, round(max(x) - min(x), 6) AS size_x, round(min(y), 6) AS miny, round(max(y), 6) AS maxy, round(max(y) - min(y), 6) AS size_y, round(min(z), 6) AS minz, round(max(z), 6) AS maxz, round(max(z) - min(z), 6) AS size_z FROM sv")
def mesh_extents(spark, sf_dir):
    got = mesh.extents(mesh.solid_vertices(_vertices(spark, sf_dir), N * N))
    return got.select(*(r6(c).alias(c) for c in got.columns))


PROBES = [(f"p{i}", 0.1 + i * 0.777, 0.13 + i * 0.511) for i in range(20)]


@query(SOLID_V + ", " + fx.values("pr", PROBES, ("name", "px", "py")) + ", k AS (SELECT name, count(p) FILTER ((struct_extract(p, 2) > py) <> (struct_extract(q, 2) > py) AND px < struct_extract(p, 1) + (py - struct_extract(p, 2)) * (struct_extract(q, 1) - struct_extract(p, 1)) / nullif(struct_extract(q, 2) - struct_extract(p, 2), 0)) AS n FROM pr LEFT JOIN seg ON true GROUP BY name) SELECT name, n % 2 = 0 AS has_hole, CASE WHEN n % 2 = 0 THEN 100.0 ELSE 0.0 END::DOUBLE AS hole_coverage, CASE WHEN n % 2 = 0 THEN 'hole found' ELSE 'solid at the capital' END AS message FROM k")
def star_hole_check(spark, sf_dir):
    points = spark.createDataFrame(PROBES, "name string, x double, y double")
    return checks.star_holes(points, mesh.section(*_solid_mesh(spark, sf_dir), 1.0))


@query(QUADS + " SELECT row_number() OVER (ORDER BY fid) - 1 AS number, fid, a, b, c FROM f")
def ordered_faces(spark, sf_dir):
    return mesh.ordered_faces(_faces(spark, sf_dir))


# ---- quality


SHIFTED = SHAPED + ",\n" + INSIDE + ", foot AS (SELECT feature, row - 1 AS row, col + 2 AS col FROM inside WHERE (row * 7 + col) % 29 <> 0 UNION ALL SELECT 'ALPHA', 60, 60)"


def _cells(spark):
    return raster.rasterize(fx.rings(spark))


def _footprint(spark):
    moved = _cells(spark).where("(row * 7 + col) % 29 <> 0").select("feature", (F.col("row") - 1).alias("row"), (F.col("col") + 2).alias("col"))
    return moved.unionByName(spark.createDataFrame([("ALPHA", 60, 60)], "feature string, row int, col int"))


@query(SHIFTED + """, o AS (SELECT feature, count(i.row) AS boundary, count(f.row) AS footprint, count(*) FILTER (i.row IS NOT NULL AND f.row IS NOT NULL) AS shared FROM inside i FULL JOIN foot f USING (feature, row, col) GROUP BY feature)
SELECT feature, boundary, footprint, shared, boundary - shared AS missing, footprint - shared AS extra, round(100.0 * footprint / boundary, 6) AS coverage_pct, round(100.0 * (boundary - shared) / boundary, 6) AS missing_pct, 100.0 * (boundary - shared) / boundary <= 5 AS passed, CASE WHEN 100 - 100.0 * (boundary - shared) / boundary >= 98 THEN 'excellent' WHEN 100 - 100.0 * (boundary - shared) / boundary >= 95 THEN 'good' WHEN 100 - 100.0 * (boundary - shared) / boundary >= 90 THEN 'acceptable' ELSE 'poor' END AS grade FROM o""")
def coverage_missing_extra(spark, sf_dir):
    got = checks.overlap(_cells(spark), _footprint(spark))
    return got.withColumns({"coverage_pct": r6("coverage_pct"), "missing_pct": r6("missing_pct")})


@query(SHIFTED + ", h AS (SELECT i.feature, f.col - i.col AS dx, f.row - i.row AS dy, count(*) AS covered FROM inside i JOIN foot f ON f.feature = i.feature AND f.col - i.col BETWEEN -30 AND 30 AND f.row - i.row BETWEEN -30 AND 30 GROUP BY 1, 2, 3) SELECT feature, dx::INT AS dx, dy::INT AS dy, covered FROM h QUALIFY row_number() OVER (PARTITION BY feature ORDER BY covered DESC, dx, dy) = 1")
def alignment_grid_search(spark, sf_dir):
    return checks.best_shift(_cells(spark), _footprint(spark), 30)


STEPS = _with(fx.values("rings", [*fx.STAIRS, *fx.RINGS], fx.RING_COLUMNS), EDGES) + """, a AS (SELECT *, ((degrees(atan2(y2 - y, x2 - x)) % 360) + 360) % 360 AS angle, sqrt((x2 - x) ** 2 + (y2 - y) ** 2) AS len FROM edges), d AS (SELECT *, CASE WHEN angle < 5 OR angle > 355 OR abs(angle - 180) < 5 THEN 'H' WHEN abs(angle - 90) < 5 OR abs(angle - 270) < 5 THEN 'V' END AS way FROM a)"""


@query(STEPS + """, w AS (SELECT feature, way, lead(way, 1) OVER o AS w1, lead(way, 2) OVER o AS w2 FROM d WHERE len > 0.1 WINDOW o AS (PARTITION BY feature, part, ring ORDER BY seq)), k AS (SELECT feature, count(*) AS total_boundary_edges, count(*) FILTER (way = w2 AND way <> w1) AS stair_step_count FROM w GROUP BY feature)
SELECT feature, total_boundary_edges, stair_step_count, round(CASE WHEN total_boundary_edges > 2 THEN stair_step_count / (total_boundary_edges - 2) ELSE 0 END, 6) AS stair_step_ratio, CASE WHEN total_boundary_edges > 2 THEN stair_step_count / (total_boundary_edges - 2) ELSE 0 END > 0.15 AS is_aliased, 0.15::DOUBLE AS threshold FROM k""")
def stair_step_ratio(spark, sf_dir):
    return checks.stair_steps(g.edges(fx.rings(spark, [*fx.STAIRS, *fx.RINGS]))).withColumn("stair_step_ratio", r6("stair_step_ratio"))


@query(STEPS + " SELECT feature, count(*) AS edges, count(way) AS aligned, round(count(way) / count(*), 6) AS ratio, count(way) / count(*) < 0.5 AS is_smooth FROM d WHERE len > 0.01 GROUP BY feature")
def axis_aligned_ratio(spark, sf_dir):
    return checks.axis_aligned(g.edges(fx.rings(spark, [*fx.STAIRS, *fx.RINGS]))).withColumn("ratio", r6("ratio"))


@query(MEASURES + " SELECT feature, part, ring, round(area, 6) AS area FROM m WHERE area > 50")
def section_polygon_filter(spark, sf_dir):
    return checks.keep_sections(g.ring_measures(fx.rings(spark)), 50.0).select("feature", "part", "ring", r6("area").alias("area"))


# ---- kernels, by what can be measured of their results



def _clip_area(subject: str, window: str) -> str:
    """SQL for the area that two triangles (or a convex ring) share, by cutting both at every crossing: cells of a fine raster would
    only be near it, so the corners are found and ordered around their middle."""
    return f"""c AS (SELECT x, y FROM {subject} e WHERE (SELECT bool_and((w.x2 - w.x) * (e.y - w.y) - (w.y2 - w.y) * (e.x - w.x) >= -1e-9) FROM {window} w)
UNION SELECT x, y FROM {window} w WHERE (SELECT bool_and((e.x2 - e.x) * (w.y - e.y) - (e.y2 - e.y) * (w.x - e.x) >= -1e-9) FROM {subject} e)
UNION SELECT round(e.x + t * (e.x2 - e.x), 9), round(e.y + t * (e.y2 - e.y), 9) FROM (SELECT e.*, ((w.x - e.x) * (w.y2 - w.y) - (w.y - e.y) * (w.x2 - w.x)) / nullif((e.x2 - e.x) * (w.y2 - w.y) - (e.y2 - e.y) * (w.x2 - w.x), 0) AS t, ((w.x - e.x) * (e.y2 - e.y) - (w.y - e.y) * (e.x2 - e.x)) / nullif((e.x2 - e.x) * (w.y2 - w.y) - (e.y2 - e.y) * (w.x2 - w.x), 0) AS u FROM {subject} e, {window} w) e WHERE t BETWEEN 0 AND 1 AND u BETWEEN 0 AND 1),
o AS (SELECT x, y, lead(x) OVER k AS nx, lead(y) OVER k AS ny, first_value(x) OVER k AS fx_, first_value(y) OVER k AS fy_ FROM c WINDOW k AS (ORDER BY atan2(y - (SELECT avg(y) FROM c), x - (SELECT avg(x) FROM c)))),
area AS (SELECT abs(sum(x * coalesce(ny, fy_) - coalesce(nx, fx_) * y)) / 2 AS a FROM o)"""


LAKE2 = _with(fx.SHAPES, fx.WATERS, EDGES, fx.edges_of("lakes", "lake_edges"))


@query(LAKE2 + ", be AS (SELECT * FROM edges WHERE feature = 'BETA'), le AS (SELECT * FROM lake_edges WHERE feature = 'LAKE_2'),\n" + _clip_area("be", "le") + " SELECT * FROM (SELECT 'ALPHA' AS feature, round(1634 - 92 - (46 - a), 6) AS area, 2::BIGINT AS holes FROM area UNION ALL SELECT 'BETA', round(252 - a, 6), 0 FROM area)")
def countries_minus_lakes(spark, sf_dir):
    rings, lakes = fx.rings(spark), fx.rings(spark, fx.LAKES)
    areas = g.measures(lakes).where("area >= 10").select(F.col("feature").alias("right"))
    pairs = vector.box_pairs(rings, lakes).join(areas, "right", "left_semi")
    return g.measures(overlay.combine(rings, lakes, pairs, "difference")).select("feature", r6("area").alias("area"), "holes")


@query("SELECT 'DENSE' AS feature, 0 AS part, 0 AS ring, 4::BIGINT AS points, 100.0::DOUBLE AS area UNION ALL SELECT feature, part, ring, count(*), round(abs(sum(x * y2 - x2 * y)) / 2, 6) FROM (" + SHAPED + "SELECT * FROM edges WHERE feature = 'BETA') GROUP BY ALL")
def simplify_ring(spark, sf_dir):
    dense = [("DENSE", 0, 0, i, x, y) for i, (x, y) in enumerate([(t, 0.001 * (t % 2)) for t in map(float, range(10))] + [(10.0, t) for t in map(float, range(10))] + [(10.0 - t, 10.0) for t in map(float, range(10))] + [(0.0, 10.0 - t) for t in map(float, range(10))])]
    got = overlay.simplify(fx.rings(spark, [*dense, *(r for r in fx.RINGS if r[0] == "BETA")]), 0.02)
    return g.ring_measures(got).select("feature", "part", "ring", "points", r6("area").alias("area"))




@query(MEASURES + " SELECT feature, round(sum(CASE WHEN ring = 0 THEN area ELSE -area END), 4) AS area, true AS is_volume FROM m GROUP BY feature")
def prism_clip_area(spark, sf_dir):
    flat = raster.grid(N, N, spark).withColumn("z", F.col("row") + F.col("col"))
    cells = mesh.surface_faces(flat, N)
    vertices = mesh.surface_vertices(flat, N, p=DEFAULT.with_(mm_per_pixel=1.0))
    pieces = overlay.clip_faces(mesh.with_corners(cells, vertices), overlay.triangles(fx.rings(spark)), 8.0)
    v, f = overlay.clipped_mesh(pieces)
    sound = mesh.soundness(mesh.solid_faces(f, overlay.SHIFT).select("a", "b", "c"))
    area = overlay.piece_areas(pieces).select("feature", r6("area", 4).alias("area"))
    return area.crossJoin(sound.select("is_volume"))


def _whole_solid(spark, sf_dir):
    """mesh_id, ax to cz: the solid under all N x N cells; those without lines lie at 0."""
    full = raster.grid(N, N, spark).join(fx.grid(spark, sf_dir).select("row", "col", "z"), ["row", "col"], "left").withColumn("z", F.coalesce("z", F.lit(0)))
    faces = mesh.solid_faces(mesh.surface_faces(full, N), N * N).withColumn("fid", F.monotonically_increasing_id())
    return mesh.with_corners(faces, mesh.solid_vertices(mesh.surface_vertices(full, N), N * N)).withColumn("mesh_id", F.lit("m"))


@query(GRIDDED + "SELECT (4 * max(row) * max(col) + 4 * (max(row) + max(col)))::BIGINT AS faces_before, true AS reached, true AS is_volume, max(col) * 0.25::DOUBLE AS size_x, max(row) * 0.25::DOUBLE AS size_y FROM grid")
def decimate_mesh(spark, sf_dir):
    whole = _whole_solid(spark, sf_dir)
    small = written(overlay.decimate(whole, target=200))
    corner = lambda c: F.xxhash64(*(F.round(f"{c}{k}", 9) for k in "xyz")).alias(c)
    size = lambda k: r6(F.max(F.greatest(*(f"{c}{k}" for c in "abc"))) - F.min(F.least(*(f"{c}{k}" for c in "abc")))).alias(f"size_{k}")
    before = whole.agg(F.count("*").alias("faces_before"))
    return small.agg((F.count("*") <= 200).alias("reached"), size("x"), size("y")).crossJoin(before).crossJoin(mesh.soundness(small.select(corner("a"), corner("b"), corner("c"))).select("is_volume"))


@query("SELECT * FROM (VALUES ('box', 900.0::DOUBLE, 1::BIGINT), ('extruded', 120.0::DOUBLE, 16::BIGINT), ('mended', 120.0::DOUBLE, 16::BIGINT), ('repaired', 50.0::DOUBLE, 2::BIGINT), ('union', 175.0::DOUBLE, 1::BIGINT)) t(what, measure, n)")
def union_and_overlay_area(spark, sf_dir):
    square = lambda name, x, y, s: [(name, 0, 0, i, float(a), float(b)) for i, (a, b) in enumerate([(x, y), (x + s, y), (x + s, y + s), (x, y + s)])]
    one = lambda what, df, value, n="feature": df.select(F.lit(what).alias("what"), r6(value).alias("measure"), F.col(n).cast("bigint").alias("n"))
    overlap = fx.rings(spark, [*square("a", 0, 0, 10), *square("b", 5, 5, 10)])
    parts = lambda r: g.measures(r).crossJoin(r.agg(F.countDistinct("part").alias("parts")))
    union = one("union", parts(overlay.dissolve(overlap)), "area", "parts")
    box = one("box", parts(overlay.intersect_box(fx.rings(spark, square("c", -10, -10, 50)), (0.0, 0.0, 30.0, 60.0))).withColumn("area", F.col("area") - 300), "area", "parts")
    bow = fx.rings(spark, [("bow", 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 10.0), (10.0, 0.0), (0.0, 10.0)])])
    fixed = one("repaired", parts(overlay.repair(bow)), "area", "parts")
    ell = fx.rings(spark, [("ell", 0, 0, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (8.0, 0.0), (8.0, 4.0), (0.0, 4.0)])] + [("ell", 0, 1, i, x, y) for i, (x, y) in enumerate([(3.0, 1.0), (5.0, 1.0), (5.0, 2.0), (3.0, 2.0)])])
    prism = overlay.extruded(ell, 4.0)
    six = (F.col("ax") * (F.col("by") * F.col("cz") - F.col("bz") * F.col("cy")) + F.col("ay") * (F.col("bz") * F.col("cx") - F.col("bx") * F.col("cz")) + F.col("az") * (F.col("bx") * F.col("cy") - F.col("by") * F.col("cx"))) / 6
    extruded = one("extruded", prism.agg(F.sum(six).alias("v"), F.count_if(F.col("kind") != "wall").alias("n")), "v", "n")
    soup = prism.withColumn("mesh_id", F.lit("ell"))
    mended = one("mended", overlay.mend(soup).agg(F.sum(six).alias("v"), F.count_if((F.col("az") == F.col("bz")) & (F.col("bz") == F.col("cz"))).alias("n")), "v", "n")
    return union.unionByName(box).unionByName(fixed).unionByName(extruded).unionByName(mended)


from cairn.plans import shapes  # noqa: E402,F401  registers its queries
