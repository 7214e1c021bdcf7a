"""Geometry and spatial join queries (G)."""

from pyspark.sql import functions as F

from busloom.functions import geo
from busloom.operators import polyline as PL
from busloom.operators import spatial as S
from busloom.operators.dbscan import near_components
from busloom.plans.q_delay import rounded
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle

derive("poly", ["track_points"], """
SELECT *, sqrt(len2) + s0 AS s1 FROM (
  SELECT *, coalesce(sum(sqrt(len2)) OVER (PARTITION BY linha ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s0,
    row_number() OVER (PARTITION BY linha ORDER BY seq) - 1 AS seg
  FROM (SELECT *, CASE WHEN vx * vx + vy * vy = 0 THEN 1e-9 ELSE CAST(vx * vx + vy * vy AS DOUBLE) END AS len2 FROM (
    SELECT linha, seq, x AS ax, y AS ay, lead(x) OVER w - x AS vx, lead(y) OVER w - y AS vy FROM track_points
    WINDOW w AS (PARTITION BY linha ORDER BY seq)) WHERE vx IS NOT NULL))
""")


def segs_of(b):
    return PL.polyline_segments(b.track_points, "linha", "seq")


@query("g01_haversine", oracle("positions", f"""
SELECT event_id, round({geo.sql_haversine('lat', 'lon', '-23.5505', '-46.6333')}, 3) AS dist_m FROM positions"""))
def g01(spark, sf):
    p = Bus(spark, sf).positions
    return p.select("event_id", F.round(geo.haversine_m("lat", "lon", -23.5505, -46.6333), 3).alias("dist_m"))


@query("g02_bearing", oracle("positions", """
SELECT event_id, round(((degrees(atan2(sin(o2 - o1) * cos(a2), cos(a1) * sin(a2) - sin(a1) * cos(a2) * cos(o2 - o1))) + 360.0) % 360.0 + 360.0) % 360.0, 4) AS rumo
FROM (SELECT event_id, radians(-23.5505) AS a1, radians(-46.6333) AS o1, radians(lat) AS a2, radians(lon) AS o2 FROM positions)"""))
def g02(spark, sf):
    p = Bus(spark, sf).positions
    return p.select("event_id", F.round(geo.bearing_deg(-23.5505, -46.6333, "lat", "lon"), 4).alias("rumo"))


@query("g03_projection", oracle("positions", f"""
SELECT event_id, round({geo.sql_x('lon')}, 4) AS x, round({geo.sql_y('lat')}, 4) AS y, round(lat, 7) AS lat2, round(lon, 7) AS lon2 FROM positions"""))
def g03(spark, sf):
    p = Bus(spark, sf).positions.withColumns({"x": geo.to_x("lon"), "y": geo.to_y("lat")})
    return p.select("event_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
                    F.round(geo.to_lat("y"), 7).alias("lat2"), F.round(geo.to_lon("x"), 7).alias("lon2"))


#: Transverse Mercator by Krueger's series in the third flattening, another form than the one under test.
UTM_SQL = """
, k AS (SELECT event_id, radians(lat) AS phi, radians(lon + 45) AS lam, 1 / 298.257222101 / (2 - 1 / 298.257222101) AS n FROM positions),
t AS (SELECT *, sinh(atanh(sin(phi)) - 2 * sqrt(n) / (1 + n) * atanh(2 * sqrt(n) / (1 + n) * sin(phi))) AS tau FROM k),
u AS (SELECT *, atan2(tau, cos(lam)) AS xi, asinh(sin(lam) / sqrt(tau * tau + cos(lam) * cos(lam))) AS eta,
  0.9996 * 6378137.0 / (1 + n) * (1 + n * n / 4 + n ** 4 / 64) AS a,
  n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1, 13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3, 49561 * n ** 4 / 161280 AS a4 FROM t)
SELECT event_id, round(500000 + a * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta) + a4 * cos(8 * xi) * sinh(8 * eta)), 2) AS x,
  round(10000000 + a * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta) + a4 * sin(8 * xi) * cosh(8 * eta)), 2) AS y FROM u"""


@query("g04_utm_projection", oracle("positions", UTM_SQL.strip()))
def g04(spark, sf):
    east, north = geo.utm_xy("lat", "lon")
    return Bus(spark, sf).positions.select("event_id", F.round(east, 2).alias("x"), F.round(north, 2).alias("y"))


@query("g05_polyline_segments", oracle("poly", """
SELECT linha, CAST(seg AS INTEGER) AS seg, round(s0, 4) AS s0, round(s1, 4) AS s1 FROM poly"""))
def g05(spark, sf):
    return rounded(segs_of(Bus(spark, sf)), "s0", "s1", digits=4).select("linha", "seg", "s0", "s1")


_FOOT = """SELECT p.linha, p.pid, seg, s0 + t * sqrt(len2) AS s, sqrt(pow(ax + t * vx - x, 2) + pow(ay + t * vy - y, 2)) AS dist
FROM (SELECT p.*, o.seg, o.s0, o.ax, o.ay, o.vx, o.vy, o.len2,
    least(1.0, greatest(0.0, ((x - ax) * vx + (y - ay) * vy) / len2)) AS t FROM probes p JOIN poly o ON o.linha = p.linha) p"""


@query("g06_project_points", oracle("probes poly", f"""
SELECT p.pid, round(dist, 4) AS dist, round(s, 3) AS s FROM probes p LEFT JOIN (
  SELECT * FROM ({_FOOT}) WHERE dist <= 60
  QUALIFY row_number() OVER (PARTITION BY pid ORDER BY dist, seg) = 1) q ON q.pid = p.pid"""))
def g06(spark, sf):
    b = Bus(spark, sf)
    out = PL.project_points(b.probes, segs_of(b), "linha", "pid", 60.0)
    return out.select("pid", F.round("dist", 4).alias("dist"), F.round("s", 3).alias("s"))


@query("g07_anchored_projection")
def g07(spark, sf):
    b = Bus(spark, sf)
    pts = b.probes.withColumn("dia", F.floor(F.col("pid") / 1000))
    out = PL.project_track(pts, segs_of(b), "linha", ["dia"], "pid")
    return rounded(out, "s", "dist", digits=3)


@query("g08_point_at", oracle("probes poly", """
, e AS (SELECT linha, max(s1) AS fim FROM poly GROUP BY 1), q AS (
  SELECT pid, linha, least(greatest(CAST(pid * 5 % 40000 AS DOUBLE), 0), fim) AS s FROM probes JOIN e USING (linha)),
m AS (SELECT q.*, ax + (s - s0) / sqrt(len2) * vx AS px, ay + (s - s0) / sqrt(len2) * vy AS py
  FROM q ASOF JOIN poly ON q.linha = poly.linha AND q.s >= poly.s0)
SELECT pid, round(px, 3) AS x, round(py, 3) AS y FROM m""".strip()))
def g08(spark, sf):
    b = Bus(spark, sf)
    q = b.probes.select("linha", "pid", (F.col("pid") * 5 % 40000).alias("alvo"))
    return rounded(PL.point_at(q, segs_of(b), "linha", "alvo"), "x", "y", digits=3).select("pid", "x", "y")


@query("g09_resample", oracle("poly", """
, e AS (SELECT linha, max(s1) AS fim FROM poly GROUP BY 1),
g AS (SELECT linha, fim, unnest(list_concat(list_transform(generate_series(0, CAST(floor(fim / 500) AS BIGINT)), lambda i: i * 500.0),
    CASE WHEN floor(fim / 500) * 500.0 < fim THEN [fim] ELSE [] END)) AS s FROM e),
q AS (SELECT linha, s, o, least(greatest(s + o, 0), fim) AS a FROM g, (VALUES (0.0), (-5.0), (5.0)) v(o)),
p AS (SELECT q.linha, q.s, q.o, ax + least(1.0, (a - s0) / sqrt(len2)) * vx AS x, ay + least(1.0, (a - s0) / sqrt(len2)) * vy AS y
  FROM q ASOF JOIN poly ON q.linha = poly.linha AND q.a >= poly.s0),
t AS (SELECT linha, s, max(x) FILTER (o = 0) AS x, max(y) FILTER (o = 0) AS y, max(x) FILTER (o = 5) - max(x) FILTER (o = -5) AS dx,
  max(y) FILTER (o = 5) - max(y) FILTER (o = -5) AS dy FROM p GROUP BY 1, 2)
SELECT linha, round(s, 3) AS s, round(x, 3) AS x, round(y, 3) AS y, round(dx / sqrt(dx * dx + dy * dy), 4) AS ux,
  round(dy / sqrt(dx * dx + dy * dy), 4) AS uy FROM t""".strip()))
def g09(spark, sf):
    r = PL.resample(segs_of(Bus(spark, sf)), "linha", 500.0)
    return rounded(rounded(r, "s", "x", "y", digits=3), "ux", "uy", digits=4)


@query("g10_simplify", oracle("track_points", """
, t AS (SELECT *, row_number() OVER (PARTITION BY linha ORDER BY seq) AS i, count(*) OVER (PARTITION BY linha) AS n FROM track_points),
r AS (SELECT linha, CAST(1 AS BIGINT) AS a, n AS b FROM t WHERE i = 1 UNION ALL (
  SELECT linha, CASE WHEN h = 0 THEN a ELSE k END AS a, CASE WHEN h = 0 THEN k ELSE b END AS b FROM (
    SELECT r.linha, r.a, r.b, m.i AS k, m.x - p.x AS px, m.y - p.y AS py, q.x - p.x AS vx, q.y - p.y AS vy,
      CASE WHEN vx * vx + vy * vy > 0 THEN least(1.0, greatest(0.0, (px * vx + py * vy) / (vx * vx + vy * vy))) ELSE 0.0 END AS f, round(sqrt(pow(px - f * vx, 2) + pow(py - f * vy, 2)), 6) AS dist
    FROM r JOIN t m ON m.linha = r.linha AND m.i > r.a AND m.i < r.b JOIN t p ON p.linha = r.linha AND p.i = r.a JOIN t q ON q.linha = r.linha AND q.i = r.b
    QUALIFY row_number() OVER (PARTITION BY r.linha, r.a, r.b ORDER BY dist DESC, m.i) = 1) far, (VALUES (0), (1)) s(h) WHERE dist > 60))
SELECT linha, seq, x, y FROM t WHERE i = 1 OR EXISTS (SELECT 1 FROM r WHERE r.linha = t.linha AND r.b = t.i)""".strip()).replace("WITH ", "WITH RECURSIVE ", 1))
def g10(spark, sf):
    return PL.simplify(Bus(spark, sf).track_points, "linha", "seq", 60.0)


@query("g11_cells", oracle("positions", f"""
SELECT {geo.sql_cell('lat', 'lon', 8)} AS celula, count(*) AS n FROM positions GROUP BY 1"""))
def g11(spark, sf):
    return Bus(spark, sf).positions.groupBy(geo.cell_id("lat", "lon", 8).alias("celula")).agg(F.count("*").alias("n"))


@query("g12_radius_search", oracle("positions", f"""
SELECT event_id, round(d, 3) AS dist_m FROM (SELECT event_id, {geo.sql_haversine('lat', 'lon', '-23.55', '-46.63')} AS d FROM positions) WHERE d <= 1500"""))
def g12(spark, sf):
    return rounded(S.near_point(Bus(spark, sf).positions, -23.55, -46.63, 1500.0), "dist_m", digits=3).select("event_id", "dist_m")


def xy(df):
    return df.withColumns({"x": geo.to_x("lon"), "y": geo.to_y("lat")})


derive("pos_xy", ["positions"], f"SELECT event_id, {geo.sql_x('lon')} AS x, {geo.sql_y('lat')} AS y FROM positions")
derive("stop_xy", ["stops"], f"SELECT cp, {geo.sql_x('lon')} AS sx, {geo.sql_y('lat')} AS sy FROM stops")
derive("pos_stop", ["pos_xy", "stop_xy"], "SELECT event_id, cp, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS dist FROM pos_xy, stop_xy")


def sides(spark, sf):
    b = Bus(spark, sf)
    return xy(b.positions).select("event_id", "x", "y"), xy(b.stops).select("cp", "x", "y")


@query("g13_radius_join", oracle("pos_stop", "SELECT event_id, cp, round(dist, 3) AS dist FROM pos_stop WHERE dist <= 400"))
def g13(spark, sf):
    return rounded(S.radius_join(*sides(spark, sf), 400.0), "dist", digits=3).select("event_id", "cp", "dist")


@query("g14_nearest_k", oracle("pos_stop", """
SELECT event_id, cp, CAST(row_number() OVER w AS INTEGER) AS posicao FROM pos_stop WHERE dist <= 900
WINDOW w AS (PARTITION BY event_id ORDER BY dist, cp) QUALIFY row_number() OVER w <= 6"""))
def g14(spark, sf):
    return S.nearest_k(*sides(spark, sf), "event_id", "cp", 6, 900.0).select("event_id", "cp", "posicao")


@query("g15_id_or_nearest", oracle("pos_xy stop_xy", """
, l AS (SELECT event_id AS cod, x, y FROM pos_xy), n AS (
  SELECT cod, cp, sqrt(pow(x - sx, 2) + pow(y - sy, 2)) AS d FROM l, stop_xy WHERE cod NOT IN (SELECT cp FROM stop_xy)),
b AS (SELECT cod, arg_min(cp, (d, cp)) AS cp FROM n WHERE d <= 80 GROUP BY cod)
SELECT cod, CASE WHEN s.cp IS NOT NULL THEN cod ELSE b.cp END AS cp, CASE WHEN s.cp IS NOT NULL THEN 'id' WHEN b.cp IS NOT NULL THEN 'posicao' END AS modo
FROM l LEFT JOIN stop_xy s ON s.cp = cod LEFT JOIN b USING (cod)""".strip()))
def g15(spark, sf):
    left, right = sides(spark, sf)
    return S.match_by_id_or_place(left.withColumnRenamed("event_id", "cod"), right, "cod", "cp", 80.0).select("cod", "cp", "modo")


derive("located", ["positions", "zone_edges"], """
SELECT event_id, arg_min(zona, ordem) AS zona FROM (
  SELECT p.event_id, z.zona, z.ordem FROM positions p JOIN zone_edges z
    ON (z.y1 > p.lat) <> (z.y2 > p.lat) AND p.lon < (z.x2 - z.x1) * (p.lat - z.y1) / (z.y2 - z.y1) + z.x1
  GROUP BY 1, 2, 3 HAVING count(*) % 2 = 1) GROUP BY event_id
""")

ZONE_CELL = 0.01


@query("g16_point_in_zone", oracle("positions located", """
SELECT p.event_id, zona FROM positions p LEFT JOIN located USING (event_id)"""))
def g16(spark, sf):
    b = Bus(spark, sf)
    cells = S.zone_cells(b.zone_edges, "zona", "ordem", ZONE_CELL)
    return S.locate(b.positions, cells, ZONE_CELL).select("event_id", "zona")


# a pair of points is an edge of the hull if no point of the group lies right of it or further along it
derive("hulls", ["points"], """
WITH p AS (SELECT DISTINCT label, x, y FROM points WHERE label IS NOT NULL),
e AS (SELECT a.label, a.x, a.y FROM p a JOIN p b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y) WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.label = a.label
  AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - b.x) * (b.x - a.x) + (c.y - b.y) * (b.y - a.y) > 0)
    OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (b.x - a.x) + (c.y - a.y) * (b.y - a.y) < 0)))),
w AS (SELECT *, atan2(y - avg(y) OVER k, x - avg(x) OVER k) AS g FROM e WINDOW k AS (PARTITION BY label)),
o AS (SELECT *, arg_min(g, (x, y)) OVER (PARTITION BY label) AS g0 FROM w)
SELECT label, count(*) AS vertices, concat('[', string_agg(concat('[', x, ',', y, ']'), ',' ORDER BY CASE WHEN g < g0 THEN 1 ELSE 0 END, g), ',', arg_min(concat('[', x, ',', y, ']'), (x, y)), ']') AS anel
FROM o GROUP BY label HAVING count(*) > 2""")


@query("g17_convex_hull", oracle("hulls", "SELECT label, CAST(vertices AS INTEGER) AS vertices, anel FROM hulls"))
def g17(spark, sf):
    return S.convex_hulls(Bus(spark, sf).points, "label").select("label", "vertices", F.to_json("anel").alias("anel"))


@query("g18_components", oracle("points", """
, e AS (SELECT a.vec_id AS u, b.vec_id AS v FROM points a JOIN points b ON a.vec_id <> b.vec_id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 6400),
r AS (SELECT vec_id AS v, vec_id AS c FROM points UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.v)
SELECT v, min(c) AS component FROM r GROUP BY v""".strip()).replace("WITH ", "WITH RECURSIVE ", 1))
def g18(spark, sf):
    p = Bus(spark, sf).points.select("vec_id", "x", "y")
    return near_components(p, "vec_id", "x", "y", 80.0).withColumnRenamed("vec_id", "v")


@query("g19_grid_snap", oracle("positions", """
SELECT greatest(least(round(lat / 0.05) * 0.05, -23.4), -23.6) AS la, round(lon / 0.05) * 0.05 AS lo, count(*) AS n FROM positions GROUP BY 1, 2"""))
def g19(spark, sf):
    p = Bus(spark, sf).positions
    return p.groupBy(geo.snap("lat", 0.05, -23.6, -23.4).alias("la"), geo.snap("lon", 0.05).alias("lo")).agg(F.count("*").alias("n"))


@query("g20_geojson", oracle("positions", """
SELECT event_id, 'Point' AS tipo, round(lon, 9) AS c0, round(lat, 9) AS c1 FROM positions"""))
def g20(spark, sf):
    p = Bus(spark, sf).positions.withColumn("g", geo.geojson_point("lat", "lon"))
    return p.select("event_id", F.col("g.type").alias("tipo"), F.round(F.col("g.coordinates")[0], 9).alias("c0"),
                    F.round(F.col("g.coordinates")[1], 9).alias("c1"))
