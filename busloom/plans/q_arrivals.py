"""Arrival, fleet and layer queries (A, V)."""

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.functions import geo
from busloom.functions.geo import ANCHOR_LAT, ANCHOR_LON, M_PER_LAT, M_PER_LON, num, sql_haversine
from busloom.operators import arrivals as A
from busloom.operators import fleet as V
from busloom.operators import polyline as PL
from busloom.plans.q_delay import epoch, rounded, seg_of
from busloom.plans.q_features import ID, recent_sql
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_hour, sql_weekday
from busloom.session import cut_lineage


def ll(df, la="lat", lo="lon"):
    return df.withColumns({la: geo.to_lat("y"), lo: geo.to_lon("x")})


LL = f"y / {num(M_PER_LAT)} + {num(ANCHOR_LAT)} AS lat, x / {num(M_PER_LON)} + {num(ANCHOR_LON)} AS lon"


def shapes(b):
    """A straight street per line, one vertex every 100 m."""
    n = F.sequence(F.lit(0), F.lit(40))
    return b.gps_stops.select("cl", "y").distinct().select("cl", F.explode(n).alias("seq"), "y").select("cl", "seq", (F.col("seq") * 100.0).alias("x"), "y")


@query("a01_continuous_blocks", oracle("gps", """
, c AS (SELECT *, CASE WHEN ta - lag(ta) OVER w > 40000 THEN 1 ELSE 0 END AS corte FROM gps WINDOW w AS (PARTITION BY cl, prefixo ORDER BY ta, rid)),
b AS (SELECT *, sum(corte) OVER (PARTITION BY cl, prefixo ORDER BY ta, rid) AS bloco FROM c)
SELECT cl, prefixo, CAST(bloco AS BIGINT) AS bloco, count(*) AS pontos FROM b GROUP BY 1, 2, 3 HAVING count(*) >= 5""".strip()))
def a01(spark, sf):
    d = A.continuous_blocks(Bus(spark, sf).gps, 40000.0, p=A.Params(min_track_points=5))
    return d.groupBy("cl", "prefixo", "bloco").agg(F.count("*").alias("pontos"))


@query("a02_observed_shape")
def a02(spark, sf):
    b = Bus(spark, sf)
    return A.observed_shape(b.gps, b.gps_stops, p=A.Params(min_track_points=5)).groupBy("cl").agg(F.count("*").alias("pontos"), F.max("cobertura").alias("cobertura"), F.max("nota").alias("nota"))


@query("a03_shape_coverage", oracle("gps_stops", """
SELECT cl, avg(CASE WHEN d <= 120 THEN 1.0 ELSE 0.0 END) AS cobertura, 4000.0 AS comprimento_m, median(d) AS dist_mediana_m FROM (
  SELECT cl, CASE WHEN cp % 4 = 0 THEN 200.0 ELSE 10.0 END AS d FROM gps_stops) GROUP BY 1"""))
def a03(spark, sf):
    b = Bus(spark, sf)
    off = b.gps_stops.withColumn("y", F.col("y") + F.when(F.col("cp") % 4 == 0, 200).otherwise(10))
    return A.shape_coverage(off, PL.polyline_segments(shapes(b), "cl", "seq")).drop("trechos")


@query("a04_choose_shape", oracle("gps_stops", """
SELECT cl, CASE WHEN cl % 3 > 0 THEN 'gtfs' ELSE 'observado' END AS origem, 41 AS pontos FROM gps_stops GROUP BY cl"""))
def a04(spark, sf):
    b = Bus(spark, sf)
    s = shapes(b)
    cov = s.select("cl").distinct().withColumn("cobertura", F.when(F.col("cl") % 3 > 0, 0.9).otherwise(0.2))
    return A.choose_shape(s, s, cov).groupBy("cl", "origem").agg(F.count("*").cast("int").alias("pontos"))


@query("a05_complete_stops", oracle("gps_stops", """
SELECT cl, cp, CASE WHEN cp % 3 = 0 THEN 'catalogo' WHEN cp % 3 = 1 THEN 'previsao' ELSE 'gtfs' END AS fonte FROM gps_stops"""))
def a05(spark, sf):
    s = Bus(spark, sf).gps_stops
    return A.complete_stops(s.where("cp % 3 = 0"), s.where("cp % 3 < 2"), s).select("cl", "cp", "fonte")


@query("a06_order_stops", oracle("gps_stops", """
SELECT cl, cp, CAST(row_number() OVER (PARTITION BY cl ORDER BY s_m, cp) - 1 AS INTEGER) AS ordem, s_m FROM gps_stops WHERE cp % 4 > 0"""))
def a06(spark, sf):
    b = Bus(spark, sf)
    off = b.gps_stops.select("cl", "cp", "x", (F.col("y") + F.when(F.col("cp") % 4 == 0, 200).otherwise(10)).alias("y"))
    return A.order_stops(off, PL.polyline_segments(shapes(b), "cl", "seq")).select("cl", "cp", "ordem", F.round("s_m", 6).alias("s_m"))


derive("on_route", ["gps"], f"""
SELECT *, {LL} FROM gps WHERE dist <= 150 QUALIFY count(*) OVER (PARTITION BY cl, prefixo) >= 3""")
derive("trips_gps", ["on_route"], """
SELECT * FROM (SELECT *, count(*) OVER v AS n, min(s) OVER v AS smin, max(s) OVER v AS smax, min(ta) OVER v AS ta0,
  concat(cl, '-', prefixo, '-', strftime(make_timestamp(min(ta) OVER v * 1000000), '%Y%m%dT%H%M%S')) AS vid FROM (
  SELECT *, sum(corte) OVER (PARTITION BY cl, prefixo ORDER BY ta, rid) AS tr FROM (
    SELECT *, CASE WHEN ta - lag(ta) OVER w > 900 OR s - lag(s) OVER w < -1500 THEN 1 ELSE 0 END AS corte FROM on_route WINDOW w AS (PARTITION BY cl, prefixo ORDER BY ta, rid)))
  WINDOW v AS (PARTITION BY cl, prefixo, tr)) WHERE n >= 3""")


def trips_of(b):
    return A.segment_trips(A.on_route(ll(b.gps)))


@query("a07_on_route", oracle("on_route", "SELECT rid FROM on_route"))
def a07(spark, sf):
    return A.on_route(Bus(spark, sf).gps).select("rid")


@query("a08_segment_trips", oracle("trips_gps", "SELECT rid, vid AS viagem_id FROM trips_gps"))
def a08(spark, sf):
    return trips_of(Bus(spark, sf)).select("rid", "viagem_id")


derive("stops_ll", ["gps_stops"], f"SELECT cl, cp, ordem, s_m, {LL} FROM gps_stops")
derive("crossings", ["trips_gps", "stops_ll"], f"""
SELECT * EXCLUDE (f), ta + f * (t1 - ta) AS t, lat + f * (la1 - lat) AS vlat, lon + f * (lo1 - lon) AS vlon, abs(s1 - s) AS salto_m, t1 - ta AS salto_s,
  {sql_haversine('lat + f * (la1 - lat)', 'lon + f * (lo1 - lon)', 'plat', 'plon')} AS d FROM (
  SELECT g.*, k.cp, k.ordem, k.lat AS plat, k.lon AS plon, CASE WHEN s1 - s <= 0 THEN 0 ELSE least(1.0, greatest(0.0, (k.s_m - s) / (s1 - s))) END AS f
  FROM (SELECT *, lead(s) OVER w AS s1, lead(ta) OVER w AS t1, lead(lat) OVER w AS la1, lead(lon) OVER w AS lo1 FROM trips_gps WINDOW w AS (PARTITION BY cl, prefixo, tr ORDER BY ta, rid)) g
  JOIN stops_ll k ON k.cl = g.cl AND s <= k.s_m AND s1 >= k.s_m
  QUALIFY row_number() OVER (PARTITION BY vid, tr, cp, k.ordem ORDER BY ta, rid) = 1)""")
derive("approaches", ["trips_gps", "stops_ll", "crossings"], f"""
SELECT * FROM (SELECT g.*, k.cp, k.ordem, {sql_haversine('g.lat', 'g.lon', 'k.lat', 'k.lon')} AS d FROM (
    SELECT *, abs(coalesce(lead(s) OVER w, s) - coalesce(lag(s) OVER w, s)) AS salto_m, coalesce(lead(ta) OVER w, ta) - coalesce(lag(ta) OVER w, ta) AS salto_s
    FROM trips_gps WINDOW w AS (PARTITION BY cl, prefixo, tr ORDER BY ta, rid)) g
  JOIN stops_ll k ON k.cl = g.cl AND k.s_m BETWEEN smin - 90 AND smax + 90) a
WHERE d <= 90 AND NOT EXISTS (SELECT 1 FROM crossings c WHERE c.vid = a.vid AND c.tr = a.tr AND c.cp = a.cp AND c.ordem = a.ordem)
QUALIFY row_number() OVER (PARTITION BY vid, tr, cp, ordem ORDER BY d, ta, rid) = 1""")
derive("detected", ["crossings", "approaches"], """
SELECT vid AS viagem_id, cp, ordem, 'cruzamento' AS metodo, t AS t_chegada, d, salto_m, salto_s FROM crossings
UNION ALL SELECT vid, cp, ordem, 'aproximacao', ta, d, salto_m, salto_s FROM approaches""")
derive("graded", ["detected"], """
SELECT *, CASE WHEN salto_m <= 500 THEN 1 ELSE 500 / salto_m END * CASE WHEN salto_s <= 120 THEN 1 ELSE 120 / salto_s END * CASE WHEN d <= 90 THEN 1 ELSE 90 / d END
  * CASE WHEN metodo = 'cruzamento' THEN 1.0 ELSE 0.7 END AS conf
FROM detected WHERE CASE WHEN salto_s > 0 THEN salto_m / salto_s * 3.6 ELSE 0 END <= 80 AND d <= 270 AND salto_m <= 1200 AND salto_s <= 300""")


def events(b):
    return A.detect_arrivals(trips_of(b), ll(b.gps_stops))


@query("a09_stop_crossings", oracle("detected", """
SELECT viagem_id, cp, round(t_chegada, 2) AS t, round(d, 2) AS dist_min_m, salto_m, CAST(salto_s AS DOUBLE) AS salto_s FROM detected WHERE metodo = 'cruzamento'"""))
def a09(spark, sf):
    e = events(Bus(spark, sf)).where("metodo = 'cruzamento'")
    return e.select("viagem_id", "cp", F.round(F.unix_micros("t_chegada") / 1e6, 2).alias("t"), F.round("dist_min_m", 2).alias("dist_min_m"), "salto_m", "salto_s")


@query("a10_nearest_sample", oracle("detected", """
SELECT viagem_id, cp, CAST(t_chegada AS BIGINT) AS t, round(d, 2) AS dist_min_m, salto_m, CAST(salto_s AS DOUBLE) AS salto_s FROM detected WHERE metodo = 'aproximacao'"""))
def a10(spark, sf):
    e = events(Bus(spark, sf)).where("metodo = 'aproximacao'")
    return e.select("viagem_id", "cp", F.unix_seconds("t_chegada").alias("t"), F.round("dist_min_m", 2).alias("dist_min_m"), "salto_m", "salto_s")


@query("a11_hard_rejects", oracle("graded", "SELECT metodo, count(*) AS n FROM graded GROUP BY 1"))
def a11(spark, sf):
    return A.grade_arrivals(events(Bus(spark, sf))).groupBy("metodo").agg(F.count("*").alias("n"))


@query("a12_confidence", oracle("graded", "SELECT viagem_id, cp, ordem, round(conf, 3) AS confianca FROM graded"))
def a12(spark, sf):
    return A.grade_arrivals(events(Bus(spark, sf))).select("viagem_id", "cp", "ordem", "confianca")


@query("a13_arrival_job")
def a13(spark, sf):
    b = Bus(spark, sf)
    pos = ll(b.gps).select("rid", "cl", "prefixo", "ta", F.col("ta").alias("ts_coleta"), "lat", "lon")
    out = A.build_arrivals(pos, shapes(b), ll(b.gps_stops).select("cl", "cp", "lat", "lon"))
    return A.arrivals_summary(out)


@query("v01_pair_geometry", oracle("gps_stops", """
SELECT cp AS cp_origem, c AS cp_destino, min(s - s_m) AS extensao_m FROM (SELECT *, lead(cp) OVER w AS c, lead(s_m) OVER w AS s FROM gps_stops WINDOW w AS (PARTITION BY cl ORDER BY s_m, cp))
WHERE c IS NOT NULL GROUP BY 1, 2"""))
def v01(spark, sf):
    b = Bus(spark, sf)
    return V.pair_geometry(b.gps_stops, PL.polyline_segments(shapes(b), "cl", "seq"))[0].select("cp_origem", "cp_destino", "extensao_m")


@query("v02_heading", oracle("gps", """
, d AS (SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, ta - lag(ta) OVER w AS dt FROM gps WINDOW w AS (PARTITION BY prefixo ORDER BY ta, rid)),
u AS (SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) >= 15 AND dt <= 300 THEN dx / sqrt(dx * dx + dy * dy) END AS ux0 FROM d)
SELECT rid, round(last_value(ux0 IGNORE NULLS) OVER (PARTITION BY prefixo ORDER BY ta, rid ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 6) AS ux FROM u""".strip()))
def v02(spark, sf):
    return rounded(V.headings(Bus(spark, sf).gps), "ux").select("rid", "ux")


def matched(b):
    pairs, pts = V.pair_geometry(b.gps_stops, PL.polyline_segments(shapes(b), "cl", "seq"))
    return pairs, cut_lineage(pts), V.match_to_pairs(V.headings(b.gps), pts)


derive("v10", ["segments"], recent_sql({"cp_origem": "cp_origem", "cp_destino": "cp_destino"}, "velocidade_kmh / 3.6", 600, src="segments", qcols="viagem_id, ordem_origem, extensao_m"))
derive("v30", ["segments"], recent_sql({"cp_origem": "cp_origem", "cp_destino": "cp_destino"}, "velocidade_kmh / 3.6", 1800, src="segments", qcols="viagem_id, ordem_origem, extensao_m"))


@query("v05_speed_state", oracle("v10 v30", """
SELECT a.viagem_id, a.ordem_origem, round(a.med * 3.6, 5) AS frota_vel10_kmh, a.cnt AS frota_n10, round(b.med * 3.6, 5) AS frota_vel30_kmh, b.cnt AS frota_n30, b.idade AS frota_idade_s,
  round(a.extensao_m / CASE WHEN coalesce(a.med, b.med) > 0.5 THEN coalesce(a.med, b.med) END, 5) AS frota_tempo_s
FROM v10 a JOIN v30 b ON a.viagem_id = b.viagem_id AND a.ordem_origem = b.ordem_origem"""))
def v05(spark, sf):
    s = cut_lineage(seg_of(Bus(spark, sf)))
    m = s.select("cp_origem", "cp_destino", F.col("t_chegada").alias("t"), (F.col("velocidade_kmh") / 3.6).alias("vel_ms"), "viagem_id")
    d = V.speed_state(s, m, "viagem_id")
    return rounded(d, "frota_vel10_kmh", "frota_vel30_kmh", "frota_tempo_s", digits=5).select(
        *ID, "frota_vel10_kmh", "frota_n10", "frota_vel30_kmh", "frota_n30", "frota_idade_s", "frota_tempo_s")


def layers(b):
    """Lights, lanes and markets at places derived from suppliers."""
    s = b.table("supplier")
    at = s.select("s_suppkey", (F.col("s_suppkey") * 131 % 3500).cast("double").alias("x"), (F.col("s_suppkey") % 29 * 300 + 300 + F.col("s_suppkey") % 40).cast("double").alias("y"))
    lane = at.select(F.col("s_suppkey").alias("feicao"), F.explode(F.sequence(F.lit(0), F.lit(300), F.lit(10))).alias("d"), "x", "y").select("feicao", (F.col("x") + F.col("d")).alias("x"), "y")
    return at.withColumnRenamed("s_suppkey", "semaforo"), lane


# the streets are straight along x, so a pair's points are the multiples of 10 m between its stops
derive("pair_of_stops", ["gps_stops"], """
SELECT concat(p.o, '>', p.d) AS par, p.o AS cp_origem, p.d AS cp_destino, p.m.cl AS cl, p.m.a AS a, p.m.b AS b, p.m.extensao_m AS extensao_m FROM (
  SELECT cp AS o, nxt AS d, min({'cl': cl, 'a': s_m, 'b': s_nxt, 'extensao_m': s_nxt - s_m}) AS m
  FROM (SELECT *, lead(cp) OVER w AS nxt, lead(s_m) OVER w AS s_nxt FROM gps_stops WINDOW w AS (PARTITION BY cl ORDER BY s_m, cp))
  WHERE s_nxt - s_m > 0 AND s_nxt - s_m < 8000 GROUP BY 1, 2) AS p""")
derive("pair_points", ["pair_of_stops"], "SELECT par, cp_origem, cp_destino, k.x, cl * 300 AS y FROM pair_of_stops JOIN (SELECT unnest(range(0, 4001, 10)) AS x) AS k ON k.x BETWEEN a AND b")
derive("lights", [], "SELECT s_suppkey AS id, s_suppkey * 131 % 3500 AS x, s_suppkey % 29 * 300 + 300 + s_suppkey % 40 AS y FROM supplier")


derive("on_pairs", ["gps", "pair_of_stops", "pair_points"], """
SELECT rid, prefixo, cl, ta, i, dt, par, arg_min(s, pos) AS s FROM (
  SELECT h.* EXCLUDE (s), p.par, p.x - o.a AS s, row_number() OVER (PARTITION BY rid ORDER BY sqrt(pow(h.x - p.x, 2) + pow(h.y - p.y, 2)), p.par, p.x - o.a) AS pos FROM (
    SELECT *, last_value(ux0 IGNORE NULLS) OVER (PARTITION BY prefixo ORDER BY ta, rid ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS ux FROM (
      SELECT *, CASE WHEN sqrt(dx * dx + dy * dy) >= 15 AND dt <= 300 THEN dx / sqrt(dx * dx + dy * dy) END AS ux0 FROM (
        SELECT *, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy, ta - lag(ta) OVER w AS dt, row_number() OVER w AS i FROM gps WINDOW w AS (PARTITION BY prefixo ORDER BY ta, rid)))) h
  JOIN pair_points p ON pow(h.x - p.x, 2) + pow(h.y - p.y, 2) <= 625 JOIN pair_of_stops o ON o.par = p.par)
WHERE pos <= 6 AND ux > 0.5 GROUP BY ALL""")


@query("v03_match_to_pairs", oracle("on_pairs", "SELECT rid, par, CAST(s AS DOUBLE) AS s FROM on_pairs"))
def v03(spark, sf):
    return matched(Bus(spark, sf))[2].select("rid", "par", "s")


@query("v04_pair_speed", oracle("on_pairs", """
SELECT m.par, m.ta AS t, round(greatest(m.s - p.s, 0) / m.dt, 6) AS vel_ms, m.cl AS cl_medidor, m.prefixo FROM on_pairs m
JOIN on_pairs p ON p.prefixo = m.prefixo AND p.par = m.par AND p.i = m.i - 1 WHERE m.dt BETWEEN 10 AND 300 AND m.s - p.s >= -5"""))
def v04(spark, sf):
    return rounded(V.pair_speeds(matched(Bus(spark, sf))[2], 10.0, 300.0), "vel_ms").withColumn("t", F.unix_seconds("t"))


@query("v06_lights_on_pairs", oracle("pair_of_stops pair_points lights", """
SELECT p.par, cp_origem, cp_destino, extensao_m, coalesce(n, 0) AS geo_semaforos, coalesce(n, 0) / greatest(extensao_m / 1000, 0.05) AS geo_semaforos_km
FROM pair_of_stops AS p LEFT JOIN (SELECT par, count(DISTINCT id) AS n FROM pair_points AS q JOIN lights AS l ON (q.x - l.x) ** 2 + (q.y - l.y) ** 2 <= 400 GROUP BY 1) AS c ON c.par = p.par"""))
def v06(spark, sf):
    b = Bus(spark, sf)
    pairs, pts, _ = matched(b)
    return V.lights_on_pairs(pairs, pts, layers(b)[0])


@query("v07_share_near_layer", oracle("pair_points lights", """
SELECT par, avg(CASE WHEN near THEN 1.0 ELSE 0.0 END) AS geo_faixa FROM (
  SELECT par, EXISTS (SELECT 1 FROM lights AS l, range(0, 301, 10) AS t(d) WHERE (q.x - l.x - d) ** 2 + (q.y - l.y) ** 2 <= 225) AS near FROM pair_points AS q) GROUP BY 1"""))
def v07(spark, sf):
    b = Bus(spark, sf)
    return V.share_near_layer(matched(b)[1], layers(b)[1], "geo_faixa")


def lane_text(key):
    """A timetable text whose hours follow the key: two spans and two kinds of days, all day, one span, none."""
    k = F.col(key)
    two = F.concat(F.lit("De 2ª a 5ª, "), (5 + k % 5).cast("string"), F.lit("-"), (11 + k % 7).cast("string"), F.lit("h e 16:15-19h; sáb. 8-"), (12 + k % 3).cast("string"), F.lit("h"))
    one = F.concat(F.lit("dom. "), (6 + k % 4).cast("string"), F.lit(":45-13h"))
    return F.when(k % 4 == 0, two).when(k % 4 == 1, F.lit("Integral")).when(k % 4 == 2, one).otherwise("")


LANES = """
WITH k AS (SELECT s_suppkey AS faixa, s_suppkey % 4 AS m FROM supplier),
w AS (SELECT faixa, unnest(range(0, 4)) AS dia, 5.0 + faixa % 5 AS a, 11.0 + faixa % 7 AS b FROM k WHERE m = 0
  UNION ALL SELECT faixa, unnest(range(0, 4)), 16.25, 19.0 FROM k WHERE m = 0
  UNION ALL SELECT faixa, 5, 8.0, 12.0 + faixa % 3 FROM k WHERE m = 0
  UNION ALL SELECT faixa, 6, 6.75 + faixa % 4, 13.0 FROM k WHERE m = 2
  UNION ALL SELECT faixa, unnest(range(0, 7)), 0.0, 24.0 FROM k WHERE m IN (1, 3))
SELECT faixa, CAST(dia AS INTEGER) AS dia, CAST(a AS DOUBLE) AS h_ini, CAST(b AS DOUBLE) AS h_fim FROM w"""


@query("v08_lane_timetables", LANES.strip())
def v08(spark, sf):
    return V.lane_windows(Bus(spark, sf).table("supplier").select(F.col("s_suppkey").alias("faixa"), lane_text("s_suppkey").alias("txt")), "txt")


def agenda(b):
    lights, lane = layers(b)
    days = F.element_at(F.array(F.lit("Terça-feira"), F.lit("Sábado e Domingo"), F.lit("quarta")), (F.col("semaforo") % 3 + 1).cast("int"))
    m = lights.select(F.col("semaforo").alias("feira"), "x", "y", days.alias("d"), F.when(F.col("semaforo") % 2 == 0, "07:30 as 13h").otherwise("cedo").alias("h"))
    return V.market_windows(m, "d", "h")


MARKETS = """
SELECT DISTINCT cp_origem, cp_destino, id AS feira, dia, CASE WHEN id % 2 = 0 THEN 7.5 ELSE 7.0 END::DOUBLE AS h_ini, CASE WHEN id % 2 = 0 THEN 13.0 ELSE 14.0 END::DOUBLE AS h_fim
FROM pair_points AS q JOIN lights AS l ON (q.x - l.x) ** 2 + (q.y - l.y) ** 2 <= 40000
JOIN (SELECT unnest([0, 1, 1, 2]) AS m, unnest([1, 5, 6, 2]) AS dia) AS d ON d.m = l.id % 3"""


@query("v09_market_agenda", oracle("pair_points lights", MARKETS))
def v09(spark, sf):
    b = Bus(spark, sf)
    return V.market_agenda(matched(b)[1], agenda(b))


# the lane nearest to each point of a pair, at most 15 m away
derive("lane_points", ["pair_points", "lights"], """
SELECT q.par, q.x, l.id FROM pair_points q JOIN lights l ON abs(q.y - l.y) <= 15, range(0, 301, 10) t(d) WHERE pow(q.x - l.x - d, 2) + pow(q.y - l.y, 2) <= 225
GROUP BY q.par, q.x, l.id QUALIFY row_number() OVER (PARTITION BY q.par, q.x ORDER BY min(sqrt(pow(q.x - l.x - d, 2) + pow(q.y - l.y, 2))), l.id) = 1""")
# pairs with the lights on them
LIT = """(SELECT p.*, coalesce(n, 0) AS k FROM pair_of_stops AS p LEFT JOIN (
  SELECT par, count(DISTINCT id) AS n FROM pair_points AS q JOIN {lights} AS l ON pow(q.x - l.x, 2) + pow(q.y - l.y, 2) <= 400 GROUP BY 1) AS c ON c.par = p.par)"""


@query("v10_attach_layers", oracle("segments lane_points pair_of_stops pair_points lights", f"""
, agenda AS ({MARKETS}),
lanes AS (SELECT par, faixa, dia AS wd, h_ini, h_fim, fracao FROM (SELECT par, id, count(*) / max(t) AS fracao FROM lane_points JOIN (SELECT par, count(*) AS t FROM pair_points GROUP BY 1) USING (par) GROUP BY 1, 2)
  JOIN ({LANES}) ON faixa = id),
q AS (SELECT viagem_id, ordem_origem, cp_origem, cp_destino, {sql_weekday('t_origem')} AS wd, {sql_hour('t_origem')} + (t_origem - 10800) % 3600 // 60 / 60 AS h FROM segments),
a AS (SELECT viagem_id, ordem_origem, count(*) AS fd, count(*) FILTER (h BETWEEN h_ini AND h_fim) AS fa FROM q JOIN agenda g ON g.cp_origem = q.cp_origem AND g.cp_destino = q.cp_destino AND g.dia = q.wd GROUP BY 1, 2),
x AS (SELECT viagem_id, ordem_origem, sum(fracao) AS fx FROM q JOIN pair_of_stops p ON p.cp_origem = q.cp_origem AND p.cp_destino = q.cp_destino JOIN lanes l ON l.par = p.par AND l.wd = q.wd AND h >= h_ini AND h < h_fim GROUP BY 1, 2)
SELECT q.viagem_id, q.ordem_origem, f.k AS geo_semaforos, CASE WHEN f.k IS NOT NULL THEN coalesce(fd, 0) END AS geo_feira_dia, CASE WHEN f.k IS NOT NULL THEN coalesce(fa, 0) END AS geo_feira_agora,
  round(CASE WHEN f.k IS NOT NULL THEN least(1, coalesce(fx, 0)) END, 6) AS geo_faixa_ativa
FROM q LEFT JOIN {LIT.format(lights='lights')} f ON f.cp_origem = q.cp_origem AND f.cp_destino = q.cp_destino
LEFT JOIN a ON a.viagem_id = q.viagem_id AND a.ordem_origem = q.ordem_origem LEFT JOIN x ON x.viagem_id = q.viagem_id AND x.ordem_origem = q.ordem_origem""".strip()))
def v10(spark, sf):
    b = Bus(spark, sf)
    pairs, pts, _ = matched(b)
    lights, lane = layers(b)
    share = V.share_per_feature(pts, lane).join(pairs.select("par", "cp_origem", "cp_destino"), "par")
    lanes = V.lane_windows(share.withColumn("txt", lane_text("feicao")), "txt").drop("par", "feicao")
    d = V.attach_layers(seg_of(b), ID, V.lights_on_pairs(pairs, pts, lights), V.market_agenda(pts, agenda(b)), lanes)
    return rounded(d, "geo_faixa_ativa").select(*ID, "geo_semaforos", "geo_feira_dia", "geo_feira_agora", "geo_faixa_ativa")


@query("v11_map_extract_layers", oracle("pair_of_stops pair_points lights", f"""
, e AS (SELECT a.id AS u, b.id AS v FROM lights a JOIN lights b ON a.id <> b.id AND pow(a.x - b.x, 2) + pow(a.y - b.y, 2) <= 900),
r AS (SELECT id AS v, id AS c FROM lights UNION SELECT e.v, r.c FROM r JOIN e ON e.u = r.v),
m AS (SELECT c AS id, avg(x) AS x, avg(y) AS y FROM (SELECT v, min(c) AS c FROM r GROUP BY v) JOIN lights ON id = v GROUP BY 1),
s AS (SELECT q.par, q.x, CAST(l.id % 3 * 10 + 30 AS DOUBLE) AS v FROM pair_points q JOIN lights l ON abs(q.y - l.y) <= 15, range(0, 301, 10) t(d) WHERE pow(q.x - l.x - d, 2) + pow(q.y - l.y, 2) <= 225
  QUALIFY row_number() OVER (PARTITION BY q.par, q.x ORDER BY sqrt(pow(q.x - l.x - d, 2) + pow(q.y - l.y, 2)), l.id % 3) = 1)
SELECT f.par, cp_origem, cp_destino, extensao_m, k AS geo_semaforos, k / greatest(extensao_m / 1000, 0.05) AS geo_semaforos_km, osm_velocidade
FROM {LIT.format(lights='m')} f LEFT JOIN (SELECT par, median(v) AS osm_velocidade FROM s GROUP BY 1) z ON z.par = f.par""".strip()).replace("WITH ", "WITH RECURSIVE ", 1))
def v11(spark, sf):
    b = Bus(spark, sf)
    pairs, pts, _ = matched(b)
    lights, lane = layers(b)
    merged = V.merge_lights(lights.withColumnRenamed("semaforo", "id"))
    ways = lane.select((F.col("feicao") % 3 * 10 + 30).alias("maxspeed"), "x", "y")
    return V.lights_on_pairs(pairs, pts, merged).join(V.speed_limits(pts, ways), "par", "left")
