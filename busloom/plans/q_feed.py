"""Static feed queries (T, S08)."""

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.operators import feed as FD
from busloom.plans.q_delay import rounded, seg_of
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_hour

derive("rep", ["trips", "stop_times"], """
SELECT route_id, direction_id, trip_id, shape_id, n_paradas FROM (
  SELECT t.*, coalesce(n, 0) AS n_paradas FROM trips t LEFT JOIN (SELECT trip_id, count(*) AS n FROM stop_times GROUP BY 1) s USING (trip_id))
QUALIFY row_number() OVER (PARTITION BY route_id, direction_id ORDER BY n_paradas DESC, trip_id) = 1
""")
derive("feed_lines", ["lines"], """
SELECT cl, letreiro, sentido, CASE WHEN cl % 4 > 0 THEN concat(letreiro, '-10') END AS letreiro_completo,
  CASE WHEN cl % 4 = 0 AND cl % 8 > 0 THEN 10 END AS tl FROM lines
""")
derive("linked", ["feed_lines", "rep"], """
SELECT cl, letreiro, l.route_id, sentido, sentido - 1 AS direction_id, trip_id, shape_id
FROM (SELECT *, coalesce(letreiro_completo, CASE WHEN tl IS NOT NULL THEN concat(letreiro, '-', tl) END) AS route_id FROM feed_lines) l
JOIN rep ON rep.route_id = l.route_id AND rep.direction_id = sentido - 1
""")
derive("sched", ["frequencies", "feed_lines"], """
SELECT cl, hora, intervalo_s FROM (SELECT cl, concat(letreiro_completo, '-', sentido - 1) AS trip_id FROM feed_lines WHERE letreiro_completo IS NOT NULL)
JOIN (SELECT trip_id, h % 24 AS hora, min(headway_secs) AS intervalo_s FROM (
  SELECT trip_id, headway_secs, unnest(generate_series(h0, h1)) AS h FROM frequencies) GROUP BY 1, 2) USING (trip_id)
""")


def feed_lines(b):
    return b.lines.select(
        "cl", "letreiro", "sentido",
        F.when(F.col("cl") % 4 > 0, F.concat("letreiro", F.lit("-10"))).alias("letreiro_completo"),
        F.when((F.col("cl") % 4 == 0) & (F.col("cl") % 8 > 0), F.lit(10)).alias("tl"))


def linked_of(b):
    return FD.bridge(feed_lines(b), b.trips, b.stop_times)


def shapes_of(b):
    return b.line_stops.join(b.stops, "cp").select(
        F.concat(F.lit("S"), "cl").alias("shape_id"), F.col("ordem").alias("shape_pt_sequence"),
        F.col("lat").alias("shape_pt_lat"), F.col("lon").alias("shape_pt_lon"))


def feed_stops(b):
    return b.stops.withColumnRenamed("cp", "stop_id")


@query("s08_bus_routes", oracle("routes", "SELECT route_id FROM routes WHERE route_type = 3"))
def s08(spark, sf):
    return FD.bus_routes(Bus(spark, sf).routes).select("route_id")


@query("t01_representative_trip", oracle("rep", "SELECT * FROM rep"))
def t01(spark, sf):
    b = Bus(spark, sf)
    return FD.representative_trips(b.trips, b.stop_times)


@query("t02_ordered_shape", oracle("line_stops stops", """
SELECT concat('S', l.cl) AS shape_id, string_agg(concat(l.ordem, '@', round(lat * 10000)::BIGINT), ' ' ORDER BY l.ordem, lat) AS pontos
FROM line_stops l JOIN stops s ON s.cp = l.cp GROUP BY 1"""))
def t02(spark, sf):
    s = FD.ordered_shape(shapes_of(Bus(spark, sf)))
    txt = F.transform("pontos", lambda p: F.concat(p["shape_pt_sequence"], F.lit("@"), F.round(p["lat"] * 10000).cast("long")))
    return s.select("shape_id", F.array_join(txt, " ").alias("pontos"))


@query("t03_stop_sequence", oracle("stop_times stops", """
SELECT trip_id, stop_sequence, stop_id, round(lat, 6) AS lat, round(lon, 6) AS lon FROM stop_times JOIN stops ON cp = stop_id"""))
def t03(spark, sf):
    b = Bus(spark, sf)
    return rounded(FD.stop_sequence(b.stop_times, feed_stops(b)), "lat", "lon")


@query("t04_itinerary", oracle("rep stop_times line_stops", """
SELECT route_id, direction_id, trip_id, n_paradas, CAST(np AS INTEGER) AS n_pontos, CAST(ns AS INTEGER) AS n_lista
FROM rep LEFT JOIN (SELECT concat('S', cl) AS shape_id, count(*) AS np FROM line_stops GROUP BY 1) USING (shape_id)
LEFT JOIN (SELECT trip_id, count(*) AS ns FROM stop_times GROUP BY 1) USING (trip_id)"""))
def t04(spark, sf):
    b = Bus(spark, sf)
    it = FD.itinerary(b.trips, b.stop_times, shapes_of(b), feed_stops(b))
    return it.select("route_id", "direction_id", "trip_id", "n_paradas", F.when(F.col("pontos").isNotNull(), F.size("pontos")).alias("n_pontos"),
                     F.size("paradas").alias("n_lista"))


@query("t05_id_bridge", oracle("linked", "SELECT * FROM linked"))
def t05(spark, sf):
    return linked_of(Bus(spark, sf))


@query("t06_stop_coverage", oracle("linked line_stops stop_times", """
SELECT cl, route_id, sentido, a AS paradas_api, coalesce(f, 0) AS paradas_gtfs, round(a / nullif(coalesce(f, 0), 0), 3) AS cobertura
FROM linked JOIN (SELECT cl, count(*) AS a FROM line_stops GROUP BY 1) USING (cl)
LEFT JOIN (SELECT trip_id, count(*) AS f FROM stop_times GROUP BY 1) USING (trip_id)"""))
def t06(spark, sf):
    b = Bus(spark, sf)
    return FD.stop_coverage(linked_of(b), b.line_stops, b.stop_times)


@query("t07_feed_check", oracle("routes trips stops line_stops", """
SELECT (SELECT count(*) FROM routes WHERE route_type = 3) AS rotas_onibus,
  (SELECT count(*) FROM routes WHERE route_type = 3 AND NOT regexp_matches(route_id, '^[0-9A-Z]+-[0-9]+$')) AS rotas_fora_do_padrao,
  (SELECT count(*) FROM trips) AS viagens, (SELECT count(*) FROM trips WHERE shape_id IS NULL) AS viagens_sem_forma,
  (SELECT count(*) FROM stops) AS paradas, (SELECT count(DISTINCT cl) FROM line_stops) AS formas"""))
def t07(spark, sf):
    b = Bus(spark, sf)
    return FD.feed_check(b.routes, b.trips, b.stops, shapes_of(b))


@query("t08_scheduled_headway", oracle("sched", "SELECT cl, hora, intervalo_s FROM sched"))
def t08(spark, sf):
    b = Bus(spark, sf)
    return FD.scheduled_headways(b.frequencies, feed_lines(b))


@query("t09_headway_ratio", oracle("segments sched", """
SELECT viagem_id, ordem_origem, intervalo_s AS prog_intervalo_s, round(headway_s / intervalo_s, 6) AS prog_razao
FROM segments s LEFT JOIN sched c ON c.cl = s.cl AND c.hora = s.hora"""))
def t09(spark, sf):
    b = Bus(spark, sf)
    out = FD.attach_headway(seg_of(b), FD.scheduled_headways(b.frequencies, feed_lines(b)), "headway_s")
    return rounded(out, "prog_razao").select("viagem_id", "ordem_origem", "prog_intervalo_s", "prog_razao")


@query("t10_real_vs_planned", oracle("segments linked stop_times", """
, plan AS (SELECT cl, n_paradas, dur / (n_paradas - 1) AS prog FROM linked JOIN (
    SELECT trip_id, count(*) AS n_paradas, max(arrival_s) - min(arrival_s) AS dur FROM stop_times GROUP BY 1 HAVING count(*) > 1) USING (trip_id)),
v AS (SELECT viagem_id, min(cl) AS cl, count(*) AS trechos, sum(tempo_percurso_s) AS real_s, arg_min(tipo, ordem_origem) AS tipo,
    arg_min(faixa, ordem_origem) AS faixa FROM segments GROUP BY 1),
w AS (SELECT tipo, faixa, real_s, real_s / (trechos * prog) AS razao FROM v JOIN plan USING (cl) WHERE trechos / (n_paradas - 1) >= 0.8)
SELECT tipo, faixa, count(*) AS viagens, round(100 * avg(CASE WHEN razao > 1 THEN 1 ELSE 0 END), 6) AS acima_pct,
  round(100 * avg(CASE WHEN razao >= 1.2 THEN 1 ELSE 0 END), 6) AS acima20_pct, round(median(razao), 6) AS razao_mediana,
  CAST(median(real_s) AS DOUBLE) AS real_mediano_s FROM w GROUP BY 1, 2""".strip()))
def t10(spark, sf):
    b = Bus(spark, sf)
    seg = seg_of(b).withColumn("tipo", cal.day_type("t_origem", ("2024-01-01",)))
    out = FD.real_vs_planned(seg, linked_of(b), b.stop_times, ["tipo", "faixa"])
    return rounded(out, "acima_pct", "acima20_pct", "razao_mediana")
