"""Source and ingest queries (S, I)."""

from pyspark.sql import functions as F

from busloom.config import LOCAL_TZ
from busloom.functions import calendar as cal
from busloom.operators import feed as FD
from busloom.operators import ingest as I
from busloom.plans.q_delay import epoch
from busloom.plans.q_feed import linked_of
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_hour
from busloom.sources import tables as TB


@query("s01_raw_scan", """
SELECT event_id, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-20' AND value > 10""")
def s01(spark, sf):
    from datetime import datetime
    return TB.read_raw(spark, f"{sf}/events.parquet", datetime(2024, 1, 10), datetime(2024, 1, 20),
                       ["event_id", "user_id", "value"], "value > 10", "ts")


@query("s05_file_manifest", "SELECT count(*) AS linhas, epoch_us(min(ts)) AS ts_min, epoch_us(max(ts)) AS ts_max FROM events")
def s05(spark, sf):
    m = TB.manifest(spark.read.parquet(f"{sf}/events.parquet"), "ts")
    return m.agg(F.sum("linhas").alias("linhas"), F.unix_micros(F.min("ts_min").cast("timestamp")).alias("ts_min"),
                 F.unix_micros(F.max("ts_max").cast("timestamp")).alias("ts_max"))


@query("s13_named_views", """
SELECT c.cl, count(*) AS n, min(l.s_m) AS s_min FROM (SELECT l_orderkey % 29 + 1 AS cl FROM lineitem) c
JOIN (SELECT r_regionkey + 1 AS cl, CAST(r_regionkey AS DOUBLE) AS s_m FROM region) l ON l.cl = c.cl GROUP BY c.cl""")
def s13(spark, sf):
    b = Bus(spark, sf)
    TB.register_views(spark, {
        "busloom_chegadas": b.table("lineitem").selectExpr("l_orderkey % 29 + 1 AS cl"),
        "busloom_linha_parada": b.table("region").selectExpr("r_regionkey + 1 AS cl", "CAST(r_regionkey AS DOUBLE) AS s_m")})
    return spark.sql("SELECT c.cl, count(*) AS n, min(l.s_m) AS s_min FROM busloom_chegadas c JOIN busloom_linha_parada l ON l.cl = c.cl GROUP BY c.cl")


@query("s16_keyed_upsert", oracle("arrivals", """
SELECT cp, prefixo, CAST(max(t_chegada) AS BIGINT) AS t FROM arrivals GROUP BY cp, prefixo"""))
def s16(spark, sf):
    a = Bus(spark, sf).arrivals.select("cp", "prefixo", "t_chegada", "ordem")
    out = TB.upsert(a.where("ordem <= 3"), a.where("ordem > 3"), ["cp", "prefixo"], "t_chegada")
    return out.select("cp", "prefixo", F.unix_seconds("t_chegada").alias("t"))


@query("s17_refresh_links", oracle("line_stops", """
SELECT cl, cp, CASE WHEN cl % 3 = 0 THEN cp WHEN cp % 2 = 0 THEN cp ELSE NULL END AS ordem_api, s_m FROM line_stops"""))
def s17(spark, sf):
    ls = Bus(spark, sf).line_stops
    current = ls.where("cl % 3 = 0 OR cp % 2 = 0").select("cl", "cp", F.col("cp").alias("ordem_api"), "ordem", "s_m")
    fresh = ls.where("cl % 3 <> 0").select("cl", "cp", F.lit(None).cast("long").alias("ordem_api"), "ordem", "s_m")
    return TB.refresh_links(current, fresh).select("cl", "cp", "ordem_api", "s_m")


def position_payloads(b):
    """Raw payload texts as the service would send them: both shapes, one vehicle per poll."""
    p = b.positions
    v = F.struct(
        F.col("prefixo").alias("p"), (F.col("event_id") % 2 == 0).alias("a"),
        F.date_format("ta", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ta"), F.col("lat").alias("py"),
        F.when(F.col("event_id") % 50 > 0, F.col("lon")).alias("px"))
    by_line = F.struct(
        F.lit("14:00").alias("hr"),
        F.array(F.struct(F.concat("letreiro", F.lit("-10")).alias("c"), "cl", F.lit(1).alias("sl"), F.lit("A").alias("lt0"),
                         F.lit("B").alias("lt1"), F.lit(1).alias("qv"), F.array(v).alias("vs"))).alias("l"))
    root = F.struct(F.lit("14:00").alias("hr"), F.array(v).alias("vs"))
    return p.select("event_id", "ts_coleta", F.when(F.col("event_id") % 3 > 0, F.to_json(by_line)).otherwise(F.to_json(root)).alias("payload"))


@query("i01_flatten_positions", oracle("positions", """
SELECT event_id, CASE WHEN event_id % 3 > 0 THEN cl ELSE 999 END AS cl, CASE WHEN event_id % 3 > 0 THEN letreiro ELSE 'X' END AS letreiro,
  CASE WHEN event_id % 3 > 0 THEN 1 ELSE 2 END AS sentido, prefixo, ta, round(lat, 6) AS lat, round(lon, 6) AS lon
FROM positions WHERE event_id % 50 > 0"""))
def i01(spark, sf):
    f = I.flatten_positions(position_payloads(Bus(spark, sf)), "payload", "ts_coleta", 999, "X-21", 2)
    return epoch(f, "ta").select("event_id", "cl", "letreiro", "sentido", "prefixo", "ta", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


def forecast_payloads(b):
    f = b.forecasts
    t = F.date_format(cal.local("t_previsto"), "HH:mm")
    v = F.array(F.struct(F.col("prefixo").alias("p"), t.alias("t"), F.lit(True).alias("a")))
    direct = F.struct(F.lit("14:00").alias("hr"), F.array(F.struct("cp", F.col("parada_nome").alias("np"), v.alias("vs"))).alias("ps"))
    nested = F.struct(F.lit("14:00").alias("hr"), F.struct("cp", F.col("parada_nome").alias("np"), F.array(F.struct("cl", F.col("sentido").alias("sl"), v.alias("vs"))).alias("l")).alias("p"))
    return f.select("qid", "ts_coleta", "cl", "letreiro", "sentido", F.when(F.col("qid") % 2 == 0, F.to_json(direct)).otherwise(F.to_json(nested)).alias("payload"))


@query("i02_flatten_forecasts", oracle("forecasts", """
SELECT qid, cl, sentido, cp, prefixo, t_previsto, CAST(horizonte_s AS INTEGER) AS horizonte_s FROM forecasts"""))
def i02(spark, sf):
    d = forecast_payloads(Bus(spark, sf)).withColumn("way", F.col("sentido"))
    f = I.flatten_forecasts(d.drop("sentido"), "payload", "ts_coleta", "cl", "letreiro", "way")
    return epoch(f, "t_previsto").select("qid", "cl", F.col("sentido").cast("long").alias("sentido"), "cp", "prefixo", "t_previsto", "horizonte_s")


@query("i03_parse_instant", oracle("positions", """
SELECT event_id, CASE WHEN event_id % 10 > 0 THEN ta END AS ta FROM positions"""))
def i03(spark, sf):
    p = Bus(spark, sf).positions
    txt = F.when(F.col("event_id") % 10 > 0, F.date_format("ta", "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise("2026-99-99Tbad")
    return p.select("event_id", F.unix_seconds(I.parse_instant(txt)).alias("ta"))


@query("i04_resolve_clock", oracle("forecasts", """
SELECT qid, CASE WHEN t - ts_coleta < -5400 THEN t + 86400 WHEN t - ts_coleta > 43200 THEN t - 86400 ELSE t END AS resolvido
FROM (SELECT qid, ts_coleta, (ts_coleta - 10800) // 86400 * 86400 + (t_previsto - 10800) % 86400 + 10800 AS t FROM forecasts)"""))
def i04(spark, sf):
    f = Bus(spark, sf).forecasts.withColumn("txt", F.date_format(cal.local("t_previsto"), "HH:mm"))
    return f.select("qid", F.unix_seconds(cal.resolve_clock("txt", "ts_coleta")).alias("resolvido"))


@query("i05_zone_choice", oracle("forecasts", """
, h AS (SELECT 'local' AS fuso, t_previsto - ts_coleta AS h FROM forecasts UNION ALL
  SELECT 'utc', CASE WHEN t - ts_coleta < -5400 THEN t + 86400 WHEN t - ts_coleta > 43200 THEN t - 86400 ELSE t END - ts_coleta
  FROM (SELECT ts_coleta, ts_coleta // 86400 * 86400 + (t_previsto - 10800) % 86400 AS t FROM forecasts))
SELECT fuso, round(avg(CASE WHEN h BETWEEN -120 AND 3600 THEN 1 ELSE 0 END), 3) AS fracao_plausivel,
  CAST(list_sort(list(h))[count(*) // 2 + 1] AS DOUBLE) AS horizonte_mediano_s, fuso = 'local' AS escolhido FROM h GROUP BY fuso""".strip()))
def i05(spark, sf):
    f = Bus(spark, sf).forecasts.withColumn("txt", F.date_format(cal.local("t_previsto"), "HH:mm"))
    return I.choose_zone(f, "txt", "ts_coleta")


@query("i06_daily_window", oracle("positions", f"""
SELECT event_id FROM positions WHERE {sql_hour('ts_coleta')} >= 4 OR {sql_hour('ts_coleta')} < 1"""))
def i06(spark, sf):
    return Bus(spark, sf).positions.where(cal.inside_window("ts_coleta", "04:00", "01:00")).select("event_id")


derive("polls", ["positions"], """
SELECT event_id, prefixo, cl, ta, ts_coleta FROM positions UNION ALL
SELECT event_id + 100000000, prefixo, cl, ta, ts_coleta + 30 FROM positions WHERE event_id % 3 = 0""")


def polls(b):
    p = b.positions.select("event_id", "prefixo", "cl", "ta", "ts_coleta")
    again = p.where("event_id % 3 = 0").select((F.col("event_id") + 100000000).alias("event_id"), "prefixo", "cl", "ta",
                                               F.timestamp_seconds(F.unix_seconds("ts_coleta") + 30).alias("ts_coleta"))
    return p.unionByName(again)


@query("i07_drop_repeats", oracle("polls", """
SELECT event_id FROM (SELECT *, lag(ta) OVER (PARTITION BY prefixo, cl ORDER BY ts_coleta, event_id) AS p FROM polls) WHERE p IS NULL OR p <> ta"""))
def i07(spark, sf):
    return I.drop_repeats(polls(Bus(spark, sf)), "event_id").select("event_id")


@query("i08_exact_duplicates", oracle("polls", """
SELECT event_id FROM polls QUALIFY row_number() OVER (PARTITION BY prefixo, ta ORDER BY ts_coleta, event_id) = 1"""))
def i08(spark, sf):
    return I.drop_exact_duplicates(polls(Bus(spark, sf)), "event_id").select("event_id")


@query("i09_line_catalogue", oracle("positions", """
SELECT DISTINCT cl, letreiro, concat(letreiro, '-10') AS letreiro_completo, 'B' AS terminal_principal FROM positions WHERE event_id % 3 > 0"""))
def i09(spark, sf):
    l = I.lines_from_snapshot(position_payloads(Bus(spark, sf)), "payload", "ts_coleta")
    return l.select("cl", "letreiro", "letreiro_completo", "terminal_principal").distinct()


@query("i10_catalogue_union", oracle("lines", """
SELECT cl, CASE WHEN cl % 2 = 0 THEN concat(letreiro, '!') ELSE letreiro END AS letreiro FROM lines"""))
def i10(spark, sf):
    l = Bus(spark, sf).lines.select("cl", "letreiro")
    return I.catalogue_union(l, l.where("cl % 2 = 0").withColumn("letreiro", F.concat("letreiro", F.lit("!"))))


@query("i11_resolve_signs", oracle("lines", "SELECT cl FROM lines WHERE upper(letreiro) IN (SELECT DISTINCT upper(concat('l', o_orderkey % 4)) FROM orders)"))
def i11(spark, sf):
    b = Bus(spark, sf)
    want = b.table("orders").select(F.concat(F.lit(" l"), F.col("o_orderkey") % 4, F.lit(" ")).alias("w"))
    return I.resolve_signs(b.lines, want, "w").select("cl")


@query("i12_stop_union", oracle("stops forecasts", """
, o AS (SELECT cp, max(parada_nome) AS nome FROM forecasts GROUP BY cp)
SELECT cp, CASE WHEN trim(s.nome) <> '' THEN s.nome WHEN trim(o.nome) <> '' THEN o.nome ELSE s.nome END AS nome FROM stops s FULL JOIN o USING (cp)""".strip()))
def i12(spark, sf):
    b = Bus(spark, sf)
    seen = b.forecasts.groupBy("cp").agg(F.max("parada_nome").alias("nome"))
    return I.stop_union(b.stops.select("cp", "nome"), seen)


@query("i13_complete_names", oracle("stops", """
SELECT cp, CASE WHEN trim(nome) = '' THEN concat('S', cp) ELSE nome END AS nome FROM stops"""))
def i13(spark, sf):
    s = Bus(spark, sf).stops.select("cp", "nome")
    return I.complete_names(s, s.select(F.col("cp").alias("stop_id"), F.concat(F.lit("S"), "cp").alias("stop_name")))


@query("i14_flatten_companies", """
SELECT CAST(n_regionkey AS INTEGER) AS area, CAST(n_nationkey AS INTEGER) AS codigo, n_name AS nome FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3""")
def i14(spark, sf):
    b = Bus(spark, sf)
    n = b.table("nation").join(b.table("customer").select(F.col("c_nationkey").alias("n_nationkey")).distinct(), "n_nationkey")
    areas = n.groupBy(F.col("n_regionkey").alias("a")).agg(F.collect_list(F.struct(F.col("n_nationkey").alias("c"), F.col("n_name").alias("n"))).alias("e"))
    return I.flatten_companies(areas.select(F.to_json(F.struct(F.array(F.struct("a", "e")).alias("e"))).alias("payload")), "payload")


@query("i15_collection_gaps", oracle("positions", """
, f AS (SELECT ts_coleta // 900 AS arquivo, min(ts_coleta) AS ts_min, max(ts_coleta) AS ts_max FROM positions GROUP BY 1)
SELECT de, ts_min AS ate, round((ts_min - de) / 60, 4) AS minutos FROM (SELECT *, lag(ts_max) OVER (ORDER BY ts_min, arquivo) AS de FROM f)
WHERE (ts_min - de) / 60 > 10""".strip()))
def i15(spark, sf):
    p = Bus(spark, sf).positions
    files = p.groupBy(F.floor(F.unix_seconds("ts_coleta") / 900).alias("arquivo")).agg(F.min("ts_coleta").alias("ts_min"), F.max("ts_coleta").alias("ts_max"))
    return epoch(TB.gaps(files), "de", "ate").withColumn("minutos", F.round("minutos", 4))


@query("i16_dataset_coverage", oracle("positions forecasts", """
SELECT 'posicoes' AS conjunto, count(*) AS linhas, min(ts_coleta) AS inicio, max(ts_coleta) AS fim FROM positions UNION ALL
SELECT 'previsoes', count(*), min(ts_coleta), max(ts_coleta) FROM forecasts"""))
def i16(spark, sf):
    b = Bus(spark, sf)
    return epoch(TB.coverage(b.positions, "posicoes", "ts_coleta").unionByName(TB.coverage(b.forecasts, "previsoes", "ts_coleta")), "inicio", "fim")


@query("i17_candidate_lines", oracle("linked line_stops stop_times arrivals", """
SELECT cl, veiculos, paradas_api, cobertura, veiculos * paradas_api AS rendimento FROM (
  SELECT cl, a AS paradas_api, round(a / f, 3) AS cobertura FROM linked JOIN (SELECT cl, count(*) AS a FROM line_stops GROUP BY 1) USING (cl)
  JOIN (SELECT trip_id, count(*) AS f FROM stop_times GROUP BY 1) USING (trip_id))
JOIN (SELECT cl, count(DISTINCT prefixo) AS veiculos FROM arrivals GROUP BY 1) USING (cl)
WHERE cobertura >= 0.5 AND paradas_api >= 5 AND veiculos >= 2 ORDER BY rendimento DESC, cl LIMIT 20"""))
def i17(spark, sf):
    b = Bus(spark, sf)
    cov = FD.stop_coverage(linked_of(b), b.line_stops, b.stop_times)
    veh = b.arrivals.groupBy("cl").agg(F.countDistinct("prefixo").alias("veiculos"))
    return I.candidate_lines(cov, veh).select("cl", "veiculos", "paradas_api", "cobertura", "rendimento")
