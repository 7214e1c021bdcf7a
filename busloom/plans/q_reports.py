"""Report queries (Q)."""

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.operators import reports as R
from busloom.operators import delay as D
from busloom.operators.quantiles import summarize
from busloom.plans.q_delay import epoch, pairs_of, rounded, seg_of
from busloom.plans.registry import query
from busloom.plans.standins import Bus, oracle, sql_date

LATE = "round(avg(CASE WHEN erro_s >= 300 THEN 1 ELSE 0 END), 4) AS prob_atraso_5min"


@query("q01_hourly_coverage", oracle("positions", """
SELECT ts_coleta // 3600 * 3600 AS hora, count(*) AS amostras, count(DISTINCT prefixo) AS veiculos,
  count(DISTINCT cl) AS linhas FROM positions GROUP BY 1"""))
def q01(spark, sf):
    return epoch(R.hourly_coverage(Bus(spark, sf).positions), "hora")


#: How each reported number is counted, over a view with e (error), h (headway) and the keys.
NUMBERS = {
    "rows": "count(*)", "trips": "count(*)", "lines": "count(DISTINCT code)",
    "mean_error_s": "round(sum(e) / count(e), 1)", "mean_abs_error_s": "round(sum(abs(e)) / count(e), 1)",
    "late_share": "round(count(*) FILTER (e >= 300) / count(*), 4)", "early_share": "round(count(*) FILTER (e <= -60) / count(*), 4)",
    "headway_median_min": "round(quantile_cont(h, 0.5) / 60, 1)", "headway_sd_min": "round(sqrt(var_samp(h)) / 60, 1)",
    "headway_variation": "round(sqrt(var_samp(h)) / nullif(avg(h), 0), 3)",
    "lat": "round(avg(lat), 5)", "lon": "round(avg(lon), 5)", "mean_confidence": "round(avg(trust), 3)",
}
NUMBERS |= {n: f"round(quantile_cont({c}, {q}), {d})" for n, c, q, d in (
    ("median_error_s", "e", 0.5, 1), ("error_p10_s", "e", 0.1, 1), ("error_p90_s", "e", 0.9, 1), ("length_m", "CAST(step_m AS DOUBLE)", 0.5, 0), ("median_time_s", "CAST(step_s AS DOUBLE)", 0.5, 0),
    ("median_distance_m", "dist_min_m", 0.5, 1), ("median_jump_m", "salto_m", 0.5, 1), ("median_jump_s", "salto_s", 0.5, 1))}
NUMBERS["speed_kmh"] = "round(3.6 * quantile_cont(step_m / step_s, 0.5), 1)"

ERRORS = "SELECT erro_s AS e, headway_obs_s AS h, letreiro AS line, sentido AS direction, cl AS code, * FROM pairs WHERE confianca >= 0.5"


def tally(view: str, keys: str, numbers: str, least: int = 0, order: str = "", top: int = 0, with_keys: str = "") -> str:
    """The numbers of each key of a view; keys with fewer rows than `least` and places after `top` are left out."""
    made = ", ".join(f"{NUMBERS[n]} AS {n}" for n in numbers.split())
    end = f" QUALIFY row_number() OVER (ORDER BY {order}) <= {top}" if top else ""
    return f"SELECT * EXCLUDE (_n) FROM (SELECT {keys}{with_keys}, {made}, count(*) AS _n FROM ({view}) GROUP BY {keys}) AS t WHERE _n >= {least}{end}"


@query("q02_line_ranking", oracle("pairs", tally(
    ERRORS, "line, direction", "rows mean_error_s median_error_s error_p90_s mean_abs_error_s late_share early_share headway_median_min", 100, "late_share DESC, line, direction", 40)))
def q02(spark, sf):
    return R.line_ranking(pairs_of(Bus(spark, sf)))


BANDS = "SELECT *, CASE WHEN k = 0 THEN '0-5 min' WHEN k = 1 THEN '5-10 min' WHEN k < 4 THEN '10-20 min' WHEN k < 6 THEN '20-30 min' ELSE '30-60 min' END AS horizon FROM (SELECT floor(horizonte_s / 300) AS k, * FROM ({}))"


@query("q03_error_by_horizon", oracle("pairs", tally(BANDS.format(ERRORS), "horizon", "rows mean_abs_error_s median_error_s error_p10_s error_p90_s")))
def q03(spark, sf):
    return R.horizon_table(pairs_of(Bus(spark, sf)))


@query("q04_part_weekday", oracle("pairs", tally(f"SELECT faixa AS day_part, CAST(dia_semana AS INTEGER) AS weekday, e FROM ({ERRORS})", "day_part, weekday", "rows mean_error_s late_share")))
def q04(spark, sf):
    return R.part_weekday(pairs_of(Bus(spark, sf)))


@query("q05_worst_cells", oracle("pairs", tally(
    f"SELECT celula AS cell, * FROM ({ERRORS})", "cell", "rows lines lat lon mean_error_s error_p90_s late_share", 50, "late_share DESC, rows DESC, cell", 50)))
def q05(spark, sf):
    return R.worst_cells(pairs_of(Bus(spark, sf)))


PLACED = f"SELECT a.*, a.cp AS stop, b.ordem AS place FROM ({ERRORS}) AS a LEFT JOIN line_stops AS b USING (cl, cp)"


@query("q06_critical_stops", oracle("pairs line_stops", tally(
    PLACED, "stop", "rows mean_error_s late_share", 50, "late_share DESC, stop", 40, ", max(parada_nome) AS stop_name, max(line) AS line, max(place) AS position")))
def q06(spark, sf):
    b = Bus(spark, sf)
    return R.critical_stops(pairs_of(b), b.line_stops)


@query("q07_headway_regularity", oracle("pairs", tally(
    "SELECT headway_obs_s AS h, letreiro AS line, sentido AS direction FROM pairs WHERE headway_obs_s >= 30 AND headway_obs_s <= 5400", "line, direction",
    "rows headway_median_min headway_sd_min headway_variation", 100, "headway_variation DESC, line, direction", 30)))
def q07(spark, sf):
    return R.headway_regularity(pairs_of(Bus(spark, sf)))


#: Neighbouring passages of a trip by self-join on the running number.
STEPS = """
WITH placed AS (SELECT a.*, b.s_m, row_number() OVER (PARTITION BY a.viagem_id ORDER BY a.ordem, a.t_chegada) AS k
  FROM (SELECT * FROM arrivals WHERE confianca >= 0.5) AS a LEFT JOIN line_stops AS b USING (cl, cp))
SELECT y.cl AS line_code, x.ordem AS from_position, y.s_m - x.s_m AS step_m, y.t_chegada - x.t_chegada AS step_s
FROM placed AS x JOIN placed AS y ON y.viagem_id = x.viagem_id AND y.k = x.k + 1 AND y.ordem = x.ordem + 1 AND y.s_m > x.s_m AND y.t_chegada BETWEEN x.t_chegada + 10 AND x.t_chegada + 1800"""


@query("q08_commercial_speed", oracle("arrivals line_stops", tally(
    STEPS, "line_code, from_position", "trips length_m median_time_s speed_kmh", 20, "speed_kmh, line_code, from_position", 40)))
def q08(spark, sf):
    b = Bus(spark, sf)
    return R.commercial_speed(b.arrivals, b.line_stops)


@query("q09_detection_quality", oracle("arrivals", tally(
    "SELECT metodo AS method, confianca AS trust, * FROM arrivals", "method", "rows mean_confidence median_distance_m median_jump_m median_jump_s")))
def q09(spark, sf):
    return R.detection_quality(Bus(spark, sf).arrivals)


@query("q10_hotspots", oracle("pairs", f"""
SELECT celula, count(*) AS n, round(avg(erro_s), 4) AS erro_medio_s, {LATE},
  string_agg(DISTINCT letreiro, ', ' ORDER BY letreiro) AS linhas, median(erro_s) AS p50_s,
  round(quantile_cont(erro_s, 0.9), 6) AS p90_s
FROM pairs WHERE faixa = 'pico_tarde' GROUP BY celula"""))
def q10(spark, sf):
    return rounded(R.hotspots(pairs_of(Bus(spark, sf)), "pico_tarde"), "p90_s")


@query("q11_critical_pairs", oracle("pairs", f"""
SELECT cp, letreiro, count(*) AS n, round(avg(erro_s), 4) AS erro_medio_s, {LATE} FROM pairs
GROUP BY cp, letreiro HAVING count(*) >= 20 ORDER BY prob_atraso_5min DESC, erro_medio_s DESC, cp, letreiro LIMIT 50"""))
def q11(spark, sf):
    return R.critical_pairs(pairs_of(Bus(spark, sf)))


def typed_segments(b):
    return seg_of(b).withColumns({"tipo": cal.day_type("t_origem", ("2024-01-01",)), "dia": cal.local_date("t_origem")})


@query("q12_slice_kpis", oracle("segments", """
SELECT count(*) AS n, count(DISTINCT viagem_id) AS viagens, round(avg(atrasado), 6) AS taxa,
  round(quantile_cont(atraso_s, 0.9), 6) AS atraso_p90_s, round(median(velocidade_kmh), 6) AS vel_mediana
FROM segments WHERE letreiro IN ('L1', 'L2', 'L3') AND sentido = 1 AND faixa = 'pico_tarde' AND tipo = 'util'"""))
def q12(spark, sf):
    out = R.slice_kpis(typed_segments(Bus(spark, sf)), letreiro=["L1", "L2", "L3"], sentido=1, faixa="pico_tarde", tipo="util")
    return rounded(out, "taxa", "atraso_p90_s", "vel_mediana")


@query("q13_group_aggregate", oracle("segments", """
SELECT letreiro, faixa, count(*) AS n, round(avg(atrasado), 6) AS taxa, round(avg(atraso_s), 6) AS atraso_medio_s,
  median(atraso_s) AS atraso_mediano_s, round(quantile_cont(atraso_s, 0.9), 6) AS atraso_p90_s,
  round(median(velocidade_kmh), 6) AS vel_mediana FROM segments GROUP BY ALL"""))
def q13(spark, sf):
    g = D.group_profile(seg_of(Bus(spark, sf)), ["letreiro", "faixa"])
    return rounded(g, "taxa", "atraso_medio_s", "atraso_p90_s", "vel_mediana")


@query("q14_relative_profile", oracle("segments", """
SELECT tipo, hora, count(*) AS n, round(100 * avg(atrasado), 6) AS taxa_pct, round(quantile_cont(atraso_rel, 0.9), 6) AS p90_rel
FROM segments GROUP BY ALL"""))
def q14(spark, sf):
    aggs = [F.count("*").alias("n"), F.round(100 * F.avg("atrasado"), 6).alias("taxa_pct")]
    g = summarize(typed_segments(Bus(spark, sf)), ["tipo", "hora"], aggs, {"atraso_rel": {"p90_rel": 0.9}})
    return rounded(g, "p90_rel")


@query("q15_lines_by_stop", oracle("segments", """
SELECT cp_destino, string_agg(DISTINCT letreiro, ', ' ORDER BY letreiro) AS linhas FROM segments GROUP BY 1"""))
def q15(spark, sf):
    return R.lines_by(seg_of(Bus(spark, sf)), ["cp_destino"])


@query("q16_official_place", oracle("arrivals stops", """
SELECT a.cp, n, CASE WHEN trim(coalesce(nome, '')) <> '' THEN nome ELSE concat('parada ', a.cp) END AS nome,
  round(coalesce(s.lat, la), 6) AS lat, round(coalesce(s.lon, lo), 6) AS lon
FROM (SELECT cp, count(*) AS n, avg(lat) AS la, avg(lon) AS lo FROM arrivals GROUP BY cp) a
LEFT JOIN (SELECT cp, CASE WHEN cp % 3 > 0 THEN nome END AS nome, CASE WHEN cp % 3 > 0 THEN lat END AS lat, CASE WHEN cp % 3 > 0 THEN lon END AS lon FROM stops) s ON s.cp = a.cp"""))
def q16(spark, sf):
    b = Bus(spark, sf)
    return rounded(R.official_place(b.arrivals, b.stops.withColumns({c: F.when(F.col("cp") % 3 > 0, F.col(c)) for c in ("nome", "lat", "lon")})), "lat", "lon")


@query("q17_flows_on_map", oracle("segments line_stops stops lines", """
, e AS (SELECT l.cl, arg_min(s.lat, l.ordem) AS lat0, arg_min(s.lon, l.ordem) AS lon0, arg_max(s.lat, l.ordem) AS lat1,
    arg_max(s.lon, l.ordem) AS lon1 FROM line_stops l JOIN stops s ON s.cp = l.cp GROUP BY l.cl),
r AS (SELECT cl, CASE WHEN sentido = 2 THEN terminal_secundario ELSE terminal_principal END AS a,
    CASE WHEN sentido = 2 THEN terminal_principal ELSE terminal_secundario END AS b FROM lines),
p AS (SELECT regiao, avg(lat) AS lat, avg(lon) AS lon FROM (
    SELECT a AS regiao, lat0 AS lat, lon0 AS lon FROM e JOIN r USING (cl) UNION ALL
    SELECT b, lat1, lon1 FROM e JOIN r USING (cl)) WHERE regiao IS NOT NULL GROUP BY 1)
SELECT regiao_origem, regiao_destino, n, round(taxa, 6) AS taxa, round(o.lat, 6) AS lat_o, round(o.lon, 6) AS lon_o,
  round(d.lat, 6) AS lat_d, round(d.lon, 6) AS lon_d
FROM (SELECT regiao_origem, regiao_destino, count(*) AS n, avg(atrasado) AS taxa FROM segments GROUP BY 1, 2 HAVING count(*) >= 30) f
JOIN p o ON o.regiao = regiao_origem JOIN p d ON d.regiao = regiao_destino""".strip()))
def q17(spark, sf):
    b = Bus(spark, sf)
    places = R.terminal_points(b.line_stops, b.stops, D.terminals(b.lines))
    return rounded(R.flows_on_map(seg_of(b), places), "taxa", "lat_o", "lon_o", "lat_d", "lon_d")


@query("q18_delay_histogram", oracle("segments", """
SELECT floor((least(greatest(atraso_s, -300), 900 - 0.03) + 300) / 30) * 30 - 300 AS de, count(*) AS n FROM segments GROUP BY 1"""))
def q18(spark, sf):
    return R.histogram(seg_of(Bus(spark, sf)), "atraso_s", -300.0, 900.0, 30.0)


@query("q19_scaled_colour", oracle("segments", """
, g AS (SELECT cp_destino, avg(atrasado) AS taxa FROM segments GROUP BY 1),
q AS (SELECT quantile_cont(taxa, 0.05) AS lo, quantile_cont(taxa, 0.95) AS hi FROM g)
SELECT cp_destino, round(1 - least(1.0, greatest(0.0, (taxa - lo) / (hi - lo))), 6) AS cor FROM g, q""".strip()))
def q19(spark, sf):
    g = seg_of(Bus(spark, sf)).groupBy("cp_destino").agg(F.avg("atrasado").alias("taxa"))
    return rounded(R.scale01(g, "taxa", "cor", invert=True), "cor").select("cp_destino", "cor")


@query("q20_modal_day_type", oracle("segments", """
SELECT CAST(dia_semana AS INTEGER) AS dia_semana, tipo AS tipo_modal FROM (
  SELECT dia_semana, tipo, count(*) AS n FROM segments GROUP BY 1, 2)
QUALIFY row_number() OVER (PARTITION BY dia_semana ORDER BY n DESC, tipo) = 1"""))
def q20(spark, sf):
    return R.modal_value(typed_segments(Bus(spark, sf)), ["dia_semana"], "tipo", "tipo_modal")


@query("q23_regularity_measures", oracle("segments", """
SELECT letreiro, sentido, n, round(c_vh, 6) AS c_vh, round(espera_s, 6) AS espera_s,
  CASE WHEN c_vh <= 0.21 THEN 1 WHEN c_vh <= 0.30 THEN 2 WHEN c_vh <= 0.39 THEN 3 WHEN c_vh <= 0.52 THEN 4
    WHEN c_vh <= 0.74 THEN 5 ELSE 6 END AS classe
FROM (SELECT letreiro, sentido, count(*) AS n, stddev_samp(headway_s) / avg(headway_s) AS c_vh,
    sum(headway_s * headway_s) / (2 * sum(headway_s)) AS espera_s
  FROM segments WHERE headway_s > 0 GROUP BY 1, 2)"""))
def q23(spark, sf):
    return rounded(R.regularity(seg_of(Bus(spark, sf)), ["letreiro", "sentido"]), "c_vh", "espera_s")
