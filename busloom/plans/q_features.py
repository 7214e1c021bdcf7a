"""Feature queries (W) and the model base."""

import math

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.functions.geo import num, sql_x, sql_y
from busloom.operators import features as W
from busloom.operators.delay import hourly_typical
from busloom.plans.q_delay import epoch, kept, pairs_of, rounded, seg_of
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_hour, sql_weekday
from busloom.session import cut_lineage

HOL = ("2024-01-01",)
ID = ["viagem_id", "ordem_origem"]
R7 = "CAST('0.7' AS DOUBLE)"
R85 = "CAST('0.85' AS DOUBLE)"

derive("split", ["segments"], f"""
SELECT *, CASE WHEN rn > nt THEN 'teste' WHEN rn <= floor(nt * {R85}) THEN 'treino' ELSE 'validacao' END AS parte
FROM (SELECT * EXCLUDE (percurso_tipico_s, atraso_s, atraso_rel, atrasado), percurso_tipico_s AS semana_s,
  row_number() OVER (ORDER BY t_origem, viagem_id, ordem_origem) AS rn, floor(count(*) OVER () * {R7}) AS nt FROM segments)
""")
derive("base", ["split"], """
SELECT *, tempo_percurso_s - percurso_tipico_s AS alvo_s, CAST(tempo_percurso_s - percurso_tipico_s >= 0.2 * percurso_tipico_s AS INTEGER) AS alvo_atrasado,
  greatest(-3.0, least(10.0, (tempo_percurso_s - percurso_tipico_s) / percurso_tipico_s)) AS rel
FROM (SELECT *, coalesce(median(tempo_percurso_s) FILTER (parte <> 'teste') OVER (PARTITION BY cl, ordem_origem, faixa),
  median(tempo_percurso_s) FILTER (parte <> 'teste') OVER (PARTITION BY cl, ordem_origem)) AS percurso_tipico_s FROM split)
WHERE percurso_tipico_s IS NOT NULL
""")


def recent_sql(keys: dict[str, str], value="alvo_s", lookback=1800, shift=0, src="base", qcols="viagem_id, ordem_origem") -> str:
    """Oracle of the recent state; `keys` maps an event column to the query expression."""
    part = ", ".join(keys)
    on = " AND ".join(f"q.k{i} = e.{c}" for i, c in enumerate(keys))
    qk = ", ".join(f"{x} AS k{i}" for i, x in enumerate(keys.values()))
    return f"""
SELECT {', '.join('q.' + c.strip() for c in qcols.split(','))}, CASE WHEN qt - et <= {lookback} THEN med END AS med, CASE WHEN qt - et <= {lookback} THEN cnt END AS cnt,
  CASE WHEN qt - et <= {lookback} THEN ult END AS ult, CASE WHEN qt - et <= {lookback} THEN CAST(qt - et AS DOUBLE) END AS idade
FROM (SELECT {qcols}, t_origem - {shift} AS qt, {qk} FROM {src}) q ASOF LEFT JOIN (
  SELECT {part}, et, med, cnt, ult FROM (SELECT {part}, t_chegada AS et, viagem_id, {value} AS ult, median({value}) OVER w AS med, count({value}) OVER w AS cnt
    FROM {src} WINDOW w AS (PARTITION BY {part} ORDER BY t_chegada RANGE BETWEEN {lookback - 1} PRECEDING AND CURRENT ROW))
  QUALIFY row_number() OVER (PARTITION BY {part}, et ORDER BY viagem_id DESC) = 1) e
ON {on} AND q.qt > e.et"""


derive("recent", ["base"], recent_sql({"cl": "cl", "ordem_origem": "ordem_origem"}))
derive("recent_early", ["base"], recent_sql({"cl": "cl", "ordem_origem": "ordem_origem"}, shift=1800))


def base_of(b, **kw):
    return W.model_base(seg_of(b), **kw)


@query("w01_calendar_features", oracle("forecasts", f"""
SELECT qid, CAST(m AS INTEGER) AS minuto_dia, CAST(d AS INTEGER) AS dia_semana, round(sin(m * {num(2 * math.pi)} / 1440), 6) AS sin_dia,
  round(cos(m * {num(2 * math.pi)} / 1440), 6) AS cos_dia, round(sin(d * {num(2 * math.pi)} / 7), 6) AS sin_semana,
  CAST(d IN (5, 6) AS INTEGER) AS fim_de_semana,
  CAST(strftime(make_timestamp((t_previsto - 10800) * 1000000), '%m-%d') IN ('01-01', '01-25', '04-21', '05-01') AS INTEGER) AS feriado
FROM (SELECT qid, t_previsto, (t_previsto - 10800) % 86400 // 60 AS m, {sql_weekday('t_previsto')} AS d FROM forecasts)"""))
def w01(spark, sf):
    d = W.calendar_features(Bus(spark, sf).forecasts)
    return rounded(d, "sin_dia", "cos_dia", "sin_semana").select(
        "qid", "minuto_dia", "dia_semana", "sin_dia", "cos_dia", "sin_semana", "fim_de_semana", "feriado")


@query("w02_route_fraction", oracle("arrivals line_stops", """
SELECT viagem_id, a.cp, s_m, round(s_m / fim, 6) AS fracao_percurso FROM arrivals a
LEFT JOIN line_stops l ON l.cl = a.cl AND l.cp = a.cp LEFT JOIN (SELECT cl, max(s_m) AS fim FROM line_stops GROUP BY 1) e ON e.cl = a.cl"""))
def w02(spark, sf):
    b = Bus(spark, sf)
    return rounded(W.route_fraction(b.arrivals, b.line_stops), "fracao_percurso").select("viagem_id", "cp", "s_m", "fracao_percurso")


@query("w03_active_vehicles", oracle("forecasts", """
SELECT qid, veiculos_ativos FROM (SELECT qid, cl, ts_coleta // 300 AS b FROM forecasts) JOIN (
  SELECT cl, ts_coleta // 300 AS b, count(DISTINCT prefixo) AS veiculos_ativos FROM forecasts GROUP BY 1, 2) USING (cl, b)"""))
def w03(spark, sf):
    return W.active_vehicles(Bus(spark, sf).forecasts).select("qid", "veiculos_ativos")


derive("arr_err", ["pairs"], "SELECT cl, cp, viagem_id, t_chegada, median(erro_s) AS e FROM pairs GROUP BY 1, 2, 3, 4")


@query("w04_arrival_error", oracle("arr_err", "SELECT cl, cp, viagem_id, t_chegada, e AS erro_chegada_s FROM arr_err"))
def w04(spark, sf):
    return epoch(W.arrival_errors(pairs_of(Bus(spark, sf))), "t_chegada")


@query("w05_stop_state", oracle("pairs arr_err", """
SELECT qid, e AS erro_anterior_parada_s, round(m3, 6) AS erro_media3_parada_s, CAST(hw AS DOUBLE) AS headway_anterior_s, CAST(ts_coleta - s.t_chegada AS DOUBLE) AS desde_ultimo_s
FROM pairs p ASOF LEFT JOIN (SELECT cl, cp, t_chegada, e, avg(e) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS m3, t_chegada - lag(t_chegada) OVER w AS hw FROM arr_err
  WINDOW w AS (PARTITION BY cl, cp ORDER BY t_chegada, viagem_id)
  QUALIFY row_number() OVER (PARTITION BY cl, cp, t_chegada ORDER BY viagem_id DESC) = 1) s
ON s.cl = p.cl AND s.cp = p.cp AND p.ts_coleta > s.t_chegada"""))
def w05(spark, sf):
    p = kept(pairs_of(Bus(spark, sf)), "qid", "cl", "cp", "viagem_id", "t_chegada", "ts_coleta", "erro_s")
    out = W.stop_state(p, W.arrival_errors(p), polls=p)
    return rounded(out, "erro_media3_parada_s").select("qid", "erro_anterior_parada_s", "erro_media3_parada_s", "headway_anterior_s", "desde_ultimo_s")


@query("w06_line_state", oracle("pairs arr_err", """
SELECT qid, e AS erro_anterior_linha_s FROM pairs p ASOF LEFT JOIN (
  SELECT cl, t_chegada, e FROM arr_err QUALIFY row_number() OVER (PARTITION BY cl, t_chegada ORDER BY concat(viagem_id, '|', cp) DESC) = 1) s
ON s.cl = p.cl AND p.ts_coleta > s.t_chegada"""))
def w06(spark, sf):
    p = kept(pairs_of(Bus(spark, sf)), "qid", "cl", "cp", "viagem_id", "t_chegada", "ts_coleta", "erro_s")
    return W.line_state(p.select("qid", "cl", "ts_coleta"), cut_lineage(W.arrival_errors(p))).select("qid", "erro_anterior_linha_s")


@query("w07_trip_state", oracle("pairs seg_raw", """
SELECT qid, desvio AS desvio_percurso_s, round(razao, 6) AS razao_percurso FROM pairs p ASOF LEFT JOIN (
  SELECT viagem_id, t_chegada, tempo_percurso_s - tip AS desvio, tempo_percurso_s / tip AS razao FROM (
    SELECT *, median(tempo_percurso_s) FILTER (t_chegada < 1705881600) OVER (PARTITION BY cl, ordem_origem, hora) AS tip FROM seg_raw)
  QUALIFY row_number() OVER (PARTITION BY viagem_id, t_chegada ORDER BY ordem_destino DESC) = 1) s
ON s.viagem_id = p.viagem_id AND p.ts_coleta > s.t_chegada"""))
def w07(spark, sf):
    b = Bus(spark, sf)
    t = hourly_typical(b.arrivals, before=F.timestamp_seconds(F.lit(1705881600)))
    return rounded(W.trip_state(kept(pairs_of(b), "qid", "viagem_id", "ts_coleta"), t), "razao_percurso").select("qid", "desvio_percurso_s", "razao_percurso")


@query("w08_cutoff_instant", oracle("pairs", f"""
SELECT t_chegada AS corte FROM (SELECT t_chegada, row_number() OVER (ORDER BY t_chegada) AS rn, count(*) OVER () AS n FROM pairs)
WHERE rn = floor(n * {R7}) + 1"""))
def w08(spark, sf):
    return epoch(W.cutoff_instant(pairs_of(Bus(spark, sf)), "t_chegada"), "corte")


@query("w09_modelling_table", oracle("pairs arr_err", f"""
, d AS (SELECT * FROM pairs WHERE confianca >= 0.4)
SELECT qid, CAST(erro_s AS INTEGER) AS alvo_erro_s, CAST(erro_s >= 300 AS INTEGER) AS alvo_atrasado, CAST({sql_hour('t_previsto')} AS INTEGER) AS hora, va AS veiculos_ativos
FROM d JOIN (SELECT cl, ts_coleta // 300 AS b, count(DISTINCT prefixo) AS va FROM d GROUP BY 1, 2) c ON c.cl = d.cl AND c.b = ts_coleta // 300""".strip()))
def w09(spark, sf):
    b = Bus(spark, sf)
    return W.modelling_table(pairs_of(b), b.arrivals, b.line_stops).select("qid", "alvo_erro_s", "alvo_atrasado", "hora", "veiculos_ativos")


derive("bins", ["pairs"], """
SELECT cl, cp, t_chegada // 10800 AS b, avg(erro_s) AS em, CAST(max(erro_s) AS DOUBLE) AS ex, count(DISTINCT prefixo) AS vol, median(headway_obs_s) AS hw
FROM pairs GROUP BY 1, 2, 3""")
derive("series", ["bins"], """
SELECT * FROM (SELECT g.cl, g.cp, g.b, em IS NOT NULL AS observado, last_value(em IGNORE NULLS) OVER w AS em, last_value(ex IGNORE NULLS) OVER w AS ex,
  coalesce(vol, 0) AS vol, coalesce(hw, mh) AS hw
FROM (SELECT cl, cp, mh, unnest(generate_series(a, z)) AS b FROM (SELECT cl, cp, min(b) AS a, max(b) AS z, median(hw) AS mh FROM bins GROUP BY 1, 2 HAVING count(*) >= 9)) g
LEFT JOIN bins o ON o.cl = g.cl AND o.cp = g.cp AND o.b = g.b
WINDOW w AS (PARTITION BY g.cl, g.cp ORDER BY g.b ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE em IS NOT NULL""")


def series_pairs(b):
    return kept(pairs_of(b), "cl", "cp", "t_chegada", "erro_s", "prefixo", "headway_obs_s")


@query("w10_regular_series", oracle("series", """
SELECT cl, cp, b * 10800 AS bin, observado, round(em, 6) AS erro_medio, ex AS erro_max, CAST(hw AS DOUBLE) AS headway, vol AS volume FROM series"""))
def w10(spark, sf):
    s = W.regular_series(series_pairs(Bus(spark, sf)), 180, 8)
    return rounded(epoch(s, "bin"), "erro_medio").select("cl", "cp", "bin", "observado", "erro_medio", "erro_max", "headway", "volume")


@query("w11_sliding_windows", oracle("series", """
SELECT cl, cp, b * 10800 AS bin, round(em, 6) AS alvo, round(p, 6) AS primeiro, CAST(v AS BIGINT) AS volume FROM (
  SELECT *, lag(em, 8) OVER w AS p, sum(vol) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS v FROM series WINDOW w AS (PARTITION BY cl, cp ORDER BY b))
WHERE p IS NOT NULL AND observado"""))
def w11(spark, sf):
    s = W.sliding_windows(W.regular_series(series_pairs(Bus(spark, sf)), 180, 8), 8)
    return epoch(s, "bin").select("cl", "cp", "bin", F.round("alvo", 6).alias("alvo"), F.round(F.col("passos")[0]["erro_medio"], 6).alias("primeiro"),
                                  F.aggregate("passos", F.lit(0).cast("long"), lambda a, x: a + x["volume"]).alias("volume"))


def node_pairs(b):
    return kept(pairs_of(b), "cl", "cp", "t_chegada", "erro_s", "headway_obs_s", "lat", "lon")


@query("w12_stop_nodes", oracle("pairs", f"""
, d AS (SELECT *, t_chegada < (SELECT quantile_cont(t_chegada, {R7}) FROM pairs) AS cedo FROM pairs)
SELECT cp, count(*) AS n, round(avg(erro_s), 6) AS erro_medio, round(coalesce(stddev_samp(erro_s), 0), 6) AS erro_desvio, count(DISTINCT cl) AS linhas,
  median(erro_s) AS erro_mediano, CAST(median(headway_obs_s) AS DOUBLE) AS headway, any_value(alvo) AS alvo
FROM d LEFT JOIN (SELECT cp, median(erro_s) AS alvo FROM d WHERE NOT cedo GROUP BY 1) f USING (cp) WHERE cedo GROUP BY cp""".strip()))
def w12(spark, sf):
    return rounded(W.stop_nodes(node_pairs(Bus(spark, sf))), "erro_medio", "erro_desvio").drop("lat", "lon")


@query("w13_stop_edges", oracle("pairs segments", f"""
, d AS (SELECT * FROM pairs WHERE t_chegada < (SELECT quantile_cont(t_chegada, {R7}) FROM pairs)),
n AS (SELECT cp, {sql_x('avg(lon)')} AS x, {sql_y('avg(lat)')} AS y FROM d GROUP BY 1)
SELECT cp_origem AS a, cp_destino AS b, CAST(median(tempo_percurso_s) AS DOUBLE) AS peso, 'itinerario' AS tipo FROM segments
WHERE cp_origem IN (SELECT cp FROM n) AND cp_destino IN (SELECT cp FROM n) GROUP BY 1, 2
UNION ALL SELECT p.cp, q.cp, 0.0, 'vizinhanca' FROM n p, n q WHERE p.cp <> q.cp AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 400""".strip()))
def w13(spark, sf):
    b = Bus(spark, sf)
    return W.stop_edges(cut_lineage(W.stop_nodes(node_pairs(b))), kept(seg_of(b), "cp_origem", "cp_destino", "tempo_percurso_s"))


@query("w14_day_type", oracle("segments", "SELECT viagem_id, ordem_origem, tipo FROM segments"))
def w14(spark, sf):
    return seg_of(Bus(spark, sf)).select(*ID, cal.day_type("t_origem", HOL).alias("tipo"))


@query("w15_hierarchical_reference", oracle("split", """
SELECT viagem_id, ordem_origem, coalesce(CASE WHEN count(*) FILTER (parte <> 'teste') OVER a >= 3 THEN median(tempo_percurso_s) FILTER (parte <> 'teste') OVER a END,
  median(tempo_percurso_s) FILTER (parte <> 'teste') OVER b, median(tempo_percurso_s) FILTER (parte <> 'teste') OVER c) AS percurso_tipico_s
FROM split WINDOW a AS (PARTITION BY cl, ordem_origem, tipo, faixa), b AS (PARTITION BY cl, ordem_origem, faixa), c AS (PARTITION BY cl, ordem_origem)"""))
def w15(spark, sf):
    s = seg_of(Bus(spark, sf)).withColumn("tipo", cal.day_type("t_origem", HOL))
    s = kept(s, *ID, "cl", "tipo", "faixa", "t_origem", "tempo_percurso_s")
    s = W.time_split(s, ["t_origem", "viagem_id", "ordem_origem"])
    return W.hierarchical_reference(s, "tempo_percurso_s", W.BY_TYPE, F.col("parte") != "teste", "percurso_tipico_s").select(*ID, "percurso_tipico_s")


@query("w16_recent_traffic", oracle("recent", """
SELECT viagem_id, ordem_origem, med AS desvio_recente_trecho_s, cnt AS n_recente_trecho, ult AS desvio_ultimo_veiculo_s, idade AS desde_ultimo_veiculo_s FROM recent"""))
def w16(spark, sf):
    return W.recent_traffic(base_of(Bus(spark, sf))).select(
        *ID, "desvio_recente_trecho_s", "n_recente_trecho", "desvio_ultimo_veiculo_s", "desde_ultimo_veiculo_s")


@query("w17_previous_segment", oracle("base", """
SELECT viagem_id, ordem_origem, CASE WHEN ordem_origem - lag(ordem_origem) OVER w = 1 THEN lag(alvo_s) OVER w END AS atraso_trecho_anterior_s
FROM base WINDOW w AS (PARTITION BY viagem_id ORDER BY ordem_origem)"""))
def w17(spark, sf):
    return W.previous_segment(base_of(Bus(spark, sf))).select(*ID, "atraso_trecho_anterior_s")


@query("w18_target", oracle("base", "SELECT viagem_id, ordem_origem, alvo_s, alvo_atrasado, parte FROM base"))
def w18(spark, sf):
    return base_of(Bus(spark, sf)).select(*ID, "alvo_s", "alvo_atrasado", "parte")


derive("up", ["base"], recent_sql({"cl": "cl", "ordem_origem": "ordem_origem - 1"}))
derive("down", ["base"], recent_sql({"cl": "cl", "ordem_origem": "ordem_origem + 1"}))
derive("physical", ["base"], recent_sql({"cp_origem": "cp_origem", "cp_destino": "cp_destino"}))


@query("w19_neighbour_traffic", oracle("up down", """
SELECT u.viagem_id, u.ordem_origem, u.med AS acima_med, u.cnt AS acima_n, u.idade AS acima_idade, d.med AS abaixo_med, d.cnt AS abaixo_n, d.idade AS abaixo_idade
FROM up u JOIN down d ON d.viagem_id = u.viagem_id AND d.ordem_origem = u.ordem_origem"""))
def w19(spark, sf):
    d = W.neighbour_traffic(W.neighbour_traffic(base_of(Bus(spark, sf)), -1, "acima"), 1, "abaixo")
    return d.select(*ID, "acima_med", "acima_n", "acima_idade", "abaixo_med", "abaixo_n", "abaixo_idade")


@query("w20_physical_traffic", oracle("physical", """
SELECT viagem_id, ordem_origem, med AS fisico_med, cnt AS fisico_n, idade AS fisico_idade FROM physical"""))
def w20(spark, sf):
    return W.physical_traffic(base_of(Bus(spark, sf))).select(*ID, "fisico_med", "fisico_n", "fisico_idade")


# a third of the forecasts name no stop, so that some segments are not covered
derive("fc_some", ["forecasts"], "SELECT * REPLACE (CASE WHEN cp % 3 <> 1 THEN cp END AS cp) FROM forecasts")


def some_unnamed(forecasts):
    return forecasts.withColumn("cp", F.when(F.col("cp") % 3 != 1, F.col("cp")))


derive("covered", ["base", "fc_some", "cum"], """
SELECT b.*, a AS ordem_api, cp_api, a - b.ordem_origem AS api_trechos,
  CASE WHEN a = b.ordem_destino THEN percurso_tipico_s ELSE c1.c - c0.c END AS tipico_estirao_s
FROM base b LEFT JOIN (SELECT s.cl, s.o AS ordem_destino, min(h.o) AS a, arg_min(h.cp, h.o) AS cp_api
    FROM (SELECT DISTINCT cl, ordem_destino AS o FROM base) s JOIN (
      SELECT cl, ordem_destino AS o, min(cp_destino) AS cp FROM base WHERE (cl, cp_destino) IN (SELECT (cl, cp) FROM fc_some) GROUP BY 1, 2) h ON h.cl = s.cl AND h.o >= s.o
    GROUP BY 1, 2) n ON n.cl = b.cl AND n.ordem_destino = b.ordem_destino
LEFT JOIN cum c0 ON c0.cl = b.cl AND c0.faixa = b.faixa AND c0.o = b.ordem_origem
LEFT JOIN cum c1 ON c1.cl = b.cl AND c1.faixa = b.faixa AND c1.o = a""")
derive("cum", ["base"], """
SELECT cl, faixa, o, coalesce(sum(v) OVER (PARTITION BY cl, faixa ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c FROM (
  SELECT g.cl, f.faixa, g.o, coalesce(p.m, s.m, l.m) AS v
  FROM (SELECT cl, unnest(generate_series(0, greatest(max(ordem_origem), max(ordem_destino)))) AS o FROM base GROUP BY cl) g
  JOIN (SELECT DISTINCT cl, faixa FROM base) f ON f.cl = g.cl
  LEFT JOIN (SELECT cl, ordem_origem AS o, median(percurso_tipico_s) AS m FROM base GROUP BY 1, 2) s ON s.cl = g.cl AND s.o = g.o
  LEFT JOIN (SELECT cl, faixa, ordem_origem AS o, median(percurso_tipico_s) AS m FROM base GROUP BY 1, 2, 3) p ON p.cl = g.cl AND p.o = g.o AND p.faixa = f.faixa
  LEFT JOIN (SELECT cl, median(m) AS m FROM (SELECT cl, ordem_origem, median(percurso_tipico_s) AS m FROM base GROUP BY 1, 2) GROUP BY 1) l ON l.cl = g.cl)""")


@query("w21_covered_stop", oracle("covered", """
SELECT viagem_id, ordem_origem, cp_api, api_trechos, round(tipico_estirao_s, 6) AS tipico_estirao_s FROM covered"""))
def w21(spark, sf):
    b = Bus(spark, sf)
    d = W.covered_stop(base_of(b), some_unnamed(b.forecasts))
    return rounded(d, "tipico_estirao_s").select(*ID, "cp_api", "api_trechos", "tipico_estirao_s")


@query("w22_forecast_deviation", oracle("covered fc_some", """
SELECT viagem_id, ordem_origem, CASE WHEN ok THEN round((t_previsto - t_origem - tipico_estirao_s) * percurso_tipico_s / tipico_estirao_s, 4) END AS api_desvio_s,
  CASE WHEN ok THEN CAST(t_origem - ts_coleta AS DOUBLE) END AS api_idade_s
FROM (SELECT c.*, f.t_previsto, f.ts_coleta, coalesce(t_origem - f.ts_coleta <= 300, FALSE) AS ok FROM covered c ASOF LEFT JOIN (
  SELECT * FROM fc_some QUALIFY row_number() OVER (PARTITION BY prefixo, cp, ts_coleta ORDER BY qid DESC) = 1) f
  ON f.prefixo = c.prefixo AND f.cp = c.cp_api AND c.t_origem > f.ts_coleta)"""))
def w22(spark, sf):
    b = Bus(spark, sf)
    d = W.forecast_deviation(base_of(b), some_unnamed(b.forecasts))
    return rounded(d, "api_desvio_s", digits=4).select(*ID, "api_desvio_s", "api_idade_s")


@query("w23_trip_context", oracle("base", """
SELECT viagem_id, ordem_origem, coalesce(sum(alvo_s) OVER (PARTITION BY viagem_id ORDER BY ordem_origem ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS atraso_acumulado_s,
  round(ordem_origem / max(ordem_destino) OVER (PARTITION BY cl), 6) AS fracao_rota FROM base"""))
def w23(spark, sf):
    return rounded(W.trip_context(base_of(Bus(spark, sf))), "fracao_rota").select(*ID, "atraso_acumulado_s", "fracao_rota")


@query("w24_trend", oracle("recent recent_early", """
SELECT r.viagem_id, r.ordem_origem, e.med AS desvio_30_60min_s, r.med - e.med AS tendencia_s FROM recent r
JOIN recent_early e ON e.viagem_id = r.viagem_id AND e.ordem_origem = r.ordem_origem"""))
def w24(spark, sf):
    return W.trend(base_of(Bus(spark, sf))).select(*ID, "desvio_30_60min_s", "tendencia_s")


@query("w25_holiday_flag", oracle("segments", "SELECT viagem_id, ordem_origem, CAST(dia = 19723 AS INTEGER) AS feriado FROM segments"))
def w25(spark, sf):
    return W.holiday_flag(seg_of(Bus(spark, sf)), HOL).select(*ID, "feriado")


@query("w26_trip_sequence", oracle("base", """
SELECT viagem_id, ordem_origem, coalesce(lag(alvo_s) OVER w / 60, 0) AS d1, round(coalesce(lag(rel, 2) OVER w, 0), 6) AS r2,
  coalesce(lag(percurso_tipico_s, 3) OVER w / 100, 0) AS t3, coalesce((ordem_origem - lag(ordem_origem, 4) OVER w) / 4, 0) AS o4,
  CAST(lag(rel, 2) OVER w IS NOT NULL AS INTEGER) AS p2 FROM base WINDOW w AS (PARTITION BY viagem_id ORDER BY ordem_origem)"""))
def w26(spark, sf):
    s = F.col("seq_viagem")
    return W.trip_sequence(base_of(Bus(spark, sf)), 4).select(
        *ID, s[3]["desvio"].alias("d1"), F.round(s[2]["rel"], 6).alias("r2"), s[1]["tipico"].alias("t3"), s[0]["distancia"].alias("o4"), s[2]["presente"].alias("p2"))


@query("w27_segment_sequence", oracle("base", """
, e AS (SELECT cl, ordem_origem, t_chegada, viagem_id, [lag(t_chegada, 3) OVER w, lag(t_chegada, 2) OVER w, lag(t_chegada) OVER w, t_chegada] AS ts,
    [lag(alvo_s, 3) OVER w, lag(alvo_s, 2) OVER w, lag(alvo_s) OVER w, alvo_s] AS vs
  FROM base WINDOW w AS (PARTITION BY cl, ordem_origem ORDER BY t_chegada, viagem_id)),
f AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY cl, ordem_origem, t_chegada ORDER BY viagem_id DESC) = 1),
m AS (SELECT b.viagem_id, b.ordem_origem, b.t_origem, ts, vs FROM base b ASOF LEFT JOIN f ON f.cl = b.cl AND f.ordem_origem = b.ordem_origem AND b.t_origem > f.t_chegada),
x AS (SELECT viagem_id, ordem_origem, [coalesce(t_origem - ts[i] <= 3600, FALSE) FOR i IN [1, 2, 3, 4]] AS ok, vs FROM m)
SELECT viagem_id, ordem_origem, CAST(ok[1] AS INTEGER) + CAST(ok[2] AS INTEGER) + CAST(ok[3] AS INTEGER) + CAST(ok[4] AS INTEGER) AS n,
  round(CASE WHEN ok[4] THEN vs[4] / 60 ELSE 0 END, 6) AS ultimo, round(CASE WHEN ok[1] THEN vs[1] / 60 ELSE 0 END, 6) AS primeiro FROM x""".strip()))
def w27(spark, sf):
    d = W.segment_sequence(base_of(Bus(spark, sf)), 4)
    s = F.col("seq_trecho")
    return d.select(*ID, F.aggregate(s, F.lit(0), lambda a, x: a + x["presente"]).alias("n"), F.round(s[3]["desvio"], 6).alias("ultimo"),
                    F.round(s[0]["desvio"], 6).alias("primeiro"))


derive("seg_nodes", ["base"], f"""
SELECT concat(cp_origem, '>', cp_destino) AS no, {sql_x('avg(lon)')} AS x, {sql_y('avg(lat)')} AS y FROM base GROUP BY 1""")


@query("w28_segment_graph", oracle("base seg_nodes", """
, l AS (SELECT concat(cp_origem, '>', cp_destino) AS a, cp_destino, lead(concat(cp_origem, '>', cp_destino)) OVER w AS b, lead(cp_origem) OVER w AS o
  FROM base WINDOW w AS (PARTITION BY viagem_id ORDER BY ordem_origem)),
s AS (SELECT DISTINCT a, b FROM l WHERE cp_destino = o AND a <> b),
v AS (SELECT p.no AS a, q.no AS b FROM seg_nodes p, seg_nodes q WHERE p.no <> q.no AND sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 1500
  AND (p.no, q.no) NOT IN (SELECT (a, b) FROM s) AND (q.no, p.no) NOT IN (SELECT (a, b) FROM s)),
e AS (SELECT b AS de, a AS para, 'acima' AS relacao FROM s UNION ALL SELECT a, b, 'abaixo' FROM s UNION ALL SELECT a, b, 'vizinho' FROM v)
SELECT de, para, relacao, round(1.0 / count(*) OVER (PARTITION BY de, relacao), 6) AS peso FROM e""".strip()))
def w28(spark, sf):
    return rounded(W.segment_graph(base_of(Bus(spark, sf)), 1500.0)[1], "peso")


@query("w29_network_state", oracle("base", f"""
, v AS (SELECT concat(cp_origem, '>', cp_destino) AS no, t_chegada, viagem_id, alvo_s, rel FROM base),
e AS (SELECT no, t_chegada, median(rel) OVER a AS r15, median(rel) OVER b AS r60, median(alvo_s) OVER a AS d15, count(alvo_s) OVER a AS n15 FROM v
  WINDOW a AS (PARTITION BY no ORDER BY t_chegada RANGE BETWEEN 899 PRECEDING AND CURRENT ROW), b AS (PARTITION BY no ORDER BY t_chegada RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)
  QUALIFY row_number() OVER (PARTITION BY no, t_chegada ORDER BY viagem_id DESC) = 1),
g AS (SELECT no, s FROM (SELECT DISTINCT no FROM v), (SELECT unnest(generate_series(min(t_origem) // 1800, max(t_origem) // 1800)) * 1800 AS s FROM base)),
m AS (SELECT g.no, g.s, (g.s - e.t_chegada) / 60 AS idade, r15, r60, d15, n15 FROM g ASOF LEFT JOIN e ON e.no = g.no AND g.s > e.t_chegada)
SELECT no, s AS inicio, round(CASE WHEN idade <= 15 THEN r15 ELSE 0 END, 6) AS rel15, round(CASE WHEN idade <= 60 THEN r60 ELSE 0 END, 6) AS rel60,
  round(CASE WHEN idade <= 15 THEN d15 / 60 ELSE 0 END, 6) AS desvio15_min, round(CASE WHEN idade <= 15 THEN ln(1 + n15) ELSE 0 END, 6) AS log_n15,
  round(CASE WHEN idade <= 60 THEN ln(1 + idade) / {num(math.log1p(60))} ELSE 1 END, 6) AS idade, CAST(coalesce(idade <= 60, FALSE) AS INTEGER) AS presente FROM m""".strip()))
def w29(spark, sf):
    need = (*ID, "cl", "faixa", "cp_origem", "cp_destino", "t_origem", "t_chegada", "tempo_percurso_s", "percurso_tipico_s")
    d = W.model_base(seg_of(Bus(spark, sf)).select(*need))
    s = W.network_state(d, W.every_bin(d, 30))
    return rounded(epoch(s, "inicio"), "rel15", "rel60", "desvio15_min", "log_n15", "idade")


@query("w30_relative_deviation", oracle("base", "SELECT viagem_id, ordem_origem, round(rel, 6) AS rel FROM base"))
def w30(spark, sf):
    return base_of(Bus(spark, sf)).select(*ID, F.round(W.relative_deviation(), 6).alias("rel"))


@query("w31_standardise", oracle("base", """
, s AS (SELECT avg(headway_s) AS m1, stddev_pop(headway_s) + 1e-6 AS s1, avg(extensao_m) AS m2, stddev_pop(extensao_m) + 1e-6 AS s2 FROM base WHERE parte <> 'teste')
SELECT viagem_id, ordem_origem, CAST(headway_s IS NULL AS INTEGER) AS headway_s_nulo, round(coalesce((headway_s - m1) / s1, 0), 6) AS headway_s_z,
  round(coalesce((extensao_m - m2) / s2, 0), 6) AS extensao_m_z FROM base, s""".strip()))
def w31(spark, sf):
    d = W.standardise(base_of(Bus(spark, sf)), ["headway_s", "extensao_m"], F.col("parte") != "teste")
    return rounded(d, "headway_s_z", "extensao_m_z").select(*ID, "headway_s_nulo", "headway_s_z", "extensao_m_z")


derive("depart", ["base"], """
SELECT *, t_origem - lag(t_origem) OVER w AS intervalo_s, lag(viagem_id) OVER w AS va, lead(viagem_id) OVER w AS vs
FROM base WINDOW w AS (PARTITION BY cl, cp_origem ORDER BY t_origem, viagem_id)""")


@query("w32_departure_interval", oracle("depart", """
SELECT viagem_id, ordem_origem, CAST(intervalo_s AS DOUBLE) AS intervalo_s,
  round(intervalo_s / nullif(median(intervalo_s) FILTER (parte <> 'teste') OVER (PARTITION BY cl, cp_origem, faixa), 0), 6) AS intervalo_rel FROM depart"""))
def w32(spark, sf):
    return rounded(W.departure_interval(base_of(Bus(spark, sf))), "intervalo_rel").select(*ID, "intervalo_s", "intervalo_rel")


@query("w33_neighbours_on_line", oracle("depart", """
, p AS (SELECT viagem_id, t_chegada, max(ordem_destino) AS o FROM depart GROUP BY 1, 2),
a AS (SELECT d.*, p.o AS oa FROM depart d ASOF LEFT JOIN p ON p.viagem_id = d.va AND d.t_origem > p.t_chegada)
SELECT a.viagem_id, a.ordem_origem, oa - a.ordem_origem AS paradas_ate_anterior, a.ordem_origem - p.o AS paradas_ate_seguinte
FROM a ASOF LEFT JOIN p ON p.viagem_id = a.vs AND a.t_origem > p.t_chegada""".strip()))
def w33(spark, sf):
    return W.neighbours_on_line(base_of(Bus(spark, sf))).select(*ID, "paradas_ate_anterior", "paradas_ate_seguinte")


@query("w34_segment_spread", oracle("base", """
SELECT cl, ordem_origem, faixa, round(quantile_cont(alvo_s, 0.75), 6) AS trecho_p75_s, round(quantile_cont(alvo_s, 0.9), 6) AS trecho_p90_s, round(stddev_samp(alvo_s), 6) AS trecho_dp_s
FROM base WHERE parte <> 'teste' GROUP BY 1, 2, 3"""))
def w34(spark, sf):
    d = W.segment_spread(base_of(Bus(spark, sf))).where("trecho_p75_s IS NOT NULL")
    c = ["cl", "ordem_origem", "faixa", "trecho_p75_s", "trecho_p90_s", "trecho_dp_s"]
    return rounded(d.select(*c).distinct(), *c[3:])


@query("w35_out_of_fold_spread", oracle("base", """
, t AS (SELECT cl, ordem_origem, faixa, dia, alvo_s FROM base WHERE parte <> 'teste')
SELECT d.cl, d.ordem_origem, d.faixa, CAST(d.dia AS BIGINT) AS dia, round(quantile_cont(alvo_s, 0.75), 6) AS oof_p75_s, round(quantile_cont(alvo_s, 0.9), 6) AS oof_p90_s,
  round(stddev_samp(alvo_s), 4) AS oof_dp_s
FROM (SELECT DISTINCT cl, ordem_origem, faixa, dia FROM t) d JOIN t ON t.cl = d.cl AND t.ordem_origem = d.ordem_origem AND t.faixa = d.faixa AND t.dia <> d.dia
GROUP BY 1, 2, 3, 4""".strip()))
def w35(spark, sf):
    day = F.datediff(cal.local_date("t_origem"), F.lit("1970-01-01").cast("date")).cast("long")
    d = W.out_of_fold_spread(base_of(Bus(spark, sf)), day)
    return rounded(rounded(d, "oof_p75_s", "oof_p90_s"), "oof_dp_s", digits=4)


derive("rain", ["positions"], """
SELECT round((-23.65 + (event_id % 5) * 0.05) / 0.05) AS la, round((-46.75 + (event_id % 4) * 0.05) / 0.05) AS lo, ta // 3600 * 3600 AS h, max(floor(value)) / 10 AS mm
FROM positions GROUP BY 1, 2, 3""")


def rain_of(b):
    p = b.positions
    return p.groupBy((-23.65 + (F.col("event_id") % 5) * 0.05).alias("lat"), (-46.75 + (F.col("event_id") % 4) * 0.05).alias("lon"),
                     F.date_trunc("hour", "ta").alias("hora")).agg((F.max(F.floor("value")) / 10).alias("chuva_mm"))


@query("w36_rain", oracle("segments rain", """
, c AS (SELECT *, sum(mm) OVER (PARTITION BY la, lo ORDER BY h RANGE BETWEEN 7200 PRECEDING AND CURRENT ROW) AS mm3 FROM rain),
y AS (SELECT h, avg(mm) AS city FROM rain GROUP BY 1), x AS (SELECT min(la) AS a0, max(la) AS a1, min(lo) AS o0, max(lo) AS o1 FROM rain)
SELECT viagem_id, ordem_origem, mm AS chuva_1h_mm, round(mm3, 6) AS chuva_3h_mm, round(city, 6) AS chuva_cidade_1h_mm
FROM (SELECT viagem_id, ordem_origem, least(greatest(round(lat / 0.05), a0), a1) AS la, least(greatest(round(lon / 0.05), o0), o1) AS lo, t_origem // 3600 * 3600 AS h FROM segments, x) s
LEFT JOIN c ON c.la = s.la AND c.lo = s.lo AND c.h = s.h LEFT JOIN y ON y.h = s.h""".strip()))
def w36(spark, sf):
    b = Bus(spark, sf)
    d = W.rain_features(seg_of(b), rain_of(b))
    return rounded(d, "chuva_3h_mm", "chuva_cidade_1h_mm").select(*ID, "chuva_1h_mm", "chuva_3h_mm", "chuva_cidade_1h_mm")


@query("w37_direct_forecast", oracle("base forecasts", """
SELECT viagem_id, ordem_origem, CASE WHEN ok THEN t_previsto - t_origem - percurso_tipico_s END AS api_desvio_s, CASE WHEN ok THEN CAST(t_origem - ts_coleta AS DOUBLE) END AS api_idade_s
FROM (SELECT b.*, f.t_previsto, f.ts_coleta, coalesce(t_origem - f.ts_coleta <= 300, FALSE) AS ok FROM base b ASOF LEFT JOIN (
  SELECT * FROM forecasts QUALIFY row_number() OVER (PARTITION BY prefixo, cp, ts_coleta ORDER BY qid DESC) = 1) f
  ON f.prefixo = b.prefixo AND f.cp = b.cp_destino AND b.t_origem > f.ts_coleta)"""))
def w37(spark, sf):
    b = Bus(spark, sf)
    return W.direct_forecast(base_of(b), b.forecasts).select(*ID, "api_desvio_s", "api_idade_s")
