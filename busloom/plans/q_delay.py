"""Queries of the delay table (D), forecast matching (F)."""

from pyspark.sql import functions as F

from busloom.operators import delay as D
from busloom.operators import forecast as FC
from busloom.operators.quantiles import group_quantiles
from busloom.plans import oracle_tables  # noqa: F401
from busloom.plans.registry import query
from busloom.plans.standins import Bus, oracle, sql_hour
from busloom.session import cut_lineage


def epoch(df, *cols):
    return df.withColumns({c: F.unix_seconds(c) for c in cols})


def seg_of(b: Bus, *cols):
    """The delay table; with columns, these alone, from stored segments (see `build_segments`)."""
    return D.build_segments(b.arrivals, b.line_stops, b.lines, seen=b.passage_rows, columns=list(cols) or None)


def pairs_of(b: Bus):
    rows = b.passage_rows  # two forecasts a passage
    return FC.build_pairs(b.forecasts, b.arrivals, b.stops, raw=rows.unionByName(rows), seen=rows)


def kept(df, *cols):
    """The named columns, stored: a table that is read more than once, or whose groups are counted first, is built once."""
    return cut_lineage(df.select(*cols))


@query("d01_consecutive_segments", oracle("seg_raw", """
SELECT viagem_id, trecho, cp_origem, cp_destino, ordem_origem, ordem_destino, t_origem, t_chegada,
  CAST(tempo_percurso_s AS DOUBLE) AS tempo_percurso_s FROM seg_raw"""))
def d01(spark, sf):
    s = D.consecutive_segments(Bus(spark, sf).arrivals)
    return epoch(s, "t_origem", "t_chegada").select(
        "viagem_id", "trecho", "cp_origem", "cp_destino", "ordem_origem", "ordem_destino", "t_origem",
        "t_chegada", "tempo_percurso_s")


@query("d02_segment_length_speed", oracle("seg_ref", """
SELECT viagem_id, ordem_origem, extensao_m, round(velocidade_kmh, 6) AS velocidade_kmh FROM seg_ref"""))
def d02(spark, sf):
    b = Bus(spark, sf)
    s = D.attach_length(D.consecutive_segments(b.arrivals), b.line_stops)
    return s.select("viagem_id", "ordem_origem", "extensao_m", F.round("velocidade_kmh", 6).alias("velocidade_kmh"))


@query("d03_calendar_cuts", oracle("seg_raw", """
SELECT hora, dia_semana, faixa, CAST(faixa IN ('pico_manha', 'pico_tarde') AS INTEGER) AS pico,
  CAST(dia_semana IN (5, 6) AS INTEGER) AS fim_de_semana, count(*) AS n
FROM seg_raw GROUP BY ALL"""))
def d03(spark, sf):
    s = D.calendar_cuts(D.consecutive_segments(Bus(spark, sf).arrivals))
    return s.groupBy("hora", "dia_semana", "faixa", "pico", "fim_de_semana").agg(F.count("*").alias("n"))


@query("d04_reference_median", oracle("seg_raw", """
SELECT cl, ordem_origem, faixa, CAST(median(tempo_percurso_s) AS DOUBLE) AS percurso_tipico_s,
  count(*) AS n_referencia
FROM seg_raw GROUP BY ALL HAVING count(*) >= 5"""))
def d04(spark, sf):
    s = D.calendar_cuts(D.consecutive_segments(Bus(spark, sf).arrivals))
    ref = group_quantiles(
        s, ["cl", "ordem_origem", "faixa"], "tempo_percurso_s", {"percurso_tipico_s": 0.5}, "n_referencia")
    return ref.where("n_referencia >= 5")


@query("d05_delay_flags", oracle("segments", """
SELECT viagem_id, ordem_origem, atraso_s, round(atraso_rel, 6) AS atraso_rel, atrasado FROM segments"""))
def d05(spark, sf):
    return seg_of(Bus(spark, sf)).select(
        "viagem_id", "ordem_origem", "atraso_s", F.round("atraso_rel", 6).alias("atraso_rel"), "atrasado")


@query("d06_headway", oracle("segments", """
SELECT cl, cp_destino, viagem_id, CAST(headway_s AS DOUBLE) AS headway_s FROM segments"""))
def d06(spark, sf):
    return seg_of(Bus(spark, sf)).select("cl", "cp_destino", "viagem_id", "headway_s")


@query("d07_terminals", oracle("lines", """
SELECT cl, CASE WHEN sentido = 2 THEN terminal_secundario ELSE terminal_principal END AS regiao_origem,
  CASE WHEN sentido = 2 THEN terminal_principal ELSE terminal_secundario END AS regiao_destino FROM lines"""))
def d07(spark, sf):
    return D.terminals(Bus(spark, sf).lines)


@query("d08_midpoint_cell", oracle("segments", """
SELECT celula, count(*) AS n, round(avg(lat), 5) AS lat, round(avg(lon), 5) AS lon FROM segments GROUP BY celula"""))
def d08(spark, sf):
    return seg_of(Bus(spark, sf)).groupBy("celula").agg(
        F.count("*").alias("n"), F.round(F.avg("lat"), 5).alias("lat"), F.round(F.avg("lon"), 5).alias("lon"))


@query("d09_delay_summary", oracle("segments", """
SELECT count(*) AS trechos, count(DISTINCT viagem_id) AS viagens, count(DISTINCT cl) AS linhas,
  round(avg(atrasado), 4) AS taxa_atraso, round(median(atraso_s), 1) AS atraso_mediano_s,
  round(quantile_cont(atraso_s, 0.9), 1) AS atraso_p90_s,
  round(median(percurso_tipico_s), 1) AS percurso_tipico_mediano_s,
  round(median(velocidade_kmh), 1) AS velocidade_mediana_kmh FROM segments"""))
def d09(spark, sf):
    return D.delay_summary(seg_of(Bus(spark, sf)))


@query("d10_od_flows", oracle("segments", """
SELECT regiao_origem, regiao_destino, count(*) AS n, round(avg(atrasado), 6) AS taxa,
  round(avg(atraso_s), 6) AS atraso_medio_s, count(DISTINCT cl) AS linhas, median(atraso_s) AS atraso_mediano_s,
  round(quantile_cont(atraso_s, 0.9), 6) AS atraso_p90_s, round(median(velocidade_kmh), 6) AS vel_mediana
FROM segments GROUP BY ALL HAVING count(*) >= 30"""))
def d10(spark, sf):
    return rounded(D.od_flows(seg_of(Bus(spark, sf))), "taxa", "atraso_medio_s", "atraso_p90_s", "vel_mediana")


def rounded(df, *cols, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in cols})


@query("d11_hourly_typical", oracle("seg_raw", """
SELECT viagem_id, ordem_origem, hora, tipico_s, tempo_percurso_s - tipico_s AS desvio_s,
  round(tempo_percurso_s / tipico_s, 6) AS razao
FROM (SELECT *, median(tempo_percurso_s) FILTER (t_chegada < 1705881600) OVER (PARTITION BY cl, ordem_origem, hora) AS tipico_s
  FROM seg_raw)"""))
def d11(spark, sf):
    out = D.hourly_typical(Bus(spark, sf).arrivals, before=F.timestamp_seconds(F.lit(1705881600)))
    return rounded(out, "razao").select("viagem_id", "ordem_origem", "hora", "tipico_s", "desvio_s", "razao")


@query("f01_stop_headway", oracle("arrivals", """
SELECT cl, cp, viagem_id, CAST(t_chegada - lag(t_chegada) OVER (PARTITION BY cl, cp ORDER BY t_chegada, viagem_id) AS DOUBLE)
  AS headway_obs_s FROM arrivals"""))
def f01(spark, sf):
    a = D.add_headway(Bus(spark, sf).arrivals, ("cl", "cp"), out="headway_obs_s")
    return a.select("cl", "cp", "viagem_id", "headway_obs_s")


@query("f02_clean_forecasts", oracle("forecasts", """
SELECT cl, cp, prefixo, ts_coleta, t_previsto, horizonte_s FROM forecasts WHERE horizonte_s BETWEEN 0 AND 3600
QUALIFY row_number() OVER (PARTITION BY cl, cp, prefixo, ts_coleta ORDER BY qid DESC) = 1"""))
def f02(spark, sf):
    f = FC.clean_forecasts(Bus(spark, sf).forecasts, "qid")
    return epoch(f, "ts_coleta", "t_previsto").select("cl", "cp", "prefixo", "ts_coleta", "t_previsto", "horizonte_s")


@query("f03_forward_asof", oracle("pairs_all", """
SELECT qid, CASE WHEN t_chegada - (ts_coleta - 60) <= 3600 THEN t_chegada END AS t_chegada,
  CASE WHEN t_chegada - (ts_coleta - 60) <= 3600 THEN viagem_id END AS viagem_id FROM pairs_all"""))
def f03(spark, sf):
    b = Bus(spark, sf)
    m = FC.match_arrivals(FC.clean_forecasts(b.forecasts, "qid"), b.arrivals)
    return epoch(m, "t_chegada").select("qid", "t_chegada", "viagem_id")


@query("f04_forecast_error", oracle("pairs", "SELECT qid, CAST(erro_s AS DOUBLE) AS erro_s FROM pairs"))
def f04(spark, sf):
    b = Bus(spark, sf)
    return FC.with_error(FC.match_arrivals(FC.clean_forecasts(b.forecasts, "qid"), b.arrivals)).select("qid", "erro_s")


@query("f05_pair_table", oracle("pairs", """
SELECT qid, parada_nome, viagem_id, CAST(horizonte_s AS INTEGER) AS horizonte_s, CAST(erro_s AS INTEGER) AS erro_s,
  CAST(erro_abs_s AS INTEGER) AS erro_abs_s, CAST(headway_obs_s AS INTEGER) AS headway_obs_s, celula,
  CAST(dia_semana AS INTEGER) AS dia_semana, CAST(hora AS INTEGER) AS hora, faixa FROM pairs"""))
def f05(spark, sf):
    return pairs_of(Bus(spark, sf)).select(
        "qid", "parada_nome", "viagem_id", "horizonte_s", "erro_s", "erro_abs_s", "headway_obs_s", "celula",
        "dia_semana", "hora", "faixa")


@query("f06_pair_summary", oracle("pairs", """
SELECT (SELECT count(*) FROM pairs_all) AS previsoes_avaliadas,
  (SELECT count(*) FROM pairs_all WHERE t_chegada - (ts_coleta - 60) <= 3600) AS casadas,
  round((SELECT avg(CASE WHEN t_chegada - (ts_coleta - 60) <= 3600 THEN 1 ELSE 0 END) FROM pairs_all), 3) AS taxa_casamento,
  count(*) AS validas, round(avg(erro_s), 1) AS erro_medio_s, round(avg(erro_abs_s), 1) AS mae_s,
  round(sqrt(avg(erro_s * erro_s)), 1) AS rmse_s,
  round(avg(CASE WHEN erro_s >= 300 THEN 1 ELSE 0 END), 4) AS prob_atraso_acima_5min,
  round(avg(CASE WHEN erro_s <= -60 THEN 1 ELSE 0 END), 4) AS prob_adiantado_1min, median(erro_s) AS erro_mediano_s
FROM pairs"""))
def f06(spark, sf):
    b = Bus(spark, sf)
    return FC.pair_summary(FC.match_arrivals(FC.clean_forecasts(b.forecasts, "qid"), b.arrivals))


@query("f07_line_ranking", oracle("pairs", """
SELECT letreiro, sentido, count(*) AS n, round(avg(erro_s), 6) AS erro_medio_s, round(avg(erro_abs_s), 6) AS mae_s,
  round(avg(CASE WHEN erro_s >= 300 THEN 1 ELSE 0 END), 6) AS prob_atraso, median(erro_s) AS erro_mediano_s,
  round(quantile_cont(erro_s, 0.9), 6) AS p90_erro_s
FROM pairs GROUP BY ALL HAVING count(*) >= 50"""))
def f07(spark, sf):
    return rounded(FC.line_ranking(pairs_of(Bus(spark, sf))), "erro_medio_s", "mae_s", "prob_atraso", "p90_erro_s")


_PRE = """
SELECT cp, letreiro, hora, dia_semana, horizonte_s // 300 * 5 AS faixa_min, count(*) AS n, avg(erro_s) AS erro_medio_s,
  avg(erro_abs_s) AS mae_s, avg(CASE WHEN erro_s >= 300 THEN 1.0 ELSE 0.0 END) AS prob_tarde
FROM pairs GROUP BY ALL"""


@query("f08_preaggregate", oracle("pairs", f"""
SELECT cp, letreiro, hora, dia_semana, faixa_min, n, round(erro_medio_s, 6) AS erro_medio_s, round(mae_s, 6) AS mae_s,
  round(prob_tarde, 6) AS prob_tarde FROM ({_PRE})"""))
def f08(spark, sf):
    return rounded(FC.preaggregate(pairs_of(Bus(spark, sf))), "erro_medio_s", "mae_s", "prob_tarde")


@query("f09_reaggregate", oracle("pairs", f"""
SELECT letreiro, hora, CAST(sum(n) AS BIGINT) AS n, round(sum(erro_medio_s * n) / sum(n), 5) AS erro_medio_s,
  round(sum(mae_s * n) / sum(n), 5) AS mae_s FROM ({_PRE}) GROUP BY letreiro, hora"""))
def f09(spark, sf):
    pre = FC.preaggregate(pairs_of(Bus(spark, sf)))
    return rounded(FC.reaggregate(pre, ["letreiro", "hora"], ("erro_medio_s", "mae_s")), "erro_medio_s", "mae_s", digits=5)


@query("f10_error_curve", oracle("pairs", """
SELECT horizonte_s // 120 * 2 + 1 AS minuto, count(*) AS n, round(avg(erro_abs_s), 6) AS mae_s
FROM pairs WHERE horizonte_s < 2700 GROUP BY 1 HAVING count(*) >= 1000"""))
def f10(spark, sf):
    p = pairs_of(Bus(spark, sf)).where("horizonte_s < 2700")
    g = p.groupBy((F.floor(F.col("horizonte_s") / 120) * 2 + 1).alias("minuto"))
    out = g.agg(F.count("*").alias("n"), F.avg("erro_abs_s").alias("mae_s")).where("n >= 1000")
    return rounded(out, "mae_s")


def _band(edges, names):
    out = f"'{names[-1]}'"
    for e, n in reversed(list(zip(edges, names))):
        out = f"CASE WHEN horizonte_s < {e} THEN '{n}' ELSE {out} END"
    return out


_B11 = ([300, 900, 1800], ["<5", "5-15", "15-30", "30-60"])
_B12 = ([120, 300, 600, 1200], ["0-2", "2-5", "5-10", "10-20", "20+"])


@query("f11_error_by_horizon", oracle("pairs", f"""
SELECT {_band(*_B11)} AS faixa_h, count(*) AS n, round(avg(erro_abs_s), 6) AS mae_s,
  round(avg(CASE WHEN erro_s >= 60 THEN 1 ELSE 0 END), 4) AS tarde, round(avg(CASE WHEN erro_s <= -60 THEN 1 ELSE 0 END), 4) AS cedo,
  median(erro_s) AS erro_mediano_s FROM pairs GROUP BY 1"""))
def f11(spark, sf):
    p = pairs_of(Bus(spark, sf)).withColumn("faixa_h", FC.horizon_band("horizonte_s", *_B11))
    return FC.error_table(cut_lineage(FC.error_counts(p, ["faixa_h"])), ["faixa_h"], {"erro_mediano_s": 0.5}, [
        F.round(F.sum(F.col("erro_abs_s") * F.col("_n")) / F.sum("_n"), 6).alias("mae_s"),
        FC.share(F.col("erro_s") >= 60, "tarde", weight="_n"), FC.share(F.col("erro_s") <= -60, "cedo", weight="_n")], weight="_n")


@query("f12_short_horizon", oracle("pairs", f"""
SELECT faixa_h, count(*) AS n, round(avg(erro_abs_s), 6) AS mae_s, round(avg(erro_s), 6) AS vies_s,
  round(avg(CASE WHEN erro_s >= 300 THEN 1 ELSE 0 END), 4) AS prob_5min, round(quantile_cont(erro_s, 0.9), 6) AS p90_s
FROM (SELECT *, {_band(*_B12)} AS faixa_h FROM pairs) WHERE faixa_h <> '20+' GROUP BY 1"""))
def f12(spark, sf):
    p = pairs_of(Bus(spark, sf)).withColumn("faixa_h", FC.horizon_band("horizonte_s", *_B12)).where("faixa_h <> '20+'")
    of = lambda v: F.sum(v * F.col("_n")) / F.sum("_n")
    return rounded(FC.error_table(cut_lineage(FC.error_counts(p, ["faixa_h"])), ["faixa_h"], {"p90_s": 0.9}, [
        F.round(of(F.col("erro_abs_s")), 6).alias("mae_s"), F.round(of(F.col("erro_s")), 6).alias("vies_s"),
        F.round(of((F.col("erro_s") >= 300).cast("int")), 4).alias("prob_5min")], weight="_n"), "p90_s")
