"""Oracle forms of the derived tables (segments, forecast pairs), shared by many queries."""

from busloom.functions.geo import sql_cell
from busloom.plans.standins import derive, sql_date, sql_hour, sql_part, sql_weekday

derive("seg_raw", ["arrivals"], f"""
SELECT *, t_chegada - t_origem AS tempo_percurso_s, concat(cl, ':', ordem_origem) AS trecho,
  {sql_hour('t_origem')} AS hora, {sql_weekday('t_origem')} AS dia_semana,
  {sql_part(sql_hour('t_origem'))} AS faixa, {sql_date('t_origem')} AS dia
FROM (
  SELECT cl, letreiro, sentido, prefixo, viagem_id, cp AS cp_destino, ordem AS ordem_destino, t_chegada,
    confianca, lat AS lat1, lon AS lon1, lag(t_chegada) OVER w AS t_origem, lag(ordem) OVER w AS ordem_origem,
    lag(cp) OVER w AS cp_origem, lag(lat) OVER w AS lat0, lag(lon) OVER w AS lon0
  FROM arrivals WHERE confianca >= 0.4
  WINDOW w AS (PARTITION BY viagem_id ORDER BY ordem, t_chegada))
WHERE ordem_destino - ordem_origem = 1 AND t_chegada - t_origem > 5 AND t_chegada - t_origem < 3600
""")

derive("seg_ref", ["seg_raw", "line_stops"], """
SELECT r.*, b.s_m - a.s_m AS extensao_m, (b.s_m - a.s_m) / tempo_percurso_s * 3.6 AS velocidade_kmh,
  median(tempo_percurso_s) OVER k AS percurso_tipico_s, count(*) OVER k AS n_referencia
FROM seg_raw r LEFT JOIN line_stops a ON a.cl = r.cl AND a.cp = r.cp_origem
LEFT JOIN line_stops b ON b.cl = r.cl AND b.cp = r.cp_destino
WINDOW k AS (PARTITION BY r.cl, r.ordem_origem, r.faixa)
""")

derive("segments", ["seg_ref", "lines"], f"""
SELECT s.*, CASE WHEN l.sentido = 2 THEN terminal_secundario ELSE terminal_principal END AS regiao_origem,
  CASE WHEN l.sentido = 2 THEN terminal_principal ELSE terminal_secundario END AS regiao_destino,
  CASE WHEN (dia_semana = 6 OR dia IN (19723)) THEN 'domingo' WHEN dia_semana = 5 THEN 'sabado' ELSE 'util' END AS tipo,
  {sql_cell('lat', 'lon')} AS celula, CAST(faixa IN ('pico_manha', 'pico_tarde') AS INTEGER) AS pico,
  CAST(dia_semana IN (5, 6) AS INTEGER) AS fim_de_semana
FROM (
  SELECT *, tempo_percurso_s - percurso_tipico_s AS atraso_s,
    (tempo_percurso_s - percurso_tipico_s) / percurso_tipico_s AS atraso_rel,
    CAST((tempo_percurso_s - percurso_tipico_s) / percurso_tipico_s >= 0.2 AS INTEGER) AS atrasado,
    (lat0 + lat1) / 2 AS lat, (lon0 + lon1) / 2 AS lon,
    t_chegada - lag(t_chegada) OVER (PARTITION BY cl, cp_destino ORDER BY t_chegada, viagem_id) AS headway_s
  FROM seg_ref WHERE n_referencia >= 5) s
LEFT JOIN lines l ON l.cl = s.cl
""")

derive("hw_arrivals", ["arrivals"], f"""
SELECT *, t_chegada - lag(t_chegada) OVER (PARTITION BY cl, cp ORDER BY t_chegada, viagem_id) AS headway_obs_s,
  {sql_cell('lat', 'lon')} AS celula
FROM arrivals WHERE confianca >= 0.35
""")

derive("pairs_all", ["forecasts", "hw_arrivals"], """
SELECT q.*, a.t_chegada, a.viagem_id, a.ordem, a.confianca, a.headway_obs_s, a.lat, a.lon, a.celula
FROM (SELECT * FROM forecasts WHERE horizonte_s BETWEEN 0 AND 3600
  QUALIFY row_number() OVER (PARTITION BY cl, cp, prefixo, ts_coleta ORDER BY qid DESC) = 1) q
ASOF LEFT JOIN (SELECT * FROM hw_arrivals
  QUALIFY row_number() OVER (PARTITION BY cl, cp, prefixo, t_chegada ORDER BY viagem_id) = 1) a
ON a.cl = q.cl AND a.cp = q.cp AND a.prefixo = q.prefixo AND a.t_chegada >= q.ts_coleta - 60
""")

derive("pairs", ["pairs_all", "stops"], f"""
SELECT p.cl, p.letreiro, p.sentido, p.cp,
  CASE WHEN trim(coalesce(parada_nome, '')) = '' THEN s.nome ELSE parada_nome END AS parada_nome,
  prefixo, viagem_id, ts_coleta, t_previsto, t_chegada, horizonte_s, t_chegada - t_previsto AS erro_s,
  abs(t_chegada - t_previsto) AS erro_abs_s, coalesce(headway_obs_s, 0) AS headway_obs_s, p.lat, p.lon, celula,
  {sql_weekday('t_chegada')} AS dia_semana, {sql_hour('t_chegada')} AS hora,
  {sql_part(sql_hour('t_chegada'))} AS faixa, confianca, qid, ordem
FROM pairs_all p LEFT JOIN stops s ON s.cp = p.cp
WHERE t_chegada IS NOT NULL AND t_chegada - (ts_coleta - 60) <= 3600 AND abs(t_chegada - t_previsto) <= 2700
""")
