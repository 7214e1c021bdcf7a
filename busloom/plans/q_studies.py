"""Study queries (E)."""

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.operators import features as W
from busloom.operators import studies as E
from busloom.plans.q_clusters import zoned
from busloom.plans.q_delay import rounded
from busloom.plans.q_features import rain_of
from busloom.plans.q_reports import typed_segments
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_draw, sql_poisson
from busloom.session import cut_lineage

DIA_TEXT = "CAST(DATE '1970-01-01' + CAST(dia AS INTEGER) AS VARCHAR)"


def seg(sf, spark):
    return typed_segments(Bus(spark, sf))


def segz(spark, sf):
    b = Bus(spark, sf)
    return zoned(b, typed_segments(b))


@query("e01_group_profile", oracle("segments", """
SELECT tipo, count(*) AS n, round(100 * avg(atrasado), 6) AS tarde_pct, round(avg(atraso_s) FILTER (atrasado = 1), 6) AS media_tardes_s, median(atraso_s) AS mediana_s,
  round(quantile_cont(atraso_s, 0.9), 6) AS p90_s, round(median(velocidade_kmh), 6) AS vel_mediana, round(1 / avg(atrasado), 6) AS um_em FROM segments GROUP BY 1"""))
def e01(spark, sf):
    return rounded(E.profile(seg(sf, spark), ["tipo"]), "tarde_pct", "media_tardes_s", "p90_s", "vel_mediana", "um_em")


@query("e02_peak_share", oracle("segments", """
SELECT round(100 * avg(pico), 6) AS passagens_pct, round(100 * sum(pico * atrasado) / sum(atrasado), 6) AS atrasos_pct FROM segments"""))
def e02(spark, sf):
    return rounded(E.peak_share(seg(sf, spark)), "passagens_pct", "atrasos_pct")


derive("trip_tot", ["segments"], """
SELECT * FROM (SELECT cl, viagem_id, count(*) AS trechos, sum(atraso_s) AS acumulado_s FROM segments GROUP BY 1, 2)
JOIN (SELECT cl, count(DISTINCT ordem_origem) AS k FROM segments GROUP BY 1) USING (cl) WHERE trechos >= 0.5 * k""")


@query("e03_trip_delay", oracle("trip_tot", """
SELECT cl, count(*) AS viagens, round(100 * avg(CASE WHEN acumulado_s >= 300 THEN 1 ELSE 0 END), 6) AS mais5_pct, round(avg(acumulado_s), 6) AS media_s FROM trip_tot GROUP BY 1"""))
def e03(spark, sf):
    t = E.trip_totals(seg(sf, spark), 0.5)
    g = t.groupBy("cl").agg(F.count("*").alias("viagens"), (100 * F.avg(F.when(F.col("acumulado_s") >= 300, 1.0).otherwise(0.0))).alias("mais5_pct"), F.avg("acumulado_s").alias("media_s"))
    return rounded(g, "mais5_pct", "media_s")


HOUR = "SELECT hora, avg(velocidade_kmh) AS v, avg(atrasado) AS r FROM segments GROUP BY 1"


@query("e04_speed_late_correlation", oracle("segments", f"""
, g AS ({HOUR}), k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS b FROM g)
SELECT count(*) AS n, round(corr(v, r), 6) AS pearson, round(corr(a, b), 6) AS spearman FROM k""".strip()))
def e04(spark, sf):
    g = seg(sf, spark).groupBy("hora").agg(F.avg("velocidade_kmh").alias("v"), F.avg("atrasado").alias("r"))
    return rounded(E.correlations(g, "v", "r"), "pearson", "spearman")


@query("e05_within_hour", oracle("segments", """
, d AS (SELECT velocidade_kmh - avg(velocidade_kmh) OVER (PARTITION BY hora) AS x, atraso_s - avg(atraso_s) OVER (PARTITION BY hora) AS y FROM segments)
SELECT round(corr(x, y), 5) AS correlacao, round(regr_slope(y, x), 5) AS inclinacao FROM d""".strip()))
def e05(spark, sf):
    return rounded(E.within_group(seg(sf, spark), "hora", "velocidade_kmh", "atraso_s"), "correlacao", "inclinacao", digits=5)


derive("others", ["segments"], """
SELECT s.viagem_id, s.ordem_origem, s.atrasado, count(o.velocidade_kmh) AS n, avg(o.velocidade_kmh) AS v FROM segments s LEFT JOIN segments o
ON o.cp_origem = s.cp_origem AND o.cp_destino = s.cp_destino AND o.cl <> s.cl AND o.t_origem // 900 = s.t_origem // 900 - 1 GROUP BY 1, 2, 3""")


@query("e06_other_lines_before", oracle("others", "SELECT viagem_id, ordem_origem, round(v, 5) AS vel_outras FROM others"))
def e06(spark, sf):
    return E.other_lines_before(seg(sf, spark)).select("viagem_id", "ordem_origem", F.round("vel_outras", 5).alias("vel_outras"))


@query("e07_late_by_quintile", oracle("segments", """
, q AS (SELECT quantile_cont(extensao_m, 0.2) AS a, quantile_cont(extensao_m, 0.4) AS b, quantile_cont(extensao_m, 0.6) AS c, quantile_cont(extensao_m, 0.8) AS d FROM segments)
SELECT CAST(extensao_m > a AS INTEGER) + CAST(extensao_m > b AS INTEGER) + CAST(extensao_m > c AS INTEGER) + CAST(extensao_m > d AS INTEGER) AS faixa_q, count(*) AS n,
  round(100 * avg(atrasado), 6) AS tarde_pct, round(avg(extensao_m), 6) AS media FROM segments, q GROUP BY 1""".strip()))
def e07(spark, sf):
    return rounded(E.rate_by_bin(seg(sf, spark), "extensao_m", 5), "tarde_pct", "media")


@query("e08_threshold_sensitivity", oracle("segments", """
SELECT tipo, count(*) AS n, CAST(c AS DOUBLE) AS corte, round(100 * avg(CASE WHEN atraso_rel >= CAST(c AS DOUBLE) THEN 1 ELSE 0 END), 6) AS acima_pct,
  round(100 * avg(CASE WHEN atraso_rel <= -CAST(c AS DOUBLE) THEN 1 ELSE 0 END), 6) AS abaixo_pct FROM segments, (VALUES (0.1), (0.2), (0.3), (0.5)) v(c) GROUP BY tipo, c"""))
def e08(spark, sf):
    return rounded(E.threshold_sensitivity(seg(sf, spark), [0.1, 0.2, 0.3, 0.5], ["tipo"]), "acima_pct", "abaixo_pct")


@query("e09_ratio_histogram", oracle("segments", """
, g AS (SELECT tipo, unnest(generate_series(0, 29)) AS bin FROM (SELECT DISTINCT tipo FROM segments)),
c AS (SELECT tipo, CAST(least(greatest(floor((atraso_rel + CAST('0.5' AS DOUBLE)) / CAST('0.05' AS DOUBLE)), 0), 29) AS BIGINT) AS bin, count(*) AS n FROM segments GROUP BY 1, 2)
SELECT tipo, bin, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (tipo, bin)""".strip()))
def e09(spark, sf):
    return E.ratio_histogram(seg(sf, spark), ["tipo"])


@query("e10_rank_stability", oracle("segz", """
, t AS (SELECT zona, c AS corte, avg(CASE WHEN atraso_rel >= CAST(c AS DOUBLE) THEN 1.0 ELSE 0.0 END) AS p FROM segz, (VALUES (0.1), (0.2), (0.4)) v(c) WHERE zona IS NOT NULL GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY corte ORDER BY p DESC, zona) AS r FROM t), b AS (SELECT zona, r AS r0 FROM r WHERE corte = 0.2)
SELECT CAST(corte AS DOUBLE) AS corte, round(corr(r, r0), 6) AS spearman, count(*) FILTER (r <= 5 AND r0 <= 5) AS piores_em_comum FROM r JOIN b USING (zona) GROUP BY 1""".strip()))
def e10(spark, sf):
    return rounded(E.rank_stability(segz(spark, sf).where("zona IS NOT NULL"), "zona", [0.1, 0.2, 0.4], 0.2), "spearman")


@query("e11_late_by_date", oracle("segments", f"""
, d AS (SELECT tipo, dia, 100 * avg(atrasado) AS v FROM segments GROUP BY 1, 2),
r AS (SELECT tipo, r, sum(w * v) / nullif(sum(w), 0) AS m FROM (SELECT *, {sql_poisson('7', 'r', DIA_TEXT)} AS w FROM d, range(1, 301) t(r)) GROUP BY 1, 2)
SELECT tipo, round((SELECT avg(v) FROM d WHERE d.tipo = r.tipo), 6) AS valor, round(quantile_cont(m, 0.025), 6) AS ic_baixo, round(quantile_cont(m, 0.975), 6) AS ic_alto FROM r GROUP BY tipo""".strip()))
def e11(spark, sf):
    return rounded(E.date_bootstrap(seg(sf, spark), "dia", "tipo"), "valor", "ic_baixo", "ic_alto")


@query("e12_hour_windows", oracle("segments", """
, g AS (SELECT dia, 100 * avg(atrasado) FILTER (hora BETWEEN 6 AND 9) AS manha, 100 * avg(atrasado) FILTER (hora BETWEEN 16 AND 19) AS tarde FROM segments GROUP BY 1)
SELECT CAST(dia AS BIGINT) AS dia, round(manha, 6) AS manha, round(tarde, 6) AS tarde, round(abs(manha - tarde), 6) AS folga_pp FROM g""".strip()))
def e12(spark, sf):
    g = E.hour_windows(seg(sf, spark), "dia", {"manha": (6, 9), "tarde": (16, 19)})
    return rounded(g.withColumn("dia", F.datediff("dia", F.lit("1970-01-01").cast("date")).cast("long")), "manha", "tarde", "folga_pp")


@query("e13_fleet_by_hour", oracle("segments", """
, n AS (SELECT dia, hora, count(DISTINCT prefixo) AS v, max(tipo) AS t FROM segments GROUP BY 1, 2), m AS (SELECT hora, avg(v) AS mu FROM n WHERE t = 'util' GROUP BY 1)
SELECT CAST(hora AS INTEGER) AS hora, v AS veiculos, round(mu, 6) AS media_util, round(v / mu, 6) AS razao FROM n JOIN m USING (hora) WHERE dia = 19732""".strip()))
def e13(spark, sf):
    return rounded(E.fleet_by_hour(seg(sf, spark), "dia", ["2024-01-10"], F.col("tipo") == "util"), "media_util", "razao").drop("dia")


ENDS = """
SELECT s.cl, CASE WHEN coalesce(rn, 0) >= 3 THEN l[1] ELSE a END AS primeiro, CASE WHEN coalesce(rn, 0) >= 3 THEN l[2] ELSE a END AS segundo,
  CASE WHEN coalesce(rn, 0) >= 3 THEN l[-2] ELSE b END AS penultimo, CASE WHEN coalesce(rn, 0) >= 3 THEN l[-1] ELSE b END AS ultimo
FROM (SELECT cl, count(DISTINCT ordem_origem) AS k, min(ordem_origem) AS a, max(ordem_origem) AS b FROM segments GROUP BY 1) s
LEFT JOIN (SELECT cl, list(ordem_origem ORDER BY ordem_origem) AS l, count(*) AS rn FROM (
  SELECT c.cl, c.ordem_origem, count(DISTINCT c.viagem_id) / max(t.n) AS cob FROM segments c JOIN full_trips f ON f.viagem_id = c.viagem_id JOIN (SELECT cl, count(*) AS n FROM full_trips GROUP BY 1) t ON t.cl = c.cl
  GROUP BY 1, 2 HAVING cob >= {coverage}) GROUP BY 1) r ON r.cl = s.cl"""
derive("ends", ["segments", "full_trips"], ENDS.format(coverage=0.7))
derive("wide_ends", ["segments", "full_trips"], ENDS.format(coverage=0.3))
derive("full_trips", ["segments"], """
SELECT cl, viagem_id FROM (SELECT cl, viagem_id, count(DISTINCT ordem_origem) AS n FROM segments GROUP BY 1, 2) JOIN (SELECT cl, count(DISTINCT ordem_origem) AS k FROM segments GROUP BY 1) USING (cl) WHERE n >= k / 2""")


@query("e14_inner_segments", oracle("full_trips ends", "SELECT * FROM ends"))
def e14(spark, sf):
    return E.inner_segments(seg(sf, spark), 0.7, 3)


@query("e15_zone_trims", oracle("segz full_trips ends", """
, a AS (SELECT zona, round(100 * avg(atrasado), 6) AS todos FROM segz WHERE zona IS NOT NULL GROUP BY 1 HAVING count(*) >= 50),
b AS (SELECT zona, round(100 * avg(atrasado), 6) AS sem_terminal FROM segz JOIN ends USING (cl) WHERE zona IS NOT NULL AND ordem_origem >= primeiro + 1 AND ordem_origem <= ultimo - 1 GROUP BY 1 HAVING count(*) >= 50),
c AS (SELECT zona, round(100 * avg(atrasado), 6) AS sem_dois FROM segz JOIN ends USING (cl) WHERE zona IS NOT NULL AND ordem_origem > segundo AND ordem_origem < penultimo GROUP BY 1 HAVING count(*) >= 50)
SELECT zona, todos, sem_terminal, sem_dois FROM a FULL JOIN b USING (zona) FULL JOIN c USING (zona)""".strip()))
def e15(spark, sf):
    d = cut_lineage(segz(spark, sf))
    ends = cut_lineage(E.inner_segments(d, 0.7, 3))
    cuts = {"todos": d, "sem_terminal": E.trimmed(d, ends, 1), "sem_dois": E.trimmed(d, ends, 1, "segundo", "penultimo")}
    return rounded(E.zone_variants(cuts, "zona", 50), *cuts)


@query("e16_zone_by_origin_or_midpoint", oracle("segz stops zone_edges", """
, o AS (SELECT cp AS cp_origem, arg_min(zona, ordem) AS zona_origem FROM (SELECT p.cp, z.zona, z.ordem FROM stops p JOIN zone_edges z
  ON (z.y1 > p.lat) <> (z.y2 > p.lat) AND p.lon < (z.x2 - z.x1) * (p.lat - z.y1) / (z.y2 - z.y1) + z.x1 GROUP BY ALL HAVING count(*) % 2 = 1) GROUP BY 1),
j AS (SELECT segz.*, zona_origem FROM segz LEFT JOIN o USING (cp_origem)),
m AS (SELECT zona, 100 * avg(atrasado) AS v FROM j WHERE zona IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
q AS (SELECT zona_origem AS zona, 100 * avg(atrasado) AS r FROM j WHERE zona_origem IS NOT NULL GROUP BY 1 HAVING count(*) >= 30),
k AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS a, rank() OVER (ORDER BY r) + (count(*) OVER (PARTITION BY r) - 1) / 2 AS b FROM m JOIN q USING (zona))
SELECT count(*) AS n, round(corr(v, r), 6) AS pearson, round(corr(a, b), 6) AS spearman, (SELECT round(100 * avg(CAST(zona = zona_origem AS INTEGER)), 6) FROM j) AS concordancia_pct FROM k""".strip()))
def e16(spark, sf):
    b = Bus(spark, sf)
    d = cut_lineage(segz(spark, sf))
    st = zoned(b, b.stops).select(F.col("cp").alias("cp_origem"), F.col("zona").alias("zona_origem"))
    j = d.join(st, "cp_origem", "left")
    z = E.zone_variants({"meio": j, "origem": j.drop("zona").withColumnRenamed("zona_origem", "zona")}, "zona", 30)
    agree = j.agg((100 * F.avg((F.col("zona") == F.col("zona_origem")).cast("double"))).alias("concordancia_pct"))
    return rounded(E.correlations(z, "meio", "origem").crossJoin(agree), "pearson", "spearman", "concordancia_pct")


@query("e17_block_bootstrap", oracle("segments", f"""
, s AS (SELECT dia, sum(atrasado) FILTER (sentido = 1) AS a, count(*) FILTER (sentido = 1) AS na, sum(atrasado) FILTER (sentido <> 1) AS b, count(*) FILTER (sentido <> 1) AS nb FROM segments GROUP BY 1),
r AS (SELECT r, 100 * (sum(w * a) / nullif(sum(w * na), 0) - sum(w * b) / nullif(sum(w * nb), 0)) AS d FROM (SELECT *, {sql_poisson('3', 'r', DIA_TEXT)} AS w FROM s, range(1, 301) t(r)) GROUP BY 1)
SELECT (SELECT round(100 * (sum(a) / sum(na) - sum(b) / sum(nb)), 6) FROM s) AS diferenca_pp, round(quantile_cont(d, 0.025), 6) AS ic_baixo, round(quantile_cont(d, 0.975), 6) AS ic_alto FROM r""".strip()))
def e17(spark, sf):
    return rounded(E.rate_difference(seg(sf, spark), "dia", F.col("sentido") == 1), "diferenca_pp", "ic_baixo", "ic_alto")


@query("e18_standardised_rates", oracle("segments", """
, c AS (SELECT sentido, hora, tipo, count(*) AS n, avg(atrasado) AS r FROM segments GROUP BY 1, 2, 3),
s AS (SELECT hora, tipo, sum(n) AS w FROM c GROUP BY 1, 2 HAVING count(*) = 2)
SELECT sentido, CAST(sum(n) AS BIGINT) AS n, round(100 * sum(r * w) / sum(w), 6) AS padronizada_pct, round(100 * sum(r * n) / sum(n), 6) AS bruta_pct FROM c JOIN s USING (hora, tipo) GROUP BY 1""".strip()))
def e18(spark, sf):
    return rounded(E.standardised(cut_lineage(seg(sf, spark)), "sentido", ["hora", "tipo"]), "padronizada_pct", "bruta_pct")


@query("e19_dispersion", oracle("segz", """
, c AS (SELECT zona, cl, 100 * avg(atrasado) AS r FROM segz WHERE zona IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 10)
SELECT round((SELECT avg(s) FROM (SELECT stddev_samp(r) AS s FROM c GROUP BY zona)), 5) AS entre_b_dentro_a, round((SELECT avg(s) FROM (SELECT stddev_samp(r) AS s FROM c GROUP BY cl)), 5) AS entre_a_dentro_b""".strip()))
def e19(spark, sf):
    return rounded(E.dispersion(segz(spark, sf).where("zona IS NOT NULL"), "zona", "cl", 10), "entre_b_dentro_a", "entre_a_dentro_b", digits=5)


@query("e20_deviance_decomposition")
def e20(spark, sf):
    d = segz(spark, sf).withColumn("tipo_hora", F.concat_ws("-", "tipo", F.col("hora")))
    return E.deviance_decomposition(d, "tipo_hora", "letreiro", "zona")


@query("e21_rate_by_typical_time", oracle("segments", """
, q AS (SELECT quantile_cont(percurso_tipico_s, 0.25) AS a, quantile_cont(percurso_tipico_s, 0.5) AS b, quantile_cont(percurso_tipico_s, 0.75) AS c FROM segments)
SELECT CAST(percurso_tipico_s > a AS INTEGER) + CAST(percurso_tipico_s > b AS INTEGER) + CAST(percurso_tipico_s > c AS INTEGER) AS faixa_q, count(*) AS n, round(100 * avg(atrasado), 6) AS tarde_pct, round(avg(percurso_tipico_s), 6) AS media FROM segments, q GROUP BY 1""".strip()))
def e21(spark, sf):
    return rounded(E.rate_by_bin(seg(sf, spark), "percurso_tipico_s", 4), "tarde_pct", "media")


@query("e22_anchored_trips", oracle("segments wide_ends", """
, t AS (SELECT cl, viagem_id, segundo, penultimo, count(*) AS trechos, sum(tempo_percurso_s) AS duracao_s, arg_min(tipo, ordem_origem) AS tipo, arg_min(faixa, ordem_origem) AS faixa
  FROM segments JOIN wide_ends USING (cl) WHERE ordem_origem BETWEEN primeiro AND ultimo GROUP BY cl, viagem_id, primeiro, segundo, penultimo, ultimo
  HAVING min(ordem_origem) = primeiro AND max(ordem_origem) = ultimo AND count(*) >= 0.5 * (ultimo - primeiro + 1)),
m AS (SELECT *, median(duracao_s) OVER (PARTITION BY cl) AS mediana_s FROM t)
SELECT *, count(*) OVER (PARTITION BY cl, tipo, faixa) AS n_celula FROM (SELECT * FROM m WHERE duracao_s > 0 AND duracao_s <= 3 * mediana_s) QUALIFY n_celula >= 2""".strip()))
def e22(spark, sf):
    d = cut_lineage(seg(sf, spark))
    return E.anchored_trips(d, E.inner_segments(d, 0.3, 3), 0.5, 2)


@query("e23_flow_ranking", oracle("trip_tot lines", """
, g AS (SELECT cl, count(*) AS n, sum(CASE WHEN acumulado_s > 0 THEN 1 ELSE 0 END) AS k FROM trip_tot GROUP BY 1)
SELECT cl, n, CAST(k AS BIGINT) AS k, round(100 * k / n, 6) AS taxa_pct, round(100 * (k / n + 3.8416 / (2 * n) - 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 5) AS ic_baixo,
  round(100 * (k / n + 3.8416 / (2 * n) + 1.96 * sqrt(k / n * (1 - k / n) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 5) AS ic_alto FROM g""".strip()))
def e23(spark, sf):
    g = E.flow_ranking(E.trip_totals(seg(sf, spark), 0.5), ["cl"], F.col("acumulado_s") > 0)
    return rounded(rounded(g, "taxa_pct"), "ic_baixo", "ic_alto", digits=5)


@query("e24_without_terminals", oracle("full_trips ends segments", """
SELECT tipo, count(*) AS n, round(100 * avg(atrasado), 6) AS tarde_pct FROM segments JOIN ends USING (cl) WHERE ordem_origem > primeiro AND ordem_origem < ultimo GROUP BY 1"""))
def e24(spark, sf):
    d = cut_lineage(seg(sf, spark))
    t = E.trimmed(d, E.inner_segments(d, 0.7, 3), 1)
    return rounded(t.groupBy("tipo").agg(F.count("*").alias("n"), E.rate().alias("tarde_pct")), "tarde_pct")


@query("e25_lag_correlation", oracle("segments", """
SELECT round(corr(l1, v) FILTER (o1 - ordem_origem = 1), 5) AS r1, round(corr(l2, v) FILTER (o2 - ordem_origem = 2), 5) AS r2 FROM (
  SELECT *, lead(v) OVER w AS l1, lead(v, 2) OVER w AS l2, lead(ordem_origem) OVER w AS o1, lead(ordem_origem, 2) OVER w AS o2 FROM (SELECT viagem_id, ordem_origem, ln(1 + atraso_rel) AS v FROM segments)
  WINDOW w AS (PARTITION BY viagem_id ORDER BY ordem_origem))"""))
def e25(spark, sf):
    return rounded(E.lag_correlation(seg(sf, spark), F.log(1 + F.col("atraso_rel")), [1, 2]), "r1", "r2", digits=5)


@query("e26_synthetic_trips", oracle("segments", f"""
, d AS (SELECT *, row_number() OVER (PARTITION BY cl, ordem_origem, faixa ORDER BY {sql_draw('11', 'viagem_id', 'ordem_origem')}, viagem_id) AS i, count(*) OVER (PARTITION BY cl, ordem_origem, faixa) AS n FROM segments),
q AS (SELECT *, {sql_draw('12', 'r', 'viagem_id', 'ordem_origem')} % n + 1 AS k FROM d, range(1, 11) t(r)),
t AS (SELECT r, q.viagem_id, sum(d.tempo_percurso_s) - sum(q.percurso_tipico_s) AS e FROM q JOIN d ON d.cl = q.cl AND d.ordem_origem = q.ordem_origem AND d.faixa = q.faixa AND d.i = q.k GROUP BY 1, 2),
o AS (SELECT viagem_id, sum(tempo_percurso_s) - sum(percurso_tipico_s) AS e FROM segments GROUP BY 1)
SELECT (SELECT round(stddev_samp(e), 6) FROM o) AS dp_real_s, round(avg(s), 6) AS dp_sintetico_s FROM (SELECT stddev_samp(e) AS s FROM t GROUP BY r)""".strip()))
def e26(spark, sf):
    return rounded(E.synthetic_trips(cut_lineage(seg(sf, spark)), ["cl", "ordem_origem", "faixa"], 10), "dp_real_s", "dp_sintetico_s")


@query("e27_paired_difference", oracle("segments", """
, g AS (SELECT cl, ordem_origem, hora, avg(velocidade_kmh) FILTER (tipo = 'util') AS a, avg(velocidade_kmh) FILTER (tipo <> 'util') AS b, count(*) FILTER (tipo = 'util') AS na, count(*) FILTER (tipo <> 'util') AS nb
  FROM segments GROUP BY 1, 2, 3 HAVING na >= 2 AND nb >= 2)
SELECT count(*) AS celulas, round(sum(least(na, nb) * (a - b)) / sum(least(na, nb)), 5) AS diferenca FROM g""".strip()))
def e27(spark, sf):
    return rounded(E.paired_difference(seg(sf, spark), F.col("tipo") == "util", ["cl", "ordem_origem", "hora"], "velocidade_kmh", 2), "diferenca", digits=5)


@query("e28_four_references", oracle("segments", """
, m AS (SELECT tempo_percurso_s AS t, median(tempo_percurso_s) OVER (PARTITION BY cl, ordem_origem, faixa) AS a, median(tempo_percurso_s) OVER (PARTITION BY cl, ordem_origem, hora) AS b,
  median(tempo_percurso_s) OVER (PARTITION BY cl, ordem_origem, hora, tipo) AS c FROM segments)
SELECT count(*) AS n, round(100 * avg(CASE WHEN t / a - 1 >= 0.2 THEN 1 ELSE 0 END), 5) AS parte, round(100 * avg(CASE WHEN t / b - 1 >= 0.2 THEN 1 ELSE 0 END), 5) AS hora_ref,
  round(100 * avg(CASE WHEN t / c - 1 >= 0.2 THEN 1 ELSE 0 END), 5) AS hora_tipo FROM m""".strip()))
def e28(spark, sf):
    k = ["cl", "ordem_origem"]
    d = E.flags_under_references(cut_lineage(seg(sf, spark)), {"parte": [*k, "faixa"], "hora_ref": [*k, "hora"], "hora_tipo": [*k, "hora", "tipo"]})
    return rounded(d, "parte", "hora_ref", "hora_tipo", digits=5)


@query("e29_zone_flows", oracle("segz", """
, t AS (SELECT viagem_id, arg_min(zona, ordem_origem) AS origem, arg_max(zona, ordem_origem) AS destino, avg(atrasado) AS r FROM segz WHERE zona IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
SELECT origem, destino, count(*) AS n, round(100 * avg(r), 6) AS tarde_pct FROM t GROUP BY 1, 2 HAVING count(*) >= 10""".strip()))
def e29(spark, sf):
    return rounded(E.od_zone_flows(segz(spark, sf), "zona", 2, 10), "tarde_pct")


@query("e30_period_day_type", oracle("segments", """
SELECT dia >= 19738 AS segundo, tipo, count(*) AS n, round(100 * avg(atrasado), 6) AS tarde_pct, round(100 * avg(atrasado) FILTER (hora >= 20 OR hora < 6), 6) AS noite_pct FROM segments GROUP BY 1, 2"""))
def e30(spark, sf):
    night = F.when((F.col("hora") >= 20) | (F.col("hora") < 6), F.col("atrasado").cast("double"))
    g = seg(sf, spark).groupBy((F.col("dia") >= "2024-01-16").alias("segundo"), "tipo").agg(F.count("*").alias("n"), E.rate().alias("tarde_pct"), (100 * F.avg(night)).alias("noite_pct"))
    return rounded(g, "tarde_pct", "noite_pct")


@query("e31_places_two_periods", oracle("segments", """
, g AS (SELECT cp_destino, 100 * avg(atrasado) FILTER (dia < 19738) AS a, 100 * avg(atrasado) FILTER (dia >= 19738) AS b FROM segments GROUP BY 1 HAVING count(*) FILTER (dia < 19738) >= 20 AND count(*) FILTER (dia >= 19738) >= 20),
k AS (SELECT *, rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb FROM g)
SELECT count(*) AS n, round(corr(a, b), 6) AS pearson, round(corr(ra, rb), 6) AS spearman, count(*) FILTER (a >= (SELECT quantile_cont(a, 0.8) FROM g) AND b >= (SELECT quantile_cont(b, 0.8) FROM g)) AS em_comum FROM k""".strip()))
def e31(spark, sf):
    return rounded(E.places_in_two_periods(cut_lineage(seg(sf, spark)), "cp_destino", F.col("dia") < "2024-01-16"), "pearson", "spearman")


@query("e32_rain_effect", oracle("segments rain", """
, y AS (SELECT h, avg(mm) AS city FROM rain GROUP BY 1),
g AS (SELECT hora, avg(atrasado) FILTER (city > 1) AS a, avg(atrasado) FILTER (city <= 1) AS b, count(*) FILTER (city > 1) AS n FROM segments JOIN y ON h = t_origem // 3600 * 3600 GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS n_chuva, round(100 * sum(n * (a - b)) / sum(n), 6) AS diferenca_pp FROM g WHERE a IS NOT NULL AND b IS NOT NULL""".strip()))
def e32(spark, sf):
    b = Bus(spark, sf)
    return rounded(E.wet_effect(W.rain_features(typed_segments(b), rain_of(b)), F.col("chuva_cidade_1h_mm") > 1), "diferenca_pp")


@query("e33_probe_against_fleet", oracle("segments", """
, f AS (SELECT cp_destino, t_chegada AS t, velocidade_kmh AS v, concat(viagem_id, '#', ordem_origem) AS pid, median(velocidade_kmh) OVER w AS m, count(velocidade_kmh) OVER w AS n FROM segments
  WINDOW w AS (PARTITION BY cp_destino ORDER BY t_chegada RANGE BETWEEN 3599 PRECEDING AND CURRENT ROW)),
k AS (SELECT * FROM f WHERE n >= 3 AND v IS NOT NULL),
q AS (SELECT *, v / (40 + cp_destino % 20) AS a, m / quantile_cont(m, 0.9) OVER (PARTITION BY cp_destino) AS b FROM k),
r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2 AS rv, rank() OVER (ORDER BY m) + (count(*) OVER (PARTITION BY m) - 1) / 2 AS rm,
  rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2 AS rb,
  rank() OVER (PARTITION BY cp_destino ORDER BY v) + (count(*) OVER (PARTITION BY cp_destino, v) - 1) / 2 AS pv, rank() OVER (PARTITION BY cp_destino ORDER BY m) + (count(*) OVER (PARTITION BY cp_destino, m) - 1) / 2 AS pm FROM q),
i AS (SELECT corr(pv, pm) AS c FROM r GROUP BY cp_destino HAVING count(*) > 30 AND min(pv) < max(pv) AND min(pm) < max(pm))
SELECT (SELECT count(*) FROM r) AS n, round((SELECT corr(rv, rm) FROM r), 6) AS velocidades, round((SELECT corr(ra, rb) FROM r), 6) AS relativas, round(median(c), 6) AS dentro_mediana, count(c) AS lugares FROM i""".strip()))
def e33(spark, sf):
    d = cut_lineage(seg(sf, spark))
    f = d.select("cp_destino", F.col("t_chegada").alias("t"), F.col("velocidade_kmh").alias("vel_kmh"))
    pid = F.concat_ws("#", "viagem_id", "ordem_origem").alias("pid")
    p = d.where("velocidade_kmh IS NOT NULL").select("cp_destino", F.col("t_chegada").alias("t"), pid, F.col("velocidade_kmh").alias("vel_sonda"), (40 + F.col("cp_destino") % 20).alias("vel_livre"))
    return rounded(E.probe_correlations(E.probe_against_fleet(p, f, "cp_destino", 60, 3), "cp_destino"), "velocidades", "relativas", "dentro_mediana")


@query("e34_segment_vs_trip", oracle("segments", """
, d AS (SELECT viagem_id, tempo_percurso_s AS t, median(tempo_percurso_s) OVER (PARTITION BY cl, ordem_origem, faixa, tipo) AS m FROM segments),
v AS (SELECT sum(t) / sum(m) - 1 AS x, avg(CASE WHEN t / m - 1 >= 0.2 THEN 1.0 ELSE 0.0 END) AS r FROM d GROUP BY viagem_id)
SELECT round((SELECT 100 * avg(CASE WHEN t / m - 1 >= 0.2 THEN 1 ELSE 0 END) FROM d), 5) AS trechos_pct, round(100 * avg(CASE WHEN x >= 0.2 THEN 1 ELSE 0 END), 5) AS viagens_pct,
  round(100 * avg(r), 5) AS parcela_media_pct, round(100 * avg(CASE WHEN r = 0 THEN 1 ELSE 0 END), 5) AS sem_atraso_pct FROM v""".strip()))
def e34(spark, sf):
    d = E.segment_vs_trip(cut_lineage(seg(sf, spark)), ["cl", "ordem_origem", "faixa", "tipo"])
    return rounded(d, "trechos_pct", "viagens_pct", "parcela_media_pct", "sem_atraso_pct", digits=5)


@query("e35_segment_list", oracle("segments stops", """
SELECT cl, ordem_origem, cp_origem, cp_destino, count(DISTINCT viagem_id) AS viagens, round(any_value(a.lat), 6) AS lat_o, round(any_value(b.lat), 6) AS lat_d FROM segments
JOIN stops a ON a.cp = cp_origem JOIN stops b ON b.cp = cp_destino GROUP BY 1, 2, 3, 4"""))
def e35(spark, sf):
    b = Bus(spark, sf)
    g = typed_segments(b).groupBy("cl", "ordem_origem", "cp_origem", "cp_destino").agg(F.countDistinct("viagem_id").alias("viagens"))
    o = b.stops.select(F.col("cp").alias("cp_origem"), F.round("lat", 6).alias("lat_o"))
    return g.join(o, "cp_origem").join(o.withColumnsRenamed({"cp_origem": "cp_destino", "lat_o": "lat_d"}), "cp_destino")


@query("e36_zone_table", oracle("segz", """
SELECT zona, count(*) AS n, round(100 * avg(atrasado), 6) AS tarde_pct, round(quantile_cont(atraso_rel, 0.9), 6) AS p90_rel, round(median(velocidade_kmh), 6) AS vel_mediana
FROM segz WHERE zona IS NOT NULL GROUP BY 1 HAVING count(*) >= 50"""))
def e36(spark, sf):
    return rounded(E.zone_table(segz(spark, sf), "zona", 50), "tarde_pct", "p90_rel", "vel_mediana")


@query("e37_fleet_against_study_lines", oracle("segments", """
, g AS (SELECT cp_origem, cp_destino, hora, avg(velocidade_kmh) FILTER (cl <= 10) AS a, avg(velocidade_kmh) FILTER (cl > 10) AS b, count(*) FILTER (cl <= 10) AS na, count(*) FILTER (cl > 10) AS nb
  FROM segments GROUP BY 1, 2, 3 HAVING na >= 2 AND nb >= 2)
SELECT count(*) AS celulas, round(sum(least(na, nb) * (a - b)) / sum(least(na, nb)), 5) AS diferenca FROM g""".strip()))
def e37(spark, sf):
    return rounded(E.paired_difference(seg(sf, spark), F.col("cl") <= 10, ["cp_origem", "cp_destino", "hora"], "velocidade_kmh", 2), "diferenca", digits=5)


@query("e38_modal_stops", oracle("arrivals", """
, n AS (SELECT cl, sentido, ordem, cp, count(*) AS n FROM arrivals GROUP BY 1, 2, 3, 4), t AS (SELECT cl, sentido, count(DISTINCT viagem_id) AS t FROM arrivals GROUP BY 1, 2),
c AS (SELECT cl, sentido, ordem, count(DISTINCT viagem_id) AS v FROM arrivals GROUP BY 1, 2, 3)
SELECT cl, sentido, ordem, cp, round(v / t, 6) AS cobertura FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY cl, sentido, ordem ORDER BY n DESC, cp) = 1) JOIN c USING (cl, sentido, ordem) JOIN t USING (cl, sentido)""".strip()))
def e38(spark, sf):
    return rounded(E.modal_stops(Bus(spark, sf).arrivals), "cobertura")
