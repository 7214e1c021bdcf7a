"""Split, metric and model queries (M)."""

from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.operators import features as W
from busloom.operators import metrics as M
from busloom.operators import models as ML
from busloom.operators.asof import asof_join, seconds_between
from busloom.plans.q_delay import pairs_of, rounded, seg_of
from busloom.plans.q_features import ID, base_of, series_pairs
from busloom.plans.registry import query
from busloom.plans.standins import Bus, derive, oracle, sql_poisson

# predictions derived from the passages: two rival errors, a probability, three quantiles
derive("preds", ["segments"], """
SELECT viagem_id, ordem_origem, cl, letreiro, dia, tempo_percurso_s AS real_s, atraso_s AS y, atrasado AS c, confianca,
  floor(atraso_s / 2) + cl % 7 - 3 AS a, floor(atraso_s / 3) + ordem_origem % 5 - 2 AS b, (cl * 13 + ordem_origem * 7 + hora * 3) % 100 / 100 AS p,
  CAST(cl % 9 - 60 AS DOUBLE) AS q1, CAST(cl % 5 - 2 AS DOUBLE) AS q2, CAST(70 - cl % 11 AS DOUBLE) AS q3 FROM segments""")


def preds(b):
    cl, o, h = F.col("cl"), F.col("ordem_origem"), F.col("hora")
    return seg_of(b).select(
        *ID, "cl", "letreiro", cal.local_date("t_origem").alias("dia"), F.col("tempo_percurso_s").alias("real_s"), F.col("atraso_s").alias("y"),
        F.col("atrasado").alias("c"), "confianca", "prefixo", (F.floor(F.col("atraso_s") / 2) + cl % 7 - 3).alias("a"),
        (F.floor(F.col("atraso_s") / 3) + o % 5 - 2).alias("b"), ((cl * 13 + o * 7 + h * 3) % 100 / 100).alias("p"),
        (cl % 9 - 60).cast("double").alias("q1"), (cl % 5 - 2).cast("double").alias("q2"), (70 - cl % 11).cast("double").alias("q3"))


@query("m01_time_split", oracle("split", "SELECT parte, count(*) AS n, min(t_origem) AS de, max(t_origem) AS ate FROM split GROUP BY 1"))
def m01(spark, sf):
    d = W.time_split(seg_of(Bus(spark, sf)), ["t_origem", "viagem_id", "ordem_origem"])
    return d.groupBy("parte").agg(F.count("*").alias("n"), F.unix_seconds(F.min("t_origem")).alias("de"), F.unix_seconds(F.max("t_origem")).alias("ate"))


@query("m02_model_base", oracle("base recent", """
SELECT parte, count(*) AS n, round(avg(alvo_s), 6) AS alvo_medio, count(r.med) AS com_recente FROM base b
JOIN recent r ON r.viagem_id = b.viagem_id AND r.ordem_origem = b.ordem_origem GROUP BY 1"""))
def m02(spark, sf):
    d = W.recent_traffic(base_of(Bus(spark, sf)))
    return d.groupBy("parte").agg(F.count("*").alias("n"), F.round(F.avg("alvo_s"), 6).alias("alvo_medio"), F.count("desvio_recente_trecho_s").alias("com_recente"))


MET = "count(*) AS n, round(avg(abs({p} - {y})), 4) AS mae_s, round(sqrt(avg(pow({p} - {y}, 2))), 4) AS rmse_s, round(avg({p} - {y}), 4) AS vies_s"


def met(df, y, p):
    return rounded(M.regression_metrics(df, y, p), "mae_s", "rmse_s", "vies_s", digits=4).select("n", "mae_s", "rmse_s", "vies_s")


@query("m03_delay_baselines", oracle("base recent", f"""
, t AS (SELECT b.*, coalesce(r.med, 0) AS rec, semana_s - percurso_tipico_s AS sem FROM base b JOIN recent r ON r.viagem_id = b.viagem_id AND r.ordem_origem = b.ordem_origem WHERE parte = 'teste')
SELECT 'trivial' AS modelo, {MET.format(p='0', y='alvo_s')} FROM t UNION ALL SELECT 'recente', {MET.format(p='rec', y='alvo_s')} FROM t
UNION ALL SELECT 'semana', {MET.format(p='sem', y='alvo_s')} FROM t""".strip()))
def m03(spark, sf):
    d = W.recent_traffic(base_of(Bus(spark, sf))).where("parte = 'teste'")
    e = F.explode(F.array(F.struct(F.lit("trivial").alias("m"), F.lit(0.0).alias("p")), F.struct(F.lit("recente").alias("m"), F.coalesce("desvio_recente_trecho_s", F.lit(0.0)).alias("p")),
                          F.struct(F.lit("semana").alias("m"), (F.col("semana_s") - F.col("percurso_tipico_s")).alias("p"))))
    d = d.withColumn("e", e).select("alvo_s", F.col("e.m").alias("modelo"), F.col("e.p").alias("p"))
    return rounded(M.regression_metrics(d, "alvo_s", "p", ["modelo"]), "mae_s", "rmse_s", "vies_s", digits=4).select("modelo", "n", "mae_s", "rmse_s", "vies_s")


BAND = "CASE WHEN horizonte_s <= 0 THEN NULL WHEN horizonte_s <= 300 THEN '0-5min' WHEN horizonte_s <= 600 THEN '5-10min' WHEN horizonte_s <= 1200 THEN '10-20min' WHEN horizonte_s <= 1800 THEN '20-30min' ELSE '30-60min' END"
derive("fsplit", ["pairs"], f"""
SELECT *, {BAND} AS fh, rn <= floor(n * CAST('0.7' AS DOUBLE)) AS tr FROM (SELECT *, row_number() OVER (ORDER BY t_chegada, qid) AS rn, count(*) OVER () AS n FROM pairs)""")


def forecast_base(b):
    d = W.cut_lineage(pairs_of(b).withColumn("fh", M.closed_band("horizonte_s", *M.HORIZON_BANDS)))
    d = W.time_split(d, ["t_chegada", "qid"])
    tr = d.where("parte <> 'teste'")
    med = M.group_quantiles(tr, [], "erro_s", {"mediana": 0.5})
    by = M.group_quantiles(tr.where("fh IS NOT NULL"), ["fh"], "erro_s", {"_m": 0.5})
    t = d.where("parte = 'teste'").join(by, "fh", "left").crossJoin(F.broadcast(med))  # one row
    return t.withColumns({"zero": F.lit(0.0), "por_faixa": F.coalesce("_m", "mediana"), "erro": F.col("erro_s").cast("double")})


FB = """
, g AS (SELECT median(erro_s) FILTER (tr) AS med FROM fsplit), h AS (SELECT fh, median(erro_s) FILTER (tr) AS m FROM fsplit WHERE fh IS NOT NULL GROUP BY 1),
t AS (SELECT f.*, med, coalesce(m, med) AS pf FROM fsplit f LEFT JOIN h ON h.fh = f.fh, g WHERE NOT tr)""".strip()


@query("m04_forecast_baselines", oracle("fsplit", FB + f"""
SELECT 'zero' AS modelo, {MET.format(p='0', y='erro_s')} FROM t UNION ALL SELECT 'mediana', {MET.format(p='med', y='erro_s')} FROM t
UNION ALL SELECT 'por_faixa', {MET.format(p='pf', y='erro_s')} FROM t"""))
def m04(spark, sf):
    d = forecast_base(Bus(spark, sf))
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("double").alias("p")) for m in ("zero", "mediana", "por_faixa")]))
    d = d.withColumn("e", e).select("erro", F.col("e.m").alias("modelo"), F.col("e.p").alias("p"))
    return rounded(M.regression_metrics(d, "erro", "p", ["modelo"]), "mae_s", "rmse_s", "vies_s", digits=4).select("modelo", "n", "mae_s", "rmse_s", "vies_s")


FEATS = ["hora", "dia_semana", "pico", "ordem_origem", "extensao_m", "percurso_tipico_s", "desvio_recente_trecho_s", "n_recente_trecho", "sentido"]


def model_rows(b):
    return W.cut_lineage(W.recent_traffic(base_of(b)).withColumn("rotulo", F.col("alvo_atrasado").cast("double")))


@query("m05_boosted_absolute")
def m05(spark, sf):
    d = model_rows(Bus(spark, sf))
    m = ML.fit_boosted(d.where("parte <> 'teste'"), FEATS, "alvo_s", "absolute", rounds=8)
    return M.regression_metrics(ML.predict(m, d.where("parte = 'teste'"), FEATS), "alvo_s", "previsto")


@query("m06_boosted_squared")
def m06(spark, sf):
    d = model_rows(Bus(spark, sf))
    m = ML.fit_boosted(d.where("parte <> 'teste'"), FEATS, "alvo_s", "squared", rounds=8)
    return M.regression_metrics(ML.predict(m, d.where("parte = 'teste'"), FEATS), "alvo_s", "previsto")


@query("m07_boosted_classifier")
def m07(spark, sf):
    d = model_rows(Bus(spark, sf))
    m = ML.fit_boosted(d.where("parte <> 'teste'"), FEATS, "rotulo", "logistic", rounds=6)
    rate = d.where("parte = 'treino'").agg(F.avg("alvo_atrasado").alias("r")).head()["r"]
    return M.classification_report(ML.predict(m, d.where("parte = 'validacao'"), FEATS), ML.predict(m, d.where("parte = 'teste'"), FEATS), "alvo_atrasado", "prob", rate)


@query("m08_conditional_quantiles", oracle("base", """
, k AS (SELECT cl, faixa, quantile_cont(alvo_s, 0.1) AS a, quantile_cont(alvo_s, 0.5) AS b, quantile_cont(alvo_s, 0.9) AS c FROM base WHERE parte <> 'teste' GROUP BY 1, 2 HAVING count(*) >= 20),
g AS (SELECT quantile_cont(alvo_s, 0.1) AS ga, quantile_cont(alvo_s, 0.5) AS gb, quantile_cont(alvo_s, 0.9) AS gc FROM base WHERE parte <> 'teste')
SELECT viagem_id, ordem_origem, round(coalesce(a, ga), 6) AS p10, round(coalesce(b, gb), 6) AS p50, round(coalesce(c, gc), 6) AS p90
FROM base LEFT JOIN k ON k.cl = base.cl AND k.faixa = base.faixa, g""".strip()))
def m08(spark, sf):
    d = M.conditional_quantiles(base_of(Bus(spark, sf)), "alvo_s", ["cl", "faixa"], F.col("parte") != "teste", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return rounded(d, "p10", "p50", "p90").select(*ID, "p10", "p50", "p90")


@query("m09_importance")
def m09(spark, sf):
    d = model_rows(Bus(spark, sf))
    return ML.importance(ML.fit_boosted(d.where("parte <> 'teste'"), FEATS, "alvo_s", rounds=5), FEATS, spark)


@query("m10_regression_metrics", oracle("preds", """
SELECT count(*) AS n, round(avg(abs(a - y)), 4) AS mae_s, round(sqrt(avg(pow(a - y, 2))), 4) AS rmse_s, round(100 * avg(abs((a - y) / y)) FILTER (abs(y) >= 1), 4) AS mape_pct,
  count(*) FILTER (abs(y) >= 1) AS n_mape, round(avg(a - y), 4) AS vies_s, round(1 - sum(pow(a - y, 2)) / (var_pop(y) * count(*)), 6) AS r2 FROM preds"""))
def m10(spark, sf):
    return rounded(rounded(M.regression_metrics(preds(Bus(spark, sf)), "y", "a"), "mae_s", "rmse_s", "mape_pct", "vies_s", digits=4), "r2")


@query("m11_confusion", oracle("preds", """
SELECT *, round(2 * precisao * revocacao / (precisao + revocacao), 6) AS f1 FROM (SELECT n, taxa_base, vp, fp, vn, fn, round((vp + vn) / n, 6) AS acuracia, vp / (vp + fp) AS precisao, vp / (vp + fn) AS revocacao FROM (
SELECT count(*) AS n, round(avg(c), 6) AS taxa_base, count(*) FILTER (p >= 0.5 AND c = 1) AS vp, count(*) FILTER (p >= 0.5 AND c = 0) AS fp,
  count(*) FILTER (p < 0.5 AND c = 0) AS vn, count(*) FILTER (p < 0.5 AND c = 1) AS fn FROM preds))"""))
def m11(spark, sf):
    return rounded(M.confusion(preds(Bus(spark, sf)), "c", F.col("p") >= 0.5), "taxa_base", "acuracia", "f1")


@query("m12_ranking_metrics", oracle("preds", """
, g AS (SELECT p, sum(c) AS pos, count(*) - sum(c) AS neg FROM preds GROUP BY 1),
w AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g)
SELECT round(sum(pos * (below + neg / 2)) / max(np * nn), 6) AS auc, round(sum(pos / np * tp / (tp + fp)), 6) AS pr_auc FROM w""".strip()))
def m12(spark, sf):
    return rounded(M.ranking_metrics(preds(Bus(spark, sf)), "c", "p"), "auc", "pr_auc")


@query("m13_brier", oracle("preds", """
SELECT round(b, 6) AS brier, round(r, 6) AS brier_ref, round(1 - b / r, 6) AS brier_skill FROM (SELECT avg(pow(p - c, 2)) AS b, avg(pow(0.25 - c, 2)) AS r FROM preds)"""))
def m13(spark, sf):
    return rounded(M.brier(preds(Bus(spark, sf)), "c", "p", 0.25), "brier", "brier_ref", "brier_skill")


@query("m14_best_threshold", oracle("preds", """
, t AS (SELECT round(unnest(generate_series(1, 49)) * 0.02, 2) AS limiar),
s AS (SELECT limiar, count(*) FILTER (p >= limiar AND c = 1) AS vp, count(*) FILTER (p >= limiar AND c = 0) AS fp, count(*) FILTER (p < limiar AND c = 1) AS fn FROM t, preds GROUP BY 1)
SELECT CAST(limiar AS DOUBLE) AS limiar, round(2 * vp / (2 * vp + fp + fn), 6) AS f1 FROM s ORDER BY 2 DESC, 1 LIMIT 1""".strip()))
def m14(spark, sf):
    return rounded(M.best_threshold(preds(Bus(spark, sf)), "c", "p"), "f1")


@query("m15_classification_report", oracle("preds", """
, t AS (SELECT round(unnest(generate_series(1, 49)) * 0.02, 2) AS limiar),
s AS (SELECT limiar, count(*) FILTER (p >= limiar AND c = 1) AS vp, count(*) FILTER (p >= limiar AND c = 0) AS fp, count(*) FILTER (p < limiar AND c = 1) AS fn FROM t, preds WHERE cl % 2 = 0 GROUP BY 1),
best AS (SELECT CAST(limiar AS DOUBLE) AS limiar FROM s ORDER BY round(2 * vp / (2 * vp + fp + fn), 9) DESC, limiar LIMIT 1),
test AS (SELECT * FROM preds WHERE cl % 2 = 1),
k AS (SELECT limiar, count(*) AS n, avg(c) AS taxa_base, count(*) FILTER (p >= limiar AND c = 1) AS vp, count(*) FILTER (p >= limiar AND c = 0) AS fp, count(*) FILTER (p < limiar AND c = 0) AS vn,
  count(*) FILTER (p < limiar AND c = 1) AS fn, avg(pow(p - c, 2)) AS b, avg(pow(0.25 - c, 2)) AS br FROM test, best GROUP BY 1),
g AS (SELECT p, sum(c) AS pos, count(*) - sum(c) AS neg FROM test GROUP BY 1),
w AS (SELECT *, sum(neg) OVER (ORDER BY p) - neg AS below, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS np, sum(neg) OVER () AS nn FROM g),
a AS (SELECT sum(pos * (below + neg / 2)) / max(np * nn) AS auc, sum(pos / np * tp / (tp + fp)) AS pr_auc FROM w)
SELECT n, round(taxa_base, 6) AS taxa_base, vp, fp, vn, fn, round((vp + vn) / n, 6) AS acuracia, round(vp / (vp + fp), 6) AS precisao, round(vp / (vp + fn), 6) AS revocacao, round(2 * vp / (2 * vp + fp + fn), 6) AS f1, limiar,
  round(2 * taxa_base / (taxa_base + 1), 6) AS f1_sempre_atrasado, round(auc, 6) AS auc, round(pr_auc, 6) AS pr_auc, round(b, 6) AS brier, round(br, 6) AS brier_ref, round(1 - b / br, 6) AS brier_skill FROM k, a""".strip()))
def m15(spark, sf):
    d = W.cut_lineage(preds(Bus(spark, sf)))
    r = M.classification_report(d.where("cl % 2 = 0"), d.where("cl % 2 = 1"), "c", "p", 0.25)
    return rounded(r, "taxa_base", "acuracia", "precisao", "revocacao", "f1", "f1_sempre_atrasado", "auc", "pr_auc", "brier", "brier_ref", "brier_skill")


@query("m16_mae_by_horizon", oracle("fsplit", FB + """
SELECT fh, modelo, count(*) AS n, round(avg(e), 1) AS mae_s FROM (SELECT fh, 'zero' AS modelo, abs(erro_s) AS e FROM t UNION ALL SELECT fh, 'mediana', abs(med - erro_s) FROM t
  UNION ALL SELECT fh, 'por_faixa', abs(pf - erro_s) FROM t) WHERE fh IS NOT NULL GROUP BY 1, 2"""))
def m16(spark, sf):
    return M.mae_by_band(forecast_base(Bus(spark, sf)), "erro", ["zero", "mediana", "por_faixa"], "fh")


@query("m17_pinball", oracle("preds", """
SELECT round(avg(greatest((y - q1) * 0.1, (y - q1) * -0.9)), 5) AS pinball_q1, round(avg(greatest((y - q3) * 0.9, (y - q3) * -0.1)), 5) AS pinball_q3,
  round(avg(-CASE WHEN c = 1 THEN ln(greatest(p, 1e-7)) ELSE ln(1 - greatest(p, 1e-7)) END), 5) AS entropia FROM preds"""))
def m17(spark, sf):
    d = M.uncross(preds(Bus(spark, sf)), ["q1", "q2", "q3"])
    return rounded(M.pinball(d, "y", {"q1": 0.1, "q3": 0.9}, "c", "p"), "pinball_q1", "pinball_q3", "entropia", digits=5)


@query("m18_quantile_coverage", oracle("preds", """
SELECT letreiro, count(*) AS n, round(avg(CASE WHEN y <= q1 THEN 1 ELSE 0 END), 6) AS cob_baixo, round(avg(CASE WHEN y <= q2 THEN 1 ELSE 0 END), 6) AS cob_meio,
  round(avg(CASE WHEN y <= q3 THEN 1 ELSE 0 END), 6) AS cob_alto, round(avg(CASE WHEN y BETWEEN q1 AND q3 THEN 1 ELSE 0 END), 6) AS cob_intervalo,
  round(avg(q3 - q1), 6) AS largura_media, median(q3 - q1) AS largura_mediana FROM preds GROUP BY 1"""))
def m18(spark, sf):
    d = M.coverage(preds(Bus(spark, sf)), "y", "q1", "q2", "q3", ["letreiro"])
    return rounded(d, "cob_baixo", "cob_meio", "cob_alto", "cob_intervalo", "largura_media")


@query("m19_ensemble", oracle("preds", """
, l AS (SELECT avg(abs(a - y)) AS ma, avg(abs(b - y)) AS mb FROM preds)
SELECT round((ma + mb) / 2, 6) AS mae_media, round(abs(ma - mb) / 2, 6) AS mae_dp, round((SELECT avg(abs((a + b) / 2 - y)) FROM preds), 6) AS mae_conjunto FROM l""".strip()))
def m19(spark, sf):
    d = preds(Bus(spark, sf)).select(*ID, "y", F.explode(F.array(F.struct(F.lit(1).alias("s"), F.col("a").cast("double").alias("p")), F.struct(F.lit(2).alias("s"), F.col("b").cast("double").alias("p")))).alias("e"))
    return rounded(M.ensemble(d.select(*ID, "y", F.col("e.s").alias("semente"), F.col("e.p").alias("p")), ID, "y", "p", "semente"), "mae_media", "mae_dp", "mae_conjunto")


@query("m20_sequence_baselines", oracle("series", """
, w AS (SELECT em, observado, lag(em) OVER w AS u, (lag(em, 1) OVER w + lag(em, 2) OVER w + lag(em, 3) OVER w) / 3 AS m3, avg(em) OVER (w ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS m, lag(em, 8) OVER w AS p
  FROM series WINDOW w AS (PARTITION BY cl, cp ORDER BY b))
SELECT count(*) AS n, round(avg(abs(u - em)), 5) AS mae_ultimo, round(avg(abs(m3 - em)), 5) AS mae_media3, round(avg(abs(m - em)), 5) AS mae_media FROM w WHERE p IS NOT NULL AND observado""".strip()))
def m20(spark, sf):
    w = W.sliding_windows(W.regular_series(series_pairs(Bus(spark, sf)), 180, 8), 8)
    return rounded(M.sequence_baselines(w), "mae_ultimo", "mae_media3", "mae_media", digits=5)


derive("wf", ["segments"], """
SELECT s.viagem_id, s.ordem_origem, s.dia, 'janela_7' AS config, s.tempo_percurso_s AS real_s, abs(s.tempo_percurso_s - r.m) AS e FROM segments s JOIN (
  SELECT d.dia AS dt, t.cl, t.ordem_origem, median(t.tempo_percurso_s) AS m FROM (SELECT DISTINCT dia FROM segments) d JOIN segments t ON t.dia < d.dia AND t.dia >= d.dia - 7 GROUP BY 1, 2, 3) r
  ON r.dt = s.dia AND r.cl = s.cl AND r.ordem_origem = s.ordem_origem
UNION ALL SELECT s.viagem_id, s.ordem_origem, s.dia, 'janela_toda', s.tempo_percurso_s, abs(s.tempo_percurso_s - r.m) FROM segments s JOIN (
  SELECT d.dia AS dt, t.cl, t.ordem_origem, median(t.tempo_percurso_s) AS m FROM (SELECT DISTINCT dia FROM segments) d JOIN segments t ON t.dia < d.dia GROUP BY 1, 2, 3) r
  ON r.dt = s.dia AND r.cl = s.cl AND r.ordem_origem = s.ordem_origem""")


def wf(b):
    s = seg_of(b).select(*ID, "cl", "tempo_percurso_s", cal.local_date("t_origem").alias("dia"))
    return ML.walk_forward(W.cut_lineage(s), "dia", [7, None], ["cl", "ordem_origem"], "tempo_percurso_s")


@query("m21_walk_forward", oracle("wf", "SELECT config, count(*) AS n, round(avg(e), 6) AS mae_s FROM wf GROUP BY 1"))
def m21(spark, sf):
    e = F.avg(F.abs(F.col("tempo_percurso_s") - F.col("previsto")))
    return wf(Bus(spark, sf)).groupBy("config").agg(F.count("*").alias("n"), F.round(e, 6).alias("mae_s"))


@query("m22_config_comparison", oracle("wf", """
, k AS (SELECT viagem_id, ordem_origem FROM wf GROUP BY 1, 2 HAVING count(*) = 2)
SELECT dia, config, count(*) AS n, round(avg(e), 6) AS mae_s, round(sum(e) / sum(real_s), 6) AS erro_rel, round(avg(CASE WHEN e <= 0.2 * real_s THEN 1 ELSE 0 END), 6) AS acerto20,
  round(avg(e) FILTER (real_s <= 180), 6) AS mae_curtos_s FROM wf JOIN k USING (viagem_id, ordem_origem) GROUP BY 1, 2""".strip()))
def m22(spark, sf):
    return rounded(compared(spark, sf), "mae_s", "erro_rel", "acerto20", "mae_curtos_s")


def compared(spark, sf):
    d = wf(Bus(spark, sf)).select(F.concat_ws("#", *ID).alias("id"), F.datediff("dia", F.lit("1970-01-01").cast("date")).cast("long").alias("dia"), "config",
                                  F.col("tempo_percurso_s").alias("real_s"), (F.col("previsto") - F.col("tempo_percurso_s")).alias("desvio_s"))
    return M.daily_comparison(d, ["janela_7", "janela_toda"])


@query("m23_learning_curve", oracle("segments", """
, t AS (SELECT k, s.cl, s.ordem_origem, median(tempo_percurso_s) AS m FROM segments s JOIN (VALUES (3), (7), (14)) v(k) ON dia < 19743 AND 19743 - dia <= k GROUP BY 1, 2, 3)
SELECT k, count(*) AS n, round(avg(abs(tempo_percurso_s - m)), 6) AS mae_s FROM segments s JOIN t ON t.cl = s.cl AND t.ordem_origem = s.ordem_origem WHERE dia >= 19743 GROUP BY 1""".strip()))
def m23(spark, sf):
    s = seg_of(Bus(spark, sf)).withColumn("dia", cal.local_date("t_origem"))
    return rounded(ML.learning_curve(s, "dia", "2024-01-21", [3, 7, 14], ["cl", "ordem_origem"], "tempo_percurso_s"), "mae_s")


@query("m24_train_periods", oracle("segments", """
, t AS (SELECT p, s.cl, s.ordem_origem, median(tempo_percurso_s) AS m FROM segments s JOIN (VALUES ('inicio', 19722, 19733), ('recente', 19733, 19743)) v(p, a, z) ON dia >= a AND dia < z GROUP BY 1, 2, 3)
SELECT p AS periodo, count(*) AS n, round(avg(abs(tempo_percurso_s - m)), 6) AS mae_s FROM segments s JOIN t ON t.cl = s.cl AND t.ordem_origem = s.ordem_origem WHERE dia >= 19743 GROUP BY 1""".strip()))
def m24(spark, sf):
    s = seg_of(Bus(spark, sf)).withColumn("dia", cal.local_date("t_origem"))
    per = F.when(F.col("dia") < "2024-01-11", "inicio").when(F.col("dia") < "2024-01-21", "recente")
    ref = M.group_quantiles(s.where("dia < '2024-01-21'").withColumn("periodo", per), ["periodo", "cl", "ordem_origem"], "tempo_percurso_s", {"m": 0.5})
    t = s.where("dia >= '2024-01-21'").join(ref, ["cl", "ordem_origem"])
    return t.groupBy("periodo").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("tempo_percurso_s") - F.col("m"))), 6).alias("mae_s"))


@query("m25_parameter_grid")
def m25(spark, sf):
    d = model_rows(Bus(spark, sf)).where("parte <> 'teste'")
    return ML.grid_search(d, FEATS[:6], "alvo_s", {"depth": [3, 4]}, rounds=3)


@query("m26_ablation")
def m26(spark, sf):
    return ML.ablation(model_rows(Bus(spark, sf)), FEATS[:4], {"transito": FEATS[6:8]}, "alvo_s", rounds=3)


@query("m27_cluster_bootstrap", oracle("preds", f"""
, s AS (SELECT viagem_id, sum(abs(a - y) - abs(b - y)) AS e, count(*) AS n FROM preds GROUP BY 1),
r AS (SELECT r, sum(w * e) / nullif(sum(w * n), 0) AS v FROM (SELECT *, {sql_poisson('7', 'r', 'viagem_id')} AS w FROM s, range(1, 201) t(r)) GROUP BY 1)
SELECT (SELECT round(sum(e) / sum(n), 6) FROM s) AS valor, round(quantile_cont(v, 0.025), 6) AS ic_baixo, round(quantile_cont(v, 0.975), 6) AS ic_alto FROM r""".strip()))
def m27(spark, sf):
    d = preds(Bus(spark, sf))
    return rounded(M.cluster_bootstrap(d, "viagem_id", F.abs(F.col("a") - F.col("y")) - F.abs(F.col("b") - F.col("y")), F.lit(1.0)), "valor", "ic_baixo", "ic_alto")


@query("m28_per_line", oracle("preds", """
, d AS (SELECT letreiro, dia, count(*) AS n, avg(abs(a - y)) AS a, avg(abs(b - y)) AS b, sum(abs(a - y)) AS sa, sum(abs(b - y)) AS sb FROM preds GROUP BY 1, 2)
SELECT letreiro, CAST(sum(n) AS BIGINT) AS n, round(sum(sa) / sum(n), 6) AS mae_a, round(sum(sb) / sum(n), 6) AS mae_b, round(avg(a), 6) AS mae_dia_a, round(avg(b), 6) AS mae_dia_b,
  count(*) FILTER (a < b) AS dias_a, count(*) AS dias FROM d GROUP BY 1""".strip()))
def m28(spark, sf):
    d = preds(Bus(spark, sf)).withColumns({"ea": F.abs(F.col("a") - F.col("y")), "eb": F.abs(F.col("b") - F.col("y"))})
    return rounded(M.per_line_table(d, ["letreiro"]), "mae_a", "mae_b", "mae_dia_a", "mae_dia_b")


@query("m29_error_floor", oracle("segments", """
SELECT count(*) AS pares, round(avg(abs(tempo_percurso_s - x)), 6) AS dif_media_s, round(avg(abs(tempo_percurso_s - x)) / sqrt(2), 6) AS piso_s FROM (
  SELECT *, lag(tempo_percurso_s) OVER w AS x, lag(t_origem) OVER w AS t, lag(prefixo) OVER w AS v FROM segments WINDOW w AS (PARTITION BY cp_origem, cp_destino ORDER BY t_origem, viagem_id))
WHERE t_origem - t <= 3600 AND v <> prefixo"""))
def m29(spark, sf):
    return rounded(M.error_floor(seg_of(Bus(spark, sf)), 3600.0), "dif_media_s", "piso_s")


@query("m30_residual_autocovariance", oracle("preds", """
SELECT round(var_samp(r), 4) AS variancia, round(covar_samp(r1, r) FILTER (o1 - ordem_origem = 1), 4) AS cov_1, round(covar_samp(r2, r) FILTER (o2 - ordem_origem = 2), 4) AS cov_2 FROM (
  SELECT *, lead(r) OVER w AS r1, lead(r, 2) OVER w AS r2, lead(ordem_origem) OVER w AS o1, lead(ordem_origem, 2) OVER w AS o2 FROM (SELECT *, y - a AS r FROM preds)
  WINDOW w AS (PARTITION BY viagem_id ORDER BY ordem_origem))"""))
def m30(spark, sf):
    d = preds(Bus(spark, sf)).withColumn("r", F.col("y") - F.col("a"))
    return rounded(M.residual_autocovariance(d, "r", 2), "variancia", "cov_1", "cov_2", digits=4)


@query("m31_error_profile", oracle("preds", """
, q AS (SELECT quantile_cont(confianca, 0.25) AS a, quantile_cont(confianca, 0.5) AS b, quantile_cont(confianca, 0.75) AS c FROM preds)
SELECT CAST(confianca > q.a AS INTEGER) + CAST(confianca > q.b AS INTEGER) + CAST(confianca > q.c AS INTEGER) AS quartil, count(*) AS n, round(avg(abs(y - preds.a)), 6) AS mae_s FROM preds, q GROUP BY 1""".strip()))
def m31(spark, sf):
    d = M.quantile_bins(preds(Bus(spark, sf)), "confianca", 4, "quartil")
    return d.groupBy("quartil").agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("y") - F.col("a"))), 6).alias("mae_s"))


@query("m31_worst_segments", oracle("preds", """
, g AS (SELECT cl, ordem_origem, sum(abs(y - a)) AS s, avg(abs(y - a)) AS m FROM preds GROUP BY 1, 2 HAVING count(*) >= 20), c AS (SELECT quantile_cont(m, 0.95) AS c FROM g)
SELECT count(*) FILTER (m > c) AS grupos, round(sum(s) FILTER (m > c) / sum(s), 6) AS parcela FROM g, c""".strip()))
def m31b(spark, sf):
    d = preds(Bus(spark, sf)).withColumn("e", F.abs(F.col("y") - F.col("a")))
    return rounded(M.worst_share(d, ["cl", "ordem_origem"], "e"), "parcela")


@query("m31_error_by_age", oracle("segments", """
, k AS (SELECT s.*, floor(s.atraso_s / 2) + s.cl % 7 - 3 AS a, s.t_origem - e.t_chegada AS idade_s FROM segments s ASOF LEFT JOIN (SELECT cl, ordem_origem, t_chegada FROM segments) e
  ON e.cl = s.cl AND e.ordem_origem = s.ordem_origem AND s.t_origem > e.t_chegada)
SELECT CASE WHEN idade_s < 60 THEN '< 1 min' WHEN idade_s < 180 THEN '1-3 min' WHEN idade_s < 600 THEN '3-10 min' WHEN idade_s < 1800 THEN '10-30 min' ELSE 'sem dado' END AS idade, count(*) AS n,
  round(avg(abs(atraso_s - a)), 6) AS modelo, round(avg(abs(atraso_s)), 6) AS trivial, round(1 - avg(abs(atraso_s - a)) / avg(abs(atraso_s)), 6) AS ganho, round(count(*) / (SELECT count(*) FROM k), 6) AS parcela FROM k GROUP BY 1""".strip()))
def m31_age(spark, sf):
    d = seg_of(Bus(spark, sf))
    own = d.select(*ID, "cl", "t_origem", F.col("atraso_s").alias("y"), (F.col("atraso_s") - (F.floor(F.col("atraso_s") / 2) + F.col("cl") % 7 - 3)).alias("e"))
    m = asof_join(own, d.select("cl", "ordem_origem", "t_chegada", "viagem_id"), ["cl", "ordem_origem"], "t_origem", "t_chegada", {}, "viagem_id", event_time_out="_et")
    m = m.withColumn("idade_s", seconds_between("t_origem", "_et"))
    return rounded(M.error_by_age(m, "idade_s", "e", "y"), "modelo", "trivial", "ganho", "parcela")


@query("m31_tail_bias", oracle("preds", """
, k AS (SELECT quantile_cont(y, 0.9) AS q FROM preds)
SELECT count(*) FILTER (y >= q) AS n, round(any_value(q), 6) AS corte, round(avg(y) FILTER (y >= q), 6) AS real_media, round(avg(a) FILTER (y >= q), 6) AS previsto_media,
  round(sum(abs(y - a)) FILTER (y >= q) / sum(abs(y - a)), 6) AS parcela FROM preds, k""".strip()))
def m31_tail(spark, sf):
    return rounded(M.tail_bias(preds(Bus(spark, sf)), "y", "a"), "corte", "real_media", "previsto_media", "parcela")


@query("m22_wins_by_day", oracle("wf", """
, k AS (SELECT viagem_id, ordem_origem FROM wf GROUP BY 1, 2 HAVING count(*) = 2),
d AS (SELECT dia, config, avg(e) AS m FROM wf JOIN k USING (viagem_id, ordem_origem) GROUP BY 1, 2)
SELECT config, count(*) AS dias_vencidos FROM (SELECT dia, config FROM d QUALIFY row_number() OVER (PARTITION BY dia ORDER BY round(m, 9), config) = 1) GROUP BY 1""".strip()))
def m22_wins(spark, sf):
    return M.day_wins(compared(spark, sf).withColumn("mae_s", F.round("mae_s", 9)))
