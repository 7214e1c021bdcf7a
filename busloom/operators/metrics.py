"""Regression, classification and probability metrics as single aggregates; resampling."""

from __future__ import annotations

import math
from fractions import Fraction

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators.ordered import Ordered, lagged
from busloom.operators.quantiles import group_quantiles, summarize


def _safe(a, b, zero=0.0):
    return F.when(b != 0, a / b).otherwise(F.lit(zero))


def regression_metrics(df: DataFrame, y: str, pred: str, keys: list[str] = ()) -> DataFrame:
    e = F.col(pred) - F.col(y)
    big = F.abs(F.col(y)) >= 1
    ss = F.var_pop(y) * F.count(y)
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("mae_s"), F.sqrt(F.avg(e * e)).alias("rmse_s"),
        (100 * F.avg(F.when(big, F.abs(e / F.col(y))))).alias("mape_pct"), F.count_if(big).alias("n_mape"),
        F.avg(e).alias("vies_s"), (1 - F.sum(e * e) / F.greatest(ss, F.lit(1e-9))).alias("r2"))


def confusion(df: DataFrame, y: str, hit: Column, keys: list[str] = ()) -> DataFrame:
    pos = F.col(y) == 1
    g = df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.col(y).cast("double")).alias("taxa_base"),
        F.count_if(hit & pos).alias("vp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("vn"), F.count_if(~hit & pos).alias("fn"))
    return scores(g)


def scores(g: DataFrame) -> DataFrame:
    vp, fp, vn, fn = (F.col(c) for c in ("vp", "fp", "vn", "fn"))
    g = g.withColumns({"acuracia": _safe(vp + vn, vp + fp + vn + fn), "precisao": _safe(vp, vp + fp), "revocacao": _safe(vp, vp + fn)})
    return g.withColumn("f1", _safe(2 * F.col("precisao") * F.col("revocacao"), F.col("precisao") + F.col("revocacao")))


def ranking_metrics(df: DataFrame, y: str, score: str) -> DataFrame:
    """ROC AUC (ties count half) and average precision, from counts per distinct score."""
    g = df.groupBy(F.col(score).alias("_s")).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    g = g.withColumn("_q", F.col("_n") - F.col("_p"))
    g = Ordered(g, [], ["_s"]).running_sum({"_cp": "_p", "_cq": "_q"}).df
    tot = g.agg(F.sum("_p").alias("_tp"), F.sum("_q").alias("_tq"))
    g = g.crossJoin(F.broadcast(tot))  # one row
    below = F.col("_cq") - F.col("_q")
    auc = F.sum(F.col("_p") * (below + F.col("_q") / 2)) / F.max(F.col("_tp").cast("double") * F.col("_tq"))
    tp = F.col("_tp") - F.col("_cp") + F.col("_p")
    fp = F.col("_tq") - F.col("_cq") + F.col("_q")
    ap = F.sum(F.col("_p") / F.col("_tp") * tp / (tp + fp))
    return g.agg(auc.alias("auc"), ap.alias("pr_auc"))


def brier(df: DataFrame, y: str, prob: str, base_rate: float | Column) -> DataFrame:
    yy = F.col(y).cast("double")
    rate = base_rate if isinstance(base_rate, Column) else F.lit(float(base_rate))
    g = df.agg(F.avg(F.pow(F.col(prob) - yy, F.lit(2))).alias("brier"), F.avg(F.pow(rate - yy, F.lit(2))).alias("brier_ref"))
    return g.withColumn("brier_skill", F.when(F.col("brier_ref") > 0, 1 - F.col("brier") / F.col("brier_ref")))


THRESHOLDS = [0.02 + 0.02 * i for i in range(49)]


def threshold_table(df: DataFrame, y: str, prob: str, thresholds=None) -> DataFrame:
    """F1 at every threshold in one pass: rows are counted per threshold step, then summed from the top."""
    ts = [round(t, 2) for t in (thresholds or THRESHOLDS)]
    b = Bucketizer(splits=[float("-inf"), *ts, float("inf")], inputCol="_x", outputCol="_k")
    d = b.transform(df.withColumn("_x", F.col(prob).cast("double")))
    step = d.groupBy(F.col("_k").cast("int").alias("_k")).agg(F.sum(F.col(y).cast("long")).alias("_p"), F.count("*").alias("_n"))
    one = step.agg(F.collect_list(F.struct("_k", "_p", "_n")).alias("_s"))  # 50 items at most
    t = one.select(F.posexplode(F.array(*[F.lit(x) for x in ts])).alias("_i", "limiar"), "_s")

    def total(item, over):
        keep = F.filter("_s", lambda s: (s["_k"] > F.col("_i")) if over else (s["_k"] <= F.col("_i")))
        return F.aggregate(keep, F.lit(0).cast("long"), lambda a, s: a + item(s))

    pos, neg = (lambda s: s["_p"]), (lambda s: s["_n"] - s["_p"])
    g = t.select("limiar", total(pos, True).alias("vp"), total(neg, True).alias("fp"), total(neg, False).alias("vn"), total(pos, False).alias("fn"))
    return scores(g)


def best_threshold(df: DataFrame, y: str, prob: str) -> DataFrame:
    """Lowest threshold with the highest F1."""
    t = threshold_table(df, y, prob)
    return t.agg(F.max_by(F.struct("limiar", "f1"), F.struct("f1", -F.col("limiar"))).alias("_b")).select("_b.*")


def classification_report(valid: DataFrame, test: DataFrame, y: str, prob: str, base_rate: float) -> DataFrame:
    """Test metrics at the threshold chosen on validation, with the trivial references."""
    t = best_threshold(valid, y, prob).head()["limiar"]
    rep = confusion(test, y, F.col(prob) >= F.lit(t)).withColumn("limiar", F.lit(t))
    base = F.col("taxa_base")
    rep = rep.withColumn("f1_sempre_atrasado", 2 * base / (base + 1))
    return rep.crossJoin(ranking_metrics(test, y, prob)).crossJoin(brier(test, y, prob, base_rate))  # one row each


def mae_by_band(df: DataFrame, y: str, preds: list[str], band: str) -> DataFrame:
    """MAE per band for several predictors, in long form."""
    pairs = F.explode(F.array(*[F.struct(F.lit(p).alias("modelo"), F.abs(F.col(p) - F.col(y)).alias("e")) for p in preds]))
    d = df.where(F.col(band).isNotNull()).select(band, pairs.alias("_s"))
    return d.groupBy(band, "_s.modelo").agg(F.count("*").alias("n"), F.round(F.avg("_s.e"), 1).alias("mae_s"))


def closed_band(c: str, edges: list[float], names: list[str]) -> Column:
    """Right-closed bands (a, b]; outside them NULL."""
    out = F.lit(None).cast("string")
    for lo, hi, n in reversed(list(zip(edges, edges[1:], names))):
        out = F.when((F.col(c) > lo) & (F.col(c) <= hi), n).otherwise(out)
    return out


HORIZON_BANDS = ([0, 300, 600, 1200, 1800, 3600], ["0-5min", "5-10min", "10-20min", "20-30min", "30-60min"])


def pinball(df: DataFrame, y: str, quantiles: dict[str, float], flag: str, prob: str) -> DataFrame:
    """Mean pinball loss per quantile and cross-entropy of the late probability."""
    aggs = []
    for c, q in quantiles.items():
        e = F.col(y) - F.col(c)
        aggs.append(F.avg(F.greatest(e * q, e * (q - 1))).alias(f"pinball_{c}"))
    p = F.least(F.greatest(F.col(prob), F.lit(1e-7)), F.lit(1 - 1e-7))
    aggs.append(F.avg(-F.when(F.col(flag) == 1, F.log(p)).otherwise(F.log(1 - p))).alias("entropia"))
    return df.agg(*aggs)


def uncross(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sort crossed quantile predictions of a row."""
    s = F.array_sort(F.array(*cols))
    d = df.withColumn("_q", s)
    return d.withColumns({c: F.col("_q")[i] for i, c in enumerate(cols)}).drop("_q")


def coverage(df: DataFrame, y: str, low: str, mid: str, high: str, keys: list[str]) -> DataFrame:
    flag = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    d = df.withColumn("_w", F.col(high) - F.col(low))
    return summarize(d, keys, [
        F.count("*").alias("n"), flag(F.col(y) <= F.col(low)).alias("cob_baixo"), flag(F.col(y) <= F.col(mid)).alias("cob_meio"),
        flag(F.col(y) <= F.col(high)).alias("cob_alto"), flag(F.col(y).between(F.col(low), F.col(high))).alias("cob_intervalo"),
        F.avg("_w").alias("largura_media")], {"_w": {"largura_mediana": 0.5}})


def ensemble(preds: DataFrame, row: list[str], y: str, pred: str, seed: str) -> DataFrame:
    """MAE of each run summarised, and MAE of the mean prediction."""
    per = preds.groupBy(seed).agg(F.avg(F.abs(F.col(pred) - F.col(y))).alias("_m"))
    a = per.agg(F.avg("_m").alias("mae_media"), F.stddev_pop("_m").alias("mae_dp"))
    m = preds.groupBy(*row).agg(F.avg(pred).alias("_p"), F.max(y).alias("_y"))
    return a.crossJoin(m.agg(F.avg(F.abs(F.col("_p") - F.col("_y"))).alias("mae_conjunto")))  # one row each


def sequence_baselines(windows: DataFrame) -> DataFrame:
    """Last step, mean of the last three and of all steps as predictors of the next bin."""
    errs = F.transform("passos", lambda p: p["erro_medio"])
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda x, v: x + v) / F.size(a)
    d = windows.withColumn("_e", errs)
    d = d.withColumns({"ultimo": F.element_at("_e", -1), "media3": mean(F.slice("_e", -3, 3)), "media": mean(F.col("_e"))})
    return d.agg(F.count("*").alias("n"), *[F.avg(F.abs(F.col(c) - F.col("alvo"))).alias(f"mae_{c}") for c in ("ultimo", "media3", "media")])


def conditional_quantiles(df: DataFrame, value: str, keys: list[str], train: Column, probs: dict[str, float], min_n: int = 20) -> DataFrame:
    """Empirical quantiles by key from train rows, the overall ones where a key is rare."""
    tr = df.where(train)
    by = group_quantiles(tr, keys, value, {o + "_k": p for o, p in probs.items()}, "_n").where(F.col("_n") >= min_n).drop("_n")
    every = group_quantiles(tr, [], value, {o + "_g": p for o, p in probs.items()})
    d = df.join(by, keys, "left").crossJoin(F.broadcast(every))  # one row
    return d.withColumns({o: F.coalesce(o + "_k", o + "_g") for o in probs}).drop(*[o + t for o in probs for t in ("_k", "_g")])


# -- comparisons
def daily_comparison(errors: DataFrame, configs: list[str]) -> DataFrame:
    """`errors`: id, dia, config, real_s, desvio_s (signed), on any rows; kept where all configs have them."""
    n = errors.groupBy("id").agg(F.countDistinct("config").alias("_k")).where(F.col("_k") == len(configs))
    d = errors.join(n.select("id"), "id", "left_semi")
    e = F.abs("desvio_s")
    return d.groupBy("dia", "config").agg(
        F.count("*").alias("n"), F.avg(e).alias("mae_s"), (F.sum(e) / F.sum("real_s")).alias("erro_rel"),
        F.avg(F.when(e <= 0.2 * F.col("real_s"), 1.0).otherwise(0.0)).alias("acerto20"),
        F.avg(F.when(F.col("real_s") <= 180, e)).alias("mae_curtos_s"))


def day_wins(daily: DataFrame) -> DataFrame:
    """Days on which each config has the lowest MAE."""
    best = daily.groupBy("dia").agg(F.min_by("config", F.struct("mae_s", "config")).alias("config"))
    return best.groupBy("config").agg(F.count("*").alias("dias_vencidos"))


def per_line_table(errors: DataFrame, keys: list[str]) -> DataFrame:
    """Two models (columns ea, eb = absolute errors): overall, mean of daily means, days won."""
    day = errors.groupBy(*keys, "dia").agg(F.count("*").alias("_n"), F.avg("ea").alias("_a"), F.avg("eb").alias("_b"), F.sum("ea").alias("_sa"), F.sum("eb").alias("_sb"))
    return day.groupBy(*keys).agg(
        F.sum("_n").alias("n"), (F.sum("_sa") / F.sum("_n")).alias("mae_a"), (F.sum("_sb") / F.sum("_n")).alias("mae_b"),
        F.avg("_a").alias("mae_dia_a"), F.avg("_b").alias("mae_dia_b"), F.count_if(F.col("_a") < F.col("_b")).alias("dias_a"), F.count("*").alias("dias"))


def draw(*parts) -> Column:
    """A number of 52 bits fixed by md5, so other engines can draw the same."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


# Cumulative Poisson(1) probabilities.
POISSON_CDF = [0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582, 0.99991676]


def poisson_weight(*parts) -> Column:
    """Poisson(1) draw fixed by a hash: the same replicate and unit always weigh the same."""
    u = F.md5(F.concat_ws(":", *parts))  # the draw's digits lead: they compare like the number
    out = F.lit(len(POISSON_CDF))
    for k, c in reversed(list(enumerate(POISSON_CDF))):
        out = F.when(u < f"{math.ceil(Fraction(c) * (1 << 52)):013x}", k).otherwise(out)
    return out


def cluster_bootstrap(df: DataFrame, unit: str, num: Column, den: Column, replicates: int = 200, seed: int = 7, keys: list[str] = ()) -> DataFrame:
    """Ratio of sums with a 95 % interval, resampling whole units (trips or days)."""
    sums = df.groupBy(*keys, unit).agg(F.sum(num).alias("_a"), F.sum(den).alias("_b"))
    rep = sums.withColumn("_r", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    w = poisson_weight(F.lit(seed), F.col("_r"), F.col(unit))
    rep = rep.withColumn("_w", w).groupBy(*keys, "_r").agg(
        (F.sum(F.col("_w") * F.col("_a")) / F.nullif(F.sum(F.col("_w") * F.col("_b")), F.lit(0.0))).alias("_v"))
    ci = rep.groupBy(*keys).agg(F.percentile("_v", 0.025).alias("ic_baixo"), F.percentile("_v", 0.975).alias("ic_alto"))
    point = sums.groupBy(*keys).agg((F.sum("_a") / F.sum("_b")).alias("valor"))
    return point.join(ci, list(keys)) if keys else point.crossJoin(ci)  # one row each


# -- diagnosis
def error_floor(seg: DataFrame, gap_s: float = 120.0) -> DataFrame:
    """Difference to the previous other vehicle that crossed the stop pair within `gap_s`."""
    d = lagged(seg, ["cp_origem", "cp_destino"], ["t_origem", "viagem_id"], {"_x": "tempo_percurso_s", "_t": "t_origem", "_v": "prefixo"})
    gap = (F.unix_micros("t_origem") - F.unix_micros("_t")) / 1e6
    d = d.where((gap <= gap_s) & (F.col("_v") != F.col("prefixo"))).withColumn("_d", F.abs(F.col("tempo_percurso_s") - F.col("_x")))
    return d.agg(F.count("*").alias("pares"), F.avg("_d").alias("dif_media_s"), (F.avg("_d") / F.sqrt(F.lit(2.0))).alias("piso_s"))


def residual_autocovariance(df: DataFrame, residual: str, lags: int = 3) -> DataFrame:
    """Covariance of residuals k segments apart in the same trip."""
    o = Ordered(df, ["viagem_id"], ["ordem_origem"])
    for k in range(1, lags + 1):
        o.lead({f"_r{k}": residual, f"_o{k}": "ordem_origem"}, k)
    d = o.df
    aggs = [F.var_samp(residual).alias("variancia")]
    for k in range(1, lags + 1):
        near = F.col(f"_o{k}") - F.col("ordem_origem") == k
        aggs.append(F.covar_samp(F.when(near, F.col(residual)), F.when(near, F.col(f"_r{k}"))).alias(f"cov_{k}"))
    return d.agg(*aggs)


def quantile_bins(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
    """Equal-frequency bins from interpolated edges, right-closed; the edges are k - 1 scalars."""
    probs = {f"e{i}": i / k for i in range(1, k)}
    row = group_quantiles(df, [], value, probs).head()
    c = F.lit(0)
    for i in range(1, k):
        c = c + F.when(F.col(value) > F.lit(row[f"e{i}"]), 1).otherwise(0)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), c))


AGE_LIMITS_S, AGE_NAMES = (60, 180, 600, 1800), ("< 1 min", "1-3 min", "3-10 min", "10-30 min")


def error_by_age(df: DataFrame, age_s: str, err: str, trivial: str) -> DataFrame:
    """Absolute error of a model and of the trivial answer by the age of the newest information; older or none is `sem dado`."""
    band = F.lit("sem dado")
    for limit, name in reversed(list(zip(AGE_LIMITS_S, AGE_NAMES))):
        band = F.when((F.col(age_s) >= 0) & (F.col(age_s) < limit), name).otherwise(band)
    n = F.sum("n").over(Window.partitionBy(F.lit(1)))  # five rows
    g = df.groupBy(band.alias("idade")).agg(F.count("*").alias("n"), F.avg(F.abs(err)).alias("modelo"), F.avg(F.abs(trivial)).alias("trivial"))
    return g.withColumns({"ganho": 1 - F.col("modelo") / F.nullif("trivial", F.lit(0.0)), "parcela": F.col("n") / n})


def tail_bias(df: DataFrame, actual: str, predicted: str, share: float = 0.9) -> DataFrame:
    """Rows at or above the quantile of what happened: real and predicted mean, and their part of the whole absolute error."""
    cut = group_quantiles(df, [], actual, {"_cut": share}).head()["_cut"]
    e, tail = F.abs(F.col(actual) - F.col(predicted)), F.col(actual) >= F.lit(cut)
    return df.agg(
        F.count_if(tail).alias("n"), F.lit(cut).alias("corte"), F.avg(F.when(tail, F.col(actual))).alias("real_media"),
        F.avg(F.when(tail, F.col(predicted))).alias("previsto_media"), (F.sum(F.when(tail, e)) / F.sum(e)).alias("parcela"))


def worst_share(df: DataFrame, keys: list[str], err: str, share: float = 0.05) -> DataFrame:
    """Share of all absolute error held by the worst `share` of groups (by mean error, min 20 rows)."""
    g = df.groupBy(*keys).agg(F.sum(err).alias("_s"), F.count("*").alias("_n"), F.avg(err).alias("_m")).where("_n >= 20")
    cut = group_quantiles(g, [], "_m", {"_c": 1 - share})
    d = g.crossJoin(F.broadcast(cut))  # one row
    return d.agg(F.count_if(F.col("_m") > F.col("_c")).alias("grupos"), (F.sum(F.when(F.col("_m") > F.col("_c"), F.col("_s"))) / F.sum("_s")).alias("parcela"))
