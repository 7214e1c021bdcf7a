"""Forecast against what happened: cleaning, forward as-of match, error, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.config import Params
from busloom.functions import calendar as cal
from busloom.functions.geo import cell_id
from busloom.operators.asof import asof_join, seconds_between
from busloom.operators.delay import add_headway
from busloom.operators.ordered import latest_per_key
from busloom.operators.quantiles import summarize


def valid_forecasts(fc: DataFrame, p: Params = Params()) -> DataFrame:
    """Known promise and vehicle, horizon in range."""
    return fc.where(
        F.col("t_previsto").isNotNull()
        & F.col("prefixo").isNotNull()
        & F.col("horizonte_s").between(0, p.horizon_max_s)
    )


def last_polls(fc: DataFrame, order: str) -> DataFrame:
    """The last row per line, stop, vehicle and poll."""
    return latest_per_key(fc, ["cl", "cp", "prefixo", "ts_coleta"], [order])


def clean_forecasts(fc: DataFrame, order: str, p: Params = Params()) -> DataFrame:
    return last_polls(valid_forecasts(fc, p), order)


def match_arrivals(
    fc: DataFrame, arrivals: DataFrame, p: Params = Params(), raw: DataFrame | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """First arrival at or after the poll (less the tolerance); unmatched forecasts stay. `raw`: the forecasts before
    cleaning, enough to see that no group is hot. `seen`: at least as many rows of each line, stop and vehicle as arrivals has."""
    seen = arrivals if seen is None else seen
    a = arrivals.where(F.col("confianca") >= p.min_confidence_match)
    a = add_headway(a, ("cl", "cp"), out="headway_obs_s", bound=seen.select("cl", "cp"))
    a = a.withColumn("celula", cell_id("lat", "lon"))  # before the join: one per arrival
    us = p.past_tolerance_s * 1_000_000
    q = fc.withColumn("_key", F.timestamp_micros(F.unix_micros("ts_coleta") - us))
    by = ["cl", "cp", "prefixo"]
    bound = None if raw is None else raw.select(*by).unionByName(seen.select(*by))
    cols = ("viagem_id", "ordem", "confianca", "headway_obs_s", "lat", "lon", "celula")
    return asof_join(
        q, a, by, "_key", "t_chegada", {c: c for c in cols}, "viagem_id",
        p.horizon_max_s, "forward", exact=True, event_time_out="t_chegada", bound=bound,
    ).drop("_key")


def with_error(pairs: DataFrame, p: Params = Params()) -> DataFrame:
    return (
        pairs.where(F.col("t_chegada").isNotNull())
        .withColumn("erro_s", seconds_between("t_chegada", "t_previsto"))
        .where(F.abs("erro_s") <= p.error_max_s)
    )


def fill_stop_names(df: DataFrame, stops: DataFrame, name: str = "parada_nome") -> DataFrame:
    s = stops.select("cp", F.col("nome").alias("_nome"))
    blank = F.trim(F.coalesce(F.col(name), F.lit(""))) == ""
    return (
        df.join(s, "cp", "left")
        .withColumn(name, F.when(blank, F.col("_nome")).otherwise(F.col(name)))
        .drop("_nome")
    )


def to_int(c: str):
    """NULL as 0, half to even."""
    return F.bround(F.coalesce(F.col(c).cast("double"), F.lit(0.0))).cast("int")


def finish_pairs(df: DataFrame) -> DataFrame:
    df = df.withColumns(
        {"dia_semana": cal.local_weekday("t_chegada"), "hora": cal.local_hour("t_chegada")}
    ).withColumns({"faixa": cal.day_part("hora"), "erro_abs_s": F.abs("erro_s")})
    return df.withColumns({c: to_int(c) for c in ("horizonte_s", "erro_s", "erro_abs_s", "headway_obs_s")})


def build_pairs(
    fc, arrivals, stops, order: str = "qid", p: Params = Params(), raw: DataFrame | None = None, seen: DataFrame | None = None
) -> DataFrame:
    """`raw` and `seen`: rows to count instead of forecasts and arrivals, see `match_arrivals`.

    A poll is matched by itself, so polls repeated are dropped after the match: the rows lie by line, stop and vehicle then,
    and are not shuffled again.
    """
    m = match_arrivals(valid_forecasts(fc, p), arrivals, p, raw=fc if raw is None else raw, seen=seen)
    return finish_pairs(fill_stop_names(with_error(last_polls(m, order), p), stops))


def share(cond, out: str, digits: int = 4, weight: str | None = None):
    """Share of the rows that meet `cond`. `weight`: how many rows a row stands for."""
    hit = F.avg(F.when(cond, 1).otherwise(0)) if weight is None else F.sum(F.when(cond, F.col(weight)).otherwise(0)) / F.sum(weight)
    return F.round(hit, digits).alias(out)


def pair_summary(matched: DataFrame, p: Params = Params()) -> DataFrame:
    """Match rate and error measures of the output of match_arrivals, in one pass.

    Rows are counted by error first: errors are whole seconds within a bound, so everything else reads a small table.
    """
    error = seconds_between("t_chegada", "t_previsto")
    found = F.col("t_chegada").isNotNull()
    valid = F.when(found & (F.abs(error) <= p.error_max_s), F.bround(error).cast("long"))
    n = matched.select(found.alias("_m"), valid.alias("_e")).groupBy("_m", "_e").agg(F.count("*").alias("_n"))
    total = lambda c, where: F.sum(F.when(where, c * F.col("_n")))
    has, e = F.col("_e").isNotNull(), F.col("_e")
    rows = F.coalesce(F.sum("_n"), F.lit(0)).cast("long")
    kept = F.coalesce(total(F.lit(1), has), F.lit(0)).cast("long")
    hits = F.coalesce(total(F.lit(1), F.col("_m")), F.lit(0)).cast("long")
    per = lambda c, digits: F.round(c / F.nullif(kept, F.lit(0)), digits)
    return n.agg(
        rows.alias("previsoes_avaliadas"), hits.alias("casadas"), F.round(hits / F.nullif(rows, F.lit(0)), 3).alias("taxa_casamento"), kept.alias("validas"),
        per(total(e, has), 1).alias("erro_medio_s"), per(total(F.abs(e), has), 1).alias("mae_s"), F.round(F.sqrt(total(e * e, has) / F.nullif(kept, F.lit(0))), 1).alias("rmse_s"),
        per(F.coalesce(total(F.lit(1), e >= p.late_error_s), F.lit(0)), 4).alias("prob_atraso_acima_5min"), per(F.coalesce(total(F.lit(1), e <= p.early_error_s), F.lit(0)), 4).alias("prob_adiantado_1min"),
        F.expr("percentile(_e, 0.5, _n)").alias("erro_mediano_s"))


def error_table(
    pairs: DataFrame, keys: list[str], probs: dict[str, float], extra: list, min_n: int = 1, weight: str | None = None
) -> DataFrame:
    """Counts, given aggregates and quantiles of the error by key. `weight`: how many pairs a row stands for."""
    n = F.count("*") if weight is None else F.sum(weight)
    out = summarize(pairs, keys, [n.alias("n"), *extra], {"erro_s": probs}, weight=weight)
    return out.where(F.col("n") >= min_n)


def error_counts(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """How many pairs (`_n`) each key has of each error: errors are whole seconds within a bound, so this is a small table."""
    return pairs.groupBy(*keys, "erro_s", "erro_abs_s").agg(F.count("*").alias("_n"))


def line_ranking(pairs: DataFrame, min_n: int = 50, p: Params = Params()) -> DataFrame:
    return error_table(
        pairs, ["letreiro", "sentido"], {"erro_mediano_s": 0.5, "p90_erro_s": 0.9},
        [
            F.avg("erro_s").alias("erro_medio_s"), F.avg("erro_abs_s").alias("mae_s"),
            F.avg(F.when(F.col("erro_s") >= p.late_error_s, 1).otherwise(0)).alias("prob_atraso"),
        ],
        min_n,
    ).orderBy(F.desc("prob_atraso"), "letreiro", "sentido")


def preaggregate(pairs: DataFrame, p: Params = Params()) -> DataFrame:
    """By stop, line, hour, weekday and horizon band; small enough for a dashboard."""
    band = F.floor(F.col("horizonte_s") / 300) * 5
    return pairs.groupBy("cp", "letreiro", "hora", "dia_semana", band.alias("faixa_min")).agg(
        F.count("*").alias("n"),
        F.avg("erro_s").alias("erro_medio_s"),
        F.avg("erro_abs_s").alias("mae_s"),
        F.avg(F.when(F.col("erro_s") >= p.late_error_s, 1.0).otherwise(0.0)).alias("prob_tarde"),
    )


def reaggregate(pre: DataFrame, keys: list[str], means: tuple[str, ...]) -> DataFrame:
    """Weighted recombination of pre-aggregated means."""
    return pre.groupBy(*keys).agg(
        F.sum("n").alias("n"),
        *[(F.sum(F.col(m) * F.col("n")) / F.sum("n")).alias(m) for m in means],
    )


def horizon_band(c: str, edges: list[int], names: list[str]):
    """Left-closed bands; the last name takes the rest."""
    out = F.lit(names[-1])
    for e, n in reversed(list(zip(edges, names))):
        out = F.when(F.col(c) < e, n).otherwise(out)
    return out
