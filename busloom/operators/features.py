"""Features known at the instant of prediction: as-of state, rolling traffic, trip context, graphs."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busloom.config import HOLIDAYS_MMDD, Params
from busloom.functions import calendar as cal
from busloom.functions import geo
from busloom.operators.asof import asof_join, seconds_between
from busloom.operators.delay import hourly_typical
from busloom.operators.ordered import Ordered, lagged
from busloom.operators.quantiles import group_quantiles, summarize, with_group_median
from busloom.operators.rolling import recent_state, rolling_median
from busloom.operators.spatial import radius_join
from busloom.session import cut_lineage

P = Params()


# -- splits
def _plain(df: DataFrame, c: str) -> Column:
    """An order column as a value that travels unchanged to the driver and back."""
    return F.unix_micros(c) if isinstance(df.schema[c].dataType, T.TimestampType) else F.col(c)


def rows_at(df: DataFrame, order: list[str], ranks: list[int]) -> list[list]:
    """The rows at the given 0-based ranks of the global order (a handful of scalars)."""
    cols = df.select(*[_plain(df, c).alias(c) for c in order])
    ranked = Ordered(cols, [], order).row_number("_rn").df
    got = {r["_rn"] - 1: list(r)[:-1] for r in ranked.where(F.col("_rn").isin([k + 1 for k in ranks])).select(*order, "_rn").collect()}
    return [got[k] for k in ranks]


def before(df: DataFrame, order: list[str], row: list) -> Column:
    return F.struct(*[_plain(df, c).alias(c) for c in order]) < F.struct(*[F.lit(v).alias(c) for c, v in zip(order, row)])


def time_split(df: DataFrame, order: list[str], p: Params = P, out: str = "parte") -> DataFrame:
    """'treino', 'validacao' (the last part of train) or 'teste' by time order and row count."""
    n = df.count()
    train = int(n * p.train_share)
    fit = int(train * (1 - p.validation_share))
    test_row, val_row = rows_at(df, order, [train, fit])
    return df.withColumn(
        out, F.when(before(df, order, val_row), "treino").when(before(df, order, test_row), "validacao").otherwise("teste"))


def cutoff_instant(df: DataFrame, time: str, share: float = 0.7) -> DataFrame:
    """Instant at rank int(n * share): a row of the data, not an interpolated quantile."""
    n = df.count()
    us = rows_at(df, [time], [min(int(n * share), n - 1)])[0][0]
    return df.sparkSession.range(1).select(F.timestamp_micros(F.lit(us)).alias("corte"))


# -- reference and target
def hierarchical_reference(
    df: DataFrame, value: str, levels: list[tuple[list[str], int]], where, out: str
) -> DataFrame:
    """Median from the train rows at the finest level with enough of them, else the next one."""
    cols = []
    for i, (keys, least) in enumerate(levels):
        ref = group_quantiles(df.where(where), keys, value, {f"_m{i}": 0.5}, f"_c{i}")
        df = df.join(ref.where(F.col(f"_c{i}") >= least).drop(f"_c{i}"), keys, "left")
        cols.append(f"_m{i}")
    return df.withColumn(out, F.coalesce(*cols)).drop(*cols)


BY_TYPE = [
    (["cl", "ordem_origem", "tipo", "faixa"], 3), (["cl", "ordem_origem", "faixa"], 1), (["cl", "ordem_origem"], 1),
]


def add_target(df: DataFrame, p: Params = P) -> DataFrame:
    """Deviation from the train reference and late flag; rows without a reference drop out."""
    return (
        df.withColumn("alvo_s", F.col("tempo_percurso_s") - F.col("percurso_tipico_s"))
        .where("alvo_s IS NOT NULL")
        .withColumn("alvo_atrasado", (F.col("alvo_s") >= p.late_ratio * F.col("percurso_tipico_s")).cast("int"))
    )


def model_base(seg: DataFrame, by_type: bool = False, p: Params = P) -> DataFrame:
    """Split, train-only reference and target of the delay models. Keeps the full-period median."""
    # read many times below and by every feature: materialised once in the shared folder
    d = cut_lineage(seg.withColumnRenamed("percurso_tipico_s", "semana_s"))
    d = time_split(d, ["t_origem", "viagem_id", "ordem_origem"], p)
    levels = BY_TYPE if by_type else BY_TYPE[1:]
    d = hierarchical_reference(d, "tempo_percurso_s", levels, F.col("parte") != "teste", "percurso_tipico_s")
    return cut_lineage(add_target(d, p))


def relative_deviation() -> Column:
    r = F.col("alvo_s") / F.when(F.col("percurso_tipico_s") > 0, F.col("percurso_tipico_s"))
    return F.when(r.isNotNull(), F.greatest(F.lit(-3.0), F.least(F.lit(10.0), r)))


# -- forecast modelling table
def calendar_features(df: DataFrame, ts: str = "t_previsto", holidays=HOLIDAYS_MMDD) -> DataFrame:
    """Cyclic calendar from the promised time: the real one would leak the error."""
    loc = cal.local(ts)
    minute = F.hour(loc) * 60 + F.minute(loc)
    day = F.weekday(loc)
    tau = 2 * math.pi
    return df.withColumns(
        {
            "minuto_dia": minute, "hora": F.hour(loc), "dia_semana": day,
            "sin_dia": F.sin(minute * F.lit(tau) / 1440), "cos_dia": F.cos(minute * F.lit(tau) / 1440),
            "sin_semana": F.sin(day * F.lit(tau) / 7), "cos_semana": F.cos(day * F.lit(tau) / 7),
            "fim_de_semana": day.isin(5, 6).cast("int"),
            "feriado": cal.holiday_mmdd(ts, holidays).cast("int"),
        }
    )


def route_fraction(df: DataFrame, links: DataFrame) -> DataFrame:
    end = links.groupBy("cl").agg(F.max("s_m").alias("_end"))
    l = links.join(end, "cl").select(
        "cl", "cp", F.col("ordem").alias("ordem_cat"), "s_m", (F.col("s_m") / F.nullif("_end", F.lit(0.0))).alias("fracao_percurso"))
    return df.join(l, ["cl", "cp"], "left")


def active_vehicles(df: DataFrame, ts: str = "ts_coleta") -> DataFrame:
    d = df.withColumn("_bin", F.window(ts, "5 minutes")["start"])
    n = d.groupBy("cl", "_bin").agg(F.countDistinct("prefixo").alias("veiculos_ativos"))
    return d.join(n, ["cl", "_bin"], "left").drop("_bin")


def arrival_errors(pairs: DataFrame) -> DataFrame:
    """One error per arrival: the median over the polls that aimed at it."""
    keys = ["cl", "cp", "viagem_id", "t_chegada"]
    return group_quantiles(pairs, keys, "erro_s", {"erro_chegada_s": 0.5})


def stop_state(df: DataFrame, errors: DataFrame, polls: DataFrame | None = None) -> DataFrame:
    """Last error at the stop, mean of the last three, last headway, time since; strictly before the poll.

    `polls`: the rows that the errors were taken from, if they are cheaper to count.
    """
    seen = None if polls is None else polls.select("cl", "cp")
    o = Ordered(errors, ["cl", "cp"], ["t_chegada", "viagem_id"], bound=seen)
    o.lag({"_e1": "erro_chegada_s", "_t1": "t_chegada"}).lag({"_e2": "erro_chegada_s"}, 2)
    n = 1 + F.col("_e1").isNotNull().cast("int") + F.col("_e2").isNotNull().cast("int")
    total = F.col("erro_chegada_s") + F.coalesce("_e1", F.lit(0.0)) + F.coalesce("_e2", F.lit(0.0))
    e = o.df.withColumns({"_m3": total / n, "_hw": seconds_between("t_chegada", "_t1")})
    out = asof_join(
        df, e, ["cl", "cp"], "ts_coleta", "t_chegada",
        {"erro_anterior_parada_s": "erro_chegada_s", "erro_media3_parada_s": "_m3", "headway_anterior_s": "_hw"},
        "viagem_id", event_time_out="_et", bound=None if seen is None else seen.unionByName(df.select("cl", "cp")),
    )
    return out.withColumn("desde_ultimo_s", seconds_between("ts_coleta", "_et")).drop("_et")


def line_state(df: DataFrame, errors: DataFrame) -> DataFrame:
    e = errors.withColumn("_tie", F.concat_ws("|", "viagem_id", "cp"))
    return asof_join(df, e, ["cl"], "ts_coleta", "t_chegada", {"erro_anterior_linha_s": "erro_chegada_s"}, "_tie")


def trip_state(df: DataFrame, typical: DataFrame) -> DataFrame:
    """Deviation and ratio of the last segment this trip finished before the poll."""
    t = typical.select("viagem_id", F.col("t_chegada").alias("_tc"), "desvio_s", "razao", "ordem_destino")
    return asof_join(
        df, t, ["viagem_id"], "ts_coleta", "_tc", {"desvio_percurso_s": "desvio_s", "razao_percurso": "razao"}, "ordem_destino")


def modelling_table(pairs, arrivals, links, p: Params = P) -> DataFrame:
    """The forecast-error table: one row per poll, with targets."""
    d = cut_lineage(pairs.where(F.col("confianca") >= p.min_confidence_delay).drop("hora", "dia_semana", "faixa"))
    cut = cutoff_instant(d, "t_chegada", p.train_share).head()
    typical = hourly_typical(arrivals, before=F.lit(cut["corte"]))
    err = arrival_errors(d)
    d = active_vehicles(route_fraction(calendar_features(d), links))
    d = trip_state(line_state(stop_state(d, err, polls=d), err), typical)
    return d.withColumns({"alvo_erro_s": F.col("erro_s"), "alvo_atrasado": (F.col("erro_s") >= p.late_error_s).cast("int")})


# -- regular series
def regular_series(pairs: DataFrame, minutes: int = 15, steps: int = 8) -> DataFrame:
    """Per line and stop, a grid of bins: short gaps filled forward, volume 0, typical headway.

    A group is one stop's grid: its rows are bounded by the number of bins of the period.
    """
    keys = ["cl", "cp"]
    width = f"{minutes} minutes"
    b = pairs.withColumn("bin", F.window("t_chegada", width)["start"])
    agg = summarize(
        b, [*keys, "bin"],
        [F.avg("erro_s").alias("erro_medio"), F.max("erro_s").cast("double").alias("erro_max"), F.countDistinct("prefixo").alias("volume")],
        {"headway_obs_s": {"headway": 0.5}},
    )
    span = agg.groupBy(*keys).agg(
        F.min("bin").alias("_a"), F.max("bin").alias("_b"), F.count("*").alias("_k"), F.percentile("headway", 0.5).alias("_hw"))
    grid = span.where(F.col("_k") >= steps + 1).select(
        *keys, "_hw", F.explode(F.sequence("_a", "_b", F.expr(f"INTERVAL {minutes} MINUTES"))).alias("bin"))
    g = grid.join(agg, [*keys, "bin"], "left")
    w = Window.partitionBy(*keys).orderBy("bin").rowsBetween(-2, 0)
    g = g.withColumn("observado", F.col("erro_medio").isNotNull())
    return g.withColumns(
        {
            "erro_medio": F.last("erro_medio", ignorenulls=True).over(w),
            "erro_max": F.last("erro_max", ignorenulls=True).over(w),
            "volume": F.coalesce("volume", F.lit(0)), "headway": F.coalesce("headway", "_hw"),
            "hora": cal.local_hour("bin") / 23.0, "dia": cal.local_weekday("bin") / 6.0,
        }
    ).where("erro_medio IS NOT NULL").drop("_hw")


def sliding_windows(series: DataFrame, steps: int = 8) -> DataFrame:
    """The `steps` bins before each observed bin, oldest first, and its mean error as target."""
    step = F.struct("erro_medio", "erro_max", "headway", "volume", "hora", "dia")
    w = Window.partitionBy("cl", "cp").orderBy("bin").rowsBetween(-steps, -1)
    d = series.withColumn("passos", F.collect_list(step).over(w))
    return d.where((F.size("passos") == steps) & F.col("observado")).select(
        "cl", "cp", "bin", "passos", F.col("erro_medio").alias("alvo"))


# -- graph of stops
def stop_nodes(pairs: DataFrame, share: float = 0.7) -> DataFrame:
    """Node statistics from the start of the period; target from the rest."""
    d = pairs.withColumn("_us", F.unix_micros("t_chegada").cast("double"))
    cut = group_quantiles(d, [], "_us", {"_cut": share}).head()["_cut"]
    early = F.col("_us") < F.lit(cut)

    def of(c):
        return F.when(early, F.col(c))

    d = d.withColumns({"_e": of("erro_s"), "_h": of("headway_obs_s"), "_f": F.when(~early, F.col("erro_s"))})
    nodes = summarize(
        d, ["cp"],
        [
            F.avg(of("lat")).alias("lat"), F.avg(of("lon")).alias("lon"), F.count("_e").alias("n"), F.avg("_e").alias("erro_medio"),
            F.coalesce(F.stddev_samp("_e"), F.lit(0.0)).alias("erro_desvio"), F.countDistinct(of("cl")).alias("linhas"),
        ],
        {"_e": {"erro_mediano": 0.5}, "_h": {"headway": 0.5}, "_f": {"alvo": 0.5}},
    )
    return nodes.where("n > 0")


def stop_edges(nodes: DataFrame, seg: DataFrame, radius_m: float = 400.0) -> DataFrame:
    """Itinerary edges weighted by median time, and proximity edges in both directions (weight 0)."""
    med = group_quantiles(seg, ["cp_origem", "cp_destino"], "tempo_percurso_s", {"peso": 0.5})
    ids = nodes.select("cp")
    it = (
        med.join(ids.withColumnRenamed("cp", "cp_origem"), "cp_origem", "left_semi")
        .join(ids.withColumnRenamed("cp", "cp_destino"), "cp_destino", "left_semi")
        .select(F.col("cp_origem").alias("a"), F.col("cp_destino").alias("b"), "peso", F.lit("itinerario").alias("tipo"))
    )
    xy = nodes.select("cp", geo.to_x("lon").alias("x"), geo.to_y("lat").alias("y"))
    near = radius_join(xy, xy.withColumnRenamed("cp", "outro"), radius_m, extra=F.col("cp") != F.col("outro"))
    return it.unionByName(near.select(F.col("cp").alias("a"), F.col("outro").alias("b"), F.lit(0.0).alias("peso"), F.lit("vizinhanca").alias("tipo")))


# -- traffic now
def recent_traffic(base: DataFrame, p: Params = P) -> DataFrame:
    return recent_state(
        base, base, ["cl", "ordem_origem"], "t_origem", "t_chegada", "alvo_s", "viagem_id", p.recent_s,
        ("desvio_recente_trecho_s", "n_recente_trecho", "desvio_ultimo_veiculo_s", "desde_ultimo_veiculo_s"))


def previous_segment(base: DataFrame) -> DataFrame:
    """Deviation of the previous segment of the trip, only if it is the adjacent one."""
    d = lagged(base, ["viagem_id"], ["ordem_origem"], {"_v": "alvo_s", "_o": "ordem_origem"})
    ok = F.col("ordem_origem") - F.col("_o") == 1
    return d.withColumn("atraso_trecho_anterior_s", F.when(ok, F.col("_v"))).drop("_v", "_o")


def neighbour_traffic(base: DataFrame, step: int, name: str, p: Params = P) -> DataFrame:
    """The same state on the segment `step` orders away."""
    ev = base.select("cl", F.col("ordem_origem").alias("_k"), "t_chegada", "alvo_s", "viagem_id")
    q = base.withColumn("_k", F.col("ordem_origem") + step)
    out = recent_state(
        q, ev, ["cl", "_k"], "t_origem", "t_chegada", "alvo_s", "viagem_id", p.recent_s,
        (f"{name}_med", f"{name}_n", "_last", f"{name}_idade"))
    return out.drop("_k", "_last")


def physical_traffic(base: DataFrame, p: Params = P) -> DataFrame:
    """The same state on the stop pair, whatever the line."""
    return recent_state(
        base, base, ["cp_origem", "cp_destino"], "t_origem", "t_chegada", "alvo_s", "viagem_id", p.recent_s,
        ("fisico_med", "fisico_n", "_last", "fisico_idade")).drop("_last")


def covered_stop(base: DataFrame, forecasts: DataFrame) -> DataFrame:
    """First stop from the destination on that forecasts cover, and the typical time to reach it.

    Works on tables of line x order (x day part): their size is the network, not the passages.
    """
    stops = base.groupBy("cl", F.col("ordem_destino").alias("ordem")).agg(F.min("cp_destino").alias("cp"))
    seen = forecasts.select("cl", "cp").distinct()
    have = stops.join(seen, ["cl", "cp"], "left_semi").select("cl", F.col("ordem").alias("_a"), F.col("cp").alias("cp_api"))
    d = stops.select("cl", F.col("ordem").alias("ordem_destino")).join(have, "cl").where("_a >= ordem_destino")
    nxt = d.groupBy("cl", "ordem_destino").agg(F.min(F.struct("_a", "cp_api")).alias("_n")).select("cl", "ordem_destino", "_n.*")
    by_seg = group_quantiles(base, ["cl", "ordem_origem"], "percurso_tipico_s", {"_s": 0.5})
    by_part = group_quantiles(base, ["cl", "faixa", "ordem_origem"], "percurso_tipico_s", {"_p": 0.5})
    line = by_seg.groupBy("cl").agg(F.percentile("_s", 0.5).alias("_l"))
    top = base.groupBy("cl").agg(F.greatest(F.max("ordem_origem"), F.max("ordem_destino")).alias("_n"))
    grid = top.select("cl", F.explode(F.sequence(F.lit(0).cast("long"), "_n")).alias("ordem_origem"))
    grid = grid.join(base.select("cl", "faixa").distinct(), "cl").join(by_seg, ["cl", "ordem_origem"], "left")
    grid = grid.join(by_part, ["cl", "faixa", "ordem_origem"], "left").join(line, "cl")
    w = Window.partitionBy("cl", "faixa").orderBy("ordem_origem").rowsBetween(Window.unboundedPreceding, -1)
    cum = grid.withColumn("_c", F.coalesce(F.sum(F.coalesce("_p", "_s", "_l")).over(w), F.lit(0.0)))
    c0 = cum.select("cl", "faixa", "ordem_origem", F.col("_c").alias("_c0"))
    c1 = cum.select("cl", "faixa", F.col("ordem_origem").alias("_a"), F.col("_c").alias("_c1"))
    out = base.join(nxt, ["cl", "ordem_destino"], "left").join(c0, ["cl", "faixa", "ordem_origem"], "left").join(c1, ["cl", "faixa", "_a"], "left")
    stretch = F.when(F.col("_a") == F.col("ordem_destino"), F.col("percurso_tipico_s")).otherwise(F.col("_c1") - F.col("_c0"))
    return out.withColumns({"api_trechos": F.col("_a") - F.col("ordem_origem"), "tipico_estirao_s": stretch}).drop("_a", "_c0", "_c1")


def forecast_deviation(base: DataFrame, forecasts: DataFrame, max_age_s: float = 300.0) -> DataFrame:
    """Latest forecast for the covered stop, as the share of its deviation due to this segment."""
    named = forecasts.where(F.col("cp").isNotNull())  # a forecast without a stop is for no covered stop
    ev = named.select("prefixo", F.col("cp").alias("cp_api"), "ts_coleta", "t_previsto", "qid")
    d = asof_join(
        covered_stop(base, forecasts), ev, ["prefixo", "cp_api"], "t_origem", "ts_coleta", {"_tp": "t_previsto"}, "qid", max_age_s,
        event_time_out="_tc")
    left = seconds_between("_tp", "t_origem")
    return d.withColumns(
        {
            "api_desvio_s": (left - F.col("tipico_estirao_s")) * F.col("percurso_tipico_s") / F.nullif("tipico_estirao_s", F.lit(0.0)),
            "api_idade_s": seconds_between("t_origem", "_tc"),
        }
    ).drop("_tp", "_tc")


def direct_forecast(base: DataFrame, forecasts: DataFrame, max_age_s: float = 300.0) -> DataFrame:
    """Deviation promised for the destination stop itself."""
    ev = forecasts.select("prefixo", F.col("cp").alias("cp_destino"), "ts_coleta", "t_previsto", "qid")
    d = asof_join(
        base, ev, ["prefixo", "cp_destino"], "t_origem", "ts_coleta", {"_tp": "t_previsto"}, "qid", max_age_s, event_time_out="_tc")
    return d.withColumns(
        {
            "api_desvio_s": seconds_between("_tp", "t_origem") - F.col("percurso_tipico_s"),
            "api_idade_s": seconds_between("t_origem", "_tc"),
        }
    ).drop("_tp", "_tc")


# -- trip context
def trip_context(base: DataFrame) -> DataFrame:
    """Delay gathered earlier in the trip, and how far along the route the segment is."""
    d = Ordered(base, ["viagem_id"], ["ordem_origem"]).running_sum({"_acc": "alvo_s"}, current=False).df
    top = base.groupBy("cl").agg(F.max("ordem_destino").alias("_top"))
    return d.join(top, "cl").withColumns(
        {"atraso_acumulado_s": F.coalesce("_acc", F.lit(0.0)), "fracao_rota": F.col("ordem_origem") / F.col("_top")}
    ).drop("_acc", "_top")


def trend(base: DataFrame, p: Params = P) -> DataFrame:
    """Rolling median half an hour earlier, and how much the recent one moved since."""
    d = recent_state(
        recent_traffic(base, p), base, ["cl", "ordem_origem"], "t_origem", "t_chegada", "alvo_s", "viagem_id", p.recent_s,
        ("desvio_30_60min_s", "_n", "_l", "_g"), shift_s=p.recent_s)
    return d.drop("_n", "_l", "_g").withColumn("tendencia_s", F.col("desvio_recente_trecho_s") - F.col("desvio_30_60min_s"))


def holiday_flag(df: DataFrame, holidays, ts: str = "t_origem") -> DataFrame:
    return df.withColumn("feriado", cal.local_date(ts).cast("string").isin(list(holidays)).cast("int"))


# -- sequences
def trip_sequence(base: DataFrame, steps: int = 4) -> DataFrame:
    """The previous `steps` segments of the trip, oldest first, absent ones as zeros."""
    o = Ordered(base.withColumn("_rel", relative_deviation()), ["viagem_id"], ["ordem_origem"])
    for k in range(1, steps + 1):
        o.lag({f"_p{k}": F.struct("alvo_s", "_rel", "percurso_tipico_s", "ordem_origem")}, k)
    parts = []
    for k in range(steps, 0, -1):
        c = F.col(f"_p{k}")
        parts.append(F.struct(
            F.coalesce(c["alvo_s"] / 60, F.lit(0.0)).alias("desvio"), F.coalesce(c["_rel"], F.lit(0.0)).alias("rel"),
            F.coalesce(c["percurso_tipico_s"] / 100, F.lit(0.0)).alias("tipico"),
            F.coalesce((F.col("ordem_origem") - c["ordem_origem"]) / steps, F.lit(0.0)).alias("distancia"),
            c.isNotNull().cast("int").alias("presente"),
        ))
    return o.df.withColumn("seq_viagem", F.array(*parts)).drop("_rel", *[f"_p{k}" for k in range(1, steps + 1)])


def segment_sequence(base: DataFrame, steps: int = 4, max_age_s: float = 3600.0) -> DataFrame:
    """The last `steps` vehicles that finished the segment before this departure, oldest first."""
    keys = ["cl", "ordem_origem"]
    ev = base.withColumn("_rel", relative_deviation()).select(*keys, "t_chegada", "viagem_id", "alvo_s", "_rel")
    o = Ordered(ev, keys, ["t_chegada", "viagem_id"])
    one = F.struct("t_chegada", "alvo_s", "_rel")
    for k in range(1, steps):
        o.lag({f"_p{k}": one}, k)
    last = F.array(*[F.col(f"_p{k}") for k in range(steps - 1, 0, -1)], one)
    ev = o.df.withColumn("_seq", last)
    d = asof_join(base, ev, keys, "t_origem", "t_chegada", {"_seq": "_seq"}, "viagem_id", max_age_s)

    def item(e):
        age = (F.unix_micros("t_origem") - F.unix_micros(e["t_chegada"])) / 1e6
        ok = e.isNotNull() & (age <= max_age_s)
        zero = F.lit(0.0)
        return F.struct(
            F.when(ok, e["alvo_s"] / 60).otherwise(zero).alias("desvio"),
            F.when(ok, F.coalesce(e["_rel"], zero)).otherwise(zero).alias("rel"),
            F.when(ok, age / 3600).otherwise(zero).alias("idade_h"),
            F.when(ok, 1).otherwise(0).alias("presente"),
        )

    blank = F.array_repeat(F.lit(None).cast(ev.schema["_seq"].dataType.elementType), steps)
    return d.withColumn("seq_trecho", F.transform(F.coalesce("_seq", blank), item)).drop("_seq")


# -- graph of segments
def segment_graph(base: DataFrame, radius_m: float = 300.0) -> tuple[DataFrame, DataFrame]:
    """Nodes (stop pairs with mean position) and mean-normalised edges of three relations."""
    node = F.concat_ws(">", "cp_origem", "cp_destino")
    d = base.withColumn("no", node)
    nodes = d.groupBy("no").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count("*").alias("n"))
    s = Ordered(d.select("viagem_id", "ordem_origem", "no", "cp_origem", "cp_destino"), ["viagem_id"], ["ordem_origem"])
    s = s.lead({"_b": "no", "_o": "cp_origem"}).df
    seq = s.where("cp_destino = _o AND no <> _b").select(F.col("no").alias("a"), F.col("_b").alias("b")).distinct()
    xy = nodes.select("no", geo.to_x("lon").alias("x"), geo.to_y("lat").alias("y"))
    near = radius_join(xy, xy.withColumnRenamed("no", "outro"), radius_m, extra=F.col("no") != F.col("outro"))
    near = near.select(F.col("no").alias("a"), F.col("outro").alias("b"))
    both = seq.unionByName(seq.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = near.join(both, ["a", "b"], "left_anti")
    edges = (
        seq.select(F.col("b").alias("de"), F.col("a").alias("para"), F.lit("acima").alias("relacao"))
        .unionByName(seq.select(F.col("a").alias("de"), F.col("b").alias("para"), F.lit("abaixo").alias("relacao")))
        .unionByName(near.select(F.col("a").alias("de"), F.col("b").alias("para"), F.lit("vizinho").alias("relacao")))
    )
    deg = edges.groupBy("de", "relacao").agg(F.count("*").alias("_g"))
    return nodes, edges.join(deg, ["de", "relacao"]).withColumn("peso", 1.0 / F.col("_g")).drop("_g")


def network_state(base: DataFrame, asked: DataFrame) -> DataFrame:
    """State of stop pairs at the instants asked for (no, inicio), from passages finished before them.

    A pair's state changes with a passage or as one grows old, so it is kept per passage and read by the last one before the
    instant; its age says which parts still hold.
    """
    d = base.withColumns({"no": F.concat_ws(">", "cp_origem", "cp_destino"), "_rel": relative_deviation()})
    ev = d.where("alvo_s IS NOT NULL").select("no", "t_chegada", "viagem_id", "alvo_s", "_rel")
    seen = ev  # each of the steps keeps its rows: they are counted before any median is
    ev = rolling_median(ev, ["no"], "t_chegada", "_rel", 900, "rel15", "_n15", seen)
    ev = rolling_median(ev, ["no"], "t_chegada", "_rel", 3600, "rel60", "_n60", seen)
    ev = rolling_median(ev, ["no"], "t_chegada", "alvo_s", 900, "desvio15", "n15", seen)
    m = asof_join(
        asked.select("no", "inicio"), ev, ["no"], "inicio", "t_chegada", {c: c for c in ("rel15", "rel60", "desvio15", "n15")}, "viagem_id", 3600,
        event_time_out="_et", bound=asked.select("no").unionByName(seen.select("no")))
    age = seconds_between("inicio", "_et") / 60
    in15, in60 = F.coalesce(age <= 15, F.lit(False)), F.coalesce(age <= 60, F.lit(False))
    zero = F.lit(0.0)
    return m.select(
        "no", "inicio",
        F.coalesce(F.when(in15, F.col("rel15")), zero).alias("rel15"),
        F.coalesce(F.when(in60, F.col("rel60")), zero).alias("rel60"),
        F.coalesce(F.when(in15, F.col("desvio15") / 60), zero).alias("desvio15_min"),
        F.coalesce(F.when(in15, F.log1p("n15")), zero).alias("log_n15"),
        F.when(in60, F.log1p(age) / math.log1p(60)).otherwise(1.0).alias("idade"),
        in60.cast("int").alias("presente"),
    )


def every_bin(base: DataFrame, bin_min: int = 5) -> DataFrame:
    """(no, inicio): every pair at the start of every bin of the period.

    Its size is set by the map and the period: bins times network nodes.
    """
    step = bin_min * 60
    span = base.agg(F.min("t_origem").alias("_a"), F.max("t_origem").alias("_b"))
    first, last = (F.floor(F.unix_seconds(c) / step) * step for c in ("_a", "_b"))
    starts = span.select(F.explode(F.sequence(first, last, F.lit(step).cast("long"))).alias("_s"))
    nodes = base.select(F.concat_ws(">", "cp_origem", "cp_destino").alias("no")).distinct()
    return nodes.crossJoin(F.broadcast(starts)).select("no", F.timestamp_seconds("_s").alias("inicio"))


def standardise(df: DataFrame, cols: list[str], train: Column) -> DataFrame:
    """(x - mean) / population sd of the train rows, NULL as 0, with a NULL indicator."""
    aggs = []
    for c in cols:
        v = F.when(train, F.col(c))
        aggs += [F.avg(v).alias("_mu_" + c), (F.stddev_pop(v) + 1e-6).alias("_sd_" + c)]
    st = df.agg(*aggs)
    d = df.crossJoin(F.broadcast(st))  # one row
    out = {f"{c}_nulo": F.col(c).isNull().cast("int") for c in cols}
    out |= {f"{c}_z": F.coalesce((F.col(c) - F.col("_mu_" + c)) / F.col("_sd_" + c), F.lit(0.0)) for c in cols}
    return d.withColumns(out).drop(*st.columns)


# -- experiments
def departure_interval(base: DataFrame) -> DataFrame:
    """Interval to the previous departure at the origin stop, and its ratio to the train median."""
    o = Ordered(base, ["cl", "cp_origem"], ["t_origem", "viagem_id"])
    d = o.lag({"_t": "t_origem", "viagem_anterior": "viagem_id"}).lead({"viagem_seguinte": "viagem_id"}).df
    d = d.withColumn("intervalo_s", seconds_between("t_origem", "_t")).drop("_t")
    d = with_group_median(d, ["cl", "cp_origem", "faixa"], "intervalo_s", "_ref", where=F.col("parte") != "teste")
    return d.withColumn("intervalo_rel", F.col("intervalo_s") / F.nullif("_ref", F.lit(0.0))).drop("_ref")


def neighbours_on_line(base: DataFrame) -> DataFrame:
    """Stops between this vehicle and the ones ahead and behind, by the last stop each has passed."""
    d = departure_interval(base)
    ev = base.select(F.col("viagem_id").alias("_v"), F.col("t_chegada").alias("_tc"), "ordem_destino")
    for side in ("anterior", "seguinte"):
        d = d.withColumn("_v", F.col(f"viagem_{side}"))
        d = asof_join(d, ev, ["_v"], "t_origem", "_tc", {f"_o_{side}": "ordem_destino"}, "ordem_destino").drop("_v")
    return d.withColumns(
        {
            "paradas_ate_anterior": F.col("_o_anterior") - F.col("ordem_origem"),
            "paradas_ate_seguinte": F.col("ordem_origem") - F.col("_o_seguinte"),
        }
    ).drop("_o_anterior", "_o_seguinte")


def segment_spread(base: DataFrame) -> DataFrame:
    """p75, p90 and sd of the deviation on the segment and day part, from train rows."""
    keys = ["cl", "ordem_origem", "faixa"]
    st = summarize(
        base.where("parte <> 'teste'"), keys, [F.stddev_samp("alvo_s").alias("trecho_dp_s")],
        {"alvo_s": {"trecho_p75_s": 0.75, "trecho_p90_s": 0.9}})
    return base.join(st, keys, "left")


def out_of_fold_spread(base: DataFrame, day: Column) -> DataFrame:
    """Per key and train day, the same spread from the other train days.

    All other days are all days less this one, so counts and sums are subtracted. A quantile of the rest is found likewise: between
    two neighbouring values of the day the count taken off is constant, so the value sought has a known rank among all days; of the
    values that fall into their own stretch the smallest is it. Each value of a day is looked up once for each rank: volume follows rows.
    """
    keys = ["cl", "ordem_origem", "faixa"]
    tr = base.where("parte <> 'teste'").withColumn("dia", day)
    known = tr.where("alvo_s IS NOT NULL").withColumn("v", F.col("alvo_s").cast("double"))
    own = cut_lineage(known.groupBy(*keys, "dia", "v").agg(F.count("*").alias("n")))
    whole = own.groupBy(*keys, "v").agg(F.sum("n").alias("n"))
    moments = [F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("s"), F.sum(F.col("v") * F.col("v") * F.col("n")).alias("q")]
    per_day = tr.select(*keys, "dia").distinct().join(own.groupBy(*keys, "dia").agg(*moments), [*keys, "dia"], "left")
    total = own.groupBy(*keys).agg(*moments).withColumnsRenamed({"n": "n_t", "s": "s_t", "q": "q_t"})
    left = per_day.join(total, keys).select(*keys, "dia", *[(F.col(c + "_t") - F.coalesce(c, F.lit(0))).alias(c) for c in ("n", "s", "q")]).where("n > 0")
    left = cut_lineage(left)
    # ranks asked for: those beside each quantile's place among the rest
    place = lambda p: F.lit(p) * (F.col("n") - 1)
    ranks = left.select(*keys, "dia", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), f(place(p)).cast("long").alias("r")) for i, (p, f) in enumerate((p, f) for p in (0.75, 0.9) for f in (F.floor, F.ceil))])).alias("_r")).select(*keys, "dia", "_r.*")
    # stretches between the day's own values, with what the day counts up to them
    o = Ordered(own, [*keys, "dia"], ["v"]).running_sum({"c": "n"}).lead({"until": "v"}).df.select(*keys, "dia", F.col("v").alias("since"), "until", "c")
    before = own.groupBy(*keys, "dia").agg(F.min("v").alias("until")).select(*keys, "dia", F.lit(None).cast("double").alias("since"), "until", F.lit(0).cast("long").alias("c"))
    asked = ranks.join(o.unionByName(before), [*keys, "dia"], "left").withColumn("at", F.col("r") + F.coalesce("c", F.lit(0)) + 0.5)
    steps = Ordered(whole, keys, ["v"]).running_sum({"below": "n"}, current=False).df.select(*keys, "v", F.coalesce("below", F.lit(0)).cast("double").alias("below"))
    met = asof_join(asked, steps, keys, "at", "below", {"x": "v"}, "below")
    met = met.where(F.col("until").isNull() | (F.col("x") < F.col("until")))
    found = met.groupBy(*keys, "dia").pivot("i", [0, 1, 2, 3]).agg(F.min(F.greatest("x", "since")))
    out = left.join(found, [*keys, "dia"])
    mix = lambda p, lo, hi: F.col(lo) + (F.col(hi) - F.col(lo)) * (place(p) - F.floor(place(p)))
    var = (F.col("q") - F.col("s") * F.col("s") / F.col("n")) / F.nullif(F.col("n") - 1, F.lit(0))
    return out.select(
        *keys, "dia", mix(0.75, "0", "1").alias("oof_p75_s"), mix(0.9, "2", "3").alias("oof_p90_s"), F.sqrt(F.when(F.col("n") > 1, F.greatest(var, F.lit(0.0)))).alias("oof_dp_s"))


def rain_features(df: DataFrame, rain: DataFrame, step: float = 0.05) -> DataFrame:
    """Rain of the hour, of three hours, and the city mean. `rain`: lat, lon, hora (timestamp), chuva_mm.

    A grid cell holds one row per hour, so its window is bounded by the period.
    """
    def at(c):
        return F.round(F.col(c) / step).cast("long")

    r = rain.select(at("lat").alias("_la"), at("lon").alias("_lo"), F.unix_seconds("hora").alias("_h"), "chuva_mm")
    w = Window.partitionBy("_la", "_lo").orderBy("_h").rangeBetween(-7200, 0)
    cells = r.withColumn("chuva_3h_mm", F.sum("chuva_mm").over(w)).withColumnRenamed("chuva_mm", "chuva_1h_mm")
    city = r.groupBy("_h").agg(F.avg("chuva_mm").alias("chuva_cidade_1h_mm"))
    box = r.agg(*[f(c).alias(f"_{n}{c}") for c in ("_la", "_lo") for n, f in (("min", F.min), ("max", F.max))])
    d = df.crossJoin(F.broadcast(box))  # one row
    d = d.withColumns(
        {c: F.least(F.greatest(at(src), F.col("_min" + c)), F.col("_max" + c)) for c, src in (("_la", "lat"), ("_lo", "lon"))}
    ).withColumn("_h", F.floor(F.unix_seconds("t_origem") / 3600) * 3600)
    return d.join(cells, ["_la", "_lo", "_h"], "left").join(city, "_h", "left").drop("_la", "_lo", "_h", *box.columns)
