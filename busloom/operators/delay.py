"""Segment travel time, reference, delay and headway, built from arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.config import Params
from busloom.functions import calendar as cal
from busloom.functions.geo import cell_id
from busloom.operators.asof import seconds_between
from busloom.operators.ordered import lagged
from busloom.operators.quantiles import group_quantiles, summarize, with_group_median
from busloom.session import cut_lineage


def consecutive_segments(arrivals: DataFrame, p: Params = Params(), bound: DataFrame | None = None) -> DataFrame:
    """Stop-to-stop passages of a trip; the confidence filter comes before the lag."""
    prev = {
        "t_origem": "t_chegada", "ordem_origem": "ordem", "cp_origem": "cp",
        "_lat0": "lat", "_lon0": "lon",
    }
    a = arrivals.where(F.col("confianca") >= p.min_confidence_delay)
    t = lagged(a, ["viagem_id"], ["ordem", "t_chegada"], prev, bound=bound)
    t = (
        t.where(F.col("ordem") - F.col("ordem_origem") == 1)
        .withColumnRenamed("cp", "cp_destino")
        .withColumnRenamed("ordem", "ordem_destino")
        .withColumn("tempo_percurso_s", seconds_between("t_chegada", "t_origem"))
    )
    return t.where(
        (F.col("tempo_percurso_s") > p.min_segment_s) & (F.col("tempo_percurso_s") < p.max_segment_s)
    ).withColumn("trecho", F.concat_ws(":", "cl", "ordem_origem"))


def attach_length(seg: DataFrame, line_stops: DataFrame) -> DataFrame:
    """Length from the arc positions of both stops, and the speed over it."""
    s = line_stops.select("cl", "cp", "s_m")
    dest = s.select("cl", F.col("cp").alias("cp_destino"), F.col("s_m").alias("_s1"))
    orig = s.select("cl", F.col("cp").alias("cp_origem"), F.col("s_m").alias("_s0"))
    return (
        seg.join(dest, ["cl", "cp_destino"], "left")
        .join(orig, ["cl", "cp_origem"], "left")
        .withColumn("extensao_m", F.col("_s1") - F.col("_s0"))
        .withColumn(
            "velocidade_kmh", F.col("extensao_m") / F.nullif("tempo_percurso_s", F.lit(0.0)) * 3.6
        )
        .drop("_s0", "_s1")
    )


def calendar_cuts(seg: DataFrame, ts: str = "t_origem") -> DataFrame:
    return (
        seg.withColumns({"hora": cal.local_hour(ts), "dia_semana": cal.local_weekday(ts)})
        .withColumn("faixa", cal.day_part("hora"))
        .withColumns(
            {
                "pico": cal.is_peak("faixa").cast("int"),
                "fim_de_semana": F.col("dia_semana").isin(5, 6).cast("int"),
            }
        )
    )


def add_reference(
    seg: DataFrame, keys: tuple[str, ...] = ("cl", "ordem_origem", "faixa"), p: Params = Params(), bound: DataFrame | None = None,
    store: bool = False,
) -> DataFrame:
    ref = with_group_median(seg, list(keys), "tempo_percurso_s", "percurso_tipico_s", "n_referencia", bound=bound, store=store)
    return ref.where(F.col("n_referencia") >= p.min_reference)


def add_delay(seg: DataFrame, p: Params = Params()) -> DataFrame:
    return (
        seg.withColumn("atraso_s", F.col("tempo_percurso_s") - F.col("percurso_tipico_s"))
        .withColumn("atraso_rel", F.col("atraso_s") / F.nullif("percurso_tipico_s", F.lit(0.0)))
        .withColumn(
            "atrasado", F.coalesce(F.col("atraso_rel") >= p.late_ratio, F.lit(False)).cast("int")
        )
    )


def add_headway(
    df: DataFrame, keys=("cl", "cp_destino"), ts: str = "t_chegada", out: str = "headway_s",
    tie: str = "viagem_id", bound: DataFrame | None = None,
) -> DataFrame:
    """Seconds since the previous vehicle of the line at the stop."""
    return (
        lagged(df, list(keys), [ts, tie], {"_tp": ts}, bound=bound)
        .withColumn(out, seconds_between(ts, "_tp"))
        .drop("_tp")
    )


def terminals(lines: DataFrame) -> DataFrame:
    """Origin and destination terminal of a line; swapped in the second direction."""
    first, second = F.col("terminal_principal"), F.col("terminal_secundario")
    back = F.col("sentido") == 2
    return lines.select(
        "cl",
        F.when(back, second).otherwise(first).alias("regiao_origem"),
        F.when(back, first).otherwise(second).alias("regiao_destino"),
    )


def midpoint_cell(seg: DataFrame, res: int = 9) -> DataFrame:
    return (
        seg.withColumn("lat", (F.col("_lat0") + F.col("lat")) / 2)
        .withColumn("lon", (F.col("_lon0") + F.col("lon")) / 2)
        .drop("_lat0", "_lon0")
        .withColumn("celula", cell_id("lat", "lon", res))
    )


def by_order(arrivals: DataFrame) -> DataFrame:
    """At least as many rows of a line and order as it has segments: each ends in an arrival of its own."""
    return arrivals.select("cl", (F.col("ordem") - 1).alias("ordem_origem"))


# columns that the reference, the midpoint and the headway read
_AFTER = ["cl", "ordem_origem", "faixa", "tempo_percurso_s", "lat", "lon", "_lat0", "_lon0"]
_HEADWAY = ["cl", "cp_destino", "t_chegada", "viagem_id"]


def build_segments(
    arrivals, line_stops, lines, p: Params = Params(), seen: DataFrame | None = None, columns: list[str] | None = None
) -> DataFrame:
    """The whole delay table. `seen`: at least as many rows of each trip, line, stop and order as arrivals has, cheaper to count.

    `columns`: these alone, for who reads them more than once. The reference and its join read the segments as well, so they are stored
    before it with what the columns need, and the medians as a table of known size: trips are put in order once, and segments meet their
    median without a shuffle while the medians are few.
    """
    seen = arrivals if seen is None else seen
    store = columns is not None
    seg = consecutive_segments(arrivals, p, seen.select("viagem_id"))
    seg = calendar_cuts(attach_length(seg, line_stops))
    if store:
        need = [*columns, *_AFTER, *(_HEADWAY if "headway_s" in columns else [])]
        seg = cut_lineage(seg.select(*[c for c in seg.columns if c in need]))
    seg = add_delay(add_reference(seg, p=p, bound=by_order(seen), store=store), p)
    if not store or "headway_s" in columns:
        seg = add_headway(seg, bound=seen.select("cl", F.col("cp").alias("cp_destino")))
    seg = midpoint_cell(seg.join(terminals(lines), "cl", "left"))
    return seg.select(*columns) if store else seg


def delay_summary(seg: DataFrame) -> DataFrame:
    # every column's values with their counts in one pass; trips and lines are only counted
    measures, names = ["atrasado", "atraso_s", "percurso_tipico_s", "velocidade_kmh"], ["viagem_id", "cl"]
    part = lambda c, v, w: F.struct(F.lit(c).alias("c"), v.cast("double").alias("v"), w.cast("string").alias("w"))
    parts = [part(c, F.col(c), F.lit(None)) for c in measures] + [part(c, F.lit(None), F.col(c)) for c in names]
    d = seg.select(F.explode(F.array(*parts)).alias("_p")).select("_p.*").groupBy("c", "v", "w").agg(F.count("*").alias("n"))
    d = cut_lineage(d.groupBy("c", "v").agg(F.sum("n").alias("n"), F.count("w").alias("k")))
    of = lambda c, x: F.sum(F.when(F.col("c") == c, x))
    late = F.col("v").isNotNull()
    rows = d.agg(
        F.coalesce(of("atrasado", F.col("n")), F.lit(0)).alias("trechos"),
        F.coalesce(of("viagem_id", F.col("k")), F.lit(0)).alias("viagens"),
        F.coalesce(of("cl", F.col("k")), F.lit(0)).alias("linhas"),
        F.round(of("atrasado", F.col("v") * F.col("n")) / of("atrasado", F.when(late, F.col("n"))), 4).alias("taxa_atraso"),
    )
    q = group_quantiles(d.where(F.col("c").isin(measures[1:])), ["c"], "v", {"m": 0.5, "p": 0.9}, weight="n")
    at = lambda c, x, out: F.max(F.when(F.col("c") == c, F.col(x))).alias(out)
    rows = rows.crossJoin(F.broadcast(q.agg(  # one row each
        at("atraso_s", "m", "_m"), at("atraso_s", "p", "_p"), at("percurso_tipico_s", "m", "_r"), at("velocidade_kmh", "m", "_v"))))
    return rows.select(
        "trechos", "viagens", "linhas", "taxa_atraso",
        F.round("_m", 1).alias("atraso_mediano_s"),
        F.round("_p", 1).alias("atraso_p90_s"),
        F.round("_r", 1).alias("percurso_tipico_mediano_s"),
        F.round("_v", 1).alias("velocidade_mediana_kmh"),
    )


def od_flows(seg: DataFrame, min_n: int = 30) -> DataFrame:
    """Delay per origin-destination flow; flows without a known terminal are kept."""
    keys = ["regiao_origem", "regiao_destino"]
    return group_profile(seg, keys, lines=True).where(F.col("n") >= min_n)


def group_profile(seg: DataFrame, keys: list[str], lines: bool = False) -> DataFrame:
    """Count, late rate, mean, median and p90 delay, median speed by any keys."""
    aggs = [
        F.count("*").alias("n"),
        F.avg("atrasado").alias("taxa"),
        F.avg("atraso_s").alias("atraso_medio_s"),
    ]
    if lines:
        aggs.append(F.countDistinct("cl").alias("linhas"))
    return summarize(
        seg, keys, aggs,
        {"atraso_s": {"atraso_mediano_s": 0.5, "atraso_p90_s": 0.9}, "velocidade_kmh": {"vel_mediana": 0.5}},
    )


def hourly_typical(arrivals: DataFrame, before=None, p: Params = Params()) -> DataFrame:
    """Typical time per line, segment and hour, deviation and ratio; optionally learnt before a cut."""
    seg = consecutive_segments(arrivals, p).withColumn("hora", cal.local_hour("t_origem"))
    where = None if before is None else F.col("t_chegada") < before
    seg = with_group_median(seg, ["cl", "ordem_origem", "hora"], "tempo_percurso_s", "tipico_s", where=where, bound=by_order(arrivals))
    return seg.withColumn("desvio_s", F.col("tempo_percurso_s") - F.col("tipico_s")).withColumn(
        "razao", F.col("tempo_percurso_s") / F.nullif("tipico_s", F.lit(0.0))
    )
