"""Static feed operators: trips, shapes, stops, bridge to line codes, scheduled headways."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.operators.quantiles import summarize


def bus_routes(routes: DataFrame) -> DataFrame:
    return routes.where(F.col("route_type") == 3)


def representative_trips(trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Per route and direction the trip with most stops, the first id on ties."""
    n = stop_times.groupBy("trip_id").agg(F.count("*").alias("n_paradas"))
    t = trips.join(n, "trip_id", "left").withColumn("n_paradas", F.coalesce("n_paradas", F.lit(0)))
    best = F.min_by(F.struct("trip_id", "shape_id", "n_paradas"), F.struct(-F.col("n_paradas"), F.col("trip_id")))
    return t.groupBy("route_id", "direction_id").agg(best.alias("_b")).select("route_id", "direction_id", "_b.*")


def ordered_shape(shapes: DataFrame) -> DataFrame:
    """One row per shape, its points in order (a shape is bounded by its length on the street)."""
    pts = F.array_sort(F.collect_list(F.struct("shape_pt_sequence", F.col("shape_pt_lat").alias("lat"), F.col("shape_pt_lon").alias("lon"))))
    return shapes.groupBy("shape_id").agg(pts.alias("pontos"))


def stop_sequence(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Stops of trips in order, with coordinates."""
    return stop_times.join(stops, "stop_id").select("trip_id", "stop_sequence", "stop_id", "lat", "lon")


def itinerary(trips, stop_times, shapes, stops) -> DataFrame:
    """Representative trip with its shape and stop list, per route and direction."""
    rep = representative_trips(trips, stop_times)
    seq = stop_sequence(stop_times.join(rep.select("trip_id"), "trip_id", "left_semi"), stops)
    lst = seq.groupBy("trip_id").agg(F.array_sort(F.collect_list(F.struct("stop_sequence", "stop_id", "lat", "lon"))).alias("paradas"))
    return rep.join(ordered_shape(shapes), "shape_id", "left").join(lst, "trip_id", "left")


def route_key(lines: DataFrame) -> DataFrame:
    """Stable route id of a line code: the full sign, else sign and type."""
    alt = F.concat_ws("-", "letreiro", "tl")
    return lines.withColumn("route_id", F.coalesce("letreiro_completo", F.when(F.col("tl").isNotNull(), alt)))


def bridge(lines: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    l = route_key(lines).where("route_id IS NOT NULL")
    l = l.withColumn("direction_id", F.coalesce("sentido", F.lit(1)) - 1)
    rep = representative_trips(trips, stop_times)
    return l.join(rep, ["route_id", "direction_id"]).select(
        "cl", "letreiro", "route_id", "sentido", "direction_id", "trip_id", "shape_id")


def bridge_rate(lines: DataFrame, linked: DataFrame) -> DataFrame:
    a = lines.agg(F.count("*").alias("linhas"))
    b = linked.agg(F.count("*").alias("casadas"))
    return a.crossJoin(b).withColumn("taxa", F.round(F.col("casadas") / F.col("linhas"), 4))  # one row each


def stop_coverage(linked: DataFrame, links: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Stops known to the service against stops of the itinerary."""
    api = links.groupBy("cl").agg(F.count("*").alias("paradas_api"))
    feed = stop_times.groupBy("trip_id").agg(F.count("*").alias("paradas_gtfs"))
    j = linked.join(api, "cl").join(feed, "trip_id", "left").withColumn("paradas_gtfs", F.coalesce("paradas_gtfs", F.lit(0)))
    cov = F.round(F.col("paradas_api") / F.nullif("paradas_gtfs", F.lit(0)), 3)
    return j.withColumn("cobertura", cov).select("cl", "route_id", "sentido", "paradas_api", "paradas_gtfs", "cobertura")


def feed_check(routes, trips, stops, shapes) -> DataFrame:
    """Cheap checks that expose a broken feed."""
    r = bus_routes(routes).agg(
        F.count("*").alias("rotas_onibus"),
        F.count_if(~F.col("route_id").rlike(r"^[0-9A-Z]+-[0-9]+$")).alias("rotas_fora_do_padrao"),
    )
    t = trips.agg(F.count("*").alias("viagens"), F.count_if(F.col("shape_id").isNull()).alias("viagens_sem_forma"))
    s = stops.agg(F.count("*").alias("paradas"))
    f = shapes.agg(F.countDistinct("shape_id").alias("formas"))
    return r.crossJoin(t).crossJoin(s).crossJoin(f)  # one row each


def scheduled_headways(freq: DataFrame, lines: DataFrame) -> DataFrame:
    """Smallest headway per line and clock hour; periods past midnight wrap."""
    hours = F.explode(F.sequence(F.floor(F.col("h0")).cast("int"), F.floor(F.col("h1")).cast("int")))
    tab = (
        freq.withColumn("_h", hours)
        .withColumn("hora", F.pmod("_h", F.lit(24)))
        .groupBy("trip_id", "hora")
        .agg(F.min("headway_secs").alias("intervalo_s"))
    )
    trip = F.concat_ws("-", "letreiro_completo", (F.col("sentido") - 1).cast("string"))
    l = lines.where("letreiro_completo IS NOT NULL AND sentido IS NOT NULL").select("cl", trip.alias("trip_id"))
    return l.join(tab, "trip_id").select("cl", "hora", "intervalo_s")


def clock_hours(text: str):
    """HH:MM:SS of the feed (may pass 24) as hours."""
    p = F.split(F.col(text), ":")
    return p[0].cast("double") + p[1].cast("double") / 60 + p[2].cast("double") / 3600


def attach_headway(df: DataFrame, headways: DataFrame, since: str | None = None) -> DataFrame:
    hw = headways.select("cl", F.col("hora").alias("_h"), F.col("intervalo_s").alias("prog_intervalo_s"))
    out = df.withColumn("_h", cal.local_hour("t_origem")).join(hw, ["cl", "_h"], "left").drop("_h")
    if since:
        out = out.withColumn("prog_razao", F.col(since) / F.col("prog_intervalo_s"))
    return out


def real_vs_planned(seg: DataFrame, bridge_: DataFrame, stop_times: DataFrame, keys: list[str], coverage=0.8) -> DataFrame:
    """Real trip time against the planned one, for trips with most of their segments."""
    plan = stop_times.groupBy("trip_id").agg(
        F.count("*").alias("n_paradas"), (F.max("arrival_s") - F.min("arrival_s")).alias("_dur")
    ).where("n_paradas > 1").withColumn("trecho_prog_s", F.col("_dur") / (F.col("n_paradas") - 1))
    plan = bridge_.select("cl", "trip_id").join(plan, "trip_id").drop("trip_id")
    v = seg.groupBy("viagem_id").agg(
        F.min("cl").alias("cl"), F.count("*").alias("trechos"), F.sum("tempo_percurso_s").alias("real_s"),
        *[F.min_by(k, "ordem_origem").alias(k) for k in keys],
    )
    v = v.join(plan, "cl").where(F.col("trechos") / (F.col("n_paradas") - 1) >= coverage)
    v = v.withColumn("prog_s", F.col("trechos") * F.col("trecho_prog_s")).withColumn("razao", F.col("real_s") / F.col("prog_s"))
    aggs = [
        F.count("*").alias("viagens"),
        (100 * F.avg(F.when(F.col("razao") > 1, 1).otherwise(0))).alias("acima_pct"),
        (100 * F.avg(F.when(F.col("razao") >= 1.2, 1).otherwise(0))).alias("acima20_pct"),
    ]
    return summarize(v, keys, aggs, {"razao": {"razao_mediana": 0.5}, "real_s": {"real_mediano_s": 0.5}})
