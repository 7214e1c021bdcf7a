"""From GPS samples to arrivals: continuous tracks, reference line, trips, crossings, confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from busloom.config import Params
from busloom.functions import geo
from busloom.operators import polyline as PL
from busloom.operators.asof import seconds_between
from busloom.operators.ingest import drop_exact_duplicates
from busloom.operators.ordered import Ordered
from busloom.operators.quantiles import summarize
from busloom.session import cut_lineage

P = Params()
VEHICLE = ["cl", "prefixo"]


def continuous_blocks(pos: DataFrame, gap_s: float = 1200.0, tie: str = "rid", p: Params = P) -> DataFrame:
    """Cut a vehicle's samples where the clock jumps; keep blocks with enough points."""
    o = Ordered(pos, VEHICLE, ["ta", tie]).lag({"_t": "ta"})
    cut = F.coalesce(seconds_between("ta", "_t") > gap_s, F.lit(False)).cast("int")
    o.rows = o.rows.withColumn("_cut", cut)
    d = o.running_sum({"bloco": "_cut"}).df.drop("_t", "_cut")
    keep = d.groupBy(*VEHICLE, "bloco").agg(F.count("*").alias("pontos")).where(F.col("pontos") >= p.min_track_points)
    return d.join(keep, [*VEHICLE, "bloco"])


def observed_shape(pos: DataFrame, stops: DataFrame, tie: str = "rid", p: Params = P) -> DataFrame:
    """Per line, the simplified track that serves its stops best: columns cl, seq, x, y and scores."""
    blocks = continuous_blocks(pos, tie=tie, p=p).withColumn("faixa_id", F.concat_ws("|", *VEHICLE, "bloco"))
    tracks = blocks.withColumn("seq", F.unix_micros("ta"))
    # one sample per instant, so the order along a track is unambiguous
    tracks = tracks.groupBy("cl", "faixa_id", "seq").agg(F.min("x").alias("x"), F.min_by("y", "x").alias("y"))
    # read by all steps below: simplified once
    slim = cut_lineage(PL.simplify(tracks, "faixa_id", "seq", 10.0, bound=pos.select(*VEHICLE)))
    segs = PL.polyline_segments(slim, "faixa_id", "seq")
    length = segs.groupBy("faixa_id").agg(F.max("s1").alias("comprimento_m"), F.count("*").alias("_k")).where("comprimento_m >= 1500 AND _k >= 4")
    pts = slim.select("cl", "faixa_id").distinct().join(stops.select("cl", "cp", F.col("x").alias("px"), F.col("y").alias("py")), "cl")
    near = PL.nearest_on_line(pts, segs, "faixa_id", "cp", "px", "py")
    score = summarize(near, ["cl", "faixa_id"], [
        F.avg(F.when(F.col("dist") <= p.stop_off_route_m, 1.0).otherwise(0.0)).alias("cobertura")], {"dist": {"dist_mediana_m": 0.5}}, bound=pts.select("cl", "faixa_id"))
    score = score.join(length.drop("_k"), "faixa_id").withColumn("nota", 100 * F.col("cobertura") - F.col("dist_mediana_m") / 50)
    best = score.groupBy("cl").agg(F.max_by(F.struct("faixa_id", "cobertura", "dist_mediana_m", "comprimento_m", "nota"), F.struct("nota", "faixa_id")).alias("_b"))
    return slim.join(best.select("cl", "_b.*"), ["cl", "faixa_id"])


def shape_coverage(stops: DataFrame, segs: DataFrame, p: Params = P) -> DataFrame:
    """How much of a line's stops a reference polyline (keyed by cl) passes."""
    near = PL.nearest_on_line(stops.select("cl", "cp", "x", "y"), segs, "cl", "cp")
    g = summarize(near, ["cl"], [F.avg(F.when(F.col("dist") <= p.stop_off_route_m, 1.0).otherwise(0.0)).alias("cobertura")], {"dist": {"dist_mediana_m": 0.5}})
    return g.join(segs.groupBy("cl").agg(F.max("s1").alias("comprimento_m"), F.count("*").alias("trechos")), "cl", "left")


def choose_shape(feed: DataFrame, observed: DataFrame, coverage: DataFrame, p: Params = P) -> DataFrame:
    """The feed's polyline where it covers enough stops, else the observed one. Both: cl, seq, x, y."""
    good = coverage.where(F.col("cobertura") >= p.feed_coverage).select("cl")
    a = feed.join(good, "cl", "left_semi").select("cl", "seq", "x", "y", F.lit("gtfs").alias("origem"))
    b = observed.join(good, "cl", "left_anti").select("cl", "seq", "x", "y", F.lit("observado").alias("origem"))
    return a.unionByName(b)


def complete_stops(known: DataFrame, observed: DataFrame, feed: DataFrame) -> DataFrame:
    """Stops of a line from the catalogue, then those seen in forecasts, then the feed sequence."""
    cols = ["cl", "cp", "x", "y"]
    out = known.select(*cols, F.lit("catalogo").alias("fonte"))
    for df, name in ((observed, "previsao"), (feed, "gtfs")):
        new = df.select(*cols).dropDuplicates(["cl", "cp"]).join(out, ["cl", "cp"], "left_anti")
        out = out.unionByName(new.withColumn("fonte", F.lit(name)))
    return out


def order_stops(stops: DataFrame, segs: DataFrame, p: Params = P) -> DataFrame:
    """Stops placed on the line, far ones dropped, numbered along it. A line has tens of stops."""
    near = PL.nearest_on_line(stops, segs, "cl", "cp").where(F.col("dist") <= p.stop_off_route_m)
    w = Window.partitionBy("cl").orderBy("s", "cp")
    return near.withColumn("ordem", F.row_number().over(w) - 1).withColumnsRenamed({"s": "s_m", "dist": "dist_tracado_m"}).drop("seg")


def on_route(samples: DataFrame, p: Params = P) -> DataFrame:
    """Samples near the line, of vehicles with at least three of them."""
    d = samples.where(F.col("dist") <= p.off_route_m)
    n = d.groupBy(*VEHICLE).agg(F.count("*").alias("_n")).where("_n >= 3")
    return d.join(n.drop("_n"), VEHICLE, "left_semi")


def segment_trips(samples: DataFrame, tie: str = "rid", p: Params = P, bound: DataFrame | None = None) -> DataFrame:
    """Trip ids: a new trip after a silence or a jump backwards; at least three samples."""
    o = Ordered(samples, VEHICLE, ["ta", tie], bound=bound).lag({"_t": "ta", "_s": "s"})
    gap = F.unix_seconds("ta") - F.unix_seconds("_t") > p.track_gap_s
    back = F.col("s") - F.col("_s") < -p.backward_m
    o.rows = o.rows.withColumn("_cut", F.coalesce(gap | back, F.lit(False)).cast("int"))
    d = o.running_sum({"_trip": "_cut"}).df.drop("_t", "_s", "_cut")
    t = d.groupBy(*VEHICLE, "_trip").agg(F.min("ta").alias("_a"), F.count("*").alias("_n"), F.min("s").alias("_smin"), F.max("s").alias("_smax")).where("_n >= 3")
    d = d.join(t, [*VEHICLE, "_trip"])
    name = F.concat_ws("-", F.col("cl").cast("string"), "prefixo", F.date_format("_a", "yyyyMMdd'T'HHmmss"))
    return d.withColumn("viagem_id", name).drop("_a", "_n")


def _with_neighbours(trips: DataFrame, tie: str, bound: DataFrame | None = None) -> DataFrame:
    o = Ordered(trips, [*VEHICLE, "_trip"], ["ta", tie], bound=bound)
    cols = {"s": "s", "ta": "ta", "lat": "lat", "lon": "lon"}
    o.lead({f"{c}_1": v for c, v in cols.items()}).lag({"s_0": "s", "ta_0": "ta"})
    return o.df


def _line_stops(stops: DataFrame) -> DataFrame:
    """The stops of a line as one array: tens of items, joined once per line."""
    return stops.groupBy("cl").agg(F.collect_list(F.struct("cp", "ordem", "s_m", F.col("lat").alias("plat"), F.col("lon").alias("plon"))).alias("_stops"))


def detect_arrivals(trips: DataFrame, stops: DataFrame, tie: str = "rid", p: Params = P, bound: DataFrame | None = None) -> DataFrame:
    """One event per trip and stop: first crossing of the stop's position, else the nearest sample."""
    d = _with_neighbours(trips, tie, bound).join(_line_stops(stops), "cl")
    trip = [*VEHICLE, "_trip", "viagem_id"]
    reach = lambda k: (F.col("_smin") - p.arrival_radius_m <= k["s_m"]) & (k["s_m"] <= F.col("_smax") + p.arrival_radius_m)
    hit = F.filter("_stops", lambda k: reach(k) & (F.col("s") <= k["s_m"]) & (F.col("s_1") >= k["s_m"]))
    x = d.where("s_1 IS NOT NULL").withColumn("k", F.explode(hit))
    first = x.groupBy(*trip, "k.cp", "k.ordem", "k.s_m", "k.plat", "k.plon").agg(
        F.min_by(F.struct("s", "ta", "lat", "lon", "s_1", "ta_1", "lat_1", "lon_1"), F.struct("ta", tie)).alias("e"))
    ds = F.col("e.s_1") - F.col("e.s")
    f = F.when(ds <= 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("s_m") - F.col("e.s")) / ds)))
    dt = seconds_between("e.ta_1", "e.ta")
    first = first.withColumn("_f", f)
    step = lambda a, b: F.col(a) + F.col("_f") * (F.col(b) - F.col(a))
    crossing = first.select(
        *trip, "cp", "ordem", "plat", "plon", F.lit("cruzamento").alias("metodo"),
        F.timestamp_micros((F.unix_micros("e.ta") + F.col("_f") * dt * 1e6).cast("long")).alias("t_chegada"),
        step("e.lat", "e.lat_1").alias("lat"), step("e.lon", "e.lon_1").alias("lon"), F.abs(ds).alias("salto_m"), dt.alias("salto_s"),
    ).withColumn("dist_min_m", geo.haversine_m("lat", "lon", "plat", "plon"))
    def metres(k):
        return geo.haversine_m(F.col("lat"), F.col("lon"), k["plat"], k["plon"])

    close = F.transform(F.filter("_stops", lambda k: reach(k) & (metres(k) <= p.arrival_radius_m)), lambda k: F.struct(k.alias("k"), metres(k).alias("d")))
    y = d.withColumn("n", F.explode(close)).select("*", F.col("n.k.cp").alias("cp"), F.col("n.k.ordem").alias("ordem"), F.col("n.d").alias("dist_min_m"))
    y = y.join(crossing.select(*trip, "cp", "ordem"), [*trip, "cp", "ordem"], "left_anti")
    s1, s0 = F.coalesce("s_1", "s"), F.coalesce("s_0", "s")
    t1, t0 = F.coalesce("ta_1", "ta"), F.coalesce("ta_0", "ta")
    y = y.withColumns({"salto_m": F.abs(s1 - s0), "salto_s": seconds_between(t1, t0)})
    nearest = y.groupBy(*trip, "cp", "ordem").agg(
        F.min_by(F.struct("ta", "lat", "lon", "salto_m", "salto_s", "dist_min_m"), F.struct("dist_min_m", "ta", tie)).alias("e"))
    approach = nearest.select(*trip, "cp", "ordem", F.lit("aproximacao").alias("metodo"), F.col("e.ta").alias("t_chegada"), "e.lat", "e.lon", "e.salto_m", "e.salto_s", "e.dist_min_m")
    return crossing.drop("plat", "plon").unionByName(approach).drop("_trip")


def grade_arrivals(ev: DataFrame, p: Params = P) -> DataFrame:
    """Reject impossible events and score the rest."""
    vel = F.when(F.col("salto_s") > 0, F.col("salto_m") / F.col("salto_s") * 3.6).otherwise(0.0)
    ok = (vel <= p.max_speed_kmh) & (F.col("dist_min_m") <= 3 * p.arrival_radius_m)
    ok = ok & (F.col("salto_m") <= p.hard_jump_m) & (F.col("salto_s") <= p.hard_jump_s)
    part = lambda c, lim: F.when(F.col(c) <= lim, 1.0).otherwise(lim / F.col(c))
    conf = part("salto_m", p.soft_jump_m) * part("salto_s", p.soft_jump_s) * part("dist_min_m", p.arrival_radius_m)
    conf = conf * F.when(F.col("metodo") == "cruzamento", 1.0).otherwise(0.7)
    return ev.where(ok).withColumns(
        {"velocidade_kmh": F.round(vel, 1), "confianca": F.round(conf, 3), "dist_min_m": F.round("dist_min_m", 1),
         "salto_m": F.round("salto_m", 1), "salto_s": F.round("salto_s", 1)})


def build_arrivals(pos: DataFrame, shape: DataFrame, stops: DataFrame, tie: str = "rid", p: Params = P) -> DataFrame:
    """All lines in one plan. `pos`: cl, prefixo, ta, ts_coleta, lat, lon; `shape`: cl, seq, x, y."""
    xy = {"x": geo.to_x("lon"), "y": geo.to_y("lat")}
    # tables of the map's size, read by each step below
    segs = cut_lineage(PL.polyline_segments(cut_lineage(shape), "cl", "seq"))
    placed = cut_lineage(order_stops(stops.withColumns(xy), segs, p))
    pts = drop_exact_duplicates(pos.where("ta IS NOT NULL"), tie).withColumns(xy).withColumn("dia", F.to_date("ta"))
    # the one stage that leaves the JVM: run once, read by the steps below
    s = cut_lineage(PL.project_track(pts, segs, "cl", ["prefixo", "dia"], "ta"))
    seen = s.select(*VEHICLE)  # a trip has no more samples than its vehicle
    return grade_arrivals(detect_arrivals(segment_trips(on_route(s, p), tie, p, seen), placed, tie, p, seen), p)


def arrivals_summary(arrivals: DataFrame) -> DataFrame:
    return arrivals.groupBy("metodo").agg(
        F.count("*").alias("chegadas"), F.countDistinct("viagem_id").alias("viagens"), F.countDistinct("prefixo").alias("veiculos"),
        F.round(F.avg("confianca"), 3).alias("confianca_media"))
