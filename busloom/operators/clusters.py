"""Samples for clustering, cluster summaries, episodes and the permutation test."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.functions import geo
from busloom.operators.dbscan import st_dbscan
from busloom.operators.metrics import draw
from busloom.operators.ordered import Ordered
from busloom.operators.quantiles import summarize
from busloom.session import cut_lineage


def unified_base(df: DataFrame, value: str, event: Column, time: str, stop: str) -> DataFrame:
    """One shape for delay and forecast error: value, event flag, time, stop, place."""
    rest = [c for c in ("letreiro", "regiao_origem", "regiao_destino", "prefixo", "viagem_id", "faixa", "hora") if c in df.columns]
    return df.where(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(
        F.col(value).cast("double").alias("valor"), event.cast("int").alias("evento"), F.col(time).alias("t"), F.col(stop).alias("cp"), "lat", "lon", *rest)


def with_xy(df: DataFrame) -> DataFrame:
    return df.withColumns({"x": geo.to_x("lon"), "y": geo.to_y("lat")})


def event_samples(base: DataFrame) -> DataFrame:
    return with_xy(base.where("evento = 1")).withColumn("peso", F.greatest(F.col("valor"), F.lit(1.0)))


def stop_samples(base: DataFrame, min_n: int = 20) -> DataFrame:
    g = summarize(base, ["cp"], [
        F.count("*").alias("n"), F.avg("valor").alias("media"), F.avg("evento").alias("taxa"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon")],
        {"valor": {"mediana": 0.5, "p90": 0.9}})
    return with_xy(g.where(F.col("n") >= min_n)).withColumn("peso", F.col("taxa") * F.col("n"))


def weighted_kmeans(samples: DataFrame, k: int, weight: str = "peso", seed: int = 42) -> DataFrame:
    n = samples.limit(k).count()
    d = VectorAssembler(inputCols=["x", "y"], outputCol="_v").transform(samples.where(F.col(weight) > 0))
    model = KMeans(k=max(2, min(k, n)), seed=seed, weightCol=weight, featuresCol="_v", predictionCol="rotulo").fit(d)
    return model.transform(d).drop("_v")


def impacted_stops(samples: DataFrame, base: DataFrame) -> DataFrame:
    overall = base.agg(F.avg("evento").alias("_r"))
    return samples.crossJoin(F.broadcast(overall)).where(F.col("taxa") >= F.col("_r")).drop("_r")  # one row


def top_values(df: DataFrame, keys: list[str], value: str, k: int, out: str) -> DataFrame:
    """The k most common values per key, as an array."""
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("_n"), value)
    top = n.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
    return top.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", value))), lambda s: s[value]).alias(out))


def cluster_summary(d: DataFrame, keys: list[str] = ("rotulo",)) -> DataFrame:
    """Centre, p90 radius, delay, stops, top lines and hours, time window and impact (mean delay by events) per cluster, worst first.

    `d`: clustered events with rotulo, x, y, lat, lon, valor, t, cp, letreiro, hora.
    """
    keys = list(keys)
    d = d.where("rotulo <> -1")
    mid = d.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    r = d.join(mid, keys).withColumn("_d", F.sqrt(F.pow(F.col("x") - F.col("_mx"), F.lit(2)) + F.pow(F.col("y") - F.col("_my"), F.lit(2))))
    s = summarize(r, keys, [
        F.count("*").alias("n"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.avg("valor").alias("atraso_medio_s"),
        F.countDistinct("cp").alias("paradas"), F.min("t").alias("inicio"), F.max("t").alias("fim")],
        {"_d": {"raio_m": 0.9}, "valor": {"atraso_mediano_s": 0.5, "atraso_p90_s": 0.9}})
    s = s.join(top_values(d, keys, "letreiro", 15, "linhas"), keys, "left").join(top_values(d, keys, "hora", 3, "horas"), keys, "left")
    return s.withColumn("impacto", F.col("atraso_medio_s") * F.col("n")).orderBy(F.desc("impacto"), *keys)


def stop_cluster_summary(d: DataFrame, keys: list[str] = ("rotulo",)) -> DataFrame:
    """The same for clusters of stops (`stop_samples` with labels): means weighted by the stops' observations."""
    w = F.col("n")
    mean = lambda c: F.sum(F.col(c) * w) / F.sum(w)
    s = d.where("rotulo <> -1").groupBy(*keys).agg(
        F.count("*").alias("paradas"), F.sum("n").alias("observacoes"), F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), mean("media").alias("atraso_medio_s"), mean("taxa").alias("prob_atraso"))
    return s.withColumn("impacto", F.col("atraso_medio_s") * F.col("observacoes")).orderBy(F.desc("impacto"), *keys)


def top_flows(d: DataFrame, k: int = 5) -> DataFrame:
    flow = d.where("rotulo <> -1").withColumn("fluxo", F.concat_ws(" > ", "regiao_origem", "regiao_destino"))
    return top_values(flow.where("regiao_origem IS NOT NULL AND regiao_destino IS NOT NULL"), ["rotulo"], "fluxo", k, "fluxos")


def label_back(rows: DataFrame, labels: DataFrame, pid: str) -> DataFrame:
    """Labels on the full table: -1 noise, -3 filtered out before clustering."""
    return rows.join(labels.select(pid, "rotulo"), pid, "left").withColumn("rotulo", F.coalesce("rotulo", F.lit(-3).cast("long")))


def episodes_by_day(late: DataFrame, pid: str, eps_m=400.0, eps_s=1800.0, min_pts=10, extra_by: list[str] = ()) -> DataFrame:
    """Space-time clusters of late passages, each local day apart. Columns: day `dia`, labels."""
    d = with_xy(late).withColumns({"dia": cal.local_date("t"), "_ts": F.unix_micros("t") / 1e6})
    return st_dbscan(d, pid, "x", "y", eps_m, min_pts, by=[*extra_by, "dia"], t="_ts", eps_t=eps_s)


def episode_table(d: DataFrame, keys: list[str] = ("dia", "rotulo")) -> DataFrame:
    keys = list(keys)
    s = cluster_summary(d, keys)
    return s.withColumns(
        {"duracao_min": (F.unix_micros("fim") - F.unix_micros("inicio")) / 60e6, "hora_inicio": cal.local_hour("inicio")})


def grid_measures(labelled: DataFrame, params: list[str]) -> DataFrame:
    """Noise share, episodes, sizes, largest, and stops seen on many days, per parameter set."""
    base = labelled.groupBy(*params).agg(
        F.count("*").alias("eventos"), (100 * F.avg(F.when(F.col("rotulo") == -1, 1.0).otherwise(0.0))).alias("ruido_pct"))
    ep = labelled.where("rotulo <> -1").groupBy(*params, "dia", "rotulo").agg(F.count("*").alias("_n"), F.min("t").alias("_a"), F.max("t").alias("_b"))
    ep = ep.withColumn("_dur", (F.unix_micros("_b") - F.unix_micros("_a")) / 60e6)
    size = summarize(ep, params, [F.count("*").alias("episodios"), F.max("_n").alias("maior")], {"_n": {"tamanho_mediano": 0.5}, "_dur": {"duracao_mediana_min": 0.5}})
    rec = labelled.where("rotulo <> -1").groupBy(*params, "cp").agg(F.countDistinct("dia").alias("_d")).groupBy(*params).agg(
        F.count_if(F.col("_d") >= 5).alias("paradas_recorrentes"))
    return base.join(size, params, "left").join(rec, params, "left")


def select_parameters(measures: DataFrame, max_noise: float = 60.0) -> DataFrame:
    """Most recurrent stops among sets with acceptable noise."""
    return measures.where(F.col("ruido_pct") <= max_noise).orderBy(F.desc("paradas_recorrentes"), "ruido_pct").limit(1)


def per_zone(episodes: DataFrame, passages: DataFrame, zone: str) -> DataFrame:
    """Episodes per 10 k passages and distinct days with an episode, per zone."""
    n = passages.groupBy(zone).agg(F.count("*").alias("passagens"))
    e = episodes.groupBy(zone).agg(F.count("*").alias("episodios"), F.countDistinct("dia").alias("dias"))
    return n.join(e, zone, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("episodios", "dias")}).withColumn(
        "por_10mil", 1e4 * F.col("episodios") / F.col("passagens"))


def episode_profile(d: DataFrame) -> DataFrame:
    """Distinct vehicles, trips and lines per episode, summarised."""
    e = d.where("rotulo <> -1").groupBy("dia", "rotulo").agg(
        F.count("*").alias("n"), F.countDistinct("prefixo").alias("v"), F.countDistinct("viagem_id").alias("g"), F.countDistinct("letreiro").alias("l"))
    return summarize(e, [], [
        F.count("*").alias("episodios"), F.avg(F.when(F.col("v") == 1, 1.0).otherwise(0.0)).alias("um_veiculo"),
        F.avg(F.when(F.col("l") >= 2, 1.0).otherwise(0.0)).alias("duas_linhas")],
        {"v": {"veiculos_mediana": 0.5}, "g": {"viagens_mediana": 0.5}, "l": {"linhas_p90": 0.9}})


def shuffled_flags(seg: DataFrame, pid: str, groups: list[str], replicates: int, seed: int = 5) -> DataFrame:
    """Per replicate, the same number of late passages per group, on other passages.

    Rows are ranked by md5 of (seed, replicate, id) inside (replicate, group), so other engines can draw the same; hot groups are
    ranked across slices.
    """
    d = seg.withColumn("replica", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    d = d.withColumn("_h", draw(F.lit(seed), "replica", pid).cast("double"))  # 52 bits: exact
    k = seg.groupBy(*groups).agg(F.sum("atrasado").alias("_k"))
    r = Ordered(d, ["replica", *groups], ["_h", pid]).row_number("_r").df.join(k, groups)
    return r.withColumn("atrasado", (F.col("_r") <= F.col("_k")).cast("int")).drop("_h", "_r", "_k")


def permutation_test(
    seg: DataFrame, pid: str, zone: str, shuffles: dict[str, tuple[list[str], int]], min_days: int = 15, eps_m=400.0, eps_s=1800.0, min_pts=10
) -> DataFrame:
    """Recurrent zones as observed against shuffled late flags, per way of shuffling (name: groups it keeps, replicates).

    `seg`: id, x, y, ts (seconds), dia, the zone, the group columns and the flag `atrasado`. All replicates and days are clustered in
    one job; the observed flags are replicate 0. A zone is recurrent with an episode on `min_days` days.
    """
    seg = cut_lineage(seg)
    parts = []
    for name, (groups, replicates) in shuffles.items():
        drawn = shuffled_flags(seg, pid, groups, replicates).unionByName(seg.withColumn("replica", F.lit(0)))
        parts.append(drawn.where("atrasado = 1").withColumn("modelo", F.lit(name)).select("modelo", "replica", "dia", pid, "x", "y", "ts", zone))
    late = parts[0]
    for part in parts[1:]:
        late = late.unionByName(part)
    late = cut_lineage(late)
    keys = ["modelo", "replica"]
    lab = st_dbscan(late, pid, "x", "y", eps_m, min_pts, by=[*keys, "dia"], t="ts", eps_t=eps_s).drop("nucleo")
    hit = late.join(lab, [*keys, "dia", pid]).where(f"{zone} IS NOT NULL")
    runs = late.groupBy(*keys).agg(F.count("*").alias("_n"))  # a replicate without an episode counts as 0
    z = runs.join(recurrent_zones(hit, keys, zone, min_days), keys, "left").select(*keys, F.coalesce("zonas_recorrentes", F.lit(0)).alias("z"))
    seen = z.where("replica = 0").select("modelo", F.col("z").alias("observado"))
    d = z.where("replica > 0").join(seen, "modelo")
    return d.groupBy("modelo", "observado").agg(
        F.count("*").alias("repeticoes"), F.avg("z").alias("media"), F.min("z").alias("minimo"), F.max("z").alias("maximo"),
        F.avg(F.when(F.col("z") >= F.col("observado"), 1.0).otherwise(0.0)).alias("fracao_igual_ou_acima"))


def recurrent_zones(labelled: DataFrame, keys: list[str], zone: str, min_days: int) -> DataFrame:
    """Zones with an episode on at least `min_days` days, counted per key."""
    d = labelled.where("rotulo <> -1").groupBy(*keys, zone).agg(F.countDistinct("dia").alias("_d"))
    return d.groupBy(*keys).agg(F.count_if(F.col("_d") >= min_days).alias("zonas_recorrentes"))


def episode_context(episode: DataFrame, seg: DataFrame, radius_m=700.0, minutes=90.0) -> DataFrame:
    """Passages around each episode (lat, lon, inicio, fim) by 15-minute bin: count and late share.

    Episodes meet passages by a place and day cell, then the exact radius and time window decide.
    """
    from busloom.operators.spatial import radius_join

    e = with_xy(episode).select(F.col("rotulo").alias("episodio"), "x", "y", F.col("inicio").alias("_a"), F.col("fim").alias("_b"))
    s = with_xy(seg)
    span = minutes * 60e6
    inside = (F.unix_micros("t") >= F.unix_micros("_a") - span) & (F.unix_micros("t") <= F.unix_micros("_b") + span)
    j = radius_join(s.select("x", "y", "t", "atrasado"), e, radius_m, extra=inside)
    return j.groupBy("episodio", F.window("t", "15 minutes")["start"].alias("bloco")).agg(F.count("*").alias("n"), F.avg("atrasado").alias("taxa"))
