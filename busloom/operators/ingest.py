"""Row transforms of raw payloads; all work on batch and streaming DataFrames unless noted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from busloom.config import LOCAL_TZ
from busloom.functions import calendar as cal
from busloom.operators.ordered import Ordered, lagged, latest_per_key
from busloom.schemas import FORECAST_PAYLOAD, POSITIONS_PAYLOAD, SUBLINE_LIST, VEHICLE_LIST


def parse_instant(text) -> Column:
    """ISO instant, NULL when it cannot be read."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def first_sign(full) -> Column:
    return F.nullif(F.get(F.split(full, "-"), F.lit(0)), F.lit(""))


def flatten_positions(df: DataFrame, payload: str, ts: str, cl=None, sign=None, way=None) -> DataFrame:
    """One row per vehicle. Payloads list lines in `l`, or hold `vs` at the root for one line."""
    d = df.withColumn("_j", F.from_json(payload, POSITIONS_PAYLOAD))
    root = F.array(
        F.struct(
            F.lit(sign).cast("string").alias("c"), F.lit(cl).cast("bigint").alias("cl"), F.lit(way).cast("int").alias("sl"),
            F.lit(None).cast("string").alias("lt0"), F.lit(None).cast("string").alias("lt1"),
            F.lit(None).cast("int").alias("qv"), F.col("_j.vs").alias("vs"),
        )
    )
    blocks = F.when(F.coalesce(F.size("_j.l"), F.lit(0)) > 0, F.col("_j.l")).when(F.col("_j.vs").isNotNull(), root)
    d = d.withColumn("_l", F.explode(blocks)).withColumn("_v", F.explode("_l.vs"))
    sign_full = F.coalesce(F.nullif("_l.c", F.lit("")), F.lit(sign).cast("string"), F.lit(""))
    line = F.coalesce("_l.cl", F.lit(cl).cast("bigint"))
    return d.where(line.isNotNull() & F.col("_v.py").isNotNull() & F.col("_v.px").isNotNull()).select(
        *[c for c in df.columns if c not in (payload, ts)],
        F.col(ts).alias("ts_coleta"),
        F.col("_j.hr").alias("hr_api"),
        line.alias("cl"),
        first_sign(sign_full).alias("letreiro"),
        F.coalesce(F.nullif("_l.sl", F.lit(0)), F.lit(way).cast("int"), F.lit(0)).alias("sentido"),
        F.col("_l.lt0").alias("destino"),
        F.nullif("_v.p", F.lit("")).alias("prefixo"),
        F.col("_v.a").alias("acessivel"),
        parse_instant(F.col("_v.ta")).alias("ta"),
        F.col("_v.py").alias("lat"),
        F.col("_v.px").alias("lon"),
    )


def flatten_forecasts(
    df: DataFrame, payload: str, ts: str, cl: str, sign: str, way: str, tz: str | None = LOCAL_TZ
) -> DataFrame:
    """One row per stop and vehicle. Stops come in `ps` or `p`; vehicles directly or under lines."""
    d = df.withColumn("_j", F.from_json(payload, FORECAST_PAYLOAD))
    stops = F.coalesce("_j.ps", F.array("_j.p"))
    d = d.withColumn("_s", F.explode(stops)).where("_s.cp IS NOT NULL")
    blk = "array<struct<cl:bigint,sl:int,vs:" + VEHICLE_LIST + ">>"
    own = F.when(
        F.col("_s.vs").isNotNull(),
        F.array(F.struct(F.col(cl).cast("bigint").alias("cl"), F.col(way).cast("int").alias("sl"), F.col("_s.vs").alias("vs"))),
    ).otherwise(F.array().cast(blk))
    subs = F.transform(
        F.coalesce("_s.l", F.array().cast(SUBLINE_LIST)),
        lambda x: F.struct(
            F.coalesce(F.nullif(x["cl"], F.lit(0)), F.col(cl).cast("bigint")).alias("cl"),
            F.coalesce(F.nullif(x["sl"], F.lit(0)), F.col(way).cast("int")).alias("sl"),
            x["vs"].alias("vs"),
        ),
    )
    d = d.withColumn("_b", F.explode(F.concat(own, subs))).withColumn("_v", F.explode("_b.vs"))
    when = cal.resolve_clock(F.col("_v.t"), F.col(ts), tz)
    d = d.withColumn("t_previsto", when)
    return d.select(
        *[c for c in df.columns if c not in (payload, ts, cl, sign, way)],
        F.col(ts).alias("ts_coleta"), F.col("_j.hr").alias("hr_api"), F.col("_b.cl").alias("cl"),
        F.col(sign).alias("letreiro"), F.coalesce("_b.sl", F.lit(0)).alias("sentido"), F.col("_s.cp").alias("cp"),
        F.col("_s.np").alias("parada_nome"), F.col("_s.py").alias("parada_lat"), F.col("_s.px").alias("parada_lon"),
        F.nullif("_v.p", F.lit("")).alias("prefixo"), F.col("_v.a").alias("acessivel"), F.col("_v.t").alias("t_previsto_str"),
        "t_previsto",
        ((F.unix_micros("t_previsto") - F.unix_micros(ts)) / 1e6).cast("int").alias("horizonte_s"),
        parse_instant(F.col("_v.ta")).alias("ta"), F.col("_v.py").alias("lat"), F.col("_v.px").alias("lon"),
    )


def choose_zone(df: DataFrame, text: str, ts: str) -> DataFrame:
    """Which reading of the clock texts gives plausible horizons: one row per candidate, best first."""
    parts = []
    for name, tz in (("local", LOCAL_TZ), ("utc", None)):
        h = (F.unix_micros(cal.resolve_clock(text, ts, tz)) - F.unix_micros(ts)) / 1e6
        parts.append(df.where(cal.clock_ok(text)).select(F.lit(name).alias("fuso"), h.alias("h")))
    # counted once: the clock maths runs over the rows a single time
    d = parts[0].unionByName(parts[1]).groupBy("fuso", "h").agg(F.count("*").alias("n"))
    ok = F.sum(F.when(F.col("h").between(-120, 3600), F.col("n")).otherwise(0))
    rate = d.groupBy("fuso").agg(F.round(ok / F.sum("n"), 3).alias("fracao_plausivel"), F.sum("n").alias("_n"))
    cum = Ordered(d, ["fuso"], ["h"]).running_sum({"_c": "n"}).df.join(rate.select("fuso", "_n"), "fuso")
    upper = cum.where(F.col("_c") > F.floor(F.col("_n") / 2)).groupBy("fuso").agg(F.min("h").alias("horizonte_mediano_s"))
    rate = rate.drop("_n")
    out = rate.join(upper, "fuso")
    best = out.agg(F.max(F.struct("fracao_plausivel", F.when(F.col("fuso") == "local", 1).otherwise(0).alias("l"), "fuso")).alias("_b"))
    return out.crossJoin(best).withColumn("escolhido", F.col("fuso") == F.col("_b.fuso")).drop("_b")  # one row


def drop_repeats(df: DataFrame, tie: str) -> DataFrame:
    """Rows whose GPS instant differs from the last seen one of the vehicle and line (batch)."""
    known = df.where("prefixo IS NOT NULL AND ta IS NOT NULL")
    rest = df.where("prefixo IS NULL OR ta IS NULL")
    k = lagged(known, ["prefixo", "cl"], ["ts_coleta", tie], {"_ta": "ta"})
    return k.where("_ta IS NULL OR _ta <> ta").drop("_ta").unionByName(rest)


def drop_exact_duplicates(df: DataFrame, tie: str) -> DataFrame:
    """One row per vehicle and GPS instant, the first polled."""
    return latest_per_key(df, ["prefixo", "ta"], [-F.unix_micros("ts_coleta"), -F.col(tie)])


def catalogue_union(snapshot: DataFrame, search: DataFrame, key: str = "cl") -> DataFrame:
    """Search rows override snapshot rows."""
    both = snapshot.withColumn("_p", F.lit(0)).unionByName(search.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return latest_per_key(both, [key], ["_p"]).drop("_p")


def lines_from_snapshot(df: DataFrame, payload: str, ts: str) -> DataFrame:
    d = df.select(F.col(ts).alias("atualizado_em"), F.explode(F.from_json(payload, POSITIONS_PAYLOAD)["l"]).alias("l"))
    return d.where("l.cl IS NOT NULL").select(
        "l.cl", first_sign(F.col("l.c")).alias("letreiro"), F.nullif("l.c", F.lit("")).alias("letreiro_completo"),
        F.coalesce("l.sl", F.lit(0)).alias("sentido"), F.col("l.lt1").alias("terminal_principal"),
        F.col("l.lt0").alias("terminal_secundario"), "atualizado_em")


def lines_from_search(df: DataFrame, item: str) -> DataFrame:
    """Search items (struct cl, lt, tl, sl, lc, tp, ts) as catalogue rows."""
    sign = F.nullif(F.trim(F.coalesce(F.col(f"{item}.lt"), F.lit(""))), F.lit(""))
    full = F.when(sign.isNotNull() & F.col(f"{item}.tl").isNotNull(), F.concat_ws("-", sign, F.col(f"{item}.tl"))).otherwise(sign)
    return df.where(F.col(f"{item}.cl").isNotNull()).select(
        F.col(f"{item}.cl").alias("cl"), sign.alias("letreiro"), full.alias("letreiro_completo"), F.col(f"{item}.tl").alias("tl"),
        F.coalesce(f"{item}.sl", F.lit(0)).alias("sentido"), F.col(f"{item}.lc").alias("circular"),
        F.col(f"{item}.tp").alias("terminal_principal"), F.col(f"{item}.ts").alias("terminal_secundario"))


def resolve_signs(lines: DataFrame, wanted: DataFrame, sign: str) -> DataFrame:
    """Codes of both directions for the given signs, ignoring case and blanks."""
    w = wanted.select(F.upper(F.trim(sign)).alias("_s")).where("_s <> ''").distinct()
    return lines.join(w, F.upper(F.trim("letreiro")) == F.col("_s"), "left_semi")


def stop_union(a: DataFrame, b: DataFrame, key: str = "cp", name: str = "nome") -> DataFrame:
    """Stops of two sources; a record with a name wins, then the first source."""
    both = a.withColumn("_p", F.lit(1)).unionByName(b.withColumn("_p", F.lit(0)), allowMissingColumns=True)
    named = (F.trim(F.coalesce(F.col(name), F.lit(""))) != "").cast("int")
    return latest_per_key(both, [key], [named, "_p"]).drop("_p")


def link_union(service: DataFrame, observed: DataFrame) -> DataFrame:
    """Line-stop pairs of both sources; only the service gives an order."""
    both = service.select("cl", "cp", "ordem_api").unionByName(observed.select("cl", "cp", F.lit(None).cast("int").alias("ordem_api")))
    return both.groupBy("cl", "cp").agg(F.min("ordem_api").alias("ordem_api"))


def complete_names(stops: DataFrame, feed: DataFrame) -> DataFrame:
    """Empty stop names from the feed, by id."""
    f = feed.select(F.col("stop_id").cast("string").alias("_id"), F.col("stop_name").alias("_n"))
    blank = F.trim(F.coalesce("nome", F.lit(""))) == ""
    return stops.join(f, F.col("cp").cast("string") == F.col("_id"), "left").withColumn(
        "nome", F.when(blank, F.coalesce(F.nullif(F.trim("_n"), F.lit("")), "nome")).otherwise(F.col("nome"))).drop("_id", "_n")


def flatten_companies(df: DataFrame, payload: str) -> DataFrame:
    """Companies nested by operating area."""
    d = df.select(F.explode(F.from_json(payload, "e array<struct<a:int, e:array<struct<c:int, n:string>>>>")["e"]).alias("a"))
    return d.select(F.col("a.a").alias("area"), F.explode("a.e").alias("e")).select("area", F.col("e.c").alias("codigo"), F.col("e.n").alias("nome"))


def corridor_lines(df: DataFrame, payload: str) -> DataFrame:
    """Distinct line codes serving the stops of monitored corridors."""
    d = df.select(F.explode(F.from_json(payload, "array<struct<cp:bigint, l:array<struct<cl:bigint>>>>")).alias("s"))
    return d.select(F.explode("s.l").alias("l")).where("l.cl IS NOT NULL").select("l.cl").distinct()


def corridors(df: DataFrame, payload: str) -> DataFrame:
    d = df.select(F.explode(F.from_json(payload, "array<struct<cc:int, nc:string>>")).alias("c"))
    return d.where("c.cc IS NOT NULL").select("c.cc", F.col("c.nc").alias("nome"))


def candidate_lines(linked: DataFrame, vehicles: DataFrame, min_cov=0.5, min_stops=5, min_vehicles=2, top=20) -> DataFrame:
    """Lines worth following: enough covered stops and vehicles, most events per cycle first."""
    d = linked.join(vehicles, "cl").withColumn("rendimento", F.col("veiculos") * F.col("paradas_api"))
    ok = (F.col("cobertura") >= min_cov) & (F.col("paradas_api") >= min_stops) & (F.col("veiculos") >= min_vehicles)
    return d.where(ok).orderBy(F.desc("rendimento"), "cl").limit(top)
