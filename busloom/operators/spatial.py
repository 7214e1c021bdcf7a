"""Spatial joins on grid cells, polygons, hulls, connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.functions.geo import M_PER_LAT, M_PER_LON, haversine_m
from busloom.session import cut_round


def near_point(df: DataFrame, lat: float, lon: float, radius_m: float, la="lat", lo="lon") -> DataFrame:
    """Rows within a radius of one place, nearest first; the box filter reaches the scan."""
    dla, dlo = radius_m / M_PER_LAT * 1.01, radius_m / M_PER_LON * 1.05
    box = df.where(F.col(la).between(lat - dla, lat + dla) & F.col(lo).between(lon - dlo, lon + dlo))
    return box.withColumn("dist_m", haversine_m(la, lo, lat, lon)).where(F.col("dist_m") <= radius_m).orderBy("dist_m")


def _cells(df: DataFrame, size: float, x: str, y: str) -> DataFrame:
    return df.withColumns({"_cx": F.floor(F.col(x) / size), "_cy": F.floor(F.col(y) / size)})


def spread(df: DataFrame, size: float, x: str = "x", y: str = "y") -> DataFrame:
    """Each row once per cell of the 3 x 3 block around it."""
    d = _cells(df, size, x, y)
    step = F.array(*[F.lit(i) for i in (-1, 0, 1)])
    return (
        d.withColumn("_dx", F.explode(step))
        .withColumn("_dy", F.explode(step))
        .withColumns({"_cx": F.col("_cx") + F.col("_dx"), "_cy": F.col("_cy") + F.col("_dy")})
        .drop("_dx", "_dy")
    )


def radius_join(
    left: DataFrame, right: DataFrame, radius: float, how: str = "inner", on: list[str] | None = None,
    x="x", y="y", dist: str = "dist", extra: Column | None = None,
) -> DataFrame:
    """Left rows with right rows at most `radius` away. Right columns must not clash with left.

    The right side (features, stops) is repeated over neighbouring cells, the left (readings)
    keeps its rows, so the larger side should be on the left.
    """
    on = on or []
    rx, ry = "_r" + x, "_r" + y
    r = spread(right.withColumnsRenamed({x: rx, y: ry}), radius, rx, ry)
    l = _cells(left, radius, x, y)
    dx, dy = F.col(x) - F.col(rx), F.col(y) - F.col(ry)
    cond = dx * dx + dy * dy <= radius * radius
    if extra is not None:
        cond = cond & extra
    keys = [*on, "_cx", "_cy"]
    renamed = r.withColumnsRenamed({k: "_k" + k for k in keys})
    match = reduce(lambda a, b: a & b, [F.col(k) == F.col("_k" + k) for k in keys], cond)
    return (
        l.join(renamed, match, how)
        .withColumn(dist, F.sqrt(dx * dx + dy * dy))
        .drop("_cx", "_cy", rx, ry, *["_k" + k for k in keys])
    )


def nearest_k(
    left: DataFrame, right: DataFrame, lid: str, rid: str, k: int, radius: float, x="x", y="y", on=None
) -> DataFrame:
    """Up to k nearest right rows within the radius, ranked."""
    pairs = radius_join(left, right, radius, on=on, x=x, y=y)
    w = Window.partitionBy(lid).orderBy("dist", rid)
    return pairs.withColumn("posicao", F.row_number().over(w)).where(F.col("posicao") <= k)


def nearest_one(left, right, lid: str, value: Column, radius: float, x="x", y="y", on=None, spread_left: bool = False) -> DataFrame:
    """(lid, dist, value columns) of the nearest right row: an aggregate, no sort. `spread_left` where the right side is the
    larger: it is not repeated, and not broadcast by an estimate that may come from before its rows were made."""
    pairs = radius_join(right.hint("merge"), left, radius, on=on, x=x, y=y) if spread_left else radius_join(left, right, radius, on=on, x=x, y=y)
    best = F.min(F.struct("dist", value.alias("v"))).alias("_b")
    return pairs.groupBy(lid).agg(best).select(lid, F.col("_b.dist").alias("dist"), F.col("_b.v").alias("v"))


def match_by_id_or_place(
    left: DataFrame, right: DataFrame, lid: str, rid: str, radius: float, x="x", y="y"
) -> DataFrame:
    """Match ids first; what is left takes the nearest right row within the radius."""
    ids = right.select(F.col(rid).alias("_rid"))
    exact = left.join(ids, F.col(lid) == F.col("_rid"), "left_semi").select(
        lid, F.col(lid).alias(rid), F.lit("id").alias("modo"), F.lit(0.0).alias("dist"))
    rest = left.join(ids, F.col(lid) == F.col("_rid"), "left_anti")
    near = nearest_one(rest.select(lid, x, y), right.select(F.col(rid).alias("_rid"), x, y), lid, F.col("_rid"), radius, x, y)
    near = near.select(lid, F.col("v").alias(rid), F.lit("posicao").alias("modo"), "dist")
    found = exact.unionByName(near)
    none = rest.select(lid).join(near.select(F.col(lid).alias("_l")), F.col(lid) == F.col("_l"), "left_anti")
    return found.unionByName(none, allowMissingColumns=True)


# -- polygons
def zone_cells(edges: DataFrame, zone: str, order: str, cell: float) -> DataFrame:
    """Per grid cell, the zones whose box touches it, in order, with those of their edges that a ray to the east from the cell may cross.

    `edges` has x1, y1, x2, y2 of every ring of the zone, holes included.
    """
    z = edges.groupBy(zone, order).agg(
        F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_edges"),
        F.min(F.least("x1", "x2")).alias("_ax"), F.max(F.greatest("x1", "x2")).alias("_bx"),
        F.min(F.least("y1", "y2")).alias("_ay"), F.max(F.greatest("y1", "y2")).alias("_by"),
    )

    def span(lo, hi):
        return F.explode(F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell)))

    def met(e):
        # level edges, those above or below the cell and those west of it count for none of its points; the margin is for rounding
        m = F.lit(1e-6 * cell) + 1e-9 * (F.abs(e["x1"]) + F.abs(e["x2"]) + F.abs(e["y1"]) + F.abs(e["y2"]))
        beside = (F.greatest(e["y1"], e["y2"]) < F.col("_cy") * cell - m) | (F.least(e["y1"], e["y2"]) > (F.col("_cy") + 1) * cell + m)
        return (e["y1"] != e["y2"]) & ~beside & ~(F.greatest(e["x1"], e["x2"]) < F.col("_cx") * cell - m)

    return (
        z.withColumn("_cx", span("_ax", "_bx"))
        .withColumn("_cy", span("_ay", "_by"))
        .withColumn("_edges", F.filter("_edges", met))
        .where(F.size("_edges") > 0)
        .groupBy("_cx", "_cy")
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("ord"), F.col(zone).alias("zone"), F.col("_edges").alias("edges")))).alias("_zones"))
    )


def locate(points: DataFrame, cells: DataFrame, cell: float, out: str = "zona", x="lon", y="lat") -> DataFrame:
    """First zone holding the point, by the even-odd rule over all rings. No shuffle of points
    when the cell table is small enough for Spark to broadcast."""
    p = _cells(points, cell, x, y).join(cells, ["_cx", "_cy"], "left")

    def crosses(e):
        straddles = (e["y1"] > F.col(y)) != (e["y2"] > F.col(y))
        at = (e["x2"] - e["x1"]) * (F.col(y) - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"]
        return F.when(straddles & (F.col(x) < at), 1).otherwise(0)

    def inside(z):
        return F.aggregate(z["edges"], F.lit(0), lambda acc, e: acc + crosses(e)) % 2 == 1

    hit = F.get(F.filter(F.coalesce("_zones", F.array()), inside), F.lit(0))
    return p.withColumn(out, hit["zone"]).drop("_cx", "_cy", "_zones")


# -- hulls
def _hull(x, y):
    """Monotone chain over distinct points, counter-clockwise."""
    pts = sorted(set(zip(x, y)))
    if len(pts) < 3:
        return pts

    def half(seq):
        h = []
        for p in seq:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (p[1] - h[-2][1]) <= (h[-1][1] - h[-2][1]) * (p[0] - h[-2][0]):
                h.pop()
            h.append(p)
        return h

    lower, upper = half(pts), half(reversed(pts))
    return lower[:-1] + upper[:-1]


def convex_hulls(df: DataFrame, key: str, x="x", y="y") -> DataFrame:
    """Hull ring per group. Each Arrow batch is reduced to its hulls before the shuffle, and the
    hull of hulls is the hull of the group."""
    kind = df.schema[key].dataType.simpleString()
    small = f"{key} {kind}, x double, y double"

    def partial(batches):
        import pandas as pd

        for pdf in batches:
            rows = [
                (k, a, b) for k, g in pdf.groupby(key) for a, b in _hull(g["x"].tolist(), g["y"].tolist())
            ]
            yield pd.DataFrame(rows, columns=[key, "x", "y"])

    def final(pdf):
        import pandas as pd

        h = _hull(pdf["x"].tolist(), pdf["y"].tolist())
        flat = len(h) < 3
        if flat and len(set(zip(pdf["x"], pdf["y"]))) >= 1:
            ring = None
        else:
            ring = [[a, b] for a, b in [*h, h[0]]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "anel": [ring], "vertices": [len(h)]})

    src = df.select(key, F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where(f"{key} IS NOT NULL").distinct()
    once = src.mapInPandas(partial, small)
    # a second reduction spreads what one hot group leaves behind
    salted = once.withColumn("_salt", F.pmod(F.xxhash64("x", "y"), F.lit(64)))
    twice = salted.repartition(F.col(key), F.col("_salt")).drop("_salt").mapInPandas(partial, small)
    return twice.groupBy(key).applyInPandas(final, f"{key} {kind}, anel array<array<double>>, vertices int")


# -- connected components
def connected_components(edges: DataFrame, a: str, b: str, vertices: DataFrame | None = None) -> DataFrame:
    """(v, component): the component is its smallest vertex.

    Alternating star contraction: each round is two aggregates and joins over edges, and the number
    of rounds grows with the logarithm of the size. Rounds are cut by reliable checkpoints.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = cut_round(e)

    def state(d):
        return d.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).head()

    seen = state(e)
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # large star leaves u > v
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        e = cut_round(small)
        now = state(e)
        if now == seen:
            break
        seen = now
    out = e.select(F.col("u").alias("v"), F.col("v").alias("component"))
    roots = out.select(F.col("component").alias("v")).distinct().withColumn("component", F.col("v"))
    out = out.unionByName(roots)
    if vertices is not None:
        alone = vertices.select(F.col(vertices.columns[0]).alias("v")).distinct().join(out, "v", "left_anti")
        out = out.unionByName(alone.withColumn("component", F.col("v")))
    return out
