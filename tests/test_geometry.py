import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busloom.functions import geo
from busloom.operators import polyline as PL
from busloom.operators import spatial as S
from busloom.operators import dbscan
from busloom.operators.dbscan import near_components, st_dbscan


def one(df):
    return df.head()


def test_distances_and_projection(spark):
    d = spark.createDataFrame([(-23.55, -46.63, -23.56, -46.64)], "a double, b double, c double, d double")
    r = one(d.select(geo.haversine_m("a", "b", "c", "d").alias("h"), geo.bearing_deg("a", "b", "c", "b").alias("s"),
                     geo.to_lat(geo.to_y("c")).alias("la"), geo.cell_id("a", "b").alias("cel")))
    assert 1500 < r.h < 1515 and abs(r.s - 180) < 1e-6 and abs(r.la + 23.56) < 1e-9
    lat, lon = geo.cell_center(F.lit(r.cel))
    c = one(d.select(lat.alias("la"), lon.alias("lo"), geo.cell_center(F.lit("x"))[0].alias("n")))
    assert abs(c.la + 23.55) < 0.001 and abs(c.lo + 46.63) < 0.001 and c.n is None
    east, north = geo.utm_xy("a", "b")
    u = one(d.select(east.alias("e"), north.alias("n")))
    assert 333000 < u.e < 334500 and 7394000 < u.n < 7395500


def test_out_and_back_street(spark):
    # the way back runs on the other side of the street
    pts = [(1, i, float(x), 0.0 if i < 21 else 12.0) for i, x in enumerate([*range(0, 10001, 500), *range(10000, -1, -500)])]
    segs = PL.polyline_segments(spark.createDataFrame(pts, "cl int, seq int, x double, y double"), "cl", "seq")
    track = [(1, "v", i, float(x), 3.0 if i < 41 else 9.0) for i, x in enumerate([*range(0, 10001, 250), *range(9750, -1, -250)])]
    got = PL.project_track(spark.createDataFrame(track, "cl int, prefixo string, i int, x double, y double"), segs, "cl", ["prefixo"], "i").toPandas().sort_values("i")
    way, back = got[(got.x == 2000) & (got.i < 41)].s.iloc[0], got[(got.x == 2000) & (got.i > 41)].s.iloc[0]
    assert back > way + 5000 and (got.s.diff().dropna() >= -1e-6).all()


def plain_track(line, xs, ys, back=800.0, ahead=8000.0, accept=150.0):
    """The rule of project_track said plainly: every sample against every segment, one after the other."""
    a, v = line[:-1], np.diff(line, axis=0)
    length = np.maximum(np.hypot(*v.T), 1e-12)
    s1 = np.cumsum(length)
    s0, prev, out = s1 - length, None, []
    for p in np.column_stack([xs, ys]):
        t = np.clip(((p - a) * v).sum(axis=1) / length**2, 0, 1)
        d = np.hypot(*(a + t[:, None] * v - p).T)
        k = d.argmin()
        part = np.flatnonzero((s1 >= prev - back) & (s0 <= prev + ahead)) if prev is not None else []
        if len(part):
            w = part[d[part].argmin()]
            k = k if d[w] > accept and d[k] < 0.6 * d[w] else w
        prev = s0[k] + t[k] * length[k]
        out.append((prev, d[k]))
    return out


def test_anchored_track_against_every_segment(spark):
    r = np.random.default_rng(7)
    lines = {1: np.cumsum(r.normal(0, 90, (400, 2)), axis=0), 2: np.column_stack([np.tile([0.0, 3000.0], 12), np.arange(24) * 40.0]), 3: np.array([[0.0, 0.0], [5.0, 0.0]])}
    pts = [(k, i, float(x), float(y)) for k, line in lines.items() for i, (x, y) in enumerate(line)]
    segs = PL.polyline_segments(spark.createDataFrame(pts, "cl int, seq int, x double, y double"), "cl", "seq")
    rows, want = [], {}
    for k, line in lines.items():
        for vehicle in "abc":
            at = line[np.sort(r.integers(0, len(line), 150))] + r.normal(0, {"a": 20, "b": 200, "c": 4000}[vehicle], (150, 2))
            at[60:63] = at[0]  # back at the start, then on: the window doesn't hold it
            rows += [(k, vehicle, i, float(x), float(y)) for i, (x, y) in enumerate(at)]
            want |= {(k, vehicle, i): v for i, v in enumerate(plain_track(line, *at.T))}
    rows += [(1, "a", 999, None, 1.0), (9, "a", 0, 1.0, 1.0)]
    track = spark.createDataFrame(rows, "cl int, prefixo string, i int, x double, y double").repartition(5)
    got = {(g.cl, g.prefixo, g.i): (g.s, g.dist) for g in PL.project_track(track, segs, "cl", ["prefixo"], "i").collect()}
    assert got.keys() == want.keys()
    assert max(abs(a - b) for k in want for a, b in zip(got[k], want[k])) < 1e-6


def test_simplify_rounds_equal_grouped(spark):
    r = np.random.default_rng(1)
    pdf = pd.DataFrame({"k": np.repeat(["a", "b"], 60), "seq": np.tile(np.arange(60), 2), "x": np.tile(np.arange(60) * 10.0, 2), "y": r.normal(0, 20, 120)})
    df = spark.createDataFrame(pdf)
    a = PL.simplify(df, "k", "seq", 15.0).toPandas().sort_values(["k", "seq"])
    b = PL.simplify_rounds(df, "k", "seq", 15.0).toPandas().sort_values(["k", "seq"])
    assert 4 < len(a) < 120 and a[["k", "seq"]].to_numpy().tolist() == b[["k", "seq"]].to_numpy().tolist()


def test_hull(spark):
    r = np.random.default_rng(2)
    pts = [("a", float(x), float(y)) for x, y in r.random((200, 2))] + [("a", -1.0, -1.0), ("a", 2.0, -1.0), ("a", 0.5, 3.0), ("b", 0.0, 0.0), ("b", 1.0, 1.0)]
    h = {x.g: x for x in S.convex_hulls(spark.createDataFrame(pts, "g string, x double, y double"), "g").collect()}
    assert h["a"].vertices == 3 and h["a"].anel[0] == h["a"].anel[-1] and h["b"].anel is None


def test_hole_is_outside(spark):
    def ring(x0, y0, w):
        c = [(x0, y0), (x0 + w, y0), (x0 + w, y0 + w), (x0, y0 + w)]
        return [("z", 0, *p, *q) for p, q in zip(c, c[1:] + c[:1])]
    e = spark.createDataFrame(ring(0.0, 0.0, 10.0) + ring(4.0, 4.0, 2.0), "zona string, ordem int, x1 double, y1 double, x2 double, y2 double")
    p = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 20.0, 1.0)], "i int, lon double, lat double")
    got = {r.i: r.zona for r in S.locate(p, S.zone_cells(e, "zona", "ordem", 3.0), 3.0).collect()}
    assert got == {1: "z", 2: None, 3: None}


def brute(pts, eps, k, eps_t):
    n = len(pts)
    d = np.hypot(pts[:, None, 0] - pts[None, :, 0], pts[:, None, 1] - pts[None, :, 1]) <= eps
    d &= np.abs(pts[:, None, 2] - pts[None, :, 2]) <= eps_t
    core = d.sum(1) >= k
    lab = np.where(core, np.arange(n), n)
    while True:
        new = np.array([min([lab[i], *lab[d[i] & core]]) if core[i] else n for i in range(n)])
        if (new == lab).all():
            break
        lab = new
    out = lab.copy()
    for i in np.flatnonzero(~core):
        near = lab[d[i] & core]
        out[i] = near.min() if len(near) else -1
    return core, out


@pytest.mark.parametrize("seed", [0, 1])
def test_dbscan_with_crowded_cells(spark, seed):
    """Crowded, copied and thin places together; crowded neighbours around the radius of each other."""
    r = np.random.default_rng(seed)
    crowd = np.vstack([r.normal((0, 0), 9, (60, 2)), r.normal((118, 0), 9, (60, 2)), r.normal((0, 131), 4, (40, 2)), np.repeat([[300.0, 300.0]], 30, 0)])
    xy = np.vstack([crowd, r.uniform(-200, 500, (110, 2))])
    pts = np.column_stack([xy, r.integers(0, 3000, len(xy)).astype(float)])
    core, want = brute(pts, 100.0, 8, 1500.0)
    df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y", "t"]).assign(id=np.arange(len(pts))))
    got = st_dbscan(df, "id", "x", "y", 100.0, 8, t="t", eps_t=1500.0).toPandas().sort_values("id")
    assert (got.nucleo.to_numpy() == core).all() and (got.rotulo.to_numpy() == want).all()


@pytest.mark.parametrize("seed", [3, 4])
def test_thin_points_meet_boxes_of_crowded_cells(spark, seed, monkeypatch):
    """Rings of thin points at the radius of crowded cells: some reach all of a cell, some a few or one of its points."""
    monkeypatch.setattr(dbscan, "CROWD", 12)
    r = np.random.default_rng(seed)
    crowd = np.vstack([r.uniform((10, 10), (60, 60), (150, 2)), r.uniform((180, 40), (215, 60), (90, 2)), np.repeat([[320.0, 20.0]], 20, 0)])
    way = r.uniform(0, 2 * np.pi, 40)
    ring = np.column_stack([35 + np.cos(way) * r.uniform(70, 135, 40), 35 + np.sin(way) * r.uniform(70, 135, 40)])
    xy = np.vstack([crowd, ring, [[320 + 100.0, 20.0], [320.0, 120.0], [320.0, 120.0000001]]])
    pts = np.column_stack([xy, r.integers(0, 3000, len(xy)).astype(float)])
    for times in (None, 1500.0):
        core, want = brute(pts, 100.0, 8, times or 1e9)
        df = spark.createDataFrame(pd.DataFrame(pts, columns=["x", "y", "t"]).assign(id=np.arange(len(pts))))
        got = st_dbscan(df, "id", "x", "y", 100.0, 8, **({"t": "t", "eps_t": times} if times else {})).toPandas().sort_values("id")
        assert (got.nucleo.to_numpy() == core).all() and (got.rotulo.to_numpy() == want).all()


def test_a_crowd_beside_thin_points_gives_few_rows(spark):
    """100,000 points in one cell and four thin ones around it."""
    r = np.random.default_rng(8)
    xy = np.vstack([r.uniform(0, 60, (100_000, 2)), [[30.0, 158.0], [30.0, 155.0], [159.0, 30.0], [300.0, 300.0]]])
    df = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "id": np.arange(len(xy))}))
    cell = {f"c{a}": F.lit(0).cast("long") for a in "xyt"}
    fine = 100 * 0.999999 / 2**0.5 / 512
    crowd = df.where("id < 100000").withColumns(cell | {"t": F.lit(0.0), "_e": F.lit(100.0), "_et": F.lit(1.0), "ft": F.lit(0).cast("long"), "fx": F.floor(F.col("x") / fine), "fy": F.floor(F.col("y") / fine)})
    thin = df.where("id >= 100000").withColumns({f"q{a}": F.lit(0).cast("long") for a in "xyt"} | {"t": F.lit(0.0), "_e": F.lit(100.0), "_et": F.lit(1.0), "_m": F.lit(1_000_000)})
    got = {x.id: x._k for x in dbscan._reach_of_crowded(thin, crowd, []).collect()}
    d = ((xy[100_000:, None] - xy[None, :100_000]) ** 2).sum(2) <= 1e4
    assert got == {100_000 + k: n for k, n in enumerate(d.sum(1).tolist()) if n}


def test_components_without_pairs(spark):
    r = np.random.default_rng(9)
    xy = np.vstack([r.uniform(0, 900, (220, 2)), np.repeat([[2000.0, 2000.0]], 20_000, 0), [[2000.0, 2049.9], [2000.0, 2101.0]]])
    df = spark.createDataFrame(pd.DataFrame({"x": xy[:, 0], "y": xy[:, 1], "id": np.arange(len(xy))})).unionByName(spark.createDataFrame([(None, 1.0, 99_999)], "x double, y double, id long"))
    got = {x.id: x.component for x in near_components(df, "id", "x", "y", 50.0).collect()}
    small = xy[:220]
    near = ((small[:, None] - small[None]) ** 2).sum(2) <= 2500
    want = np.arange(220)
    while True:
        low = np.array([want[near[k]].min() for k in range(220)])
        if (low == want).all():
            break
        want = low
    assert [got[k] for k in range(220)] == want.tolist() and {got[k] for k in range(220, 20_221)} == {220}
    assert got[20_221] == 20_221 and got[99_999] == 99_999 and len(got) == len(xy) + 1


def test_two_times_one_place(spark):
    r = np.random.default_rng(5)
    xy = r.normal(0, 85, (120, 2))
    t = np.r_[8 * 3600 + r.uniform(0, 300, 60), 18 * 3600 + r.uniform(0, 300, 60)]
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(120), "x": xy[:, 0], "y": xy[:, 1], "t": t}))
    both = st_dbscan(df, "id", "x", "y", 400.0, 10, t="t", eps_t=1800.0)
    assert both.where("rotulo <> -1").select("rotulo").distinct().count() == 2
    assert st_dbscan(df, "id", "x", "y", 400.0, 10).where("rotulo <> -1").select("rotulo").distinct().count() == 1


def farthest_first(pts, tol):
    """Indices kept by definition: split at the point farthest from the chord segment, while one is beyond tol."""
    def gap(p, a, b):
        vx, vy = b[0] - a[0], b[1] - a[1]
        n = vx * vx + vy * vy
        t = 0.0 if n == 0 else min(1.0, max(0.0, ((p[0] - a[0]) * vx + (p[1] - a[1]) * vy) / n))
        return ((p[0] - a[0] - t * vx) ** 2 + (p[1] - a[1] - t * vy) ** 2) ** 0.5

    if len(pts) < 3:
        return list(range(len(pts)))
    d = [gap(p, pts[0], pts[-1]) for p in pts[1:-1]]
    if max(d) <= tol:
        return [0, len(pts) - 1]
    m = 1 + d.index(max(d))
    return farthest_first(pts[: m + 1], tol)[:-1] + [m + i for i in farthest_first(pts[m:], tol)]


def test_simplify_keeps_turns(spark):
    """A track that turns back beyond the end of its chord keeps the turn; random tracks as by definition."""
    rng = np.random.default_rng(8)
    tracks = {0: [(0, 0), (500, 0), (10, 0)], 1: [(0, 0), (0, 0), (0, 0)], 2: [(0, 0), (5, 5)]}
    tracks |= {k: np.cumsum(rng.normal(0, 20, (60, 2)), axis=0).tolist() for k in range(3, 8)}
    rows = [(k, i, float(x), float(y)) for k, t in tracks.items() for i, (x, y) in enumerate(t)]
    df = spark.createDataFrame(rows, "k int, seq int, x double, y double")
    want = sorted((k, i) for k, t in tracks.items() for i in farthest_first(t, 15.0))
    for out in (PL.simplify(df, "k", "seq", 15.0), PL.simplify_rounds(df.where("k <> 2"), "k", "seq", 15.0).unionByName(df.where("k = 2"))):
        assert sorted((r.k, r.seq) for r in out.collect()) == want
