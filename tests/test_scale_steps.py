"""What keeps steps small: columns nobody reads, the side that is repeated, cells as wide as segments."""

import datetime as dt
import math
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from busloom.operators import arrivals as A
from busloom.operators import delay as D
from busloom.operators import features as W
from busloom.operators import fleet as V
from busloom.operators import forecast as FC
from busloom.operators import metrics as M
from busloom.operators import polyline as PL
from busloom.operators import reports as R
from busloom.operators import spatial as S
from busloom.operators.asof import asof_join
from busloom.operators.hot import leaf_bytes, none_above
from busloom.operators.ordered import Ordered, latest_per_key
from busloom.operators.quantiles import any_hot, summarize, with_group_median
from busloom.operators.rolling import rolling_median
from busloom.operators.spatial import connected_components, nearest_one
from busloom.operators.studies import probe_against_fleet
from busloom.plans.q_delay import pairs_of, seg_of
from busloom.plans.standins import Bus
from busloom.session import DEFAULTS, DENSE_WINDOW_ROWS, SMALL_INPUT_BYTES, STORED_PARTITIONS, cut_round


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_asof_shuffles_only_what_is_read(spark):
    q = spark.createDataFrame([(1, 10, "wide"), (2, 10, "wide")], "k int, s long, quer string").withColumn("t", F.timestamp_seconds("s"))
    e = spark.createDataFrame([(1, 5, 1, 7, "big"), (1, 8, 2, None, "big")], "k int, s2 long, tie int, v int, bulk string").withColumn("u", F.timestamp_seconds("s2"))
    out = asof_join(q, e, ["k"], "t", "u", {"v": "v", "bulk": "bulk"}, "tie")
    assert {(r.k, r.v, r.bulk) for r in out.collect()} == {(1, None, "big"), (2, None, None)}  # the latest event, though its value is NULL
    slim = plan(out.select("k", "v"))
    assert "_e_bulk" not in slim and "_q_quer" not in slim


def test_latest_per_key_is_prunable_and_takes_null_orders_last(spark):
    d = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, None, "c")], "k int, o int, v string").withColumn("heavy", F.concat("v", F.lit("x")))
    out = latest_per_key(d, ["k"], ["o"])
    assert {(r.k, r.v, r.heavy) for r in out.collect()} == {(1, "b", "bx"), (2, "c", "cx")}
    assert "concat" not in plan(out.select("k", "o"))


def test_many_rows_of_few_values_are_not_hot(spark, hot):
    d = spark.range(500).select((F.col("id") % 2).alias("k"), (F.col("id") % 3).alias("few"), F.col("id").alias("many"))
    assert not any_hot(d, ["k"], ["few"])
    assert any_hot(d, ["k"], ["few", "many"])


def test_groups_without_quantiles_are_not_looked_at(spark, hot):
    d = spark.range(500).select((F.col("id") % 2).alias("k"))
    assert not any_hot(d, ["k"], [])  # no values to count: failed on groups above half the limit
    assert {(r.k, r.n) for r in summarize(d, ["k"], [F.count("*").alias("n")], {}).collect()} == {(0, 250), (1, 250)}
    pairs = spark.range(300).select((F.col("id") % 2).alias("cl"), (F.col("id") % 3).alias("cp"), (F.col("id") * 7 % 600).cast("int").alias("erro_s"), F.lit(0.9).alias("confianca"), F.lit("s").alias("parada_nome"), F.lit("L").alias("letreiro"))
    stops = R.critical_stops(pairs, spark.createDataFrame([(0, 1, 4), (1, 1, 6)], "cl long, cp long, ordem int"))
    assert {(r.stop, r.rows, r.position) for r in stops.collect()} == {(0, 100, None), (1, 100, 6), (2, 100, None)}


def test_a_layer_is_not_repeated(spark):
    pts = spark.createDataFrame([("p", 0.0, 0.0, 0.0), ("p", 100.0, 100.0, 0.0)], "par string, s double, x double, y double")
    layer = spark.range(40).select(F.col("id").alias("feicao"), F.lit(3.0).alias("x"), (F.col("id") / 10).alias("y"))
    out = V.share_near_layer(pts, layer, "share")
    assert out.head()["share"] == 0.5
    near = nearest_one(pts.select("s", "x", "y"), layer, "s", F.col("feicao"), 15.0, spread_left=True)
    assert "SortMergeJoin" in near._jdf.queryExecution().sparkPlan().toString()


def test_cells_of_long_segments(spark):
    track = spark.range(20).select(F.lit(1).alias("linha"), F.col("id").alias("seq"), (F.col("id") * 60_000).cast("double").alias("x"), ((F.col("id") * 37) % 200).cast("double").alias("y"))
    segs = PL.polyline_segments(track, "linha", "seq")
    pts = spark.range(300).select(F.lit(1).alias("linha"), F.col("id").alias("pid"), (F.col("id") * 3701.0).alias("x"), ((F.col("id") * 53) % 260).cast("double").alias("y"))
    got = {r.pid: r.dist for r in PL.project_points(pts, segs, "linha", "pid", 60.0).collect()}
    near = pts.join(segs, "linha").withColumns(PL.foot()).groupBy("pid").agg(F.min("dist").alias("d")).collect()
    assert len(got) == 300 and any(v is not None for v in got.values())
    assert all((got[r.pid] is None) if r.d > 60 else abs(got[r.pid] - r.d) < 1e-9 for r in near)


def test_every_bin_of_every_pair(spark):
    d = spark.createDataFrame([(1, 2, 0), (1, 2, 7200), (3, 4, 100)], "cp_origem int, cp_destino int, s long").withColumn("t_origem", F.timestamp_seconds("s"))
    assert W.every_bin(d, 30).count() == 2 * 5


def test_rounds_of_joins_keep_their_real_size(spark):
    edges = spark.range(3000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = connected_components(edges, "a", "b")
    assert got.count() == 3001 and got.select("component").distinct().count() == 1
    assert leaf_bytes(got) < 10 << 20  # was a number of more digits than Python reads


def test_rounds_keep_few_partitions(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        d = cut_round(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count())
        assert d.rdd.getNumPartitions() < 16 and d.count() == 100  # was 64, and in each round that followed
        assert spark.conf.get(STORED_PARTITIONS, None) is None
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_groups_are_counted_by_buckets_or_bounds(spark, hot):
    d = spark.range(500).select((F.col("id") % 20).alias("k"), F.col("id").alias("v"))
    assert none_above(d.select("k"), 25) and not none_above(d.select("k"), 24)
    assert any_hot(d, ["k"], ["v"])  # 25 values a group, an estimate from 20 on
    assert not any_hot(d, ["k"], ["v"], bound=spark.range(3).select(F.col("id").alias("k")))  # the cheaper rows decide


@pytest.fixture(scope="module")
def lines(spark, tmp_path_factory):
    """A folder with lineitems: 2,000 orders of seven."""
    at = tmp_path_factory.mktemp("lines")
    d = spark.range(14_000).select(
        (F.col("id") / 7).cast("long").alias("l_orderkey"), (F.col("id") % 7 + 1).cast("int").alias("l_linenumber"),
        (F.col("id") * 31 % 97).alias("l_partkey"), (F.col("id") * 17 % 89).alias("l_suppkey"))
    d.write.parquet(f"{at}/lineitem.parquet")
    return str(at)


@pytest.mark.parametrize("name", [
    "w05_stop_state", "w06_line_state", "w10_regular_series", "w11_sliding_windows", "w12_stop_nodes", "w13_stop_edges", "f12_short_horizon",
    "d09_delay_summary", "w15_hierarchical_reference", "m20_sequence_baselines"])
def test_pairs_and_segments_are_built_once(spark, lines, name):
    assert "Relation [" not in plan(__spark_entry__.queries()[name](spark, lines))  # the steps read what was stored, not the tables again


def test_named_segments_are_ordered_once(spark, lines):
    b = Bus(spark, lines)
    cols = ["viagem_id", "ordem_origem", "t_origem", "lat", "lon", "celula", "atrasado", "atraso_s", "headway_s", "extensao_m", "hora", "regiao_origem"]
    whole, named = seg_of(b), seg_of(b, *cols)
    assert named.columns == cols and named.count() > 1000
    assert named.exceptAll(whole.select(*cols)).isEmpty() and whole.select(*cols).exceptAll(named).isEmpty()
    slim = seg_of(b, "lat", "lon", "atrasado")
    assert not re.search("Window|Aggregate|l_orderkey", plan(slim))  # neither trips nor medians are made again by who reads them
    assert "BroadcastHashJoin" in slim._jdf.queryExecution().sparkPlan().toString()  # few medians, of known size


def test_episodes_and_passages_of_zones_share_segments(spark, lines, tmp_path):
    spark.read.parquet(f"{lines}/lineitem.parquet").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(i, f"n{i}") for i in range(25)], "n_nationkey int, n_name string").write.parquet(f"{tmp_path}/nation.parquet")
    out = __spark_entry__.queries()["c16_episodes_per_zone"](spark, str(tmp_path))
    assert "l_orderkey" not in plan(out)
    b = Bus(spark, str(tmp_path))
    want = S.locate(seg_of(b), S.zone_cells(b.zone_edges, "zona", "ordem", 0.01), 0.01).groupBy("zona").count().collect()
    assert {(r.zona, r.passagens) for r in out.collect()} == {tuple(r) for r in want} and len(want) > 3


def test_cells_hold_the_edges_a_ray_may_cross(spark):
    ring = [(0.0, 0.0), (9.0, 0.0), (9.0, 9.0), (6.0, 9.0), (6.0, 4.0), (3.0, 4.5), (3.0, 9.0), (0.0, 9.0), (0.0, 0.0)]
    sides = [("u", 1, *p, *q) for p, q in zip(ring, ring[1:])]
    e = spark.createDataFrame(sides, "zona string, ordem int, x1 double, y1 double, x2 double, y2 double")
    cells = S.zone_cells(e, "zona", "ordem", 3.0)
    kept = {(r._cx, r._cy): len(r._zones[0].edges) for r in cells.collect()}
    assert max(kept.values()) < 8 and kept[2, 0] == 1  # was all eight in every cell
    at = [(i, (i % 41) / 4 - 0.5, (i // 41) / 4 - 0.5) for i in range(41 * 41)]
    inside = lambda x, y: sum((y1 > y) != (y2 > y) and x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 for _, _, x1, y1, x2, y2 in sides) % 2
    got = S.locate(spark.createDataFrame(at, "i int, lon double, lat double"), cells, 3.0).collect()
    assert {r.i for r in got if r.zona} == {i for i, x, y in at if inside(x, y)}


def test_pairs_are_shuffled_once(spark):
    t = dt.datetime(2024, 1, 1, 12)
    at = lambda s: t + dt.timedelta(seconds=s)
    fc = spark.createDataFrame(
        [(1, 2, "v", "", at(0), at(600), 600, 1), (1, 2, "v", "", at(0), at(660), 660, 2), (1, 2, "v", "", at(60), at(9000), 900, 3), (1, 2, "v", "", at(60), at(540), 480, 4),
         (1, 3, None, "", at(0), at(60), 60, 5)],
        "cl long, cp long, prefixo string, parada_nome string, ts_coleta timestamp, t_previsto timestamp, horizonte_s long, qid long")
    arr = spark.createDataFrame([(1, 2, "v", "a", 1, at(630), 0.9, -23.5, -46.6)], "cl long, cp long, prefixo string, viagem_id string, ordem long, t_chegada timestamp, confianca double, lat double, lon double")
    out = FC.build_pairs(fc, arr, spark.createDataFrame([(2, "s")], "cp long, nome string"))
    assert {(r.qid, r.erro_s) for r in out.select("qid", "erro_s").collect()} == {(2, -30), (4, 90)}
    keys = out.select("erro_s")._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"hashpartitioning\(cl#\d+L?, cp#\d+L?, prefixo#\d+", keys)) == 1  # polls were shuffled before the match as well
    assert not re.search(r"hashpartitioning\([^)]*ts_coleta", keys)


def test_pairs_are_counted_by_error(spark, hot):
    p = spark.range(300).select(F.concat(F.lit("h"), F.col("id") % 2).alias("h"), (F.col("id") * 7 % 97 - 40).cast("int").alias("erro_s")).withColumn("erro_abs_s", F.abs("erro_s"))
    plain = {r.h: (r.n, r.q) for r in FC.error_table(p, ["h"], {"q": 0.9}, []).collect()}
    assert {r.h: (r.n, r.q) for r in FC.error_table(FC.error_counts(p, ["h"]), ["h"], {"q": 0.9}, [], weight="_n").collect()} == plain


def test_horizons_are_counted_by_error(spark, lines, hot):
    out = __spark_entry__.queries()["f11_error_by_horizon"](spark, lines)
    assert "Relation [" not in plan(out)  # pairs are built once, not anew to look for hot bands
    p = pairs_of(Bus(spark, lines)).withColumn("h", FC.horizon_band("horizonte_s", [300, 900, 1800], ["<5", "5-15", "15-30", "30-60"]))
    want = p.groupBy("h").agg(F.count("*"), F.round(F.avg("erro_abs_s"), 6), FC.share(F.col("erro_s") >= 60, "a"), FC.share(F.col("erro_s") <= -60, "b"), F.percentile("erro_s", 0.5))
    assert sorted(map(tuple, out.select("faixa_h", "n", "mae_s", "tarde", "cedo", "erro_mediano_s").collect())) == sorted(map(tuple, want.collect()))


def test_line_ranking_reads_counts(spark, hot):
    i = F.col("id")
    pairs = spark.range(1200).select(
        F.concat(F.lit("L"), i % 3).alias("letreiro"), (i % 2).alias("sentido"), F.when(i % 10 < 9, 0.9).otherwise(0.4).alias("confianca"),
        F.when(i % 13 > 0, (i * 37 % 701 - 200).cast("int")).alias("erro_s"), F.when(i % 7 > 0, (i * 11 % 900).cast("int")).alias("headway_obs_s"))
    out = R.line_ranking(pairs, min_n=150)
    assert "Range" not in plan(out)  # built once
    e, q = F.col("erro_s"), lambda c, x, unit=1.0: F.round(F.percentile(c, x) / unit, 1)
    want = pairs.where("confianca >= 0.5").groupBy("letreiro", "sentido").agg(
        F.count("*").alias("n"), FC.share(e >= 300, "late"), FC.share(e <= -60, "early"), F.round(F.avg(e), 1), F.round(F.avg(F.abs(e)), 1), q(e, 0.5), q(e, 0.9), q("headway_obs_s", 0.5, 60.0))
    want = sorted(map(tuple, want.where("n >= 150").collect()), key=lambda r: (-r[3], *r[:2]))
    names = ["line", "direction", "rows", "late_share", "early_share", "mean_error_s", "mean_abs_error_s", "median_error_s", "error_p90_s", "headway_median_min"]
    assert [tuple(r) for r in out.select(*names).collect()] == want and len(want) == 6


def _segments(spark, n):
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 11 > 0, F.concat(F.lit("v"), (i / 5).cast("long"))).alias("viagem_id"), (i % 3).alias("cl"), (i % 4 == 0).cast("int").alias("atrasado"),
        F.when(i % 7 > 0, (i * 13 % 90 - 30).cast("double")).alias("atraso_s"), (i % 50 + 0.5).cast("double").alias("percurso_tipico_s"), (i * 31 % 77).cast("double").alias("velocidade_kmh"))


def test_delay_summary_stores_counts(spark):
    out = D.delay_summary(_segments(spark, 400))
    assert "Range" not in plan(out)  # built once
    d = _segments(spark, 400)
    q = lambda c, x: F.round(F.percentile(c, x), 1)
    want = d.agg(F.count("*"), F.countDistinct("viagem_id"), F.countDistinct("cl"), F.round(F.avg("atrasado"), 4), q("atraso_s", 0.5), q("atraso_s", 0.9),
                 q("percurso_tipico_s", 0.5), q("velocidade_kmh", 0.5)).head()
    assert tuple(out.head()) == tuple(want)
    assert tuple(D.delay_summary(_segments(spark, 0)).head()) == (0, 0, 0, None, None, None, None, None)


def test_delay_summary_hot(spark, hot):
    d = _segments(spark, 400)
    assert tuple(D.delay_summary(d).head())[4:6] == tuple(d.agg(F.round(F.percentile("atraso_s", 0.5), 1), F.round(F.percentile("atraso_s", 0.9), 1)).head())


def test_reference_medians_count_values_first(spark):
    d = spark.range(600).select((F.col("id") % 200).alias("k"), F.when(F.col("id") % 9 > 0, (F.col("id") % 5).cast("double")).alias("v"))
    out = with_group_median(d, ["k"], "v", "m", "n")
    assert "count(1)" in plan(out)
    want = {r.k: (r.m, r.n) for r in d.groupBy("k").agg(F.percentile("v", 0.5).alias("m"), F.count("v").alias("n")).collect()}
    assert {r.k: (r.m, r.n) for r in out.collect()} == want and out.count() == 600


def test_rows_bound_passages(spark, lines):
    b = Bus(spark, lines)
    keys = ["cl", "cp", "prefixo", "viagem_id", "ordem"]
    assert b.arrivals.select(*keys).exceptAll(b.passage_rows.select(*keys)).isEmpty()
    assert "Aggregate" not in plan(b.passage_rows)


def test_dense_windows_leave_the_frame_early(spark):
    assert DEFAULTS[DENSE_WINDOW_ROWS] <= 100
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, t0 + dt.timedelta(seconds=i // 2), float(i * 7 % 60), i) for i in range(300)] + [(1, None, 4.0, 900), (1, None, 9.0, 901)]
    d = spark.createDataFrame(rows, "k int, t timestamp, v double, i int")
    thin = {r.i: (r.m, r.n) for r in rolling_median(d, ["k"], "t", "v", 60, "m", "n").collect()}
    spark.conf.set(SMALL_INPUT_BYTES, "0")
    try:
        out = rolling_median(d, ["k"], "t", "v", 60, "m", "n")
        assert "FlatMapGroupsInPandas" in plan(out)
        assert {r.i: (r.m, r.n) for r in out.collect()} == thin
        p = d.where("t IS NOT NULL").select("k", "t", F.col("i").cast("string").alias("pid"), "v")
        met = probe_against_fleet(p, p.select("k", "t", F.col("v").alias("vel_kmh")), "k", 1, 3)
        assert "struct" not in dict(met.dtypes)["pid"] and met.where("pid = '299'").head()["n"] == 120
    finally:
        spark.conf.unset(SMALL_INPUT_BYTES)


def test_network_state_of_dense_pairs(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    base = spark.createDataFrame(
        [(f"v{i:03}", i % 2 + 1, 3, at(i * 37), at(i * 37 + 60 + i % 5), None if i % 19 == 0 else float(i * 7 % 60 - 20), float(i % 11 * 10)) for i in range(300)],
        "viagem_id string, cp_origem int, cp_destino int, t_origem timestamp, t_chegada timestamp, alvo_s double, percurso_tipico_s double")
    state = lambda: {(r.no, r.inicio): tuple(round(x, 9) for x in r[2:]) for r in W.network_state(base, W.every_bin(base, 5)).collect()}
    thin = state()
    spark.conf.set(SMALL_INPUT_BYTES, "0")
    spark.conf.set(DENSE_WINDOW_ROWS, "3")
    try:
        assert state() == thin  # all three medians are sliced: a column's name was taken
    finally:
        spark.conf.unset(SMALL_INPUT_BYTES)
        spark.conf.unset(DENSE_WINDOW_ROWS)
    assert len(thin) == 74 and sum(v[-1] for v in thin.values()) > 60


def test_slices_leave_columns_alone(spark, hot):
    d = spark.range(300).select((F.col("id") % 2).alias("k"), "id", F.lit(7).alias("_b"))
    assert Ordered(d, ["k"], ["id"]).row_number("n").df.where("_b = 7").count() == 300


def test_weights_compare_digits(spark):
    d = spark.range(5000).withColumn("u", M.draw(F.lit(7), "id") / float(1 << 52))
    want = F.lit(len(M.POISSON_CDF))
    for k, c in reversed(list(enumerate(M.POISSON_CDF))):
        want = F.when(F.col("u") < c, k).otherwise(want)
    w = M.poisson_weight(F.lit(7), F.col("id"))
    assert d.where(want != w).isEmpty() and d.select(w).distinct().count() > 4
    assert "conv(" not in plan(d.select(w))


def test_steps_of_a_line_come_from_its_segments(spark):
    pts = spark.createDataFrame(
        [(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (3.0, 0.0), (3.0, 0.0), (3.0, 1200.0), (503.0, 1200.0)])] + [(2, 0, 0.0, 0.0), (2, 1, 0.0, 1000.0), (3, 0, 5.0, 5.0), (3, 1, 9.0, 5.0)],
        "linha int, seq int, x double, y double")
    segs = PL.polyline_segments(pts, "linha", "seq")
    out = PL.resample(segs, "linha", 500.0)
    assert "Union" not in plan(out)  # no ordered pass over all the places
    got = {(r.linha, round(r.s, 3)): r for r in out.collect()}
    assert {k for k in got} == {(1, 0.0), (1, 500.0), (1, 1000.0), (1, 1500.0), (1, 1703.0), (2, 0.0), (2, 500.0), (2, 1000.0), (3, 0.0), (3, 4.0)}
    at = PL.point_at(out.select("linha", "s"), segs, "linha", "s").collect()
    assert all(abs(got[r.linha, round(r.s, 3)].x - r.x) + abs(got[r.linha, round(r.s, 3)].y - r.y) < 1e-9 for r in at)
    assert (got[1, 500.0].ux, got[1, 500.0].uy) == (0.0, 1.0) and got[1, 1500.0].ux == 1.0


def test_places_of_a_segment_are_not_grouped(spark):
    pts = spark.createDataFrame(
        [(1, 0, 0.0, 0.0), (1, 1, 5000.0, 0.0), (1, 2, 5000.0, 2.0), (1, 3, 5003.0, 2.0), (1, 4, 5003.0, 995.0), (1, 5, 5003.0, 1001.0), (1, 6, 9000.0, 1001.0)], "linha int, seq int, x double, y double")
    segs = PL.polyline_segments(pts, "linha", "seq")
    out = PL.resample(segs, "linha", 10.0)
    steps = plan(out)
    assert steps.index("Generate explode") < steps.index("Aggregate")  # places are spread after the grouping, which reads a few rows a segment
    got = {round(r.s, 3): r for r in out.collect()}
    assert sorted(got) == [10.0 * i for i in range(1001)] + [10001.0]
    at = lambda off: {round(r.s, 3): r for r in PL.point_at(out.select("linha", "s", (F.col("s") + off).alias("a")), segs, "linha", "a").collect()}
    mid, back, ahead = at(0.0), at(-5.0), at(5.0)
    for s, r in got.items():
        dx, dy = ahead[s].x - back[s].x, ahead[s].y - back[s].y
        want = (mid[s].x, mid[s].y, dx / math.hypot(dx, dy), dy / math.hypot(dx, dy))
        assert all(abs(a - b) < 1e-9 for a, b in zip((r.x, r.y, r.ux, r.uy), want))


def test_tracks_are_simplified_once(spark):
    rows = [(1, "a", i, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=30 * i), 400.0 * i, 60.0 * (i % 2)) for i in range(8)]
    pos = spark.createDataFrame(rows, "cl int, prefixo string, rid int, ta timestamp, x double, y double")
    stops = spark.createDataFrame([(1, 1, 0.0, 0.0), (1, 2, 800.0, 0.0)], "cl int, cp int, x double, y double")
    out = A.observed_shape(pos, stops, p=A.Params(min_track_points=5))
    assert out.count() == 8 and out.head()["cobertura"] == 1.0
    assert "FlatMapGroupsInPandas" not in plan(out)
