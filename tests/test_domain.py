"""Synthetic bus line with known arrivals; payloads; sources; streams against batch."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busloom.functions import calendar as cal
from busloom.functions import geo
from busloom.operators import arrivals as A
from busloom.operators import forecast as FC
from busloom.operators import ingest as I
from busloom.plans.standins import Bus
from busloom.sources import files as FL
from busloom.sources import tables as TB
from busloom.streaming import live as L

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def line(spark):
    """Straight street, 11 stops, 10 trips, 20 km/h, a sample every 30 s, 8 m of noise."""
    r = np.random.default_rng(0)
    lon = np.linspace(-46.70, -46.60, 11)
    metres = (lon - lon[0]) * geo.M_PER_LON
    speed = 20 / 3.6
    stops = spark.createDataFrame([(1, 100 + i, -23.55, float(x)) for i, x in enumerate(lon)], "cl int, cp int, lat double, lon double")
    pos, truth, rid = [], [], 0
    for v in range(10):
        t0 = pd.Timestamp("2026-08-20 06:00") + pd.Timedelta(hours=1.5 * v)
        for i, m in enumerate(metres):
            truth.append((f"v{v}", 100 + i, t0 + pd.Timedelta(seconds=float(m / speed))))
        for s in np.arange(-60, metres[-1] / speed + 90, 30):
            m = float(np.clip(s * speed, -300, metres[-1] + 300))
            pos.append((rid, 1, f"v{v}", t0 + pd.Timedelta(seconds=float(s)), -23.55 + r.normal(0, 8) / geo.M_PER_LAT, lon[0] + (m + r.normal(0, 8)) / geo.M_PER_LON))
            rid += 1
    pos = spark.createDataFrame(pd.DataFrame(pos, columns=["rid", "cl", "prefixo", "ta", "lat", "lon"])).withColumn("ts_coleta", F.col("ta"))
    x = (np.linspace(-46.705, -46.595, 40) - geo.ANCHOR_LON) * geo.M_PER_LON
    y = (-23.55 - geo.ANCHOR_LAT) * geo.M_PER_LAT
    shape = spark.createDataFrame([(1, i, float(a), float(y)) for i, a in enumerate(x)], "cl int, seq int, x double, y double")
    arr = A.build_arrivals(pos, shape, stops).cache()
    return arr, pd.DataFrame(truth, columns=["prefixo", "cp", "t"])


def test_arrivals_found_and_exact(line):
    arr, truth = line
    m = truth.merge(arr.toPandas(), on=["prefixo", "cp"])
    err = (m.t_chegada - m.t).dt.total_seconds().abs()
    assert len(m) >= 0.9 * len(truth) and err.median() < 15 and err.quantile(0.9) < 40
    assert m.confianca.between(0, 1).all()


def test_injected_forecast_error(spark, line):
    arr, truth = line
    rows = []
    for i, r in enumerate(truth.itertuples()):
        promised = (r.t - pd.Timedelta(seconds=60 + 70 * int(r.prefixo[1:]))).floor("min")
        asked = r.t - pd.Timedelta(seconds=600)
        rows.append((i, 1, "L", 1, r.cp, "", r.prefixo, asked, promised, int((promised - asked).total_seconds()), 60 + 70 * int(r.prefixo[1:]) + (r.t - pd.Timedelta(seconds=60 + 70 * int(r.prefixo[1:])) - promised).total_seconds()))
    fc = spark.createDataFrame(pd.DataFrame(rows, columns=["qid", "cl", "letreiro", "sentido", "cp", "parada_nome", "prefixo", "ts_coleta", "t_previsto", "horizonte_s", "inj"]))
    a = arr.withColumn("letreiro", F.lit("L"))
    ok = FC.clean_forecasts(fc, "qid")
    p = FC.with_error(FC.match_arrivals(ok, a)).toPandas()
    assert len(p) > 0.9 * ok.count() and abs((p.erro_s - p.inj).median()) < 5


def test_clock_and_window(spark):
    d = spark.createDataFrame([("2026-08-21 02:50:00", "00:05"), ("2026-08-20 17:02:00", "14:07"), ("2026-08-20 17:02:00", "xx")], "a string, t string").select(F.to_timestamp("a").alias("a"), "t")
    h = [r[0] for r in d.select((F.unix_seconds(cal.resolve_clock("t", "a")) - F.unix_seconds("a"))).collect()]
    assert h == [900, 300, None]
    w = [r[0] for r in d.select(cal.inside_window("a", "04:00", "01:00")).collect()]
    assert w == [True, True, True]
    z = I.choose_zone(d, "t", "a").where("escolhido").head()
    assert z.fuso == "local"


def test_payload_shapes(spark):
    v = {"p": "11433", "a": True, "ta": "2026-08-20T17:00:37Z", "py": -23.55, "px": -46.63}
    pays = [{"hr": "14:00", "l": [{"c": "8000-10", "cl": 1273, "sl": 1, "lt0": "A", "lt1": "B", "qv": 2, "vs": [v, {"p": "1", "py": None, "px": 1.0}]}]}, {"hr": "14:00", "vs": [v]}]
    d = spark.createDataFrame([(json.dumps(p),) for p in pays], "payload string").withColumn("ts_coleta", F.lit("2026-08-20 17:00:00").cast("timestamp"))
    got = I.flatten_positions(d, "payload", "ts_coleta", 7, "175T-10", 2).orderBy("cl").collect()
    assert [(r.cl, r.letreiro, r.sentido, r.destino) for r in got] == [(7, "175T", 2, None), (1273, "8000", 1, "A")]
    f = {"hr": "14:00", "ps": [{"cp": 42, "np": "STOP", "py": -23.55, "px": -46.63, "vs": [{**v, "t": "14:07"}]}]}
    d = spark.createDataFrame([(json.dumps(f), 1273, "8000", 1)], "payload string, cl int, s string, w int").withColumn("ts_coleta", F.lit("2026-08-20 17:00:00").cast("timestamp"))
    r = I.flatten_forecasts(d, "payload", "ts_coleta", "cl", "s", "w").collect()
    assert len(r) == 1 and r[0].horizonte_s == 420 and r[0].cp == 42


def test_raw_tables_and_derived(spark, tmp_path):
    p = Bus(spark, SF).positions
    path = str(tmp_path / "raw")
    TB.append_raw(p, path, "posicoes")
    TB.append_raw(p.limit(5), path, "posicoes")
    from datetime import datetime
    got = TB.read_raw(spark, path, datetime(2024, 1, 10), datetime(2024, 1, 12), ["prefixo", "ts_coleta"], table="posicoes")
    assert 0 < got.count() < p.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "dt#" in plan.split("PartitionFilters")[1].split("]")[0]
    assert TB.manifest(spark.read.parquet(path)).agg(F.sum("linhas")).head()[0] == p.count() + 5
    assert TB.read_derived(spark, str(tmp_path / "none"), "chegadas").count() == 0
    TB.save_derived(Bus(spark, SF).arrivals, str(tmp_path / "ch"), "chegadas")
    assert TB.read_derived(spark, str(tmp_path / "ch"), "chegadas").count() == Bus(spark, SF).arrivals.count()


def test_only_missing_days_are_built(spark, tmp_path):
    src = Bus(spark, SF).positions.withColumn("dia", F.to_date("ta"))
    path = str(tmp_path / "frota")
    seen = []

    def build(d):
        seen.append(d.select("dia").distinct().count())
        return d.select(F.col("ta").alias("t"), F.lit(1.0).alias("vel_ms"), F.col("dia").alias("dt"))

    TB.build_missing_days(spark, path, "frota", src.where("dia < '2024-01-06'"), "dia", build)
    TB.build_missing_days(spark, path, "frota", src.where("dia < '2024-01-08'"), "dia", build)
    assert seen[1] == 2 and spark.read.parquet(path).count() == src.where("dia < '2024-01-08'").count()


def test_geojson_round_trip(spark, tmp_path):
    fc = {"type": "FeatureCollection", "features": [
        {"type": "Feature", "properties": {"nm_zona": "A"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2], [0, 0]]]}},
        {"type": "Feature", "properties": {"n": 1}, "geometry": {"type": "Point", "coordinates": [5.0, 6.0]}},
        {"type": "Feature", "properties": {}, "geometry": {"type": "MultiLineString", "coordinates": [[[0, 0], [1, 1]], [[2, 2], [3, 3], [4, 4]]]}},
        {"type": "Feature", "properties": {}, "geometry": None}]}
    f = tmp_path / "z.geojson"
    f.write_text(json.dumps(fc))
    d = FL.read_geojson(spark, str(f))
    assert d.count() == 3 and FL.geojson_edges(d, "nm_zona").count() == 3
    assert FL.geojson_points(d).head().lat == 6.0 and FL.geojson_lines(d).count() == 5
    c = spark.createDataFrame([(1, [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]], 1.0, 2.0), (2, None, 3.0, 4.0)], "rotulo int, anel array<array<double>>, lat double, lon double")
    FL.write_feature_lines(FL.cluster_features(c, "anel", "lat", "lon", ["rotulo"]), str(tmp_path / "c"))
    back = {r.propriedades["rotulo"]: r.anel for r in FL.read_cluster_features(spark, str(tmp_path / "c")).collect()}
    assert back["1"] == [[0.0, 0.0], [1.0, 0.0], [0.0, 0.0]] and back["2"] is None


def test_feed_and_logs(spark, tmp_path):
    (tmp_path / "frequencies.txt").write_text("﻿trip_id,start_time,end_time,headway_secs,exact\nA-10-0,00:00:00,02:59:00,600,0\n")
    r = FL.read_feed(spark, str(tmp_path), "frequencies").head()
    assert r.trip_id == "A-10-0" and r.headway_secs == 600.0
    TB.log_event(spark, str(tmp_path / "log"), "atraso", {"n": 3})
    assert spark.read.json(str(tmp_path / "log")).head().tipo == "atraso"


def test_streams_equal_batch(spark, tmp_path):
    pos = Bus(spark, SF).positions.select("prefixo", "cl", "ta", "ts_coleta", "lat", "lon")
    again = pos.where("cl = 4").withColumn("ts_coleta", F.col("ts_coleta") + F.expr("INTERVAL 10 SECONDS"))
    src = str(tmp_path / "in")
    pos.unionByName(again).coalesce(1).sortWithinPartitions("ts_coleta").write.parquet(src)

    def run(df, name):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    def stream():
        return spark.readStream.schema(pos.schema).parquet(src)

    n = pos.dropDuplicates(["prefixo", "cl", "ta"]).count()
    assert run(L.new_positions(stream()), "s_new").count() == n
    assert run(L.changed_positions(stream()), "s_changed").count() == n
    beat = run(L.heartbeat(stream()), "s_beat").agg(F.sum("amostras")).head()[0]
    assert 0.9 * (pos.count() + again.count()) < beat <= pos.count() + again.count()
    q = L.write_raw(L.new_positions(stream()), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == n


def test_present_days_open_no_file(spark, tmp_path):
    for day in ("2024-01-01", "2024-01-02"):
        (tmp_path / "t" / f"dt={day}").mkdir(parents=True)
        (tmp_path / "t" / f"dt={day}" / "part-0.parquet").write_text("no parquet at all")
    wanted = spark.sql("SELECT explode(sequence(DATE'2024-01-01', DATE'2024-01-04')) AS dt")
    assert sorted(str(r.dt) for r in TB.missing_days(spark, str(tmp_path / "t"), wanted).collect()) == ["2024-01-03", "2024-01-04"]
    assert TB.missing_days(spark, str(tmp_path / "none"), wanted).count() == 4


def test_deviance_decomposition_equals_a_plain_fit(spark):
    import numpy as np

    from busloom.operators import studies as E
    r = np.random.default_rng(4)
    f = [r.integers(0, k, 3000) for k in (4, 3, 5)]
    y = (r.random(3000) < 1 / (1 + np.exp(-(0.5 * f[0] - 0.8 * f[1] + 0.2 * f[2] - 1)))).astype(int)
    rows = [(f"h{a}", f"l{b}", None if k % 500 == 0 else f"z{c}", int(v)) for k, (a, b, c, v) in enumerate(zip(*f, y))]
    got = {x.modelo: x for x in E.deviance_decomposition(spark.createDataFrame(rows, "h string, l string, z string, atrasado int"), "h", "l", "z").collect()}
    keep = np.array([k % 500 != 0 for k in range(3000)])

    def deviance(use):
        x = np.concatenate([np.ones((3000, 1)), *[np.eye(f[k].max() + 1)[f[k]][:, 1:] for k in use]], axis=1)[keep]
        w, v = np.zeros(x.shape[1]), y[keep]
        for _ in range(30):
            p = 1 / (1 + np.exp(-x @ w))
            w += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x, x.T @ (v - p))
        p = 1 / (1 + np.exp(-x @ w))
        return -2 * (v * np.log(p) + (1 - v) * np.log(1 - p)).sum(), x.shape[1]

    want = {n: deviance(u) for n, u in (("h", [0]), ("h+l", [0, 1]), ("h+z", [0, 2]), ("h+l+z", [0, 1, 2]))}
    for n, (d, k) in want.items():
        assert abs(got[n].deviance - d) < 1e-3 and got[n].parametros == k and abs(got[n].aic - d - 2 * k) < 1e-3
    assert abs(got["h+l+z"].queda_a - (want["h+z"][0] - want["h+l+z"][0])) < 1e-2 and abs(got["h+l"].queda_a - (want["h"][0] - want["h+l"][0])) < 1e-2


def test_external_readers(spark, tmp_path):
    osm = {"elements": [{"type": "node", "id": 1, "lat": -23.5, "lon": -46.6, "tags": {"highway": "traffic_signals"}},
                        {"type": "way", "id": 2, "tags": {"maxspeed": "50"}, "geometry": [{"lat": 1.0, "lon": 2.0}]}]}
    (tmp_path / "o.json").write_text(json.dumps(osm))
    rows = FL.read_map_extract(spark, str(tmp_path / "o.json")).collect()
    assert rows[0].tags == {"highway": "traffic_signals"} and rows[1].geometry[0].lon == 2.0
    (tmp_path / "p.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","ponto":"a","status":200,"velocidade_kmh":12.5}\n{"ponto":"a","status":500}\n')
    assert FL.read_probes(spark, str(tmp_path / "p.jsonl")).count() == 1
    spark.createDataFrame([(1.0, 2.0, 0.5)], "lat double, lon double, chuva_mm double").withColumn("hora_local", F.current_timestamp()).write.parquet(str(tmp_path / "r"))
    assert FL.read_rain(spark, str(tmp_path / "r")).head().chuva_mm == 0.5


def test_only_algorithms_that_ran_are_replaced(spark, tmp_path):
    p = str(tmp_path / "c")
    TB.replace_partitions(spark.createDataFrame([("a", 1), ("b", 2)], "algoritmo string, n int"), p, "algoritmo")
    TB.replace_partitions(spark.createDataFrame([("b", 3)], "algoritmo string, n int"), p, "algoritmo")
    assert {(r.algoritmo, r.n) for r in spark.read.parquet(p).collect()} == {("a", 1), ("b", 3)}


def test_live_headway(spark, tmp_path):
    a = Bus(spark, SF).arrivals.select("cl", "cp", "t_chegada", "viagem_id")
    a.drop("viagem_id").coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(a.drop("viagem_id").schema).parquet(str(tmp_path / "in"))
    q = L.live_headway(s).writeStream.format("memory").queryName("s_headway").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    from busloom.operators.delay import add_headway
    want = add_headway(a, ("cl", "cp")).agg(F.count("headway_s"), F.sum("headway_s")).head()
    got = spark.table("s_headway").where("NOT isnan(headway_s)").agg(F.count("headway_s"), F.sum("headway_s")).head()
    assert tuple(got) == tuple(want)
