"""One payload stream into positions and forecasts; replays and repeats add nothing."""

import json
from datetime import datetime, timedelta, timezone

import pytest

from busloom.streaming import live as L

START = datetime(2024, 3, 5, 14, 50, tzinfo=timezone.utc)


def line(kind, at, payload, cl=None, sign=None, way=None):
    return json.dumps({"ts_coleta": at.isoformat(), "tipo": kind, "cl": cl, "letreiro": sign, "sentido": way, "payload": json.dumps(payload)}) + "\n"


def position(at, vehicles):
    vs = [{"p": p, "a": True, "ta": t.isoformat().replace("+00:00", "Z"), "py": -23.5, "px": -46.6} for p, t in vehicles]
    return line("posicao", at, {"hr": "11:50", "l": [{"c": "100-1", "cl": 7, "sl": 1, "lt0": "A", "lt1": "B", "qv": len(vs), "vs": vs}]})


def forecast(at, clocks):
    vs = [{"p": f"v{k}", "t": t, "a": False, "ta": at.isoformat().replace("+00:00", "Z"), "py": -23.5, "px": -46.6} for k, t in enumerate(clocks)]
    return line("previsao", at, {"hr": "x", "ps": [{"cp": 11, "np": "stop", "py": -23.5, "px": -46.6, "vs": vs}]}, 7, "100-1", 1)


@pytest.mark.parametrize("shift", [-3, 0])
def test_both_kinds_of_payload(spark, tmp_path, shift):
    """shift -3: clocks in local time; 0: in UTC. The zone is chosen from the batch."""
    folder = tmp_path / "in"
    folder.mkdir()
    clock = lambda t: (t + timedelta(hours=shift)).strftime("%H:%M")
    later = START + timedelta(minutes=30)
    (folder / "a.json").write_text(
        position(START, [("v1", START), ("v2", START), ("v1", START)]) + forecast(START, [clock(START + timedelta(minutes=m)) for m in (2, 9, 20)]) + line("posicao", START, {"hr": "x"}) + line("outro", START, {})
    )
    paths = [str(tmp_path / x) for x in ("pos", "fore", "ck")]
    assert L.ingest_all(spark, str(folder), *paths).awaitTermination(180)
    (folder / "b.json").write_text(position(later, [("v1", START), ("v2", later), (None, later), (None, later)]) + forecast(later, [clock(later + timedelta(minutes=5)), None]))
    assert L.ingest_all(spark, str(folder), *paths).awaitTermination(180)
    def state():
        pos, fore = (spark.read.parquet(p) for p in paths[:2])
        return sorted((r.prefixo or "", r.ta, r.lote) for r in pos.collect()), sorted((r.prefixo, r.horizonte_s or -1, r.lote) for r in fore.collect())

    have = state()
    assert [p for p, _, n in have[0] if n == 0] == ["v1", "v2"] and [p for p, _, n in have[0] if n == 1] == ["", "", "v2"]
    assert [h // 60 for _, h, n in have[1] if n == 0] == [2, 9, 20] and [h for _, h, n in have[1] if n == 1] == [300, -1]
    pos = spark.read.parquet(paths[0])
    assert set(pos.select("dt", "h").distinct().collect()[0].asDict()) == {"dt", "h"} and pos.select("h").distinct().count() == 2
    # the second batch comes again, as after a crash before its commit
    again = spark.read.schema("ts_coleta timestamp, tipo string, cl int, letreiro string, sentido int, payload string").json(str(folder / "b.json"))
    L.store_batch(again, 1, *paths[:2])
    assert state() == have
