"""The sliced paths give what the plain windows and pandas give."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from busloom.operators.asof import asof_join
from busloom.operators.hot import slice_groups
from busloom.operators.ordered import Ordered
from busloom.operators.quantiles import group_quantiles, summarize
from busloom.operators.rolling import rolling_median


@pytest.fixture(scope="module")
def rows(spark):
    r = np.random.default_rng(3)
    n = 600
    k = np.where(r.random(n) < 0.5, "hot", r.integers(0, 40, n).astype(str))
    t = pd.to_datetime("2024-01-01") + pd.to_timedelta(r.integers(0, 4000, n), unit="s")  # ties on purpose
    v = r.integers(-50, 50, n).astype(float)
    pdf = pd.DataFrame({"k": k, "t": t, "i": np.arange(n), "v": v})
    return pdf, spark.createDataFrame(pdf)


def test_hot_group_is_sliced(rows, hot):
    cut = slice_groups(rows[1], ["k"], "t")
    assert cut.hot
    size = cut.df.groupBy("k", "_slice").count().toPandas()
    assert size["count"].max() < 200 and len(size[size.k == "hot"]) > 3
    assert (size[size.k != "hot"]["_slice"] == 0).all()


def test_ordered_operations(rows, hot):
    pdf, df = rows
    o = Ordered(df, ["k"], ["t", "i"]).lag({"l1": "v"}).lag({"l3": "v"}, 3).lead({"n2": "v"}, 2)
    o.running_sum({"s": "v"}).running_sum({"b": "v"}, current=False).row_number("rn")
    o.last_seen({"seen": F.when(F.col("v") > 30, F.col("v"))})
    assert o.hot
    got = o.df.toPandas().sort_values("i").reset_index(drop=True)
    p = pdf.sort_values(["k", "t", "i"])
    g = p.groupby("k")["v"]
    want = p.assign(l1=g.shift(1), l3=g.shift(3), n2=g.shift(-2), s=g.cumsum(), rn=g.cumcount() + 1)
    want["b"] = want.groupby("k")["s"].shift(1)
    want["seen"] = p.assign(w=p.v.where(p.v > 30)).groupby("k")["w"].ffill()
    want = want.sort_values("i").reset_index(drop=True)
    for c in ("l1", "l3", "n2", "s", "b", "rn", "seen"):
        pd.testing.assert_series_equal(got[c].astype(float), want[c].astype(float), check_names=False, obj=c)


def test_quantiles(rows, hot):
    pdf, df = rows
    for keys in (["k"], []):
        got = group_quantiles(df, keys, "v", {"a": 0.1, "m": 0.5, "z": 0.9}, "n").toPandas()
        q = (pdf.groupby("k")["v"] if keys else pdf["v"]).quantile([0.1, 0.5, 0.9])
        want = q.unstack() if keys else q.to_frame().T
        got = got.sort_values(keys) if keys else got
        np.testing.assert_allclose(got[["a", "m", "z"]].to_numpy(float), want.to_numpy(float))
    s = summarize(df, ["k"], [F.count("*").alias("n")], {"v": {"m": 0.5}}).toPandas()
    assert s.set_index("k")["m"].to_dict() == pdf.groupby("k")["v"].median().to_dict()


@pytest.mark.parametrize("direction,exact", [("backward", False), ("backward", True), ("forward", True)])
def test_asof(rows, hot, direction, exact):
    pdf, df = rows
    ev = pdf[pdf.i % 2 == 0].drop_duplicates(["k", "t"])
    q = pdf[pdf.i % 2 == 1]
    d_ev, d_q = df.join(df.sparkSession.createDataFrame(ev[["i"]]), "i"), df.where("i % 2 = 1").select("k", "t", "i")
    got = asof_join(d_q, d_ev, ["k"], "t", "t", {"m": "v"}, "i", 300, direction, exact).toPandas().sort_values("i")
    a = q.sort_values("t")[["k", "t", "i"]]
    want = pd.merge_asof(a, ev.sort_values("t")[["k", "t", "v"]], on="t", by="k", direction=direction, allow_exact_matches=exact, tolerance=pd.Timedelta("300s")).sort_values("i")
    np.testing.assert_array_equal(got["m"].to_numpy(float), want["v"].to_numpy(float))


def test_rolling(rows, hot):
    pdf, df = rows
    got = rolling_median(df, ["k"], "t", "v", 600, "m", "n").toPandas().sort_values("i").reset_index(drop=True)
    out = []
    for r in pdf.itertuples():
        w = pdf[(pdf.k == r.k) & (pdf.t <= r.t) & (pdf.t > r.t - pd.Timedelta("600s"))].v
        out.append((w.median(), len(w)))
    np.testing.assert_allclose(got[["m", "n"]].to_numpy(float), np.array(out, float))
