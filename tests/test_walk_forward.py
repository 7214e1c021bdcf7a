"""Medians learnt day by day against a plain loop over the folds."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from busloom.operators.models import walk_forward


def test_every_fold_against_a_plain_median(spark):
    r = np.random.default_rng(11)
    n = 400
    pdf = pd.DataFrame({"k": r.choice(["a", "b", "c"], n, p=[0.7, 0.2, 0.1]), "d": r.choice([0, 1, 2, 5, 6, 9, 20], n), "v": r.integers(0, 30, n).astype(float), "i": np.arange(n)})
    pdf.loc[r.random(n) < 0.1, "v"] = np.nan
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["z", "z", "y"], "d": [1, 2, 3], "v": [np.nan, 1.0, 2.0], "i": [n, n + 1, n + 2]})])
    df = spark.createDataFrame(pdf).withColumns({"dia": F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")), "v": F.nanvl("v", F.lit(None).cast("double"))})
    got = walk_forward(df, "dia", [3, None], ["k"], "v").toPandas()
    want = []
    for t in pdf.itertuples():
        for w in (3, None):
            past = pdf[(pdf.k == t.k) & (pdf.d < t.d) & ((pdf.d >= t.d - w) if w else True)].v.dropna()
            if len(past):
                want.append((t.i, f"janela_{w or 'toda'}", past.median(), len(past)))
    found = sorted(got[["i", "config", "previsto", "n_treino"]].itertuples(index=False, name=None))
    assert found == sorted(want) and len(want) > 500


def test_empty_table(spark):
    df = spark.createDataFrame([], "k string, dia date, v double")
    assert walk_forward(df, "dia", [7, None], ["k"], "v").count() == 0
