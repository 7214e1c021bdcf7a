"""Boosted trees with early stopping on a fixed validation part, and evaluation loops over folds."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busloom.operators.quantiles import group_quantiles


def fit_boosted(train: DataFrame, features: list[str], label: str, loss: str = "absolute", rounds: int = 20, depth: int = 5, step: float = 0.1):
    """`train` holds `parte`: rows marked 'validacao' stop the boosting early."""
    cols = [f"_f_{c}" for c in features]
    d = train.withColumns({f"_f_{c}": F.col(c).cast("double") for c in features}).withColumn("_val", F.col("parte") == "validacao")
    stages = [
        Imputer(inputCols=cols, outputCols=[c + "_i" for c in cols], strategy="median"),
        VectorAssembler(inputCols=[c + "_i" for c in cols], outputCol="_x", handleInvalid="keep"),
    ]
    common = dict(featuresCol="_x", labelCol=label, maxIter=rounds, maxDepth=depth, stepSize=step, seed=7, validationIndicatorCol="_val", subsamplingRate=0.8)
    gbt = GBTClassifier(**common, predictionCol="classe") if loss == "logistic" else GBTRegressor(**common, lossType=loss, predictionCol="previsto")
    return Pipeline(stages=[*stages, gbt]).fit(d)


def predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    out = model.transform(df.withColumns({f"_f_{c}": F.col(c).cast("double") for c in features}))
    if "probability" in out.columns:
        out = out.withColumn("prob", vector_to_array("probability")[1])
    return out.drop(*[c for c in out.columns if c.startswith("_f_")], "_x", "probability", "rawPrediction")


def importance(model, features: list[str], spark) -> DataFrame:
    w = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(x)) for f, x in zip(features, w)), key=lambda r: -r[1])
    return spark.createDataFrame(rows, "atributo string, importancia double")


def walk_forward(df: DataFrame, day: str, windows: list[int | None], keys: list[str], value: str) -> DataFrame:
    """Median predictor re-learnt for every test day from the `w` days before it (None = all before).

    Values are counted per key and day once for all windows. The counts of a key are walked day by day: those of the days that come
    into a window are added and those that leave it taken off, so each is met twice per window, however many days follow. A key
    holds one count per day and value. Rows whose value is NULL are tested but teach nothing; days without a day before have no row.
    """
    number = F.datediff(F.col(day), F.lit("1970-01-01").cast("date"))
    counts = df.groupBy(*keys, number.alias("_d"), F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))

    def folds(pdf):
        pdf = pdf.sort_values("_d", kind="stable")
        days, known = np.unique(pdf["_d"].to_numpy()), pdf["_v"].notna().to_numpy()
        d, n = pdf["_d"].to_numpy()[known], pdf["_n"].to_numpy("int64")[known]
        values, at = np.unique(pdf["_v"].to_numpy("float64")[known], return_inverse=True)
        rows = []
        for w in windows if len(values) else []:
            held, first, last = np.zeros(len(values), "int64"), 0, 0
            for t in days:
                come = np.searchsorted(d, t)
                np.add.at(held, at[last:come], n[last:come])
                go = first if w is None else np.searchsorted(d, t - w)
                np.subtract.at(held, at[first:go], n[first:go])
                first, last = go, come
                upto = held.cumsum()
                if upto[-1]:
                    middle = values[np.searchsorted(upto, [(upto[-1] - 1) // 2, upto[-1] // 2], side="right")]
                    rows.append((t, middle.mean(), upto[-1], f"janela_{w or 'toda'}"))
        out = pd.DataFrame(rows, columns=["_d", "previsto", "n_treino", "config"], dtype=object)
        for k in reversed(keys):
            out.insert(0, k, pd.Series([pdf[k].iloc[0]] * len(out), dtype=object))
        return out

    schema = T.StructType([df.schema[k] for k in keys] + [
        T.StructField("_d", T.IntegerType()), T.StructField("previsto", T.DoubleType()), T.StructField("n_treino", T.LongType()), T.StructField("config", T.StringType())])
    ref = counts.groupBy(*keys).applyInPandas(folds, schema)
    return df.withColumns({"dia_teste": F.col(day), "_d": number}).join(ref, [*keys, "_d"]).drop("_d")


def learning_curve(df: DataFrame, day: str, test_from, ks: list[int], keys: list[str], value: str) -> DataFrame:
    """MAE on the days from `test_from` with a median learnt on the last k days before it."""
    start = F.lit(test_from).cast("date")
    train = df.where((F.col(day) < start) & (F.col(day) >= F.date_sub(start, max(ks))))
    back = F.datediff(start, F.col(day))
    t = train.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(back <= F.col("k"))
    ref = group_quantiles(t, ["k", *keys], value, {"previsto": 0.5})
    test = df.where(F.col(day) >= start).join(ref, keys)
    return test.groupBy("k").agg(F.count("*").alias("n"), F.avg(F.abs(F.col(value) - F.col("previsto"))).alias("mae_s"))


def grid_search(train: DataFrame, features: list[str], label: str, grid: dict[str, list], rounds: int = 10) -> DataFrame:
    """Error on the validation part of every combination; the choice never sees the test rows."""
    rows = []
    for values in product(*grid.values()):
        par = dict(zip(grid, values))
        model = fit_boosted(train, features, label, rounds=rounds, **par)
        val = predict(model, train.where("parte = 'validacao'"), features)
        mae = val.agg(F.avg(F.abs(F.col("previsto") - F.col(label))).alias("m")).head()["m"]
        rows.append((", ".join(f"{k}={v}" for k, v in par.items()), float(mae)))
    return train.sparkSession.createDataFrame(rows, "parametros string, mae_validacao_s double").orderBy("mae_validacao_s")


def ablation(df: DataFrame, base: list[str], groups: dict[str, list[str]], label: str, rounds: int = 10) -> DataFrame:
    """Test error of the base columns, of each group added alone, and of all groups together."""
    sets = {"base": base, **{n: base + c for n, c in groups.items()}, "todos": base + [c for g in groups.values() for c in g]}
    rows = []
    for name, cols in sets.items():
        model = fit_boosted(df.where("parte <> 'teste'"), cols, label, rounds=rounds)
        mae = predict(model, df.where("parte = 'teste'"), cols).agg(F.avg(F.abs(F.col("previsto") - F.col(label))).alias("m")).head()["m"]
        rows.append((name, len(cols), float(mae)))
    return df.sparkSession.createDataFrame(rows, "conjunto string, atributos int, mae_s double")
