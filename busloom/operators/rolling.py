"""Rolling statistics over a look-back in time, left-open: (t - lookback, t]."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busloom.operators.asof import asof_join, seconds_between
from busloom.operators.hot import as_number, bucketed, edges_of, is_small
from busloom.session import DENSE_WINDOW_ROWS, HOT_GROUP_ROWS, setting


def _dense(df: DataFrame, keys: list[str], time: str, lookback_s: float) -> int:
    """Rows of the input if some look-back holds too many rows for a sliding frame, else 0."""
    if is_small(df):
        return 0
    limit = setting(df.sparkSession, DENSE_WINDOW_ROWS)
    per = (
        df.groupBy(*keys, F.floor(F.unix_micros(time) / (lookback_s * 1e6)).alias("_w"))
        .agg(F.count("*").alias("_n"))
        .agg(F.max("_n").alias("m"), F.sum("_n").alias("s"))
        .head()
    )
    return int(per["s"]) if per["m"] and per["m"] > limit else 0


def rolling_median(
    df: DataFrame, keys: list[str], time: str, value: str, lookback_s: float, median: str, count: str, seen: DataFrame | None = None
) -> DataFrame:
    """Median and count of `value` over (t - lookback, t]; peers of the same instant included. `seen`: rows with the keys and
    instants of `df`, cheaper to count."""
    seen = df if seen is None else seen.select(*keys, time)
    total = _dense(seen, keys, time, lookback_s)
    if not total:
        w = (
            Window.partitionBy(*keys)
            .orderBy("_us")
            .rangeBetween(-(int(lookback_s * 1e6) - 1), 0)
        )
        return (
            df.withColumn("_us", F.unix_micros(time))
            .withColumns({median: F.percentile(value, 0.5).over(w), count: F.count(value).over(w)})
            .drop("_us")
        )
    n = max(2, 1 + total // setting(df.sparkSession, HOT_GROUP_ROWS))
    edges = edges_of(seen.select(as_number(seen, time).alias("_ord")), n)
    return _sliced_rolling(df, keys, time, value, lookback_s, median, count, edges)


def _sliced_rolling(df, keys, time, value, lookback_s, median, count, edges):
    """Every row also visits the slices its look-back reaches; pandas rolls inside a slice.

    Cost is n log w instead of n w, and a group is one slice plus its look-back.
    """
    base = df.withColumn("_ord", as_number(df, time))
    base = bucketed(base, edges, "_own")
    base = bucketed(base.withColumn("_ord", F.col("_ord") + float(lookback_s)), edges, "_last")
    rows = base.drop("_ord").withColumn("_slice", F.explode(F.sequence("_own", "_last")))
    keep = [f for f in df.schema.fields]
    schema = T.StructType(
        keep + [T.StructField(median, T.DoubleType()), T.StructField(count, T.LongType())]
    )
    names = [f.name for f in keep]

    def roll(pdf):
        lost = pdf[pdf[time].isna()]  # rows without an instant are peers of each other
        pdf = pdf[pdf[time].notna()].sort_values(time, kind="stable")
        r = pdf.set_index(time)[value].astype("float64").rolling(f"{int(lookback_s * 1e6)}us")
        # peers of one instant share the value at the last of them
        at = pdf[time].to_numpy()
        last = np.searchsorted(at, at, side="right") - 1
        pdf = pdf.assign(**{median: r.median().to_numpy()[last], count: r.count().to_numpy()[last].astype("int64")})
        if len(lost):
            pdf = pd.concat([pdf, lost.assign(**{median: lost[value].astype("float64").median(), count: lost[value].count()})])
        return pdf.loc[pdf["_own"] == pdf["_slice"], names + [median, count]]

    return rows.groupBy(*keys, "_slice").applyInPandas(roll, schema)


def recent_state(
    queries: DataFrame,
    events: DataFrame,
    by: list[str],
    query_time: str,
    event_time: str,
    value: str,
    tie: str,
    lookback_s: float,
    names: tuple[str, str, str, str],
    shift_s: float = 0.0,
) -> DataFrame:
    """Rolling median and count at the last event strictly before the query, its value and age.

    `names` = (median, count, last value, age in seconds). The event must be at most `lookback_s`
    old. With `shift_s` the query looks at the state that many seconds earlier.
    """
    med, cnt, last, age = names
    ev = events.where(F.col(value).isNotNull()).select(*by, event_time, value, tie)
    ev = rolling_median(ev, by, event_time, value, lookback_s, "_med", "_cnt")
    q = queries
    if shift_s:
        q = q.withColumn(
            "_qt", F.timestamp_micros(F.unix_micros(query_time) - int(shift_s * 1e6))
        )
    else:
        q = q.withColumn("_qt", F.col(query_time))
    out = asof_join(
        q, ev, by, "_qt", event_time,
        {med: "_med", cnt: "_cnt", last: value}, tie, lookback_s, event_time_out="_et",
    )
    return out.withColumn(age, seconds_between("_qt", "_et")).drop("_qt", "_et")
