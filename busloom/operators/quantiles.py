"""Exact quantiles with linear interpolation, safe for hot groups.

`percentile` keeps a map of all distinct values of a group in one task. For hot groups the values
are counted first, ranked across slices, and only the rows at the wanted ranks are kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators.hot import is_small, none_above, slice_groups
from busloom.operators.ordered import Ordered
from busloom.session import HOT_GROUP_ROWS, cut_round, setting


def _native(df, keys, value, probs, count, weight=None):
    times = 1 if weight is None else F.col(weight)
    aggs = [F.percentile(value, p, times).alias(o) for o, p in probs.items()]
    if count:
        aggs.append((F.count(value) if weight is None else F.sum(F.when(F.col(value).isNotNull(), times))).alias(count))
    return df.groupBy(*keys).agg(*aggs)


def ranked_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float], count=None, weight: str | None = None):
    """Quantiles by distributed rank: no task ever sees a whole group. `weight`: how many times a row counts."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("_n"))
    )
    cum = Ordered(counted, keys, [value]).running_sum({"_hi": F.col("_n")}).df
    cum = cum.withColumn("_lo", F.col("_hi") - F.col("_n"))  # ranks _lo .. _hi - 1
    totals = counted.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    if keys:
        cond = reduce(lambda a, b: a & b, [cum[k].eqNullSafe(totals[k]) for k in keys])
        j = cum.join(totals, cond).select(*[cum[k] for k in keys], value, "_lo", "_hi", "_total")
    else:
        j = cum.crossJoin(F.broadcast(totals))  # one row
    aggs = []
    for o, p in probs.items():
        pos = (F.col("_total") - 1) * F.lit(float(p))
        for tag, at in (("l", F.floor(pos)), ("h", F.ceil(pos))):
            hit = (F.col("_lo") <= at) & (at < F.col("_hi"))
            aggs.append(F.max(F.when(hit, F.col(value))).cast("double").alias(f"_{tag}_{o}"))
        aggs.append(F.max(pos - F.floor(pos)).alias(f"_f_{o}"))
    aggs.append(F.max("_total").alias("_total"))
    out = j.groupBy(*keys).agg(*aggs)
    cols = [
        (F.col(f"_l_{o}") + (F.col(f"_h_{o}") - F.col(f"_l_{o}")) * F.col(f"_f_{o}")).alias(o)
        for o in probs
    ]
    if count:
        cols.append(F.col("_total").alias(count))
    return out.select(*keys, *cols)


def group_quantiles(
    df: DataFrame, keys: list[str], value: str, probs: dict[str, float], count: str | None = None, bound: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """One row per key with the named quantiles of `value` (nulls ignored). `bound`: see `any_hot`. `weight`: how many times a row counts."""
    df = df.select(*keys, value, *([weight] if weight else []))
    if not any_hot(df, keys, [value], bound):
        return _native(df, keys, value, probs, count, weight)
    if not keys:
        return ranked_quantiles(df, keys, value, probs, count, weight)
    limit = setting(df.sparkSession, HOT_GROUP_ROWS)
    # at most rows / limit hot keys
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit)
    ks = hot.select(*[F.col(k).alias("_hot_" + k) for k in keys])
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col("_hot_" + k)) for k in keys])
    cold_part = _native(df.join(ks, cond, "left_anti"), keys, value, probs, count, weight)
    hot_part = ranked_quantiles(df.join(ks, cond, "left_semi"), keys, value, probs, count, weight)
    return cold_part.unionByName(hot_part)


def _join_null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    if not keys:
        return a.crossJoin(F.broadcast(b))  # one row each
    b = b.withColumnsRenamed({k: "_j_" + k for k in keys})
    cond = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col("_j_" + k)) for k in keys])
    return a.join(b, cond, "left").drop(*["_j_" + k for k in keys])


def any_hot(df: DataFrame, keys: list[str], values: list[str], bound: DataFrame | None = None) -> bool:
    """Whether some group has more different values than the hot limit; free for inputs known to be small.

    `percentile` keeps each value once with its count, so many rows of few values are no burden, and without values none is hot. Values are estimated only where
    some group has the rows for it; `bound` has some of the keys alone and at least as many rows of each, and is cheaper to count.
    """
    if not values or is_small(df):
        return False
    limit = setting(df.sparkSession, HOT_GROUP_ROWS)
    if keys and none_above(df.select(*keys) if bound is None else bound, limit // 2):
        return False
    n = df.groupBy(*keys).agg(*[F.approx_count_distinct(v).alias(f"_n{i}") for i, v in enumerate(values)])
    # an estimate, so from half the limit on
    return not n.where(F.greatest(F.lit(0), *[F.col(f"_n{i}") for i in range(len(values))]) > limit / 2).isEmpty()


def summarize(
    df: DataFrame, keys: list[str], aggs: list, quantiles: dict[str, dict[str, float]], bound: DataFrame | None = None, weight: str | None = None
) -> DataFrame:
    """Plain aggregates and exact quantiles of several columns by key. `weight`: how many times a row counts in the quantiles.

    One pass and one shuffle unless a group is hot; then each column is ranked across slices.
    """
    if not any_hot(df, keys, list(quantiles), bound):
        times = 1 if weight is None else F.col(weight)
        q = [F.percentile(v, p, times).alias(o) for v, names in quantiles.items() for o, p in names.items()]
        return df.groupBy(*keys).agg(*aggs, *q)
    out = df.groupBy(*keys).agg(*aggs)
    for v, names in quantiles.items():
        out = _join_null_safe(out, group_quantiles(df, keys, v, names, weight=weight), keys)
    return out


def with_group_median(
    df: DataFrame, keys: list[str], value: str, out: str, count: str | None = None, where=None, bound: DataFrame | None = None,
    store: bool = False,
) -> DataFrame:
    """Join each row with the median of its group, optionally from a subset of the rows.

    Values are counted first: from some groups a task on, `percentile` sorts its input rows, and of counts there are few.
    `store`: the medians are stored with their real size, for a result that is read more than once.
    """
    src = df if where is None else df.where(where)
    times = src.groupBy(*keys, value).agg(F.count("*").alias("_times"))
    ref = group_quantiles(times, keys, value, {out: 0.5}, count, bound, "_times")
    if store:
        ref = cut_round(ref)
    return df.join(ref, keys, "left")


__all__ = ["group_quantiles", "ranked_quantiles", "with_group_median", "slice_groups"]
