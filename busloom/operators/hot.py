"""Finding and slicing hot groups.

A window over a key sorts all rows of the key in one task. That is right for the usual vehicle or
segment, and wrong for the one key that holds a third of the data. Here such keys are found by a
pre-aggregated count and cut into slices along the order column, with edges of about equal depth.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from busloom.session import HOT_GROUP_ROWS, SMALL_INPUT_BYTES, cut_lineage, setting

MAX_SLICES = 20_000
BUCKETS = 1 << 16


def leaf_bytes(df: DataFrame) -> int:
    """Bytes of the leaves of the plan, as estimated by Spark (file sizes for scans)."""
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    found = [leaves.apply(i) for i in range(leaves.size())]
    # a reference to a common table expression repeats leaves already counted at its definition
    return sum(int(x.stats().sizeInBytes()) for x in found if x.nodeName() != "CTERelationRef")


def is_small(df: DataFrame) -> bool:
    return leaf_bytes(df) <= setting(df.sparkSession, SMALL_INPUT_BYTES)


def none_above(keys: DataFrame, limit: int) -> bool:
    """Whether no key occurs in more than `limit` rows. Keys are counted by buckets of their hash, a few numbers to shuffle however
    many keys there are; a bucket holds at least as many rows as each of its keys, so False may be wrong and True is not."""
    bucket = F.pmod(F.xxhash64(*keys.columns), F.lit(BUCKETS)).alias("_b")
    return keys.groupBy(bucket).agg(F.count("*").alias("_n")).where(F.col("_n") > limit).isEmpty()


def as_number(df: DataFrame, name: str) -> Column:
    """The order column as a double; timestamps in seconds."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return (F.unix_micros(c.cast("timestamp")) / F.lit(1e6)).cast("double")
    if isinstance(kind, T.DateType):
        return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("double")
    return c.cast("double")


def null_safe(keys: list[str], left: DataFrame, right: DataFrame) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right["_hot_" + k])
    return cond


@dataclass
class Sliced:
    df: DataFrame  # with _slice (0 for groups that are not hot)
    hot: bool


def edges_of(df: DataFrame, n: int) -> list[float]:
    """Equal-depth edges of column _ord: n - 1 numbers at most, whatever the data size."""
    probs = [i / n for i in range(1, n)]
    if not probs:
        return []
    row = df.agg(F.percentile_approx("_ord", probs, 10 * n).alias("e")).head()
    return sorted(set(row["e"] or []))


def bucketed(df: DataFrame, edges: list[float], out: str = "_slice") -> DataFrame:
    splits = [float("-inf"), *edges, float("inf")]
    return (
        Bucketizer(splits=splits, inputCol="_ord", outputCol="_hot_bucket", handleInvalid="keep")
        .transform(df)
        .withColumn(out, F.coalesce(F.col("_hot_bucket").cast("int"), F.lit(-1)))
        .drop("_hot_bucket")
    )


def slice_groups(df: DataFrame, keys: list[str], order: str, always: bool = False, bound: DataFrame | None = None) -> Sliced:
    """Add `_slice`. With `always` (or no keys) the whole input is sliced. `bound` has some of the keys alone and at least as
    many rows of each: where none of its groups is hot, none of `df` is, and `df` isn't counted."""
    spark = df.sparkSession
    limit = setting(spark, HOT_GROUP_ROWS)
    if not keys or always:
        n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
        if not is_small(df):
            n = min(MAX_SLICES, max(n, ceil(df.count() / limit)))
        base = df.withColumn("_ord", as_number(df, order))
        return Sliced(bucketed(base, edges_of(base, n)).drop("_ord"), True)
    if is_small(df):
        return Sliced(df.withColumn("_slice", F.lit(0)), False)
    if none_above(df.select(*keys) if bound is None else bound, limit):
        return Sliced(df.withColumn("_slice", F.lit(0)), False)
    # at most rows / limit keys, read by each of the steps below
    counts = cut_lineage(df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > limit))
    total = counts.agg(F.sum("_n").alias("s")).head()["s"]
    if not total:
        return Sliced(df.withColumn("_slice", F.lit(0)), False)
    # small by construction, left to Spark to broadcast
    hot = counts.select(*[F.col(k).alias("_hot_" + k) for k in keys], F.lit(True).alias("_is_hot"))
    marked = df.join(hot, null_safe(keys, df, hot), "left").drop(*hot.columns[:-1])
    marked = marked.withColumn("_ord", as_number(df, order))
    n = min(MAX_SLICES, 1 + ceil(2 * total / limit))
    edges = edges_of(marked.where("_is_hot"), n)
    out = bucketed(marked, edges).withColumn(
        "_slice", F.when(F.col("_is_hot"), F.col("_slice")).otherwise(F.lit(0))
    )
    return Sliced(out.drop("_is_hot", "_ord"), True)
