"""Ordered operations inside a key: lag, lead, running sums, row numbers, last seen value.

Plain windows while no key is hot. Otherwise each (key, slice) is one window group and what
crosses a slice border travels through a summary of one row per (key, slice).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from busloom.operators.hot import slice_groups


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


class Ordered:
    """`df` ordered by `order` inside `keys`; `order` must end in a unique column."""

    def __init__(self, df: DataFrame, keys: list[str], order: list[str], descending: bool = False, bound: DataFrame | None = None):
        self.keys, self.order, self.desc = list(keys), list(order), descending
        cut = slice_groups(df, self.keys, self.order[0], bound=bound)
        self.rows, self.hot = cut.df, cut.hot

    @property
    def df(self) -> DataFrame:
        return self.rows.drop("_slice")

    # -- windows
    def _sorted(self, *names: str) -> list[Column]:
        return [F.col(n).desc() if self.desc else F.col(n).asc() for n in names]

    def _inside(self):
        part = [*self.keys, "_slice"] if self.hot else self.keys
        return Window.partitionBy(*part).orderBy(*self._sorted(*self.order))

    def _across(self):
        # one row per slice: bounded by the number of slices
        part = self.keys or [F.lit(1)]
        return Window.partitionBy(*part).orderBy(*self._sorted("_slice"))

    def _attach(self, summary: DataFrame, names: list[str]) -> DataFrame:
        on = [*self.keys, "_slice"]
        right = summary.select(*[F.col(c).alias("_r_" + c) for c in on], *names)
        cond = F.lit(True)
        for c in on:
            cond = cond & F.col(c).eqNullSafe(F.col("_r_" + c))
        return self.rows.join(right, cond, "left").drop(*["_r_" + c for c in on])

    def _edge(self):
        """Aggregate that picks the last struct of a slice in the current direction."""
        key = F.struct(*self.order)
        return (lambda v: F.min_by(v, key)) if self.desc else (lambda v: F.max_by(v, key))

    # -- operations
    def lag(self, values: dict[str, str | Column], k: int = 1) -> "Ordered":
        w = self._inside()
        cols = {o: _col(c) for o, c in values.items()}
        if not self.hot:
            self.rows = self.rows.withColumns({o: F.lag(c, k).over(w) for o, c in cols.items()})
            return self
        names = list(cols)
        for step in range(k):
            src = cols if step == 0 else {o: F.col("_v_" + o) for o in names}
            self.rows = self.rows.withColumns({"_s_" + o: c for o, c in src.items()})
            tails = (
                self.rows.groupBy(*self.keys, "_slice")
                .agg(self._edge()(F.struct(*["_s_" + o for o in names])).alias("_t"))
                .withColumn("_c", F.lag("_t").over(self._across()))
            )
            self.rows = self._attach(tails, ["_c"])
            first = F.row_number().over(w) == 1
            self.rows = self.rows.withColumns(
                {
                    "_v_" + o: F.when(first, F.col("_c._s_" + o)).otherwise(
                        F.lag("_s_" + o).over(w)
                    )
                    for o in names
                }
            ).drop("_c", *["_s_" + o for o in names])
        self.rows = self.rows.withColumns({o: F.col("_v_" + o) for o in names}).drop(
            *["_v_" + o for o in names]
        )
        return self

    def lead(self, values: dict[str, str | Column], k: int = 1) -> "Ordered":
        if not self.hot:
            w = self._inside()
            self.rows = self.rows.withColumns(
                {o: F.lead(_col(c), k).over(w) for o, c in values.items()}
            )
            return self
        self.desc = not self.desc
        self.lag(values, k)
        self.desc = not self.desc
        return self

    def running_sum(self, values: dict[str, str | Column], current: bool = True) -> "Ordered":
        """Sum of all rows up to this one (or up to the one before)."""
        last = 0 if current else -1
        w = self._inside().rowsBetween(Window.unboundedPreceding, last)
        cols = {o: _col(c) for o, c in values.items()}
        if not self.hot:
            self.rows = self.rows.withColumns({o: F.sum(c).over(w) for o, c in cols.items()})
            return self
        self.rows = self.rows.withColumns({"_s_" + o: c for o, c in cols.items()})
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        totals = (
            self.rows.groupBy(*self.keys, "_slice")
            .agg(*[F.sum("_s_" + o).alias("_t_" + o) for o in cols])
            .withColumns({"_c_" + o: F.sum("_t_" + o).over(before) for o in cols})
        )
        self.rows = self._attach(totals, ["_c_" + o for o in cols])
        out = {}
        for o in cols:
            own, carry = F.sum("_s_" + o).over(w), F.col("_c_" + o)
            out[o] = F.when(own.isNull(), carry).otherwise(own + F.coalesce(carry, F.lit(0)))
        self.rows = self.rows.withColumns(out).drop(
            *[p + o for o in cols for p in ("_s_", "_c_")]
        )
        return self

    def row_number(self, out: str) -> "Ordered":
        return self.running_sum({out: F.lit(1).cast("long")})

    def last_seen(self, values: dict[str, str | Column]) -> "Ordered":
        """Latest non-null value at or before the row."""
        w = self._inside().rowsBetween(Window.unboundedPreceding, 0)
        cols = {o: _col(c) for o, c in values.items()}
        if not self.hot:
            self.rows = self.rows.withColumns(
                {o: F.last(c, ignorenulls=True).over(w) for o, c in cols.items()}
            )
            return self
        self.rows = self.rows.withColumns({"_s_" + o: c for o, c in cols.items()})
        before = self._across().rowsBetween(Window.unboundedPreceding, -1)
        pick = F.min_by if self.desc else F.max_by
        tails = self.rows.groupBy(*self.keys, "_slice").agg(
            *[
                pick(
                    F.struct(F.col("_s_" + o).alias("v")),
                    F.when(F.col("_s_" + o).isNotNull(), F.struct(*self.order)),
                ).alias("_t_" + o)
                for o in cols
            ]
        )
        tails = tails.withColumns(
            {"_c_" + o: F.last(F.col(f"_t_{o}.v"), ignorenulls=True).over(before) for o in cols}
        )
        self.rows = self._attach(tails, ["_c_" + o for o in cols])
        self.rows = self.rows.withColumns(
            {
                o: F.coalesce(F.last("_s_" + o, ignorenulls=True).over(w), F.col("_c_" + o))
                for o in cols
            }
        ).drop(*[p + o for o in cols for p in ("_s_", "_c_")])
        return self


def lagged(df, keys, order, values, k=1, bound=None) -> DataFrame:
    return Ordered(df, keys, order, bound=bound).lag(values, k).df


def numbered(df, keys, order, out="rn") -> DataFrame:
    return Ordered(df, keys, order).row_number(out).df


def latest_per_key(df: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """One row per key, the highest by `order`; Spark keeps one row per key before the shuffle, and only the columns read later."""
    w = Window.partitionBy(*keys).orderBy(*[_col(c).desc_nulls_last() for c in order])
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").select(*df.columns)
