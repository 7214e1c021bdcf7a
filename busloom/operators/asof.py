"""As-of joins: the latest event before a query, or the first one after it.

One union and one ordered pass per key, so both sides shuffle once and nothing is paired up.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from busloom.operators.ordered import Ordered


def micros(c) -> F.Column:
    return F.unix_micros(F.col(c) if isinstance(c, str) else c)


def seconds_between(later, earlier):
    """Difference in seconds as a double, exact to the microsecond."""
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def asof_join(
    queries: DataFrame,
    events: DataFrame,
    by: list[str],
    query_time: str,
    event_time: str,
    values: dict[str, str],
    tie: str,
    tolerance_s: float | None = None,
    direction: str = "backward",
    exact: bool = False,
    event_time_out: str | None = None,
    bound: DataFrame | None = None,
) -> DataFrame:
    """Queries with the columns `values` (output name -> event column) of the matched event.

    `exact` lets an event at the very instant of the query match. `tie` orders events of one
    instant: backward takes the highest, forward the lowest. The tolerance is inclusive. `bound` has
    at least as many rows of each key as both sides and is cheaper to count.

    Every column travels by itself, an event's wrapped so that its NULLs are seen: what nobody reads later is never shuffled.
    """
    forward = direction == "forward"
    # backward: the query sorts before same-instant events unless exact; forward: mirrored
    q_side = 1 if exact != forward else 0
    e_side = 1 - q_side
    qcols = [c for c in queries.columns if c not in by]
    ecols = list(dict.fromkeys([event_time, *values.values()]))
    q = queries.select(
        *by,
        F.col(query_time).alias("_t"),
        F.lit(q_side).alias("_side"),
        F.lit(None).cast(events.schema[tie].dataType).alias("_tie"),
        *[F.col(c).alias("_q_" + c) for c in qcols],
    )
    e = events.where(F.col(event_time).isNotNull()).select(
        *by,
        F.col(event_time).alias("_t"),
        F.lit(e_side).alias("_side"),
        F.col(tie).alias("_tie"),
        *[F.struct(F.col(c).alias("v")).alias("_e_" + c) for c in ecols],
    )
    both = q.unionByName(e, allowMissingColumns=True)
    seen = Ordered(both, by, ["_t", "_side", "_tie"], descending=forward, bound=bound).last_seen({"_m_" + c: "_e_" + c for c in ecols}).df
    found = F.col(f"_m_{event_time}.v")
    gap = seconds_between("_t", found)
    ok = found.isNotNull()
    if tolerance_s is not None:
        ok = ok & (F.abs(gap) <= F.lit(float(tolerance_s)))
    out = {o: F.when(ok, F.col(f"_m_{c}.v")) for o, c in values.items()}
    if event_time_out:
        out[event_time_out] = F.when(ok, found)
    return (
        seen.where(F.col("_side") == q_side)
        .select(*by, *[F.col("_q_" + c).alias(c) for c in qcols], *[c.alias(o) for o, c in out.items()])
        .select(*queries.columns, *out)
    )
