"""Local calendar of the study as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from busloom.config import LOCAL_TZ


def local(ts, tz: str = LOCAL_TZ) -> Column:
    return F.from_utc_timestamp(F.col(ts) if isinstance(ts, str) else ts, tz)


def local_hour(ts) -> Column:
    return F.hour(local(ts))


def local_weekday(ts) -> Column:
    """Monday = 0."""
    return F.weekday(local(ts))


def local_date(ts) -> Column:
    return F.to_date(local(ts))


def day_part(hour) -> Column:
    h = F.col(hour) if isinstance(hour, str) else hour
    return (
        F.when(h < 6, "madrugada")
        .when(h < 9, "pico_manha")
        .when(h < 16, "entrepico")
        .when(h < 20, "pico_tarde")
        .otherwise("noite")
    )


def is_peak(part) -> Column:
    p = F.col(part) if isinstance(part, str) else part
    return p.isin("pico_manha", "pico_tarde")


def day_type(ts, holidays: list[str] | tuple[str, ...] = ()) -> Column:
    """'util', 'sabado' or 'domingo' (Sundays and the given yyyy-MM-dd holidays)."""
    d = local_date(ts)
    off = d.cast("string").isin(list(holidays)) if holidays else F.lit(False)
    return (
        F.when(off | (F.weekday(d) == 6), "domingo").when(F.weekday(d) == 5, "sabado").otherwise("util")
    )


def holiday_mmdd(ts, days) -> Column:
    return F.date_format(local(ts), "MM-dd").isin(list(days))


def clock_ok(text) -> Column:
    """Whether a text reads as HH:MM[:SS]."""
    t = F.trim(F.col(text) if isinstance(text, str) else text)
    return t.rlike(r"^([01]?\d|2[0-3]):[0-5]?\d(:[0-5]?\d)?$")


def resolve_clock(text, anchor, tz: str | None = LOCAL_TZ) -> Column:
    """HH:MM[:SS] near an instant: more than 90 min behind rolls a day on, 12 h ahead a day back."""
    text = F.col(text) if isinstance(text, str) else text
    anchor = F.col(anchor) if isinstance(anchor, str) else anchor
    hms = F.split(F.trim(text), ":")
    ok = clock_ok(text)
    h, m = F.get(hms, F.lit(0)).try_cast("int"), F.get(hms, F.lit(1)).try_cast("int")
    s = F.coalesce(F.get(hms, F.lit(2)).try_cast("int"), F.lit(0))
    base = F.date_trunc("day", local(anchor, tz) if tz else anchor)
    day_s = 86_400 * 1_000_000
    us = F.unix_micros(base) + (h * 3600 + m * 60 + s).cast("long") * F.lit(1_000_000)
    wall = F.timestamp_micros(us)
    utc_us = F.unix_micros(F.to_utc_timestamp(wall, tz) if tz else wall)
    gap = utc_us - F.unix_micros(anchor)
    days = F.when(gap < -90 * 60 * 1_000_000, 1).when(gap > 12 * 3600 * 1_000_000, -1).otherwise(0)
    fixed = utc_us + days * F.lit(day_s)
    return F.when(ok, F.timestamp_micros(fixed))


def inside_window(ts, start: str, end: str) -> Column:
    """Local clock inside [start, end), wrapping past midnight; equal bounds mean always."""
    if start == end:
        return F.lit(True)
    clock = F.date_format(local(ts), "HH:mm")
    if start < end:
        return (clock >= start) & (clock < end)
    return (clock >= start) | (clock < end)
