"""Time buckets: the ladder of widths and zone-aware bucket starts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MS, SEC, MIN, HOUR, DAY = 10**6, 10**9, 60 * 10**9, 3600 * 10**9, 86400 * 10**9
# The widths a reader can name.
LADDER = (
    MS, 10 * MS, 100 * MS, 250 * MS, 500 * MS, SEC, 5 * SEC, 10 * SEC, 30 * SEC, MIN, 5 * MIN, 10 * MIN, 15 * MIN, 30 * MIN, HOUR, 3 * HOUR, 6 * HOUR, 12 * HOUR, DAY,
)


def width_of(span_ns: int | None, target: int | None) -> int | None:
    """The narrowest rung that cuts the span into at most ``target`` whole buckets; beyond a day, fractional days as the reference rounds them."""
    if not target or target <= 0 or span_ns is None or span_ns <= 0:
        return None
    for w in LADDER:
        if span_ns // w <= target:
            return w
    return round((span_ns / DAY / target + 1) * DAY)


def width_column(span: Column, target: Column) -> Column:
    """``width_of`` as an expression: whole buckets are counted exactly, a width half-way between two nanoseconds is the even one."""
    fits = F.filter(F.array(*(F.lit(w).cast("long") for w in LADDER)), lambda w: floor_div(span, w) <= target)
    over = F.rint((span / F.lit(float(DAY)) / target + 1) * F.lit(float(DAY))).cast("long")
    return F.when((target > 0) & (span > 0), F.coalesce(F.array_min(fits), over))


def floor_div(a: Column, b: Column | int) -> Column:
    """Exact floor division of longs (a double quotient would be lossy above 2**53)."""
    b = F.lit(b).cast("long") if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)


def floor_to(a: Column, width: Column | int) -> Column:
    """The largest multiple of ``width`` not above ``a``."""
    w = F.lit(width).cast("long") if isinstance(width, int) else width
    return a - F.pmod(a, w)


def _stamp(ns: Column) -> Column:
    return F.timestamp_micros(floor_div(ns, 1000))


def zone_offset(ns: Column, zone: str | None) -> Column:
    """Offset of a zone at an instant, in ns; null without a zone. The session zone must be UTC."""
    return zone_offset_at(_stamp(ns), zone)


def zone_offset_at(t: Column, zone: str | None) -> Column:
    """``zone_offset`` of a timestamp, which may lie beyond the ns of a long (1677 to 2262)."""
    if zone is None:
        return F.lit(None).cast("long")
    return (F.unix_micros(F.from_utc_timestamp(t, zone)) - F.unix_micros(t)) * 1000


def to_local(ns: Column, zone: str | None, fallback: int = 0) -> Column:
    return ns + F.coalesce(zone_offset(ns, zone), F.lit(fallback).cast("long"))


def to_utc(local: Column, zone: str | None, fallback: int = 0) -> Column:
    """The instant of a wall time. Of two (an hour that is repeated) it is the later one.

    The engine's own conversion gives the earlier one; the offset a day later tells what
    the zone's clock does after the change, and is used where it maps back to the same
    wall time later on.
    """
    if zone is None:
        return local - F.lit(fallback).cast("long")
    wall = _stamp(local)
    first = F.unix_micros(F.to_utc_timestamp(wall, zone))
    after = F.timestamp_micros(first + 86_400_000_000)
    offset = F.unix_micros(F.from_utc_timestamp(after, zone)) - F.unix_micros(after)
    other = F.unix_micros(wall) - offset
    back = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(other), zone))
    chosen = F.when((back == F.unix_micros(wall)) & (other > first), other).otherwise(first)
    return chosen * 1000


def bucket_start(ns: Column, width: int, zone: str | None = None, fallback: int = 0) -> Column:
    """Start of an instant's bucket: floored in the viewer's local time, given in UTC."""
    return to_utc(floor_to(to_local(ns, zone, fallback), width), zone, fallback)
