"""Elapsed-time expressions.

Elapsed time is counted in whole minutes (seconds are dropped, as reading only
the DAY/HOUR/MINUTE parts of an interval does), then scaled.  Rounding of the
scaled value is done on integers, so the result is exact and equal in every
engine: ``round_half_away(m / d) = sign(m) * ((2|m| + d) div 2d)``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_between(later: Column | str, earlier: Column | str) -> Column:
    """Whole minutes from ``earlier`` to ``later``, truncated toward zero."""
    return F.timestamp_diff("MINUTE", _c(earlier), _c(later))


def round_ratio(num: Column, den: int) -> Column:
    """Integer nearest to ``num / den``, ties away from zero (exact)."""
    a = F.abs(num)
    q = F.floor((a * 2 + F.lit(den)) / F.lit(2 * den))
    return (F.signum(num) * q).cast("bigint")


def days_since(ts: Column | str, origin: Column | str) -> tuple[Column, Column]:
    """(days_raw, days): fractional days and days rounded half away from zero."""
    m = minutes_between(ts, origin)
    return (m / F.lit(1440.0)), round_ratio(m, 1440)


def hours_since(ts: Column | str, origin: Column | str) -> tuple[Column, Column]:
    """(hours_raw, hours_in): fractional hours and hours rounded half away from zero."""
    m = minutes_between(ts, origin)
    return (m / F.lit(60.0)), round_ratio(m, 60)


def event_date(ts: Column | str) -> Column:
    """Calendar date of a timestamp."""
    return F.to_date(_c(ts))


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x
