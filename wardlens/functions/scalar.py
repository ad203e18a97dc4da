"""Scalar column expressions.

Everything here returns a native Spark ``Column``: no Python UDF, so the
expressions stay inside whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardlens.functions.timecalc import round_ratio


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket_values(col: Column | str, mapping: Mapping[str, Iterable[str]],
                  default: str = "OTHER") -> Column:
    """CASE col IN (...) THEN bucket ... ELSE default (NULL -> default)."""
    c = _c(col)
    expr = None
    for bucket, values in mapping.items():
        cond = c.isin(list(values))
        expr = F.when(cond, F.lit(bucket)) if expr is None else expr.when(cond, F.lit(bucket))
    return F.lit(default) if expr is None else expr.otherwise(F.lit(default))


def open_interval_flag(col: Column | str, low: float, high: float) -> Column:
    """1 if low < col < high else 0 (NULL -> 0)."""
    c = _c(col)
    return F.when((c > low) & (c < high), F.lit(1)).otherwise(F.lit(0)).cast("int")


def age_years(start: Column | str, birth: Column | str, year_days_milli: int = 365242) -> Column:
    """Whole days between the two dates / (year_days_milli / 1000), 2 decimals.

    Rounded half away from zero on integers (exact), returned as double.
    """
    days = F.datediff(F.to_date(_c(start)), F.to_date(_c(birth))).cast("bigint")
    centi = round_ratio(days * F.lit(100000), year_days_milli)
    return (centi / F.lit(100.0)).alias("age")


def not_equal_keep_null(col: Column | str, value) -> Column:
    """Pandas-style ``col != value`` that keeps NULL rows."""
    return ~_c(col).eqNullSafe(F.lit(value))


def title_flag(col: Column | str, suffix: str) -> Column:
    """1 if lower(col) ends with ``suffix`` (LIKE '%suffix') else 0."""
    return F.when(F.lower(_c(col)).endswith(suffix.lower()), 1).otherwise(0).cast("int")


def in_set_flag(col: Column | str, codes: Iterable[str], lower: bool = False) -> Column:
    """1 if the code is in the set else 0 (NULL -> 0)."""
    c = F.lower(_c(col)) if lower else _c(col)
    return F.when(c.isin(list(codes)), 1).otherwise(0).cast("int")


def band(col: Column | str, intervals: Sequence[tuple[float, float, int]], default: int) -> Column:
    """Right-closed bands ``(lo, hi] -> value``; anything else -> default."""
    c = _c(col)
    expr = None
    for lo, hi, val in intervals:
        cond = (c > lo) & (c <= hi)
        expr = F.when(cond, F.lit(val)) if expr is None else expr.when(cond, F.lit(val))
    return expr.otherwise(F.lit(default)).cast("int")


def category_by_substring(col: Column | str, rules: Sequence[tuple[str, str]],
                          default: str = "OTHER") -> Column:
    """first rule whose substring occurs in the value wins; else default."""
    c = _c(col)
    expr = None
    for needle, label in rules:
        cond = c.contains(needle)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(F.lit(default))


def fill_missing(col: Column | str, value: str = "Missing") -> Column:
    """NULL -> 'Missing'."""
    return F.coalesce(_c(col), F.lit(value))


def zscore_word(x: Column | str, mean: Column | str, std: Column | str, limit: int = 4) -> Column:
    """clip(round_half_even((x - mean) / std), -limit, limit) as int.

    NULL stands for the missing word.  A zero or undefined deviation gives
    NULL when x equals the mean (0/0) and +-limit otherwise (x/0 = +-inf,
    clipped), as a float pipeline would; ANSI division errors never occur.
    """
    xc, mc, sc = _c(x), _c(mean), _c(std)
    diff = xc - mc
    z = F.bround(F.try_divide(diff, sc), 0)
    clipped = F.greatest(F.lit(-limit).cast("double"), F.least(F.lit(limit).cast("double"), z))
    zero_std = sc.isNotNull() & (sc == 0)
    return (F.when(xc.isNull() | mc.isNull() | sc.isNull(), F.lit(None))
            .when(zero_std & (diff == 0), F.lit(None))
            .when(zero_std, F.signum(diff) * limit)
            .otherwise(clipped)).cast("int")
