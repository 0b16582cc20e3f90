"""Rolling functions of one column of a series."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barline.errors import InvalidParameter, window
from barline.functions.windows import BARS, Series, finite


def rolling_sum(x: Column, n: int, series: Series = BARS) -> Column:
    x = finite(x)
    return series.guarded(F.sum(x).over(series.last(window(n))), n, x)


def rolling_mean(x: Column, n: int, series: Series = BARS) -> Column:
    x = finite(x)
    return series.guarded(F.avg(x).over(series.last(window(n))), n, x)


sma = rolling_mean


def rolling_variance(x: Column, n: int, ddof: int = 1, series: Series = BARS) -> Column:
    """Sum of squared deviations over n - ddof, never below 0."""
    if ddof < 0 or window(n) <= ddof:
        raise InvalidParameter(f"a window of {n} has no variance with ddof {ddof}")
    x = finite(x)
    return series.guarded(F.greatest(F.var_pop(x).over(series.last(n)), F.lit(0.0)) * (n / (n - ddof)), n, x)


def rolling_std(x: Column, n: int, ddof: int = 1, series: Series = BARS) -> Column:
    return F.sqrt(rolling_variance(x, n, ddof, series))


def rolling_max(x: Column, n: int, series: Series = BARS) -> Column:
    x = finite(x)
    return series.guarded(F.max(x).over(series.last(window(n))), n, x)


def rolling_min(x: Column, n: int, series: Series = BARS) -> Column:
    x = finite(x)
    return series.guarded(F.min(x).over(series.last(window(n))), n, x)


def oldest(x: Column, n: int, series: Series = BARS) -> Column:
    """The first value of the window of n rows, once it is full."""
    return shift(x, window(n) - 1, series=series)


def diff(x: Column, n: int = 1, series: Series = BARS) -> Column:
    """x less its value n rows ago; n = 0 gives x itself."""
    x = finite(x)
    return x if n == 0 else x - series.lag(x, n)


def shift(x: Column, n: int, fill: float | None = None, series: Series = BARS) -> Column:
    """The value n rows ago (ahead, if n is negative), ``fill`` where there is none."""
    x = finite(x)
    return (F.lag(x, n, fill) if n >= 0 else F.lead(x, -n, fill)).over(series.ordered())


def pct_change(x: Column, n: int = 1, series: Series = BARS) -> Column:
    """Relative change over n rows; undefined from 0 and for n = 0."""
    x = finite(x)
    before = series.lag(x, n)
    return F.lit(None).cast("double") if n == 0 else F.when(before != 0, (x - before) / before)


def ffill(x: Column, series: Series = BARS) -> Column:
    return F.last(finite(x), ignorenulls=True).over(series.so_far())


def fillna(x: Column, value: float) -> Column:
    return F.coalesce(finite(x), F.lit(value))


def wma(x: Column, n: int, series: Series = BARS) -> Column:
    """Mean with weights 1 for the oldest up to n for the newest value."""
    x = finite(x)
    values = F.collect_list(x).over(series.last(window(n)))  # of a full window in order, once none is missing
    total = F.aggregate(values, F.struct(F.lit(0.0).alias("sum"), F.lit(1.0).alias("weight")), lambda a, v: F.struct((a["sum"] + a["weight"] * v).alias("sum"), (a["weight"] + 1).alias("weight")))
    return F.when(F.size(values) == n, total["sum"] / (n * (n + 1) / 2))
