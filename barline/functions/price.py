"""Row-local price expressions and predicates over open, high, low, close and volume."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from barline.functions.windows import BARS, Series, finite, value


def _cols() -> tuple[Column, ...]:
    return tuple(value(n) for n in ("open", "high", "low", "close", "volume"))


def typical_price() -> Column:
    _, h, l, c, _ = _cols()
    return (h + l + c) / 3


def median_price() -> Column:
    _, h, l, _, _ = _cols()
    return (h + l) / 2


def weighted_close() -> Column:
    _, h, l, c, _ = _cols()
    return (h + l + 2 * c) / 4


def bar_range() -> Column:
    return value("high") - value("low")


def body() -> Column:
    return F.abs(value("close") - value("open"))


def upper_shadow() -> Column:
    return value("high") - F.greatest(value("open"), value("close"))


def lower_shadow() -> Column:
    return F.least(value("open"), value("close")) - value("low")


def is_bullish() -> Column:
    return value("close") > value("open")


def is_bearish() -> Column:
    return value("close") < value("open")


def is_finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def any_missing(*names: str) -> Column:
    """Whether one of these columns is missing, as of an indicator with several outputs."""
    found = F.lit(False)
    for n in names:
        found = found | value(n).isNull()
    return found


def is_valid() -> Column:
    """All values finite, open and close between low and high, volume not negative."""
    o, h, l, c, v = _cols()
    return F.coalesce((l <= o) & (o <= h) & (l <= c) & (c <= h) & (v >= 0), F.lit(False))


def close_location() -> Column:
    """(2c - h - l) / (h - l), and 0 in a bar without range."""
    from barline.functions.windows import ratio

    _, h, l, c, _ = _cols()
    return ratio(2 * c - h - l, h - l, 0.0)


def clamp(x: Column, low: float, high: float) -> Column:
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def abs_diff(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def crossover(a: Column, b: Column, series: Series = BARS) -> Column:
    """``a`` was at or below ``b`` a row ago and is above it now; false where unknown."""
    a, b = finite(a), finite(b)
    return F.coalesce((series.lag(a) <= series.lag(b)) & (a > b), F.lit(False))


def crossunder(a: Column, b: Column, series: Series = BARS) -> Column:
    a, b = finite(a), finite(b)
    return F.coalesce((series.lag(a) >= series.lag(b)) & (a < b), F.lit(False))


def true_range(series: Series = BARS) -> Column:
    """The largest of h - l, abs(h - previous close), abs(l - previous close); h - l in the first row."""
    _, high, low, close, _ = _cols()
    before = series.lag(close)
    return F.greatest(high - low, F.abs(high - before), F.abs(low - before))
