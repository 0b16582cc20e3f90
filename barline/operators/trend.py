"""Trend indicators. Each function adds columns to a table of bars; undefined values are NULL.

With ``pieces`` (a unit of time, or a number for numeric orders), series that are too
long for one task are cut; see ``barline.plans.scan``. Wide windows and recurrences run
as steps of ``barline.operators.programs``, narrow windows as Spark's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.errors import InvalidParameter, columns, window
from barline.functions import rolling
from barline.functions.windows import BARS, Series, value, with_columns
from barline.operators import programs
from barline.operators.programs import kernels, study

Pieces = str | int | None


def sma(df: DataFrame, n: int = 14, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    columns(df, column)
    name = out or f"sma_{n}"
    if kernels(n, pieces):
        return study(df, [programs.rolling("mean", n, column, name)], series, pieces, fillna)
    return with_columns(df, {name: rolling.sma(F.col(column), n, series)}, fillna)


def ema(df: DataFrame, n: int = 14, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Exponential average, alpha 2 / (n + 1), begun at the mean of the first n values."""
    return study(df, [programs.average("ema", n, column, out)], series, pieces, fillna)


def wilder(df: DataFrame, n: int = 14, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Wilder's average, alpha 1 / n, begun at the mean of the first n values."""
    return study(df, [programs.average("wilder", n, column, out)], series, pieces, fillna)


def wma(df: DataFrame, n: int = 14, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Mean with weights 1 for the oldest up to n for the newest value."""
    return study(df, [programs.rolling("wma", n, column, out or f"wma_{n}")], series, pieces, fillna)


def macd(df: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """macd, macd_signal and macd_histogram; the signal begins at the first macd value."""
    for n in (fast, slow, signal):
        window(n)
    if fast >= slow:
        raise InvalidParameter("fast must be below slow")
    return study(df, [programs.macd(fast, slow, signal)], series, pieces, fillna)


def adx(df: DataFrame, n: int = 14, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """adx, plus_di and minus_di; directional values from the row after the first n on, adx n rows later."""
    if window(n) < 2:
        raise InvalidParameter("adx needs a window of 2 or more")
    return study(df, [programs.adx(n)], series, pieces, fillna)


def aroon(df: DataFrame, n: int = 25, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """aroon_up, aroon_down and aroon_oscillator over n + 1 rows without missing ones; of equal extremes the latest counts."""
    columns(df, "high", "low")
    if kernels(n, pieces):
        return study(df, [programs.aroon(n)], series, pieces, fillna)
    frame, order = series.last(window(n) + 1), F.row_number().over(series.ordered())
    made = df.withColumns({"__rn": order, "__h": value("high"), "__l": value("low")})
    full = series.full(n + 1, F.col("__h")) & series.full(n + 1, F.col("__l"))
    made = made.withColumns({"__full": full, "__high": F.max(F.struct("__h", "__rn")).over(frame)["__rn"], "__low": -F.min(F.struct("__l", (-F.col("__rn")).alias("r"))).over(frame)["r"]})
    up, down = (F.when(F.col("__full"), 100.0 * (n - (F.col("__rn") - F.col(c))) / n) for c in ("__high", "__low"))
    made = made.withColumns({"aroon_up": up, "aroon_down": down}).drop("__rn", "__h", "__l", "__full", "__high", "__low")
    return with_columns(made, {"aroon_up": F.col("aroon_up"), "aroon_down": F.col("aroon_down"), "aroon_oscillator": F.col("aroon_up") - F.col("aroon_down")}, fillna)
