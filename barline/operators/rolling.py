"""Rolling and running functions of one column as table functions, for series in pieces and for windows of any width.

``barline.functions.rolling`` has most of them as column expressions over Spark's windows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from barline.functions.windows import BARS, Series
from barline.operators import programs
from barline.operators.programs import study

Pieces = str | int | None


def rolling(df: DataFrame, kind: str, n: int, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """sum, mean, variance, population_variance, std, wma, max, min, first (the oldest value) or since_max and since_min (rows since the latest extreme) of n rows."""
    return study(df, [programs.rolling(kind, n, column, out)], series, pieces, fillna)


def shift(df: DataFrame, n: int, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    return study(df, [programs.shift(n, column, out)], series, pieces, fillna)


def diff(df: DataFrame, n: int = 1, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    return study(df, [programs.diff(n, column, out)], series, pieces, fillna)


def pct_change(df: DataFrame, n: int = 1, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Relative change over n rows; undefined from 0."""
    return study(df, [programs.pct_change(n, column, out)], series, pieces, fillna)


def ffill(df: DataFrame, column: str = "close", out: str = "ffill", series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """The last value there is."""
    return study(df, [programs.ffill(column, out)], series, pieces)


def running_sum(df: DataFrame, column: str = "close", out: str = "running_sum", series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """The sum of all values so far; undefined before the first."""
    return study(df, [programs.running_sum(column, out)], series, pieces)
