"""Momentum indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.errors import columns, window
from barline.functions import rolling
from barline.functions.windows import BARS, Series, is_zero, ratio, value, with_columns
from barline.operators import programs
from barline.operators.programs import kernels, study

Pieces = str | int | None


def rsi(df: DataFrame, n: int = 14, column: str = "close", out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Relative strength; gains and losses are averaged from the first row's 0 on, shown from row n on."""
    return study(df, [programs.rsi(n, column, out)], series, pieces, fillna)


def stoch_rsi(df: DataFrame, n: int = 14, k: int = 3, d: int = 3, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """stoch_rsi, stoch_rsi_k and stoch_rsi_d, from 0 to 1."""
    return study(df, [programs.stoch_rsi(n, k, d)], series, pieces, fillna)


def _extremes(df: DataFrame, n: int, series: Series) -> DataFrame:
    return df.withColumns({"__low": rolling.rolling_min(F.col("low"), n, series), "__high": rolling.rolling_max(F.col("high"), n, series)})


def stochastic(df: DataFrame, k_period: int = 14, k_smooth: int = 3, d_period: int = 3, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """stoch_k (smoothed) and stoch_d; 50 in a window without range."""
    columns(df, "high", "low", "close")
    if kernels(max(window(k_period), window(k_smooth), window(d_period)), pieces):
        return study(df, [programs.stochastic(k_period, k_smooth, d_period)], series, pieces, fillna)
    made = _extremes(df, k_period, series)
    made = made.withColumn("__raw", 100 * ratio(value("close") - F.col("__low"), F.col("__high") - F.col("__low"), 0.5))
    made = made.withColumn("stoch_k", rolling.sma(F.col("__raw"), k_smooth, series))
    made = made.withColumn("stoch_d", rolling.sma(F.col("stoch_k"), d_period, series)).drop("__raw", "__low", "__high")
    return with_columns(made, {c: F.col(c) for c in ("stoch_k", "stoch_d")}, fillna)


def williams_r(df: DataFrame, n: int = 14, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """-100 to 0; -50 in a window without range."""
    columns(df, "high", "low", "close")
    if kernels(n, pieces):
        return study(df, [programs.williams_r(n)], series, pieces, fillna)
    made = _extremes(df, n, series)
    return with_columns(made, {f"williams_r_{n}": -100 * ratio(F.col("__high") - value("close"), F.col("__high") - F.col("__low"), 0.5)}, fillna).drop("__low", "__high")


def roc(df: DataFrame, n: int = 12, column: str = "close", fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Change over n rows in percent; undefined from 0."""
    columns(df, column)
    if window(n) and pieces is not None:
        return study(df, [programs.roc(n, column)], series, pieces, fillna)
    before = series.lag(value(column), n)
    return with_columns(df, {f"roc_{n}": F.when(~is_zero(before), 100 * (value(column) - before) / before)}, fillna)
