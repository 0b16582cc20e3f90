"""Volatility indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from barline.errors import InvalidParameter, columns, window
from barline.functions import rolling
from barline.functions.windows import BARS, EPSILON, Series, is_zero, value, with_columns
from barline.operators import programs
from barline.operators.programs import kernels, study

Pieces = str | int | None


def atr(df: DataFrame, n: int = 14, out: str | None = None, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Wilder's average of the true range."""
    return study(df, [programs.atr(n, out)], series, pieces, fillna)


def bollinger(df: DataFrame, n: int = 20, num_std: float = 2.0, column: str = "close", fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """bb_upper, bb_middle, bb_lower, bb_width and bb_pct_b, with the sample deviation (0 for one row)."""
    if num_std <= 0:
        raise InvalidParameter("num_std must be positive")
    columns(df, column)
    if kernels(n, pieces):
        return study(df, [programs.bollinger(n, num_std, column)], series, pieces, fillna)
    x, frame = value(column), series.last(n)
    # Each window is made once; bands are derived from its columns.
    made = df.withColumns({"__n": F.count(x).over(frame), "__mean": F.avg(x).over(frame), "__std": F.stddev_samp(x).over(frame)})
    middle = F.when(F.col("__n") == n, F.col("__mean"))
    made = made.withColumns({"bb_middle": middle, "__spread": num_std * F.coalesce("__std", F.lit(0.0))})
    made = made.withColumns({"bb_upper": F.col("bb_middle") + F.col("__spread"), "bb_lower": F.col("bb_middle") - F.col("__spread")})
    upper, middle, lower = F.col("bb_upper"), F.col("bb_middle"), F.col("bb_lower")
    bands = {
        "bb_upper": upper,
        "bb_middle": middle,
        "bb_lower": lower,
        "bb_width": F.when(~is_zero(middle), (upper - lower) / middle),
        "bb_pct_b": F.when(upper - lower > EPSILON, (x - lower) / (upper - lower)).when(middle.isNotNull(), 0.5),
    }
    kept = [c for c in df.columns if c not in bands]
    return with_columns(made, bands, fillna).select(*kept, *bands)


def keltner(df: DataFrame, ema_window: int = 20, atr_window: int = 10, multiplier: float = 2.0, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """kc_upper, kc_middle and kc_lower: an exponential average with bands of the average true range."""
    if multiplier <= 0:
        raise InvalidParameter("multiplier must be positive")
    return study(df, [programs.keltner(ema_window, atr_window, multiplier)], series, pieces, fillna)


def donchian(df: DataFrame, n: int = 20, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """dc_upper, dc_middle, dc_lower and dc_width."""
    columns(df, "high", "low")
    if kernels(n, pieces):
        return study(df, [programs.donchian(n)], series, pieces, fillna)
    made = df.withColumns({"dc_upper": rolling.rolling_max(F.col("high"), n, series), "dc_lower": rolling.rolling_min(F.col("low"), n, series)})
    high, low = F.col("dc_upper"), F.col("dc_lower")
    bands = {"dc_upper": high, "dc_middle": (high + low) / 2, "dc_lower": low, "dc_width": high - low}
    return with_columns(made, bands, fillna).select(*[c for c in df.columns if c not in bands], *bands)
