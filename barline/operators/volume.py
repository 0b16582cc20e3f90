"""Volume indicators."""

from __future__ import annotations

from typing import Literal

from pyspark.sql import DataFrame, Window, functions as F

from barline.errors import InvalidParameter, columns, window
from barline.functions.price import close_location, typical_price
from barline.functions.windows import BARS, EPSILON, Series, is_zero, ratio, value, with_columns
from barline.operators import programs
from barline.operators.programs import OBV_LIMIT, kernels, study

Pieces = str | int | None


def obv(df: DataFrame, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """On-balance volume, begun at 0; a total beyond OBV_LIMIT fails the query."""
    columns(df, "close", "volume")
    if pieces is not None:
        return study(df, [programs.obv()], series, pieces, fillna)
    change = value("close") - series.lag(value("close"))
    flow = F.when(change > EPSILON, value("volume")).when(change < -EPSILON, -value("volume")).otherwise(0.0)
    made = df.withColumn("__flow", flow).withColumn("obv", F.sum("__flow").over(series.so_far())).drop("__flow")
    checked = F.when(F.abs("obv") > OBV_LIMIT, F.raise_error(F.lit("on-balance volume overflow")).cast("double")).otherwise(F.col("obv"))
    return with_columns(made, {"obv": checked}, fillna)


def vwap(df: DataFrame, mode: Literal["cumulative", "rolling", "session"] = "cumulative", n: int | None = None, out: str = "vwap", fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Volume-weighted typical price: since the start, over n rows, or since the day began. Without volume the last value stays."""
    columns(df, "high", "low", "close", "volume")
    if pieces is not None or (mode == "rolling" and kernels(n or 0, pieces)):
        return study(df, [programs.vwap(mode, n, out)], series, pieces, fillna)
    frame, shown = series.so_far(), F.lit(True)
    if mode == "rolling":
        frame, shown = series.last(window(n or 0)), series.full(n)
    elif mode == "session":
        frame = Window.partitionBy(*series.by, F.to_date(series.order[0])).orderBy(*series.order).rowsBetween(Window.unboundedPreceding, 0)
    elif mode != "cumulative":
        raise InvalidParameter(f"unknown mode {mode!r}")
    made = df.withColumns({"__money": F.sum(typical_price() * value("volume")).over(frame), "__volume": F.sum(value("volume")).over(frame)})
    made = made.withColumn("__vwap", F.when(shown & ~is_zero(F.col("__volume")), F.try_divide("__money", "__volume")))
    made = made.withColumn(out, F.last("__vwap", ignorenulls=True).over(series.so_far())).drop("__vwap", "__money", "__volume")
    return with_columns(made, {out: F.col(out)}, fillna)


def mfi(df: DataFrame, n: int = 14, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Money flow index, 0 to 100, from the row after the first n on."""
    columns(df, "high", "low", "close", "volume")
    if kernels(n, pieces):
        return study(df, [programs.mfi(n)], series, pieces, fillna)
    price = typical_price()
    change = price - series.lag(price)
    made = df.withColumns({"__up": F.when(change > 0, price * value("volume")).otherwise(0.0), "__down": F.when(change < 0, price * value("volume")).otherwise(0.0)})
    frame = series.last(n)
    made = made.withColumns({c: F.coalesce(F.sum(c).over(frame), F.lit(0.0)) for c in ("__up", "__down")} | {"__full": series.full(n + 1)})
    up, down = F.col("__up"), F.col("__down")
    found = F.when((F.abs(up) < EPSILON) & (F.abs(down) < EPSILON), 50.0).when(F.abs(down) < EPSILON, 100.0).when(F.abs(up) < EPSILON, 0.0).otherwise(100 - 100 / (1 + F.try_divide(up, down)))
    found = F.least(F.greatest(found, F.lit(0.0)), F.lit(100.0))
    made = made.withColumn(f"mfi_{n}", F.when(F.col("__full"), found)).drop("__up", "__down", "__full")
    return with_columns(made, {f"mfi_{n}": F.col(f"mfi_{n}")}, fillna)


def cmf(df: DataFrame, n: int = 20, fillna: bool = False, series: Series = BARS, pieces: Pieces = None) -> DataFrame:
    """Chaikin money flow, -1 to 1; 0 without volume."""
    columns(df, "high", "low", "close", "volume")
    if kernels(n, pieces):
        return study(df, [programs.cmf(n)], series, pieces, fillna)
    frame = series.last(n)
    made = df.withColumns({"__flow": F.sum(close_location() * value("volume")).over(frame), "__sum": F.sum(value("volume")).over(frame), "__full": series.full(n)})
    return with_columns(made, {f"cmf_{n}": F.when(F.col("__full"), ratio(F.col("__flow"), F.col("__sum"), 0.0))}, fillna).drop("__flow", "__sum", "__full")
