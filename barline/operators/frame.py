"""Whole-series reductions, column operations with checks, alignment, heads and tails."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from barline.errors import DuplicateColumn, columns
from barline.functions.windows import BARS, Series, value
from barline.operators.quantiles import exact_quantiles
from barline.plans.scan import numbers


def series_stats(df: DataFrame, column: str, series: Series = BARS) -> DataFrame:
    """n, n_missing, total, mean, least, most, first and last of a column for each series; missing values are passed over."""
    columns(df, column)
    x = value(column)
    order = F.struct(*series.order)
    return df.groupBy(*series.by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(x.isNull()).alias("n_missing"),
        F.bool_or(x.isNull()).alias("has_missing"),
        F.coalesce(F.sum(x), F.lit(0.0)).alias("total"),
        F.avg(x).alias("mean"),
        F.min(x).alias("least"),
        F.max(x).alias("most"),
        F.min_by(column, order).alias("first"),
        F.max_by(column, order).alias("last"),
    )


def quantiles(df: DataFrame, column: str, q: tuple[float, ...] = (0.25, 0.5, 0.75), series: Series = BARS) -> DataFrame:
    """Exact quantiles with linear interpolation, as columns q0, q1, ..; missing values are passed over."""
    columns(df, column)
    return exact_quantiles(df, list(series.by), column, q)


def select(df: DataFrame, *names: str) -> DataFrame:
    columns(df, *names)
    return df.select(*names)


def add_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    if name in df.columns:
        raise DuplicateColumn(name)
    return df.withColumn(name, value)


def set_column(df: DataFrame, name: str, value: Column) -> DataFrame:
    return df.withColumn(name, value)


def drop_column(df: DataFrame, name: str) -> DataFrame:
    columns(df, name)
    return df.drop(name)


def rename_column(df: DataFrame, old: str, new: str) -> DataFrame:
    columns(df, old)
    if new in df.columns and new != old:
        raise DuplicateColumn(new)
    return df.withColumnRenamed(old, new)


def map_column(df: DataFrame, name: str, of: Callable[[Column], Column]) -> DataFrame:
    """``name`` with every value x as ``of(x)``."""
    columns(df, name)
    return df.withColumn(name, of(F.col(name)))


def map_indexed(df: DataFrame, name: str, of: Callable[[Column, Column], Column], series: Series = BARS) -> DataFrame:
    """``name`` with every value x as ``of(position, x)``; positions count from 0 in each series."""
    columns(df, name)
    return df.withColumn(name, of(F.row_number().over(series.ordered()) - 1, F.col(name)))


def map_values(df: DataFrame, name: str, of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """``name`` with ``of`` applied to its values as arrays of doubles, batch by batch, for functions that no Column expresses.

    Missing values (NULL, NaN, infinite) are NaN in the arrays, and such results are NULL.
    ``of`` must work value by value: what lies in one batch is Spark's choice.
    """
    columns(df, name)
    return _mapped(df, name, lambda table: of(numbers(table, name)))


def map_values_indexed(df: DataFrame, name: str, of: Callable[[np.ndarray, np.ndarray], np.ndarray], series: Series = BARS) -> DataFrame:
    """As ``map_values``, with ``of(positions, values)``; positions count from 0 in each series."""
    columns(df, name)
    placed = df.withColumn("__place", F.row_number().over(series.ordered()) - 1)
    return _mapped(placed, name, lambda table: of(table.column("__place").to_numpy(), numbers(table, name))).drop("__place")


def _mapped(df: DataFrame, name: str, of: Callable[[pa.Table], np.ndarray]) -> DataFrame:
    at = df.columns.index(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch.columns, names=batch.schema.names)
            made = np.asarray(of(table), np.float64)
            column = pa.array(made, pa.float64(), mask=~np.isfinite(made))
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], column, *batch.columns[at + 1 :]], names=batch.schema.names)

    schema = T.StructType([T.StructField(f.name, T.DoubleType() if f.name == name else f.dataType) for f in df.schema.fields])
    return df.mapInArrow(run, schema)


def at(df: DataFrame, position: int, series: Series = BARS) -> DataFrame:
    """The row at a position of each series, from 0, or from the end for negative ones; series that are too short have none."""
    order = [F.col(c).desc() if position < 0 else F.col(c).asc() for c in series.order]
    place = -position if position < 0 else position + 1
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*series.by).orderBy(*order))).where(F.col("__rank") == place).drop("__rank")


def concat(left: DataFrame, right: DataFrame, series: Series = BARS) -> DataFrame:
    """Columns side by side, rows matched by series and order; a name on both sides is an error."""
    keys = [*series.by, *series.order]
    both = (set(left.columns) & set(right.columns)) - set(keys)
    if both:
        raise DuplicateColumn(", ".join(sorted(both)))
    return left.join(right, keys)


def append(df: DataFrame, rows: DataFrame) -> DataFrame:
    return df.unionByName(rows)


def _ranked(df: DataFrame, n: int, series: Series, backward: bool) -> DataFrame:
    order = [F.col(c).desc() if backward else F.col(c).asc() for c in series.order]
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*series.by).orderBy(*order))).where(F.col("__rank") <= n).drop("__rank")


def head(df: DataFrame, n: int, series: Series = BARS) -> DataFrame:
    """The first n rows of each series."""
    return _ranked(df, n, series, False)


def tail(df: DataFrame, n: int, series: Series = BARS) -> DataFrame:
    """The last n rows of each series."""
    return _ranked(df, n, series, True)


def drop_invalid(df: DataFrame) -> DataFrame:
    from barline.functions.price import is_valid

    return df.where(is_valid())
