"""One ordered window per series: frames, warm-up guards, and what "undefined" means.

All indicators over one ``Series`` share a partitioning and an order, so Spark plans
one exchange and one sort for any number of them. Undefined and warm-up values are
NULL.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Below this, a denominator or a range counts as zero.
EPSILON = 1e-10


@dataclass(frozen=True)
class Series:
    """Rows with equal ``by`` columns, in the order of the ``order`` columns."""

    by: tuple[str, ...] = ("symbol",)
    order: tuple[str, ...] = ("ts",)

    def ordered(self) -> WindowSpec:
        return Window.partitionBy(*self.by).orderBy(*self.order)

    def last(self, rows: int) -> WindowSpec:
        """The current row and those before it, ``rows`` in all."""
        return self.ordered().rowsBetween(-(rows - 1), 0)

    def so_far(self) -> WindowSpec:
        return self.ordered().rowsBetween(Window.unboundedPreceding, 0)

    def lag(self, column: Column, n: int = 1) -> Column:
        return F.lag(column, n).over(self.ordered())

    def full(self, rows: int, of: Column | None = None) -> Column:
        """Whether the frame of ``rows`` rows is complete (and has as many values of ``of``)."""
        return F.count(F.lit(1) if of is None else of).over(self.last(rows)) == rows

    def guarded(self, value: Column, rows: int, of: Column | None = None) -> Column:
        return F.when(self.full(rows, of), value)


BARS = Series()


def finite(x: Column) -> Column:
    """``x``, and NULL where it is missing: NULL, NaN (above all numbers in comparisons) or infinite."""
    return F.when(F.abs(x) < F.lit(float("inf")), x)


def value(name: str) -> Column:
    """A column of a table, whose missing values may be NULL, NaN or infinite, as ``finite`` gives it."""
    return finite(F.col(name))


def is_zero(column: Column) -> Column:
    return F.abs(column) < EPSILON


def ratio(top: Column, bottom: Column, otherwise: Column | float | None = None) -> Column:
    """top / bottom, and ``otherwise`` where the bottom is zero."""
    return F.when(~is_zero(bottom), F.try_divide(top, bottom)).when(bottom.isNotNull(), F.lit(otherwise) if not isinstance(otherwise, Column) else otherwise)


def with_columns(df: DataFrame, made: dict[str, Column], fillna: bool = False) -> DataFrame:
    """``df`` with columns; ``fillna`` turns what is undefined into 0 at the very end."""
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) if fillna else v for k, v in made.items()})


def without_nan(df: DataFrame, *names: str) -> DataFrame:
    """``df`` with NaN and infinite values as NULL in these columns, so that aggregates pass over them."""
    return df.withColumns({n: value(n) for n in names})
