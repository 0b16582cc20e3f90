"""Exact quantiles of groups of any size, without holding a group's values in one task.

A first aggregation counts each group and brackets every quantile by approximate
ones with a proven rank error. A second one counts the rows of each distinct value
(combined before the shuffle, so a value that fills a third of a group is one row),
adds up those below the bracket and lists the distinct values within it: a
five-thousandth of the group, whatever its size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barline.functions.windows import finite

#: Rank error of the approximate quantiles: a group's rows over this.
ACCURACY = 20_000
#: Groups of fewer rows are listed whole.
SMALL = 4 * ACCURACY


def _at_rank(inside: Column, below: Column, rank: Column) -> Column:
    """The value at a rank (from 0), from ordered (value, count) pairs and the number of rows before them."""
    start = F.struct(below.alias("seen"), F.lit(None).cast("double").alias("x"))

    def walk(s: Column, e: Column) -> Column:
        seen = s["seen"] + e["count"]
        return F.struct(seen.alias("seen"), F.when(s["x"].isNull() & (seen > rank), e["x"]).otherwise(s["x"]).alias("x"))

    return F.aggregate(inside, start, walk, lambda s: s["x"])


def exact_quantiles(df: DataFrame, keys: list[str], value: str, q: tuple[float, ...]) -> DataFrame:
    """``keys`` and q0, q1, ..: quantiles with linear interpolation of ``value`` for each group of the keys.

    Missing values (NULL, NaN, infinite) are passed over; a group without values has NULL quantiles.
    Null keys are a group; an empty table gives an empty result.
    """
    x = F.col(value).cast("double")
    rows = df.select(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)], finite(x).alias("x"))
    names = [f"k{i}" for i in range(len(keys))]
    margin = 2 / ACCURACY
    ends = [p for level in q for p in (max(level - margin, 0.0), min(level + margin, 1.0))]
    figures = rows.groupBy(*names).agg(F.count("x").alias("n"), F.percentile_approx("x", ends, ACCURACY).alias("ends"))
    small = F.col("n") < SMALL
    for i in range(len(q)):
        figures = figures.withColumns({f"low{i}": F.when(~small, F.col("ends")[2 * i]), f"high{i}": F.when(~small, F.col("ends")[2 * i + 1])})
    counted = rows.where(F.col("x").isNotNull()).groupBy(*names, "x").count()
    left = figures.select(*[F.col(k).alias(f"of_{k}") for k in names], *[c for c in figures.columns if c not in (*names, "ends")])
    joined = counted.join(left, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in names]))
    sums = []
    for i in range(len(q)):
        low, high = F.col(f"low{i}"), F.col(f"high{i}")
        within = F.coalesce(F.col("x").between(low, high), F.lit(True))
        sums += [F.coalesce(F.sum(F.when(F.col("x") < low, F.col("count"))), F.lit(0)).alias(f"below{i}"), F.sort_array(F.collect_list(F.when(within, F.struct("x", "count")))).alias(f"inside{i}")]
    found = joined.groupBy(*names, "n").agg(*sums)
    made = []
    for i, level in enumerate(q):
        place = (F.col("n") - 1) * F.lit(float(level))
        rank = F.floor(place).cast("long")
        lower = _at_rank(F.col(f"inside{i}"), F.col(f"below{i}"), rank)
        upper = _at_rank(F.col(f"inside{i}"), F.col(f"below{i}"), F.least(rank + 1, F.col("n") - 1))
        made.append((lower + (upper - lower) * (place - rank)).alias(f"q{i}"))
    values = found.select(*[F.col(k).alias(f"of_{k}") for k in names], *made)
    groups = figures.select(*names)
    every = groups.join(values, reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"of_{k}")) for k in names]), "left")
    return every.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], *[f"q{i}" for i in range(len(q))])
