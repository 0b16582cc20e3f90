"""Fitted transforms and pipelines for features: log returns, z-scores, robust scaling.

``fit`` runs one aggregation for all columns of a step; ``transform`` and
``inverse`` stay lazy expressions. Fitted steps are plain data (``state``), so they
can be kept as JSON and restored.

Scalers have one centre and scale for a whole table, or with ``per_series`` those of
each series: a fitted table by series, joined by a broadcast up to FEW_SERIES of them
and by a shuffle beyond. Rows of a series that was not in the fit have no result.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from barline.errors import InverseNotSupported, InvalidParameter, NotFitted, StateVersionError, columns
from barline.functions.windows import BARS, Series, finite
from barline.operators.quantiles import exact_quantiles
from barline.plans.lineage import checkpointed

VERSION = 1
#: Series whose figures are broadcast and can be kept as JSON; those of more are a table (``fitted_table``).
FEW_SERIES = 100_000
_NUMERIC = ("double", "float")


class Transform(Protocol):
    def fit(self, df: DataFrame) -> "Transform": ...
    def transform(self, df: DataFrame) -> DataFrame: ...
    def inverse(self, df: DataFrame) -> DataFrame: ...
    def output_columns(self, columns_in: list[str]) -> list[str]: ...
    def state(self) -> str: ...
    def restore(self, saved: str) -> "Transform": ...
    def reset(self) -> None: ...


def checked(saved: str, kind: str) -> dict:
    found = json.loads(saved)
    if found.get("version") != VERSION or found.get("kind") != kind:
        raise StateVersionError(f"{found.get('kind')} version {found.get('version')}")
    return found


def numeric(df: DataFrame, names: list[str] | None, series: Series) -> list[str]:
    if names:
        columns(df, *names)
        return list(names)
    return [c for c, t in df.dtypes if t in _NUMERIC and c not in (*series.by, *series.order)]


def is_volume(name: str) -> bool:
    """By name: contains "vol", or is "v"."""
    low = name.lower()
    return "vol" in low or low == "v"


class LogReturn:
    def __init__(self, names: list[str] | None = None, fill: float | None = None, log1p_for_volume: bool = True, series: Series = BARS):
        self.names, self.fill, self.log1p, self.series = names, fill, log1p_for_volume, series
        self.fitted: list[str] | None = None

    def fit(self, df: DataFrame) -> "LogReturn":
        self.fitted = numeric(df, self.names, self.series)
        return self

    def _of(self, name: str) -> Column:
        x = finite(F.col(name))
        before = self.series.lag(x)
        if self.log1p and is_volume(name):
            # What is not positive counts as 0; the first row has no value before it.
            def level(v: Column) -> Column:
                return F.when(v > 0, F.log1p(v)).otherwise(0.0)

            value = F.when(F.row_number().over(self.series.ordered()) > 1, level(x) - level(before))
        else:
            value = F.when((x > 0) & (before > 0), F.log(x / before))
        return value if self.fill is None else F.coalesce(value, F.lit(float(self.fill)))

    def transform(self, df: DataFrame) -> DataFrame:
        if self.fitted is None:
            raise NotFitted("log return")
        columns(df, *self.fitted)
        return df.withColumns({n: self._of(n) for n in self.fitted})

    def inverse(self, df: DataFrame) -> DataFrame:
        raise InverseNotSupported("log returns cannot be undone")

    def output_columns(self, columns_in: list[str]) -> list[str]:
        return list(columns_in)

    def state(self) -> str:
        return json.dumps({"version": VERSION, "kind": "log_return", "fitted": self.fitted, "fill": self.fill, "log1p": self.log1p})

    def restore(self, saved: str) -> "LogReturn":
        found = checked(saved, "log_return")
        self.fitted, self.fill, self.log1p = found["fitted"], found["fill"], found["log1p"]
        return self

    def reset(self) -> None:
        self.fitted = None


class _Scaler:
    kind = ""

    def __init__(self, names: list[str] | None = None, series: Series = BARS, per_series: bool = False):
        self.names, self.series, self.per_series = names, series, per_series
        self.centers: dict[str, float | None] | None = None
        self.scales: dict[str, float] = {}
        #: With ``per_series``: the columns of the series, and __c0, __s0, __c1, .. (centre and scale of each column).
        self.fitted_table: DataFrame | None = None
        self._few = True

    def _figures(self, df: DataFrame, names: list[str]) -> list[tuple[float | None, float | None]]:
        """Centre and scale of each column, missing values passed over."""
        raise NotImplementedError

    def _figures_by_series(self, df: DataFrame, names: list[str]) -> DataFrame:
        """A row for each series with c0, s0, c1, ..; missing values passed over."""
        raise NotImplementedError

    def fit(self, df: DataFrame) -> "_Scaler":
        names = numeric(df, self.names, self.series)
        if self.per_series:
            figures = self._figures_by_series(df, names) if names else df.select(*self.series.by).distinct()
            whole = [F.when(F.col(f"s{i}") > 0, F.col(f"s{i}")).otherwise(1.0).alias(f"__s{i}") for i in range(len(names))]
            return self._keep(figures.select(*self.series.by, *[F.col(f"c{i}").alias(f"__c{i}") for i in range(len(names))], *whole), names)
        figures = self._figures(df, names) if names else []
        self.centers = {n: center for n, (center, _) in zip(names, figures)}
        self.scales = {n: scale if scale and scale > 0 else 1.0 for n, (_, scale) in zip(names, figures)}
        return self

    def _keep(self, table: DataFrame, names: list[str]) -> "_Scaler":
        self.fitted_table = checkpointed(table)
        self._few = self.fitted_table.count() <= FEW_SERIES
        self.centers, self.scales = dict.fromkeys(names), {}
        return self

    def _scaled(self, df: DataFrame, of: Callable[[Column, Column, Column], Column]) -> DataFrame:
        """``df`` with fitted columns x as ``of(x, centre, scale)``."""
        names = self._fitted(df)
        if not self.per_series:
            return df.withColumns({n: of(F.col(n), F.lit(self.centers[n]), F.lit(self.scales[n])) for n in names})
        by = self.series.by
        own = self.fitted_table.select(*[F.col(c).alias(f"__of{i}") for i, c in enumerate(by)], *[c for c in self.fitted_table.columns if c not in by])
        same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__of{i}")) for i, c in enumerate(by)])
        joined = df.join(F.broadcast(own) if self._few else own, same, "left")
        return joined.withColumns({n: of(F.col(n), F.col(f"__c{i}"), F.col(f"__s{i}")) for i, n in enumerate(names)}).select(*df.columns)

    def output_columns(self, columns_in: list[str]) -> list[str]:
        return list(columns_in)

    def _fitted(self, df: DataFrame) -> list[str]:
        if self.centers is None:
            raise NotFitted(self.kind)
        columns(df, *self.centers)
        return list(self.centers)

    def transform(self, df: DataFrame) -> DataFrame:
        return self._scaled(df, lambda x, center, scale: (x - center) / scale)

    def inverse(self, df: DataFrame) -> DataFrame:
        return self._scaled(df, lambda x, center, scale: x * scale + center)

    def center(self, name: str) -> float | None:
        return (self.centers or {}).get(name)

    def scale(self, name: str) -> float | None:
        return self.scales.get(name)

    def reset(self) -> None:
        self.centers, self.scales, self.fitted_table = None, {}, None

    def state(self) -> str:
        if self.per_series and self.fitted_table is not None:
            if not self._few:
                raise InvalidParameter(f"figures of more than {FEW_SERIES} series are a table (fitted_table), not JSON")
            rows = [list(r) for r in self.fitted_table.collect()]  # bounded by FEW_SERIES
            return json.dumps({"version": VERSION, "kind": self.kind, "names": list(self.centers), "schema": self.fitted_table.schema.json(), "rows": rows})
        return json.dumps({"version": VERSION, "kind": self.kind, "centers": self.centers, "scales": self.scales})

    def restore(self, saved: str) -> "_Scaler":
        found = checked(saved, self.kind)
        if self.per_series != ("rows" in found) and (self.per_series or "rows" in found):
            raise InvalidParameter("a state with and one without figures for each series")
        if self.per_series:
            schema = T.StructType.fromJson(json.loads(found["schema"]))
            return self._keep(SparkSession.active().createDataFrame([tuple(r) for r in found["rows"]], schema), found["names"])
        self.centers, self.scales = found["centers"], found["scales"]
        return self


class Normalization(_Scaler):
    """(x - mean) / sample deviation; a column without spread is only centred."""

    kind = "normalization"

    def _figures(self, df: DataFrame, names: list[str]) -> list[tuple[float | None, float | None]]:
        made = []
        for i, n in enumerate(names):
            x = finite(F.col(n))
            made += [F.avg(x).alias(f"c{i}"), F.stddev_samp(x).alias(f"s{i}")]
        row = df.agg(*made).first()
        return [(row[f"c{i}"], row[f"s{i}"]) for i in range(len(names))]

    def _figures_by_series(self, df: DataFrame, names: list[str]) -> DataFrame:
        figures = [f(finite(F.col(n))).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("c", F.avg), ("s", F.stddev_samp))]
        return df.groupBy(*self.series.by).agg(*figures)

    mean = _Scaler.center


class RobustNormalization(_Scaler):
    """(x - median) / distance of two quantiles; a column without that distance is only centred."""

    kind = "robust"

    def __init__(self, names: list[str] | None = None, quantile_range: tuple[float, float] = (0.25, 0.75), series: Series = BARS, per_series: bool = False):
        super().__init__(names, series, per_series)
        low, high = quantile_range
        if not 0 <= low < high <= 1:
            raise InvalidParameter("quantile_range must rise within 0 and 1")
        self.range = quantile_range

    @staticmethod
    def _pairs(names: list[str]) -> Column:
        """Columns as rows of (number, value), so that one pair of aggregations serves them all."""
        return F.explode(F.array(*[F.struct(F.lit(i).alias("__i"), F.col(n).cast("double").alias("__x")) for i, n in enumerate(names)])).alias("__p")

    def _figures_by_series(self, df: DataFrame, names: list[str]) -> DataFrame:
        by = self.series.by
        found = exact_quantiles(df.select(*by, self._pairs(names)).select(*by, "__p.__i", "__p.__x"), [*by, "__i"], "__x", (0.5, *self.range))
        figures = [F.max(F.when(F.col("__i") == i, v)).alias(f"{k}{i}") for i in range(len(names)) for k, v in (("c", F.col("q0")), ("s", F.col("q2") - F.col("q1")))]
        return found.groupBy(*by).agg(*figures)

    def _figures(self, df: DataFrame, names: list[str]) -> list[tuple[float | None, float | None]]:
        pairs = df.select(self._pairs(names)).select(F.col("__p.__i").alias("i"), F.col("__p.__x").alias("x"))
        found = {r["i"]: r for r in exact_quantiles(pairs, ["i"], "x", (0.5, *self.range)).collect()}
        return [(found[i]["q0"], None if found[i]["q1"] is None else found[i]["q2"] - found[i]["q1"]) if i in found else (None, None) for i in range(len(names))]


class Pipeline:
    """Steps in order; each is fitted on what the one before makes, and undone in reverse."""

    def __init__(self, *steps: Transform):
        self.steps: list[tuple[str, Transform]] = []
        self.fitted = False
        for s in steps:
            self.add(s)

    def add(self, step: Transform, name: str | None = None) -> "Pipeline":
        self.steps.append((name or f"step_{len(self.steps)}", step))
        self.fitted = False
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.steps]

    def __len__(self) -> int:
        return len(self.steps)

    def fit(self, df: DataFrame) -> "Pipeline":
        self.fit_transform(df)
        return self

    def fit_transform(self, df: DataFrame) -> DataFrame:
        for _, step in self.steps:
            df = step.fit(df).transform(df)
        self.fitted = True
        return df

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFitted("pipeline")
        for _, step in self.steps:
            df = step.transform(df)
        return df

    def inverse(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise NotFitted("pipeline")
        for _, step in reversed(self.steps):
            df = step.inverse(df)
        return df

    def output_columns(self, columns_in: list[str]) -> list[str]:
        for _, step in self.steps:
            columns_in = step.output_columns(columns_in)
        return columns_in

    def state(self) -> str:
        if not self.fitted:
            raise NotFitted("pipeline")
        return json.dumps({"version": VERSION, "kind": "pipeline", "steps": [[n, s.state()] for n, s in self.steps]})

    def restore(self, saved: str) -> "Pipeline":
        """Puts saved figures into a pipeline of the same steps."""
        found = checked(saved, "pipeline")["steps"]
        if [n for n, _ in found] != self.names:
            raise InvalidParameter(f"a state of the steps {', '.join(n for n, _ in found)}")
        for (_, step), (_, own) in zip(self.steps, found):
            step.restore(own)
        self.fitted = True
        return self

    def reset(self) -> None:
        """Forgets what was fitted, in every step."""
        for _, step in self.steps:
            step.reset()
        self.fitted = False
