"""Indicators as table functions of Spark SQL.

After ``register(spark)``::

    SELECT * FROM ema(TABLE(bars) PARTITION BY symbol ORDER BY (ts), 14)
    SELECT * FROM macd(TABLE(bars) PARTITION BY symbol ORDER BY (ts), 12, 26, 9)

Rows come back with the indicator's columns after their own, named as on streams
(``ema``, ``macd``, ``macd_signal``). Spark deals rows by PARTITION BY and sorts them; a function
keeps the small state of ``barline.streaming.live`` and reads row by row, so a
series needs no memory. For speed over large tables use ``operators.programs.study``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import DoubleType, Row, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from barline.errors import MissingColumn
from barline.streaming import live

#: Functions by name: the indicator from its whole-number parameters, and the columns it reads.
FUNCTIONS: dict[str, tuple[Callable[..., live.Indicator], tuple[str, ...]]] = {
    "sma": (live.Sma, ("close",)),
    "wma": (live.Wma, ("close",)),
    "ema": (live.Average, ("close",)),
    "wilder": (lambda n=14: live.Average(n, "wilder"), ("close",)),
    "macd": (live.Macd, ("close",)),
    "adx": (live.Adx, ("high", "low", "close")),
    "aroon": (live.Aroon, ("high", "low", "close")),
    "rsi": (live.Rsi, ("close",)),
    "stoch_rsi": (live.StochRsi, ("close",)),
    "stochastic": (live.Stochastic, ("high", "low", "close")),
    "williams_r": (live.WilliamsR, ("high", "low", "close")),
    "roc": (live.Roc, ("close",)),
    "atr": (live.Atr, ("high", "low", "close")),
    "bollinger": (live.Bollinger, ("close",)),
    "keltner": (live.Keltner, ("high", "low", "close")),
    "donchian": (live.Donchian, ("high", "low", "close")),
    "obv": (live.Obv, ("close", "volume")),
    "vwap": (live.Vwap, ("high", "low", "close", "volume")),
    "mfi": (live.Mfi, ("high", "low", "close", "volume")),
    "cmf": (live.Cmf, ("high", "low", "close", "volume")),
}


def table_function(name: str) -> type:
    """The class that Spark runs for each partition of a call."""
    make, needs = FUNCTIONS[name]

    class Function:
        @staticmethod
        def analyze(rows: AnalyzeArgument, *parameters: AnalyzeArgument) -> AnalyzeResult:
            missing = [c for c in needs if c not in rows.dataType.names]
            if missing:
                raise MissingColumn(", ".join(missing))
            indicator = make(*[p.value for p in parameters])  # a parameter out of range fails here
            schema = StructType(list(rows.dataType.fields))
            for part in getattr(indicator, "names", ("",)):
                schema = schema.add(f"{name}_{part}" if part else name, DoubleType())
            return AnalyzeResult(schema)

        def __init__(self) -> None:
            self.indicator = self.state = None

        def eval(self, row: Row, *parameters: int) -> Iterator[tuple]:
            if self.indicator is None:
                self.indicator = make(*parameters)
                self.state = self.indicator.start()
            bar = {k: None if isinstance(v, float) and not math.isfinite(v) else v for k, v in row.asDict().items()}
            value = self.indicator.update(self.state, bar)
            yield (*row, *(value if isinstance(value, tuple) else (value,)))

    return Function


def register(spark: SparkSession, prefix: str = "") -> None:
    """Makes all functions known to the session's SQL, as ``prefix`` and their name."""
    for name in FUNCTIONS:
        spark.udtf.register(prefix + name, udtf(table_function(name)))
