"""Indicators of ``barline.streaming.live`` with typed state variables, and hand-over from tables to streams.

``stateful_indicators`` keeps for each symbol a value ``progress`` (time of the last bar, bars
taken, bars dropped), a map ``own`` with the state of each indicator, and a map
``current`` with the latest value of each column and whether it is there yet. Spark's state reader
shows them::

    spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "current").load()

``states`` folds a table of bars into the same states, and a stream takes them as its
``initial`` ones, so history in batch and bars on a stream are one series.

Bars of a trigger are taken in order of time; those at or before the last one seen, and
further ones of one time, are dropped and counted. Sessions need the RocksDB state store
(``STORE`` as ``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from barline.errors import InvalidParameter, StateVersionError
from barline.streaming.live import VERSION, Indicator, as_bars

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROGRESS = "seen timestamp, bars long, dropped long, version int"
STATES = f"symbol string, {PROGRESS}, own map<string,string>"


def column_names(indicators: dict[str, Indicator]) -> dict[str, list[str]]:
    return {k: [f"{k}_{n}" if n else k for n in getattr(i, "names", ("",))] for k, i in indicators.items()}


def advanced(indicators: dict[str, Indicator], own: dict[str, dict], bar: dict) -> list[float | None]:
    """The values of all columns after a bar; ``own`` moves on."""
    made: list[float | None] = []
    for k, i in indicators.items():
        value = i.update(own[k], bar)
        made += list(value) if isinstance(value, tuple) else [value]
    return made


class Processor(StatefulProcessor):
    def __init__(self, indicators: dict[str, Indicator], idle: int | None):
        self.indicators, self.idle = indicators, idle
        self.columns = [c for own in column_names(indicators).values() for c in own]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.progress = handle.getValueState("progress", PROGRESS)
        self.own = handle.getMapState("own", "indicator string", "state string")
        self.current = handle.getMapState("current", "name string", "value double, ready boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.progress.update((row["seen"].to_pydatetime(), int(row["bars"]), int(row["dropped"]), int(row["version"])))
        for name, state in dict(row["own"]).items():
            self.own.updateValue((name,), (state,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, bars, dropped, version = self.progress.get() if self.progress.exists() else (None, 0, 0, VERSION)
        if version != VERSION:
            raise StateVersionError(str(version))
        kept = {k[0]: json.loads(v[0]) for k, v in self.own.iterator()}
        own = {k: kept.get(k) or i.start() for k, i in self.indicators.items()}
        table = pd.concat(list(rows)).sort_values("ts", kind="stable")
        all_rows = len(table)
        if seen is not None:
            table = table[table["ts"] > pd.Timestamp(seen)]
        table = table.drop_duplicates("ts").reset_index(drop=True)
        made = [advanced(self.indicators, own, bar) for bar in as_bars(table)]
        if len(table):
            seen = table["ts"].iloc[-1].to_pydatetime()
            for k, state in own.items():
                self.own.updateValue((k,), (json.dumps(state),))
            for c, v in zip(self.columns, made[-1]):
                self.current.updateValue((c,), (math.nan if v is None else float(v), v is not None))
        if seen is not None:
            self.progress.update((seen, bars + len(table), dropped + all_rows - len(table), VERSION))
        if self.idle is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)
        for c, values in zip(self.columns, zip(*made) if made else [[]] * len(self.columns)):
            table[c] = pd.Series(list(values), dtype="float64")
        yield table

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """A symbol without bars for so long starts anew."""
        for state in (self.progress, self.own, self.current):
            state.clear()
        return iter([])

    def close(self) -> None:
        pass


def stateful_indicators(bars: DataFrame, indicators: dict[str, Indicator], idle: str | None = None, initial: DataFrame | None = None) -> DataFrame:
    """A stream of bars with a column for each value of each indicator.

    ``initial`` is what ``states`` made of the bars before the stream. With ``idle`` (a
    pandas duration such as "2 days"), the state of a symbol without bars for that long goes.
    """
    spark = bars.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass", "") != STORE:
        raise InvalidParameter(f"set spark.sql.streaming.stateStore.providerClass to {STORE}")
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    out = fields + "".join(f", `{c}` double" for own in column_names(indicators).values() for c in own)
    first = None if initial is None else initial.groupBy("symbol")
    return bars.groupBy("symbol").transformWithStateInPandas(Processor(indicators, wait), out, "append", "none" if wait is None else "processingTime", first)


def states(bars: DataFrame, indicators: dict[str, Indicator]) -> DataFrame:
    """(symbol, seen, bars, dropped, version, own): the state of each symbol after all its bars.

    Bars are read in order, batch by batch, so a task holds one batch and one state.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol, seen, n, dropped, own = None, None, 0, 0, None

        def row() -> pd.DataFrame:
            return pd.DataFrame({"symbol": [symbol], "seen": [seen], "bars": [n], "dropped": [dropped], "version": [VERSION], "own": [{k: json.dumps(v) for k, v in own.items()}]})

        for batch in batches:
            for bar in as_bars(batch):
                if own is None or bar["symbol"] != symbol:
                    if own is not None:
                        yield row()
                    symbol, seen, n, dropped, own = bar["symbol"], None, 0, 0, {k: i.start() for k, i in indicators.items()}
                if seen is not None and bar["ts"] <= seen:
                    dropped += 1
                    continue
                advanced(indicators, own, bar)
                seen, n = bar["ts"], n + 1
        if own is not None:
            yield row()

    known = bars.where(F.col("symbol").isNotNull() & F.col("ts").isNotNull())
    return known.repartition("symbol").sortWithinPartitions("symbol", "ts").mapInPandas(fold, STATES)
