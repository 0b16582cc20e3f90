"""Bars and indicators on live data, with checkpointed state for each symbol.

Bars come from ticks by an event-time window with a watermark. Indicators keep a
small versioned state per symbol in Spark's state store. Bars of a micro-batch are
taken in order of time; bars at or before the last one seen are dropped as late.

An indicator of several values has its ``names``; its columns are its own name with
each of them as ``name_suffix`` (without a suffix for an empty one).

Missing values (NULL, NaN, infinite) count as in the batch functions: windows are
undefined or pass over them while they hold one, a recurrence passes over leading
ones and ends at a later one.
"""

from __future__ import annotations

import json
import math
import statistics
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from barline.errors import InvalidParameter, StateVersionError, columns, window
from barline.functions.windows import EPSILON, value
from barline.plans.scan import Scan

VERSION = 1
#: A bar's columns by name; None where a number is missing.
Bar = dict[str, Any]


class Indicator(Protocol):
    """What ``live_indicators`` takes: a state of JSON values, and a step that changes it and gives one value or a tuple."""

    def start(self) -> dict: ...
    def update(self, state: dict, bar: Bar) -> float | tuple | None: ...


def live_bars(ticks: DataFrame, width: str = "1 hour", late: str = "2 hours", symbol: str = "symbol", ts: str = "ts", price: str = "price", volume: str | None = None, tie: str | None = None) -> DataFrame:
    """Bars of a stream of ticks; a bar comes out once the watermark has passed it.

    As in ``sources.bars.bars``: without a volume column ticks are counted, ``tie`` orders
    ticks of one time, and NaN and infinite prices and volumes count as missing.
    """
    columns(ticks, symbol, ts, price, *([volume] if volume else []), *([tie] if tie else []))
    order = F.struct(ts, tie) if tie else F.col(ts)
    amount = F.sum(value(volume)) if volume else F.count(F.lit(1))
    return (
        ticks.withColumn(ts, F.col(ts).cast("timestamp"))
        .withWatermark(ts, late)
        .groupBy(F.col(symbol).alias("symbol"), F.window(ts, width).alias("w"))
        .agg(F.min_by(value(price), order).alias("open"), F.max(value(price)).alias("high"), F.min(value(price)).alias("low"), F.max_by(value(price), order).alias("close"), amount.cast("double").alias("volume"))
        .select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")
    )


class Recurrence:
    """One of the recurrences of ``barline.plans.scan``, value by value."""

    def __init__(self, n: int, kind: str):
        self.scan = Scan("", "", window(n), kind)

    def start(self) -> dict:
        return {"count": 0, "sum": 0.0, "value": None, "ended": False}

    def add(self, state: dict, x: float | None) -> float | None:
        scan = self.scan
        if x is None:
            state["ended"] = state["ended"] or state["count"] > 0
        if x is None or state["ended"]:
            return None
        state["count"] += 1
        if state["count"] <= scan.n:
            state["sum"] += x
        if state["count"] == scan.first_at:
            state["value"] = state["sum"] if scan.kind == "sum_skip" else state["sum"] / state["count"]
        elif state["count"] > scan.first_at:
            state["value"] = scan.a * state["value"] + scan.b * x
        return state["value"]


class Average(Recurrence):
    """Exponential (``ema``) or Wilder's (``wilder``) average of closes, begun at the mean of the first n."""

    def __init__(self, n: int = 14, kind: str = "ema"):
        super().__init__(n, kind)

    def update(self, state: dict, bar: Bar) -> float | None:
        return self.add(state, bar["close"])


class Rolling:
    """A function of the last n closes, once there are n of them and none is missing."""

    def __init__(self, n: int, of: Callable[[list[float]], float]):
        self.n, self.of = window(n), of

    def start(self) -> dict:
        return {}

    def update(self, state: dict, bar: Bar) -> float | None:
        last = kept(state, "last", bar["close"], self.n)
        return None if last is None else self.of(last)


def latest(state: dict, name: str, x: float | None, n: int) -> list[float | None] | None:
    """The last n values with ``x``, once there are n of them."""
    state[name] = [*state.get(name, []), x][-n:]
    return state[name] if len(state[name]) == n else None


def kept(state: dict, name: str, x: float | None, n: int) -> list[float] | None:
    """The last n values with ``x``, once there are n of them that are defined."""
    found = latest(state, name, x, n)
    return None if found is None or None in found else found


def total(values: list[float | None]) -> float | None:
    """Their sum, missing ones passed over; None if there is none."""
    there = [v for v in values if v is not None]
    return math.fsum(there) if there else None


def mean(values: list[float] | None) -> float | None:
    return None if values is None else math.fsum(values) / len(values)


def prices(bar: Bar) -> tuple[float | None, float | None, float | None]:
    return bar["high"], bar["low"], bar["close"]


def typical(bar: Bar) -> float | None:
    return None if None in prices(bar) else sum(prices(bar)) / 3


def product(a: float | None, b: float | None) -> float | None:
    return None if a is None or b is None else a * b


def reach(bar: Bar, close: float | None) -> float | None:
    """The true range after a bar with this close; the widest of those distances that are defined."""
    high, low, _ = prices(bar)
    found = [abs(a - b) if i else a - b for i, (a, b) in enumerate(((high, low), (high, close), (low, close))) if a is not None and b is not None]
    return max(found) if found else None


class Sma(Rolling):
    def __init__(self, n: int = 14):
        super().__init__(n, mean)


class Wma(Rolling):
    """Weights 1 for the oldest up to n for the newest close."""

    def __init__(self, n: int = 14):
        super().__init__(n, lambda x: math.fsum((i + 1) * v for i, v in enumerate(x)) / (n * (n + 1) / 2))


class Roc:
    """Change over n bars in percent; undefined from 0."""

    def __init__(self, n: int = 12):
        self.n = window(n)

    def start(self) -> dict:
        return {}

    def update(self, state: dict, bar: Bar) -> float | None:
        last = latest(state, "last", bar["close"], self.n + 1)
        if last is None or last[0] is None or last[-1] is None or abs(last[0]) < EPSILON:
            return None
        return 100 * (last[-1] - last[0]) / last[0]


class LogReturn:
    """Logarithm of a column's change, or with ``log1p`` (volumes) the change of log(1 + value); ``fill`` where undefined."""

    def __init__(self, column: str = "close", log1p: bool = False, fill: float | None = None):
        self.column, self.log1p, self.fill = column, log1p, fill

    def start(self) -> dict:
        return {}

    def update(self, state: dict, bar: Bar) -> float | None:
        x, seen, before, value = bar[self.column], "before" in state, state.get("before"), None
        if self.log1p:
            x = math.log1p(x) if x is not None and x > 0 else 0.0
            value = x - before if seen else None
        elif before is not None and x is not None and x > 0 and before > 0:
            value = math.log(x / before)
        state["before"] = x
        return self.fill if value is None else value


class Macd:
    """macd, its signal and the difference."""

    names = ("", "signal", "histogram")

    def __init__(self, fast: int = 12, slow: int = 26, signal: int = 9):
        if window(fast) >= window(slow):
            raise InvalidParameter("fast must be below slow")
        self.fast, self.slow, self.signal = Average(fast), Average(slow), Average(signal)

    def start(self) -> dict:
        return {"fast": self.fast.start(), "slow": self.slow.start(), "signal": self.signal.start()}

    def update(self, state: dict, bar: Bar) -> tuple:
        fast, slow = self.fast.update(state["fast"], bar), self.slow.update(state["slow"], bar)
        if fast is None or slow is None:
            return None, None, None
        signal = self.signal.add(state["signal"], fast - slow)
        return fast - slow, signal, None if signal is None else fast - slow - signal


class Adx:
    """adx and the directional indicators."""

    names = ("", "plus_di", "minus_di")

    def __init__(self, n: int = 14):
        if window(n) < 2:
            raise InvalidParameter("adx needs a window of 2 or more")
        self.sums, self.average = Recurrence(n, "sum_skip"), Recurrence(n, "wilder")

    def start(self) -> dict:
        return {"before": [None, None, None], "sums": [self.sums.start() for _ in range(3)], "adx": self.average.start()}

    def update(self, state: dict, bar: Bar) -> tuple:
        high, low, _ = prices(bar)
        h, l, close = state["before"]
        up, down = (None if a is None or b is None else a - b for a, b in ((high, h), (l, low)))
        moves = [0.0, 0.0]
        if up is not None and down is not None:
            moves = [up if up > down and up > 0 else 0.0, down if down > up and down > 0 else 0.0]
        state["before"] = list(prices(bar))
        width, *moved = [self.sums.add(own, x) for own, x in zip(state["sums"], [reach(bar, close), *moves])]
        if width is None or None in moved:
            self.average.add(state["adx"], None)
            return None, None, None
        plus, minus = (100 * x / width if abs(width) >= EPSILON else 0.0 for x in moved)
        return self.average.add(state["adx"], 100 * abs(plus - minus) / (plus + minus) if plus + minus > EPSILON else 0.0), plus, minus


class Aroon:
    """Up, down and oscillator over n + 1 bars; of equal extremes the latest counts."""

    names = ("up", "down", "oscillator")

    def __init__(self, n: int = 25):
        self.n = window(n)

    def start(self) -> dict:
        return {}

    def update(self, state: dict, bar: Bar) -> tuple:
        high, low, _ = prices(bar)
        highs, lows = kept(state, "high", high, self.n + 1), kept(state, "low", low, self.n + 1)
        if highs is None or lows is None:
            return None, None, None
        up = 100.0 * (self.n - highs[::-1].index(max(highs))) / self.n
        down = 100.0 * (self.n - lows[::-1].index(min(lows))) / self.n
        return up, down, up - down


class Rsi:
    """Relative strength; gains and losses are averaged from the first bar's 0 on."""

    def __init__(self, n: int = 14):
        self.n = window(n)

    def start(self) -> dict:
        return {"count": 0, "gain": 0.0, "loss": 0.0, "before": None}

    def update(self, state: dict, bar: Bar) -> float | None:
        x = bar["close"]
        change = x - state["before"] if x is not None and state["before"] is not None else 0.0
        state["gain"] += (max(change, 0.0) - state["gain"]) / self.n
        state["loss"] += (max(-change, 0.0) - state["loss"]) / self.n
        state["before"] = x
        state["count"] += 1
        if state["count"] < self.n:
            return None
        gain, loss = state["gain"], state["loss"]
        if gain < 1e-10 and loss < 1e-10:
            return 50.0
        return 100.0 if loss < 1e-10 else 0.0 if gain < 1e-10 else 100 - 100 / (1 + gain / loss)


class Atr:
    def __init__(self, n: int = 14):
        self.average = Recurrence(n, "wilder")

    def start(self) -> dict:
        return {"average": self.average.start(), "before": None}

    def update(self, state: dict, bar: Bar) -> float | None:
        value = self.average.add(state["average"], reach(bar, state["before"]))
        state["before"] = bar["close"]
        return value


class Obv:
    def start(self) -> dict:
        return {"value": 0.0, "before": None}

    def update(self, state: dict, bar: Bar) -> float:
        x = bar["close"]
        if x is not None and state["before"] is not None and bar["volume"] is not None:
            change = x - state["before"]
            state["value"] += bar["volume"] * ((change > EPSILON) - (change < -EPSILON))
        state["before"] = x
        return state["value"]


class Vwap:
    """Volume-weighted typical price since the start, or since the day began; without volume the last value stays."""

    def __init__(self, session: bool = False):
        self.session = session

    def start(self) -> dict:
        return {"money": None, "volume": None, "value": None, "day": None}

    def update(self, state: dict, bar: Bar) -> float | None:
        day = str(pd.Timestamp(bar["ts"]).date())
        if self.session and state["day"] != day:
            state["money"] = state["volume"] = None
        state["day"] = day
        for name, x in (("money", product(typical(bar), bar["volume"])), ("volume", bar["volume"])):
            state[name] = total([state[name], x])
        if state["money"] is not None and abs(state["volume"]) >= EPSILON:
            state["value"] = state["money"] / state["volume"]
        return state["value"]


class RollingVwap:
    """Volume-weighted typical price over n bars; without volume the last value stays."""

    def __init__(self, n: int):
        self.n = window(n)

    def start(self) -> dict:
        return {"value": None}

    def update(self, state: dict, bar: Bar) -> float | None:
        last = [latest(state, name, x, self.n) for name, x in (("money", product(typical(bar), bar["volume"])), ("volume", bar["volume"]))]
        if None not in last:
            money, volume = (total(x) for x in last)
            if money is not None and volume is not None and abs(volume) >= EPSILON:
                state["value"] = money / volume
        return state["value"]


class StochRsi:
    """The place of the strength in its range, and two averages of it, from 0 to 1."""

    names = ("", "k", "d")

    def __init__(self, n: int = 14, k: int = 3, d: int = 3):
        self.n, self.k, self.d, self.rsi = window(n), window(k), window(d), Rsi(n)

    def start(self) -> dict:
        return {"rsi": self.rsi.start()}

    def update(self, state: dict, bar: Bar) -> tuple:
        last = kept(state, "last", self.rsi.update(state["rsi"], bar), self.n)
        value = None
        if last is not None:
            low, high = min(last), max(last)
            value = 0.5 if high - low < EPSILON else (last[-1] - low) / (high - low)
        k = mean(kept(state, "raw", value, self.k))
        return value, k, mean(kept(state, "smooth", k, self.d))


class Channel:
    """High and low of the last n bars."""

    def __init__(self, n: int):
        self.n = window(n)

    def start(self) -> dict:
        return {}

    def range(self, state: dict, bar: Bar) -> tuple[float, float] | None:
        high, low, _ = prices(bar)
        highs, lows = kept(state, "high", high, self.n), kept(state, "low", low, self.n)
        return None if highs is None or lows is None else (max(highs), min(lows))


class Stochastic(Channel):
    """The smoothed place of the close in the range, and its average; 50 in a window without range."""

    names = ("k", "d")

    def __init__(self, k_period: int = 14, k_smooth: int = 3, d_period: int = 3):
        super().__init__(k_period)
        self.k, self.d = window(k_smooth), window(d_period)

    def update(self, state: dict, bar: Bar) -> tuple:
        ends, raw, close = self.range(state, bar), None, bar["close"]
        if ends is not None and close is not None:
            high, low = ends
            raw = 100 * ((close - low) / (high - low) if high - low >= EPSILON else 0.5)
        k = mean(kept(state, "raw", raw, self.k))
        return k, mean(kept(state, "smooth", k, self.d))


class WilliamsR(Channel):
    """-100 to 0; -50 in a window without range."""

    def __init__(self, n: int = 14):
        super().__init__(n)

    def update(self, state: dict, bar: Bar) -> float | None:
        ends, close = self.range(state, bar), bar["close"]
        if ends is None or close is None:
            return None
        high, low = ends
        return -100 * ((high - close) / (high - low) if high - low >= EPSILON else 0.5)


class Donchian(Channel):
    names = ("upper", "middle", "lower", "width")

    def __init__(self, n: int = 20):
        super().__init__(n)

    def update(self, state: dict, bar: Bar) -> tuple:
        highs, lows = kept(state, "high", bar["high"], self.n), kept(state, "low", bar["low"], self.n)
        high, low = highs and max(highs), lows and min(lows)
        if high is None or low is None:
            return high, None, low, None
        return high, (high + low) / 2, low, high - low


class Bollinger:
    """Bands of the sample deviation (0 for one bar)."""

    names = ("upper", "middle", "lower", "width", "pct_b")

    def __init__(self, n: int = 20, num_std: float = 2.0):
        if num_std <= 0:
            raise InvalidParameter("num_std must be positive")
        self.n, self.num_std = window(n), num_std

    def start(self) -> dict:
        return {}

    def update(self, state: dict, bar: Bar) -> tuple:
        last = kept(state, "last", bar["close"], self.n)
        if last is None:
            return None, None, None, None, None
        middle, spread = mean(last), self.num_std * (statistics.stdev(last) if self.n > 1 else 0.0)
        upper, lower = middle + spread, middle - spread
        width = (upper - lower) / middle if abs(middle) >= EPSILON else None
        return upper, middle, lower, width, (last[-1] - lower) / (upper - lower) if upper - lower > EPSILON else 0.5


class Keltner:
    """An exponential average with bands of the average true range."""

    names = ("upper", "middle", "lower")

    def __init__(self, ema_window: int = 20, atr_window: int = 10, multiplier: float = 2.0):
        if multiplier <= 0:
            raise InvalidParameter("multiplier must be positive")
        self.ema, self.atr, self.multiplier = Average(ema_window), Atr(atr_window), multiplier

    def start(self) -> dict:
        return {"ema": self.ema.start(), "atr": self.atr.start()}

    def update(self, state: dict, bar: Bar) -> tuple:
        middle, reach = self.ema.update(state["ema"], bar), self.atr.update(state["atr"], bar)
        if middle is None or reach is None:
            return None, None, None
        return middle + self.multiplier * reach, middle, middle - self.multiplier * reach


class Mfi:
    """Money flow index, 0 to 100, from the bar after the first n on."""

    def __init__(self, n: int = 14):
        self.n = window(n)

    def start(self) -> dict:
        return {"count": 0, "before": None}

    def update(self, state: dict, bar: Bar) -> float | None:
        price, before = typical(bar), state["before"]
        change, flow = 0.0 if before is None or price is None else price - before, product(price, bar["volume"])
        state["before"] = price
        state["count"] += 1
        ups, downs = latest(state, "up", flow if change > 0 else 0.0, self.n), latest(state, "down", flow if change < 0 else 0.0, self.n)
        if ups is None or downs is None or state["count"] <= self.n:
            return None
        up, down = total(ups) or 0.0, total(downs) or 0.0
        if abs(down) < EPSILON:
            return 50.0 if abs(up) < EPSILON else 100.0
        return 0.0 if abs(up) < EPSILON else min(max(100 - 100 / (1 + up / down), 0.0), 100.0)


class Cmf:
    """Chaikin money flow, -1 to 1; 0 without volume."""

    def __init__(self, n: int = 20):
        self.n = window(n)

    def start(self) -> dict:
        return {}

    def update(self, state: dict, bar: Bar) -> float | None:
        high, low, close = prices(bar)
        place = None
        if None not in (high, low, close):
            place = (2 * close - high - low) / (high - low) if abs(high - low) >= EPSILON else 0.0
        last = [latest(state, name, x, self.n) for name, x in (("flow", product(place, bar["volume"])), ("volume", bar["volume"]))]
        if None in last:
            return None
        flow, volume = (total(x) for x in last)
        if volume is None or (flow is None and abs(volume) >= EPSILON):
            return None
        return flow / volume if abs(volume) >= EPSILON else 0.0


def as_bars(rows: pd.DataFrame) -> Iterator[Bar]:
    """Rows as plain values, numbers that are missing as None."""
    columns = {}
    for c in rows.columns:
        values = rows[c].tolist()
        columns[c] = [None if isinstance(v, float) and not math.isfinite(v) else v for v in values]
    for values in zip(*columns.values()):
        yield dict(zip(columns, values))


def live_indicators(bars: DataFrame, indicators: dict[str, Indicator], idle: str | None = None) -> DataFrame:
    """A stream of bars with a column for each value of each indicator.

    With ``idle`` (a pandas duration such as "2 days"), the state of a symbol without
    bars for that long is given up, and the symbol starts anew.
    """
    columns = {k: [f"{k}_{n}" if n else k for n in getattr(i, "names", ("",))] for k, i in indicators.items()}
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)

    def advance(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        saved = json.loads(state.get[0]) if state.exists else {"version": VERSION, "seen": None, "own": {k: i.start() for k, i in indicators.items()}}
        if saved["version"] != VERSION:
            raise StateVersionError(str(saved["version"]))
        rows = pd.concat(list(parts)).sort_values("ts", kind="stable")
        if saved["seen"] is not None:
            rows = rows[rows["ts"] > pd.Timestamp(saved["seen"])]
        rows = rows.drop_duplicates("ts").reset_index(drop=True)
        made: dict[str, list] = {c: [] for own in columns.values() for c in own}
        for bar in as_bars(rows):
            for k, i in indicators.items():
                value = i.update(saved["own"][k], bar)
                for c, v in zip(columns[k], value if isinstance(value, tuple) else (value,)):
                    made[c].append(v)
        if len(rows):
            saved["seen"] = str(rows["ts"].iloc[-1])
        state.update((json.dumps(saved),))
        if wait is not None:
            state.setTimeoutDuration(wait)
        for k, values in made.items():
            rows[k] = pd.Series(values, dtype="float64")
        yield rows

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in bars.schema.fields)
    out = fields + "".join(f", `{c}` double" for own in columns.values() for c in own)
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return bars.groupBy("symbol").applyInPandasWithState(advance, out, "state string", "append", timeout)
