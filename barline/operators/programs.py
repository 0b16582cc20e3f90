"""Indicators as lists of steps over a series, for one grouped pass.

A ``Program`` names the columns it reads, its steps and its outputs. ``study`` runs any
number of programs over the same series in one pass with one exchange; steps that
several programs need (a previous close, the true range) are made once. Series in
``pieces`` are solved piece by piece in tasks of their own, whatever the indicator.
The indicators of ``operators`` use these for pieces and for windows wider than WIDE,
where the work of a Spark window grows with its width and that of a kernel does not.

Missing values (null, NaN, infinite) are NaN inside and null in the results.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from barline.errors import InvalidParameter, columns, window
from barline.functions.windows import BARS, EPSILON, Series, with_columns
from barline.plans.rolls import KERNELS, Running, Window
from barline.plans.scan import Derived, Scan, Step, linear_scans

#: Windows of more rows run in kernels.
WIDE = 64
#: Beyond this a running volume is an error.
OBV_LIMIT = 1e15


@dataclass(frozen=True)
class Program:
    needs: tuple[str, ...]
    steps: tuple[Step | Derived, ...]
    outputs: tuple[str, ...]
    #: Columns that Spark makes before the pass, from the name of the order column.
    prepared: tuple[tuple[str, Callable[[str], Column]], ...] = field(default=())


def study(df: DataFrame, programs: Sequence[Program], series: Series = BARS, pieces: str | int | None = None, fillna: bool = False) -> DataFrame:
    """``df`` with the outputs of all programs, in one grouped pass (several for pieces)."""
    columns(df, *[c for p in programs for c in p.needs])
    steps = list({s.out: s for p in programs for s in p.steps}.values())
    outputs = list(dict.fromkeys(c for p in programs for c in p.outputs))
    prepared = {k: make(series.order[0]) for p in programs for k, make in p.prepared}
    made = linear_scans(df.withColumns(prepared), steps, series, pieces, outputs).drop(*prepared)
    return with_columns(made, {c: F.col(c) for c in outputs}, True) if fillna else made


def kernels(n: int, pieces: str | int | None) -> bool:
    """Whether an indicator of n rows runs in kernels."""
    return pieces is not None or window(n) > WIDE


def rolling(kind: str, n: int, column: str = "close", out: str | None = None) -> Program:
    """A rolling function of one column (the names of ``barline.plans.rolls.KERNELS``)."""
    if kind not in KERNELS:
        raise InvalidParameter(f"unknown rolling function {kind!r}")
    window(n)
    name = out or f"{kind}_{n}"
    return Program((column,), (Window(column, name, n, kind),), (name,))


def _unless(bad: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.where(bad, np.nan, value)


def _less(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a - b


def _relative(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return _unless(before == 0, (x - before) / before)


def shift(n: int, column: str = "close", out: str | None = None) -> Program:
    """The value n rows ago."""
    name = out or f"shift_{n}"
    return Program((column,), (Window(column, name, window(n) + 1, "first"),), (name,))


def diff(n: int = 1, column: str = "close", out: str | None = None) -> Program:
    name, before = out or f"diff_{n}", f"__lag{n}_{column}"
    return Program((column,), (Window(column, before, window(n) + 1, "first"), Derived((column, before), name, _less)), (name,))


def pct_change(n: int = 1, column: str = "close", out: str | None = None) -> Program:
    name, before = out or f"pct_change_{n}", f"__lag{n}_{column}"
    return Program((column,), (Window(column, before, window(n) + 1, "first"), Derived((column, before), name, _relative)), (name,))


def ffill(column: str = "close", out: str = "ffill") -> Program:
    return Program((column,), (Running(column, out, "last"),), (out,))


def running_sum(column: str = "close", out: str = "running_sum") -> Program:
    return Program((column,), (Running(column, out, "sum"),), (out,))


def average(kind: str, n: int, column: str = "close", out: str | None = None) -> Program:
    """Exponential (``ema``) or Wilder's (``wilder``) average."""
    window(n)
    name = out or f"{kind}_{n}"
    return Program((column,), (Scan(column, name, n, kind),), (name,))


def macd(fast: int = 12, slow: int = 26, signal: int = 9) -> Program:
    a, b = f"__ema{fast}_close", f"__ema{slow}_close"
    steps = (
        Scan("close", a, fast, "ema"), Scan("close", b, slow, "ema"), Derived((a, b), "macd", _less),
        Scan("macd", "macd_signal", signal, "ema"), Derived(("macd", "macd_signal"), "macd_histogram", _less),
    )
    return Program(("close",), steps, ("macd", "macd_signal", "macd_histogram"))


def _before(*names: str) -> tuple[Window, ...]:
    return tuple(Window(c, f"__lag1_{c}", 2, "first") for c in names)


def _true_range(high: np.ndarray, low: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))


_TR = (*_before("close"), Derived(("high", "low", "__lag1_close"), "__tr", _true_range))


def _up(high: np.ndarray, high_before: np.ndarray, low: np.ndarray, low_before: np.ndarray) -> np.ndarray:
    up, down = high - high_before, low_before - low
    return np.where((up > down) & (up > 0), up, 0.0)


def _down(high: np.ndarray, high_before: np.ndarray, low: np.ndarray, low_before: np.ndarray) -> np.ndarray:
    up, down = high - high_before, low_before - low
    return np.where((down > up) & (down > 0), down, 0.0)


def _directional(move: np.ndarray, reach: np.ndarray) -> np.ndarray:
    """The share of a movement in the range, in percent; 0 without a range."""
    wide = np.abs(reach) >= EPSILON
    return _unless(np.isnan(reach), np.where(wide, 100 * move / np.where(wide, reach, 1.0), 0.0))


def _difference(plus: np.ndarray, minus: np.ndarray) -> np.ndarray:
    both = plus + minus
    return np.where(both > EPSILON, 100 * np.abs(plus - minus) / np.where(both > EPSILON, both, 1.0), both * 0.0)


def adx(n: int = 14) -> Program:
    moves = ("high", "__lag1_high", "low", "__lag1_low")
    steps = (
        *_TR, *_before("high", "low"), Derived(moves, "__plus", _up), Derived(moves, "__minus", _down),
        *[Scan(f"__{x}", f"__sum{n}_{x}", n, "sum_skip") for x in ("tr", "plus", "minus")],
        *[Derived((f"__sum{n}_{x}", f"__sum{n}_tr"), f"{x}_di", _directional) for x in ("plus", "minus")],
        Derived(("plus_di", "minus_di"), f"__dx{n}", _difference), Scan(f"__dx{n}", "adx", n, "wilder"),
    )
    return Program(("high", "low", "close"), steps, ("adx", "plus_di", "minus_di"))


def _share_of(n: int, since: np.ndarray, other: np.ndarray) -> np.ndarray:
    return _unless(np.isnan(other), 100.0 * (n - since) / n)


def aroon(n: int = 25) -> Program:
    high, low = f"__since_max{n}", f"__since_min{n}"
    steps = (
        Window("high", high, window(n) + 1, "since_max"), Window("low", low, n + 1, "since_min"),
        Derived((high, low), "aroon_up", partial(_share_of, n)), Derived((low, high), "aroon_down", partial(_share_of, n)), Derived(("aroon_up", "aroon_down"), "aroon_oscillator", _less),
    )
    return Program(("high", "low"), steps, ("aroon_up", "aroon_down", "aroon_oscillator"))


def _gain(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.where(x > before, x - before, 0.0)


def _loss(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    return np.where(x < before, before - x, 0.0)


def _strength(n: int, gain: np.ndarray, loss: np.ndarray, row: np.ndarray) -> np.ndarray:
    some = np.where(loss < EPSILON, 1.0, loss)
    value = np.where(loss < EPSILON, np.where(gain < EPSILON, 50.0, 100.0), np.where(gain < EPSILON, 0.0, 100 - 100 / (1 + gain / some)))
    return _unless((row < n) | np.isnan(gain) | np.isnan(loss), value)


def rsi(n: int = 14, column: str = "close", out: str | None = None) -> Program:
    window(n)
    name, before, gain, loss = out or f"rsi_{n}", f"__lag1_{column}", f"__gain_{column}", f"__loss_{column}"
    steps = (
        *_before(column), Derived((column, before), gain, _gain), Derived((column, before), loss, _loss), Running(column, "__row", "row"),
        Scan(gain, f"{gain}{n}", n, "first"), Scan(loss, f"{loss}{n}", n, "first"), Derived((f"{gain}{n}", f"{loss}{n}", "__row"), name, partial(_strength, n)),
    )
    return Program((column,), steps, (name,))


def _within(x: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.where(high - low < EPSILON, 0.5, (x - low) / (high - low))


def stoch_rsi(n: int = 14, k: int = 3, d: int = 3) -> Program:
    steps = (
        *rsi(n, out=f"__rsi{n}").steps, Window(f"__rsi{n}", f"__rsi_low{n}", n, "min"), Window(f"__rsi{n}", f"__rsi_high{n}", n, "max"),
        Derived((f"__rsi{n}", f"__rsi_low{n}", f"__rsi_high{n}"), "stoch_rsi", _within), Window("stoch_rsi", "stoch_rsi_k", window(k), "mean"), Window("stoch_rsi_k", "stoch_rsi_d", window(d), "mean"),
    )
    return Program(("close",), steps, ("stoch_rsi", "stoch_rsi_k", "stoch_rsi_d"))


def _ratio(top: np.ndarray, bottom: np.ndarray, otherwise: float) -> np.ndarray:
    zero = np.abs(bottom) < EPSILON
    return _unless(np.isnan(bottom), np.where(zero, otherwise, top / np.where(zero, 1.0, bottom)))


def _above_low(close: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return 100 * _ratio(close - low, high - low, 0.5)


def _below_high(close: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return -100 * _ratio(high - close, high - low, 0.5)


def _extremes(n: int) -> tuple[Window, Window]:
    return Window("low", f"__low{n}", window(n), "min"), Window("high", f"__high{n}", n, "max")


def stochastic(k_period: int = 14, k_smooth: int = 3, d_period: int = 3) -> Program:
    raw = f"__above{k_period}"
    steps = (*_extremes(k_period), Derived(("close", f"__low{k_period}", f"__high{k_period}"), raw, _above_low), Window(raw, "stoch_k", window(k_smooth), "mean"), Window("stoch_k", "stoch_d", window(d_period), "mean"))
    return Program(("high", "low", "close"), steps, ("stoch_k", "stoch_d"))


def williams_r(n: int = 14) -> Program:
    return Program(("high", "low", "close"), (*_extremes(n), Derived(("close", f"__low{n}", f"__high{n}"), f"williams_r_{n}", _below_high)), (f"williams_r_{n}",))


def _percent(x: np.ndarray, before: np.ndarray) -> np.ndarray:
    zero = np.abs(before) < EPSILON
    return _unless(zero, 100 * (x - before) / np.where(zero, 1.0, before))


def roc(n: int = 12, column: str = "close") -> Program:
    before = f"__lag{window(n)}_{column}"
    return Program((column,), (Window(column, before, n + 1, "first"), Derived((column, before), f"roc_{n}", _percent)), (f"roc_{n}",))


def atr(n: int = 14, out: str | None = None) -> Program:
    window(n)
    name = out or f"atr_{n}"
    return Program(("high", "low", "close"), (*_TR, Scan("__tr", name, n, "wilder")), (name,))


def _band(times: float, middle: np.ndarray, width: np.ndarray) -> np.ndarray:
    return middle + times * width


def _relative_width(upper: np.ndarray, middle: np.ndarray, lower: np.ndarray) -> np.ndarray:
    zero = np.abs(middle) < EPSILON
    return _unless(zero, (upper - lower) / np.where(zero, 1.0, middle))


def _place(x: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    wide = upper - lower > EPSILON
    return _unless(np.isnan(upper), np.where(wide, (x - lower) / np.where(wide, upper - lower, 1.0), 0.5))


def bollinger(n: int = 20, num_std: float = 2.0, column: str = "close") -> Program:
    spread = f"__std{window(n)}_{column}"
    steps = (
        Window(column, "bb_middle", n, "mean"), Window(column, spread, n, "std"),
        Derived(("bb_middle", spread), "bb_upper", partial(_band, num_std)), Derived(("bb_middle", spread), "bb_lower", partial(_band, -num_std)),
        Derived(("bb_upper", "bb_middle", "bb_lower"), "bb_width", _relative_width), Derived((column, "bb_upper", "bb_lower"), "bb_pct_b", _place),
    )
    return Program((column,), steps, ("bb_upper", "bb_middle", "bb_lower", "bb_width", "bb_pct_b"))


def _where_both(middle: np.ndarray, width: np.ndarray) -> np.ndarray:
    return middle + 0 * width


def keltner(ema_window: int = 20, atr_window: int = 10, multiplier: float = 2.0) -> Program:
    middle, width = f"__ema{ema_window}_close", f"__atr{atr_window}"
    steps = (
        *_TR, Scan("close", middle, window(ema_window), "ema"), Scan("__tr", width, window(atr_window), "wilder"),
        Derived((middle, width), "kc_upper", partial(_band, multiplier)), Derived((middle, width), "kc_middle", _where_both), Derived((middle, width), "kc_lower", partial(_band, -multiplier)),
    )
    return Program(("high", "low", "close"), steps, ("kc_upper", "kc_middle", "kc_lower"))


def _middle(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b) / 2


def donchian(n: int = 20) -> Program:
    steps = (Window("high", "dc_upper", window(n), "max"), Window("low", "dc_lower", n, "min"), Derived(("dc_upper", "dc_lower"), "dc_middle", _middle), Derived(("dc_upper", "dc_lower"), "dc_width", _less))
    return Program(("high", "low"), steps, ("dc_upper", "dc_middle", "dc_lower", "dc_width"))


def _flow(close: np.ndarray, before: np.ndarray, volume: np.ndarray) -> np.ndarray:
    change = close - before
    return np.where(change > EPSILON, volume, np.where(change < -EPSILON, -volume, 0.0))


def _checked(total: np.ndarray) -> np.ndarray:
    if (np.abs(total) > OBV_LIMIT).any():
        raise ArithmeticError("on-balance volume overflow")
    return total


def obv() -> Program:
    steps = (*_before("close"), Derived(("close", "__lag1_close", "volume"), "__flow", _flow), Running("__flow", "__flows", "sum"), Derived(("__flows",), "obv", _checked))
    return Program(("close", "volume"), steps, ("obv",))


def _typical(high: np.ndarray, low: np.ndarray, close: np.ndarray) -> np.ndarray:
    return (high + low + close) / 3


def _money(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    return _typical(high, low, close) * volume


_MONEY = Derived(("high", "low", "close", "volume"), "__money", _money)


def _share(money: np.ndarray, volume: np.ndarray) -> np.ndarray:
    zero = np.abs(volume) < EPSILON
    return _unless(zero, money / np.where(zero, 1.0, volume))


def _day(order: str) -> Column:
    return F.unix_date(F.to_date(order)).cast("double")


def vwap(mode: str = "cumulative", n: int | None = None, out: str = "vwap") -> Program:
    """Without volume the last value stays, also over the end of a session."""
    if mode not in ("cumulative", "rolling", "session"):
        raise InvalidParameter(f"unknown mode {mode!r}")
    label = f"{mode}{n or ''}"
    if mode == "rolling":
        sums = (Window("__money", f"__money_{label}", window(n or 0), "sum_there"), Window("volume", f"__volume_{label}", n, "sum_there"))
    else:
        reset = "__day" if mode == "session" else None
        sums = (Running("__money", f"__money_{label}", "sum", reset), Running("volume", f"__volume_{label}", "sum", reset))
    steps = (_MONEY, *sums, Derived((f"__money_{label}", f"__volume_{label}"), f"__vwap_{label}", _share), Running(f"__vwap_{label}", out, "last"))
    return Program(("high", "low", "close", "volume"), steps, (out,), (("__day", _day),) if mode == "session" else ())


def _inflow(price: np.ndarray, before: np.ndarray, volume: np.ndarray) -> np.ndarray:
    return np.where(price > before, price * volume, 0.0)


def _outflow(price: np.ndarray, before: np.ndarray, volume: np.ndarray) -> np.ndarray:
    return np.where(price < before, price * volume, 0.0)


def _money_flow(n: int, up: np.ndarray, down: np.ndarray, row: np.ndarray) -> np.ndarray:
    up, down = np.nan_to_num(up, nan=0.0), np.nan_to_num(down, nan=0.0)
    none = np.abs(down) < EPSILON
    value = np.where(none, np.where(np.abs(up) < EPSILON, 50.0, 100.0), np.where(np.abs(up) < EPSILON, 0.0, 100 - 100 / (1 + up / np.where(none, 1.0, down))))
    return _unless(row <= n, np.clip(value, 0.0, 100.0))


def mfi(n: int = 14) -> Program:
    flows = ("__tp", "__lag1___tp", "volume")
    steps = (
        Derived(("high", "low", "close"), "__tp", _typical), *_before("__tp"), Derived(flows, "__inflow", _inflow), Derived(flows, "__outflow", _outflow), Running("close", "__row", "row"),
        Window("__inflow", f"__in{window(n)}", n, "sum_there"), Window("__outflow", f"__out{n}", n, "sum_there"), Derived((f"__in{n}", f"__out{n}", "__row"), f"mfi_{n}", partial(_money_flow, n)),
    )
    return Program(("high", "low", "close", "volume"), steps, (f"mfi_{n}",))


def _located(high: np.ndarray, low: np.ndarray, close: np.ndarray, volume: np.ndarray) -> np.ndarray:
    return _ratio(2 * close - high - low, high - low, 0.0) * volume


def _flow_share(flow: np.ndarray, volume: np.ndarray) -> np.ndarray:
    return _ratio(flow, volume, 0.0)


def cmf(n: int = 20) -> Program:
    steps = (Derived(("high", "low", "close", "volume"), "__located", _located), Window("__located", f"__located{window(n)}", n, "sum_there"), Window("volume", f"__volume{n}", n, "sum_there"), Derived((f"__located{n}", f"__volume{n}"), f"cmf_{n}", _flow_share))
    return Program(("high", "low", "close", "volume"), steps, (f"cmf_{n}",))
