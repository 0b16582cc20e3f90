"""How many rows an indicator needs for its first complete result."""

from __future__ import annotations

from collections.abc import Callable

from barline.errors import InvalidParameter, window

_PERIODS: dict[str, Callable[..., int]] = {
    "sma": lambda n=14: n,
    "ema": lambda n=14: n,
    "wilder": lambda n=14: n,
    "wma": lambda n=14: n,
    "macd": lambda fast=12, slow=26, signal=9: slow + signal - 1,
    "adx": lambda n=14: 2 * n,
    "aroon": lambda n=25: n + 1,
    "rsi": lambda n=14: n,
    "stoch_rsi": lambda n=14, k=3, d=3: 2 * n + k + d - 3,
    "stochastic": lambda k_period=14, k_smooth=3, d_period=3: k_period + k_smooth + d_period - 2,
    "williams_r": lambda n=14: n,
    "roc": lambda n=12: n + 1,
    "atr": lambda n=14: n,
    "bollinger": lambda n=20: n,
    "keltner": lambda ema_window=20, atr_window=10: max(ema_window, atr_window),
    "donchian": lambda n=20: n,
    "obv": lambda: 1,
    "vwap": lambda n=1: n,
    "mfi": lambda n=14: n + 1,
    "cmf": lambda n=20: n,
}


def min_periods(indicator: str, **parameters: int) -> int:
    """Rows until all outputs of an indicator are there, for its parameters (the defaults are those of its function)."""
    if indicator not in _PERIODS:
        raise InvalidParameter(f"unknown indicator {indicator!r}")
    for name, value in parameters.items():
        window(value, name)
    return _PERIODS[indicator](**parameters)
