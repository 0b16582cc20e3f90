"""Windows and running values of a series as numpy kernels, for series in pieces and for wide windows.

A window of n rows spans two blocks of n rows at most, so its sum is the end of one block
and the beginning of the next: running sums from the left and from the right of
each block give every window with one addition, whatever n is, and nothing is
subtracted that rounding could leave behind. The same holds for extremes, and for means
and squared deviations, whose halves are merged. Missing values are NaN.

``Window``, ``Running`` and ``Share`` are steps like the recurrences of ``barline.plans.scan``:
each can be summed up for a piece and carried to the next one. A window carries
its last rows, a running sum its total, a fill its last value.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np


def blocks(x: np.ndarray, n: int, fill: float) -> np.ndarray:
    """``x`` as rows of n values, the last one filled up."""
    rows = -(-len(x) // n)
    out = np.full(rows * n, fill)
    out[: len(x)] = x
    return out.reshape(rows, n)


def both_ends(x: np.ndarray, n: int, fill: float, along: Callable) -> tuple[np.ndarray, np.ndarray]:
    """For each window of n rows: what lies in the earlier block (``fill`` where it is a whole block) and in the later one."""
    rows = blocks(x, n, fill)
    later = along(rows).ravel()[n - 1 : len(x)]
    earlier = along(rows[:, ::-1])[:, ::-1].ravel()[: max(0, len(x) - n + 1)]
    whole = np.arange(len(earlier)) % n == 0
    return np.where(whole, fill, earlier), later


def padded(y: np.ndarray, size: int) -> np.ndarray:
    """Results of full windows, after NaN for the rows before the first one."""
    out = np.full(size, np.nan)
    out[size - len(y) :] = y
    return out


def window_sum(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of all full windows (no missing values)."""
    earlier, later = both_ends(x, n, 0.0, lambda rows: np.cumsum(rows, axis=1))
    return earlier + later


def there_in(x: np.ndarray, n: int) -> np.ndarray:
    """How many values of each full window are there."""
    total = np.concatenate([[0], np.cumsum(~np.isnan(x))])
    return total[n:] - total[:-n] if len(x) >= n else np.zeros(0, np.int64)


def rolling_sum(x: np.ndarray, n: int, least: int | None = None) -> np.ndarray:
    """Sums of full windows with ``least`` values (all of them, if not given); missing ones are passed over."""
    made = window_sum(np.nan_to_num(x, nan=0.0), n)
    return padded(np.where(there_in(x, n) >= (n if least is None else least), made, np.nan), len(x))


@dataclass(frozen=True)
class Halves:
    """Both parts of every full window: the blocks' first values, rows of the parts, and the values' distance from their block's first one."""

    n_early: np.ndarray
    first_early: np.ndarray
    first_late: np.ndarray
    apart: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray, n: int) -> Halves:
        rows = blocks(np.nan_to_num(x, nan=0.0), n, 0.0)
        k = np.arange(max(0, len(x) - n + 1))
        start = rows[:, 0] if len(rows) else np.zeros(1)
        return cls((n - k % n) % n, start[k // n], start[np.minimum((k + n - 1) // n, len(start) - 1)], (rows - start[: len(rows), None]).ravel()[: len(x)])

    def sums(self, x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        return both_ends(x, n, 0.0, lambda rows: np.cumsum(rows, axis=1))


def rolling_mean(x: np.ndarray, n: int) -> np.ndarray:
    halves = Halves.of(x, n)
    early, late = halves.sums(halves.apart, n)
    made = halves.first_early + (early + late + (n - halves.n_early) * (halves.first_late - halves.first_early)) / n
    return padded(np.where(there_in(x, n) == n, made, np.nan), len(x))


def rolling_variance(x: np.ndarray, n: int, ddof: int = 1) -> np.ndarray:
    """Squared deviations over n - ddof; those of the two parts of a window are merged."""
    halves = Halves.of(x, n)
    s_early, s_late = halves.sums(halves.apart, n)
    q_early, q_late = halves.sums(halves.apart**2, n)
    n_early, n_late = halves.n_early, n - halves.n_early
    some = np.maximum(n_early, 1)
    between = halves.first_early + s_early / some - (halves.first_late + s_late / n_late)
    squares = (q_early - s_early**2 / some) + (q_late - s_late**2 / n_late) + np.where(n_early > 0, between**2 * n_early * n_late / n, 0.0)
    return padded(np.where(there_in(x, n) == n, np.maximum(squares, 0.0) / max(n - ddof, 1), np.nan), len(x))


def rolling_wma(x: np.ndarray, n: int) -> np.ndarray:
    """Means with weights 1 for the oldest up to n for the newest value, from sums of values and of values times their place in a block."""
    halves = Halves.of(x, n)
    s_early, s_late = halves.sums(halves.apart, n)
    p_early, p_late = halves.sums(halves.apart * (np.arange(len(x)) % n), n)
    first, n_early, weight = np.arange(len(s_early)) % n, halves.n_early, n * (n + 1) / 2
    # The value at place p of the earlier block has weight p - first + 1, one at place p of the later block n - first more.
    total = p_early + (1 - first) * s_early + p_late + np.where(first == 0, 1, n - first + 1) * s_late
    made = halves.first_early + (total + (weight - n_early * (n_early + 1) / 2) * (halves.first_late - halves.first_early)) / weight
    return padded(np.where(there_in(x, n) == n, made, np.nan), len(x))


def rolling_max(x: np.ndarray, n: int) -> np.ndarray:
    earlier, later = both_ends(np.where(np.isnan(x), -np.inf, x), n, -np.inf, lambda r: np.maximum.accumulate(r, axis=1))
    return padded(np.where(there_in(x, n) == n, np.maximum(earlier, later), np.nan), len(x))


def rolling_min(x: np.ndarray, n: int) -> np.ndarray:
    return -rolling_max(-x, n)


def _latest_max(rows: np.ndarray) -> np.ndarray:
    """Place of the latest greatest value up to each place of each row."""
    most = np.maximum.accumulate(rows, axis=1)
    return np.maximum.accumulate(np.where(rows == most, np.arange(rows.shape[1]), 0), axis=1)


def rows_since_max(x: np.ndarray, n: int) -> np.ndarray:
    """How many rows ago the latest greatest value of a full window of n rows was."""
    full = np.where(np.isnan(x), -np.inf, x)
    rows = blocks(full, n, -np.inf)
    late = (_latest_max(rows) + n * np.arange(len(rows))[:, None]).ravel()[n - 1 : len(x)]
    # From the right, an earlier value counts only if it is greater.
    back = rows[:, ::-1]
    most = np.maximum.accumulate(back, axis=1)
    greater = np.ones(back.shape, bool)
    greater[:, 1:] = back[:, 1:] > most[:, :-1]
    place = np.maximum.accumulate(np.where(greater, np.arange(n), 0), axis=1)
    early = (n - 1 - place[:, ::-1] + n * np.arange(len(rows))[:, None]).ravel()[: len(late)]
    k = np.arange(len(late))
    at = np.where((k % n == 0) | (full[late] >= full[early]), late, early)
    return padded(np.where(there_in(x, n) == n, k + n - 1 - at, np.nan), len(x))


def lag(x: np.ndarray, n: int) -> np.ndarray:
    """The value of the row before, as of a window of two rows (n rows: of the first one)."""
    return padded(x[: max(0, len(x) - n + 1)], len(x))


#: Kernels by name: values and rows of the window to results.
KERNELS: dict[str, Callable[[np.ndarray, int], np.ndarray]] = {
    "sum": rolling_sum,
    "sum_there": lambda x, n: rolling_sum(x, n, 1),
    "mean": rolling_mean,
    "variance": rolling_variance,
    "population_variance": lambda x, n: rolling_variance(x, n, 0),
    "std": lambda x, n: np.sqrt(rolling_variance(x, n)),
    "wma": rolling_wma,
    "max": rolling_max,
    "min": rolling_min,
    "since_max": rows_since_max,
    "since_min": lambda x, n: rows_since_max(-x, n),
    "first": lag,
    "rows": lambda x, n: padded(np.full(max(0, len(x) - n + 1), float(n)), len(x)),
}


@dataclass(frozen=True)
class Window:
    """A kernel over the last n rows of a column; ``first`` gives the oldest of them, ``rows`` whether there are so many."""

    source: str
    out: str
    n: int
    kind: str

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,)

    @property
    def fresh(self) -> np.ndarray:
        return np.zeros(0)

    def run(self, columns: list[np.ndarray], carried: np.ndarray) -> np.ndarray:
        before = len(carried)
        return KERNELS[self.kind](np.concatenate([carried, columns[0]]), self.n)[before:]

    def summary(self, columns: list[np.ndarray]) -> np.ndarray:
        return columns[0][max(0, len(columns[0]) - self.n + 1) :] if self.n > 1 else np.zeros(0)

    def carry(self, carried: np.ndarray, summary: np.ndarray) -> np.ndarray:
        both = np.concatenate([carried, summary])
        return both[max(0, len(both) - self.n + 1) :] if self.n > 1 else both[:0]


@dataclass(frozen=True)
class Running:
    """From the start of the series: ``sum`` of the values there are (missing before the first), ``last`` value, or ``row`` number from 1.

    With ``reset``, a sum begins anew where that column changes.
    """

    source: str
    out: str
    kind: str
    reset: str | None = None

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,) if self.reset is None else (self.source, self.reset)

    @property
    def fresh(self) -> np.ndarray:
        return np.array([np.nan, 0.0 if self.kind == "row" else np.nan])  # key, value so far

    def _parts(self, columns: list[np.ndarray]) -> np.ndarray:
        """Where parts with one key begin."""
        key = columns[1] if self.reset else np.zeros(len(columns[0]))
        return np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)

    def run(self, columns: list[np.ndarray], carried: np.ndarray) -> np.ndarray:
        x = columns[0]
        if self.kind == "row":
            return carried[1] + np.arange(1, len(x) + 1)
        if self.kind == "last":
            there = ~np.isnan(x)
            at = np.maximum.accumulate(np.where(there, np.arange(len(x)), -1))
            return np.where(at >= 0, x[np.maximum(at, 0)], carried[1])
        out, begin = np.empty(len(x)), self._parts(columns)
        for a, b in zip(begin.tolist(), [*begin[1:].tolist(), len(x)]):
            goes_on = a == 0 and not np.isnan(carried[1]) and (self.reset is None or carried[0] == columns[1][0])
            total = np.cumsum(np.nan_to_num(x[a:b], nan=0.0)) + (carried[1] if goes_on else 0.0)
            seen = np.cumsum(~np.isnan(x[a:b])) > 0
            out[a:b] = total if goes_on else np.where(seen, total, np.nan)
        return out

    def summary(self, columns: list[np.ndarray]) -> np.ndarray:
        x = columns[0]
        if self.kind == "row":
            return np.array([0.0, 0.0, len(x)])
        if not len(x):
            return np.array([0.0, 0.0, np.nan])
        if self.kind == "last":
            return np.array([0.0, 0.0, self.run(columns, self.fresh)[-1]])
        begin = self._parts(columns)
        first, last = (columns[1][0], columns[1][-1]) if self.reset else (0.0, 0.0)
        return np.array([float(len(begin) == 1 and first == first), last, self.run(columns, self.fresh)[-1]])

    def carry(self, carried: np.ndarray, summary: np.ndarray) -> np.ndarray:
        alone, key, value = summary
        if self.kind == "row":
            return np.array([0.0, carried[1] + value])
        if self.kind == "last":
            return np.array([0.0, carried[1] if np.isnan(value) else value])
        goes_on = alone and (self.reset is None or carried[0] == key)
        if goes_on and not np.isnan(carried[1]):
            value = carried[1] + (0.0 if np.isnan(value) else value)
        return np.array([key, value])
