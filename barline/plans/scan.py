"""First-order linear recurrences y[t] = a * y[t-1] + b * x[t] over each series.

No window function expresses them. All recurrences that a plan needs run in one
grouped pass over Arrow tables: a numpy kernel solves blocks of rows by a triangular
product and carries one number from block to block. Seeds differ by indicator:

* ``ema``, ``wilder``: the mean of the first n values, at the n-th;
* ``first``: the first value itself;
* ``sum_skip``: the sum of the first n values, at the row after them, whose own
  value is left out (directional movement).

Missing values (NULL, NaN, infinite): leading ones are passed over and the
recurrence begins at the first value; a later one ends it, so that it and all rows
after it have no result, while the rows before it keep theirs.

Windows and running values (``barline.plans.rolls``) are steps of the same passes.

A series that is too long for one task is cut by its order (``pieces``, a unit of
time such as "month", or a number for numeric orders). A piece is summed up by its
number of values, its first values and its answer to a zero start; since such maps
compose, the value before each piece follows from these few numbers, and every piece
is then solved in a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barline.errors import window
from barline.functions.windows import BARS, Series
from barline.plans.lineage import checkpointed

_ROWS = 128


@dataclass(frozen=True)
class Scan:
    source: str
    out: str
    n: int
    kind: str  # ema, wilder, first or sum_skip

    @property
    def first_at(self) -> int:
        """How many values there must be for the first result."""
        return {"ema": self.n, "wilder": self.n, "first": 1, "sum_skip": self.n + 1}[self.kind]

    @property
    def a(self) -> float:
        return 1 - 2 / (self.n + 1) if self.kind == "ema" else 1 - 1 / self.n

    @property
    def b(self) -> float:
        return {"ema": 2 / (self.n + 1), "sum_skip": 1.0}.get(self.kind, 1 / self.n)

    def seed(self, head: np.ndarray) -> float:
        return float(head[: self.n].sum() if self.kind == "sum_skip" else head.mean())

    @property
    def sources(self) -> tuple[str, ...]:
        return (self.source,)

    @property
    def fresh(self) -> np.ndarray:
        return FRESH.numbers()

    def run(self, columns: list[np.ndarray], carried: np.ndarray) -> np.ndarray:
        return run(columns[0], self, Carried.of(carried))

    def summary(self, columns: list[np.ndarray]) -> np.ndarray:
        return Summary.of(columns[0], self).numbers()

    def carry(self, carried: np.ndarray, summary: np.ndarray) -> np.ndarray:
        return step(self, Carried.of(carried), Summary.read(summary)).numbers()


@dataclass(frozen=True)
class Derived:
    """A column made row by row from scans' results, for a later scan to read; NaN where undefined."""

    of: tuple[str, ...]
    out: str
    value: Callable[..., np.ndarray]


def affine(x: np.ndarray, a: float, b: float, y: float) -> np.ndarray:
    """y[t] = a * y[t-1] + b * x[t], from the value before x[0]; all x are finite."""
    out = np.empty(len(x))
    power = a ** np.arange(_ROWS + 1)
    lower = np.tril(power[np.abs(np.subtract.outer(np.arange(_ROWS), np.arange(_ROWS)))]) * b
    for k in range(0, len(x), _ROWS):
        part = x[k : k + _ROWS]
        n = len(part)
        out[k : k + n] = lower[:n, :n] @ part + power[1 : n + 1] * y
        y = out[k + n - 1]
    return out


def extent(x: np.ndarray) -> tuple[int, int]:
    """Where the first value is, and where the values from there on end."""
    there = np.isfinite(x)
    if not there.any():
        return len(x), len(x)
    begin = int(there.argmax())
    gap = ~there[begin:]
    return begin, begin + int(gap.argmax()) if gap.any() else len(x)


@dataclass(frozen=True)
class Carried:
    """What a piece needs from the pieces before it: values short of the seed, the last result, and whether a missing value has ended the recurrence."""

    head: np.ndarray
    before: float
    ended: bool

    @property
    def begun(self) -> bool:
        return self.ended or len(self.head) > 0 or not np.isnan(self.before)

    def numbers(self) -> np.ndarray:
        return np.array([self.before, float(self.ended), *self.head])

    @classmethod
    def of(cls, x: np.ndarray) -> Carried:
        return cls(x[2:], float(x[0]), bool(x[1]))


FRESH = Carried(np.zeros(0), np.nan, False)


def run(x: np.ndarray, scan: Scan, carried: Carried = FRESH) -> np.ndarray:
    """One recurrence over one series or piece; NaN where undefined."""
    out = np.full(len(x), np.nan)
    begin, end = extent(x)
    if carried.ended or begin == end or (carried.begun and begin > 0):
        return out
    before, part = carried.before, x[begin:end]
    if np.isnan(before):
        need = scan.first_at - len(carried.head)
        if len(part) < need:
            return out
        before = scan.seed(np.concatenate([carried.head, part[:need]]))
        begin, part = begin + need, part[need:]
        out[begin - 1] = before
    out[begin:end] = affine(part, scan.a, scan.b, before)
    return out


@dataclass(frozen=True)
class Summary:
    """A piece: whether it starts with a missing value, its values up to a later missing one (their number, the first ones, the answer to a zero start), and whether there is a later one."""

    late: bool
    n: int
    first: np.ndarray
    answer: float
    ends: bool

    @classmethod
    def of(cls, x: np.ndarray, scan: Scan) -> Summary:
        begin, end = extent(x)
        part = x[begin:end]
        return cls(begin > 0, len(part), part[: scan.first_at], float(affine(part, scan.a, scan.b, 0.0)[-1]) if len(part) else 0.0, end < len(x))

    def numbers(self) -> np.ndarray:
        return np.array([float(self.late), self.n, self.answer, float(self.ends), *self.first])

    @classmethod
    def read(cls, x: np.ndarray) -> Summary:
        return cls(bool(x[0]), int(x[1]), x[4:], float(x[2]), bool(x[3]))


def step(scan: Scan, carried: Carried, piece: Summary) -> Carried:
    """What is carried on after a piece."""
    if carried.ended or (carried.begun and piece.late):
        return Carried(np.zeros(0), np.nan, True)
    head, before = carried.head, carried.before
    if not np.isnan(before):
        before = scan.a**piece.n * before + piece.answer
    else:
        need = scan.first_at - len(head)
        if piece.n < need:
            head = np.concatenate([head, piece.first[: piece.n]])
        else:
            seeded = scan.seed(np.concatenate([head, piece.first[:need]]))
            rest = piece.n - need
            late = piece.answer - scan.a**rest * affine(piece.first[:need], scan.a, scan.b, 0.0)[-1]
            before = scan.a**rest * seeded + late
    return Carried(head, before, piece.ends)


def numbers(table: pa.Table, name: str) -> np.ndarray:
    """A column as doubles, NaN where it is missing (null, NaN or infinite)."""
    x = np.asarray(table.column(name).cast(pa.float64()).to_numpy(), np.float64)
    return x if np.isfinite(x).all() else np.where(np.isfinite(x), x, np.nan)


def doubles(x: np.ndarray) -> pa.Array:
    return pa.array(x, pa.float64(), mask=np.isnan(x))


def in_order(table: pa.Table, order: list[str]) -> pa.Table:
    """Rows by rising order, without one first, as Spark's windows have them."""
    return table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in order], null_placement="at_start"))


class Step(Protocol):
    """A column made in order of the series. A piece is summed up in some numbers, which ``carry`` turns, piece by piece, into what the next one starts from."""

    out: str

    @property
    def sources(self) -> tuple[str, ...]: ...
    @property
    def fresh(self) -> np.ndarray: ...
    def run(self, columns: list[np.ndarray], carried: np.ndarray) -> np.ndarray: ...
    def summary(self, columns: list[np.ndarray]) -> np.ndarray: ...
    def carry(self, carried: np.ndarray, summary: np.ndarray) -> np.ndarray: ...


class Values:
    """Columns of a table as numbers, and what steps have made of them."""

    def __init__(self, table: pa.Table):
        self.table, self.made = table, {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.made:
            self.made[name] = numbers(self.table, name)
        return self.made[name]

    def derive(self, d: Derived) -> None:
        with np.errstate(all="ignore"):
            made = np.asarray(d.value(*[self[c] for c in d.of]), np.float64)
        self.made[d.out] = np.where(np.isfinite(made), made, np.nan)


def solved(table: pa.Table, steps: list[Step | Derived], outputs: list[str], carried: dict[str, np.ndarray]) -> pa.Table:
    """``table`` in order with the columns ``outputs``."""
    values = Values(table)
    for s in steps:
        if isinstance(s, Derived):
            values.derive(s)
        else:
            with np.errstate(all="ignore"):
                values.made[s.out] = s.run([values[c] for c in s.sources], carried.get(s.out, s.fresh))
    for name in outputs:
        table = table.append_column(name, doubles(values[name]))
    return table


def levels(steps: list[Step | Derived]) -> list[list[Step | Derived]]:
    """Steps in runs in which no step with a state reads what rests on another one's state."""
    found: list[list[Step | Derived]] = [[]]
    resting: set[str] = set()  # on the state of a step of the last run
    for s in steps:
        rests = bool(resting.intersection(s.of if isinstance(s, Derived) else s.sources))
        if not isinstance(s, Derived) and rests:
            found.append([])
            resting = set()
        if rests or not isinstance(s, Derived):
            resting.add(s.out)
        found[-1].append(s)
    return found


def linear_scans(df: DataFrame, steps: list[Step | Derived], series: Series = BARS, pieces: str | int | None = None, outputs: list[str] | None = None) -> DataFrame:
    """``df`` with the columns ``outputs`` (the ``out`` column of every step, if not given), in one grouped pass.

    ``pieces`` is the unit (of ``date_trunc``), or for a numeric order the width, by
    which long series are cut; each further level of steps upon steps is then a pass
    of its own. A pass reads its input twice, so its result is checkpointed, else a
    chain of passes would be planned twice for each of them; such calls run at once.
    All other columns travel as they are.
    """
    for s in steps:
        if isinstance(s, Scan):
            window(s.n)
    outs = [s.out for s in steps]
    outputs = outs if outputs is None else outputs
    kept = df.drop(*outs)
    by, order = list(series.by), list(series.order)

    def wider(schema: T.StructType, names: list[str]) -> T.StructType:
        return T.StructType([*schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])

    if pieces is None:
        return kept.groupBy(*by).applyInArrow(lambda t: solved(in_order(t, order), steps, outputs, {}), wider(kept.schema, outputs))
    passes = levels(steps)
    for i, level in enumerate(passes):
        later = {c for after in passes[i + 1 :] for s in after for c in (s.of if isinstance(s, Derived) else s.sources)}
        made = [s.out for s in level if s.out in later or s.out in outputs]
        kept = checkpointed(_by_pieces(kept, level, by, order, pieces, made, wider(kept.schema, made)))
    return kept.select(*[c for c in kept.columns if c not in outs], *outputs)


def _by_pieces(df: DataFrame, steps: list[Step | Derived], by: list[str], order: list[str], pieces: str | int, made: list[str], schema: T.StructType) -> DataFrame:
    states = [s for s in steps if not isinstance(s, Derived)]
    piece: Column = F.floor(F.col(order[0]) / pieces) if isinstance(pieces, int) else F.date_trunc(pieces, order[0])
    cut = df.withColumn("__piece", piece)
    where = [*by, "__piece"]
    keys = ", ".join(f"`{k}` {dict(cut.dtypes)[k]}" for k in where)
    figures = "".join(f", s{i} array<double>" for i in range(len(states)))

    def lists(rows: list[list[np.ndarray]]) -> dict[str, pa.Array]:
        return {f"s{i}": pa.array([r[i] for r in rows], pa.list_(pa.float64())) for i in range(len(states))}

    def summary(table: pa.Table) -> pa.Table:
        table = in_order(table, order)
        values, resting = Values(table), {s.out for s in states}
        for s in steps:
            if isinstance(s, Derived):
                if resting.intersection(s.of):
                    resting.add(s.out)
                else:
                    values.derive(s)
        with np.errstate(all="ignore"):
            row = [s.summary([values[c] for c in s.sources]) for s in states]
        return pa.table({**{k: table.column(k).slice(0, 1) for k in where}, **lists([row])})

    def carry(table: pa.Table) -> pa.Table:
        table = in_order(table, ["__piece"])
        now, found = [s.fresh for s in states], []
        for k in range(len(table)):
            found.append(now)
            own = [np.asarray(table.column(f"s{i}")[k].values.to_numpy(zero_copy_only=False), np.float64) for i in range(len(states))]
            now = [s.carry(c, x) for s, c, x in zip(states, now, own)]
        return pa.table({**{k: table.column(k) for k in where}, **lists(found)})

    def resume(table: pa.Table, state: pa.Table) -> pa.Table:
        carried = {s.out: np.asarray(state.column(f"s{i}")[0].values.to_numpy(zero_copy_only=False), np.float64) for i, s in enumerate(states)}
        return solved(in_order(table, order), steps, made, carried).select(schema.names)

    own = {s.out for s in steps}
    needed = list(dict.fromkeys([*where, *order, *[c for s in steps for c in (s.of if isinstance(s, Derived) else s.sources) if c not in own]]))
    carried = cut.select(*needed).groupBy(*where).applyInArrow(summary, f"{keys}{figures}").groupBy(*by).applyInArrow(carry, f"{keys}{figures}")
    # A piece and its state meet as two groups of one task, so that the state is not copied to every row.
    return cut.groupBy(*where).cogroup(carried.groupBy(*where)).applyInArrow(resume, schema)
