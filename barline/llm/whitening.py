"""Whitening of embeddings by principal components, found by a block Jacobi-Davidson method.

The covariance is never formed: Spark multiplies it with a block of vectors, as a sum of
C'(C V) over the centred rows C of each partition. ``jacobi_davidson`` works on the
driver with matrices of one column for each component: Rayleigh-Ritz in a subspace,
locking of converged components, and a correction equation for each open one,
projected off the locked and current vectors and solved by some steps of MINRES. All
corrections of a round share their products, so a round takes a few passes over the
rows whatever the number of components. It ends when all residuals are at double
precision, and a block of random vectors finds no larger eigenvalue beside them.

Values are whole numbers, floor(64 c) + 1000000; sums and deviations are exact integers
(numpy's 64 bits where they suffice, Python's integers beyond), and rows are centred
by the whole part of the mean first.

Defined cases: null vectors and vectors with a null, NaN or infinite entry are left out,
and empty ones; of different lengths the most frequent counts (ties: the longest) and others
are left out; repeated rows and null ids are rows of their own; components without
variance are left out, so fewer than ``components`` come back where the rows span less;
a deviation beyond 64 bits is null; an empty table gives an empty result; only the two named
columns are read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.lineage import checkpointed

COMPONENTS = 32
#: Vectors beyond the wanted ones that the subspace starts with.
GUARD = 8
#: MINRES steps for one correction, and the reduction of its residual at which they end.
INNER_STEPS = 8
INNER_TOLERANCE = 1e-3
OUTER_STEPS = 200
#: Residuals below this share of the largest eigenvalue are at double precision.
TOLERANCE = 2.0**-44
#: Eigenvalues below this share of the largest one are none.
NO_VARIANCE = 1e-12
#: Entries of vectors that are converted to doubles at a time.
ENTRIES = 1 << 20

Product = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class Fit:
    """Exact sums over n rows, and unit components with falling eigenvalues."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def whole_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, x): vectors of whole numbers, without those that are left out."""
    vector = F.col(vector_col).cast("array<double>")
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(vector, lambda c: F.floor(64 * c) + F.lit(1_000_000).cast("long"))
    made = df.where(F.col(vector_col).isNotNull() & ~bad & (F.size(vector_col) > 0)).select(F.col(id_col).alias("vec_id"), whole.alias("x"))
    made = checkpointed(made)
    lengths = made.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).head(2)
    return made.where(F.size("x") == lengths[0]["d"]) if len(lengths) > 1 else made


def blocks(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Rows of a batch as matrices of bounded size."""
    column = batch.column(batch.schema.get_field_index("x"))
    if len(column):
        x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
        step = max(1, ENTRIES // x.shape[1])
        for k in range(0, len(x), step):
            yield x[k : k + step]


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x less the mean: whole numbers first, the mean's fraction after."""
    whole = np.array([s // n for s in sums], np.int64)
    fraction = np.array([s % n for s in sums], np.float64) / n
    if max(abs(int(x.min())), abs(int(x.max()))) < 1 << 52:
        return (x - whole) - fraction
    return x.astype(np.float64) - whole - fraction


def summed(rows: DataFrame, part: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of ``part`` (a matrix of ``shape``) over all blocks of rows: one matrix for each task, added up by rows in a shuffle."""
    names = [f"c{j}" for j in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(shape), False
        for batch in batches:
            for x in blocks(batch):
                total += part(x)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), *map(pa.array, np.ascontiguousarray(total.T))], names=["i", *names])

    made = rows.select("x").mapInArrow(arrays.lean(run), "i long, " + ", ".join(f"{c} double" for c in names))
    out = np.zeros(shape)
    for r in made.groupBy("i").agg(*[F.sum(c).alias(c) for c in names]).collect():
        out[r["i"]] = [r[c] for c in names]
    return out


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sum of each dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = high = n = 0
        for batch in batches:
            for x in blocks(batch):
                low, high, n = low + (x & 0xFFFFFFFF).sum(axis=0), high + (x >> 32).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(low))), pa.array(low), pa.array(high), pa.array(np.full(len(low), n))], names=["i", "low", "high", "n"])

    made = rows.select("x").mapInArrow(arrays.lean(run), "i long, low long, high long, n long")
    found = made.groupBy("i").agg(*[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("low", "high", "n")]).orderBy("i").collect()
    return (int(found[0]["n"]), [int(r["low"]) + (int(r["high"]) << 32) for r in found]) if found else (0, [])


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - sum)^2 for each row; None beyond 64 bits."""
    reach = max(abs(int(x.min())), abs(int(x.max())), 1)
    widest = n * reach + max(map(abs, sums))
    if widest < 1 << 62:
        apart = np.abs(n * x - np.array(sums, np.int64))
        if int(apart.max()) ** 2 * x.shape[1] < 1 << 63:
            return (apart * apart).sum(axis=1).tolist()
    found = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in found]


def orthonormal(t: np.ndarray, *against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of ``t`` off the others; directions that vanish are left out."""
    for _ in range(2):
        before = np.linalg.norm(t, axis=0)
        for q in against:
            t = t - q @ (q.T @ t)
        size = np.linalg.norm(t, axis=0)
        there = size > 1e-10 * before
        t = t[:, there] / size[there]
        if not t.shape[1]:
            return t
        left, weight, _ = np.linalg.svd(t, full_matrices=False)
        t = left[:, weight > 1e-8]
    return t


def minres(product: Product, rhs: np.ndarray, steps: int = INNER_STEPS, tolerance: float = INNER_TOLERANCE) -> np.ndarray:
    """Minimal-residual solutions of symmetric systems, one for each column of ``rhs``, by one product of a block a step."""
    x, before, w, w_before = (np.zeros_like(rhs) for _ in range(4))
    beta = np.linalg.norm(rhs, axis=0)
    first = np.where(beta > 0, beta, 1.0)
    v, rest = rhs / first, beta.copy()
    beta = np.zeros_like(beta)
    cos, cos_before, sin, sin_before = np.ones_like(rest), np.ones_like(rest), np.zeros_like(rest), np.zeros_like(rest)
    live = rest > 0
    for _ in range(steps):
        p = product(v)
        alpha = (v * p).sum(axis=0)
        p = p - alpha * v - beta * before
        after = np.linalg.norm(p, axis=0)
        delta = cos * alpha - cos_before * sin * beta
        r1, r2, r3 = np.hypot(delta, after), sin * alpha + cos_before * cos * beta, sin_before * beta
        live = live & (r1 > 0)
        safe = np.where(live, r1, 1.0)
        cos_before, sin_before = cos, sin
        cos, sin = np.where(live, delta / safe, 1.0), np.where(live, after / safe, 0.0)
        w, w_before = np.where(live, (v - r3 * w_before - r2 * w) / safe, 0.0), w
        x = x + np.where(live, cos * rest, 0.0) * w
        rest = np.where(live, -sin * rest, rest)
        live = live & (after > 1e-14 * first) & (np.abs(rest) > tolerance * first)
        if not live.any():
            break
        before, v, beta = v, np.where(live, p / np.where(after > 0, after, 1.0), 0.0), after
    return x


def jacobi_davidson(product: Product, d: int, want: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """The ``want`` largest eigenvalues of a symmetric positive semidefinite operator of size d, falling, and their unit vectors."""
    rng = np.random.default_rng(seed)
    want = min(want, d)
    limit = min(d, max(4 * want, want + 4 * GUARD))
    locked, values = np.zeros((d, 0)), np.zeros(0)
    q = orthonormal(rng.standard_normal((d, min(d, want + GUARD))))
    aq = product(q)
    stuck, least = 0, np.inf
    for _ in range(OUTER_STEPS):
        h = q.T @ aq
        theta, y = np.linalg.eigh((h + h.T) / 2)
        theta, y = theta[::-1], y[:, ::-1]
        q, aq = q @ y, aq @ y
        scale = max(values.max(initial=0.0), theta.max(initial=0.0))
        open_ = min(want - locked.shape[1], q.shape[1])
        residual = aq[:, :open_] - q[:, :open_] * theta[:open_]
        residual = residual - locked @ (locked.T @ residual)
        size = np.linalg.norm(residual, axis=0)
        # Where rounding ends the descent above the tolerance, residuals count as converged once they stay.
        stuck, least = (stuck + 1, least) if size.max(initial=0.0) > 0.5 * least else (0, size.max(initial=0.0))
        near = size <= TOLERANCE * scale
        if locked.shape[1] + q.shape[1] == d or (stuck > 2 and (size <= 1e-10 * scale).all()):
            near[:] = True
        done = open_ if near.all() else int(near.argmin())
        if done:
            stuck, least = 0, np.inf
        locked, values = np.hstack([locked, q[:, :done]]), np.append(values, theta[:done])
        q, aq, theta, residual = q[:, done:], aq[:, done:], theta[done:], residual[:, done:]
        if locked.shape[1] >= want:
            more = beyond(product, locked, q, rng, values.min() + 1e-9 * scale)
            if not more.shape[1]:
                break
            # A larger eigenvalue was missed: all vectors go back into the subspace.
            q, locked, values = orthonormal(np.hstack([locked, more])), np.zeros((d, 0)), np.zeros(0)
            aq = product(q)
            continue
        t = residual.shape[1]
        held = np.hstack([locked, q[:, :t]])

        def shifted(v: np.ndarray) -> np.ndarray:
            v = v - held @ (held.T @ v)
            v = product(v) - v * theta[:t]
            return v - held @ (held.T @ v)

        if q.shape[1] + t > limit:
            kept = min(q.shape[1], max(t + GUARD, limit // 2))
            q, aq = q[:, :kept], aq[:, :kept]
        right = -(residual - held @ (held.T @ residual))
        new = orthonormal(minres(shifted, right), locked, q)
        if not new.shape[1]:
            new = orthonormal(rng.standard_normal((d, GUARD)), locked, q)
        q, aq = np.hstack([q, new]), np.hstack([aq, product(new)])
    by = np.argsort(-values, kind="stable")
    values, vectors = values[by], locked[:, by]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * sign


def beyond(product: Product, locked: np.ndarray, rest: np.ndarray, rng: np.random.Generator, most: float, steps: int = 3) -> np.ndarray:
    """Vectors off the locked ones with a quotient above ``most``, from the rest of the subspace and random ones."""
    d = len(locked)
    t = orthonormal(np.hstack([rest[:, :GUARD], rng.standard_normal((d, min(GUARD, d)))]), locked)
    for _ in range(steps):
        if not t.shape[1]:
            return t
        at = product(t)
        value, y = np.linalg.eigh((t.T @ at + at.T @ t) / 2)
        if value[-1] > most:
            return t @ y[:, value > most]
        t = orthonormal(np.hstack([t @ y[:, -GUARD:], at @ y[:, -GUARD:]]), locked)
    return t[:, :0]


def fit(rows: DataFrame, components: int = COMPONENTS) -> Fit:
    """Components of all rows of ``whole_vectors``."""
    n, sums = exact_sums(rows)
    if not n:
        return Fit(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d = len(sums)

    def product(v: np.ndarray) -> np.ndarray:
        def part(x: np.ndarray) -> np.ndarray:
            c = centred(x, n, sums)
            return c.T @ (c @ v)

        return summed(rows, part, v.shape) / n

    trace = float(summed(rows, lambda x: np.array([[(centred(x, n, sums) ** 2).sum()]]), (1, 1))[0, 0] / n)
    if trace == 0:
        return Fit(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    values, vectors = jacobi_davidson(product, d, components)
    there = values > NO_VARIANCE * values.max()
    return Fit(n, sums, values[there], vectors[:, there], trace)


def identity_error(rows: DataFrame, model: Fit) -> float:
    """The largest entry of the whitened rows' covariance less the identity; the covariance is centred before multiplying."""
    scaled = model.vectors / np.sqrt(model.values)
    k = len(model.values)
    mean = summed(rows, lambda x: (centred(x, model.n, model.sums) @ scaled).sum(axis=0)[None, :], (1, k))[0] / model.n

    def part(x: np.ndarray) -> np.ndarray:
        z = centred(x, model.n, model.sums) @ scaled - mean
        return z.T @ z

    return float(np.abs(summed(rows, part, (k, k)) / model.n - np.eye(k)).max())


def whiten(df: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each remaining row and component."""
    rows = whole_vectors(df, id_col, vector_col)
    model = fit(rows, components)
    k = len(model.values)
    error = identity_error(rows, model) if k else None
    scaled = model.vectors / np.sqrt(model.values) if k else model.vectors

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for x in blocks(batch):
                z = centred(x, model.n, model.sums) @ scaled
                ends = pa.array(np.arange(0, z.size + 1, k, dtype=np.int32))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(x)), pa.array(deviations(x, model.n, model.sums), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(z.ravel()))], names=["vec_id", "deviation", "z"]
                )
                at += len(x)

    kind = dict(rows.dtypes)["vec_id"]
    if not k:
        return rows.limit(0).selectExpr("vec_id", "CAST(0 AS INT) AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error")
    made = rows.mapInArrow(arrays.lean(project), f"vec_id {kind}, deviation long, z array<double>").select("vec_id", "deviation", F.posexplode("z").alias("place", "whitened"))
    explained = F.element_at(F.array(*[F.lit(float(e / model.trace)) for e in model.values]), F.col("place") + 1)
    return made.select("vec_id", (F.col("place") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
