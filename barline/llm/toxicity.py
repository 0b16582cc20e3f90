"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A word is the mean of the vectors of its character n-grams (hashed to a table), so
an unseen misspelling shares most vectors with the word it comes from. A window of
words is the mean of its words and goes through a linear softmax; vectors and
softmax are trained together by Adagrad in numpy. A document is as toxic as its
most toxic window: training starts from all windows with their document's label
and goes on with each document's top windows (an average over a whole text would hide
one toxic sentence in a long document). The cut at which a text counts as toxic is
fitted on documents kept out of that training.

Defined cases: null, empty and wordless texts score like a window without words;
with no labels, or of one class only, every score is 0; with so few documents that
a class would be missing in the training or the calibration part, both use all of
them; equal top windows count once; repeated rows each get the same score; an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.arrays import Words, ragged

BUCKETS = 1 << 17
DIMENSIONS = 8
LENGTHS = (3, 4, 5, 6)
WINDOW, STEP = 6, 3
EPOCHS = 14
RATE = 0.25
#: Pull of a vector towards zero, and the training documents that an n-gram must occur in to have one.
DECAY = 1e-6
LEAST_DOCUMENTS = 3
#: Steps of the fit (not of scoring): windows that each of the first three epochs takes at most, drawn at random from
#: all windows of the sample, and further clean windows that each later epoch takes beside the top ones.
FIRST_WINDOWS, CLEAN_WINDOWS = 40_000, 3_000
#: Documents count as toxic from this score on.
THRESHOLD = 0.3

_SPLIT = arrays.space_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    return Words(data, offsets, arrays.LOWER_VALUES, _SPLIT)


def subwords(words: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """Table rows of all n-grams of ``<word>`` and of the word itself, end to end, and how many each word has."""
    marked = [f"<{w.lower()}>" for w in words]
    sizes = np.array([len(m) for m in marked], np.int64)
    x = np.frombuffer("".join(marked).encode("utf-32-le"), np.uint32).astype(np.uint64)
    at = np.cumsum(sizes) - sizes
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(arrays.mix(x + np.uint64(77)) * arrays.powers(arrays._BASE, len(x)), out=total[1:])
    inverse = arrays.powers(arrays._INVERSE, len(x) + 1)

    def hashed(start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return (arrays.mix((total[start + length] - total[start]) * inverse[start] + np.uint64(1)) % np.uint64(buckets)).astype(np.int32)

    parts, owners = [hashed(at, sizes)], [np.arange(len(words))]
    for n in LENGTHS:
        count = np.maximum(sizes - n + 1, 0)
        owners.append(np.repeat(np.arange(len(words)), count))
        parts.append(hashed(ragged(at, count), n))
    rows, owner = np.concatenate(parts), np.concatenate(owners)
    by = np.argsort(owner, kind="stable")
    return rows[by], np.bincount(owner, minlength=len(words))


def distinct(words: Words) -> tuple[list[str], np.ndarray]:
    """Distinct words as text, and which of them each word is."""
    _, first, which = np.unique(words.hashes, return_index=True, return_inverse=True)
    raw = words.data.tobytes()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[first].tolist(), words.ends[first].tolist())], which


def window_bounds(row_at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: row, first word, end word. A row of no words has one empty window."""
    n = np.diff(row_at)
    count = np.maximum(1, -(-np.maximum(n - WINDOW, 0) // STEP) + 1)
    row = np.repeat(np.arange(len(n)), count)
    start = row_at[row] + ragged(np.zeros(len(n), np.int64), count) * STEP
    return row, start, np.minimum(start + WINDOW, row_at[row + 1])


def window_means(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.zeros((len(values) + 1, *values.shape[1:]))
    np.cumsum(values, axis=0, out=total[1:])
    return (total[end] - total[start]) / WINDOW


def tops(row: np.ndarray, logit: np.ndarray, n: int) -> np.ndarray:
    """The highest logit of each row."""
    top = np.full(n, -np.inf)
    np.maximum.at(top, row, logit)
    return top


def fit(texts: list[str], labels: list[int], weights: list[float], epochs: int = EPOCHS, seed: int = 3) -> bytes:
    """Table of subword scores, bias and calibration."""
    y, weight = np.array(labels) > 0, np.array(weights)
    if not y.any() or y.all():
        return b""
    rng = np.random.default_rng(seed)
    words = words_of(*arrays.utf8(pa.array(texts, pa.large_string())))
    names, which = distinct(words)
    grams, size = subwords(names)
    at = np.cumsum(size) - size
    row, start, end = window_bounds(words.row_at)
    held = np.zeros(len(y), bool)  # for calibration: every fifth document of each class
    for own in (np.flatnonzero(y), np.flatnonzero(~y)):
        held[own[4::5]] = True
    train = ~held
    if not (y[held].any() and not y[held].all()):
        held, train = np.ones(len(y), bool), np.ones(len(y), bool)
    # N-grams of few documents would be learnt by heart, so they keep the zero vector.
    holding = np.zeros(BUCKETS, np.int64)
    for first, last in zip(words.row_at[:-1], words.row_at[1:]):
        own = np.unique(which[first:last])
        holding[np.unique(grams[ragged(at[own], size[own])])] += 1
    learnt = (holding >= LEAST_DOCUMENTS).astype(np.float32)
    table = np.zeros((BUCKETS, DIMENSIONS), np.float32)
    soft = rng.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.array([2, -2], np.float32)  # a window without telling words is clean
    squares = [np.full(table.shape, 1e-10, np.float32), np.full(soft.shape, 1e-6, np.float32), np.full(2, 1e-6, np.float32)]

    def logits() -> np.ndarray:
        z = (table @ (soft[:, 1] - soft[:, 0]))[grams]
        by_word = np.add.reduceat(z, at) / size if len(at) else np.zeros(0)
        return window_means(by_word[which], start, end) + (bias[1] - bias[0])

    def step(batch: np.ndarray, target: np.ndarray, mass: np.ndarray) -> None:
        length = end[batch] - start[batch]
        token = which[ragged(start[batch], length)]
        gram = grams[ragged(at[token], size[token])]
        share = np.repeat(1.0 / (size[token] * WINDOW), size[token]).astype(np.float32)
        per_window = np.repeat(np.repeat(np.arange(len(batch)), length), size[token])
        hidden = np.zeros((len(batch), DIMENSIONS), np.float32)
        inputs = table[gram] * share[:, None]
        for d in range(DIMENSIONS):
            hidden[:, d] = np.bincount(per_window, inputs[:, d], len(batch))
        out = hidden @ soft + bias
        out -= out.max(axis=1, keepdims=True)
        p = np.exp(out)
        p /= p.sum(axis=1, keepdims=True)
        error = (p - np.stack([1 - target, target], axis=1)) * mass[:, None]
        to_hidden = (error @ soft.T).astype(np.float32)
        touched, where = np.unique(gram, return_inverse=True)
        slope = np.stack([np.bincount(where, to_hidden[per_window, d] * share, len(touched)) for d in range(DIMENSIONS)], axis=1).astype(np.float32)
        slope = (slope + DECAY * table[touched]) * learnt[touched, None]
        squares[0][touched] += slope**2
        table[touched] -= RATE * slope / np.sqrt(squares[0][touched])
        for value, gradient, square in ((soft, hidden.T @ error, squares[1]), (bias, error.sum(axis=0), squares[2])):
            square += gradient**2
            value -= 0.2 * RATE * gradient / np.sqrt(square)

    usable = np.flatnonzero(train[row] & (end > start))
    if not len(usable):
        return b""
    for epoch in range(epochs):
        if epoch < 3:
            chosen = usable if len(usable) < FIRST_WINDOWS else rng.choice(usable, FIRST_WINDOWS, replace=False)
        else:
            z = logits()
            order = usable[np.lexsort((-z[usable], row[usable]))]
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            chosen = order[(rank == 0) | ((rank < 4) & ~y[row[order]])]
            clean = order[~y[row[order]]]
            chosen = np.concatenate([chosen, rng.choice(clean, min(len(clean), CLEAN_WINDOWS))]) if len(clean) else chosen
        chosen = rng.permutation(chosen)
        for k in range(0, len(chosen), 256):
            batch = chosen[k : k + 256]
            target = y[row[batch]].astype(np.float32)
            step(batch, target, np.full(len(batch), 1.0 / len(batch), np.float32))
    top = tops(row, logits(), len(y))
    scale = calibrate(top[held], y[held], weight[held])
    return pickle.dumps(((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]), scale))


def calibrate(top: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a sigmoid of the top logit: the best cut (by F1) gets the score THRESHOLD,
    and the slope follows the spread of the logits. Scores rank texts; only the cut is fitted."""
    cuts = np.unique(top)
    cuts = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2]) if len(cuts) > 1 else cuts
    f1 = np.array([2 * (weight * (y & (top >= c))).sum() / max((weight * y).sum() + (weight * (top >= c)).sum(), 1e-9) for c in cuts])
    best = cuts[f1 >= f1.max() - 1e-12]
    cut = float((best.min() + best.max()) / 2)
    slope = 4.0 / max(float(np.subtract(*np.percentile(top, [75, 25]))), float(np.std(top)), 1e-3)
    return slope, float(np.log(THRESHOLD / (1 - THRESHOLD)) - slope * cut)


def score(docs: DataFrame, model: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score at THRESHOLD or above) of every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = pickle.loads(sent.value) if sent.value else None
        for batch in batches:
            data, offsets = arrays.utf8(batch.column(1))
            for first, last in arrays.chunks(offsets):
                value = np.zeros(last - first)
                if loaded:
                    table, bias, (slope, offset) = loaded
                    words = words_of(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                    z = np.zeros(len(words.hashes))
                    if len(z):
                        names, which = distinct(words)
                        grams, size = subwords(names)
                        z = (np.add.reduceat(table[grams].astype(np.float64), np.cumsum(size) - size) / size)[which]
                    row, start, end = window_bounds(words.row_at)
                    value = 1 / (1 + np.exp(-np.clip(slope * (tops(row, window_means(z, start, end), last - first) + bias) + offset, -50, 50)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), pa.array(value), pa.array((value >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(arrays.lean(run), "doc_id long, score double, predicted int")
