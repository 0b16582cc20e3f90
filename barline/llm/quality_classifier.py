"""Quality classifier: ordinal cumulative-link regression on hashed text.

Grades 0, 1, .., K-1 share one weight vector over hashed features of a text (its
words, word endings, word shapes and repeated words, as shares of all words). Only
the K-1 thresholds differ, and they are kept in order: P(grade <= k) =
sigmoid(threshold_k - score). The fit gives an expected grade and the tail
probability P(grade >= g) with which texts are selected.

Defined cases: null, empty and wordless texts have no features, so their score is
0; with no labels every grade is equally likely; a single grade leaves the weights
at 0; a chance that equals the limit is enough; repeated rows each get the same
result; an empty table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.arrays import Words

#: Hashed features.
BUCKETS = 1 << 18
EPOCHS = 60
RATE = 0.3
DECAY = 1e-5
#: A grade of this or above is good enough to select.
GOOD = 1
#: Texts are selected from this chance of a good grade on.
LEAST_CHANCE = 0.5

_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'"]] = True


def features(words: Words, buckets: int = BUCKETS) -> np.ndarray:
    """Feature numbers of each word (columns: word, ending, shape, repeat); rows as in ``words``."""
    data, n = words.data, len(words.hashes)
    size = words.ends - words.starts

    def many(table: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(table[data])])
        return np.minimum(total[words.ends] - total[words.starts], 3)

    ending = np.zeros(n, np.uint64)
    for k in range(1, 4):
        ending = ending * np.uint64(257) + np.where(size >= k, data[np.maximum(words.ends - k, 0)], 0).astype(np.uint64)
    shape = many(_UPPER) + 4 * many(_DIGIT) + 16 * many(_SYMBOL) + 64 * np.minimum(size // 4, 7)
    again = np.zeros(n, np.int64)
    row = words.rows()
    again[1:] = (words.hashes[1:] == words.hashes[:-1]) & (row[1:] == row[:-1])
    out = np.empty((n, 4), np.int64)
    for i, x in enumerate((words.hashes, arrays.mix(ending + np.uint64(1 << 40)), arrays.mix(shape.astype(np.uint64) + np.uint64(1 << 41)), arrays.mix(again.astype(np.uint64) + np.uint64(1 << 42)))):
        out[:, i] = (x % np.uint64(buckets)).astype(np.int64)
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def tails(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= 1), P(grade >= 2), .. of each score."""
    return sigmoid(score[:, None] - thresholds[None, :])


def slopes(y: np.ndarray, mass: np.ndarray, score: np.ndarray, thresholds: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The weighted negative log-likelihood of the grades, and its slopes by score and by threshold."""
    grades = len(thresholds) + 1
    tail = np.concatenate([np.ones((len(y), 1)), tails(score, thresholds), np.zeros((len(y), 1))], axis=1)
    low, high = tail[np.arange(len(y)), y], tail[np.arange(len(y)), y + 1]
    p = np.maximum(low - high, 1e-9)
    slope_low, slope_high = low * (1 - low), high * (1 - high)
    to_threshold = np.zeros(grades + 1)
    np.add.at(to_threshold, y, mass * slope_low / p)
    np.add.at(to_threshold, y + 1, -mass * slope_high / p)
    return -float((mass * np.log(p)).sum()), -mass * (slope_low - slope_high) / p, to_threshold[1:grades]


def fit(texts: list[str], labels: list[int], weights: list[float], epochs: int = EPOCHS) -> bytes:
    """Weights and ordered thresholds by Adagrad on the weighted likelihood of the grades."""
    y, mass = np.array(labels, np.int64), np.array(weights)
    grades = int(y.max()) + 1 if len(y) else 1
    if grades < 2:
        return pickle.dumps((np.zeros(BUCKETS, np.float32), np.zeros(0)))
    mass = mass / mass.sum() * len(mass)
    words = Words(*arrays.utf8(pa.array(texts, pa.large_string())), values=arrays.LOWER_VALUES)
    column = features(words)
    row = words.rows()
    share = 1 / np.maximum(words.per_row, 1)
    doc = np.repeat(row, column.shape[1])
    by_doc = np.unique(doc * BUCKETS + column.ravel(), return_counts=True)
    doc, feature = by_doc[0] // BUCKETS, by_doc[0] % BUCKETS
    value = by_doc[1] * share[doc]
    value = np.sqrt(value)  # dampens features that fill a text
    known = np.bincount(feature, minlength=BUCKETS) >= 3
    value = value * known[feature]
    w, square = np.zeros(BUCKETS), np.full(BUCKETS, 1e-6)
    at_least = np.array([np.average(y >= k, weights=mass) for k in range(1, grades)])
    first = -np.log(np.clip(at_least, 1e-3, 1 - 1e-3) / (1 - np.clip(at_least, 1e-3, 1 - 1e-3)))
    base, gaps = first[0], np.log(np.maximum(np.diff(first), 0.1))
    extra = np.full(grades - 1, 1e-6)
    for _ in range(epochs):
        thresholds = base + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.bincount(doc, value * w[feature], len(y))
        _, to_score, to_threshold = slopes(y, mass, score, thresholds)
        gradient = np.bincount(feature, value * to_score[doc], BUCKETS) / len(y) + DECAY * w
        square += gradient**2
        w -= RATE * gradient / np.sqrt(square)
        moved = to_threshold / len(y)
        parts = np.concatenate([[moved.sum()], [moved[k:].sum() * np.exp(gaps[k - 1]) for k in range(1, grades - 1)]])
        extra += parts**2
        parts = 0.5 * RATE * parts / np.sqrt(extra)
        base -= parts[0]
        gaps -= parts[1:]
    return pickle.dumps((w.astype(np.float32), base + np.concatenate([[0], np.cumsum(np.exp(gaps))])))


def grade(docs: DataFrame, model: bytes, good: int = GOOD, least_chance: float = LEAST_CHANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, quality_score, expected_grade, p_good = P(grade >= good) and kept, for every whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, thresholds = pickle.loads(sent.value) if sent.value else (np.zeros(BUCKETS, np.float32), np.zeros(0))
        for batch in batches:
            for first, last, words in arrays.words_in_chunks(batch.column(1), arrays.LOWER_VALUES):
                column, row = features(words), words.rows()
                keyed, counts = np.unique(np.repeat(row, column.shape[1]) * BUCKETS + column.ravel(), return_counts=True)
                doc, feature = keyed // BUCKETS, keyed % BUCKETS
                value = np.sqrt(counts / np.maximum(words.per_row, 1)[doc])
                score = np.bincount(doc, value * w[feature], last - first).astype(float)
                tail = tails(score, thresholds)
                chance = tail[:, good - 1] if len(thresholds) >= good else np.ones(last - first)
                made = [*(pa.array(x, pa.float64()) for x in (score, tail.sum(axis=1), chance)), pa.array(chance >= least_chance)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), *made], names=["doc_id", "quality_score", "expected_grade", "p_good", "kept"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(arrays.lean(run), "doc_id long, quality_score double, expected_grade double, p_good double, kept boolean")
