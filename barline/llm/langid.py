"""Language identification by interpolated Kneser-Ney character models.

For each language a character model of a fixed order is fitted to a bounded sample
of labelled texts. N-grams live in sorted arrays of 64-bit hashes. The n-grams of
all languages together form one further sorted array with a row of log
probabilities (one per language), so scoring a text takes one binary search per
character; n-grams that no language has seen take the back-off path. The language
with the lowest cross-entropy per character wins.

Rejection is calibrated on labelled texts kept out of the fit: a text is rejected
if its cross-entropy is above what nearly all texts of that language stay below,
with an allowance for short texts.

Defined cases: a null text or one without letters is ``und`` with score 0 and is
rejected; an empty table gives an empty result; with nothing to learn from, every
text is ``und``; equal cross-entropies go to the first language by name; repeated
rows each get the same result; only the named columns are read.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from barline.llm import arrays

#: Characters in an n-gram.
ORDER = 4
#: Characters of labelled text per language that a model is fitted to, about (a bound on the fit, never on what is scored),
#: of all languages together (shared equally where there are many), and documents per language at least, about.
SAMPLE_CHARS = 1_500_000
ALL_CHARS = 60_000_000
LEAST_DOCUMENTS = 30
#: Bytes of text that are scored at a time.
#: Characters of a long text that are scored at a time.
SLICE = 1 << 20
_SPACE = re.compile(r"\s")
CHUNK_BYTES = 1 << 19
#: Cells (n-grams by languages) up to which all languages' log probabilities are kept in one table; beyond, each language
#: looks its own n-grams up, with the same results.
TABLE_CELLS = 50_000_000
#: The calibration texts of a language above which the limit lies, as a share: one odd text in fifty sets no limit.
CALIBRATION = 0.98
#: Added to the calibrated limit, so that texts of two languages or with much junk stay.
MARGIN_BITS = 1.0
UNDETERMINED = "und"

_START = 2
_multipliers = np.array([pow(arrays._BASE, 2 * i + 1, 1 << 64) for i in range(16)], np.uint64)


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return arrays.once_per_process("letters", lambda: np.fromiter(map(str.isalpha, map(chr, range(0x110000))), bool, 0x110000))


def codes(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts: lower case, other characters as single spaces, each text after order - 1 start marks.

    The second array has where each text's marks begin, and the total at its end.
    """
    mark = chr(_START) * (order - 1)
    lowered = [mark + t.lower() for t in texts]
    at = np.cumsum([0, *map(len, lowered)])
    x = np.frombuffer("".join(lowered).encode("utf-32-le"), np.uint32).copy()
    marks = np.zeros(len(x) + order, bool)
    for i in range(order - 1):
        marks[at[:-1] + i] = True
    marks = marks[: len(x)]
    other = ~letter_table()[x] & ~marks
    x[other] = 32
    x[marks] = _START
    keep = np.ones(len(x), bool)
    keep[1:] = ~(other[1:] & other[:-1])
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def slices(text: str, order: int) -> Iterator[np.ndarray]:
    """The codes of a text in parts, each after the order - 1 codes before it; parts end at spaces where there are some."""
    last, begin = np.full(order - 1, _START, np.uint32), 0
    while begin < len(text):
        space = _SPACE.search(text, begin + SLICE, begin + 2 * SLICE)
        end = space.start() if space else min(begin + 2 * SLICE, len(text))
        x = codes([text[begin:end]], order)[0][order - 1 :]
        x = x[1:] if len(x) and x[0] == 32 and last[-1] == 32 else x
        x = np.concatenate([last, x])
        yield x
        last, begin = x[len(x) - order + 1 :], end


def keys(grams: np.ndarray) -> np.ndarray:
    """64-bit hashes of the rows of an array of code points."""
    total = np.zeros(len(grams), np.uint64)
    for i in range(grams.shape[1]):
        total += grams[:, i].astype(np.uint64) * _multipliers[i]
    return arrays.mix(total + np.uint64(grams.shape[1]))


def windows(x: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(x, n) if len(x) >= n else np.zeros((0, n), np.uint32)


def found(sorted_keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(sorted_keys, wanted), len(sorted_keys) - 1)
    return at, sorted_keys[at] == wanted


@dataclass
class KneserNey:
    """Interpolated Kneser-Ney of all orders up to ``order``; each order as sorted hash arrays."""

    order: int
    uniform: float
    #: Of each order: n-gram hashes, discounted counts, context hashes, context totals, back-off masses.
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    @classmethod
    def fit(cls, grams: np.ndarray, counts: np.ndarray) -> KneserNey:
        """From distinct n-grams (rows of code points) and their counts."""
        order = grams.shape[1]
        uniform = 1.0 / (len(np.unique(grams[:, -1])) + 1)
        levels = []
        while grams.shape[1] >= 1:
            singles, doubles = int((counts == 1).sum()), int((counts == 2).sum())
            discount = singles / (singles + 2 * doubles) if singles and doubles else 0.5
            own = keys(grams)
            by = np.argsort(own)
            contexts, where = np.unique(keys(grams[:, :-1]), return_inverse=True)
            totals = np.bincount(where, weights=counts)
            backoff = discount * np.bincount(where) / totals
            levels.append((own[by], np.maximum(counts[by] - discount, 0.0), contexts, totals, backoff))
            if grams.shape[1] == 1:
                break
            _, first, counts = np.unique(keys(grams[:, 1:]), return_index=True, return_counts=True)
            grams = grams[first, 1:]  # continuation counts: in how many distinct contexts
        return cls(order, uniform, levels[::-1])

    def probabilities(self, grams: np.ndarray) -> np.ndarray:
        p = np.full(len(grams), self.uniform)
        for k, (own, discounted, contexts, totals, backoff) in enumerate(self.levels, 1):
            tail = grams[:, self.order - k :]
            at, hit = found(contexts, keys(tail[:, :-1]))
            mine, seen = found(own, keys(tail))
            top = np.where(seen, discounted[mine], 0.0) / totals[at]
            p = np.where(hit, top + backoff[at] * p, p)
        return p


@dataclass
class Rejection:
    """A text of n characters is accepted up to level + spread / sqrt(n) bits a character."""

    level: float
    spread: float


def fit_language(texts: list[str], order: int) -> bytes:
    """A model and its rejection limits, from texts of one language; every fifth text calibrates."""
    kept = [t for i, t in enumerate(texts) if i % 5 or len(texts) < 10]
    x, _ = codes(kept, order)
    grams = windows(x, order)
    grams = grams[grams[:, -1] != _START]
    if not len(grams):
        return b""
    _, first, counts = np.unique(keys(grams), return_index=True, return_counts=True)
    model = KneserNey.fit(grams[first], counts)
    losses, sizes, spread = [], [], 0.0
    for t in (t for i, t in enumerate(texts) if i % 5 == 0 or len(texts) < 10):
        own = windows(codes([t], order)[0], order)
        own = own[own[:, -1] != _START]
        if len(own):
            loss = -np.log2(model.probabilities(own))
            losses.append(loss.mean())
            sizes.append(len(own))
            spread = max(spread, float(loss.std()) if len(own) > 100 else 0.0)
    spread = 4 * max(spread, 1.0)
    level = np.quantile(np.array(losses) - spread / np.sqrt(sizes), CALIBRATION) if losses else 8.0
    typical = float(np.median(losses)) if losses else 8.0
    return pickle.dumps((grams[first], (order, model.uniform, model.levels), (max(float(level), typical) + MARGIN_BITS, spread)))


class Identifier:
    """Scores texts against the models of all languages at once."""

    def __init__(self, fitted: dict[str, bytes], order: int = ORDER):
        loaded = {k: pickle.loads(v) for k, v in sorted(fitted.items()) if v}
        self.order, self.languages = order, list(loaded)
        self.models = [KneserNey(*m) for _, m, _ in loaded.values()]
        self.limits = [Rejection(*r) for _, _, r in loaded.values()]
        if self.languages:
            grams = np.concatenate([g for g, _, _ in loaded.values()])
            self.known, first = np.unique(keys(grams), return_index=True)
            self.bits = None
            if len(self.known) * len(self.languages) <= TABLE_CELLS:
                self.bits = [self.losses(m, grams[first]) for m in self.models]

    @staticmethod
    def losses(model: KneserNey, grams: np.ndarray) -> np.ndarray:
        return (-np.log2(model.probabilities(grams))).astype(np.float32)

    def bits_of(self, language: int, grams: np.ndarray, row: np.ndarray, hit: np.ndarray) -> np.ndarray:
        """Bits of each n-gram in one language."""
        if self.bits is None:
            return self.losses(self.models[language], grams)
        bits = self.bits[language][row]
        if not hit.all():
            bits[~hit] = self.losses(self.models[language], np.ascontiguousarray(grams[~hit]))
        return bits

    def identify(self, texts: list[str]) -> list[tuple[str, float, float | None, bool]]:
        """For each text: language, confidence, cross-entropy in bits per character, accepted."""
        nothing = (UNDETERMINED, 0.0, None, False)
        if not self.languages or not texts:
            return [nothing] * len(texts)
        if any(len(t) > SLICE for t in texts):
            return [r for t in texts for r in (self.judged(*self.measured(t)) if len(t) > SLICE else self.identify([t]))]
        x, at = codes(texts, self.order)
        grams = windows(x, self.order)
        n = self.order - 1
        scored = x != _START
        letters = np.concatenate([[0], np.cumsum(scored & (x != 32))])
        sizes = np.diff(np.concatenate([[0], np.cumsum(scored)])[at])
        has = np.diff(letters[at]) > 0
        entropy = np.zeros((len(texts), len(self.languages)))
        if len(grams):
            row, hit = found(self.known, keys(grams))
            bits = np.zeros(len(x) + 1, np.float32)
            for i in range(len(self.languages)):  # one language at a time, so memory doesn't grow with their number
                bits[n:-1] = self.bits_of(i, grams, row, hit)
                bits[:-1][~scored] = 0
                entropy[:, i] = np.add.reduceat(bits, at[:-1], dtype=np.float64) / np.maximum(sizes, 1)
        return self.judged(entropy, sizes, has)

    def measured(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropies, characters and whether there is a letter, of one long text read in slices."""
        total, size, letter = np.zeros(len(self.languages)), 0, False
        for x in slices(text, self.order):
            grams = windows(x, self.order)
            if len(grams):
                row, hit = found(self.known, keys(grams))
                total += [self.bits_of(i, grams, row, hit).sum(dtype=np.float64) for i in range(len(self.languages))]
                size, letter = size + len(grams), letter or bool((x[self.order - 1 :] != 32).any())
        return total[None, :] / max(size, 1), np.array([size]), np.array([letter])

    def judged(self, entropy: np.ndarray, sizes: np.ndarray, has: np.ndarray) -> list[tuple[str, float, float | None, bool]]:
        """Language, confidence, cross-entropy and acceptance from the figures of each text."""
        best = entropy.argmin(axis=1)
        low = entropy[np.arange(len(sizes)), best]
        ahead = (entropy - low[:, None]) * np.minimum(sizes, 60)[:, None]
        sure = 1.0 / np.exp2(-ahead).sum(axis=1)
        rows = []
        for i in range(len(sizes)):
            if not has[i]:
                rows.append((UNDETERMINED, 0.0, None, False))
                continue
            limit = self.limits[best[i]]
            rows.append((self.languages[best[i]], float(sure[i]), float(low[i]), bool(low[i] <= limit.level + limit.spread / np.sqrt(sizes[i]))))
        return rows


def fit(labelled: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> dict[str, bytes]:
    """A fitted model for each language of ``labelled``.

    Rows are taken by a hash of their id so that each language gives about
    ``sample_chars`` characters, and about LEAST_DOCUMENTS documents at least. Each
    language is fitted in a task of its own.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"), F.xxhash64(F.lit(5), F.col(id_col), F.col(text_col)).alias("key")
    )
    sizes = rows.groupBy("lang").agg(F.sum(F.length("text")).alias("n"), F.count(F.lit(1)).alias("docs")).collect()
    if not sizes:
        return {}
    chars = min(sample_chars, ALL_CHARS / len(sizes))
    share = F.create_map(*[F.lit(v) for r in sizes for v in (r["lang"], min(1.0, max(chars / max(r["n"], 1), LEAST_DOCUMENTS / r["docs"])))])
    picked = rows.where(F.pmod("key", F.lit(1 << 30)) < F.element_at(share, F.col("lang")) * float(1 << 30))

    def learn(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["key", "text"])
        return pd.DataFrame({"lang": [part["lang"].iloc[0]], "model": [fit_language(part["text"].tolist(), order)]})

    return {r["lang"]: bytes(r["model"]) for r in picked.groupBy("lang").applyInPandas(arrays.lean_group(learn), "lang string, model binary").collect()}


OUT = "lang_pred string, score double, cross_entropy double, accepted boolean"


def identify(docs: DataFrame, fitted: dict[str, bytes], text_col: str = "text", order: int = ORDER) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1), cross_entropy (bits a character) and accepted added.

    Columns of these names that ``docs`` has already are replaced.
    """
    models = docs.sparkSession.sparkContext.broadcast(fitted)
    base = docs.drop("lang_pred", "score", "cross_entropy", "accepted")
    text_at = base.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = Identifier(models.value, order)
        for batch in batches:
            _, offsets = arrays.utf8(batch.column(text_at).cast(pa.string()))
            for first, last in arrays.chunks(offsets, CHUNK_BYTES):
                part = batch.slice(first, last - first)
                rows = identifier.identify([t or "" for t in part.column(text_at).to_pylist()])
                made = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, "lang_pred", "score", "cross_entropy", "accepted"])

    schema = T.StructType(list(base.schema.fields))
    for name, kind in (f.split(" ") for f in OUT.split(", ")):
        schema = schema.add(name, kind)
    return base.mapInArrow(arrays.lean(run), schema)


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (a null id has remainder 0)."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % F.lit(modulus), F.lit(0))
