"""Spelling variants: all pairs of words one edit apart, found by Gram matrices of letter counts.

``word_counts`` counts maximal runs of letters over whole texts. Two words that differ
by one inserted, deleted or replaced letter have letter counts at a squared distance
of 1 or 2, and squared distances of whole blocks of words are one matrix product
(|a|^2 + |b|^2 - 2ab). Blocks are cells of words with equal numbers of letters in each
of GROUPS groups of letters, so words of one length fall into many cells, and a cell
need only be held against itself, against cells of its length with one letter moved
from a group to another, and against cells one letter longer. No pair one edit apart
lies elsewhere. Pairs that the product keeps are verified letter by letter.

Work: a word visits 1 + 6 + 15 cells at most. Cells are cut into blocks of at most
LEFT by RIGHT words, by their counted numbers of words, so no task holds a whole cell
however large. What comes back from a block is a partial number and best partner for
each of its words, never its pairs.

Defined cases: a null text has no words, a null id is an empty one; texts are read in
slices, and one text must fit a task; repeated rows count as often as they come; equal
counts are told apart by code-point order; an empty table gives an empty result;
only the two named columns are read, whatever the names of others.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.lineage import checkpointed, release

#: Of a run whose checksum this divides, one letter is left out.
DROP = 97
LEAST_LETTERS = 5
LEAST_COUNT = 3
#: A form has at least so many times the occurrences of the word.
FORM_TIMES = 2
#: Groups of letters (by code point modulo) whose numbers make a cell.
GROUPS = 6
#: Words of a cell and of its visitors in one block.
LEFT = 1024
RIGHT = 16_384
#: Cells cut into blocks whose numbers are broadcast; more are joined by a shuffle.
BROADCAST_CELLS = 1_000_000
#: Rows of blocks in one call of the comparison, about.
TASK_ROWS = 20_000
#: Distinct words that a counting task holds before it sends their numbers on.
HELD = 200_000
SLICE = 4 << 20

#: Latin-1 with A-Z as small letters and a space for all but a-z and U+00C0 to U+00FF.
LETTERS = bytes(c if 97 <= c <= 122 or c >= 0xC0 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_KEYS = arrays.mix(np.arange(1, GROUPS + 1, dtype=np.uint64))


def runs(text: str) -> Counter[bytes]:
    """Numbers of the letter runs of a text, in Latin-1."""
    raw = text.encode("latin-1", "replace").translate(LETTERS)
    found: Counter[bytes] = Counter()
    begin = 0
    while begin < len(raw):
        end = raw.find(b" ", begin + SLICE)
        end = len(raw) if end < 0 else end
        found.update(raw[begin:end].split())
        begin = end
    return found


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) for the words of at least LEAST_LETTERS letters and LEAST_COUNT occurrences."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, int] = {}

        def sent() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in found], pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return made

        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1)):
                if not text.is_valid:
                    continue
                base = crc32(f"{i.as_py() if i.is_valid else ''}:".encode())
                for run, n in runs(text.as_py()).items():
                    if len(run) >= LEAST_LETTERS:
                        h = crc32(run if run.isascii() else run.decode("latin-1").encode(), base)
                        if not h % DROP:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                            if len(run) < LEAST_LETTERS:
                                continue
                        found[run] = found.get(run, 0) + n
                if len(found) > HELD:
                    yield sent()
        yield sent()

    picked = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text"))
    counted = picked.mapInArrow(arrays.lean(count), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def group_counts(words: list[bytes]) -> np.ndarray:
    """How many letters of each group each word has."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), size)
    return np.bincount(row * GROUPS + np.frombuffer(b"".join(words), np.uint8) % GROUPS, minlength=len(words) * GROUPS).reshape(-1, GROUPS)


def visits(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """Rows and the cells that they visit: their own, those one letter shorter, and those of their length that come before it."""
    counts = group_counts(words)
    own = (counts.astype(np.uint64) * _KEYS).sum(axis=1, dtype=np.uint64)
    yield np.arange(len(words)), own, True
    for i in range(GROUPS):
        has = np.flatnonzero(counts[:, i])
        yield has, own[has] - _KEYS[i], False
        for j in range(i + 1, GROUPS):
            yield has, own[has] - _KEYS[i] + _KEYS[j], False


def letter_counts(words: list[bytes]) -> np.ndarray:
    size = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), size)
    letters = np.frombuffer(b"".join(words), np.uint8)
    return np.bincount(row * 256 + letters, minlength=len(words) * 256).reshape(-1, 256).astype(np.float32 if size.max(initial=0) < 1000 else np.float64)


def letters_of(words: list[bytes]) -> np.ndarray:
    """Words of one length as a matrix of letters."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def one_edit(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Whether each row of ``long`` is that of ``short`` with one letter replaced, or, one letter longer, with one inserted."""
    n = short.shape[1]
    if long.shape[1] == n:
        return (short != long).sum(axis=1) == 1
    head = (short == long[:, :n]).cumprod(axis=1).sum(axis=1)
    tail = (short == long[:, 1:])[:, ::-1].cumprod(axis=1).sum(axis=1)
    return head + tail >= n


def near_pairs(left: list[bytes], right: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs one edit apart, of words of one length and words of that length or one more."""
    found = []
    a, size = letter_counts(left), np.fromiter(map(len, right), np.int64, len(right))
    matrix = letters_of(left)
    for length in np.unique(size):
        place = np.flatnonzero(size == length)
        for begin in range(0, len(place), 2048):
            part = place[begin : begin + 2048]
            words = [right[i] for i in part.tolist()]
            b = letter_counts(words)
            used = a.any(axis=0) | b.any(axis=0)
            x, y = a[:, used], b[:, used]
            i, j = np.nonzero((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1)[None, :] - 2 * (x @ y.T) <= 2)
            other = letters_of(words)
            for k in range(0, len(i), 1 << 16):  # letters of so many pairs at a time
                keep = one_edit(matrix[i[k : k + (1 << 16)]], other[j[k : k + (1 << 16)]])
                found.append((i[k : k + (1 << 16)][keep], part[j[k : k + (1 << 16)][keep]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def partners(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) for every word with a near one: how many there are, and the most frequent of them."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [w.encode("latin-1") for w in batch.column(0).to_pylist()]
            for row, cell, own in visits(found):
                part = batch.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(cell.view(np.int64)), pa.array(np.full(len(row), own))], names=["word", "n", "cell", "own"])

    sent = words.select("word", "n").mapInArrow(arrays.lean(visit), "word string, n long, cell long, own boolean")
    # Only cells that have words of their own are visited.
    cells = sent.where("own").groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / LEFT).cast("int").alias("lefts"))
    placed = checkpointed(sent.join(cells, "cell"))
    crowded = checkpointed(placed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / RIGHT).cast("int").alias("rights")).where("rights > 1"))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_CELLS else crowded
    placed = placed.join(crowded, "cell", "left").withColumn("rights", F.coalesce("rights", F.lit(1)))

    def place(of: str):
        return F.pmod(F.xxhash64("word"), F.col(of)).cast("int")

    def every(of: str):
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    lefts = placed.where("own").select("cell", place("lefts").alias("l"), every("rights").alias("r"), "word", "n", "own", F.lit(True).alias("left"))
    rights = placed.select("cell", every("lefts").alias("l"), place("rights").alias("r"), "word", "n", "own", F.lit(False).alias("left"))
    blocks = lefts.unionByName(rights).withColumn("block", F.xxhash64("cell", "l", "r")).drop("cell", "l", "r")
    release(words.sparkSession)
    tasks = max(1, -(-blocks.count() // TASK_ROWS))

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        letters = [w.encode("latin-1") for w in table.column("word").to_pylist()]
        n, own, left, block = (table.column(c).to_numpy() for c in ("n", "own", "left", "block"))
        ends = np.append(np.flatnonzero(block[1:] != block[:-1]) + 1, len(block))
        pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        begin = 0
        for end in ends.tolist():
            at = np.arange(begin, end)
            a, b = at[left[begin:end]], at[~left[begin:end]]
            if len(a) and len(b):
                i, j = near_pairs([letters[k] for k in a.tolist()], [letters[k] for k in b.tolist()])
                i, j = a[i], b[j]
                # Both words of a pair within one cell are on both sides.
                once = np.array([not own[y] or letters[x] < letters[y] for x, y in zip(i.tolist(), j.tolist())], bool)
                pairs.append((i[once], j[once]))
            begin = end
        i, j = (np.concatenate(x) for x in zip(*pairs))
        distinct, name = np.unique(np.array(letters, object), return_inverse=True)  # in code-point order
        times = np.zeros(len(distinct), np.int64)
        times[name] = n
        this, other = name[np.concatenate([i, j])], name[np.concatenate([j, i])]
        by = np.lexsort((other, -times[other], this))
        this, other = this[by], other[by]
        first = np.flatnonzero(np.append(True, this[1:] != this[:-1])) if len(this) else this
        return pa.table(
            {
                "word": pa.array([distinct[k].decode("latin-1") for k in this[first].tolist()], pa.string()),
                "n_near": pa.array(np.diff(np.append(first, len(this))), pa.int64()),
                "form": pa.array([distinct[k].decode("latin-1") for k in other[first].tolist()], pa.string()),
                "form_n": pa.array(times[other[first]], pa.int64()),
            }
        )

    found = blocks.withColumn("task", F.pmod("block", F.lit(tasks))).groupBy("task").applyInArrow(arrays.lean_group(compare), "word string, n_near long, form string, form_n long")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), "form"))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): forms followed to the last one, twice as far in each round.

    Occurrences double from a word to its form, so chains are short and without circles.
    """
    found = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = found.select(F.col("word").alias("root"), F.col("root").alias("further"))
        found = checkpointed(found.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        if found.where("moved").isEmpty():
            return found.select("word", "root")
        found = found.drop("moved")


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of (word, n): the near word that it is probably a misspelling of."""
    seen = words.join(partners(words), "word", "left")
    is_form = F.col("form_n") >= FORM_TIMES * F.col("n")
    seen = checkpointed(seen.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("form")).alias("form"), F.when(is_form, F.col("form_n")).alias("form_n")))
    ends = roots(seen.where("form IS NOT NULL"))
    return seen.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
