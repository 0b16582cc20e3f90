"""Benchmark decontamination by an exact shingle filter and exact verification.

A document holds an item if an item-sized window of the document's words has a
weighted (multiset) Jaccard similarity of 0.8 or more with the item, over five-word
shingles. Windows begin at every word and end with the text at the latest, so a text
shorter than the item is a window as a whole.

Of an item with shingles of total weight m, such a window has ``need`` = 0.8 m at
least. It therefore holds one of any set of the item's shingles that weighs more
than m - need. Such a set of each item, those that the fewest items have, is looked
up in the shingles of the documents; a pair that meets in none of them cannot reach
the similarity. Of the pairs that meet, all windows are compared: an occurrence of a
shingle counts in the windows that begin at it or less than a window before it, but
after the occurrence that the item's own number of this shingle lies back. The
number shared by every window is then a running sum, so no window is left out.

Words are runs of letters and digits, in small letters (A-Z and
the Latin-1 capitals are folded). Defined cases: null, empty
and wordless texts and items match nothing; items of fewer than five words have
one shingle; equal items each match; repeated documents each give their own rows;
empty tables give an empty result; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays
from barline.llm.arrays import Words, ragged
from barline.llm.near_dup import SHINGLE, shingles

SIMILARITY = 0.8
#: Bytes of item texts that are sent to all executors at once; more items are taken in blocks of that size.
BLOCK_BYTES = 16 << 20
CHUNK_BYTES = 1 << 18

_SPLIT = arrays.space_table(bytes(c for c in range(128) if not chr(c).isalnum()))


def words_of(texts: pa.Array) -> Words:
    data, offsets = arrays.utf8(texts)
    return Words(arrays.folded(data), offsets, spaces=_SPLIT)


class Index:
    """Shingles of items, and for each length of shingle a table of those by which an item is found."""

    def __init__(self, ids: list[int], texts: list[str], similarity: float = SIMILARITY):
        self.similarity = similarity
        words = words_of(pa.array(texts, pa.large_string()))
        row, self.key, self.number = shingles(words)
        self.ids = ids
        self.at = np.searchsorted(row, np.arange(len(texts) + 1))
        self.shingle = np.minimum(words.per_row, SHINGLE)
        self.mass = np.bincount(row, self.number, len(texts)).astype(np.int64)
        # Rounded down, since the similarity itself is decided on the windows.
        self.need = np.maximum(1, np.ceil(similarity * self.mass - 1e-6).astype(np.int64))
        _, same, owners = np.unique(self.key, return_inverse=True, return_counts=True)
        by = np.lexsort((self.key, owners[same], row))
        number = self.number[by]
        before = np.cumsum(number) - number
        before -= before[self.at[row[by]]] if len(by) else 0
        by = by[before <= (self.mass - self.need)[row[by]]]
        self.tables = {}
        for n in np.unique(self.shingle[row[by]]).tolist():
            own = by[self.shingle[row[by]] == n]
            own = own[np.argsort(self.key[own], kind="stable")]
            keys, first, many = np.unique(self.key[own], return_index=True, return_counts=True)
            shift = np.uint64(64 - min(24, max(10, int(len(keys)).bit_length() + 5)))
            marks = np.zeros(1 << (64 - int(shift)), bool)
            marks[keys >> shift] = True
            self.tables[n] = (shift, marks, keys, first, many, row[own])

    def matches(self, words: Words) -> dict[tuple[int, int], tuple[float, int]]:
        """(row, item) -> similarity and first word of the best window."""
        found: dict[tuple[int, int], tuple[float, int]] = {}
        rows = words.rows()
        for n, (shift, marks, keys, first, many, items) in self.tables.items():
            grams = arrays.ngrams(words.hashes, n)
            place = np.flatnonzero(marks[grams >> shift])
            place = place[rows[place] == rows[place + n - 1]]
            at = np.minimum(np.searchsorted(keys, grams[place]), len(keys) - 1)
            hit = keys[at] == grams[place]
            place, at = place[hit], at[hit]
            item = items[ragged(first[at], many[at])]
            place = np.repeat(place, many[at])
            by = np.lexsort((place, item, rows[place]))
            place, item = place[by], item[by]
            row = rows[place]
            new = np.ones(len(place), bool)
            new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1])
            begin = np.flatnonzero(new)
            end = np.append(begin, len(place))[1:]
            for a, b in zip(begin.tolist(), end.tolist()):
                r, i, m = int(row[a]), int(item[a]), int(self.mass[item[a]])
                top = int(words.row_at[r + 1]) - n + 1
                low = max(int(words.row_at[r]), int(place[a]) - m + 1)
                high = min(top, int(place[b - 1]) + m)
                best = self.best(i, grams[low:high], top - low)
                if best is not None:
                    found[r, i] = (best[0], low + best[1] - int(words.row_at[r]))
        return found

    def best(self, item: int, grams: np.ndarray, left: int) -> tuple[float, int] | None:
        """Similarity and start of the best window of an item over consecutive shingles, of which the text has ``left`` to its end."""
        m, need = int(self.mass[item]), int(self.need[item])
        key, number = self.key[self.at[item] : self.at[item + 1]], self.number[self.at[item] : self.at[item + 1]]
        which = np.minimum(np.searchsorted(key, grams), len(key) - 1)
        place = np.flatnonzero(key[which] == grams)
        if len(place) < need or (place[need - 1 :] - place[: len(place) - need + 1]).min() >= m:
            return None
        which = which[place]
        # Of each occurrence: where the occurrence of the same shingle lies that fills the item's number without it.
        by = np.argsort(which, kind="stable")
        rank = np.arange(len(by))
        back = rank - number[which[by]]
        full = (back >= 0) & (which[by][back] == which[by])
        lowest = np.zeros(len(by), np.int64)
        lowest[by[full]] = place[by[back[full]]] + 1
        lowest = np.maximum(lowest, place - m + 1)
        steps = np.bincount(lowest, minlength=len(grams) + 1) - np.bincount(place + 1, minlength=len(grams) + 1)
        shared = np.cumsum(steps[:-1])
        value = shared / (m + np.minimum(m, left - np.arange(len(grams))) - shared)
        first = int(value.argmax())
        return (float(value[first]), first) if value[first] >= self.similarity else None


OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64())])


def matches(docs: DataFrame, items: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, similarity and first_word of the best window, for every item that a document holds.

    Items are read in blocks of a bounded size; every block is held against all documents.
    """
    spark = docs.sparkSession
    wanted = items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).cast("string").alias("text")).where(F.length("text") > 0)
    total = wanted.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def search(block: int) -> DataFrame:
        rows = wanted.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        sent = spark.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = Index(*sent.value, similarity)
            for batch in batches:
                for first, _, words in arrays.words_in_chunks(batch.column(1), spaces=_SPLIT, limit=CHUNK_BYTES, fold=True):
                    found = index.matches(words)
                    rows = [(batch.column(0)[first + row].as_py(), index.ids[item], value, word) for (row, item), (value, word) in found.items()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(OUT), OUT)], schema=OUT)

        return picked.mapInArrow(arrays.lean(run), "doc_id long, item_id long, similarity double, first_word long")

    found = search(0)
    for block in range(1, blocks):
        found = found.unionByName(search(block))
    return found
