"""Packing token pieces into fixed-size sequences by first-fit decreasing.

``tokenize`` cuts each document's ids into pieces of at most ``capacity`` ids.
``pack`` deals documents to groups at random and runs first-fit decreasing in each
group on its own: pieces in order of falling length, each put into the
lowest-numbered sequence with room, found by a tournament tree over the free space
of the sequences. The number of groups follows the number of pieces, so a group is
a bounded piece of work at any size of the input. Only lengths and places go
through the groups; token ids, where there are any, are joined to them afterwards.

Defined cases: a null text is an empty one; an empty text has the end id alone;
documents are dealt by row, so null and much repeated ids spread over all groups;
repeated rows are packed as often as they come; equal lengths are packed by id
(null first), then start; an empty table gives an empty result; columns beyond the
two named ones are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from barline.llm import arrays
from barline.llm.arrays import Words
from barline.llm.lineage import batches_of, checkpointed

#: Ids in a sequence.
CAPACITY = 2048
#: Appended to every document.
END_ID = 1
#: Words whose ids a worker remembers before it forgets those not met again (about 15 MB), and ids of them all.
REMEMBERED = 400_000
REMEMBERED_IDS = 4_000_000
#: New words are kept apart until there are so many.
RECENT = 20_000
#: Bytes of text that are encoded at a time, unless a single text is longer.
CHUNK_BYTES = 1 << 18
#: New words that go to the tokenizer in one call.
ENCODED = 1024
#: Rows that a worker is sent at a time.
BATCH_ROWS = 1000
#: Pieces in a group, about.
GROUP_PIECES = 16_384


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted hash is in sorted ``keys``, and whether it is there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


class Grown:
    """An array that grows at its end, in place."""

    def __init__(self, values: np.ndarray):
        self.room, self.n = values.copy(), len(values)

    def append(self, more: np.ndarray) -> None:
        n = self.n + len(more)
        if n > len(self.room):
            self.room.resize(n + n // 4, refcheck=False)  # nothing else holds it: reads are copies
        self.room[self.n : n] = more
        self.n = n


def merged(keys: np.ndarray, values: np.ndarray, more: np.ndarray, of_more: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two sorted tables as one."""
    at = np.searchsorted(keys, more)
    return np.insert(keys, at, more), np.insert(values, at, of_more)


#: Mixed case, accents, figures, marks and all white space, for telling how a tokenizer treats words.
PROBE = "Probe WORDS, \u00c9t\u00e9 it's 12.5-3 (x)\n\tand\u00e9  a\u0301b ...Q\r\x0b\x0cz_z #9\u20ac"


class TextEncoder:
    """Ids of texts by any tokenizer, whole texts at a time."""

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer, self.end_id = tokenizer, end_id

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text closed by the end id, and how many each has."""
        raw = data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        parts = [np.array([*e.ids, self.end_id], np.uint32) for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.concatenate(parts), np.array([len(p) for p in parts])


def encoder(path: str, end_id: int) -> TextEncoder | WordEncoder:
    """By words where the tokenizer lower-cases and treats each word alone, else by whole texts."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)

    def ids(x: str) -> list[int]:
        return tokenizer.encode(x, add_special_tokens=False).ids

    alone = [i for w in PROBE.lower().split() for i in ids(w)]
    return WordEncoder(tokenizer, end_id) if ids(PROBE) == alone == ids(PROBE.upper()) else TextEncoder(tokenizer, end_id)


class WordEncoder:
    """Ids of texts by a word-level tokenizer that drops white space and letter case.

    Such a tokenizer splits at white space before anything else, so the ids of a
    text are those of its words end to end. Words are found by their hash in sorted
    arrays; each new one is encoded once, many words to a call. Texts with the
    strings of special tokens go to the tokenizer as they are.
    """

    def __init__(self, tokenizer, end_id: int):
        self.tokenizer = tokenizer
        self.special = tuple(x.content.encode() for x in self.tokenizer.get_added_tokens_decoder().values())
        self.end_id = end_id
        self.reset()

    def reset(self) -> None:
        """Nothing but the end id, at index 0."""
        self.flat, self.at = Grown(np.array([self.end_id], np.uint32)), Grown(np.array([0, 1]))  # the ids of word i are at[i] up to at[i + 1]
        self.levels = [(np.zeros(0, np.uint64), np.zeros(0, np.int32))] * 2  # all older words, and recent ones
        self.again = Grown(np.array([True]))  # whether a word was met after it was learnt

    def forget(self) -> None:
        """Drops words not met again since they were learnt or last kept; all words, if more than half were."""
        stay = self.again.room[: self.again.n].copy()
        if 2 * np.count_nonzero(stay) > REMEMBERED:
            return self.reset()
        long = np.diff(self.at.room[: self.at.n])
        flat, at = self.flat.room[: self.flat.n][np.repeat(stay, long)], np.concatenate([[0], np.cumsum(long[stay])])
        if 2 * len(flat) > REMEMBERED_IDS:
            return self.reset()
        levels, renamed = merged(*self.levels[0], *self.levels[1]), np.cumsum(stay, dtype=np.int32) - 1
        kept = stay[levels[1]]
        self.reset()
        self.flat, self.at, self.again = Grown(flat), Grown(at), Grown(np.arange(len(at) - 1) == 0)
        self.levels[0] = levels[0][kept], renamed[levels[1][kept]]

    @property
    def words(self) -> int:
        return self.at.n - 1

    def places(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words begin, and how many there are."""
        begin = self.at.room[index]
        return begin, self.at.room[index + 1] - begin

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Indices of words by hash, -1 where unknown."""
        (keys, index), recent = self.levels
        at, hit = lookup(keys, hashes)
        out = np.where(hit, index[at] if len(index) else -1, -1)
        rest = np.flatnonzero(~hit)
        if len(rest) and len(recent[0]):
            at, hit = lookup(recent[0], hashes[rest])
            out[rest[hit]] = recent[1][at[hit]]
        return out

    def keep(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Remembers new words; ``hashes`` are distinct and sorted."""
        index = np.arange(self.words, self.words + len(hashes), dtype=np.int32)
        self.at.append(self.flat.n + np.cumsum(lengths))
        self.flat.append(ids)
        self.again.append(np.zeros(len(hashes), bool))
        self.levels[1] = merged(*self.levels[1], hashes, index)
        if len(self.levels[1][0]) > RECENT:
            self.levels = [merged(*self.levels[0], *self.levels[1]), (np.zeros(0, np.uint64), np.zeros(0, np.int32))]

    def indices(self, words: Words) -> np.ndarray:
        """The index of every word; new ones are learnt."""
        index = self.find(words.hashes)
        unknown = np.flatnonzero(index < 0)
        new, first = np.unique(words.hashes[unknown], return_index=True)
        if self.words + 2 * len(new) > REMEMBERED or self.flat.n > REMEMBERED_IDS:
            self.forget()
            index = self.find(words.hashes)
            unknown = np.flatnonzero(index < 0)
            new, first = np.unique(words.hashes[unknown], return_index=True)
        self.again.room[index[index >= 0]] = True
        if len(new):
            self.learn(words, new, unknown[first])
            index[unknown] = self.find(words.hashes[unknown])
        return index

    def learn(self, words: Words, new: np.ndarray, place: np.ndarray) -> None:
        """Remembers words by hash and by where they are."""
        raw = words.data.tobytes()
        texts = [raw[a:b].decode("utf-8", "replace") for a, b in zip(words.starts[place].tolist(), words.ends[place].tolist())]
        # After an ASCII letter, a final stop or comma doesn't change the ids of what stands before it. Other letters may
        # become several characters in small letters, the last of them a mark that joins the stop.
        tails = [t[-1] if t[-1] in ".," and t[-2:-1].isalpha() and t.isascii() else "" for t in texts]
        stems = [t[:-1] if tail else t for t, tail in zip(texts, tails)]
        stem_hash, where = np.unique(hashes_of([*stems, ".", ","]), return_inverse=True)
        example = np.zeros(len(stem_hash), np.int64)
        example[where] = np.arange(len(where))
        missing = np.flatnonzero(self.find(stem_hash) < 0)
        every = [*stems, ".", ","]
        self.encode_words(stem_hash[missing], [every[i] for i in example[missing].tolist()])
        index = self.find(stem_hash)[where]
        tailed = np.flatnonzero(np.array([bool(t) for t in tails]))
        if len(tailed):
            both = np.stack([index[tailed], np.where(np.array([tails[i] == "." for i in tailed.tolist()]), index[-2], index[-1])], axis=1)
            begin, lengths = self.places(both)
            self.keep(new[tailed], self.flat.room[arrays.ragged(begin.ravel(), lengths.ravel())], lengths.sum(axis=1))

    def encode_words(self, hashes: np.ndarray, words: list[str]) -> None:
        """Remembers words by the tokenizer's own ids, told apart by where each id begins."""
        flat, long = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        self.tokenizer.encode_special_tokens = True  # in small letters, a word may read like a special token
        for k in range(0, len(words), ENCODED):
            part = words[k : k + ENCODED]
            found = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            begins = np.fromiter((a for a, _ in found.offsets), np.int64, len(found.ids))
            ends = np.cumsum(np.fromiter(map(len, part), np.int64, len(part)) + 1)
            long.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(part)))
            flat.append(np.array(found.ids, np.uint32))
        self.keep(hashes, np.concatenate(flat), np.concatenate(long))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts end to end, each text closed by the end id, and how many each has."""
        words = Words(arrays.folded(data), offsets)
        index = np.insert(self.indices(words), words.row_at[1:], 0)
        begin, lengths = self.places(index)
        ids = self.flat.room[arrays.ragged(begin, lengths)]
        total = np.concatenate([[0], np.cumsum(lengths)])
        counts = np.diff(total[np.concatenate([[0], np.cumsum(words.per_row + 1)])])
        raw = data.tobytes()
        if any(s in raw for s in self.special):
            self.tokenizer.encode_special_tokens = False
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
                if any(s in raw[a:b] for s in self.special):
                    parts[i] = np.array([*self.tokenizer.encode(raw[a:b].decode("utf-8", "replace"), add_special_tokens=False).ids, self.end_id], np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, counts


def hashes_of(texts: list[str]) -> np.ndarray:
    """Hashes of whole strings without white space, as words have them."""
    data, offsets = arrays.utf8(pa.array(texts, pa.large_string()))
    return Words(data, offsets, spaces=np.zeros(256, bool)).hashes


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("deal", pa.int64())])


def tokenize(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of documents: doc_id, start, length, ids (little-endian uint32), doc_tokens, and a random number of each row (``deal``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = arrays.once_per_process(("encoder", tokenizer_path, end_id), lambda: encoder(tokenizer_path, end_id))
        for batch in batches:
            data, offsets = arrays.utf8(batch.column(1))
            for first, last in arrays.chunks(offsets, CHUNK_BYTES):
                ids, counts = own.encode(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
                begin = np.cumsum(counts) - counts
                pieces = -(-counts // capacity)
                row = np.repeat(np.arange(last - first), pieces)
                start = arrays.ragged(np.zeros(last - first, np.int64), pieces) * capacity
                length = np.minimum(capacity, counts[row] - start)
                at = begin[row] + start
                ids = ids.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(first + row)),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array([ids[a : a + n].tobytes() for a, n in zip(at.tolist(), length.tolist())], pa.binary()),
                        pa.array(counts[row], pa.int64()),
                        batch.column(2).take(pa.array(first + row)),
                    ],
                    schema=PIECES,
                )

    deal = F.xxhash64(F.lit(17), F.col(id_col), F.monotonically_increasing_id())
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), deal.alias("deal"))
    return picked.mapInArrow(arrays.lean(cut), "doc_id long, start long, length long, ids binary, doc_tokens long, deal long")


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each length; the lengths must not rise."""
    size = 1
    while size < max(1, len(lengths)):
        size *= 2
    free = [capacity] * (2 * size)  # a tournament tree: each node has the most free space below it
    used = [0] * size
    bins, offsets = [], []
    for n in lengths:
        node = 1
        while node < size:
            node *= 2
            if free[node] < n:
                node += 1
        left = free[node] - n
        free[node] = left
        b = node - size
        bins.append(b)
        offsets.append(used[b])
        used[b] += n
        node //= 2
        while node:
            most = free[2 * node] if free[2 * node] >= free[2 * node + 1] else free[2 * node + 1]
            if free[node] == most:
                break
            free[node] = most
            node //= 2
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``, and without ``deal``.

    Needs doc_id, start, length (1 up to ``capacity``) and deal, by which rows are
    dealt to groups; other columns pass through. A sequence holds pieces of one
    group only, without gaps. No sequence id occurs in two groups.
    """
    with batches_of(pieces.sparkSession, BATCH_ROWS):
        pieces = checkpointed(pieces.drop("sequence_id", "offset").withColumn("pack_row", F.monotonically_increasing_id()))
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(table: pa.Table) -> pa.Table:
        # Nulls come first in one order only if it is that of all keys, so lengths are sorted by their negative.
        table = table.append_column("less", pc.negate(table.column("length")))
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in ("less", "doc_id", "start", "pack_row")], null_placement="at_start"))
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), capacity)
        group = table.column("pack_group")[0].as_py()
        made = table.select([n for n in table.column_names if n not in ("less", "pack_group")])
        return made.append_column("sequence_id", pa.array(np.array(bins, np.int64) + (group << 32))).append_column("offset", pa.array(offsets, pa.int64()))

    placed = pieces.withColumn("pack_group", F.pmod("deal", F.lit(groups))).drop("deal")
    light = [f for f in placed.schema.fields if not isinstance(f.dataType, (T.BinaryType, T.StringType))]
    heavy = [f.name for f in placed.schema.fields if f not in light]
    schema = T.StructType([f for f in light if f.name != "pack_group"]).add("sequence_id", "long").add("offset", "long")
    packed = placed.select(*[f.name for f in light]).groupBy("pack_group").applyInArrow(arrays.lean_group(fill), schema)
    if heavy:
        packed = packed.join(pieces.select("pack_row", *heavy), "pack_row")
    return packed.select(*[c for c in pieces.columns if c not in ("deal", "pack_row")], "sequence_id", "offset")
