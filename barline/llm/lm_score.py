"""Language-model scores by deleted interpolation over words.

P(w | h) mixes three maximum-likelihood estimates: of the pair (h, w), of w alone,
and a uniform one. The weights depend on how often the context h was seen (by
powers of two) and are learned by expectation-maximisation on held-out counts: one
fold of the training texts, scored with the counts of all other training texts.

How counting is distributed: texts are dealt to blocks by a hash of their id and
text and travel compressed. Each block sends its distinct words and pairs with
their counts, cut by hash range, to the owner of that range; the owner adds them up
and answers with the totals in the same order. So what is shuffled is distinct
n-grams per block instead of tokens, and no table of the corpus is broadcast or
collected. Totals then meet their block's texts, where all tokens are scored at
once. Only three corpus sums, and a histogram of bounded size for the weights, reach
the driver. Blocks and ranges grow with the root of the corpus once that keeps a
message above MESSAGE_BYTES of text, so the number of messages (blocks times
ranges) grows with the corpus and not with its square, and the memory of a task
with its root.

Words are runs of bytes other than white space with A-Z as a-z, told apart by
64-bit hashes; each text ends with one end token, which is also the context of its
first word. Totals are 64-bit numbers. Defined cases: a null or empty text is its
end token alone; a null id is dealt by its text and counts as training; repeated rows each count and each get a row; an empty table
gives an empty result; with nothing to learn from, only the uniform estimate is
left; only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from barline.llm import arrays
from barline.llm.arrays import Words, mix
from barline.llm.lineage import checkpointed

#: Bytes of text in a block, and of all texts for each owner of a hash range, about; more where messages would get small.
BLOCK_BYTES = 12 << 20
RANGE_BYTES = 16 << 20
#: Bytes of a block's text for each message that it sends, at least, about.
MESSAGE_BYTES = 2500
END = np.uint64(0x0E4D0E4D0E4D0E4D)
#: Classes of context frequency: 0, 1, 2-3, 4-7, ..
CLASSES = 24
#: Steps of the histogram in log10 of an estimate; the last cell is for 0.
STEP, CELLS = 0.1, 120
ITERATIONS = 60
START = (0.4, 0.4, 0.2)


def _planes(x: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, which compress well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()


def _numbers(raw: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _steps(x: np.ndarray) -> np.ndarray:
    return np.diff(x, prepend=np.uint64(0))


class Block:
    """The tokens of a block's texts, and its distinct words and pairs in order of their hashes."""

    def __init__(self, table: pa.Table):
        parts = [pa.ipc.open_stream(p.as_py()).read_all() for p in table.column("payload")]
        rows = pa.concat_tables(parts).combine_chunks()
        order = np.lexsort((rows.column("training").to_numpy(zero_copy_only=False), rows.column("text_key").to_numpy()))
        rows = rows.take(pa.array(order))
        self.ids = rows.column("doc_id")
        training = rows.column("training").to_numpy(zero_copy_only=False)
        data, offsets = arrays.utf8(rows.column("text"))
        hashes, per_row = [], []
        for first, last in arrays.chunks(offsets):
            words = Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], arrays.LOWER_VALUES)
            hashes.append(np.insert(words.hashes, words.row_at[1:], END))
            per_row.append(words.per_row + 1)
        self.tokens = np.concatenate(hashes)
        self.per_row = np.concatenate(per_row)
        self.at = np.cumsum(self.per_row) - self.per_row
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[:1] = END
        learned = np.repeat(training, self.per_row)
        self.words, self.word = np.unique(self.tokens, return_inverse=True)
        self.pairs, self.pair = np.unique(mix(context * np.uint64(0xD1342543DE82EF95) + self.tokens), return_inverse=True)
        self.word_counts = np.bincount(self.word[learned], minlength=len(self.words)).astype(np.uint32)
        self.pair_counts = np.bincount(self.pair[learned], minlength=len(self.pairs)).astype(np.uint32)
        end = int(np.searchsorted(self.words, END))
        self.context = np.empty_like(self.word)
        self.context[1:] = self.word[:-1]
        self.context[:1] = end

    def totals(self, table: pa.Table, deleted: bool) -> list[np.ndarray]:
        """Corpus counts of the words and pairs (and their part in the held-out fold), from the owners' answers."""
        answers = table.sort_by("range").column("payload").to_pylist()
        found: list[list[np.ndarray]] = [[], [], [], []]
        for raw in answers:
            for at, part in zip(found, _fields(raw)):
                at.append(_numbers(part, np.uint64))
        made = [np.concatenate(f).astype(np.float64) if f else np.zeros(0) for f in found]
        return made if deleted else made[:2]


def _joined(fields: list[bytes]) -> bytes:
    """One compressed message."""
    return zstandard.ZstdCompressor(level=1).compress(b"".join(len(f).to_bytes(8, "little") + f for f in fields))


def _fields(message: bytes) -> Iterator[bytes]:
    raw, at = zstandard.ZstdDecompressor().decompress(message), 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        yield raw[at + 8 : at + 8 + n]
        at += 8 + n


def _dealt(docs: DataFrame, held_out: Column, fold: Column, blocks: int, folds: int, id_col: str, text_col: str) -> DataFrame:
    """(block, payload): texts by block, compressed. Blocks from ``blocks`` on hold the fold."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("training", pa.bool_()), ("text_key", pa.int64())])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column(4).to_numpy()
            for number in np.unique(block):
                part = pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(batch.take(pa.array(np.flatnonzero(block == number))).columns, schema)], schema=schema)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["block", "payload"])

    key = F.xxhash64(F.lit(11), F.col(id_col), F.col(text_col))
    block = F.when(fold, F.lit(blocks) + F.pmod(key, F.lit(folds))).otherwise(F.pmod(key, F.lit(blocks)))
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), (~held_out).alias("training"), F.xxhash64(id_col, text_col).alias("text_key"), block.cast("long").alias("block"))
    return picked.mapInArrow(arrays.lean(deal), "block long, payload binary")


def _counts(table: pa.Table, ranges: int, blocks: int) -> pa.Table:
    """A block's distinct n-grams and their training counts, by owner."""
    number = table.column("block")[0].as_py()
    block = Block(table)
    # Ranges follow the high half of the hash, so sorted keys come by rising range. Ranges without keys get no row.
    sides = [(keys, counts, ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)) for keys, counts in ((block.words, block.word_counts), (block.pairs, block.pair_counts))]
    owners = np.union1d(sides[0][2], sides[1][2])
    cuts = [(np.searchsorted(own, owners, "left"), np.searchsorted(own, owners, "right")) for _, _, own in sides]
    rows = []
    for r in range(len(owners)):
        fields = []
        for (keys, counts, _), (first, last) in zip(sides, cuts):
            fields += [_planes(_steps(keys[first[r] : last[r]])), _planes(counts[first[r] : last[r]])]
        rows.append(_joined(fields))
    n = len(owners)
    return pa.table({"range": pa.array(owners.astype(np.int64)), "block": pa.array([number] * n, pa.int64()), "fold": pa.array([number >= blocks] * n), "payload": pa.array(rows, pa.binary())})


ANSWERS = "block long, range long, payload binary, types long, tokens long, fold_tokens long"


def _owner(table: pa.Table) -> pa.Table:
    """Totals over all blocks in each block's own order; a row without block has the sums of the range."""
    own = table.column("range")[0].as_py()
    numbers, folds = table.column("block").to_pylist(), table.column("fold").to_pylist()
    payloads = [list(_fields(p)) for p in table.column("payload").to_pylist()]
    answers: list[list[bytes]] = [[] for _ in numbers]
    late: list[list[bytes]] = [[] for _ in numbers]
    sums = (0, 0, 0)
    for side in (0, 2):
        keys = [np.cumsum(_numbers(p[side], np.uint64), dtype=np.uint64) for p in payloads]
        counts = [_numbers(p[side + 1], np.uint32) for p in payloads]
        sizes = [len(k) for k in keys]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        every = np.concatenate(counts)
        in_fold = np.repeat(folds, sizes)
        total = np.bincount(where, every, len(distinct)).astype(np.uint64)
        held = np.bincount(where[in_fold], every[in_fold], len(distinct)).astype(np.uint64)
        if side == 0:
            sums = (int((total > 0).sum()), int(total.sum()), int(held.sum()))
        for i, part in enumerate(np.split(where, np.cumsum(sizes)[:-1])):
            answers[i].append(_planes(total[part]))
            if folds[i]:
                late[i].append(_planes(held[part]))
    rows = [(n, own, _joined(a + b), None, None, None) for n, a, b in zip(numbers, answers, late)] + [(None, own, None, *sums)]
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[f.split(" ")[0] for f in ANSWERS.split(", ")])


def frequency_class(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(np.log2(count + 1)), CLASSES - 1).astype(np.int64)


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.minimum(np.floor(-np.log10(p) / STEP), CELLS - 2), CELLS - 1).astype(np.int64)


def learn_weights(cells: np.ndarray, counts: np.ndarray, types: int) -> np.ndarray:
    """Mixture weights (pair, word, uniform) of each frequency class by expectation-maximisation on held-out counts."""
    weights = np.tile(np.array(START), (CLASSES, 1))
    value = np.append(10.0 ** (-(np.arange(CELLS - 1) + 0.5) * STEP), 0.0)
    kind, pair, word = cells // (CELLS * CELLS), cells // CELLS % CELLS, cells % CELLS
    estimates = np.stack([value[pair], value[word], np.full(len(cells), 1.0 / (types + 1))], axis=1)
    for _ in range(ITERATIONS):
        parts = weights[kind] * estimates
        parts *= (counts / parts.sum(axis=1))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(kind, parts[:, k], CLASSES) + START[k]
        weights /= weights.sum(axis=1, keepdims=True)
    return weights


SCORES = "doc_id long, n_tokens long, n_known long, base_sum double, score double"


def score(docs: DataFrame, held_out: Column, fold: Column, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every text.

    Texts where ``held_out`` is true are not learned from; those where ``fold`` is
    true (and ``held_out`` is not) are what the mixture weights are learned on.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string"))).alias("n")).first()["n"] or 0
    wider = max(1.0, math.sqrt(size * MESSAGE_BYTES / (block_bytes * range_bytes)))
    blocks = max(1, math.ceil(size / (block_bytes * wider)))
    folds = max(1, blocks // 6)
    ranges = max(1, math.ceil(size / (range_bytes * wider)))
    fold = fold & ~held_out

    def dealt(rows: DataFrame) -> DataFrame:
        return _dealt(rows, held_out, fold, blocks, folds, id_col, text_col)

    sent = dealt(docs).groupBy("block").applyInArrow(lambda t: _counts(t, ranges, blocks), "range long, block long, fold boolean, payload binary")
    answers = checkpointed(sent.groupBy("range").applyInArrow(arrays.lean_group(_owner), ANSWERS))
    sums = answers.where(F.col("block").isNull()).agg(F.sum("types").alias("types"), F.sum("tokens").alias("tokens"), F.sum("fold_tokens").alias("fold_tokens")).first()
    types, tokens, fold_tokens = sums["types"] or 0, sums["tokens"] or 0, sums["fold_tokens"] or 0
    replies = answers.where(F.col("block").isNotNull()).select("block", "range", "payload")

    def meet(rows: DataFrame, replies: DataFrame, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        return dealt(rows).groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(work, schema)

    def held_out_events(texts: pa.Table, reply: pa.Table) -> pa.Table:
        block = Block(texts)
        word, pair, word_held, pair_held = block.totals(reply, True)
        seen = (word - word_held)[block.context]
        p_pair = np.where(seen > 0, (pair - pair_held)[block.pair] / np.maximum(seen, 1), 0)
        p_word = (word - word_held)[block.word] / max(tokens - fold_tokens, 1)
        cell, count = np.unique((frequency_class(seen) * CELLS + _cell(p_pair)) * CELLS + _cell(p_word), return_counts=True)
        return pa.table({"cell": pa.array(cell), "n": pa.array(count)})

    events = meet(docs.where(fold), replies.where(F.col("block") >= blocks), held_out_events, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    weights = learn_weights(np.array([r["cell"] for r in events], np.int64), np.array([r["n"] for r in events], np.float64), types)

    def scored(texts: pa.Table, reply: pa.Table) -> pa.Table:
        block = Block(texts)
        word, pair = block.totals(reply, False)
        seen = word[block.context]
        mixed = weights[frequency_class(seen)]
        p = mixed[:, 0] * np.where(seen > 0, pair[block.pair] / np.maximum(seen, 1), 0) + mixed[:, 1] * (word[block.word] / max(tokens, 1)) + mixed[:, 2] / (types + 1)
        known = word[block.word]
        return pa.table(
            {
                "doc_id": block.ids,
                "n_tokens": pa.array(block.per_row),
                "n_known": pa.array(np.add.reduceat((known > 0).astype(np.int64), block.at)),
                "base_sum": pa.array(np.add.reduceat(np.log10(known + 1), block.at)),
                "score": pa.array(np.add.reduceat(np.log10(p), block.at)),
            }
        )

    base = F.col("base_sum") - F.col("n_tokens") * float(np.log10(tokens + types + 1))
    return meet(docs, replies, scored, SCORES).select("doc_id", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), base.alias("base_score"), "score")
