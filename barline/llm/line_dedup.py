"""Line deduplication by a segment-partition edit join.

Lines within ``edits`` edits of each other must share one of ``edits + 1`` segments
of the shorter one unchanged. Every distinct line indexes its own segments, and
probes, for each length that a partner may have, the few substrings that can be
such a segment (positions are bounded from the left and from the right). Segment
and partner length make one 64-bit key; rows that share a key meet in one sorted
partition. A parity signature of the characters discards most chance meetings, and
a banded bit-parallel edit distance verifies the rest on the whole lines.

Hot keys (lines of one template share whole segments) are found on a sample of the
lines and treated apart: what is left of a line without the shared segment is cut
into segments once more, so that lines meet only if they share a second segment.
The cuts of a key follow how much its lines vary from place to place, so that each
new segment has a like share of what tells the lines apart. This goes on while a
key would still make many pairs. It loses no pair: what is left of two lines within
``edits`` edits is itself within ``edits`` edits.

Lines linked directly or through others form a class, named by its first line (by
doc_id, then line number). Deduplication keeps that line and drops the others.

Defined cases: a line is what lies between two newlines; lines of white space only
are not compared and always stay; lines shorter than ``min_chars`` match only if
equal (MIN_CHARS by default, 1 compares all); null and empty texts have no lines to drop; rows of one doc_id are taken
together, so repeated rows get one result; rows without doc_id cannot be the first
line of a class and are left as they are; an empty table gives an empty result;
lines are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barline.llm import arrays
from barline.llm.arrays import mix, ragged
from barline.llm.components import components
from barline.llm.lineage import checkpointed

EDITS = 2
#: What the operator means by a repeated line: shorter lines are other lines after two edits, so they match only if equal.
MIN_CHARS = 20
#: A key is looked at as a hot one from so many rows of every SAMPLE-th line on, and split if its rows would make more pairs.
SAMPLE, SAMPLED_ROWS = 64, 32
MANY_PAIRS = 1 << 18
#: Lines of a hot key that its cuts are chosen by, about.
PROFILE_ROWS = 200
#: Line hashes that a task remembers, so as to send a repeated line once.
REMEMBERED = 1 << 20
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs that are compared at a time.
PAIRS = 1 << 20


def segment(length: np.ndarray, i: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of segment i of lines of these lengths; the last segments are the longer ones."""
    base, rest = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - rest)), base + (i >= parts - rest)


def code_points(lines: list[str]) -> np.ndarray:
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)


def rolling(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Running sums of code points and factors, by which ``(total[b] - total[a]) * inverse[a]`` is the hash of x[a:b]."""
    total = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(mix(x.astype(np.uint64) + np.uint64(3)) * arrays.powers(arrays._BASE, len(x)), out=total[1:])
    return total, arrays.powers(arrays._INVERSE, len(x) + 1)


def segment_keys(lines: list[str], edits: int = EDITS) -> Iterator[tuple[bool, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each segment and probe: whether it is an index key, how many characters more the line has than its partner, the
    keys of all lines (0 where a probe does not fit), and where the substring starts and how long it is."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    total, inverse = rolling(code_points(lines))
    at = np.cumsum(size) - size
    for fewer in range(edits + 1):
        length = size - fewer
        for i in range(edits + 1):
            start, many = segment(length, i, edits + 1)
            for shift in range(max(-i, fewer - (edits - i)), min(i, fewer + edits - i) + 1):
                a = start + shift
                fits = (a >= 0) & (a + many <= size) & (length > 0)
                begin = np.where(fits, at + a, at)
                end = np.where(fits, begin + many, begin)
                key = mix((total[end] - total[begin]) * inverse[begin] + mix((length * 8 + i).astype(np.uint64)))
                yield fewer == 0 and shift == 0, fewer, np.where(fits, key, 0), a, many


def parity(lines: list[str]) -> np.ndarray:
    """A bit for each of 64 classes of characters: whether the line has an odd number of them. An edit turns two bits at most."""
    size = np.fromiter(map(len, lines), np.int64, len(lines))
    x = code_points(lines)
    return np.bitwise_xor.reduceat(np.left_shift(np.uint64(1), (x % 64).astype(np.uint64)), np.cumsum(size) - size)


def meeting(key: np.ndarray, index: np.ndarray, line: np.ndarray, sign: np.ndarray, edits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of lines that share a key, one of them by an index key, and whose parities allow ``edits``."""
    by = np.lexsort((line, ~index, key))
    key, index, line, sign = key[by], index[by], line[by], sign[by]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (index[1:] != index[:-1])
    key, index, line, sign = key[new], index[new], line[new], sign[new]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(first, len(key)))
    indexed = np.add.reduceat(index.astype(np.int64), first) if len(key) else first
    begin = np.repeat(first, sizes)
    partners = np.minimum(np.arange(len(key)) - begin, np.repeat(indexed, sizes))
    rows = np.flatnonzero(partners)
    ends = np.cumsum(partners[rows])
    done = 0
    while done < len(rows):
        stop = max(int(np.searchsorted(ends, (ends[done - 1] if done else 0) + PAIRS, "right")), done + 1)
        part = rows[done:stop]
        x, y = np.repeat(part, partners[part]), ragged(begin[part], partners[part])
        near = (np.bitwise_count(sign[x] ^ sign[y]) <= 2 * edits) & (line[x] != line[y])
        a, b = line[x[near]], line[y[near]]
        yield np.minimum(a, b), np.maximum(a, b)
        done = stop


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance is at most ``edits``: bit vectors of the vertical steps in a band of 2 * edits + 1 rows."""
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > edits:
        return False
    low = 0
    while low < len(a) and a[low] == b[low]:
        low += 1
    high = 0
    while high < len(a) - low and a[-1 - high] == b[-1 - high]:
        high += 1
    a, b = a[low : len(a) - high], b[low : len(b) - high]
    rows, columns = len(a), len(b)
    if rows == 0:
        return columns <= edits
    band = 2 * edits + 1
    full = (1 << band) - 1
    up, down = full & ~((1 << edits) - 1), 0  # before the first column, each row is one above the last
    distance = min(edits, rows)
    for j in range(1, columns + 1):
        c = b[j - 1]
        top = j - edits  # the row of bit 0
        same = 0
        for t in range(band):
            i = top + t
            if 1 <= i <= rows and a[i - 1] == c:
                same |= 1 << t
        d0 = ((((same & up) + up) ^ up) | same | down) & full
        hp = (down | ~(d0 | up)) & full
        hn = d0 & up
        if top + band - 1 <= rows:
            distance += not d0 >> (band - 1) & 1
        else:
            t = rows - top
            if t < 0:
                return False
            distance += (hp >> t & 1) - (hn >> t & 1)
        up = (hn | ~((d0 >> 1) | hp)) & full
        down = (d0 >> 1) & hp
    return distance <= edits


def lines_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no (from 0), line and its hash, for all lines that are not white space only."""
    rows = docs.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(F.col(text_col).cast("string"), "\n")).alias("line_no", "line"))
    return rows.where(F.col("line").rlike(r"\S")).withColumn("h", F.xxhash64("line"))


KEYED = "key long, index boolean, h long, sign long"


def keyed(lines: DataFrame, edits: int, places: bool = False) -> DataFrame:
    """Index and probe rows of lines (h, line); with ``places`` also the line's surplus and its substring."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.zeros(0, np.int64)
        for batch in batches:
            h, once = np.unique(batch.column(0).to_numpy(), return_index=True)
            new = ~np.isin(h, known, assume_unique=True)
            known = np.union1d(known, h) if len(known) < REMEMBERED else h
            batch = batch.take(pa.array(once[new]))
            for first, last in arrays.chunks(arrays.utf8(batch.column(1))[1]):
                h = batch.column(0).slice(first, last - first).to_numpy()
                text = batch.column(1).slice(first, last - first).to_pylist()
                sign = parity(text).view(np.int64)
                for index, fewer, key, a, many in segment_keys(text, edits):
                    fits = np.flatnonzero(key)
                    made = [pa.array(key[fits].view(np.int64)), pa.array(np.full(len(fits), index)), pa.array(h[fits]), pa.array(sign[fits])]
                    if places:
                        made += [pa.array(np.full(len(fits), fewer)), pa.array(a[fits]), pa.array(many[fits])]
                    yield pa.RecordBatch.from_arrays(made, names=["key", "index", "h", "sign", "fewer", "at", "many"][: len(made)])

    return lines.select("h", "line").mapInArrow(arrays.lean(emit), KEYED + (", fewer long, at long, many long" if places else ""))


def met(rows: DataFrame, edits: int) -> DataFrame:
    """Pairs (a, b) of lines whose rows (key, index, h, sign) share a key."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []

        def out(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            for a, b in meeting(*columns, edits):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)]
            if not len(columns[0]):
                continue
            whole = int(np.searchsorted(columns[0], columns[0][-1]))  # rows of the last key may go on in the next batch
            if whole:
                held.append([c[:whole] for c in columns])
                yield from out([np.concatenate(c) for c in zip(*held)])
                held = []
            held.append([c[whole:] for c in columns])
        if held:
            yield from out([np.concatenate(c) for c in zip(*held)])

    return rows.select("key", "index", "h", "sign").repartition("key").sortWithinPartitions("key").mapInArrow(arrays.lean(meet), "a long, b long")


def cuts_by_variety(lines: list[str], parts: int) -> list[int]:
    """Ends of ``parts`` segments of lines of one length, each with a like share of the entropy of the lines' places."""
    n = len(lines[0])
    x = code_points([y for y in lines if len(y) == n]).reshape(-1, n)
    weight = np.full(n, 1e-3)  # so that places without variety are shared out too
    for i in range(n):
        share = np.unique(x[:, i], return_counts=True)[1] / len(x)
        weight[i] += -(share * np.log(share)).sum()
    total = np.cumsum(weight)
    ends: list[int] = []
    for k in range(1, parts):
        end = int(np.searchsorted(total, total[-1] * k / parts)) + 1
        ends.append(min(max(end, (ends[-1] if ends else 0) + 1), n - (parts - k)))
    return [*ends, n]


def split_again(rows: DataFrame, edits: int) -> DataFrame:
    """Rows (key, index, h, sign, fewer, rest, ends) as rows of their second segments; ``rest`` loses the shared one."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last in arrays.chunks(arrays.utf8(batch.column(5))[1]):
                part = batch.slice(first, last - first)
                key, index, h, sign, fewer = (part.column(i).to_numpy(zero_copy_only=False) for i in range(5))
                rest = part.column(5).to_pylist()
                ends = np.array(part.column(6).to_pylist(), np.int64).reshape(len(rest), edits + 1)
                size = np.fromiter(map(len, rest), np.int64, len(rest))
                total, inverse = rolling(code_points(rest))
                at = np.cumsum(size) - size
                for j in range(edits + 1):
                    start = ends[:, j - 1] if j else np.zeros(len(rest), np.int64)
                    many = ends[:, j] - start
                    for shift in range(-edits, edits + 1):
                        a = start + shift
                        ok = np.flatnonzero((np.abs(shift) + np.abs(fewer - shift) <= edits) & (a >= 0) & (a + many <= size))
                        begin, end = (at + a)[ok], (at + a + many)[ok]
                        new = mix((total[end] - total[begin]) * inverse[begin] + mix(key[ok].view(np.uint64) + np.uint64(j + 1)))
                        left = [rest[i][:p] + rest[i][q:] for i, p, q in zip(ok.tolist(), a[ok].tolist(), (a + many)[ok].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(new.view(np.int64)), pa.array(index[ok] & (shift == 0)), pa.array(h[ok]), pa.array(sign[ok]), pa.array(fewer[ok]), pa.array(left, pa.string())],
                            names=["key", "index", "h", "sign", "fewer", "rest"],
                        )

    return rows.mapInArrow(arrays.lean(emit), KEYED + ", fewer long, rest string")


def hot_pairs(lines: DataFrame, hot: DataFrame, edits: int) -> list[DataFrame]:
    """Tables of the pairs (a, b) that meet at hot keys, one for each level of cutting."""

    def beside(table: DataFrame, few: DataFrame) -> DataFrame:
        return table.join(F.broadcast(few) if few.count() <= BROADCAST_IDS else few, "key")

    placed = checkpointed(beside(keyed(lines, edits, places=True), hot))
    ids = checkpointed(placed.select("h").distinct())
    texts = lines.select("h", "line").join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "h", "left_semi").dropDuplicates(["h"])
    rest = F.concat(F.substr("line", F.lit(1), F.col("at").cast("int")), F.substr("line", (F.col("at") + F.col("many") + 1).cast("int")))
    rows = checkpointed(placed.join(texts, "h").select("key", "index", "h", "sign", "fewer", rest.alias("rest")))
    found = []
    while True:
        own = F.max(F.when(F.col("index"), F.length("rest"))).alias("chars")
        sizes = checkpointed(rows.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.count_if("index").alias("indexed"), own).where("indexed > 0 and rows > 1"))
        hot_now = (F.col("rows") * F.col("indexed") > MANY_PAIRS) & (F.col("chars") > edits)
        few = sizes.where(hot_now)
        found.append(met(beside(rows, sizes.where(~hot_now).select("key")), edits))
        if few.isEmpty():
            return found
        # Places are judged by some index rows of each key, taken by their hash; any cuts are right, good ones make fewer pairs.
        some = beside(rows.where("index"), few.select("key", "indexed")).where(F.pmod(F.xxhash64(F.lit(31), "h"), F.greatest(F.floor(F.col("indexed") / PROFILE_ROWS), F.lit(1))) == 0)

        def profile(table: pa.Table) -> pa.Table:
            return pa.table({"key": table.column("key").slice(0, 1), "ends": pa.array([cuts_by_variety(table.column("rest").to_pylist(), edits + 1)], pa.list_(pa.int32()))})

        cuts = checkpointed(some.select("key", "rest").groupBy("key").applyInArrow(profile, "key long, ends array<int>"))
        rows = checkpointed(split_again(beside(rows, cuts).select("key", "index", "h", "sign", "fewer", "rest", "ends"), edits))


def candidates(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (a, b) of hashes of different lines that may be within ``edits`` edits."""
    lines = lines.where(F.length("line") >= min_chars).select("h", "line")
    sampled = keyed(lines.where(F.pmod("h", F.lit(SAMPLE)) == 0).dropDuplicates(["h"]), edits).groupBy("key").count()
    hot = checkpointed(sampled.where(F.col("count") >= SAMPLED_ROWS).select("key"))
    rows, many = keyed(lines, edits), hot.count()
    if not many:
        return met(rows, edits).distinct()
    pairs = met(rows.join(F.broadcast(hot) if many <= BROADCAST_IDS else hot, "key", "left_anti"), edits)
    for more in hot_pairs(lines, hot, edits):
        pairs = pairs.unionByName(more)
    return pairs.distinct()


def edit_links(lines: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS) -> DataFrame:
    """Pairs (a, b) of hashes of all different lines within ``edits`` edits."""
    pairs = checkpointed(candidates(lines, edits, min_chars))
    ids = checkpointed(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    few = ids.count() <= BROADCAST_IDS
    texts = checkpointed(lines.select("h", "line").join(F.broadcast(ids) if few else ids, "h", "left_semi").dropDuplicates(["h"]))
    both = pairs.join(texts.select(F.col("h").alias("a"), F.col("line").alias("left")), "a").join(texts.select(F.col("h").alias("b"), F.col("line").alias("right")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = pa.array([within(x, y, edits) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["a", "b"])

    return both.select("a", "b", "left", "right").mapInArrow(arrays.lean(verify), "a long, b long")


def repeated_lines(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, line_no, first_doc_id, first_line_no and n_links of every line whose class has other lines or places.

    ``n_links`` counts the different lines within ``edits`` edits of this one.
    """
    lines = lines_of(docs, id_col, text_col)
    links = checkpointed(edit_links(lines, edits, min_chars))
    degree = links.select(F.col("a").alias("h")).unionAll(links.select(F.col("b").alias("h"))).groupBy("h").agg(F.count(F.lit(1)).alias("n_links"))
    place = F.struct("doc_id", "line_no")
    placed = checkpointed(lines.select("doc_id", "line_no", "h"))
    places = placed.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last"))
    # A line at one place without links is alone in its class and goes no further.
    shared = (
        places.join(components(links), F.col("h") == F.col("node"), "left")
        .join(degree, "h", "left")
        .where((F.col("first") != F.col("last")) | F.col("node").isNotNull())
        .select("h", "first", F.coalesce("component", "h").alias("component"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    shared = checkpointed(shared)
    firsts = shared.groupBy("component").agg(F.min("first").alias("first"))
    named = shared.select("h", "component", "n_links").join(firsts, "component")
    return placed.join(named, "h").select("doc_id", F.col("line_no").cast("long").alias("line_no"), F.col("first.doc_id").alias("first_doc_id"), F.col("first.line_no").cast("long").alias("first_line_no"), "n_links")


def decisions(repeated: DataFrame) -> DataFrame:
    """doc_id, dropped (line numbers), repeats_of (doc_id of each one's first line), n_links; a row for each document with shared lines."""
    drop = (F.col("doc_id") != F.col("first_doc_id")) | (F.col("line_no") != F.col("first_line_no"))
    rows = repeated.distinct().groupBy("doc_id").agg(
        F.sort_array(F.collect_list(F.when(drop, F.struct("line_no", "first_doc_id")))).alias("gone"), F.sum("n_links").alias("n_links")
    )
    return rows.select("doc_id", F.col("gone.line_no").alias("dropped"), F.col("gone.first_doc_id").alias("repeats_of"), "n_links")


def kept_text(text: Column, dropped: Column) -> Column:
    """``text`` without the lines of these numbers; null where nothing but white space is left and lines were dropped."""
    # The list of lines is bound once by a one-element transform, else it would be split again for each line.
    joined = F.get(
        F.transform(
            F.array(F.split(text, "\n")),
            lambda lines: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0).cast("long"), F.size(lines).cast("long") - 1), dropped), lambda i: F.get(lines, i.cast("int"))), "\n"),
        ),
        0,
    )
    return F.when(F.size(dropped) == 0, text).when(joined.rlike(r"\S"), joined)


def deduplicate(docs: DataFrame, edits: int = EDITS, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without repeated lines; documents of which no line is left go."""
    made = decisions(repeated_lines(docs, edits, min_chars, id_col, text_col)).where(F.size("dropped") > 0).select(F.col("doc_id").alias("__of"), F.col("dropped").alias("__dropped"))
    # The row travels as one column, so that no column of the documents clashes with a helper.
    joined = docs.select(F.struct(*docs.columns).alias("row")).join(made, F.col(f"row.`{id_col}`") == F.col("__of"), "left")
    text = F.when(F.col("__of").isNull(), F.col(f"row.`{text_col}`")).otherwise(kept_text(F.col(f"row.`{text_col}`").cast("string"), F.col("__dropped")))
    whole = joined.withColumn("__text", text).where(F.col("__of").isNull() | F.col("__text").isNotNull())
    return whole.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
