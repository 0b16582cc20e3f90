"""Near-duplicate documents by BagMinHash over multisets of five-word shingles.

A shingle that occurs w times in a text has weight w. The weight axis is cut into
levels [0,1), [1,2), [2,4), [4,8), ..; each level of each shingle runs one Poisson
process whose rate is the length of the level, so a heavy shingle needs a
logarithmic number of processes. A point has a time, a place on the weight axis
and a signature slot; points whose place lies below the weight count, and a slot
keeps its earliest time. Two texts agree in a slot with a probability equal to
their weighted Jaccard similarity. Processes stop at the time by which all slots
are filled, so a long text costs little more than a short one.

Signatures are banded. Links within a bucket are verified exactly on the multisets.
Buckets are not expanded to all pairs: every member is first linked with one
centre, then classes are formed, and only members of different classes are compared
further: by pairs of rows in small buckets; in large ones, members that share too few
shingles with other classes to be linked with one are left out, and all others outside
the largest class are held against all others, in blocks of texts of which only the
links that join classes come back. No bucket keeps an unchecked pair of different
classes, and no candidate is capped.

Defined cases: texts with the same words are copies whatever the white space; a
text of one to four words has one shingle of all its words; null, empty and
wordless texts are alone in their class; a class is named by its least doc_id; a
row without doc_id follows its text; repeated rows get the same class; an empty
table gives an empty result; only the two named columns are read. An id names one
text: where different texts share an id, give a key of the rows as ``id_col``.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from barline.llm import arrays
from barline.llm.arrays import Words, mix, ragged
from barline.llm.components import components
from barline.llm.lineage import checkpointed, release

SHINGLE = 5
SIMILARITY = 0.8
SLOTS = 128
BANDS = 32
#: Ids that may be broadcast; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Buckets with more members of several classes are compared in blocks of texts instead of by pairs of rows.
HOT = 48
BLOCK = 200
CHUNK_BYTES = 1 << 20
#: Texts of a group of large buckets whose shingles are counted in one place, about.
GROUP_PART = 512
#: Pairs of one text that meet it in one place.
MEMBERS = 64
#: Of 128 one-bit slots, so many differ at most between texts of similarity 0.8 (four standard deviations).
MOST_BITS_APART = 27


def shingles(words: Words, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, hash and number of each distinct shingle, ordered by row and hash."""
    per_row = words.per_row
    count = np.where(per_row >= n, per_row - n + 1, (per_row > 0).astype(np.int64))
    row = np.repeat(np.arange(len(per_row)), count)
    hashed = np.zeros(len(row), np.uint64)
    long = per_row[row] >= n
    grams = arrays.ngrams(words.hashes, n)
    at = ragged(words.row_at[:-1], count)
    hashed[long] = grams[at[long]]
    for i in np.flatnonzero((per_row > 0) & (per_row < n)):
        hashed[np.searchsorted(row, i)] = arrays.ngrams(words.hashes[words.row_at[i] : words.row_at[i + 1]], int(per_row[i]))[0]
    by = np.lexsort((hashed, row))
    row, hashed = row[by], hashed[by]
    first = np.ones(len(row), bool)
    first[1:] = (hashed[1:] != hashed[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(first)
    return row[at], hashed[at], np.diff(np.append(at, len(row)))


def bag_minhash(row: np.ndarray, key: np.ndarray, weight: np.ndarray, rows: int, slots: int = SLOTS) -> np.ndarray:
    """Earliest point of every slot of every row, as a 64-bit hash; 0 in rows without elements."""
    levels = 1 + np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64)
    element = np.repeat(np.arange(len(row)), levels)
    level = ragged(np.zeros(len(row), np.int64), levels)
    rate = np.where(level == 0, 1.0, np.exp2(level - 1.0))
    start = np.where(level == 0, 0.0, rate)
    owner = row[element]
    below = weight[element].astype(np.float64)
    state = mix(key[element] + level.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
    unit = 2.0**-53

    def next_gap(state: np.ndarray, rate: np.ndarray) -> np.ndarray:
        return -np.log1p(-((state >> np.uint64(11)) * unit)) / rate

    time = next_gap(state, rate)
    mass = np.bincount(row, weight, rows)
    until = (np.log(slots) + 3) * slots / np.maximum(mass, 1)
    earliest = np.full(rows * slots, np.inf)
    there = np.flatnonzero(mass > 0)
    while True:
        live = np.flatnonzero(time <= until[owner])
        t, s, who, r, b, z = time[live], state[live], owner[live], rate[live], below[live], start[live]
        while len(t):
            point = mix(s + np.uint64(1))
            place = z + np.floor((point >> np.uint64(32)) * 2.0**-32 * r)
            hit = place < b
            np.minimum.at(earliest, who[hit] * slots + (point[hit] & np.uint64(0xFFFFFFFF)).astype(np.int64) % slots, t[hit])
            s = mix(point + np.uint64(0x9E3779B97F4A7C15))
            t = t + next_gap(s, r)
            time[live], state[live] = t, s
            on = t <= until[who]
            live, t, s, who, r, b, z = live[on], t[on], s[on], who[on], r[on], b[on], z[on]
        short = there[~np.isfinite(earliest.reshape(rows, slots)[there]).all(axis=1)]
        if not len(short):
            break
        until[short] *= 2
    earliest[~np.isfinite(earliest)] = 0
    return mix(earliest.view(np.uint64)).reshape(rows, slots)


def band_hashes(signature: np.ndarray, bands: int = BANDS) -> np.ndarray:
    per = signature.shape[1] // bands
    total = np.zeros((len(signature), bands), np.uint64)
    for i in range(per):
        total += signature[:, i::per][:, :bands] * np.uint64(pow(arrays._BASE, 2 * i + 1, 1 << 64))
    return mix(total + np.arange(bands, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """doc_id, copy (128 bits of the word sequence as two longs; null without words), bits (two longs) and bands of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, words in arrays.words_in_chunks(batch.column(1), limit=CHUNK_BYTES):
                signature = bag_minhash(*shingles(words, n), last - first)
                bits = np.packbits((signature & np.uint64(1)).astype(bool), axis=1).view(np.int64)
                raw = [words.hashes[a:b].tobytes() for a, b in zip(words.row_at[:-1], words.row_at[1:])]
                digest = np.frombuffer(b"".join(hashlib.blake2b(x, digest_size=16).digest() for x in raw), np.int64).reshape(-1, 2)
                none = words.per_row == 0
                columns = [batch.column(0).slice(first, last - first), pa.array(digest[:, 0], mask=none), pa.array(digest[:, 1], mask=none), pa.array(bits[:, 0]), pa.array(bits[:, 1])]
                bands = band_hashes(signature).view(np.int64)
                columns.append(pa.ListArray.from_arrays(np.arange(0, bands.size + 1, bands.shape[1], dtype=np.int32), pa.array(bands.ravel())))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "copy1", "copy2", "bits1", "bits2", "bands"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(arrays.lean(run), "doc_id long, copy1 long, copy2 long, bits1 long, bits2 long, bands array<long>")


def weighted_jaccard(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> float:
    """Of two multisets given as sorted distinct hashes and their numbers."""
    both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    shared = int(np.minimum(na[i], nb[j]).sum())
    return shared / max(int(na.sum() + nb.sum()) - shared, 1)


def texts_of(ids: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text) of the rows with these ids, one for each; ids are broadcast to the scan up to BROADCAST_IDS of them and joined by a shuffle beyond."""
    few = ids.count() <= BROADCAST_IDS
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return texts.join(F.broadcast(ids) if few else ids, "id", "left_semi").dropDuplicates(["id"])


def verified(pairs: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """Those pairs (a, b) of ids whose whole texts have at least ``similarity``, with it as column ``similarity``.

    Texts of candidate documents alone are moved. A text ``a`` of many pairs is sent
    once for each MEMBERS of them, so no key of the join holds more.
    """
    ids = checkpointed(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
    texts = texts_of(ids, docs, id_col, text_col)
    crowded = checkpointed(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).cast("int").alias("parts")).where("parts > 1"))
    crowded = F.broadcast(crowded) if crowded.count() <= BROADCAST_IDS else crowded
    parts = F.coalesce("parts", F.lit(1))
    left = pairs.select("a").distinct().join(crowded, "a", "left").select("a", parts.alias("parts"))
    left = texts.join(left, F.col("id") == F.col("a")).select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("text").alias("left"))
    placed = pairs.join(crowded, "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
    both = placed.join(texts.select(F.col("id").alias("b"), F.col("text").alias("right")), "b").join(left, ["a", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(arrays.utf8(batch.column(2))[1]) + np.diff(arrays.utf8(batch.column(3))[1])
            for first, last in arrays.chunks(np.concatenate([[0], np.cumsum(size)])):
                part = batch.slice(first, last - first)
                sides = []
                for k in (2, 3):
                    row, key, number = shingles(Words(*arrays.utf8(part.column(k))), n)
                    sides.append((key, number, np.searchsorted(row, np.arange(len(part) + 1))))
                found = np.zeros(len(part))
                for i in range(len(part)):
                    (a, na, at), (b, nb, to) = sides
                    found[i] = weighted_jaccard(a[at[i] : at[i + 1]], na[at[i] : at[i + 1]], b[to[i] : to[i + 1]], nb[to[i] : to[i + 1]])
                keep = pa.array(found >= similarity)
                yield pa.RecordBatch.from_arrays([part.column(0).filter(keep), part.column(1).filter(keep), pa.array(found).filter(keep)], names=["a", "b", "similarity"])

    return both.select("a", "b", "left", "right").mapInArrow(arrays.lean(run), "a long, b long, similarity double")


def close(pairs: DataFrame, copies: DataFrame) -> DataFrame:
    """Those pairs (a, b) whose one-bit slots differ in MOST_BITS_APART places at most."""
    for side in ("a", "b"):
        pairs = pairs.join(copies.select(F.col("id").alias(side), F.array("bits1", "bits2").alias(f"{side}_bits")), side)
    apart = reduce(Column.__add__, [F.bit_count(F.col("a_bits")[i].bitwiseXOR(F.col("b_bits")[i])) for i in range(2)])
    return pairs.where(apart <= MOST_BITS_APART).select("a", "b")


def similar(left: Words, right: Words, n: int = SHINGLE) -> np.ndarray:
    """Weighted Jaccard similarity of every text of one block with every text of another."""
    sides = [shingles(words, n) for words in (left, right)]
    sizes = [len(words.row_at) - 1 for words in (left, right)]
    mass = [np.bincount(row, number, size) for (row, _, number), size in zip(sides, sizes)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    shared = np.zeros(sizes)
    for first in range(0, len(both), 4096):
        part = both[first : first + 4096]
        dense = []
        for (row, key, number), size in zip(sides, sizes):
            at = np.minimum(np.searchsorted(part, key), len(part) - 1)
            hit = part[at] == key
            counts = np.zeros((size, len(part)), np.int32)
            counts[row[hit], at[hit]] = number[hit]
            dense.append(counts)
        for level in range(1, int(min(dense[0].max(), dense[1].max())) + 1):
            columns = (dense[0] >= level).any(axis=0) & (dense[1] >= level).any(axis=0)
            shared += (dense[0][:, columns] >= level).astype(np.float32) @ (dense[1][:, columns] >= level).astype(np.float32).T
    return shared / np.maximum(mass[0][:, None] + mass[1][None, :] - shared, 1)


def joining(a: np.ndarray, b: np.ndarray, class_a: np.ndarray, class_b: np.ndarray) -> list[int]:
    """Those of the links (a, b) that join classes not joined by earlier ones."""
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            parent[c] = parent.get(parent[c], parent[c])
            c = parent[c]
        return c

    kept = []
    for i, (c, d) in enumerate(zip(class_a.tolist(), class_b.tolist())):
        c, d = root(c), root(d)
        if c != d:
            parent[max(c, d)] = min(c, d)
            kept.append(i)
    return kept


def shared_across(keys: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether the key of each place belongs to two or more values of ``of``."""
    found, name = np.unique(keys, return_inverse=True)
    low, high = np.full(len(found), np.iinfo(np.int64).max), np.full(len(found), np.iinfo(np.int64).min)
    np.minimum.at(low, name, of)
    np.maximum.at(high, name, of)
    return (low < high)[name]


def with_partners(placed: DataFrame, docs: DataFrame, similarity: float, id_col: str, text_col: str, n: int = SHINGLE) -> DataFrame:
    """Those rows (id, class, group) that can have a partner of at least ``similarity`` in another class of their group.

    A text of m shingles, r of them also in another class, shares r with a partner at
    most, and at least s / (1 + s) of the shingles of both. So the partner has at most
    r (1 + s) / s - m of them, and s m at least; where the group has no text of such a
    length (to a hundredth), the row goes. Texts made from one template that differ in
    words of their own go so by one count of shingles, without comparisons. What goes
    takes shingles along, so the count is repeated while it takes a fifth or more.
    """
    many = placed.count()
    while many:
        sizes = placed.groupBy("group").agg(F.ceil(F.count(F.lit(1)) / GROUP_PART).cast("int").alias("parts"))
        sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_IDS else sizes
        texts = texts_of(placed.select("id").distinct(), docs, id_col, text_col)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for first, last, words in arrays.words_in_chunks(batch.column(4), limit=CHUNK_BYTES):
                    row, key, number = shingles(words, n)
                    part = ((key >> np.uint64(8)) % batch.column(3).slice(first, last - first).to_numpy()[row].astype(np.uint64)).astype(np.int64)
                    by = np.lexsort((part, row))
                    row, key, number, part = row[by], key[by], number[by], part[by]
                    new = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (part[1:] != part[:-1]))) if len(row) else row
                    ends = np.append(new, len(row)).astype(np.int32)
                    own = [batch.column(i).take(pa.array(first + row[new])) for i in range(3)]
                    lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (key.view(np.int64), number.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(part[new]), *lists], names=["group", "class", "id", "part", "keys", "numbers"])

        def count(table: pa.Table) -> pa.Table:
            lists = table.column("keys").combine_chunks()
            size = lists.value_lengths().to_numpy()
            numbers = table.column("numbers").combine_chunks().flatten().to_numpy()
            both = shared_across(lists.flatten().to_numpy(), np.repeat(table.column("class").to_numpy(), size))
            row = np.repeat(np.arange(len(size)), size)
            return pa.table({"group": table.column("group"), "id": table.column("id"), "shared": pa.array(np.bincount(row, numbers * both, len(size))), "mass": pa.array(np.bincount(row, numbers, len(size)))})

        rows = placed.join(sizes, "group").join(texts, "id").select("group", "class", "id", "parts", "text")
        rows = rows.mapInArrow(arrays.lean(emit), "group long, class long, id long, part long, keys array<long>, numbers array<int>")
        counted = rows.groupBy("group", "part").applyInArrow(arrays.lean_group(count), "group long, id long, shared double, mass double")
        counted = checkpointed(counted.groupBy("group", "id").agg(F.sum("shared").alias("shared"), F.sum("mass").alias("mass")))
        longest = F.col("shared") * ((1 + similarity) / similarity) - F.col("mass") + 1e-6

        def step(mass: Column) -> Column:
            return F.floor(F.log(mass) / math.log(1.01))

        alike = counted.where(longest >= F.col("mass")).select("id")
        shorter = counted.where((longest < F.col("mass")) & (longest >= similarity * F.col("mass"))).select("group", "id", F.explode(F.sequence(step(similarity * F.col("mass")), step(longest))).alias("step"))
        able = alike.unionByName(shorter.join(counted.select("group", step(F.col("mass")).alias("step")).distinct(), ["group", "step"]).select("id").distinct())
        placed = checkpointed(placed.join(able, "id"))
        left = placed.count()
        release(docs.sparkSession)
        if left > 0.8 * many:
            break
        many = left
    return placed


def block_links(members: DataFrame, docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (a, b) of at least ``similarity`` that join the classes of members of large buckets.

    Buckets that share members are one group, so that a pair is compared once. Of a
    group, members that can have a partner in another class are left (``with_partners``),
    and every one of them outside its largest class is held against every one, in blocks
    of about BLOCK texts a side.
    """
    members = checkpointed(members.select("id", "component", "centre"))
    groups = components(members.where(F.col("id") != F.col("centre")).select(F.col("id").alias("a"), F.col("centre").alias("b")))
    placed = members.select("id", F.col("component").alias("class")).distinct()
    placed = checkpointed(placed.join(groups.select(F.col("node").alias("id"), F.col("component").alias("group")), "id"))
    placed = with_partners(placed, docs, similarity, id_col, text_col)
    counted = placed.groupBy("group", "class").agg(F.count(F.lit(1)).alias("n"))
    largest = counted.groupBy("group").agg(F.max_by("class", "n").alias("main"), F.max("n").alias("most"), F.sum("n").alias("all"))
    largest = largest.select("group", "main", F.ceil((F.col("all") - F.col("most")) / BLOCK).cast("int").alias("lefts"), F.ceil(F.col("all") / BLOCK).cast("int").alias("rights"))
    placed = checkpointed(placed.join(largest, "group"))

    def place(count: str) -> Column:
        return F.pmod(F.xxhash64(F.lit(23), "id"), F.col(count)).cast("int")

    def every(count: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    sides = [
        placed.where(F.col("class") != F.col("main")).select("group", place("lefts").alias("left"), every("rights").alias("right"), F.lit(True).alias("side"), "id", "class"),
        placed.where("lefts > 0").select("group", every("lefts").alias("left"), place("rights").alias("right"), F.lit(False).alias("side"), "id", "class"),
    ]
    texts = texts_of(checkpointed(placed.select("id").distinct()), docs, id_col, text_col)

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        parts = [table.filter(pa.array(side)), table.filter(pa.array(~side))]
        id_a, id_b = (p.column("id").to_numpy() for p in parts)
        class_a, class_b = (p.column("class").to_numpy() for p in parts)
        value = similar(*(Words(*arrays.utf8(p.column("text"))) for p in parts))
        i, j = np.nonzero((value >= similarity) & (class_a[:, None] != class_b[None, :]))
        kept = joining(id_a[i], id_b[j], class_a[i], class_b[j])
        return pa.table({"a": pa.array(id_a[i[kept]]), "b": pa.array(id_b[j[kept]])})

    rows = sides[0].unionByName(sides[1]).join(texts, "id")
    return checkpointed(rows.groupBy("group", "left", "right").applyInArrow(arrays.lean_group(compare), "a long, b long"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, class_id, n_copies) for every row: class_id is the least doc_id of all texts linked with it."""
    seen = checkpointed(sketches(docs, id_col, text_col))
    worded = seen.where(F.col("copy1").isNotNull())
    # One row for each distinct text; a group of copies is reduced before the shuffle.
    copies = checkpointed(
        worded.groupBy("copy1", "copy2").agg(
            F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n_copies"), F.first("bits1").alias("bits1"), F.first("bits2").alias("bits2"), F.first("bands").alias("bands")
        )
    )
    members = copies.where(F.col("id").isNotNull()).select("id", F.explode("bands").alias("bucket"))  # the hash of a band holds its number
    centre = members.groupBy("bucket").agg(F.min("id").alias("centre"), F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = checkpointed(members.join(centre, "bucket"))
    release(docs.sparkSession)
    first = checkpointed(close(crowded.where("id != centre").select(F.col("centre").alias("a"), F.col("id").alias("b")).distinct(), copies))
    links = checkpointed(verified(first, docs, similarity, id_col, text_col).select("a", "b"))
    release(docs.sparkSession)
    # Members of one bucket that are not in one class yet are compared with each other.
    labelled = crowded.join(components(links), crowded["id"] == F.col("node"), "left").select("bucket", "id", "centre", "n", F.coalesce("component", "id").alias("component"))
    split = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low != high")
    open_rows = checkpointed(labelled.join(split.select("bucket"), "bucket", "left_semi"))
    del crowded, labelled, split
    release(docs.sparkSession)
    cool = open_rows.where(F.col("n") <= HOT)
    x, y = cool.alias("x"), cool.alias("y")
    more = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component")))
    more = close(more.select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct().join(first, ["a", "b"], "left_anti"), copies)
    more = checkpointed(verified(checkpointed(more), docs, similarity, id_col, text_col).select("a", "b"))
    del first, cool, x, y
    release(docs.sparkSession)
    more = more.unionByName(block_links(open_rows.where(F.col("n") > HOT), docs, similarity, id_col, text_col))
    del open_rows
    found = components(links.unionByName(more))
    named = copies.select("copy1", "copy2", "id", "n_copies").join(found, copies["id"] == found["node"], "left").select("copy1", "copy2", F.coalesce("component", "id").alias("class_id"), "n_copies")
    with_words = worded.select("doc_id", "copy1", "copy2").join(named, ["copy1", "copy2"]).select("doc_id", "class_id", "n_copies")
    return with_words.unionByName(seen.where(F.col("copy1").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long").alias("n_copies")))
