"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source whose target is r times its size takes each document floor(r) times, and once
more with the remaining probability p. Independent draws would miss the target by the
spread of the sizes, so the draws depend on each other: of two documents with sizes a
and b, words move from one to the other until one probability is 0 or 1, in a random
direction such that neither probability changes in expectation. The sum of size times
probability stays what it was, so only the last document of a source, which has no
partner, moves the total.

Documents meet in random groups of about FAN, one fold over each; what a group leaves
over (one document at most) meets the rest of other groups, in a tree that ends with
one document for each source. Large documents are rounded first: the probability of
those of the next class of sizes is then set anew from the words still wanted, which
takes up what the last large document missed. In the end a source misses its target by
less than the size of a document of its smallest class.

All draws are hashes of source, id, size and the number among equal rows, so a mix does
not depend on how rows are dealt. Rows that agree in these are counted before the
shuffle and told apart by number afterwards; no source, id or row gathers in one task.

Defined cases: a null text has size 0 and is taken 0 times; null is a source of its own,
the last one; a null id is an id; equal rows are documents of their own; sources without
words have target 0; an empty table gives an empty result; only the three named columns
are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from barline.llm.lineage import checkpointed
from barline.llm.quality_rules import once

#: Weights of sources by code point, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: No source is taken more often than that.
MOST = 2
#: Documents in a group of the tree, about.
FAN = 256
#: Classes of sizes: the least size of all but the last.
CLASSES = (4096, 512, 64)
#: Equal rows in one piece.
CHUNK = 4096
#: Sources whose figures are broadcast; more are joined by a shuffle.
FEW_SOURCES = 100_000
_CERTAIN = 1e-9
SEED = 12


def sizes(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, size, n): words of whole texts, and the number of equal rows."""
    words = F.regexp_replace(F.col(text_col).cast("string"), r"[^\x20\x09-\x0D]++", "x")
    size = F.coalesce(F.length(F.translate(words, "\x20\x09\x0a\x0b\x0c\x0d", "")), F.lit(0)).cast("long")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"))
    return rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))


def numbered(sources: DataFrame) -> DataFrame:
    """Sources with their number ``s`` from 0 by code point, null last: places in sorted partitions and the partitions' sums."""
    place = F.monotonically_increasing_id()
    rows = checkpointed(sources.orderBy(F.col("source").asc_nulls_last()))
    rows = rows.withColumns({"part": F.shiftright(place, 33), "row": place.bitwiseAND(F.lit((1 << 33) - 1))})
    before, offsets = 0, []
    for r in rows.groupBy("part").count().orderBy("part").collect():  # one row for each partition
        offsets.append((r["part"], before))
        before += r["count"]
    starts = sources.sparkSession.createDataFrame(offsets, "part long, before long")
    return rows.join(F.broadcast(starts), "part").withColumn("s", F.col("before") + F.col("row")).drop("part", "row", "before")


def targets(sized: DataFrame) -> DataFrame:
    """(source, s, source_size, target, base, p): words of each source, its target, and copies of each document with the probability of one more.

    The level at which weights give the targets rises while sources reach their limit,
    and only sums over all sources leave the cluster.
    """
    found = numbered(sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")))
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.col("s") % len(WEIGHTS) + 1).cast("int"))
    found = checkpointed(found.withColumns({"weight": weight, "most": F.col("source_size") * MOST}))
    total = SHARE * (found.agg(F.sum("source_size")).first()[0] or 0)
    level, reached = 0.0, -1
    while True:
        full = F.lit(level) * F.col("weight") > F.col("most")
        row = found.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("most"))).alias("most"), F.sum(F.when(~full, F.col("weight"))).alias("weight")).first()
        if row["n"] == reached or not row["weight"]:
            break
        reached, level = row["n"], (total - (row["most"] or 0)) / row["weight"]
    target = F.least(F.lit(level) * F.col("weight"), F.col("most").cast("double"))
    copies = F.coalesce(F.try_divide(target, F.col("source_size")), F.lit(0.0))
    base = F.floor(copies + _CERTAIN)
    return found.select("source", "s", "source_size", target.alias("target"), base.alias("base"), F.greatest(copies - base, F.lit(0.0)).alias("p"))


def joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "s")


def draw(kind: int, level: int) -> Column:
    return F.xxhash64(F.lit(kind), F.lit(level), "h")


def uniform(x: Column) -> Column:
    return F.shiftrightunsigned(x, 11) * F.lit(2.0**-53)


_KEPT = ("h", "doc_id", "size", "p")


def rounded(rows: Column, kind: str) -> Column:
    """A fold over documents in order of ``at``: those whose number of copies is settled, and the one left over (null if none).

    Rows have at, u, h, doc_id (of type ``kind``), size (double) and p.
    """
    none = F.lit(None).cast(f"struct<h:bigint,doc_id:{kind},size:double,p:double>")
    empty = F.array().cast(f"array<struct<doc_id:{kind},size:double,copies:int>>")

    def settled(x: Column, p: Column) -> Column:
        return F.struct(x["doc_id"].alias("doc_id"), x["size"].alias("size"), F.round(p).cast("int").alias("copies"))

    def with_p(x: Column, p: Column) -> Column:
        return F.struct(*[(p if c == "p" else x[c]).alias(c) for c in _KEPT])

    def certain(p: Column) -> Column:
        return (p < _CERTAIN) | (p > 1 - _CERTAIN)

    def moved(a: Column, b: Column) -> Column:
        """The new probabilities of a and b."""
        to_a = F.least(a["size"] * (1 - a["p"]), b["size"] * b["p"])
        to_b = F.least(a["size"] * a["p"], b["size"] * (1 - b["p"]))
        gain = F.when(b["u"] * (to_a + to_b) < to_b, to_a).otherwise(-to_b)
        return once(gain, lambda g: F.struct((a["p"] + g / a["size"]).alias("a"), (b["p"] - g / b["size"]).alias("b")))

    def step(state: Column, x: Column) -> Column:
        left = state["left"]

        def result(p: Column) -> Column:
            done = F.concat(state["done"], F.when(certain(p["a"]), F.array(settled(left, p["a"]))).otherwise(empty), F.when(certain(p["b"]), F.array(settled(x, p["b"]))).otherwise(empty))
            rest = F.when(~certain(p["a"]), with_p(left, p["a"])).when(~certain(p["b"]), with_p(x, p["b"])).otherwise(none)
            return F.struct(done.alias("done"), rest.alias("left"))

        return F.when(left.isNull(), F.struct(state["done"].alias("done"), with_p(x, x["p"]).alias("left"))).otherwise(once(moved(left, x), result))

    return F.aggregate(F.sort_array(rows), F.struct(empty.alias("done"), none.alias("left")), step)


def pivotal(rows: DataFrame, count: int, phase: int) -> DataFrame:
    """(s, doc_id, size, copies) for (s, h, doc_id, size, p) with 0 < p < 1: rounded in a tree of groups, one document of each source by itself at the end."""
    kind = dict(rows.dtypes)["doc_id"]
    groups, level, found = count, 0, []
    while True:
        groups = max(1, -(-groups // FAN))
        held = F.struct(draw(1, 8 * level + phase).alias("at"), uniform(draw(2, 8 * level + phase)).alias("u"), *_KEPT)
        held = rows.select("s", F.pmod(draw(3, 8 * level + phase), F.lit(groups)).alias("g"), held.alias("x"))
        folded = checkpointed(held.groupBy("s", "g").agg(rounded(F.collect_list("x"), kind).alias("r")))
        found.append(folded.select("s", F.inline("r.done")))
        rows = folded.where("r.left IS NOT NULL").select("s", "r.left.*")
        if groups == 1:
            alone = (uniform(draw(4, phase)) < F.col("p")).cast("int")
            found.append(rows.select("s", "doc_id", "size", alone.alias("copies")))
            return reduce(DataFrame.unionByName, found)
        level += 1


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, size, source_size, target, copies, taken) for every row; taken is size times copies."""
    sized = checkpointed(sizes(docs, id_col, source_col, text_col))
    sources = checkpointed(targets(sized))
    few = sources.count() <= FEW_SOURCES
    named = F.broadcast(sources) if few else sources
    pieces = sized.alias("d").join(named.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("t.s", "d.source", "doc_id", "size", "n")
    pieces = pieces.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(CHUNK).cast("long"))).alias("k0"))
    pieces = pieces.repartition("s", "doc_id", "size", "k0")
    rows = pieces.select("s", "source", "doc_id", "size", F.explode(F.sequence(F.col("k0"), F.least(F.col("k0") + CHUNK, F.col("n")) - 1)).alias("k"))
    phase = reduce(Column.__add__, [(F.col("size") < c).cast("int") for c in CLASSES])
    rows = checkpointed(rows.select("s", F.xxhash64(F.lit(SEED), "source", "doc_id", "size", "k").alias("h"), "doc_id", F.col("size").cast("double").alias("size"), phase.alias("phase")))
    # Words that are still wanted beyond ``base`` copies of each document, and words of documents that are still open.
    state = checkpointed(sources.select("s", "source_size", (F.col("p") * F.col("source_size")).alias("want"), F.col("source_size").cast("double").alias("open")))
    found = [rows.where("size = 0").select("s", "doc_id", "size", F.lit(0).alias("copies"))]
    for k in range(len(CLASSES) + 1):
        chance = F.least(F.greatest(F.coalesce(F.try_divide(F.col("want"), F.col("open")), F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
        own = joined(rows.where((F.col("phase") == k) & (F.col("size") > 0)), state.select("s", chance.alias("p")), few)
        own = checkpointed(own.select("s", "h", "doc_id", "size", "p"))
        certain = (F.col("p") < _CERTAIN) | (F.col("p") > 1 - _CERTAIN)
        made = own.where(certain).select("s", "doc_id", "size", F.round("p").cast("int").alias("copies"))
        drawn = own.where(~certain)
        count = drawn.count()
        made = made.unionByName(pivotal(drawn, count, k)) if count else made
        found.append(made)
        sums = made.groupBy("s").agg(F.sum(F.col("size") * F.col("copies")).alias("got"), F.sum("size").alias("closed"))
        state = state.join(sums, "s", "left").select("s", "source_size", (F.col("want") - F.coalesce("got", F.lit(0.0))).alias("want"), (F.col("open") - F.coalesce("closed", F.lit(0.0))).alias("open"))
        state = checkpointed(state)
    every = reduce(DataFrame.unionByName, found)
    size, copies = F.col("size").cast("long"), F.when(F.col("size") > 0, F.col("base") + F.col("copies")).otherwise(F.lit(0)).cast("long")
    every = joined(every, sources.select("s", "source_size", "target", "base"), few)
    return every.select("doc_id", size.alias("size"), "source_size", "target", copies.alias("copies"), (size * copies).alias("taken"))
