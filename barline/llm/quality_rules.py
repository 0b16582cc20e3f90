"""Quality rules as weak supervision, in DataFrame functions only.

Every rule votes good (1), bad (-1) or abstains (0) on a document. Nobody says
which rules are right: expectation-maximisation over the counts of vote patterns
estimates how often each rule votes what on good and on bad documents, and the
share of good ones. The posterior probability of "good" replaces all-must-pass
filtering. A pattern is a row however many documents share it, so an iteration
reads at most 3 ** rules rows.

Defined cases: a null text is an empty one, has no words and fails the base; an
empty table gives an empty result; repeated rows each count and each get a result;
columns beyond the two named ones are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from barline.llm.lineage import checkpointed

# Fixed: what lies between words, what a line with a word has, and the characters that count as symbols.
SPACE = r"[\x20\x09-\x0D]+"
NO_SPACE = r"[^\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]+"
#: Documents that the base fails: fewer words, or a larger share (in percent) in repeated 3-word windows.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

ITERATIONS = 12
#: Added to every count of the maximisation step.
SMOOTHING = 1.0


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once: a one-element transform binds it."""
    return F.get(F.transform(F.array(value), use), 0)


def repeated_words(hashes: Column, n: int = 3) -> Column:
    """How many words lie in n-word windows that occur twice or more, from the words' 64-bit hashes.

    Most texts repeat no window, which a set of the windows' hashes shows. In the
    others, sorting pairs of hash and position brings equal windows together.
    """

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - n), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(n)]))

    def covered(places: Column) -> Column:
        gaps = F.transform(places, lambda p, i: F.least(F.lit(n), F.coalesce(F.get(places, i + 1) - p, F.lit(n))).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    def in_twins(grams: Column) -> Column:
        placed = F.sort_array(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

        def twins(rows: Column) -> Column:
            same = F.filter(rows, lambda x, i: F.coalesce(x["g"] == F.get(rows, i + 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get(rows, i - 1)["g"], F.lit(False)))
            return F.sort_array(F.transform(same, lambda x: x["i"]))

        return once(once(placed, twins), covered)

    none = F.lit(0).cast("long")
    count = once(hashes, lambda h: F.when(F.size(h) < n, none).otherwise(once(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), none).otherwise(in_twins(g)))))
    return count


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the figures that rules look at, for every whole text."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    worded = base.select("doc_id", "text", F.array_remove(F.split("text", SPACE), "").alias("words"))
    size = F.length("text")

    def lines(found: Column) -> Column:
        return F.struct(F.size(found).cast("long").alias("n"), (F.size(found) - F.size(F.array_distinct(found))).cast("long").alias("again"))

    made = worded.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        (size - F.length(F.regexp_replace("text", SYMBOL, ""))).cast("long").alias("n_symbols"),
        once(F.filter(F.split("text", "\n"), lambda x: x.rlike(NO_SPACE)), lines).alias("lines"),
        repeated_words(F.transform("words", lambda w: F.xxhash64(w))).alias("n_repeat_words"),
        (size - F.length(F.regexp_replace("text", r"\p{L}+", ""))).cast("long").alias("n_letters"),
        F.length(F.regexp_replace("text", r"\P{Lu}+", "")).cast("long").alias("n_capitals"),
    )
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", F.col("lines.again").alias("n_dup_lines"), "n_repeat_words", F.col("lines.n").alias("n_lines"), "n_letters", "n_capitals")


def _vote(value: Column, good: Column, bad: Column) -> Column:
    return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")


def rules() -> dict[str, Column]:
    """Votes: 1 good, -1 bad, 0 abstains."""
    words = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    chars = F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    length = F.col("word_chars") / words
    symbols = F.col("n_symbols") / words
    share = F.col("n_symbols") / chars
    repeats = F.col("n_repeat_words") / words
    twice = F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")
    letters = F.col("n_letters") / chars
    capitals = F.col("n_capitals") / F.greatest(F.col("n_letters"), F.lit(1)).cast("double")
    return {
        "enough_words": _vote(words, F.col("n_words") >= 100, F.col("n_words") < LEAST_WORDS),
        "word_length": _vote(length, length.between(3, 10), ~length.between(2.5, 14)),
        "few_symbols": _vote(symbols, symbols < 0.02, symbols > 0.1),
        "low_symbol_share": _vote(share, share < 0.003, share > 0.01),
        "few_repeats": _vote(repeats, repeats < 0.15, repeats > 0.4),
        "few_repeated_lines": _vote(twice, twice < 0.05, twice > 0.5),
        "mostly_letters": _vote(letters, letters > 0.8, letters < 0.6),
        "few_capitals": _vote(capitals, capitals < 0.15, capitals > 0.4),
    }


class LabelModel:
    """Rates of each rule's votes on good and bad documents, and the share of good ones."""

    def __init__(self, names: list[str]):
        self.names = names
        self.prior = 0.8
        #: names -> vote -> (rate on good, rate on bad). At the start a bad vote is rare on good documents, while
        #: a bad document may well please most rules.
        self.rates = {n: {1: (0.85, 0.55), 0: (0.14, 0.2), -1: (0.01, 0.25)} for n in names}

    def posterior(self, votes: Column) -> Column:
        """The chance of "good", from the votes of all rules as an array."""
        logs = [math.log(self.rates[n][vote][0] / self.rates[n][vote][1]) for n in self.names for vote in (-1, 0, 1)]
        table = F.lit(logs)
        odds = F.aggregate(F.transform(votes, lambda v, i: F.get(table, 3 * i + v + 1)), F.lit(math.log(self.prior / (1 - self.prior))), lambda a, x: a + x)
        return 1.0 / (1.0 + F.exp(-odds))

    def votes(self) -> Column:
        return F.array(*[F.col(n).cast("int") for n in self.names])

    def fit(self, patterns: DataFrame, iterations: int = ITERATIONS) -> LabelModel:
        """Expectation-maximisation over rows of votes and ``weight``, each iteration one aggregation by rule and vote."""
        rows = patterns.select(self.votes().alias("votes"), "weight")
        good, bad = F.sum(F.col("weight") * F.col("p")).alias("good"), F.sum(F.col("weight") * (1 - F.col("p"))).alias("bad")
        for _ in range(iterations):
            scored = rows.withColumn("p", self.posterior(F.col("votes"))).select("weight", "p", F.posexplode("votes").alias("rule", "vote"))
            found = {(r["rule"], r["vote"]): (r["good"], r["bad"]) for r in scored.groupBy("rule", "vote").agg(good, bad).collect()}
            if not found:
                return self
            totals = [sum(found.get((0, vote), (0.0, 0.0))[side] for vote in (1, 0, -1)) for side in (0, 1)]
            self.prior = (totals[0] + SMOOTHING) / (totals[0] + totals[1] + 2 * SMOOTHING)
            for i, n in enumerate(self.names):
                self.rates[n] = {vote: tuple((found.get((i, vote), (0.0, 0.0))[side] + SMOOTHING) / (totals[side] + 3 * SMOOTHING) for side in (0, 1)) for vote in (1, 0, -1)}
        return self


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Measures, base verdict, p_good and kept for every document."""
    votes = rules()
    names = list(votes)
    seen = checkpointed(measures(docs, id_col, text_col).withColumns(votes))
    # Counted in parallel; only then do the rows, 3 ** rules at most, go into one partition for the iterations.
    patterns = checkpointed(seen.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("weight")))
    model = LabelModel(names).fit(patterns.coalesce(1))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    return (
        seen.withColumn("p_good", model.posterior(model.votes()))
        .withColumn("base_failed", failed)
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
    )
