"""Defined results for nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib

import public_tokenizers
import pytest

from barline.llm import decontaminate, langid, line_dedup, lm_score, near_dup, packing, quality_classifier, quality_rules, secrets, toxicity
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 30_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, similarity double, class_id long, bucket string, band int, block long, line string, h long"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "en", None, 1, 0.5, 0.1, 7, "b", 1, 2, "l", 3) for i, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Null, empty, white, long, repeated and null-id rows, with columns named like those the operators make."""
    return table(spark, [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (5, "same text here\nagain"), (5, "same text here\nagain"), (None, "no id but some text"), (6, "Ünïcode ✓ — 漢字 🙂")]).cache()


def test_packing(spark, odd):
    path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.pack(packing.tokenize(odd, path)).collect()
    by = {}
    for r in made:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.doc_tokens for r in by[1]] == [1] and [r.doc_tokens for r in by[2]] == [1] and [r.doc_tokens for r in by[3]] == [1]
    assert len(by[5]) == 2 and sum(r.length for r in by[4]) == by[4][0].doc_tokens > 100_000
    assert packing.pack(packing.tokenize(odd.limit(0), path)).count() == 0


def test_packing_keeps_large_ids_and_spreads_rows_without_one(spark):
    path, big = public_tokenizers.path("word_bpe_49k.json"), 9007199254740993
    docs = spark.createDataFrame([(big + i, "some words") for i in range(4)] + [(None, "no id")] * 200, "doc_id long, text string")
    made = packing.pack(packing.tokenize(docs, path), group_pieces=40).collect()
    assert sorted(r.doc_id for r in made if r.doc_id is not None) == [big + i for i in range(4)] and len(made) == 204
    groups = {r.sequence_id >> 32 for r in made if r.doc_id is None}
    assert len(groups) == 6


def test_secrets(odd):
    rows = {r.doc_id: r for r in secrets.scan(odd).collect()}
    assert rows[1].spans == "" and rows[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.scan(odd).count() == 8 and secrets.scan(odd.limit(0)).count() == 0


def test_language(odd):
    models = langid.fit(odd)
    made = langid.identify(odd, models)
    rows = {r.doc_id: r for r in made.collect()}
    assert all(rows[i].lang_pred == "und" and not rows[i].accepted and rows[i].score == 0 for i in (1, 2, 3))
    assert made.count() == 8 and langid.identify(odd.limit(0), models).count() == 0
    assert langid.fit(odd.limit(0)) == {} and {r.lang_pred for r in langid.identify(odd, {}).collect()} == {"und"}


def test_quality_rules(odd):
    rows = {r.doc_id: r for r in quality_rules.judge(odd).collect()}
    assert all(rows[i].n_words == 0 and rows[i].base_failed and not rows[i].kept for i in (1, 2, 3))
    assert rows[4].n_repeat_words == rows[4].n_words == 150_000
    assert quality_rules.judge(odd.limit(0)).count() == 0


def test_classifiers(odd):
    assert {r.score for r in toxicity.score(odd, b"").collect()} == {0.0} and toxicity.score(odd.limit(0), b"").count() == 0
    assert {r.kept for r in quality_classifier.grade(odd, b"").collect()} == {True} and quality_classifier.grade(odd.limit(0), b"").count() == 0
    assert toxicity.fit(["a", "b"], [0, 0], [1, 1]) == b"" and toxicity.fit(["", ""], [0, 1], [1, 1]) == b""
    for labels in ([1, 1, 1, 1, 0], [0, 1], [0, 0, 0, 0, 1], [1] * 9 + [0], [0] * 5 + [1] * 5):
        made = toxicity.fit([f"word{i} other{i} text" for i in range(len(labels))], labels, [1.0] * len(labels))
        assert all(0 <= r.score <= 1 for r in toxicity.score(odd, made).collect())
    model = quality_classifier.fit(["a b", "c d", ""], [0, 2, 1], [1, 1, 1])
    rows = quality_classifier.grade(odd, model).collect()
    assert len(rows) == 8 and all(0 <= r.p_good <= 1 and 0 <= r.expected_grade <= 2 for r in rows)


def test_near_dup(odd):
    rows = near_dup.classes(odd).collect()
    assert len(rows) == 8
    by = {r.doc_id: r for r in rows}
    assert by[1].class_id == 1 and by[2].class_id == 2 and by[3].class_id == 3 and by[5].class_id == 5 and by[5].n_copies == 2
    assert near_dup.classes(odd.limit(0)).count() == 0


def test_line_dedup(spark, odd):
    kept = line_dedup.deduplicate(odd)
    assert kept.columns == odd.columns and kept.count() == 8
    assert line_dedup.deduplicate(odd.limit(0)).count() == 0
    docs = table(spark, [(1, "a line that is long enough\nshort\n\nshort"), (2, "a line that is long enougg\nonly here"), (3, "short"), (4, "shorx")])
    rows = {r.doc_id: r.text for r in line_dedup.deduplicate(docs).collect()}
    assert rows == {1: "a line that is long enough\nshort\n", 2: "only here", 4: "shorx"}
    odd_names = docs.withColumns({"__of": F.lit(1), "__dropped": F.lit("x"), "__text": F.lit(None).cast("string"), "row": F.lit(2), "first": F.lit(3)})
    made = line_dedup.deduplicate(odd_names)
    assert made.columns == odd_names.columns and {r.doc_id: r.text for r in made.collect()} == rows


def test_decontaminate(spark, odd):
    items = spark.createDataFrame([(1, "lorem ipsum dolor sit amet " * 4), (2, None), (3, ""), (4, "nowhere to be found in any of these texts at all")], "item_id long, text string")
    rows = decontaminate.matches(odd, items).collect()
    assert {(r.doc_id, r.item_id) for r in rows} == {(4, 1)}
    assert decontaminate.matches(odd.limit(0), items).count() == 0 and decontaminate.matches(odd, items.limit(0)).count() == 0


def test_lm_score(odd):
    never = F.lit(False)
    rows = lm_score.score(odd, never, F.col("doc_id") == 4).collect()
    assert len(rows) == 8 and all(r.n_tokens >= 1 for r in rows) and {r.n_tokens for r in rows if r.doc_id in (1, 2, 3)} == {1}
    assert lm_score.score(odd.limit(0), never, never).count() == 0
    untrained = lm_score.score(odd, F.lit(True), never).collect()
    assert {r.n_known for r in untrained} == {0} and all(r.train_tokens == 0 for r in untrained)
