"""Held-out accuracy of the classifiers on small labelled tables."""

import math
import pickle
import random
import re

import numpy as np
import pytest

from barline.llm import labelled, quality_classifier, toxicity

WORDS = [a + b + c for a in ("ba", "do", "ki", "lu") for b in ("ran", "les", "mi", "tu") for c in ("", "st", "ne", "ring")]


def table(spark, n, make, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        words = [rng.choice(WORDS) for _ in range(rng.randint(20, 80))]
        label = rng.randrange(3)
        rows.append((i, " ".join(make(rng, words, label)), label))
    return spark.createDataFrame(rows, "doc_id long, text string, label int")


def test_unseen_misspellings_are_toxic(spark):
    known, unseen = ["vexgrump", "vexgrumpy", "vexgrumps", "zilchwad", "zilchwads"], ["vexgrumpp", "xvexgrump", "zilchwadd"]

    def with_words(which):
        def make(rng, words, label):
            for _ in range(2 * (label == 2)):
                words[rng.randrange(len(words))] = rng.choice(which)
            return words

        return make

    train = table(spark, 500, with_words(known), 1)
    model = labelled.fitted(labelled.sample(train.select("doc_id", "text"), train.selectExpr("doc_id", "int(label = 2) as label"), "label"), toxicity.fit)
    test = table(spark, 150, with_words(unseen), 2)
    rows = toxicity.score(test, model).join(test.select("doc_id", "label"), "doc_id").collect()
    assert sum(r.predicted == (r.label == 2) for r in rows) / len(rows) > 0.95


def test_grades_are_ordered(spark):
    def make(rng, words, label):
        return [w.upper() + "!!" if rng.random() < (0.8, 0.3, 0.0)[label] else w for w in words]

    train, test = table(spark, 400, make, 3), table(spark, 150, make, 4)
    model = labelled.fitted(labelled.sample(train.select("doc_id", "text"), train.select("doc_id", "label"), "label"), quality_classifier.fit)
    rows = quality_classifier.grade(test, model).join(test.select("doc_id", "label"), "doc_id").collect()
    means = [sum(r.expected_grade for r in rows if r.label == k) / max(1, sum(r.label == k for r in rows)) for k in range(3)]
    assert means[0] + 0.5 < means[1] < means[2] - 0.5
    assert sum(r.kept == (r.label >= 1) for r in rows) / len(rows) > 0.9


def test_sample_is_bounded(spark):
    docs = spark.range(4000).selectExpr("id as doc_id", "concat('w', id) as text")
    picked = labelled.sample(docs, docs.selectExpr("doc_id", "int(doc_id % 2) as label"), "label", rows=100)
    assert picked.count() == pytest.approx(200, abs=60)


def test_sample_thins_long_and_short_texts_alike(spark, monkeypatch):
    monkeypatch.setattr(labelled, "SAMPLE_CHARS", 40_000)
    monkeypatch.setattr(labelled, "LEAST_ROWS", 5)
    docs = spark.range(400).selectExpr("id as doc_id", "repeat('word ', int(if(id % 2 = 0, 100, 20))) as text")
    rows = labelled.sample(docs, docs.selectExpr("doc_id", "1 as label"), "label", rows=10_000).collect()
    sizes = [len(r.text) for r in rows]
    assert 20_000 < sum(sizes) < 60_000 and 0.35 < sum(n > 200 for n in sizes) / len(sizes) < 0.65
    assert sum(r.weight for r in rows) == pytest.approx(400, rel=0.25)


def test_toxicity_scores_against_plain_loops(spark):
    rng = random.Random(5)
    labels = [i % 3 == 0 for i in range(90)]
    texts = [" ".join([rng.choice(WORDS) for _ in range(rng.randint(0, 40))] + ["Vexgrump!"] * (2 * y)) for y in labels]
    model = toxicity.fit(texts, [int(y) for y in labels], [1.0] * 90)
    table, bias, (slope, offset) = pickle.loads(model)
    docs = [*texts, "", None, "...", "Äb-c d_e", "x " * 5000]
    for r in toxicity.score(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model).collect():
        words = [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", docs[r.doc_id] or "") if w]
        values = []
        for w in words:
            rows, _ = toxicity.subwords([w])
            marked = f"<{w.lower()}>"
            assert len(rows) == 1 + sum(max(len(marked) - n + 1, 0) for n in toxicity.LENGTHS)
            values.append(sum(float(table[k]) for k in rows) / len(rows))
        windows = [values[i : i + 6] for i in range(0, max(len(values) - 6, 0) + 3, 3) if i == 0 or i < len(values)]
        top = max(sum(v) / 6 for v in windows) + bias
        assert r.score == pytest.approx(1 / (1 + math.exp(-min(max(slope * top + offset, -50), 50))), abs=1e-6)
        assert r.predicted == (r.score >= 0.3)


def test_likelihood_slopes():
    rng = np.random.default_rng(6)
    y, mass, score, thresholds = rng.integers(0, 4, 50), rng.uniform(0.5, 2, 50), rng.normal(0, 2, 50), np.array([-1.0, 0.3, 1.5])

    def plain(score, thresholds):
        def tail(s, k):
            return 1.0 if k == 0 else 0.0 if k == 4 else 1 / (1 + math.exp(-(s - thresholds[k - 1])))

        return -sum(m * math.log(tail(s, k) - tail(s, k + 1)) for m, s, k in zip(mass, score, y))

    loss, to_score, to_threshold = quality_classifier.slopes(y, mass, score, thresholds)
    assert loss == pytest.approx(plain(score, thresholds))
    for i in range(50):
        step = np.zeros(50)
        step[i] = 1e-5
        assert to_score[i] == pytest.approx((plain(score + step, thresholds) - plain(score - step, thresholds)) / 2e-5, abs=1e-4)
    for k in range(3):
        step = np.zeros(3)
        step[k] = 1e-5
        assert to_threshold[k] == pytest.approx((plain(score, thresholds + step) - plain(score, thresholds - step)) / 2e-5, abs=1e-4)


def test_grades_against_plain_loops(spark):
    rng = random.Random(7)
    texts = [" ".join(w.upper() if rng.random() < i % 3 / 3 else w for w in (rng.choice(WORDS) for _ in range(rng.randint(1, 60)))) for i in range(120)]
    model = quality_classifier.fit(texts, [2 - i % 3 for i in range(120)], [1.0] * 120)
    weights, thresholds = pickle.loads(model)
    assert list(thresholds) == sorted(thresholds)
    docs = [*texts, "", None]
    for r in quality_classifier.grade(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), model).collect():
        words = (docs[r.doc_id] or "").split()
        bag, before = {}, None
        for w in words:
            low = w.lower()
            own = quality_classifier.features(quality_classifier.Words(np.frombuffer(w.encode(), np.uint8), np.array([0, len(w.encode())]), values=quality_classifier.arrays.LOWER_VALUES))[0]
            if low == before:  # the last feature says whether a word repeats the one before
                own[3] = quality_classifier.features(quality_classifier.Words(np.frombuffer(b"a a", np.uint8), np.array([0, 3])))[1, 3]
            for k in own:
                bag[k] = bag.get(k, 0) + 1
            before = low
        score = sum(math.sqrt(n / len(words)) * float(weights[k]) for k, n in bag.items())
        chances = [1 / (1 + math.exp(-(score - t))) for t in thresholds]
        assert r.quality_score == pytest.approx(score, abs=1e-6) and r.expected_grade == pytest.approx(sum(chances), abs=1e-6)
        assert r.p_good == pytest.approx(chances[0], abs=1e-6) and r.kept == (r.p_good >= 0.5)


def test_unknown_toxicity_has_no_grade(spark):
    from barline.llm.op9_quality_classifier import ratings

    rows = [(0, None), (0, 1), (1, 0), (1, 1), (1, None), (None, 1), (None, None)]
    made = ratings(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, quality int, toxic int"))
    assert [r.grade for r in made.orderBy("doc_id").collect()] == [0, 0, 2, 1, None, None, None]
