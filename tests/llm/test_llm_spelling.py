"""Spelling variants against all pairs of words, in a plain loop."""

import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest

from barline.llm import spelling


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain(docs):
    n = Counter()
    for i, text in docs:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 3}
    rows = {}
    for w in n:
        near = [x for x in n if abs(len(x) - len(w)) <= 1 and x != w and edits(w, x) == 1]
        form = min(near, key=lambda x: (-n[x], x)) if near else None
        form = form if form and n[form] >= 2 * n[w] else None
        rows[w] = [form, None, n[w], len(near), n.get(form)]
    for w, row in rows.items():
        row[1] = w
        while rows[row[1]][0]:
            row[1] = rows[row[1]][0]
    return {w: tuple(r) for w, r in rows.items()}


def documents(seed, docs=150):
    rng = random.Random(seed)
    letters = "abcdelnorstÀé÷ÿß"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]

    def changed(w):
        k, c = rng.randrange(len(w)), rng.choice(letters)
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + c + w[k:], w[:k] + c + w[k + 1 :]])

    words = base * 6 + [changed(rng.choice(base)) for _ in range(60)] * 3 + [changed(changed(rng.choice(base))) for _ in range(40)] * 3
    rows = [(rng.choice([i, i, None]), rng.choice([" ", ". ", "1", "漢"]).join(rng.choice([str.lower, str.upper, str])(rng.choice(words)) for _ in range(40))) for i in range(docs)]
    return rows + [(7, None), (8, ""), (9, "a " * 50), (9, "abcde" * 700 + " x"), (9, "abcde" * 700), (9, "abcde" * 700 + "f"), rows[0], rows[0]]


@pytest.mark.parametrize("seed", (1, 2))
def test_all_pairs(spark, monkeypatch, seed):
    for name, value in (("LEFT", 16), ("RIGHT", 40), ("TASK_ROWS", 300), ("SLICE", 64)):
        monkeypatch.setattr(spelling, name, value)
    docs = documents(seed)
    df = spark.createDataFrame([(i, t, 1.5, "w", 2) for i, t in docs], "doc_id long, text string, n double, word string, cell long")
    made = spelling.variants(spelling.word_counts(df)).collect()
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in made}
    want = plain(docs)
    assert len(made) == len(got) and got == want
    assert sum(r[0] is not None for r in want.values()) > 30 and any(r[0] not in (None, r[1]) for r in want.values())
    assert spelling.variants(spelling.word_counts(df.limit(0))).count() == 0


def test_one_edit():
    def rows(*words):
        return np.array([list(w.encode()) for w in words], np.uint8)

    assert spelling.one_edit(rows("abcd", "abcd", "abcd"), rows("abcd", "abce", "bacd")).tolist() == [False, True, False]
    assert spelling.one_edit(rows("abcd", "abcd", "aaaa", "abcd"), rows("xabcd", "abcdx", "aaaaa", "axbdc")).tolist() == [True, True, True, False]
