"""The stages of the pipeline, each against a brute-force version on its own input."""

import os
import re
from collections import Counter

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


def root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


def bag(words):
    n = min(5, len(words))
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if words else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def without_repeated_lines(docs):
    places = {}
    for k in sorted(docs):
        for i, line in enumerate(docs[k].split("\n")):
            if line.strip():
                places.setdefault(line, []).append((k, i))
    parent = {x: x for x in places}
    for x in places:
        for y in places:
            if len(x) >= 20 and len(y) >= 20 and x < y and abs(len(x) - len(y)) <= 2 and sum((Counter(x) - Counter(y)).values()) <= 2 and edits(x, y) <= 2:
                parent[root(parent, y)] = root(parent, x)
    first = {}
    for x, at in places.items():
        first[root(parent, x)] = min(first.get(root(parent, x), (1 << 60, 0)), min(at))
    kept = {}
    for k, text in docs.items():
        lines = text.split("\n")
        left = [x for i, x in enumerate(lines) if not x.strip() or first[root(parent, x)] == (k, i)]
        if len(left) == len(lines) or "\n".join(left).strip():
            kept[k] = "\n".join(left)
    return kept


def without_near_copies(docs, originals):
    bags = {k: [bag(y.split()) for y in ([x, originals[k]] if len(x) < len(originals[k]) else [x])] for k, x in docs.items()}
    parent = {k: k for k in docs}
    for a in docs:
        for b in docs:
            if a < b and any(x and jaccard(x, y) >= 0.8 for x in bags[a] for y in bags[b]):
                x, y = root(parent, a), root(parent, b)
                parent[max(x, y)] = min(x, y)
    return {k: x for k, x in docs.items() if root(parent, k) == k}


def without_leaks(docs, items):
    def words(x):
        return re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+", x.lower())

    own = [(len(words(x)), bag(words(x))) for x in items]

    def leaks(x):
        w = words(x)
        grams = set(bag(w))
        return any(grams & set(b) and any(jaccard(bag(w[p : p + n]), b) >= 0.8 for p in range(max(1, len(w) - n + 1))) for n, b in own if n)

    return {k: x for k, x in docs.items() if not leaks(x)}


def test_stages(spark, tmp_path):
    import corpus_pipeline

    read = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, items = read.columns, [r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    originals = {r.doc_id: r.text for r in read.collect()}
    brute = {"line_dedup": without_repeated_lines, "near_dup": lambda d: without_near_copies(d, originals), "decontaminate": lambda d: without_leaks(d, items)}
    docs = read
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        made = spark.read.parquet(str(tmp_path / name))
        if name == "packing":
            assert {r.doc_id for r in made.select("doc_id").collect()} == set(before)
            break
        assert made.columns == columns
        after = {r.doc_id: r.text for r in made.collect()}
        if name in brute:
            assert after == brute[name](before), name
        else:
            assert len(after) >= 0.98 * len(before) and set(after.items()) <= set(before.items())
        docs = made


def test_near_copies_that_line_dedup_shortened(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(9)

    def words(n):
        return " ".join(str(rng.randrange(10**6)) for _ in range(n))

    line, other = words(90), words(40)
    copy = f"{line} and some further words\n{other}"
    rows = [(1, f"{line}\n{other}"), (2, copy), (3, f"{words(30)}\n{other}"), (4, words(50))]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.createDataFrame([(1, rows[0][1]), (2, copy.split("\n")[0]), (3, rows[2][1].split("\n")[0]), (4, rows[3][1])], "doc_id long, text string")
    made = corpus_pipeline.keep_one_of_near_duplicates(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in made.collect()) == [1, 3, 4]


def test_null_and_shared_ids(spark, tmp_path):
    import random

    import corpus_pipeline

    rng = random.Random(4)

    def words(n):
        return " ".join(str(rng.randrange(10**6)) for _ in range(n))

    item, x, y, z, last = (words(60) for _ in range(5))
    leak, near_y = f"before {item} after", f"{y} more"
    spark.createDataFrame([(1, item)], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))

    def after(stage, rows):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        made = stage(spark, docs, str(tmp_path))
        assert made.columns == docs.columns
        return sorted(((r.doc_id, r.text) for r in made.collect()), key=str)

    # A row without an id goes if it leaks; of two texts with one id only the leaking one does.
    rows = [(None, leak), (None, x), (5, leak), (5, y), (6, z), (7, None), (None, None)]
    assert after(corpus_pipeline.drop_benchmark_leaks, rows) == sorted([(None, x), (5, y), (6, z), (7, None), (None, None)], key=str)
    # Different texts of one id stay, near copies without an id go, and equal rows become one.
    rows = [(None, x), (None, f"{x} more"), (5, y), (5, z), (None, near_y), (9, near_y), (6, last), (6, last), (3, f"{last} more"), (8, None), (8, None), (None, "")]
    made = after(corpus_pipeline.keep_one_of_near_duplicates, rows)
    assert [r for r in made if r[1] in (x, f"{x} more")] in ([(None, x)], [(None, f"{x} more")])
    assert [r for r in made if r[1] not in (x, f"{x} more")] == sorted([(5, y), (5, z), (3, f"{last} more"), (8, None), (None, "")], key=str)


def test_entry_works_without_this_part(tmp_path):
    """With these folders gone the other queries are still there."""
    import shutil
    import subprocess
    import sys

    home = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    shutil.copytree(home, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'sma' in q and 'pipeline' not in q and not any(k.startswith('op') and k[2].isdigit() for k in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
