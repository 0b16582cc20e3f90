"""Operators against plain brute-force versions on small tables."""

import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from barline.llm import arrays, components, decontaminate, langid, line_dedup, lm_score, near_dup, packing, quality_rules, secrets

WORDS = [a + b for a in ("ba", "do", "ki", "lu", "me", "no", "ri", "su") for b in ("", "n", "ra", "st", "ting", "le")]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def root(parent, i):
    while parent[i] != i:
        i = parent[i]
    return i


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(5)
    docs, base = [], text(rng, 120).split()
    for i in range(160):
        if i % 4 == 0:  # a large group of near copies with up to 12 changed words
            w = list(base)
            for _ in range(rng.randint(0, 12)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            docs.append(" ".join(w))
        elif i % 9 == 0 and i > 9:
            docs.append(docs[i - 9])
        else:
            docs.append("\n".join(text(rng, rng.randint(0, 14)) for _ in range(rng.randint(1, 6))))
    return spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").cache(), docs


def bag(x):
    w = x.split()
    n = min(5, len(w))
    return Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if w else Counter()


def jaccard(a, b):
    shared = sum((a & b).values())
    return shared / max(sum(a.values()) + sum(b.values()) - shared, 1)


def test_near_dup_classes(corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "HOT", 8)
    monkeypatch.setattr(near_dup, "BLOCK", 10)
    df, docs = corpus
    bags, parent = [bag(x) for x in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if docs[i].split() and jaccard(bags[i], bags[j]) >= 0.8:
                a, b = root(parent, i), root(parent, j)
                parent[max(a, b)] = min(a, b)
    got = {r.doc_id: r.class_id for r in near_dup.classes(df).collect()}
    assert got == {i: root(parent, i) for i in range(len(docs))}


def test_verified_pairs(corpus):
    df, docs = corpus
    bags = [bag(x) for x in docs]
    pairs = df.sparkSession.createDataFrame([(i, j, len(docs[j])) for i in range(0, 160, 4) for j in range(i + 4, 160, 4)], "a long, b long, size long")
    found = {(r.a, r.b): r.similarity for r in near_dup.verified(pairs, df).collect()}
    want = {(r.a, r.b): jaccard(bags[r.a], bags[r.b]) for r in pairs.collect() if jaccard(bags[r.a], bags[r.b]) >= 0.8}
    assert found == pytest.approx(want) and len(want) > 5


def test_bag_minhash_is_unbiased():
    rng = np.random.default_rng(1)
    off = []
    for k in range(40):
        key = rng.integers(1, 1 << 60, 60).astype(np.uint64)
        a, b = rng.integers(1, 20, 60), rng.integers(1, 20, 60)
        s = near_dup.bag_minhash(np.repeat([0, 1], 60), np.concatenate([key, key]), np.concatenate([a, b]), 2, 256)
        off.append((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(off)) < 0.02 and np.std(off) < 0.06


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_band_distance():
    rng = random.Random(2)
    for _ in range(3000):
        a = [rng.choice("ab") for _ in range(rng.randint(0, 9))]
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            b[rng.randint(0, len(b)) :][:1] = [rng.choice("abc")] * rng.randint(0, 2)
            b.insert(rng.randint(0, len(b)), rng.choice("ab")) if rng.random() < 0.5 else b and b.pop()
        for k in (1, 2, 3):
            assert line_dedup.within("".join(a), "".join(b), k) == (edits(a, b) <= k)


def test_edit_links(spark):
    rng = random.Random(3)
    lines = []
    for _ in range(60):
        x = list(text(rng, rng.randint(4, 9)))
        lines.append("".join(x))
        for _ in range(rng.randint(0, 3)):
            y = list(x)
            for _ in range(rng.randint(1, 3)):
                k = rng.randrange(len(y))
                rng.choice([lambda: y.insert(k, "q"), lambda: y.pop(k), lambda: y.__setitem__(k, "z")])()
            lines.append("".join(y))
    lines = sorted({x for x in lines if len(x) >= 20})
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    name = {r.h: r.line for r in df.collect()}
    got = {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.edit_links(df).collect()}
    assert got == {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}


def linked(lines, edits_allowed=2):
    return {(a, b) for i, a in enumerate(lines) for b in lines[i + 1 :] if abs(len(a) - len(b)) <= edits_allowed and edits(a, b) <= edits_allowed}


def edit_pairs(spark, lines, **more):
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    name = {r.h: r.line for r in df.collect()}
    return {tuple(sorted((name[r.a], name[r.b]))) for r in line_dedup.edit_links(df, **more).collect()}


def test_edit_links_of_short_lines(spark):
    rng = random.Random(61)
    lines = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 7))) for _ in range(150)})
    assert edit_pairs(spark, lines, min_chars=1) == linked(lines)


def test_hot_keys_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "SAMPLE", 1)
    monkeypatch.setattr(line_dedup, "SAMPLED_ROWS", 6)
    monkeypatch.setattr(line_dedup, "MANY_PAIRS", 30)
    rng = random.Random(62)
    lines = []
    for _ in range(280):
        x = list(f"Posted by {rng.choice(('ann', 'bob', 'eve'))} on page {rng.randrange(4)}, number {rng.randrange(10**rng.choice((2, 8)))}")
        for _ in range(rng.choice((0, 0, 1, 2, 3))):
            k = rng.randrange(len(x))
            rng.choice([lambda: x.insert(k, "q"), lambda: x.pop(k), lambda: x.__setitem__(k, "z")])()
        lines.append("".join(x))
    lines = sorted({x for x in lines if len(x) >= 20})
    want = linked(lines)
    assert len(want) > 100 and edit_pairs(spark, lines) == want
    assert edit_pairs(spark, lines, edits=1) == linked(lines, 1)


def test_lines_of_one_template_make_few_pairs(spark):
    rng = random.Random(63)
    lines = [f"Posted by the editor of the daily paper under number {rng.randrange(10**12):012d} in the main section" for _ in range(20_000)]
    lines += [lines[i][:52] + "x" + lines[i][53:] for i in range(0, 200)]
    df = spark.createDataFrame([(x,) for x in lines], "line string").withColumn("h", F.xxhash64("line"))
    pairs = line_dedup.candidates(df)
    found = {tuple(sorted((r.a, r.b))) for r in pairs.collect()}
    h = {r.line: r.h for r in df.collect()}
    assert {tuple(sorted((h[lines[i]], h[lines[20_000 + i]]))) for i in range(200)} <= found
    assert len(found) < 20 * 20_000  # of 200 million pairs that share a whole segment


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {n: n for l in links for n in l}
    for a, b in links:
        a, b = root(parent, a), root(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    linked = {n for a, b in links if a != b for n in (a, b)}
    assert got == {n: root(parent, n) for n in linked}


def test_decontamination(spark):
    rng = random.Random(6)
    items = [text(rng, n) for n in (6, 9, 12, 15, 18, 25, 33, 41, 57)]
    docs = []
    for i in range(80):
        w = text(rng, 60).split()
        if i % 3 == 0:
            passage = items[i % len(items)].split()
            if i % 2 and len(passage) > 35:
                passage[rng.randrange(len(passage))] = "changed"
            w[i % 50 : i % 50] = passage
        docs.append(" ".join(w))
    want = set()
    for k, item in enumerate(items):
        own, n = bag(item), len(item.split())
        for i, x in enumerate(docs):
            w = x.split()
            if any(jaccard(bag(" ".join(w[p : p + n])), own) >= 0.8 for p in range(len(w) - n + 1)):
                want.add((i, k))
    got = decontaminate.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want


def test_decontamination_of_cut_and_edited_passages(spark):
    """All pairs and similarities of brute force, near 0.8 too and in texts shorter than the item."""
    rng = random.Random(11)
    vocabulary = ["w%d" % i for i in range(400)]
    items = [" ".join(rng.choices(vocabulary[: 400 if k % 4 else 6], k=n)) for k, n in enumerate((1, 2, 4, 5, 7, 11, 14, 20, 28, 40, 64, 90, 130))]
    docs = []
    for i in range(600):
        w = items[i % len(items)].split()
        some, at = rng.randrange(len(w) // 5 + 2), rng.randrange(len(w))
        kind = i // len(items) % 5
        if kind == 0:
            w = w[some:]
        elif kind == 1:
            w = w[: len(w) - some]
        elif kind == 2:
            w[at : at + some // 2] = rng.choices(vocabulary, k=some // 2)
        elif kind == 3:
            w[at : at + some // 2] = []
        else:
            w[at:at] = rng.choices(vocabulary, k=some // 2)
        around = rng.choice((0, 0, 3, 60))
        docs.append(" ".join([*rng.choices(vocabulary, k=around), *w, *rng.choices(vocabulary, k=rng.choice((0, around)))]))
    want, whole = {}, set()
    for k, item in enumerate(items):
        own, n = bag(item), len(item.split())
        for i, x in enumerate(docs):
            w = x.split()
            for p in range(len(w)):
                value = jaccard(bag(" ".join(w[p : p + n])), own)
                if value >= 0.8:
                    want[i, k] = max(want.get((i, k), 0.0), value)
                    if p < max(1, len(w) - n + 1):
                        whole.add((i, k))
    got = decontaminate.matches(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    rows = {(r.doc_id, r.item_id): r for r in got.collect()}
    assert {k: r.similarity for k, r in rows.items()} == want and whole <= set(rows)
    assert sum(1 for v in want.values() if v < 0.85) > 20 and sum(1 for i, k in whole if len(docs[i].split()) < len(items[k].split())) > 20
    for (i, k), r in rows.items():
        assert jaccard(bag(" ".join(docs[i].split()[r.first_word :][: len(items[k].split())])), bag(items[k])) == r.similarity


def plain_lm(docs, held_out, fold):
    """Counts, weights and scores of deleted interpolation in plain Python."""
    import math

    low = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
    tokens = [[w for w in re.split(rb"[\x20\x09-\x0d]+", x.encode().translate(low)) if w] + [None] for x in docs]
    words, pairs, fold_words, fold_pairs = Counter(), Counter(), Counter(), Counter()
    for i, ts in enumerate(tokens):
        if not held_out(i):
            both = list(zip([None, *ts], ts))
            words.update(ts)
            pairs.update(both)
            if fold(i):
                fold_words.update(ts)
                fold_pairs.update(both)
    n, v, rest = sum(words.values()), len(words), sum(words.values()) - sum(fold_words.values())

    def kind(count):
        return min(math.floor(math.log2(count + 1)), lm_score.CLASSES - 1)

    def cell(p):
        return min(math.floor(-math.log10(p) / lm_score.STEP), lm_score.CELLS - 2) if p > 0 else None

    def middle(c):
        return 0.0 if c is None else 10 ** (-(c + 0.5) * lm_score.STEP)

    events = Counter()
    for i, ts in enumerate(tokens):
        if fold(i) and not held_out(i):
            for h, w in zip([None, *ts], ts):
                seen = words[h] - fold_words[h]
                pair = (pairs[h, w] - fold_pairs[h, w]) / seen if seen else 0
                events[kind(seen), cell(pair), cell((words[w] - fold_words[w]) / max(rest, 1))] += 1
    weights = [list(lm_score.START) for _ in range(lm_score.CLASSES)]
    for _ in range(lm_score.ITERATIONS):
        sums = [list(lm_score.START) for _ in range(lm_score.CLASSES)]
        for (k, pair, word), count in events.items():
            parts = [x * y for x, y in zip(weights[k], (middle(pair), middle(word), 1 / (v + 1)))]
            for j in range(3):
                sums[k][j] += count * parts[j] / sum(parts)
        weights = [[x / sum(row) for x in row] for row in sums]
    scores = []
    for ts in tokens:
        total = 0.0
        for h, w in zip([None, *ts], ts):
            a, b, c = weights[kind(words[h])]
            total += math.log10(a * (pairs[h, w] / words[h] if words[h] else 0) + b * words[w] / max(n, 1) + c / (v + 1))
        scores.append(total)
    return tokens, words, n, v, scores


def test_lm_scores(corpus):
    df, docs = corpus
    tokens, counts, n, v, want = plain_lm(docs, lambda i: i % 5 == 0, lambda i: i % 5 == 1)
    for blocks, ranges in ((9000, 7000), (1 << 20, 1 << 20)):
        rows = lm_score.score(df, F.col("doc_id") % 5 == 0, F.col("doc_id") % 5 == 1, block_bytes=blocks, range_bytes=ranges).collect()
        for r in rows:
            ts = tokens[r.doc_id]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ts), sum(counts[t] > 0 for t in ts), n)
            assert r.base_score == pytest.approx(sum(np.log10((counts[t] + 1) / (n + v + 1)) for t in ts))
            assert r.score == pytest.approx(want[r.doc_id], rel=1e-9)
        held = [r for r in rows if r.doc_id % 5 == 0]
        assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_lm_totals_beyond_32_bits():
    import pyarrow as pa

    count = np.array([3_000_000_000], np.uint32)
    message = lm_score._joined([lm_score._planes(np.array([7], np.uint64)), lm_score._planes(count), lm_score._planes(np.zeros(0, np.uint64)), lm_score._planes(np.zeros(0, np.uint32))])
    rows = lm_score._owner(pa.table({"range": [0, 0], "block": [0, 1], "fold": [False, True], "payload": pa.array([message] * 2, pa.binary())})).to_pylist()
    assert (rows[-1]["types"], rows[-1]["tokens"], rows[-1]["fold_tokens"]) == (1, 6_000_000_000, 3_000_000_000)
    assert [lm_score._numbers(f, np.uint64).tolist() for f in lm_score._fields(rows[1]["payload"])] == [[6_000_000_000], [], [3_000_000_000], []]


def test_quality_measures(corpus):
    df, docs = corpus
    for r in quality_rules.measures(df).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])
        grams = list(zip(w, w[1:], w[2:]))
        many = Counter(grams)
        covered = {i + k for i, g in enumerate(grams) if many[g] > 1 for k in range(3)}
        lines = [x for x in docs[r.doc_id].split("\n") if x.strip()]
        assert (r.n_words, r.word_chars, r.n_repeat_words, r.n_dup_lines) == (len(w), sum(map(len, w)), len(covered), len(lines) - len(set(lines)))


def test_packing_round_trip(corpus):
    from tokenizers import Tokenizer

    df, docs = corpus
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    odd = df.unionByName(df.sparkSession.createDataFrame([(900, "A<|endoftext|>b it's I'LL x.y, ... ,. é́  z q 1234 #a_b"), (901, "Don't.\tSTOP,\r\nÄÖÜ İx")], "doc_id long, text string"))
    made = packing.pack(packing.tokenize(odd, path, capacity=64), capacity=64, group_pieces=50).collect()
    ids = {}
    for r in sorted(made, key=lambda r: (r.doc_id, r.start)):
        ids.setdefault(r.doc_id, []).extend(np.frombuffer(r.ids, "<u4").tolist())
    for r in odd.collect():
        assert ids[r.doc_id] == [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1]
    by = {}
    for r in made:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64


def test_first_fit_decreasing():
    rng = random.Random(8)
    lengths = sorted((rng.randint(1, 50) for _ in range(300)), reverse=True)
    free, want = [], []
    for n in lengths:
        b = next((i for i, f in enumerate(free) if f >= n), len(free))
        if b == len(free):
            free.append(50)
        free[b] -= n
        want.append(b)
    assert packing.first_fit_decreasing(lengths, 50)[0] == want


def test_entropy_windows():
    import math

    rng = random.Random(9)
    alphabet = frozenset("abcdef0123456789")
    for _ in range(200):
        x = "".join(rng.choice("abcdef0123456789" if rng.random() < 0.97 else "-") for _ in range(60))
        x = x[:20] + "a" * rng.randint(0, 20) + x[20:]
        hit = set()
        for i in range(len(x) - 15):
            w = x[i : i + 16]
            if set(w) <= alphabet and -sum(c / 16 * math.log2(c / 16) for c in Counter(w).values()) >= 3.2:
                hit |= set(range(i, i + 16))
        got = [p for a, b in secrets.suspect_windows(x, alphabet, 16, 3.2) for p in range(a, b)]
        assert sorted(got) == sorted(hit) and len(got) == len(set(got))
    scanner = secrets.Scanner()
    found = scanner.extra("key Zk3v9QpL7xT2mW8rY4bN6cJ1 and 123e4567-e89b-12d3-a456-426614174000 and plainlowercasewordsruntogether", [])
    assert len(found) == 1


def test_secrets_after_an_equals_sign():
    scanner, secret = secrets.Scanner(), "Zk3v9QpL7xT2mW8rY4bN6cJ1"
    for before in ("AUTH=", "private_key=", "export X=", "https://a.example/b?sig=", "https://a.example/b?v=1&sig=", "X==", "X = ", "X: ", "(", "X='", "é"):
        x = f"{before}{secret} and more"
        assert scanner.extra(x, scanner.base(x)) == [(len(before), 3, len(before) + len(secret))], before
    assert scanner.extra("id=123e4567-e89b-12d3-a456-426614174000 n=12345678901234567890123 w=plainlowercasewordsruntogether", []) == []


def test_partly_covered_secrets_are_kept():
    scanner = secrets.Scanner()
    x = "id 0123456789abcdefZk3v9QpL7xT2mW8rY4bN6cJ1"
    base = scanner.base(x)
    assert base == [(3, 2, 19)] and [(k, b) for _, k, b in scanner.extra(x, base)] == [(3, len(x))]
    x = "token=Zk3v9QpL7xT2mW8rY4bN6cJ1"
    assert scanner.base(x) and scanner.extra(x, scanner.base(x)) == []
    assert scanner.extra(x, [(0, 0, 12), (12, 2, len(x))]) == [] and len(scanner.extra(x, [(0, 0, 12), (13, 2, len(x))])) == 1


def plain_spans(x):
    """All spans of a text by re-computing every window."""
    import math

    base = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", x) if len(m.group(1)) >= 12]
    base += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", x) if len(m.group()) >= 18]
    base += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", x) if len(m.group()) >= 16]
    hexadecimal, every = set("0123456789abcdefABCDEF"), set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
    found, i = set(), 0
    while i < len(x):
        j = i
        while j < len(x) and x[j] in every:
            j += 1
        word = x[i:j]
        if len(word) >= 20 and any(c in "0123456789" for c in word) and not any(re.fullmatch(p, word, re.ASCII) for p in secrets.ALLOWED):
            for alphabet, n, bits in ((hexadecimal, 24, 3.0), (every, 20, 3.75)):
                marked = set()
                for k in range(len(word) - n + 1):
                    w = word[k : k + n]
                    if set(w) <= alphabet and -sum(c / n * math.log2(c / n) for c in Counter(w).values()) >= bits - 1e-9:
                        marked |= set(range(k, k + n))
                runs = [(a, next(b for b in range(a, len(word) + 1) if b not in marked)) for a in marked if a - 1 not in marked]
                found |= {(i + a, 3, i + b) for a, b in runs if re.search("[0-9]", word[a:b]) and re.search("[A-Za-z]", word[a:b])}
        i = max(j, i + 1)
    covered = {p for a, _, b in base for p in range(a, b)}
    extra = []
    for a, _, b in sorted(found):
        if not set(range(a, b)) <= covered:
            extra = [*extra[:-1], (extra[-1][0], 3, max(b, extra[-1][2]))] if extra and a < extra[-1][2] else [*extra, (a, 3, b)]
    return sorted(base), extra


def test_secrets_whole(spark):
    rng = random.Random(21)
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"

    def piece():
        make = rng.randrange(9)
        run = "".join(rng.choice((every, "0123456789abcdef", "0123456789ABCDEF", "ab01", "0123456789")[rng.randrange(5)]) for _ in range(rng.randint(1, 60)))
        name = rng.choice(("password", "Token", "API_KEY", "apikey", "secret", "passwd", "key"))
        return (run, f"{name}={run}", f'{name}" : \'{run}', "AKIA" + run.upper(), run[:20] + "0123456789abcdef" + run[20:], text(rng, 4), "123e4567-e89b-12d3-a456-426614174000", "2024-01-02T03-04", "é" + run)[make]

    docs = [rng.choice((" ", "\n", "=", ";", "")).join(piece() for _ in range(rng.randint(0, 12))) for _ in range(400)]
    rows = {r.doc_id: r for r in secrets.scan(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}
    more = 0
    for i, x in enumerate(docs):
        base, extra = plain_spans(x)
        assert rows[i].spans == secrets.joined(sorted(base + extra)), x
        assert [rows[i].n_assign, rows[i].n_access, rows[i].n_hex, rows[i].n_entropy] == [sum(k == n for _, k, _ in base) for n in range(3)] + [len(extra)]
        more += len(extra)
    assert more > 100


def test_recall_of_random_strings():
    rng, scanner = random.Random(22), secrets.Scanner()
    every = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for n, least in ((24, 0.9), (32, 0.98), (40, 0.99)):
        made = ["".join(rng.choice(every) for _ in range(n)) for _ in range(2000)]
        assert sum(bool(scanner.extra(f"key {x} end", [])) for x in made) / len(made) >= least
    prose = [text(rng, 200) for _ in range(50)] + ["see https://example.org/some/path/to/a/page-of-words and some_long_identifier_name_here"]
    assert not any(scanner.extra(x, []) for x in prose)


class PlainKneserNey:
    """Interpolated Kneser-Ney by dictionaries of strings."""

    def __init__(self, texts, order):
        self.order, self.tables = order, []
        counts = Counter(g for t in texts for g in self.grams(t))
        self.uniform = 1 / (len({g[-1] for g in counts}) + 1)
        while True:
            singles, doubles = sum(c == 1 for c in counts.values()), sum(c == 2 for c in counts.values())
            discount = singles / (singles + 2 * doubles) if singles and doubles else 0.5
            totals, kinds = Counter(), Counter()
            for g, c in counts.items():
                totals[g[:-1]] += c
                kinds[g[:-1]] += 1
            self.tables.insert(0, (counts, totals, kinds, discount))
            if len(next(iter(counts))) == 1:
                break
            counts = Counter(g[1:] for g in counts)

    def line(self, t):
        return "\x02" * (self.order - 1) + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in t.lower()))

    def grams(self, t):
        x = self.line(t)
        return [x[i : i + self.order] for i in range(len(x) - self.order + 1)]

    def probability(self, gram):
        p = self.uniform
        for k, (counts, totals, kinds, discount) in enumerate(self.tables, 1):
            g = gram[self.order - k :]
            if totals[g[:-1]]:
                p = max(counts[g] - discount, 0) / totals[g[:-1]] + discount * kinds[g[:-1]] / totals[g[:-1]] * p
        return p

    def bits(self, t):
        import math

        own = self.grams(t)
        return sum(-math.log2(self.probability(g)) for g in own) / len(own)


def test_kneser_ney_against_dictionaries(monkeypatch):
    rng = random.Random(31)
    languages = {"a": "abcdeéü", "b": "cdefgh", "c": "xyzwvab"}
    made = {k: ["".join(rng.choice(v + "  .") for _ in range(rng.randint(5, 120))) for _ in range(9)] for k, v in languages.items()}
    models = {k: langid.fit_language(v, 4) for k, v in made.items()}
    plain = {k: PlainKneserNey(v, 4) for k, v in made.items()}
    tests = ["".join(rng.choice(languages[k] + " Q7") for _ in range(rng.randint(1, 200))) for k in "abc" for _ in range(20)] + ["123 ...", ""]
    for cells in (langid.TABLE_CELLS, 0):
        monkeypatch.setattr(langid, "TABLE_CELLS", cells)
        for t, (language, _, low, _) in zip(tests, langid.Identifier(models).identify(tests)):
            if not any(c.isalpha() for c in t):
                assert language == "und"
                continue
            want = {k: m.bits(t) for k, m in plain.items()}
            assert low == pytest.approx(min(want.values()), rel=1e-5) and want[language] == pytest.approx(low, rel=1e-5)


def test_foreign_and_random_text_is_rejected(spark):
    rng = random.Random(32)
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    models = langid.fit(docs)
    finnish = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki ja omatunto ja heidän on toimittava toisiaan kohtaan veljeyden hengessä"
    noise = ["".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(300)) for _ in range(20)]
    made = langid.identify(spark.createDataFrame(list(enumerate([finnish, *noise])), "doc_id long, text string"), models).collect()
    assert not any(r.accepted for r in made)
    assert langid.identify(docs.where("lang is not null and length(text) > 100"), models).select(F.avg(F.col("accepted").cast("int")).alias("x")).first().x > 0.995


def test_language_fit_has_documents_of_each_language(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_CHARS", 10)
    docs = spark.createDataFrame([(i, "some words of a language here " * 50, "en") for i in range(400)], "doc_id long, text string, lang string")
    assert langid.fit(docs, sample_chars=10)["en"]


def test_languages_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    made = langid.identify(docs.where("doc_id % 3 = 0"), langid.fit(docs.where("doc_id % 3 != 0")))
    assert made.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")).alias("x")).first().x > 0.97


def test_words_of_long_texts_in_slices(monkeypatch):
    import pyarrow as pa

    rng = random.Random(52)
    data = [" ".join("x" * rng.choice((1, 3, 40)) for _ in range(rng.randint(0, 60))) + rng.choice(("", " ", "\n")) for _ in range(30)] + ["y" * 900, "", " ", "z" * 300 + " a"]
    _, _, whole = next(arrays.words_in_chunks(pa.array(data)))
    for size in (1, 7, 64, 500):
        monkeypatch.setattr(arrays, "SLICE_BYTES", size)
        _, _, cut = next(arrays.words_in_chunks(pa.array(data)))
        assert all(np.array_equal(getattr(whole, k), getattr(cut, k)) for k in ("starts", "ends", "hashes", "row_at"))


def test_word_hashes():
    import pyarrow as pa

    data = ["one  two\nthree", "", None, "two", "\x1cone one"]
    _, _, words = next(arrays.words_in_chunks(pa.array(data)))
    assert words.per_row.tolist() == [3, 0, 0, 1, 2]
    h = words.hashes.tolist()
    assert h[1] == h[3] and h[0] == h[5] and len({*h}) == 4


def test_near_dup_texts_of_one_template(spark, monkeypatch):
    """Texts that differ in words of their own resemble each other below the limit: none is linked, and few reach the comparison in blocks."""
    monkeypatch.setattr(near_dup, "HOT", 8)
    monkeypatch.setattr(near_dup, "GROUP_PART", 50)
    rng = random.Random(11)
    base = [f"t{rng.randrange(10**6)}" for _ in range(200)]
    rows = []
    for i in range(240):
        words = list(base)
        for k in rng.sample(range(0, 200, 5), 7):
            words[k] = f"x{rng.randrange(10**9)}"
        rows.append((i, " ".join(words)))
    rows += [(300 + i, rows[i][1] + " more words") for i in range(30)]
    rows += [(400 + i, " ".join(rows[40 + i][1].split()[:182])) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    assert all(made[i] == i for i in range(240)) and all(made[300 + i] == i for i in range(30)) and all(made[400 + i] == 40 + i for i in range(10))
    placed = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("class"), F.lit(1).cast("long").alias("group"))
    left = {r.id for r in near_dup.with_partners(placed, docs, 0.8, "doc_id", "text").collect()}
    assert {*range(30), *range(40, 50), *range(300, 330), *range(400, 410)} <= left and len(left) < 100, len(left)


def test_components_of_stars_and_chains(spark):
    links = [(1, 2), (1, 3), (3, 1), (10, 11), (11, 12), (13, 12), (None, 4), (5, 5), (20, 40), (30, 40)]
    made = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert made == {1: 1, 2: 1, 3: 1, 10: 10, 11: 10, 12: 10, 13: 10, 20: 20, 30: 20, 40: 20}


def test_secret_spans_of_many_lines_take_one_sweep():
    import time

    rng = random.Random(3)
    scanner = secrets.Scanner()
    lines = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) + " key" + "".join(rng.choice("ABCDEFGHJKLMNPQRSTUVWXYZabcdefghjkmnpqrstuvwxyz23456789") for _ in range(40)) for _ in range(20_000)]
    text = "\n".join(lines)
    began = time.time()
    base = scanner.base(text)
    extra = scanner.extra(text, base)
    assert time.time() - began < 30 and len(base) == 20_000 and len(extra) > 19_000
    # A span goes if base spans that touch cover it, and stays if a part of it is left.
    kept = scanner.extra("token=" + "a1B2c3D4e5F6g7H8i9J0kLmN", scanner.base("token=" + "a1B2c3D4e5F6g7H8i9J0kLmN"))
    assert kept == []


def test_language_of_long_texts_in_slices(monkeypatch):
    """A text in slices has the figures of the whole text."""
    rng = random.Random(8)
    words = ["the", "house", "Straße", "été", "12", "--", "İstanbul", "ΟΔΟΣ", "and", "\n\n", "Haus"]
    texts = [" ".join(rng.choice(words) for _ in range(400)) for _ in range(30)]
    models = {"x": langid.fit_language(texts[:15], langid.ORDER), "y": langid.fit_language([t[::-1] for t in texts[15:]], langid.ORDER)}
    own = langid.Identifier(models)
    odd = [texts[0] * 3, "a" * 2000, "  " * 900 + "word", "", " \n " * 500, "…".join(texts[3:6])]
    whole = own.identify(odd)
    for size in (50, 64, 333):
        monkeypatch.setattr(langid, "SLICE", size)
        for a, b in zip(own.identify(odd), whole):
            assert a[0] == b[0] and a[3] == b[3] and a[1] == pytest.approx(b[1]) and (a[2] is None and b[2] is None or a[2] == pytest.approx(b[2], abs=1e-4))
