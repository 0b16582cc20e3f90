"""SQL of the training-data queries that SQL can express, for another engine to run on the same tables."""

from __future__ import annotations

from barline.llm.lm_score import CELLS, CLASSES, ITERATIONS as EM_STEPS, START, STEP
from barline.llm.near_dup import SHINGLE, SIMILARITY
from barline.llm.quality_rules import ITERATIONS, LEAST_WORDS, MOST_REPEATED_PERCENT, SMOOTHING, LabelModel
from barline.llm.secrets import ALLOWED, CLASSES as CLASSES_OF_SECRETS

_VOTES = {
    "enough_words": ("n_words >= 100", f"n_words < {LEAST_WORDS}"),
    "word_length": ("word_chars / words BETWEEN 3 AND 10", "NOT (word_chars / words BETWEEN 2.5 AND 14)"),
    "few_symbols": ("n_symbols / words < 0.02", "n_symbols / words > 0.1"),
    "low_symbol_share": ("n_symbols / chars < 0.003", "n_symbols / chars > 0.01"),
    "few_repeats": ("n_repeat_words / words < 0.15", "n_repeat_words / words > 0.4"),
    "few_repeated_lines": ("n_dup_lines / lines < 0.05", "n_dup_lines / lines > 0.5"),
    "mostly_letters": ("n_letters / chars > 0.8", "n_letters / chars < 0.6"),
    "few_capitals": ("n_capitals / letters < 0.15", "n_capitals / letters > 0.4"),
}


def quality_rules() -> str:
    """Measures, votes, and expectation-maximisation as one pair of tables for each iteration."""
    names = list(_VOTES)
    votes = ", ".join(f"CASE WHEN {_VOTES[n][1]} THEN -1 WHEN {_VOTES[n][0]} THEN 1 ELSE 0 END AS {n}" for n in names)
    start = LabelModel(names)
    cells = [(n, v) for n in names for v in (1, 0, -1)]

    def cell(side: str, n: str, v: int) -> str:
        return f"{side}_{n}_{v + 1}"

    model = "SELECT CAST(" + repr(start.prior) + " AS DOUBLE) AS prior, " + ", ".join(f"CAST({start.rates[n][v][k]!r} AS DOUBLE) AS {cell(s, n, v)}" for n, v in cells for k, s in enumerate("gb"))
    odds = "ln(prior / (1 - prior)) + " + " + ".join(f"ln(CASE {n} " + " ".join(f"WHEN {v} THEN {cell('g', n, v)} / {cell('b', n, v)}" for v in (1, 0, -1)) + " END)" for n in names)
    posterior = f"1.0 / (1.0 + exp(-({odds})))"
    steps = [f"m0 AS ({model})"]
    for k in range(ITERATIONS):
        sums = ", ".join(f"(sum(CASE WHEN {n} = {v} THEN weight * {p} ELSE 0 END) + {SMOOTHING}) / (sum(weight * {p}) + {3 * SMOOTHING}) AS {cell(s, n, v)}" for n, v in cells for s, p in (("g", "p"), ("b", "(1 - p)")))
        steps.append(f"e{k} AS MATERIALIZED (SELECT {', '.join(names)}, weight, {posterior} AS p FROM patterns, m{k})")
        steps.append(f"m{k + 1} AS MATERIALIZED (SELECT (sum(weight * p) + {SMOOTHING}) / (sum(weight) + {2 * SMOOTHING}) AS prior, {sums} FROM e{k})")
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 worded AS MATERIALIZED (SELECT rid, doc_id, text, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM docs),
 grams AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM worded))),
 repeats AS (SELECT rid, count(DISTINCT i + k) AS n FROM grams, (VALUES (0), (1), (2)) AS t(k) WHERE n > 1 GROUP BY rid),
 seen AS (SELECT worded.rid, doc_id, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0) AS BIGINT) AS word_chars,
 length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
 len(ls) AS n_lines, length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')) AS n_letters, length(regexp_replace(text, '\\P{{Lu}}', '', 'g')) AS n_capitals FROM worded LEFT JOIN repeats USING (rid)),
 ratios AS (SELECT *, CAST(greatest(n_words, 1) AS DOUBLE) AS words, CAST(greatest(word_chars, 1) AS DOUBLE) AS chars, CAST(greatest(n_lines, 1) AS DOUBLE) AS lines, CAST(greatest(n_letters, 1) AS DOUBLE) AS letters FROM seen),
 votes AS MATERIALIZED (SELECT *, {votes} FROM ratios),
 patterns AS MATERIALIZED (SELECT {', '.join(names)}, CAST(count(*) AS DOUBLE) AS weight FROM votes GROUP BY ALL),
 {', '.join(steps)},
 judged AS (SELECT *, {posterior} AS p_good, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words AS base_failed FROM votes, m{ITERATIONS})
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p_good >= 0.5 AS kept, p_good FROM judged"""


#: crc32 of doc_id as text, bit by bit (0 without an id).
CRC32 = """coalesce(xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
 lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), CAST(4294967295 AS BIGINT)), 0)"""
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"


def near_dup() -> str:
    """Classes of texts whose five-word shingles have a multiset similarity of 0.8, all pairs compared."""
    return f"""WITH RECURSIVE worded AS MATERIALIZED (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
 texts AS MATERIALIZED (SELECT ws, min(doc_id) AS id, count(*) AS n_copies FROM worded WHERE len(ws) > 0 GROUP BY ws),
 places AS (SELECT id, ws, least({SHINGLE}, len(ws)) AS k, unnest(range(1, len(ws) - least({SHINGLE}, len(ws)) + 2)) AS i FROM texts),
 grams AS MATERIALIZED (SELECT id, array_to_string(ws[i:i + k - 1], ' ') AS g, count(*) AS n FROM places GROUP BY ALL),
 mass AS (SELECT id, sum(n) AS m FROM grams GROUP BY id),
 shared AS (SELECT x.id AS a, y.id AS b, CAST(sum(least(x.n, y.n)) AS DOUBLE) AS s FROM grams x JOIN grams y ON x.g = y.g AND x.id < y.id GROUP BY ALL),
 links AS MATERIALIZED (SELECT a, b FROM shared JOIN mass p ON p.id = a JOIN mass q ON q.id = b WHERE s / (p.m + q.m - s) >= {SIMILARITY}),
 both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
 reached AS (SELECT id AS node, id AS least FROM texts UNION SELECT b, least FROM reached JOIN both_ways ON a = node WHERE least < b),
 named AS (SELECT node, min(least) AS class_id FROM reached GROUP BY node)
 SELECT w.doc_id, coalesce(class_id, w.doc_id) AS class_id, coalesce(n_copies, 1) AS n_copies FROM worded w LEFT JOIN texts t ON t.ws = w.ws LEFT JOIN named ON node = t.id"""


def decontaminate() -> str:
    """The best item-sized window of every pair of a document and an item that share a shingle."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)

    def words(text: str) -> str:
        return f"regexp_extract_all(translate({text}, '{upper}', '{upper.lower()}'), '[0-9A-Za-z\\x{{80}}-\\x{{10FFFF}}]+')"

    grams = "array_to_string(ws[i:i + k - 1], ' ')"
    return f"""WITH items AS MATERIALIZED (SELECT item_id, ws, least({SHINGLE}, len(ws)) AS k, len(ws) - least({SHINGLE}, len(ws)) + 1 AS m FROM (SELECT item_id, {words('text')} AS ws FROM benchmark) WHERE len(ws) > 0),
 owned AS MATERIALIZED (SELECT item_id, k, m, {grams} AS g, count(*) AS n FROM (SELECT *, unnest(range(1, m + 1)) AS i FROM items) GROUP BY ALL),
 docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, {words("coalesce(text, '')")} AS ws FROM documents),
 placed AS (SELECT rid, len(ws) AS size, k, i, {grams} AS g FROM (SELECT rid, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM docs, (SELECT DISTINCT k FROM items))),
 hits AS MATERIALIZED (SELECT rid, size, i, item_id, o.k, m, n, o.g FROM placed p JOIN owned o ON o.k = p.k AND o.g = p.g),
 starts AS (SELECT DISTINCT rid, item_id, unnest(range(greatest(i - m + 1, 1), i + 1)) AS p FROM hits),
 counted AS (SELECT h.rid, h.item_id, p, g, k, m, size, least(count(*), any_value(n)) AS c FROM starts s JOIN hits h ON h.rid = s.rid AND h.item_id = s.item_id AND h.i BETWEEN p AND p + m - 1 GROUP BY ALL),
 valued AS (SELECT rid, item_id, p, CAST(sum(c) AS DOUBLE) / (m + least(m, size - k + 2 - p) - sum(c)) AS value FROM counted GROUP BY rid, item_id, p, m, k, size)
 SELECT doc_id, item_id, max(value) AS similarity, arg_min(p, (-value, p)) - 1 AS first_word FROM valued JOIN docs USING (rid) WHERE value >= {SIMILARITY} GROUP BY rid, doc_id, item_id"""


def lm_score() -> str:
    """Counts, expectation-maximisation over a histogram of the fold, and the mixed score of every text."""
    low, big = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    kind = f"CAST(least(floor(log2({{}} + 1)), {CLASSES - 1}) AS INTEGER)"

    def cell(p: str) -> str:
        return f"CASE WHEN {p} > 0 THEN CAST(least(floor(-log10({p}) / {STEP}), {CELLS - 2}) AS INTEGER) END"

    def middle(c: str) -> str:
        return f"coalesce(pow(10.0, -({c} + 0.5) * {STEP}), 0.0)"

    steps = [f"m0 AS MATERIALIZED (SELECT k, CAST({START[0]} AS DOUBLE) AS a, CAST({START[1]} AS DOUBLE) AS b, CAST({START[2]} AS DOUBLE) AS c FROM (SELECT unnest(range(0, {CLASSES})) AS k))"]
    for i in range(EM_STEPS):
        parts = f"SELECT kind, n * a * ep / t AS pa, n * b * ew / t AS pb, n * c * u / t AS pc FROM (SELECT *, a * ep + b * ew + c * u AS t FROM events JOIN m{i} ON k = kind)"
        sums = f"SELECT k, coalesce(pa, 0) + {START[0]} AS a, coalesce(pb, 0) + {START[1]} AS b, coalesce(pc, 0) + {START[2]} AS c FROM m0 LEFT JOIN (SELECT kind, sum(pa) AS pa, sum(pb) AS pb, sum(pc) AS pc FROM ({parts}) GROUP BY kind) ON kind = k"
        steps.append(f"m{i + 1} AS MATERIALIZED (SELECT k, a / (a + b + c) AS a, b / (a + b + c) AS b, c / (a + b + c) AS c FROM ({sums}))")
    fold_pair = "CASE WHEN wc.n - wc.f > 0 THEN (p.n - p.f) / CAST(wc.n - wc.f AS DOUBLE) ELSE 0 END"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, crc % 7 = 2 AS held_out, crc % 7 = 6 AS fold, list_append(list_transform({_WORDS.format("translate(coalesce(text, ''), '" + big + "', '" + low + "')")}, lambda w: 'w' || w), 'e') AS ts FROM (SELECT *, {CRC32} AS crc FROM documents)),
 tokens AS MATERIALIZED (SELECT rid, held_out, fold, i, ts[i] AS w, CASE WHEN i = 1 THEN 'e' ELSE ts[i - 1] END AS h FROM (SELECT *, unnest(range(1, len(ts) + 1)) AS i FROM docs)),
 words AS MATERIALIZED (SELECT w, count(*) FILTER (NOT held_out) AS n, count(*) FILTER (fold) AS f FROM tokens GROUP BY w),
 pairs AS MATERIALIZED (SELECT h, w, count(*) FILTER (NOT held_out) AS n, count(*) FILTER (fold) AS f FROM tokens GROUP BY h, w),
 sums AS MATERIALIZED (SELECT CAST(sum(n) AS BIGINT) AS total, count(*) FILTER (n > 0) AS types, CAST(sum(n) - sum(f) AS DOUBLE) AS rest FROM words),
 events AS MATERIALIZED (SELECT kind, {middle('cp')} AS ep, {middle('cw')} AS ew, 1.0 / (types + 1) AS u, count(*) AS n FROM (
 SELECT {kind.format('(wc.n - wc.f)')} AS kind, {cell(fold_pair)} AS cp, {cell('((ww.n - ww.f) / greatest(rest, 1))')} AS cw, types FROM tokens t JOIN words wc ON wc.w = t.h JOIN words ww ON ww.w = t.w JOIN pairs p ON p.h = t.h AND p.w = t.w, sums WHERE fold) GROUP BY kind, cp, cw, types),
 {', '.join(steps)},
 known AS (SELECT t.rid, ww.n AS c, log10(a * CASE WHEN wc.n > 0 THEN p.n / CAST(wc.n AS DOUBLE) ELSE 0 END + b * (ww.n / greatest(CAST(total AS DOUBLE), 1)) + m{EM_STEPS}.c / (types + 1)) AS s, total, types
 FROM tokens t JOIN words wc ON wc.w = t.h JOIN words ww ON ww.w = t.w JOIN pairs p ON p.h = t.h AND p.w = t.w JOIN m{EM_STEPS} ON k = {kind.format('wc.n')}, sums),
 scored AS (SELECT rid, count(*) AS n_tokens, count(*) FILTER (c > 0) AS n_known, any_value(total) AS train_tokens, sum(log10(c + 1)) - count(*) * log10(any_value(total + types + 1)) AS base_score, sum(s) AS score FROM known GROUP BY rid)
 SELECT doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score FROM docs JOIN scored USING (rid)"""


def secret_scan() -> str:
    """Spans of the patterns by what stands between matches, and joined high-entropy windows of candidate strings."""
    patterns = {0: r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 1: "AKIA[A-Z0-9]+", 2: "[0-9a-f]{16,}", 3: "[A-Za-z0-9+/_-]{20,}"}
    least = {0: "length(g) >= 12", 1: "length(m) >= 18", 2: "true", 3: "true"}

    def matches(kind: int) -> str:
        p = patterns[kind]
        groups = f"regexp_extract_all(text, '{p}', 2)" if kind == 0 else "ms"
        begin = "list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0)"
        lists = f"SELECT rid, text, ms, regexp_split_to_array(text, '{p}') AS ps, {groups} AS gs FROM (SELECT rid, text, regexp_extract_all(text, '{p}') AS ms FROM docs)"
        return f"SELECT rid, {kind} AS k, CAST(a AS BIGINT) AS a, CAST(a + length(m) AS BIGINT) AS b, m FROM (SELECT rid, ms[i] AS m, gs[i] AS g, {begin} AS a FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM ({lists}))) WHERE {least[kind]}"

    windows = " UNION ALL ".join(
        f"SELECT rid, a, m, {n} AS kind, p - 1 AS s, p - 1 + {c.window} AS e FROM (SELECT *, unnest(range(1, length(m) - {c.window} + 2)) AS p FROM candidates) WHERE regexp_full_match(substr(m, p, {c.window}), '[{'0-9a-fA-F' if n == 0 else '0-9a-zA-Z+/_-'}]+') AND list_aggregate(string_split(substr(m, p, {c.window}), ''), 'entropy') >= {c.bits - 1e-10!r}"
        for n, c in enumerate(CLASSES_OF_SECRETS)
    )
    allowed = "|".join(f"(?:{p})" for p in ALLOWED)
    name = "CASE k WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'entropy' END"
    shown = f"string_agg({name} || ':' || a || ':' || b, ',' ORDER BY a, k)"
    return f"""WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
 base AS MATERIALIZED (SELECT rid, k, a, b FROM ({" UNION ALL ".join(matches(k) for k in (0, 1, 2))})),
 candidates AS MATERIALIZED (SELECT rid, a, m FROM ({matches(3)}) WHERE regexp_matches(m, '[0-9]') AND NOT regexp_full_match(m, '{allowed}')),
 windows AS ({windows}),
 starts AS (SELECT *, s > coalesce(max(e) OVER (PARTITION BY rid, a, kind ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM windows),
 runs AS (SELECT rid, a, any_value(m) AS m, min(s) AS s, max(e) AS e FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid, a, kind ORDER BY s) AS run FROM starts) GROUP BY rid, a, kind, run),
 found AS (SELECT DISTINCT rid, a + s AS a, a + e AS b FROM runs WHERE regexp_matches(substr(m, s + 1, e - s), '[0-9]') AND regexp_matches(substr(m, s + 1, e - s), '[A-Za-z]')),
 bare AS (SELECT DISTINCT rid, a, b FROM (SELECT *, unnest(range(a, b)) AS p FROM found) f WHERE NOT EXISTS (SELECT 1 FROM base WHERE base.rid = f.rid AND f.p >= base.a AND f.p < base.b)),
 opened AS (SELECT *, a >= coalesce(max(b) OVER (PARTITION BY rid ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS fresh FROM bare),
 extra AS (SELECT rid, 3 AS k, min(a) AS a, max(b) AS b FROM (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY rid ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS run FROM opened) GROUP BY rid, run),
 every AS (SELECT rid, k, a, b FROM base UNION ALL SELECT rid, k, a, b FROM extra),
 told AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, count(*) FILTER (k = 3) AS n_entropy, {shown.replace("ORDER BY a, k)", "ORDER BY a, k) FILTER (k < 3)")} AS plain, {shown} AS spans FROM every GROUP BY rid)
 SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy, sha256(coalesce(plain, '')) AS base_sha256, coalesce(spans, '') AS spans FROM docs LEFT JOIN told USING (rid)"""


def spelling_variants() -> str:
    """Letter runs with one letter left out of every 97th, and the edit distances of all pairs of words.

    Edit distances are of bytes there, so the 64 letters beyond ASCII stand as ASCII characters that no word has.
    """
    beyond = "".join(map(chr, range(0xC0, 0x100)))
    free = [c for c in map(chr, range(33, 127)) if not c.islower() and c not in "'\\"]
    plain = f"translate({{}}, '{beyond}', '{''.join(free[:60])}' || '{''.join(map(chr, (1, 2, 3, 4)))}')"
    checksum = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, CAST(length(bytes) / 2 AS BIGINT) + 1),
 lambda i: [CAST('0x' || bytes[2 * i - 1:2 * i] AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))), lambda a, x: xor(xor(a, x) >> 1, (xor(a, x) & 1) * 3988292384)), CAST(4294967295 AS BIGINT))"""
    return f"""WITH RECURSIVE found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
 runs AS MATERIALIZED (SELECT run, hex(encode(id || ':' || run)) AS bytes, count(*) AS n FROM found WHERE length(run) >= 5 GROUP BY id, run),
 summed AS MATERIALIZED (SELECT run, n, {checksum} AS h FROM runs),
 words AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n, {plain.format('word')} AS plain, length(word) AS size
 FROM (SELECT n, CASE WHEN h % 97 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM summed) WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
 pairs AS MATERIALIZED (SELECT a.word AS a, b.word AS b, a.n AS an, b.n AS bn FROM words a JOIN words b ON b.size = a.size AND a.plain < b.plain WHERE levenshtein(a.plain, b.plain) = 1
 UNION ALL SELECT a.word, b.word, a.n, b.n FROM words a JOIN words b ON b.size = a.size + 1 WHERE levenshtein(a.plain, b.plain) = 1),
 near AS (SELECT a AS word, b AS form, bn AS n FROM pairs UNION ALL SELECT b, a, an FROM pairs),
 best AS MATERIALIZED (SELECT word, first(form ORDER BY n DESC, form) AS form, max(n) AS form_n, count(*) AS n_near FROM near GROUP BY word),
 seen AS MATERIALIZED (SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * words.n THEN form END AS form, CASE WHEN form_n >= 2 * words.n THEN form_n END AS form_n FROM words LEFT JOIN best USING (word)),
 walk AS (SELECT word, word AS root FROM seen UNION ALL SELECT walk.word, seen.form FROM walk JOIN seen ON seen.word = walk.root WHERE seen.form IS NOT NULL),
 last AS (SELECT walk.word, walk.root FROM walk JOIN seen ON seen.word = walk.root WHERE seen.form IS NULL)
 SELECT word, form, root, n, n_near, form_n FROM seen JOIN last USING (word)"""
