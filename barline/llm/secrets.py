"""Secret scanning: patterned secrets plus high-entropy strings.

Three fixed patterns give the base spans. The method then looks at candidate
strings (runs of base64-like characters). For each character class a window slides
over the runs of that class; its Shannon entropy follows from character counts
that change by one in and one out per step. Windows above the class's threshold
are joined to spans. An allow-list suppresses identifiers that are no secrets:
numbers, words and paths without figures (so a random string of letters alone is
none), UUIDs, dates and words joined by marks. Of spans of this kind that overlap,
one is made; those that base spans cover whole are not repeated, those that they
cover in part stay whole.

Defined cases: a null text is an empty one and has no spans; repeated rows each
get their own result; an empty table gives an empty result; positions are code
points with exclusive ends; only the two named columns are read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from barline.llm import arrays

KINDS = ("assign", "access", "hex", "entropy")

# Fixed patterns of the base.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"

#: A run begins wherever its class begins, so also right after '=' or any other character outside the class.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"


@dataclass(frozen=True)
class EntropyClass:
    """Windows of ``window`` characters of ``alphabet`` with ``bits`` of entropy or more are suspect."""

    name: str
    alphabet: str
    window: int
    bits: float


CLASSES = (
    EntropyClass("hexadecimal", "0123456789abcdefABCDEF", 24, 3.0),
    EntropyClass("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 20, 3.75),
)

#: Candidates that match one of these in full are no secrets.
ALLOWED = (
    r"[0-9]+",
    r"[A-Za-z]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9A-Za-z_-]*",
    r"(?:[A-Za-z]+[-_/+])+[A-Za-z]*",
    r"(?:/[A-Za-z_.-]+)+/?[0-9]*",
)


def suspect_windows(text: str, alphabet: frozenset[str], window: int, bits: float) -> Iterator[tuple[int, int]]:
    """Joined windows of characters of one class whose entropy reaches ``bits``."""
    gain = [0.0] + [n * math.log2(n) for n in range(1, window + 2)]  # a step first adds, then takes away
    least = (math.log2(window) - bits) * window  # entropy >= bits exactly if sum(n log n) <= least
    counts: dict[str, int] = {}
    total, run, begin, end = 0.0, 0, -1, -1
    for i, c in enumerate(text):
        if c not in alphabet:
            counts, total, run = {}, 0.0, 0
            continue
        n = counts.get(c, 0)
        counts[c] = n + 1
        total += gain[n + 1] - gain[n]
        run += 1
        if run > window:
            gone = text[i - window]
            n = counts[gone]
            counts[gone] = n - 1
            total += gain[n - 1] - gain[n]
        if run >= window and total <= least + 1e-9:
            if i - window + 1 > end:
                if end >= 0:
                    yield begin, end
                begin = i - window + 1
            end = i + 1
    if end >= 0:
        yield begin, end


class Scanner:
    def __init__(self, classes: Iterable[EntropyClass] = CLASSES, allowed: Iterable[str] = ALLOWED):
        self.assign, self.access, self.hex = (re.compile(p, re.ASCII) for p in (ASSIGN, ACCESS, HEX))
        self.candidate = re.compile(CANDIDATE, re.ASCII)
        self.allowed = re.compile("|".join(f"(?:{p})" for p in allowed), re.ASCII)
        self.classes = [(frozenset(c.alphabet), c.window, c.bits) for c in classes]

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the patterned secrets."""
        found = [(m.start(), 0, m.end()) for m in self.assign.finditer(text) if m.end(2) - m.start(2) >= 12] if ":" in text or "=" in text else []
        if "AKIA" in text:
            found += [(m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= 18]
        found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text)]
        return sorted(found)

    def extra(self, text: str, covered: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        found = set()
        for m in self.candidate.finditer(text):
            word = m.group()
            if self.allowed.fullmatch(word) or not any(c.isdigit() for c in word):
                continue
            for alphabet, window, bits in self.classes:
                for a, b in suspect_windows(word, alphabet, window, bits):
                    part = word[a:b]
                    if any(c.isdigit() for c in part) and any(c.isalpha() for c in part):
                        found.add((m.start() + a, 3, m.start() + b))
        together: list[tuple[int, int]] = []  # base spans that touch or overlap, as one
        for x, _, y in covered:
            if together and x <= together[-1][1]:
                together[-1] = (together[-1][0], max(y, together[-1][1]))
            else:
                together.append((x, y))
        spans: list[tuple[int, int, int]] = []
        at = 0
        for a, k, b in sorted(found):  # both lists rise, so one sweep meets them
            while at < len(together) and together[at][1] <= a:
                at += 1
            if at < len(together) and together[at][0] <= a and together[at][1] >= b:
                continue
            if spans and a < spans[-1][2]:
                spans[-1] = (spans[-1][0], k, max(b, spans[-1][2]))
            else:
                spans.append((a, k, b))
        return spans


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


OUT = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, classes: tuple[EntropyClass, ...] = CLASSES, allowed: tuple[str, ...] = ALLOWED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: counts by kind, a digest of the base spans, and all spans as ``kind:start:end``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(classes, allowed)
        for batch in batches:
            rows: list[tuple] = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = text.as_py() or ""
                base = scanner.base(text)
                extra = scanner.extra(text, base)
                n = [sum(1 for _, k, _ in base if k == i) for i in range(3)]
                rows.append((key, *n, len(extra), hashlib.sha256(joined(base).encode()).hexdigest(), joined(sorted(base + extra))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(OUT), OUT)], schema=OUT)

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(arrays.lean(run), "doc_id long, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string")
