"""Whole-batch text handling in numpy: words, word hashes and n-gram hashes.

A batch of texts is one UTF-8 byte array. Word boundaries come from a lookup table
and word hashes from one running polynomial sum modulo 2**64, so no Python loop
touches single words. Large batches are cut into chunks of a few MB of text, which
bounds the memory of a task whatever the number of rows in an Arrow batch; a text
is never cut.
"""

from __future__ import annotations

import ctypes
import hashlib
import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Bytes of text that one chunk holds at most, unless a single text is longer.
CHUNK_BYTES = 1 << 20
#: Bytes of a single long text whose words are found at a time.
SLICE_BYTES = 4 << 20
#: Longer words are hashed by blake2b: modulo a power of two, sums of powers clash for long words of some patterns.
LONG_WORD = 64

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def once_per_process(key: object, make: Callable[[], Any]) -> Any:
    """``make()``, kept for later tasks of this Python worker (functions sent by value have no lasting globals)."""
    home = sys.modules.setdefault("_barline_kept", types.ModuleType("_barline_kept")).__dict__
    if key not in home:
        home[key] = make()
    return home[key]


def release_memory() -> None:
    """Hands freed memory back to the system, so that idle Python workers of an executor stay small."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not glibc
        pass


def lean(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``work`` over the batches of a task, then ``release_memory``."""

    def run(batches: Iterator) -> Iterator:
        try:
            yield from work(batches)
        finally:
            release_memory()

    return run


def lean_group(work: Callable) -> Callable:
    """``work`` over one group, then ``release_memory``."""

    def run(group):
        try:
            return work(group)
        finally:
            release_memory()

    return run


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of uint64 values (the public splitmix64 finaliser)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def space_table(separators: bytes = b" \t\n\v\f\r") -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(separators, np.uint8)] = True
    return table


SPACES = space_table()
#: A fixed random value for each byte, and the same with A-Z folded to a-z.
BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
LOWER_VALUES = BYTE_VALUES[LOWER]


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    kept = once_per_process("powers", dict)
    have = kept.get(base)
    if have is None or len(have) < n:
        have = np.full(-(-max(n, 1) // 65536) * 65536, base, np.uint64)
        have[0] = 1
        have = np.cumprod(have, dtype=np.uint64)
        if n <= 16 * CHUNK_BYTES:  # those for a very long text are not held
            kept[base] = have
    return have[:n]


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts end to end, and where each starts (nulls: empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold up to ``limit`` bytes of text together."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, "right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def folded(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals from U+00C0 to U+00DE (two bytes, the first 0xC3) as small letters."""
    data = LOWER[data]
    second = np.flatnonzero(data[:-1] == 0xC3) + 1
    second = second[(data[second] >= 0x80) & (data[second] <= 0x9E) & (data[second] != 0x97)]
    data[second] += 0x20
    return data


def next_gap(data: np.ndarray, begin: int, spaces: np.ndarray) -> int:
    """How far the next separator is from ``begin``, or the rest of the data."""
    for at in range(begin, len(data), SLICE_BYTES):
        found = np.flatnonzero(spaces[data[at : at + SLICE_BYTES]])
        if len(found):
            return at + int(found[0]) - begin
    return len(data) - begin


class Words:
    """Words of consecutive texts: byte bounds, 64-bit hashes, and rows as ranges of words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, values=BYTE_VALUES, spaces=SPACES):
        self.data = data
        parts, begin = [], 0
        while begin < len(data):
            end = begin + SLICE_BYTES
            if end < len(data):  # slices end where words do, so that a very long text needs no more memory than a slice
                end += next_gap(data, end, spaces)
            end = min(end, len(data))
            inside = offsets[np.searchsorted(offsets, begin) : np.searchsorted(offsets, end, "right")] - begin
            parts.append([x + y for x, y in zip(self._found(data[begin:end], inside, values, spaces), (begin, begin, np.uint64(0)))])
            begin = end
        self.starts, self.ends, self.hashes = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))
        #: Row i has the words row_at[i] up to row_at[i + 1].
        self.row_at = np.searchsorted(self.starts, offsets)

    @staticmethod
    def _found(data: np.ndarray, offsets: np.ndarray, values: np.ndarray, spaces: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = len(data)
        solid = ~spaces[data]
        first = np.zeros(n + 1, bool)
        first[offsets] = True
        before = np.empty(n, bool)
        before[:1] = True
        before[1:] = ~solid[:-1]
        after = np.empty(n, bool)
        after[-1:] = True
        after[:-1] = ~solid[1:]
        starts = np.flatnonzero(solid & (before | first[:-1]))
        ends = np.flatnonzero(solid & (after | first[1:])) + 1
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(values[data] * powers(_BASE, n), out=total[1:])
        hashes = mix((total[ends] - total[starts]) * powers(_INVERSE, n + 1)[starts])
        folds = np.array_equal(values[65:91], values[97:123])
        for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            word = LOWER[data[starts[i] : ends[i]]] if folds else data[starts[i] : ends[i]]
            hashes[i] = int.from_bytes(hashlib.blake2b(word.tobytes(), digest_size=8).digest(), "little")
        return starts, ends, hashes

    @property
    def per_row(self) -> np.ndarray:
        return np.diff(self.row_at)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.row_at) - 1), self.per_row)


def words_in_chunks(texts: pa.Array, values=BYTE_VALUES, spaces=SPACES, limit: int = CHUNK_BYTES, fold: bool = False) -> Iterator[tuple[int, int, Words]]:
    data, offsets = utf8(texts)
    data = folded(data) if fold else data
    for first, last in chunks(offsets, limit):
        yield first, last, Words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], values, spaces)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n consecutive items; runs across rows are for the caller to leave out."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        total += hashes[i : len(hashes) - n + 1 + i] * np.uint64(pow(_BASE, 2 * i + 1, 1 << 64))
    return mix(total)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every range, end to end."""
    total = int(lengths.sum())
    shift = starts - (np.cumsum(lengths) - lengths)
    return np.repeat(shift, lengths) + np.arange(total)
