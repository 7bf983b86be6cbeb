"""Words and n-grams of whole Arrow batches, as numpy arrays over UTF-8 bytes.

All word classes used by the operators are ASCII classes, so bytes and code points
agree about where a word starts and ends.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
#: Words `[^\x20\x09-\x0D]+`.
SPACED = ~_SPACE
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lower-cased.
ALNUM = np.ones(256, bool)
ALNUM[0x00:0x30] = ALNUM[0x3A:0x41] = ALNUM[0x5B:0x61] = ALNUM[0x7B:0x80] = False

#: Byte to its lower case, A-Z only.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD1342543DE82EF95)
_BASE_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
_GRAM = np.uint64(0xA0761D6478BD642F)
_powers = np.ones(1, np.uint64)
_inverse = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_EXACT = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _EXACT[LOWER]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = 1 << (int(n) - 1).bit_length()
        both = []
        for base in (_BASE, _BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            both.append(np.multiply.accumulate(steps))
        _powers, _inverse = both
    return _powers, _inverse


Run = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: What operators keep in a worker from task to task, each with what drops it.
KEPT: dict[str, Callable[[], None]] = {}


def give_back() -> None:
    """Return to the system what Arrow's and C's allocators hold but don't use."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run: Run, owner: str = "") -> Run:
    """``run`` in a worker that other operators use too: it drops what they keep before, and gives back unused memory after a task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, drop in KEPT.items():
            if name != owner:
                drop()
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidy


def text_last(run: Run, columns: list[str], name: str, text_col: str = "text") -> Run:
    """``run``, which takes its last column as texts, for batches of ``columns``; the texts come as one column and are seen as two."""
    k = columns.index(text_col)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(pa.RecordBatch.from_arrays([*b.columns, b.column(k)], [*b.schema.names, name]) for b in batches)

    return seen


def free(columns: Iterable[str], name: str) -> str:
    """A column name like ``name`` that none of ``columns`` has, in any case of letters."""
    taken = {c.lower() for c in columns}
    while (name := f"_{name}").lower() in taken:
        pass
    return name


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts one after another, and where each begins; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The batch in runs of texts of about ``most`` bytes: first row, bytes, offsets."""
    data, offsets = flat(texts)
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def spans(data: np.ndarray, offsets: np.ndarray, word: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words, and for each text the number of its first word."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    inside = word[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:-1]
    end = inside.copy()
    end[:-1] &= ~inside[1:] | cut[1:-1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span; the spans are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    table, at = (_FOLDED if fold else _EXACT), 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + BLOCK_BYTES, "right")))
        low = int(starts[at])
        part = data[low : int(ends[to - 1])]
        powers, inverse = _power_tables(len(part))
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(table[part] * powers[: len(part)], out=sums[1:])
        a, b = starts[at:to] - low, ends[at:to] - low
        out[at:to] = mix((sums[b] - sums[a]) * inverse[a] + (b - a).astype(np.uint64) * _ODD)
        at = to
    return out


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words, without regard to where texts end."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = hashes[: len(hashes) - n + 1].copy()
    for k in range(1, n):
        out *= _GRAM
        out += hashes[k : len(hashes) - n + 1 + k]
    return mix(out)
