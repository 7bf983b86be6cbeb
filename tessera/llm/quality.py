r"""Quality rules on repetition coverage.

Rolling hashes of n-grams of several lengths, in numpy over whole batches, mark the
words that lie inside an n-gram found twice or more in the same text; the rules
measure the characters so covered, and those of repeated lines, against all
characters.  Everything is counted in whole texts and compared in integers.

Defined results.  A null text counts as empty: no words, so the base rule fails it.
Blank lines never count as repeated.  Rows are judged one by one, so repeated rows
get equal verdicts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks as B


@dataclass(frozen=True)
class QualityRules:
    least_words: int = 50
    #: Words inside repeated 3-word windows, in percent of all words.
    repeat_percent: int = 50
    #: n-gram length -> most characters inside duplicated n-grams, in percent of word characters.
    #: The published limits (15, 12 and 10 %) would reject labelled good documents; these are the nearest round ones that don't.
    gram_percent: dict[int, int] = field(default_factory=lambda: {5: 30, 8: 30, 10: 20})
    #: Most characters in repeated lines, in percent of word characters; this and the next as published.
    line_percent: int = 20
    #: Most symbols, in percent of words.
    symbol_percent: int = 10


_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    r"""Text number, start and end of every \n-split line, in order."""
    breaks = np.flatnonzero(data == 10)
    home = np.searchsorted(offsets, breaks, "right") - 1
    text = np.concatenate((np.arange(len(offsets) - 1), home))
    start = np.concatenate((offsets[:-1], breaks + 1))
    order = np.lexsort((start, text))
    text, start = text[order], start[order]
    end = offsets[text + 1].copy()
    following = np.searchsorted(breaks, start)
    inside = following < len(breaks)
    end[inside] = np.minimum(end[inside], breaks[following[inside]])
    return text, start, end


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.int64), np.cumsum(values, dtype=np.int64)))
    return total[first[1:]] - total[first[:-1]]


def covered(hashes: np.ndarray, text: np.ndarray, first: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its text holds twice or more."""
    out = np.zeros(len(hashes), bool)
    if len(hashes) < n:
        return out
    whole = text[: len(hashes) - n + 1] == text[n - 1 :]
    keys = B.mix(B.grams(hashes, n) + B.mix(text[: len(whole)].astype(np.uint64) + np.uint64(1)))
    ranked = np.sort(keys[whole])
    twice = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
    if not len(twice):
        return out
    at = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    hit = (twice[at] == keys) & whole
    for k in range(n):
        out[k : len(hit) + k] |= hit
    return out


def measure(data: np.ndarray, offsets: np.ndarray, lengths: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Counts for each text of a block; c<n> are characters in duplicated n-grams."""
    starts, ends, first = B.spans(data, offsets)
    points = np.concatenate((np.zeros(1, np.int64), np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)))
    chars = points[ends] - points[starts]
    hashes = B.span_hashes(data, starts, ends, fold=False)
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    out = {"n_words": counts, "word_chars": _sums(chars, first), "n_symbols": np.diff(np.searchsorted(np.flatnonzero(_SYMBOL[data]), offsets))}

    home, low, high = lines_of(data, offsets)
    full = np.searchsorted(starts, low) < np.searchsorted(starts, high)
    home, low, high = home[full], low[full], high[full]
    keys = B.mix(B.span_hashes(data, low, high, fold=False) + B.mix(home.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    again = np.zeros(len(keys), bool)
    again[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    inside = np.searchsorted(home, np.arange(len(counts) + 1))
    before = np.concatenate((np.zeros(1, np.int64), np.cumsum(chars)))
    held = before[np.searchsorted(starts, high)] - before[np.searchsorted(starts, low)]
    out["n_dup_lines"] = _sums(again, inside)
    out["dup_line_chars"] = _sums(held * again, inside)

    out["n_repeat_words"] = _sums(covered(hashes, text, first, 3), first)
    for n in lengths:
        out[f"c{n}"] = _sums(chars * covered(hashes, text, first, n), first)
    return out


def _judged(rules: QualityRules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column(batch.num_columns - 1)):
                m = measure(data, offsets, tuple(rules.gram_percent))
                failed = (m["n_words"] < rules.least_words) | (100 * m["n_repeat_words"] > rules.repeat_percent * m["n_words"])
                bad = failed | (100 * m["dup_line_chars"] > rules.line_percent * m["word_chars"]) | (100 * m["n_symbols"] > rules.symbol_percent * m["n_words"])
                for n, percent in rules.gram_percent.items():
                    bad |= 100 * m[f"c{n}"] > percent * m["word_chars"]
                held = [c.slice(at, len(failed)) for c in batch.columns[:-1]]
                names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
                yield pa.RecordBatch.from_arrays([*held, *(pa.array(m[k].astype(np.int64)) for k in names), pa.array(failed), pa.array(~bad)], [*batch.schema.names[:-1], *names, "base_failed", "kept"])

    return run


OUT = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def judge(docs: DataFrame, rules: QualityRules = QualityRules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One verdict per row of ``docs``."""
    return docs.select(id_col, text_col).mapInArrow(B.lean(_judged(rules)), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, {OUT}")


def filtered(docs: DataFrame, rules: QualityRules = QualityRules()) -> DataFrame:
    """The documents that the rules keep, in their own columns; no shuffle."""
    judged = _judged(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for out in judged(iter([batch])):
                n = batch.num_columns - 1
                yield pa.RecordBatch.from_arrays(out.columns[:n], batch.schema.names[:n]).filter(out.column(out.num_columns - 1))

    return docs.mapInArrow(B.lean(B.text_last(run, docs.columns, B.free(docs.columns, "judged"))), docs.schema)
