r"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become words of letters and digits, A-Z lower-cased, so
punctuation and case don't hide a passage.  Runs of ``least`` words that a text shares
with an item seed matches (Karp-Rabin hashes, compared with the hashes of the single
words); greedy tiling then marks the longest match that is still free, again and
again, until none of ``least`` words is left.  Tiles don't overlap and may come in any
order, so reordered passages are caught.  A text is contaminated by an item when
tiles cover at least ``percent`` of the item's words.

Before tiling, a pair must share so many different seeds that the threshold can be
reached at all (every tile of length t brings t - least + 1 of them), so a common line
costs no tiling.

The benchmark is sent to all tasks only in blocks whose size is checked: it is cut by
a hash of its rows into as many blocks as it takes to stay under ``block_bytes``, and
the texts are read once per block.  Nothing is shuffled but the hits of several blocks,
which name the rows that leave by id and text.

Defined results.  Null and empty texts are clean.  An item of fewer than ``least`` words
is contained in a text only if the text has just its words; items without words are no
evidence.  Rows are judged one by one; equal items both count.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks as B
from .store import Workspace


@dataclass(frozen=True)
class Tiling:
    least: int = 5
    percent: int = 50
    #: Most bytes of benchmark text that are sent to all tasks at once.
    block_bytes: int = 16 << 20


def words_of(texts: pa.Array) -> list[np.ndarray]:
    """The word hashes of each text."""
    out = []
    for _, data, offsets in B.blocks(texts):
        starts, ends, first = B.spans(B.LOWER[data], offsets, B.ALNUM)
        hashes = B.span_hashes(data, starts, ends, fold=True)
        out += [hashes[a:b] for a, b in zip(first[:-1], first[1:], strict=True)]
    return out


def tiles(item: np.ndarray, text: np.ndarray, pairs: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling from seeds (position in item, position in text): tiles (item, text, length)."""
    diagonal = pairs[:, 1] - pairs[:, 0]
    order = np.lexsort((pairs[:, 0], diagonal))
    i, d = pairs[order, 0], diagonal[order]
    new = np.ones(len(i), bool)
    new[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], len(i))
    heap = []
    for a, b in zip(begin.tolist(), end.tolist(), strict=True):
        x, n = int(i[a]), b - a + least - 1
        y = x + int(d[a])
        if np.array_equal(item[x : x + n], text[y : y + n]):
            heap.append((-n, x, y))
    heapq.heapify(heap)
    used_item, used_text = np.zeros(len(item), bool), np.zeros(len(text), bool)
    out = []
    while heap:
        n, x, y = heapq.heappop(heap)
        n = -n
        taken = used_item[x : x + n] | used_text[y : y + n]
        if not taken.any():
            used_item[x : x + n] = used_text[y : y + n] = True
            out.append((x, y, n))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], taken, [True]))))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= least:
                heapq.heappush(heap, (a - b, x + a, y + a))
    return out


class Seeds:
    """All runs of ``least`` words of a block of items, with a bitmap before the search."""

    BITS = 22

    def __init__(self, items: list[tuple[object, np.ndarray]], p: Tiling) -> None:
        self.items, self.p = items, p
        parts = [(B.grams(w, p.least), np.full(max(0, len(w) - p.least + 1), k)) for k, (_, w) in enumerate(items)]
        grams = np.concatenate([g for g, _ in parts] or [np.zeros(0, np.uint64)])
        owner = np.concatenate([o for _, o in parts] or [np.zeros(0, np.int64)])
        place = np.concatenate([np.arange(len(g)) for g, _ in parts] or [np.zeros(0, np.int64)])
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner, self.place = grams[order], owner[order], place[order]
        self.map = np.zeros(1 << self.BITS, bool)
        self.map[self.grams >> np.uint64(64 - self.BITS)] = True
        #: Items too short for a seed, by their words.
        self.short: dict[bytes, list[object]] = {}
        for name, w in items:
            if 0 < len(w) < p.least:
                self.short.setdefault(w.tobytes(), []).append(name)
        #: Different seeds without which an item can't be covered.
        self.least = [math.ceil(math.ceil(p.percent * len(w) / 100) / p.least) for _, w in items]

    def hits(self, text: np.ndarray, runs: np.ndarray) -> list[tuple[object, int, int]]:
        """Items that the text contains: id, words covered, words of the item."""
        if len(text) < self.p.least:
            return [(name, len(text), len(text)) for name in self.short.get(text.tobytes(), ())] if len(text) else []
        near = np.flatnonzero(self.map[runs >> np.uint64(64 - self.BITS)])
        if not len(near):
            return []
        low = np.searchsorted(self.grams, runs[near], "left")
        many = np.searchsorted(self.grams, runs[near], "right") - low
        near, low, many = near[many > 0], low[many > 0], many[many > 0]
        if not len(near):
            return []
        at = np.repeat(low - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        owner, pairs = self.owner[at], np.stack((self.place[at], np.repeat(near, many)), 1)
        out = []
        order = np.argsort(owner, kind="stable")
        owner, pairs = owner[order], pairs[order]
        for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner)) + 1):
            k = int(owner[part[0]])
            name, item = self.items[k]
            if len(np.unique(pairs[part, 0])) < self.least[k]:
                continue
            covered = sum(n for _, _, n in tiles(item, text, pairs[part], self.p.least))
            if 100 * covered >= self.p.percent * len(item):
                out.append((name, covered, len(item)))
        return out


@lru_cache(maxsize=2)
def _seeds(rows: tuple[tuple[object, str], ...], p: Tiling) -> Seeds:
    """The seeds of a block, made once in a worker."""
    words = words_of(pa.array([t for _, t in rows], pa.string()))
    return Seeds([(i, w) for (i, _), w in zip(rows, words, strict=True)], p)


def _found(rows: list[tuple[object, str]], p: Tiling, whole: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seeds = _seeds(tuple(rows), p)
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column(batch.num_columns - 1)):
                starts, ends, first = B.spans(B.LOWER[data], offsets, B.ALNUM)
                hashes = B.span_hashes(data, starts, ends, fold=True)
                runs = B.grams(hashes, p.least)
                found = [sorted(seeds.hits(hashes[a:b], runs[a : max(a, b - p.least + 1)]), key=str) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                held = pa.RecordBatch.from_arrays([c.slice(at, len(found)) for c in batch.columns[:-1]], batch.schema.names[:-1])
                if whole:
                    yield held.filter(pa.array([not f for f in found]))
                else:
                    hits = pa.array([[{"item": i, "covered": c, "words": n} for i, c, n in f] for f in found], pa.list_(pa.struct([("item", pa.int64()), ("covered", pa.int64()), ("words", pa.int64())])))
                    yield pa.RecordBatch.from_arrays([*held.columns, hits], [*held.schema.names, "hits"])

    return run


def benchmark_blocks(benchmark: DataFrame, p: Tiling, id_col: str = "item_id", text_col: str = "text") -> tuple[int, Iterator[list[tuple[int, str]]]]:
    """The benchmark in blocks of checked size, each collected when its turn comes."""
    rows = benchmark.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    size = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, math.ceil(2 * size / p.block_bytes)) if size > p.block_bytes else 1
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n))
    return n, ([(r.i, r.t) for r in part.collect()] for part in parts)


def _verdict(hits: DataFrame, id_col: str) -> DataFrame:
    best = F.coalesce(F.array_max(F.transform("hits", lambda h: F.floor(100 * h["covered"] / h["words"]))), F.lit(0))
    return hits.select(
        F.col("id").alias(id_col), F.size("hits").cast("long").alias("n_items"), F.array_sort(F.array_distinct(F.col("hits.item"))).alias("items"),
        best.cast("long").alias("best_percent"), (F.size("hits") > 0).alias("contaminated"), (F.size("hits") == 0).alias("kept"),
    )


def contaminated(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, p: Tiling = Tiling(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, n_items, items, best_percent, contaminated, kept."""
    hit = "hits array<struct<item bigint, covered bigint, words bigint>>"
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n, blocks = benchmark_blocks(benchmark, p)
    if n == 1:
        return _verdict(rows.mapInArrow(B.lean(_found(next(blocks), p, False)), f"id {kind}, {hit}"), id_col)
    with Workspace(spark) as ws:
        keyed = rows.select("id", F.xxhash64("text").alias("key"), "text")
        parts = [ws.table(keyed.mapInArrow(B.lean(_found(block, p, False)), f"id {kind}, key long, {hit}").where("size(hits) > 0")) for block in blocks]
        every = reduce(DataFrame.union, parts).groupBy(F.col("id").alias("i"), F.col("key").alias("k")).agg(F.flatten(F.collect_set("hits")).alias("hits"))
        met = keyed.join(every, keyed["id"].eqNullSafe(every["i"]) & (keyed["key"] == every["k"]), "left")
        return ws.result(_verdict(met.select("id", F.coalesce("hits", F.array()).alias("hits")), id_col))


def clean(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, p: Tiling = Tiling()) -> DataFrame:
    """The documents that no item contaminates, in their own columns.

    One block needs no shuffle.  Of several, each is read past all texts and writes the
    rows that it hits, and one anti-join removes them in the end.
    """
    n, blocks = benchmark_blocks(benchmark, p)
    if n == 1:
        return docs.mapInArrow(B.lean(B.text_last(_found(next(blocks), p, True), docs.columns, B.free(docs.columns, "tiled"))), docs.schema)
    kind, (gone, key) = docs.schema["doc_id"].dataType.simpleString(), (B.free(docs.columns, x) for x in ("gone", "gone_key"))
    with Workspace(spark) as ws:
        rows = docs.select(F.col("doc_id").alias("id"), F.xxhash64("text").alias("key"), "text")
        hit = "hits array<struct<item bigint, covered bigint, words bigint>>"
        parts = [ws.table(rows.mapInArrow(B.lean(_found(block, p, False)), f"id {kind}, key long, {hit}").where("size(hits) > 0").select("id", "key").distinct()) for block in blocks]
        marks = ws.result(reduce(DataFrame.union, parts).distinct().select(F.col("id").alias(gone), F.col("key").alias(key)))
    return docs.join(marks, docs["doc_id"].eqNullSafe(marks[gone]) & (F.xxhash64(docs["text"]) == marks[key]), "left_anti")
