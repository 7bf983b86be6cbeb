r"""Byte-level BPE encoding and decoding under a given table of ranks.

A text is split by the tokenizer's pattern; each match is merged by itself.  A
segment tree over the byte positions of a match stores the leftmost smallest rank
among adjacent live pairs: its root names the next merge, and a merge updates three
leaves (the merged pair, its left neighbour, the pair that vanished), each in a
logarithmic number of steps.  Short matches share one array of trees, so that one
step merges a pair in each of them; long ones have a tree of their own.  Encoded
matches are remembered in a table of bounded size.

Defined results.  A null text counts as empty and has no tokens.  Very long texts
are encoded in runs of matches, with digests carried along.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from . import blocks as B

#: Matches remembered by a worker and their characters with their ids; the table is turned over beyond
#: either, so a worker holds two such tables and what one run adds.  Characters, and matches, of a run.
REMEMBERED, REMEMBERED_BYTES, RUN = 100_000, 16 << 20, 2_000_000
#: Longest match, in bytes, that shares an array of trees.
SHARED = 64
_NONE = np.int64(1) << np.int64(60)


class Bpe:
    """Encoder and decoder for ranks (bytes -> id) and a splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        # `\s` of the pattern's own dialect is Unicode's White_Space, which leaves out U+001C to U+001F.
        self.split = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.bytes_of = {str(i): b for b, i in ranks.items()}
        self.width = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {(ranks[t[:k]] * self.width + ranks[t[k:]]): i for t, i in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks}
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.pairs = pairs
        self.new: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.size = 0

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_ranks[at], -1)

    def _many(self, pieces: list[bytes], leaves: int) -> list[list[int]]:
        """Merges of many short pieces side by side, one row of trees each."""
        n, bits = len(pieces), leaves.bit_length() - 1
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((n, leaves + 1), -1, np.int64)  # the last column is the end of every piece
        ids[:, :leaves][np.arange(leaves) < lengths[:, None]] = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        after = np.minimum(np.tile(np.arange(1, leaves + 2), (n, 1)), leaves)
        before = np.tile(np.arange(-1, leaves), (n, 1))
        tree = np.full((n, 2 * leaves), _NONE, np.int64)
        rank = self._rank(ids[:, :leaves], ids[:, 1:])
        tree[:, leaves:] = np.where(rank >= 0, (rank << bits) | np.arange(leaves), _NONE)
        level = leaves
        while level > 1:
            np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2], out=tree[:, level // 2 : level])
            level //= 2

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            node = at + leaves
            tree[rows, node] = value
            while node[0] > 1:  # all leaves lie equally deep
                node = node >> 1
                tree[rows, node] = np.minimum(tree[rows, 2 * node], tree[rows, 2 * node + 1])

        rows = np.flatnonzero(tree[:, 1] < _NONE)
        while len(rows):
            top = tree[rows, 1]
            at, merged = top & (leaves - 1), top >> bits
            gone = after[rows, at]
            far = after[rows, gone]
            ids[rows, at], ids[rows, gone] = merged, -1
            after[rows, at], before[rows, far] = far, at
            put(rows, gone, np.full(len(rows), _NONE))
            right = self._rank(merged, ids[rows, far])
            put(rows, at, np.where(right >= 0, (right << bits) | at, _NONE))
            prior = before[rows, at]
            has = prior >= 0
            if has.any():
                left = self._rank(ids[rows[has], prior[has]], merged[has])
                put(rows[has], prior[has], np.where(left >= 0, (left << bits) | prior[has], _NONE))
            rows = rows[tree[rows, 1] < _NONE]
        ids = ids[:, :leaves]
        live = ids >= 0
        flat, to = ids[live].tolist(), np.cumsum(live.sum(axis=1)).tolist()
        return [flat[a:b] for a, b in zip([0, *to], to, strict=False)]

    def _long(self, piece: bytes) -> list[int]:
        """Merges of one long piece with a tree of its own."""
        n = len(piece)
        leaves = 1 << max(1, (n - 1).bit_length())
        none, width, pairs = int(_NONE), self.width, self.pairs
        ids = self.single[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        tree = [none] * (2 * leaves)

        def value(k: int) -> int:
            j = after[k]
            rank = pairs.get(ids[k] * width + ids[j]) if j < n else None
            return none if rank is None else rank * leaves + k

        tree[leaves : leaves + n] = [value(k) for k in range(n)]
        for k in range(leaves - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(k: int, x: int) -> None:
            k += leaves
            tree[k] = x
            while k > 1:
                x = min(x, tree[k ^ 1])
                k >>= 1
                tree[k] = x

        while tree[1] != none:
            rank, k = divmod(tree[1], leaves)
            j = after[k]
            ids[k], ids[j] = rank, -1
            after[k] = far = after[j]
            if far < n:
                before[far] = k
            put(j, none)
            put(k, value(k))
            if before[k] >= 0:
                put(before[k], value(before[k]))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: Iterable[bytes]) -> list[list[int]]:
        pieces = list(pieces)
        out: list[list[int]] = [[]] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            if (i := self.ranks.get(p)) is not None:
                out[k] = [i]
            elif len(p) > SHARED:
                out[k] = self._long(p)
            else:
                groups.setdefault(max(2, 1 << (len(p) - 1).bit_length()), []).append(k)
        for leaves, members in groups.items():
            for at in range(0, len(members), 4096):
                part = members[at : at + 4096]
                for k, ids in zip(part, self._many([pieces[k] for k in part], leaves), strict=True):
                    out[k] = ids
        return out

    def forget(self) -> None:
        """Once the table is full, keep only what is asked for again."""
        if len(self.new) > REMEMBERED or self.size > REMEMBERED_BYTES:
            self.old, self.new, self.size = self.new, {}, 0

    def learn(self, pieces: set[str]) -> None:
        """Remember the ids of pieces, as text."""
        unknown = []
        for p in pieces:
            if (ids := self.old.get(p)) is not None:
                self.new[p] = ids
                self.size += len(p) + len(ids)
            else:
                unknown.append(p)
        for p, ids in zip(unknown, self.encode_pieces(p.encode() for p in unknown), strict=True):
            self.new[p] = ",".join(map(str, ids))
            self.size += len(p) + len(self.new[p])

    def pieces(self, text: str) -> Iterator[list[str]]:
        """The matches of a text, in runs of bounded length."""
        if len(text) <= RUN:
            yield self.split.findall(text)
        else:
            found = self.split.finditer(text)
            while run := [m.group() for m in islice(found, RUN)]:
                yield run

    def encode(self, text: str) -> list[int]:
        return [i for run in self.pieces(text) for ids in self.encode_pieces(p.encode() for p in run) for i in ids]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(self.bytes_of[str(i)] for i in ids)


#: Where the table of ranks lies: a path, or what gives it on the machine that reads it.
Path = str | Callable[[], str]


def load(path: Path, pattern: str) -> Bpe:
    return _load(path() if callable(path) else path, pattern)


@lru_cache(maxsize=2)
def _load(path: str, pattern: str) -> Bpe:
    with open(path, "rb") as f:
        return Bpe({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)


#: A vocabulary and its remembered matches serve all tasks of a worker, until another operator's task comes.
B.KEPT["bpe"] = _load.cache_clear


def _digests(vocabulary: Callable[[], Bpe]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = vocabulary()
        for batch in batches:
            texts, at = batch.column(1), 0
            while at < len(texts):
                group, size = [], 0
                while at + len(group) < len(texts) and (not group or size < RUN):
                    group.append(texts[at + len(group)].as_py() or "")
                    size += len(group[-1])
                counts, ids_sha, decoded_sha = [], [], []
                bpe.forget()
                whole = [bpe.split.findall(t) if len(t) <= RUN else None for t in group]
                bpe.learn({p for w in whole if w for p in w if p not in bpe.new})
                for text, known in zip(group, whole, strict=True):
                    a, b, n = hashlib.sha256(), hashlib.sha256(), 0
                    for pieces in [known] if known is not None else bpe.pieces(text):
                        if known is None:
                            bpe.forget()
                            bpe.learn({p for p in pieces if p not in bpe.new})
                        if pieces:
                            ids = ",".join(map(bpe.new.__getitem__, pieces))
                            parts = ids.split(",")
                            a.update((("," if n else "") + ids).encode())
                            b.update(b"".join(map(bpe.bytes_of.__getitem__, parts)))
                            n += len(parts)
                    counts.append(n)
                    ids_sha.append(a.hexdigest())
                    decoded_sha.append(b.hexdigest())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(group)), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(decoded_sha)], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
                at += len(group)

    return run


def digests(docs: DataFrame, path: Path, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; its number of tokens and digests of ids and of decoded bytes."""
    return docs.select(id_col, text_col).mapInArrow(B.lean(_digests(lambda: load(path, pattern)), "bpe"), f"{id_col} {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def token_ids(docs: DataFrame, path: Path, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The ids themselves, one array per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(path, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), pa.array([bpe.encode(batch.column(1)[k].as_py() or "")], pa.list_(pa.int32()))], ["id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {docs.schema[id_col].dataType.simpleString()}, ids array<int>")
