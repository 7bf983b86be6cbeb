r"""MinHash near-dedup.

Texts become sets of word shingles.  ``rows * bands`` universal hash functions give
each set its minima; sets that agree on all minima of a band meet in a bucket.
Buckets only propose pairs: a link counts when the full sets confirm it.  Connected
components follow by alternating large-star and small-star steps.

Hot groups.  Equal sets collapse to one node first (partial aggregation), so exact
copies never meet in pairs.  Within buckets, pairs are not enumerated: each round
picks a pivot per bucket, members are verified against the pivots that most of their
buckets name, and buckets whose members have become one component leave.  After the
first and the last round, shingles that no open set of another component has are set
aside: the rest bounds every intersection to come from above, which takes out,
exactly, the strays that resemble a group but not closely enough.  A round settles most of a group of near copies of any size with a
number of verified pairs in proportion to its members.  What is left after it is
compared across components, so no proposed link is lost: see ``_left_over``.

Full sets are the last thing to be read.  A pair is first tried on the sketches of its
two sets: bitmaps of four to eight bits a shingle (``sketch``) that bound the difference
of the sets from below, so texts that resemble each other just below the threshold fall
without their sets, and a link never does.  Members of crowded buckets are compared on
sketches alone, in tiles of bounded size that are tasks of their own.  Keys that hold
many rows (buckets, shingles, pivots) are dealt into as many parts as it takes
(``Hot``), so that no join puts all rows of one key into one task.

What stays quadratic: sketches in a family whose texts all resemble each other just
below the threshold.  Its members are compared within every crowded bucket they share.

At the defaults (50 bands of 5 minima) a pair at similarity 0.75 escapes all bands
with probability 1.3e-6, one at 0.8 with 2e-9.

Defined results.  Null, empty and blank texts have no shingles, are linked with
nothing and are kept.  Rows that repeat a doc_id are rows of their own; a component's
id is its smallest doc_id, null if it has none (such rows are kept only where they
are linked with nothing).  Columns other than the id and the text are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks as B
from .store import Workspace


@dataclass(frozen=True)
class MinHash:
    words: int = 5
    percent: int = 75
    bands: int = 50
    rows: int = 5
    #: Pivot rounds before what is left is compared in full; pivots of a bucket and pivots that a node tries in each.
    rounds: int = 1
    pivots: int = 8
    tries: int = 4
    #: Open sets that share a rare shingle at most.
    rare: int = 8
    #: Members beyond which a bucket is compared in tiles, and members of a tile.
    crowd: int = 64
    tile: int = 256
    #: Pairs of a row that a tile yields at its second turn; four times as many at each further one.
    nearest: int = 16
    #: Bits of the smallest and the largest sketch, powers of two.
    sketch_bits: tuple[int, int] = (1 << 11, 1 << 20)
    #: A key is dealt into parts beyond this share of all rows, and beyond this many rows.
    hot_share: int = 1 << 18
    hot_least: int = 1024
    seed: int = 7


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> Iterator[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles."""
    starts, ends, first = B.spans(data, offsets)
    hashes = B.span_hashes(data, starts, ends, fold=True)
    runs = B.grams(hashes, words)
    for k in range(len(offsets) - 1):
        a, b = int(first[k]), int(first[k + 1])
        if b - a >= words:
            yield np.unique(runs[a : b - words + 1])
        elif b > a:
            yield B.grams(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)


class Signer:
    """Minima of many hash functions a * x + b modulo 2**64, a odd."""

    STEP = 256

    def __init__(self, p: MinHash) -> None:
        draw = np.random.default_rng(p.seed)
        k = p.bands * p.rows
        self.p = p
        self.a = draw.integers(0, 1 << 63, (k, 1), np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = draw.integers(0, 1 << 63, (k, 1), np.uint64) * np.uint64(2)
        self.band = B.mix(np.arange(1, p.bands + 1, dtype=np.uint64))
        self.space = np.empty((k, self.STEP), np.uint64)

    def minima(self, values: np.ndarray) -> np.ndarray:
        best = np.full(len(self.a), np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(values), self.STEP):
            part = values[at : at + self.STEP]
            space = self.space[:, : len(part)]
            np.multiply(self.a, part, out=space)
            np.add(space, self.b, out=space)
            np.minimum(best, space.min(axis=1), out=best)
        return best

    def buckets(self, values: np.ndarray) -> np.ndarray:
        """One bucket key for each band; the band's number is part of the key."""
        key = self.band.copy()
        for column in self.minima(values).reshape(self.p.bands, self.p.rows).T:
            key = B.mix(key ^ column) + self.band
        return key.view(np.int64)


def _name(values: np.ndarray) -> bytes:
    return hashlib.blake2b(values.tobytes(), digest_size=16).digest()


def _signed(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(p)
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column(1)):
                sizes, names, keys = [], [], []
                for values in shingle_sets(data, offsets, p.words):
                    sizes.append(len(values))
                    names.append(_name(values) if len(values) else None)
                    keys.append(signer.buckets(values) if len(values) else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(sizes)), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
                    ["id", "n", "node", "buckets"],
                )

    return run


def _with_names(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The last column, a text, gives way to the name of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column(batch.num_columns - 1)):
                names = [_name(values) if len(values) else None for values in shingle_sets(data, offsets, p.words)]
                held = [c.slice(at, len(names)) for c in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*held, pa.array(names, pa.binary())], batch.schema.names)

    return run


def sketch(values: np.ndarray, p: MinHash) -> np.ndarray:
    """A bitmap that counts the set's hashes at each of its places, modulo 2, in bytes.

    It has at least four bits a shingle, between the least and the most of ``p``.  The
    xor of two sets' bitmaps is the bitmap of their symmetric difference, so the number
    of its bits never exceeds the number of shingles that only one of them has.
    """
    least, most = p.sketch_bits
    bits = min(most, max(least, 1 << (4 * len(values) - 1).bit_length()))
    places = (values & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(places, minlength=bits) & 1).astype(np.uint8))


def _folded(bitmaps: np.ndarray, width: int) -> np.ndarray:
    """Rows of bitmaps, as bitmaps of fewer bytes: places are taken modulo the smaller size."""
    n, wide = bitmaps.shape
    return bitmaps if wide == width else np.bitwise_xor.reduce(bitmaps.reshape(n, wide // width, width), axis=1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least differences of the sets behind rows of bitmaps; one row of ``a`` may face many of ``b``."""
    width = min(a.shape[1], b.shape[1])
    both = _folded(a, width) ^ _folded(b, width)
    return np.bitwise_count(np.ascontiguousarray(both).view(np.uint64)).sum(axis=1, dtype=np.int64)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a binary column without nulls."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _bitmaps(column: pa.Array, rows: np.ndarray, width: int) -> np.ndarray:
    data, offsets = _bytes(column)
    return data[offsets[rows][:, None] + np.arange(width)]


def _widths(column: pa.Array) -> np.ndarray:
    return np.diff(_bytes(column)[1])


def _sets(p: MinHash) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in B.blocks(batch.column(0)):
                full = [x for x in shingle_sets(data, offsets, p.words) if len(x)]
                columns = [[_name(x) for x in full], [len(x) for x in full], [x.tobytes() for x in full], [sketch(x, p).tobytes() for x in full]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["node", "n", "members", "bits"])

    return run


def _alike(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (u, v) whose sketches allow a link, of rows (u, v, n, m, a, b) with sketches a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(2).to_numpy(zero_copy_only=False) + batch.column(3).to_numpy(zero_copy_only=False)
            a, b = batch.column(4), batch.column(5)
            wide = _widths(a), _widths(b)
            keep = np.zeros(batch.num_rows, bool)
            for x, y in set(zip(*(w.tolist() for w in wide), strict=True)):
                rows = np.flatnonzero((wide[0] == x) & (wide[1] == y))
                for part in np.split(rows, np.arange(1, len(rows) * max(x, y) // B.BLOCK_BYTES + 1) * max(1, B.BLOCK_BYTES // max(x, y))):
                    if len(part):
                        keep[part] = (100 - percent) * sizes[part] >= (100 + percent) * _apart(_bitmaps(a, part, x), _bitmaps(b, part, y))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep))

    return run


def _forest(pairs: np.ndarray, far: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The pairs, nearest first, that join parts that no nearer pair has joined; rows of a component are joined from the start."""
    up = np.unique(c.astype(str), return_inverse=True)[1].tolist()
    own, up = up, list(range(max(up, default=-1) + 1))
    out = []
    for k in np.argsort(far, kind="stable").tolist():
        a, b = (own[r] for r in pairs[k])
        while up[a] != a:
            up[a] = a = up[up[a]]
        while up[b] != b:
            up[b] = b = up[up[b]]
        if a != b:
            up[a] = b
            out.append(k)
    return np.array(out, np.int64)


def _nearest(pairs: np.ndarray, far: np.ndarray, most: int) -> np.ndarray:
    """Up to ``most`` pairs of each first row, nearest first."""
    order = np.lexsort((far, pairs[:, 0]))
    first = pairs[order, 0]
    return order[np.arange(len(order)) - np.searchsorted(first, first) < most]


def _tile(percent: int, most: int) -> Callable[[pa.Table], pa.Table]:
    """Pairs (u, v, more) of a tile, a table of (part, node, n, k, c, bits), whose sketches allow a link.

    Rows of part 0 are compared with those of part 1, or among each other where there is
    no part 1.  Of the pairs found come up to ``most`` for each row, or with 0 those of a
    forest; ``more`` says whether others were left out.
    """

    def run(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        part, n, k, node, bits = (batch.column(batch.schema.get_field_index(x)) for x in ("part", "n", "k", "node", "bits"))
        part, n, k = (x.to_numpy(zero_copy_only=False) for x in (part, n, k))
        c = np.array([x.hex() for x in batch.column(batch.schema.get_field_index("c")).to_pylist()], object)
        wide = _widths(bits)
        left, right = np.flatnonzero(part == 0), np.flatnonzero(part == 1)
        inner = not len(right)
        right = left if inner else right
        facing = {w: (rows := right[wide[right] == w], _bitmaps(bits, rows, w)) for w in np.unique(wide[right]).tolist()}
        pairs, far = [np.zeros((0, 2), np.int64)], [np.zeros(0)]
        for i in left.tolist():
            own = _bitmaps(bits, np.array([i]), int(wide[i]))
            for rows, maps in facing.values():
                ok = (100 * np.minimum(n[rows], n[i]) >= percent * np.maximum(n[rows], n[i])) & ((100 + percent) * np.minimum(k[rows], k[i]) >= percent * (n[rows] + n[i])) & (c[rows] != c[i])
                if inner:
                    ok &= rows > i
                near = np.flatnonzero(ok)
                if len(near):
                    apart, both = _apart(own, maps[near]), n[rows[near]] + n[i]
                    hit = (100 - percent) * both >= (100 + percent) * apart
                    found = rows[near[hit]]
                    pairs.append(np.stack((np.full(len(found), i), found), 1))
                    far.append(apart[hit] / both[hit])
        every, apart = np.concatenate(pairs), np.concatenate(far)
        kept = every[_nearest(every, apart, most) if most else _forest(every, apart, c)]
        u, v = (node.take(pa.array(kept[:, e])) for e in (0, 1))
        return pa.table({"u": u, "v": v, "more": pa.array(np.full(len(kept), len(kept) < len(every)))})

    return run


def _confirmed(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links (u, v) among rows (u, v, a, b) with full sets a and b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (a, b))
                both = np.concatenate((x, y))
                both.sort()
                common = int(np.count_nonzero(both[1:] == both[:-1]))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets as rows of one shingle each."""
    for batch in batches:
        for name, members, c in zip(*batch.columns, strict=True):
            g = np.frombuffer(members.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(g), pa.repeat(name, len(g)), pa.repeat(c, len(g))], ["g", "node", "c"])


class Hot:
    """Keys of a join that hold many rows, dealt into parts of at most ``bound`` rows.

    ``sizes`` has the key and ``many``, its number of rows; all keys have ``total``.  A key
    is hot beyond ``least`` rows and one in ``share`` of all rows, so there are at most
    ``share`` hot keys, and the list of them, which is broadcast, has a bounded size.
    """

    def __init__(self, sizes: DataFrame, key: str, total: int, share: int, least: int) -> None:
        self.key, self.table, bound = key, None, max(least, total // share)
        if total > bound:
            kind = sizes.schema[key].dataType.simpleString()
            hot = [(r[0], -(-r[1] // bound)) for r in sizes.where(F.col("many") > bound).select(key, "many").collect()]
            if hot:
                self.table = F.broadcast(sizes.sparkSession.createDataFrame(hot, f"{key} {kind}, _w int"))

    def deal(self, rows: DataFrame, by: str, name: str = "x", key: str | None = None) -> DataFrame:
        """Adds the number of the part; rows of a key differ in ``by``."""
        if self.table is None:
            return rows.withColumn(name, F.lit(0))
        key = key or self.key
        met = rows.join(self.table.withColumnRenamed(self.key, key), key, "left")
        return met.withColumn(name, F.when(F.col("_w").isNotNull(), F.pmod(F.xxhash64(by), F.col("_w")).cast("int")).otherwise(0)).drop("_w")

    def copies(self, facts: DataFrame, name: str = "x", key: str | None = None) -> DataFrame:
        """One copy of a row for each part of its key."""
        if self.table is None:
            return facts.withColumn(name, F.lit(0))
        key = key or self.key
        met = facts.join(self.table.withColumnRenamed(self.key, key), key, "left")
        return met.withColumn(name, F.explode(F.sequence(F.lit(0), F.coalesce("_w", F.lit(1)) - 1))).drop("_w")

    def join(self, rows: DataFrame, facts: DataFrame, by: str, key: str | None = None) -> DataFrame:
        """Rows with the facts of their key."""
        key = key or self.key
        if self.table is None:
            return rows.join(facts, key)
        return self.deal(rows, by, "_x", key).join(self.copies(facts, "_x", key), [key, "_x"]).drop("_x")


def components(ws: Workspace, links: DataFrame, large_from: int = 1 << 20) -> DataFrame:
    """Rows (v, root) for every node of ``links`` (u, v); root is the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars: no node has two
    edges to smaller nodes, or edges in both directions.  Up to ``large_from`` edges a step
    is a minimum over each node's edges, of which there are no more; beyond, it is a
    partial minimum and an equi-join on the node, whose many edges are dealt into parts.
    """

    def star(e: DataFrame, large: bool, crowded: bool) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select("u", "v")
        if crowded:
            sizes = both.groupBy("u").agg(F.count(F.lit(1)).alias("many"))
            low = both.groupBy("u").agg(F.min("v").alias("m"))
            met = Hot(sizes, "u", both.count(), 1 << 18, large_from).join(both, low, "v")
        else:
            met = both.withColumn("m", F.min("v").over(Window.partitionBy("u")))
        met = met.withColumn("m", F.least("u", "m"))
        if large:
            return met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Every edge's two ends now point to the smallest of them.
        own = met.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        return own.where("u <> v").distinct()

    edges = ws.table(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
    while True:
        n = edges.count()
        crowded = n > large_from
        larger = star(edges, True, crowded)
        edges = ws.table(star(ws.table(larger.distinct()) if crowded else larger, False, crowded))
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
        ends = ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if ends.where("up > 1 or (up = 1 and down = 1)").isEmpty():
            return edges.select(F.col("u").alias("v"), F.col("v").alias("root"))


def _left_over(ws: Workspace, open_: DataFrame, single: DataFrame, sets: DataFrame, hot: Hot, p: MinHash, turn: int) -> tuple[DataFrame, bool]:
    """Pairs (u, v) across components that may still be links, and whether there are others.

    All pairs are found in two ways.

    Call a shingle rare if at most ``rare`` open sets have it, and let k be a set's count
    of other shared shingles.  A pair whose intersection must exceed the smaller k shares
    a rare shingle, and is found, with their number, by the shingle: each brings at most
    ``rare`` partners, whatever the size of the group.  Any other pair is found in its
    buckets, from the side that isn't in the bucket's largest component: by a join in
    buckets of up to ``crowd`` members, elsewhere in tiles of two runs of about ``tile``
    members, which yield a pair only if its sketches allow a link.

    As one link joins two components, a tile first yields a forest of its pairs, then, at
    each further turn with the components of that time, more of them for each row, until
    none is left out.  So a group of near copies never yields all its pairs, and no pair
    across components escapes in the end.
    """
    enough = f"(100 + {p.percent}) * (least(k, k2) + r) >= {p.percent} * (n + m) and 100 * least(n, m) >= {p.percent} * greatest(n, m)"
    facts = open_.select("node", "n", "k").distinct()
    few = single.where(F.col("df") <= p.rare).join(facts, "node").select("g", "node", "c", "n", "k")
    other = few.select("g", F.col("node").alias("v"), F.col("c").alias("e"), F.col("n").alias("m"), F.col("k").alias("k2"))
    rare = few.withColumnRenamed("node", "u").join(other, "g").where("u < v and c <> e").groupBy("u", "v").agg(F.count(F.lit(1)).alias("r"), *(F.first(x).alias(x) for x in ("n", "m", "k", "k2")))

    dense = open_.where(f"100 * k >= {p.percent} * n")
    each = dense.groupBy("h", "c").agg(F.count(F.lit(1)).alias("size")).groupBy("h").agg(F.max(F.struct("size", "c")).alias("y"), F.sum("size").alias("many"))
    each = each.select("h", F.col("y.c").alias("d"), F.col("y.size").alias("main"), "many").where("main < many")
    dense = ws.table(dense.drop("size").join(hot.copies(each), ["h", "x"]))

    plain = dense.where(F.col("many") <= p.crowd)
    side = plain.where("c <> d").select("h", F.col("node").alias("u"), "n", "k", "c")
    rest = plain.select("h", F.col("node").alias("v"), F.col("n").alias("m"), F.col("k").alias("k2"), F.col("c").alias("e"), "d", F.lit(0).alias("r"))
    close = side.join(rest, "h").where("c <> e and (e = d or u < v)").where(enough).select("u", "v")

    runs = lambda n: F.greatest(F.lit(1), F.ceil(n / p.tile)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    crowded = dense.where(F.col("many") > p.crowd).withColumn("own", F.col("c") == F.col("d")).withColumn("a", runs(F.col("many") - F.col("main"))).withColumn("b", runs(F.col("main")))
    crowded = crowded.withColumn("i", F.pmod(F.xxhash64("node"), F.when(F.col("own"), F.col("b")).otherwise(F.col("a"))).cast("int")).join(sets.select("node", "bits"), "node")
    place = lambda kind, a, b, part: F.struct(F.lit(kind).alias("kind"), a.cast("int").alias("a"), b.cast("int").alias("b"), part.cast("int").alias("part"))
    mine = F.col("i")
    across = F.when(F.col("own"), F.transform(upto(F.col("a")), lambda j: place(0, j, mine, F.lit(1)))).otherwise(F.transform(upto(F.col("b")), lambda j: place(0, mine, j, F.lit(0))))
    among = F.when(F.col("own"), F.slice(across, 1, 0)).otherwise(F.transform(upto(F.col("a")), lambda j: place(1, F.least(mine, j), F.greatest(mine, j), j < mine)))
    tiles = crowded.select("h", "node", "n", "k", "c", "bits", F.explode(F.concat(across, among)).alias("t")).select("h", "t.*", "node", "n", "k", "c", "bits")
    most = p.nearest * 4 ** (turn - 1) if turn else 0
    found = ws.table(tiles.groupBy("h", "kind", "a", "b").applyInArrow(_tile(p.percent, most), "u binary, v binary, more boolean"))
    more = not found.where("more").isEmpty()
    found = found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
    if turn:
        return found.distinct(), more
    return rare.where(enough).select("u", "v").union(close.select(F.least("u", "v"), F.greatest("u", "v"))).union(found).distinct(), more


def near_duplicates(spark: SparkSession, docs: DataFrame, p: MinHash = MinHash(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id_col, n_shingles, component_id, kept."""
    return _verdicts(spark, docs, p, id_col, text_col).drop("_node", "_root")


def _verdicts(spark: SparkSession, docs: DataFrame, p: MinHash, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``near_duplicates`` with the name of their set and, where they are linked or repeated, the root of their group."""
    with Workspace(spark) as ws:
        id_type = docs.schema[id_col].dataType
        rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        signed = ws.table(rows.mapInArrow(B.lean(_signed(p)), f"id {id_type.simpleString()}, n long, node binary, buckets array<long>"))

        nodes = signed.where("node is not null").dropDuplicates(["node"])
        spread = nodes.select("node", "n", F.explode("buckets").alias("h"))
        shared = ws.table(spread.groupBy("h").agg(F.count(F.lit(1)).alias("many")).where("many > 1"))
        hot = Hot(shared, "h", shared.agg(F.sum("many")).first()[0] or 0, p.hot_share, p.hot_least)
        members = ws.table(hot.deal(spread, "node").join(hot.copies(shared.withColumnRenamed("many", "size")), ["h", "x"]))

        # Sets of all nodes that share a bucket.  Their texts are found by the smallest id of the node.
        wanted = members.select("node").distinct()
        bearers = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("id")).join(wanted, "node", "left_semi")
        texts = rows.join(bearers.select(F.col("id").alias("b")).distinct(), F.col("id").eqNullSafe(F.col("b")), "left_semi").select("text")
        sets = ws.table(texts.mapInArrow(B.lean(_sets(p)), "node binary, n long, members binary, bits binary").join(wanted, "node", "left_semi").dropDuplicates(["node"]))

        def verified(pairs: DataFrame) -> DataFrame:
            """The links among a table of pairs: sketches first, full sets of what they let through."""

            def with_both(some: DataFrame, what: list[str]) -> DataFrame:
                many = some.select(F.col("u").alias("node")).union(some.select("v")).groupBy("node").agg(F.count(F.lit(1)).alias("many"))
                busy = Hot(many, "node", some.count(), p.hot_share, p.hot_least)
                for end, mate, names in (("u", "v", ("n", "a")), ("v", "u", ("m", "b"))):
                    some = busy.join(some, sets.select(F.col("node").alias(end), *(F.col(c).alias(names[c != "n"]) for c in what)), mate, end)
                return some

            alike = ws.table(with_both(pairs, ["n", "bits"]).select("u", "v", "n", "m", "a", "b").mapInArrow(B.lean(_alike(p.percent)), "u binary, v binary"))
            return ws.table(with_both(alike, ["members"]).select("u", "v", "a", "b").mapInArrow(B.lean(_confirmed(p.percent)), "u binary, v binary"))

        # An intersection can't exceed the smaller of the two sets' counts of shared shingles, nor fall below what the threshold asks of their sizes.
        roots, tried = None, None
        open_ = members.withColumn("c", F.col("node")).withColumn("s", F.col("n")).withColumn("k", F.col("n"))
        fits = F.expr(f"100 * least(n, m) >= {p.percent} * greatest(n, m) and (100 + {p.percent}) * least(s, z) >= {p.percent} * (n + m)")
        for t in count():
            if t <= p.rounds and roots is not None:  # without links so far, all buckets have members of several components
                mixed = open_.groupBy("h").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("size")).where("c0 <> c1").select("h", "size")
                open_ = ws.table(open_.drop("size").join(hot.copies(mixed), ["h", "x"]))
            if t <= p.rounds and open_.isEmpty():
                break
            if t in (1, p.rounds):
                # Shingles that no open set of another component has are in no intersection to come.
                here = open_.select("node", "c").distinct()
                single = sets.join(here, "node").select("node", "members", "c").mapInArrow(B.lean(_single), "g long, node binary, c binary")
                foreign = ws.table(single.groupBy("g").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count(F.lit(1)).alias("many")).where("c0 <> c1").select("g", "many"))
                often = Hot(foreign, "g", foreign.agg(F.sum("many")).first()[0] or 0, p.hot_share, p.hot_least)
                single = ws.table(often.join(single, foreign.withColumnRenamed("many", "df"), "node"))
                common = single.groupBy("node").agg(F.count(F.lit(1)).alias("s"), F.count_if(F.col("df") > p.rare).alias("k"))
                open_ = ws.table(open_.drop("s", "k").join(common, "node").where(f"100 * s >= {p.percent} * n").select("h", "x", "node", "n", "c", "s", "k", "size"))
            if t < p.rounds:
                # A few members of each bucket are its pivots, others each round.  Each bucket names one of them to each member, and a node tries those that most of its buckets name.
                turn = Window.partitionBy("h").orderBy(F.xxhash64("node", F.lit(t)), "node")
                lead = open_.drop("x").withColumn("k", F.row_number().over(turn)).where(F.col("k") <= p.pivots).select("h", "k", F.col("node").alias("v"), F.col("n").alias("m"), F.col("s").alias("z"), F.col("c").alias("d"))
                named = open_.withColumn("k", (F.pmod(F.xxhash64("node", "h", F.lit(t)), F.least("size", F.lit(p.pivots))) + 1).cast("int"))
                votes = named.join(hot.copies(lead), ["h", "k", "x"]).where("c <> d").where(fits).groupBy(F.col("node").alias("u"), "v").agg(F.count(F.lit(1)).alias("votes"))
                if tried is not None:
                    votes = votes.join(tried.select("u", "v"), ["u", "v"], "left_anti")
                best = Window.partitionBy("u").orderBy(F.desc("votes"), "v")
                pairs = votes.withColumn("k", F.row_number().over(best)).where(F.col("k") <= p.tries).select("u", "v")
            else:
                pairs, more = _left_over(ws, open_, single, sets, hot, p, t - p.rounds)
                if tried is not None:
                    pairs = pairs.join(tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")), ["u", "v"], "left_anti")
            pairs = ws.table(pairs)
            last = t >= p.rounds and not more
            if pairs.isEmpty():
                if last:
                    break
                continue
            links = verified(pairs)
            tried = pairs if tried is None else ws.table(tried.union(pairs))
            if links.isEmpty():
                if last:
                    break
                continue
            if roots is not None:
                links = links.union(roots.select(F.col("v").alias("u"), F.col("root").alias("v")))
            roots = components(ws, links)
            open_ = open_.drop("c").join(roots.select(F.col("v").alias("node"), F.col("root").alias("r")), "node", "left").select("h", "x", "node", "n", F.coalesce("r", "node").alias("c"), "s", "k", "size")
            if last:
                break

        per_node = signed.where("node is not null").groupBy("node").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("copies"))
        if roots is not None:
            per_node = per_node.join(roots.select(F.col("v").alias("node"), "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
        else:
            per_node = per_node.withColumn("root", F.col("node"))
        per_node = ws.table(per_node)
        groups = per_node.groupBy("root").agg(F.min("low").alias("component_id"), F.sum("copies").alias("size"))
        crowded = ws.table(per_node.join(groups.where("size > 1"), "root").select("node", "component_id", "root", F.col("copies").alias("many")))
        busy = Hot(crowded, "node", signed.count(), p.hot_share, p.hot_least)
        facts = busy.copies(crowded.drop("many")).withColumnsRenamed({"node": "g", "x": "y"})
        out = busy.deal(signed.select("id", "n", "node", F.monotonically_increasing_id().alias("place")), "place")
        out = out.join(facts, (F.col("node") == F.col("g")) & (F.col("x") == F.col("y")), "left")
        out = out.select(
            F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
            F.when(F.col("g").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"),
            (F.col("g").isNull() | F.coalesce(F.col("id") == F.col("component_id"), F.lit(False))).alias("kept"),
            F.col("node").alias("_node"), F.col("root").alias("_root"),
        )
        return ws.result(out)


def keep_one(spark: SparkSession, docs: DataFrame, p: MinHash = MinHash()) -> DataFrame:
    """One document of each group of near copies, and all documents that are linked with nothing.

    Rows are told apart by id and set, so one that shares only its id (or its lack of
    one) with a near copy stays.  Of a group stays the row with the smallest id, null
    last; of several sets with that id the one with the smallest name, and of several
    rows with that set the first by their values.
    """
    own = {x: B.free(docs.columns, x) for x in ("gone", "gone_node", "best", "node", "turn")}
    linked = _verdicts(spark, docs.select("doc_id", "text"), p).where("_root is not null").groupBy("_root", "_node", "doc_id").agg(F.count(F.lit(1)).alias("rows"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_node")
    best = linked.groupBy("_root").agg(F.min(place).alias("best"))
    with Workspace(spark) as ws:
        marks = linked.join(best, "_root").select(F.col("doc_id").alias(own["gone"]), F.col("_node").alias(own["gone_node"]), place.eqNullSafe(F.col("best")).alias(own["best"]), "rows")
        marks = ws.result(marks.where(~F.col(own["best"]) | (F.col("rows") > 1)).drop("rows"))
    schema = T.StructType([*docs.schema.fields, T.StructField(own["node"], T.BinaryType())])
    named = docs.mapInArrow(B.lean(B.text_last(_with_names(p), docs.columns, own["node"])), schema)
    met = lambda side: named["doc_id"].eqNullSafe(side[own["gone"]]) & (named[own["node"]] == side[own["gone_node"]])
    out = named.join(marks, met(marks), "left_anti").select(*docs.columns)
    tied = marks.where(F.col(own["best"]))
    if tied.isEmpty():
        return out
    turn = Window.partitionBy("doc_id", own["node"]).orderBy(F.to_json(F.struct(*docs.columns)))
    first = named.join(tied, met(tied), "left_semi").withColumn(own["turn"], F.row_number().over(turn)).where(F.col(own["turn"]) == 1)
    return out.union(first.select(*docs.columns))
