r"""Language identification by prediction by partial matching.

For each language a tree of byte contexts of up to three bytes is counted in training
texts.  In a context that was seen, a byte that followed it n times of N, among d
different ones, has probability n / (N + d); the rest, d / (N + d), is the escape to
the next shorter context, down to a uniform choice among all bytes (method C, without
exclusion).  The statistics are then frozen, so the code length of a byte after a
context is a constant, and the code length of a text is an exact sum over all its
bytes.  The language with the shortest code wins.

Frozen trees become two tables: from three bytes to the number of the longest known
context, and from context and byte to code length, in units of 2**-16 bit.  Scoring is
two look-ups per byte and language, in numpy over whole batches, and sums of integers,
so a text's score doesn't depend on the texts beside it.  Bytes that no training text
holds share one symbol: their code length is the same everywhere.

Training reads a bounded sample: the ``sample`` rows of each language with the
smallest hashes; rows that repeat id, language and text count once.  Only ids and hashes are
ranked, first within parts of a language, then among the parts' best, so no task gets
the rows of a language; the texts of the chosen rows are fetched afterwards.  Their
n-grams are counted on the executors; only counts of the sample come to the driver.  All
contexts of the sample are kept.

Defined results.  ``und`` with score 0 where the text is null or has no letter (no
character of Unicode's category L), or nothing was learned.  Rows are judged one by one.
Ties go to the language first in the alphabet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks as B
from .store import Workspace

_LETTER = regex.compile(r"\p{L}")
#: Units of a code length in one bit.
_UNITS = 1 << 16


@dataclass(frozen=True)
class Ppm:
    #: Training rows per language.
    sample: int = 600
    #: Parts of a language that are ranked by themselves first.
    parts: int = 64


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of one to four bytes of each batch: lang, order, gram as an integer, count."""
    for batch in batches:
        langs = np.array(batch.column(0).to_pylist(), object)
        for lang in sorted(set(langs)):
            for _, data, offsets in B.blocks(batch.column(1).filter(pa.array(langs == lang))):
                wide = data.astype(np.int64)
                inside = np.searchsorted(offsets, np.arange(len(wide)), "right")
                for order in range(4):
                    gram = wide[: max(0, len(wide) - order)].copy()
                    for k in range(1, order + 1):
                        gram = gram * 256 + wide[k : len(wide) - order + k]
                    if order:
                        gram = gram[inside[: len(gram)] == inside[order:]]
                    values, counts = np.unique(gram, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), order, np.int32)), pa.array(values), pa.array(counts.astype(np.int64))], ["lang", "order", "gram", "n"])


@dataclass(frozen=True)
class Model:
    """Frozen statistics of all languages."""

    langs: list[str]
    symbol: np.ndarray  # byte -> symbol
    width: int
    state: np.ndarray  # language, three symbols -> number of the longest known context
    cost: list[np.ndarray]  # for each language: context * width + symbol -> units of code length

    def bits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Code length of each text in each language; at a text's begin the context is shorter."""
        w = self.width
        s = self.symbol[data].astype(np.int64)
        held = np.zeros((3, len(s)), np.int64)  # the third, second and first byte before; 0: none
        for k in range(1, 4):
            if len(s) >= k:
                held[3 - k, k:] = s[:-k] + 1
                for j in range(k):
                    at = offsets[:-1] + j
                    held[3 - k, at[at < offsets[1:]]] = 0
        key = (held[0] * (w + 1) + held[1]) * (w + 1) + held[2]
        out = np.empty((len(offsets) - 1, len(self.langs)))
        for k in range(len(self.langs)):
            total = np.concatenate((np.zeros(1, np.int64), np.cumsum(self.cost[k][self.state[k][key] * w + s], dtype=np.int64)))
            out[:, k] = (total[offsets[1:]] - total[offsets[:-1]]) / _UNITS
        return out


def freeze(counts: dict[str, list[tuple[int, int, int]]]) -> Model:
    """A model from (order, gram, count) of each language."""
    langs = sorted(counts)
    seen = sorted({gram for lang in langs for order, gram, _ in counts[lang] if order == 0})
    w = len(seen) + 1
    symbol = np.full(256, w - 1, np.int64)
    symbol[seen] = np.arange(len(seen))
    other = 256 - len(seen)
    states, costs = [], []
    for lang in langs:
        trees: list[dict[tuple[int, ...], dict[int, int]]] = [{}, {}, {}, {}]
        for order, gram, n in counts[lang]:
            path = tuple(int(symbol[(gram >> (8 * k)) & 255]) for k in range(order, -1, -1))
            trees[order].setdefault(path[:-1], {})[path[-1]] = n
        base = np.full(w, 1 / 256)
        table, number = [base], {}
        for order in range(4):
            for context, follow in sorted(trees[order].items()):
                n, d = sum(follow.values()), len(follow)
                shorter = context[1:]
                while shorter and shorter not in number:
                    shorter = shorter[1:]
                p = table[number.get(shorter, 0)] * (d / (n + d)) if order else base * (d / (n + d))
                p = p.copy()
                for s, m in follow.items():
                    p[s] += m / (n + d)
                number[context] = len(table)
                table.append(p)
        state = np.full(((w + 1),) * 3, number.get((), 0), np.int32)
        for context, k in sorted(number.items(), key=lambda x: len(x[0])):
            if context:
                at = tuple(slice(None) for _ in range(3 - len(context))) + tuple(c + 1 for c in context)
                state[at] = k
        states.append(state.reshape(-1))
        costs.append(np.rint(-np.log2(np.array(table)) * _UNITS).astype(np.int32).reshape(-1))
    assert other >= 0
    return Model(langs, symbol, w, np.array(states) if states else np.zeros((0, 1), np.int32), costs)


def train(spark: SparkSession, labelled: DataFrame, p: Ppm = Ppm(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learns from rows with text and language."""
    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = rows.select("lang", "id", F.xxhash64("text").alias("key"), F.xxhash64("id").alias("place"))
    with Workspace(spark) as ws:
        place = [F.col("place"), F.col("id"), F.col("key")]
        parts = marks.distinct().withColumn("part", F.pmod(F.xxhash64("id", "key", F.lit(1)), F.lit(p.parts)))
        parts = parts.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*place))).where(F.col("k") <= p.sample)
        best = parts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*place))).where(F.col("k") <= p.sample)
        chosen = ws.table(best.select("lang", F.col("id").alias("chosen"), "key"))
        keyed = rows.withColumn("key", F.xxhash64("text"))
        same = (keyed["lang"] == chosen["lang"]) & (keyed["key"] == chosen["key"]) & keyed["id"].eqNullSafe(chosen["chosen"])
        texts = keyed.join(chosen, same, "left_semi").dropDuplicates(["lang", "id", "key"]).select("lang", "text")
        grams = texts.mapInArrow(_counts, "lang string, order int, gram long, n long").groupBy("lang", "order", "gram").agg(F.sum("n").alias("n"))
        counts: dict[str, list[tuple[int, int, int]]] = {}
        for r in grams.select("lang", "order", "gram", "n").collect():
            counts.setdefault(r.lang, []).append((r.order, r.gram, r.n))
    return freeze(counts)


def _scored(model: Callable[[], Model]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model()
        for batch in batches:
            for at, data, offsets in B.blocks(batch.column(2)):
                n = len(offsets) - 1
                named = [bool(m.langs) and bool(_LETTER.search(t or "")) for t in batch.column(2).slice(at, n).to_pylist()]
                if m.langs:
                    bits = m.bits(data, offsets)
                    best = bits.argmin(axis=1)
                    # The posterior with texts weighed by the square root of their length: neighbouring bytes aren't independent.
                    length = np.sqrt(np.maximum(1, np.diff(offsets)))[:, None]
                    score = 1 / np.exp2(np.maximum(-1000, (bits.min(axis=1, keepdims=True) - bits) / length)).sum(axis=1)
                else:
                    best, score = np.zeros(n, int), np.zeros(n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), batch.column(1).slice(at, n), pa.array([m.langs[b] if ok else "und" for b, ok in zip(best, named, strict=True)]), pa.array([float(s) if ok else 0.0 for s, ok in zip(score, named, strict=True)])],
                    ["id", "held_out", "lang_pred", "score"],
                )

    return run


def held_out(id_col: str = "doc_id"):
    """A quarter of the rows, by a checksum of the id; a null id isn't held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(spark: SparkSession, docs: DataFrame, p: Ppm = Ppm(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from the rows that aren't held out and judges all: id_col, held_out, lang_pred, score."""
    model = train(spark, docs.where(~held_out(id_col)), p, id_col, text_col, lang_col)
    sent = spark.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, held_out(id_col).alias("held_out"), text_col).mapInArrow(_scored(lambda: sent.value), f"{id_col} {kind}, held_out boolean, lang_pred string, score double")
