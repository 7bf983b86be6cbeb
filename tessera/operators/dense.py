"""Exact vector search: query vectors in blocks of checked size against all rows."""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import tokens_of
from .common import Best, top

BLOCK_VALUES = 4 << 20


#: A plug-in that turns texts into rows of a matrix; it is made once per task.
Encoder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashed_encoder(dim: int = 64) -> Callable[[list[str]], np.ndarray]:
    """The built-in encoder: counts of hashed tokens, scaled to unit length."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.stack([np.bincount([zlib.crc32(t.encode()) % dim for t in tokens_of(text)], minlength=dim) for text in texts]).astype(np.float64)
        return out / np.maximum(np.sqrt((out * out).sum(axis=1, keepdims=True)), 1e-300)

    return encode


def encode(rows: DataFrame, key: str, text_col: str = "text", encoder: Encoder = hashed_encoder, batch: int = 16, instruction: str = "") -> DataFrame:
    """(key, vec) of every text, ``batch`` texts at a time; ``instruction`` goes before each."""
    if batch < 1:
        raise ValueError("a batch holds at least one text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = encoder()
        for b in (x.slice(at, batch) for x in batches for at in range(0, x.num_rows, batch)):
            matrix = np.ascontiguousarray(turn([instruction + (t or "") for t in b.column(1).to_pylist()]), np.float32)
            ends = np.arange(0, matrix.size + 1, max(1, matrix.shape[1]), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(ends, pa.array(matrix.reshape(-1)))], ["key", "vec"])

    return rows.select(key, text_col).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, vec array<float>")


def _scan(names: list, matrix: np.ndarray, limit: int, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(names), limit)
        step = max(1, BLOCK_VALUES // max(matrix.shape))
        for batch in (b.slice(at, step) for b in batches for at in range(0, b.num_rows, step)):
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            values = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(values) != len(ids) * matrix.shape[1]:
                raise ValueError("vectors differ in length from the query vectors")
            scores = values.reshape(len(ids), -1).astype(np.float64) @ matrix.T
            best.offer(ids, scores if digits is None else np.round(scores, digits))
        query, number, score = best.rows()
        yield pa.RecordBatch.from_arrays([pa.array([names[q] for q in query.tolist()], pa.int64()), pa.array(number, pa.int64()), pa.array(score)], ["qid", "record_index", "score"])

    return run


def vector_search(vectors: DataFrame, queries: DataFrame, limit: int = DEFAULT.channel_limit, digits: int | None = DEFAULT.rank_digits) -> DataFrame:
    """(qid, record_index, score, rank) from vectors (record_index, vec) and queries (qid, vec).

    Each task keeps the best ``limit`` rows per query; only those are shuffled.  Scores
    are compared at ``digits`` decimal places, or as they are where it is None.
    """
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vec")), F.lit(1)).alias("d")).first()
    blocks = max(1, math.ceil(size.n * size.d / BLOCK_VALUES))
    found = []
    for k in range(blocks):
        part = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == k)
        rows = part.select("qid", "vec").collect()
        matrix = np.array([r.vec for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, size.d))
        found.append(vectors.select(F.col("record_index").cast("long"), "vec").mapInArrow(_scan([r.qid for r in rows], matrix, limit, digits), "qid long, record_index long, score double"))
    scores = reduce(DataFrame.union, found)
    if digits is not None:
        scores = scores.withColumn("score", F.round("score", digits))
    return top(scores, ["qid"], [F.desc("score"), "record_index"], limit)
