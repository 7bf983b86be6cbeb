"""Helpers that several operators share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def _drop(spark: SparkSession, path: str) -> None:
    try:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
    except Exception:  # the JVM has gone; the folder is left to whoever clears it
        pass


def settled(frame: DataFrame) -> DataFrame:
    """The frame as Parquet in the shared folder, removed when the program ends.

    What made it runs once, every use sees the same rows and partitions, and Spark knows
    its size: a join broadcasts it below ``spark.sql.autoBroadcastJoinThreshold`` alone.
    """
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/settled-{uuid.uuid4().hex}"
    atexit.register(_drop, spark, path)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def ranked(frame: DataFrame, by: list, order: list, name: str = "rank") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


def top(frame: DataFrame, by: list, order: list, limit: int, name: str = "rank") -> DataFrame:
    return ranked(frame, by, order, name).where(F.col(name) <= limit)


class Best:
    """The best ``limit`` rows of each query among all that were offered: highest score, then lowest number."""

    def __init__(self, queries: int, limit: int, least: float = -np.inf) -> None:
        self.limit, self.floor = limit, np.full(queries, least)
        self.pool: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.most, self.held = max(4 * queries * limit, 1 << 16), 0

    def offer(self, numbers: np.ndarray, scores: np.ndarray) -> None:
        """Rows by their numbers, with one column of scores per query."""
        row, query = np.nonzero(scores >= self.floor)
        self.pool.append((query, numbers[row], scores[row, query]))
        self.held += len(row)
        if self.held > self.most:
            self.rows()

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, number and score of the best rows so far."""
        query, number, score = (np.concatenate(x) for x in zip(*self.pool, strict=True)) if self.pool else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((number, -score, query))
        query, number, score = query[order], number[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        last = place == self.limit - 1
        self.floor[query[last]] = score[last]
        kept = place < self.limit
        self.pool, self.held = [(query[kept], number[kept], score[kept])], int(kept.sum())
        return self.pool[0]


def dense_index(frame: DataFrame, order: list, name: str = "record_index") -> DataFrame:
    """Numbers all rows from 0 in a total order, without bringing them into one task.

    Rows are sorted by range; a row's number is its place in its partition plus the
    sizes of the partitions before, of which there are few.
    """
    placed = settled(frame.orderBy(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = placed.groupBy("_p").count()
    before = sizes.select("_p", (F.sum("count").over(Window.orderBy("_p")) - F.col("count")).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn(name, F.col("_before") + F.col("_i")).drop("_p", "_i", "_before")


def ordered_digest(frame: DataFrame, index: str, row_hash: Column, width: int = 4096) -> DataFrame:
    """One sha256 over row hashes in order of ``index``, as a tree of runs of ``width``."""
    level = frame.select(F.col(index).cast("long").alias("i"), row_hash.alias("h"))
    for _ in range(3):
        runs = level.groupBy(F.expr(f"i div {width}").alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("x"))
        level = runs.select("i", F.sha2(F.array_join(F.col("x.h"), ""), 256).alias("h"))
    return level.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("i", "h")))["h"], ""), 256).alias("digest"))
