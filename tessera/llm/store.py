"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one of our own only where none is set and all tasks run on this machine."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tessera-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


#: Rows of an Arrow batch, Spark's setting and the most that a run of an operator takes.
BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 2000


class Workspace:
    """Tables written for one run of an operator, dropped when the run ends.

    During the run Arrow batches hold fewer rows, so that executor and Python worker each
    hold a few megabytes of texts or sets per task; afterwards the setting is as before.

    ``table`` cuts the lineage by writing Parquet into the shared folder, so a lost
    executor costs no more than the tasks it held.  ``result`` keeps a frame beyond
    the run by a checkpoint.  Spark removes it with the frame where
    ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set; elsewhere it stays until
    the folder is cleared.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/work-{uuid.uuid4().hex}"
        self.n = 0

    def __enter__(self) -> Workspace:
        self.before = self.spark.conf.get(BATCH)
        if not 0 < int(self.before) <= BATCH_ROWS:
            self.spark.conf.set(BATCH, str(BATCH_ROWS))
        return self

    def __exit__(self, *_: object) -> None:
        self.spark.conf.set(BATCH, self.before)
        self._drop(self.root)

    def table(self, frame: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        frame.write.parquet(path)
        return self.spark.read.schema(frame.schema).parquet(path)

    def result(self, frame: DataFrame) -> DataFrame:
        return frame.checkpoint(eager=True)

    def _drop(self, path: str) -> None:
        jvm = self.spark._jvm
        there = jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(there, True)
