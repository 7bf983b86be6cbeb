"""What a session needs before queries with Python operators run."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import SparkSession

#: Spark's bound of the bytes of an Arrow batch, and ours: JVM and Python worker each hold a few batches per task.
BATCH_BYTES, MOST_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def ship(spark: SparkSession) -> None:
    """Give the package to the executors, once per context, as ``--py-files`` would."""
    context = spark.sparkContext
    if getattr(context, "_tessera_shipped", False):
        return
    package = Path(__file__).resolve().parents[1]
    target = os.path.join(tempfile.mkdtemp(prefix="tessera-"), "tessera_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    context.addPyFile(target)
    context._tessera_shipped = True


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes as well as rows, as 10,000 texts may be long; a smaller bound stays.

    Results are lazy, so the bound must outlast the query: the session keeps it.
    """
    now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BYTES))
    if not 0 < now <= MOST_BYTES:
        spark.conf.set(BATCH_BYTES, str(MOST_BYTES))


def shipped(query: Callable) -> Callable:
    """A query or stage, its session first, that readies the session before it runs."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args):
        ship(spark)
        small_batches(spark)
        return query(spark, *args)

    return run
