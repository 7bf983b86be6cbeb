"""Versioned publication: a version is written whole into a folder of its own, then named by a pointer.

No folder is written twice: a version published again gets a new one.  Pointers are numbered files, each made by one
rename onto a name that didn't exist; the highest that names a whole version counts.  What fails on the way leaves the
version before it as it was.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession

POINTER = "CURRENT."


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def write_text(spark: SparkSession, path: str, text: str, *, new: bool = False) -> None:
    """Writes beside the target and renames onto it; a ``new`` target must not exist."""
    target, fs = _fs(spark, path)
    beside, _ = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    if fs.exists(target):
        if new:
            fs.delete(beside, False)
            raise OSError(f"{path} was published by someone else")
        fs.delete(target, False)
    if not fs.rename(beside, target):
        raise OSError(f"can't publish {path}")


def read_text(spark: SparkSession, path: str) -> str | None:
    target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    return spark.read.text(path, wholetext=True).first()[0]


def _pointers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of the pointers, the highest first."""
    home, fs = _fs(spark, root)
    names = [x.getPath().getName() for x in fs.listStatus(home)] if fs.exists(home) else []
    return sorted((int(x[len(POINTER) :]) for x in names if x.startswith(POINTER) and x[len(POINTER) :].isdigit()), reverse=True)


def publish(spark: SparkSession, root: str, tables: dict[str, DataFrame], metadata: dict) -> str:
    """Writes all tables of a new version, metadata last, and moves the pointer; returns the version's folder name."""
    home = f"v={metadata.get('version') or 'x'}-{uuid.uuid4().hex[:12]}"
    try:
        for name, frame in tables.items():
            frame.write.mode("errorifexists").parquet(f"{root}/{home}/{name}")
        write_text(spark, f"{root}/{home}/metadata.json", json.dumps(metadata, sort_keys=True, ensure_ascii=False), new=True)
        write_text(spark, f"{root}/{POINTER}{next(iter(_pointers(spark, root)), 0) + 1:09d}", home, new=True)
    except Exception:
        path, fs = _fs(spark, f"{root}/{home}")
        fs.delete(path, True)
        raise
    return home


def current(spark: SparkSession, root: str) -> str | None:
    """The folder of the live version."""
    for n in _pointers(spark, root):
        home = (read_text(spark, f"{root}/{POINTER}{n:09d}") or "").strip()
        path, fs = _fs(spark, f"{root}/{home}/metadata.json")
        if home and fs.exists(path):
            return home
    return None


def load(spark: SparkSession, root: str) -> tuple[dict, dict[str, DataFrame]]:
    """Metadata and tables of the live version."""
    home = current(spark, root)
    if home is None:
        raise FileNotFoundError(f"no version is published in {root}")
    metadata = json.loads(read_text(spark, f"{root}/{home}/metadata.json") or "{}")
    return metadata, {name: spark.read.parquet(f"{root}/{home}/{name}") for name in metadata["tables"]}


def prune(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Removes versions before the last ``keep`` ones; no one may be reading them."""
    for n in _pointers(spark, root)[keep:]:
        home = (read_text(spark, f"{root}/{POINTER}{n:09d}") or "").strip()
        pointer, fs = _fs(spark, f"{root}/{POINTER}{n:09d}")
        fs.delete(pointer, False)
        if home:
            fs.delete(_fs(spark, f"{root}/{home}")[0], True)


def write_report(spark: SparkSession, path: str, report: dict) -> dict:
    """The whole report to a file; what is returned leaves out the details."""
    write_text(spark, path, json.dumps(report, ensure_ascii=False, indent=2))
    return {k: v for k, v in report.items() if k != "details"}
