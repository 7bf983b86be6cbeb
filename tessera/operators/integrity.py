"""Manifests of files: creation, verification and directory digests."""

from __future__ import annotations

import hashlib
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dense_index, ordered_digest

#: Files whose line ends are made portable before hashing.
TEXT_SUFFIXES = (".py", ".md", ".json", ".toml", ".txt", ".html", ".yml", ".yaml", ".lock")


def file_table(spark: SparkSession, root: str) -> DataFrame:
    """(path below root, sha256, bytes, portable_text) of all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.regexp_replace("path", "^[a-z]+:/*", "/")
    text = F.lower("path").rlike("(" + "|".join(s.replace(".", "\\.") for s in TEXT_SUFFIXES) + ")$")
    body = F.when(text, F.encode(F.regexp_replace(F.decode("content", "UTF-8"), "\r\n?", "\n"), "UTF-8")).otherwise(F.col("content"))
    below = F.substring(name, len(os.path.abspath(root)) + 2, 1 << 30)
    return files.select(below.alias("path"), F.sha2(body, 256).alias("sha256"), F.length(body).cast("long").alias("bytes"), text.alias("portable_text"))


def create_manifest(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    wanted = spark.createDataFrame([(p,) for p in sorted(set(paths))], "path string")
    met = wanted.join(file_table(spark, root), "path", "left")
    missing = [r.path for r in met.where("sha256 is null").limit(10).collect()]
    if missing:
        raise FileNotFoundError(", ".join(missing))
    return met.orderBy("path")


def verify_manifest(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(path, error) for files outside the root, missing, or different."""
    met = expected.join(actual.select("path", F.col("sha256").alias("s"), F.col("bytes").alias("b")), "path", "left")
    error = F.when(F.col("path").rlike(r"^/|(^|/)\.\.(/|$)"), "outside_root").when(F.col("s").isNull(), "missing").when(F.col("s") != F.col("sha256"), "sha256_mismatch").when(F.col("b") != F.col("bytes"), "size_mismatch")
    return met.select("path", error.alias("error")).where("error is not null")


def tree_digest(files: DataFrame) -> DataFrame:
    """Digest over length-prefixed names, sizes and hashes, in order of path."""
    line = F.concat_ws(":", F.octet_length("path"), "path", "bytes", "sha256")
    return ordered_digest(dense_index(files, [F.col("path")]), "record_index", F.sha2(line, 256))


def portable_sha256(content: bytes) -> str:
    return hashlib.sha256(content.replace(b"\r\n", b"\n").replace(b"\r", b"\n")).hexdigest()
