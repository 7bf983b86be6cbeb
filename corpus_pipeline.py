"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and
returns the documents that it keeps, in the columns of ``documents``; the last one
returns the digests of the encoded texts.
"""

from __future__ import annotations

from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import blocks, bpe, decontam, linededup, minhash, quality
from tessera.llm.store import Workspace
from tessera.plans.session import shipped


@shipped
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.filtered(docs)


@shipped
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without repeated runs of lines; n_chars follows the text."""
    counts = tuple(blocks.free(docs.columns, x) for x in ("n_lines", "n_removed", "n_chunks"))
    out = linededup.without_repeated_runs(docs, counts=counts)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(counts[1]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


@shipped
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash.keep_one(spark, docs)


@shipped
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.clean(spark, docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@shipped
def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes."""
    return bpe.digests(docs, partial(public_tokenizers.path, "byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("byte_bpe", byte_bpe)]

#: Near-dedup after line dedup, tiling and BPE are beyond SQL; the tests hold each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each result written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with Workspace(spark) as ws:
        for k, (_, stage) in enumerate(STAGES):
            docs = stage(spark, docs, sf_dir)
            if k < len(STAGES) - 1:
                docs = ws.table(docs)
        return ws.result(docs)
