"""Weighted reciprocal-rank fusion of two rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import top


def rrf_fuse(bm25: DataFrame, vector: DataFrame, limit: int = 20, *, rrf_k: int = 1, bm25_weight: float = 1.0, vector_weight: float = 1.0) -> DataFrame:
    """(qid, record_index, rrf_score, bm25_rank, vector_rank, bm25_score, vector_score, matched_by, retrieval_rank)."""
    a = bm25.select("qid", "record_index", F.col("rank").alias("bm25_rank"), F.col("score").alias("bm25_score"))
    b = vector.select("qid", "record_index", F.col("rank").alias("vector_rank"), F.col("score").alias("vector_score"))
    share = lambda w, r: F.coalesce(F.lit(float(w)) / (F.lit(rrf_k) + F.col(r)), F.lit(0.0))
    both = a.join(b, ["qid", "record_index"], "full_outer").withColumn("rrf_score", F.round(share(bm25_weight, "bm25_rank") + share(vector_weight, "vector_rank"), 9))
    named = F.array_compact(F.array(F.when(F.col("bm25_rank").isNotNull(), "bm25"), F.when(F.col("vector_rank").isNotNull(), "vector")))
    return top(both.withColumn("matched_by", named), ["qid"], [F.desc("rrf_score"), "record_index"], limit, "retrieval_rank")


def only_active(rows: DataFrame, limit: int | None = None, order: str = "retrieval_rank") -> DataFrame:
    """Rows of active versions; a missing flag counts as active."""
    kept = rows.where(F.coalesce(F.col("active"), F.lit(True)))
    return kept if limit is None else top(kept, ["qid"], [order], limit, "_kept").drop("_kept")
