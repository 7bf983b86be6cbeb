"""Rank blending with a score per pair, and protection of the fused top rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import bigram_share, clamp

#: Fixed value: queries that ask for tabular facts.
TABLE_QUERY = r"分别|对应|排名|区间|比例|占比|折算|表中|列表|明细|各.+(?:多少|是什么|哪些)|地址.+(?:电话|联系电话)|(?:编号|学时|学分).*(?:学期|分别)"


def overlap_score(query: Column, text: Column) -> Column:
    """The built-in scorer, in (0, 1): share of the query's character pairs that the text has."""
    return F.lit(0.01) + 0.98 * clamp(F.coalesce(bigram_share(query, text), F.lit(0.0)))


def batch_scorer(factory: Callable[[], Callable[[list[tuple[str, str]]], list[float]]], batch: int = 16):
    """A scorer from a plug-in that scores lists of (query, text); it is made once per task."""
    if batch < 1:
        raise ValueError("a batch holds at least one pair")

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        turn = factory()
        for queries, texts in parts:
            pairs = list(zip(queries, texts, strict=True))
            yield pd.Series([float(x) for at in range(0, len(pairs), batch) for x in turn(pairs[at : at + batch])], dtype="float64")

    return score


def rerank(pairs: DataFrame, scorer=overlap_score, c: Config = DEFAULT) -> DataFrame:
    """Scores rows (qid, query, text, record_index, retrieval_rank, ...) and blends."""
    return rerank_from_scores(pairs.withColumn("reranker_raw", scorer(F.col("query"), F.col("text"))), c=c)


def rerank_from_scores(scored: DataFrame, score: str = "reranker_raw", c: Config = DEFAULT) -> DataFrame:
    """Adds reranker_score and blended_rank.  Equal scores keep the order of retrieval."""
    q = Window.partitionBy("qid")
    out = scored.withColumn("score_rank", F.row_number().over(q.orderBy(F.desc(score), "retrieval_rank"))).withColumn("_n", F.count(F.lit(1)).over(q))
    out = out.withColumn("normalized", F.expr("1.0D - (score_rank - 1) / greatest(1, _n - 1)"))
    out = out.withColumn("reranker_score", F.round(F.col("normalized") + F.lit(c.prior_weight) / F.col("retrieval_rank"), 9))
    return out.withColumn("blended_rank", F.row_number().over(q.orderBy(F.desc("reranker_score"), "retrieval_rank", "record_index"))).drop("_n")


def is_table_query(rows: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Adds table_query: a fused top row is a table, or the query asks for tabular facts."""
    some = F.bool_or((F.col("retrieval_rank") <= c.protect_slots) & (F.col("source_type") == "table")).over(Window.partitionBy("qid"))
    return rows.withColumn("table_query", F.coalesce(some, F.lit(False)) | F.coalesce(F.col("query").rlike(TABLE_QUERY), F.lit(False)))


def protect_top(rows: DataFrame, score: str = "reranker_raw", c: Config = DEFAULT) -> DataFrame:
    """Adds final_rank.  Protected rows that blending moved out of the top take its lowest unprotected slots."""
    k, q = c.protect_slots, Window.partitionBy("qid")
    guarded = (F.col("retrieval_rank") <= k) & ((F.col("table_query") & (F.col("source_type") == "table")) | (F.col(score) >= c.protect_score)) & (F.count(F.lit(1)).over(q) > k)
    out = rows.withColumn("protected", F.coalesce(guarded, F.lit(False)))
    missing, slot = F.col("protected") & (F.col("blended_rank") > k), ~F.col("protected") & (F.col("blended_rank") <= k)
    out = out.withColumn("_m", F.when(missing, F.sum(missing.cast("int")).over(q.orderBy("blended_rank"))))
    out = out.withColumn("_s", F.when(slot, F.sum(slot.cast("int")).over(q.orderBy(F.desc("blended_rank")))))
    out = out.withColumn("_n", F.max("_m").over(q))
    # A map from slot number to place replaces a self-join; it has at most as many entries as there are slots.
    places = F.map_from_entries(F.collect_list(F.when(F.col("_s").isNotNull(), F.struct("_s", "blended_rank"))).over(q))
    out = out.withColumn("_to", F.when(F.col("_m").isNotNull(), F.try_element_at(places, F.col("_m"))))
    gone = F.coalesce(F.col("_s") <= F.col("_n"), F.lit(False))
    low = (F.col("blended_rank") > k) & F.col("_to").isNull()
    after = gone | low
    order = [F.when(after, 1).otherwise(0), F.when(after, F.col("blended_rank")).otherwise(F.coalesce("_to", "blended_rank"))]
    return out.withColumn("final_rank", F.row_number().over(q.orderBy(*order))).drop("_m", "_s", "_n", "_to")
