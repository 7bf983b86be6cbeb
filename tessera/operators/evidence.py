"""Evidence sufficiency: signals over the top rows of each query, and a decision."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import bigram_share, clamp

#: Fixed values.
TIME_SENSITIVE = "今天|明天|后天|现在|此刻|今晚|本周|实时|最新|天气|下雨|菜单|新闻|当前时间|现任|今年|本学期|时刻表|空座位|空闲座位"
INSTITUTION = r"([一-鿿]{2,10}大学(?!生))"
ALLOWED_INSTITUTIONS = ("南京邮电大学",)
CUES = (
    ("预约", "预约", "预约"),
    ("遗失物品", "遗失|失物", "遗失|失物"),
    ("退款/退费", "退还|退款|退费", "退还|退款|退费"),
    ("收费/计费", "收费|计费|多少钱", r"收费|计费|费用|价格|\d+(?:\.\d+)?\s*元"),
)
REASONS = (
    "no_retrieval_results",
    "query_targets_different_institution",
    "missing_required_evidence_cues",
    "current_evidence_required",
    "insufficient_query_evidence_overlap",
    "supported_by_retrieved_evidence",
    "insufficient_retrieval_evidence",
)


def signals(queries: DataFrame, results: DataFrame, allowed: tuple[str, ...] = ALLOWED_INSTITUTIONS, c: Config = DEFAULT) -> DataFrame:
    """One row per query.  ``results``: qid, rank, text, reranker_score, matched_by, source_file, low_confidence, effective_date, active."""
    top3 = results.where("rank <= 3")
    modal = top3.groupBy("qid", "source_file").agg(F.count(F.lit(1)).alias("n")).groupBy("qid").agg(F.max("n").alias("modal"))
    ordered = F.array_sort(F.collect_list(F.struct("rank", F.coalesce("text", F.lit("")).alias("text"))))
    facts = top3.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("rank") == 1, F.col("reranker_score"))).alias("top_score"), F.max(F.when(F.col("rank") == 2, F.col("reranker_score"))).alias("second_score"),
        F.bool_or((F.col("rank") == 1) & F.array_contains("matched_by", "bm25") & F.array_contains("matched_by", "vector")).alias("agree"),
        F.avg(F.coalesce(F.col("low_confidence"), F.lit(False)).cast("int")).alias("low_quality"),
        F.bool_or(F.col("effective_date").isNotNull() & F.coalesce(F.col("active"), F.lit(True))).alias("current_evidence"), F.array_join(ordered["text"], " ").alias("evidence"),
    )
    out = queries.select("qid", "query").join(facts, "qid", "left").join(modal, "qid", "left")
    named = F.filter(F.regexp_extract_all("query", F.lit(INSTITUTION), F.lit(1)), lambda x: ~x.isin(*allowed))
    cue = F.array_compact(F.array(*(F.when(F.col("query").rlike(a) & ~F.coalesce(F.col("evidence"), F.lit("")).rlike(b), F.lit(label)) for label, a, b in CUES)))
    return out.select(
        "qid", "query", F.coalesce("n", F.lit(0)).alias("n"), "top_score", F.greatest(F.lit(0.0), F.col("top_score") - F.coalesce("second_score", F.lit(0.0))).alias("margin"),
        F.coalesce(bigram_share(F.col("query"), F.col("evidence")), F.lit(0.0)).alias("coverage"),
        F.coalesce("agree", F.lit(False)).alias("agree"), F.coalesce(F.col("modal") / F.col("n"), F.lit(0.0)).alias("consistency"), F.coalesce("low_quality", F.lit(0.0)).alias("low_quality"),
        F.try_element_at(named, F.lit(1)).alias("wrong_entity"), cue.alias("missing_cues"), F.col("query").rlike(TIME_SENSITIVE).alias("time_sensitive"), F.coalesce("current_evidence", F.lit(False)).alias("current_evidence"),
    )


def decide(s: DataFrame, c: Config = DEFAULT) -> DataFrame:
    """Adds confidence, evidence_sufficient and reason to signals."""
    late = (F.col("time_sensitive") & (F.col("top_score") < c.time_penalty_below)).cast("int")
    value = 0.65 * clamp(F.col("top_score")) + 0.10 * clamp(2 * F.col("margin")) + 0.10 * F.col("coverage") + 0.10 * F.col("agree").cast("int") + 0.05 * F.col("consistency") - 0.15 * F.col("low_quality") - 0.15 * late
    out = s.withColumn("confidence", F.when(F.col("n") > 0, F.round(clamp(value), 4)).otherwise(0.0))
    wrong, missing, stale, thin = F.col("wrong_entity").isNotNull(), F.size("missing_cues") > 0, F.col("time_sensitive") & ~F.col("current_evidence"), F.col("coverage") < c.min_coverage
    fine = (F.col("n") > 0) & (F.col("top_score") >= c.min_top_score) & (F.col("confidence") >= c.min_confidence) & ~thin & ~wrong & ~missing & ~stale
    out = out.withColumn("evidence_sufficient", F.coalesce(fine, F.lit(False)))
    reason = F.when(F.col("n") == 0, REASONS[0]).when(wrong, REASONS[1]).when(missing, REASONS[2]).when(stale, REASONS[3]).when(thin, REASONS[4]).when(F.col("evidence_sufficient"), REASONS[5]).otherwise(REASONS[6])
    return out.withColumn("reason", reason)


def assess(queries: DataFrame, results: DataFrame, allowed: tuple[str, ...] = ALLOWED_INSTITUTIONS, c: Config = DEFAULT) -> DataFrame:
    return decide(signals(queries, results, allowed, c), c)
