"""Ranking metrics, diagnostics and threshold calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from .common import settled


def relevant(c_ids: str = "relevant_chunk_ids") -> Column:
    """Listed chunks decide where there are any; else file and page."""
    listed = F.size(F.coalesce(F.col(c_ids), F.array().cast("array<string>"))) > 0
    return F.when(listed, F.array_contains(c_ids, F.col("chunk_id"))).otherwise((F.col("source_file") == F.col("expected_file")) & F.array_contains("pages", F.col("page")))


def file_types(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("source_file").agg(F.when(F.bool_or(F.col("source_type") == "ocr"), "scanned").otherwise("native").alias("pdf_type"))


def case_metrics(rankings: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """Per method and case: first_rank, dcg, idcg, ndcg, found.  ``rankings``: method, case_id, rank, rel; ``totals``: case_id, n_relevant, category, pdf_type."""
    hit = F.col("rel")
    per = rankings.groupBy("method", "case_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first_rank"), F.coalesce(F.sum(F.when(hit & (F.col("rank") <= k), 1 / F.log2(F.col("rank") + 1))), F.lit(0.0)).alias("dcg"), F.count_if(hit & (F.col("rank") <= 20)).alias("found"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.greatest(F.col("n_relevant"), F.lit(1)), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    return per.join(totals, "case_id").withColumn("ndcg", F.when(F.col("n_relevant") > 0, F.col("dcg") / ideal).otherwise(0.0))


def metric_columns(k: int = 5) -> list[Column]:
    r = F.col("first_rank")
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("int"))
    return [
        F.count(F.lit(1)).alias("cases"), F.count_if(r == 1).alias("hits_at_1"), F.count_if(r <= k).alias("hits_at_5"), F.round(share(r == 1), 4).alias("recall_at_1"), F.round(share(r <= 3), 4).alias("recall_at_3"), F.round(share(r <= k), 4).alias("recall_at_5"),
        F.round(F.avg(F.when(r <= k, 1 / r).otherwise(0.0)), 4).alias("mrr_at_5"), F.round(F.avg("ndcg"), 4).alias("ndcg_at_5"), F.round(share(r.isNotNull()), 4).alias("candidate_recall"), F.round(share(r <= 20), 4).alias("oracle_recall_at_20"),
    ]


def report(cases: DataFrame, pdf_types: tuple[str, ...] = ("native", "scanned"), without_oracle: tuple[str, ...] = ("reranker",)) -> DataFrame:
    """Metrics overall, by category and by pdf type, in one pass of grouping sets.

    Each method has a row for each of ``pdf_types``, of 0 cases and null rates where there are none.  A method that only
    orders another one's candidates has no oracle recall.
    """
    sets = cases.groupingSets([[F.col("method")], [F.col("method"), F.col("category")], [F.col("method"), F.col("pdf_type")]], "method", "category", "pdf_type")
    out = sets.agg(F.grouping("category").alias("_c"), F.grouping("pdf_type").alias("_p"), *metric_columns())
    out = out.withColumn("scope", F.when((F.col("_c") == 1) & (F.col("_p") == 1), "overall").when(F.col("_c") == 0, "category").otherwise("pdf_type")).drop("_c", "_p")
    wanted = cases.select("method").distinct().select("method", F.explode(F.array(*map(F.lit, pdf_types))).alias("pdf_type"))
    none = wanted.join(cases.select("method", "pdf_type").distinct(), ["method", "pdf_type"], "left_anti").select("method", "pdf_type", F.lit("pdf_type").alias("scope"), *(F.lit(0).cast("long").alias(c) for c in ("cases", "hits_at_1", "hits_at_5")))
    out = out.unionByName(none, allowMissingColumns=True).withColumn("mrr", F.col("mrr_at_5"))
    return out.withColumn("oracle_recall_at_20", F.when(~F.col("method").isin(*without_oracle), F.col("oracle_recall_at_20")))


def diagnostics(cases: DataFrame) -> DataFrame:
    r = F.col("first_rank")
    return cases.groupBy("method").agg(F.count_if(r.isNull()).alias("not_recalled"), F.count_if(r > 5).alias("beyond_5"), F.count_if((r > 1) & (r <= 5)).alias("within_5"))


def worst_cases(cases: DataFrame, limit: int = 20) -> DataFrame:
    """The cases that rank worst; one that isn't found ranks last."""
    return cases.where("first_rank is null or first_rank > 1").orderBy(F.desc(F.coalesce("first_rank", F.lit(10**9))), "case_id", "method").limit(limit)


def first_place(cases: DataFrame) -> DataFrame:
    """(method, pdf_type, cases, hits_at_1, recall_at_1, misses, misses_by_category): who is missed in the first place."""
    missed = F.coalesce(F.col("first_rank") != 1, F.lit(True))
    per = cases.groupBy("method", "pdf_type", "category").agg(F.count(F.lit(1)).alias("n"), F.count_if(missed).alias("m"))
    out = per.groupBy("method", "pdf_type").agg(F.sum("n").alias("cases"), F.sum("m").alias("misses"), F.array_sort(F.collect_list(F.when(F.col("m") > 0, F.struct("category", "m")))).alias("x"))
    hits = F.col("cases") - F.col("misses")
    return out.select("method", "pdf_type", "cases", hits.alias("hits_at_1"), F.round(hits / F.col("cases"), 4).alias("recall_at_1"), "misses", F.map_from_entries("x").alias("misses_by_category"))


def score_summary(rows: DataFrame, by: list[str] | None = None, score: str = "score") -> DataFrame:
    """Number, least, mean and greatest of the scores that there are."""
    r6 = lambda f, name: F.round(f(score), 6).alias(name)
    return rows.groupBy(*(by or [])).agg(F.count(score).alias("cases"), r6(F.min, "minimum"), r6(F.avg, "mean"), r6(F.max, "maximum"))


def acceptance(metrics: DataFrame, methods: tuple[str, str, str, str, str] = ("legacy", "bm25", "vector", "hybrid", "reranker")) -> DataFrame:
    """One row of gates from the rows of ``report``: fusion against its channels and the older ranking, reranking against fusion, each pdf type by itself.

    A gate whose figures are missing isn't passed.
    """
    old, lexical, dense, fused, last = methods

    def of(method: str, what: str, pdf_type: str | None = None) -> Column:
        here = (F.col("method") == method) & (F.col("scope") == "overall" if pdf_type is None else (F.col("scope") == "pdf_type") & (F.col("pdf_type") == pdf_type))
        return F.max(F.when(here, F.col(what)))

    kinds = ("native", "scanned")
    every = lambda gates: gates[0] & gates[1]
    gates = {
        "hybrid_recall_not_below_channels": of(fused, "recall_at_5") >= F.greatest(of(lexical, "recall_at_5"), of(dense, "recall_at_5")),
        "hybrid_recall_above_legacy": of(fused, "recall_at_5") > of(old, "recall_at_5"),
        "reranker_recall_not_below_hybrid": of(last, "recall_at_5") >= of(fused, "recall_at_5"),
        "reranker_mrr_above_hybrid": of(last, "mrr") > of(fused, "mrr"),
        "reranker_ndcg_not_below_hybrid": of(last, "ndcg_at_5") >= of(fused, "ndcg_at_5"),
        "reranker_recall_not_below_hybrid_by_pdf_type": every([of(last, "recall_at_5", k) >= of(fused, "recall_at_5", k) for k in kinds]),
        "reranker_mrr_above_hybrid_by_pdf_type": every([of(last, "mrr", k) > of(fused, "mrr", k) for k in kinds]),
    }
    out = metrics.agg(*(F.coalesce(g, F.lit(False)).alias(name) for name, g in gates.items()))
    return out.withColumn("passed", F.expr(" and ".join(gates)))


def latency(rows: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Mean and nearest-rank percentiles."""
    p = lambda q: F.expr(f"percentile_disc({q}) within group (order by {value})")
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(value), 6).alias("mean_ms"), p(0.5).alias("p50_ms"), p(0.95).alias("p95_ms"), F.min(value).alias("min_ms"), F.max(value).alias("max_ms"))


def confusion(accept: Column, answerable: str = "answerable") -> list[Column]:
    a = F.col(answerable)
    return [F.count_if(a & accept).alias("accepted_answerable"), F.count_if(a & ~accept).alias("false_refusals"), F.count_if(~a & ~accept).alias("correct_refusals"), F.count_if(~a & accept).alias("false_answers")]


def with_rates(counts: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Adds rates to confusion counts; ``empty`` stands where a class has no cases."""
    other = F.lit(empty).cast("double")
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), other)
    out = counts.withColumn("accept_rate", rate("accepted_answerable", "false_refusals")).withColumn("refusal_recall", rate("correct_refusals", "false_answers")).withColumn("false_answer_rate", rate("false_answers", "correct_refusals"))
    total = F.col("accepted_answerable") + F.col("false_refusals") + F.col("correct_refusals") + F.col("false_answers")
    out = out.withColumn("overall_accuracy", F.coalesce(F.try_divide(F.col("accepted_answerable") + F.col("correct_refusals"), total), other))
    both = (F.col("accepted_answerable") + F.col("false_refusals") > 0) & (F.col("correct_refusals") + F.col("false_answers") > 0)
    return out.withColumn("balanced_accuracy", F.when(both, (F.col("accept_rate") + F.col("refusal_recall")) / 2).otherwise(other))


def refusal_at(rows: DataFrame, threshold: float, by: list[str] | None = None, score: str = "score") -> DataFrame:
    return with_rates(rows.groupBy(*(by or [])).agg(*confusion(F.col(score) >= threshold)))


def refusal_breakdown(rows: DataFrame, threshold: float, score: str = "score") -> DataFrame:
    """(side, kind, cases, accept_rate, false_refusal_rate, refusal_recall, false_answer_rate): answerable cases by source type, the others by type of question."""
    side = F.when(F.col("answerable"), "answerable").otherwise("no_answer")
    kind = F.when(F.col("answerable"), F.coalesce(F.nullif("source_type", F.lit("")), F.lit("unknown"))).otherwise(F.coalesce(F.nullif("no_answer_type", F.lit("")), F.lit("unspecified")))
    taken = F.round(F.avg((F.col(score) >= threshold).cast("int")), 4)
    left = F.round(F.avg((F.col(score) < threshold).cast("int")), 4)
    out = rows.where(F.col(score).isNotNull()).groupBy(side.alias("side"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("cases"), taken.alias("taken"), left.alias("left"))
    mine = lambda name, one: F.when(F.col("side") == one, F.col(name))
    return out.select("side", "kind", "cases", mine("taken", "answerable").alias("accept_rate"), mine("left", "answerable").alias("false_refusal_rate"), mine("left", "no_answer").alias("refusal_recall"), mine("taken", "no_answer").alias("false_answer_rate"))


def refusal_report(rows: DataFrame, threshold: float | None = None, calibrated: bool = False, score: str = "score") -> dict:
    """Scores by class, and metrics at a threshold that is given, or calibrated on these rows, or neither."""
    scored = rows.where(F.col(score).isNotNull())
    summary = {("answerable" if r.answerable else "no_answer"): r.asDict() for r in score_summary(scored, ["answerable"], score).collect()}
    out = {"score_summary": summary, "mode": "calibrated_on_this_dataset" if calibrated else "not_scored" if threshold is None else "fixed_threshold", "metrics": None}
    if calibrated:
        if not summary:
            raise ValueError("there are no scores to calibrate on")
        threshold = calibrate(scored, score).first().threshold
    if threshold is None:
        return out
    return out | {"metrics": refusal_at(scored, threshold, score=score).first().asDict() | {"threshold": threshold}, "breakdown": [r.asDict() for r in refusal_breakdown(scored, threshold, score).orderBy("side", "kind").collect()]}


def threshold_counts(rows: DataFrame, score: str, edges: list[float], accept: Column | None = None) -> DataFrame:
    """Confusion counts at every distinct score and at ``edges``: one sort instead of a cross join.

    Counts per distinct score are summed from the highest down; sums of the scores'
    buckets come first, so that no window holds all scores in one task.
    """
    hard = F.lit(True) if accept is None else accept
    per = rows.groupBy(F.col(score).cast("double").alias("threshold")).agg(F.count_if(F.col("answerable") & hard).alias("a"), F.count_if(~F.col("answerable") & hard).alias("u"))
    per = per.union(rows.sparkSession.createDataFrame([(float(e), 0, 0) for e in edges], "threshold double, a long, u long")).groupBy("threshold").agg(F.sum("a").alias("a"), F.sum("u").alias("u"))
    placed = settled(per.orderBy(F.desc("threshold")).withColumn("_p", F.spark_partition_id()))
    sums = placed.groupBy("_p").agg(F.sum("a").alias("pa"), F.sum("u").alias("pu"))
    before = Window.orderBy("_p")
    sums = sums.select("_p", (F.sum("pa").over(before) - F.col("pa")).alias("ba"), (F.sum("pu").over(before) - F.col("pu")).alias("bu"))
    run = Window.partitionBy("_p").orderBy(F.desc("threshold"))
    placed = placed.join(F.broadcast(sums), "_p")
    totals = F.broadcast(rows.agg(F.count_if("answerable").alias("na"), F.count_if(~F.col("answerable")).alias("nu")))
    out = placed.select("threshold", (F.sum("a").over(run) + F.col("ba")).alias("accepted_answerable"), (F.sum("u").over(run) + F.col("bu")).alias("false_answers")).crossJoin(totals)
    return out.select("threshold", "accepted_answerable", (F.col("na") - F.col("accepted_answerable")).alias("false_refusals"), (F.col("nu") - F.col("false_answers")).alias("correct_refusals"), "false_answers")


def calibrate(rows: DataFrame, score: str = "score", eps: float = 1e-9) -> DataFrame:
    """The threshold of best (balanced, overall, refusal recall, threshold)."""
    ends = rows.agg(F.min(score).alias("a"), F.max(score).alias("b")).first()
    rated = with_rates(threshold_counts(rows, score, [ends.a - eps, ends.b + eps]))
    best = F.max(F.struct(F.round("balanced_accuracy", 9).alias("balanced_accuracy"), F.round("overall_accuracy", 9).alias("overall_accuracy"), F.round("refusal_recall", 9).alias("refusal_recall"), "threshold"))
    return rated.agg(best.alias("x")).select("x.*")


def constrained_threshold(rows: DataFrame, max_false_answers: float = 0.05, score: str = "confidence", hard: str = "hard_rules_passed") -> DataFrame:
    """Among thresholds within the bound on false answers, that of best (accept rate, balanced, threshold)."""
    rated = with_rates(threshold_counts(rows, score, [0.0, 1 + 1e-9], F.col(hard))).where(F.col("false_answer_rate") <= max_false_answers)
    best = F.max(F.struct(F.round("accept_rate", 9).alias("accept_rate"), F.round("balanced_accuracy", 9).alias("balanced_accuracy"), "threshold", F.round("false_answer_rate", 9).alias("false_answer_rate")))
    return rated.agg(best.alias("x")).where("x is not null").select("x.*")


def classify(rows: DataFrame, threshold: float) -> DataFrame:
    """Confusion and rates where acceptance also needs the hard rules; rates are null where a class is empty."""
    return with_rates(rows.agg(*confusion(F.col("hard_rules_passed") & (F.col("confidence") >= threshold))), None)


def hard_rules(c: Config = DEFAULT) -> Column:
    """Whether evidence may be accepted at all, from the signals of an assessment."""
    ok = lambda name: F.coalesce(F.col(name), F.lit(False))
    return (
        (F.coalesce("top_score", F.lit(0.0)) >= c.min_top_score) & (F.coalesce("coverage", F.lit(0.0)) >= c.min_coverage) & (~ok("time_sensitive") | ok("current_evidence"))
        & (F.coalesce("wrong_entity", F.lit("")) == "") & (F.size(F.coalesce("missing_cues", F.array().cast("array<string>"))) <= 0)
    )


def gates(metrics: DataFrame, max_far: float = 0.05, max_frr: float = 0.35) -> DataFrame:
    """Adds far_ok and frr_ok; a rate of an empty class is no failure.  The bound on refusals is strict."""
    return metrics.withColumn("far_ok", F.coalesce(F.col("false_answer_rate") <= max_far, F.lit(True))).withColumn("frr_ok", F.coalesce(1 - F.col("accept_rate") < max_frr, F.lit(True)))
