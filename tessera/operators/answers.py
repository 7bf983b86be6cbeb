"""Answer and citation scoring, and validation of case results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import char_ngrams, normalized


def bigram_recall(pairs: DataFrame, reference: str, answer: str, key: list[str], n: int = 2) -> DataFrame:
    """Adds recall: the share of the reference's character n-grams, with their counts, that the answer has."""

    def grams(name: str) -> DataFrame:
        return pairs.select(*key, F.explode(char_ngrams(normalized(F.col(name)), n)).alias("g")).groupBy(*key, "g").agg(F.count(F.lit(1)).alias(f"n_{name}"))

    met = grams(reference).join(grams(answer), [*key, "g"], "left").groupBy(*key).agg((F.sum(F.least(F.col(f"n_{reference}"), F.coalesce(F.col(f"n_{answer}"), F.lit(0)))) / F.sum(f"n_{reference}")).alias("_r"))
    r, a = normalized(F.col(reference)), normalized(F.col(answer))
    short = F.when(r == "", 0.0).otherwise(F.contains(a, r).cast("double"))
    return pairs.join(met, key, "left").withColumn("recall", F.round(F.when(F.length(r) < n, short).otherwise(F.col("_r")), 6)).drop("_r")


def duplicate_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def unmatched_ids(cases: DataFrame, predictions: DataFrame) -> DataFrame:
    """Ids that only one side has."""
    a, b = cases.select("id"), predictions.select("id")
    return a.join(b, "id", "left_anti").withColumn("only_in", F.lit("cases")).union(b.join(a, "id", "left_anti").withColumn("only_in", F.lit("predictions")))


def fact_recall(facts: str = "required_facts", answer: str = "answer") -> Column:
    hit = F.filter(facts, lambda x: F.contains(normalized(F.col(answer)), normalized(x)))
    return F.when(F.col("refused") | (F.size(facts) <= 0), 0.0).otherwise(F.size(hit) / F.size(facts))


def citation_scores() -> list[Column]:
    cited, wanted = F.array_distinct("cited_chunk_ids"), F.array_distinct("relevant_chunk_ids")
    both = F.size(F.array_intersect(cited, wanted))
    share = lambda n: F.when(F.col("refused"), 0.0).otherwise(F.coalesce(F.try_divide(both, n), F.lit(0.0)))
    return [share(F.size(cited)).alias("citation_precision"), share(F.size(wanted)).alias("citation_recall"), (~F.col("refused") & (both > 0)).alias("supported")]


def metadata_complete() -> Column:
    """There are citations, and they name exactly the cited chunks, each with file and page."""
    named = F.col("citations.chunk_id")
    typed = (F.size("citations") > 0) & F.forall("citations", lambda c: c["source_file"].isNotNull() & (c["source_file"] != "") & c["page"].isNotNull() & (c["page"] >= 1))
    return (F.size(F.array_except(named, F.col("cited_chunk_ids"))) == 0) & (F.size(F.array_except(F.col("cited_chunk_ids"), named)) == 0) & typed


#: The stages in which a case can fail.
STAGES = ("unclassified_missing_trace", "evidence_judgment_error", "passed", "generation_error", "retrieval_error", "pending_manual_review")


def failure_stage() -> Column:
    """Where a case failed; the first condition that holds decides."""
    c = F.col
    found = F.coalesce(F.arrays_overlap("retrieved_chunk_ids", "relevant_chunk_ids"), F.lit(False))
    cited = F.coalesce(F.arrays_overlap("cited_chunk_ids", "relevant_chunk_ids"), F.lit(False))
    marks = [c("review.correct"), c("review.complete"), c("review.citation_supported"), c("review.uses_model_memory_or_guess")]
    open_ = marks[0].isNull() | marks[1].isNull() | marks[2].isNull() | marks[3].isNull()
    bad = ~marks[0] | ~marks[1] | ~marks[2] | marks[3]
    return (
        F.when(c("retrieved_chunk_ids").isNull() | c("evidence_sufficient").isNull(), STAGES[0])
        .when(~c("answerable") & c("evidence_sufficient"), STAGES[1])
        .when(~c("answerable") & c("refused"), STAGES[2])
        .when(~c("answerable"), STAGES[3])
        .when(~found, STAGES[4])
        .when(~c("evidence_sufficient"), STAGES[1])
        .when(c("refused") | ~cited, STAGES[3])
        .when(open_, STAGES[5])
        .when(bad, STAGES[3])
        .otherwise(STAGES[2])
    )


def score_cases(cases: DataFrame) -> DataFrame:
    return cases.select("*", fact_recall().alias("fact_recall"), *citation_scores(), metadata_complete().alias("citations_complete"), failure_stage().alias("stage"))


REVIEW = ("correct", "complete", "citation_supported", "uses_model_memory_or_guess")


def with_fact_bigrams(cases: DataFrame) -> DataFrame:
    """Adds fact_bigram_recall: the mean over a case's required facts of the share of their character pairs that the answer has."""
    facts = cases.where("answerable").select("id", F.posexplode("required_facts").alias("k", "fact"), F.when(F.col("refused"), "").otherwise(F.col("answer")).alias("said"))
    each = bigram_recall(facts, "fact", "said", ["id", "k"]).groupBy("id").agg(F.avg("recall").alias("fact_bigram_recall"))
    return cases.join(each, "id", "left")


def report(scored: DataFrame) -> DataFrame:
    """One row: twelve means, coverage and rates of the manual review, counts of stages.  A mean over no cases is null.

    ``scored``: rows of ``score_cases``, with fact_bigram_recall where ``with_fact_bigrams`` added it.
    """
    c, yes = F.col, F.col("answerable")
    mean = lambda cond, x, name: F.round(F.avg(F.when(cond, x.cast("double"))), 4).alias(name)
    bigrams = c("fact_bigram_recall") if "fact_bigram_recall" in scored.columns else F.lit(None).cast("double")
    marks = [c(f"review.{m}") for m in REVIEW]
    whole = marks[0].isNotNull() & marks[1].isNotNull() & marks[2].isNotNull() & marks[3].isNotNull()
    return scored.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(yes).alias("answerable_cases"), F.count_if(~yes).alias("no_answer_cases"),
        mean(yes, ~c("refused"), "answerable_answer_rate"), mean(~yes, c("refused"), "no_answer_refusal_accuracy"), mean(yes, c("fact_recall"), "fact_recall"), mean(yes, bigrams, "fact_bigram_recall"),
        mean(yes, c("citation_precision"), "citation_precision"), mean(yes, c("citation_recall"), "citation_recall"), mean(yes, c("supported"), "supported_citation_rate"), mean(yes, c("citations_complete"), "citation_metadata_complete_rate"),
        mean(yes & ~c("refused"), ~marks[0], "incorrect_answer_rate"), mean(~yes, ~c("refused"), "false_answer_rate"), mean(yes, c("refused"), "false_refusal_rate"), mean(~c("evidence_sufficient"), c("refused"), "insufficient_refusal_compliance"),
        F.count_if(yes & whole).alias("reviewed_answerable_cases"), mean(yes, F.coalesce(whole, F.lit(False)), "review_coverage"), *(mean(yes, m, f"review_{name}_rate") for m, name in zip(marks, REVIEW, strict=True)),
        *(F.count_if(c("stage") == s).alias(s) for s in STAGES),
    )


#: Shape of one case's result: what was asked of the tool, what it gave, what was answered.
CASE_RESULT = (
    "protocol_version string, id string, query string, "
    "tool_call struct<name: string, arguments: struct<query: string, limit: int>, result: struct<query: string, evidence_sufficient: boolean, confidence: double, reason: string, results: array<struct<chunk_id: string, source_file: string, page: int, text: string>>>>, "
    "prediction struct<id: string, answer: string, refused: boolean, cited_chunk_ids: array<string>, citations: array<struct<chunk_id: string, source_file: string, page: int>>>"
)
#: Fixed value: what is answered where the evidence isn't enough.
REFUSAL = "知识库证据不足，无法回答"


def protocol_violations(tasks: DataFrame, results: DataFrame, protocol: str, tool: str = "search_knowledge_base", refusal: str = REFUSAL) -> DataFrame:
    """(id, rule) for every rule that a result of shape ``CASE_RESULT`` breaks against its task (id, query, limit)."""
    c = F.col
    met = tasks.select("id", c("query").alias("asked"), c("limit").alias("most")).join(results, "id")
    got, said = c("tool_call.result.results"), c("prediction.citations")
    had, cited, named = got["chunk_id"], c("prediction.cited_chunk_ids"), said["chunk_id"]
    place = lambda rows: F.transform(rows, lambda r: F.struct(r["chunk_id"], r["source_file"], r["page"]))
    blank = lambda x: F.trim(F.coalesce(x, F.lit(""))) == ""
    whole = F.forall(got, lambda r: r["chunk_id"].isNotNull() & r["source_file"].isNotNull() & r["page"].isNotNull() & r["text"].isNotNull())
    enough, answered = c("tool_call.result.evidence_sufficient"), ~c("prediction.refused") & ~blank(c("prediction.answer")) & (F.size(said) > 0)
    refused = c("prediction.refused") & (c("prediction.answer") == refusal) & (F.size(cited) == 0) & (F.size(said) == 0)
    rules = {
        "protocol_version": c("protocol_version") != protocol,
        "query_differs_from_task": c("query") != c("asked"),
        "unexpected_tool": c("tool_call.name") != tool,
        "tool_arguments_differ_from_task": (c("tool_call.arguments.query") != c("asked")) | (c("tool_call.arguments.limit") != c("most")),
        "tool_result_query": c("tool_call.result.query") != c("asked"),
        "tool_result_incomplete": enough.isNull() | c("tool_call.result.confidence").isNull() | c("tool_call.result.reason").isNull(),
        "too_many_results": F.size(got) > c("most"),
        "result_field_missing": ~whole,
        "repeated_result": F.size(F.array_distinct(had)) < F.size(had),
        "prediction_id": c("prediction.id") != c("id"),
        "prediction_incomplete": c("prediction.answer").isNull() | c("prediction.refused").isNull(),
        "blank_citation": F.exists(cited, blank),
        "repeated_citation": F.size(F.array_distinct(cited)) < F.size(cited),
        "cited_chunk_not_retrieved": F.size(F.array_except(named, had)) > 0,
        "citation_differs_from_retrieval": F.size(F.array_except(place(said), place(got))) > 0,
        "citations_differ_from_cited_ids": named != cited,
        "must_answer_with_citation": enough & ~answered,
        "must_refuse_with_fixed_text": ~enough & ~refused,
    }
    broken = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules.items())))
    return met.select("id", F.explode(broken).alias("rule"))


def violations(results: DataFrame, refusal: str) -> DataFrame:
    """(id, rule) for every broken rule of a case result."""
    c = F.col
    cites = c("citations.chunk_id")
    had = c("retrieval_results.chunk_id")
    known = F.transform("retrieval_results", lambda r: F.struct(r["chunk_id"], r["source_file"], r["page"]))
    given = F.transform("citations", lambda r: F.struct(r["chunk_id"], r["source_file"], r["page"]))
    rules = [
        ("unsafe_id", ~F.coalesce(c("id"), F.lit("")).rlike("^[A-Za-z0-9._-]+$")),
        ("blank_query", F.trim(F.coalesce(c("query"), F.lit(""))) == ""),
        ("blank_answer", F.trim(F.coalesce(c("answer"), F.lit(""))) == ""),
        ("confidence_out_of_range", ~F.coalesce(c("confidence").between(0, 1), F.lit(False))),
        ("cited_chunk_not_retrieved", F.size(F.array_except("cited_chunk_ids", had)) > 0),
        ("repeated_citation", F.size(F.array_distinct("cited_chunk_ids")) < F.size("cited_chunk_ids")),
        ("citations_differ_from_cited_ids", (F.size(F.array_except(cites, c("cited_chunk_ids"))) > 0) | (F.size(F.array_except(c("cited_chunk_ids"), cites)) > 0)),
        ("citation_differs_from_retrieval", F.size(F.array_except(given, known)) > 0),
        ("refusal_text", c("refused") & (c("answer") != refusal)),
        ("refused_with_citations", c("refused") & (F.size("cited_chunk_ids") > 0)),
        ("answered_without_citations", ~c("refused") & (F.size("cited_chunk_ids") <= 0)),
        ("answered_against_evidence", ~c("refused") & ~c("evidence_sufficient")),
        ("refused_against_evidence", c("refused") & c("evidence_sufficient")),
    ]
    broken = F.array_compact(F.array(*(F.when(F.coalesce(cond, F.lit(True)), F.lit(name)) for name, cond in rules)))
    return results.select("id", F.explode(broken).alias("rule"))


def merge_predictions(tasks: DataFrame, results: DataFrame, protocol: str) -> DataFrame:
    """Predictions in the order of their tasks, reviews still open.  Ids must be the same on both sides, each once, and no rule may be broken."""
    for what, wrong in (("repeated ids", duplicate_ids(results)), ("ids on one side only", unmatched_ids(tasks, results)), ("broken rules", protocol_violations(tasks, results, protocol))):
        some = [tuple(r) for r in wrong.limit(5).collect()]
        if some:
            raise ValueError(f"{what}: {some}")
    c = F.col
    review = F.struct(*(F.lit(None).cast("boolean").alias(m) for m in REVIEW))
    out = tasks.select("id", "task_order").join(results, "id").select(
        "task_order", "id", "query", c("tool_call.result.evidence_sufficient").alias("evidence_sufficient"), c("tool_call.result.confidence").alias("confidence"), c("tool_call.result.reason").alias("reason"),
        c("tool_call.result.results").alias("retrieval_results"), c("prediction.answer").alias("answer"), c("prediction.refused").alias("refused"), c("prediction.cited_chunk_ids").alias("cited_chunk_ids"), c("prediction.citations").alias("citations"), review.alias("review"),
    )
    return out.orderBy("task_order").drop("task_order")
