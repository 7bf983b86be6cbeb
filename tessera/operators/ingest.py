"""Document versions: change detection, upsert and the quality gate."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SOURCE_TYPES = ("auto", "native", "scanned")
MANIFEST = "document_id string, source_file string, version string, effective_date string, sha256 string, active boolean"


def detect_type(pages: DataFrame, sample_pages: int = 3, least: int = 50) -> DataFrame:
    """(source_file, source_type) from extracted pages (source_file, page, text)."""
    from ..functions.text import alnum_count

    seen = F.sum(F.when(F.col("page") <= sample_pages, alnum_count(F.col("text"))).otherwise(0))
    return pages.groupBy("source_file").agg(F.when(seen >= least, "native").otherwise("scanned").alias("source_type"))


def change_summary(existing: DataFrame, plans: DataFrame) -> DataFrame:
    """(source_file, change): added, modified or unchanged."""
    old = existing.select("source_file", F.col("sha256").alias("old"))
    return plans.select("source_file", "sha256").join(old, "source_file", "left").select("source_file", F.when(F.col("old").isNull(), "added").when(F.col("old") != F.col("sha256"), "modified").otherwise("unchanged").alias("change"))


def upsert_versions(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Versions of incoming documents replace their predecessors as the active ones."""
    ids = incoming.select(F.col("document_id").alias("_in")).distinct()
    old = existing.join(incoming.select("source_file"), "source_file", "left_anti").join(ids, F.col("document_id") == F.col("_in"), "left")
    old = old.withColumn("active", F.when(F.col("_in").isNotNull(), False).otherwise(F.coalesce("active", F.lit(True)))).drop("_in")
    return old.unionByName(incoming.withColumn("active", F.lit(True)), allowMissingColumns=True)


def quality_gate(pages: DataFrame) -> DataFrame:
    """One row of counts.  ``pages``: decision, confidence, extraction_failures, extraction_diagnostics, quality_warnings.

    A page that goes to OCR without a confidence counts as one of low confidence.
    """
    low = (F.col("decision") == "ocr") & (F.coalesce("confidence", F.lit(0.0)) < 0.85)
    size = lambda name: F.coalesce(F.sum(F.size(F.coalesce(F.col(name), F.array().cast("array<string>")))), F.lit(0))
    out = pages.agg(size("extraction_failures").alias("failures"), size("extraction_diagnostics").alias("diagnostics"), size("quality_warnings").alias("warnings"), F.count_if(low).alias("low_confidence_pages"))
    return out.withColumn("passed", (F.col("failures") == 0) & (F.col("low_confidence_pages") == 0))


def validate_request(paths: list[str], source_type: str = "auto", document_id: str | None = None, effective_date: str | None = None) -> None:
    if not paths:
        raise ValueError("at least one document is needed")
    if document_id is not None and len(paths) != 1:
        raise ValueError("document_id goes with exactly one document")
    if source_type not in SOURCE_TYPES:
        raise ValueError(f"source_type must be one of {SOURCE_TYPES}")
    if effective_date is not None:
        date.fromisoformat(effective_date)


def _optional(frame: DataFrame, *names: str) -> list[str]:
    return [n for n in names if n in frame.columns]


def page_artifacts(pages: DataFrame) -> DataFrame:
    """Artifacts of extracted pages: native text, and OCR text with its confidence and the end of the page before.

    A page of a native document that was sent to OCR but has no OCR text stays an empty page.
    """
    ocr = F.col("decision") == "ocr"
    low = F.coalesce("confidence", F.lit(0.0)) < 0.85
    text = F.coalesce("indexed_text", "text") if "indexed_text" in pages.columns else F.col("text")
    return pages.select(
        F.lit(0).alias("kind"), F.concat("source_file", F.lit("/pages/"), F.format_string("page-%03d.md", "page")).alias("path"), "source_file", F.col("page").cast("int").alias("page"), F.when(ocr, "ocr").otherwise("pdf").alias("source_type"), text.alias("content"),
        F.when(ocr, F.col("confidence")).alias("confidence"), F.when(ocr, low).alias("low_confidence"), F.when(ocr & low, F.format_string("自动识别，建议核对原 PDF 第 %d 页", "page")).alias("processing_note"), *_optional(pages, "quality_warnings", "imported_at"),
    )


def table_artifacts(tables: DataFrame) -> DataFrame:
    """Artifacts of extracted tables: source_file, page, table_no, markdown, title, method, score."""
    return tables.select(
        F.lit(1).alias("kind"), F.concat("source_file", F.lit("/tables/"), F.format_string("page-%03d-table-%02d.md", "page", "table_no")).alias("path"), "source_file", F.col("page").cast("int").alias("page"), F.lit("table").alias("source_type"),
        F.concat(F.lit("# "), "title", F.lit("\n\n"), "markdown").alias("content"), F.concat("source_file", F.lit("#page-"), "page", F.lit("-table-"), "table_no").alias("table_id"), F.col("title").alias("table_title"), F.col("method").alias("extraction_method"),
        F.col("score").alias("extraction_score"), (F.col("score") < 0.60).alias("low_confidence"),
    )
