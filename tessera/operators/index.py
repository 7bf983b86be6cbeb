"""Records of an index: exact dedup in order, digests, versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents
from ..functions.text import clean_text
from .common import dense_index, ordered_digest, ranked


def first_wins(chunks: DataFrame, order: list, text_col: str = "text", scope: Column | None = None) -> DataFrame:
    """The first chunk of each whitespace-normalized text, in order.

    Equality goes by sha256 of the text, and the first place is a partial minimum, so a
    text that many chunks share leaves each task as one row.  ``scope`` limits the
    comparison, for instance to active versions.
    """
    key = F.sha2(clean_text(F.col(text_col)), 256)
    at = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    keyed = chunks.withColumn("_key", key if scope is None else F.concat(key, scope.cast("string"))).withColumn("_at", at)
    first = keyed.groupBy("_key").agg(F.min("_at").alias("_first"))
    return keyed.join(first, "_key").where(F.col("_at").eqNullSafe(F.col("_first"))).drop("_key", "_at", "_first")


#: Attributes of an artifact that its records carry, with their types.
ATTRIBUTES = {
    "imported_at": "string", "quality_warnings": "array<string>", "table_id": "string", "table_title": "string", "extraction_method": "string",
    "extraction_score": "double", "confidence": "double", "low_confidence": "boolean", "processing_note": "string",
}


def with_attributes(artifacts: DataFrame) -> DataFrame:
    """Artifacts (kind, path, attributes, content) with their source and the typed attributes as columns."""
    said = lambda name: F.try_element_at("attributes", F.lit(name))
    typed = {
        "array<string>": lambda x: F.when(x == "none", F.array().cast("array<string>")).otherwise(F.split(x, ",")),
        "boolean": lambda x: F.lower(x) == "true",
        "double": lambda x: x.try_cast("double"),
        "string": lambda x: x,
    }
    return artifacts.select(
        "kind", "path", "content", F.coalesce(said("source_file"), F.lit("unknown")).alias("source_file"), F.coalesce(said("page").try_cast("int"), F.lit(0)).alias("page"),
        F.coalesce(said("source_type"), F.lit("pdf")).alias("source_type"), *(typed[t](said(n)).alias(n) for n, t in ATTRIBUTES.items()),
    )


def chunk_artifacts(artifacts: DataFrame, **limits) -> DataFrame:
    """Chunks of artifacts (kind, path, source_file, source_type, content, ...): tables by rows, with their text for retrieval."""
    chunks = chunk_documents(artifacts, "path", "content", "source_type", **limits)
    return chunks.join(artifacts.drop("content"), "path").withColumnRenamed("chunk_text", "text")


def build_records(chunks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Deduplicated, numbered records with the manifest's attributes.

    ``chunks``: kind (0 page, 1 table), path, chunk_index, text, source_file, ...; order is kind, path by parts, chunk_index.
    """
    order = ["kind", F.split("path", "/"), "chunk_index"]
    kept = first_wins(chunks, [F.col("kind"), F.split("path", "/").alias("parts"), F.col("chunk_index")])
    numbered = dense_index(kept, order)
    attributes = manifest.select("source_file", "document_id", "version", "effective_date", F.coalesce("active", F.lit(True)).alias("active"), F.col("sha256").alias("source_sha256"))
    return numbered.join(attributes, "source_file", "left").withColumn("chunk_id", F.concat("path", F.lit("#"), "chunk_index")).withColumn("content_sha256", F.sha2("text", 256))


def content_digest(records: DataFrame, columns: list[str], index: str = "record_index") -> DataFrame:
    """One digest over all records in order."""
    return ordered_digest(records, index, F.sha2(F.to_json(F.struct(*sorted(columns))), 256))


def document_versions(records: DataFrame) -> DataFrame:
    """The first record of every file decides its version."""
    first = ranked(records, ["source_file"], ["record_index"], "_k").where("_k = 1")
    return first.select("source_file", "document_id", "version", "effective_date", F.coalesce("active", F.lit(True)).alias("active")).orderBy("source_file")


def artifacts_digest(files: DataFrame) -> DataFrame:
    """Digest over (path, content) of a binaryFile frame, by path."""
    return ordered_digest(dense_index(files.select("path", "content"), [F.split("path", "/")]), "record_index", F.sha2(F.concat(F.encode("path", "UTF-8"), F.lit(b"\0"), F.col("content"), F.lit(b"\0")), 256))
