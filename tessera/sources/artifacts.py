"""Readers and writers of artifacts: front matter, JSON, vectors, extracted pages."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CASE = "id string, query string, source_file string, pages array<int>, category string, no_answer_type string, split string, source_type string, scenario string, relevant_chunk_ids array<string>, gold_answer string, required_facts array<string>"
PREDICTION = "id string, query string, answer string, refused boolean, evidence_sufficient boolean, confidence double, reason string, retrieval_results array<struct<chunk_id string, source_file string, page int, text string>>, cited_chunk_ids array<string>, citations array<struct<chunk_id string, source_file string, page int>>, review struct<correct boolean, complete boolean, citation_supported boolean, uses_model_memory_or_guess boolean>"


def stripped(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, "(?U)^\\s+|\\s+$", "")


def front_matter(raw: Column) -> tuple[Column, Column]:
    """Attributes and content of a text that may begin with a block of ``key: value`` lines between ``---``."""
    parts = F.split(raw, "---\n", 3)
    has = F.startswith(raw, F.lit("---\n")) & (F.size(parts) == 3)
    lines = F.filter(F.split(F.try_element_at(parts, F.lit(2)), "\n"), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(lines, lambda x: F.struct(stripped(F.substring_index(x, ":", 1)).alias("k"), stripped(F.regexp_replace(x, "^[^:]*:", "")).alias("v")))
    # A key that comes again overrides the one before.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["k"] == p["k"]))
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    return F.when(has, F.map_from_entries(last)).otherwise(empty), stripped(F.when(has, F.try_element_at(parts, F.lit(3))).otherwise(raw))


def with_front_matter(attributes: Column, content: Column) -> Column:
    """The text of an artifact: attributes in their order, then content."""
    lines = F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n\n"), content, F.lit("\n"))


def _below(spark: SparkSession, root: str, path: Column) -> Column:
    """The path of a file below the folder that was read, as it was written."""
    there = spark._jvm.org.apache.hadoop.fs.Path(root)
    home = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toUri()
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    # The path begins with the folder's; only its scheme may be written otherwise.
    return F.substring(decoded, F.instr(decoded, F.lit(home.getPath())) + len(home.getPath().rstrip("/")) + 1, F.length(decoded))


def read_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """(kind, path, attributes, content): pages (0), then tables (1); paths are relative to ``root``."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").text(root, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    files = files.select(_below(spark, root, F.col("file")).alias("path"), "raw")
    kind = F.when(F.concat(F.lit("/"), "path").rlike("/pages/[^/]*$"), 0).when(F.concat(F.lit("/"), "path").rlike("/tables/[^/]*$"), 1)
    attributes, content = front_matter(F.col("raw"))
    return files.select(kind.alias("kind"), "path", attributes.alias("attributes"), content.alias("content")).where("kind is not null")


def artifact_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content, modificationTime) of what an index is built from: the manifest, metadata, pages and tables."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.select(_below(spark, root, F.col("path")).alias("path"), "content", "modificationTime")
    return files.where(F.concat(F.lit("/"), "path").rlike("^/documents\\.json$|/metadata\\.json$|/(pages|tables)/[^/]*\\.md$"))


def write_artifacts(frame: DataFrame, path: str) -> None:
    """Texts with front matter, one row per artifact, as Parquet."""
    frame.select("path", with_front_matter(F.col("attributes"), F.col("content")).alias("raw")).write.mode("errorifexists").parquet(path)


MANIFEST = "document_id string, source_file string, source_type string, sha256 string, version string, effective_date string, active boolean"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The documents of ``documents.json`` in a folder of artifacts; none where there is no such file."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/documents.json")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return spark.createDataFrame([], MANIFEST)
    whole = read_json(spark, [f"{root}/documents.json"], f"schema_version int, documents array<struct<{MANIFEST.replace(' ', ': ').replace(',: ', ', ')}>>")
    if whole.where("schema_version <> 1").count():
        raise ValueError("documents.json has another schema version")
    return whole.select(F.inline("documents"))


def read_json(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Whole JSON documents; several files are one frame."""
    return spark.read.schema(schema).option("multiLine", "true").json(paths)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(record_index, vec) of a binary matrix file; rows are read on executors."""
    schema = "record_index long, vec array<float>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        for batch in batches:
            for content in batch.column(0):
                matrix = np.load(io.BytesIO(content.as_py()), allow_pickle=False).astype(np.float32)
                for at in range(0, len(matrix), 4096):
                    part = matrix[at : at + 4096]
                    vec = pa.ListArray.from_arrays(np.arange(0, part.size + 1, matrix.shape[1], dtype=np.int32), pa.array(part.reshape(-1)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), vec], ["record_index", "vec"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, schema)


#: A plug-in that turns one document's bytes into rows of PAGE; it is made once per Python worker.
Extractor = Callable[[], Callable[[str, bytes], Iterator[dict]]]
PAGE = "source_file string, page int, text string, width double, height double, confidence double, extraction_failures array<string>, extraction_diagnostics array<string>"


def text_extractor() -> Callable[[str, bytes], Iterator[dict]]:
    """The built-in extractor: UTF-8 text, pages divided by form feeds."""

    def pages(name: str, content: bytes) -> Iterator[dict]:
        for k, text in enumerate(content.decode("utf-8", "replace").split("\f"), 1):
            yield {"source_file": name, "page": k, "text": text, "width": 595.0, "height": 842.0, "confidence": None, "extraction_failures": [], "extraction_diagnostics": []}

    return pages


def extract_pages(spark: SparkSession, paths: list[str], extractor: Extractor = text_extractor) -> DataFrame:
    """Pages of documents; rows that come from a failure carry its message."""
    files = spark.read.format("binaryFile").load(paths).select(F.substring_index("path", "/", -1).alias("name"), "content")
    shape = pa.schema([("source_file", pa.string()), ("page", pa.int32()), ("text", pa.string()), ("width", pa.float64()), ("height", pa.float64()), ("confidence", pa.float64()), ("extraction_failures", pa.list_(pa.string())), ("extraction_diagnostics", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = extractor()
        for batch in batches:
            for name, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    rows = list(one(name, content))
                except Exception as x:  # a document that can't be read is reported by the quality gate
                    rows = [{"source_file": name, "page": 1, "text": "", "extraction_failures": [f"{type(x).__name__}: {x}"], "extraction_diagnostics": []}]
                yield pa.RecordBatch.from_pylist(rows, shape)

    return files.mapInArrow(run, PAGE)


def unseen_pages(pages: DataFrame, cached: DataFrame, start: int = 1, end: int | None = None) -> DataFrame:
    """Pages of the wanted range that have no stored OCR result yet."""
    wanted = pages.where(F.col("page") >= start)
    wanted = wanted if end is None else wanted.where(F.col("page") <= end)
    return wanted.join(cached.select("source_file", "page"), ["source_file", "page"], "left_anti")


def recognized_lines(pages: DataFrame, cached: DataFrame, recognize: Callable[[DataFrame], DataFrame], start: int = 1, end: int | None = None, dpi: int = 300) -> DataFrame:
    """OCR lines of all pages: stored ones as they are, whatever the range, and new ones of the pages in it that have none.

    ``recognize`` turns pages into rows like those of ``cached`` (source_file, page, x, y, text, score).
    """
    if dpi <= 0:
        raise ValueError("the resolution must be positive")
    have = cached.join(pages.select("source_file", "page").distinct(), ["source_file", "page"], "left_semi")
    return have.unionByName(recognize(unseen_pages(pages, cached, start, end)).select(*cached.columns))


def inside(root: str, path: str) -> str:
    """The absolute path, which must lie below root; root can't be the root of the file system."""
    top, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.dirname(top) == top:
        raise ValueError("the file system's root can't be the asset root")
    if os.path.commonpath([top, full]) != top:
        raise ValueError(f"{path} lies outside {root}")
    return full
