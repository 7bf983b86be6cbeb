"""Command lines, and the tool server over the engine."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import ingest
from ..sources import artifacts
from .engine import Engine

TOOLS = ("knowledge_base_status", "search_knowledge_base")
#: What the tools take, as the protocol's clients ask for it.
SCHEMAS = (
    {"name": TOOLS[0], "description": "State of the index.", "inputSchema": {"type": "object", "properties": {}}},
    {"name": TOOLS[1], "description": "Passages for a question, and whether they are evidence enough.", "inputSchema": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1, "maximum": 10, "default": 5}}, "required": ["query"]}},
)
PROTOCOL = "2024-11-05"


def call(engine: Engine, name: str, arguments: dict) -> dict:
    """One tool call."""
    if name == TOOLS[0]:
        return engine.status()
    if name == TOOLS[1]:
        return engine.retrieve(arguments["query"], int(arguments.get("limit", 5)))
    raise ValueError(f"unknown tool: {name}")


def answer(engine: Engine, request: dict) -> dict | None:
    """The reply to one JSON-RPC request; notifications have none."""
    method, params = request.get("method"), request.get("params") or {}
    if "id" not in request:
        return None
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    try:
        if method == "initialize":
            return reply | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "tessera", "version": "1"}}}
        if method == "ping":
            return reply | {"result": {}}
        if method == "tools/list":
            return reply | {"result": {"tools": list(SCHEMAS)}}
        if method == "tools/call":
            said = call(engine, params["name"], params.get("arguments") or {})
            return reply | {"result": {"content": [{"type": "text", "text": json.dumps(said, ensure_ascii=False, default=str)}], "structuredContent": json.loads(json.dumps(said, default=str)), "isError": False}}
        return reply | {"error": {"code": -32601, "message": f"unknown method: {method}"}}
    except (KeyError, ValueError, FileNotFoundError) as x:
        return reply | {"error": {"code": -32602, "message": str(x)}}


def serve(engine: Engine, lines=sys.stdin, out=sys.stdout, prewarm: bool = False) -> None:
    """JSON-RPC 2.0, one message a line."""
    if prewarm and engine.status()["ready"]:
        engine.warmup()
    for line in filter(str.strip, lines):
        try:
            reply = answer(engine, json.loads(line))
        except json.JSONDecodeError as x:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": str(x)}}
        if reply is not None:
            print(json.dumps(reply, ensure_ascii=False, default=str), file=out, flush=True)


def ingest_documents(engine: Engine, paths: list[str], source_type: str = "auto", document_id: str | None = None, version: str | None = None, effective_date: str | None = None, dry_run: bool = False, allow_quality_failures: bool = False, extractor: artifacts.Extractor = artifacts.text_extractor) -> dict:
    """Reads documents, tells native ones from scanned ones, and publishes them with the documents that the index has."""
    ingest.validate_request(paths, source_type, document_id, effective_date)
    spark = engine.spark
    pages = artifacts.extract_pages(spark, paths, extractor)
    kinds = ingest.detect_type(pages) if source_type == "auto" else pages.select("source_file", F.lit(source_type).alias("source_type")).distinct()
    pages = pages.join(kinds.select("source_file", F.col("source_type").alias("document_type")), "source_file")
    pages = pages.withColumn("decision", F.when(F.col("document_type") == "scanned", "ocr").otherwise("native")).withColumn("quality_warnings", F.array().cast("array<string>"))
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, "\\.[^.]*$", "")
    incoming = spark.read.format("binaryFile").load(paths).select(
        (F.lit(document_id) if document_id else stem).alias("document_id"), name.alias("source_file"), F.lit(version).alias("version"), F.lit(effective_date).alias("effective_date"), F.sha2("content", 256).alias("sha256"),
    )
    out = engine.ingest(pages, None, incoming, dry_run=dry_run, allow_quality_failures=allow_quality_failures)
    if "documents" in out:
        out["documents"] = [r.asDict() for r in out["documents"].orderBy("source_file").collect()]
    return out | {"source_types": {r.source_file: r.source_type for r in kinds.collect()}}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["build", "search", "retrieve", "status", "serve", "ingest"])
    p.add_argument("words", nargs="*", help="the query, or the documents to ingest")
    p.add_argument("--index", required=True)
    p.add_argument("--artifacts", help="folder of pages/*.md and tables/*.md to build from")
    p.add_argument("--limit", type=int, default=5)
    p.add_argument("--force", action="store_true")
    p.add_argument("--source-type", default="auto", choices=list(ingest.SOURCE_TYPES))
    p.add_argument("--document-id")
    p.add_argument("--version")
    p.add_argument("--effective-date")
    p.add_argument("--dry-run", action="store_true")
    p.add_argument("--allow-quality-failures", action="store_true")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = parser()
    args = p.parse_args(argv)
    query = " ".join(args.words)
    if args.command in ("search", "retrieve") and not query.strip():
        p.error("search and retrieve need a query")
    if args.command == "build" and not args.artifacts:
        p.error("build needs --artifacts")
    if args.command == "ingest" and not args.words:
        p.error("ingest needs documents")
    engine = Engine(spark or SparkSession.builder.appName("tessera").getOrCreate(), args.index)
    if args.command == "serve":
        serve(engine, prewarm=os.environ.get("TESSERA_PREWARM", "1") != "0")
        return 0
    out = {
        "build": lambda: engine.build_from_folder(args.artifacts, force=args.force),
        "search": lambda: engine.search(query, args.limit),
        "retrieve": lambda: engine.retrieve(query, args.limit),
        "status": engine.status,
        "ingest": lambda: ingest_documents(engine, args.words, args.source_type, args.document_id, args.version, args.effective_date, args.dry_run, args.allow_quality_failures),
    }[args.command]()
    print(json.dumps(out, ensure_ascii=False, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
