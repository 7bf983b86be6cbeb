"""The engine: build an index, search it, assess the evidence."""

from __future__ import annotations

import time
from collections import OrderedDict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators import dense, evidence, fusion, index, ingest, lexical, rerank
from ..operators.common import settled
from ..sources import artifacts as files
from ..sources import publish
from .session import ship

#: Settings that an index is built with; another value of any means another index.
SETTINGS = ("schema_version", "target_tokens", "max_tokens", "overlap_tokens", "k1", "b", "tokenizer_version", "encoder_name", "rrf_k", "bm25_weight", "vector_weight")


def index_text(chunks: DataFrame):
    """What the lexical channel reads of a chunk."""
    return F.coalesce("retrieval_text", "text") if "retrieval_text" in chunks.columns else F.col("text")


def search_frame(chunks: DataFrame, vectors: DataFrame, queries: DataFrame, query_vectors: DataFrame, limit: int = 5, scorer=rerank.overlap_score, c: Config = DEFAULT, posts: DataFrame | None = None, lengths: DataFrame | None = None) -> DataFrame:
    """All queries at once.  ``chunks``: record_index, text, source_type, source_file, active, ...; ``queries``: qid, query.

    Inactive versions leave before any statistic is taken; the two channels, fusion,
    blending and protection then shrink to at most ``channel_limit`` rows a query.  A few
    queries are cheapest with the postings and lengths of a stored index, many without.
    """
    live = chunks.where(F.coalesce(F.col("active"), F.lit(True)))
    if posts is not None and lengths is not None:
        a = lexical.bm25_indexed(posts, lengths, live, queries, c=c)
    else:
        a = lexical.bm25(live.select("record_index", index_text(chunks).alias("text")), queries, c=c)
    b = dense.vector_search(vectors.join(live.select("record_index"), "record_index", "left_semi"), query_vectors, c.channel_limit, c.rank_digits)
    fused = settled(fusion.rrf_fuse(a, b, c.channel_limit, rrf_k=c.rrf_k, bm25_weight=c.bm25_weight, vector_weight=c.vector_weight))
    expanded = queries.select("qid", lexical.expand_query(F.col("query")).alias("query"))
    # Scores are settled: several windows follow, and the scorer may be a model.
    blended = rerank.rerank(settled(live.join(fused, "record_index").join(expanded, "qid")), scorer, c)
    out = rerank.protect_top(rerank.is_table_query(blended, c), c=c)
    return out.where(F.col("final_rank") <= limit).withColumn("rank", F.col("final_rank")).withColumn("reranker_score", F.round("reranker_raw", 6))


def check_request(query: str, limit: int, c: Config = DEFAULT) -> None:
    if not query or not query.strip():
        raise ValueError("the query is blank")
    if not 1 <= limit <= c.max_limit:
        raise ValueError(f"limit must be from 1 to {c.max_limit}")


class Engine:
    """An index in a folder, and a cache of results for its current version."""

    def __init__(self, spark: SparkSession, root: str, config: Config = DEFAULT, scorer=rerank.overlap_score, encoder: dense.Encoder = dense.hashed_encoder) -> None:
        self.spark, self.root, self.config, self.scorer, self.encoder = spark, root, config, scorer, encoder
        self._results: OrderedDict[tuple, list[dict]] = OrderedDict()
        self._loaded: tuple[str, dict, dict[str, DataFrame]] | None = None
        ship(spark)

    def settings(self) -> dict:
        return {name: getattr(self.config, name) for name in SETTINGS}

    def build_from_folder(self, folder: str, manifest: DataFrame | None = None, *, force: bool = False) -> dict:
        """Reads all artifacts below a folder, and its ``documents.json`` where no manifest is given."""
        if manifest is None:
            manifest = files.read_manifest(self.spark, folder)
        digest = index.artifacts_digest(files.artifact_files(self.spark, folder)).first().digest
        return self.build_index(index.with_attributes(files.read_artifacts(self.spark, folder)), manifest, force=force, artifacts_root=folder, artifacts_digest=digest)

    def build_index(self, artifacts: DataFrame, manifest: DataFrame, *, force: bool = False, artifacts_root: str | None = None, artifacts_digest: str | None = None) -> dict:
        """``artifacts``: kind, path, source_file, source_type, content, and what else their records shall carry.

        The published version is used again where it was built from the same records, in
        the same place, with the same settings, and is whole.
        """
        c = self.config
        records = settled(index.build_records(index.chunk_artifacts(artifacts, target=c.target_tokens, most=c.max_tokens, overlap=c.overlap_tokens), manifest))
        n = records.count()
        if not n:
            raise ValueError("there is nothing to index")
        said = [x for x in records.columns if x not in ("record_index", "kind", "path")]
        digest = index.content_digest(records, said).first().digest
        facts = {"version": digest, "settings": self.settings(), "artifacts_root": artifacts_root, "chunks": n}
        if not force and self._reusable(facts):
            return {"index_path": self.root, "chunks": n, "reused": True}
        vectors = settled(dense.encode(records, "record_index", "text", self.encoder))
        sizes = vectors.agg(F.min(F.size("vec")).alias("a"), F.max(F.size("vec")).alias("b")).first()
        if sizes.a != sizes.b:
            raise ValueError("the encoder's vectors differ in length")
        told = records.select("record_index", index_text(records).alias("text"))
        tables = {"chunks": records, "postings": lexical.postings(told), "lengths": lexical.document_lengths(told), "vectors": vectors, "versions": index.document_versions(records), "artifacts": artifacts, "manifest": manifest}
        metadata = facts | {
            "schema_version": c.schema_version, "tables": list(tables), "dimension": sizes.a, "documents": records.select("source_file").distinct().count(), "artifacts_digest": artifacts_digest,
            "built_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "built_ms": int(time.time() * 1000),
        }
        publish.publish(self.spark, self.root, tables, metadata)
        self.clear_caches()
        return {"index_path": self.root, "chunks": n, "reused": False}

    def _reusable(self, facts: dict) -> bool:
        try:
            metadata, tables = publish.load(self.spark, self.root)
            return all(metadata.get(k) == v for k, v in facts.items()) and tables["vectors"].count() == facts["chunks"] == tables["chunks"].count()
        except Exception:  # a version that can't be read is built again
            return False

    def load(self) -> tuple[dict, dict[str, DataFrame]]:
        """Metadata and tables of the live version, whose parts were compared."""
        version = publish.current(self.spark, self.root)
        if self._loaded is None or self._loaded[0] != version:
            metadata, tables = publish.load(self.spark, self.root)
            if metadata["schema_version"] != self.config.schema_version:
                raise ValueError("the index has another schema version")
            n = metadata["chunks"]
            vectors = tables["vectors"].agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("vec") != metadata["dimension"]).alias("bad")).first()
            posted = tables["postings"].agg(F.max("record_index").alias("last")).first().last
            if tables["chunks"].count() != n or vectors.n != n or (posted is not None and posted >= n):
                raise ValueError("the parts of the index differ in size")
            if vectors.bad:
                raise ValueError("the index's vectors differ in length")
            self._loaded = (version, metadata, tables)
        return self._loaded[1], self._loaded[2]

    def clear_caches(self) -> None:
        self._results.clear()
        self._loaded = None

    def search(self, query: str, limit: int = 5) -> list[dict]:
        check_request(query, limit, self.config)
        self.load()
        key = (query, limit, self._loaded[0])
        if key not in self._results:
            _, t = self.load()
            q = self.spark.createDataFrame([(0, query)], "qid long, query string")
            qv = dense.encode(q, "qid", "query", self.encoder, instruction=self.config.query_instruction)
            rows = search_frame(t["chunks"], t["vectors"], q, qv, limit, self.scorer, self.config, t["postings"], t["lengths"]).orderBy("rank").collect()
            self._results[key] = [r.asDict(recursive=True) for r in rows]
            while len(self._results) > 128:
                self._results.popitem(last=False)
        self._results.move_to_end(key)
        return [dict(r) for r in self._results[key]]

    def retrieve(self, query: str, limit: int = 5) -> dict:
        began = time.perf_counter()
        check_request(query, limit, self.config)
        self.load()
        hit = (query, limit, self._loaded[0]) in self._results
        rows = self.search(query, limit)
        found = time.perf_counter()
        q = self.spark.createDataFrame([(0, query)], "qid long, query string")
        schema = "qid long, rank int, text string, reranker_score double, matched_by array<string>, source_file string, low_confidence boolean, effective_date string, active boolean"
        shown = self.spark.createDataFrame([(0, r["rank"], r["text"], r["reranker_score"], r["matched_by"], r["source_file"], r.get("low_confidence"), r.get("effective_date"), r.get("active")) for r in rows], schema)
        verdict = evidence.assess(q, shown, c=self.config).first().asDict()
        ended = time.perf_counter()
        ms = lambda a, b: round(1000 * (b - a), 3)
        return {"query": query, "evidence_sufficient": verdict["evidence_sufficient"], "confidence": verdict["confidence"], "reason": verdict["reason"], "assessment": verdict, "diagnostics": {"cache_hit": hit, "retrieval_ms": ms(began, found), "assessment_ms": ms(found, ended), "total_ms": ms(began, ended)}, "results": rows}

    def profile_search(self, query: str, limit: int = 5) -> dict:
        began = time.perf_counter()
        self.load()
        loaded = time.perf_counter()
        rows = self.search(query, limit)
        return {"results": rows, "timings": {"load_ms": 1000 * (loaded - began), "search_ms": 1000 * (time.perf_counter() - loaded)}}

    def warmup(self) -> float:
        """Holds the tables and runs one search, which wakes scorer and encoder; milliseconds."""
        began = time.perf_counter()
        _, tables = self.load()
        for name in ("chunks", "vectors", "postings", "lengths"):
            tables[name].persist().count()
        q = self.spark.createDataFrame([(0, "warm up")], "qid long, query string")
        search_frame(tables["chunks"], tables["vectors"], q, dense.encode(q, "qid", "query", self.encoder), 1, self.scorer, self.config, tables["postings"], tables["lengths"]).count()
        return 1000 * (time.perf_counter() - began)

    def freshness(self) -> dict:
        """Whether the artifacts that the live version was built from are still the same; by time of change where it has no digest."""
        metadata, _ = self.load()
        folder = metadata.get("artifacts_root")
        if folder is None:
            return {"checked": False, "fresh": None}
        found = files.artifact_files(self.spark, folder)
        if metadata.get("artifacts_digest"):
            return {"checked": True, "by": "digest", "fresh": index.artifacts_digest(found).first().digest == metadata["artifacts_digest"]}
        later = found.where(F.unix_millis("modificationTime") > metadata["built_ms"]).limit(1).count()
        return {"checked": True, "by": "time", "fresh": later == 0}

    def status(self) -> dict:
        out = {"index_path": self.root, "cached_results": len(self._results), **{f: getattr(self.config, f) for f in self.config.__dataclass_fields__}}
        try:
            metadata, tables = self.load()
        except (FileNotFoundError, ValueError) as x:
            return out | {"ready": False, "error": str(x)}
        try:
            fresh = self.freshness()
        except Exception as x:  # the artifacts may be elsewhere by now; the index still answers
            fresh = {"checked": False, "fresh": None, "error": str(x)}
        return out | metadata | {"ready": True, "freshness": fresh, "document_versions": [r.asDict() for r in tables["versions"].collect()]}

    def ingest(self, pages: DataFrame, manifest: DataFrame | None, incoming: DataFrame, *, tables: DataFrame | None = None, dry_run: bool = False, allow_quality_failures: bool = False) -> dict:
        """Changes, gate, version upsert and index of extracted pages and tables; the old version stays until the new one is published.

        Artifacts of documents that don't come in are kept.  ``manifest`` defaults to that of the live version.
        """
        live = None if publish.current(self.spark, self.root) is None else self.load()[1]
        if manifest is None:
            manifest = live["manifest"] if live else self.spark.createDataFrame([], ingest.MANIFEST)
        changes = {r.source_file: r.change for r in ingest.change_summary(manifest, incoming).collect()}
        if dry_run:
            return {"dry_run": True, "changes": changes, "index_rebuilt": False}
        gate = ingest.quality_gate(pages).first().asDict()
        if not gate["passed"] and not allow_quality_failures:
            raise ValueError(f"the quality gate failed: {gate}")
        versions = settled(ingest.upsert_versions(manifest, incoming))
        artifacts = ingest.page_artifacts(pages)
        if tables is not None:
            artifacts = artifacts.unionByName(ingest.table_artifacts(tables), allowMissingColumns=True)
        if live:
            artifacts = live["artifacts"].join(incoming.select("source_file"), "source_file", "left_anti").unionByName(artifacts, allowMissingColumns=True)
        built = self.build_index(artifacts, versions, force=True)
        return {"dry_run": False, "changes": changes, "quality": gate, "index_rebuilt": True, "index": built, "documents": versions}
