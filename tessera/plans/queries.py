"""Registered queries over the driver's tables, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.chunking import chunk_documents
from ..functions.text import normalized, token_count, tokens
from ..operators import answers, dense, evaluate, evidence, extract, fusion, index, ingest, integrity, lexical, rerank
from ..operators.common import dense_index, ordered_digest
from ..sources import artifacts
from .engine import search_frame

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _t(x: str) -> str:
    return rf"regexp_extract_all(lower({x}), '[\x{{4e00}}-\x{{9fff}}]|[a-z0-9]+(?:[._/-][a-z0-9]+)*')"


# --- text, postings, BM25 ---


def chunks_of(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks: one kind of source is tabular, one language is inactive."""
    return table(spark, d, "documents").select(F.col("doc_id").alias("record_index"), "text", F.when(F.col("source") == "src3", "table").otherwise("pdf").alias("source_type"), F.col("source").alias("source_file"), (F.col("lang") != "fr").alias("active"))


def asked(spark: SparkSession, d: str) -> DataFrame:
    """Every benchmark item as a query, with its whole text."""
    return table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query"))


@query(rf"select doc_id, len({_t('text')})::int as n_tokens, len(regexp_extract_all(text, '[\x{{4e00}}-\x{{9fff}}]|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[^\s]'))::int as n_fallback from documents")
def tokenize_counts(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens(F.col("text"))).alias("n_tokens"), token_count(F.col("text")).alias("n_fallback"))


@query(f"select term, count(*) as df, sum(tf)::bigint as cf from (select doc_id, term, count(*) as tf from (select doc_id, unnest({_t('text')}) as term from documents) group by all) group by term")
def postings_df(spark, d):
    return lexical.postings(chunks_of(spark, d)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"))


@query(f"select source, count(*) as n, round(avg(len({_t('text')})), 6) as avg_len, max(len({_t('text')}))::int as max_len from documents group by source")
def doc_length_stats(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.size(tokens(F.col("text")))), 6).alias("avg_len"), F.max(F.size(tokens(F.col("text")))).alias("max_len"))


_ASKED = "q as (select item_id as qid, text as query from benchmark)"


def _bm25(where: str) -> str:
    return f"""
qtf as (select qid, term, count(*) as qtf from (select qid, unnest({_t("query")}) as term from q) group by all),
d as (select doc_id, {_t("text")} as t from documents {where}),
st as (select count(*) as n, avg(len(t)) as avgdl from d),
post as (select doc_id, term, dl, count(*) as tf from (select doc_id, len(t) as dl, unnest(t) as term from d) group by all),
df as (select term, count(*) as df from post group by term),
bs as (select qid, doc_id as record_index, round(sum(qtf * ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.5::double / (tf + 1.5::double * (0.25::double + 0.75::double * dl / avgdl))), 6) as score
  from qtf join post using (term) join df using (term), st group by all),
bm as (select * from (select qid, record_index, score, (row_number() over (partition by qid order by score desc, record_index))::int as rank from bs where score > 0) where rank <= 20)"""


_ENGLISH = "where lang = 'en'"


@query(f"with {_ASKED}, {_bm25('')} select * from bm")
def bm25_topk(spark, d):
    return lexical.bm25(chunks_of(spark, d), asked(spark, d))


@query(f"with {_ASKED}, {_bm25(_ENGLISH)} select * from bm")
def bm25_active_subset(spark, d):
    """Statistics are those of the active documents alone."""
    active = table(spark, d, "documents").where("lang = 'en'").select(F.col("doc_id").alias("record_index"), "text")
    return lexical.bm25(active, asked(spark, d))


@query(f"""with {_ASKED}, qc as (select qid, term, count(*) as tf from (select qid, unnest({_t("query")}) as term from q) group by all),
dc as (select doc_id, term, count(*) as tf from (select doc_id, unnest({_t("text")}) as term from documents) group by all),
n as (select count(*) as n from documents), df as (select term, count(*) as df from dc group by term),
dv as (select doc_id, ('0x' || substr(md5(term), 1, 7))::bigint % 512 as b, sum((1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1)) as w from dc left join df using (term), n group by all),
qv as (select qid, ('0x' || substr(md5(term), 1, 7))::bigint % 512 as b, sum((1 + ln(tf)) * (ln((n + 1) / (coalesce(df, 0) + 1)) + 1)) as v from qc left join df using (term), n group by all),
dl as (select doc_id, sqrt(sum(w * w)) as dl from dv group by 1), ql as (select qid, sqrt(sum(v * v)) as ql from qv group by 1),
s as (select qid, doc_id as record_index, sum(w * v) as dot from dv join qv using (b) group by all),
r as (select qid, record_index, round(dot / (dl * ql), 6) as score from s join dl on dl.doc_id = s.record_index join ql using (qid))
select * from (select *, (row_number() over (partition by qid order by score desc, record_index))::int as rank from r where score > 0) where rank <= 20""")
def legacy_tfidf_topk(spark, d):
    return lexical.legacy_tfidf(chunks_of(spark, d), asked(spark, d))


# --- dense search and fusion ---


def vectors_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("record_index"), F.col("embedding").alias("vec"))


_DOT = "round(list_inner_product(a.embedding::double[], b.embedding::double[]), 6)"
_VECTOR = f"select * from (select *, (row_number() over (partition by qid order by score desc, record_index))::int as rank from (select a.vec_id as qid, b.vec_id as record_index, {_DOT} as score from embeddings a, embeddings b where a.vec_id % 100 = 0)) where rank <= 20"


def _nearest(spark: SparkSession, d: str) -> DataFrame:
    v = vectors_of(spark, d)
    return dense.vector_search(v, v.where("record_index % 100 = 0").select(F.col("record_index").alias("qid"), "vec"))


@query(_VECTOR)
def vector_topk(spark, d):
    return _nearest(spark, d)


_VE = f"""ve as (select * from (select *, (row_number() over (partition by qid order by score desc, record_index))::int as rank from (
  select q.qid, b.vec_id as record_index, {_DOT} as score from q join embeddings a on a.vec_id = q.qid, embeddings b join documents d on d.doc_id = b.vec_id and d.lang <> 'fr')) where rank <= 20)"""
_FU = """fb as (select qid, record_index, round(coalesce(3.0::double / (1 + bm.rank), 0) + coalesce(1.0::double / (1 + ve.rank), 0), 9) as rrf_score, bm.rank as bm25_rank, ve.rank as vector_rank from bm full join ve using (qid, record_index)),
fu as (select * from (select *, (row_number() over (partition by qid order by rrf_score desc, record_index))::int as retrieval_rank from fb) where retrieval_rank <= 20)"""
_LIVE = "where lang <> 'fr'"


def _ranks() -> list:
    """Ranks of both channels, 0 where a row is absent."""
    return [F.coalesce(c, F.lit(0)).alias(c) for c in ("bm25_rank", "vector_rank")]


def _fused(spark: SparkSession, d: str) -> DataFrame:
    live = chunks_of(spark, d).where("active")
    qs = asked(spark, d)
    qv = vectors_of(spark, d).withColumnRenamed("record_index", "qid").join(qs.select("qid"), "qid", "left_semi")
    b = dense.vector_search(vectors_of(spark, d).join(live.select("record_index"), "record_index", "left_semi"), qv)
    return fusion.rrf_fuse(lexical.bm25(live, qs), b, rrf_k=1, bm25_weight=3.0, vector_weight=1.0)


@query(f"with {_ASKED}, {_bm25(_LIVE)}, {_VE}, {_FU} select qid, record_index, rrf_score, coalesce(bm25_rank, 0) as bm25_rank, coalesce(vector_rank, 0) as vector_rank, retrieval_rank from fu")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("qid", "record_index", "rrf_score", *_ranks(), "retrieval_rank")


def _blend(raw: str) -> str:
    return f"""sc as (select fu.*, q.query, d.text, d.source, case when d.source = 'src3' then 'table' else 'pdf' end as source_type, {raw} as reranker_raw from fu join q using (qid) join documents d on d.doc_id = fu.record_index),
sr as (select *, row_number() over (partition by qid order by reranker_raw desc, retrieval_rank) as score_rank, count(*) over (partition by qid) as cn from sc),
sn as (select *, round(1.0::double - (score_rank - 1)::double / greatest(1, cn - 1) + 0.16::double / retrieval_rank, 9) as reranker_score from sr),
bl as (select *, (row_number() over (partition by qid order by reranker_score desc, retrieval_rank, record_index))::int as blended_rank from sn)"""


_PR = """pg as (select *, bool_or(retrieval_rank <= 5 and source_type = 'table') over (partition by qid) as tq from bl),
pa as (select *, cn > 5 and retrieval_rank <= 5 and ((tq and source_type = 'table') or reranker_raw >= 0.97) as protected from pg),
pm as (select *, case when protected and blended_rank > 5 then row_number() over (partition by qid, protected and blended_rank > 5 order by blended_rank) end as m,
  case when not protected and blended_rank <= 5 then row_number() over (partition by qid, not protected and blended_rank <= 5 order by blended_rank desc) end as s from pa),
pj as (select x.*, y.blended_rank as slot, z.m as taken from pm x left join pm y on y.qid = x.qid and y.s = x.m left join pm z on z.qid = x.qid and z.m = x.s),
pr as (select *, (row_number() over (partition by qid order by case when taken is not null or (slot is null and blended_rank > 5) then 1 else 0 end, coalesce(slot, blended_rank)))::int as final_rank from pj)"""

_PSEUDO = "((record_index * 37 + qid * 11) % 101) / 100.0::double"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    met = chunks_of(spark, d).join(_fused(spark, d), "record_index").join(asked(spark, d), "qid")
    return rerank.rerank_from_scores(met.withColumn("reranker_raw", F.expr("((record_index * 37 + qid * 11) % 101) / 100.0D")))


@query(f"with {_ASKED}, {_bm25(_LIVE)}, {_VE}, {_FU}, {_blend(_PSEUDO)} select qid, record_index, reranker_raw, reranker_score, retrieval_rank, blended_rank from bl")
def rerank_blend(spark, d):
    return _scored(spark, d).select("qid", "record_index", "reranker_raw", "reranker_score", "retrieval_rank", "blended_rank")


@query(f"with {_ASKED}, {_bm25(_LIVE)}, {_VE}, {_FU}, {_blend(_PSEUDO)}, {_PR} select qid, record_index, protected, blended_rank, final_rank from pr")
def top5_protect(spark, d):
    return rerank.protect_top(rerank.is_table_query(_scored(spark, d))).select("qid", "record_index", "protected", "blended_rank", "final_rank")


def _grams(x: str) -> str:
    c = rf"regexp_extract_all(regexp_replace(lower({x}), '[^0-9a-z\x{{4e00}}-\x{{9fff}}]', '', 'g'), '.')"
    return f"list_distinct(list_transform(list_zip({c}[:-2], {c}[2:]), lambda p: p[1] || p[2]))"


_OVERLAP = f"0.01::double + 0.98::double * least(1.0::double, greatest(0.0::double, len(list_intersect({_grams('q.query')}, {_grams('d.text')}))::double / greatest(len({_grams('q.query')}), 1)))"


def _results(spark: SparkSession, d: str) -> DataFrame:
    qs = asked(spark, d)
    qv = vectors_of(spark, d).withColumnRenamed("record_index", "qid").join(qs.select("qid"), "qid", "left_semi")
    return search_frame(chunks_of(spark, d), vectors_of(spark, d), qs, qv)


_SEARCH = f"{_ASKED}, {_bm25(_LIVE)}, {_VE}, {_FU}, {_blend(_OVERLAP)}, {_PR}"


@query(f"with {_SEARCH} select qid, record_index, final_rank as rank, round(reranker_raw, 6) as reranker_score, rrf_score, retrieval_rank, coalesce(bm25_rank, 0) as bm25_rank, coalesce(vector_rank, 0) as vector_rank, source as source_file, source_type from pr where final_rank <= 5")
def search_results(spark, d):
    return _results(spark, d).select("qid", "record_index", "rank", "reranker_score", "rrf_score", "retrieval_rank", *_ranks(), "source_file", "source_type")


@query(f"""with {_SEARCH},
t3 as (select *, round(reranker_raw, 6) as rs from pr where final_rank <= 3),
mo as (select qid, max(n) as modal from (select qid, source, count(*) as n from t3 group by all) group by qid),
fa as (select qid, any_value(query) as query, count(*) as n, max(rs) filter (where final_rank = 1) as top_score, coalesce(max(rs) filter (where final_rank = 2), 0) as second,
  bool_or(final_rank = 1 and bm25_rank is not null and vector_rank is not null) as agree, string_agg(text, ' ' order by final_rank) as ev from t3 group by qid),
si as (select qid, n, top_score, greatest(0, top_score - second) as margin, coalesce(len(list_intersect({_grams("query")}, {_grams("ev")}))::double / nullif(len({_grams("query")}), 0), 0) as coverage, agree, modal::double / n as consistency from fa join mo using (qid)),
co as (select *, round(greatest(0.0::double, least(1.0::double, 0.65::double * greatest(0.0::double, least(1.0::double, top_score)) + 0.1::double * greatest(0.0::double, least(1.0::double, 2 * margin)) + 0.1::double * coverage + 0.1::double * agree::int + 0.05::double * consistency)), 4) as confidence from si)
select q.qid, coalesce(n, 0)::int as n, round(coalesce(coverage, 0), 6) as coverage, coalesce(agree, false) as agree, round(coalesce(consistency, 0), 6) as consistency, coalesce(confidence, 0.0) as confidence,
  coalesce(top_score >= 0.1 and confidence >= 0.6 and coverage >= 0.25, false) as evidence_sufficient,
  case when n is null then 'no_retrieval_results' when coverage < 0.25 then 'insufficient_query_evidence_overlap' when top_score >= 0.1 and confidence >= 0.6 then 'supported_by_retrieved_evidence' else 'insufficient_retrieval_evidence' end as reason
from q left join co using (qid)""")
def evidence_decision(spark, d):
    shown = _results(spark, d).withColumn("low_confidence", F.lit(False)).withColumn("effective_date", F.lit(None).cast("string"))
    out = evidence.assess(asked(spark, d), shown)
    return out.select("qid", F.col("n").cast("int").alias("n"), F.round("coverage", 6).alias("coverage"), "agree", F.round("consistency", 6).alias("consistency"), "confidence", "evidence_sufficient", "reason")


# --- index and ingest ---

_NORM = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query(f"select doc_id, source, sha256({_NORM}) as text_sha256 from (select *, row_number() over (partition by {_NORM} order by source, doc_id) as k from documents) where k = 1")
def dedup_first_wins(spark, d):
    kept = index.first_wins(table(spark, d, "documents"), ["source", "doc_id"])
    from ..functions.text import clean_text

    return kept.select("doc_id", "source", F.sha2(clean_text(F.col("text")), 256).alias("text_sha256"))


@query("""with a as (select row_number() over (order by doc_id) - 1 as i, sha256(text) as h from documents),
b as (select i // 4096 as i, sha256(string_agg(h, '' order by i)) as h from a group by i // 4096),
c as (select i // 4096 as i, sha256(string_agg(h, '' order by i)) as h from b group by i // 4096),
e as (select i // 4096 as i, sha256(string_agg(h, '' order by i)) as h from c group by i // 4096)
select sha256(string_agg(h, '' order by i)) as digest from e""")
def content_digest(spark, d):
    rows = dense_index(table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")), ["doc_id"])
    return ordered_digest(rows, "record_index", F.col("h"))


@query("select 'doc-' || doc_id as source_file, case when doc_id % 3 = 0 then 'added' when doc_id % 5 = 0 then 'modified' else 'unchanged' end as change from documents")
def change_summary(spark, d):
    docs = table(spark, d, "documents")
    old = docs.select(F.concat(F.when(F.col("doc_id") % 3 == 0, "old-").otherwise("doc-"), "doc_id").alias("source_file"), F.sha2("text", 256).alias("sha256"))
    new = docs.select(F.concat(F.lit("doc-"), "doc_id").alias("source_file"), F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return ingest.change_summary(old, new)


@query("select 'd' || (doc_id // 2) as document_id, 'f' || doc_id as source_file, '2023' as version, (doc_id // 2) % 4 <> 0 as active from documents union all select distinct 'd' || (doc_id // 2), 'n' || (doc_id // 2), '2024', true from documents where (doc_id // 2) % 4 = 0")
def version_upsert(spark, d):
    docs = table(spark, d, "documents").withColumn("g", F.expr("doc_id div 2"))
    old = docs.select(F.concat(F.lit("d"), "g").alias("document_id"), F.concat(F.lit("f"), "doc_id").alias("source_file"), F.lit("2023").alias("version"), F.lit(True).alias("active"))
    new = docs.where("g % 4 = 0").select(F.concat(F.lit("d"), "g").alias("document_id"), F.concat(F.lit("n"), "g").alias("source_file"), F.lit("2024").alias("version")).distinct()
    return ingest.upsert_versions(old, new)


@query("""with p as (select case when quality = 0 then 'ocr' else 'native' end as decision, case when toxic = 1 then 0.9 end as confidence, toxic, length(text) < 500 as short from documents left join labels using (doc_id))
select coalesce(sum(toxic), 0)::bigint as failures, 0::bigint as diagnostics, (count(*) filter (where short)) as warnings, count(*) filter (where decision = 'ocr' and coalesce(confidence, 0) < 0.85) as low_confidence_pages,
  coalesce(sum(toxic), 0) = 0 and count(*) filter (where decision = 'ocr' and coalesce(confidence, 0) < 0.85) = 0 as passed from p""")
def quality_gate(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    none = F.array().cast("array<string>")
    pages = rows.select(F.when(F.col("quality") == 0, "ocr").otherwise("native").alias("decision"), F.when(F.col("toxic") == 1, 0.9).alias("confidence"), F.when(F.col("toxic") == 1, F.array(F.lit("x"))).otherwise(none).alias("extraction_failures"), none.alias("extraction_diagnostics"), F.when(F.length("text") < 500, F.array(F.lit("short"))).otherwise(none).alias("quality_warnings"))
    return ingest.quality_gate(pages)


@query()
def chunk_text(spark, d):
    return chunk_documents(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "chunk_index", "n_tokens", F.sha2("chunk_text", 256).alias("chunk_sha256"))


def _stripped(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@query(f"""select page_id, {_stripped("coalesce(url, '')")} as url, {_stripped("regexp_extract(coalesce(html, ''), '<title>([^<]*)</title>', 1)")} as title, sha256({_stripped("coalesce(html, '')")}) as content_sha256 from pages""")
def page_frontmatter(spark, d):
    pages = table(spark, d, "pages").select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    raw = F.concat(F.lit("---\nurl: "), "url", F.lit("\ntitle: "), F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit("\n---\n"), "html")
    attributes, content = artifacts.front_matter(F.col("raw"))
    read = pages.withColumn("raw", raw).select("page_id", attributes.alias("a"), content.alias("c"))
    return read.select("page_id", F.try_element_at("a", F.lit("url")).alias("url"), F.try_element_at("a", F.lit("title")).alias("title"), F.sha2("c", 256).alias("content_sha256"))


@query(r"""select conv_id, turn, case when regexp_matches(text, '^[A-Z][a-z]{1,4} ') and p <> '' then '上页续文：' || right(regexp_replace(p, '\s', '', 'g'), 32) end as continued_from
from (select *, lag(text) over (partition by conv_id order by turn) as p from conversations)""")
def page_continuation(spark, d):
    return extract.continue_pages(table(spark, d, "conversations"), ["conv_id"], "turn", begins="^[A-Z][a-z]{1,4} ").select("conv_id", "turn", "continued_from")


# --- tables as chunks ---

_ROW = "'| ' || o_orderkey || ' | ' || o_orderpriority || ' | ' || o_totalprice::decimal(18, 2) || ' |'"
_FALLBACK = r"'[\x{4e00}-\x{9fff}]|[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*|[^\s]'"


@query(rf"""with recursive r as (select o_custkey as c, (row_number() over (partition by o_custkey order by o_orderkey))::int as k, {_ROW} as line, '订单：' || o_orderkey || '；级别：' || o_orderpriority || '；金额：' || o_totalprice::decimal(18, 2) as said from orders),
n as (select *, len(regexp_extract_all(line, {_FALLBACK})) as n from r),
h as (select c, '# 客户 ' || c || chr(10) || '| 订单 | 级别 | 金额 |' || chr(10) || '| --- | --- | --- |' as head from r group by c),
z as (select c, head, len(regexp_extract_all(head, {_FALLBACK})) as z from h),
st as (
  select n.c, n.k, n.k as first, z + n as held from n join z on z.c = n.c where n.k = 1
  union all
  select n.c, n.k, case when held >= 60 or held + n > 80 then n.k else first end, case when held >= 60 or held + n > 80 then z + n else held + n end from st join n on n.c = st.c and n.k = st.k + 1 join z on z.c = n.c
),
g as (select st.c, first, max(st.k) as last, string_agg(line, chr(10) order by st.k) as lines, string_agg(said, chr(10) order by st.k) as told from st join n on n.c = st.c and n.k = st.k group by st.c, first)
select g.c as custkey, (row_number() over (partition by g.c order by first))::int as chunk_index, first as row_start, last as row_end, sha256(head || chr(10) || lines) as chunk_sha256,
  sha256('表名：客户 ' || g.c || chr(10) || '字段：订单、级别、金额' || chr(10) || told) as retrieval_sha256 from g join z on z.c = g.c""")
def table_chunks(spark, d):
    """A table of orders per customer, cut between rows."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", F.concat(F.lit("| "), "o_orderkey", F.lit(" | "), "o_orderpriority", F.lit(" | "), F.col("o_totalprice").cast("decimal(18,2)"), F.lit(" |")).alias("line"))
    head = F.concat(F.lit("# 客户 "), "custkey", F.lit("\n| 订单 | 级别 | 金额 |\n| --- | --- | --- |\n"))
    texts = rows.groupBy("custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "line"))), lambda x: x["line"]), "\n").alias("lines"))
    chunks = chunk_documents(texts.select("custkey", F.concat(head, "lines").alias("text"), F.lit("table").alias("kind")), "custkey", "text", "kind", target=60, most=80)
    return chunks.select("custkey", "chunk_index", "row_start", "row_end", F.sha2("chunk_text", 256).alias("chunk_sha256"), F.sha2("retrieval_text", 256).alias("retrieval_sha256"))


# --- extraction ---

_BLOCKS = """b as (select l_orderkey as page, l_linenumber as block_no, min(l_partkey) as p, min(l_suppkey) as s from lineitem group by all),
k as (select page, block_no, ((p * 37) % 540)::double as x0, ((s * 53 + block_no * 40) % 700)::double as y0, ((p * 37) % 540 + 20 + p % 50)::double as x1, ((s * 53 + block_no * 40) % 700 + 10 + p % 15)::double as y1,
  case p % 6 when 0 then ' ' when 1 then 'ab' || chr(10) || ' ab ' when 2 then chr(65533) || chr(65533) || ' x' when 3 then 'words of block ' || p when 4 then '--- !' else 'seven words' end as text from b)"""


def _blocks(spark, d) -> DataFrame:
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("block_no")).agg(F.min("l_partkey").alias("p"), F.min("l_suppkey").alias("s"))
    x, y = "(p * 37) % 540", "(s * 53 + block_no * 40) % 700"
    text = "case p % 6 when 0 then ' ' when 1 then 'ab\\n ab ' when 2 then '\\ufffd\\ufffd x' when 3 then concat('words of block ', p) when 4 then '--- !' else 'seven words' end"
    return b.selectExpr("'f' as source_file", "page", "block_no", f"cast({x} as double) as x0", f"cast({y} as double) as y0", f"cast({x} + 20 + p % 50 as double) as x1", f"cast({y} + 10 + p % 15 as double) as y1", f"{text} as text")


@query(rf"""with {_BLOCKS}, o as (select o_orderkey as page from orders union select -1), nb as (select *, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) as a, regexp_replace(text, '\s', '', 'g') as v, (x0 + x1) / 2 < 300.5 as l from k where trim(text) <> ''),
md as (select page, list_sort(list(y1 - y0))[count(*) // 2 + 1] as mh from nb group by page),
pr as (select nb.*, mh, lag(x0) over w as px, lag(y0) over w as py from nb join md using (page) window w as (partition by page order by block_no)),
f as (select page, sum(a)::bigint as alnum, sum(length(v) - length(replace(v, chr(65533), ''))) as bad, sum(length(v)) as seen, sum(case when a >= 5 then (x1 - x0) * (y1 - y0) else 0 end) as area, coalesce(bool_or(abs(x0 - px) <= 0.15 * 601 and y0 + mh < py), false) as back,
  count(*) filter (where l) as nl, count(*) filter (where not l) as nr, min(y0) filter (where l) as l0, max(y1) filter (where l) as l1, min(y0) filter (where not l) as r0, max(y1) filter (where not l) as r1 from pr group by page),
li as (select page, trim(unnest(string_split(text, chr(10)))) as line from nb), du as (select page, 1 - count(distinct line)::double / count(*) as d from li where line <> '' group by page),
m as (select o.page, coalesce(alnum, 0) as alnum, round(coalesce(bad::double / nullif(seen, 0), 0), 6) as replacement_ratio, round(coalesce(area / 478997.0::double, 0), 6) as usable_ratio, round(coalesce(d, 0), 6) as duplicate_line_ratio,
  coalesce(back, false) or coalesce(nl >= 3 and nr >= 3 and greatest(0, least(l1, r1) - greatest(l0, r0)) >= 0.5 * least(l1 - l0, r1 - r0), false) as reading_order_anomaly from o left join f using (page) left join du using (page))
select *, case when alnum = 0 or replacement_ratio > 0.15 or usable_ratio < 0.01 then 'ocr' else 'native' end as decision,
  array_to_string(list_filter([case when alnum > 0 and alnum < 50 then 'short_text' end, case when duplicate_line_ratio > 0.3 then 'duplicate_line_ratio' end, case when reading_order_anomaly then 'reading_order_anomaly' end], lambda x: x is not null), ',') as warning from m""")
def page_metrics(spark, d):
    """Blocks with blank ones among them, and a page without any."""
    pages = table(spark, d, "orders").select(F.col("o_orderkey").alias("page")).union(spark.createDataFrame([(-1,)], "page long")).selectExpr("'f' as source_file", "page", "601.0D as width", "797.0D as height")
    m = extract.page_metrics(_blocks(spark, d), pages)
    for c in ("replacement_ratio", "usable_ratio", "duplicate_line_ratio"):
        m = m.withColumn(c, F.round(c, 6))
    return extract.route_pages(m).drop("source_file").withColumn("quality_warnings", F.array_join("quality_warnings", ",")).withColumnRenamed("quality_warnings", "warning")


@query(f"""with {_BLOCKS}, w as (select page // 4 as page, x0, round_even(y0 / 60, 0) as line from k), g as (select *, lead(x0) over (partition by page, line order by x0) - x0 as gap from w),
t as (select page, line from g group by page, line having max(gap) >= 28), n as (select page from t group by page having count(*) >= 3),
x as (select page, round_even(x0 / 20, 0) as b from w join t using (page, line) group by page, b having count(distinct line) >= 3), y as (select page from x group by page having count(*) >= 2)
select page from n join y using (page) where page % 3 <> 0""")
def borderless_pages(spark, d):
    """Words of four pages on one, lines twenty times as high as they are."""
    words = _blocks(spark, d).selectExpr("source_file", "page div 4 as page", "x0", "y0 / 20 as y0")
    captions = words.select("source_file", "page").distinct().select("source_file", "page", F.when(F.col("page") % 3 == 0, "no caption").otherwise("表 7").alias("text"))
    return extract.may_hold_borderless(words, captions).select("page")



def _boxes(spark, d, x: int, y: int, s: int) -> DataFrame:
    part = table(spark, d, "part")
    box = F.expr(f"named_struct('x0', cast((p_partkey * {x}) % 300 as double), 'y0', cast((p_partkey * {y}) % 300 as double), 'x1', cast((p_partkey * {x}) % 300 + 60 + (p_partkey * 13) % 80 as double), 'y1', cast((p_partkey * {y}) % 300 + 50 + (p_partkey * 7) % 60 as double))")
    return part.select(F.lit("f").alias("source_file"), F.expr("p_partkey div 8").alias("page"), F.col("p_partkey").alias("n"), box.alias("bbox"), F.expr(f"((p_partkey * {s}) % 100) / 100.0D").alias("score"), F.lit(f"m{x}").alias("method"))


def _boxes_sql(x: int, y: int, s: int) -> str:
    return f"select p_partkey // 8 as page, p_partkey as n, ((p_partkey * {x}) % 300)::double as x0, ((p_partkey * {y}) % 300)::double as y0, ((p_partkey * {x}) % 300 + 60 + (p_partkey * 13) % 80)::double as x1, ((p_partkey * {y}) % 300 + 50 + (p_partkey * 7) % 60)::double as y1, ((p_partkey * {s}) % 100) / 100.0::double as score, 'm{x}' as method from part"


@query(f"""with a as ({_boxes_sql(37, 53, 29)}), b as ({_boxes_sql(41, 59, 31)}),
m as (select a.page, a.n, a.score, a.method, b.n as ln, b.score as ls, b.method as lm, greatest(0, least(a.x1, b.x1) - greatest(a.x0, b.x0)) * greatest(0, least(a.y1, b.y1) - greatest(a.y0, b.y0)) / least((a.x1 - a.x0) * (a.y1 - a.y0), (b.x1 - b.x0) * (b.y1 - b.y0)) as o from a left join b using (page)),
k as (select *, row_number() over (partition by page, n order by case when o >= 0.3 then 0 else 1 end, o desc, ln) as k from m)
select page, n, case when o >= 0.3 and score < 0.6 and ls > score then ls else score end as score, case when o >= 0.3 and score < 0.6 and ls > score then lm else method end as method, case when o >= 0.3 and score < 0.6 and ls > score then ln else -1 end as lattice_n from k where k = 1""")
def spatial_argmax_join(spark, d):
    return extract.select_tables(_boxes(spark, d, 37, 53, 29), _boxes(spark, d, 41, 59, 31)).drop("source_file").withColumn("lattice_n", F.coalesce("lattice_n", F.lit(-1)))


@query(f"""with a as ({_boxes_sql(37, 53, 29)}), l as (select p_partkey // 8 as page, ((p_partkey * 71) % 300)::double as y, '表 ' || p_partkey as text from part),
m as (select a.page, a.n, l.y, l.text, row_number() over (partition by a.page, a.n order by case when y <= y0 and y >= y0 - 100 then 0 else 1 end, y desc, text desc) as k, y <= y0 and y >= y0 - 100 as near from a left join l using (page))
select page, n, case when near then text else 'table ' || n end as title from m where k = 1""")
def nearest_caption(spark, d):
    boxes = _boxes(spark, d, 37, 53, 29).withColumn("fallback", F.concat(F.lit("table "), "n"))
    lines = table(spark, d, "part").select(F.lit("f").alias("source_file"), F.expr("p_partkey div 8").alias("page"), F.expr("cast((p_partkey * 71) % 300 as double)").alias("y"), F.concat(F.lit("表 "), "p_partkey").alias("text"))
    return extract.table_titles(boxes, lines).drop("source_file")


@query("""with g as (select l_orderkey, l_linenumber as r, min(l_returnflag) as f, min(l_linestatus) as s from lineitem group by all),
c as (select l_orderkey, r, unnest([0, 1, 2]) as k, unnest([case when f = 'N' then '' else f end, case when s = 'O' then '' else s end, r::varchar]) as v from g)
select l_orderkey, r, k, case when v = '' and max(case when v <> '' then k end) over (partition by l_orderkey, r) > k then coalesce(last_value(nullif(v, '') ignore nulls) over (partition by l_orderkey, k order by r rows between unbounded preceding and 1 preceding), '') else v end as filled from c""")
def forward_fill(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("r")).agg(F.min("l_returnflag").alias("f"), F.min("l_linestatus").alias("s"))
    blank = lambda c, v: F.when(F.col(c) == v, "").otherwise(F.col(c))
    rows = lines.select("l_orderkey", "r", F.posexplode(F.array(blank("f", "N"), blank("s", "O"), F.col("r").cast("string"))).alias("k", "v"))
    return extract.forward_fill(rows, ["l_orderkey"], "r", "k", "v").drop("v")


@query(r"""with m as (select doc_id, length(regexp_replace(text, '[^\p{L}\p{N}]', '', 'g')) as alnum from documents)
select doc_id, case when alnum = 0 then 'ocr' else 'native' end as decision, case when alnum > 0 and alnum < 50 then 'short_text' else '' end as warning from m""")
def page_route(spark, d):
    from ..functions.text import alnum_count

    m = table(spark, d, "documents").select("doc_id", alnum_count(F.col("text")).alias("alnum"), F.lit(0.0).alias("replacement_ratio"), F.lit(1.0).alias("usable_ratio"), F.lit(0.0).alias("duplicate_line_ratio"), F.lit(False).alias("reading_order_anomaly"))
    return extract.route_pages(m).select("doc_id", "decision", F.array_join("quality_warnings", ",").alias("warning"))


# --- evaluation ---

_CASES = f"""v as ({_VECTOR}), r as (select 'dot' as method, v.qid as case_id, rank, a.label = b.label as rel from v join embeddings a on a.vec_id = v.qid join embeddings b on b.vec_id = v.record_index),
rr as (select * from r union all select 'reversed', case_id, 21 - rank, rel from r),
tt as (select vec_id as case_id, (select count(*) from embeddings y where y.label = x.label) as n_relevant, 'c' || (label % 3) as category, case when label % 2 = 0 then 'native' else 'scanned' end as pdf_type from embeddings x where vec_id % 100 = 0),
pc as (select method, case_id, min(rank) filter (where rel) as fr, coalesce(sum(1 / log2(rank + 1)) filter (where rel and rank <= 5), 0) as dcg from rr group by all),
cs as (select pc.*, tt.* exclude (case_id), case when n_relevant > 0 then dcg / list_sum(list_transform(range(1, least(n_relevant, 5) + 1), lambda i: 1 / log2(i + 1))) else 0 end as ndcg from pc join tt using (case_id))"""


def _cases(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    met = _nearest(spark, d).join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("a")), "qid").join(e.select(F.col("vec_id").alias("record_index"), F.col("label").alias("b")), "record_index")
    r = met.select(F.lit("dot").alias("method"), F.col("qid").alias("case_id"), "rank", (F.col("a") == F.col("b")).alias("rel"))
    r = r.union(r.select(F.lit("reversed"), "case_id", 21 - F.col("rank"), "rel"))
    sizes = e.groupBy("label").agg(F.count(F.lit(1)).alias("n_relevant"))
    totals = e.where("vec_id % 100 = 0").join(sizes, "label").select(F.col("vec_id").alias("case_id"), "n_relevant", F.concat(F.lit("c"), F.col("label") % 3).alias("category"), F.when(F.col("label") % 2 == 0, "native").otherwise("scanned").alias("pdf_type"))
    return evaluate.case_metrics(r, totals)


@query(f"""with {_CASES}
select method, category, pdf_type, case when grouping(category) = 1 and grouping(pdf_type) = 1 then 'overall' when grouping(category) = 0 then 'category' else 'pdf_type' end as scope, count(*) as cases, count(*) filter (where fr = 1) as hits_at_1, count(*) filter (where fr <= 5) as hits_at_5,
  round(avg(coalesce(fr = 1, false)::int), 4) as recall_at_1, round(avg(coalesce(fr <= 3, false)::int), 4) as recall_at_3, round(avg(coalesce(fr <= 5, false)::int), 4) as recall_at_5, round(avg(case when fr <= 5 then 1.0::double / fr else 0 end), 4) as mrr_at_5, round(avg(ndcg), 4) as ndcg_at_5, round(avg(case when fr <= 5 then 1.0::double / fr else 0 end), 4) as mrr, round(avg((fr is not null)::int), 4) as candidate_recall,
  case when method <> 'reversed' then round(avg(coalesce(fr <= 20, false)::int), 4) end as oracle_recall_at_20
from cs group by grouping sets ((method), (method, category), (method, pdf_type))""")
def retrieval_metrics(spark, d):
    return evaluate.report(_cases(spark, d), without_oracle=("reversed",))


@query(f"""with {_CASES}, m as (select method, pdf_type, category, count(*) as n, count(*) filter (where fr is null or fr <> 1) as m from cs group by all)
select method, pdf_type, sum(n)::bigint as cases, sum(n - m)::bigint as hits_at_1, round(sum(n - m) / sum(n), 4) as recall_at_1, sum(m)::bigint as misses, coalesce(string_agg(category || ':' || m, ',' order by category) filter (where m > 0), '') as missed from m group by method, pdf_type""")
def first_place(spark, d):
    out = evaluate.first_place(_cases(spark, d))
    said = F.array_join(F.transform(F.map_entries("misses_by_category"), lambda e: F.concat(e["key"], F.lit(":"), e["value"])), ",")
    return out.withColumn("missed", said).drop("misses_by_category")


@query(f"with {_CASES} select method, count(*) filter (where fr is null) as not_recalled, count(*) filter (where fr > 5) as beyond_5, count(*) filter (where fr > 1 and fr <= 5) as within_5 from cs group by method")
def ranking_diagnostics(spark, d):
    return evaluate.diagnostics(_cases(spark, d))


_LABELLED = "r as (select quality = 1 as answerable, ((doc_id * 7919) % 1000) / 1000.0::double + 0.2::double * quality as score, toxic = 0 as hard from labels)"
_RATED = """p as (select t, count(*) filter (where answerable and ok) as aa, count(*) filter (where answerable and not ok) as fr, count(*) filter (where not answerable and not ok) as cr, count(*) filter (where not answerable and ok) as fa from m group by t),
q as (select *, coalesce(aa / nullif(aa + fr, 0), 0) as ar, coalesce(cr / nullif(cr + fa, 0), 0) as rr, coalesce(fa / nullif(cr + fa, 0), 0) as far, (aa + cr) / (aa + fr + cr + fa) as oa from p), b as (select *, round((ar + rr) / 2, 9) as ba from q)"""


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").select((F.col("quality") == 1).alias("answerable"), F.expr("((doc_id * 7919) % 1000) / 1000.0D + 0.2D * quality").alias("score"), (F.col("toxic") == 0).alias("hard_rules_passed"))


@query(f"""with {_LABELLED}, e as (select distinct score as t from r union select min(score) - 1e-9 from r union select max(score) + 1e-9 from r), m as (select t, answerable, score >= t as ok from r, e), {_RATED}
select ba as balanced_accuracy, round(oa, 9) as overall_accuracy, round(rr, 9) as refusal_recall, t as threshold from b order by ba desc, round(oa, 9) desc, round(rr, 9) desc, t desc limit 1""")
def threshold_calibration(spark, d):
    return evaluate.calibrate(_labelled(spark, d))


@query(f"""with {_LABELLED}, e as (select distinct score as t from r union select 0.0 union select 1 + 1e-9), m as (select t, answerable, hard and score >= t as ok from r, e), {_RATED}
select round(ar, 9) as accept_rate, ba as balanced_accuracy, t as threshold, round(far, 9) as false_answer_rate from b where far <= 0.05 order by round(ar, 9) desc, ba desc, t desc limit 1""")
def constrained_threshold(spark, d):
    return evaluate.constrained_threshold(_labelled(spark, d).withColumnRenamed("score", "confidence"))


@query(f"""with {_LABELLED}, m as (select 0.75 as t, answerable, score >= 0.75 as ok from r), {_RATED} select aa as accepted_answerable, fr as false_refusals, cr as correct_refusals, fa as false_answers, round(ar, 9) as accept_rate, round(rr, 9) as refusal_recall, round(ba, 9) as balanced_accuracy from b""")
def refusal_confusion(spark, d):
    r9 = lambda n: F.round(n, 9).alias(n)
    return evaluate.refusal_at(_labelled(spark, d), 0.75).select("accepted_answerable", "false_refusals", "correct_refusals", "false_answers", r9("accept_rate"), r9("refusal_recall"), r9("balanced_accuracy"))


@query(f"""with {_LABELLED}, t as (select *, case when answerable then case when score < 0.4 then 'unknown' else 'native' end else case when hard then 'unspecified' else 'toxic' end end as kind from r)
select case when answerable then 'answerable' else 'no_answer' end as side, kind, count(*) as cases, case when answerable then round(avg((score >= 0.75)::int), 4) end as accept_rate, case when answerable then round(avg((score < 0.75)::int), 4) end as false_refusal_rate,
  case when not answerable then round(avg((score < 0.75)::int), 4) end as refusal_recall, case when not answerable then round(avg((score >= 0.75)::int), 4) end as false_answer_rate from t group by answerable, kind""")
def refusal_breakdown(spark, d):
    rows = _labelled(spark, d).withColumn("source_type", F.when(F.col("score") >= 0.4, "native")).withColumn("no_answer_type", F.when(F.col("hard_rules_passed"), "").otherwise("toxic"))
    return evaluate.refusal_breakdown(rows, 0.75)


@query(f"with {_LABELLED} select answerable, count(*) as cases, round(min(score), 6) as minimum, round(avg(score), 6) as mean, round(max(score), 6) as maximum from r group by answerable")
def score_summary(spark, d):
    return evaluate.score_summary(_labelled(spark, d), ["answerable"])


@query("select event_type, count(*) as n, round(avg(value), 6) as mean_ms, quantile_disc(value, 0.5) as p50_ms, quantile_disc(value, 0.95) as p95_ms, min(value) as min_ms, max(value) as max_ms from events group by event_type")
def latency_percentile(spark, d):
    return evaluate.latency(table(spark, d, "events"), "value", ["event_type"])


# --- answers and integrity ---

_W = r"lower(regexp_replace({}, '[^\p{{L}}\p{{N}}\p{{M}}_]', '', 'g'))"


@query(rf"""with p as (select item_id, {_W.format("b.text")} as r, {_W.format("d.text")} as a from benchmark b join documents d on d.doc_id = b.item_id),
x as (select item_id, g, count(*) as n from (select item_id, unnest(list_transform(range(1, length(r)), lambda i: substr(r, i, 2))) as g from p) group by all),
y as (select item_id, g, count(*) as m from (select item_id, unnest(list_transform(range(1, length(a)), lambda i: substr(a, i, 2))) as g from p) group by all)
select item_id, round(sum(least(n, coalesce(m, 0))) / sum(n), 6) as recall from x left join y using (item_id, g) group by item_id""")
def answer_bigram_recall(spark, d):
    pairs = table(spark, d, "benchmark").select("item_id", F.col("text").alias("gold")).join(table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("answer")), "item_id")
    return answers.bigram_recall(pairs, "gold", "answer", ["item_id"]).select("item_id", "recall")


@query("""with c as (select doc_id, doc_id % 11 = 0 as refused, list_distinct([(doc_id % 7)::varchar, (doc_id % 5)::varchar]) as c, list_distinct([(doc_id % 3)::varchar, (doc_id % 5)::varchar]) as w from documents)
select doc_id, case when refused then 0 else round(len(list_intersect(c, w))::double / len(c), 6) end as citation_precision, case when refused then 0 else round(len(list_intersect(c, w))::double / len(w), 6) end as citation_recall, not refused and len(list_intersect(c, w)) > 0 as supported from c""")
def citation_scores(spark, d):
    s = lambda k: (F.col("doc_id") % k).cast("string")
    rows = table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 11 == 0).alias("refused"), F.array(s(7), s(5)).alias("cited_chunk_ids"), F.array(s(3), s(5)).alias("relevant_chunk_ids"))
    a, b, c = answers.citation_scores()
    return rows.select("doc_id", F.round(a, 6).alias("citation_precision"), F.round(b, 6).alias("citation_recall"), c)


@query("""with x as (select doc_id, 'a' || doc_id as path, sha256(text) as sha256 from documents) select path, case when doc_id % 9 = 0 then 'missing' when doc_id % 4 = 0 then 'sha256_mismatch' else 'size_mismatch' end as error from x where doc_id % 9 = 0 or doc_id % 4 = 0 or doc_id % 10 = 1""")
def manifest_verify(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("a"), "doc_id").alias("path"), F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("bytes"))
    actual = docs.select(F.when(F.col("doc_id") % 9 == 0, F.concat(F.lit("z"), "doc_id")).otherwise(F.col("path")).alias("path"), F.when(F.col("doc_id") % 4 == 0, "?").otherwise(F.col("sha256")).alias("sha256"), (F.col("bytes") + (F.col("doc_id") % 10 == 1).cast("long")).alias("bytes"))
    return integrity.verify_manifest(docs, actual)


@query(rf"select doc_id, {_W.format('text')} = '' as empty, length({_W.format('text')}) as n from documents")
def normalized_text(spark, d):
    return table(spark, d, "documents").select("doc_id", (normalized(F.col("text")) == "").alias("empty"), F.length(normalized(F.col("text"))).alias("n"))
