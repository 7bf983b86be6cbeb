"""The registered queries of the ten operators and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, langid, licenses, linededup, minhash, pii, quality, urls

#: The rules of the URL query.
URL_RULES = [
    urls.UrlRule("com", "/", "allow"),
    urls.UrlRule("example.com", "/en/", "block"),
    urls.UrlRule("www.example.com", "/en/", "allow"),
    urls.UrlRule("net", "/es/", "block"),
    urls.UrlRule("net", "/fr/", "block"),
]
#: Words in a host that label a URL of the training sample as bad.
BAD_WORDS = r"spam|pills|casino|bets|ads-|track|cheap|win\.|viagra|xxx|loan|poker"
#: Fixed value: the text of conversation -7.
PROBE = r"\### Assistant: </turn> ok"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(spark, _table(spark, sf_dir, "documents"))


def pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_table(spark, sf_dir, "documents"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    labelled = pages.where("url is not null").select("url", F.regexp_extract("url", "://([^/?#]*)", 1).rlike(BAD_WORDS).cast("int").alias("label"))
    return urls.judge(pages, labelled, URL_RULES)


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, _table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(_table(spark, sf_dir, "documents"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linededup.without_repeated_runs(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.withColumnsRenamed({"_n_lines": "n_lines", "_n_removed": "n_removed", "_n_chunks": "n_chunks"})


def chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return chat.read_conversations(chat.format_turns(turns.union(probe))).drop("n_attachments", "n_tokens")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(spark, _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), partial(public_tokenizers.path, "byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_dedup": near_dedup,
    "op2_pii": pii_spans,
    "op3_url_filter": url_filter,
    "op4_language_id": language_id,
    "op5_license_scan": license_scan,
    "op6_line_dedup": line_dedup,
    "op7_chat_format": chat_format,
    "op8_decontaminate": decontaminate,
    "op9_quality_rules": quality_rules,
    "op10_byte_bpe": byte_bpe,
}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

NEAR_DEDUP_SQL = rf"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') as w from documents
), s as (
  select distinct doc_id, unnest(case when len(w) >= 5 then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w
), n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as u, b.doc_id as v, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
linked as (select u, v from common join n x on x.doc_id = u join n y on y.doc_id = v where 100 * c >= 75 * (x.n + y.n - c)),
edges as (select u, v from linked union select v, u from linked),
reach as (select u, v from edges union select r.u, e.v from reach r join edges e on r.v = e.u),
low as (select u, min(v) as m from reach group by u)
select w.doc_id, coalesce(n.n, 0)::bigint as n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) as component_id, w.doc_id <= coalesce(m, w.doc_id) as kept
from w left join n on n.doc_id = w.doc_id left join low on low.u = w.doc_id
"""

LINE_DEDUP_SQL = r"""
with g as (select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
l as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as k from g),
n as (select *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n from l),
s as (select doc_id, k, t - n as b, t from (select *, (sum(n) over (partition by doc_id order by k))::bigint as t from n) where n > 0),
runs as (
  select x.doc_id, x.k as a, y.k as e from s x join s y on y.doc_id = x.doc_id and y.b <= x.b + 50 and y.t > x.b + 50
  union select x.doc_id, y.k, x.k from s x join s y on y.doc_id = x.doc_id and y.b <= x.t - 51 and y.t > x.t - 51
),
texts as (select doc_id, a, e, array_to_string(ls[a:e], chr(10)) as t from runs join g using (doc_id)),
placed as (select doc_id, a, e, row_number() over w as place, first_value(doc_id) over w as first_id, first_value(a) over w as first_a from texts window w as (partition by t order by doc_id, a)),
later as (select doc_id, case when doc_id = first_id then greatest(a, first_a + e - a + 1) else a end as b, e from placed where place > 1),
lost as (select distinct doc_id, unnest(range(b, e + 1)) as k from later where b <= e),
j as (select l.doc_id, l.k, line, lost.k is not null as gone from l left join lost on lost.doc_id = l.doc_id and lost.k = l.k),
o as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by k), false) as opens from j),
per as (
  select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_removed, count(*) filter (where opens) as n_chunks, coalesce(string_agg(line, chr(10) order by k) filter (where not gone), '') as kept_text
  from o group by doc_id
)
select d.doc_id, case when n_removed > 0 then kept_text else d.text end as text, case when d.text is null then 0 else n_lines end as n_lines, n_removed, n_chunks
from documents d join per using (doc_id)
"""

CHAT_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f as (
  select *, '<|turn|>' || replace(replace(role, '\', '\\'), '<|', '<\|') || '<|sep|>' || replace(replace(text, '\', '\\'), '<|', '<\|') || '<|end|>' as formatted from t
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, formatted)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, formatted) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(length(formatted))::bigint as formatted_chars
from f group by conv_id
"""


def _quality_sql() -> str:
    lengths = (3, *quality.QualityRules().gram_percent)
    dup = ", ".join(f"case when i <= n - {n - 1} and count(*) over (partition by doc_id, array_to_string(words[i:i + {n - 1}], ' '), i <= n - {n - 1}) > 1 then 1 else 0 end as d{n}" for n in lengths)
    cover = ", ".join(f"max(d{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as v{n}" for n in lengths)
    sums = ", ".join(f"sum(length(w) * v{n}) as c{n}" for n in lengths)
    rules = quality.QualityRules()
    bad = " or ".join(f"100 * coalesce(c{n}, 0) > {p} * coalesce(word_chars, 0)" for n, p in rules.gram_percent.items())
    return rf"""
with t as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words, coalesce(text, '') as text from documents
), x as (select doc_id, words, len(words) as n, unnest(words) as w, generate_subscripts(words, 1) as i from t),
y as (select doc_id, i, w, {dup} from x),
z as (select doc_id, w, {cover} from y),
g as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars, sum(v3) as n_repeat_words, {sums} from z group by doc_id),
l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as k from t),
m as (select doc_id, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) as chars, row_number() over (partition by doc_id, line order by k) > 1 as again from l where regexp_matches(line, '[^\x20\x09-\x0D]')),
o as (select doc_id, count(*) filter (where again) as n_dup_lines, coalesce(sum(chars) filter (where again), 0) as line_chars from m group by doc_id),
a as (
  select t.doc_id, coalesce(n_words, 0) as n_words, coalesce(word_chars, 0) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words,
    coalesce(n_words, 0) < {rules.least_words} or 100 * coalesce(n_repeat_words, 0) > {rules.repeat_percent} * n_words as base_failed,
    ({bad}) or 100 * coalesce(line_chars, 0) > {rules.line_percent} * coalesce(word_chars, 0) as worse
  from t left join g on g.doc_id = t.doc_id left join o on o.doc_id = t.doc_id
)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols, n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words, base_failed,
  not base_failed and not worse and 100 * n_symbols <= {rules.symbol_percent} * n_words as kept
from a
"""


ORACLE_SQL: dict[str, str] = {
    "op1_near_dedup": NEAR_DEDUP_SQL,
    "op6_line_dedup": LINE_DEDUP_SQL,
    "op7_chat_format": CHAT_SQL,
    "op9_quality_rules": _quality_sql(),
}
