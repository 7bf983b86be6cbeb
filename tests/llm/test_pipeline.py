import collections
import random

import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken

import corpus_pipeline
from tessera.llm import blocks, bpe, decontam

from .conftest import SCHEMA, prose
from .test_operators import ALNUM, brute_components, brute_quality, brute_runs, brute_tiling, low, sha

#: Names that stages use inside, as columns of the documents.
INNER = "_key _lines _gone _gone_key _gone_id _gone_node _judged _tiled _node _near_node _near_turn _best _turn _later _lost _root _n_lines _n_removed _n_chunks _h _id node id kept key h x c n u v hits n_words base_failed component_id value".split()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, near copies, passages and leaks, and its benchmark."""
    rnd = random.Random(21)
    items = [prose(rnd, 30, 30) for _ in range(6)]
    texts = [prose(rnd, rnd.randint(60, 160)) for _ in range(40)]
    passage = prose(rnd, 64)
    texts += [prose(rnd, 80) + "\n" + passage + "\n" + prose(rnd, 70) for _ in range(4)]
    for k in range(6):
        words = texts[k].split(" ")
        words[10] = "changed"
        texts.append(" ".join(words))
    texts += [texts[0], prose(rnd, 60) + "\n" + items[0], "# | % " * 40, "again and again\n" * 30, "short", "", None]
    home = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], SCHEMA).repartition(4).write.parquet(f"{home}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{home}/benchmark.parquet")
    return home, texts, items


def test_pipeline_matches_brute_force(spark, folder):
    home, texts, items = folder
    rows = [(k, t) for k, t in enumerate(texts) if brute_quality(t)[-1]]
    lines, _ = brute_runs([t for _, t in rows])
    rows = [(k, t) for (k, _), t in zip(rows, lines, strict=True)]
    rows = [r for r, (_, c) in zip(rows, brute_components(rows), strict=True) if r[0] == c]
    words = lambda t: ALNUM.findall(low(t))
    p = decontam.Tiling()
    hit = lambda t, i: 100 * brute_tiling(words(i), words(t), p.least) >= p.percent * len(words(i))
    rows = [(k, t) for k, t in rows if not any(hit(t, i) for i in items)]
    assert 30 < len(rows) <= len(texts) - 6
    import base64

    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for k, t in rows:
        ids = library.encode_ordinary(t or "")
        want[k] = (len(ids), sha(",".join(map(str, ids))), sha(t or ""))
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in corpus_pipeline.run(spark, home).collect()} == want


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:4]])
def test_stages_keep_odd_rows_and_columns(spark, folder, name):
    home, texts, _ = folder
    stage = dict(corpus_pipeline.STAGES)[name]
    schema = f"{SCHEMA}, {', '.join(f'`{x}` string' for x in INNER)}"
    good = [t for t in texts[:6]]
    rows = [(1, good[0], "en", None, 3), (1, good[0], "en", None, 3), (None, good[1], None, "s", None), (None, None, None, None, None), (2, "", "en", "s", 0), (3, good[2], None, None, 0)]
    docs = spark.createDataFrame([(*r, *(f"{x}{k}" for x in INNER)) for k, r in enumerate(rows)], schema).repartition(2)
    out = stage(spark, docs, home)
    assert out.columns == docs.columns
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    full = collections.Counter((r[0], r[1]) for r in rows)
    if name == "quality_rules":
        del full[None, None], full[2, ""]
    if name == "near_dedup":
        full[1, good[0]] = 1
    assert got == full
    assert all(r[x] == f"{x}{r['_key'][4:]}" for r in out.collect() for x in INNER)
    assert stage(spark, docs.limit(0), home).count() == 0


def test_several_benchmark_blocks(spark, folder, monkeypatch):
    home, texts, items = folder
    docs, bench = (spark.read.parquet(f"{home}/{x}.parquet") for x in ("documents", "benchmark"))
    p = decontam.Tiling(block_bytes=300)
    assert decontam.benchmark_blocks(bench, p)[0] > 2
    one, many = (sorted((r.doc_id, r.text) for r in decontam.clean(spark, docs.where("doc_id is not null and text is not null"), bench, x).collect()) for x in (decontam.Tiling(), p))
    assert one == many and len(one) < len(texts)
    clashing = docs.withColumn("_gone", docs.doc_id).withColumn("_gone_key", docs.doc_id).withColumn("_tiled", docs.doc_id)
    assert decontam.clean(spark, clashing, bench, p).columns == clashing.columns


@pytest.mark.parametrize("name", ["quality_rules", "decontaminate"])
def test_scans_send_each_text_once_in_small_batches(spark, folder, name):
    home, _, _ = folder
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(bound)
    try:
        docs = spark.read.parquet(f"{home}/documents.parquet")
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, home)
        sent = out._jdf.queryExecution().analyzed().children().head().output()
        assert [sent.apply(k).name() for k in range(sent.size())] == docs.columns

        def sizes(batches):
            for b in batches:
                yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

        wide = spark.range(0, 5000, 1, 1).selectExpr("id", "repeat('x', 4000) as text")
        found = [r.n for r in wide.mapInArrow(sizes, "n long").collect()]
        assert sum(found) > 20_000_000 and max(found) < 5 << 20
    finally:
        spark.conf.unset(bound)


def test_a_worker_drops_what_other_operators_keep():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    bpe.load(path, public_tokenizers.PATTERN)
    assert list(blocks.lean(lambda batches: batches, "bpe")(iter([1, 2]))) == [1, 2] and bpe._load.cache_info().currsize
    assert list(blocks.lean(lambda batches: batches)(iter([1, 2]))) == [1, 2] and not bpe._load.cache_info().currsize
