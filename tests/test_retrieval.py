import collections
import hashlib
import io
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import chunking
from tessera.config import Config
from tessera.functions.text import bigram_share, char_bigrams, clean_text, normalized, token_count, tokens, tokens_of
from tessera.operators import answers, dense, evaluate, evidence, extract, fusion, index, ingest, integrity, lexical, rerank
from tessera.operators.common import dense_index
from tessera.plans import cli
from tessera.plans.engine import Engine
from tessera.sources import artifacts, publish

RANKING = "qid int, record_index long, rank int, score double"


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, tokens, "第一，二 GPA-4.0 a.b") == ["第", "一", "二", "gpa-4.0", "a.b", "第一", "一二"]
    assert one(spark, token_count, "第一 a-b c! ？") == 6
    assert one(spark, clean_text, " a　 b\n") == "a b" and one(spark, clean_text, None) == ""
    assert one(spark, char_bigrams, "Ab-c") == ["ab", "bc"] and one(spark, char_bigrams, "a") == []
    assert one(spark, normalized, "A_b，第 c!") == "a_b第c"


def test_chunks():
    parts = chunking.split_chunks("第一段" * 180 + "\n\n" + "第二段" * 180, size=200, overlap=20)
    assert len(parts) > 1 and all(chunking.count_tokens(p) <= 200 for p in parts)
    assert parts[0][-10:] in parts[1]
    assert chunking.split_chunks("") == []
    with pytest.raises(ValueError):
        chunking.split_chunks("x", 10, 5, 2)
    rnd = random.Random(1)
    for _ in range(200):
        t = "".join(rnd.choice("ab。. \n\n-第！") for _ in range(rnd.randint(0, 400)))
        for p in chunking.split_chunks(t, 20, 30, 5):
            assert chunking.count_tokens(p) <= 30


def test_pieces_of_a_unit():
    rnd = random.Random(4)
    parts = ["a", "b-", "c._", "第", "。", "!", " ", "\n", "x/y.z", "-", "9 ", "word ", ".", "；"]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(1, 120)))
        m = chunking.Measured(t)
        for _ in range(6):
            a = rnd.randint(0, len(t))
            b = rnd.randint(a, len(t))
            assert m.count(a, b) == chunking.count_tokens(t[a:b]), (t, a, b)
        most = rnd.randint(3, 25)
        pieces = chunking.split_unit(t, most)
        assert "".join(pieces) == t and all(pieces)
        assert all(chunking.count_tokens(x) <= most for x in pieces)
    assert chunking.split_unit("One two. Three four. Five six seven eight nine ten.", 6) == ["One two. Three four.", " Five six seven eight nine ten", "."]
    assert chunking.split_unit("see a/b.c for x_y. ok", 3) == ["see a/b.", "c for x", "_y.", " ok"]
    assert chunking.split_chunks("a b c d e f g h i j. k l\n\nm n", 5, 6, 2) == ["a b c d e f ", "g h i j.", "j.\n\n k l\n\nm n"]


def test_long_text_is_chunked_in_linear_time():
    import time

    def took(n):
        began = time.perf_counter()
        chunking.split_chunks(" ".join(f"w{k}" for k in range(n)))
        return time.perf_counter() - began

    took(1000)
    assert took(80_000) < 20 * max(took(10_000), 0.01)


def test_table_chunks():
    head = "# 成绩\n| 成绩区间 | 绩点范围 |\n| --- | --- |\n"
    parts = chunking.split_table(head + "\n".join(f"| {k} | {k} |" for k in range(179)), 80, 100)
    assert all("| 成绩区间 | 绩点范围 |" in p["text"] for p in parts)
    assert parts[0]["row_start"] == 1 and parts[-1]["row_end"] == 179
    assert all(b["row_start"] == a["row_end"] + 1 for a, b in zip(parts, parts[1:]))
    assert chunking.split_table("no table") == [] and chunking.split_table(head)[0]["row_end"] == 0
    told = chunking.table_retrieval_text(head + "| 90～100 | 4.0～5.0 |")
    assert "表名：成绩" in told and "字段：成绩区间、绩点范围" in told and "成绩区间：90～100；绩点范围：4.0～5.0" in told and "---" not in told
    noted = chunking.split_table(head + "| a | b |\nfootnote text\n| c | d |")
    assert [(p["text"].count("\n"), p["row_start"], p["row_end"]) for p in noted] == [(4, 1, 2)] and "footnote" not in noted[0]["text"]
    assert "footnote" not in chunking.table_retrieval_text(head + "| a | b |\nfootnote text")
    assert chunking.table_retrieval_text("## C# #\n|| x |\n|---|---|\n| 1 \\| 2 | |") == "表名：C# #\n字段：x\nx：1 | 2"
    wide = head + "\n".join("| " + "x y z " * 10 + "| b |" for _ in range(15))
    assert chunking.table_retrieval_text(wide, 100) == wide


def test_expansion(spark):
    f = lambda q: one(spark, lexical.expand_query, q)
    assert f("普通问题") == "普通问题"
    assert f("休学后需要离校手续吗") == "休学后需要离校手续吗 办理手续离校"
    assert "评定资格" in f("退学研究生能参加奖学金评选吗")


def test_bm25_against_formula(spark):
    texts = ["alpha beta beta", "beta gamma", "gamma gamma delta epsilon", ""]
    chunks = spark.createDataFrame(list(enumerate(texts)), "record_index long, text string")
    got = {r.record_index: r.score for r in lexical.bm25(chunks, spark.createDataFrame([(0, "beta beta gamma")], "qid int, query string")).collect()}
    docs = [t.split() for t in texts]
    avg = sum(map(len, docs)) / 4
    want = {}
    for k, d in enumerate(docs):
        s = 0
        for t, w in (("beta", 2), ("gamma", 1)):
            df = sum(t in x for x in docs)
            s += w * math.log(1 + (4 - df + 0.5) / (df + 0.5)) * d.count(t) * 2.5 / (d.count(t) + 1.5 * (0.25 + 0.75 * len(d) / avg))
        if s > 0:
            want[k] = round(s, 6)
    assert got == pytest.approx(want)
    asked_ = spark.createDataFrame([(0, "beta beta gamma"), (1, "delta"), (2, "none")], "qid int, query string")
    for live in (chunks, chunks.where("record_index <> 1")):
        stored = lexical.bm25_indexed(lexical.postings(chunks), lexical.document_lengths(chunks), live, asked_).collect()
        fresh = lexical.bm25(live, asked_).collect()
        assert sorted((r.qid, r.record_index, r.score, r["rank"]) for r in stored) == sorted((r.qid, r.record_index, r.score, r["rank"]) for r in fresh) and stored
    only = lexical.bm25(chunks.where("record_index = 1"), spark.createDataFrame([(0, "beta")], "qid int, query string")).collect()
    assert [r.record_index for r in only] == [1]


def brute_tfidf(rows, asked, limit):
    """Cosines of hashed TF-IDF vectors, text by text; rows of one number are one text."""
    docs = collections.defaultdict(collections.Counter)
    for k, t in rows:
        docs[k].update(tokens_of(t))
    df = collections.Counter(t for c in docs.values() for t in c)

    def vector(counts):
        v = [0.0] * 512
        for t, n in counts.items():
            v[int(hashlib.md5(t.encode()).hexdigest()[:7], 16) % 512] += (1 + math.log(n)) * (math.log((len(rows) + 1) / (df[t] + 1)) + 1)
        return v

    norm = lambda v: math.sqrt(sum(x * x for x in v))
    vectors = {k: vector(c) for k, c in docs.items() if k is not None and c}
    out = []
    for qid, text in asked:
        q = vector(collections.Counter(tokens_of(text)))
        scores = [(round(sum(a * b for a, b in zip(q, v)) / (norm(q) * norm(v)), 6), k) for k, v in vectors.items()] if any(q) else []
        out += [(qid, k, s, n + 1) for n, (s, k) in enumerate(sorted(((s, k) for s, k in scores if s > 0), key=lambda x: (-x[0], x[1]))[:limit])]
    return out


def test_legacy_tfidf_against_formula(spark, monkeypatch):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(90)]
    rows = [(k, " ".join(rnd.choices(words, k=rnd.randint(1, 30)))) for k in range(60)]
    rows += [(3, "w1 w2 w2 extra"), (None, "w1 hidden"), (None, "hidden"), (70, None), (71, ""), (72, "奖学金 w5"), (73, rows[5][1]), (74, rows[5][1])]
    asked = [(k, " ".join(rnd.choices([*words, "hidden", "never"], k=8))) for k in range(12)] + [(20, ""), (21, None), (22, "never seen"), (23, "奖学金 W5")]
    chunks = spark.createDataFrame(rows, "record_index long, text string").repartition(3)
    queries_ = spark.createDataFrame(asked, "qid int, query string")
    want = sorted(brute_tfidf(rows, asked, 5))
    key = lambda r: (r.qid, r.record_index, r.score, r["rank"])
    assert sorted(map(key, lexical.legacy_tfidf(chunks, queries_, 5).collect())) == want
    monkeypatch.setattr(lexical, "PART_BYTES", 400)
    monkeypatch.setattr(lexical, "BLOCK_VALUES", 2048)
    assert sorted(map(key, lexical.legacy_tfidf(chunks, queries_, 5).collect())) == want
    assert lexical.legacy_tfidf(chunks.limit(0), queries_).count() == 0 and lexical.legacy_tfidf(chunks, queries_.limit(0)).count() == 0


def shuffled_records(spark):
    """Records that all stages so far have written to shuffles."""
    context, jvm = spark.sparkContext, spark._jvm
    context._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(x.stageId(), x.attemptId()): x.shuffleWriteRecords() for x in (stages.apply(k) for k in range(stages.size()))}


def test_legacy_tfidf_makes_no_row_per_text_and_query(spark):
    rnd = random.Random(9)
    words = [f"w{k}" for k in range(40)]
    chunks = spark.createDataFrame([(k, " ".join(rnd.choices(words, k=20))) for k in range(500)], "record_index long, text string").repartition(4).cache()
    queries_ = spark.createDataFrame([(k, " ".join(rnd.choices(words, k=10))) for k in range(60)], "qid int, query string").cache()
    assert chunks.count() + queries_.count() == 560
    before = shuffled_records(spark)
    assert lexical.legacy_tfidf(chunks, queries_, 5).count() == 300
    made = sum(n for k, n in shuffled_records(spark).items() if k not in before)
    assert 0 < made < 500 * 60 / 4, made


def test_vector_search_blocks(spark, monkeypatch):
    rnd = random.Random(2)
    rows = [(k, [rnd.random() for _ in range(4)]) for k in range(50)]
    v = spark.createDataFrame(rows, "record_index long, vec array<float>")
    q = v.where("record_index < 7").withColumnRenamed("record_index", "qid")
    whole = dense.vector_search(v, q, 3).orderBy("qid", "rank").collect()
    monkeypatch.setattr(dense, "BLOCK_VALUES", 8)
    assert dense.vector_search(v, q, 3).orderBy("qid", "rank").collect() == whole
    with pytest.raises(Exception):
        dense.vector_search(spark.createDataFrame([(1, [1.0])], "record_index long, vec array<float>"), q, 3).collect()


def test_fusion(spark):
    a = spark.createDataFrame([(0, 0, 1, 1.0), (0, 1, 2, 0.5)], RANKING)
    b = spark.createDataFrame([(0, 1, 1, 1.0), (0, 2, 2, 0.5)], RANKING)
    got = fusion.rrf_fuse(a, b).orderBy("retrieval_rank").collect()
    assert [r.record_index for r in got] == [1, 0, 2]
    assert [r.matched_by for r in got] == [["bm25", "vector"], ["bm25"], ["vector"]]
    rows = spark.createDataFrame([(0, 0, False), (0, 1, True), (0, 2, None)], "qid int, retrieval_rank int, active boolean")
    assert [r.retrieval_rank for r in fusion.only_active(rows, 2).orderBy("retrieval_rank").collect()] == [1, 2]


def blended(spark, scores, tables=(), query="q"):
    rows = [(0, k, k + 1, float(s), "table" if k in tables else "pdf", query) for k, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "qid int, record_index long, retrieval_rank int, reranker_raw double, source_type string, query string")
    out = rerank.protect_top(rerank.is_table_query(rerank.rerank_from_scores(frame)))
    return out.orderBy("final_rank").collect()


def test_blend_and_protection(spark):
    got = sorted(blended(spark, [0.4, 0.9, 0.9]), key=lambda r: r.blended_rank)
    assert [r.record_index for r in got] == [1, 2, 0]
    assert (got[0].retrieval_rank, got[0].normalized, got[0].reranker_score) == (2, 1.0, 1.08)
    top = blended(spark, [0.9, 0.8, 0.7, 0.6, 0.1, 1.0], {4}, "百分制成绩各区间对应的绩点范围是什么？")
    assert top[0].record_index == 5 and 4 in [r.record_index for r in top[:5]]
    assert 3 in [r.record_index for r in blended(spark, [0.999, 0.995, 0.986, 0.973, 0.995, 1.0, 0.998])[:5]]


def test_protection_against_sequential_policy(spark):
    rnd = random.Random(3)
    rows, want = [], {}
    for qid in range(150):
        n = rnd.randint(1, 12)
        scores = [rnd.choice([0.2, 0.5, 0.98, rnd.random()]) for _ in range(n)]
        rows += [(qid, k, k + 1, s, rnd.choice(["table", "pdf"]), "对应") for k, s in enumerate(scores)]
    frame = spark.createDataFrame(rows, "qid int, record_index long, retrieval_rank int, reranker_raw double, source_type string, query string")
    out = rerank.protect_top(rerank.is_table_query(rerank.rerank_from_scores(frame))).collect()
    for qid in range(150):
        mine = [r for r in out if r.qid == qid]
        order = [r.record_index for r in sorted(mine, key=lambda r: r.blended_rank)]
        guard = {r.record_index for r in mine if r.protected}
        head, tail = order[:5], order[5:]
        for x in [x for x in tail if x in guard]:
            k = max(k for k in range(5) if head[k] not in guard)
            tail.insert(0, head[k])
            head[k] = x
            tail.remove(x)
        want[qid] = head + sorted(tail, key=order.index)
    assert {q: [r.record_index for r in sorted((r for r in out if r.qid == q), key=lambda r: r.final_rank)] for q in want} == want


RESULT = "qid int, rank int, text string, reranker_score double, matched_by array<string>, source_file string, low_confidence boolean, effective_date string, active boolean"


def judged(spark, query, rows):
    both = ["bm25", "vector"]
    shown = spark.createDataFrame([(0, k, t, s, both, "f.pdf", False, None, True) for k, (t, s) in enumerate(rows, 1)], RESULT)
    return evidence.assess(spark.createDataFrame([(0, query)], "qid int, query string"), shown).first()


def test_evidence(spark):
    good = judged(spark, "本科学生国家奖学金奖励标准是多少", [("本科学生国家奖学金奖励标准为每人每年8000元", 0.98), ("国家奖学金", 0.72)])
    assert good.evidence_sufficient and good.confidence >= 0.8 and good.reason == "supported_by_retrieved_evidence"
    assert judged(spark, "学校附近明天会不会下雨", [("学校附近道路", 0.05), ("天气", 0.02)]).reason == "current_evidence_required"
    assert judged(spark, "任何问题", []).reason == "no_retrieval_results"
    other = judged(spark, "南京大学仙林校区有几个食堂", [("食堂", 0.9)])
    assert other.reason == "query_targets_different_institution" and other.wrong_entity == "南京大学"
    assert judged(spark, "羽毛球场如何预约和收费", [("羽毛球场开放", 0.9)]).missing_cues == ["预约", "收费/计费"]
    assert judged(spark, "校园班车遗失物品在哪里领取", [("失物 完全无关", 0.9)]).reason == "insufficient_query_evidence_overlap"


def test_extraction(spark):
    box = lambda *v: dict(zip(("x0", "y0", "x1", "y1"), map(float, v)))
    kind = "struct<x0 double,y0 double,x1 double,y1 double>"
    rows = spark.createDataFrame([(box(0, 0, 100, 100), box(10, 10, 90, 90)), (box(0, 0, 1, 1), box(5, 5, 6, 6))], f"a {kind}, b {kind}")
    assert [r.o for r in rows.select(extract.bbox_overlap("a", "b").alias("o")).collect()] == [1.0, 0.0]
    grid = extract.normalize_table([["", "", "10 分"], ["", "学习态度", "不遵守课堂纪律"], ["综合评议", "民主评议", ""]])
    assert grid[0] == ["列1", "列2", "列3"] and extract.markdown_table(grid).endswith("| 综合评议 | 民主评议 |  |")
    assert extract.normalize_table([["a", "b", ""], ["", "", "c"], ["1", "2", "3"]])[0] == ["a", "b", "b / c"]
    assert extract.normalize_table([["a", "", "c"], ["1", "2", "3"], ["", "4", "5"], ["6", "", ""]]) == [["a", "a", "c"], ["1", "2", "3"], ["1", "4", "5"], ["6", "", ""]]
    assert extract.normalize_table([["", "b", "c"], ["", "x", ""]]) == [["b", "c"], ["x", ""]] and extract.normalize_table([["", ""]]) == []
    tables = spark.createDataFrame([(1, [["a", "b"], ["c", "d"], ["e", "f"]]), (2, [["long prose " * 9], ["x" * 90], ["y" * 90]])], "n int, rows array<array<string>>")
    assert [r.p for r in tables.select("n", extract.plausible_stream(F.col("rows")).alias("p")).orderBy("n").collect()] == [True, False]
    assert extract.render_tables(tables).count() == 2
    pages = spark.createDataFrame([("f", 1, "优秀学生奖学金评"), ("f", 2, "定资格：要求"), ("f", 3, "三、奖励比例和标准")], "source_file string, page int, text string")
    pages = pages.union(spark.createDataFrame([("f", 4, ""), ("f", 5, "条件：无")], pages.schema))
    got = extract.continue_pages(pages, ["source_file"], "page").orderBy("page").collect()
    assert [r.continued_from for r in got] == [None, "上页续文：优秀学生奖学金评", None, None, None]
    assert got[1].indexed_text == "上页续文：优秀学生奖学金评\n\n定资格：要求" and got[4].indexed_text == "条件：无"
    ocr = spark.createDataFrame([("f", 1, 5.0, 9.0, "b", 0.9), ("f", 1, 1.0, 2.0, "a", 0.7)], "source_file string, page int, x double, y double, text string, score double")
    r = extract.ocr_pages(ocr).first()
    assert r.text == "a\n\nb" and r.low_confidence
    names = extract.artifact_names(spark.createDataFrame([("f.pdf", 7, 2)], "source_file string, page int, table_no int")).first()
    assert (names.page_artifact, names.table_artifact, names.table_id) == ("page-007.md", "page-007-table-02.md", "f.pdf#page-7-table-2")


def test_page_metrics(spark):
    blocks = spark.createDataFrame([("f", 1, k, 10.0, 100.0 - 30 * k, 200.0, 120.0 - 30 * k, "some words here") for k in range(3)], "source_file string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string")
    m = extract.page_metrics(blocks, spark.createDataFrame([("f", 1, 600.0, 800.0)], "source_file string, page int, width double, height double"))
    r = extract.route_pages(m).first()
    assert r.alnum == 39 and r.reading_order_anomaly and r.decision == "native" and round(r.duplicate_line_ratio, 3) == 0.667
    assert r.quality_warnings == ["short_text", "duplicate_line_ratio", "reading_order_anomaly"]
    boxes = spark.createDataFrame([("f", 1, {"x0": 0.0, "y0": 90.0, "x1": 300.0, "y1": 130.0})], "source_file string, page int, bbox struct<x0 double,y0 double,x1 double,y1 double>")
    assert extract.body_text(blocks, boxes).first().text == "some words here\n\nsome words here"
    # A page without text and one with blank blocks only go to OCR; blank blocks don't come between neighbours.
    size = "source_file string, page int, width double, height double"
    kind = "source_file string, page int, block_no int, x0 double, y0 double, x1 double, y1 double, text string"
    more = blocks.union(spark.createDataFrame([("f", 1, 9, 0.0, 0.0, 9.0, 900.0, " \n"), ("f", 2, 0, 0.0, 0.0, 50.0, 9.0, "  "), ("f", 4, 0, 0.0, 0.0, 400.0, 400.0, "a�� b�\u3000c")], kind))
    got = {r.page: r for r in extract.route_pages(extract.page_metrics(more, spark.createDataFrame([("f", k, 600.0, 800.0) for k in (1, 2, 3, 4)], size))).collect()}
    assert {k: r.decision for k, r in got.items()} == {1: "native", 2: "ocr", 3: "ocr", 4: "ocr"}
    assert (got[3].alnum, got[3].usable_ratio, got[3].quality_warnings) == (0, 0.0, []) and got[4].replacement_ratio == 0.5
    assert got[1].reading_order_anomaly and round(got[1].duplicate_line_ratio, 3) == 0.667
    left = [("g", 1, k, 10.0, 50.0 * k, 90.0, 50.0 * k + 20, "left words") for k in range(3)] + [("g", 1, 3 + k, 400.0, 50.0 * k, 480.0, 50.0 * k + 20, "right words") for k in range(3)]
    assert extract.page_metrics(spark.createDataFrame(left, kind), spark.createDataFrame([("g", 1, 600.0, 800.0)], size)).first().reading_order_anomaly
    point = spark.createDataFrame([("f", 1, 0, 5.0, 5.0, 5.0, 5.0, "a  point\nhere")], kind)
    assert extract.body_text(point, spark.createDataFrame([("f", 1, {"x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0})], boxes.schema)).first().text == "a point here"


def test_borderless_pages_and_captions(spark):
    kind = "source_file string, page int, x0 double, y0 double, word string"
    rows = [("f", 1, x, 30.0 * y, f"w{x}") for y in range(4) for x in (10.0, 60.0, 120.0)]
    rows += [("f", 2, 10.0 + 20 * k, 30.0 * y, "prose") for y in range(4) for k in range(5)]
    rows += [("f", 3, x, 30.0 * y, "w") for y in range(2) for x in (10.0, 60.0)]
    words = spark.createDataFrame(rows + [("f", 1, 20.0, 301.0, "3"), ("f", 1, 10.0, 299.0, "表"), ("f", 1, 40.0, 300.0, "成绩")], kind)
    lines = extract.lines_of_words(words)
    assert lines.where("y = 300").first().text == "表3成绩"
    captions = lines.union(spark.createDataFrame([("f", k, 0.0, "表 1") for k in (2, 3)], lines.schema))
    assert [r.page for r in extract.may_hold_borderless(words, captions).collect()] == [1]
    boxes = spark.createDataFrame([("f", 1, 1, {"x0": 0.0, "y0": 390.0, "x1": 9.0, "y1": 400.0}, "none"), ("f", 1, 2, {"x0": 0.0, "y0": 500.0, "x1": 9.0, "y1": 600.0}, "none")], "source_file string, page int, n int, bbox struct<x0 double,y0 double,x1 double,y1 double>, fallback string")
    assert {r.n: r.title for r in extract.table_titles(boxes, lines).collect()} == {1: "表3成绩", 2: "none"}


def test_versions_and_gate(spark):
    kind = "document_id string, source_file string, version string, sha256 string, active boolean"
    old = spark.createDataFrame([("d", "2023.pdf", "2023", "x", True), ("e", "e.pdf", "1", "y", None)], kind)
    new = spark.createDataFrame([("d", "2024.pdf", "2024", "z")], "document_id string, source_file string, version string, sha256 string")
    assert {r.source_file: r.active for r in ingest.upsert_versions(old, new).collect()} == {"2023.pdf": False, "2024.pdf": True, "e.pdf": True}
    page = "decision string, confidence double, extraction_failures array<string>, extraction_diagnostics array<string>, quality_warnings array<string>"
    assert ingest.quality_gate(spark.createDataFrame([("native", None, [], ["d"], ["w", "w"])], page)).first().asDict() == {"failures": 0, "diagnostics": 1, "warnings": 2, "low_confidence_pages": 0, "passed": True}
    assert not ingest.quality_gate(spark.createDataFrame([("ocr", None, [], [], [])], page)).first().passed
    for bad in (dict(paths=[]), dict(paths=["a", "b"], document_id="x"), dict(paths=["a"], source_type="no"), dict(paths=["a"], effective_date="2024-13-01")):
        with pytest.raises(ValueError):
            ingest.validate_request(**bad)


def test_dense_index_and_dedup(spark):
    rows = spark.range(1000).withColumn("t", F.concat(F.lit("x "), F.col("id") % 7)).repartition(7)
    got = dense_index(rows, ["id"])
    assert got.where("id <> record_index").count() == 0 and got.count() == 1000
    assert sorted(r.id for r in index.first_wins(rows, ["id"], "t").collect()) == list(range(7))


def test_metrics(spark):
    ranks = [("m", 0, [0, 2, 1], 0), ("m", 1, [0, 2, 1], 1), ("m", 2, [0, 1, 2], None)]
    rankings = spark.createDataFrame([(m, c, k, x == want) for m, c, order, want in [("m", 0, [0, 2, 1], 2), ("m", 1, [0, 2, 1], 1)] for k, x in enumerate(order, 1)], "method string, case_id int, rank int, rel boolean")
    totals = spark.createDataFrame([(0, 1, "a", "native"), (1, 1, "b", "scanned")], "case_id int, n_relevant long, category string, pdf_type string")
    r = evaluate.report(evaluate.case_metrics(rankings, totals)).where("scope = 'overall'").first()
    assert ranks and (r.recall_at_1, r.recall_at_3, r.recall_at_5, r.mrr_at_5, r.ndcg_at_5) == (0.0, 1.0, 1.0, 0.4167, 0.5655)
    assert (r.mrr, r.candidate_recall, r.oracle_recall_at_20) == (0.4167, 1.0, 1.0)
    kind = "method string, case_id int, first_rank int, ndcg double, category string, pdf_type string"
    methods = {"legacy": [5, None], "bm25": [2, 6], "vector": [None, 2], "hybrid": [2, 2], "reranker": [1, 1]}
    cases = spark.createDataFrame([(m, k, rank, 0.5 if rank else 0.0, "ab"[k], ["native", "scanned"][k]) for m, ranks in methods.items() for k, rank in enumerate(ranks)], kind)
    rows = evaluate.report(cases)
    assert rows.where("method = 'reranker' and oracle_recall_at_20 is not null").count() == 0
    only = {(r.method, r.pdf_type): r for r in evaluate.report(cases.where("pdf_type = 'native'")).where("scope = 'pdf_type'").collect()}
    assert only["bm25", "scanned"].cases == 0 and only["bm25", "scanned"].mrr is None and only["bm25", "native"].cases == 1
    gates = evaluate.acceptance(rows).first().asDict()
    assert all(gates.values()) and len(gates) == 8
    worse = evaluate.acceptance(evaluate.report(cases.withColumn("first_rank", F.expr("if(method = 'reranker', 6, first_rank)")))).first()
    assert not worse.passed and not worse.reranker_mrr_above_hybrid_by_pdf_type and worse.hybrid_recall_above_legacy
    assert not evaluate.acceptance(evaluate.report(cases.where("method <> 'legacy'"))).first().hybrid_recall_above_legacy
    place = {(r.method, r.pdf_type): r for r in evaluate.first_place(cases).collect()}
    assert place["legacy", "scanned"].misses_by_category == {"b": 1} and place["reranker", "native"].misses_by_category == {} and place["reranker", "native"].recall_at_1 == 1.0
    assert [(r.method, r.first_rank) for r in evaluate.worst_cases(cases, 3).collect()] == [("vector", None), ("legacy", None), ("bm25", 6)]
    chunks = spark.createDataFrame([("f", "pdf"), ("f", "ocr"), ("g", "table")], "source_file string, source_type string")
    assert {r.source_file: r.pdf_type for r in evaluate.file_types(chunks).collect()} == {"f": "scanned", "g": "native"}
    found = spark.createDataFrame([(["target"], "target", "x", "f", 9, [1]), (["target"], "other", "f", "f", 1, [1]), (None, "other", "f", "f", 1, [1]), ([], "other", "f", "f", 2, [1])], "relevant_chunk_ids array<string>, chunk_id string, source_file string, expected_file string, page int, pages array<int>")
    assert [r.r for r in found.select(evaluate.relevant().alias("r")).collect()] == [True, False, True, False]


def test_thresholds(spark):
    rows = spark.createDataFrame([(True, 0.9), (True, 0.7), (False, 0.8), (False, 0.2)], "answerable boolean, score double")
    r = evaluate.refusal_at(rows, 0.75).first()
    assert (r.accepted_answerable, r.false_refusals, r.correct_refusals, r.false_answers, r.balanced_accuracy) == (1, 1, 1, 1, 0.5)
    best = evaluate.calibrate(spark.createDataFrame([(True, 0.9), (True, 0.8), (False, 0.2), (False, 0.1)], rows.schema)).first()
    assert (best.threshold, best.balanced_accuracy) == (0.8, 1.0)
    facts = spark.createDataFrame([(True, 0.9, True), (False, 0.6, True), (False, 0.95, False)], "answerable boolean, confidence double, hard_rules_passed boolean")
    x = evaluate.constrained_threshold(facts, 0.0).first()
    assert x.threshold > 0.6 and x.false_answer_rate == 0
    assert evaluate.classify(facts.where("answerable"), 0.5).first().false_answer_rate is None
    kinds = "answerable boolean, score double, source_type string, no_answer_type string"
    some = spark.createDataFrame([(True, 0.9, "native", None), (True, 0.4, "native", None), (True, 0.8, None, None), (False, 0.8, None, "outside_corpus"), (False, 0.2, None, "outside_corpus"), (False, None, None, None), (False, 0.1, None, None)], kinds)
    got = {(r.side, r.kind): r for r in evaluate.refusal_breakdown(some, 0.75).collect()}
    assert got["answerable", "native"].false_refusal_rate == 0.5 and got["no_answer", "outside_corpus"].false_answer_rate == 0.5 and got["answerable", "unknown"].accept_rate == 1.0 and got["no_answer", "unspecified"].refusal_recall == 1.0
    assert evaluate.refusal_report(some)["mode"] == "not_scored" and evaluate.refusal_report(some)["metrics"] is None
    fixed = evaluate.refusal_report(some, 0.75)
    assert fixed["mode"] == "fixed_threshold" and fixed["metrics"]["false_answers"] == 1 and len(fixed["breakdown"]) == 4
    assert evaluate.refusal_report(some, calibrated=True)["metrics"]["threshold"] in (0.4, 0.8, 0.9) and fixed["score_summary"]["no_answer"]["cases"] == 3
    with pytest.raises(ValueError):
        evaluate.refusal_report(some.limit(0), calibrated=True)
    judged_ = judged(spark, "本科学生国家奖学金奖励标准是多少", [("本科学生国家奖学金奖励标准", 0.9)])
    facts_ = spark.createDataFrame([(0.9, 0.5, False, False, None, []), (0.05, 0.5, False, False, None, []), (0.9, 0.1, False, False, None, []), (0.9, 0.5, True, False, None, []), (0.9, 0.5, True, True, None, []), (0.9, 0.5, False, False, "x", []), (0.9, 0.5, False, False, None, ["y"]), (None, 0.5, False, False, None, None)], "top_score double, coverage double, time_sensitive boolean, current_evidence boolean, wrong_entity string, missing_cues array<string>")
    assert judged_ is not None and [r.x for r in facts_.select(evaluate.hard_rules().alias("x")).collect()] == [True, False, False, False, True, False, False, False]
    rates = spark.createDataFrame([(0.05, 0.65), (0.06, 0.66), (None, None)], "false_answer_rate double, accept_rate double")
    assert [(r.far_ok, r.frr_ok) for r in evaluate.gates(rates).collect()] == [(True, False), (False, True), (True, True)]
    p = evaluate.latency(spark.createDataFrame([(float(k),) for k in (1, 2, 3, 4)], "v double"), "v", []).first()
    assert (p.p50_ms, p.p95_ms) == (2.0, 4.0)


def test_answers(spark):
    pair = spark.createDataFrame([(1, "一般在学年限为2.5至3年", "在学年限一般为2.5至3年"), (2, "", "x"), (3, "a", "bab")], "id int, gold string, answer string")
    got = [r.recall for r in answers.bigram_recall(pair, "gold", "answer", ["id"]).orderBy("id").collect()]
    assert got[0] > 0.7 and got[1:] == [0.0, 1.0]
    kind = "id string, query string, answer string, refused boolean, answerable boolean, evidence_sufficient boolean, confidence double, required_facts array<string>, cited_chunk_ids array<string>, relevant_chunk_ids array<string>, retrieved_chunk_ids array<string>, retrieval_results array<struct<chunk_id string, source_file string, page int>>, citations array<struct<chunk_id string, source_file string, page int>>, review struct<correct boolean, complete boolean, citation_supported boolean, uses_model_memory_or_guess boolean>"
    hit = [("a", "f", 1), ("noise", "f", 2)]
    rows = [
        ("c1", "q", "Fact One and fact two", False, True, True, 0.9, ["fact one", "FACT TWO"], ["a", "noise"], ["a", "b"], ["a", "noise"], hit, hit, (True, True, True, False)),
        ("c2", "q", "x", False, True, True, 0.9, ["z"], ["a"], ["b"], ["a"], hit, [("a", "f", 9)], None),
        ("c 3", "q", "no", True, False, True, 1.9, [], [], [], [], [], [], None),
    ]
    cases = spark.createDataFrame(rows, kind)
    r = {x.id: x for x in answers.score_cases(cases).collect()}
    assert (r["c1"].fact_recall, r["c1"].citation_precision, r["c1"].citation_recall, r["c1"].stage, r["c1"].citations_complete) == (1.0, 0.5, 0.5, "passed", True)
    assert r["c2"].stage == "retrieval_error" and r["c 3"].stage == "evidence_judgment_error"
    broken = {(x.id, x.rule) for x in answers.violations(cases, "I can't answer").collect()}
    assert {("c2", "citation_differs_from_retrieval"), ("c 3", "refusal_text"), ("c 3", "unsafe_id"), ("c 3", "confidence_out_of_range")} <= broken
    assert not [x for x in broken if x[0] == "c1"]
    r = answers.report(answers.score_cases(answers.with_fact_bigrams(cases))).first()
    assert (r.passed, r.cases, r.answerable_cases, r.no_answer_cases, r.answerable_answer_rate, r.no_answer_refusal_accuracy, r.fact_recall, r.citation_precision, r.citation_recall) == (1, 3, 2, 1, 1.0, 1.0, 0.5, 0.25, 0.25)
    assert (r.supported_citation_rate, r.citation_metadata_complete_rate, r.incorrect_answer_rate, r.false_answer_rate, r.false_refusal_rate, r.insufficient_refusal_compliance) == (0.5, 1.0, 0.0, 0.0, 0.0, None)
    assert (r.reviewed_answerable_cases, r.review_coverage, r.review_correct_rate, r.review_uses_model_memory_or_guess_rate, r.fact_bigram_recall) == (1, 0.5, 1.0, 0.0, 0.5)
    assert answers.unmatched_ids(cases.select("id"), cases.where("id <> 'c2'").select("id")).count() == 1


def test_case_results_follow_the_protocol(spark):
    tasks = spark.createDataFrame([("a", "question a", 2, 1), ("b", "question b", 2, 0)], "id string, query string, limit int, task_order int")
    hit = ("k1", "f", 1, "text")
    good = [
        ("1.0", "a", "question a", ("search_knowledge_base", ("question a", 2), ("question a", True, 0.9, "ok", [hit, ("k2", "f", 2, "more")])), ("a", "An answer.", False, ["k1"], [("k1", "f", 1)])),
        ("1.0", "b", "question b", ("search_knowledge_base", ("question b", 2), ("question b", False, 0.1, "no", [hit])), ("b", answers.REFUSAL, True, [], [])),
    ]
    frame = lambda rows: spark.createDataFrame(rows, answers.CASE_RESULT)
    assert answers.protocol_violations(tasks, frame(good), "1.0").count() == 0
    merged = answers.merge_predictions(tasks, frame(good), "1.0").collect()
    assert [r.id for r in merged] == ["b", "a"] and merged[1].citations[0].chunk_id == "k1" and merged[0].review.correct is None

    def broken(**change):
        version, name, query, (tool, arguments, (asked, enough, confidence, reason, found)), (own, answer, refused, cited, citations) = good[0]
        v = dict(version=version, query=query, tool=tool, arguments=arguments, asked=asked, enough=enough, confidence=confidence, reason=reason, found=found, own=own, answer=answer, refused=refused, cited=cited, citations=citations) | change
        row = (v["version"], name, v["query"], (v["tool"], v["arguments"], (v["asked"], v["enough"], v["confidence"], v["reason"], v["found"])), (v["own"], v["answer"], v["refused"], v["cited"], v["citations"]))
        return {r.rule for r in answers.protocol_violations(tasks, frame([row]), "1.0").collect()}

    for change, rule in (
        (dict(version="2"), "protocol_version"), (dict(query="x"), "query_differs_from_task"), (dict(tool="x"), "unexpected_tool"), (dict(arguments=("question a", 3)), "tool_arguments_differ_from_task"), (dict(asked="x"), "tool_result_query"),
        (dict(confidence=None), "tool_result_incomplete"), (dict(found=[hit, ("k2", "f", 2, ""), ("k3", "f", 3, "")]), "too_many_results"), (dict(found=[hit, ("k2", None, 2, "")]), "result_field_missing"), (dict(found=[hit, hit]), "repeated_result"),
        (dict(own="b"), "prediction_id"), (dict(refused=None), "prediction_incomplete"), (dict(cited=["k1", ""]), "blank_citation"), (dict(cited=["k1", "k1"]), "repeated_citation"), (dict(citations=[("k9", "f", 1)], cited=["k9"]), "cited_chunk_not_retrieved"),
        (dict(citations=[("k1", "f", 9)]), "citation_differs_from_retrieval"), (dict(cited=["k2"]), "citations_differ_from_cited_ids"), (dict(answer=" "), "must_answer_with_citation"), (dict(enough=False), "must_refuse_with_fixed_text"),
    ):
        assert rule in broken(**change), rule
    for rows in (good[:1], good + good[:1], [good[0], (good[1][0], "c", *good[1][2:])], [good[1], ("2", *good[0][1:])]):
        with pytest.raises(ValueError):
            answers.merge_predictions(tasks, frame(rows), "1.0")


def test_front_matter_and_files(spark, tmp_path):
    raw = spark.createDataFrame([("---\nurl: http://x:1\n a : b \nnoise\n---\n\nbody --- x\n",), ("\n\tplain ",)], "raw string")
    a, c = artifacts.front_matter(F.col("raw"))
    got = raw.select(a.alias("a"), c.alias("c")).collect()
    assert got[0].a == {"url": "http://x:1", "a": "b"} and got[0].c == "body --- x" and got[1].a == {} and got[1].c == "plain"
    again = raw.select(artifacts.with_front_matter(a, c).alias("raw")).select(a.alias("a")).collect()
    assert again[0].a == got[0].a
    (tmp_path / "d" / "pages").mkdir(parents=True)
    (tmp_path / "d" / "pages" / "p.md").write_text("---\nk: v\n---\n\nhello")
    (tmp_path / "d" / "pages" / "t.py").write_bytes(b"value = 1\r\n")
    assert [(r.kind, r.path, r.attributes) for r in artifacts.read_artifacts(spark, str(tmp_path)).collect()] == [(0, "d/pages/p.md", {"k": "v"})]
    with pytest.raises(ValueError):
        artifacts.inside(str(tmp_path), "../x")
    assert integrity.portable_sha256(b"value = 1\r\n") == integrity.portable_sha256(b"value = 1\n")
    manifest = integrity.create_manifest(spark, str(tmp_path), ["d/pages/t.py", "d/pages/p.md"])
    assert manifest.where("path = 'd/pages/t.py'").first().sha256 == integrity.portable_sha256(b"value = 1\n")
    manifest = manifest.persist()
    manifest.count()
    (tmp_path / "d" / "pages" / "p.md").write_text("changed")
    assert [(r.path, r.error) for r in integrity.verify_manifest(manifest, integrity.file_table(spark, str(tmp_path))).collect()] == [("d/pages/p.md", "sha256_mismatch")]
    with pytest.raises(FileNotFoundError):
        integrity.create_manifest(spark, str(tmp_path), ["nope"])
    assert len(integrity.tree_digest(integrity.file_table(spark, str(tmp_path))).first().digest) == 64


def test_publish_keeps_old_version_on_failure(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/index"
    t = spark.range(3)
    bad = t.withColumn("x", F.expr("if(id >= 0, raise_error('no'), 0)"))
    live = lambda: (publish.load(spark, root)[0]["version"], publish.load(spark, root)[1]["t"].count())
    folders = lambda: sorted(x.name for x in (tmp_path / "index").iterdir() if x.name.startswith("v="))
    publish.publish(spark, root, {"t": t}, {"version": "a", "tables": ["t"]})
    had = folders()
    # Another version fails; the same version fails, at its first table and at its second; the pointer can't be written.
    for tables, version in (({"t": bad}, "b"), ({"t": bad}, "a"), ({"t": spark.range(9), "u": bad}, "a")):
        with pytest.raises(Exception):
            publish.publish(spark, root, tables, {"version": version, "tables": ["t"]})
        assert live() == ("a", 3) and folders() == had
    write = publish.write_text

    def failing(spark, path, text, **more):
        if publish.POINTER in path:
            raise OSError("no")
        write(spark, path, text, **more)

    monkeypatch.setattr(publish, "write_text", failing)
    with pytest.raises(OSError):
        publish.publish(spark, root, {"t": spark.range(9)}, {"version": "a", "tables": ["t"]})
    monkeypatch.undo()
    assert live() == ("a", 3) and folders() == had
    # A pointer to a version that isn't whole doesn't count; one that exists isn't written over.
    publish.write_text(spark, f"{root}/{publish.POINTER}{7:09d}", "v=gone")
    assert live() == ("a", 3)
    with pytest.raises(OSError):
        publish.write_text(spark, f"{root}/{publish.POINTER}{7:09d}", "x", new=True)
    publish.publish(spark, root, {"t": spark.range(5)}, {"version": "a", "tables": ["t"]})
    assert live() == ("a", 5) and len(folders()) == 2
    publish.prune(spark, root, 1)
    assert live() == ("a", 5) and len(folders()) == 1


KIND = "document_id string, source_file string, version string, effective_date string, sha256 string, active boolean"


def test_engine_end_to_end(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rules.txt").write_text("Scholarship rules require a grade of ninety.\fThe library opens at eight.")
    pages = artifacts.extract_pages(spark, [f"{tmp_path}/in/rules.txt"]).withColumn("decision", F.lit("native")).withColumn("quality_warnings", F.array().cast("array<string>"))
    engine = Engine(spark, f"file://{tmp_path}/index")
    assert engine.status()["ready"] is False
    incoming = spark.createDataFrame([("rules", "rules.txt", "1", None, "s")], KIND.replace(", active boolean", ""))
    empty = spark.createDataFrame([], KIND)
    assert engine.ingest(pages, empty, incoming, dry_run=True)["changes"] == {"rules.txt": "added"}
    assert engine.ingest(pages, empty, incoming)["index"]["chunks"] == 2
    got = engine.retrieve("library opens", 2)
    assert got["results"][0]["text"].startswith("The library") and not got["diagnostics"]["cache_hit"]
    assert engine.retrieve("library opens", 2)["diagnostics"]["cache_hit"]
    for bad in (("", 5), ("x", 0), ("x", 11)):
        with pytest.raises(ValueError):
            engine.search(*bad)
    out = io.StringIO()
    said = lambda k, method, **params: json.dumps({"jsonrpc": "2.0", "id": k, "method": method, "params": params})
    lines = [said(1, "initialize"), json.dumps({"jsonrpc": "2.0", "method": "notifications/initialized"}), said(2, "tools/list"), said(3, "tools/call", name="search_knowledge_base", arguments={"query": "grade", "limit": 1}), said(4, "tools/call", name="x"), said(5, "nope"), "{"]
    cli.serve(engine, lines, out)
    replies = {r["id"]: r for r in map(json.loads, out.getvalue().splitlines())}
    assert replies[1]["result"]["serverInfo"]["name"] == "tessera" and len(replies[2]["result"]["tools"]) == 2
    assert len(replies[3]["result"]["structuredContent"]["results"]) == 1 and replies[4]["error"]["code"] == -32602 and replies[5]["error"]["code"] == -32601 and None in replies
    broken = pages.withColumn("extraction_failures", F.array(F.lit("boom")))
    with pytest.raises(ValueError):
        engine.ingest(broken, empty, incoming)
    assert engine.status()["chunks"] == 2
    # Another document comes in: the first one stays; its next version replaces it.
    more = pages.withColumn("source_file", F.lit("two.txt")).withColumn("text", F.concat(F.lit("second "), "text"))
    assert engine.ingest(more, None, incoming.withColumn("source_file", F.lit("two.txt")).withColumn("version", F.lit("2")))["index"]["chunks"] == 4
    assert {r["source_file"]: r["active"] for r in engine.status()["document_versions"]} == {"rules.txt": False, "two.txt": True}
    assert {r["source_file"] for r in engine.search("library", 5)} == {"two.txt"}


def test_index_of_a_folder_with_tables(spark, tmp_path, capsys):
    home = tmp_path / "art"
    for kind, name, raw in (
        ("pages", "page-001.md", "---\nsource_file: guide.pdf\npage: 1\nsource_type: pdf\nquality_warnings: short_text,duplicate_line_ratio\n---\n\n\nThe library opens at eight.\n"),
        ("pages", "page-002.md", "---\nsource_file: guide.pdf\npage: 2\nsource_type: ocr\nconfidence: 0.700\nlow_confidence: true\n---\n\nScanned rules of the dormitory."),
        ("tables", "page-001-table-01.md", "---\nsource_file: guide.pdf\npage: 1\nsource_type: table\ntable_id: guide.pdf#page-1-table-1\nextraction_score: 0.9\n---\n\n# Grades\n| Range | Points |\n| --- | --- |\n| 90 | 4.0 |\n| 80 | 3.0 |\nfootnote\n"),
        ("tables", "page-002-table-01.md", "---\nsource_file: guide.pdf\npage: 2\nsource_type: table\n---\n\nno bars here"),
        ("pages", "page-003.md", "---\nsource_file: guide.pdf\npage: 3\n---\n\nThe  library opens\nat eight."),
    ):
        (home / "guide" / kind).mkdir(parents=True, exist_ok=True)
        (home / "guide" / kind / name).write_text(raw)
    (home / "documents.json").write_text(json.dumps({"schema_version": 1, "documents": [{"document_id": "guide", "source_file": "guide.pdf", "version": "2024", "sha256": "s", "active": True}]}))
    index_root = f"file://{tmp_path}/index"
    assert cli.main(["build", "--index", index_root, "--artifacts", str(home)], spark) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["chunks"] == 4
    engine = Engine(spark, index_root)
    rows = {r.chunk_id: r for r in engine.load()[1]["chunks"].collect()}
    assert list(sorted(rows)) == ["guide/pages/page-001.md#1", "guide/pages/page-002.md#1", "guide/tables/page-001-table-01.md#1", "guide/tables/page-002-table-01.md#1"]
    table = rows["guide/tables/page-001-table-01.md#1"]
    assert (table.row_start, table.row_end, table.oversize_row, table.extraction_score, table.document_id, table.page) == (1, 2, False, 0.9, "guide", 1)
    assert table.retrieval_text == "表名：Grades\n字段：Range、Points\nRange：90；Points：4.0\nRange：80；Points：3.0" and "footnote" not in table.text
    assert rows["guide/pages/page-001.md#1"].quality_warnings == ["short_text", "duplicate_line_ratio"] and rows["guide/pages/page-002.md#1"].low_confidence
    assert rows["guide/tables/page-002-table-01.md#1"].retrieval_text == "no bars here" and rows["guide/tables/page-002-table-01.md#1"].row_start is None
    assert engine.search("表名 Grades points", 1)[0]["chunk_id"] == table.chunk_id
    # Unchanged content is used again, unless the settings differ or it is forced.
    assert engine.build_from_folder(str(home))["reused"] and not engine.build_from_folder(str(home), force=True)["reused"]
    assert not Engine(spark, index_root, Config(k1=1.2)).build_from_folder(str(home))["reused"]
    assert engine.status()["freshness"] == {"checked": True, "by": "digest", "fresh": True}
    (home / "guide" / "pages" / "page-001.md").write_text("changed")
    assert engine.status()["freshness"]["fresh"] is False and engine.warmup() > 0
    assert cli.main(["search", "library", "--index", index_root, "--limit", "1"], spark) == 0 and "library" in capsys.readouterr().out
    for wrong in (["build", "--index", index_root], ["search", "--index", index_root], ["ingest", "--index", index_root]):
        with pytest.raises(SystemExit):
            cli.main(wrong, spark)
    with pytest.raises(ValueError):
        engine.build_index(index.with_attributes(artifacts.read_artifacts(spark, str(home)).limit(0)), spark.createDataFrame([], KIND))


def test_ingest_command(spark, tmp_path, capsys):
    (tmp_path / "a.txt").write_text("The rules of the library, long enough to be taken for a document with text.")
    (tmp_path / "scan.txt").write_text("?")
    args = ["--index", f"file://{tmp_path}/index"]
    said = lambda: json.loads(capsys.readouterr().out.splitlines()[-1])
    assert cli.main(["ingest", f"{tmp_path}/a.txt", "--dry-run", *args], spark) == 0 and said()["changes"] == {"a.txt": "added"}
    assert cli.main(["ingest", f"{tmp_path}/a.txt", "--document-id", "a", "--effective-date", "2024-01-31", *args], spark) == 0
    out = said()
    assert out["source_types"] == {"a.txt": "native"} and out["documents"][0]["document_id"] == "a" and out["index"]["chunks"] == 1
    with pytest.raises(ValueError):  # a scanned page without OCR fails the gate
        cli.main(["ingest", f"{tmp_path}/scan.txt", *args], spark)
    assert cli.main(["ingest", f"{tmp_path}/scan.txt", "--allow-quality-failures", *args], spark) == 0
    assert [d["source_file"] for d in said()["documents"]] == ["a.txt", "scan.txt"]


def test_ocr_reuse_and_artifacts(spark):
    pages = spark.createDataFrame([("f", k) for k in range(1, 5)], "source_file string, page int")
    line = "source_file string, page int, x double, y double, text string, score double"
    cached = spark.createDataFrame([("f", 4, 0.0, 0.0, "old", 0.9), ("g", 1, 0.0, 0.0, "other", 0.9)], line)
    seen = []

    def recognize(todo):
        seen.extend(r.page for r in todo.orderBy("page").collect())
        return todo.selectExpr("source_file", "page", "0.0D as x", "0.0D as y", "'new' as text", "0.5D as score")

    got = artifacts.recognized_lines(pages, cached, recognize, 2, 4)
    assert sorted((r.page, r.text) for r in got.collect()) == [(2, "new"), (3, "new"), (4, "old")] and seen == [2, 3]
    with pytest.raises(ValueError):
        artifacts.recognized_lines(pages, cached, recognize, dpi=0)
    read = extract.continue_pages(extract.ocr_pages(got), ["source_file"], "page").withColumn("decision", F.lit("ocr"))
    rows = {r.path: r for r in ingest.page_artifacts(read).collect()}
    assert rows["f/pages/page-002.md"].low_confidence and "2 页" in rows["f/pages/page-002.md"].processing_note and rows["f/pages/page-004.md"].processing_note is None
    tables = spark.createDataFrame([("f", 2, 1, "| a |", "Grades", "lattice", 0.5)], "source_file string, page int, table_no int, markdown string, title string, method string, score double")
    r = ingest.table_artifacts(tables).first()
    assert (r.path, r.content, r.low_confidence) == ("f/tables/page-002-table-01.md", "# Grades\n\n| a |", True)


def test_batch_plug_ins(spark):
    import numpy as np

    rows = spark.createDataFrame([(k, f"text {k}") for k in range(40)], "record_index long, text string").repartition(3)
    sizes = dense.encode(rows, "record_index", "text", lambda: lambda texts: np.array([[len(texts), t.startswith("say: text")] for t in texts], float), batch=7, instruction="say: ").collect()
    assert len(sizes) == 40 and all(0 < r.vec[0] <= 7 and r.vec[1] == 1 for r in sizes)
    unit = dense.encode(rows, "record_index").first().vec
    assert sum(x * x for x in unit) == pytest.approx(1) and dense.encode(spark.createDataFrame([(1, None)], "record_index long, text string"), "record_index").first().vec == [0.0] * 64
    pairs = rows.selectExpr("1L as qid", "'q' as query", "text", "record_index", "cast(record_index + 1 as int) as retrieval_rank")
    scored = rerank.rerank(pairs, rerank.batch_scorer(lambda: lambda some: [int(t.split()[1]) / 100 for _, t in some], 16))
    assert scored.orderBy("score_rank").first().record_index == 39
    for bad in (lambda: dense.encode(rows, "record_index", batch=0), lambda: rerank.batch_scorer(None, 0)):
        with pytest.raises(ValueError):
            bad()


def test_tokens_agree(spark):
    rnd = random.Random(3)
    parts = ["Ab", "İ", "ſ", "第", "一", "。", "x-y", ".", "/", "9", " ", "é", "K", "鿿", "\n", "_"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 20))) for _ in range(300)] + [None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", tokens(F.col("t")).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == [tokens_of(t) for t in texts]
    pairs = spark.createDataFrame(list(zip(texts, texts[7:] + texts[:7])), "a string, b string")
    q = char_bigrams(F.col("a"))
    both = pairs.select(bigram_share("a", "b").alias("x"), (F.size(F.array_intersect(q, char_bigrams(F.col("b")))) / F.nullif(F.size(q), F.lit(0))).alias("y"))
    assert both.where("not (x <=> y)").count() == 0 and both.where("x > 0").count() > 20


def test_registered_queries_ask_with_whole_texts(spark, tmp_path):
    from tessera.plans import queries

    rnd = random.Random(6)
    words = [f"w{k}" for k in range(40)]
    docs = [(k, " ".join(rnd.choices(words, k=rnd.randint(5, 40))), rnd.choice(["en", "fr", "de"]), f"src{k % 4}") for k in range(60)]
    # The first six words are in no document, so a query cut to them finds nothing.
    items = [(k, "a1 a2 a3 a4 a5 a6 " + " ".join(rnd.choices(words, k=rnd.randint(2, 20)))) for k in range(8)]
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    vec = [(k, [rnd.random() for _ in range(4)]) for k in range(60)]
    spark.createDataFrame(vec, "vec_id long, embedding array<float>").write.parquet(f"{d}/embeddings.parquet")

    def brute(rows):
        split = {k: t.split(" ") for k, t, *_ in rows}
        avg, out = sum(map(len, split.values())) / len(split), {}
        for q, text in items:
            for k, t in split.items():
                score = 0.0
                for term in text.split(" "):
                    df, tf = sum(term in x for x in split.values()), t.count(term)
                    score += math.log(1 + (len(split) - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / avg))
                if score > 0:
                    out[q, k] = score
        best = {q: sorted(((-round(s, 6), k) for (x, k), s in out.items() if x == q))[:20] for q, _ in items}
        return {(q, k, n + 1): -s for q, rows in best.items() for n, (s, k) in enumerate(rows)}

    for query, rows in ((queries.bm25_topk, docs), (queries.bm25_active_subset, [r for r in docs if r[2] == "en"])):
        got = {(r.qid, r.record_index, r["rank"]): r.score for r in query(spark, d).collect()}
        assert got == pytest.approx(brute(rows), abs=2e-6)
    assert queries.legacy_tfidf_topk(spark, d).select("qid").distinct().count() == len(items)
    live = brute([r for r in docs if r[2] != "fr"])
    for query in (queries.rrf_fuse, queries.search_results):
        got = {(r.qid, r.record_index): r.bm25_rank for r in query(spark, d).collect() if r.bm25_rank}
        assert got and got.items() <= {(q, k): n for q, k, n in live}.items()
    grams = lambda t: {a + b for a, b in zip(t, t[1:])}
    text, plain = {k: t.replace(" ", "") for k, t, *_ in docs}, {q: t.replace(" ", "") for q, t in items}
    for r in queries.search_results(spark, d).collect():
        q = grams(plain[r.qid])
        assert r.reranker_score == pytest.approx(0.01 + 0.98 * len(q & grams(text[r.record_index])) / len(q), abs=1e-6)
    assert queries.evidence_decision(spark, d).where("coverage > 0").count() == len(items)
