"""The search over a table of questions: permissions, index, refresh, contexts and prompts."""

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import retrieval
from lorekeep.operators.ranks import at_ranks
from lorekeep.operators.search import Config, Search, build_index, prompts, refresh_index, retrieve, tokens
from lorekeep.plans.operator import view

QUESTIONS = "qid long, query string, perm_mode string, perm_group string"
CHUNKS = "doc_id long, text string, file_path string, kb_group string, visibility string"


@pytest.fixture(scope="module")
def small(spark):
    chunks = [(1, "red apples and pears", "a", "g1", "internal"), (2, "red plums", "b", "g2", "internal"), (3, "green apples", "c", "g1", "public"), (4, None, "d", "g1", "public"), (5, "blue sky over fields", "e", "g2", "public"), (6, "grey stones lie there", "f", "g2", "public")]
    questions = [(1, "red apples", "all", None), (2, "red apples", "public_only", None), (3, "red apples", "groups", "g2"), (4, None, "all", None)]
    return spark.createDataFrame(questions, QUESTIONS), spark.createDataFrame(chunks, CHUNKS)


@pytest.mark.parametrize("name", ["hybrid_search", "topk_rerank", "build_prompt", "rerank_rank", "merge_dedupe", "ablation", "topk_bm25", "explicit_order", "multi_variant"])
def test_no_hidden_document_is_found(name, spark, sf_dir):
    op = getattr(retrieval, name)
    frames = {x: view(spark, sf_dir, x) for x in op.inputs}
    q = {r["qid"]: r for r in frames["questions"].collect()}
    docs = {r["doc_id"]: r for r in frames["kb_docs"].collect()}
    may = lambda i, d: q[i]["perm_mode"] == "all" or docs[d]["visibility"] == "public" or (q[i]["perm_mode"] == "groups" and docs[d]["kb_group"] == q[i]["perm_group"])
    rows = op(**frames).collect()
    assert rows
    if name == "build_prompt":
        by_path = {r["file_path"]: r["doc_id"] for r in docs.values()}
        assert all(may(r["qid"], d) for r in rows for path, d in by_path.items() if f"({path})" in r["prompt"])
    else:
        assert all(may(r["qid"], r["doc_id"]) for r in rows)


def test_contexts_follow_permissions_and_hold_every_visible_hit(small):
    got = retrieve(*small, Config(reranked=2)).collect()
    found = {}
    for r in sorted(got, key=lambda r: (r["qid"], r["rk"])):
        found.setdefault(r["qid"], []).append(r["doc_id"])
    assert found[1][0] == 1 and 3 in found[2] and 1 not in found[2] + found[3] and 2 in found[3] and 4 not in found
    text = {r["qid"]: r["prompt"] for r in prompts(small[0], retrieve(*small, Config(reranked=2))).collect()}
    assert text[1].startswith("[1] (a) red apples and pears\n[2] (") and text[1].endswith("\nQuestion: red apples")


def test_words_of_chinese_texts_and_stop_words(spark):
    d = spark.createDataFrame([("知识库 RAG_2 的",), (None,)], "t string")
    assert [r[0] for r in d.select(tokens(F.col("t"))).collect()] == [["知", "识", "库", "rag_2", "的", "知识", "识库"], []]
    assert d.select(tokens(F.col("t"), ("的", "rag_2"))).first()[0] == ["知", "识", "库", "知识", "识库"]


def test_refreshed_index_is_a_built_one(spark, small):
    _, chunks = small
    old = build_index(chunks)
    now = chunks.where("doc_id <> 2").withColumn("text", F.when(F.col("doc_id") == 3, "green pears").otherwise(F.col("text")))
    now = now.unionByName(spark.createDataFrame([(9, "new red words", "x", "g1", "public")], CHUNKS))
    new = refresh_index(old, now, spark.createDataFrame([(2,), (3,), (9,)], "doc_id long"))
    whole = build_index(now)
    rows = lambda i: (sorted(map(tuple, i.postings.collect())), sorted((r[0], *r[1]) for r in i.vectors.collect()), i.documents, i.length)
    assert rows(new) == rows(whole)


def test_questions_in_blocks_find_the_same(spark, sf_dir, monkeypatch):
    from lorekeep.operators import search

    frames = [view(spark, sf_dir, x) for x in ("documents", "questions", "kb_docs")]
    index = build_index(frames[0])
    one = sorted(map(tuple, Search(*frames, index=index).vec.collect()))
    monkeypatch.setattr(search, "QUESTION_BLOCK", 15)
    assert sorted(map(tuple, Search(*frames, index=index).vec.collect())) == one and one


def test_values_at_ranks(spark):
    v = [float((i * 7919) % 5003) / 7 for i in range(5000)] + [3.5] * 300
    d = spark.createDataFrame([(x,) for x in v], "v double")
    assert at_ranks(d, [1, 2500, 5300]) == [sorted(v)[k - 1] for k in (1, 2500, 5300)]


@pytest.mark.parametrize("permissions", [True, False])
def test_search_without_an_index_is_that_with_one(spark, sf_dir, small, monkeypatch, permissions):
    """The same lists, and nothing is built for them."""
    from lorekeep.operators import search

    cfg = Config(permissions=permissions, channel=5)
    own = [view(spark, sf_dir, x) for x in ("documents", "questions", "kb_docs")]
    for documents, questions, catalog in (own, (small[1].select("doc_id", "text"), small[0], small[1].where("doc_id <> 3"))):
        index = build_index(documents, cfg)
        given = Search(documents, questions, catalog, cfg, index)
        monkeypatch.setattr(search, "build_index", None)
        monkeypatch.setattr(search, "QUESTION_BLOCK", 15)
        monkeypatch.setattr(search._Scorer, "DOCUMENTS", 7)
        monkeypatch.setattr(search._Scorer, "QUESTIONS", 4)
        monkeypatch.setattr(search._Scorer, "HELD", 50)
        direct = Search(documents, questions, catalog, cfg)
        for name in ("vec", "kw", "kw_raw", "hyb", "rer"):
            lists = [sorted((r["qid"], r["rk"], r["doc_id"]) for r in getattr(x, name).collect()) for x in (given, direct)]
            assert lists[0] == lists[1] and lists[0], name
        monkeypatch.undo()


def test_texts_are_read_once(spark, small):
    """One pass over the texts both counts words and finds what scoring needs."""
    reads = spark.sparkContext.accumulator(0)

    def text(t):
        reads.add(1)
        return t

    documents = small[1].select("doc_id", F.udf(text, "string").asNondeterministic()("text").alias("text"))
    s = Search(documents, small[0], small[1])
    assert s.vec.count() and s.kw.count() and s.kw_raw.count() and reads.value == 6


def test_words_of_a_cut_text_are_those_found_one_by_one(spark):
    from lorekeep.operators.search import WORDS

    texts = ["", " .,;", "a", "..a  b_1--2..", "İstanbul ŞX", "é-à", "知识 a-b", "😀 x𝔘y", " a bあう", "a\n\nb\x00c", "²½ Ⅳ"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    got = d.select(F.filter(tokens(F.col("t")), lambda w: w != "知识").alias("a"), F.regexp_extract_all(F.lower("t"), F.lit(WORDS), F.lit(0)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and sum(len(r["a"]) for r in got) > 20


def test_merged_lists_read_the_texts_of_listed_documents_only(small):
    got = retrieval.merge_dedupe(documents=small[1].select("doc_id", "text"), questions=small[0], kb_docs=small[1])
    assert "LeftSemi" in got._jdf.queryExecution().optimizedPlan().toString()
    assert (1, 1, 0, 1) in set(map(tuple, got.select("qid", "doc_id", "src", "rk").collect()))


@pytest.mark.parametrize("name", ["calibrate", "build_prompt", "rerank_rank", "rerank_pipeline", "token_budget", "min_score", "topk_rerank", "rrf_fuse", "no_context", "funnel", "explicit_order"])
def test_no_postings_are_dealt_for_ranked_lists(name, spark, sf_dir, monkeypatch):
    """Neither an index nor a row for each question and matching document is made."""
    from lorekeep.operators import search

    monkeypatch.setattr(search, "build_index", None)
    monkeypatch.setattr(search, "_postings", None)
    monkeypatch.setattr(search.Search, "scored", None)
    op = getattr(retrieval, name)
    rows = op(**{x: view(spark, sf_dir, x) for x in op.inputs}).collect()
    assert rows or name == "no_context"
