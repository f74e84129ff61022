"""Queries against rules written out by hand, apart from the SQL that both engines share."""

from lorekeep.operators import access, kb, retrieval, text
from lorekeep.plans.operator import view


def test_texts_short_and_with_titles_are_cut_by_the_rules(spark):
    near, title = "x" * 400 + "qz" + "y" * 400, "【a > b】" + "t" * 600
    docs = [(0, "short qz"), (40, "p" * 600), (80, near), (120, title), (1, "n" * 600), (2, "m" * 20), (3, "k" * 600)]
    got = text.smart_truncate(query_texts=spark.createDataFrame([(i, t, {0: "qz", 3: "k"}.get(i % 40)) for i, t in docs], "doc_id long, text string, query string")).collect()
    assert {r["doc_id"]: r["t"] for r in got} == {0: "short qz", 40: "p" * 512, 80: near[144:656], 120: title[:505], 1: "n" * 512, 2: "m" * 20, 3: "k" * 512}


def test_every_path_is_looked_up(spark):
    docs = [(i, f"kb/s/{i}.txt") for i in range(20)]
    got = kb.lookup_fallback(kb_docs=spark.createDataFrame(docs, "doc_id long, file_path string")).collect()
    assert sorted(map(tuple, got)) == [(i, p, "name" if i % 2 else "path") for i, p in docs]


def test_groups_count_all_documents_and_fall_back_to_the_store(spark):
    frames = {
        "kb_groups": spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "group_id long, name string"),
        "kb_group_members": spark.createDataFrame([(1, 5)], "group_id long, user_id long"),
        "kb_docs": spark.createDataFrame([(1, "p1", "a"), (2, "p2", "a"), (3, "p3", "a")], "doc_id long, file_path string, kb_group string"),
        "chunk_vectors": spark.createDataFrame([(1, "p1", "a"), (8, "p8", "b"), (9, "p8", "b"), (10, "p9", "b")], "chunk_id long, file_path string, kb_group string"),
    }
    assert sorted(map(tuple, access.group_overview(**frames).collect())) == [(1, "a", 1, 3), (2, "b", 0, 2), (3, "c", 0, 0)]


def test_candidates_without_a_score_keep_their_order_behind_the_others(spark, sf_dir):
    frames = {x: view(spark, sf_dir, x) for x in retrieval.rerank_pipeline.inputs}
    frames["questions"] = frames["questions"].where("qid < 3")
    scored = retrieval.rank_change(**{x: frames[x] for x in retrieval.rank_change.inputs}).collect()
    assert any(r["doc_id"] % 10 == 0 for r in scored)
    expected = set()
    for q in {r["qid"] for r in scored}:
        mine = [r for r in scored if r["qid"] == q]
        order = sorted((r for r in mine if r["doc_id"] % 10), key=lambda r: r["rk"]) + sorted((r for r in mine if r["doc_id"] % 10 == 0), key=lambda r: r["before_rk"])
        expected |= {(q, r["doc_id"], k) for k, r in enumerate(order, 1)}
    assert {tuple(r) for r in retrieval.rerank_pipeline(**frames).collect()} == expected
