"""Golden cases and properties that the driver tables don't hold."""

import datetime as dt

import pytest

from lorekeep.functions.hooks import FAILED, generate, pair_score, split_text
from lorekeep.operators import access, logs, retrieval, text
from lorekeep.sources.files import AUDIT, VersionedTable, bad_lines, check_model, json_lines, scratch
from lorekeep.streaming.jobs import circuit_breaker, finish, ingest, ingested, replay, token_bucket, ttl_cache

T0 = dt.datetime(2024, 1, 1)


def events(spark, rows, cols):
    return spark.createDataFrame([(i, T0 + dt.timedelta(seconds=s), *r) for i, (s, *r) in enumerate(rows)], f"event_id long, ts timestamp, {cols}")


def test_price_of_known_calls(spark):
    calls = spark.createDataFrame([(1, T0, "s", "deepseek-v4-flash", "x", 500, 200), (2, T0, "s", "deepseek-v4-flash", "x", 300, 50), (3, T0, "s", "deepseek-chat", "x", 1000, 400)], "event_id long, ts timestamp, session_id string, model string, call_site string, prompt_tokens long, completion_tokens long")
    row = logs.token_session(token_log=calls).first()
    assert (row["total_tokens"], row["total_cost"]) == (2450, 0.0031)


def test_operator_names_missing_tables():
    with pytest.raises(TypeError):
        access.permission()


def test_permission_grows_with_groups(spark, sf_dir):
    rows = {r["doc_id"]: r for r in access.permission_public.over(spark, sf_dir).collect()}
    assert all(r["for_groups"] or not r["for_empty"] for r in rows.values())


def test_budget_is_a_prefix(spark, sf_dir):
    seen = {}
    for r in retrieval.token_budget.over(spark, sf_dir).collect():
        seen.setdefault(r["qid"], set()).add(r["rk"])
    assert seen and all(v == set(range(1, len(v) + 1)) for v in seen.values())


def test_planted_passages_are_found(spark, sf_dir):
    r = retrieval.recall.over(spark, sf_dir).first()
    assert r["found"] >= 0.8 * r["planted"]


def test_rollback_and_clear(spark):
    t = VersionedTable(spark, scratch(spark, "t"))
    assert t.versions() == []
    t.write(spark.range(5))
    t.write(spark.range(2))
    t.rollback(1)
    assert t.read().count() == 5
    t.clear()
    assert t.read().count() == 0 and t.read(1).count() == 5
    assert t.expire(2) == [1, 2] and t.versions() == [3, 4]


def test_model_check(spark):
    catalog = spark.createDataFrame([("m", 64)], "embedding_model string, embedding_dim int")
    check_model(catalog, "m", 64)
    with pytest.raises(ValueError):
        check_model(catalog, "m", 32)


def test_bad_json_lines_are_dropped_and_counted(spark):
    path = scratch(spark, "bad")
    spark.createDataFrame([('{"event_id": 1, "tool_name": "a"}',), ("{broken",)], "value string").write.text(path)
    assert json_lines(spark, path, AUDIT).count() == 1
    assert {r["bad"]: r["count"] for r in bad_lines(spark, path, AUDIT).collect()} == {True: 1, False: 1}


def test_bucket_bursts_then_refills(spark):
    rows = events(spark, [(0, 1), (0, 1), (0, 1), (1, 1)], "user_id int")
    done = finish(token_bucket(replay(spark, rows, "b"), capacity=2.0, refill=1.0), "b")
    assert [r["allowed"] for r in done.orderBy("event_id").collect()] == [True, True, False, True]


@pytest.mark.parametrize("probe,mode", [(True, "CLOSED"), (False, "OPEN")])
def test_breaker_opens_and_probes(spark, probe, mode):
    rows = events(spark, [*[(i, "d", False) for i in range(5)], (10, "d", True), (60, "d", probe)], "dest string, ok boolean")
    done = finish(circuit_breaker(replay(spark, rows, "c")), "c").orderBy("event_id").collect()
    assert [r["verdict"] for r in done] == ["called"] * 5 + ["rejected", "called"]
    assert done[4]["mode"] == "OPEN" and done[-1]["mode"] == mode


def test_cache_fills_again_after_its_time(spark):
    rows = events(spark, [(0, "q"), (10, "q"), (700, "q"), (701, "r")], "k string")
    done = finish(ttl_cache(replay(spark, rows, "t")), "t").orderBy("event_id").collect()
    assert [r["hit"] for r in done] == [False, True, False, False]


def test_splitter_covers_the_text():
    t = ("一句话。" * 100 + "\n\n" + "word " * 300 + "x" * 1700).strip()
    chunks = split_text(t)
    assert all(len(c) <= 500 and t[a : a + len(c)] == c == c.strip() for a, c in chunks)
    assert chunks[0][0] == 0 and chunks[-1][0] + len(chunks[-1][1]) == len(t)
    assert all(not t[a + len(c) : b].strip() for (a, c), (b, _) in zip(chunks, chunks[1:]))
    assert split_text("") == split_text(" \n ") == []


@pytest.mark.parametrize("text,size,overlap,chunks", [
    ("aa bb cc dd", 5, 2, [(0, "aa bb"), (6, "cc"), (9, "dd")]),
    ("aa bb cc dd", 8, 3, [(0, "aa bb cc"), (6, "cc dd")]),
    ("one\n\ntwo two\nthree", 9, 3, [(0, "one"), (5, "two two"), (13, "three")]),
    ("abcdefgh", 4, 1, [(0, "abcd"), (3, "defg"), (6, "gh")]),
    ("a\n\nbbbbbbbbb c", 6, 0, [(0, "a"), (3, "bbbbb"), (8, "bbbb"), (13, "c")]),
])
def test_splitter_goes_down_the_separators(text, size, overlap, chunks):
    assert split_text(text, size, overlap, ["\n\n", "\n", " ", ""]) == chunks


def test_ingest_replaces_what_changed(spark):
    base, state, path = scratch(spark, "base"), scratch(spark, "state"), scratch(spark, "in")
    first = [("a", "alpha text one"), ("b", "beta text that stays"), ("c", "gone soon, so it is"), (None, "no path at all")]
    for rows in (first, [("a", "alpha text two"), ("b", "beta text that stays"), ("c", None), ("d", "short")]):
        spark.createDataFrame(rows, "path string, text string").coalesce(1).write.mode("append").parquet(path)
        ingest(spark.readStream.schema("path string, text string").parquet(path), base, state)
    got = ingested(spark, base)
    assert sorted(tuple(r) for r in got.where("chunk IS NOT NULL").select("path", "chunk").collect()) == [("a", "alpha text two"), ("b", "beta text that stays")]
    assert sorted(r[0] for r in got.where("chunk IS NULL").select("path").collect()) == ["a", "b", "c", "d"]
    ingest(spark.readStream.schema("path string, text string").parquet(path), base, scratch(spark, "again"))  # all batches once more
    assert ingested(spark, base).where("chunk IS NOT NULL").count() == 2


def test_scorer_marks_only_the_pair_that_fails(spark):
    def factory():
        def score(pairs):
            if any(t == "bad" for _, t in pairs):
                raise ValueError
            return [1.0] * len(pairs)

        return score

    df = spark.createDataFrame([("q", "ok"), ("q", "bad"), (None, "ok")], "q string, t string").coalesce(1)
    assert [r["s"] for r in pair_score(df, "q", "t", "s", factory).collect()] == [1.0, FAILED, 1.0]


def test_generator_falls_back(spark):
    df = spark.createDataFrame([("a",), ("b",)], "p string").coalesce(1)
    out = generate(df, "p", "o", lambda: lambda xs: ["" if x == "a" else x * 2 for x in xs])
    assert [r["o"] for r in out.collect()] == ["a", "bb"]


def test_chinese_rule(spark):
    docs = spark.createDataFrame([(0, "知" * 300), (2, "plain english text " * 20)], "doc_id long, text string")
    assert {r["doc_id"]: r["chinese"] for r in text.is_chinese(mixed_texts=docs).collect()} == {0: True, 2: False}
