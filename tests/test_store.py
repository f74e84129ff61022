"""The versioned store, corpus signatures and the segmented index."""

import threading

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import base
from lorekeep.operators.search import Config, Search, build_index, refresh_index
from lorekeep.operators.segments import FACTOR, SegmentedIndex
from lorekeep.operators.signature import changed_documents, differing, sign
from lorekeep.plans.operator import view
from lorekeep.sources import files, store
from lorekeep.sources.files import refused, scratch
from lorekeep.sources.store import Conflict, VersionedTable


def table(spark, rows=100, buckets=8):
    t = VersionedTable(spark, scratch(spark, "t"), "k", buckets)
    t.write(spark.range(rows).select(F.col("id").alias("k"), F.lit("old").alias("v")))
    return t


def content(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_changes_touch_only_their_buckets(spark):
    t = table(spark)
    one = spark.createDataFrame([(7, "new"), (1000, "new")], "k long, v string")
    touched = {r[0] for r in one.select(t.bucket_of("k")).collect()}
    assert t.upsert(one) == 2 and t.differing(1, 2) == touched
    assert content(t.read()) == sorted([(i, "new" if i == 7 else "old") for i in range(100)] + [(1000, "new")], key=repr)
    t.delete(spark.createDataFrame([(7,), (8,)], "k long"))
    assert {r["k"] for r in t.read().collect()} == {*range(100), 1000} - {7, 8}
    assert content(t.read(1)) == [(i, "old") for i in sorted(range(100), key=repr)]


def test_null_keys_and_all_rows_of_a_key(spark):
    t = VersionedTable(spark, scratch(spark, "t"), "k", 4)
    t.write(spark.createDataFrame([(None, "a"), (None, "b"), (1, "a"), (1, "b")], "k long, v string"))
    t.upsert(spark.createDataFrame([(None, "c"), (1, "d"), (1, "e")], "k long, v string"))
    assert content(t.read()) == [(1, "d"), (1, "e"), (None, "c")]
    t.delete(spark.createDataFrame([(None,), (1,)], "k long"))
    assert content(t.read()) == [] and t.read().columns == ["k", "v"]


def test_a_failed_write_leaves_the_old_version(spark):
    t = table(spark)
    before = content(t.read())
    with pytest.raises(Exception):
        t.upsert(spark.range(5).select(F.col("id").alias("k"), F.raise_error(F.lit("no")).cast("string").alias("v")))
    assert t.versions() == [1] and content(t.read()) == before


def test_readers_see_the_old_version_until_the_commit(spark, monkeypatch):
    t, seen = table(spark), []
    commit = store.Manifests.commit

    def late(self, version, written):
        seen.append(content(VersionedTable(spark, t.path, "k", 8).read()))  # all rows of the new version are written by now
        commit(self, version, written)

    monkeypatch.setattr(store.Manifests, "commit", late)
    old = content(t.read())
    t.upsert(spark.createDataFrame([(1, "new")], "k long, v string"))
    assert seen == [old] and content(t.read()) != old


def test_two_writers_cannot_both_win(spark):
    t = table(spark)
    rows = spark.createDataFrame([(1, "new")], "k long, v string")
    t.upsert(rows, base=1)
    with pytest.raises(Conflict):
        t.upsert(rows, base=1)
    won, lost = [], []

    def take(name):
        try:
            t.manifests.commit(99, {"by": name})
            won.append(name)
        except Conflict:
            lost.append(name)

    threads = [threading.Thread(target=take, args=(i,)) for i in range(4)]
    [x.start() for x in threads]
    [x.join() for x in threads]
    assert len(won) == 1 and len(lost) == 3 and t.manifests.read(99) == {"by": won[0]}


def test_rolling_back_copies_nothing_and_expiry_keeps_what_is_used(spark):
    t = table(spark)
    t.upsert(spark.createDataFrame([(1, "new")], "k long, v string"))
    t.rollback(1)
    assert t.version().folders == t.version(1).folders and t.expire(1) == [1, 2]
    assert content(t.read()) == [(i, "old") for i in sorted(range(100), key=repr)]


def test_catalog_of_files(spark):
    t = base.catalog(spark, scratch(spark, "c"), 4)
    cols = "file_path string, file_hash string, kb_group string, visibility string"
    t.write(spark.createDataFrame([("a", "1", "g", "public"), ("b", "1", "g", "internal"), ("c", "1", "h", "internal")], cols))
    batch = spark.createDataFrame([("a", "1", "x", "x"), ("b", "2", "x", "x"), ("d", "1", "x", "x"), ("d", "2", "y", "y")], cols)
    assert {(r["file_path"], r["action"]) for r in base.actions(t, batch).collect()} == {("a", "skip"), ("b", "update"), ("d", "insert")}
    base.update(t, batch)
    assert content(t.read()) == [("a", "1", "g", "public"), ("b", "2", "g", "internal"), ("c", "1", "h", "internal"), ("d", "2", "y", "y")]
    kept = base.catalog(spark, scratch(spark, "b"), 4)
    base.remove(t, kept, spark.createDataFrame([("a",), ("zz",)], "file_path string"))
    assert content(kept.read()) == [("a", "1", "g", "public")] and t.read().count() == 3
    base.permit(t, spark.createDataFrame([("b", None, "public")], "file_path string, kb_group string, visibility string"))
    assert ("b", "2", "g", "public") in content(t.read())


def test_batches_of_other_models_are_refused(spark):
    held = spark.createDataFrame([("m", 64)], "embedding_model string, embedding_dim int")
    given = spark.createDataFrame([(1, "m", 64), (2, "m", 32), (3, "n", 64)], "batch int, embedding_model string, embedding_dim int")
    assert {r["batch"]: r["taken"] for r in refused(held, given).collect()} == {1: True, 2: False, 3: False}
    assert all(r["taken"] for r in refused(held.limit(0), given).collect())


def test_signatures_tell_what_changed(spark):
    cols = "doc_id long, text string, kb_group string, visibility string"
    old = [(i, f"text {i}", "g", "public") for i in range(200)] + [(500, "twice", "g", "public")] * 2 + [(None, "n", "g", "public")]
    new = [(*r[:1], "edited", *r[2:]) if r[0] == 3 else (*r[:2], None, "public") if r[0] == 4 else r for r in old if r[0] != 5][:-2] + [(700, "new", "g", "public"), (None, "n", "g", "internal")]
    a, b = sign(spark.createDataFrame(old, cols)), sign(spark.createDataFrame(new, cols).repartition(3))
    assert content(changed_documents(a, b)) == sorted([(3, "changed"), (4, "changed"), (5, "removed"), (700, "added"), (500, "changed"), (None, "changed")], key=repr)
    assert 0 < len(differing(a, b)) <= 6
    assert changed_documents(a, sign(spark.createDataFrame(old, cols).repartition(5))).collect() == []


DOCS = "doc_id long, text string"


def live(index):
    i = index.live() if isinstance(index, SegmentedIndex) else index
    return content(i.postings), content(i.terms), sorted((r[0], *r[1]) for r in i.vectors.collect()), i.documents, round(i.length, 9)


def test_segments_are_an_index_built_anew(spark):
    now = {i: f"red word{i} {'common ' * (i % 3)}" for i in range(40)} | {41: None, 42: ""}
    frame = lambda: spark.createDataFrame(list(now.items()), DOCS)
    index = SegmentedIndex(spark, scratch(spark, "seg")).build(frame())
    assert live(index) == live(build_index(frame()))
    for step, change in enumerate([{3: "green pears", 100: "new red words"}, {3: None, 41: "has words now"}, {100: "again other words"}]):
        gone = [7 + step]
        now.update(change)
        [now.pop(g) for g in gone]
        index.refresh(frame(), spark.createDataFrame([(i,) for i in [*change, *gone]], "doc_id long"), merge=False)
        assert live(index) == live(build_index(frame()))
    assert len(index.state) == 3 and index.state[0].dead  # the first refresh wrote what later ones replaced
    assert sum(s.documents for s in index.state[1:]) <= 4  # what changed is all that was written
    index.merge()
    assert len(index.state) == 1 and not index.state[0].dead and live(index) == live(build_index(frame()))


def test_segments_of_like_size_are_merged(spark):
    now: dict[int, str] = {i: f"w{i}" for i in range(30)}
    frame = lambda: spark.createDataFrame(list(now.items()), DOCS)
    index = SegmentedIndex(spark, scratch(spark, "seg")).build(frame())
    for i in range(100, 100 + FACTOR):
        now[i] = f"new w{i}"
        index.refresh(frame(), spark.createDataFrame([(i,)], "doc_id long"))
    assert [s.documents for s in index.state] == [30, FACTOR] and live(index) == live(build_index(frame()))


def test_search_over_segments(spark, sf_dir):
    frames = [view(spark, sf_dir, x) for x in ("documents", "questions", "kb_docs")]
    now = frames[0].where("doc_id % 17 <> 0").withColumn("text", F.when(F.col("doc_id") % 19 == 1, F.concat("text", F.lit(" changed here"))).otherwise(F.col("text")))
    index = SegmentedIndex(spark, scratch(spark, "seg")).build(frames[0])
    index.refresh(now, frames[0].where("doc_id % 17 = 0 OR doc_id % 19 = 1").select("doc_id"))
    hits = lambda i: content(Search(now, *frames[1:], Config(), i).hyb.select("qid", "doc_id", "rk"))
    assert len(index.state) == 2 and hits(index.live()) == hits(build_index(now)) != []


def test_refreshing_a_whole_index_writes_changed_documents(spark):
    docs = spark.createDataFrame([(i, f"a b{i}") for i in range(20)], DOCS)
    now = docs.where("doc_id <> 4")
    assert live(refresh_index(build_index(docs), now, spark.createDataFrame([(4,)], "doc_id long"))) == live(build_index(now))


def test_whole_files_stay_small_whatever_a_source_has(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FILE", 2000, raising=False)
    rows = [(i, f"line {i}\nother é" if i % 2 else "the same text", "hot") for i in range(900)] + [(None, f"text {i}", "hot") for i in range(100)]
    rows += [(2000 + i, t, s) for i, (t, s) in enumerate([("a b", "a b/c+d:100%"), ("x\r\ny", "é%41"), (None, "a b/c+d:100%"), ("no folder", None), ("", "empty")])]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    sizes = [r["length"] for r in files.scan_directory(spark, files._text_files(spark, str(tmp_path))).collect()]
    assert max(sizes) < 4 * 2000 and len(sizes) < 30
    expected = {}
    for _, t, s in rows:
        expected[s] = expected.get(s, 0) + len(t or "")
    assert {r["source"]: r["chars"] for r in files.src_wholetext(spark, str(tmp_path)).collect()} == expected
    assert {r["source"] for r in files.src_dir_scan(spark, str(tmp_path)).collect()} == set(expected)
