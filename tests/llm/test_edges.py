"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator."""

import pytest
from pyspark.sql import functions as F

from lorekeep.llm import byte_bpe, curve_packing, hnsw, importance_resampling, language_id, line_dedup, minhash_forest, quality_rules, secret_scan, token_counts

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_words string, ids string, spans string, key string, pos string, v string"
LONG = "lorem ipsum dolor sit amet " * 3000


@pytest.fixture(scope="module")
def docs(spark):
    line = "a line of text that is long enough to be compared with others"
    rows = [(1, f"{line}\nshort", "en"), (1, f"{line}\nshort", "en"), (2, None, "en"), (3, "", None), (None, "no id but some text here", "de"), (4, LONG, "en"), (5, " \n\t ", "en"), (6, line + "s", "en")]
    return spark.createDataFrame([(i, t, g, "s", len(t or ""), "x", "x", "x", "x", "x", "x") for i, t, g in rows], DOCS)


def path(name):
    import public_tokenizers

    return public_tokenizers.path(name)


FRAMES = {
    "packing": lambda d: curve_packing.pack(d, path(curve_packing.VOCABULARY)),
    "secrets": lambda d: secret_scan.find_secrets(d, ["doc_id"]),
    "masked": secret_scan.mask_secrets,
    "resampling": lambda d: importance_resampling.resample(d, d.where("doc_id = 1").select("doc_id"), 0.5),
    "rules": quality_rules.quality_rules,
    "lines": line_dedup.dedup_lines,
    "language": lambda d: language_id.identify(d, language_id.learn(d), ["doc_id"]),
    "bpe": lambda d: byte_bpe.with_ids(d, path(byte_bpe.VOCABULARY), out="tokens"),
    "counts": lambda d: d.select("doc_id", token_counts.token_count(F.col("text"), path(token_counts.VOCABULARY)).alias("n")),
    "near": minhash_forest.near_duplicates,
    "first": minhash_forest.keep_first,
}


@pytest.mark.parametrize("name", FRAMES)
def test_odd_rows(name, docs):
    got = FRAMES[name](docs).collect()
    ids = [r["doc_id"] for r in got]
    if name in ("secrets", "masked", "resampling", "rules", "language", "bpe", "counts", "near"):
        assert sorted(map(str, ids)) == sorted(map(str, [1, 1, 2, 3, None, 4, 5, 6]))
    if name in ("masked", "lines", "first"):
        assert got[0].asDict().keys() == set(docs.columns)
    if name == "packing":
        assert sum(r["length"] for r in got if r["doc_id"] == 2) == 1
    if name == "lines":
        assert sorted(map(str, ids)) == sorted(map(str, [1, 1, 2, 3, None, 4, 5]))
    if name == "first":
        assert ids.count(1) == 1 and len(ids) == 7
    if name == "language":
        assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got}[2] == ("und", 0.0)
    if name == "near":
        assert all(r["kept"] and r["n_shingles"] == 0 for r in got if r["doc_id"] in (2, 3, 5))


@pytest.mark.parametrize("name", FRAMES)
def test_empty_table(name, spark):
    assert FRAMES[name](spark.createDataFrame([], DOCS)).collect() == []


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, []), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [None, 1.0]), (None, [1.0, 1.0]), (10, [1.0, 2.0, 3.0])]
    v = spark.createDataFrame([(i, x, "x", "x") for i, x in rows], "vec_id long, embedding array<double>, rank string, shard string")
    index, shards = hnsw.build_index(v)
    got = [tuple(r) for r in hnsw.search(index, shards, v.where("vec_id = 0")).orderBy("rank").collect()]
    assert [(r[1], r[2]) for r in got] == [(1, 1), (2, 2), (3, 3)] and got[0][3] == 0.0
    none = v.where("vec_id = 4")
    index, shards = hnsw.build_index(none)
    assert hnsw.search(index, shards, none).collect() == []
