"""The pipeline on the smallest table: each stage's own promise."""

import random
import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lorekeep.llm import line_dedup, secret_scan

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, n int, pos string, spans string"
BIG = 1_000_000  # ids of the odd rows


def prose(words, n, seed):
    """`n` of the words as sentences of twelve, one a line."""
    rng = random.Random(seed)
    picked = [rng.choice(words) for _ in range(n)]
    return "\n".join(" ".join(picked[k : k + 12]).capitalize() + "." for k in range(0, n, 12))


def through(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        columns = docs.columns
        docs = corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns
    return docs, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)


def test_odd_rows_go_through(spark, sf_dir):
    """Nulls, empty and repeated texts, null ids, clashing columns, a very long text beside the documents."""
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    clean = table.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id").where("lang = 'en'").orderBy(F.desc("n_chars")).first()["text"]
    words = sorted(set(w for w in clean.split() if w.isalpha()))
    text = prose(words, 240, 1)
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, prose(words, 240, 2)), (4, prose(words, 60_000, 3)), (5, " \n\t "), (6, text + "!")]
    odd = spark.createDataFrame([(i and BIG + i, t, None, "s", len(t or ""), "k", 1, "p", "x") for i, t in rows], DOCS)
    kept, pieces = through(spark, table.unionByName(odd, allowMissingColumns=True), sf_dir)
    those = lambda d: d.where(f"doc_id IS NULL OR doc_id > {BIG}").select("doc_id").collect()
    assert sorted(str(r[0]) for r in those(kept)) == ["1000001", "1000004", "None"]
    assert {str(r[0]) for r in those(pieces)} == {"1000001", "1000004", "None"}


def test_empty_table_goes_through(spark, sf_dir):
    kept, pieces = through(spark, spark.createDataFrame([], DOCS), sf_dir)
    assert kept.count() == pieces.count() == 0


@pytest.mark.parametrize("gone", [[], [0], [1, 2], [4], [0, 1, 2, 3, 4], [0, 2, 4]])
def test_lines_without_some(spark, gone):
    d = spark.createDataFrame([("a\nb\n\nd\ne", gone)], "text string, gone array<int>")
    got = d.select(F.array_join(line_dedup._without(F.split("text", "\n"), F.col("gone")), "\n")).first()[0]
    assert got == "\n".join(x for i, x in enumerate(["a", "b", "", "d", "e"]) if i not in gone)


def test_one_long_text_of_repeats_and_secrets(spark):
    """Work follows the length of a text: not lines times lines that go, nor parts times spans."""
    n = 20_000
    line = "user_name: bobby77 password=hunter2hunter2 at https://api.example.com/v1"
    docs = spark.createDataFrame([(1, "\n".join([line] * n), "s")], "doc_id long, text string, source string")
    began = time.monotonic()
    assert line_dedup.dedup_lines(docs).first()["text"] == line
    got = secret_scan.find_secrets(docs, ["doc_id"]).select(F.size("base"), F.size("spans")).first()
    assert got[0] == n and got[1] >= 2 * n
    assert time.monotonic() - began < 120


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, before = docs.columns, None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, corpus_pipeline.written(stage(spark, docs, sf_dir), f"test-{name}")
        assert docs.columns == columns and docs.schema == before.schema
        ids = {r[0] for r in docs.select("doc_id").collect()}
        assert ids <= {r[0] for r in before.select("doc_id").collect()} and len(ids) > 0.7 * before.count()
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert {r[0] for r in pieces.select("doc_id").distinct().collect()} == ids
