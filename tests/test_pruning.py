"""Pruned joins against all pairs, and how much they leave out."""

import math
import random
import statistics

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.operators import alike, knn, memory, near, patterns, ranks, setjoin
from lorekeep.operators.knn import nearest
from lorekeep.plans.dialect import DUCK


def vectors(n, dim, seed, centres=12):
    rng = random.Random(seed)
    c = [[rng.gauss(0, 4) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + rng.gauss(0, 0.4) for x in c[i % centres]], f"g{i % 3}") for i in range(n)]


def plain(queries, rows, k, measure, sign, allowed=lambda q, r: True):
    out = []
    for q in queries:
        m = sorted((sign * round(measure(q[1], r[1]), 6), r[0]) for r in rows if r[1] and r[0] != q[0] and allowed(q, r) and measure(q[1], r[1]) is not None)
        out += [(q[0], i, n + 1) for n, (_, i) in enumerate(m[:k])]
    return sorted(out)


def l2(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b)) / n if n else None


@pytest.mark.parametrize("cos", [False, True])
def test_nearest_are_those_of_all_pairs(spark, cos):
    rows = vectors(600, 6, 3) + [(700 + i, [1.0] * 6, "g0") for i in range(30)] + [(800, [0.0] * 6, "g1"), (801, None, "g1")]
    queries = [rows[i] for i in (0, 7, 100, 333, 605)] + [(5000, [50.0] * 6, "g2")]
    q = spark.createDataFrame(queries, "qid long, embedding array<double>, mine string")
    r = spark.createDataFrame(rows, "id long, vector array<double>, theirs string")
    expected = plain(queries, rows, 10, cosine if cos else l2, -1 if cos else 1)
    got = nearest(q, r, 10, cosine=cos, pivots=24)
    assert sorted((x["qid"], x["id"], x["rk"]) for x in got.found.collect()) == expected
    seen = {x["qid"]: x["n"] for x in got.compared.collect()}
    assert seen[0] < 0.5 * len(rows)  # a query inside a cluster looks at its neighbourhood
    theirs = nearest(q, r, 5, cosine=cos, allowed=F.col("mine") == F.col("theirs"), pivots=24)
    assert sorted((x["qid"], x["id"], x["rk"]) for x in theirs.found.collect()) == plain(queries, rows, 5, cosine if cos else l2, -1 if cos else 1, lambda a, b: a[2] == b[2])


def test_fewer_rows_than_asked_for(spark):
    q = spark.createDataFrame([(1, [0.0, 1.0]), (2, None)], "qid long, embedding array<double>")
    r = spark.createDataFrame([(1, [0.0, 1.0]), (5, [3.0, 1.0]), (4, [3.0, 1.0])], "id long, vector array<double>")
    assert [(x["qid"], x["id"], x["rk"]) for x in nearest(q, r, 9).found.orderBy("rk").collect()] == [(1, 4, 1), (1, 5, 2)]
    assert nearest(q, r.limit(0), 9).found.collect() == []


@pytest.mark.parametrize("threshold", [0.15, 0.5, 0.8, 1.0])
def test_similar_sets_are_those_of_all_pairs(spark, threshold):
    rng = random.Random(1)
    base = [rng.sample(range(300), rng.randint(1, 30)) for _ in range(25)]
    sets = [("p" if i % 5 else "q", i, [0, 1] * (i % 2) + [x for x in base[i % 25] if rng.random() > 0.1 * (i // 25)]) for i in range(150)] + [("p", 900, []), ("p", 901, None), ("q", 902, [7, 7, 7])]
    expected = []
    for p, i, x in sets:
        for o, j, y in sets:
            if p == o and i < j and x and y and len(set(x) & set(y)) / len(set(x) | set(y)) >= threshold:
                expected.append((p, i, j, len(set(x) & set(y)), len(set(x) | set(y))))
    d = spark.createDataFrame(sets, "part string, id long, items array<int>")
    assert sorted(map(tuple, setjoin.similar(d, threshold).collect())) == sorted(expected) != []
    tried = setjoin.candidates(setjoin.ordered(d), threshold).count()
    assert len(expected) <= tried and (threshold < 0.5 or tried < 3 * len(expected) + 50)  # all pairs that share an element are some 7,000


def test_repeated_questions(spark):
    rows = [(1, 1, "u", "where is the red book"), (1, 3, "u", "Where is the red book?"), (2, 1, "u", "quite another thing"), (3, 1, "v", "where is the red book"), (3, 3, "u", "x"), (4, 1, "u", None)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, user_id string, query string")
    assert [tuple(r) for r in memory.jaccard_repeats(reflection=d).collect()] == [(1, 3, 1, 1, 1)]


@pytest.mark.parametrize("limit", [patterns.BLOCK_CHARS, 2000])
def test_ten_thousand_words_in_all_texts(spark, limit):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdé") for _ in range(rng.randint(1, 6)))
    words = sorted({word() for _ in range(10_000)})
    texts = [(i, " ".join(word() for _ in range(30))) for i in range(40)] + [(100, None), (101, ""), (102, "aaaa")]
    got = patterns.hits(spark.createDataFrame(texts, "k long, t string"), ["k"], "t", spark.createDataFrame([(w,) for w in [*words, None, words[0]]], "word string"), limit)
    count = lambda t, w: sum(t.startswith(w, i) for i in range(len(t)))
    assert sorted(map(tuple, got.collect())) == sorted((i, w, count(t, w)) for i, t in texts if t for w in words if w in t)


def test_empty_words_and_no_words(spark):
    t = spark.createDataFrame([(1, "ab"), (2, None)], "k long, t string")
    assert [tuple(r) for r in patterns.hits(t, ["k"], "t", spark.createDataFrame([("",)], "word string")).collect()] == [(1, "", 3)]
    assert patterns.hits(t, ["k"], "t", spark.createDataFrame([], "word string")).collect() == []


@pytest.mark.parametrize("few", [ranks.FEW, 0])
def test_ranks_of_many_groups(spark, few, monkeypatch):
    monkeypatch.setattr(ranks, "FEW", few)
    monkeypatch.setattr(ranks, "LEAF", 16)  # more than one round
    rng = random.Random(2)
    rows = [(f"g{i % 7}", rng.lognormvariate(0, 3)) for i in range(4000)] + [("same", 5.0)] * 300 + [("one", -1.5), ("none", None), (None, 2.0), (None, 4.0), ("wide", -1e300), ("wide", 1e300), ("wide", 0.0), ("zero", -0.0), ("zero", 0.0)]
    got = {r["g"]: r for r in ranks.distribution(spark.createDataFrame(rows, "g string, v double"), ["g"]).collect()}
    by = {}
    for g, v in rows:
        by.setdefault(g, []).extend([] if v is None else [v])
    assert got.keys() == by.keys() and got["none"]["n"] == 0 and got["none"]["p95"] is None
    for g, v in by.items():
        if v:
            v.sort()
            assert got[g]["n"] == len(v) and got[g]["median"] == statistics.median(v) and got[g]["p95"] == v[min(int(len(v) * 0.95), len(v) - 1)]
            assert got[g]["mean"] == pytest.approx(statistics.fmean(v), abs=1e284 if g == "wide" else 1e-9)


def test_nearest_among_copies_in_many_groups(spark, monkeypatch):
    monkeypatch.setattr(knn, "SLICE", 40)  # cells and queries in several groups
    rows = vectors(300, 4, 8) + [(1000 + i, [2.0, 0.5, 1.0, -1.0], "g1") for i in range(120)]
    queries = rows[:70] + rows[-50:]
    q = spark.createDataFrame(queries, "qid long, embedding array<double>, mine string")
    r = spark.createDataFrame(rows, "id long, vector array<double>, theirs string")
    for cos in (False, True):
        got = nearest(q, r, 4, cosine=cos, pivots=6, allowed=F.col("mine") <= F.col("theirs"))
        assert sorted((x["qid"], x["id"], x["rk"]) for x in got.found.collect()) == plain(queries, rows, 4, cosine if cos else l2, -1 if cos else 1, lambda a, b: a[2] <= b[2])


def test_a_group_gives_out_no_pairs_of_copies():
    """400 copies asked for by 100 of them: four rows a query, not 40,000."""
    schema = T.StructType([T.StructField("qid", T.LongType()), T.StructField("id", T.LongType()), T.StructField("m", T.DoubleType()), T.StructField("s", T.DoubleType()), T.StructField("n", T.LongType())])
    q = pa.table({"qid": list(range(100)), "embedding": [[1.0, 2.0]] * 100, "__qd": [0.0] * 100, "__bound": [math.inf] * 100})
    r = pa.table({"id": list(range(400)), "vector": [[1.0, 2.0]] * 400, "__d": [0.0] * 400})
    found = knn._met(schema, 4, False, False, False)(q, r).to_pylist()
    assert sum(x["id"] is not None for x in found) == 400 and {x["n"] for x in found if x["id"] is None} == {399}
    assert [x["id"] for x in found if x["qid"] == 2 and x["id"] is not None] == [0, 1, 3, 4]


def test_questions_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(alike, "BLOCK", 30)
    monkeypatch.setattr(alike, "PRODUCT", 16)
    rng = random.Random(4)
    words = ["red", "book", "é𝄞", "where", "is", "knihu"]
    rows = [(i % 90, i, f"u{i % 2}", " ".join(rng.choice(words) for _ in range(rng.randint(0, 4)))) for i in range(260)] + [(500 + i, 0, "u0", "the same text") for i in range(40)]
    got = memory.like(spark.createDataFrame(rows, "conv_id long, turn long, user_id string, query string"), 0.4, 3).collect()
    grams = lambda t: {t[i : i + 2] for i in range(len(t) - 1)}
    expected = []
    for c, t, u, q in rows:
        s = []
        for hc, ht, hu, h in rows:
            a, b = grams(q.strip().lower()), grams(h.strip().lower())
            if hu == u and (hc, ht) < (c, t) and a and b and len(a & b) / len(a | b) >= 0.4:
                s.append((-round(len(a & b) / len(a | b), 6), hc, ht))
        expected += [(c, t, hc, ht, i + 1) for i, (_, hc, ht) in enumerate(sorted(s)[:3])]
    assert sorted(map(tuple, got)) == sorted(expected) != []


@pytest.mark.parametrize("spread", [0.05, 0.25, 3.0])
def test_near_memories_of_many_blocks(spark, monkeypatch, spread):
    for name, size in (("PAIR_BLOCK", 20), ("BLOCK", 20), ("PRODUCT", 7)):
        monkeypatch.setattr(near, name, size)
    rng = random.Random(6)
    rows = [(i, f"u{i % 2}", [rng.gauss(0, spread) for _ in range(3)]) for i in range(150)] + [(200, "u0", None), (201, None, [0.0, 0.0, 0.0]), (202, "u0", [0.0, 0.0])]
    d = spark.createDataFrame(rows, "mem_id long, user_id string, embedding array<double>")
    found = [(u, a, b, round(1 / (1 + l2(x, y)), 6)) for a, u, x in rows for b, o, y in rows if u and u == o and a < b and x and y and len(x) == len(y) and 1 / (1 + l2(x, y)) >= 0.85]
    assert sorted(map(tuple, memory.memory_dup(memory=d).collect())) == sorted(found)
    assert sorted(r["mem_id"] for r in memory.memory_upsert(memory=d).collect()) == sorted({r[0] for r in rows} - {f[1] for f in found})


def _group(vectors, blocks=1):
    """A group of `near.pairs`: one block, or two that meet."""
    n = len(vectors)
    own = [0] * n if blocks == 1 else [i % 2 for i in range(n)]
    ints = lambda x: pa.array(x, pa.int32())
    return pa.table({"owner": ["u"] * n, "dim": ints([2] * n), "a": ints([0] * n), "b": ints([blocks - 1] * n), "own": ints(own), "id": pa.array(range(n)), "vector": pa.array(vectors, pa.list_(pa.float64()))})


@pytest.mark.parametrize("blocks", [1, 2])
def test_near_pairs_of_a_group_are_given_out_a_few_rows_at_a_time(monkeypatch, blocks):
    monkeypatch.setattr(near, "PAIR_PRODUCT", 8)
    fields = [("owner", pa.string()), ("lefts", pa.list_(pa.int64())), ("rights", pa.list_(pa.int64())), ("units", pa.list_(pa.int32()))]
    group = _group([[0.001 * i, 0.0] for i in range(300)], blocks)
    pairs, most = 0, 0
    for batch in near._all_pairs(0.85, pa.schema(fields))(iter(group.to_batches())):
        units = batch["units"].flatten()
        pairs, most = pairs + sum(x.as_py() != near.APART for x in units), max(most, len(units))
    assert pairs == (300 * 299 // 2 if blocks == 1 else 150 * 150) and most <= 8 * 300


def test_similarities_are_rounded_as_in_sql_also_of_large_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(near, "PAIR_BLOCK", 8)
    monkeypatch.setattr(near, "PAIR_PRODUCT", 3)
    rng = random.Random(8)
    nan, inf = float("nan"), float("inf")
    rows = [(i, "u", [o + rng.gauss(0, 0.1) for _ in range(3)]) for i, o in enumerate([0.0, 1e3, 1e7] * 12)]
    rows += [(40, "u", [nan, 0.0, 0.0]), (41, "u", [inf, 0.0, 0.0]), (42, "u", [1e200, 0.0, 0.0]), (43, "u", [0.0, None, 0.0]), (5, "u", [1e3, 1e3, 1e3]), (7, "w", [0.0, 0.0, 0.0]), (7, "w", [0.0, 0.0, 0.1]), (8, "w", [0.0, 0.0, 0.2])]
    d = spark.createDataFrame(rows, "mem_id long, user_id string, embedding array<double>")
    found = []
    for a, u, x in rows:
        for b, o, y in rows:
            if u == o and a < b and None not in x and None not in y:
                s = 1 / (1 + sum((i - j) * (i - j) for i, j in zip(x, y)))
                if s >= 0.85 or math.isnan(s):
                    found.append((u, a, b, str(round(s, 6))))
    got = [(r["user_id"], r["a"], r["b"], str(r["similarity"])) for r in memory.memory_dup(memory=d).collect()]
    assert sorted(got) == sorted(found) and len({s for *_, s in found}) > 50
    named = spark.createDataFrame([(f"m{i}", u, x) for i, u, x in rows], "mem_id string, user_id string, embedding array<double>")
    assert sorted((r["user_id"], *sorted((r["a"], r["b"])), str(r["similarity"])) for r in memory.memory_dup(memory=named).collect()) == sorted((u, *sorted((f"m{a}", f"m{b}")), s) for u, a, b, s in found)


def test_recalled_memories_are_those_of_the_sql_also_of_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(near, "BLOCK", 25)
    monkeypatch.setattr(near, "PAIR_PRODUCT", 3)
    rng = random.Random(9)
    some = lambda: [round(rng.gauss(0, 1), 1) for _ in range(3)]
    nan, inf = float("nan"), float("inf")
    odd = [[0.1, None, 0.2], [None, None, None], [], None, [0.5], [0.1, 0.2, 0.3, 9.0], [nan, 0.0, 0.0], [inf, 0.0, 0.0], [1e200, 0.0, 0.0], [None, 0.3, None]] * 3
    vectors = [some() for _ in range(110)] + [[0.1, 0.2, 0.3]] * 40 + odd
    rows = [(i, None if i == 7 else f"u{i % 3 if i < 150 else i % 2}", ["profile", "entity", "conclusion"][i % 3], None if i % 31 == 0 else 0.5 + i % 6 / 10, i % 400, x) for i, x in enumerate(vectors)]
    rows += [(500 + i, "v", "profile", 1.0, 0, [float(i)] if i else [nan]) for i in range(3)]
    asked = [(i, f"u{i % 3}", some()) for i in range(30)] + [(30, "u0", [0.1, 0.2, 0.3]), (31, "u1", [0.1, None]), (32, "u1", None), (33, "v", [0.0]), (34, "nobody", [0.0]), (5, "u1", some()), (35, None, [0.0])]
    kinds = ["mem_id long, user_id string, mem_type string, confidence double, age_days long, embedding array<double>", "qid long, user_id string, embedding array<double>"]
    got = memory.topk_memory(memory=spark.createDataFrame(rows, kinds[0]), memory_queries=spark.createDataFrame(asked, kinds[1]))
    con = duckdb.connect()
    for name, data, kind in (("memory", rows, kinds[0]), ("memory_queries", asked, kinds[1])):
        con.execute(f"CREATE TABLE {name} ({kind.replace(' long', ' BIGINT').replace(' string', ' VARCHAR').replace('array<double>', 'DOUBLE[]')})")
        con.executemany(f"INSERT INTO {name} VALUES ({', '.join('?' * len(data[0]))})", data)
    expected = con.execute(memory.topk_memory.other(DUCK)).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(expected) and len(expected) > 150


def test_no_pair_of_query_and_memory_is_a_row(spark):
    rows = [(i, "u", "entity", 1.0, 0, [math.sin(i), math.cos(i)]) for i in range(400)]
    d = spark.createDataFrame(rows, "mem_id long, user_id string, mem_type string, confidence double, age_days long, embedding array<double>")
    found = near.nearest(d.selectExpr("mem_id AS qid", "user_id AS owner", "embedding AS vector"), d.selectExpr("mem_id AS id", "user_id AS owner", "embedding AS vector"), 3)
    assert found.count() == 3 * 400
