"""The manifest against a plain tree in Python, on odd rows."""

import hashlib
import zlib

from pyspark.sql import functions as F

from lorekeep.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, node string, path string, pos long, size long, root string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
    return out


def steps(levels, i):
    for level in levels[:-1]:
        run, at = level[i - i % 8 : i - i % 8 + 8], i % 8
        yield run[:at], run[at + 1 :]
        i //= 8


def plain(rows):
    """Sorted (doc_id, leaf, subroot, root, proof, folded, verified) of all rows."""
    by = {}
    for r in rows:
        by.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    trees = {k: levels_of([x[2] for x in sorted(by[k], key=lambda x: x[:3])]) for k in names}
    crown = levels_of([trees[k][-1][0] for k in names])
    out = []
    for c, k in enumerate(names):
        for i, (_, _, mine, r) in enumerate(sorted(by[k], key=lambda x: x[:3])):
            path = [*steps(trees[k], i), *steps(crown, c)]
            hit = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            back = leaf(r[0], "".join(x.lower() if "A" <= x <= "Z" else x for x in r[1]), *r[2:]) if hit else mine
            for left, right in path:
                back = h(*left, back, *right)
            out.append((r[0], mine, trees[k][-1][0], crown[-1][0], h(*[x for p in path for s in p for x in s]), back, back == crown[-1][0]))
    return sorted(out, key=repr)


def made(docs):
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, F.lit(False))
    return sorted(map(tuple, merkle.verified(docs, hit, merkle.lowered(F.col("text"))).collect()), key=repr)


def test_odd_rows(spark):
    rows = [(i, f"Text {i} ÉÀ" if i % 2 else "ABC " * (i % 5), "en", "s", i) for i in range(150)]
    rows += [(1, "same", "de", None, None)] * 20 + [(None, "no id", "de", "x", 5), (None, None, "de", None, None), (2, "", "", "", 0), (3, "lone", None, "y", 1), (4, "é" * 70_000 + "Z", "fr", "y", None)]
    rows += [(1000 + i, "T", f"lang{i}", "s", 1) for i in range(70)]
    docs = spark.createDataFrame([(*r, "x", "x", 1, 1, "x") for r in rows], SCHEMA)
    assert made(docs) == plain(rows)


def test_one_row_and_no_row(spark):
    one = [(7, "Only", None, None, None)]
    docs = spark.createDataFrame([(*one[0], "x", "x", 1, 1, "x")], SCHEMA)
    assert made(docs) == plain(one) and made(docs)[0][1] == made(docs)[0][3]
    assert made(docs.limit(0)) == []


def test_many_ranges_by_shuffle(spark, monkeypatch):
    """No broadcast of the runs, one language, ids that are all equal."""
    monkeypatch.setattr("lorekeep.llm.common.RUNS", 0)
    rows = [(5, f"t{i % 40}", "en", "s", 1) for i in range(600)]
    assert made(spark.createDataFrame([(*r, "x", "x", 1, 1, "x") for r in rows], SCHEMA).repartition(7)) == plain(rows)
