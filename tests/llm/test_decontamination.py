"""Exact and near matches against a plain scan, on odd rows."""

import hashlib
import re
from collections import Counter

import pytest

from lorekeep.llm import decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, row string, words string, wid string, at string, term string, pos string, items string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, size=10, slop=3, share=0.8):
    named = {}
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            named.setdefault(tuple(w[i : i + n]), set()).add("" if item is None else str(item))
    corpus = [(d, words(t)) for d, t in docs]
    counts = Counter(x for _, w in corpus for x in w)
    seeds = {k: sorted(set(k), key=lambda x: (counts[x], x))[:2] for k in named}
    out = []
    for d, w in corpus:
        hit, found, near = set(), set(), 0
        at = {}
        for p, x in enumerate(w):
            at.setdefault(x, []).append(p)
        for k, who in named.items():
            starts = [p for p in at.get(k[0], []) if tuple(w[p : p + len(k)]) == k]
            for p in starts:
                hit.update(range(p, p + len(k)))
                found |= who
            if len(seeds[k]) == 2:
                o0, o1 = k.index(seeds[k][0]), k.index(seeds[k][1])
                for p in {p - o0 for p in at.get(seeds[k][0], [])}:
                    if any(abs(q - o1 - p) <= slop for q in at.get(seeds[k][1], [])) and p not in starts:
                        near += len(set(k) & set(w[max(p - slop, 0) : max(p + len(k) + slop, 0)])) >= share * len(set(k))
        ids = ",".join(sorted(found))
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(ids.encode()).hexdigest(), bool(hit), near))
    return sorted(out, key=repr)


PASSAGE = "The quick BROWN fox, jumps over the lazy dog while a small cat looks on from its warm place"
ITEMS = [
    (1, PASSAGE), (1, PASSAGE), (2, "short item here"), (3, None), (4, " .,; "), (5, "again again again again again again again again again again again again"),
    (None, "an item that has no id but does have more than ten words in it"), (10, "Ärger über Öl und 42 Zahlen — 北京 天气 heute nicht gut genug"), (2, "a second text of item two that says other things than the first"), (7, "solo"),
]
TEXTS = [
    PASSAGE, f"before {PASSAGE.upper()} after", f"{PASSAGE} {PASSAGE}", PASSAGE.replace("lazy", "sleepy"), PASSAGE.replace("jumps over", "jumps right over"), " ".join(reversed(PASSAGE.split())),
    None, "", " \n\t", "short item here", "x short-item.HERE! solo", "again " * 30, "again " * 9, "an item that has no id but does have more than ten words in it, so it is found",
    "ÄRGER über öl", "vor Ärger über Öl und 42 Zahlen — 北京 天气 heute nicht gut genug nach", "nothing of the kind", "solo " * 5, "the first text says other things than item two, a second of that",
]


@pytest.mark.parametrize("broadcast_rows", [decontamination.BROADCAST_ROWS, 0])
def test_odd_rows(spark, broadcast_rows):
    docs = [*enumerate(TEXTS), (3, TEXTS[3]), (0, TEXTS[0]), (0, "another text of the same id"), (None, PASSAGE), (99, f"{'filler words of no item ' * 4000}{PASSAGE} tail " * 3)]
    d = spark.createDataFrame([(i, t, "x", *["x"] * 7) for i, t in docs], DOCS)
    b = spark.createDataFrame([(i, t, "x", "x") for i, t in ITEMS], "item_id long, text string, item string, words string")
    got = sorted(map(tuple, decontamination.contamination(d, b, broadcast_rows=broadcast_rows).collect()), key=repr)
    assert got == plain(docs, ITEMS)
    assert sum(r[6] > 0 for r in got) >= 2 and sum(r[5] for r in got) >= 10


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, PASSAGE)], "doc_id long, text string"), spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    assert decontamination.contamination(docs.limit(0), items).collect() == []
    assert [tuple(r) for r in decontamination.contamination(docs, items.limit(0)).collect()] == plain([(1, PASSAGE)], [])


def test_no_python(spark, sf_dir):
    plan = decontamination.op13_positional_index(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
