"""Replies, slots, pages and text rules against values worked out by hand."""

import pytest

from lorekeep.operators import pages, replies, text
from lorekeep.plans.operator import view

RAW = "doc_id long, raw string"


def decided(spark, raw):
    r = replies.parse_decision(replies=spark.createDataFrame([(1, raw)], RAW)).first()
    return r["action"], r["response"], r["mode"], r["tools"]


@pytest.mark.parametrize("raw,expected", [
    ('ok {x}\n```json\n{"action": "call_tools", "tools": [{"tool_name": "a", "arguments": {"q": {"n": [1, {"k": "}"}]}}}, {"tool_name": "b"}, 5, {}]}\n``` end }', ("call_tools", None, "serial", "a,b")),
    ('{"action": "call_tools", "execution_mode": "parallel", "tools": "none"}', ("call_tools", None, "parallel", "")),
    (r'so: {"action": "direct_answer", "response": "a \"b\" {c}"} .', ("direct_answer", 'a "b" {c}', "serial", "")),
    ('{"action": "direct_answer"}', ("direct_answer", '{"action": "direct_answer"}', "serial", "")),
    ('{"action": "direct_answer"} and }', ("direct_answer", '{"action": "direct_answer"} and }', "serial", "")),
    ('{"action": "dance"}', ("direct_answer", '{"action": "dance"}', "serial", "")),
    ('{"action": "call_tools", ', ("direct_answer", '{"action": "call_tools",', "serial", "")),
    ('{"action": "call_tools" "tools": []}', ("direct_answer", '{"action": "call_tools" "tools": []}', "serial", "")),
    ("} nothing {", ("direct_answer", "} nothing {", "serial", "")),
    ("", ("direct_answer", replies.NOTHING, "serial", "")),
    (None, ("direct_answer", replies.NOTHING, "serial", "")),
])
def test_decisions(spark, raw, expected):
    assert decided(spark, raw) == expected


def test_nested_arguments_and_memories(spark):
    raw = spark.createDataFrame([(1, '{"action":"call_tools","tools":[{"tool_name":"a","arguments":{"x":{"y":[1,2]}},"reason":"why"},{"tool_name":"b"}]}'), (2, 'see [{"content":"c","about":{"t":["]"]}},{"content":""},{"mem_type":"profile"},{"content":"d","mem_type":"profile","confidence":1}] ok'), (3, "[1, 2"), (4, None)], RAW)
    assert [tuple(r) for r in replies.decision_tools(replies=raw).orderBy("doc_id", "pos").collect()] == [(1, 0, "a", '{"x":{"y":[1,2]}}', "why"), (1, 1, "b", "{}", "")]
    assert [tuple(r) for r in replies.parse_memory(replies=raw).orderBy("doc_id", "pos").collect()] == [(2, 0, "c", "entity", 0.8), (2, 3, "d", "profile", 1.0)]


@pytest.mark.parametrize("args,verdict,unknown", [
    ('{"city":"x","days":3}', "ok", 0), ('{"days":3}', "missing city", 0), ('{"city":"","days":"3"}', "missing city", 0), ('{"city":5}', "city is no string", 0), ('{"city":"x","days":"3"}', "days is no number", 0),
    ('{"city":"x","days":1.5,"unit":"m"}', "unit is not allowed", 0), ('{"city":"x","unit":"c","odd":{"a":1}}', "ok", 1), ('{"city":"x","days":null,"unit":""}', "ok", 0), ("{}", "missing city", 0), (None, "missing city", 0),
])
def test_slots(spark, args, verdict, unknown):
    slots = spark.createDataFrame([("w", "city", 0, "string", True, None), ("w", "days", 1, "number", False, None), ("w", "unit", 2, "string", False, '["c","f"]'), ("other", "x", 0, "string", True, None)], "tool string, slot string, pos int, type string, required boolean, allowed string")
    calls = spark.createDataFrame([(1, "w", args), (2, "free", '{"a":1}')], "call_id long, tool string, args string")
    got = {r["call_id"]: (r["verdict"], r["unknown"]) for r in replies.validate_args(calls=calls, slots=slots).collect()}
    assert got == {1: (verdict, unknown), 2: ("ok", 1)}


LINES = "doc_id long, page int, line_no int, text string, x double, y double, w double, h double, size double, is_bold boolean, is_monospace boolean"


def page(spark, rows, width=600.0):
    full = [(1, 0, i, r.get("text", "some words here"), float(r.get("x", 40)), float(r.get("y", 20 * i)), float(r.get("w", 500)), 12.0, float(r.get("size", 12)), r.get("bold", False), r.get("mono", False)) for i, r in enumerate(rows)]
    return {"layout_lines": spark.createDataFrame(full, LINES), "page_sizes": spark.createDataFrame([(1, 0, width)], "doc_id long, page int, width double")}


@pytest.mark.parametrize("xs,w,n,bounds,order", [
    ([40] * 4, 500, 1, "", [0, 1, 2, 3]),
    ([40, 340] * 2, 200, 2, "195.00", [0, 2, 1, 3]),
    ([10, 310] * 2, 280, 2, "195.00", [0, 2, 1, 3]),  # columns whose lines lie 20 points apart
    ([20, 220, 420] * 2, 150, 3, "135.00 345.00", [0, 3, 1, 4, 2, 5]),
    ([240, 300], 60, 2, "285.00", [0, 1]),  # middles two strips apart: no empty strip between, the fold keeps one column
])
def test_columns(spark, xs, w, n, bounds, order):
    frames = page(spark, [{"x": x, "y": 20 * (i // len(set(xs)))} for i, x in enumerate(xs)] if len(set(xs)) > 1 else [{"x": x} for x in xs])
    if w != 500:
        frames["layout_lines"] = frames["layout_lines"].selectExpr(*[c if c != "w" else f"{float(w)}D AS w" for c in frames["layout_lines"].columns])
    r = pages.columns(**frames).first()
    got = [x["line_no"] for x in pages.reading_order(**frames).orderBy("pos").collect()]
    if xs == [240, 300]:
        assert (r["n_columns"], r["boundaries"], got) == (1, "", [0, 1])
    else:
        assert r["n_columns"] == n and len(r["boundaries"].split()) == n - 1 and got == order
        sides = [float(b) for b in r["boundaries"].split()]
        assert all(a + w / 2 < b for a, b in zip(sorted(set(xs)), sides)) and all(b <= x for b, x in zip(sides, sorted(set(xs))[1:]))


def test_headings_keep_the_last_size_as_body(spark):
    frames = page(spark, [{"size": s} for s in (20, 19.5, 18.9, 12, 12)] + [{"size": 30, "text": "  "}, {"size": 18.9, "bold": True}])
    bins = [(r["size"], r["lv"], r["low"], r["high"]) for r in pages.heading_bins(**{x: frames[x] for x in pages.heading_bins.inputs}).orderBy("lv").collect()]
    assert bins == [(20.0, 1, 19.4, 22.0), (18.9, 2, 12.5, 20.9)]
    levels = {r["line_no"]: r["lv"] for r in pages.range_heading(**{x: frames[x] for x in pages.range_heading.inputs}).collect()}
    assert levels == {0: 1, 1: 1, 2: 2, 6: 1}
    one = page(spark, [{"size": 12}, {"size": 12}])
    assert pages.heading_bins(**{x: one[x] for x in pages.heading_bins.inputs}).collect() == []


def test_markdown_of_a_page(spark):
    rows = [
        {"text": "Title", "size": 20, "y": 0}, {"text": "first line", "y": 20}, {"text": "second", "y": 34}, {"text": "far below", "y": 90}, {"text": "∑ x = y", "y": 104}, {"text": "∫ more", "y": 118},
        {"text": "after", "y": 132}, {"text": "let x", "y": 146, "mono": True}, {"text": "let y", "y": 160, "mono": True}, {"text": " ", "y": 174}, {"text": "Section", "size": 16, "y": 188}, {"text": "code", "y": 202, "mono": True},
    ]
    md = pages.lines_to_md(**page(spark, rows)).first()["md"]
    assert md == "# Title\nfirst line\nsecond\n\nfar below\n\n$$\n∑ x = y\n∫ more\n$$\n\nafter\n```\nlet x\nlet y\n```\n\n## Section\n```\ncode\n```"


def test_columns_are_parted_by_a_blank_line(spark):
    frames = page(spark, [{"x": x, "y": y, "w": 200, "text": t} for t, x, y in (("left one", 40, 0), ("right one", 340, 0), ("left two", 40, 14), ("right two", 340, 14))])
    frames["layout_lines"] = frames["layout_lines"].selectExpr(*[c if c != "w" else "200D AS w" for c in frames["layout_lines"].columns])
    assert pages.lines_to_md(**frames).first()["md"] == "left one\nleft two\n\nright one\nright two"


@pytest.mark.parametrize("body,verdict", [
    ('He said "yes" (twice), and: [one] <two>; it is fine.', "ok"), ("他说：“可以”，《书名》（附录）……不错。还有一句完整的话！", "ok"), ("plain words §§§ here", "garbage"), ("", "empty"), (None, "empty"),
    ("a b! c d! e f!", "short"), ("\n" * 30 + "one long line of words", "sparse"), ("　" * 3 + "全角空格也是空白，这一句足够长。", "repeated"),
])
def test_text_layers_by_ordinary_characters(spark, body, verdict):
    assert text.quality_gate(page_texts=spark.createDataFrame([(1, body)], "doc_id long, text string")).first()["verdict"] == verdict


def test_timetables_of_more_than_seven_columns(spark):
    entry = '<td><div class="kbcontent">AB<br/>no course name of two letters</div></td>'
    html = f"<table><tr><th>1</th>{'<td></td>' * 7}{entry}</tr></table>"
    fields = view(spark, "/", "timetable_fields")
    got = text.schedule_rows(timetable_html=spark.createDataFrame([(1, html)], "person long, html string"), timetable_fields=fields).collect()
    assert [(r["place"], r["info"]) for r in got] == [("列8 1", "AB no course name of two lette")]


def test_words_in_order(spark):
    t = spark.createDataFrame([(1, "The 知识库 of RAG_2"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n"], r["tokens"]) for r in text.tokenize(mixed_texts=t, stop_words=spark.createDataFrame([("the",), ("of",)], "word string")).collect()}
    assert got[1] == (6, "知 识 库 rag_2 知识 识库")


def test_short_questions_are_planted_too(spark):
    from lorekeep.operators.search import Search

    docs = spark.createDataFrame([(1, "one red apple here"), (2, "applesauce"), (3, "nothing")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "apple", "all", None), (2, "red apple", "all", None), (3, "one red apple", "all", None)], "qid long, query string, perm_mode string, perm_group string")
    meta = docs.selectExpr("doc_id", "'g' AS kb_group", "'public' AS visibility")
    assert sorted(map(tuple, Search(docs, asked, meta).planted.collect())) == [(1, 1), (1, 2), (2, 1), (3, 1)]
