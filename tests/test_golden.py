"""Rules against values worked out by hand."""

import pytest

from lorekeep.operators import chunking, evals, layout, logs, memory, text
from lorekeep.plans.operator import view


def one(op, column, **frames):
    return [r[column] for r in op(**frames).collect()]


@pytest.mark.parametrize("t,ok", [("$x^{2}$", True), ("$x$ $", False), ("}{", False), ("([)]", False), ("a(b[c]{d})", True), ("x", False), ("{", False), ("", False)])
def test_brackets_close_in_order(spark, t, ok):
    assert one(text.latex_ok, "ok", latex_texts=spark.createDataFrame([(1, t)], "doc_id long, t string")) == [ok]


@pytest.mark.parametrize("html,md", [
    ("<table><tr><th>a</th><td>b</td></tr><tr><td> c </td><td><b>d</b></td></tr></table>", "| a | b |\n| --- | --- |\n| c | d |"),
    ("<tr><td>1 2 3</td><td>x y</td></tr><tr><td></td><td></td></tr>", "| 1 | x |\n| --- | --- |\n| 2 | y |\n| 3 |  |"),
    ("<tr><td>only one</td></tr>", "| only one |\n| --- |"),
])
def test_tables(spark, html, md):
    assert one(text.html_table, "md", table_html=spark.createDataFrame([(1, html)], "tbl long, html string")) == [md]


def test_timetable(spark):
    cell = '<td>&nbsp;</td><td><div class="kbcontent1">线性代数 王小明</div><div class="x kbcontent">线性代数<br/>王小明1-16(周)<br/>[1-2节]<br/>【A楼101】</div></td>'
    html = f'<table id="timetable"><tr><td>head</td></tr><tr><th>第一节</th>{cell}</tr></table>'
    got = text.schedule_rows(timetable_html=spark.createDataFrame([(1, html)], "person long, html string"), timetable_fields=view(spark, "/", "timetable_fields")).collect()
    assert [(r["place"], r["info"]) for r in got] == [("周二 第一节", "线性代数 | 王小明 | 1-16周 | 1-2节 | A楼101")]


@pytest.mark.parametrize("answer,clean", [
    ("fact (来源：a.pdf，第3页) more", "fact  more"),
    ("one\n> 📚 参考来源：\n> - a\n- b\ntwo", "one\ntwo"),
    ("> ⚠️ 由大模型直接生成。\ntext", "text"),
    ("a  \n\n\n\nb", "a\n\nb"),
    ("（来源：x）", "（来源：x）"),
    ("- item\n- other", "- item\n- other"),
])
def test_answers(spark, answer, clean):
    assert one(evals.clean_answer, "answer", answers=spark.createDataFrame([(1, answer, answer)], "doc_id long, text string, answer string")) == [clean]


def test_short_lines_are_no_formulas(spark):
    lines = spark.createDataFrame([(1, 1, "∑x"), (1, 2, "a+b"), (1, 3, "plain words"), (1, 4, "x ∫ y")], "doc_id long, line_no int, line string")
    assert one(text.is_formula, "formula", doc_lines=lines) == [False, True, False, True]


def test_text_layers(spark):
    docs = spark.createDataFrame([(1, "A good sentence. Another one"), (2, "a!b!c!d"), (3, "��� x"), (4, "word\n" * 9)], "doc_id long, text string")
    assert {r["doc_id"]: r["verdict"] for r in text.quality_gate(page_texts=docs).collect()} == {1: "ok", 2: "short", 3: "garbage", 4: "short"}


def test_percentages_have_a_decimal(spark):
    rows = spark.createDataFrame([(1, "c", 0.125), (2, "c", None), (3, "c", 1.0)], "qid long, config string, context_recall double")
    assert {r["qid"]: r["recall"] for r in logs.fmt_pct(eval_scores=rows).collect()} == {1: "12.5%", 2: "N/A", 3: "100.0%"}


def test_headers_repeat_over_three_pages(spark):
    rows = [(d, p, p, 10.0, f"Title {p}") for d, n in ((1, 3), (2, 2)) for p in range(n)] + [(1, 0, 9, 400.0, "body"), (1, 1, 10, 400.0, "body"), (1, 2, 11, 400.0, "body")]
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, y double, text string")
    assert [(r["doc_id"], r["cleaned"], r["n"]) for r in layout.header_footer(layout_lines=lines).collect()] == [(1, "Title", 3)]


def test_markers_come_from_the_rules_given(spark):
    lines = spark.createDataFrame([(1, 0, "Part II  Listening"), (1, 1, "x"), (1, 2, "Chapter 4"), (1, 3, "Section B")], "doc_id long, line_no int, line string")
    rules = spark.createDataFrame([(1, 1, r"Part\s+I{1,3}V?\b.*Listen", "Part II Listening"), (2, 2, r"Chapter \d+", None)], "kind int, trial int, pattern string, label string")
    assert {r["line_no"]: r["path"] for r in chunking.asof_struct(exam_lines=lines, marker_rules=rules).collect()} == {0: "Part II Listening", 1: "Part II Listening", 2: "Part II Listening > Chapter 4", 3: "Part II Listening > Chapter 4"}


def test_memories_by_type_and_likeness(spark):
    rows = [(1, "u", "profile", "c", 1.0, 0, [0.0, 0.0]), (2, "u", "conclusion", "c", 1.0, 0, [0.0, 0.1]), (3, "u", "entity", "c", 1.0, 0, [3.0, 0.0]), (4, "v", "entity", "c", 1.0, 0, [0.0, 0.0])]
    m = spark.createDataFrame(rows, "mem_id long, user_id string, mem_type string, content string, confidence double, age_days long, embedding array<double>")
    assert [(r["a"], r["b"]) for r in memory.memory_dup(memory=m).collect()] == [(1, 2)]
    assert sorted(one(memory.memory_upsert, "mem_id", memory=m)) == [2, 3, 4]
    q = spark.createDataFrame([(0, "u", [0.0, 0.1])], "qid long, user_id string, embedding array<double>")
    assert [r["mem_id"] for r in sorted(memory.topk_memory(memory=m, memory_queries=q).collect(), key=lambda r: r["rk"])] == [1, 2, 3]


def test_relevancy_of_zero_missing_and_own_vectors(spark):
    from lorekeep.operators import evals

    q = spark.createDataFrame([(10, [1.0, 0.0], "g"), (20, [0.0, 2.0], "g"), (11, [1.0, 1.0], "g"), (30, [0.0, 0.0], "g")], "qid long, embedding array<double>, perm_group string")
    c = spark.createDataFrame([(10, [1.0, 0.0], 0), (2, [3.0, 4.0], 0), (3, [0.0, 0.0], 0), (4, None, 0), (11, [1.0, 1.0], 1)], "chunk_id long, embedding array<double>, label int")
    assert sorted(map(tuple, evals.relevancy(query_vectors=q, chunk_vectors=c).collect())) == [(10, 0.6), (20, 0.4), (30, None)]
