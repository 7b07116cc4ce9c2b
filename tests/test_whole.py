"""Queries leave no row or part of a text out: small tables, results counted by hand."""

import pytest


@pytest.fixture()
def tables(spark, tmp_path):
    """Writes tables by name into a folder of their own and gives the folder."""

    def write(**frames):
        for name, (rows, schema) in frames.items():
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


def test_layout_reads_every_line_of_a_long_document(spark, tables):
    from markloom.plans import layout_queries as L
    from markloom.plans import reply_queries as R

    folder = tables(documents=([(1, "\n".join(["some words here"] * 450)), (2, "short\ntext")], "doc_id long, text string"))
    assert L.row_ink_profile(spark, folder).where("doc_id = 1").count() == 450 * 8
    lines = L.line_islands(spark, folder).where("doc_id = 1").groupBy("page").count().collect()
    assert {r.page: r["count"] for r in lines} == {0: 200, 1: 200, 2: 50}
    boxes = [r for r in L.normalize_box(spark, folder).where("doc_id = 1").collect()]
    assert {r.page for r in boxes} == {0, 1, 2} and all(0 < r.height <= 1 and r.y + r.height <= 1 for r in boxes)
    capped = L.cap_blocks(spark, folder).where("doc_id = 1").groupBy("page", "kind").count().collect()
    assert {(r.page, r.kind): r["count"] for r in capped} == {(p, k): min(n, -(-size // 6)) for p, size in ((0, 200), (1, 200), (2, 50)) for k, n in (("printed", 26), ("handwritten", 22))}
    assert {(r.doc_id, r.page) for r in R.segment_pages(spark, folder).select("doc_id", "page").collect()} >= {(1, 0), (1, 1), (1, 2)}


def test_ruled_lines_are_found_on_every_page(spark, tables):
    from markloom.plans.reply_queries import suppress_rules

    folder = tables(documents=([(1, "\n".join(["some words here"] * 250)), (2, "short\ntext")], "doc_id long, text string"))
    rows = suppress_rules(spark, folder).collect()
    assert sorted((r.doc_id, r.page) for r in rows) == sorted([(1, 0), (1, 1), (2, 0)] * 3)
    assert all(r.x1 - r.x0 > 90 for r in rows)


def test_term_weights_cover_both_sides(spark, tables):
    import math

    from markloom.plans.matching_queries import term_weights

    folder = tables(documents=([(1, "apple banana apple"), (21, "cherry")], "doc_id long, text string"), benchmark=([(7, "apple cherry")], "item_id long, text string"))
    got = {(r.sheet, r.side, r.ix, r.token): r.weight for r in term_weights(spark, folder).collect()}
    two, one = math.log(4 / 3) + 1, math.log(4 / 2) + 1  # three texts; tokens in two of them, in one
    want = {
        ("a", 1, "apple"): 2 / 3 * two, ("a", 1, "banana"): 1 / 3 * one, ("a", 21, "cherry"): two,
        ("q", 7, "apple"): two / 2, ("q", 7, "cherry"): two / 2,
    }
    assert got == {(0, *k): pytest.approx(v, abs=1e-8) for k, v in want.items()}  # both documents are on sheet 0


def test_a_line_of_two_questions_becomes_two(spark):
    from markloom.operators import extraction as X

    texts = ["Section A", "1. Define a term. [3] 2. Why is it so?", "and more", "3. Use 12. Apples as units", "Q 4. Sum up. (5 marks) 5 (b) Then list them!  6) Name one", "= 22/7 x 7. Next"]
    lines = spark.createDataFrame([(1, 0, i, 0.1, i * 0.03, 0.6, 0.02, t) for i, t in enumerate(texts)], "doc_id long, page_number int, line_no long, x double, y double, width double, height double, text string")
    rows = X.question_lines(lines).orderBy("pos").collect()
    assert [(r.line_no, r.text) for r in rows] == [
        (0, texts[0]), (100, "1. Define a term. [3]"), (101, "2. Why is it so?"), (2, texts[2]), (3, texts[3]), (400, "Q 4. Sum up. (5 marks)"), (401, "5 (b) Then list them!"), (402, "6) Name one"), (5, texts[5]),
    ]
    size = [len(r.text) for r in rows[5:8]]
    assert [r.x for r in rows[5:8]] == pytest.approx([0.1 + 0.6 * sum(size[:i]) / sum(size) for i in range(3)])
    assert [r.width for r in rows[5:8]] == pytest.approx([0.6 * n / sum(size) for n in size])
    got = X.assemble_questions(X.with_question_starts(X.question_lines(lines))).orderBy("ord").collect()
    assert [(r.normalized, r.text, r.marks) for r in got] == [
        ("1", "Define a term.", 3), ("2", "Why is it so? and more", None), ("3", "Use 12. Apples as units", None), ("4", "Sum up.", 5), ("5b", "Then list them!", None), ("6", "Name one = 22/7 x 7. Next", None),
    ]


def test_a_paper_of_fourteen_questions(spark):
    """Set tightly: two questions on a line, notes of marks, sections, furniture, parts of a question."""
    from markloom.operators import extraction as X

    texts = ["Page 1", "Time: 3 hours", "SECTION A"] + [f"{n}. Question number {n} is this. [2] {n + 1}. Question number {n + 1} is that. [3]" for n in range(1, 9, 2)]
    texts += ["Part B - ", "9. Explain (i) and (ii) below.", "10. Compare both. (4 marks) 11(a) First part of it? 11(b) Second part of it?", "Page 2", "12) Last but one. 13. The last one", "goes on here [10 marks]"]
    lines = spark.createDataFrame([(1, i // 8, i, 0.1, i % 8 * 0.03, 0.6, 0.02, t) for i, t in enumerate(texts)], "doc_id long, page_number int, line_no long, x double, y double, width double, height double, text string")
    got = X.assemble_questions(X.with_question_starts(X.question_lines(lines))).orderBy("ord").collect()
    assert [r.normalized for r in got] == [*map(str, range(1, 11)), "11a", "11b", "12", "13"]
    assert [r.section for r in got] == ["Section A"] * 8 + ["Part B"] * 6
    assert got[-1].text == "The last one goes on here" and got[-1].marks == 10 and got[1].text == "Question number 2 is that."
    assert X.sequence_looks_complete(X.assemble_questions(X.with_question_starts(X.question_lines(lines)))).first().complete


def test_every_region_is_read_from_its_reply(spark, tables):
    from markloom.plans.intake_queries import region_rows, scan_region_responses

    folder = tables(documents=([(1, "\n".join(f"line {i}" for i in range(40)))], "doc_id long, text string"))
    for rows in (scan_region_responses(spark, folder), region_rows(spark, folder)):
        assert sorted(r["index"] for r in rows.collect()) == list(range(40))


def test_every_grade_is_read_from_its_reply(spark, tables):
    import datetime

    from markloom.plans.review_queries import grade_rows, merge_grades, repair_json_payload

    rows = [(1, 7, 3, n, 20.0, 1.0, "A", datetime.date(2020, 1, n)) for n in range(1, 8)]
    schema = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_shipdate date"
    folder = tables(lineitem=(rows, schema))
    for got in (grade_rows(spark, folder), repair_json_payload(spark, folder)):
        assert sorted(r.question_no for r in got.collect()) == list(range(1, 8))
    assert {r.question_no for r in merge_grades(spark, folder).where("marks = 0").collect()} == {3, 4, 6}


def test_requests_hold_answers_and_every_open_part(spark):
    from markloom.operators.intake import requests

    q = spark.createDataFrame([(1, i, f"Q{i}", 3, f"t{i}" + "x" * 900) for i in range(3)], "paper_id long, q_ord long, label string, marks long, text string")
    a = spark.createDataFrame([(1, 0, i, None, 0.5, f"a{i}" + "y" * 1600) for i in range(2)], "paper_id long, student_ix long, a_ord long, label string, confidence double, text string")
    m = spark.createDataFrame([(1, 0, 0, 0, "matched"), (1, 0, 1, None, "unanswered"), (1, 0, 2, None, "unanswered")], "paper_id long, student_ix long, q_ord long, a_ord long, status string")
    open_q = q.where("q_ord > 0").selectExpr("*", "0L AS student_ix")
    lines = spark.createDataFrame([(9, 0, " one "), (9, 1, "  "), (9, 2, "two")], "doc_id long, pos long, text string")
    got = {(r.paper_id, r.student_ix, r.request): r.text for r in requests(q, a, m, open_q, a.where("a_ord = 1"), lines).collect()}
    asked = lambda i: f"questionId: {i}\nlabel: Q{i}\nmaxMarks: 3\nquestion: t{i}{'x' * 798}\n"
    opened = "\n".join(f'- id={i} label="Q{i}" text="t{i}{"x" * 398}"' for i in (1, 2))
    assert got == {
        (1, 0, "grading"): f"Mark the following 1 answers.\n\n{asked(0)}ocrConfidence: 0.50\nstudentAnswer: a0{'y' * 1498}\n---",
        (1, 0, "model_answers"): f"Write the expected answer for these 2 unanswered question(s).\n\n{asked(1)}---\n{asked(2)}---",
        (1, 0, "mapping"): f'Unmatched questions:\n{opened}\n\nUnmatched answers (handwriting OCR, may contain errors):\n- id=1 writtenLabel=none text="a1{"y" * 598}"',
        (9, None, "structure"): "Lines from the question paper, in printed order:\n\n0: one\n2: two",
    }


def test_request_batches_cover_students(spark):
    import os

    from markloom.plans.intake_queries import request_batches

    data = "/root/testdata/sf0.001"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    rows = request_batches(spark, data).collect()
    assert {r.student_ix for r in rows} == {None, 0, 1, 2} and {"grading", "structure"} <= {r.request for r in rows}
