"""Spellings, names, matching rules and folds on small frames."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.functions import labels as L
from markloom.functions import payload as P
from markloom.functions import text as T
from markloom.operators import layout as Y
from markloom.operators import matching as M
from markloom.operators import review as R
from markloom.streaming import progress as S

LABELS = [
    ("11(a)", "11a"), ("11 (a)", "11a"), ("11a", "11a"), ("11.a", "11a"), ("11-A", "11a"), ("Q11(a)", "11a"), ("Ans. 11 (a)", "11a"),
    ("Section B - Q4", "4"), ("07", "7"), ("11:ii", "11ii"), ("11 What is", "11"), ("11 (b", "11b"), ("5 (ii", "5ii"), ("11 b)", "11b"),
    ("11[a", "11a"), ("l1(a)", "11a"), ("Q l2", "12"), ("hello", ""), (None, ""), ("", ""),
]


def test_labels(spark):
    df = spark.createDataFrame([(i, raw) for i, (raw, _) in enumerate(LABELS)], "i int, raw string")
    got = [r.n for r in df.select("i", L.canonical_label(F.col("raw"))["normalized"].alias("n")).orderBy("i").collect()]
    assert got == [want for _, want in LABELS]


def test_leading_labels_in_steps_as_at_once(spark):
    rows = [(i, t) for i, t in enumerate([x for x, _ in LABELS] + [f"{x} Then what?" for x, _ in LABELS] + ["Section 12", "Section 12 3) Go", "part a 4[b: x", "q. 07 . why", "Ans 5 -b) so", "12", "  ", "1234 no", "3 . ii) x"])]
    df = spark.createDataFrame(rows, "i int, text string")
    once = df.select("i", L.split_leading_label(F.col("text")).alias("p")).select("i", "p.*")
    steps = L.with_leading_label(df).select("i", "label", "normalized", "rest")
    assert sorted(map(tuple, steps.collect())) == sorted(map(tuple, once.collect()))


def test_sort_key(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "2", "11a", "11", "11b", "1", "x")], "n string")
    assert [r.n for r in df.orderBy(*L.label_sort_key(F.col("n"))).collect()] == ["1", "2", "10", "11", "11a", "11b", "x"]


@pytest.mark.parametrize(
    ("name", "index", "want"),
    [
        ("student_1_answer_sheet.pdf", 0, "Student 1 "), ("priya-sharma.pdf", 1, "Priya Sharma"), ("scan.pdf", 4, "Student 5"),
        ("IMG_20240115_ravi.jpg", 0, "Ravi"), ("2024-01-15_arjun.pdf", 0, "Arjun"), ("7.pdf", 0, "Student 7"),
    ],
)
def test_student_names(spark, name, index, want):
    got = spark.createDataFrame([(name, index)], "n string, i int").select(T.student_name(F.col("n"), F.col("i")).alias("x")).first().x
    assert got.strip() == want.strip()


def test_inline_starts_need_an_ended_sentence(spark):
    rows = [("Define it. [3] 2. Why so?",), ("foo [3] 2. Bar",), ("foo. [3] 2. Bar",), ("x = 22. Then",)]
    got = [r.p for r in spark.createDataFrame(rows, "t string").coalesce(1).select(T.inline_parts(F.col("t")).alias("p")).collect()]
    assert got == [["Define it. [3]", "2. Why so?"], ["foo [3] 2. Bar"], ["foo. [3]", "2. Bar"], ["x = 22. Then"]]


def test_json_repair(spark):
    cases = {
        '{"a":1}': '{"a":1}', "```json\n[1,2]\n```": "[1,2]", "```JSON {\"a\":2}```": '{"a":2}', 'so: {"a":"}{","b":[1]} ok': '{"a":"}{","b":[1]}',
        'x {"q":"say \\"hi\\" }"} y': '{"q":"say \\"hi\\" }"}', "nothing": None, '{"a": ': None, 'see [note] {"a":1}': '{"a":1}', "{x} then [1,[2]] end": "[1,[2]]",
        '{"a":[1} and [3]': None, '5 {"a":1}': '{"a":1}', "5": "5", '{"a":1} {"b":2}': '{"a":1}', "[NaN]": None, "": None, '{"a":1,"a":[2]}': '{"a":1,"a":[2]}',
    }
    rows = [(i, t) for i, t in enumerate([*cases, None])]
    got = {r.i: r.p for r in spark.createDataFrame(rows, "i int, t string").select("i", P.repair_json(F.col("t")).alias("p")).collect()}
    assert got == dict(enumerate([*cases.values(), None]))


def test_reply_rows_fenced_bare_and_wrapped(spark):
    from markloom.operators.replies import reply_rows

    row = '{"index":1,"text":"a"}'
    cases = {
        f'{{"regions":[{row}]}}': 1, f"```json\n[{row},{row}]\n```": 2, f'{{"z":[{row}],"a":[]}}': 1, f'{{"z":"[1]","b":[{row}],"a":[{row},{row}]}}': 1, f'{{"regions":{{"x":1,"list":[{row}]}}}}': 1,
        '{"regions":null,"rows":[{"index":1}]}': 0, '{"regions":"x"}': 0, "7": 0, "none": 0, f'{{"regions":[{row},7,null,[1],"x"]}}': 1, f'{{"regions":[],"regions":[{row}]}}': 1, f"[note]: [{row}]": 0,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "i int, reply string")
    got = {r.i: r["count"] for r in reply_rows(df, ["i"], "regions").groupBy("i").count().collect()}
    assert {i: got.get(i, 0) for i in range(len(cases))} == dict(enumerate(cases.values()))


def test_fields_of_any_type(spark):
    cases = [
        ('"12"', "12", 12.0, 0.12, False), ("2.0", "2", 2.0, 0.02, False), ("1.25", "1.25", 1.25, 0.0125, False), ("true", "true", None, 0.5, True), ('"TRUE"', "TRUE", None, 0.5, True), ('" true "', " true ", None, 0.5, False),
        ('""', "", 0.0, 0.0, False), ('" 3e1 "', " 3e1 ", 30.0, 0.3, False), ("null", None, None, 0.5, False), ('{"a":1}', None, None, 0.5, False), ("[1]", None, None, 0.5, False), ("-3", "-3", -3.0, 0.0, False), ('"1d"', "1d", None, 0.5, False),
    ]
    df, f = P.read_fields(spark.createDataFrame([(i, f'{{"v":{c[0]}}}') for i, c in enumerate(cases)], "i int, t string").select("i", P.parsed(F.col("t")).alias("r")), "r", ["v"])
    got = [tuple(r)[1:] for r in df.select("i", P.as_string(f["v"]), P.as_number(f["v"]), P.as_confidence(f["v"], 0.5), P.as_boolean(f["v"])).orderBy("i").collect()]
    assert got == [c[1:] for c in cases]


def test_structure_ranges(spark):
    from markloom.operators import replies as E

    lines = spark.createDataFrame([(1, i, t) for i, t in enumerate(["1. What is", "this [2]", "5) New", " question here ", "", "end"] + ["more"] * 200)], "p long, line_no long, text string")
    drafts = spark.createDataFrame([(1, "1", None, "S", "What is this"), (1, "2", 4, None, "x y z")], "p long, normalized string, marks long, section string, text string")
    reply = [
        '{"label":"Q1","marks":"0"},{"label":"1.","marks":3,"section":"T"},{"label":"2","marks":9,"section":" U "},{"label":"5","startLine":-1,"endLine":3},'
        '{"label":"5","startLine":"2","endLine":3},{"label":"(5)","section":"V","marks":2},{"label":"6","startLine":190,"endLine":9999},{"label":"7","startLine":4,"endLine":2},{"label":"x","startLine":1},{"label":"8","startLine":5,"endLine":1}'
    ]
    replies = spark.createDataFrame([(1, f"[{reply[0]}]")], "p long, reply string")
    got = {r.normalized: (r.marks, r.section, r.text) for r in E.merge_structure(drafts, E.structure_rows(replies, ["p"]), lines, ["p"]).collect()}
    assert got == {"1": (3, "S", "What is this"), "2": (4, "U", "x y z"), "5": (None, None, "New question here"), "6": (None, None, " ".join(["more"] * 16)), "8": (None, None, "end")}


def _sheet(spark, labels):
    q = spark.createDataFrame([(1, i, f"{i + 1}", f"{i + 1}", f"topic{i} word{i}") for i in range(4)], "paper_id long, q_ord long, label string, normalized string, text string")
    rows = [(1, 0, i, x, x, 0.9, [1], "") for i, x in enumerate(labels)]
    a = spark.createDataFrame(rows, "paper_id long, student_ix long, a_ord long, label string, normalized string, confidence double, pages array<int>, text string")
    return q, a


def test_positional_match_between_neighbours(spark):
    q, a = _sheet(spark, ["1", "", "3"])
    got = {(r.q_ord, r.a_ord, r.method) for r in M.deterministic_matches(q, a).collect()}
    assert got == {(0, 0, "explicit_label"), (2, 2, "explicit_label"), (1, 1, "structural_order")}


def test_reasons_name_the_pages_of_the_answer(spark):
    q, a = _sheet(spark, ["1", "2"])
    a = a.withColumn("pages", F.when(F.col("a_ord") == 0, F.array(F.lit(4), F.lit(3), F.lit(4))).otherwise(F.array(F.lit(2), F.lit(2))))
    got = {r.q_ord: r for r in M.map_answers(q, a).collect()}
    assert got[0].reasons[-1] == "This answer continues across pages 3 and 4." and got[0].methods == ["explicit_label", "continuation"]
    assert len(got[1].reasons) == 1 and got[1].methods == ["explicit_label", "continuation"] and got[3].methods == []


def test_corroboration(spark):
    rows = [(1, 0, 0, 5, 0.6, "structural_order", "s"), (1, 0, 0, 5, 0.4, "semantic_match", "m"), (1, 0, 0, 7, 0.9, "llm_reasoning", "l")]
    m = spark.createDataFrame(rows, "paper_id long, student_ix long, q_ord long, a_ord long, confidence double, method string, reason string")
    got = M.corroborate(m).first()
    assert (got.a_ord, round(got.confidence, 9), got.methods, got.reasons) == (5, 0.66, ["structural_order", "semantic_match"], ["s", "m"])


def test_ambiguous_smudge_stays_open(spark):
    q, a = _sheet(spark, ["9"])
    assert M.deterministic_matches(q, a).count() == 0
    m = M.map_answers(q, a)
    assert m.where("status = 'unanswered'").count() == 4


def test_clamped_edit_keeps_original(spark):
    g = spark.createDataFrame(
        [(1, 0, 1, 2.0, 5.0, "partial", True, None, "", 0.5), (1, 0, 2, 0.0, 5.0, "not_attempted", False, None, "", 0.5), (1, 0, 3, None, None, None, None, 4, None, None)],
        "paper_id long, student_ix long, question_no long, marks double, max_marks double, evaluation string, requires_review boolean, printed_marks long, feedback string, confidence double",
    )
    e = spark.createDataFrame([(1, 0, 1, 10, 99.0, None, "edit"), (1, 0, 2, 11, 3.0, None, "edit"), (1, 0, 2, 12, None, None, "revert"), (1, 0, 3, 13, None, "well done", "edit"), (2, 0, 1, 14, 1.0, None, "edit")], "paper_id long, student_ix long, question_no long, seq long, marks double, feedback string, kind string")
    rows = {r.question_no: r for r in R.apply_edits(g, R.latest_edits(e)).collect()}
    assert (rows[1].marks, rows[1].original_marks, rows[1].evaluation, rows[1].requires_review) == (5.0, 2.0, "correct", False)
    assert (rows[2].marks, rows[2].edited) == (0.0, False)
    assert (rows[3].marks, rows[3].max_marks, rows[3].evaluation, rows[3].feedback, rows[3].confidence) == (0.0, 4.0, "incorrect", "well done", 1.0)


def test_segment_page_with_rule(spark):
    page = np.full((300, 200), 245, np.uint8)
    for y, h in ((40, 10), (60, 10), (160, 10)):
        page[y : y + h, 20:160:2] = 20
    page[230:233, 5:195] = 20  # a ruled line
    df = spark.createDataFrame([(1, 7, 200, 300, page.tobytes()), (2, 0, 40, 40, b""), (3, 0, 200, 300, None)], "doc_id long, page long, width int, height int, gray binary")
    blocks = Y.segment_pages(df, 200).orderBy("block").collect()
    assert [(b.doc_id, b.page) for b in blocks] == [(1, 7), (1, 7)]
    assert blocks[0].top >= 35 and blocks[-1].bottom <= 180


def test_broken_frames_are_left_out(spark, tmp_path):
    e = spark.createDataFrame([(1, 0, "done", "view", "2024-01-01 00:00:00", 5)], "job_id long, stage long, state string, event_type string, ts string, event_id long").withColumn("ts", F.to_timestamp("ts"))
    S.write_frames(e, str(tmp_path / "frames"))
    with open(tmp_path / "frames" / "part-broken.txt", "w") as f:
        f.write('{"job_id": 1, "stage": \n\n')
    assert [(r.job_id, r.stage, r.event_id) for r in S.read_frames(spark, str(tmp_path / "frames"), stream=False).collect()] == [(1, 0, 5)]
    q = S.read_frames(spark, str(tmp_path / "frames")).writeStream.format("memory").queryName("frames_seen").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("frames_seen").count() == 1


def _png(width, height, value):
    import struct
    import zlib

    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    rows = b"".join(b"\0" + bytes([value]) * width for _ in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def test_files_and_page_images(spark, tmp_path):
    from markloom.sources import files

    (tmp_path / "a.png").write_bytes(_png(100, 90, 200))
    (tmp_path / "b.png").write_bytes(_png(20, 90, 200))
    (tmp_path / "c.png").write_bytes(b"no image")
    (tmp_path / "d").write_bytes(b"xx%PDF-1.4")
    got = {r.file_name: (r.extension, r.byte_size > 0, r.is_pdf) for r in files.scan_files(spark, str(tmp_path)).collect()}
    assert got == {"a.png": (".png", True, False), "b.png": (".png", True, False), "c.png": (".png", True, False), "d": ("", True, True)}
    pages = {r.file_name: r for r in files.scan_page_rasters(spark, str(tmp_path / "*.png")).collect()}
    assert (pages["a.png"].width, pages["a.png"].height, set(pages["a.png"].gray), pages["a.png"].error) == (100, 90, {200}, None)
    assert (pages["b.png"].error, pages["c.png"].error, pages["c.png"].gray) == ("TOO_SMALL", "CORRUPT", None)
