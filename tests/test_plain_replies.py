"""Replies of plain JSON are read without Python, to the same end as all others."""

import pytest
from pyspark.sql import functions as F

from markloom.functions import payload as P
from markloom.operators import replies as R

ROW = '{"questionId":1,"marksObtained":"2.50","maxMarks":4,"evaluation":"Not  Attempted","feedback":"  so ","confidence":85,"requiresReview":"TRUE"}'
GRADES = '{"grades":[{"questionId":1,"marksObtained":1},' + ROW + "]}"
PLAIN = [
    GRADES, f"```json\n{GRADES}\n``` as asked", f"Here:\n```JSON {GRADES}```", f"```{GRADES}```", f"``` \n{GRADES}\n```\n```json\n{{}}\n```", f" \n\t{GRADES} \n", f"[{ROW}]", ROW,
    f'{{"note":[],"rows":[{ROW}]}}', f'{{"grades":null,"rows":[{ROW}]}}', f'{{"grades":{{"rows":[7,{ROW}]}}}}', f'{{"grades":[null,3,"x",[{ROW}],{ROW}]}}', '{"grades":[]}', "[]", "{}", '{"grades":7}',
    GRADES + " and so on", GRADES + GRADES.replace('"questionId":1', '"questionId":2'), GRADES + "}]", f"```json\n{GRADES}, or not\n```", '{"grades":[{"questionId":1e0,"evaluation":2.0,"feedback":{"a":1}}]}',
    '{"grades":[{"questionId":"1","evaluation":"2.0","feedback":"{a","marksObtained":" "},{"questionId":1.5},{"questionId":true}]}', '{"grades":[{"questionId":1,"feedback":"\\ud800 \\u00e9 é"}]}',
    '{"grades":[{"questionId":1,"marksObtained":1e999,"confidence":"1e999","maxMarks":"Infinity"}]}', '{"a":{"b":[{"questionId":1}]}}', '{"it\'s":[{"questionId":1}],"b":[{"questionId":1,"marksObtained":3}]}',
]
OTHER = [
    None, "", " ", "no", '"text"', "7", "null", "so: " + GRADES, f"```json\n{GRADES}", f"````json\n{GRADES}\n````", GRADES + "```` {} ```", "``````" + GRADES, GRADES[:-1], GRADES.replace(":1", ":01", 1), f" {GRADES}",
    '{"grades":[{"questionId":1,"questionId":2,"marksObtained":1}]}', '{"grades":[],"grades":[{"questionId":1}]}', f"```jſon\n{GRADES}\n```", '{"grades":[{"questionId":1,"feedback":"```{}```"}]}', "{bad} " + GRADES,
    '{"grades":[{"questionId":1,"feedback":"say `x`"}]}', f"```json\n{GRADES.replace('so', 'a `b` c')}\n```", '{"grades":[{"questionId":NaN}]}', "{'grades':[]}", '{"grades":[{"questionId":1,}]}', "[1," + GRADES,
    '{"grades":[{"questionId":' + "1" * 1200 + "}]}", "[" * 1200 + "]" * 1200, '{"grades":[{"questionId":1,"feedback":"tab\there"}]}', "```json\n" + GRADES + "\n`` `", "{}```" + GRADES + "```",
]


@pytest.fixture(scope="module")
def replies(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(PLAIN + OTHER)], "paper_id long, reply string")


def test_plain_json_is_what_is_found_in_all_replies(replies):
    both = replies.withColumns({"p": P.plain_json(F.col("reply")), "q": P.repair_json(F.col("reply"))})
    read = both.withColumn("v", F.try_parse_json("p")).withColumn("w", P.parsed(F.col("q"))).select(
        "paper_id", F.to_json("v").alias("v"), F.to_json("w").alias("w"), F.json_object_keys("p").alias("k"), F.json_object_keys("q").alias("l"))
    got = {r.paper_id: r for r in read.collect()}
    assert all(r.v == r.w and r.k == r.l for r in got.values() if r.v is not None)
    assert not [PLAIN[i] for i in range(len(PLAIN)) if got[i].v is None]


def test_grades_of_plain_and_other_replies_are_those_found_with_python(spark, replies, monkeypatch):
    targets = spark.createDataFrame([(i, n, 3, False) for i in range(len(PLAIN + OTHER)) for n in (1, 2)], "paper_id long, question_no long, printed_marks long, needs_review boolean")
    rows = lambda: sorted(map(repr, R.grade_rows(replies, ["paper_id"], targets).collect()))
    got = rows()
    monkeypatch.setattr(R, "plain_json", lambda text: F.lit(None).cast("string"))
    assert got == rows() and len(got) > 30


def test_plain_replies_do_not_pass_through_python(spark, monkeypatch):
    """Only what is left unread does, from the rows written first; of several rows for a question numbers are read in the last."""
    replies = spark.createDataFrame([(1, GRADES), (2, "so: " + GRADES)], "paper_id long, reply string")
    seen, searched = [], []
    settle = R.settle
    monkeypatch.setattr(R, "settle", lambda df: seen.append((df, settle(df))) or seen[-1][1])
    monkeypatch.setattr(R, "repair_json", lambda text: searched.append(text) or P.repair_json(text))
    targets = spark.createDataFrame([(1, 1, 3, False), (2, 1, 3, False)], "paper_id long, question_no long, printed_marks long, needs_review boolean")
    got = R.grade_rows(replies, ["paper_id"], targets).collect()
    assert {(r.paper_id, r.marks, r.max_marks, r.evaluation, r.feedback, r.confidence, r.requires_review) for r in got} == {(i, 2.5, 4.0, "not_attempted", "so", 0.85, True) for i in (1, 2)}
    plans = [df._jdf.queryExecution().optimizedPlan().toString() for df, _ in seen]
    assert len(plans) == 2 and "ArrowEvalPython" not in plans[0] and "ArrowEvalPython" in plans[1]
    assert seen[0][1].where("_unread IS NOT NULL").count() == 1
