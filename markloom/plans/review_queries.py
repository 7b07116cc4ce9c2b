"""Queries over grades, replies and edits, and the SQL that checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from markloom.functions import payload as P
from markloom.operators import matching as M
from markloom.operators import replies as P2
from markloom.operators import review as R
from markloom.plans.label_queries import lit
from markloom.plans.matching_queries import _BASE, _qa
from markloom.plans.reply_queries import model_answer_rows
from markloom.sources.inputs import derived, with_inputs
from markloom.sources.publications import Publications, frozen, versions
from markloom.sources.shared import new_folder, settle
from markloom.streaming import review as S


def _g(spark, sf_dir):
    return derived(spark, sf_dir, "grades_in")


def _base(spark, sf_dir):
    """Grades, of which some questions of some papers have none."""
    none = (F.col("paper_id") % 11 == 0) & (F.col("question_no") % 3 == 0)
    graded = ("marks", "max_marks", "evaluation", "feedback", "confidence", "requires_review")
    return _g(spark, sf_dir).withColumns({c: F.when(~none, F.col(c)) for c in graded})


def _rows(spark, sf_dir):
    return R.apply_edits(_base(spark, sf_dir), R.latest_edits(derived(spark, sf_dir, "review_edits_in")))


def _arriving(spark, sf_dir):
    """(a folder of its own, the review events as a stream: files that mix early and late ones)."""
    folder = new_folder(spark, "reviews")
    e = derived(spark, sf_dir, "review_edits_in").select(*(F.col(f.name).cast(f.dataType) for f in S.EVENT.fields))
    e.repartition(6, F.xxhash64("seq")).write.parquet(f"{folder}/in")
    return folder, S.read_events(spark, f"{folder}/in")


def latest_review_edits(spark, sf_dir):
    """Kept up live: the edits arrive as a stream."""
    folder, events = _arriving(spark, sf_dir)
    return S.edits_in_force(S.follow_edits(events, f"{folder}/edits", f"{folder}/checkpoint"), spark)


def edit_overlay(spark, sf_dir):
    """Grades in force under the edits as the stream has left them."""
    return R.apply_edits(_base(spark, sf_dir), latest_review_edits(spark, sf_dir))


def grade_summary(spark, sf_dir):
    return R.grade_summary(_rows(spark, sf_dir), R.SHEET)


def grade_band(spark, sf_dir):
    return grade_summary(spark, sf_dir).select(*R.SHEET, R.grade_band(F.col("percentage")).alias("band"))


def verdict_tallies(spark, sf_dir):
    return R.verdict_tallies(_rows(spark, sf_dir), R.SHEET)


def class_rollup(spark, sf_dir):
    return R.class_rollup(_rows(spark, sf_dir), derived(spark, sf_dir, "lineitem").count())


def _full(spark, sf_dir):
    """Question rows of every sheet; the third student of a paper lacks every third mapping."""
    q, a = _qa(spark, sf_dir)
    m = M.finalize_mappings(q, a, M.deterministic_matches(q, a)).where("student_ix <> 2 OR q_ord % 3 <> 2")
    model = model_answer_rows(spark, sf_dir)
    sheets = a.select(*R.SHEET).distinct()
    return settle(R.question_rows(q, sheets, m, a, derived(spark, sf_dir, "sheet_grades_in"), model, derived(spark, sf_dir, "sheet_edits_in")))


def _summaries(rows):
    """What the grader said of a whole sheet."""
    n = F.col("student_ix")
    areas = F.when(n % 2 == 0, F.array(F.lit("Show the steps"), F.lit("Units")))
    return rows.select(*R.SHEET).distinct().select(
        *R.SHEET, F.concat(F.lit("Student "), (n + 1).cast("string")).alias("name"), F.concat(F.lit("paper_"), F.col("paper_id").cast("string"), F.lit(".pdf")).alias("file_name"),
        F.when(n == 1, F.lit("A good start.")).alias("summary"), areas.alias("improvement_areas"),
    )


def strengths_top4(spark, sf_dir):
    rows = _full(spark, sf_dir)
    return R.sheet_reviews(rows, _summaries(rows)).select(*R.SHEET, "strengths")


def improvements_top4(spark, sf_dir):
    rows = _full(spark, sf_dir)
    return R.sheet_reviews(rows, _summaries(rows)).select(*R.SHEET, "improvements")


def grades_in_printed_order(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy(*R.SHEET).orderBy("question_no")
    return _g(spark, sf_dir).select(*R.ROW, F.row_number().over(w).cast("bigint").alias("place"))


def report_heading(spark, sf_dir):
    status = F.when(F.col("marks").isNull() & (F.col("question_no") % 2 == 0), "unanswered").otherwise("matched")
    h = R.report_heading(F.col("marks"), F.col("max_marks"), F.col("evaluation"), F.col("edited"), F.col("question_no").cast("string"), status)
    return _rows(spark, sf_dir).select(*R.ROW, h.alias("heading"))


def write_report_rows(spark, sf_dir):
    """The lines of every report, written in order with a folder for each student's number, and read back."""
    rows = _full(spark, sf_dir)
    folder = new_folder(spark, "reports")
    lines = R.report_rows(rows, _summaries(rows))
    lines.repartition(*R.SHEET).sortWithinPartitions(*R.SHEET, "line").write.partitionBy("student_ix").parquet(folder)
    return spark.read.schema(lines.schema).parquet(folder).select(*lines.columns)


TABS = ("answered", "unanswered", "review", "edited")


def filter_rows(spark, sf_dir):
    """The question rows under each tab, by their status."""
    rows = _full(spark, sf_dir)
    return reduce(DataFrame.unionByName, (R.filter_rows(rows, n).select(F.lit(n).alias("tab"), *R.SHEET, "q_ord") for n in TABS))


def filter_counts(spark, sf_dir):
    """How many question rows of a sheet each tab shows."""
    status = F.col("status")
    return _full(spark, sf_dir).groupBy(*R.SHEET).agg(
        F.count(F.lit(1)).alias("all_rows"), F.count_if(status == "matched").alias("answered"), F.count_if(status == "unanswered").alias("unanswered"),
        F.count_if(status == "needs_review").alias("review"), F.count_if("edited").alias("edited"),
    )


def search_rows(spark, sf_dir):
    """Over label, text, section, answer and feedback of every question row, for three needles."""
    rows = _full(spark, sf_dir)
    found = [R.search_rows(rows, n, ["label", "text", "section", "answer_text", "feedback"]).select(F.lit(n).alias("needle"), *R.SHEET, "q_ord") for n in _NEEDLES]
    return reduce(DataFrame.unionByName, found)


_NEEDLES = (" look AT step 1", "section b ", "the")


def flatten_review_edits(spark, sf_dir):
    """Edits of a paper as a map of maps, by student and question, and back to rows."""
    e = R.latest_edits(derived(spark, sf_dir, "review_edits_in"))
    own = e.groupBy("paper_id", "student_ix").agg(
        F.map_from_entries(F.collect_list(F.struct("question_no", F.struct("edit_marks", "edit_feedback").alias("edit")))).alias("edits")
    )
    nested = own.groupBy("paper_id").agg(F.map_from_entries(F.collect_list(F.struct("student_ix", "edits"))).alias("students"))
    flat = nested.select("paper_id", F.explode("students").alias("student_ix", "edits")).select("paper_id", "student_ix", F.explode("edits").alias("question_no", "edit"))
    return flat.select(*R.ROW, "edit.edit_marks", "edit.edit_feedback", (F.col("edit.edit_marks").isNotNull() | F.col("edit.edit_feedback").isNotNull()).alias("has_edit"))


def publish_still_valid(spark, sf_dir):
    """Per paper whether its last publication holds, as the stream of events has left it."""
    folder, events = _arriving(spark, sf_dir)
    return S.follow_publications(events, f"{folder}/valid", f"{folder}/checkpoint").current(spark).select("paper_id", "valid", "publish_seq")


def publish_record(spark, sf_dir):
    """Per paper the students that are ready, and whether any teacher's edit is in force on it."""
    ready = ready_students(spark, sf_dir).groupBy("paper_id").agg(F.array_sort(F.collect_list("student_ix")).alias("student_ids"))
    edited = _rows(spark, sf_dir).groupBy("paper_id").agg(F.bool_or("edited").alias("includes_teacher_edits"))
    none = F.array().cast("array<bigint>")
    return edited.join(ready, "paper_id", "left").select("paper_id", F.coalesce("student_ids", none).alias("student_ids"), "includes_teacher_edits")


def ready_students(spark, sf_dir):
    return _ready(_g(spark, sf_dir))


def _ready(grades):
    s = grades.groupBy(*R.SHEET).agg(F.count(F.lit(1)).alias("n"))
    failed = F.when((F.col("paper_id") + F.col("student_ix")) % 7 == 0, "NO_ANSWERS")
    return s.withColumn("error", failed).where("error IS NULL").select(*R.SHEET)


def write_published_snapshot(spark, sf_dir):
    """Every publication of every paper: the grades of its ready students as they were in force when it was published,
    written as versions beside each other and read back, with what the manifest says of the last. Events and grades are derived
    once each; of the grades only those of published papers are dealt."""
    events = settle(derived(spark, sf_dir, "review_edits_in"))
    published = settle(versions(events))
    grades = settle(_base(spark, sf_dir).join(published.select("paper_id").distinct(), "paper_id", "left_semi"))
    ready = grades.join(_ready(grades), R.SHEET, "left_semi")
    store = Publications(new_folder(spark, "publications"))
    store.write(frozen(ready, events, published), published, 0)
    last = store.manifest.current(spark).select("paper_id", "version", "valid")
    rows = store.read(spark).join(last, ["paper_id", "version"], "left")
    return rows.select(*R.ROW, "publish_seq", "version", "marks", "evaluation", F.coalesce("valid", F.lit(False)).alias("valid"))


def _reply_parts():
    """Pieces of a grader's reply: columns, and literals between them. A row for a question that was not asked, one that a
    later row takes back, and the one that counts: marks as text, confidence on either scale."""
    n = F.col("question_no")
    q = n.cast("string")
    m = F.when(n % 2 == 0, F.col("marks") * 2).otherwise(F.col("marks")).cast("int").cast("string")
    c = F.when(n % 2 == 0, F.lit("85")).otherwise(F.lit("0.4"))
    e = F.when(F.col("evaluation") == "incorrect", "Not Attempted").otherwise(F.upper("evaluation"))
    top = F.when(n % 3 == 1, F.lit(',"maxMarks":60')).when(n % 3 == 2, F.lit(',"maxMarks":"0"')).otherwise(F.lit(""))
    said = F.when(n % 2 == 1, F.concat(F.lit(',"feedback":" Look at line '), q, F.lit(' "'))).otherwise(F.lit(""))
    held = F.when(n % 5 == 0, F.lit(',"requiresReview":true')).otherwise(F.lit(""))
    return (
        '{"grades":[{"questionId":99,"marksObtained":1},{"questionId":', q, ',"marksObtained":0,"evaluation":"correct"},{"questionId":', q,
        ',"marksObtained":"', m, '"', top, said, held, ',"confidence":', c, ',"evaluation":"', e, '"}]}',
    )


def _replies(grades):
    parts = [F.lit(x) if isinstance(x, str) else x for x in _reply_parts()]
    return grades.select(*R.ROW, F.concat(F.lit("```json\n"), *parts, F.lit("\n``` as asked")).alias("reply"))


def repair_json_payload(spark, sf_dir):
    return _replies(_g(spark, sf_dir)).select(*R.ROW, P.repair_json(F.col("reply")).alias("payload"))


def grade_rows(spark, sf_dir):
    """Grades read from replies, each of which was asked about one question."""
    return _read_back(settle(_g(spark, sf_dir)))


def _read_back(grades):
    """``grades`` (settled) as read from their replies. These are dealt by their number: a task that reads files takes rows by their
    bytes, of which a reply's are few and its work is much."""
    targets = grades.select(*R.ROW, "printed_marks", F.col("requires_review").alias("needs_review"))
    replies = _replies(R.deal(grades, grades.count(), R.ROW)).withColumnRenamed("question_no", "asked")
    return P2.grade_rows(replies, R.SHEET, targets, ["asked"])


def coerce_fields(spark, sf_dir):
    """Fields of the events written as replies write them: numbers as text or numbers, flags as text, bare and wrapped rows."""
    n = F.col("event_id")
    k = F.get_json_object("props", "$.k")
    quoted = F.concat(F.lit('"'), k, F.lit('"'))
    value = F.when(n % 4 == 0, quoted).when(n % 4 == 1, F.concat(k, F.lit(".5"))).when(n % 4 == 2, k).otherwise(F.lit("true"))
    flag = F.when(F.col("event_type") == "click", F.lit('"TRUE"')).when(F.col("event_type") == "view", F.lit("true")).otherwise(F.lit('" true "'))
    row = F.concat(F.lit('{"k":'), value, F.lit(',"flag":'), flag, F.lit("}"))
    lead = F.when(n % 3 == 0, row).when(n % 3 == 1, F.concat(F.lit('{"note":"[x]","rows":['), row, F.lit("]}"))).otherwise(F.concat(F.lit("["), row, F.lit(",7]")))
    p = derived(spark, sf_dir, "events").select("event_id", lead.alias("t")).withColumn("v", P.parsed(F.col("t")))
    rows = P.as_array(F.col("v"), F.col("t"))
    p = p.select("event_id", F.size(rows).alias("n_rows"), F.coalesce(F.get(rows, F.lit(0)), F.col("v")).alias("r"))
    p, f = P.read_fields(p, "r", ["k", "flag"])
    k, flag = f["k"], f["flag"]
    return p.select("event_id", "n_rows", P.as_string(k).alias("text"), P.as_number(k).alias("number"), P.as_confidence(k, 0.5).alias("confidence"), P.as_boolean(flag).alias("flag"))


def to_evaluation(spark, sf_dir):
    e = F.when(F.col("marks") % 5 == 0, "Not  attempted").when(F.col("marks") % 5 == 1, "wrong").otherwise(F.upper("evaluation"))
    return _g(spark, sf_dir).select(*R.ROW, R.to_evaluation(e).alias("evaluation"))


def merge_grades(spark, sf_dir):
    g = settle(_g(spark, sf_dir))  # read by three sides
    q = g.select(*R.ROW, F.col("printed_marks").cast("double").alias("printed_marks"), (F.col("question_no") % 4 != 0).alias("attempted"), F.col("requires_review").alias("needs_review"))
    replied = _read_back(g).where("question_no % 3 <> 0")  # the others were never answered
    r = replied.select(
        *R.ROW, F.col("marks").alias("reply_marks"), F.col("max_marks").alias("reply_max"), F.col("evaluation").alias("reply_evaluation"),
        F.col("confidence").alias("reply_confidence"), F.col("requires_review").alias("reply_review"),
    )
    return R.merge_grades(q, r)


def assessment_rows(spark, sf_dir):
    """Question rows of every sheet, texts as digests."""
    rows = _full(spark, sf_dir)
    return rows.withColumns({"text": F.md5("text"), "answer_text": F.md5("answer_text")})


QUERIES = {
    f.__name__: f
    for f in (
        latest_review_edits, edit_overlay, grade_summary, grade_band, verdict_tallies, class_rollup, strengths_top4, improvements_top4,
        grades_in_printed_order, report_heading, write_report_rows, filter_rows, filter_counts, search_rows, flatten_review_edits,
        publish_still_valid, publish_record, ready_students, write_published_snapshot, repair_json_payload, grade_rows, coerce_fields,
        to_evaluation, merge_grades, assessment_rows,
    )
}



def _in_force(source: str, name: str, keys: str) -> str:
    """CTEs that end in ``name``: the grade that counts of rows with an original grade, printed_marks, edit_marks and edit_feedback."""
    return f"""{name}0 AS (SELECT *, edit_marks IS NOT NULL OR edit_feedback IS NOT NULL AS edited, coalesce(max_marks, printed_marks, 1)::DOUBLE AS mx FROM {source}),
{name}1 AS (SELECT *, CASE WHEN edit_marks IS NOT NULL THEN least(mx, greatest(0, edit_marks)) ELSE coalesce(marks, 0) END AS em FROM {name}0),
{name} AS (SELECT {keys}, marks AS original_marks, CASE WHEN edited THEN mx ELSE max_marks END AS max_marks, CASE WHEN edited THEN em ELSE marks END AS marks,
    CASE WHEN NOT edited THEN evaluation WHEN em >= mx THEN 'correct' WHEN em > 0 THEN 'partial'
      WHEN coalesce(evaluation, 'incorrect') = 'not_attempted' THEN 'not_attempted' ELSE 'incorrect' END AS evaluation,
    CASE WHEN edited THEN coalesce(edit_feedback, feedback, '') ELSE feedback END AS feedback, CASE WHEN edited THEN 1 ELSE confidence END AS confidence,
    edited, CASE WHEN edited THEN false ELSE requires_review END AS requires_review FROM {name}1)"""


def _heading(label: str, status: str) -> str:
    number = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    return f"""'Q' || {label} || '  ·  ' || coalesce({number('marks')} || '/' || {number('max_marks')}, '—') || ' marks  ·  ' ||
    CASE evaluation WHEN 'correct' THEN 'Correct' WHEN 'partial' THEN 'Partially correct' WHEN 'incorrect' THEN 'Incorrect' WHEN 'not_attempted' THEN 'Not attempted'
      ELSE CASE WHEN {status} = 'unanswered' THEN 'Unanswered' ELSE 'Not graded' END END || CASE WHEN edited THEN '  ·  edited by teacher' ELSE '' END"""


_R = f"""{with_inputs('grades_in', 'review_edits_in')},
le AS (SELECT paper_id, student_ix, question_no, kind, marks, feedback FROM review_edits_in WHERE kind IN ('edit', 'revert')
  QUALIFY row_number() OVER (PARTITION BY paper_id, student_ix, question_no ORDER BY seq DESC) = 1),
led AS (SELECT paper_id, student_ix, question_no, marks AS edit_marks, feedback AS edit_feedback FROM le WHERE kind = 'edit'),
gb AS (SELECT paper_id, student_ix, question_no, printed_marks, CASE WHEN graded THEN marks END AS marks, CASE WHEN graded THEN max_marks END AS max_marks,
    CASE WHEN graded THEN evaluation END AS evaluation, CASE WHEN graded THEN feedback END AS feedback, CASE WHEN graded THEN confidence END AS confidence,
    CASE WHEN graded THEN requires_review END AS requires_review FROM (SELECT *, NOT (paper_id % 11 = 0 AND question_no % 3 = 0) AS graded FROM grades_in)),
j AS (SELECT gb.*, edit_marks, edit_feedback FROM gb LEFT JOIN led USING (paper_id, student_ix, question_no)),
{_in_force('j', 'r', 'paper_id, student_ix, question_no')},
s AS (SELECT paper_id, student_ix, sum(marks) AS marks_obtained, sum(max_marks) AS max_marks,
    CAST(floor(CASE WHEN sum(max_marks) > 0 THEN sum(marks) / sum(max_marks) * 100 ELSE 0 END + 0.5) AS BIGINT) AS percentage FROM r WHERE marks IS NOT NULL GROUP BY 1, 2),
v AS (SELECT paper_id, student_ix, count(*) FILTER (evaluation = 'correct') AS correct, count(*) FILTER (evaluation = 'partial') AS partial,
    count(*) FILTER (evaluation = 'incorrect') AS incorrect, count(*) FILTER (evaluation = 'not_attempted') AS not_attempted, count(*) FILTER (edited) AS edited FROM r GROUP BY 1, 2),
h AS (SELECT paper_id, student_ix, question_no, {_heading('question_no', "CASE WHEN marks IS NULL AND question_no % 2 = 0 THEN 'unanswered' END")} AS heading FROM r)"""
_K = "paper_id, student_ix, question_no"
_READY = "(SELECT DISTINCT paper_id, student_ix FROM grades_in WHERE (paper_id + student_ix) % 7 <> 0)"
_PIECES = """'{"grades":[{"questionId":99,"marksObtained":1},{"questionId":' || question_no || ',"marksObtained":0,"evaluation":"correct"},{"questionId":' || question_no
    || ',"marksObtained":"' || m || '"' || CASE question_no % 3 WHEN 1 THEN ',"maxMarks":60' WHEN 2 THEN ',"maxMarks":"0"' ELSE '' END
    || CASE WHEN question_no % 2 = 1 THEN ',"feedback":" Look at line ' || question_no || ' "' ELSE '' END || CASE WHEN question_no % 5 = 0 THEN ',"requiresReview":true' ELSE '' END
    || ',"confidence":' || c || ',"evaluation":"' || e || '"}]}'"""
_REP = f"""{with_inputs('grades_in')}, rp AS (SELECT *, CAST(CAST(CASE WHEN question_no % 2 = 0 THEN marks * 2 ELSE marks END AS INT) AS VARCHAR) AS m,
  CASE WHEN question_no % 2 = 0 THEN '85' ELSE '0.4' END AS c, CASE WHEN evaluation = 'incorrect' THEN 'Not Attempted' ELSE upper(evaluation) END AS e,
  greatest(1, CASE question_no % 3 WHEN 1 THEN 60 WHEN 2 THEN 0 ELSE coalesce(printed_marks, 1) END)::DOUBLE AS top FROM grades_in),
gr AS (SELECT paper_id, student_ix, question_no, least(top, greatest(0, CAST(m AS DOUBLE))) AS marks, top AS max_marks,
  CASE WHEN e = 'Not Attempted' THEN 'not_attempted' ELSE lower(e) END AS evaluation,
  CASE WHEN question_no % 2 = 1 THEN 'Look at line ' || question_no ELSE 'No feedback was generated.' END AS feedback,
  CASE WHEN c = '85' THEN 0.85 ELSE 0.4 END::DOUBLE AS confidence, requires_review OR question_no % 5 = 0 AS requires_review FROM rp)"""
_S = "paper_id, student_ix"
_FULL = f"""{_BASE.replace(with_inputs('questions_in', 'answers_in'), with_inputs('questions_in', 'answers_in', 'sheet_grades_in', 'sheet_edits_in'), 1)},
mp AS (SELECT * FROM final WHERE student_ix <> 2 OR q_ord % 3 <> 2),
md AS (SELECT paper_id, q_ord, 'because' AS model_answer, ['a', CAST(marks AS VARCHAR), 'c', 'd', 'e'] AS key_points FROM q WHERE marks > 2 AND q_ord % 3 <> 1),
fq AS (SELECT s.paper_id, s.student_ix, q.q_ord, q.label, q.text, q.section, q.marks AS printed_marks, mp.a_ord, coalesce(mp.confidence, 0) AS match_confidence,
    coalesce(mp.band, 'none') AS band, coalesce(mp.status, 'unanswered') AS status, coalesce(mp.methods, []) AS methods,
    coalesce(mp.reasons, ['No mapping was produced for this question.']) AS reasons, a.text AS answer_text, coalesce(list_sort(list_distinct(a.pages)), []) AS pages,
    g.marks, g.max_marks, g.evaluation, g.feedback, g.grade_confidence AS confidence, g.requires_review, md.model_answer, md.key_points, ed.edit_marks, ed.edit_feedback
  FROM sheets s JOIN q USING (paper_id) LEFT JOIN mp ON mp.paper_id = s.paper_id AND mp.student_ix = s.student_ix AND mp.q_ord = q.q_ord
    LEFT JOIN a ON a.paper_id = s.paper_id AND a.student_ix = s.student_ix AND a.a_ord = mp.a_ord
    LEFT JOIN sheet_grades_in g ON g.paper_id = s.paper_id AND g.student_ix = s.student_ix AND g.q_ord = q.q_ord
    LEFT JOIN md ON md.paper_id = s.paper_id AND md.q_ord = q.q_ord
    LEFT JOIN sheet_edits_in ed ON ed.paper_id = s.paper_id AND ed.student_ix = s.student_ix AND ed.q_ord = q.q_ord),
{_in_force('fq', 'fr', f"{_S}, q_ord, label, text, section, printed_marks, a_ord, match_confidence, band, status, methods, reasons, answer_text, pages, len(pages) > 1 AS multi_page, model_answer, key_points")},
lb AS (SELECT *, regexp_replace(label, '[.:]$', '') AS plain, regexp_replace(label, '[.:]$', '') || ' — ' || substring(text, 1, 90) AS item FROM fr),
rv AS (SELECT {_S}, coalesce(list(item ORDER BY q_ord) FILTER (evaluation = 'correct'), [])[1:4] AS strengths,
    coalesce(list(item ORDER BY q_ord) FILTER (evaluation <> 'correct'), CASE WHEN student_ix % 2 = 0 THEN ['Show the steps', 'Units'] ELSE [] END)[1:4] AS improvements FROM lb GROUP BY 1, 2)"""
_NUM = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
_REPORT = f"""{_FULL}, sc AS (SELECT {_S}, sum(marks) AS got, sum(max_marks) AS top, count(*) FILTER (evaluation = 'correct') AS c1, count(*) FILTER (evaluation = 'partial') AS c2,
    count(*) FILTER (evaluation = 'incorrect') AS c3, count(*) FILTER (evaluation = 'not_attempted') AS c4, count(*) FILTER (edited) AS c5 FROM lb GROUP BY 1, 2),
sp AS (SELECT *, CAST(floor(CASE WHEN top > 0 THEN got / top * 100 ELSE 0 END + 0.5) AS BIGINT) AS pc FROM sc),
hd AS (SELECT {_S}, list_filter(['EVALUATION REPORT', 'Student ' || (student_ix + 1), 'paper_' || paper_id || '.pdf',
    CASE WHEN got IS NULL THEN 'Automatic evaluation did not run for this student, so no marks were awarded.' ELSE {_NUM('got')} || ' / ' || {_NUM('top')} END,
    CASE WHEN got IS NOT NULL THEN pc || '%   Grade ' || CASE WHEN pc >= 90 THEN 'A+   Outstanding' WHEN pc >= 80 THEN 'A   Excellent' WHEN pc >= 70 THEN 'B   Good'
      WHEN pc >= 60 THEN 'C   Fair' WHEN pc >= 40 THEN 'D   Needs work' ELSE 'E   Needs support' END END,
    CASE WHEN got IS NOT NULL THEN 'Correct ' || c1 || '  ·  Partial ' || c2 || '  ·  Incorrect ' || c3 || '  ·  Unanswered ' || c4 END,
    CASE WHEN got IS NOT NULL AND c5 > 0 THEN c5 || CASE WHEN c5 = 1 THEN ' question' ELSE ' questions' END || ' reviewed and adjusted by the teacher.' END,
    'Question-wise evaluation'], lambda x: x IS NOT NULL) AS head FROM sp),
ql AS (SELECT {_S}, flatten(list(list_filter([{_heading('plain', 'status')}, text,
    CASE WHEN coalesce(answer_text, '') <> '' THEN 'Answer: ' || regexp_replace(answer_text, '\\n+', ' ', 'g') ELSE 'Answer: not found on the sheet.' END,
    CASE WHEN feedback <> '' THEN 'Feedback: ' || feedback END], lambda x: x IS NOT NULL) ORDER BY q_ord)) AS body FROM lb GROUP BY 1, 2),
al AS (SELECT {_S}, list_concat(list_concat(head, body), list_concat(['Strengths'], list_concat(
    CASE WHEN len(strengths) > 0 THEN list_transform(strengths, lambda x: '•  ' || x) ELSE ['No question was fully correct.'] END, list_concat(['Areas to improve'], list_concat(
    CASE WHEN len(improvements) > 0 THEN list_transform(improvements, lambda x: '•  ' || x) ELSE ['Nothing outstanding — every question scored full marks.'] END,
    CASE WHEN student_ix = 1 THEN ['Overall feedback', 'A good start.'] ELSE [] END))))) AS lines FROM hd JOIN ql USING ({_S}) JOIN rv USING ({_S}))"""
ORACLES = {
    "latest_review_edits": f"{_R} SELECT * FROM led",
    "edit_overlay": f"{_R} SELECT * FROM r",
    "grade_summary": f"{_R} SELECT * FROM s",
    "grade_band": f"""{_R} SELECT paper_id, student_ix, CASE WHEN percentage >= 90 THEN 'A+ Outstanding' WHEN percentage >= 80 THEN 'A Excellent'
  WHEN percentage >= 70 THEN 'B Good' WHEN percentage >= 60 THEN 'C Fair' WHEN percentage >= 40 THEN 'D Needs work' ELSE 'E Needs support' END AS band FROM s""",
    "verdict_tallies": f"{_R} SELECT * FROM v",
    "class_rollup": f"{_R} SELECT paper_id, student_ix, sum(marks) AS marks, count(*) AS n FROM r GROUP BY ROLLUP (paper_id, student_ix)",
    "strengths_top4": f"{_FULL} SELECT {_S}, strengths FROM rv",
    "improvements_top4": f"{_FULL} SELECT {_S}, improvements FROM rv",
    "grades_in_printed_order": f"{with_inputs('grades_in')} SELECT {_K}, row_number() OVER (PARTITION BY paper_id, student_ix ORDER BY question_no) AS place FROM grades_in",
    "report_heading": f"{_R} SELECT * FROM h",
    "write_report_rows": f"{_REPORT} SELECT {_S}, CAST(generate_subscripts(lines, 1) - 1 AS BIGINT) AS line, unnest(lines) AS text FROM al",
    "filter_rows": " UNION ALL ".join(f"SELECT '{tab}' AS tab, {_S}, q_ord FROM ({_FULL} SELECT * FROM fr) WHERE {where}" for tab, where in (
        ("answered", "status = 'matched'"), ("unanswered", "status = 'unanswered'"), ("review", "status = 'needs_review'"), ("edited", "edited"))),
    "filter_counts": f"""{_FULL} SELECT {_S}, count(*) AS all_rows, count(*) FILTER (status = 'matched') AS answered, count(*) FILTER (status = 'unanswered') AS unanswered,
  count(*) FILTER (status = 'needs_review') AS review, count(*) FILTER (edited) AS edited FROM fr GROUP BY 1, 2""",
    "search_rows": " UNION ALL ".join(
        f"SELECT {lit(n)} AS needle, {_S}, q_ord FROM ({_FULL} SELECT * FROM fr) WHERE contains(lower(concat_ws(' ', coalesce(label, ''), coalesce(text, ''), coalesce(section, ''), coalesce(answer_text, ''), coalesce(feedback, ''))), {lit(n.strip().lower())})"
        for n in _NEEDLES
    ),
    "flatten_review_edits": f"{_R} SELECT *, edit_marks IS NOT NULL OR edit_feedback IS NOT NULL AS has_edit FROM led",
    "publish_still_valid": f"""{_R}, p AS (SELECT paper_id, max(seq) FILTER (kind = 'publish') AS p, max(seq) FILTER (kind <> 'publish') AS e FROM review_edits_in GROUP BY 1)
SELECT paper_id, coalesce(e, -1) < p AS valid, p AS publish_seq FROM p WHERE p IS NOT NULL""",
    "publish_record": f"""{_R}, rs AS (SELECT paper_id, list(student_ix ORDER BY student_ix) AS student_ids FROM {_READY} AS x GROUP BY 1)
SELECT paper_id, coalesce(student_ids, []) AS student_ids, includes_teacher_edits FROM (SELECT paper_id, bool_or(edited) AS includes_teacher_edits FROM r GROUP BY 1) LEFT JOIN rs USING (paper_id)""",
    "ready_students": f"{with_inputs('grades_in')} SELECT * FROM {_READY} AS x",
    "write_published_snapshot": f"""{_R}, pv AS (SELECT paper_id, seq AS publish_seq, CAST(row_number() OVER (PARTITION BY paper_id ORDER BY seq) AS INT) AS version,
    seq = (SELECT max(seq) FROM review_edits_in x WHERE x.paper_id = e.paper_id) AS valid FROM review_edits_in e WHERE kind = 'publish'),
pe AS (SELECT {_K}, publish_seq, version, valid, kind, ed.marks AS m, ed.feedback AS f FROM gb JOIN pv USING (paper_id) SEMI JOIN {_READY} AS x USING (paper_id, student_ix)
  LEFT JOIN (SELECT * FROM review_edits_in WHERE kind IN ('edit', 'revert')) AS ed USING (paper_id, student_ix, question_no) WHERE ed.seq IS NULL OR ed.seq < publish_seq
  QUALIFY row_number() OVER (PARTITION BY {_K}, publish_seq ORDER BY ed.seq DESC) = 1),
pk AS (SELECT {_K}, publish_seq, version, valid FROM gb JOIN pv USING (paper_id) SEMI JOIN {_READY} AS x USING (paper_id, student_ix)),
pj AS (SELECT gb.*, pk.publish_seq, pk.version, pk.valid, CASE WHEN kind = 'edit' THEN m END AS edit_marks, CASE WHEN kind = 'edit' THEN f END AS edit_feedback
  FROM pk JOIN gb USING (paper_id, student_ix, question_no) LEFT JOIN pe USING (paper_id, student_ix, question_no, publish_seq)),
{_in_force('pj', 'pf', f'{_K}, publish_seq, version, valid')}
SELECT {_K}, publish_seq, version, marks, evaluation, valid FROM pf""",
    "repair_json_payload": f"{_REP} SELECT {_K}, {_PIECES} AS payload FROM rp",
    "grade_rows": f"{_REP} SELECT * FROM gr",
    "coerce_fields": f"""{with_inputs('events_k')}, n AS (SELECT *, CASE event_id % 4 WHEN 1 THEN k + 0.5 WHEN 3 THEN NULL ELSE k END AS n FROM events_k)
SELECT event_id, CAST(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS INT) AS n_rows, CASE event_id % 4 WHEN 3 THEN 'true' WHEN 1 THEN CAST(k AS VARCHAR) || '.5' ELSE CAST(k AS VARCHAR) END AS text,
  CAST(n AS DOUBLE) AS number, greatest(0, least(1, CASE WHEN n > 1 THEN n / 100.0 ELSE coalesce(n, 0.5) END))::DOUBLE AS confidence, event_type IN ('click', 'view') AS flag FROM n""",
    "to_evaluation": f"""{with_inputs('grades_in')} SELECT {_K}, CASE WHEN marks % 5 = 0 THEN 'not_attempted' WHEN marks % 5 = 1 THEN 'partial' ELSE evaluation END AS evaluation FROM grades_in""",
    "merge_grades": f"""{_REP}, qs AS (SELECT {_K}, printed_marks, question_no % 4 <> 0 AS att, requires_review AS nr FROM grades_in), rr AS (SELECT * FROM gr WHERE question_no % 3 <> 0)
SELECT {_K}, CASE WHEN att AND rr.marks IS NOT NULL THEN rr.marks ELSE 0 END AS marks, CASE WHEN att AND rr.marks IS NOT NULL THEN rr.max_marks ELSE coalesce(printed_marks, 1) END::DOUBLE AS max_marks,
  CASE WHEN NOT att THEN 'not_attempted' ELSE coalesce(rr.evaluation, 'partial') END AS evaluation, CASE WHEN NOT att THEN 1 ELSE coalesce(rr.confidence, 0) END::DOUBLE AS confidence,
  att AND (rr.marks IS NULL OR nr OR rr.requires_review) AS requires_review FROM qs LEFT JOIN rr USING (paper_id, student_ix, question_no)""",
    "assessment_rows": f"{_FULL} SELECT * REPLACE (md5(text) AS text, md5(answer_text) AS answer_text) FROM fr",
}
