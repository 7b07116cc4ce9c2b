"""Queries over replies, saved results and page images, and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from markloom.functions.payload import json_piece
from markloom.operators import extraction as X
from markloom.operators import layout as Y
from markloom.operators import replies as P
from markloom.plans.extraction_queries import order_sql
from markloom.plans.label_queries import sql_labels, sql_leading, sql_strip_marks
from markloom.sources.inputs import derived, with_inputs
from markloom.sources.shared import shared_folder
from markloom.streaming import progress as S


def _replies(df, keys, field, row):
    """One reply per key: fenced JSON with a row per question, and prose after it."""
    body = F.to_json(F.struct(F.array_sort(F.collect_list(row)).alias(field)))
    return df.groupBy(*keys).agg(F.concat(F.lit("```json\n"), body, F.lit("\n```\nThat is all.")).alias("reply"))


def suggested_match_rows(spark, sf_dir):
    a = derived(spark, sf_dir, "answers_in")
    row = F.struct(
        F.col("ord").cast("string").alias("answerId"), F.col("ord").cast("string").alias("questionId"),
        F.when(F.col("ord") % 2 == 0, F.lit("90")).alias("confidence"), F.when(F.col("ord") % 3 == 0, F.lit(" alike ")).alias("reason"),
    )
    return P.suggested_matches(_replies(a, ["paper_id", "student_ix"], "matches", row), ["paper_id", "student_ix"]).drop("seq")


def model_answer_rows(spark, sf_dir):
    q = derived(spark, sf_dir, "questions_in")
    points = F.array(F.lit(" a "), F.lit(" "), F.col("marks").cast("string"), F.lit("c"), F.lit("d"), F.lit("e"), F.lit("f"))
    row = F.struct(F.col("ord").cast("string").alias("questionId"), F.when(F.col("ord") % 3 == 1, F.lit("  ")).otherwise(F.lit(" because ")).alias("answer"), points.alias("keyPoints"))
    targets = q.where("marks > 2").select("paper_id", F.col("ord").alias("q_ord"))
    return P.model_answers(_replies(q, ["paper_id"], "answers", row), ["paper_id"], targets)


def _lines(spark, sf_dir):
    lines = X.reading_order(derived(spark, sf_dir, "lines_in"), X.LINE_TOLERANCE, "line_no")
    return lines.select("doc_id", F.col("pos").alias("line_no"), "text")


def _structure(spark, sf_dir):
    """Replies that name a question at every sixth line of a document, by turns one that is known and one that is not: with its
    lines as numbers or text, ends that are missing, before the start or past the last line, and labels no one can read."""
    m = F.floor(F.col("line_no") / 6)
    t = lambda c: c.cast("string")
    label = F.when(m % 11 == 5, "none").when(m % 2 == 0, F.concat(F.lit("Q"), t(F.floor(m / 2) % 300 + 1))).otherwise(F.concat(F.lit("Q "), t(500 + m % 400), F.lit(" (a")))
    row = F.struct(
        F.col("line_no").alias("n"), label.alias("label"), F.when(m % 5 == 4, "-1").otherwise(t(F.col("line_no"))).alias("startLine"),
        F.when(m % 4 != 1, F.col("line_no") + m % 7 - 1).alias("endLine"), t(m % 3).alias("marks"), F.when(m % 4 < 2, " Section R ").otherwise("").alias("section"),
    )
    lines = _lines(spark, sf_dir)
    return lines, P.structure_rows(_replies(lines.where("line_no % 6 = 0"), ["doc_id"], "questions", row), ["doc_id"])


def structure_rows(spark, sf_dir):
    return _structure(spark, sf_dir)[1]


def merge_structure_rows(spark, sf_dir):
    """Drafts are every twelfth line of a document, numbered; texts as digests."""
    lines, rows = _structure(spark, sf_dir)
    m = F.floor(F.col("line_no") / 12)
    drafts = lines.where("line_no % 12 = 0 AND line_no < 3600").select(
        "doc_id", (m + 1).cast("string").alias("normalized"), F.when(m % 2 == 1, F.lit(7)).cast("bigint").alias("marks"), F.when(m % 3 == 1, F.lit("Section Z")).alias("section"), "text"
    )
    return P.merge_structure(drafts, rows, lines, ["doc_id"]).withColumn("text", F.md5("text"))


def json_scan(spark, sf_dir):
    """The event's properties found again inside prose: behind a remark in brackets, with brackets in quotes."""
    e = derived(spark, sf_dir, "events")
    lead = F.when(F.col("event_id") % 2 == 0, "reply: ").otherwise("see [note 1]: ")
    text = F.concat(lead, "props", F.lit(' and "}" more {x'))
    return e.select("event_id", json_piece(text).alias("payload"))


def scan_assessment_json(spark, sf_dir):
    """Saved results, one nested document per paper, read with a fixed schema and laid out as rows."""
    g = derived(spark, sf_dir, "grades_in")
    nested = g.groupBy("paper_id").agg(F.collect_list(F.struct("student_ix", "question_no", "marks", "evaluation")).alias("grades"))
    folder = f"{_folder(spark)}/results-{uuid.uuid4().hex}"
    nested.select(F.to_json(F.struct("paper_id", "grades")).alias("value")).write.text(folder)
    schema = "paper_id bigint, grades array<struct<student_ix:bigint,question_no:bigint,marks:double,evaluation:string>>"
    return spark.read.schema(schema).json(folder).select("paper_id", F.inline("grades"))


def _folder(spark):
    return shared_folder(spark)


def scan_progress_frames(spark, sf_dir):
    """Progress frames written as JSON lines and read back; lines that cannot be read are left out."""
    folder = f"{_folder(spark)}/frames-{uuid.uuid4().hex}"
    S.write_frames(derived(spark, sf_dir, "stage_events_in"), folder)
    return S.read_frames(spark, folder, stream=False).select("job_id", "stage", "state", "event_id")


PAGE = ("doc_id", "page")
IMAGES = 8 << 20  # bytes of the images that leave a task at a time, about


def _pages(spark, sf_dir, rule=False):
    """Page images drawn from the ink rows of each page: white paper, dark strokes of alternating pixels; with ``rule`` a ruled
    line as well."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heights, grays, size = [], [], 0
            for i in range(batch.num_rows):
                y, x0, x1 = (v.to_numpy() for v in batch.column(2)[i].values.flatten())
                height = max(120, int(y.max()) + 20)
                gray = np.full((height, 200), 245, np.uint8)
                strokes = (x1 - x0) // 2 + 1
                place = np.arange(strokes.sum()) - np.repeat(np.cumsum(strokes) - strokes, strokes)
                gray[np.repeat(y, strokes), np.repeat(x0, strokes) + 2 * place] = 20
                if rule:
                    gray[height - 6 : height - 3, 5:195] = 20
                heights.append(height)
                grays.append(gray.tobytes())
                size += gray.size
                if size > IMAGES or i + 1 == batch.num_rows:
                    own = [batch.column(k).slice(i + 1 - len(grays), len(grays)) for k in range(2)]
                    sizes = [pa.array([200] * len(grays), pa.int32()), pa.array(heights, pa.int32())]
                    yield pa.RecordBatch.from_arrays([*own, *sizes, pa.array(grays, pa.binary())], [*PAGE, "width", "height", "gray"])
                    heights, grays, size = [], [], 0

    ink = derived(spark, sf_dir, "ink_in").groupBy(*PAGE).agg(F.collect_list(F.struct("y", "x0", "x1")).alias("ink"))
    return Y.arrow_pages(ink, draw, "doc_id long, page long, width int, height int, gray binary")


def ink_mask(spark, sf_dir):
    return Y.ink_runs(_pages(spark, sf_dir), PAGE)


def suppress_rules(spark, sf_dir):
    """The runs of ink that are ruled lines: what the mask has and the mask without rules has not."""
    return Y.rule_runs(_pages(spark, sf_dir, rule=True), PAGE)


def segment_pages(spark, sf_dir):
    return Y.segment_pages(_pages(spark, sf_dir), 200, keys=PAGE)


QUERIES = {
    f.__name__: f
    for f in (
        suggested_match_rows, model_answer_rows, structure_rows, merge_structure_rows, json_scan, scan_assessment_json,
        scan_progress_frames, ink_mask, suppress_rules, segment_pages,
    )
}

_Q = with_inputs("questions_in")
_ST = f"""{with_inputs('lines_in')}, lines AS (SELECT doc_id, pos AS line_no, text FROM {order_sql('lines_in', 'line_no', X.LINE_TOLERANCE)}),
sr AS (SELECT doc_id, line_no, line_no // 6 AS m, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS seq FROM lines WHERE line_no % 6 = 0),
sn AS (SELECT *, CASE WHEN m % 11 = 5 THEN 'none' WHEN m % 2 = 0 THEN 'Q' || (m // 2 % 300 + 1) ELSE 'Q ' || (500 + m % 400) || ' (a' END AS label, CASE WHEN m % 5 = 4 THEN -1 ELSE line_no END AS start_line FROM sr),
{sql_labels('sn', 'label', 'doc_id, seq, m, line_no, label, start_line', 'sl')},
rows_in AS (SELECT doc_id, seq, label, normalized, start_line, CASE WHEN m % 4 = 1 THEN start_line ELSE line_no + m % 7 - 1 END AS end_line, nullif(m % 3, 0) AS reply_marks,
  CASE WHEN m % 4 < 2 THEN 'Section R' END AS reply_section FROM sl WHERE normalized <> '')"""
ORACLES = {
    "suggested_match_rows": f"""{with_inputs('answers_in')} SELECT paper_id, student_ix, ord AS q_ord, ord AS a_ord, CASE WHEN ord % 2 = 0 THEN 0.78 ELSE 0.5 END::DOUBLE AS confidence,
  CASE WHEN ord % 3 = 0 THEN 'alike' ELSE 'Matched by AI reasoning over the answer''s content.' END AS reason FROM answers_in""",
    "model_answer_rows": f"{_Q} SELECT paper_id, ord AS q_ord, 'because' AS answer, ['a', CAST(marks AS VARCHAR), 'c', 'd', 'e'] AS key_points FROM questions_in WHERE marks > 2 AND ord % 3 <> 1",
    "structure_rows": f"{_ST} SELECT * FROM rows_in",
    "merge_structure_rows": f"""{_ST}, drafts AS (SELECT doc_id, CAST(line_no // 12 + 1 AS VARCHAR) AS normalized, CASE WHEN line_no // 12 % 2 = 1 THEN 7 END AS marks,
    CASE WHEN line_no // 12 % 3 = 1 THEN 'Section Z' END AS section, text FROM lines WHERE line_no % 12 = 0 AND line_no < 3600),
said AS (SELECT doc_id, normalized, arg_min(reply_marks, seq) FILTER (reply_marks IS NOT NULL) AS m, arg_min(reply_section, seq) FILTER (reply_section IS NOT NULL) AS s
  FROM rows_in SEMI JOIN drafts USING (doc_id, normalized) GROUP BY 1, 2),
size AS (SELECT doc_id, max(line_no) + 1 AS n FROM lines GROUP BY 1),
fresh AS (SELECT *, least(n - 1, greatest(start_line, end_line)) AS stop FROM rows_in JOIN size USING (doc_id) ANTI JOIN drafts USING (doc_id, normalized)),
bodies AS (SELECT f.doc_id, f.seq, string_agg(trim(l.text), ' ' ORDER BY l.line_no) AS body FROM fresh f JOIN lines l ON l.doc_id = f.doc_id AND l.line_no BETWEEN f.start_line AND f.stop
  WHERE f.start_line >= 0 AND f.start_line < f.n GROUP BY 1, 2),
{sql_leading('bodies', 'body', 'doc_id, seq, body', 'bl')},
bt AS (SELECT doc_id, seq, {sql_strip_marks("CASE WHEN rest <> '' THEN rest ELSE body END")} AS text FROM bl),
op AS (SELECT doc_id, f.normalized, min(seq) AS o, arg_min(bt.text, seq) AS text FROM fresh f JOIN bt USING (doc_id, seq) WHERE length(bt.text) >= 3 GROUP BY 1, 2),
added AS (SELECT f.doc_id, f.normalized, arg_min(reply_marks, seq) FILTER (reply_marks IS NOT NULL) AS marks, arg_min(reply_section, seq) FILTER (reply_section IS NOT NULL) AS section, any_value(op.text) AS text
  FROM fresh f JOIN op USING (doc_id, normalized) WHERE seq >= o GROUP BY 1, 2)
SELECT doc_id, normalized, coalesce(marks, m) AS marks, coalesce(section, s) AS section, md5(text) AS text FROM drafts LEFT JOIN said USING (doc_id, normalized)
UNION ALL SELECT doc_id, normalized, marks, section, md5(text) FROM added""",
    "json_scan": "SELECT event_id, props AS payload FROM events",
    "scan_assessment_json": f"{with_inputs('grades_in')} SELECT paper_id, student_ix, question_no, marks, evaluation FROM grades_in",
    "scan_progress_frames": f"{with_inputs('stage_events_in')} SELECT job_id, stage, state, event_id FROM stage_events_in",
}
