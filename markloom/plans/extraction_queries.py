"""Queries over extraction, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import text as T
from markloom.operators import extraction as X
from markloom.plans.label_queries import lit, sql_leading, sql_labels, sql_marks, sql_strip_marks
from markloom.sources.inputs import derived, with_inputs


def _ordered(spark, sf_dir):
    return X.reading_order(derived(spark, sf_dir, "lines_in"), X.LINE_TOLERANCE, "line_no")


def _marked(spark, sf_dir):
    return X.with_question_starts(X.question_lines(derived(spark, sf_dir, "lines_in")))


def _questions(spark, sf_dir):
    return X.assemble_questions(_marked(spark, sf_dir))


def _islands(spark, sf_dir):
    return X.answer_islands(derived(spark, sf_dir, "blocks_in"))


def reading_order(spark, sf_dir):
    return _ordered(spark, sf_dir).select("doc_id", "line_no", "band", "pos")


def question_islands(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", "pos", "starts", "island")


def section_fill_down(spark, sf_dir):
    return _marked(spark, sf_dir).select("doc_id", "pos", "section")


def assemble_questions(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", "ord", "label", "normalized", "text", "marks", "section", "page_number", *(F.round(c, 6).alias(c) for c in ("x", "y", "right", "bottom")))


def printed_order_and_ids(spark, sf_dir):
    return _questions(spark, sf_dir).select("doc_id", "ord", "question_id")


def sequence_looks_complete(spark, sf_dir):
    return X.sequence_looks_complete(_questions(spark, sf_dir))


def _parts(spark, sf_dir):
    """Questions with sub-parts: every second label gets one."""
    q = derived(spark, sf_dir, "questions_in")
    n = F.concat((1 + F.floor(F.col("ord") / 2)).cast("string"), F.when(F.col("ord") % 2 == 1, "a").otherwise(""))
    return q.select(F.col("paper_id").alias("doc_id"), "ord", F.concat(F.lit("q_"), n).alias("question_id"), n.alias("normalized"))


def parent_and_siblings(spark, sf_dir):
    return X.parents_and_siblings(_parts(spark, sf_dir))


def subpart_counts(spark, sf_dir):
    p = X.parents_and_siblings(_parts(spark, sf_dir)).where("parent_id IS NOT NULL")
    return p.groupBy("doc_id", "parent_id").agg(F.count(F.lit(1)).alias("n_parts"))


def usable_blocks(spark, sf_dir):
    return X.usable_blocks(derived(spark, sf_dir, "blocks_in")).select("doc_id", "block_no")


def answer_islands(spark, sf_dir):
    return _islands(spark, sf_dir).select("doc_id", "pos", "island")


def assemble_answers(spark, sf_dir):
    return X.assemble_answers(_islands(spark, sf_dir))


def low_confidence_answers(spark, sf_dir):
    a = X.assemble_answers(_islands(spark, sf_dir))
    return a.groupBy("doc_id").agg(F.count_if((F.col("confidence") > 0) & (F.col("confidence") < X.UNSURE)).alias("n_low"))


def sheet_warnings(spark, sf_dir):
    """Sheets of documents: 30 lines a page, of which 12 pages are kept; a page without text is blank; unlabelled answers need
    review."""
    b = derived(spark, sf_dir, "blocks_in")
    answers = X.assemble_answers(_islands(spark, sf_dir))
    pages = b.groupBy("doc_id", "page_number").agg(F.bool_and(F.trim("text") == "").alias("blank"))
    reviews = answers.where("normalized IS NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_review"))
    return X.sheet_warnings(b, answers, pages, reviews, 12)


def apportion_inline_split(spark, sf_dir):
    """Lines of all documents in reading order, those with several questions cut, each part with its box."""
    parts = X.question_lines(derived(spark, sf_dir, "lines_in"))
    return parts.select("doc_id", "line_no", "part_no", "pos", F.round("x", 9).alias("x"), F.round("width", 9).alias("width"), F.md5("text").alias("text_md5"))


def answer_pages(spark, sf_dir):
    return X.assemble_answers(_islands(spark, sf_dir)).select("doc_id", "island", "pages", (F.size("pages") > 1).alias("multi_page"))


QUERIES = {
    f.__name__: f
    for f in (
        reading_order, question_islands, section_fill_down, assemble_questions, printed_order_and_ids, sequence_looks_complete,
        parent_and_siblings, subpart_counts, usable_blocks, answer_islands, assemble_answers, low_confidence_answers, sheet_warnings,
        apportion_inline_split, answer_pages,
    )
}


def order_sql(source: str, number: str, tolerance: float) -> str:
    return f"""(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, band, x, {number}) - 1 AS pos FROM (
  SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, {number} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM (
  SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, {number}) > {tolerance}::DOUBLE THEN 1 ELSE 0 END AS st FROM {source}) AS a) AS b)"""


_SEC = f"regexp_extract(trim(text), {lit(T.SECTION)}, %d)"
_LINE = "doc_id, pos, page_number, text, x, y, width, height"
#: Lines cut where a further question starts: a mark is set before every token, and pieces whose text before has not ended are put together again.
def parts_sql(source: str, text: str = "text") -> str:
    """CTEs that end in pn: the parts of the ``text`` of ``source``'s lines (doc_id, line_no), numbered, with their number and shares."""
    return f"""pc AS (SELECT doc_id, line_no, string_split(regexp_replace(trim({text}), {lit(rf'(\s)({T.INLINE})')}, '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS pieces FROM {source}),
pu AS (SELECT doc_id, line_no, pieces, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS i FROM pc),
pv AS (SELECT *, CASE WHEN i > 1 AND regexp_matches(regexp_replace(regexp_replace(array_to_string(pieces[1:i - 1], ''), {lit(T.NOTE)}, ''), '\\s+$', ''), '[.?!\\])]$') THEN 1 ELSE 0 END AS st FROM pu),
pg AS (SELECT *, sum(st) OVER (PARTITION BY doc_id, line_no ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM pv),
pp AS (SELECT doc_id, line_no, g, trim(string_agg(piece, '' ORDER BY i)) AS part FROM pg GROUP BY 1, 2, 3),
pn AS (SELECT doc_id, line_no, part, row_number() OVER (PARTITION BY doc_id, line_no ORDER BY g) - 1 AS part_no, count(*) OVER (PARTITION BY doc_id, line_no) AS n,
  (sum(length(part)) OVER (PARTITION BY doc_id, line_no ORDER BY g ROWS UNBOUNDED PRECEDING) - length(part)) / sum(length(part)) OVER (PARTITION BY doc_id, line_no) AS s0,
  sum(length(part)) OVER (PARTITION BY doc_id, line_no ORDER BY g ROWS UNBOUNDED PRECEDING) / sum(length(part)) OVER (PARTITION BY doc_id, line_no) AS s1 FROM pp WHERE part <> '')"""


PARTS_SQL = f"""bd AS (SELECT *, CAST(sum(st) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS band FROM (
  SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, line_no) > {X.LINE_TOLERANCE}::DOUBLE THEN 1 ELSE 0 END AS st FROM lines_in) AS a),
{parts_sql("bd")},
ol AS (SELECT doc_id, page_number, band, CASE WHEN n > 1 THEN line_no * 100 + part_no ELSE line_no END AS line_no, CAST(CASE WHEN n > 1 THEN part_no ELSE 0 END AS INT) AS part_no,
    CASE WHEN n > 1 THEN part ELSE text END AS text, CASE WHEN n > 1 THEN x + width * s0 ELSE x END AS x, y, CASE WHEN n > 1 THEN width * (s1 - s0) ELSE width END AS width, height,
    row_number() OVER (PARTITION BY doc_id ORDER BY page_number, band, bd.x, bd.line_no, part_no) - 1 AS pos
  FROM bd LEFT JOIN (SELECT * FROM pn WHERE n > 1) AS pn USING (doc_id, line_no))"""
_Q = f"""{with_inputs('lines_in')}, {PARTS_SQL},
{sql_leading('ol', 'text', _LINE, 'll')},
lm AS (SELECT *, {_SEC.replace('%d', '1')} AS sw, {_SEC.replace('%d', '2')} AS sc, trim({_SEC.replace('%d', '3')}) AS sr,
  regexp_matches(trim(text), {lit(T.FURNITURE)}) AS furniture, {sql_marks('text')} AS marks FROM ll),
ln AS (SELECT *, normalized <> '' AND NOT furniture AND NOT (sw <> '' AND sr = '') AS may,
  CASE WHEN sw <> '' AND length(sr) < 60 THEN upper(sw[1]) || lower(sw[2:]) || ' ' || upper(sc) END AS s0 FROM lm),
lo AS (SELECT *, may AND length(rest) >= 3 AS alone FROM ln),
lp AS (SELECT *, may AND (alone OR coalesce(bool_or(alone) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)) AS starts FROM lo),
qi AS (SELECT *, last_value(s0 IGNORE NULLS) OVER w AS section, CAST(sum(CAST(starts AS INT)) OVER w AS BIGINT) AS island FROM lp
  WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
qp AS (SELECT *, CASE WHEN starts THEN {sql_strip_marks('rest')} WHEN NOT (furniture OR (sw <> '' AND sr = '') OR trim(text) = '') THEN {sql_strip_marks('text')} END AS part,
  page_number = first_value(page_number) OVER (PARTITION BY doc_id, island ORDER BY pos) AS here FROM qi WHERE island > 0),
qa AS (SELECT doc_id, island, arg_min(label, pos) AS label, arg_min(normalized, pos) AS normalized, arg_min_null(section, pos) AS section, arg_min(page_number, pos) AS page_number,
  trim(regexp_replace(string_agg(part, ' ' ORDER BY pos), '\\s{{2,}}', ' ', 'g')) AS text, arg_min(marks, pos) FILTER (NOT furniture AND marks IS NOT NULL) AS marks,
  min(x) FILTER (here) AS x, min(y) FILTER (here) AS y, max(x + width) FILTER (here) AS "right", max(y + height) FILTER (here) AS bottom, min(pos) AS start FROM qp GROUP BY 1, 2),
qq AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS ord, row_number() OVER (PARTITION BY doc_id, normalized ORDER BY start) AS rep FROM qa WHERE length(text) >= 3)"""
_B = f"""{with_inputs('blocks_in')}, ub AS (SELECT * FROM blocks_in WHERE NOT struck_out AND trim(text) <> ''),
ob AS {order_sql('ub', 'block_no', X.BLOCK_TOLERANCE)},
{sql_labels('ob', 'label', 'doc_id, pos, page_number, y, height, is_continuation, touches_bottom, touches_top, confidence, label AS given, text', 'g').replace('SELECT doc_id, pos, page_number, y, height, is_continuation, touches_bottom, touches_top, confidence, label AS given, text, CASE', 'SELECT CASE')},
{sql_leading('(SELECT * RENAME (normalized AS gn) FROM g) AS gg', 'text', 'doc_id, pos, page_number, y, height, is_continuation, touches_bottom, touches_top, confidence, given, text, gn', 'x')},
rb AS (SELECT *, CASE WHEN gn <> '' THEN gn WHEN normalized <> '' THEN normalized END AS norm, CASE WHEN gn <> '' THEN trim(given) WHEN normalized <> '' THEN label END AS lab,
  CASE WHEN gn <> '' AND normalized <> gn THEN trim(text) WHEN gn <> '' OR normalized <> '' THEN rest ELSE trim(text) END AS body FROM x),
nb AS (SELECT *, CASE WHEN norm IS NOT NULL OR lag(pos) OVER w IS NULL THEN 1 WHEN is_continuation THEN 0
  WHEN lag(page_number) OVER w <> page_number THEN CASE WHEN lag(touches_bottom) OVER w AND touches_top THEN 0 ELSE 1 END
  WHEN y - (lag(y) OVER w + lag(height) OVER w) > {X.WIDE_GAP}::DOUBLE THEN 1 ELSE 0 END AS new FROM rb WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ai AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS island FROM nb),
aa AS (SELECT doc_id, island, arg_min_null(lab, pos) AS label, arg_min_null(norm, pos) AS normalized,
  trim(regexp_replace(coalesce(string_agg(body, chr(10) ORDER BY pos) FILTER (body <> ''), ''), '\\n{{3,}}', chr(10) || chr(10), 'g')) AS text,
  list(DISTINCT page_number ORDER BY page_number) AS pages, round(sum(CAST(confidence AS DECIMAL(9, 4)))::DOUBLE / count(*), 3) AS confidence,
  arg_max(touches_bottom, pos) AND count(DISTINCT page_number) = 1 AS appears_incomplete FROM ai GROUP BY 1, 2)"""
_P = f"""{with_inputs('questions_in')}, p AS (SELECT paper_id AS doc_id, ord, CAST(1 + ord // 2 AS VARCHAR) AS main, ord % 2 = 1 AS part FROM questions_in),
pl AS (SELECT *, main || CASE WHEN part THEN 'a' ELSE '' END AS normalized FROM p),
ps AS (SELECT a.doc_id, 'q_' || a.normalized AS question_id, CASE WHEN a.part THEN 'q_' || a.main END AS parent_id,
  NOT a.part AND EXISTS (SELECT 1 FROM pl b WHERE b.doc_id = a.doc_id AND b.main = a.main AND b.part) AS has_siblings FROM pl a)"""
_AI = "doc_id, island, label, normalized, text, pages, confidence, appears_incomplete"
ORACLES = {
    "reading_order": f"{with_inputs('lines_in')} SELECT doc_id, line_no, band, pos FROM {order_sql('lines_in', 'line_no', X.LINE_TOLERANCE)}",
    "question_islands": f"{_Q} SELECT doc_id, pos, starts, island FROM qi",
    "section_fill_down": f"{_Q} SELECT doc_id, pos, section FROM qi",
    "assemble_questions": f"""{_Q} SELECT doc_id, ord, regexp_replace(label, '\\s+', ' ', 'g') AS label, normalized, text, marks, section, page_number, round(x, 6) AS x, round(y, 6) AS y,
  round("right", 6) AS "right", round(bottom, 6) AS bottom FROM qq""",
    "printed_order_and_ids": f"{_Q} SELECT doc_id, ord, 'q_' || normalized || CASE WHEN rep > 1 THEN '_' || rep ELSE '' END AS question_id FROM qq",
    "sequence_looks_complete": f"""{_Q}, m AS (SELECT doc_id, text, nullif(TRY_CAST(regexp_extract(normalized, '^(\\d+)', 1) AS BIGINT), 0) AS m FROM qq)
SELECT doc_id, coalesce(count(*) >= 3 AND count(DISTINCT m) >= 3 AND min(m) = 1 AND max(m) = count(DISTINCT m) AND min(length(text)) >= 9, false) AS complete FROM m GROUP BY 1""",
    "parent_and_siblings": f"{_P} SELECT * FROM ps",
    "subpart_counts": f"{_P} SELECT doc_id, parent_id, count(*) AS n_parts FROM ps WHERE parent_id IS NOT NULL GROUP BY 1, 2",
    "usable_blocks": f"{_B} SELECT doc_id, block_no FROM ub",
    "answer_islands": f"{_B} SELECT doc_id, pos, island FROM ai",
    "assemble_answers": f"{_B} SELECT {_AI} FROM aa",
    "low_confidence_answers": f"{_B} SELECT doc_id, count(*) FILTER (confidence > 0 AND confidence < 0.45) AS n_low FROM aa GROUP BY 1",
    "sheet_warnings": f"""{_B}, sk AS (SELECT doc_id, count(*) FILTER (struck_out) AS n FROM blocks_in GROUP BY 1),
hd AS (SELECT doc_id, count(*) FILTER (confidence > 0 AND confidence < 0.45) AS h, count(*) FILTER (normalized IS NULL) AS r FROM aa GROUP BY 1),
pg AS (SELECT doc_id, page_number, bool_and(trim(text) = '') AS blank FROM blocks_in GROUP BY 1, 2),
pb AS (SELECT doc_id, count(*) AS pages, string_agg(page_number, ', ' ORDER BY page_number) FILTER (blank) AS blank FROM pg GROUP BY 1)
SELECT doc_id, list_filter([CASE WHEN pages > 12 THEN 'Only the first 12 of ' || pages || ' pages were processed.' END,
  CASE WHEN n > 0 THEN n || ' crossed-out region(s) were ignored.' END, CASE WHEN h > 0 THEN h || ' answer(s) were hard to read; their transcription may be inaccurate.' END,
  CASE WHEN blank IS NOT NULL THEN 'No handwriting was detected on answer sheet page(s) ' || blank || '.' END,
  CASE WHEN r > 0 THEN r || ' answer(s) need review before you rely on the match.' END], lambda x: x IS NOT NULL) AS warnings
FROM sk LEFT JOIN hd USING (doc_id) LEFT JOIN pb USING (doc_id)""",
    "inline_question_starts": f"""{with_inputs('lines_in')}, tw AS (SELECT doc_id, line_no, text || ' 7. Then ' || text AS text FROM lines_in), {parts_sql('tw')}
SELECT doc_id, line_no, list(part ORDER BY part_no) AS parts FROM pn GROUP BY 1, 2""",
    "apportion_inline_split": f"{with_inputs('lines_in')}, {PARTS_SQL} SELECT doc_id, line_no, part_no, pos, round(x, 9) AS x, round(width, 9) AS width, md5(text) AS text_md5 FROM ol",
    "answer_pages": f"{_B} SELECT doc_id, island, pages, len(pages) > 1 AS multi_page FROM aa",
}
