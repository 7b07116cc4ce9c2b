"""Assessment inputs derived from the given tables: the same rows for Spark and for the SQL that checks them.

Most inputs are one SELECT in the SQL that both engines share; the few that cut texts into lines, and the ink rows, have a form each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (inputs or tables it reads, SELECT)
SHARED: dict[str, tuple[tuple[str, ...], str]] = {
    "questions_in": (("conversations",), """
SELECT conv_id AS paper_id, CAST(n - 1 AS BIGINT) AS ord,
  CASE (conv_id + n - 1) % 5 WHEN 0 THEN concat(CAST(n AS STRING), '.') WHEN 1 THEN concat('Q', CAST(n AS STRING))
    WHEN 2 THEN concat('Q ', CAST(n AS STRING), ' (a)') WHEN 3 THEN concat(CAST(n AS STRING), '(b')
    ELSE concat('Section B - ', CAST(n AS STRING)) END AS raw_label,
  CASE WHEN (conv_id + n) % 6 <> 5 THEN CAST(1 + (conv_id + turn) % 5 AS BIGINT) END AS marks, CASE WHEN (conv_id + n - 1) % 5 = 4 THEN 'Section B' END AS section, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'user') AS q"""),
    "answers_in": (("conversations",), """
SELECT paper_id, student_ix, ord, CASE WHEN k = 0 THEN NULL WHEN k = 1 AND student_ix <> 1 THEN concat('q', CAST(n + 10 AS STRING))
    WHEN (paper_id + ord) % 5 = 2 THEN concat(m, '(a)') WHEN (paper_id + ord) % 5 = 3 THEN concat('Ans. ', m, '(b)')
    ELSE concat('q', m) END AS raw_label,
  CAST((30 + (7 * paper_id + 13 * turn + student_ix) % 70) / 100.0 AS DOUBLE) AS confidence,
  CAST(1 + (paper_id + ord) % 6 AS INT) AS first_page, CASE WHEN (paper_id + ord) % 4 < 2 THEN 2 ELSE 1 END AS n_regions,
  CASE WHEN (paper_id + ord) % 4 = 0 THEN 1 ELSE 0 END AS page_step, text
FROM (SELECT conv_id AS paper_id, s AS student_ix, CAST(n - 1 AS BIGINT) AS ord, n, turn, text, (conv_id + 3 * s + n - 1) % 7 AS k,
    CASE WHEN (conv_id + 3 * s + n - 1) % 7 = 1 THEN '7' ELSE CAST(n AS STRING) END AS m
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations WHERE role = 'assistant') AS a
  CROSS JOIN (SELECT CAST(0 AS BIGINT) AS s UNION ALL SELECT 1 UNION ALL SELECT 2) AS st) AS b"""),
    "lines_in": (("raw_lines",), """
SELECT doc_id, CAST(floor(line_no / 30.0) AS INT) AS page_number, line_no,
  CASE WHEN doc_id % 10 = 0 AND line_no % 2 = 1 THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.1 AS DOUBLE) END AS x,
  (line_no % 30) * CAST(0.03 AS DOUBLE) AS y, CAST(0.3 AS DOUBLE) AS width, CAST(0.025 AS DOUBLE) AS height,
  CASE WHEN line_no % 20 = 0 AND doc_id % 3 = 0 THEN CASE WHEN line_no % 40 = 0 THEN 'Section A' ELSE 'PART b - ' END
    WHEN (doc_id + line_no) % 8 = 0 THEN concat(CAST(1 + CAST(floor(line_no / 4.0) AS INT) AS STRING), '. ', line, ' [', CAST(1 + line_no % 5 AS STRING), '] ', CAST(2 + CAST(floor(line_no / 4.0) AS INT) AS STRING),
      CASE WHEN line_no % 3 = 0 THEN ' (b) ' ELSE '. ' END, 'Also: ', line, CASE WHEN line_no % 5 = 0 THEN ' See 3. What' ELSE '' END)
    WHEN (doc_id + line_no) % 4 = 0 THEN concat(CAST(1 + CAST(floor(line_no / 4.0) AS INT) AS STRING), '. ', line, ' [', CAST(1 + line_no % 5 AS STRING), ']')
    WHEN (doc_id + line_no) % 23 = 5 THEN concat('Page ', CAST(line_no AS STRING)) ELSE line END AS text
FROM raw_lines"""),
    "blocks_in": (("lines_in",), """
SELECT doc_id, page_number, line_no AS block_no, x, y, width, height, text,
  CASE WHEN (doc_id + line_no) % 11 = 3 THEN concat('Q', CAST(1 + line_no % 9 AS STRING)) END AS label,
  (doc_id + line_no) % 5 = 0 AS is_continuation, (doc_id + line_no) % 17 = 0 AS struck_out,
  line_no % 30 = 29 AS touches_bottom, line_no % 30 = 0 AS touches_top,
  CAST((20 + (doc_id + 7 * line_no) % 80) / 100.0 AS DOUBLE) AS confidence
FROM lines_in"""),
    "ink_in": (("raw_lines",), """
SELECT doc_id, CAST(floor(line_no / 200.0) AS BIGINT) AS page, line_no % 200 AS line_no, CAST(line_no % 200 * 11 + r + floor((line_no % 200 + 0.0) / 6.0) * 11 AS INT) AS y,
  CAST(3 + length(line) % 50 AS INT) AS ink, CAST(10 + line_no % 200 % 5 AS INT) AS x0, CAST(13 + line_no % 200 % 5 + length(line) % 50 AS INT) AS x1
FROM raw_lines CROSS JOIN (SELECT 0 AS r UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4
  UNION ALL SELECT 5 UNION ALL SELECT 6 UNION ALL SELECT 7) AS rs"""),
    "grades_in": (("lineitem",), """
SELECT paper_id, student_ix, question_no, marks, max_marks, evaluation, requires_review, printed_marks, feedback, confidence FROM (
  SELECT l_orderkey AS paper_id, l_suppkey % 20 AS student_ix, CAST(l_linenumber AS BIGINT) AS question_no, CAST(l_quantity AS DOUBLE) AS marks,
    CAST(50 AS DOUBLE) AS max_marks, CASE l_returnflag WHEN 'A' THEN 'correct' WHEN 'N' THEN 'incorrect' ELSE 'partial' END AS evaluation,
    l_partkey % 7 = 0 AS requires_review, CASE WHEN l_partkey % 3 > 0 THEN CAST(5 + l_partkey % 50 AS BIGINT) END AS printed_marks,
    CASE WHEN l_returnflag = 'N' THEN concat('see line ', CAST(l_linenumber AS STRING)) END AS feedback, CAST((l_partkey % 100) / 100.0 AS DOUBLE) AS confidence,
    row_number() OVER (PARTITION BY l_orderkey, l_suppkey % 20, l_linenumber
      ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice) AS rn
  FROM lineitem) AS g WHERE rn = 1"""),
    "stage_events_in": (("events",), """
SELECT user_id AS job_id, event_id % 9 AS stage, CASE event_type WHEN 'click' THEN 'active' WHEN 'view' THEN 'done'
    WHEN 'signup' THEN 'skipped' WHEN 'error' THEN 'failed' ELSE 'done' END AS state, event_type, ts, event_id
FROM events"""),
    "review_edits_in": (("events_k", "grades_in"), """
SELECT e.paper_id, CASE WHEN e.event_type <> 'purchase' THEN g.student_ix END AS student_ix, CASE WHEN e.event_type <> 'purchase' THEN g.question_no END AS question_no,
  e.event_id AS seq, e.ts, CASE WHEN e.event_type IN ('click', 'view') THEN e.value END AS marks,
  CASE WHEN e.event_type = 'signup' THEN concat('see me about ', CAST(g.question_no AS STRING)) END AS feedback,
  CASE e.event_type WHEN 'error' THEN 'revert' WHEN 'purchase' THEN 'publish' ELSE 'edit' END AS kind
FROM (SELECT *, event_id - event_id % 10 AS paper_id FROM events_k) AS e
JOIN (SELECT paper_id, student_ix, question_no, row_number() OVER (PARTITION BY paper_id ORDER BY student_ix, question_no) - 1 AS place,
    count(*) OVER (PARTITION BY paper_id) AS size FROM grades_in) AS g ON g.paper_id = e.paper_id AND g.place = e.k % g.size"""),
    "call_log_in": (("events",), """
SELECT event_id, user_id AS sheet_id, event_id % 5 AS step_no,
  CASE event_id % 8 WHEN 0 THEN 200 WHEN 1 THEN 401 WHEN 2 THEN 400 WHEN 3 THEN 404 WHEN 4 THEN 429 WHEN 5 THEN 500 WHEN 6 THEN 503 END AS status,
  CASE event_id % 11 WHEN 0 THEN 'auth' WHEN 1 THEN 'network' ELSE 'provider' END AS error_class,
  CASE event_id % 13 WHEN 0 THEN 'document' WHEN 1 THEN 'other' WHEN 2 THEN 'other' WHEN 3 THEN 'other' WHEN 4 THEN 'auth' WHEN 5 THEN 'network' ELSE 'provider' END AS job_class,
  CASE event_id % 6 WHEN 0 THEN 'reading-question-paper' WHEN 1 THEN 'detecting-questions' WHEN 2 THEN 'reading-answer-sheet' WHEN 3 THEN 'detecting-answers' ELSE 'mapping' END AS stage,
  CASE event_id % 10 WHEN 0 THEN 'EMPTY_FILE: no bytes' WHEN 1 THEN 'Local OCR could not start' WHEN 2 THEN 'TypeError: fetch failed' WHEN 3 THEN 'prefetched page was lost' WHEN 4 THEN 'ECONNRESET' ELSE 'no such page' END AS job_message,
  CASE event_id % 3 WHEN 0 THEN 'error: API_KEY_INVALID' WHEN 1 THEN 'quota exceeded' ELSE '' END AS body,
  CASE event_id % 7 WHEN 0 THEN 'fetch failed' WHEN 1 THEN 'request timed out' WHEN 2 THEN 'Unexpected token' ELSE 'no reply' END AS message
FROM events"""),
    "manifest_in": (("pages",), """
SELECT page_id % 50 AS batch_id, page_id AS file_ix, concat('scan_', CAST(page_id % 40 AS STRING),
    CASE page_id % 6 WHEN 0 THEN '.pdf' WHEN 1 THEN '.PNG' WHEN 2 THEN '.jpg' WHEN 3 THEN '.jpeg' WHEN 4 THEN '.txt' ELSE '' END) AS file_name,
  CASE page_id % 4 WHEN 0 THEN 'application/pdf' WHEN 1 THEN 'image/png' WHEN 2 THEN 'text/plain' ELSE '' END AS mime_type,
  CAST(length(html) * (page_id % 9) * 1000 AS BIGINT) AS byte_size, CAST(page_id % 20 + 1 AS INT) AS page_count,
  CASE WHEN page_id % 5 = 0 THEN concat('x%PDF-1.7', html) ELSE html END AS content
FROM pages"""),
    # every sheet is marked against the whole paper, so each holds the paper's questions: rows grow with the sheets, the paper is fixed
    "token_docs_in": (("documents", "benchmark"), """
SELECT CAST(floor(doc_id / 50.0) AS BIGINT) AS sheet, 'a' AS side, doc_id AS ix, text FROM documents
UNION ALL SELECT s AS sheet, 'q' AS side, item_id AS ix, text FROM benchmark CROSS JOIN
  (SELECT DISTINCT CAST(floor(doc_id / 50.0) AS BIGINT) AS s FROM documents) AS st"""),
    "vectors_in": (("embeddings",), """
SELECT CAST(floor(vec_id / 60.0) AS BIGINT) AS sheet, CASE WHEN vec_id % 5 = 0 THEN 'q' ELSE 'a' END AS side, vec_id AS ix, embedding FROM embeddings"""),
    "vector_texts_in": (("vectors_in", "documents"), """
SELECT sheet, side, ix, coalesce(text, '') AS text, CASE WHEN sheet % 3 = 1 AND ix % 7 = 0 THEN NULL ELSE embedding END AS embedding
FROM vectors_in LEFT JOIN documents ON doc_id = ix"""),
    "sheet_grades_in": (("answers_in",), """
SELECT paper_id, student_ix, ord AS q_ord, CAST((paper_id + 3 * ord + student_ix) % 6 AS DOUBLE) AS marks, CAST(5 AS DOUBLE) AS max_marks,
  CASE (paper_id + 3 * ord + student_ix) % 6 WHEN 5 THEN 'correct' WHEN 0 THEN CASE WHEN ord % 2 = 0 THEN 'not_attempted' ELSE 'incorrect' END ELSE 'partial' END AS evaluation,
  CASE WHEN (paper_id + ord) % 3 = 0 THEN concat('Look at step ', CAST(ord + 1 AS STRING)) ELSE '' END AS feedback,
  CAST(((paper_id + 7 * ord) % 100) / 100.0 AS DOUBLE) AS grade_confidence, (paper_id + ord + student_ix) % 4 = 0 AS requires_review
FROM answers_in WHERE (paper_id + 2 * ord + student_ix) % 5 <> 4"""),
    "sheet_edits_in": (("answers_in",), """
SELECT paper_id, student_ix, ord AS q_ord, CASE WHEN (paper_id + ord) % 3 <> 1 THEN CAST((paper_id + 5 * ord) % 9 - 1 AS DOUBLE) END AS edit_marks,
  CASE WHEN (paper_id + ord) % 3 <> 2 THEN concat('Teacher: see page ', CAST(ord + 1 AS STRING)) END AS edit_feedback
FROM answers_in WHERE (paper_id + ord + 2 * student_ix) % 4 = 1"""),
}

DUCK = {
    "raw_lines": (("documents",), """
SELECT doc_id, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents"""),
    "events_k": (("events",), "SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events"),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


PAGE_LINES = 200  # lines of a document that a page image holds


def ink_of(lines: DataFrame) -> DataFrame:
    """Eight rows of ink for every line of a document, on pages of 200 lines each, as in the SELECT above."""
    n, size = F.col("line_no") % PAGE_LINES, F.length("line") % 50
    return lines.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(7)))).select(
        "doc_id", F.floor(F.col("line_no") / PAGE_LINES).alias("page"), n.alias("line_no"), (n * 11 + F.col("r") + F.floor(n / 6) * 11).cast("int").alias("y"),
        (3 + size).cast("int").alias("ink"), (10 + n % 5).cast("int").alias("x0"), (13 + n % 5 + size).cast("int").alias("x1"),
    )


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived input, or a given table."""
    if name == "raw_lines":
        return table(spark, sf_dir, "documents").select(
            "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line")
        ).withColumn("line_no", F.col("line_no").cast("bigint"))
    if name == "events_k":
        return table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    if name == "ink_in":
        return ink_of(derived(spark, sf_dir, "raw_lines"))
    if name not in SHARED:
        return table(spark, sf_dir, name)
    reads, text = SHARED[name]
    parts = text
    for r in reads:
        parts = _named(parts, r, "{" + r + "}")
    return spark.sql(parts, **{r: derived(spark, sf_dir, r) for r in reads})


def _named(text: str, name: str, by: str) -> str:
    import re

    return re.sub(rf"(?<=FROM |JOIN )({name})\b", lambda _: by, text)


def with_inputs(*names: str) -> str:
    """``WITH`` clause that gives the named inputs to a DuckDB query, each after those it reads."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        reads, text = SHARED.get(name) or DUCK.get(name) or ((), "")
        for r in reads:
            add(r)
        if text:
            done.setdefault(name, text.replace("AS STRING", "AS VARCHAR"))

    for n in names:
        add(n)
    return "WITH RECURSIVE " + ", ".join(f"{n} AS ({t})" for n, t in done.items())
