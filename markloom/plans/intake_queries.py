"""Queries over uploads, calls, jobs and progress, and the SQL that checks them."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from markloom.operators import extraction as X
from markloom.operators import intake as I
from markloom.operators import matching as M
from markloom.operators import replies as P
from markloom.plans.extraction_queries import order_sql
from markloom.plans.label_queries import lit
from markloom.plans.matching_queries import _BASE, _MAPPED, _qa
from markloom.sources.inputs import derived, with_inputs
from markloom.sources.shared import new_folder, settle
from markloom.streaming import progress as S


def _m(spark, sf_dir):
    return derived(spark, sf_dir, "manifest_in")


def _calls(spark, sf_dir):
    k = I.failure_kind(F.col("status"), F.col("error_class"), F.col("body"), F.col("message"))
    return derived(spark, sf_dir, "call_log_in").withColumn("kind", k)


def _events(spark, sf_dir):
    return derived(spark, sf_dir, "stage_events_in")


def scan_file_manifest(spark, sf_dir):
    m = _m(spark, sf_dir)
    return m.select("batch_id", "file_ix", I.extension(F.col("file_name")).alias("extension"), I.is_pdf(F.col("file_name"), F.col("mime_type"), F.col("content")).alias("is_pdf"))


def validate_uploads(spark, sf_dir):
    return _m(spark, sf_dir).select("batch_id", "file_ix", I.upload_error(F.col("file_name"), F.col("mime_type"), F.col("byte_size")).alias("error_code"))


def page_cap(spark, sf_dir):
    capped = F.least(F.lit(I.MOST_PAGES), "page_count")
    return _m(spark, sf_dir).select("batch_id", "file_ix", "page_count", capped.alias("kept"), (F.col("page_count") > I.MOST_PAGES).alias("capped"))


def batch_size_guard(spark, sf_dir):
    b = _m(spark, sf_dir).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("byte_size") == 0).alias("has_empty"))
    return b.select("batch_id", "n", ((F.col("n") > I.MOST_SHEETS) | F.col("has_empty")).alias("refused"))


def dedupe_uploads(spark, sf_dir):
    w = Window.partitionBy("batch_id", "file_name", "byte_size").orderBy("file_ix")
    return _m(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").select("batch_id", "file_ix")


def ordered_distinct(spark, sf_dir):
    return _m(spark, sf_dir).select("batch_id", "mime_type").distinct()


def ordered_distinct_warnings(spark, sf_dir):
    """Kinds of failure of a sheet in the order in which they were first seen."""
    w = F.array_sort(F.collect_list(F.struct("event_id", "kind")))
    said = F.array_distinct(F.transform(w, lambda x: x["kind"]))
    return _calls(spark, sf_dir).where("kind IS NOT NULL").groupBy("sheet_id").agg(said.alias("kinds"))


def first_n_clean(spark, sf_dir):
    parts = F.filter(F.transform(F.split("text", r"[.\n]"), lambda p: F.trim(p)), lambda p: p != "")
    return derived(spark, sf_dir, "benchmark").select("item_id", F.slice(parts, 1, 4).alias("points"))


def classify_provider_failure(spark, sf_dir):
    return _calls(spark, sf_dir).select("event_id", "kind")


def describe_degradation(spark, sf_dir):
    """What is said of every call that failed; every ninth had no provider to go to."""
    step = F.concat(F.lit("step "), F.col("step_no").cast("string"))
    kind = F.when(F.col("event_id") % 9 == 8, "not_configured").otherwise(F.col("kind"))
    return _calls(spark, sf_dir).where(kind.isNotNull()).select("event_id", I.failure_sentence(kind, step).alias("sentence"))


def job_error_class(spark, sf_dir):
    e = I.job_error(F.col("job_class"), F.col("status"), F.col("job_message"), F.col("stage"))
    return derived(spark, sf_dir, "call_log_in").select("event_id", e.alias("e")).select("event_id", "e.code", "e.message", "e.retryable")


def first_degradation_per_step(spark, sf_dir):
    return I.first_per_step(_calls(spark, sf_dir)).select("sheet_id", "step_no", "event_id", "kind")


def actionable_degradations(spark, sf_dir):
    return I.lead_failure(I.first_per_step(_calls(spark, sf_dir))).select("sheet_id", "event_id", "kind")


def provider_provenance(spark, sf_dir):
    """Sheets as runs: a run falls back where none of its calls went through."""
    used = _calls(spark, sf_dir).groupBy("sheet_id").agg((F.count_if(F.col("kind").isNull()) == 0).alias("used_fallback"))
    n = F.col("sheet_id")
    requested = F.when(n % 7 == 0, " LOCAL ").when(n % 7 == 1, "anthropic").when(n % 7 == 2, "gemini").when(n % 7 == 3, "other")
    return I.provenance(used.select("sheet_id", requested.alias("requested"), (n % 5 != 0).alias("has_key"), F.lit("model-1").alias("model"), "used_fallback"))


def batch_outcome(spark, sf_dir):
    v = validate_uploads(spark, sf_dir)
    b = v.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"), F.count("error_code").alias("failed"),
        F.min_by("error_code", F.when(F.col("error_code").isNotNull(), F.col("file_ix"))).alias("first_error"),
    )
    all_failed = F.col("failed") == F.col("n")
    warning = F.when((F.col("failed") > 0) & ~all_failed, F.format_string("%d of %d files failed", "failed", "n"))
    return b.select("batch_id", "failed", F.when(all_failed, F.col("first_error")).alias("job_error"), warning.alias("warning"))


def failed_sheet_row(spark, sf_dir):
    """Sheets that failed, and every fifth of the others as one on which no answer was found."""
    q = derived(spark, sf_dir, "questions_in").select("paper_id", F.col("ord").alias("q_ord"))
    sheets = validate_uploads(spark, sf_dir).select(
        F.col("batch_id").alias("paper_id"), F.col("file_ix").alias("sheet_ix"), "error_code", F.when(F.col("file_ix") % 5 == 0, 0).otherwise(3).alias("n_answers")
    )
    return I.failed_sheets(q, sheets)


def _followed(spark, sf_dir):
    """The progress of every job, followed as a stream: frames come in files that mix early and late ones."""
    folder = new_folder(spark, "progress")
    _events(spark, sf_dir).repartition(6, F.xxhash64("event_id")).write.parquet(f"{folder}/in")
    frames = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 2).parquet(f"{folder}/in")
    return S.follow_progress(frames, f"{folder}/jobs", f"{folder}/checkpoint").current(spark)


def live_progress(spark, sf_dir):
    return _followed(spark, sf_dir).select("job_id", F.inline("stages"))


def stage_progress_percent(spark, sf_dir):
    return _followed(spark, sf_dir).select("job_id", "percent")


def cut_off_runs(spark, sf_dir):
    e = _events(spark, sf_dir)
    last = e.where("event_type = 'purchase'").select("job_id").distinct()
    return e.select("job_id").distinct().join(last, "job_id", "left_anti")


def stalled_jobs(spark, sf_dir):
    """Sessions of a job (12 hours without a frame end one) that hold no terminal frame. The frames come as a stream, in slices
    of time. When it has stopped, ticks of the clock past all frames arrive and it goes on from its checkpoint: the first
    moves the watermark, with the second every session closes."""
    folder = new_folder(spark, "sessions")
    e = _events(spark, sf_dir).select(*S.EVENT.names)
    low, high = e.agg(F.min("ts"), F.max("ts")).first()
    write = lambda rows: rows.write.mode("append").parquet(f"{folder}/in")
    frames = spark.readStream.schema(S.EVENT).option("maxFilesPerTrigger", 4).parquet
    run = lambda: S.follow_sessions(frames(f"{folder}/in"), f"{folder}/closed", f"{folder}/checkpoint")
    if low is None:
        write(e.limit(0))
    else:
        step = (high - low) / 4
        for i in range(4):
            write(e.where((F.col("ts") >= low + i * step) & ((F.col("ts") < low + (i + 1) * step) if i < 3 else F.lit(True))))
        none = {f.name: F.lit(None).cast(f.dataType) for f in S.EVENT.fields}
        for days in (3, 4):
            run()
            write(spark.range(1).select(*(v.alias(k) for k, v in (none | {"ts": F.lit(high + timedelta(days=days))}).items())))
    return S.stalled_jobs(run().current(spark)).select("job_id", F.unix_timestamp("start").alias("start_s"), "n")


def write_progress_frames(spark, sf_dir):
    """Each job's frames in order with one terminal frame and its payload at the end, written as a commit and read back."""
    folder = new_folder(spark, "frames")
    S.commit_frames(S.frames_of(_events(spark, sf_dir)), folder, 0)
    said = lambda f: F.get_json_object("payload", f"$.{f}").cast("bigint").alias
    return S.read_commits(spark, folder).select("job_id", "seq", "type", "stage", "state", said("percent")("percent"), said("stage")("failed_stage"), F.get_json_object("payload", "$.message").alias("message"))


def _requests(spark, sf_dir):
    q, a = _qa(spark, sf_dir)
    found = M.deterministic_matches(q, a)
    matches = settle(found.unionByName(M.semantic_matches(q, a, found)))
    lines = X.reading_order(derived(spark, sf_dir, "lines_in"), X.LINE_TOLERANCE, "line_no")
    return I.requests(q, a, M.finalize_mappings(q, a, matches), M.open_questions(q, a, matches), M.open_answers(q, a, matches), lines)


def request_batches(spark, sf_dir):
    """The texts asked for every sheet, and for the lines of every document (no student)."""
    return _requests(spark, sf_dir).select("paper_id", "student_ix", "request", "n_rows", F.md5("text").alias("request_md5"))


def fill_missing_regions(spark, sf_dir):
    """Regions asked for, with what was read, or empty text and confidence 0."""
    b = derived(spark, sf_dir, "blocks_in")
    read = b.where("block_no % 3 <> 0").select("doc_id", "block_no", "text", "confidence")
    return b.select("doc_id", "block_no").join(read, ["doc_id", "block_no"], "left").select(
        "doc_id", "block_no", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("confidence", F.lit(0.0)).alias("confidence")
    )


def _regions(spark, sf_dir):
    """Replies of a reader, one per page with a row for every region, read back. Replies come as an object, fenced, as a bare
    array, under another name, and behind a remark in brackets; besides the regions' rows they hold an earlier row of the
    first region, rows without a usable index, and a number."""
    b = derived(spark, sf_dir, "blocks_in")
    n = F.col("block_no")
    index = F.when(n % 2 == 0, F.concat(F.lit('"'), n.cast("string"), F.lit('"'))).otherwise(n.cast("string"))
    rest = F.to_json(F.struct("text", F.coalesce("label", F.when(n % 3 == 0, "NULL")).alias("label"), F.when(n % 5 != 0, F.col("confidence")).alias("confidence"), F.col("is_continuation").cast("string").alias("isContinuation"), F.col("struck_out").alias("struckOut")))
    row = F.concat(F.lit('{"index":'), index, F.lit(","), F.substring(rest, F.lit(2), F.length(rest)))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_no", row.alias("row")))), lambda x: x["row"]), ",")
    odd = F.concat(F.lit('[{"index":'), F.min("block_no").cast("string"), F.lit(',"text":"old"},{"index":"x","text":"a"},{"index":1.5},7,null,'), rows, F.lit("]"))
    pages = b.groupBy("doc_id", "page_number").agg(odd.alias("rows"))
    how = F.pmod(F.col("doc_id") + F.col("page_number"), F.lit(5))
    named = F.concat(F.lit('{"regions":'), F.col("rows"), F.lit("}"))
    reply = (
        F.when(how == 0, named).when(how == 1, F.concat(F.lit("Here:\n```JSON\n"), named, F.lit("\n``` Done."))).when(how == 2, F.col("rows"))
        .when(how == 3, F.concat(F.lit('{"note":"[1]","found":'), F.col("rows"), F.lit("}"))).otherwise(F.concat(F.lit("As asked [see page]: "), named, F.lit(" - {end}")))
    )
    return P.region_rows(pages.select("doc_id", "page_number", reply.alias("reply")), ["doc_id", "page_number"])


def scan_region_responses(spark, sf_dir):
    return _regions(spark, sf_dir)


def region_rows(spark, sf_dir):
    return _regions(spark, sf_dir).select("doc_id", "page_number", "index", "label", "confidence")


def page_highlights(spark, sf_dir):
    """With a sheet's last answer selected on papers of even number, its first on the others."""
    q, a = _qa(spark, sf_dir)
    active = a.groupBy(*M.SHEET).agg(F.max("a_ord").alias("hi"), F.min("a_ord").alias("lo")).select(*M.SHEET, F.when(F.col("paper_id") % 2 == 0, F.col("hi")).otherwise(F.col("lo")).alias("a_ord"))
    return I.page_highlights(a, M.finalize_mappings(q, a, M.deterministic_matches(q, a)), q, active)


QUERIES = {
    f.__name__: f
    for f in (
        scan_file_manifest, validate_uploads, page_cap, batch_size_guard, dedupe_uploads, ordered_distinct, ordered_distinct_warnings,
        first_n_clean, classify_provider_failure, describe_degradation, job_error_class, first_degradation_per_step,
        actionable_degradations, provider_provenance, batch_outcome, failed_sheet_row, live_progress, stage_progress_percent, cut_off_runs,
        stalled_jobs, write_progress_frames, request_batches, fill_missing_regions, scan_region_responses, region_rows, page_highlights,
    )
}

_M = f"""{with_inputs('manifest_in')}, e AS (SELECT *, lower(regexp_extract(file_name, '(\\.[^.]*)$', 1)) AS extension FROM manifest_in),
v AS (SELECT batch_id, file_ix, CASE WHEN byte_size = 0 THEN 'EMPTY_FILE' WHEN byte_size > 10485760 THEN 'TOO_LARGE'
  WHEN NOT (extension IN ('.pdf', '.png', '.jpg', '.jpeg') OR mime_type IN ('application/pdf', 'image/png', 'image/jpeg', 'image/jpg')) THEN 'UNSUPPORTED_TYPE' END AS error_code FROM e)"""
_C = f"""{with_inputs('call_log_in')}, c AS (SELECT *, CASE WHEN status = 200 THEN NULL
  WHEN error_class = 'auth' OR status IN (401, 403) OR (status = 400 AND regexp_matches(lower(body), 'api[_ ]?key')) THEN 'credentials'
  WHEN error_class = 'network' THEN 'network' WHEN status = 429 THEN 'quota' WHEN status >= 500 THEN 'provider_unavailable' WHEN status >= 400 THEN 'misconfigured'
  WHEN regexp_matches(lower(message), 'fetch failed|timed out|econn|enotfound|network') THEN 'network' ELSE 'unusable_response' END AS kind FROM call_log_in),
fs AS (SELECT * FROM c WHERE kind IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sheet_id, step_no ORDER BY event_id) = 1)"""
_E = f"""{with_inputs('stage_events_in')}, ls AS (SELECT job_id, stage, state FROM stage_events_in QUALIFY row_number() OVER (PARTITION BY job_id, stage ORDER BY ts DESC, event_id DESC) = 1)"""
_SAID = "CASE kd " + " ".join("WHEN '" + k + "' THEN replace(replace(" + lit(v) + ", '{step}', 'step ' || step_no), '{Step}', 'Step ' || step_no)" for k, v in I.SENTENCES.items()) + " END"
_CODES = " ".join(f"WHEN cause = '{k}' THEN '{c}'" for k, (c, _, _) in I.JOB_ERRORS.items())
_MESSAGES = " ".join(f"WHEN cause = '{k}' THEN {lit(m)}" for k, (_, m, _) in I.JOB_ERRORS.items())
_B = with_inputs("blocks_in")
_ASKED = "'questionId: ' || f.q_ord || chr(10) || 'label: ' || q.label || chr(10) || 'maxMarks: ' || coalesce(q.marks, 1) || chr(10) || 'question: ' || substring(q.text, 1, 800) || chr(10)"
ORACLES = {
    "scan_file_manifest": f"""{_M} SELECT batch_id, file_ix, extension, mime_type = 'application/pdf' OR extension = '.pdf' OR contains(substring(content, 1, 1024), '%PDF-') AS is_pdf FROM e""",
    "validate_uploads": f"{_M} SELECT * FROM v",
    "page_cap": f"{_M} SELECT batch_id, file_ix, page_count, CAST(least(12, page_count) AS INT) AS kept, page_count > 12 AS capped FROM e",
    "batch_size_guard": f"{_M} SELECT batch_id, count(*) AS n, count(*) > 20 OR bool_or(byte_size = 0) AS refused FROM e GROUP BY 1",
    "dedupe_uploads": f"{_M} SELECT batch_id, min(file_ix) AS file_ix FROM e GROUP BY batch_id, file_name, byte_size",
    "ordered_distinct": f"{_M} SELECT DISTINCT batch_id, mime_type FROM e",
    "ordered_distinct_warnings": f"{_C} SELECT sheet_id, list(kind ORDER BY e) AS kinds FROM (SELECT sheet_id, kind, min(event_id) AS e FROM c WHERE kind IS NOT NULL GROUP BY 1, 2) GROUP BY 1",
    "first_n_clean": "SELECT item_id, list_filter(list_transform(regexp_split_to_array(text, '[.\\n]'), lambda p: trim(p)), lambda p: p <> '')[1:4] AS points FROM benchmark",
    "classify_provider_failure": f"{_C} SELECT event_id, kind FROM c",
    "describe_degradation": f"{_C}, k AS (SELECT *, CASE WHEN event_id % 9 = 8 THEN 'not_configured' ELSE kind END AS kd FROM c) SELECT event_id, {_SAID} AS sentence FROM k WHERE kd IS NOT NULL",
    "job_error_class": f"""{with_inputs('call_log_in')}, x AS (SELECT *, CASE WHEN job_class = 'document' THEN 'document' WHEN job_class = 'other' THEN
    CASE WHEN regexp_matches(job_message, {lit(I.OFFLINE)}) THEN 'offline' WHEN regexp_matches(job_message, {lit(I.DROPPED)}) THEN 'dropped'
      WHEN stage IN ('reading-question-paper', 'detecting-questions') THEN 'questions' WHEN stage IN ('reading-answer-sheet', 'detecting-answers') THEN 'answers' ELSE 'internal' END
    WHEN status = 429 THEN 'rate' WHEN job_class = 'auth' THEN 'auth' WHEN status BETWEEN 400 AND 499 AND status <> 408 THEN 'rejected' WHEN status >= 500 THEN 'overloaded'
    WHEN job_class = 'network' THEN 'dropped' ELSE 'unreached' END AS cause FROM call_log_in)
SELECT event_id, CASE WHEN cause = 'document' THEN CASE WHEN job_message LIKE 'EMPTY_FILE%' THEN 'EMPTY_DOCUMENT' ELSE 'INVALID_FILE' END {_CODES} END AS code,
  CASE WHEN cause = 'document' THEN job_message {_MESSAGES} END AS message, cause NOT IN ('document', 'auth', 'rejected', 'offline') AS retryable FROM x""",
    "first_degradation_per_step": f"{_C} SELECT sheet_id, step_no, event_id, kind FROM fs",
    "actionable_degradations": f"""{_C} SELECT sheet_id, event_id, kind FROM fs
QUALIFY row_number() OVER (PARTITION BY sheet_id ORDER BY CASE WHEN kind IN ('quota', 'credentials', 'misconfigured') THEN 0 ELSE 1 END, event_id) = 1""",
    "provider_provenance": f"""{_C}, u AS (SELECT sheet_id, count(*) FILTER (kind IS NULL) = 0 AS fell, sheet_id % 7 AS r, sheet_id % 5 <> 0 AS key FROM c GROUP BY 1)
SELECT sheet_id, CASE WHEN fell OR r = 0 OR NOT key THEN 'local' WHEN r = 1 THEN 'anthropic' ELSE 'gemini' END AS id,
  CASE WHEN fell OR r = 0 OR NOT key THEN 'tesseract-eng' ELSE 'model-1' END AS model, fell OR r = 0 OR NOT key AS degraded,
  CASE WHEN fell THEN 'no-key' WHEN r = 0 THEN 'chosen' WHEN NOT key THEN 'no-key' END AS local_mode FROM u""",
    "batch_outcome": f"""{_M}, b AS (SELECT batch_id, count(*) AS n, count(error_code) AS failed, arg_min(error_code, file_ix) FILTER (error_code IS NOT NULL) AS fe FROM v GROUP BY 1)
SELECT batch_id, failed, CASE WHEN failed = n THEN fe END AS job_error, CASE WHEN failed > 0 AND failed < n THEN failed || ' of ' || n || ' files failed' END AS warning FROM b""",
    "failed_sheet_row": f"""{_M.replace('WITH RECURSIVE ', with_inputs('questions_in') + ', ')}, n AS (SELECT paper_id, count(*) AS total, list(ord ORDER BY ord) AS orders FROM questions_in GROUP BY 1)
SELECT paper_id, file_ix AS sheet_ix, coalesce(error_code, 'ANSWER_EXTRACTION_FAILED') AS error_code, total, 0::BIGINT AS answered, total AS unanswered, 0::BIGINT AS needs_review,
  0::BIGINT AS unmatched_answers, CASE WHEN error_code IS NULL THEN orders ELSE [] END AS unanswered_rows,
  CASE WHEN error_code IS NULL THEN 'No handwritten answers were detected on this sheet.' END AS reason
FROM n JOIN v ON batch_id = paper_id WHERE error_code IS NOT NULL OR file_ix % 5 = 0""",
    "live_progress": f"""{_E} SELECT job_id, stage, CASE WHEN state = 'active' AND bool_or(state = 'failed') OVER (PARTITION BY job_id) THEN 'failed' ELSE state END AS state FROM ls""",
    "stage_progress_percent": f"""{_E} SELECT job_id, CAST(floor((count(*) FILTER (state IN ('done', 'skipped')) + CASE WHEN bool_or(state = 'active') THEN 0.5 ELSE 0 END) * 100 / 9 + 0.5) AS BIGINT) AS percent FROM ls GROUP BY 1""",
    "cut_off_runs": f"{_E} SELECT DISTINCT job_id FROM stage_events_in WHERE job_id NOT IN (SELECT job_id FROM stage_events_in WHERE event_type = 'purchase')",
    "stalled_jobs": f"""{_E}, g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new FROM stage_events_in WINDOW w AS (PARTITION BY job_id ORDER BY ts)),
h AS (SELECT *, sum(new) OVER (PARTITION BY job_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT job_id, CAST(floor(epoch(min(ts))) AS BIGINT) AS start_s, count(*) AS n FROM h GROUP BY job_id, s HAVING NOT bool_or(event_type = 'purchase')""",
    "write_progress_frames": f"""{_E}, pc AS (SELECT job_id, CAST(floor((count(*) FILTER (state IN ('done', 'skipped')) + CASE WHEN bool_or(state = 'active') THEN 0.5 ELSE 0 END) * 100 / 9 + 0.5) AS BIGINT) AS percent FROM ls GROUP BY 1),
en AS (SELECT job_id, count(*) + 1 AS seq, arg_max(stage, event_id) FILTER (state = 'failed') AS fs FROM stage_events_in GROUP BY 1)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY event_id) AS seq, 'stage' AS type, stage, state, NULL AS percent, NULL AS failed_stage, NULL AS message FROM stage_events_in
UNION ALL SELECT job_id, seq, CASE WHEN fs IS NOT NULL THEN 'error' ELSE 'result' END, NULL, NULL, CASE WHEN fs IS NULL THEN percent END, fs, 'Stage ' || fs || ' failed.' FROM en JOIN pc USING (job_id)""",
    "request_batches": f"""{_MAPPED.replace('WITH RECURSIVE ', with_inputs('lines_in') + ', ', 1)},
tried AS (SELECT f.paper_id, f.student_ix, count(*) AS n_rows, string_agg({_ASKED} || 'ocrConfidence: ' || CAST(CAST(CAST(a.confidence AS DECIMAL(9, 6)) AS DECIMAL(9, 2)) AS VARCHAR)
    || chr(10) || 'studentAnswer: ' || substring(a.text, 1, 1500) || chr(10) || '---', chr(10) ORDER BY f.q_ord) AS body
  FROM final4 f JOIN q USING (paper_id, q_ord) JOIN a ON a.paper_id = f.paper_id AND a.student_ix = f.student_ix AND a.a_ord = f.a_ord GROUP BY 1, 2),
miss AS (SELECT * FROM final4 WHERE status = 'unanswered' QUALIFY row_number() OVER (PARTITION BY paper_id, student_ix ORDER BY q_ord) <= 20),
una AS (SELECT f.paper_id, f.student_ix, count(*) AS n_rows, string_agg({_ASKED} || '---', chr(10) ORDER BY f.q_ord) AS body FROM miss f JOIN q USING (paper_id, q_ord) GROUP BY 1, 2),
lf AS (SELECT paper_id, student_ix, count(*) AS n, string_agg('- id=' || q_ord || ' label="' || label || '" text="' || substring(text, 1, 400) || '"', chr(10) ORDER BY q_ord) AS body FROM oq4 GROUP BY 1, 2),
rt AS (SELECT paper_id, student_ix, count(*) AS n, string_agg('- id=' || a_ord || ' writtenLabel=' || CASE WHEN coalesce(label, '') <> '' THEN '"' || label || '"' ELSE 'none' END
    || ' text="' || substring(text, 1, 600) || '"', chr(10) ORDER BY a_ord) AS body FROM oa4 GROUP BY 1, 2),
nl AS (SELECT doc_id AS paper_id, count(*) AS n_rows, string_agg(pos || ': ' || trim(text), chr(10) ORDER BY pos) AS body FROM {order_sql('lines_in', 'line_no', X.LINE_TOLERANCE)} WHERE trim(text) <> '' GROUP BY 1)
SELECT paper_id, student_ix, 'grading' AS request, n_rows, md5('Mark the following ' || n_rows || ' answers.' || chr(10) || chr(10) || body) AS request_md5 FROM tried
UNION ALL SELECT paper_id, student_ix, 'model_answers', n_rows, md5('Write the expected answer for these ' || n_rows || ' unanswered question(s).' || chr(10) || chr(10) || body) FROM una
UNION ALL SELECT paper_id, student_ix, 'mapping', lf.n + rt.n, md5('Unmatched questions:' || chr(10) || lf.body || chr(10) || chr(10) || 'Unmatched answers (handwriting OCR, may contain errors):' || chr(10) || rt.body)
  FROM lf JOIN rt USING (paper_id, student_ix)
UNION ALL SELECT paper_id, NULL, 'structure', n_rows, md5('Lines from the question paper, in printed order:' || chr(10) || chr(10) || substring(body, 1, 60000)) FROM nl""",
    "fill_missing_regions": f"""{_B} SELECT doc_id, block_no, CASE WHEN block_no % 3 <> 0 THEN text ELSE '' END AS text, CASE WHEN block_no % 3 <> 0 THEN confidence ELSE 0 END::DOUBLE AS confidence FROM blocks_in""",
    "scan_region_responses": f"""{_B} SELECT doc_id, page_number, block_no AS "index", trim(text) AS text, label, CASE WHEN block_no % 5 <> 0 THEN confidence ELSE 0.6 END::DOUBLE AS confidence, is_continuation, struck_out FROM blocks_in""",
    "region_rows": f"""{_B} SELECT doc_id, page_number, block_no AS "index", label, CASE WHEN block_no % 5 <> 0 THEN confidence ELSE 0.6 END::DOUBLE AS confidence FROM blocks_in""",
    "page_highlights": f"""{_BASE}, ac AS (SELECT paper_id, student_ix, CASE WHEN paper_id % 2 = 0 THEN max(a_ord) ELSE min(a_ord) END AS a_ord FROM a GROUP BY 1, 2),
lk AS (SELECT f.paper_id, f.student_ix, f.a_ord, f.status, regexp_replace(q.label, '[.:]$', '') AS label FROM final f JOIN q USING (paper_id, q_ord) WHERE f.a_ord IS NOT NULL),
rg AS (SELECT paper_id, student_ix, a_ord, pages, generate_subscripts(pages, 1) - 1 AS region, unnest(pages) AS page_number FROM a)
SELECT paper_id, student_ix, a_ord, CAST(region AS INT) AS region, page_number, 'muted' AS tone, NULL AS label, NULL AS note, 'Answer to question ' || label AS title
FROM rg JOIN lk USING (paper_id, student_ix, a_ord) ANTI JOIN ac USING (paper_id, student_ix, a_ord)
UNION ALL SELECT paper_id, student_ix, a_ord, CAST(region AS INT), page_number, CASE WHEN label IS NULL THEN 'unmatched' WHEN status = 'needs_review' THEN 'review' ELSE 'active' END,
  CASE WHEN list_position(pages, page_number) = region + 1 THEN coalesce(label, 'Unmatched') END,
  CASE WHEN len(list_distinct(pages)) > 1 AND region = len(pages) - 1 THEN 'continues · pages ' || array_to_string(list_sort(list_distinct(pages)), ', ') END, NULL
FROM rg SEMI JOIN ac USING (paper_id, student_ix, a_ord) LEFT JOIN lk USING (paper_id, student_ix, a_ord)""",
}
