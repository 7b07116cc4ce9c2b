"""Uploads, provider calls, batches and jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_BYTES, MOST_PAGES, MOST_SHEETS, N_STAGES = 10 * 1024 * 1024, 12, 20, 9
EXTENSIONS = (".pdf", ".png", ".jpg", ".jpeg")
MIME_TYPES = ("application/pdf", "image/png", "image/jpeg", "image/jpg")
ACTIONABLE = ("quota", "credentials", "misconfigured")

# What is said of a step that was skipped, by the kind of failure. {step} is its name, {Step} with a capital.
SENTENCES = {
    "quota": "The AI provider's quota ran out during this run, so {step} was skipped. Everything else completed normally — try again once the quota resets.",
    "credentials": "The AI provider rejected the configured key, so {step} was skipped. Check AI_API_KEY.",
    "misconfigured": "The AI provider rejected the request, so {step} was skipped. Check that AI_MODEL names a model this key can use.",
    "network": "The connection to the AI service dropped, so {step} was skipped. Trying again usually resolves it.",
    "provider_unavailable": "The AI model was temporarily overloaded, so {step} was skipped. Trying again usually resolves it.",
    "not_configured": "{Step} needs a configured AI provider, so it was skipped.",
    "unusable_response": "The AI service returned something unusable, so {step} was skipped.",
}


def extension(name: Column) -> Column:
    """From the last dot on, in lower case; empty without a dot."""
    return F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))


def is_pdf(name: Column, mime: Column, content: Column) -> Column:
    magic = F.instr(F.substring(content, 1, 1024), "%PDF-") > 0
    return (mime == "application/pdf") | (extension(name) == ".pdf") | magic


def upload_error(name: Column, mime: Column, size: Column, most: int = MOST_BYTES) -> Column:
    """The first rule that an upload breaks, null if none."""
    known = extension(name).isin(*EXTENSIONS) | mime.isin(*MIME_TYPES)
    return F.when(size == 0, "EMPTY_FILE").when(size > most, "TOO_LARGE").when(~known, "UNSUPPORTED_TYPE")


def failure_kind(status: Column, error_class: Column, body: Column, message: Column) -> Column:
    """Kind of a failed call from its status, class, body and message; null for a call that succeeded."""
    key = (status == 400) & F.lower(body).rlike(r"api[_ ]?key")
    return (
        F.when(status == 200, None)
        .when((error_class == "auth") | status.isin(401, 403) | key, "credentials")
        .when(error_class == "network", "network")
        .when(status == 429, "quota")
        .when(status >= 500, "provider_unavailable")
        .when(status >= 400, "misconfigured")
        .when(F.lower(message).rlike("fetch failed|timed out|econn|enotfound|network"), "network")
        .otherwise("unusable_response")
    )


def failure_sentence(kind: Column, step: Column) -> Column:
    """What is said of a skipped step; kinds that are not known count as unusable replies."""
    template = F.coalesce(*(F.when(kind == k, v) for k, v in SENTENCES.items()), F.lit(SENTENCES["unusable_response"]))
    capital = F.concat(F.upper(F.substring(step, 1, 1)), F.substring(step, F.lit(2), F.length(step)))
    return F.replace(F.replace(template, F.lit("{step}"), step), F.lit("{Step}"), capital)


# What a job that fails says, by cause; the stages that read questions and answers; and the last resort.
JOB_ERRORS = {
    "rate": ("PROVIDER_ERROR", "The AI service is rate limited right now. Wait a minute and try again — no credits were used for the incomplete pages.", True),
    "auth": ("PROVIDER_ERROR", "The AI provider rejected the configured credentials. Check AI_API_KEY in the deployment settings.", False),
    "rejected": ("PROVIDER_ERROR", "The AI provider rejected the request. Check that AI_MODEL names a model your key can use.", False),
    "overloaded": ("PROVIDER_ERROR", "The AI model is temporarily overloaded. This usually clears within a minute — please try again.", True),
    "dropped": ("PROVIDER_ERROR", "The connection to the AI service dropped before processing finished. Please try again.", True),
    "unreached": ("PROVIDER_ERROR", "The AI service could not be reached. Please try again in a moment.", True),
    "offline": ("PROVIDER_ERROR", "Offline OCR is not available in this environment. Set AI_API_KEY (Gemini or Anthropic) so documents can be read here.", False),
    "questions": ("QUESTION_EXTRACTION_FAILED", "Could not reliably extract the questions from this document. Check that the question paper is legible and try again.", True),
    "answers": ("ANSWER_EXTRACTION_FAILED", "Could not reliably read the answer sheet. Check that the scan is clear and try again.", True),
    "internal": ("INTERNAL", "Something went wrong while processing these files.", True),
}
QUESTION_STAGES = ("reading-question-paper", "detecting-questions")
ANSWER_STAGES = ("reading-answer-sheet", "detecting-answers")
OFFLINE = r"(?i)local ocr could not start|localocrunavailable"
DROPPED = r"(?i)\bfetch\b|network|timeout|timed out|abort|econn|enotfound|eai_again"


def job_error(error_class: Column, status: Column, message: Column, stage: Column) -> Column:
    """Struct (code, message, retryable) of a job that failed with an error of this class (document, auth, network, provider
    or other) in this stage. A document's own error keeps its message; causes at the provider come before the stage's
    wording, for a dropped connection says nothing about a scan."""
    provider = error_class.isin("auth", "network", "provider")
    cause = (
        F.when(provider & (status == 429), "rate")
        .when(error_class == "auth", "auth")
        .when(provider & status.between(400, 499) & (status != 408), "rejected")
        .when(provider & (status >= 500), "overloaded")
        .when(error_class == "network", "dropped")
        .when(provider, "unreached")
        .when(message.rlike(OFFLINE), "offline")
        .when(message.rlike(DROPPED), "dropped")
        .when(stage.isin(*QUESTION_STAGES), "questions")
        .when(stage.isin(*ANSWER_STAGES), "answers")
        .otherwise("internal")
    )
    own = F.struct(F.when(message.startswith("EMPTY_FILE"), "EMPTY_DOCUMENT").otherwise("INVALID_FILE").alias("code"), message.alias("message"), F.lit(False).alias("retryable"))
    said = F.coalesce(*(F.when(cause == k, F.struct(F.lit(c).alias("code"), F.lit(m).alias("message"), F.lit(r).alias("retryable"))) for k, (c, m, r) in JOB_ERRORS.items()))
    return F.when(error_class == "document", own).otherwise(said)


def provenance(runs: DataFrame) -> DataFrame:
    """sheet_id, id, model, degraded, local_mode of each run (requested, has_key, model, used_fallback): who read it. Without a
    key or on request the local reader does, and ``local_mode`` says which of the two it was; a run that fell back says
    no-key."""
    wanted = F.lower(F.trim(F.coalesce("requested", F.lit(""))))
    local = (wanted == "local") | ~F.col("has_key")
    chosen = F.when(local, "local").when(wanted == "anthropic", "anthropic").otherwise("gemini")
    by_local = F.col("used_fallback") | local
    mode = F.when(F.col("used_fallback"), "no-key").when(wanted == "local", "chosen").when(local, "no-key")
    return runs.select(
        "sheet_id", F.when(by_local, "local").otherwise(chosen).alias("id"), F.when(by_local, "tesseract-eng").otherwise(F.col("model")).alias("model"),
        by_local.alias("degraded"), mode.alias("local_mode"),
    )


NO_ANSWERS = ("ANSWER_EXTRACTION_FAILED", "No handwritten answers were detected on this sheet. Check that the scan is clear.", "No handwritten answers were detected on this sheet.")


def failed_sheets(questions: DataFrame, sheets: DataFrame) -> DataFrame:
    """One row per sheet (paper_id, sheet_ix, error_code or null, n_answers) that failed or has no answers: its error, counts,
    and ``unanswered_rows``: the orders of the questions that get an unanswered row (none on a failed sheet)."""
    n = questions.groupBy("paper_id").agg(F.count(F.lit(1)).alias("total"), F.array_sort(F.collect_list("q_ord")).alias("_all"))
    failed = F.col("error_code").isNotNull()
    zero = F.lit(0).cast("bigint")
    return sheets.where(failed | (F.col("n_answers") == 0)).join(n, "paper_id").select(
        "paper_id", "sheet_ix", F.coalesce("error_code", F.lit(NO_ANSWERS[0])).alias("error_code"), "total", zero.alias("answered"),
        F.col("total").alias("unanswered"), zero.alias("needs_review"), zero.alias("unmatched_answers"),
        F.when(failed, F.array().cast("array<bigint>")).otherwise(F.col("_all")).alias("unanswered_rows"),
        F.when(~failed, NO_ANSWERS[2]).alias("reason"),
    )


def page_highlights(answers: DataFrame, mappings: DataFrame, questions: DataFrame, active: DataFrame) -> DataFrame:
    """Regions to draw on the pages of every sheet: all regions of linked answers, quiet (muted), and of the sheet's ``active``
    answer, whose tone is unmatched, review or active; its label stands on its first region of each page, and a note on
    its last one where it runs over several pages."""
    sheet = ["paper_id", "student_ix"]
    plain = F.regexp_replace("label", "[.:]$", "")
    linked = mappings.where("a_ord IS NOT NULL").join(questions.select("paper_id", "q_ord", "label"), ["paper_id", "q_ord"]).select(*sheet, "a_ord", "status", plain.alias("label"))
    regions = answers.select(*sheet, "a_ord", "pages", F.posexplode("pages").alias("region", "page_number"))
    muted = regions.join(linked, [*sheet, "a_ord"]).join(active, [*sheet, "a_ord"], "left_anti")
    shown = regions.join(active, [*sheet, "a_ord"], "left_semi").join(linked, [*sheet, "a_ord"], "left")
    first = F.array_position("pages", F.col("page_number")) == F.col("region") + 1
    distinct = F.array_sort(F.array_distinct("pages"))
    last = (F.size(distinct) > 1) & (F.col("region") == F.size("pages") - 1)
    tone = F.when(F.col("label").isNull(), "unmatched").when(F.col("status") == "needs_review", "review").otherwise("active")
    none = F.lit(None).cast("string")
    key = [*sheet, "a_ord", "region", "page_number"]
    return muted.select(*key, F.lit("muted").alias("tone"), none.alias("label"), none.alias("note"), F.concat(F.lit("Answer to question "), "label").alias("title")).unionByName(
        shown.select(
            *key, tone.alias("tone"), F.when(first, F.coalesce("label", F.lit("Unmatched"))).alias("label"),
            F.when(last, F.concat(F.lit("continues · pages "), F.array_join(distinct.cast("array<string>"), ", "))).alias("note"), none.alias("title"),
        )
    )


def first_per_step(calls: DataFrame) -> DataFrame:
    """The first failure of each step of a sheet (by event_id)."""
    w = Window.partitionBy("sheet_id", "step_no").orderBy("event_id")
    return calls.where("kind IS NOT NULL").withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def lead_failure(firsts: DataFrame) -> DataFrame:
    """Per sheet the failure to show: the first that somebody can act on, else the first."""
    w = Window.partitionBy("sheet_id").orderBy((~F.col("kind").isin(*ACTIONABLE)).cast("int"), "event_id")
    return firsts.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def percent_done() -> Column:
    """Of the latest states of a job's stages: done and skipped count whole, any active half."""
    done = F.count_if(F.col("state").isin("done", "skipped")) + F.when(F.bool_or(F.col("state") == "active"), 0.5).otherwise(0.0)
    return F.floor(done * 100 / N_STAGES + 0.5).cast("bigint")


def stage_progress(latest: DataFrame) -> DataFrame:
    """job_id, percent from the latest state of each of a job's stages."""
    return latest.groupBy("job_id").agg(percent_done().alias("percent"))


MOST_TARGETS, MOST_LINE_CHARS = 20, 60_000
_SHEET = ["paper_id", "student_ix"]


def _joined(rows: DataFrame, keys: list[str], order: str, row: Column) -> DataFrame:
    """keys, n_rows, body: the row texts of a key in order, one below the other."""
    texts = F.transform(F.array_sort(F.collect_list(F.struct(order, row.alias("r")))), lambda x: x["r"])
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.array_join(texts, "\n").alias("body"))


def _asked(*more: Column) -> Column:
    """A question as graders and writers of model answers are asked about it."""
    head = (
        F.concat(F.lit("questionId: "), F.col("q_ord").cast("string")), F.concat(F.lit("label: "), F.col("label")),
        F.concat(F.lit("maxMarks: "), F.coalesce("marks", F.lit(1)).cast("string")), F.concat(F.lit("question: "), F.substring("text", 1, 800)),
    )
    return F.concat_ws("\n", *head, *more, F.lit("---"))


def requests(questions: DataFrame, answers: DataFrame, mappings: DataFrame, open_q: DataFrame, open_a: DataFrame, lines: DataFrame) -> DataFrame:
    """paper_id, student_ix, request, n_rows, text: what a sheet asks for. grading: questions with answers; model_answers: the
    first 20 unanswered ones; mapping: questions and answers still open, where there are both; structure: a document's lines."""
    asked = questions.select("paper_id", "q_ord", "label", "marks", "text")
    read = answers.select(*_SHEET, "a_ord", F.col("text").alias("a_text"), F.col("confidence").alias("reading"))
    every = mappings.select(*_SHEET, "q_ord", "a_ord", "status").join(asked, ["paper_id", "q_ord"])
    answer = (F.concat(F.lit("ocrConfidence: "), F.format_string("%.2f", "reading")), F.concat(F.lit("studentAnswer: "), F.substring("a_text", 1, 1500)))
    tried = _joined(every.join(read, [*_SHEET, "a_ord"]), _SHEET, "q_ord", _asked(*answer))
    first = F.row_number().over(Window.partitionBy(*_SHEET).orderBy("q_ord"))
    missing = every.where("status = 'unanswered'").withColumn("_n", first).where(F.col("_n") <= MOST_TARGETS)
    unanswered = _joined(missing, _SHEET, "q_ord", _asked())
    q_row = F.format_string('- id=%d label="%s" text="%s"', "q_ord", "label", F.substring("text", 1, 400))
    label = F.when(F.coalesce("label", F.lit("")) != "", F.concat(F.lit('"'), "label", F.lit('"'))).otherwise("none")
    a_row = F.format_string('- id=%d writtenLabel=%s text="%s"', "a_ord", label, F.substring("text", 1, 600))
    left = _joined(open_q, _SHEET, "q_ord", q_row)
    right = _joined(open_a, _SHEET, "a_ord", a_row).select(*_SHEET, F.col("n_rows").alias("_n"), F.col("body").alias("_body"))
    linked = left.join(right, _SHEET).select(
        *_SHEET, (F.col("n_rows") + F.col("_n")).alias("n_rows"),
        F.concat(F.lit("Unmatched questions:\n"), "body", F.lit("\n\nUnmatched answers (handwriting OCR, may contain errors):\n"), "_body").alias("body"),
    )
    written = lines.where(F.trim("text") != "").select(F.col("doc_id").alias("paper_id"), F.lit(None).cast("bigint").alias("student_ix"), "pos", "text")
    numbered = _joined(written, _SHEET, "pos", F.concat(F.col("pos").cast("string"), F.lit(": "), F.trim("text")))

    def named(rows: DataFrame, request: str, text: Column) -> DataFrame:
        return rows.select(*_SHEET, F.lit(request).alias("request"), "n_rows", text.alias("text"))

    said = lambda before, after: F.concat(F.lit(before), F.col("n_rows").cast("string"), F.lit(after), "body")
    return (
        named(tried, "grading", said("Mark the following ", " answers.\n\n"))
        .unionByName(named(unanswered, "model_answers", said("Write the expected answer for these ", " unanswered question(s).\n\n")))
        .unionByName(named(linked, "mapping", F.col("body")))
        .unionByName(named(numbered, "structure", F.concat(F.lit("Lines from the question paper, in printed order:\n\n"), F.substring("body", 1, MOST_LINE_CHARS))))
    )
