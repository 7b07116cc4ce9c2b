"""Grades, replies, teacher edits and the views over them. A sheet is (paper_id, student_ix)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.sources.shared import settle

SHEET = ["paper_id", "student_ix"]
ROW = [*SHEET, "question_no"]
VERDICTS = ("correct", "partial", "incorrect", "not_attempted")


def to_evaluation(value: Column) -> Column:
    """One of the four verdicts; what cannot be read is partial."""
    v = F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"\s+", "_")
    return F.when(v.isin(*VERDICTS), v).otherwise("partial")


def latest_edits(edits: DataFrame) -> DataFrame:
    """Last write per question of a sheet by ``seq``; a revert leaves none. Holds in whatever order the writes arrive."""
    last = (
        edits.where("kind IN ('edit', 'revert')").groupBy(*ROW)
        .agg(F.max_by(F.struct("kind", "marks", "feedback"), "seq").alias("e"))
    )
    return last.where("e.kind = 'edit'").select(*ROW, F.col("e.marks").alias("edit_marks"), F.col("e.feedback").alias("edit_feedback"))


def grade_in_force(rows: DataFrame) -> DataFrame:
    """``rows`` with the grade that counts in place of the original (marks, max_marks, evaluation, feedback, confidence,
    requires_review; null where nothing was graded), ``original_marks`` and ``edited``.

    An edit (edit_marks or edit_feedback) has marks clamped to 0..maximum (the grade's, else printed_marks, else 1), the
    verdict that follows from the marks, its own feedback or else the grade's, confidence 1, and needs no review. An
    empty edit is none; rows without an edit are as they were."""
    edited = F.col("edit_marks").isNotNull() | F.col("edit_feedback").isNotNull()
    top = F.coalesce("max_marks", F.col("printed_marks").cast("double"), F.lit(1.0))
    given = F.when(F.col("edit_marks").isNotNull(), F.least(top, F.greatest(F.lit(0.0), F.col("edit_marks")))).otherwise(F.coalesce("marks", F.lit(0.0)))
    stays = F.coalesce("evaluation", F.lit("incorrect")) == "not_attempted"
    verdict = F.when(given >= top, "correct").when(given > 0, "partial").when(stays, "not_attempted").otherwise("incorrect")
    changed = {
        "marks": given, "max_marks": top, "evaluation": verdict, "feedback": F.coalesce("edit_feedback", "feedback", F.lit("")),
        "confidence": F.lit(1.0), "requires_review": F.lit(False),
    }
    new = {c: F.when(edited, v).otherwise(F.col(c)) for c, v in changed.items()}
    return rows.withColumns({"original_marks": F.col("marks"), "edited": edited, **new}).drop("edit_marks", "edit_feedback")


def apply_edits(grades: DataFrame, edits: DataFrame) -> DataFrame:
    """The grades in force of ``grades`` under the latest ``edits`` (paper_id, student_ix, question_no)."""
    kept = grades.join(edits, ROW, "left")
    return grade_in_force(kept).select(
        *ROW, "original_marks", "max_marks", "marks", "evaluation", "feedback", "confidence", "edited", "requires_review"
    )


NO_MAPPING = "No mapping was produced for this question."


def question_rows(
    questions: DataFrame, sheets: DataFrame, mappings: DataFrame, answers: DataFrame, grades: DataFrame, model_answers: DataFrame, edits: DataFrame
) -> DataFrame:
    """Every question of a paper for every sheet of it, in printed order, with its mapping (or the default: unanswered),
    linked answer, grade in force, and expected answer: paper_id, student_ix, q_ord, label, text, section, printed_marks,
    a_ord, match_confidence, band, status, methods, reasons, answer_text, pages, multi_page, original_marks, marks,
    max_marks, evaluation, feedback, confidence, requires_review, edited, model_answer, key_points."""
    q = questions.select("paper_id", "q_ord", "label", "text", "section", F.col("marks").alias("printed_marks"))
    m = mappings.select(*SHEET, "q_ord", "a_ord", F.col("confidence").alias("match_confidence"), "band", "status", "methods", "reasons")
    a = answers.select(*SHEET, "a_ord", F.col("text").alias("answer_text"), F.array_sort(F.array_distinct("pages")).alias("pages"))
    g = grades.select(*SHEET, "q_ord", "marks", "max_marks", "evaluation", "feedback", F.col("grade_confidence").alias("confidence"), "requires_review")
    key = [*SHEET, "q_ord"]
    rows = (
        sheets.join(q, "paper_id").join(m, key, "left").join(a, [*SHEET, "a_ord"], "left").join(g, key, "left")
        .join(model_answers.select("paper_id", "q_ord", F.col("answer").alias("model_answer"), "key_points"), ["paper_id", "q_ord"], "left")
        .join(edits, key, "left")
    )
    texts = "array<string>"
    filled = rows.withColumns({
        "match_confidence": F.coalesce("match_confidence", F.lit(0.0)), "band": F.coalesce("band", F.lit("none")), "status": F.coalesce("status", F.lit("unanswered")),
        "methods": F.coalesce("methods", F.array().cast(texts)), "reasons": F.coalesce("reasons", F.array(F.lit(NO_MAPPING))),
        "pages": F.coalesce("pages", F.array().cast("array<int>")),
    })
    return grade_in_force(filled).withColumn("multi_page", F.size("pages") > 1)


def exact_sum(value: Column) -> Column:
    """The sum of doubles rounded once, the same in whatever order the rows come: added one by one they differ in the last place, and
    a share that lies on a half falls to either side. Two values add up as ever. Values are summed as whole numbers of 2^-20 and, for
    the rest, of 2^-62; where one is too large or too fine for that, all are added as doubles."""
    scaled = value * 2.0**20
    rest = (scaled - F.floor(scaled)) * 2.0**42
    fits = (F.abs(value) < 2.0**32) & (rest == F.floor(rest))
    high, low = F.try_sum(F.when(fits, F.floor(scaled))), F.try_sum(F.when(fits, F.floor(rest)))
    high, low = F.try_add(high, F.shiftright(low, 42)), low.bitwiseAND(F.lit(2**42 - 1))
    whole = F.bool_and(fits) & (F.abs(high) < 2**53)
    return F.when(whole, (high + low * 2.0**-42) * 2.0**-20).otherwise(F.sum(value))


def grade_summary(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Marks, maximum and rounded percentage of what was graded per key; 0 percent of a maximum of 0; keys without a grade
    have no row. Sums do not depend on the order of the rows."""
    total = (exact_sum(F.col(c)).alias(t) for c, t in (("marks", "marks_obtained"), ("max_marks", "max_marks")))
    s = rows.where("marks IS NOT NULL").groupBy(*keys).agg(*total)
    share = F.when(F.col("max_marks") > 0, F.col("marks_obtained") / F.col("max_marks") * 100).otherwise(0.0)
    return s.withColumn("percentage", F.floor(share + 0.5).cast("bigint"))


ROWS_A_TASK = 200_000


def deal(rows: DataFrame, at_most: int, keys: list[str]) -> DataFrame:
    """``rows`` dealt by ``keys`` over as many tasks as keep each at some ``ROWS_A_TASK`` of the ``at_most`` rows."""
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-at_most // ROWS_A_TASK))
    return rows.repartition(tasks, *keys)


def class_rollup(rows: DataFrame, at_most: int) -> DataFrame:
    """(paper_id, student_ix, marks, n) per sheet, per paper (no student) and over all (neither): sheets are summed first, dealt
    over as many tasks as keep each at some ``ROWS_A_TASK`` of the ``at_most`` rows, and the others are sums of theirs. A plain
    rollup holds every row three times over in the table of a task, which grows with the input."""
    dealt = deal(rows.select(*SHEET, "marks"), at_most, SHEET)
    total = (F.sum("marks").alias("marks"), F.sum("n").alias("n"))
    sheets = settle(dealt.groupBy(*SHEET).agg(F.sum("marks").alias("marks"), F.count(F.lit(1)).alias("n")))
    papers = settle(sheets.groupBy("paper_id").agg(*total))
    none = lambda c: F.lit(None).cast(sheets.schema[c].dataType).alias(c)
    whole = papers.agg(*total).select(none("paper_id"), none("student_ix"), "marks", F.coalesce("n", F.lit(0)).alias("n"))
    return sheets.unionByName(papers.select("paper_id", none("student_ix"), "marks", "n")).unionByName(whole)


def grade_band(percentage: Column) -> Column:
    bands = ((90, "A+ Outstanding"), (80, "A Excellent"), (70, "B Good"), (60, "C Fair"), (40, "D Needs work"))
    out = F.lit("E Needs support")
    for least, name in reversed(bands):
        out = F.when(percentage >= least, name).otherwise(out)
    return out


def verdict_tallies(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(
        *(F.count_if(F.col("evaluation") == v).alias(v) for v in VERDICTS), F.count_if("edited").alias("edited")
    )


def filter_rows(rows: DataFrame, name: str) -> DataFrame:
    """all, answered (matched only), unanswered, review or edited."""
    tests = {"answered": "status = 'matched'", "unanswered": "status = 'unanswered'", "review": "status = 'needs_review'", "edited": "edited"}
    return rows if name == "all" else rows.where(tests[name])


def search_rows(rows: DataFrame, needle: str, columns: list[str]) -> DataFrame:
    """Rows whose columns, joined by spaces (null ones as empty), hold the needle in any case; a blank one finds all."""
    hay = F.lower(F.concat_ws(" ", *(F.coalesce(F.col(c), F.lit("")) for c in columns)))
    n = needle.strip().lower()
    return rows.where(hay.contains(n)) if n else rows


def plain_label(label: Column) -> Column:
    """Without a full stop or colon at the end."""
    return F.regexp_replace(label, "[.:]$", "")


def number_text(x: Column) -> Column:
    """Whole numbers without places."""
    return F.when(x == F.floor(x), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


def report_heading(row_marks: Column, max_marks: Column, evaluation: Column, edited: Column, label: Column, status: Column) -> Column:
    """``Q4  ·  3/5 marks  ·  Partially correct  ·  edited by teacher``; a dash where nothing is graded."""
    names = {"correct": "Correct", "partial": "Partially correct", "incorrect": "Incorrect", "not_attempted": "Not attempted"}
    verdict = F.coalesce(*(F.when(evaluation == k, v) for k, v in names.items()), F.when(status == "unanswered", "Unanswered"), F.lit("Not graded"))
    marks = F.concat(F.coalesce(F.concat(number_text(row_marks), F.lit("/"), number_text(max_marks)), F.lit("—")), F.lit(" marks"))
    return F.concat_ws("  ·  ", F.concat(F.lit("Q"), label), marks, verdict, F.when(edited, "edited by teacher"))


def _listed(rows: Column, n: int = 4) -> Column:
    """``label — the first 90 characters of the text`` of the first rows."""
    return F.slice(F.transform(rows, lambda r: F.concat(plain_label(r["label"]), F.lit(" — "), F.substring(r["text"], 1, 90))), 1, n)


def sheet_reviews(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """Per sheet its question rows in printed order (``rows``), ``strengths``: the first four that are right, and
    ``improvements``: the first four that are graded and not, or if there are none the areas of its summary (``summaries``:
    sheet, name, file_name, summary, improvement_areas). A sheet's questions bound the array."""
    row = F.struct("q_ord", "label", "text", "answer_text", "marks", "max_marks", "evaluation", "feedback", "edited", "status")
    per = rows.groupBy(*SHEET).agg(F.array_sort(F.collect_list(row)).alias("rows")).join(summaries, SHEET, "left")
    improve = _listed(F.filter("rows", lambda r: r["evaluation"].isin("incorrect", "partial", "not_attempted")))
    areas = F.coalesce("improvement_areas", F.array().cast("array<string>"))
    return per.withColumns({
        "strengths": _listed(F.filter("rows", lambda r: r["evaluation"] == "correct")),
        "improvements": F.when(F.size(improve) > 0, improve).otherwise(areas),
    })


def report_rows(rows: DataFrame, summaries: DataFrame) -> DataFrame:
    """(sheet, line, text): a sheet's report in order: header, score and tallies, four rows at most for each question,
    strengths, areas to improve, and overall feedback."""
    counts = verdict_tallies(rows, SHEET)
    total = grade_summary(rows, SHEET).withColumn("_band", grade_band(F.col("percentage")))
    s = sheet_reviews(rows, summaries).join(counts, SHEET).join(total, SHEET, "left")
    graded = F.col("marks_obtained").isNotNull()
    one = lambda *texts: F.array_compact(F.array(*(t if isinstance(t, Column) else F.lit(t) for t in texts)))
    letter, name = F.split("_band", " ", 2)[0], F.split("_band", " ", 2)[1]
    head = one(
        "EVALUATION REPORT", F.col("name"), F.col("file_name"),
        F.when(graded, F.concat(number_text(F.col("marks_obtained")), F.lit(" / "), number_text(F.col("max_marks")))).otherwise(
            F.lit("Automatic evaluation did not run for this student, so no marks were awarded.")
        ),
        F.when(graded, F.concat(F.col("percentage").cast("string"), F.lit("%   Grade "), letter, F.lit("   "), name)),
        F.when(graded, F.format_string("Correct %d  ·  Partial %d  ·  Incorrect %d  ·  Unanswered %d", "correct", "partial", "incorrect", "not_attempted")),
        F.when(graded & (F.col("edited") > 0), F.concat(F.col("edited").cast("string"), F.when(F.col("edited") == 1, " question").otherwise(" questions"), F.lit(" reviewed and adjusted by the teacher."))),
        "Question-wise evaluation",
    )

    def of_question(r: Column) -> Column:
        said = F.coalesce(r["answer_text"], F.lit(""))
        return one(
            report_heading(r["marks"], r["max_marks"], r["evaluation"], r["edited"], plain_label(r["label"]), r["status"]), r["text"],
            F.when(said != "", F.concat(F.lit("Answer: "), F.regexp_replace(said, r"\n+", " "))).otherwise(F.lit("Answer: not found on the sheet.")),
            F.when(r["feedback"] != "", F.concat(F.lit("Feedback: "), r["feedback"])),
        )

    bullets = lambda items, none: F.when(F.size(items) > 0, F.transform(items, lambda x: F.concat(F.lit("•  "), x))).otherwise(F.array(F.lit(none)))
    end = F.when(F.coalesce("summary", F.lit("")) != "", F.array(F.lit("Overall feedback"), F.col("summary"))).otherwise(F.array().cast("array<string>"))
    lines = F.concat(
        head, F.flatten(F.transform("rows", of_question)), one("Strengths"), bullets(F.col("strengths"), "No question was fully correct."),
        one("Areas to improve"), bullets(F.col("improvements"), "Nothing outstanding — every question scored full marks."), end,
    )
    return s.select(*SHEET, F.posexplode(lines).alias("line", "text")).withColumn("line", F.col("line").cast("bigint"))


def merge_grades(questions: DataFrame, replies: DataFrame) -> DataFrame:
    """Questions (sheet, question_no, printed_marks, attempted, needs_review) with the grader's replies (sheet,
    question_no, reply_marks, reply_max, reply_evaluation, reply_confidence, reply_review): unattempted ones get 0; an
    attempted one without a reply is held for review."""
    r = questions.join(replies, ROW, "left")
    has = F.col("reply_marks").isNotNull()
    top = F.greatest(F.lit(1.0), F.coalesce("reply_max", "printed_marks", F.lit(1.0)))
    return r.select(
        *ROW,
        F.when(F.col("attempted") & has, F.greatest(F.lit(0.0), F.least("reply_marks", top))).otherwise(0.0).alias("marks"),
        F.when(F.col("attempted") & has, top).otherwise(F.coalesce("printed_marks", F.lit(1.0))).alias("max_marks"),
        F.when(~F.col("attempted"), "not_attempted").when(has, to_evaluation(F.col("reply_evaluation"))).otherwise("partial").alias("evaluation"),
        F.when(~F.col("attempted"), 1.0).when(has, F.coalesce("reply_confidence", F.lit(0.6))).otherwise(0.0).alias("confidence"),
        (F.col("attempted") & (~has | F.coalesce("reply_review", F.lit(False)) | F.col("needs_review"))).alias("requires_review"),
    )
