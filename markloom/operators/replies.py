"""Replies of external readers and models as rows, and how they complete what was found without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.functions.labels import canonical_label, split_leading_label, strip
from markloom.functions.payload import Read, as_array, as_boolean, as_confidence, as_number, as_string, field, is_object, plain_json, read_fields, repair_json, share, with_value
from markloom.functions.text import MIN_TEXT, strip_marks
from markloom.operators.review import to_evaluation
from markloom.sources.shared import settle

SUGGESTED_MOST = 0.78
NO_FEEDBACK = "No feedback was generated."


def reply_rows(replies: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, seq, r: VARIANT): the objects of a reply's array: its field ``name``, or where there is none the reply itself; of
    an object its first property that is an array. Replies without any give none. The JSON is parsed once."""
    found = with_value(replies.select(*keys, repair_json(F.col("reply")).alias("_payload")), "_payload", "_value")
    return _objects(found, keys, name).where(is_object(F.col("r")))


def _objects(found: DataFrame, keys: list[str], name: str) -> DataFrame:
    """(keys, seq, r: VARIANT): what stands in the array of replies (keys, _payload, _value); one row without r for a reply without any."""
    own = found.withColumn("_own", field(F.col("_value"), name))
    told = F.col("_own").isNotNull() | F.coalesce(F.array_contains(F.json_object_keys("_payload"), name), F.lit(False))
    chosen = own.withColumns({"_from": F.when(told, F.col("_own")).otherwise(F.col("_value")), "_text": F.when(told & is_object(F.col("_own")), F.to_json("_own")).otherwise(F.col("_payload"))})
    listed = chosen.select(*keys, as_array(F.col("_from"), F.col("_text")).alias("_rows")).select(*keys, F.posexplode_outer("_rows").alias("seq", "r"))  # a plain one infers a filter that reads replies twice
    return listed.withColumn("seq", F.col("seq").cast("bigint"))


def _text(value: Read) -> Column:
    """A field as trimmed text; empty where it is none."""
    return strip(F.coalesce(as_string(value), F.lit("")))


def whole(number: Column) -> Column:
    """The number as a long if it has no fraction, else null."""
    return F.when((number == F.floor(number)) & (F.abs(number) < 2**53), number.cast("bigint"))


def region_rows(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Regions read (keys, index, text, label, confidence, is_continuation, struck_out): rows need a whole number as index; of
    several with one index the last counts; a label that says null is none."""
    rows, f = read_fields(reply_rows(replies, keys, "regions"), "r", ["index", "text", "label", "confidence", "isContinuation", "struckOut"])
    read = rows.select(
        *keys, "seq", whole(as_number(f["index"])).alias("index"), _text(f["text"]).alias("text"), _text(f["label"]).alias("label"),
        as_confidence(f["confidence"], 0.6).alias("confidence"), as_boolean(f["isContinuation"]).alias("is_continuation"), as_boolean(f["struckOut"]).alias("struck_out"),
    ).where("index IS NOT NULL")
    last = read.groupBy(*keys, "index").agg(F.max_by(F.struct("text", "label", "confidence", "is_continuation", "struck_out"), "seq").alias("x"))
    named = F.when((F.col("x.label") != "") & (F.lower("x.label") != "null"), F.col("x.label"))
    return last.select(*keys, "index", "x.text", named.alias("label"), "x.confidence", "x.is_continuation", "x.struck_out")


def suggested_matches(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Suggested pairs with confidence (0.5 if not said, 0.78 at most) and reason."""
    rows, f = read_fields(reply_rows(replies, keys, "matches"), "r", ["questionId", "answerId", "confidence", "reason"])
    return rows.select(
        *keys, "seq", whole(as_number(f["questionId"])).alias("q_ord"), whole(as_number(f["answerId"])).alias("a_ord"),
        F.least(F.lit(SUGGESTED_MOST), as_confidence(f["confidence"], 0.5)).alias("confidence"),
        F.coalesce(F.nullif(_text(f["reason"]), F.lit("")), F.lit("Matched by AI reasoning over the answer's content.")).alias("reason"),
    )


def clean_points(points: Column, most: int = 5) -> Column:
    return F.slice(F.filter(F.transform(F.coalesce(points, F.array().cast("array<string>")), strip), lambda p: p != ""), 1, most)


def model_answers(replies: DataFrame, keys: list[str], targets: DataFrame) -> DataFrame:
    """Expected answers for target questions (keys, q_ord) only; empty ones are dropped, key points cleaned."""
    rows, f = read_fields(reply_rows(replies, keys, "answers"), "r", ["questionId", "answer"])
    points = F.try_variant_get(field(F.col("r"), "keyPoints"), "$", "array<variant>")
    read = rows.select(
        *keys, whole(as_number(f["questionId"])).alias("q_ord"), _text(f["answer"]).alias("answer"),
        clean_points(F.transform(points, lambda p: F.coalesce(as_string(Read.of(p)), F.lit("")))).alias("key_points"),
    )
    return settle(read.where("answer <> ''")).join(targets, [*keys, "q_ord"], "left_semi")


def structure_rows(replies: DataFrame, keys: list[str]) -> DataFrame:
    """Questions that a reply names (keys, seq, label, normalized, start_line, end_line, reply_marks, reply_section), those whose
    label can be read. The end line is the start line where none is said; marks count if they are above 0."""
    rows, f = read_fields(reply_rows(replies, keys, "questions"), "r", ["label", "startLine", "endLine", "marks", "section"])
    read = rows.select(
        *keys, "seq", _text(f["label"]).alias("label"), as_number(f["startLine"]).alias("_s"), as_number(f["endLine"]).alias("_e"), as_number(f["marks"]).alias("_m"),
        F.nullif(_text(f["section"]), F.lit("")).alias("reply_section"),
    )
    start = whole(F.coalesce("_s", F.lit(-1.0)))
    named = read.withColumn("normalized", canonical_label(F.col("label"))["normalized"]).where("normalized <> ''")
    return settle(named.select(
        *keys, "seq", "label", "normalized", start.alias("start_line"), F.coalesce(whole(F.col("_e")), start).alias("end_line"),
        F.when(F.col("_m") > 0, F.col("_m").cast("bigint")).alias("reply_marks"), "reply_section",
    ))


RANGE_BUCKET = 64


def range_texts(rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, body): the trimmed texts of the lines (keys, line_no, text) from start_line to end_line of each row, joined in
    order. An interval join: rows meet lines by buckets of line numbers, so a long document is dealt by its parts."""
    bucket = lambda c: F.floor(F.col(c) / RANGE_BUCKET)
    spans = rows.select(*keys, "seq", "start_line", "end_line", F.explode(F.sequence(bucket("start_line"), bucket("end_line"))).alias("_b"))
    met = spans.join(lines.select(*keys, "line_no", "text", bucket("line_no").alias("_b")), [*keys, "_b"]).where("line_no BETWEEN start_line AND end_line")
    texts = F.array_sort(F.collect_list(F.struct("line_no", strip(F.col("text")).alias("t"))))
    return met.groupBy(*keys, "seq").agg(F.array_join(F.transform(texts, lambda x: x["t"]), " ").alias("body"))


def merge_structure(drafts: DataFrame, rows: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Drafts (keys, normalized, marks, section, text) completed by a reply's ``rows`` (see ``structure_rows``) over ``lines`` (keys,
    line_no from 0, text).

    A known label gains only what it lacks: the first marks and the first section said of it. A new label whose start line
    exists becomes a draft with the text of its lines, up to the last there is, without label and marks, if that is long
    enough; later rows of the label complete it like others."""
    on = [*keys, "normalized"]
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    said = rows.join(drafts, on, "left_semi").groupBy(*on).agg(first("reply_marks"), first("reply_section"))
    complete = lambda own, other: F.coalesce(F.when(F.col(own) != 0, F.col(own)), F.col(other)).alias(own)
    enriched = drafts.join(said, on, "left").select(*on, complete("marks", "reply_marks"), F.coalesce("section", "reply_section").alias("section"), "text")
    n = lines.groupBy(*keys).agg((F.max("line_no") + 1).alias("_n"))
    new = rows.join(drafts, on, "left_anti").join(n, keys)
    spans = new.where("start_line >= 0 AND start_line < _n").withColumn("end_line", F.least(F.col("_n") - 1, F.greatest("start_line", "end_line")))
    rest = split_leading_label(F.col("body"))["rest"]
    bodies = settle(range_texts(spans, lines, keys).withColumn("rest", rest))
    texts = bodies.withColumn("text", strip_marks(F.when(F.col("rest") != "", F.col("rest")).otherwise(F.col("body")))).where(F.length("text") >= MIN_TEXT)
    long = new.join(texts.select(*keys, "seq", "text"), [*keys, "seq"])
    opens = F.min("seq").over(Window.partitionBy(*on))
    adding = long.withColumn("_o", opens).where("seq = _o").select(*on, "_o", "text")
    later = new.join(adding, on).where("seq >= _o").groupBy(*on, "text").agg(first("reply_marks"), first("reply_section"))
    return enriched.unionByName(later.select(*on, F.col("reply_marks").alias("marks"), F.col("reply_section").alias("section"), "text"))


GRADE = ["questionId", "marksObtained", "maxMarks", "evaluation", "feedback", "confidence", "requiresReview"]


def _grade_texts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, seq, question_no, _g): the number of the question that a row of a reply names, and the texts of its other fields."""
    rows, f = read_fields(rows, "r", GRADE)
    asked = rows.withColumn("_id", as_number(f["questionId"]))
    other = (*(F.col("_t")[n].alias(n) for n in GRADE if n not in ("questionId", "evaluation", "feedback")), *(as_string(f[n]).alias(n) for n in ("evaluation", "feedback")))
    return asked.select(*keys, "seq", whole(F.col("_id")).alias("question_no"), F.struct(*other).alias("_g"))


def _read_grades(replies: DataFrame, keys: list[str]) -> DataFrame:
    """``_grade_texts`` of replies. Those that are plain JSON, alone or in a fence, are read without Python; what cannot be read
    so is written beside their rows, and only that is searched for its JSON."""
    plain = replies.select(*keys, "reply", plain_json(F.col("reply")).alias("_payload")).withColumn("_value", F.try_parse_json("_payload"))
    unread = plain.withColumn("_unread", F.when(F.col("_value").isNull(), F.col("reply")))
    rows = _objects(unread, [*keys, "_unread"], "grades")  # what is no object names no question
    # written once: joins push filters on the key below the reading, which then would happen twice
    read = settle(_grade_texts(rows, [*keys, "_unread"]))
    rest = read.where("_unread IS NOT NULL").select(*keys, F.col("_unread").alias("reply"))
    return read.where("_unread IS NULL").drop("_unread").unionByName(settle(_grade_texts(reply_rows(rest, keys, "grades"), keys)))


def grade_rows(replies: DataFrame, keys: list[str], targets: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Grades of the questions asked (``targets``: keys, question_no, printed_marks, needs_review), from replies (keys, ``also``,
    reply): rows for other questions are dropped, and of several for one the last counts. The maximum is the reply's, else
    the printed one, else 1, and 1 at least; marks are clamped to it. Fields are read as numbers in the rows that count only."""
    known = _read_grades(replies, [*keys, *(also or [])]).join(targets, [*keys, "question_no"])
    fields = ("_g", "printed_marks", "needs_review")
    last = known.groupBy(*keys, "question_no").agg(F.max_by(F.struct(*fields), F.struct(*(also or []), "seq")).alias("x")).select(*keys, "question_no", "x.*")
    of = lambda n: Read(F.col("_g")[n], F.lit(None))
    read = last.withColumns({"_marks": as_number(of("marksObtained")), "_max": as_number(of("maxMarks")), "_sure": as_number(of("confidence")), "_said": strip(F.coalesce("_g.feedback", F.lit("")))})
    top = F.greatest(F.lit(1.0), F.coalesce("_max", F.col("printed_marks").cast("double"), F.lit(1.0)))
    return read.select(
        *keys, "question_no", F.least(top, F.greatest(F.lit(0.0), F.coalesce("_marks", F.lit(0.0)))).alias("marks"), top.alias("max_marks"),
        to_evaluation(F.col("_g.evaluation")).alias("evaluation"), F.coalesce(F.nullif("_said", F.lit("")), F.lit(NO_FEEDBACK)).alias("feedback"),
        share(F.col("_sure"), 0.6).alias("confidence"), (as_boolean(of("requiresReview")) | F.coalesce("needs_review", F.lit(False))).alias("requires_review"),
    )
