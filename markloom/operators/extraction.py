"""Questions and answers from transcribed lines and blocks, by gaps and islands. Documents are told apart by doc_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from markloom.functions import labels as L
from markloom.functions import text as T

LINE_TOLERANCE, BLOCK_TOLERANCE, WIDE_GAP, UNSURE = 0.008, 0.01, 0.075, 0.45


def banded(rows: DataFrame, tolerance: float, number: str) -> DataFrame:
    """``rows`` with ``band``: rows of a page whose tops lie within the tolerance of the one before share one."""
    page = Window.partitionBy("doc_id", "page_number").orderBy("y", "x", number)
    step = (F.col("y") - F.lag("y").over(page) > tolerance).cast("long")
    stepped = rows.withColumn("_step", F.coalesce(step, F.lit(0)))
    return stepped.withColumn("band", F.sum("_step").over(page.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def _placed(rows: DataFrame, *within: str) -> DataFrame:
    """``rows`` with ``pos``: their place in the document from 0, by page, band and ``within``. Rows of a page are ordered on
    their own, and begin behind those of the pages before, whose number is a sum over one row per page."""
    own = F.row_number().over(Window.partitionBy("doc_id", "page_number").orderBy("band", *within)).cast("long")
    sizes = rows.groupBy("doc_id", "page_number").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("doc_id", "page_number", before.alias("_before"))
    return rows.withColumn("_own", own).join(starts, ["doc_id", "page_number"]).withColumn("pos", F.col("_before") + F.col("_own") - 1).drop("_before", "_own")


def reading_order(rows: DataFrame, tolerance: float, number: str) -> DataFrame:
    """``rows`` with ``band`` and ``pos``: rows of a band are read from left to right; ``pos`` counts from 0 over the
    document."""
    return _placed(banded(rows, tolerance, number), "x", number)


def split_inline(lines: DataFrame) -> DataFrame:
    """``lines`` (line_no, text, x, width) with ``part_no``: a line that holds several questions is a row for each (line_no
    becomes 100 line_no + part_no), with the share of the line's width that its characters have; others stay as they are."""
    found = lines.withColumn("_stripped", L.strip(F.col("text"))).withColumn("_parts", T.parts_of(F.col("_stripped"))).drop("_stripped")
    one = F.array(F.struct(F.lit(0).alias("part_no"), F.col("text").alias("part"), F.lit(0.0).alias("start"), F.lit(1.0).alias("end")))
    several = F.size("_parts") > 1
    rows = found.withColumn("_several", several).withColumn("_p", F.explode(F.when(several, apportioned(F.col("_parts"))).otherwise(one)))
    p = F.col("_p")
    return rows.withColumns({
        "part_no": p["part_no"], "text": p["part"], "line_no": F.when(F.col("_several"), F.col("line_no") * 100 + p["part_no"]).otherwise(F.col("line_no")),
        "x": F.when(F.col("_several"), F.col("x") + F.col("width") * p["start"]).otherwise(F.col("x")),
        "width": F.when(F.col("_several"), F.col("width") * (p["end"] - p["start"])).otherwise(F.col("width")),
    }).drop("_parts", "_several", "_p")


def question_lines(lines: DataFrame, tolerance: float = LINE_TOLERANCE) -> DataFrame:
    """The lines of question papers in reading order, those that hold several questions cut into their parts."""
    cut = split_inline(banded(lines, tolerance, "line_no").withColumns({"_x": F.col("x"), "_line": F.col("line_no")}))
    return _placed(cut, "_x", "_line", "part_no").drop("_x", "_line")


def with_question_starts(lines: DataFrame) -> DataFrame:
    """Lines in reading order (doc_id, pos, text) with section, marks, the leading label, ``starts`` and ``island``.

    A line opens a question if a label stands at its start and either enough text follows or a question is open
    already; furniture opens none, and heading-only or blank lines neither."""
    heading = F.regexp_extract(L.strip(F.col("text")), T.SECTION, 1)
    section, rest = T.section_heading(F.col("text"))
    read = L.with_leading_label(lines).withColumns({
        "_section": section, "_bare": (heading != "") & (F.coalesce(rest, F.lit("x")) == ""), "furniture": L.strip(F.col("text")).rlike(T.FURNITURE), "marks": T.detect_marks(F.col("text")),
    })
    order = Window.partitionBy("doc_id").orderBy("pos")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    may = (F.col("normalized") != "") & ~F.col("furniture") & ~F.col("_bare")
    alone = may & (F.length("rest") >= T.MIN_TEXT)
    opened = read.withColumn("_may", may).withColumn("_alone", alone)
    opened = opened.withColumn("_open", F.coalesce(F.max("_alone").over(before), F.lit(False)))
    starts = F.col("_may") & (F.col("_alone") | F.col("_open"))
    return (
        opened.withColumn("starts", starts)
        .withColumn("section", F.last("_section", True).over(upto))
        .withColumn("island", F.sum(F.col("starts").cast("long")).over(upto))
        .drop("_section", "_may", "_alone", "_open")
    )


def assemble_questions(marked: DataFrame) -> DataFrame:
    """One row per question island: doc_id, ord, question_id, label, normalized, text, marks, section, parent, page_number
    and the box of its lines on that page. Islands with too little text are dropped."""
    used = F.col("starts") | ~(F.col("furniture") | F.col("_bare") | (L.strip(F.col("text")) == ""))
    part = F.when(F.col("starts"), T.strip_marks(F.col("rest"))).when(used, T.strip_marks(F.col("text")))
    rows = marked.where("island > 0").withColumn("_part", part)
    firsts = F.min_by(F.struct("label", "normalized", "section", "page_number"), "pos").alias("f")
    first_page = Window.partitionBy("doc_id", "island").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_here", F.first("page_number").over(first_page) == F.col("page_number"))
    here = lambda c: F.when(F.col("_here"), c)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("_part").isNotNull(), F.struct("pos", "_part")))), lambda p: p["_part"]), " ")
    q = rows.groupBy("doc_id", "island").agg(
        firsts, L.strip(F.regexp_replace(joined, r"\s{2,}", " ")).alias("text"),
        F.min_by(F.when(F.col("furniture"), None).otherwise(F.col("marks")), F.when(F.col("marks").isNotNull() & ~F.col("furniture"), F.col("pos"))).alias("marks"),
        F.min(here(F.col("x"))).alias("x"), F.min(here(F.col("y"))).alias("y"),
        F.max(here(F.col("x") + F.col("width"))).alias("right"), F.max(here(F.col("y") + F.col("height"))).alias("bottom"), F.min("pos").alias("start"),
    )
    order = Window.partitionBy("doc_id").orderBy("start")
    same = Window.partitionBy("doc_id", "f.normalized").orderBy("start")
    n = F.row_number().over(same)
    base = F.concat(F.lit("q_"), F.col("f.normalized"))
    return q.where(F.length("text") >= T.MIN_TEXT).select(
        "doc_id", (F.row_number().over(order).cast("long") - 1).alias("ord"),
        F.when(n > 1, F.concat(base, F.lit("_"), n.cast("string"))).otherwise(base).alias("question_id"),
        F.regexp_replace("f.label", r"\s+", " ").alias("label"), F.col("f.normalized").alias("normalized"), "text", "marks",
        F.col("f.section").alias("section"), F.col("f.page_number").alias("page_number"), "x", "y", "right", "bottom",
    )


def sequence_looks_complete(questions: DataFrame) -> DataFrame:
    """doc_id, complete: at least three questions, numbers from 1 without gaps, and enough text in each."""
    main = F.regexp_extract("normalized", r"^(\d+)", 1).try_cast("long")
    q = questions.withColumn("_m", F.when(main > 0, main))
    s = q.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("_m").alias("d"), F.min("_m").alias("low"), F.max("_m").alias("top"), F.min(F.length("text")).alias("short")
    )
    done = (F.col("n") >= 3) & (F.col("d") >= 3) & (F.col("low") == 1) & (F.col("top") == F.col("d")) & (F.col("short") >= 3 * T.MIN_TEXT)
    return s.select("doc_id", F.coalesce(done, F.lit(False)).alias("complete"))


def parents_and_siblings(questions: DataFrame) -> DataFrame:
    """Each question's parent id (the last printed one of that label) and whether it has siblings or parts."""
    parsed = questions.withColumn("_p", L.canonical_label(F.col("normalized"))).withColumn("_parent", F.col("_p.parent"))
    last = questions.groupBy("doc_id", F.col("normalized").alias("_parent")).agg(F.max_by("question_id", "ord").alias("parent_id"))
    linked = parsed.join(last, ["doc_id", "_parent"], "left")
    parts = linked.where("parent_id IS NOT NULL").groupBy("doc_id", "parent_id").agg(F.count(F.lit(1)).alias("n_parts"))
    own = parts.select("doc_id", F.col("parent_id").alias("question_id"), F.col("n_parts").alias("_own"))
    both = linked.join(parts, ["doc_id", "parent_id"], "left").join(own, ["doc_id", "question_id"], "left")
    siblings = F.when(F.col("parent_id").isNotNull(), F.col("n_parts") > 1).otherwise(F.coalesce("_own", F.lit(0)) >= 1)
    return both.select("doc_id", "question_id", "parent_id", siblings.alias("has_siblings"))


def usable_blocks(blocks: DataFrame) -> DataFrame:
    return blocks.where(~F.col("struck_out") & (L.strip(F.col("text")) != ""))


def answer_islands(blocks: DataFrame) -> DataFrame:
    """Usable blocks in reading order with the label found and ``island``: the number of their answer.

    A block begins an answer if it is labelled or the first; on a new page unless it continues the text or both run over
    the page's edge; on the same page if it does not continue and stands wide apart."""
    o = reading_order(usable_blocks(blocks), BLOCK_TOLERANCE, "block_no")
    o = L.with_block_label(o)
    w = Window.partitionBy("doc_id").orderBy("pos")
    prev = lambda c: F.lag(c).over(w)
    turned = prev("page_number") != F.col("page_number")
    gap = F.col("y") - (prev("y") + prev("height"))
    new = (
        F.when(F.col("normalized").isNotNull() | prev("pos").isNull(), True)
        .when(F.col("is_continuation"), False)
        .when(turned, ~(prev("touches_bottom") & F.col("touches_top")))
        .otherwise(gap > WIDE_GAP)
    )
    return (
        o.withColumn("_new", new.cast("long"))
        .withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .select("doc_id", "pos", "page_number", "island", "confidence", "touches_bottom", "label", "normalized", "body")
    )


def assemble_answers(islands: DataFrame) -> DataFrame:
    """One row per answer: doc_id, island, label, normalized, text, pages, confidence (three places), appears_incomplete."""
    part = F.array_sort(F.collect_list(F.when(F.col("body") != "", F.struct("pos", "body"))))
    text = F.array_join(F.transform(part, lambda p: p["body"]), "\n")
    return islands.groupBy("doc_id", "island").agg(
        F.min_by(F.struct("label", "normalized"), "pos").alias("f"),
        L.strip(F.regexp_replace(text, r"\n{3,}", "\n\n")).alias("text"),
        F.array_sort(F.collect_set("page_number")).alias("pages"),
        F.round(F.sum(F.col("confidence").cast("decimal(9,4)")).cast("double") / F.count(F.lit(1)), 3).alias("confidence"),
        (F.max_by("touches_bottom", "pos") & (F.count_distinct("page_number") == 1)).alias("appears_incomplete"),
    ).select("doc_id", "island", "f.label", "f.normalized", "text", "pages", "confidence", "appears_incomplete")


# What a sheet's warnings say.
WARNINGS = {
    "capped": "Only the first %d of %d pages were processed.",
    "struck": "%d crossed-out region(s) were ignored.",
    "hard": "%d answer(s) were hard to read; their transcription may be inaccurate.",
    "blank": "No handwriting was detected on answer sheet page(s) %s.",
    "review": "%d answer(s) need review before you rely on the match.",
}


def sheet_warnings(blocks: DataFrame, answers: DataFrame, pages: DataFrame, reviews: DataFrame, most_pages: int) -> DataFrame:
    """doc_id and its warnings in order: pages beyond ``most_pages``, crossed-out regions, answers that were hard to read,
    blank pages (``pages``: doc_id, page_number, blank), answers that need review (``reviews``: doc_id, n_review)."""
    struck = blocks.groupBy("doc_id").agg(F.count_if("struck_out").alias("n_struck"))
    hard = answers.groupBy("doc_id").agg(F.count_if((F.col("confidence") > 0) & (F.col("confidence") < UNSURE)).alias("n_hard"))
    blank = F.array_sort(F.collect_list(F.when(F.col("blank"), F.col("page_number"))))
    seen = pages.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_pages"), blank.alias("blank"))
    said = F.array_compact(
        F.array(
            F.when(F.col("n_pages") > most_pages, F.format_string(WARNINGS["capped"], F.lit(most_pages), "n_pages")),
            F.when(F.col("n_struck") > 0, F.format_string(WARNINGS["struck"], "n_struck")),
            F.when(F.col("n_hard") > 0, F.format_string(WARNINGS["hard"], "n_hard")),
            F.when(F.size("blank") > 0, F.format_string(WARNINGS["blank"], F.array_join(F.col("blank").cast("array<string>"), ", "))),
            F.when(F.col("n_review") > 0, F.format_string(WARNINGS["review"], "n_review")),
        )
    )
    return struck.join(hard, "doc_id", "left").join(seen, "doc_id", "left").join(reviews, "doc_id", "left").select("doc_id", said.alias("warnings"))


def _let(value: Column, f) -> Column:
    """f(value), with the value computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def apportioned(parts: Column, step: int = 32) -> Column:
    """Each part of a line with its share of the line's width: array of (part_no, part, start, end). Lengths are summed up
    to every ``step``th part first, so that a part adds few numbers however long its line is."""

    def added(numbers: Column) -> Column:
        return F.aggregate(numbers, F.lit(0), lambda s, x: s + x)

    def shares(size: Column, heads: Column, total: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            row = F.floor(i / step).cast("int")
            upto = lambda s: F.struct(i.alias("part_no"), p.alias("part"), (s / total).alias("start"), ((s + F.length(p)) / total).alias("end"))
            return _let(F.get(heads, row) + added(F.slice(size, row * step + 1, i % step)), upto)

        return F.transform(parts, one)

    def summed(size: Column) -> Column:
        rows = F.sequence(F.lit(0), F.floor((F.size(size) - 1) / step).cast("int"))
        heads = lambda r: F.transform(r, lambda x, i: added(F.slice(r, F.lit(1), i)))
        return _let(
            F.transform(rows, lambda r: added(F.slice(size, r * step + 1, F.lit(step)))),
            lambda r: _let(F.struct(heads(r).alias("heads"), added(r).alias("total")), lambda t: shares(size, t["heads"], t["total"])),
        )

    return F.when(F.size(parts) > 0, _let(F.transform(parts, F.length), summed))
