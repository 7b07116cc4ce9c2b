"""Columns over question and answer text: marks, sections, inline starts, tokens, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from markloom.functions.labels import strip

# How marks, sections and furniture are printed, and words without weight.
MARKS = (r"\[\s*(\d{1,3})\s*(?:marks?|m)?\s*\]", r"\(\s*(\d{1,3})\s*marks?\s*\)", r"\b(\d{1,3})\s*marks?\b")
SECTION = r"(?i)^\s*(section|part)\s+([a-z0-9]{1,4})\b\s*[-–—:.]?\s*(.*)$"
FURNITURE = (
    r"(?i)^(page\s*\d+|\d+\s*of\s*\d+|time\s*[:\-]|max(?:imum)?\s*marks|general\s+instructions?"
    r"|all\s+questions?\s+are|answer\s+(?:all|any)\b)"
)
INLINE = r"(?:Q\s*)?\d{1,3}\s*(?:\([a-zA-Z]{1,4}\)|[.)])\s+[A-Z(]"
NAME_NOISE = (
    r"(?i)\b(answer|answers|answersheet|sheet|sheets|scan|scanned|copy|final|submission|paper|page|pages|doc|document"
    r"|img|image|photo|file|upload|uploaded)\b"
)
STOPWORDS = (
    "a an the and or but if of to in on for with is are was were be been being it its this that these those as at by from "
    "into than then there here which who whom what when where why how all any both each some such no not only own same so "
    "too very can will just do does did has have had we you your their they explain describe define state write give list "
    "discuss following briefly short note answer question marks"
).split()
MIN_TEXT = 3


def detect_marks(text: Column) -> Column:
    """Marks between 1 and 100: of each pattern in turn the first hit is looked at; null if none is in range."""
    found = [F.when(may, F.regexp_extract(text, "(?i)" + p, 1)).try_cast("int") for p, may in zip(MARKS, _may_hold(text), strict=True)]
    return F.coalesce(*(F.when(m.between(1, 100), m) for m in found))


def _may_hold(text: Column) -> tuple[Column, Column, Column]:
    """For each marks pattern, whether the text has what no hit can lack; most lines have none of it, and are not searched."""
    word = F.contains(F.lower(text), F.lit("mark"))
    return F.contains(text, F.lit("[")), word, word


def strip_marks(text: Column) -> Column:
    """The first hit of each marks pattern replaced by a space, runs of white space made one, ends trimmed."""
    bracket, word, _ = _may_hold(text)
    one, two, three = (lambda t, p=p: F.regexp_replace(t, f"(?is)^(.*?)(?:{p})", "$1 ") for p in MARKS)
    text = F.when(bracket, one(text)).otherwise(text)
    text = F.when(word, three(two(text))).otherwise(text)  # what the first takes away holds no such word, or is a space now
    return strip(F.regexp_replace(text, r"\s{2,}", " "))


def section_heading(line: Column) -> tuple[Column, Column]:
    """(``Section B`` or null, rest of the heading line); longer rests make no heading."""
    text = strip(line)
    word, code, rest = (F.regexp_extract(text, SECTION, i) for i in (1, 2, 3))
    heading = (word != "") & (F.length(strip(rest)) < 60)
    return F.when(heading, F.concat_ws(" ", F.initcap(word), F.upper(code))), F.when(heading, strip(rest))


# Fixed value: a note of marks that may stand between two questions.
NOTE = r"(?i)\s*(?:\[\s*\d{1,3}\s*(?:marks?|m)?\s*\]|\(\s*\d{1,3}\s*marks?\s*\))\s*$"
CUT = "\u0001"  # set between pieces; no line holds it


def inline_parts(text: Column) -> Column:
    """The line cut where a further question starts: at a number token before a capital or bracket that follows white
    space and an ended sentence or note. Each piece is trimmed; empty ones are dropped."""
    return parts_of(strip(text))


def parts_of(line: Column) -> Column:
    """``inline_parts`` of a line without white space at its ends; one without a token to cut at is looked through once."""
    pieces = F.split(F.regexp_replace(line, rf"(\s)({INLINE})", f"$1{CUT}$2"), CUT)

    def ended(before: Column) -> Column:
        left = F.regexp_replace(F.regexp_replace(before, NOTE, ""), r"\s+$", "")
        return left.rlike(r"[.?!\])]$")

    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))
    glued = F.aggregate(
        pieces,
        empty,
        lambda acc, p: F.when(
            ended(F.concat(F.array_join(acc["done"], ""), acc["open"])),
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), p.alias("open")),
        ).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], p).alias("open"))),
        lambda acc: F.concat(acc["done"], F.array(acc["open"])),
    )
    whole = F.when(line == "", F.array().cast("array<string>")).otherwise(F.array(line))
    return F.when(line.rlike(rf"\s{INLINE}"), F.filter(F.transform(glued, strip), lambda p: p != "")).otherwise(whole)


def tokenize(text: Column) -> Column:
    """Lower-case words of [a-z0-9] longer than two characters that are no stop words, repeats kept."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))
    return F.filter(words, lambda w: ~w.isin(*STOPWORDS))


def student_name(file_name: Column, index: Column) -> Column:
    """A person's name from an uploaded file's name; ``Student n`` where nothing of a name is left."""
    bare = F.regexp_replace(file_name, r"(?i)\.[a-z0-9]+$", "")
    bare = F.regexp_replace(bare, r"(?<!\d)\d{4}[-/.]\d{1,2}[-/.]\d{1,2}(?!\d)", " ")
    bare = F.regexp_replace(F.regexp_replace(bare, r"[_\-.+]+", " "), NAME_NOISE, " ")
    bare = F.regexp_replace(bare, r"(?i)(?<![0-9a-z])[0-9a-f]{8,}(?![0-9a-z])", " ")
    bare = strip(F.regexp_replace(bare, r"\s{2,}", " "))
    words = F.regexp_extract_all(bare, F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    titled = F.array_join(
        F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, F.lit(2), F.length(w))))), ""
    )
    short = F.when(F.length(titled) > 48, F.concat(F.regexp_replace(F.substring(titled, 1, 45), r"\s+$", ""), F.lit("…"))).otherwise(titled)
    return (
        F.when(bare == "", F.format_string("Student %d", index + 1))
        .when(bare.rlike(r"^\d+$"), F.concat(F.lit("Student "), bare))
        .otherwise(short)
    )
