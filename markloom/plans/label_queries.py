"""Queries over labels and text, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from markloom.functions import labels as L
from markloom.functions import text as T
from markloom.sources.inputs import derived, with_inputs


def lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def sql_noise(x: str) -> str:
    once = lambda t: f"trim(regexp_replace({t}, {lit(L.NOISE)}, ''))"
    return once(once(f"trim({x})"))


def sql_parse(t: str) -> dict[str, str]:
    main = f"CAST(TRY_CAST(regexp_extract({t}, '{L.HEAD}', 1) AS INT) AS VARCHAR)"
    tail = f"substring({t}, length(regexp_extract({t}, '{L.HEAD}', 1)) + 1)"
    inside = f"regexp_extract({tail}, {lit(L.BRACKETED)}, 1)"
    beside = f"lower(regexp_extract({tail}, {lit(L.ATTACHED)}, 1))"
    sub = (
        f"CASE WHEN {inside} <> '' THEN lower({inside}) WHEN length({beside}) = 1 OR ({beside} <> '' AND "
        f"regexp_matches({beside}, {lit(L.ROMAN)})) THEN {beside} END"
    )
    return {"main": main, "sub": f"CASE WHEN {main} IS NOT NULL THEN {sub} END"}


def sql_labels(source: str, raw: str, keys: str, name: str, repair: bool = True) -> str:
    """CTEs that end in ``name``: the rows of ``source`` with normalized, main, sub, parent of ``raw``."""
    a, b = sql_parse("clean"), sql_parse("again")
    token = "regexp_extract(clean, '^[a-zA-Z0-9]{1,4}')"
    again = f"translate({token}, '{L.READ_AS[0]}', '{L.READ_AS[1]}') || substring(clean, length({token}) + 1)" if repair else "''"
    return f"""{name}_1 AS (SELECT {keys}, {sql_noise(f"coalesce({raw}, '')")} AS clean FROM {source}),
{name}_2 AS (SELECT *, {again} AS again FROM {name}_1),
{name}_3 AS (SELECT *, {a['main']} AS m1, {a['sub']} AS s1, {b['main']} AS m2, {b['sub']} AS s2 FROM {name}_2),
{name} AS (SELECT * EXCLUDE (clean, again, m1, s1, m2, s2),
  CASE WHEN m1 IS NOT NULL THEN m1 || coalesce(s1, '') WHEN m2 IS NOT NULL THEN m2 || coalesce(s2, '') ELSE '' END AS normalized,
  coalesce(m1, m2, '') AS main, CASE WHEN m1 IS NOT NULL THEN s1 ELSE s2 END AS sub,
  CASE WHEN m1 IS NOT NULL AND s1 IS NOT NULL THEN m1 WHEN m1 IS NULL AND s2 IS NOT NULL THEN m2 END AS parent FROM {name}_3)"""


def sql_leading(source: str, line: str, keys: str, name: str) -> str:
    """CTEs that end in ``name``: rows of ``source`` with label, normalized, rest of ``line``."""
    first = f"""{name}_0 AS (SELECT {keys}, trim({line}) AS t, trim(regexp_extract(trim({line}), {lit(L.LEADING)}, 1)) AS lab,
  length(regexp_extract(trim({line}), {lit(L.LEADING)})) AS n FROM {source}),
"""
    return first + sql_labels(f"{name}_0", "lab", f"{keys}, t, lab, n", f"{name}_p") + f""",
{name} AS (SELECT {keys}, CASE WHEN lab <> '' AND normalized <> '' THEN lab END AS label,
  CASE WHEN lab <> '' THEN normalized ELSE '' END AS normalized,
  CASE WHEN lab <> '' AND normalized <> '' THEN trim(substring(t, n + 1)) ELSE t END AS rest FROM {name}_p)"""


def sql_marks(x: str) -> str:
    one = [f"TRY_CAST(regexp_extract({x}, {lit('(?i)' + p)}, 1) AS INT)" for p in T.MARKS]
    return "coalesce(" + ", ".join(f"CASE WHEN {m} BETWEEN 1 AND 100 THEN {m} END" for m in one) + ")"


def sql_strip_marks(x: str) -> str:
    for p in T.MARKS:
        x = f"regexp_replace({x}, {lit('(?i)' + p)}, ' ')"
    return f"trim(regexp_replace({x}, '\\s{{2,}}', ' ', 'g'))"


def questions(spark, sf_dir):
    return derived(spark, sf_dir, "questions_in")


def answers(spark, sf_dir):
    return derived(spark, sf_dir, "answers_in")


def lines(spark, sf_dir):
    return derived(spark, sf_dir, "lines_in")


def strip_label_noise(spark, sf_dir):
    return questions(spark, sf_dir).select("paper_id", "ord", L.strip_label_noise(F.col("raw_label")).alias("label"))


def _struct(df, raw, *keys, repair=True):
    return df.select(*keys, L.canonical_label(F.col(raw), repair).alias("p")).select(*keys, "p.*")


def canonical_label(spark, sf_dir):
    return _struct(answers(spark, sf_dir), "raw_label", "paper_id", "student_ix", "ord", repair=False)


def _smudged(df):
    return df.withColumn("smudged", F.translate(F.substring("raw_label", 1, 12), "0125689", "OlZSGBg"))


def repair_ocr_digits(spark, sf_dir):
    return _struct(_smudged(answers(spark, sf_dir)), "smudged", "paper_id", "student_ix", "ord")


def split_leading_label(spark, sf_dir):
    return L.with_leading_label(lines(spark, sf_dir)).select("doc_id", "line_no", "label", "normalized", "rest")


def label_sort_key(spark, sf_dir):
    named = _struct(questions(spark, sf_dir), "raw_label", "paper_id", "ord")
    number, suffix = L.label_sort_key(F.col("normalized"))
    return named.select("paper_id", "ord", number.alias("number"), suffix.alias("suffix"))


def ocr_first_line_label(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", L.first_line_label(F.col("text")).alias("label"))


def resolve_block_label(spark, sf_dir):
    resolved = L.resolve_block_label(F.col("label"), F.col("text"))
    return derived(spark, sf_dir, "blocks_in").select("doc_id", "block_no", resolved.alias("p")).select("doc_id", "block_no", "p.*")


def detect_marks(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.detect_marks(F.col("text")).alias("marks"))


def strip_marks(spark, sf_dir):
    return lines(spark, sf_dir).select("doc_id", "line_no", T.strip_marks(F.col("text")).alias("text"))


def section_heading(spark, sf_dir):
    heading, rest = T.section_heading(F.col("text"))
    return lines(spark, sf_dir).select("doc_id", "line_no", heading.alias("section"), rest.alias("rest"))


def inline_question_starts(spark, sf_dir):
    """Two neighbouring lines set on one, cut again where the second question starts."""
    joined = lines(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" 7. Then "), "text"))
    return joined.select("doc_id", "line_no", T.inline_parts(F.col("text")).alias("parts"))


def tokenize(spark, sf_dir):
    return derived(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("tokens"))


def student_name_from_file(spark, sf_dir):
    return derived(spark, sf_dir, "manifest_in").select(
        "batch_id", "file_ix", T.student_name(F.col("file_name"), F.col("file_ix").cast("int")).alias("name")
    )


def student_id(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("batch_id").orderBy("file_ix")
    return derived(spark, sf_dir, "manifest_in").select(
        "batch_id", "file_ix", F.concat(F.lit("s_"), F.row_number().over(w).cast("string")).alias("student_id")
    )


def display_label(spark, sf_dir):
    return questions(spark, sf_dir).select("paper_id", "ord", F.regexp_replace("raw_label", r"[.:]$", "").alias("label"))


def drop_header_noise(spark, sf_dir):
    return lines(spark, sf_dir).where(~F.trim("text").rlike(T.FURNITURE)).select("doc_id", "line_no")


def truncate_text(spark, sf_dir):
    limits = (90, 400, 600, 800, 1500, 8000, 60000)
    return derived(spark, sf_dir, "documents").select("doc_id", *(F.md5(F.substring("text", 1, n)).alias(f"t{n}") for n in limits))


QUERIES = {
    f.__name__: f
    for f in (
        strip_label_noise, canonical_label, repair_ocr_digits, split_leading_label, label_sort_key, ocr_first_line_label,
        resolve_block_label, detect_marks, strip_marks, section_heading, inline_question_starts, tokenize, student_name_from_file,
        student_id, display_label, drop_header_noise, truncate_text,
    )
}

_Q, _A, _L = with_inputs("questions_in"), with_inputs("answers_in"), with_inputs("lines_in")
_SECTION = f"regexp_extract(trim(text), {lit(T.SECTION)}, %d)"
_FIRST = f"trim(regexp_extract(string_split(text, chr(10))[1], {lit(L.FIRST_LINE)}, 1))"
ORACLES = {
    "strip_label_noise": f"{_Q} SELECT paper_id, ord, {sql_noise('raw_label')} AS label FROM questions_in",
    "canonical_label": f"{_A}, {sql_labels('answers_in', 'raw_label', 'paper_id, student_ix, ord', 'p', False)} SELECT * FROM p",
    "repair_ocr_digits": f"""{_A}, sm AS (SELECT *, translate(substring(raw_label, 1, 12), '0125689', 'OlZSGBg') AS smudged FROM answers_in),
{sql_labels('sm', 'smudged', 'paper_id, student_ix, ord', 'p')} SELECT * FROM p""",
    "split_leading_label": f"{_L}, {sql_leading('lines_in', 'text', 'doc_id, line_no', 'p')} SELECT * FROM p",
    "label_sort_key": f"""{_Q}, {sql_labels('questions_in', 'raw_label', 'paper_id, ord', 'p')}
SELECT paper_id, ord, coalesce(TRY_CAST(regexp_extract(normalized, '^(\\d+)', 1) AS BIGINT), {L.LAST}) AS number,
  regexp_replace(normalized, '^\\d+', '') AS suffix FROM p""",
    "ocr_first_line_label": f"""{_L} SELECT doc_id, line_no,
  CASE WHEN {_FIRST} <> '' THEN regexp_replace({_FIRST}, '^(\\d{{1,2}})\\s*[.:)]$', '\\1') END AS label FROM lines_in""",
    "resolve_block_label": f"""{with_inputs('blocks_in')}, {sql_labels('blocks_in', 'label', 'doc_id, block_no, label AS given, text', 'g')},
{sql_leading('g', 'text', 'doc_id, block_no, given, text, normalized AS gn', 'x').replace("SELECT doc_id, block_no, given, text, normalized AS gn, CASE", "SELECT doc_id, block_no, given, text, gn, CASE").replace("SELECT doc_id, block_no, given, text, normalized AS gn, t, lab, n,", "SELECT doc_id, block_no, given, text, gn, t, lab, n,")}
SELECT doc_id, block_no, CASE WHEN gn <> '' THEN trim(given) WHEN normalized <> '' THEN label END AS label,
  CASE WHEN gn <> '' THEN gn WHEN normalized <> '' THEN normalized END AS normalized,
  CASE WHEN gn <> '' AND normalized <> gn THEN trim(text) WHEN gn <> '' OR normalized <> '' THEN rest ELSE trim(text) END AS body FROM x""",
    "detect_marks": f"{_L} SELECT doc_id, line_no, {sql_marks('text')} AS marks FROM lines_in",
    "strip_marks": f"{_L} SELECT doc_id, line_no, {sql_strip_marks('text')} AS text FROM lines_in",
    "section_heading": f"""{_L}, s AS (SELECT doc_id, line_no, {_SECTION % 1} AS w, {_SECTION % 2} AS c, trim({_SECTION % 3}) AS r FROM lines_in)
SELECT doc_id, line_no, CASE WHEN w <> '' AND length(r) < 60 THEN upper(w[1]) || lower(w[2:]) || ' ' || upper(c) END AS section,
  CASE WHEN w <> '' AND length(r) < 60 THEN r END AS rest FROM s""",
    "tokenize": "SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z0-9\\s]', ' ', 'g'), '\\s+'), "
    "lambda w: length(w) > 2 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in T.STOPWORDS) + "], w)) AS tokens FROM documents",
    "student_id": f"""{with_inputs('manifest_in')} SELECT batch_id, file_ix,
  's_' || CAST(row_number() OVER (PARTITION BY batch_id ORDER BY file_ix) AS VARCHAR) AS student_id FROM manifest_in""",
    "display_label": f"{_Q} SELECT paper_id, ord, regexp_replace(raw_label, '[.:]$', '') AS label FROM questions_in",
    "drop_header_noise": f"{_L} SELECT doc_id, line_no FROM lines_in WHERE NOT regexp_matches(trim(text), {lit(T.FURNITURE)})",
    "truncate_text": "SELECT doc_id, " + ", ".join(f"md5(substring(text, 1, {n})) AS t{n}" for n in (90, 400, 600, 800, 1500, 8000, 60000)) + " FROM documents",
}
