"""Question labels as columns: noise, canonical form, digit repair, leading labels, sort keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What may stand before a label, how sub-parts are written, and which characters are read for digits.
SPACE = r"[\s\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
NOISE = (
    r"(?i)^(?:" + SPACE + r"*(?:section\s+[a-z0-9]+\s*[-–—:.]?\s*|part\s+[a-z0-9]+\s*[-–—:.]?\s*|ans(?:wer)?\s*[.:-]?\s*"
    r"|sol(?:ution)?\s*[.:-]?\s*|q(?:uestion|ues|no)?\s*[.:-]?\s*|no\.?\s*))+"
)
HEAD = r"^(\d{1,3})"
BRACKETED = r"^\s*[(\[]\s*([a-zA-Z]{1,4})\s*(?:[)\]]|[^a-zA-Z]|$)"
ATTACHED = r"^[.)\-–—:]?\s?([a-zA-Z]{1,4})(?:[^a-zA-Z]|$)"
ROMAN = r"^x{0,3}(?:ix|iv|v?i{0,3})$"
READ_AS = ("liIOoSsZzBGgq", "1110055228699")
LEADING = (
    r"(?i)^((?:section\s+[a-z0-9]+\s*[-–—:.]?\s*)?(?:part\s+[a-z0-9]+\s*[-–—:.]?\s*)?(?:ans(?:wer)?\s*[.:-]?\s*)?"
    r"(?:q(?:uestion|ues|no)?\s*[.:-]?\s*)?\d{1,3}\s*(?:[(\[]\s*[a-zA-Z]{1,4}\s*[)\]]?|[.)\-–—:]\s*[a-zA-Z]\)|[.)\-–—:])?)\s*"
)
FIRST_LINE = r"^\s*(?:[qQ]\s*)?(\d{1,2}\s*(?:[(\[]\s*[a-zA-Z]{1,3}\s*[)\]]|[.):])?)"
LAST = 9007199254740991  # sorts after every number


def strip(text: Column) -> Column:
    """Without white space at the ends (of any kind, as far as Unicode calls it so)."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def strip_label_noise(raw: Column) -> Column:
    """The label without leading layers such as ``Section B - Q``, however many. Null stays null."""
    return strip(F.regexp_replace(strip(raw), NOISE, ""))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _parse(text: Column) -> Column:
    """Struct (main, sub) of a text that starts with a number; main is null where it does not."""
    head = F.regexp_extract(text, HEAD, 1)

    def parts(tail: Column) -> Column:
        inside, beside = F.regexp_extract(tail, BRACKETED, 1), F.lower(F.regexp_extract(tail, ATTACHED, 1))
        credible = (F.length(beside) == 1) | ((beside != "") & beside.rlike(ROMAN))
        sub = F.when(inside != "", F.lower(inside)).when(credible, beside)
        main = head.try_cast("int").cast("string")
        return F.struct(main.alias("main"), F.when(main.isNotNull(), sub).alias("sub"))

    return let(F.substring(text, F.length(head) + 1, F.length(text)), parts)


def canonical_label(raw: Column, repair: bool = True) -> Column:
    """Struct (normalized, main, sub, parent) of a label as written, e.g. ``Q 07 (ii`` -> 7ii, 7, ii, 7. Where no number
    is read and ``repair`` is set, the first one to four characters are read again as digits where they look like some.
    What cannot be read has an empty ``normalized`` and ``main``; a label without a sub-part has no ``parent``."""

    def again(clean: Column) -> Column:
        token = F.regexp_extract(clean, r"^[a-zA-Z0-9]{1,4}", 0)
        return _parse(F.concat(F.translate(token, *READ_AS), F.substring(clean, F.length(token) + 1, F.length(clean))))

    def read(clean: Column) -> Column:
        direct = let(_parse(clean), lambda p: F.when(p["main"].isNotNull(), p))
        return F.coalesce(direct, again(clean)) if repair else direct

    def whole(p: Column) -> Column:
        return F.struct(
            F.coalesce(F.concat(p["main"], F.coalesce(p["sub"], F.lit(""))), F.lit("")).alias("normalized"),
            F.coalesce(p["main"], F.lit("")).alias("main"),
            p["sub"].alias("sub"),
            F.when(p["sub"].isNotNull(), p["main"]).alias("parent"),
        )

    return let(let(strip_label_noise(F.coalesce(raw, F.lit(""))), read), whole)


def split_leading_label(line: Column) -> Column:
    """Struct (label or null, normalized or '', rest of the line)."""

    def split(text: Column) -> Column:
        label = strip(F.regexp_extract(text, LEADING, 1))
        normalized = let(label, lambda x: F.when(x == "", F.lit("")).otherwise(canonical_label(x)["normalized"]))

        def pieces(n: Column) -> Column:
            rest = strip(F.substring(text, F.length(F.regexp_extract(text, LEADING, 0)) + 1, F.length(text)))
            return F.struct(
                F.when(n != "", label).alias("label"), n.alias("normalized"), F.when(n == "", text).otherwise(rest).alias("rest")
            )

        return let(normalized, pieces)

    return let(strip(line), split)


def with_leading_label(lines: DataFrame, text: str = "text") -> DataFrame:
    """``lines`` with label (or null), normalized (or '') and rest of each line, as ``split_leading_label`` gives them. Every
    pattern is looked up once a line, in steps that later ones read as columns, so code is generated for all of them."""
    one = lines.withColumn("_t", strip(F.col(text)))
    two = one.withColumns({"_lead": F.regexp_extract("_t", LEADING, 0), "_label": strip(F.regexp_extract("_t", LEADING, 1))})
    three = two.withColumn("_clean", strip_label_noise(F.col("_label")))
    token = F.regexp_extract("_clean", r"^[a-zA-Z0-9]{1,4}", 0)
    reread = F.concat(F.translate(token, *READ_AS), F.substring("_clean", F.length(token) + 1, F.length("_clean")))
    four = three.withColumn("_clean", F.when(F.col("_clean").rlike(HEAD) | (F.col("_label") == ""), F.col("_clean")).otherwise(reread))
    five = four.withColumn("_head", F.regexp_extract("_clean", HEAD, 1)).withColumn("_tail", F.substring("_clean", F.length("_head") + 1, F.length("_clean")))
    six = five.withColumns({"_inside": F.regexp_extract("_tail", BRACKETED, 1), "_beside": F.lower(F.regexp_extract("_tail", ATTACHED, 1)), "_main": F.col("_head").try_cast("int").cast("string")})
    credible = (F.length("_beside") == 1) | ((F.col("_beside") != "") & F.col("_beside").rlike(ROMAN))
    sub = F.when(F.col("_inside") != "", F.lower("_inside")).when(credible, F.col("_beside"))
    normalized = F.when((F.col("_label") != "") & F.col("_main").isNotNull(), F.concat("_main", F.coalesce(sub, F.lit("")))).otherwise("")
    seven = six.withColumn("normalized", normalized)
    known = F.col("normalized") != ""
    after = strip(F.substring("_t", F.length("_lead") + 1, F.length("_t")))
    done = seven.withColumns({"label": F.when(known, F.col("_label")), "rest": F.when(known, after).otherwise(F.col("_t"))})
    return done.drop("_t", "_lead", "_label", "_clean", "_head", "_tail", "_inside", "_beside", "_main")


def label_sort_key(normalized: Column) -> tuple[Column, Column]:
    """(number, suffix): 2 before 10, 11a before 11b, labels without a number last by their text."""
    number = F.regexp_extract(normalized, r"^(\d+)", 1).try_cast("bigint")
    return F.coalesce(number, F.lit(LAST)), F.regexp_replace(normalized, r"^\d+", "")


def first_line_label(text: Column) -> Column:
    """Label at the start of the first line as offline readers find it: at most two digits, a short bracketed part,
    closing ``.``, ``:`` or ``)`` dropped where it closes no bracket; null if there is none."""
    found = strip(F.regexp_extract(F.element_at(F.split(text, "\n"), 1), FIRST_LINE, 1))
    return F.when(found != "", F.regexp_replace(found, r"^(\d{1,2})\s*[.:)]$", "$1"))


def resolve_block_label(label: Column, text: Column) -> Column:
    """Struct (label, normalized or null, body): the given label if it can be read, else the first line's; the label is
    taken off the body where the text repeats it."""
    lines = F.split(text, "\n")

    def resolve(given: Column, own: Column) -> Column:
        by_given, by_text = given != "", own["normalized"] != ""
        body = strip(F.array_join(F.concat(F.array(own["rest"]), F.slice(lines, 2, F.size(lines))), "\n"))
        return F.struct(
            F.when(by_given, strip(label)).when(by_text, own["label"]).alias("label"),
            F.when(by_given, given).when(by_text, own["normalized"]).alias("normalized"),
            F.when(by_given & (own["normalized"] != given), strip(text))
            .when(by_given | by_text, body)
            .otherwise(strip(text))
            .alias("body"),
        )

    return let(
        canonical_label(label)["normalized"],
        lambda given: let(split_leading_label(F.element_at(lines, 1)), lambda own: resolve(given, own)),
    )


def with_block_label(blocks: DataFrame) -> DataFrame:
    """``blocks`` (label, text) with label, normalized and body as ``resolve_block_label`` gives them, in steps that later ones read
    as columns; the given label is parsed only where there is one."""
    given = F.when(F.col("label").isNull(), "").otherwise(canonical_label(F.col("label"))["normalized"])
    asked = blocks.withColumn("_given", given).withColumnRenamed("label", "_told").withColumn("_lines", F.split("text", "\n"))
    read = with_leading_label(asked.withColumn("_first", F.element_at("_lines", 1)), "_first")
    by_given, by_text, whole = F.col("_given") != "", F.col("normalized") != "", strip(F.col("text"))
    more = F.array_join(F.concat(F.array("rest"), F.slice("_lines", F.lit(2), F.size("_lines"))), "\n")
    body = F.when((by_given | by_text) & ~(by_given & (F.col("normalized") != F.col("_given"))), strip(F.when(F.size("_lines") > 1, more).otherwise(F.col("rest")))).otherwise(whole)
    done = read.withColumn("body", body).withColumns({
        "label": F.when(by_given, strip(F.col("_told"))).when(by_text, F.col("label")), "normalized": F.when(by_given, F.col("_given")).when(by_text, F.col("normalized")),
    })
    return done.drop("_given", "_told", "_lines", "_first", "rest")
