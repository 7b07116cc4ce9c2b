"""Model replies as columns: finding the JSON in a reply, and reading its fields whatever their types.

A reply's JSON is found as text (``repair_json``), parsed once to a VARIANT (``reply_value``), and read from there; fields are
coerced one by one."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

FENCE = re.compile(r"```(?:json)?\s*(.*?)```", re.I | re.S)
PLAIN_FENCE = r"^[^`]*+```(?:[jJ][sS][oO][nN])?[ \t\r\n]*+([{\[][^`]*+)```"
MARKS = {"{": re.compile(r'\\.|["{}]', re.S), "[": re.compile(r'\\.|["\[\]]', re.S)}
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _refused(name: str):
    raise ValueError(name)


#: Made once: ``json.loads`` with an option makes one for every text.
STRICT = json.JSONDecoder(parse_constant=_refused)


def _parses(text: str) -> bool:
    try:
        STRICT.decode(text)
    except (ValueError, RecursionError):
        return False
    return True


def first_json(text: str | None) -> str | None:
    """The text's fenced part, or the whole, if it is JSON, else its first balanced object or array that is: of the two kinds of bracket the one that opens
    first is tried first, and only brackets of its kind are counted, none inside quotes; null if neither gives any."""
    if text and (fenced := FENCE.search(text)):
        text = fenced[1]
    text = (text or "").strip()
    if not text:
        return None
    if _parses(text):
        return text
    for start, opener in sorted((text.find(c), c) for c in MARKS if c in text):
        depth, quoted = 0, False
        for m in MARKS[opener].finditer(text, start):
            mark = m[0]
            if mark == '"':
                quoted = not quoted
            elif len(mark) == 1 and not quoted:
                depth += 1 if mark == opener else -1
                if depth == 0:
                    piece = text[start : m.end()]
                    if _parses(piece):
                        return piece
                    break
    return None


@F.arrow_udf(StringType())
def json_piece(text: pa.Array) -> pa.Array:
    return pa.array([first_json(t) for t in text.to_pylist()], pa.string())


@F.arrow_udf(StringType())
def _once_each(text: pa.Array) -> pa.Array:
    """JSON with every name of an object once: the last value counts."""
    return pa.array([t and json.dumps(json.loads(t)) for t in text.to_pylist()], pa.string())


def repair_json(text: Column) -> Column:
    """The reply's JSON as text: the fenced part or the whole if it parses, else the first balanced piece that does; null if none
    does."""
    return json_piece(text)


def plain_json(text: Column) -> Column:
    """The text from where an object or array opens, of replies that begin with it or whose first fenced part does (no other back
    tick up to its end); empty or null for others. If JSON can be read from its beginning, this is what ``repair_json`` finds: what
    may follow a balanced piece counts neither there nor here."""
    begins = F.when(text.rlike(r"^[ \t\r\n]*[{\[]"), text)
    return F.when(F.contains(text, F.lit("```")), F.regexp_extract(text, PLAIN_FENCE, 1)).otherwise(begins)


def reply_value(text: Column) -> Column:
    """The reply's JSON as a VARIANT, null if there is none."""
    return parsed(repair_json(text))


def parsed(payload: Column) -> Column:
    """JSON text as a VARIANT. An object that names a key twice is taken as if only the last stood there."""
    return _or_once_each(F.try_parse_json(payload), payload)


def _or_once_each(value: Column, payload: Column) -> Column:
    return F.coalesce(value, F.try_parse_json(_once_each(F.when(value.isNull(), payload))))


def with_value(rows: DataFrame, payload: str, name: str) -> DataFrame:
    """``rows`` with ``parsed`` of a column; the first parse is a step of its own, so it is not made again for what follows it."""
    first = rows.withColumn("_first", F.try_parse_json(payload))
    return first.withColumn(name, _or_once_each(F.col("_first"), F.col(payload))).drop("_first")


def field(value: Column, name: str) -> Column:
    """A field of an object as a VARIANT; null where the value is no object, or has no such field."""
    return F.try_variant_get(value, f"$.{name}", "variant")


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "struct<_:variant>").isNotNull()  # its schema would spell out all that it holds


def as_array(value: Column, payload: Column) -> Column:
    """An array of VARIANTs: the value if it is an array, else the first property of the object that is one, in the order of
    the text ``payload``; empty if there is none."""
    array = "array<variant>"
    named = lambda k: F.try_variant_get(value, F.concat(F.lit("$['"), k, F.lit("']")), array)
    keys = F.filter(F.json_object_keys(payload), lambda k: ~F.contains(k, F.lit("'")))
    first = F.get(F.filter(F.transform(keys, named), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(F.try_variant_get(value, "$", array), first, F.array().cast(array))


@dataclass(frozen=True)
class Read:
    """A JSON value and its text. What kind of value it is is asked only where the text leaves it open."""

    text: Column
    value: Column

    @staticmethod
    def of(value: Column) -> Read:
        return Read(F.try_variant_get(value, "$", "string"), value)


def read_fields(rows: DataFrame, value: str, names: list[str]) -> tuple[DataFrame, dict[str, Read]]:
    """``rows`` with the texts of the named fields of the VARIANT ``value`` as one struct, and the fields as read from it. All fields
    are looked up in one pass over the object; a field's value is asked for only where its text leaves its kind open."""
    texts = F.try_variant_get(value, "$", f"struct<{', '.join(f'`{n}`:string' for n in names)}>")
    return rows.withColumn("_t", texts), {n: Read(F.col("_t")[n], field(F.col(value), n)) for n in names}


def as_string(value: Read) -> Column:
    """A string, or a number or boolean written as one (2.0 as 2); null otherwise."""
    t, shown = value.text, F.schema_of_variant(value.value)
    return (
        F.when(t.startswith("{") | t.startswith("["), F.when(shown == "STRING", t))
        .when(t.endswith(".0"), F.when(shown == "STRING", t).otherwise(F.substring(t, F.lit(1), F.length(t) - 2))).otherwise(t)
    )


def as_number(value: Read) -> Column:
    """A number, also from its text (nothing but white space is 0); null otherwise."""
    t = F.trim(value.text)
    n = t.try_cast("double")
    return F.when(t == "", 0.0).when(t.rlike(NUMBER) & (F.abs(n) < float("inf")), n)


def as_confidence(value: Read, default: float) -> Column:
    """0..1; what is above 1 counts as a percentage."""
    return share(as_number(value), default)


def share(number: Column, default: float) -> Column:
    """A number as a confidence, see ``as_confidence``."""
    n = F.coalesce(number, F.lit(default))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(n > 1, n / 100).otherwise(n)))


def as_boolean(value: Read) -> Column:
    """A boolean, or the text ``true`` in either case; false otherwise."""
    return F.coalesce(F.lower(value.text) == "true", F.lit(False))
