"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII upper case to lower case; every other ASCII character that is no letter or digit to a space.
ALNUM_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def alnum_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text after lower-casing A-Z, as UTF-8.

    Only ASCII characters separate words, so working on the UTF-8 bytes gives the same words."""
    return text.encode("utf-8", "surrogatepass").translate(ALNUM_TABLE).split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; other columns never reach the operator, whatever their names."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets a
    temporary one; on a cluster that is an error, for executors do not see each other's folders."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="markloom-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def materialize(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder and read them back: cuts the lineage, and is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bounds of an Arrow batch, so that a batch of whole texts stays small on both sides; what the session says comes first.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8 << 20}


def arrow_pass(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches bounded in rows and bytes (the same bounds for all callers, and only where the
    session sets none), and with a worker that gives memory back when it is done: workers stay alive between tasks."""
    conf = df.sparkSession.conf
    for name, bound in BATCHES.items():
        if conf.get(name, None) is None:
            conf.set(name, str(bound))

    def run(batches):
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def steps(texts: list[str], chars: int) -> Iterator[list[str]]:
    """The texts in order, in parts of about ``chars`` characters at most; a longer text is a part of its own."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > chars:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once for the row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def least_by_hash(rows: DataFrame, on: list[str], n: int, total: int) -> DataFrame:
    """The ``n`` rows (all, if there are fewer) with the least hash of ``on``, whose values differ from row to row, of
    ``total``. A bound on the hash leaves about twice as many before they are put in order, however large the table."""
    place = F.pmod(F.xxhash64(*on), F.lit(1 << 40))
    bound = min(1 << 40, (2 * n + 200) * (1 << 40) // max(total, 1))
    return rows.where(place < bound).orderBy(place, *on).limit(n)
