"""A corpus pipeline of five stages over ``documents``; each works on all that the stage before has kept.

Every stage takes (spark, docs, sf_dir), where ``docs`` has the columns of ``documents``, and all but the last
return those columns. A stage's result is written as Parquet and read again as the next one's input. Tests compare
the stages with brute force: they cannot be said in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markloom.llm import decontamination, ngram_join, quality, secrets, sentencepiece
from markloom.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from labelled documents among ``docs``.
    Empty and null texts are scored like others."""
    docs = docs.select(*COLUMNS)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality"))
    return quality.score(docs, model).where("predicted = 1").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one with the least doc_id (nulls last), then the least digest
    of its text. Texts without words have no duplicates and stay; different texts under one doc_id are documents of
    their own, as are rows without an id; repeated rows are one."""
    return ngram_join.keep_first(docs.select(*COLUMNS)).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a benchmark item occurs; null and empty texts hold none and stay."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    return decontamination.contamination(docs.select(*COLUMNS), benchmark).where("n_hit = 0").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a placeholder; ``n_chars`` follows the text (null for a null one). Null and
    empty texts, repeated rows and rows without an id stay as they are."""
    clean = secrets.scan(docs.select(*COLUMNS), redact=True)
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def to_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, round_trip, parity of every document; a null or empty text has no ids. Rows without an id and
    repeated rows are encoded each."""
    return sentencepiece.encode(docs)


STAGES = [
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("sentencepiece", to_pieces),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
