"""Teachers' edits and publications as streams. An event names its paper, and may arrive in any order; ``seq`` orders them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.streaming.runs import KeyedTable, drain

EVENT = T.StructType(
    [
        T.StructField("paper_id", T.LongType()), T.StructField("student_ix", T.LongType()), T.StructField("question_no", T.LongType()),
        T.StructField("seq", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("marks", T.DoubleType()),
        T.StructField("feedback", T.StringType()), T.StructField("kind", T.StringType()),
    ]
)


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 2) -> DataFrame:
    """Review events as Parquet files arrive."""
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def edits_table(folder: str) -> KeyedTable:
    """The last write per (paper, student, question); a revert is a tombstone."""
    return KeyedTable(folder, EVENT, ["paper_id", "student_ix", "question_no"], F.col("seq"), F.col("kind") == "revert")


def follow_edits(events: DataFrame, folder: str, checkpoint: str) -> KeyedTable:
    """Edits and reverts of a stream of events, kept as a table while they arrive."""
    table = edits_table(folder)
    drain(events.where("kind IN ('edit', 'revert')"), table.write, checkpoint, "append")
    return table


def edits_in_force(table: KeyedTable, spark: SparkSession) -> DataFrame:
    """paper_id, student_ix, question_no, edit_marks, edit_feedback."""
    return table.current(spark).select(*table.keys, F.col("marks").alias("edit_marks"), F.col("feedback").alias("edit_feedback"))


VALIDITY = "paper_id long, valid boolean, publish_seq long, edit_seq long, change long"


def validity(events: DataFrame) -> DataFrame:
    """Per paper the last publication and the last edit or revert: it holds while no edit came after. Papers without a publication
    give none. Both numbers only grow, so their sum (``change``) tells which row of a paper is the later; works on a stream in
    update or complete mode, where the two maxima are all the state of a paper."""
    published = F.coalesce(F.col("kind") == "publish", F.lit(False))
    last = events.groupBy("paper_id").agg(F.max(F.when(published, F.col("seq"))).alias("publish_seq"), F.max(F.when(~published, F.col("seq"))).alias("edit_seq"))
    edited = F.coalesce("edit_seq", F.lit(-1))
    holds = last.where("publish_seq IS NOT NULL")
    return holds.select("paper_id", (edited < F.col("publish_seq")).alias("valid"), "publish_seq", "edit_seq", (F.col("publish_seq") + edited).alias("change"))


def follow_publications(events: DataFrame, folder: str, checkpoint: str) -> KeyedTable:
    """Validity of a stream of events, kept as a table by paper while they arrive."""
    table = KeyedTable(folder, T.StructType.fromDDL(VALIDITY), ["paper_id"], F.col("change"))
    drain(validity(events), table.write, checkpoint, "update")
    return table
