"""Publications of grades: frozen as they were when they were published, one version beside the other.

``grades/version=<v>/paper_bucket=<b>`` holds the v-th publication of the papers of a bucket (a folder per paper would be
millions); writing a version again replaces the buckets that it touches and no others. ``manifest`` says for every paper
which publication is its last, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.operators.review import ROW, grade_in_force
from markloom.streaming.runs import KeyedTable

BUCKETS = 16
PUBLISHED = "paper_id long, student_ix long, question_no long, publish_seq long, marks double, evaluation string, version int, paper_bucket int"
MANIFEST = "paper_id long, version int, publish_seq long, valid boolean"


def versions(events: DataFrame) -> DataFrame:
    """paper_id, version (from 1), publish_seq of every publication; ``valid`` where no later publication, edit or revert came."""
    published = events.where("kind = 'publish'").select("paper_id", F.col("seq").alias("publish_seq")).distinct()
    last = events.groupBy("paper_id").agg(F.max("seq").alias("last"))
    n = F.row_number().over(Window.partitionBy("paper_id").orderBy("publish_seq"))
    return published.withColumn("version", n).join(last, "paper_id").select("paper_id", "version", "publish_seq", (F.col("publish_seq") == F.col("last")).alias("valid"))


def frozen(grades: DataFrame, events: DataFrame, published: DataFrame) -> DataFrame:
    """The grades in force of every question (``grades``: paper_id, student_ix, question_no and its grade) at every
    publication of its paper: the last edit before it counts, unless it was reverted."""
    asked = grades.select(*ROW).join(published.select("paper_id", "version", "publish_seq"), "paper_id")
    none = F.lit(None)
    stops = asked.select(*ROW, F.col("publish_seq").alias("seq"), "version", none.cast("struct<kind:string,marks:double,feedback:string>").alias("e"))
    edits = events.where("kind IN ('edit', 'revert')").select(*ROW, "seq", none.cast("int").alias("version"), F.struct("kind", "marks", "feedback").alias("e"))
    upto = Window.partitionBy(*ROW).orderBy("seq", F.col("version").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    at = stops.unionByName(edits).withColumn("e", F.last("e", True).over(upto)).where("version IS NOT NULL")
    held = F.col("e.kind") == "edit"
    with_edits = at.select(*ROW, F.col("seq").alias("publish_seq"), "version", F.when(held, F.col("e.marks")).alias("edit_marks"), F.when(held, F.col("e.feedback")).alias("edit_feedback"))
    return grade_in_force(with_edits.join(grades, ROW)).select(*ROW, "publish_seq", "version", "marks", "evaluation")


class Publications:
    """The publications under a folder."""

    def __init__(self, folder: str, buckets: int = BUCKETS):
        self.folder, self.buckets = f"{folder}/grades", buckets
        self.manifest = KeyedTable(f"{folder}/manifest", T.StructType.fromDDL(MANIFEST), ["paper_id"], F.struct("version", ~F.col("valid")))

    def write(self, rows: DataFrame, published: DataFrame, number: int) -> None:
        """Freeze ``rows`` (see ``frozen``) of the publications ``published`` (see ``versions``); ``number`` is that of the
        manifest's commit. The grades come first: a manifest names nothing that is not there."""
        bucket = F.pmod(F.xxhash64("paper_id"), F.lit(self.buckets)).cast("int")
        out = rows.withColumn("paper_bucket", bucket).select(*T.StructType.fromDDL(PUBLISHED).names)
        dealt = out.repartition("version", "paper_bucket", F.pmod(F.xxhash64(*ROW), F.lit(8)))  # up to eight files a bucket
        dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "paper_bucket").parquet(self.folder)
        self.manifest.write(published, number)

    def read(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        """All publications, or those of one version; both columns of folders prune the scan."""
        rows = spark.read.schema(PUBLISHED).parquet(self.folder)
        return rows if version is None else rows.where(F.col("version") == version)

    def in_force(self, spark: SparkSession) -> DataFrame:
        """The last publication of every paper, with ``valid``."""
        return self.read(spark).join(self.manifest.current(spark).select("paper_id", "version", "valid"), ["paper_id", "version"])
