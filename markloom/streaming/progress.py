"""Progress frames of jobs: written and read as JSON lines, followed live, and the same results over finished tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markloom.operators.intake import percent_done, stage_progress
from markloom.streaming.runs import KeyedTable, commits, drain

EVENT = T.StructType(
    [
        T.StructField("job_id", T.LongType()), T.StructField("stage", T.LongType()), T.StructField("state", T.StringType()),
        T.StructField("event_type", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("event_id", T.LongType()),
    ]
)
FRAME = T.StructType(
    [*EVENT.fields, T.StructField("type", T.StringType()), T.StructField("seq", T.LongType()), T.StructField("payload", T.StringType()), T.StructField("_corrupt_record", T.StringType())]
)


def read_frames(spark: SparkSession, folder: str | list[str], stream: bool = True, files_per_trigger: int = 1) -> DataFrame:
    """Frames of newline-delimited JSON files; lines that cannot be read, and blank ones, are left out."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_trigger) if stream else spark.read
    frames = reader.schema(FRAME).option("mode", "PERMISSIVE").json(folder)
    return frames.where(F.col("_corrupt_record").isNull() & F.col("job_id").isNotNull()).drop("_corrupt_record")


def write_frames(events: DataFrame, folder: str) -> None:
    """Frames as JSON lines, those of a job in order and in one file."""
    _ordered(events, "event_id").write.mode("overwrite").text(folder)


def _ordered(frames: DataFrame, by: str) -> DataFrame:
    dealt = frames.repartition("job_id").sortWithinPartitions("job_id", by)
    return dealt.select(F.to_json(F.struct(*frames.columns)).alias("value"))


# ---- frames of finished jobs, as commits -----------------------------------------------------------------------------


def frames_of(events: DataFrame) -> DataFrame:
    """Each job's stage frames, numbered from 1 by event, and its one terminal frame behind them. The terminal frame is an
    error if a stage has failed (payload: code, message, retryable; the last that failed is named) and a result otherwise
    (payload: percent, stages)."""
    w = Window.partitionBy("job_id").orderBy("event_id")
    frames = events.select("*", F.lit("stage").alias("type"), F.row_number().over(w).cast("long").alias("seq"), F.lit(None).cast("string").alias("payload"))
    failed = F.col("state") == "failed"
    latest = latest_states(events)
    done = stage_progress(latest).join(latest.groupBy("job_id").agg(F.count(F.lit(1)).alias("stages")), "job_id")
    ends = events.groupBy("job_id").agg(
        (F.count(F.lit(1)) + 1).alias("seq"), F.max_by("stage", F.when(failed, F.col("event_id"))).alias("failed_stage"), F.max("ts").alias("ts"), F.max("event_id").alias("event_id")
    )
    error = F.to_json(F.struct(F.lit("INTERNAL").alias("code"), F.format_string("Stage %d failed.", "failed_stage").alias("message"), F.lit(True).alias("retryable"), F.col("failed_stage").alias("stage")))
    result = F.to_json(F.struct("percent", "stages"))
    bad = F.col("failed_stage").isNotNull()
    none = lambda kind: F.lit(None).cast(kind)
    last = ends.join(done, "job_id").select(
        "job_id", none("long").alias("stage"), none("string").alias("state"), none("string").alias("event_type"), "ts", "event_id",
        F.when(bad, "error").otherwise("result").alias("type"), "seq", F.when(bad, error).otherwise(result).alias("payload"),
    )
    return frames.select(*last.columns).unionByName(last)


def commit_frames(frames: DataFrame, folder: str, number: int) -> None:
    """Frames as JSON lines, those of a job in order and in one file, as commit ``number`` of the folder. A commit that was cut
    off is not read, and writing it again replaces what is there, so no job gets a second terminal frame."""
    _ordered(frames, "seq").write.mode("overwrite").text(f"{folder}/commit={number:012d}")


def read_commits(spark: SparkSession, folder: str) -> DataFrame:
    """The frames of all commits that are done."""
    paths = commits(spark, folder)
    return read_frames(spark, paths, stream=False) if paths else spark.createDataFrame([], T.StructType(FRAME.fields[:-1]))


# ---- states of stages and percent of jobs ----------------------------------------------------------------------------


def latest_states(events: DataFrame) -> DataFrame:
    """(job_id, stage, state): the last state by event; works on a stream in update or complete mode."""
    return events.groupBy("job_id", "stage").agg(F.max_by("state", F.struct("ts", "event_id")).alias("state"))


def settled_states(latest: DataFrame) -> DataFrame:
    """As ``latest``, but in a job with a failed stage the active stages have failed too."""
    any_failed = F.bool_or(F.col("state") == "failed").over(Window.partitionBy("job_id"))
    flagged = latest.withColumn("_f", any_failed)
    state = F.when(F.col("_f") & (F.col("state") == "active"), "failed").otherwise(F.col("state"))
    return flagged.select("job_id", "stage", state.alias("state"))


STATES = "job_id long, stage long, state string, event_id long, at long"


class ProgressTable(KeyedTable):
    """The last state of every stage of a job, by time and event, whatever the order in which frames arrive."""

    def __init__(self, folder: str):
        super().__init__(folder, T.StructType.fromDDL(STATES), ["job_id", "stage"], F.struct("at", "event_id"))

    def current(self, spark: SparkSession) -> DataFrame:
        """job_id, stages as they stand (active ones have failed once one has), percent: done and skipped stages count whole, any
        active half."""
        latest = super().current(spark)
        failed = F.bool_or(F.col("state") == "failed")
        jobs = latest.groupBy("job_id").agg(F.array_sort(F.collect_list(F.struct("stage", "state"))).alias("_s"), failed.alias("_f"), percent_done().alias("percent"))
        shown = F.transform("_s", lambda s: F.struct(s["stage"].alias("stage"), F.when(F.col("_f") & (s["state"] == "active"), "failed").otherwise(s["state"]).alias("state")))
        return jobs.select("job_id", shown.alias("stages"), "percent")


def follow_progress(events: DataFrame, folder: str, checkpoint: str) -> ProgressTable:
    """The stages and percent of every job of a stream of frames, kept as a table while they arrive: a batch writes the last
    frame of each of its stages."""
    frames = events.where("job_id IS NOT NULL").select("job_id", "stage", "state", "event_id", F.unix_micros("ts").alias("at"))
    table = ProgressTable(folder)
    drain(frames, table.write, checkpoint, "append")
    return table


# ---- sessions ---------------------------------------------------------------------------------------------------------

GAP, LATE = "12 hours", "1 day"
SESSION = "job_id long, start timestamp, end timestamp, n long, finished boolean"


def closed_sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Sessions of a job's frames (job_id, session, n, finished): in a stream in append mode, once the watermark has passed
    them; frames that come later than ``late`` behind the newest are left out."""
    return (
        events.withWatermark("ts", late)
        .groupBy("job_id", F.session_window("ts", gap).alias("session"))
        .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("event_type") == "purchase").alias("finished"))
    )


def stalled_jobs(sessions: DataFrame) -> DataFrame:
    """Sessions that closed without a terminal frame."""
    return sessions.where(~F.col("finished"))


def follow_sessions(events: DataFrame, folder: str, checkpoint: str, gap: str = GAP, late: str = LATE) -> KeyedTable:
    """Closed sessions of a stream of frames, kept as a table while they close. A frame without a job (a tick of the clock)
    closes what is due, once a batch follows it, and is in no session of its own."""
    closed = closed_sessions(events, gap, late).select("job_id", "session.start", "session.end", "n", "finished")
    table = KeyedTable(folder, T.StructType.fromDDL(SESSION), ["job_id", "start"], F.col("end"))
    # ticks are dropped from what has closed: a filter in the stream would move below the watermark, which must see them
    drain(closed, lambda rows, batch: table.write(rows.where("job_id IS NOT NULL"), batch), checkpoint, "append")
    return table
