"""Running streams to the end of what is there, and keyed tables that their batches write.

A keyed table is a folder of commits, one per batch: ``commit=<n>`` holds what batch n says of its keys. A commit is written
whole or not at all (readers take only those that Spark has marked as done), and writing it again replaces it, so a batch
that is repeated after a failure changes nothing. The row that counts for a key is the one of the greatest order; deletions
stay as rows (tombstones), so the order of arrival does not matter."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE_PARTITIONS = 32


@contextmanager
def stateful(spark: SparkSession, partitions: int = STATE_PARTITIONS) -> Iterator[None]:
    """While a stream is started: the state store that keyed processors need, and as many partitions of state as asked for (a
    checkpoint keeps the number that it began with), at most those of other shuffles."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": ROCKS,
        "spark.sql.shuffle.partitions": str(min(partitions, int(spark.conf.get("spark.sql.shuffle.partitions")))),
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def drain(df: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "update") -> None:
    """Run the stream over all that is there, each batch through ``sink``; called again with the checkpoint it goes on from
    where it stopped."""
    with stateful(df.sparkSession):
        query = df.writeStream.foreachBatch(sink).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def commits(spark: SparkSession, folder: str) -> list[str]:
    """The folders of the commits that are done."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/commit=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(s.getPath().getParent().toString() for s in found)


class KeyedTable:
    """Rows by ``keys`` of which the one with the greatest ``order`` counts, unless ``deleted`` holds for it."""

    def __init__(self, folder: str, schema: StructType, keys: list[str], order: Column, deleted: Column | None = None):
        self.folder, self.schema, self.keys, self.order, self.deleted = folder, schema, keys, order, deleted

    def last(self, rows: DataFrame) -> DataFrame:
        """The row of the greatest order of every key; partial aggregates, so a busy key is one row per task."""
        other = [c for c in rows.columns if c not in self.keys]
        return rows.groupBy(*self.keys).agg(F.max_by(F.struct(*other), self.order).alias("_x")).select(*self.keys, "_x.*").select(*rows.columns)

    def write(self, rows: DataFrame, batch: int) -> None:
        """Batch ``batch`` of a stream: its last row of every key, as a commit that replaces one of the same number."""
        self.last(rows.select(*self.schema.names)).write.mode("overwrite").parquet(f"{self.folder}/commit={batch:012d}")

    def history(self, spark: SparkSession) -> DataFrame:
        paths = commits(spark, self.folder)
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def current(self, spark: SparkSession) -> DataFrame:
        """The rows that count."""
        rows = self.last(self.history(spark))
        return rows.where(~self.deleted) if self.deleted is not None else rows

    def compacted(self, spark: SparkSession, folder: str) -> KeyedTable:
        """The table in another folder, as one commit; tombstones stay, for older rows may still arrive."""
        table = KeyedTable(folder, self.schema, self.keys, self.order, self.deleted)
        number = max((int(c.rpartition("commit=")[2]) for c in commits(spark, self.folder)), default=0)
        table.write(self.history(spark), number)
        return table
