"""Rebuild on change: new files and new deltas are taken in as they arrive, each batch once.

The index itself is batch-incremental; these operators let the same pure functions run under Structured Streaming with a
checkpoint, so that a restart neither loses nor repeats a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import references
from ..runtime import shared_dir


def read_new(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as they appear."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def change_counts(history: DataFrame, window: str = "1 day", late: str = "7 days") -> DataFrame:
    """Events per window and change type of a stream of history rows; rows later than the watermark are left out."""
    w = F.window("scanned_at", window)
    return history.withWatermark("scanned_at", late).groupBy(w.alias("w"), "change_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "change_type", "n")


def run_once(stream: DataFrame, name: str, write: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Take in what is there now, in batches, and end. write gets each batch and its number and must tolerate a repeat."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{shared_dir(stream.sparkSession)}/streams/{name}").trigger(availableNow=True).start()


class ReferenceState:
    """The signed reference and existence counts as a table of versions: batch n turns version n-1 into version n.

    A repeated batch writes the same version again, so its deltas never count twice. Versions before the last two are
    left to the owner of the folder to remove.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def version(self, n: int) -> str:
        return f"{self.path}/v{n:010d}"

    def read(self, n: int) -> DataFrame | None:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(self.version(n))
        there = p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)
        return self.spark.read.parquet(self.version(n)) if there else None

    def apply(self, deltas: DataFrame, batch: int) -> None:
        before = self.read(batch - 1) if batch > 0 else None
        references.apply_deltas(before, deltas).write.mode("overwrite").parquet(self.version(batch))
