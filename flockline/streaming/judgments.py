"""Judgments as a stream: windowed counts, and the last answer on each pair merged batch by batch.

The reference of these queries works on files; the batch forms are ``last_wins``
and ``counted``. A stream of files gives the same tables when it has ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.operators.sets import last_wins


def read(spark: SparkSession, folder: str, like: DataFrame, files: int = 1) -> DataFrame:
    """A stream of Parquet files with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files).parquet(folder)


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 days", time: str = "ts", kind: str = "event_type", key: str | None = None) -> DataFrame:
    """Rows and values of each kind in tumbling windows; rows later than ``late`` are not waited for. With ``key``, repeats of a key count once."""
    marked = events.withWatermark(time, late)
    if key:
        marked = marked.dropDuplicatesWithinWatermark([key])
    return marked.groupBy(F.window(time, length), kind).agg(F.count(F.lit(1)).alias("rows"), F.round(F.sum("value"), 6).alias("value"))


def upserted(events: DataFrame, target: str, checkpoint: str, keys: list[str], time: str, tie: str) -> None:
    """Keeps at ``target`` the last row of each key, until the stream has no more files.

    Each batch is reduced to its own last rows, merged with the table's, and written
    to a version of its own, which a later batch reads; a batch that is run again
    writes the same version.
    """
    spark = events.sparkSession

    def merge(batch: DataFrame, number: int) -> None:
        both = last_wins(batch, keys, time, tie)
        if number:
            both = last_wins(spark.read.parquet(f"{target}/v{number - 1}").unionByName(both), keys, time, tie)
        both.write.mode("overwrite").parquet(f"{target}/v{number}")

    events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def latest(spark: SparkSession, target: str) -> DataFrame:
    """The table's last version."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(target)
    names = [s.getPath().getName() for s in path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(path)]
    return spark.read.parquet(f"{target}/v{max(int(n[1:]) for n in names if n.startswith('v'))}")
