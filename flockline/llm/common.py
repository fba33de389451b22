"""Pieces that the training-data operators share: words, stable hashes, written tables."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Between words: space and the five ASCII controls from tab to carriage return.
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; none for a null or blank text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def key52(*parts: Column | str | int) -> Column:
    """52 bits of the MD5 of the parts joined by '/', the same on every engine; null is the word null."""
    text = [F.coalesce(p.cast("string"), F.lit("null")) if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("/", *text)), 1, 13), 16, 10).cast("long")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir, or one set here where there is none."""
    context = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not where:
        warehouse = spark.conf.get("spark.sql.warehouse.dir")
        context.setCheckpointDir(f"{warehouse.rstrip('/')}/_checkpoints")
        where = context.getCheckpointDir()
    return where.rstrip("/")


#: Spark then removes the shuffle files of an execution as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Executions started inside leave no shuffle files behind: what they made is a table or a row at the driver, so nothing reads the files again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


#: Rows that Spark sends to Python at once; as long as they are on the way, an executor holds them twice.
BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Executions started inside send at most so many rows to Python at once, or fewer where the session says so."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH, before)


def written(df: DataFrame, label: str) -> DataFrame:
    """df computed once, as a Parquet table in the shared folder: it cuts the lineage and outlives executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of ``written`` that nothing reads any more."""
    for df in tables:
        context = df.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def running_total(df: DataFrame, group: list[str], key: str, ties: list[Column], value: Column, name: str, bits: int = 12) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a group's earlier rows, in the order of the 52-bit ``key``, then ``ties``.

    No task sees a whole group: rows are dealt to 2**bits ranges of the key, the
    sums of the ranges (at most groups x 2**bits rows) give each range its start,
    and a window numbers the rows inside a range.
    """
    df = df.withColumn("__range", F.shiftright(F.col(key), 52 - bits))
    by = [*group, "__range"]
    sums = df.groupBy(*by).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(*group).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"__{c}") for c in by], F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    on = same[0]
    for x in same[1:]:
        on = on & x
    inside = Window.partitionBy(*by).orderBy(F.col(key), *ties).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(starts, on).withColumn(name, F.col("__start") + F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return out.drop("__range", "__start", *[f"__{c}" for c in by])
