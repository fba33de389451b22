"""Seeded samples, splits and weights. Order by MD5 of seed and id stands for a generator, so every engine draws alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def draw(seed: int, *ids: str) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(i).cast("string") for i in ids]))


def sample(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    return df.orderBy(draw(seed, key), key).limit(n)


def sample_by(df: DataFrame, keys: list[str], n: int, seed: int, key: str) -> DataFrame:
    """n rows of each group."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, key), key))).where(F.col("__n") <= n).drop("__n")


def holdout(df: DataFrame, dataset: str, identity: str, share: float, seed: int) -> DataFrame:
    """Adds ``role``: whole identities go to val, a share of those with two images or more in each dataset, one at least and not all."""
    ids = df.groupBy(dataset, identity).agg(F.count(F.lit(1)).alias("__n")).where("__n >= 2")
    size = ids.groupBy(dataset).agg(F.count(F.lit(1)).alias("__ids"))
    placed = ids.join(size, dataset).withColumn("__place", F.row_number().over(Window.partitionBy(dataset).orderBy(draw(seed, identity), identity)))
    wanted = F.least(F.greatest(F.lit(1), F.round(F.col("__ids") * share)), F.col("__ids") - 1)
    val = placed.where(F.col("__place") <= wanted).select(dataset, identity, F.lit("val").alias("__role"))
    return df.join(val, [dataset, identity], "left").withColumn("role", F.coalesce("__role", F.lit("fit"))).drop("__role")


def stratified_split(df: DataFrame, identity: str, share: float, seed: int, least_multi: int) -> DataFrame:
    """Adds ``role``: calib or fit by identity, the share drawn among single and multiple identities apart."""
    ids = df.groupBy(identity).agg((F.count(F.lit(1)) > 1).alias("__multi"))
    size = ids.groupBy("__multi").agg(F.count(F.lit(1)).alias("__ids"))
    placed = ids.join(size, "__multi").withColumn("__place", F.row_number().over(Window.partitionBy("__multi").orderBy(draw(seed, identity), identity)))
    wanted = F.when(F.col("__multi"), F.greatest(F.lit(least_multi), F.round(F.col("__ids") * share))).otherwise(F.round(F.col("__ids") * share))
    calib = placed.where(F.col("__place") <= wanted).select(identity, F.lit("calib").alias("__role"))
    return df.join(calib, identity, "left").withColumn("role", F.coalesce("__role", F.lit("fit"))).drop("__role")


def sample_groups(df: DataFrame, group: str, key: str, least: int, n_groups: int, n_rows: int, seed: int) -> DataFrame:
    """Some groups of at least ``least`` rows, and some rows of each."""
    groups = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least)
    chosen = groups.orderBy(draw(seed, group), group).limit(n_groups).select(group)
    return sample_by(df.join(chosen, group, "left_semi"), [group], n_rows, seed, key)


def top_values(df: DataFrame, column: str, key: str, n_values: int, n_rows: int, seed: int) -> DataFrame:
    """Some rows of each of the most frequent values."""
    chosen = df.groupBy(column).agg(F.count(F.lit(1)).alias("__n")).orderBy(F.col("__n").desc(), column).limit(n_values).select(column)
    return sample_by(df.join(chosen, column, "left_semi"), [column], n_rows, seed, key)


def balanced(df: DataFrame, label: str, key: str, n: int, seed: int) -> DataFrame:
    """n rows, half of each of two classes (1 and 0); what one lacks the other gives."""
    size = df.agg(F.count_if(F.col(label) == 1).alias("__ones"), F.count_if(F.col(label) == 0).alias("__zeros"))
    placed = df.where(F.col(label).isin(0, 1)).withColumn("__place", F.row_number().over(Window.partitionBy(label).orderBy(draw(seed, key), key)))
    half = n // 2
    ones = F.least(F.col("__ones"), F.greatest(F.lit(half), n - F.least(F.col("__zeros"), F.lit(n - half))))
    quota = F.when(F.col(label) == 1, ones).otherwise(n - ones)
    return placed.join(F.broadcast(size)).where(F.col("__place") <= quota).drop("__place", "__ones", "__zeros")


def bucketed(df: DataFrame, identity: str, key: str, n: int, seed: int) -> DataFrame:
    """Adds ``bucket`` by the identity's images, and keeps one row an identity: ceil(n / 4) a bucket, then others up to n."""
    sizes = df.groupBy(identity).agg(F.count(F.lit(1)).alias("images"))
    bucket = F.when(F.col("images") == 1, "singleton").when(F.col("images") == 2, "pair").when(F.col("images") <= 4, "small").otherwise("large")
    heads = sample_by(df.join(sizes.withColumn("bucket", bucket), identity), [identity], 1, seed, key)
    placed = heads.withColumn("__place", F.row_number().over(Window.partitionBy("bucket").orderBy(draw(seed, key), key)))
    first = (F.col("__place") > -(-n // 4)).cast("int")
    return placed.orderBy(first, draw(seed, key), key).limit(n).drop("__place")


def balanced_weights(df: DataFrame, label: str) -> DataFrame:
    """n / (classes * class count)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    counts = counts.withColumn("weight", F.sum("__c").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("__c")))
    return df.join(counts.drop("__c"), label)


def seed_weights(is_seed: str, factor: float) -> Column:
    return F.when(F.col(is_seed), F.lit(factor)).otherwise(F.lit(1.0))
