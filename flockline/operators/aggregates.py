"""Aggregations: counts, distributions, shapes of partitions, decisions, judgments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rounded(c: Column, places: int = 6) -> Column:
    return F.round(c, places)


def counted(df: DataFrame, keys: list[str], name: str = "rows") -> DataFrame:
    """Rows of each key; null keys are a group."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def per_identity(df: DataFrame, identity: str, keys: list[str]) -> DataFrame:
    """Images of each identity in each group; rows without an identity go."""
    return df.where(F.coalesce(F.col(identity).cast("string"), F.lit("")) != "").groupBy(*keys, identity).agg(F.count(F.lit(1)).alias("images"))


def distribution(counts: DataFrame, keys: list[str]) -> DataFrame:
    """How many identities have how many images."""
    return counts.groupBy(*keys, "images").agg(F.count(F.lit(1)).alias("identities"))


def summary(counts: DataFrame, keys: list[str]) -> DataFrame:
    single = F.count_if(F.col("images") == 1)
    n = F.count(F.lit(1))
    return counts.groupBy(*keys).agg(
        n.alias("identities"), F.sum("images").alias("images"), F.min("images").alias("least"), rounded(F.percentile("images", F.lit(0.5))).alias("median"), rounded(F.avg("images")).alias("mean"),
        rounded(F.percentile("images", F.lit(0.9))).alias("p90"), F.max("images").alias("most"), single.alias("singletons"), rounded(single / n, 4).alias("singleton_ratio"),
    )


def with_overall(counts: DataFrame, column: str, name: str = "ALL") -> DataFrame:
    """The rows once more under a group of all."""
    return counts.withColumn(column, F.lit(name)).unionByName(counts)


def shape(members: DataFrame, cluster: str, keys: list[str]) -> DataFrame:
    """Clusters, largest, singletons, their ratios, and sizes of a partition."""
    sizes = members.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("size"))
    n, single = F.count(F.lit(1)), F.count_if(F.col("size") == 1)
    return sizes.groupBy(*keys).agg(
        F.sum("size").alias("images"), n.alias("clusters"), F.max("size").alias("largest"), single.alias("singletons"), rounded(single / n).alias("singleton_ratio"),
        rounded((F.sum("size") - single) / F.sum("size")).alias("grouped_ratio"), rounded(F.avg("size")).alias("mean_size"), rounded(F.percentile("size", F.lit(0.5))).alias("median_size"), rounded(F.percentile("size", F.lit(0.9))).alias("p90_size"),
    )


def decisions(df: DataFrame, decision: str, truth: str) -> DataFrame:
    """Pairs of each decision, their share of all, and how many are true of those with a known truth (0 or 1)."""
    known = F.count_if(F.col(truth) >= 0)
    out = df.groupBy(decision).agg(F.count(F.lit(1)).alias("pairs"), known.alias("labeled"), F.count_if(F.col(truth) == 1).alias("true_pairs"))
    return out.withColumns({"share": rounded(F.col("pairs") / F.sum("pairs").over(Window.partitionBy())), "true_rate": rounded(F.coalesce(F.try_divide("true_pairs", "labeled"), F.lit(0.0)))})


def availability(df: DataFrame, keys: list[str], flags: list[str], values: list[str]) -> DataFrame:
    """Counts and ratios of flags, and means of values over the rows that have them."""
    aggregates = [F.count(F.lit(1)).alias("rows")]
    for f in flags:
        aggregates += [F.count_if(f).alias(f"{f}_count"), rounded(F.avg(F.coalesce(F.col(f), F.lit(False)).cast("int"))).alias(f"{f}_ratio")]
    return df.groupBy(*keys).agg(*aggregates, *[rounded(F.avg(v)).alias(f"mean_{v}") for v in values])


def joined_names(c: str | Column, separator: str = "|") -> Column:
    """Distinct non-empty values in order, as one text. For groups of bounded variety."""
    c = F.col(c) if isinstance(c, str) else c
    return F.array_join(F.array_sort(F.collect_set(F.when(c.cast("string") != "", c.cast("string")))), separator)


def trusted_pairs(sources: list[tuple[str, DataFrame]], key: str = "pair_key") -> DataFrame:
    """All sources' pairs together: support, sources, whether each has it, the best score. Source tables: pair_key, score."""
    rows = None
    for name, t in sources:
        t = t.select(key, "score", F.lit(name).alias("source"))
        rows = t if rows is None else rows.unionByName(t)
    flags = [F.bool_or(F.col("source") == name).alias(f"in_{name}") for name, _ in sources]
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("support"), *flags, rounded(F.max("score")).alias("best_score"), joined_names("source").alias("sources"))


def judgment_summary(judgments: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Answers by candidate and what they hint at: any no blocks, all yes accepts."""
    yes, no, unsure = (F.count_if(F.col(label) == v) for v in ("yes", "no", "uncertain"))
    out = judgments.groupBy(*keys).agg(F.count(F.lit(1)).alias("judged"), yes.alias("yes"), no.alias("no"), unsure.alias("uncertain"))
    hint = F.when((F.col("yes") > 0) & (F.col("no") > 0), "mixed").when(F.col("no") > 0, "reject").when((F.col("yes") > 0) & (F.col("uncertain") == 0), "accept").when(F.col("yes") > 0, "lean_accept").otherwise("uncertain")
    return out.withColumn("hint", hint)


def threshold_ratios(pairs: DataFrame, label: str, score: str, thresholds: list[float]) -> DataFrame:
    """For each label, mean and median score, and the share at or above each threshold."""
    return pairs.groupBy(label).agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(score)).alias("mean"), rounded(F.percentile(score, F.lit(0.5))).alias("median"), *[rounded(F.avg((F.col(score) >= t).cast("int"))).alias(f"at_{str(t).replace('.', 'p')}") for t in thresholds])


def weighted_mean(value: str, weight: str) -> Column:
    """0 where all weights are."""
    return F.coalesce(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)), F.lit(0.0))


def training_labels(df: DataFrame, dataset: str, identity: str) -> DataFrame:
    """Dense label in each dataset, the same after the labels of the datasets before, and the identity's images.

    Identities are counted first: ranks run over identities, not images."""
    ids = df.groupBy(dataset, identity).agg(F.count(F.lit(1)).alias("identity_images"))
    ids = ids.withColumn("label", (F.row_number().over(Window.partitionBy(dataset).orderBy(identity)) - 1).cast("long"))
    counts = ids.groupBy(dataset).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.select(dataset, F.coalesce(F.sum("__n").over(Window.orderBy(dataset).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__offset"))
    ids = ids.join(before, dataset).withColumn("global_label", (F.col("label") + F.col("__offset")).cast("long")).drop("__offset")
    return df.join(ids, [dataset, identity])


def alignment(pairs: DataFrame, student: str, teacher: str, keys: list[str]) -> DataFrame:
    """MSE, MAE and Pearson correlation of two scores of the same pairs; 0 for constant scores."""
    d = F.col(student) - F.col(teacher)
    return pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), rounded(F.avg(d * d)).alias("mse"), rounded(F.avg(F.abs(d))).alias("mae"), rounded(F.coalesce(F.corr(student, teacher), F.lit(0.0))).alias("pearson"))


def best_by_metric(log: DataFrame, metrics: list[str], epoch: str) -> DataFrame:
    """For each metric its best value and the earliest epoch that has it."""
    rows = [log.agg(F.lit(m).alias("metric"), F.max(F.struct(F.col(m).alias("value"), (-F.col(epoch)).alias("e"))).alias("b")).select("metric", "b.value", (-F.col("b.e")).alias(epoch)) for m in metrics]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
