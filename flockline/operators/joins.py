"""Joins of keyed tables: endpoints of pairs, evidence, lookups, presence, pending rows, deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that must be total."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def with_endpoints(pairs: DataFrame, attributes: DataFrame, key: str, columns: list[str], left: str = "l", right: str = "r") -> DataFrame:
    """Adds l_<column> and r_<column> of both ends; an end without a row has nulls. Pairs that carry all of these already stay as they are."""
    if all(f"{e}_{c}" in pairs.columns for e in "lr" for c in columns):
        return pairs
    for end, prefix in ((left, "l"), (right, "r")):
        side = attributes.select(F.col(key).alias("__key"), *[F.col(c).alias(f"{prefix}_{c}") for c in columns])
        pairs = pairs.join(side, F.col(end) == F.col("__key"), "left").drop("__key")
    return pairs


def date_features(pairs: DataFrame, left: str, right: str, windows: tuple[int, ...] = (7, 30, 180)) -> DataFrame:
    """Whether both dates are known, the days between them, its log1p, and whether they lie within each window."""
    known = F.col(left).isNotNull() & F.col(right).isNotNull()
    gap = F.abs(F.datediff(left, right))
    out = pairs.withColumns({"both_dates": known.cast("int"), "same_date": F.coalesce((gap == 0).cast("int"), F.lit(0)), "day_gap": gap, "log_day_gap": F.log1p(gap.cast("double"))})
    return out.withColumns({f"within_{w}": F.coalesce((F.col("day_gap") <= w).cast("int"), F.lit(0)) for w in windows})


def seed_features(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """From the ends' seed clusters: both_seeded, one_seeded, none_seeded, same_seed."""
    a, b = F.col(left).isNotNull(), F.col(right).isNotNull()
    return pairs.withColumns({"both_seeded": (a & b).cast("int"), "one_seeded": (a != b).cast("int"), "none_seeded": (~a & ~b).cast("int"), "same_seed": F.coalesce((F.col(left) == F.col(right)).cast("int"), F.lit(0))})


def profile_features(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """L1 distance and Pearson correlation of two profiles; the correlation of a constant profile is 0."""
    a, b = F.col(left), F.col(right)

    def mean(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)

    out = pairs.withColumns({"__ma": mean(a), "__mb": mean(b)})
    ca, cb = F.transform(a, lambda x: x - F.col("__ma")), F.transform(b, lambda x: x - F.col("__mb"))
    cov, va, vb = total(F.zip_with(ca, cb, lambda x, y: x * y)), total(F.transform(ca, lambda x: x * x)), total(F.transform(cb, lambda x: x * x))
    out = out.withColumns({"profile_l1": total(F.zip_with(a, b, lambda x, y: F.abs(x - y))), "profile_corr": F.when((va > 1e-12) & (vb > 1e-12), cov / F.sqrt(va * vb)).otherwise(0.0)})
    return out.drop("__ma", "__mb")


def merged_evidence(pairs: DataFrame, tables: dict[str, DataFrame], keys: list[str], columns: list[str]) -> DataFrame:
    """Left joins of evidence tables with one row a key; nulls are 0; adds <name>_<column> and min_<column> over the tables."""
    for name, t in tables.items():
        pairs = pairs.join(t.select(*keys, *[F.col(c).alias(f"{name}_{c}") for c in columns]), keys, "left").fillna(0, [f"{name}_{c}" for c in columns])
    least = {f"min_{c}": F.least(*[F.col(f"{n}_{c}") for n in tables]) if len(tables) > 1 else F.col(f"{next(iter(tables))}_{c}") for c in columns}
    return pairs.withColumns(least)


def preferred(pairs: DataFrame, scores: DataFrame, keys: list[str], score: str, order: list[Column], override: bool) -> DataFrame:
    """The best new row's score on each pair: in place of the old one if ``override``, else only where that is null; and which one it is."""
    new = best_rows(scores, keys, order).select(*keys, F.col(score).alias("__new"))
    out = pairs.join(new, keys, "left")
    first, second = ("__new", score) if override else (score, "__new")
    source = F.when(F.col(first).isNotNull(), "new" if override else "kept").when(F.col(second).isNotNull(), "kept" if override else "new").otherwise("none")
    return out.withColumn("score_source", source).withColumn(score, F.coalesce(first, second)).drop("__new")


def presence(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Full join with ``presence``: both, left_only or right_only."""
    a, b = left.withColumn("__l", F.lit(True)), right.withColumn("__r", F.lit(True))
    tag = F.when(F.col("__l") & F.col("__r"), "both").when(F.col("__l"), "left_only").otherwise("right_only")
    return a.join(b, keys, "full").withColumn("presence", tag).drop("__l", "__r")


def unique_lookup(df: DataFrame, key: str, value: str) -> DataFrame:
    """key, value of the keys that have one row only."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias(value)).where("__n = 1").drop("__n")


def staged_lookup(df: DataFrame, stages: list[tuple[str, DataFrame, str]], value: str) -> DataFrame:
    """Adds ``value`` from the first stage that knows it, and ``stage``. Stages: (name, lookup with unique keys, key column of both)."""
    for name, lookup, key in stages:
        df = df.join(lookup.select(key, F.col(value).alias(f"__{name}")), key, "left")
    found = [(name, F.col(f"__{name}")) for name, _, _ in stages]
    tag = None
    for name, c in found:
        tag = F.when(c.isNotNull(), name) if tag is None else tag.when(c.isNotNull(), name)
    return df.withColumns({"stage": tag.otherwise("unresolved"), value: F.coalesce(*[c for _, c in found])}).drop(*[f"__{n}" for n, _ in found])


def pending(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not done yet."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def duplicate_groups(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs more than once. Counts are found first, so only the keys of groups meet the rows."""
    groups = df.where(F.col(keys[0]).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    return df.join(groups, keys)


def deltas(baseline: DataFrame, other: DataFrame, keys: list[str], metrics: list[str], how: str = "inner") -> DataFrame:
    """keys and, for each metric, baseline, other and delta."""
    a = baseline.select(*keys, *[F.col(m).alias(f"{m}_baseline") for m in metrics])
    b = other.select(*keys, *[F.col(m).alias(f"{m}_other") for m in metrics])
    return b.join(a, keys, how).withColumns({f"{m}_delta": F.col(f"{m}_other") - F.col(f"{m}_baseline") for m in metrics})


def deltas_to_view(metrics: DataFrame, view: str, baseline: str, keys: list[str], names: list[str]) -> DataFrame:
    """Every other view's metrics against one view's."""
    base = metrics.where(F.col(view) == baseline).select(*keys, *names)
    rest = metrics.where(F.col(view) != baseline)
    out = rest.join(base.select(*keys, *[F.col(m).alias(f"__{m}") for m in names]), keys, "left")
    return out.withColumns({f"{m}_delta": F.col(m) - F.col(f"__{m}") for m in names}).drop(*[f"__{m}" for m in names])


def in_one_cluster(pairs: DataFrame, members: DataFrame, node: str, cluster: str, left: str = "l", right: str = "r") -> DataFrame:
    """Pairs both ends of which are in one cluster, with it."""
    a = members.select(F.col(node).alias(left), F.col(cluster).alias(cluster))
    b = members.select(F.col(node).alias(right), F.col(cluster).alias("__other"))
    return pairs.join(a, left).join(b, right).where(F.col(cluster) == F.col("__other")).drop("__other")


def within_groups(items: DataFrame, id_column: str, groups: list[str]) -> DataFrame:
    """l < r: pairs of items that agree in all group columns. For groups of bounded size: routes' clusters, seeds."""
    a = items.select(F.col(id_column).alias("l"), *groups)
    b = items.select(F.col(id_column).alias("r"), *groups)
    return a.join(b, groups).where("l < r")


def recommended(df: DataFrame, flags: DataFrame, views: DataFrame, key: str) -> DataFrame:
    """Metadata with duplicate flags and rotated views: which file to read, and whether the row is usable."""
    out = df.join(flags, key, "left").join(views, key, "left")
    return out.withColumns(
        {
            "is_exact_duplicate": F.coalesce("is_exact_duplicate", F.lit(False)),
            "input_path": F.coalesce(F.when(F.coalesce("normalization_applied", F.lit(False)), F.col("normalized_path")), F.col("path")),
            "use_for_training": F.coalesce("is_duplicate_primary", F.lit(True)),
        }
    )


def overridden(df: DataFrame, trusted: DataFrame, key: str, column: str) -> DataFrame:
    """``column`` from the trusted table where it has one; and whether it does."""
    t = trusted.select(key, F.col(column).alias("__trusted"))
    return df.join(t, key, "left").withColumns({"is_trusted": F.col("__trusted").isNotNull(), column: F.coalesce("__trusted", column)}).drop("__trusted")
