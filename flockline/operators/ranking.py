"""Ranks, top-k, best rows, duplicates, candidate pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.operators.joins import best_rows, with_endpoints


def mirrored(pairs: DataFrame, left: str = "l", right: str = "r") -> DataFrame:
    """Each undirected pair in both directions: q, nbr and the other columns."""
    rest = [c for c in pairs.columns if c not in (left, right)]
    return pairs.select(F.col(left).alias("q"), F.col(right).alias("nbr"), *rest).unionByName(pairs.select(F.col(right).alias("q"), F.col(left).alias("nbr"), *rest))


def undirected(directed: DataFrame, keys: list[str], q: str = "q", nbr: str = "nbr", score: str = "score") -> DataFrame:
    """Directed rows as pairs l < r with the larger score."""
    pairs = directed.where(F.col(q) != F.col(nbr)).withColumns({"l": F.least(q, nbr), "r": F.greatest(q, nbr)})
    return pairs.groupBy(*keys, "l", "r").agg(F.max(score).alias(score), F.count(F.lit(1)).alias("directions"))


def ranked(directed: DataFrame, k: int, order: list[Column], keys: tuple[str, ...] = ("q",)) -> DataFrame:
    """The first k rows of each key, with their rank."""
    return directed.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)


def rank_or_beyond(pairs: DataFrame, ranks: DataFrame, k: int) -> DataFrame:
    """A rank for each directed pair: 0 for an item itself, k + 1 outside its top k."""
    out = pairs.join(ranks.select("q", "nbr", "rank"), ["q", "nbr"], "left")
    return out.withColumn("rank", F.when(F.col("q") == F.col("nbr"), 0).otherwise(F.coalesce("rank", F.lit(k + 1))))


def candidate_pairs(top: DataFrame, items: DataFrame, key: str, label: str) -> DataFrame:
    """Undirected candidates with both labels and the truth: 1, 0, or -1 where a label is missing."""
    pairs = with_endpoints(undirected(top, []), items, key, [label])
    truth = F.when(F.col(f"l_{label}").isNull() | F.col(f"r_{label}").isNull(), -1).otherwise((F.col(f"l_{label}") == F.col(f"r_{label}")).cast("int"))
    return pairs.withColumn("truth", truth)


def duplicate_flags(df: DataFrame, digest: str, order: list[str]) -> DataFrame:
    """Size of each digest's group, the row's place in it, and whether it is a duplicate and the first. Null digests are no duplicates."""
    # The size comes from a count, so that only groups of more than one row are ranked.
    sizes = df.where(F.col(digest).isNotNull()).groupBy(digest).agg(F.count(F.lit(1)).alias("duplicate_group_size")).where("duplicate_group_size > 1")
    place = (F.row_number().over(Window.partitionBy(digest).orderBy(*order)) - 1).cast("int")
    several = df.join(sizes, digest).withColumn("duplicate_rank", place)
    alone = df.join(sizes, digest, "left_anti").withColumns({"duplicate_group_size": F.lit(1).cast("long"), "duplicate_rank": F.lit(0)})
    both = several.unionByName(alone)
    return both.withColumns({"is_exact_duplicate": F.col("duplicate_group_size") > 1, "is_duplicate_primary": F.col("duplicate_rank") == 0})


def best_thresholds(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The best row of each key: by ari, nmi and f1, then the lowest threshold; without metrics the fewest clusters, then the lowest threshold."""
    if "ari" not in metrics.columns:
        return best_rows(metrics, keys, [F.col("clusters"), F.col("threshold")])
    return best_rows(metrics, keys, [F.col("ari").desc_nulls_last(), F.col("nmi").desc_nulls_last(), F.col("f1").desc_nulls_last(), F.col("threshold").asc()])


def best_proxy(metrics: DataFrame, ties: list[Column]) -> DataFrame:
    """Without labels: the best proxy, the least change of cluster count, the smallest largest cluster, the lowest threshold, then ``ties``."""
    return metrics.orderBy(F.col("proxy").desc_nulls_last(), F.abs("cluster_delta").asc_nulls_last(), F.col("largest").asc(), F.col("threshold").asc(), *ties).limit(1)


def in_band_first(results: DataFrame, low: int, high: int, centre: int, order: list[Column]) -> DataFrame:
    """The best row: cluster count inside a band first, then nearest to its centre, then ``order``."""
    flagged = results.withColumns({"in_band": F.col("clusters").between(low, high), "centre_error": F.abs(F.col("clusters") - centre)})
    return flagged.orderBy(F.col("in_band").desc(), F.col("centre_error"), *order).limit(1)


def best_partner(pairs: DataFrame, anchors: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """Each anchor's best partner, whichever end of a pair it is."""
    return best_rows(mirrored(pairs).join(anchors.select(F.col(key).alias("q")).distinct(), "q", "left_semi"), ["q"], order)


def top_groups(df: DataFrame, group: str, group_order: list[Column], n_groups: int, row_order: list[Column], n_rows: int) -> DataFrame:
    """The first rows of the first groups; ``group_order`` are values that a group's rows share, least first."""
    by = [f"__o{i}" for i in range(len(group_order))]
    heads = df.select(group, *[c.alias(n) for c, n in zip(group_order, by, strict=True)]).distinct()
    chosen = heads.orderBy(*by, group).limit(n_groups).select(group)
    return best_n(df.join(chosen, group, "left_semi"), [group], row_order, n_rows)


def best_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("place") <= n)


def first_hits(ranks: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """For each query whose label another item has: the rank of the first neighbour with its label, null if there is none."""
    several = labels.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    queries = labels.join(several, label, "left_semi").select(F.col(key).alias("q"), F.col(label).alias("__ql"))
    other = labels.select(F.col(key).alias("nbr"), F.col(label).alias("__nl"))
    hits = ranks.join(queries, "q").join(other, "nbr").where(F.col("__ql") == F.col("__nl")).groupBy("q").agg(F.min("rank").alias("first_hit"))
    return queries.select("q").join(hits, "q", "left")


def first_by_signature(candidates: DataFrame, signature: str, order: list[Column], n: int) -> DataFrame:
    """The first candidate of each partition signature, of those the first n."""
    return best_rows(candidates, [signature], order).orderBy(*order).limit(n)


def partition_signature(members: DataFrame, keys: list[str], node: str, cluster: str) -> DataFrame:
    """SHA-1 of 'node:cluster' entries in node order. For partitions of one dataset."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(node).alias("n"), F.col(cluster).alias("c"))))
    return members.groupBy(*keys).agg(F.sha1(F.array_join(F.transform(entries, lambda x: F.concat_ws(":", x["n"].cast("string"), x["c"].cast("string"))), "|")).alias("signature"))


def unique_pairs(directed: DataFrame, sided: list[str], order: list[Column]) -> DataFrame:
    """Directed results (q, nbr) as pairs l < r, the first row of each in ``order``; the columns q_<name> and nbr_<name> of ``sided`` become l_<name> and r_<name>. An item with itself is no pair."""
    swap = F.col("q") > F.col("nbr")
    ends = {}
    for name in sided:
        a, b = F.col(f"q_{name}"), F.col(f"nbr_{name}")
        ends |= {f"l_{name}": F.when(swap, b).otherwise(a), f"r_{name}": F.when(swap, a).otherwise(b)}
    pairs = directed.where("q <> nbr").withColumns({"l": F.least("q", "nbr"), "r": F.greatest("q", "nbr"), **ends})
    return best_rows(pairs.drop("q", "nbr", *[f"{e}_{n}" for e in ("q", "nbr") for n in sided]), ["l", "r"], order)


def cross_cluster_pairs(directed: DataFrame, members: DataFrame, node: str, cluster: str, order: list[Column]) -> DataFrame:
    """The first row in ``order`` of each pair l < r of known members in different clusters, with both clusters."""
    known = with_endpoints(unique_pairs(directed, [], order), members, node, [cluster])
    return known.where(F.col(f"l_{cluster}") != F.col(f"r_{cluster}"))


def placed(grid: DataFrame, order: list[Column]) -> DataFrame:
    """The rows of a grid of parameters with their rank; one task numbers them."""
    return grid.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))
