"""How partitions agree: contingency, pair metrics, votes, transitions, retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.functions.vectors import clipped
from flockline.operators.joins import with_endpoints
from flockline.operators.ranking import mirrored


def contingency(members: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    return members.groupBy(*keys, a, b).agg(F.count(F.lit(1)).alias("n"))


def pair_metrics(members: DataFrame, truth: str, predicted: str, keys: list[str]) -> DataFrame:
    """precision, recall, f1, ari, nmi, rand and counts of a partition against the truth, from the contingency table alone."""
    members = members.select(*keys, F.col(truth).alias("__t"), F.col(predicted).alias("__p"))
    cells = members.groupBy(*keys, "__t", "__p").agg(F.count(F.lit(1)).alias("__n"))
    rows, columns = cells.groupBy(*keys, "__t").agg(F.sum("__n").alias("__a")), cells.groupBy(*keys, "__p").agg(F.sum("__n").alias("__b"))

    def entropy(n: str, total: Column) -> Column:
        return -F.sum(F.col(n) / total * F.log(F.col(n) / total))

    total = cells.groupBy(*keys).agg(F.sum("__n").alias("items"))
    on = keys or ["__all"]
    if not keys:
        cells, rows, columns, total = (t.withColumn("__all", F.lit(1)) for t in (cells, rows, columns, total))
    c = cells.join(rows, [*on, "__t"]).join(columns, [*on, "__p"]).join(total, on)
    n, p = F.col("__n"), F.col("__n") / F.col("items")
    first = c.groupBy(*on).agg(F.sum(n * n).alias("s"), F.sum(p * F.log(n * F.col("items") / (F.col("__a") * F.col("__b")))).alias("mi"))
    second = rows.join(total, on).groupBy(*on).agg(F.sum(F.col("__a") * F.col("__a")).alias("sa"), entropy("__a", F.col("items")).alias("ha"), F.count(F.lit(1)).alias("identities"))
    third = columns.join(total, on).groupBy(*on).agg(F.sum(F.col("__b") * F.col("__b")).alias("sb"), entropy("__b", F.col("items")).alias("hb"), F.count(F.lit(1)).alias("clusters"), F.count_if(F.col("__b") == 1).alias("singletons"))
    m = total.join(first, on).join(second, on).join(third, on)
    m = m.withColumns({"tp": F.col("s") - F.col("items"), "fp": F.col("sb") - F.col("s"), "fn": F.col("sa") - F.col("s")}).withColumn("tn", F.col("items") * F.col("items") - F.col("fp") - F.col("fn") - F.col("s"))
    tp, fp, fn, tn = (F.col(x).cast("double") for x in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    precision, recall = F.coalesce(F.try_divide(tp, tp + fp), zero), F.coalesce(F.try_divide(tp, tp + fn), zero)
    ari = F.when((fn == 0) & (fp == 0), 1.0).otherwise(F.coalesce(F.try_divide(2 * (tp * tn - fn * fp), (tp + fn) * (fn + tn) + (tp + fp) * (fp + tn)), zero))
    nmi = F.when((F.col("identities") == 1) & (F.col("clusters") == 1), 1.0).otherwise(F.coalesce(F.try_divide(F.greatest(F.col("mi"), zero), (F.col("ha") + F.col("hb")) / 2), zero))
    rand = F.coalesce(F.try_divide(tp + tn, (F.col("items") * (F.col("items") - 1)).cast("double")), F.lit(1.0))
    out = m.withColumns({"__p": precision, "__r": recall})
    f1 = F.coalesce(F.try_divide(2 * F.col("__p") * F.col("__r"), F.col("__p") + F.col("__r")), zero)
    return out.select(*keys, "items", "identities", "clusters", F.round(F.col("singletons") / F.col("clusters"), 6).alias("singleton_ratio"), *[F.round(v, 6).alias(k) for k, v in (("precision", F.col("__p")), ("recall", F.col("__r")), ("f1", f1), ("ari", ari), ("nmi", nmi), ("rand", rand))])


def agreement_table(members: DataFrame, node: str, method: str, cluster: str) -> DataFrame:
    """Rand agreement, same-pair Jaccard, ARI and NMI of each two methods (method_a < method_b)."""
    a = members.select(node, F.col(method).alias("method_a"), F.col(cluster).alias("ca"))
    b = members.select(node, F.col(method).alias("method_b"), F.col(cluster).alias("cb"))
    both = a.join(b, node).where("method_a < method_b")
    keys = ["method_a", "method_b"]
    cells = contingency(both, "ca", "cb", keys)
    together = cells.groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("__s"))
    left = cells.groupBy(*keys, "ca").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("__a"))
    right = cells.groupBy(*keys, "cb").agg(F.sum("n").alias("n")).groupBy(*keys).agg(F.sum(F.col("n") * (F.col("n") - 1)).alias("__b"))
    jaccard = together.join(left, keys).join(right, keys).select(*keys, F.round(F.coalesce(F.try_divide("__s", F.col("__a") + F.col("__b") - F.col("__s")), F.lit(1.0)), 6).alias("pair_jaccard"))
    return pair_metrics(both, "ca", "cb", keys).select(*keys, "items", "rand", "ari", "nmi").join(jaccard, keys)


def recall_at(first_hits: DataFrame, ks: list[int]) -> DataFrame:
    """Queries, and the share whose first hit is within each k; 0 without queries. first_hits: q, first_hit."""
    return first_hits.agg(F.count(F.lit(1)).alias("queries"), *[F.round(F.coalesce(F.avg(F.coalesce(F.col("first_hit") <= k, F.lit(False)).cast("int")), F.lit(0.0)), 6).alias(f"recall_at_{k}") for k in ks])


def hit_quantiles(first_hits: DataFrame) -> DataFrame:
    """Median, and the least rank within which 90 and 95 of 100 hits lie, from counts by rank."""
    counts = first_hits.where("first_hit is not null").groupBy("first_hit").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("first_hit").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.withColumns({"upto": F.sum("n").over(order), "of": F.sum("n").over(Window.partitionBy())})
    at = [F.min(F.when(F.col("upto") >= F.ceil(q * (F.col("of") - 1)) + 1, F.col("first_hit"))).alias(name) for q, name in ((0.5, "median_hit"), (0.9, "hit_90"), (0.95, "hit_95"))]
    return placed.agg(F.max("of").alias("hits"), *at)


def candidate_recall(pairs: DataFrame, items: DataFrame, key: str, label: str) -> DataFrame:
    """Queries with a positive, the share that has one among its candidates, and candidates a query."""
    n = items.groupBy(label).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1")
    queries = items.join(n, label, "left_semi").select(F.col(key).alias("q"), F.col(label).alias("__ql"))
    found = mirrored(pairs.select("l", "r")).join(items.select(F.col(key).alias("nbr"), F.col(label).alias("__nl")), "nbr").join(queries, "q")
    per = found.groupBy("q").agg(F.max((F.col("__ql") == F.col("__nl")).cast("int")).alias("hit"), F.count(F.lit(1)).alias("candidates"))
    out = queries.join(per, "q", "left").fillna(0, ["hit", "candidates"])
    return out.agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("hit"), 6).alias("recall"), F.round(F.avg("candidates"), 6).alias("mean_candidates"))


def disagreement(pairs: DataFrame, members: DataFrame, node: str, methods: list[str], base: str, probability: str, threshold: float, width: float) -> DataFrame:
    """How methods differ on each pair from a base partition: merge and split votes, conflict ratio, vote balance, border, ambiguity, direction.

    members has a cluster column for each method."""
    out = with_endpoints(pairs, members, node, methods)
    same = {m: (F.col(f"l_{m}") == F.col(f"r_{m}")).cast("int") for m in methods}
    others = [m for m in methods if m != base]
    out = out.withColumns({f"same_{m}": c for m, c in same.items()}).drop(*[f"{e}_{m}" for e in "lr" for m in methods])
    base_same = F.col(f"same_{base}")
    differ = [F.col(f"same_{m}") != base_same for m in others]
    conflicts = sum((d.cast("int") for d in differ), F.lit(0))
    together = sum((F.col(f"same_{m}") for m in methods), F.lit(0)) / len(methods)
    out = out.withColumns(
        {
            "merge_votes": F.when(base_same == 0, conflicts).otherwise(0),
            "split_votes": F.when(base_same == 1, conflicts).otherwise(0),
            "conflict_ratio": conflicts / len(others),
            "balance": clipped(1 - F.abs(together - 0.5) / 0.5),
            "border": clipped(1 - F.abs(F.col(probability) - threshold) / max(width, 1e-6)),
            "direction": F.when(conflicts == 0, "agree").when(base_same == 0, "merge").otherwise("split"),
            "conflict_methods": F.concat_ws("|", *[F.when(d, F.lit(m)) for m, d in zip(others, differ, strict=True)]),
        }
    )
    out = out.withColumns({"vote_ratio": F.greatest("merge_votes", "split_votes") / len(others), "ambiguity": 0.50 * F.col("conflict_ratio") + 0.30 * F.col("border") + 0.20 * F.col("balance")})
    return out.withColumns({c: F.round(c, 6) for c in ("conflict_ratio", "balance", "border", "vote_ratio", "ambiguity")})


def merge_candidates(pairs: DataFrame, members: DataFrame, node: str, cluster: str, probability: str, least_votes: int) -> DataFrame:
    """Pairs of base clusters that votes would merge: support, sizes, best and mean probability, methods."""
    out = with_endpoints(pairs.where(F.col("merge_votes") >= least_votes), members, node, [cluster])
    a, b = F.least(f"l_{cluster}", f"r_{cluster}"), F.greatest(f"l_{cluster}", f"r_{cluster}")
    methods = F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("conflict_methods", r"\|"))))), "|")
    found = out.withColumns({"cluster_a": a, "cluster_b": b}).where("cluster_a < cluster_b").groupBy("cluster_a", "cluster_b").agg(F.count(F.lit(1)).alias("support"), F.round(F.max(probability), 6).alias("best"), F.round(F.avg(probability), 6).alias("mean"), F.max("merge_votes").alias("votes"), methods.alias("methods"))
    size = members.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    for end in "ab":
        found = found.join(size.select(F.col(cluster).alias(f"cluster_{end}"), F.col("n").alias(f"size_{end}")), f"cluster_{end}")
    return found


def split_candidates(pairs: DataFrame, members: DataFrame, node: str, cluster: str, probability: str, least_votes: int) -> DataFrame:
    """Base clusters that votes would split: pairs, images in them, least and mean probability."""
    out = with_endpoints(pairs.where(F.col("split_votes") >= least_votes), members, node, [cluster])
    ends = out.select(F.col(f"l_{cluster}").alias("cluster"), F.explode(F.array("l", "r")).alias("i")).groupBy("cluster").agg(F.count_distinct("i").alias("images"))
    stats = out.groupBy(F.col(f"l_{cluster}").alias("cluster")).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.min(probability), 6).alias("least"), F.round(F.avg(probability), 6).alias("mean"))
    return stats.join(ends, "cluster")


def keep_ratio(pairs: DataFrame, members: DataFrame, node: str, cluster: str, keys: list[str]) -> DataFrame:
    """The share of pairs that a partition keeps together."""
    out = with_endpoints(pairs, members, node, [cluster])
    return out.groupBy(*keys).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.coalesce(F.avg(F.coalesce(F.col(f"l_{cluster}") == F.col(f"r_{cluster}"), F.lit(False)).cast("int")), F.lit(0.0)), 6).alias("keep_ratio"))


def proxy(agreement: Column, mutual: Column, recall: Column, cluster_delta: Column, largest: Column) -> Column:
    zero = F.lit(0.0)
    return 0.45 * F.coalesce(agreement, zero) + 0.35 * F.coalesce(mutual, zero) + 0.20 * F.coalesce(recall, zero) - 0.002 * F.abs(F.coalesce(cluster_delta, F.lit(0))) - 0.001 * F.coalesce(largest, F.lit(0))


def transitions(members: DataFrame, anchor: str, variant: str) -> DataFrame:
    """What becomes of each anchor cluster: exact, split_only, merge_only or split_and_merge, and its main part."""
    cells = contingency(members, anchor, variant, [])
    sizes = cells.groupBy(variant).agg(F.sum("n").alias("__v"), F.count(F.lit(1)).alias("__feeds"))
    both = cells.join(sizes, variant)
    out = both.groupBy(anchor).agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("main_part"), F.max("__feeds").alias("__m"))
    kind = F.when((F.col("parts") == 1) & (F.col("__m") == 1), "exact").when(F.col("__m") == 1, "split_only").when(F.col("parts") == 1, "merge_only").otherwise("split_and_merge")
    return out.withColumns({"kind": kind, "main_share": F.round(F.col("main_part") / F.col("size"), 6)}).drop("__m")


def merge_events(members: DataFrame, anchor: str, variant: str) -> DataFrame:
    """Variant clusters that several anchor clusters feed."""
    return contingency(members, anchor, variant, []).groupBy(variant).agg(F.count(F.lit(1)).alias("sources"), F.sum("n").alias("size"), F.max("n").alias("largest_source")).where("sources > 1")


def partner_changes(members: DataFrame, node: str, anchor: str, variant: str) -> DataFrame:
    """For each item: partners kept, lost and won from the anchor to the variant partition; from cluster sizes, without listing partners."""
    a = members.groupBy(anchor).agg(F.count(F.lit(1)).alias("__a"))
    b = members.groupBy(variant).agg(F.count(F.lit(1)).alias("__b"))
    ab = members.groupBy(anchor, variant).agg(F.count(F.lit(1)).alias("__ab"))
    out = members.select(node, anchor, variant).join(ab, [anchor, variant]).join(a, anchor).join(b, variant)
    return out.select(node, (F.col("__ab") - 1).alias("kept"), (F.col("__a") - F.col("__ab")).alias("lost"), (F.col("__b") - F.col("__ab")).alias("won"))


def stable_clusters(cuts: DataFrame, node: str, thresholds: list[float], least: int, most: int) -> DataFrame:
    """Clusters that are the same at every threshold, by size: threshold-wise label is the least member, so equality of label and size is equality of sets when sizes agree across nested cuts."""
    sizes = cuts.groupBy("dataset", "threshold", "cluster").agg(F.count(F.lit(1)).alias("size"))
    same = sizes.where(F.col("threshold").isin(*thresholds)).groupBy("dataset", "cluster", "size").agg(F.count(F.lit(1)).alias("cuts"))
    return same.where((F.col("cuts") == len(thresholds)) & F.col("size").between(least, most)).drop("cuts")


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Confusion, accuracy and macro F1 of two 0/1 columns."""

    def n(t: int, p: int) -> Column:
        return F.count_if((F.col(truth) == t) & (F.col(predicted) == p))

    out = df.agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"), n(0, 0).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    zero = F.lit(0.0)
    f1, f0 = F.coalesce(F.try_divide(2 * tp, 2 * tp + fp + fn), zero), F.coalesce(F.try_divide(2 * tn, 2 * tn + fp + fn), zero)
    return out.withColumns({"accuracy": F.round(F.coalesce(F.try_divide(tp + tn, tp + fp + fn + tn), zero), 6), "macro_f1": F.round((f1 + f0) / 2, 6)})


def top1_transitions(before: DataFrame, after: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Each query's first neighbour before and after a reranking: corrected, harmed, stable_correct, stable_wrong. Tables: q, nbr."""
    own = labels.select(F.col(key).alias("q"), F.col(label).alias("__q"))
    other = labels.select(F.col(key).alias("nbr"), F.col(label).alias("__n"))

    def right(t: DataFrame, name: str) -> DataFrame:
        return t.select("q", "nbr").join(own, "q").join(other, "nbr").select("q", (F.col("__q") == F.col("__n")).alias(name))

    a, b = F.col("was"), F.col("is")
    return right(before, "was").join(right(after, "is"), "q").select("q", F.when(~a & b, "corrected").when(a & ~b, "harmed").when(a & b, "stable_correct").otherwise("stable_wrong").alias("transition"))


def constraint_agreement(members: DataFrame, registry: DataFrame, node: str, cluster: str) -> DataFrame:
    """Support-weighted agreement with must- and cannot-links. registry: l, r, constraint_type, support."""
    out = with_endpoints(registry, members, node, [cluster]).where(F.col(f"l_{cluster}").isNotNull() & F.col(f"r_{cluster}").isNotNull())
    same, must = F.col(f"l_{cluster}") == F.col(f"r_{cluster}"), F.col("constraint_type") == "must_link"
    w = F.col("support")
    zero = F.lit(0.0)

    def ratio(good: Column, of: Column) -> Column:
        return F.round(F.coalesce(F.try_divide(F.sum(F.when(good & of, w).otherwise(0)), F.sum(F.when(of, w).otherwise(0))), zero), 6)

    return out.agg(ratio(same, must).alias("must_agreement"), ratio(~same, ~must).alias("cannot_agreement"), ratio(same == must, F.lit(True)).alias("agreement"), F.count(F.lit(1)).alias("pairs"))


def proxy_rows(labels: DataFrame, seeds: DataFrame, candidates: DataFrame, anchor: DataFrame, recall: DataFrame, node: str, cluster: str, label: str, keys: list[str]) -> DataFrame:
    """What can be said of each partition (keys) without labels: clusters and the largest, agreement with seeds and with an anchor partition, shares of candidate and mutual pairs kept together, and the proxy of these.

    seeds: node, label; candidates: l, r, mutual; anchor: node, anchor; recall: one row with seed_recall.
    """
    sizes = labels.groupBy(*keys, cluster).agg(F.count(F.lit(1)).alias("n"))
    out = sizes.groupBy(*keys).agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"))
    for name, other, column in (("seed_agreement", seeds, label), ("anchor_agreement", anchor, "anchor")):
        out = out.join(pair_metrics(labels.join(other, node), column, cluster, keys).select(*keys, F.col("rand").alias(name)), keys, "left")
    left, right = (labels.select(F.col(node).alias(end), *keys, F.col(cluster).alias(f"__{end}")) for end in "lr")
    same = (F.col("__l") == F.col("__r")).cast("int")
    kept = candidates.join(left, "l").join(right, ["r", *keys]).groupBy(*keys).agg(F.avg(same).alias("candidate_keep"), F.avg(F.when(F.col("mutual"), same)).alias("mutual_keep"))
    out = out.join(kept, keys, "left").withColumns({c: F.round(F.coalesce(c, F.lit(0.0)), 6) for c in ("candidate_keep", "mutual_keep")})
    out = out.join(F.broadcast(anchor.agg(F.count_distinct("anchor").alias("__anchors")))).join(F.broadcast(recall))
    out = out.withColumn("cluster_delta", F.abs(F.col("clusters") - F.col("__anchors"))).drop("__anchors")
    return out.withColumn("proxy", F.round(proxy(F.col("seed_agreement"), F.col("mutual_keep"), F.col("seed_recall"), F.col("cluster_delta"), F.col("largest")), 6))
