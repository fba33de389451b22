"""Small worked examples with known results."""

import pytest
from pyspark.sql import functions as F

from flockline.functions import text, vectors
from flockline.operators import aggregates, graphs, joins, linkage, partitions, ranking, review, sampling, scores


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def score_pairs(spark, matrix, dataset="d"):
    n = len(matrix)
    return spark.createDataFrame([(dataset, i, j, float(matrix[i][j])) for i in range(n) for j in range(i + 1, n)], "dataset string, l long, r long, score double")


def items(spark, n, dataset="d"):
    return spark.createDataFrame([(dataset, i) for i in range(n)], "dataset string, id long")


def test_identity_counts(spark):
    df = spark.createDataFrame([("A", "x", "fit"), ("A", "x", "fit"), ("A", "y", "val"), ("B", "z", "fit"), ("B", None, "fit")], "dataset string, identity string, role string")
    assert rows(aggregates.per_identity(df, "identity", ["dataset", "role"]), "dataset", "role", "identity", "images") == [("A", "fit", "x", 2), ("A", "val", "y", 1), ("B", "fit", "z", 1)]


def test_distribution_and_summary(spark):
    counts = spark.createDataFrame([("A", "p", 1), ("A", "q", 3), ("B", "r", 1)], "dataset string, identity string, images long")
    every = aggregates.with_overall(counts, "dataset")
    assert rows(aggregates.distribution(every, ["dataset"]).where("dataset = 'ALL'"), "images", "identities") == [(1, 2), (3, 1)]
    assert rows(aggregates.summary(every, ["dataset"]).where("dataset = 'ALL'"), "identities", "singletons", "singleton_ratio") == [(3, 2, 0.6667)]


def test_shape(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, 2, 2, 2])], "id long, cluster long").withColumn("d", F.lit(1))
    assert rows(aggregates.shape(df, "cluster", ["d"]), "clusters", "largest", "singletons", "grouped_ratio") == [(3, 3, 1, 0.833333)]


def test_duplicates(spark):
    df = spark.createDataFrame([(1, "a", "p1"), (2, "a", "p0"), (3, "b", "p2"), (4, None, "p3"), (5, None, "p4")], "id long, sha1 string, path string")
    assert rows(ranking.duplicate_flags(df, "sha1", ["path"]), "id", "duplicate_group_size", "duplicate_rank", "is_exact_duplicate") == [(1, 2, 1, True), (2, 2, 0, True), (3, 1, 0, False), (4, 1, 0, False), (5, 1, 0, False)]


def test_rotation(spark):
    df = spark.createDataFrame([("top",), ("right",), (" Left",), ("bottom",), ("unknown",), (None,)], "o string")
    assert [r[0] for r in df.select(text.rotation(F.col("o"))).collect()] == [0, 90, -90, 180, 0, 0]


def test_text(spark):
    df = spark.createDataFrame([("12.0", "a| b||c ", "x cluster=7 y")], "t string, p string, n string")
    assert tuple(df.select(text.id_token(F.col("t")), text.pipe_values(F.col("p")), text.origin_cluster(F.col("n")), text.threshold_tag(F.lit(0.35)), text.merged_reasons(F.lit("a|b"), F.lit(None), F.lit("b;c")), text.pair_key(F.lit(10), F.lit(9)), text.axis_angle(F.lit(170))).first()) == ("12", ["a", "b", "c"], 7, "0p35", "a;b;c", "10|9", -10)


def test_holdout(spark):
    df = spark.createDataFrame([("d", i % 4, i) for i in range(8)], "dataset string, identity long, id long")
    out = sampling.holdout(df, "dataset", "identity", 0.25, 42)
    assert out.select("role").distinct().count() == 2
    assert out.groupBy("identity").agg(F.count_distinct("role").alias("n")).where("n > 1").count() == 0


def test_recall_ignores_singletons(spark):
    e = spark.createDataFrame([(0, [1.0, 0.0], "x"), (1, [0.9, 0.1], "x"), (2, [0.0, 1.0], "y")], "id long, v array<double>, label string").withColumn("dataset", F.lit("d")).withColumn("v", vectors.unit(F.col("v")))
    hits = ranking.first_hits(vectors.nearest(e, 1), e, "id", "label")
    assert partitions.recall_at(hits, [1]).first()["recall_at_1"] == 1.0


def test_orthogonal_scores(spark):
    e = spark.createDataFrame([("d", 0, [1.0, 0.0]), ("d", 1, [0.0, 1.0])], "dataset string, id long, v array<double>")
    assert vectors.pair_scores(e).select(vectors.unit_score(F.col("score"))).first()[0] == 0.5


def test_blocks_agree(spark):
    e = spark.range(60).select((F.col("id") % 2).cast("string").alias("dataset"), "id", F.array(*[F.sin(F.col("id") * k + 1) for k in range(1, 6)]).alias("v"))
    assert rows(vectors.nearest(e, 3), "q", "nbr", "rank") == rows(vectors.nearest(e, 3, block=7), "q", "nbr", "rank")
    a, b = (rows(vectors.pair_scores(e, block=k), "l", "r", "score") for k in (2048, 7))
    assert [x[:2] for x in a] == [x[:2] for x in b] and all(abs(x[2] - y[2]) < 1e-12 for x, y in zip(a, b))


def test_top_pairs(spark):
    top = ranking.ranked(ranking.mirrored(score_pairs(spark, [[1, 0.9, 0.2], [0.9, 1, 0.8], [0.2, 0.8, 1]]).drop("dataset")), 2, [F.desc("score"), F.col("nbr")]).where("q < 2")
    assert rows(ranking.undirected(top, []), "l", "r") == [(0, 1), (0, 2), (1, 2)]


ADJ = [[1, 0.95, 0.9, 0.1], [0.95, 1, 0.2, 0.1], [0.9, 0.2, 1, 0.85], [0.1, 0.1, 0.85, 1]]
BLOCKS = [[1, 0.95, 0.1, 0.1], [0.95, 1, 0.1, 0.1], [0.1, 0.1, 1, 0.92], [0.1, 0.1, 0.92, 1]]


def test_adjacency(spark):
    found = rows(graphs.adjacency(score_pairs(spark, ADJ), 0.8, 2, mutual=True), "q", "nbr")
    assert found == [(0, 1), (0, 2), (1, 0), (2, 0), (2, 3), (3, 2)]


def test_components_and_whispers(spark):
    e, p = items(spark, 4), score_pairs(spark, BLOCKS)
    assert rows(graphs.threshold_components(e, p, 0.8), "id", "component") == [(0, 0), (1, 0), (2, 2), (3, 2)]
    assert rows(linkage.whispers(e, p.where("score >= 0.8")), "id", "cluster") == [(0, 0), (1, 0), (2, 2), (3, 2)]


def test_long_chain_components(spark):
    n = 300
    e, p = spark.range(n), spark.range(n - 1).select(F.col("id").alias("l"), (F.col("id") + 1).alias("r"))
    assert graphs.components(e, p).agg(F.max("component")).first()[0] == 0


def test_dbscan(spark):
    m = [[1.0 if i == j else 0.9 if {i, j} in ({0, 1}, {3, 4}) else 0.1 for j in range(5)] for i in range(5)]
    assert rows(graphs.dbscan(items(spark, 5), score_pairs(spark, m), 0.85, 2), "id", "component") == [(0, 0), (1, 0), (2, 2), (3, 3), (4, 3)]


def test_first_neighbour(spark):
    m = [[1, 0.9, 0.86, 0.1], [0.9, 1, 0.5, 0.1], [0.86, 0.5, 1, 0.2], [0.1, 0.1, 0.2, 1]]
    assert rows(graphs.first_neighbour_components(items(spark, 4), score_pairs(spark, m), 0.85), "id", "component") == [(0, 0), (1, 0), (2, 0), (3, 3)]


def test_seed_clusters(spark):
    e = spark.range(1, 7)
    p = spark.createDataFrame([(1, 2), (1, 3), (2, 3), (4, 5)], "l long, r long")
    assert rows(graphs.seed_clusters(e, p, 0.66, 8), "id", "size", "is_seed") == [(1, 3, True), (2, 3, True), (3, 3, True), (4, 2, True), (5, 2, True), (6, 1, False)]
    assert graphs.seed_clusters(e, p.where("l <> 1 or r <> 3"), 0.8, 8).where("is_seed and component = 1").count() == 0


def test_merge_overlay(spark):
    m = spark.createDataFrame([(i, c) for i, c in enumerate([0, 0, 1, 2, 3])], "id long, cluster long")
    assert [r[1] for r in rows(graphs.merged_clusters(m, spark.createDataFrame([(1, 2)], "l long, r long"), "id", "cluster"), "id", "merged")] == [0, 0, 1, 1, 3]


def test_pair_agreement(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2)], "a long, b long")
    assert partitions.pair_metrics(df, "a", "b", []).first()["rand"] == 0.666667


def test_neighbour_overlap(spark):
    a = spark.createDataFrame([("d", 0, 1), ("d", 0, 2), ("d", 1, 0), ("d", 1, 2)], "dataset string, q long, nbr long")
    b = spark.createDataFrame([("d", 0, 1), ("d", 0, 3), ("d", 1, 0), ("d", 1, 3)], "dataset string, q long, nbr long")
    assert scores.neighbour_overlap(a, b, ["dataset"]).first()["overlap"] == 0.333333


def test_shared_neighbours(spark):
    top = spark.createDataFrame([(0, 1, 0.9), (0, 2, 0.8), (1, 0, 0.9), (1, 2, 0.7)], "q long, nbr long, score double")
    p = spark.createDataFrame([(0, 1)], "l long, r long")
    assert tuple(scores.shared_neighbours(p, top).select("shared", F.round("shared_jaccard", 6), "shared_best").first()) == (1, 0.333333, 0.7)


def test_constrained_merges(spark):
    p = spark.createDataFrame([("d", 1, 2, 0.1, "yes"), ("d", 1, 3, 0.1, "yes"), ("d", 2, 3, 0.9, "no")], "dataset string, l long, r long, score double, label string")
    out = linkage.constrained(p, 0.5)
    assert rows(out, "step", "l", "r", "decision", "blocking") == [(0, 1, 2, "merge", None), (1, 1, 3, "blocked", "2|3"), (2, 2, 3, "skip_manual_no", None)]
    assert {r[0] for r in out.select(F.explode(F.array("l_component", "r_component"))).collect()} == {1, 3}


def test_linkage_against_brute_force(spark):
    import itertools
    import random

    draw = random.Random(5)
    n = 14
    d = [[0.0] * n for _ in range(n)]
    for i, j in itertools.combinations(range(n), 2):
        d[i][j] = d[j][i] = round(draw.random(), 3)
    p = score_pairs(spark, d).withColumnRenamed("score", "distance")
    for method, fold in (("average", lambda x: sum(x) / len(x)), ("complete", max)):
        found = linkage.sweep(items(spark, n), p, [0.3, 0.45, 0.6], method)
        for t in (0.3, 0.45, 0.6):
            groups = [{i} for i in range(n)]
            while len(groups) > 1:
                best = min((fold([d[i][j] for i in a for j in b]), min(a | b), a, b) for a, b in itertools.combinations(groups, 2) if True)[:1] and min(((fold([d[i][j] for i in a for j in b]), sorted(a), sorted(b)) for a, b in itertools.combinations(groups, 2)))
                if best[0] > t + 1e-12:
                    break
                groups = [g for g in groups if sorted(g) not in (best[1], best[2])] + [set(best[1]) | set(best[2])]
            expected = sorted((i, min(g)) for g in groups for i in g)
            assert rows(found.where(F.col("threshold") == t), "id", "cluster") == expected


def test_attach_counts_earlier_attachments(spark):
    m = spark.createDataFrame([("d", 0, 0), ("d", 1, 0), ("d", 2, 2), ("d", 3, 3)], "dataset string, id long, cluster long")
    w = spark.createDataFrame([("d", 0, 2, 0.3), ("d", 1, 2, 0.3), ("d", 2, 3, 0.3), ("d", 1, 3, 0.2)], "dataset string, l long, r long, score double")
    assert rows(linkage.attach_singletons(m, w, 2), "id", "cluster") == [(0, 0), (1, 0), (2, 0), (3, 0)]


def test_overlay_folds_in_order(spark):
    m = spark.createDataFrame([("d", i, i // 3) for i in range(6)], "dataset string, id long, cluster long")
    o = spark.createDataFrame([("d", 0, "split", 0, [1, 2]), ("d", 1, "attach", 1, [5])], "dataset string, position long, action string, anchor long, members array<long>")
    assert rows(linkage.overlaid(m, o), "id", "cluster", "changed") == [(0, 0, False), (1, 2, True), (2, 3, True), (3, 1, False), (4, 1, False), (5, 2, True)]


def test_budget(spark):
    p = spark.createDataFrame([("d", 0, 1, 0.9), ("d", 0, 2, 0.8), ("d", 1, 2, 0.7), ("d", 3, 4, 0.1)], "dataset string, l long, r long, score double")
    assert rows(linkage.budgeted(p, 2, 1), "l", "r") == [(0, 1), (3, 4)]


def test_singleton_splits(spark):
    v = spark.createDataFrame([("d", 1, 2, 3.0), ("d", 2, 3, 2.0), ("d", 1, 4, 1.0)], "dataset string, l long, r long, weight double")
    assert rows(linkage.singleton_splits(v, 5), "split") == [(2,), (4,)]


def test_mutual_best(spark):
    p = spark.createDataFrame([(0, 1, 0.96), (1, 2, 0.97), (3, 4, 0.99)], "l long, r long, score double")
    assert rows(review.mutual_best(p, 0.95), "l", "r") == [(1, 2), (3, 4)]


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "y"), (3, "z")], "id long, w string")
    assert rows(joins.presence(a, b, ["id"]), "id", "presence") == [(1, "left_only"), (2, "both"), (3, "right_only")]
    assert rows(joins.pending(a, b, ["id"]), "id") == [(1,)]


@pytest.mark.parametrize("mode, expected", [("replace", 0.4), ("max", 0.6), ("avg", 0.5), ("boost", 0.68), ("residual", 0.55)])
def test_blends(spark, mode, expected):
    df = spark.createDataFrame([(0.6, 0.4), (0.6, None)], "s double, p double")
    assert [round(r[0], 6) for r in df.select(scores.blended(F.col("s"), F.col("p"), mode)).collect()] == [expected, 0.6]


def test_every_answered_pair_is_merged(spark):
    from flockline.plans.identity import cl_constrained_partition
    from flockline.plans.roles import judgments

    sf = "/root/testdata/sf0.01"
    found = cl_constrained_partition(spark, sf).select("l", "r")
    want = judgments(spark, sf).select("l", "r").distinct()
    assert found.exceptAll(want).isEmpty() and want.exceptAll(found).isEmpty()


def test_ranks_and_sizes_follow_the_tables(spark):
    """At sf0.1 a dataset has 500 items and there are 1,000 suppliers."""
    from flockline.plans.identity import dataset_size, rv_next, vc_rank_percentiles

    assert [r.pair for r in rv_next(spark, "/root/testdata/sf0.1").collect()] == [52]
    sizes = spark.range(4).withColumnRenamed("id", "l").select(dataset_size(spark, "/root/testdata/sf0.1").alias("n")).collect()
    assert [r.n for r in sizes] == [500] * 4
    ranks = vc_rank_percentiles(spark, "/root/testdata/sf0.001").collect()
    assert max(max(r.rank_lr, r.rank_rl) for r in ranks) > 11
    assert all(0 < r.pct_mean <= 1 and abs(r.pct_lr - r.rank_lr / 124) < 1e-9 for r in ranks)


def test_whole_registry_and_bins(spark):
    from flockline.plans import identity, roles

    sf = "/root/testdata/sf0.01"
    assert identity.rv_bin_rates(spark, sf).groupBy().sum("rows").first()[0] == roles.table(spark, sf, "documents").where("n_chars > 0").count()
    pairs = roles.table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct().count()
    assert identity.cl_constraint_agreement(spark, sf).first().pairs == pairs
    few = spark.createDataFrame([(1.0, 1), (30.0, 0)], "x double, y int")
    assert [(r.bin, r.rows) for r in review.bin_rates(few, "x", "y", [0, 10, 20, 40]).orderBy("bin").collect()] == [(0, 1), (1, 0), (2, 1)]


def test_fresh_clusters(spark):
    members = spark.createDataFrame([(i, i % 2) for i in range(8)], "id long, cluster long")
    links = spark.createDataFrame([(0, 1), (2, 3), (3, 4)], "l long, r long")
    found, stats = graphs.constrained_components(members, links, links.limit(0))
    out = graphs.relabelled(members, found, stats, "id", "cluster").collect()
    assert {r.id: r.final for r in out} == {0: 3, 1: 3, 2: 2, 3: 2, 4: 2, 5: 1, 6: 0, 7: 1}


def test_unique_pairs(spark):
    rows = [(2, 1, 0.5, 20, 10), (1, 2, 0.7, 10, 20), (3, 3, 0.9, 5, 5), (4, 3, 0.2, 40, 30)]
    found = ranking.unique_pairs(spark.createDataFrame(rows, "q long, nbr long, score double, q_points int, nbr_points int"), ["points"], [F.desc("score")])
    assert sorted((r.l, r.r, r.score, r.l_points, r.r_points) for r in found.collect()) == [(1, 2, 0.7, 10, 20), (3, 4, 0.2, 30, 40)]


def test_feature_sets():
    assert scores.feature_columns("basic") == scores.FEATURES["base"]
    assert scores.feature_columns("dual_view_v1")[-1] == "dual_cross_mean"
    with pytest.raises(ValueError, match="no feature set"):
        scores.feature_columns("other")


def test_pair_classifier(spark):
    from flockline.operators import classify

    rows = spark.createDataFrame([(i, i + 1, (i * 37 % 100) / 100, None if i % 9 == 0 else i % 7, int(i * 37 % 100 > 60)) for i in range(400)], "l long, r long, a double, b int, same int")
    for most in (20_000, 150):
        out = classify.probabilities(classify.fitted(rows, ["a", "b"], "same", ["l", "r"], most), rows, ["a", "b"]).collect()
        assert len(out) == 400 and sum((r.probability > 0.5) == (r.same == 1) for r in out) > 390
