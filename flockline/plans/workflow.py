"""Queries over the pair tables of a review: view deltas, features of pairs, best rows, constraints, merge candidates, proxies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.functions import vectors as V
from flockline.operators import classify
from flockline.operators import graphs as G
from flockline.operators import joins as J
from flockline.operators import linkage as L
from flockline.operators import partitions as P
from flockline.operators import ranking as R
from flockline.operators import scores as X
from flockline.plans.catalog import query
from flockline.plans.identity import GRID, both_routes, dataset_size, grid_rows, near, pairs
from flockline.plans.roles import DIRS, EMB, JDG, PRS, WREG, comp_sql, half_sql, items, judgments, registry, route, top_sql
from flockline.sources.tables import table

# --- views, best rows ---------------------------------------------------------------------------------


@query("""WITH m AS (SELECT l_returnflag AS view, l_linestatus AS dataset, avg(l_quantity) AS ari, avg(l_discount) AS recall FROM lineitem GROUP BY 1, 2)
SELECT c.view, c.dataset, round(c.ari, 6) AS ari, round(c.ari - b.ari, 6) AS ari_delta, round(c.recall - b.recall, 6) AS recall_delta FROM m c LEFT JOIN m b ON b.view = 'A' AND b.dataset = c.dataset WHERE c.view <> 'A'""")
def jn_view_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN19: every other view against the view A; a dataset that A lacks has null deltas."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("view"), F.col("l_linestatus").alias("dataset")).agg(F.avg("l_quantity").alias("ari"), F.avg("l_discount").alias("recall"))
    out = J.deltas_to_view(m, "view", "A", ["dataset"], ["ari", "recall"])
    return out.select("view", "dataset", *[F.round(c, 6).alias(c) for c in ("ari", "ari_delta", "recall_delta")])


PROXIES = f"{GRID}, p AS (SELECT *, round(0.45 * ari + 0.35 * nmi + 0.20 * f1 - 0.002 * abs(clusters - 30) - 0.001 * clusters, 6) AS proxy FROM g)"


@query(f"WITH {PROXIES} SELECT dataset, threshold::DOUBLE AS threshold, proxy FROM p ORDER BY proxy DESC, abs(clusters - 30), clusters, threshold, dataset LIMIT 1")
def wn_best_proxy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN15: the best row without labels."""
    delta = F.col("clusters") - 30
    g = grid_rows(spark, sf_dir).withColumns({"proxy": F.round(P.proxy(F.col("ari"), F.col("nmi"), F.col("f1"), delta, F.col("clusters")), 6), "cluster_delta": delta, "largest": F.col("clusters")})
    return R.best_proxy(g, [F.col("dataset")]).select("dataset", F.col("threshold").cast("double").alias("threshold"), "proxy")


@query(f"WITH {GRID} SELECT dataset, threshold::DOUBLE AS threshold, clusters FROM g QUALIFY row_number() OVER (PARTITION BY dataset ORDER BY clusters, threshold) = 1")
def wn_best_unlabeled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN16: by metrics where there are any (wn_best_thresholds), else the fewest clusters."""
    g = grid_rows(spark, sf_dir).drop("ari", "nmi", "f1")
    return R.best_thresholds(g, ["dataset"]).select("dataset", F.col("threshold").cast("double").alias("threshold"), "clusters")


MATCHES = f"{DIRS}, {top_sql(5)}, d AS (SELECT q, nbr, round(score, 6) AS score, rank, (q + nbr) % 12 AS inliers, (q * nbr) % 40 AS matches, 5 + q % 30 AS q_keypoints, 5 + nbr % 30 AS nbr_keypoints FROM top)"


def matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Directed results of a local matcher: neighbours with inliers, matches and both ends' keypoints."""
    q, n = F.col("q"), F.col("nbr")
    return near(spark, sf_dir).select("q", "nbr", F.round("score", 6).alias("score"), "rank", ((q + n) % 12).alias("inliers"), ((q * n) % 40).alias("matches"), (5 + q % 30).alias("q_keypoints"), (5 + n % 30).alias("nbr_keypoints"))


@query(f"""WITH {MATCHES}, c AS (SELECT least(q, nbr) AS l, greatest(q, nbr) AS r, score, inliers, matches, rank, CASE WHEN q < nbr THEN q_keypoints ELSE nbr_keypoints END AS l_keypoints, CASE WHEN q < nbr THEN nbr_keypoints ELSE q_keypoints END AS r_keypoints FROM d)
SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY score DESC, inliers DESC, matches DESC, rank) = 1""")
def wn_unique_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN19: the better direction of each pair, both ends' columns changed over with it."""
    return R.unique_pairs(matches(spark, sf_dir), ["keypoints"], [F.desc("score"), F.desc("inliers"), F.desc("matches"), F.col("rank")])


@query(f"""WITH {MATCHES}, k AS (SELECT id, dataset || '_' || (label % 5)::VARCHAR AS cluster FROM emb WHERE label IS NOT NULL), c AS (SELECT least(q, nbr) AS l, greatest(q, nbr) AS r, score, inliers, matches FROM d WHERE q <> nbr)
SELECT l, r, score, inliers, matches, a.cluster AS l_cluster, b.cluster AS r_cluster FROM c JOIN k a ON a.id = l JOIN k b ON b.id = r WHERE a.cluster <> b.cluster QUALIFY row_number() OVER (PARTITION BY l, r ORDER BY score DESC, inliers DESC, matches DESC) = 1""")
def wn_cross_cluster_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WN20: the best row of each pair of known items in different clusters."""
    k = items(spark, sf_dir).where("label is not null").select("id", F.concat_ws("_", "dataset", (F.col("label") % 5).cast("string")).alias("cluster"))
    order = [F.desc("score"), F.desc("inliers"), F.desc("matches")]
    return R.cross_cluster_pairs(matches(spark, sf_dir), k, "id", "cluster", order).select("l", "r", "score", "inliers", "matches", "l_cluster", "r_cluster")


# --- features of pairs ---------------------------------------------------------------------------------

CAND = f"{DIRS}, {top_sql(5)}, cand AS (SELECT DISTINCT least(q, nbr) AS l, greatest(q, nbr) AS r FROM top), ends AS (SELECT l, r, a.v AS lv, b.v AS rv FROM cand JOIN emb a ON a.id = l JOIN emb b ON b.id = r)"


def ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidate pairs with both vectors."""
    return J.with_endpoints(R.undirected(near(spark, sf_dir), []).select("l", "r"), items(spark, sf_dir), "id", ["v"])


def part(left: int, right: int, n: int) -> Column:
    """The product of n dimensions of both ends' vectors, from these positions on."""
    return V.dot(F.slice("l_v", left, n), F.slice("r_v", right, n))


@query(f"""WITH {CAND}, s AS (SELECT l, r, list_dot_product(lv, rv) AS route, list_dot_product(lv[1:48], rv[1:48]) AS fusion, list_dot_product(lv[1:32], rv[1:32]) AS student, list_dot_product(lv[33:64], rv[33:64]) AS distill, (l + r) % 12 AS inliers, (l * r) % 40 AS matches, l % 30 AS lk, r % 30 AS rk FROM ends)
SELECT l, r, round(route, 6) AS route, round(route - fusion, 6) AS route_minus_fusion, round(route - student, 6) AS route_minus_student, round(student - distill, 6) AS student_minus_distill, greatest(1, least(lk, rk)) AS keypoint_min, greatest(lk, rk) AS keypoint_max, round(inliers / greatest(1, least(lk, rk)), 6) AS inlier_ratio, round(matches / greatest(1, least(lk, rk)), 6) AS match_density FROM s""")
def vc_pair_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VC15: scores of four models (here parts of the vectors), their differences, and ratios of keypoints."""
    s = ends(spark, sf_dir).withColumns({"route": V.dot(F.col("l_v"), F.col("r_v")), "fusion": part(1, 1, 48), "student": part(1, 1, 32), "distill": part(33, 33, 32), "inliers": (F.col("l") + F.col("r")) % 12, "matches": (F.col("l") * F.col("r")) % 40})
    out = X.pair_rows(s.withColumns({"l_keypoints": F.col("l") % 30, "r_keypoints": F.col("r") % 30}))
    return out.select("l", "r", *[F.round(c, 6).alias(c) for c in ("route", "route_minus_fusion", "route_minus_student", "student_minus_distill", "inlier_ratio", "match_density")], "keypoint_min", "keypoint_max")


@query(f"""WITH {CAND}, s AS (SELECT l, r, list_dot_product(lv[1:32], rv[1:32]) AS s, list_dot_product(lv[33:64], rv[33:64]) AS d, list_dot_product(lv[1:16], rv[1:16]) AS ms, list_dot_product(lv[33:48], rv[33:48]) AS md, list_dot_product(lv[1:16], rv[17:32]) AS s1, list_dot_product(lv[17:32], rv[1:16]) AS s2, list_dot_product(lv[33:48], rv[49:64]) AS d1, list_dot_product(lv[49:64], rv[33:48]) AS d2 FROM ends)
SELECT l, r, round(ms, 6) AS masked_student, round(md, 6) AS masked_distill, round((s + ms) / 2, 6) AS student_masked_mean, round(s - ms, 6) AS student_masked_gap, round((s1 + s2) / 2, 6) AS student_cross_mean, round(greatest(s1, s2), 6) AS student_cross_max, round((d + md) / 2, 6) AS distill_masked_mean, round(d - md, 6) AS distill_masked_gap, round((d1 + d2) / 2, 6) AS distill_cross_mean, round(greatest(d1, d2), 6) AS distill_cross_max, round((s + ms + d + md) / 4, 6) AS dual_mean, round((s1 + s2 + d1 + d2) / 4, 6) AS dual_cross_mean FROM s""")
def vc_dual_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VC16, VC17, VC18: twelve features of masked and crossed views, by the name of their feature set."""
    s = ends(spark, sf_dir).withColumns({"student": part(1, 1, 32), "distill": part(33, 33, 32), "masked_student": part(1, 1, 16), "masked_distill": part(33, 33, 16)})
    out = X.dual_view(s, (part(1, 17, 16), part(17, 1, 16)), (part(33, 49, 16), part(49, 33, 16)))
    return out.select("l", "r", *[F.round(c, 6).alias(c) for c in X.FEATURES["dual"]])


FLOORS = {"local": 0.6, "inliers": 6, "veto_local": 0.3, "veto_inliers": 4, "corr": 0.2, "absdiff": 0.6, "iou": 0.3, "veto_corr": 0.0, "veto_absdiff": 0.4, "veto_iou": 0.5}


@query(f"""WITH {DIRS}, {top_sql(10)}, p AS (SELECT least(q, nbr) AS l, greatest(q, nbr) AS r, coalesce(max(CASE WHEN q < nbr THEN rank END), 11) AS f, coalesce(max(CASE WHEN q > nbr THEN rank END), 11) AS b, max(score) AS score FROM top GROUP BY 1, 2), sz AS (SELECT id, label, count(*) OVER (PARTITION BY dataset) - 1 AS n FROM emb),
e AS (SELECT l, r, score, f, p.b, x.n, (x.label % 5 = y.label % 5)::BIGINT AS same_anchor, CASE WHEN l % 11 <> 0 THEN l % 10 / 10 ELSE 0 END AS lr, r % 10 / 10 AS rr, greatest(1, least(l % 30, r % 30)) AS kmin, (l + r) % 12 AS inl, (l * r) % 40 AS mat, (l + r) % 100 / 100 AS loc, ((3 * l + r) % 200 - 100) / 100 AS corr, CASE WHEN (l + r) % 13 = 0 THEN 1 ELSE (l + 7 * r) % 100 / 100 END AS ad, (l * r) % 100 / 100 AS iou, ((l + 3 * r) % 200 - 100) / 100 AS cc, ((5 * l + r) % 200 - 100) / 100 AS rc, (l + r) % 3 <> 0 AS ok FROM p JOIN sz x ON x.id = l JOIN sz y ON y.id = r)
SELECT l, r, round(score, 6) AS score, f AS rank_lr, b AS rank_rl, round(f / n, 6) AS pct_lr, round(b / n, 6) AS pct_rl, round((f + b) / 2 / n, 6) AS pct_mean, (f <= 10 AND b <= 10)::BIGINT AS mutual, same_anchor, round(abs(lr - rr), 6) AS ratio_gap, kmin AS keypoint_min, round(inl / kmin, 6) AS inlier_ratio, round(mat / kmin, 6) AS match_density, (loc >= 0.6 AND inl >= 6)::BIGINT AS local_support, (loc <= 0.3 AND inl <= 4)::BIGINT AS local_veto,
round(0.35 * corr + 0.25 * iou + 0.20 * least(1, greatest(0, 1 - ad)) + 0.10 * least(1, greatest(0, (cc + 1) * 0.5)) + 0.10 * least(1, greatest(0, (rc + 1) * 0.5)), 6) AS patch_support_score, round(0.40 * least(1, greatest(0, 1 - greatest(corr, 0))) + 0.30 * least(1, greatest(0, ad)) + 0.30 * least(1, greatest(0, 1 - iou)), 6) AS patch_veto_score,
(ok AND corr >= 0.2 AND ad <= 0.6 AND iou >= 0.3)::BIGINT AS patch_support, (ok AND corr <= 0.0 AND ad >= 0.4 AND iou <= 0.5)::BIGINT AS patch_veto FROM e""")
def vc_pair_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """VC34: ranks, local and patch evidence of candidate pairs, with support and veto flags."""
    l, r = F.col("l"), F.col("r")
    p = X.rank_features(near(spark, sf_dir, 10), dataset_size(spark, sf_dir), 10)
    p = J.with_endpoints(p, items(spark, sf_dir).select("id", (F.col("label") % 5).alias("anchor")), "id", ["anchor"])
    evidence = {
        "l_ratio": F.when(l % 11 != 0, l % 10 / 10), "r_ratio": r % 10 / 10, "l_keypoints": l % 30, "r_keypoints": r % 30, "inliers": (l + r) % 12, "matches": (l * r) % 40, "local": (l + r) % 100 / 100, "corr": ((3 * l + r) % 200 - 100) / 100,
        "absdiff": F.when((l + r) % 13 != 0, (l + 7 * r) % 100 / 100), "iou": (l * r) % 100 / 100, "column_corr": ((l + 3 * r) % 200 - 100) / 100, "row_corr": ((5 * l + r) % 200 - 100) / 100, "valid": (l + r) % 3 != 0,
    }
    out = X.pair_columns(p.withColumns(evidence), 10, FLOORS)
    whole = ("rank_lr", "rank_rl", "mutual", "same_anchor", "keypoint_min", "local_support", "local_veto", "patch_support", "patch_veto")
    return out.select("l", "r", *[F.col(c).cast("bigint").alias(c) for c in whole], *[F.round(c, 6).alias(c) for c in ("score", "pct_lr", "pct_rl", "pct_mean", "ratio_gap", "inlier_ratio", "match_density", "patch_support_score", "patch_veto_score")])


@query()
def vc_pair_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """UD40: boosted trees on neighbourhood features, fitted on at most about 20,000 pairs; every pair gets a probability."""
    top = near(spark, sf_dir, 10)
    f = X.shared_neighbours(X.rank_features(top, dataset_size(spark, sf_dir), 10), top)
    f = J.with_endpoints(f, items(spark, sf_dir), "id", ["label"]).withColumn("same", (F.col("l_label") == F.col("r_label")).cast("int"))
    names = ["score", "pct_mean", "pct_gap", "reciprocal_mean", "mutual", "shared", "shared_jaccard", "shared_mean", "shared_best"]
    model = classify.fitted(f, names, "same", ["l", "r"])
    return classify.probabilities(model, f, names).select("l", "r", "same", F.round("probability", 6).alias("probability"))


# --- constraints and merge candidates -------------------------------------------------------------------

LINKS = f"{WREG}, nodes AS (SELECT l AS id FROM wreg UNION SELECT r FROM wreg), m AS (SELECT l, r, support FROM wreg WHERE constraint_type = 'must_link' AND support > 2), {comp_sql('nodes', 'm')}"


def linked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Nodes, must-links with enough support, and their components with statistics."""
    r = registry(spark, sf_dir)
    nodes = r.select(F.col("l").alias("id")).union(r.select(F.col("r").alias("id"))).distinct()
    must = r.where("constraint_type = 'must_link' and support > 2")
    found, stats = G.constrained_components(nodes, must, r.where("constraint_type = 'cannot_link'"))
    return nodes, must, found, stats


@query(f"WITH {WREG} SELECT l, r, l % 7 AS cluster, support FROM wreg WHERE constraint_type = 'cannot_link' AND l % 7 = r % 7")
def jn_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN32: cannot-links with both ends in one cluster (here ids modulo 7)."""
    r = registry(spark, sf_dir).where("constraint_type = 'cannot_link'")
    members = r.select(F.col("l").alias("id")).union(r.select("r")).distinct().withColumn("cluster", F.col("id") % 7)
    return J.in_one_cluster(r, members, "id", "cluster").select("l", "r", "cluster", "support")


@query(f"""WITH RECURSIVE {LINKS}, bad AS (SELECT DISTINCT a.component FROM wreg JOIN comp a ON a.id = l JOIN comp b ON b.id = r WHERE constraint_type = 'cannot_link' AND a.component = b.component)
SELECT l, r, support, component FROM m JOIN comp ON id = l WHERE component NOT IN (SELECT component FROM bad)""")
def cl_clean_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL40: must-links inside components without a cannot-link."""
    _, must, found, stats = linked(spark, sf_dir)
    return G.clean_pairs(must, found, stats).select("l", "r", "support", "component")


@query(f"""WITH RECURSIVE {LINKS}, z AS (SELECT component, count(*) AS size FROM comp GROUP BY 1 HAVING count(*) > 1), o AS (SELECT *, (SELECT max(id % 7) FROM nodes) + row_number() OVER (ORDER BY size DESC, component) AS fresh FROM z)
SELECT id, size, coalesce(fresh, id % 7)::BIGINT AS cluster FROM comp LEFT JOIN o USING (component)""")
def cl_fresh_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL51: components of two or more, larger ones first, get fresh cluster ids; other items keep theirs."""
    nodes, _, found, stats = linked(spark, sf_dir)
    return G.relabelled(nodes.withColumn("cluster", F.col("id") % 7), found, stats, "id", "cluster").select("id", "size", F.col("final").alias("cluster"))


CUTS = (0.25, 0.30, 0.35)


@query(f"""WITH RECURSIVE {PRS}, mem AS (SELECT id, dataset || '_' || (label % 5)::VARCHAR AS base FROM emb), {", ".join(f"e{i} AS (SELECT l, r FROM prs WHERE score >= {t}), {comp_sql('emb', f'e{i}', f'c{i}')}" for i, t in enumerate(CUTS))},
x AS ({" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, id, component FROM c{i}" for i, t in enumerate(CUTS))}),
k AS (SELECT threshold, component, count(*) AS size, count(DISTINCT base) AS bases, string_agg(DISTINCT base, '|' ORDER BY base) AS names FROM x JOIN mem USING (id) GROUP BY 1, 2 HAVING count(DISTINCT base) > 1),
s AS (SELECT a.threshold, a.component, avg(score) AS mean, min(score) AS least FROM prs JOIN x a ON a.id = l JOIN x b ON b.id = r AND b.threshold = a.threshold AND b.component = a.component GROUP BY 1, 2)
SELECT component AS least_member, size, max(bases) AS base_clusters, max(names) AS bases, round(max(mean), 6) AS mean_score, round(min(least), 6) AS min_score, count(*) AS stable_count, string_agg(threshold::VARCHAR, '|' ORDER BY threshold) AS stable_thresholds FROM k JOIN s USING (threshold, component) GROUP BY 1, 2""")
def cl_graph_merges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CL31, CL32, CL36: components over several base clusters, their scores inside, and at how many thresholds the same set appears."""
    e = items(spark, sf_dir)
    base = e.select("id", F.concat_ws("_", "dataset", (F.col("label") % 5).cast("string")).alias("base"))
    return G.graph_merges(G.vector_cuts(e, CUTS), base, e, "id", "base")


# --- proxies, grids --------------------------------------------------------------------------------------


def rand_sql(name: str, source: str, t: str, p: str) -> str:
    """CTE: threshold and the share of pairs on which two labels of a row agree."""
    parts = {"s": "threshold, t, p", "sa": "threshold, t", "sb": "threshold, p"}
    sums = ", ".join(f"{name}_{k} AS (SELECT threshold, sum(c * c)::DOUBLE AS v, sum(c)::DOUBLE AS n FROM (SELECT {by}, count(*) AS c FROM {name}_x GROUP BY ALL) GROUP BY 1)" for k, by in parts.items())
    return f"{name}_x AS (SELECT threshold, {t} AS t, {p} AS p FROM {source}), {sums}, {name} AS (SELECT s.threshold, round(1 - (a.v + b.v - 2 * s.v) / (s.n * (s.n - 1)), 6) AS rand FROM {name}_s s JOIN {name}_sa a USING (threshold) JOIN {name}_sb b USING (threshold))"


@query(f"""WITH RECURSIVE {DIRS}, {top_sql(5)}, cand AS (SELECT least(q, nbr) AS l, greatest(q, nbr) AS r, count(*) AS ways FROM top GROUP BY 1, 2), {", ".join(f"e{i} AS (SELECT l, r FROM prs WHERE score >= {t}), {comp_sql('emb', f'e{i}', f'c{i}')}" for i, t in enumerate(CUTS))},
x AS ({" UNION ALL ".join(f"SELECT {t}::DOUBLE AS threshold, id, component FROM c{i}" for i, t in enumerate(CUTS))}),
z AS (SELECT threshold, count(*) AS clusters, max(n) AS largest FROM (SELECT threshold, component, count(*) AS n FROM x GROUP BY 1, 2) GROUP BY 1),
{rand_sql("seed", "(SELECT threshold, component, label FROM x JOIN emb USING (id) WHERE id % 3 = 0)", "label", "component")}, {rand_sql("anchor", f"(SELECT x.threshold, x.component, a.component AS anchor FROM x JOIN x a ON a.id = x.id AND a.threshold = {CUTS[1]})", "anchor", "component")},
kept AS (SELECT a.threshold, round(avg((a.component = b.component)::INT), 6) AS candidate_keep, round(avg((a.component = b.component)::INT) FILTER (WHERE ways = 2), 6) AS mutual_keep FROM cand JOIN x a ON a.id = l JOIN x b ON b.id = r AND b.threshold = a.threshold GROUP BY 1),
sn AS (SELECT q, arg_max(nbr, (score, -nbr)) AS nbr FROM dirs WHERE q % 3 = 0 AND nbr % 3 = 0 GROUP BY 1), rec AS (SELECT round(avg((a.label = b.label)::INT), 6) AS recall FROM sn JOIN emb a ON a.id = q JOIN emb b ON b.id = nbr WHERE a.label IN (SELECT label FROM emb WHERE id % 3 = 0 GROUP BY 1 HAVING count(*) > 1))
SELECT z.threshold, clusters, largest, seed.rand AS seed_agreement, candidate_keep, mutual_keep, abs(clusters - (SELECT clusters FROM z WHERE threshold = {CUTS[1]})) AS cluster_delta, anchor.rand AS anchor_agreement, recall AS seed_recall,
round(0.45 * seed.rand + 0.35 * mutual_keep + 0.20 * recall - 0.002 * abs(clusters - (SELECT clusters FROM z WHERE threshold = {CUTS[1]})) - 0.001 * largest, 6) AS proxy FROM z JOIN seed USING (threshold) JOIN anchor USING (threshold) JOIN kept USING (threshold), rec""")
def mt_proxy_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT21-24: without labels, at every threshold: shape, agreement with seeds and an anchor partition, pairs kept, proxy. Labels here are components."""
    e, p = items(spark, sf_dir), pairs(spark, sf_dir, CUTS[0])
    cuts = G.cuts(e, p, CUTS)
    return proxies(spark, sf_dir, cuts, cuts.where(F.col("threshold") == CUTS[1]).select("id", F.col("component").alias("anchor")), ["threshold"])


def proxies(spark: SparkSession, sf_dir: str, labels: DataFrame, anchor: DataFrame, keys: list[str]) -> DataFrame:
    e = items(spark, sf_dir)
    seeds = e.where("id % 3 = 0")
    recall = P.recall_at(R.first_hits(V.nearest(seeds, 1), seeds, "id", "label"), [1]).select(F.col("recall_at_1").alias("seed_recall"))
    candidates = R.undirected(near(spark, sf_dir), []).select("l", "r", (F.col("directions") == 2).alias("mutual"))
    return P.proxy_rows(labels, seeds.select("id", "label"), candidates, anchor, recall, "id", "component", "label", keys)


@query()
def mt_method_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT25: candidates of score tables, methods and thresholds, ranked by proxy; its rows are those of mt_proxy_sweep's operator."""
    e, edges = items(spark, sf_dir), []
    for half in "ab":
        p = V.pair_scores(route(spark, sf_dir, half), least=0.4).select("l", "r", "score")
        best = R.ranked(R.mirrored(p), 1, [F.desc("score"), F.col("nbr")]).select(F.col("q").alias("l"), F.col("nbr").alias("r"), "score")
        for t in (0.4, 0.5):
            edges += [x.where(F.col("score") >= t).select("l", "r", F.lit(f"{half}_{method}_{t}").alias("candidate")) for method, x in (("components", p), ("first_neighbour", best))]
    names = [f"{half}_{method}_{t}" for half in "ab" for method in ("components", "first_neighbour") for t in (0.4, 0.5)]
    labels = G.components_by(e.select("id", F.explode(F.array(*[F.lit(n) for n in names])).alias("candidate")), reduce(DataFrame.unionByName, edges), ["candidate"])
    anchor = G.components(e, pairs(spark, sf_dir, CUTS[1])).withColumnRenamed("component", "anchor")
    return R.placed(proxies(spark, sf_dir, labels, anchor, ["candidate"]), [F.desc("proxy"), F.col("cluster_delta"), F.col("largest"), F.col("candidate")])


@query()
def mt_rerank_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MT35: weights of local evidence by thresholds, each an average-linkage partition; the best row of each dataset is flagged."""
    name = F.concat_ws("@", "dataset", F.col("weight").cast("string")).alias("dataset")
    e = both_routes(spark, sf_dir).withColumn("weight", F.explode(F.array(*[F.lit(w) for w in (0.0, 0.25, 0.5)])))
    cuts = G.materialized(L.scored_sweep(e.select(name, "id", "va", "vb", "weight"), ["va", "vb", "weight"], X.local_distance, [0.5, 0.6, 0.7]))
    metrics = P.pair_metrics(cuts.join(items(spark, sf_dir).select("id", "label"), "id"), "label", "cluster", ["dataset", "threshold"])
    metrics = metrics.withColumns({"weight": F.split_part("dataset", F.lit("@"), F.lit(2)).cast("double"), "dataset": F.split_part("dataset", F.lit("@"), F.lit(1))})
    best = J.best_rows(metrics, ["dataset"], [F.desc("ari"), F.desc("nmi"), F.desc("f1"), F.col("weight"), F.col("threshold")]).select("dataset", "weight", "threshold", F.lit(True).alias("best"))
    return metrics.join(best, ["dataset", "weight", "threshold"], "left").fillna(False, ["best"])


@query(f"WITH {JDG} SELECT to_json({{'judgment_id': judgment_id, 'pair_key': pair_key, 'label': label}})::VARCHAR AS record FROM jdg ORDER BY judgment_id DESC LIMIT 20")
def rv_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """RV16: the last 20 judgments as JSON."""
    return judgments(spark, sf_dir).orderBy(F.desc("judgment_id")).limit(20).select(F.to_json(F.struct("judgment_id", "pair_key", "label")).alias("record"))
