"""Queries: scans, projections, joins, aggregations, sets, samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.functions import text as T
from flockline.operators import aggregates as A
from flockline.operators import joins as J
from flockline.operators import ranking as R
from flockline.operators import sampling as S
from flockline.operators import sets
from flockline.plans.catalog import query
from flockline.plans.roles import EMB, IMG, JDG, images, items, judgments
from flockline.sources import tables as C
from flockline.sources.tables import table


# --- scans and alignment -------------------------------------------------------------------------


@query(f"WITH {IMG} SELECT image_id, dataset, split, identity, path FROM img WHERE identity <> '' AND path <> ''")
def src_labeled_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC1-3, SRC15."""
    return C.labeled(C.require(images(spark, sf_dir), ("image_id", "identity", "path", "dataset"))).select("image_id", "dataset", "split", "identity", "path")


@query("SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS embedding_row FROM embeddings")
def src_embedding_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC4, SRC5."""
    return sets.positions(table(spark, sf_dir, "embeddings").select("vec_id"), "vec_id", "embedding_row")


@query("""WITH c AS (SELECT doc_id, lang, CASE WHEN doc_id % 50 = 3 THEN 'moved' ELSE source END AS source FROM documents WHERE doc_id % 97 <> 5)
SELECT d.doc_id, CASE WHEN c.doc_id IS NULL THEN 'missing' ELSE 'different' END AS reason FROM documents d LEFT JOIN c USING (doc_id) WHERE c.doc_id IS NULL OR c.source <> d.source""")
def src_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    other = d.where("doc_id % 97 <> 5").withColumn("source", F.when(F.col("doc_id") % 50 == 3, "moved").otherwise(F.col("source")))
    return C.mismatches(d, other, ["doc_id"])


@query("SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def src_reordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC7-10."""
    return C.aligned(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ["doc_id"], check=False).select("doc_id", F.col("quality").cast("bigint").alias("quality"), F.col("toxic").cast("bigint").alias("toxic"))


@query("SELECT user_id, json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events WHERE event_type IN ('click', 'view') GROUP BY 1, 2")
def src_json_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC11-13, SRC16: JSON fields by schema, known kinds only."""
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "view"))
    return e.select("user_id", F.from_json("props", "k bigint").alias("p")).groupBy("user_id", F.col("p.k").alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT conv_id, rank, neighbor, score FROM (SELECT conv_id, unnest([1::BIGINT, 2::BIGINT]) AS rank, unnest([a, b]) AS neighbor, unnest([sa, sb]) AS score FROM
(SELECT conv_id, max(CASE WHEN turn = 0 THEN role END) AS a, max(CASE WHEN turn = 1 THEN role END) AS b, max(CASE WHEN turn = 0 THEN length(text) END) AS sa, max(CASE WHEN turn = 1 THEN length(text) END) AS sb FROM conversations GROUP BY conv_id)) WHERE neighbor IS NOT NULL""")
def src_wide_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC14."""
    c = table(spark, sf_dir, "conversations")
    at = [F.max(F.when(F.col("turn") == k, v)).alias(f"rank_{k + 1}_{n}") for k in (0, 1) for n, v in (("id", F.col("role")), ("score", F.length("text").cast("bigint")))]
    return C.wide_ranks(c.groupBy("conv_id").agg(*at), "conv_id", 2)


@query("SELECT vec_id AS image_id, 'cluster_' || label::VARCHAR AS cluster FROM embeddings WHERE vec_id % 3 = 0")
def snk_submission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK1."""
    e = table(spark, sf_dir, "embeddings")
    sample = e.where("vec_id % 3 = 0").select(F.col("vec_id").alias("image_id"))
    return C.submission(sample, e.select(F.col("vec_id").alias("image_id"), F.concat(F.lit("cluster_"), F.col("label").cast("string")).alias("label")), "image_id", "label", "cluster")


# --- projections ---------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN a IN ('', 'nan', 'none', 'missing', 'unknown') THEN '' ELSE a END AS o,
CASE WHEN a IN ('', 'unknown') OR b IN ('', 'unknown') THEN 'unknown' WHEN least(a, b) || '__' || greatest(a, b) IN ('bottom__bottom', 'bottom__top', 'left__left', 'left__right', 'right__right', 'top__top') THEN least(a, b) || '__' || greatest(a, b) ELSE 'other_known' END AS pair,
CASE a WHEN 'top' THEN 0 WHEN 'right' THEN 90 WHEN 'bottom' THEN 180 WHEN 'left' THEN -90 ELSE 0 END::BIGINT AS degrees
FROM (SELECT o_orderkey, ['top', 'right', 'bottom', 'left', 'unknown'][(o_orderkey % 5 + 1)::INT] AS a, ['left', 'top', 'unknown', 'bottom'][(o_custkey % 4 + 1)::INT] AS b FROM orders)""")
def prj_orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ1, PRJ2, PRJ12."""
    names = F.array(*map(F.lit, ("top", "right", "bottom", "left", "unknown")))
    others = F.array(*map(F.lit, (" Left", "TOP ", "NaN", "bottom")))
    a, b = F.get(names, (F.col("o_orderkey") % 5).cast("int")), F.get(others, (F.col("o_custkey") % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", T.orientation(a).alias("o"), T.orientation_pair(a, b).alias("pair"), T.rotation(a).cast("bigint").alias("degrees"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, least(l_partkey::VARCHAR, l_suppkey::VARCHAR) || '|' || greatest(l_partkey::VARCHAR, l_suppkey::VARCHAR) AS pair_key, (((l_partkey + 90) % 180) - 90)::BIGINT AS angle FROM lineitem")
def prj_pair_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ3, PRJ13."""
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), T.pair_key(F.col("l_partkey"), F.col("l_suppkey")).alias("pair_key"), T.axis_angle(F.col("l_partkey")).cast("bigint").alias("angle"))


@query("""SELECT p_partkey, list_filter(list_transform(string_split(replace(p_name, ' ', ' | '), '|'), lambda x: trim(x)), lambda x: x <> '') AS parts, regexp_replace(p_retailprice::VARCHAR, '^(-?[0-9]+)[.]0$', '\\1') AS token,
regexp_extract(p_brand, '#([0-9]+)', 1)::BIGINT AS brand_no, lower(regexp_replace(p_name, '\\s+', '', 'g')) AS lookup, lower(regexp_replace(p_type || p_name, '[^A-Za-z0-9]', '', 'g')) AS stem FROM part""")
def prj_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ5-11."""
    p = table(spark, sf_dir, "part")
    fields = T.name_fields(F.col("p_brand"), "^Brand#([0-9]+)$", ("no",))
    path = F.concat(F.lit("img/x/"), F.col("p_type"), F.col("p_name"), F.lit(".jpg"))
    return p.select("p_partkey", T.pipe_values(F.replace("p_name", F.lit(" "), F.lit(" | "))).alias("parts"), T.id_token(F.col("p_retailprice")).alias("token"), fields["no"].cast("bigint").alias("brand_no"), T.lookup_key(F.col("p_name")).alias("lookup"), T.stem_key(path).alias("stem"))


@query("""SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN l_quantity < 5 THEN 'few' WHEN l_discount >= 0.08 THEN 'discount' WHEN l_tax > 0.06 THEN 'tax' ELSE 'applied' END AS reason,
CASE l_returnflag WHEN 'A' THEN 0.1 WHEN 'R' THEN 0.25 ELSE 0.05 END::DOUBLE AS padding, CASE WHEN l_quantity < 10 THEN 'score=' || printf('%.3f', l_quantity) WHEN l_discount < 0.03 THEN 'margin=' || printf('%.3f', l_discount) ELSE 'pass' END AS gate,
replace(rtrim(rtrim(printf('%.3f', l_discount), '0'), '.'), '.', 'p') AS tag FROM lineitem""")
def prj_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ14-16, PRJ23."""
    q, d = F.col("l_quantity"), F.col("l_discount")
    reason = T.first_rule([(q < 5, "few"), (d >= 0.08, "discount"), (F.col("l_tax") > 0.06, "tax")], "applied")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), reason.alias("reason"), T.by_group(F.col("l_returnflag"), {"A": 0.1, "R": 0.25}, 0.05).alias("padding"), T.gate(q, 10, d, 0.03).alias("gate"), T.threshold_tag(d).alias("tag"))


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN quality = 0 THEN 'poor' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL), ';') AS reasons, coalesce(quality, -1)::DOUBLE AS quality_or FROM documents LEFT JOIN labels USING (doc_id)""")
def prj_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ17-22."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    parts = [F.when(F.col("n_chars") < 300, "short| short"), F.when(F.col("quality") == 0, "poor"), F.when(F.col("toxic") == 1, "toxic;")]
    return d.select("doc_id", T.merged_reasons(*parts).alias("reasons"), T.number_or(F.col("quality").cast("string"), -1).alias("quality_or"))


@query("SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_returnflag = 'R' AND l_discount >= 0.05 ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 25")
def prj_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ24-26: a declared predicate, an order, the first rows (a top-k report)."""
    rows = table(spark, sf_dir, "lineitem").where("l_quantity > 40 and l_returnflag = 'R' and l_discount >= 0.05").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber").limit(25)
    return rows.select("l_orderkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), "l_quantity")


@query(f"WITH {EMB} SELECT dataset, sha1(string_agg(id::VARCHAR || ':' || label::VARCHAR, '|' ORDER BY id)) AS signature FROM emb GROUP BY dataset")
def prj_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ27, PRJ28."""
    return R.partition_signature(items(spark, sf_dir), ["dataset"], "id", "label")


# --- joins -----------------------------------------------------------------------------------------


@query("""WITH p AS (SELECT a.o_orderkey AS l, b.o_orderkey AS r, a.o_orderdate::DATE AS da, b.o_orderdate::DATE AS db, a.o_orderstatus AS sa, b.o_orderstatus AS sb FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey < b.o_orderkey)
SELECT l, r, abs(date_diff('day', da, db))::BIGINT AS day_gap, round(ln(1 + abs(date_diff('day', da, db))), 6) AS log_day_gap, (da = db)::BIGINT AS same_date, (abs(date_diff('day', da, db)) <= 7)::BIGINT AS within_7, (abs(date_diff('day', da, db)) <= 30)::BIGINT AS within_30, (abs(date_diff('day', da, db)) <= 180)::BIGINT AS within_180, (sa = sb)::BIGINT AS same_status FROM p""")
def jn_pair_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN1: pairs of a customer's orders; groups are as small as customers' orders."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_custkey", F.to_date("o_orderdate").alias("date"), F.col("o_orderstatus").alias("status"))
    pairs = J.with_endpoints(J.within_groups(o, "id", ["o_custkey"]).select("l", "r"), o, "id", ["date", "status"])
    out = J.date_features(pairs, "l_date", "r_date")
    return out.select("l", "r", F.col("day_gap").cast("bigint").alias("day_gap"), F.round("log_day_gap", 6).alias("log_day_gap"), *[F.col(c).cast("bigint").alias(c) for c in ("same_date", "within_7", "within_30", "within_180")], (F.col("l_status") == F.col("r_status")).cast("bigint").alias("same_status"))


@query(f"""WITH {JDG}, s AS (SELECT c_custkey AS id, CASE WHEN c_acctbal > 3000 THEN c_nationkey::BIGINT END AS seed FROM customer), p AS (SELECT DISTINCT l, r FROM jdg)
SELECT p.l, p.r, (a.seed IS NOT NULL AND b.seed IS NOT NULL)::BIGINT AS both_seeded, ((a.seed IS NULL) <> (b.seed IS NULL))::BIGINT AS one_seeded, (a.seed IS NULL AND b.seed IS NULL)::BIGINT AS none_seeded, coalesce((a.seed = b.seed)::BIGINT, 0) AS same_seed FROM p LEFT JOIN s a ON a.id = p.l LEFT JOIN s b ON b.id = p.r""")
def jn_seed_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN2."""
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_acctbal") > 3000, F.col("c_nationkey")).alias("seed"))
    pairs = J.with_endpoints(judgments(spark, sf_dir).select("l", "r").distinct(), seeds, "id", ["seed"])
    return J.seed_features(pairs, "l_seed", "r_seed").select("l", "r", *[F.col(c).cast("bigint").alias(c) for c in ("both_seeded", "one_seeded", "none_seeded", "same_seed")])


@query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), p AS (SELECT a.vec_id AS l, b.vec_id AS r, a.v AS x, b.v AS y FROM e a JOIN e b ON b.vec_id = a.vec_id + 1)
SELECT l, r, round(list_sum(list_transform(list_zip(x, y), lambda t: abs(t[1] - t[2]))), 6) AS l1, round((SELECT corr(u, w) FROM (SELECT unnest(x) AS u, unnest(y) AS w)), 6) AS corr FROM p""")
def jn_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN3."""
    e = items(spark, sf_dir)
    pairs = J.with_endpoints(e.select(F.col("id").alias("l"), (F.col("id") + 1).alias("r")), e, "id", ["v"]).where("r_v is not null")
    return J.profile_features(pairs, "l_v", "r_v").select("l", "r", F.round("profile_l1", 6).alias("l1"), F.round("profile_corr", 6).alias("corr"))


@query("""WITH b AS (SELECT DISTINCT l_partkey AS p, l_suppkey AS s FROM lineitem), m AS (SELECT l_partkey AS p, l_suppkey AS s, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2), n AS (SELECT l_partkey AS p, l_suppkey AS s, max(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1, 2)
SELECT b.p, b.s, coalesce(m.q, 0) AS masked_q, coalesce(n.q, 0) AS aligned_q, least(coalesce(m.q, 0), coalesce(n.q, 0)) AS min_q FROM b LEFT JOIN m USING (p, s) LEFT JOIN n USING (p, s)""")
def jn_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN4, JN5, JN8."""
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_quantity").alias("q"), "l_returnflag")
    best = {n: li.where(F.col("l_returnflag") == f).groupBy("p", "s").agg(F.max("q").alias("q")) for n, f in (("masked", "R"), ("aligned", "A"))}
    return J.merged_evidence(li.select("p", "s").distinct(), best, ["p", "s"], ["q"])


@query("""WITH best AS (SELECT * FROM (SELECT o_custkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F') WHERE n = 1)
SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_acctbal END, o_totalprice) AS score, CASE WHEN c_acctbal >= 0 THEN 'kept' WHEN o_totalprice IS NOT NULL THEN 'new' ELSE 'none' END AS score_source FROM customer LEFT JOIN best ON o_custkey = c_custkey""")
def jn_best_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN6, JN7."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("score"))
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_totalprice").alias("score"), "o_orderkey")
    return J.preferred(c, o, ["c_custkey"], "score", [F.desc("score"), F.col("o_orderkey")], override=False)


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS doc_id, CASE WHEN d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL THEN 'both' WHEN d.doc_id IS NOT NULL THEN 'left_only' ELSE 'right_only' END AS presence
FROM (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def jn_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10."""
    return J.presence(table(spark, sf_dir, "documents").where("doc_id % 3 <> 0").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id").distinct(), ["doc_id"])


@query("""WITH u AS (SELECT p_name, p_brand FROM part QUALIFY count(*) OVER (PARTITION BY p_name || p_brand) = 1), w AS (SELECT p_name || p_brand AS k, min(p_partkey) AS v FROM part GROUP BY 1 HAVING count(*) = 1), t AS (SELECT p_type AS k2, min(p_partkey) AS v2 FROM part GROUP BY 1 HAVING count(*) = 1)
SELECT p_partkey, CASE WHEN v IS NOT NULL THEN 'exact' WHEN v2 IS NOT NULL THEN 'stem' ELSE 'unresolved' END AS stage, coalesce(v, v2) AS found FROM part LEFT JOIN w ON k = p_name || p_brand LEFT JOIN t ON k2 = p_type""")
def jn_staged_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11, JN12."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", "p_brand").alias("k"), F.col("p_type").alias("k2"))
    named = p.withColumnRenamed("p_partkey", "found")
    stages = [("exact", J.unique_lookup(named, "k", "found"), "k"), ("stem", J.unique_lookup(named, "k2", "found"), "k2")]
    return J.staged_lookup(p, stages, "found").select("p_partkey", "stage", "found")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def jn_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, JN14."""
    return J.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query(f"WITH {IMG} SELECT image_id, sha1, count(*) OVER (PARTITION BY sha1) AS group_size FROM img QUALIFY count(*) OVER (PARTITION BY sha1) > 1")
def jn_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15."""
    return J.duplicate_groups(images(spark, sf_dir).select("image_id", "sha1"), ["sha1"])


@query("""WITH m AS (SELECT l_returnflag AS view, l_linestatus AS dataset, avg(l_quantity) AS q, avg(l_discount) AS d FROM lineitem GROUP BY 1, 2)
SELECT b.dataset, round(b.q, 6) AS q_other, round(a.q, 6) AS q_baseline, round(b.q - a.q, 6) AS q_delta, round(b.d - a.d, 6) AS d_delta FROM m a JOIN m b ON a.dataset = b.dataset AND a.view = 'N' AND b.view = 'R'""")
def jn_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16-18, JN20."""
    m = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("view"), F.col("l_linestatus").alias("dataset")).agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"))
    out = J.deltas(m.where("view = 'N'"), m.where("view = 'R'"), ["dataset"], ["q", "d"])
    return out.select("dataset", *[F.round(c, 6).alias(c) for c in ("q_other", "q_baseline", "q_delta", "d_delta")])


@query(f"""WITH {IMG}, f AS (SELECT image_id, count(*) OVER (PARTITION BY sha1) > 1 AS dup, row_number() OVER (PARTITION BY sha1 ORDER BY path, image_id) = 1 AS prim FROM img)
SELECT image_id, dup AS is_exact_duplicate, prim AS use_for_training, CASE WHEN image_id % 4 = 1 THEN 'norm/' || image_id::VARCHAR ELSE path END AS input_path FROM img JOIN f USING (image_id)""")
def jn_enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN21, JN23-25."""
    i = images(spark, sf_dir)
    flags = R.duplicate_flags(i, "sha1", ["path", "image_id"]).select("image_id", "is_exact_duplicate", "is_duplicate_primary")
    views = i.where("image_id % 4 = 1").select("image_id", F.lit(True).alias("normalization_applied"), F.concat(F.lit("norm/"), F.col("image_id").cast("string")).alias("normalized_path"))
    return J.recommended(i.select("image_id", "path"), flags, views, "image_id").select("image_id", "is_exact_duplicate", "use_for_training", "input_path")


@query("SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 99 ELSE c_nationkey END::BIGINT AS seed, c_custkey % 7 = 0 AS is_trusted FROM customer")
def jn_trusted_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN26, JN27."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("bigint").alias("seed"))
    return J.overridden(c, c.where("c_custkey % 7 = 0").select("c_custkey", F.lit(99).cast("bigint").alias("seed")), "c_custkey", "seed").select("c_custkey", "seed", "is_trusted")


@query("SELECT s_nationkey::BIGINT AS class, count(*) AS members FROM supplier WHERE s_nationkey < 12 AND NOT (s_suppkey % 5 = 0) GROUP BY 1")
def jn_approved_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN29-31."""
    s = table(spark, sf_dir, "supplier")
    approved = spark.range(12).select(F.col("id").cast("int").alias("s_nationkey"))
    return J.pending(s.join(approved, "s_nationkey"), s.where("s_suppkey % 5 = 0"), ["s_suppkey"]).groupBy(F.col("s_nationkey").cast("bigint").alias("class")).agg(F.count(F.lit(1)).alias("members"))


# --- aggregations ------------------------------------------------------------------------------------

ORD = "o AS (SELECT c_custkey, n_name AS dataset, o_orderstatus AS role FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN orders ON o_custkey = c_custkey), cnt AS (SELECT dataset, c_custkey, count(*) AS images FROM o GROUP BY 1, 2)"
SUM = "count(*) AS identities, sum(images)::BIGINT AS images, min(images) AS least, round(quantile_cont(images, 0.5), 6) AS median, round(avg(images), 6) AS mean, round(quantile_cont(images, 0.9), 6) AS p90, max(images) AS most, count(*) FILTER (WHERE images = 1) AS singletons, round(count(*) FILTER (WHERE images = 1) / count(*), 4) AS singleton_ratio"


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n, o = (table(spark, sf_dir, t) for t in ("customer", "nation", "orders"))
    rows = c.join(n, c.c_nationkey == n.n_nationkey).join(o, c.c_custkey == o.o_custkey).select("c_custkey", F.col("n_name").alias("dataset"), F.col("o_orderstatus").alias("role"))
    return A.per_identity(rows, "c_custkey", ["dataset"])


@query(f"WITH {IMG} SELECT dataset, split, count(*) AS images FROM img GROUP BY 1, 2")
def ag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG1, AG4."""
    return A.counted(images(spark, sf_dir), ["dataset", "split"], "images")


@query(f"WITH {ORD}, w AS (SELECT 'ALL' AS dataset, c_custkey, images FROM cnt UNION ALL SELECT * FROM cnt) SELECT dataset, {SUM} FROM w GROUP BY dataset")
def ag_identity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG2, AG6, AG7."""
    return A.summary(A.with_overall(identities(spark, sf_dir), "dataset"), ["dataset"])


@query(f"WITH {ORD} SELECT dataset, images, count(*) AS identities FROM cnt GROUP BY 1, 2")
def ag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG5."""
    return A.distribution(identities(spark, sf_dir), ["dataset"])


@query(f"WITH {EMB}, s AS (SELECT dataset, label, count(*) AS size FROM emb GROUP BY 1, 2) SELECT dataset, sum(size)::BIGINT AS images, count(*) AS clusters, max(size) AS largest, count(*) FILTER (WHERE size = 1) AS singletons, round(count(*) FILTER (WHERE size = 1) / count(*), 6) AS singleton_ratio, round((sum(size) - count(*) FILTER (WHERE size = 1)) / sum(size), 6) AS grouped_ratio, round(avg(size), 6) AS mean_size, round(quantile_cont(size, 0.5), 6) AS median_size, round(quantile_cont(size, 0.9), 6) AS p90_size FROM s GROUP BY dataset")
def ag_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG8-13."""
    return A.shape(items(spark, sf_dir), "label", ["dataset"])


@query("""WITH d AS (SELECT CASE WHEN l_quantity < 10 THEN 'hard' WHEN l_quantity < 20 THEN 'soft' ELSE 'support' END AS decision, CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 0 ELSE -1 END AS truth FROM lineitem)
SELECT decision, count(*) AS pairs, count(*) FILTER (WHERE truth >= 0) AS labeled, count(*) FILTER (WHERE truth = 1) AS true_pairs, round(count(*) / (SELECT count(*) FROM d), 6) AS share, round(count(*) FILTER (WHERE truth = 1) / count(*) FILTER (WHERE truth >= 0), 6) AS true_rate FROM d GROUP BY decision""")
def ag_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG14-16."""
    q = F.col("l_quantity")
    d = table(spark, sf_dir, "lineitem").select(T.first_rule([(q < 10, "hard"), (q < 20, "soft")], "support").alias("decision"), F.when(F.col("l_returnflag") == "R", 1).when(F.col("l_returnflag") == "A", 0).otherwise(-1).alias("truth"))
    return A.decisions(d, "decision", "truth")


@query("SELECT lang, source, count(*) AS rows, count(*) FILTER (WHERE q) AS labeled_count, round(avg(coalesce(q, false)::INT), 6) AS labeled_ratio, round(avg(n_chars), 6) AS mean_n_chars FROM (SELECT lang, source, n_chars, quality IS NOT NULL AS q FROM documents LEFT JOIN labels USING (doc_id)) GROUP BY 1, 2")
def ag_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG3, AG17-26."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left").withColumn("labeled", F.col("quality").isNotNull())
    return A.availability(d, ["lang", "source"], ["labeled"], ["n_chars"])


@query("SELECT l_suppkey, count(*) AS n, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1")
def ag_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG27, AG28."""
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), A.joined_names("l_returnflag").alias("flags"))


@query(f"""WITH {JDG}, u AS (SELECT pair_key, value, 'manual' AS source FROM jdg WHERE label = 'yes' UNION ALL SELECT pair_key, value, 'seed' FROM jdg WHERE label = 'uncertain')
SELECT pair_key, count(*) AS support, bool_or(source = 'manual') AS in_manual, bool_or(source = 'seed') AS in_seed, round(max(value), 6) AS best_score, string_agg(DISTINCT source, '|' ORDER BY source) AS sources FROM u GROUP BY 1""")
def ag_trusted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG29, AG30."""
    j = judgments(spark, sf_dir).withColumnRenamed("value", "score")
    return A.trusted_pairs([("manual", j.where("label = 'yes'")), ("seed", j.where("label = 'uncertain'"))])


@query(f"""WITH {JDG}, c AS (SELECT l, count(*) AS judged, count(*) FILTER (WHERE label = 'yes') AS yes, count(*) FILTER (WHERE label = 'no') AS no, count(*) FILTER (WHERE label = 'uncertain') AS uncertain FROM jdg GROUP BY l)
SELECT *, CASE WHEN yes > 0 AND no > 0 THEN 'mixed' WHEN no > 0 THEN 'reject' WHEN yes > 0 AND uncertain = 0 THEN 'accept' WHEN yes > 0 THEN 'lean_accept' ELSE 'uncertain' END AS hint FROM c""")
def ag_judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG31."""
    return A.judgment_summary(judgments(spark, sf_dir), ["l"])


@query(f"WITH {JDG} SELECT label, count(*) AS pairs, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(avg((value >= 5)::INT), 6) AS at_5, round(avg((value >= 20)::INT), 6) AS at_20 FROM jdg GROUP BY label")
def ag_threshold_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG32, AG33."""
    return A.threshold_ratios(judgments(spark, sf_dir), "label", "value", [5, 20])


@query("SELECT l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS purity FROM lineitem GROUP BY 1")
def ag_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG34, AG35."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(A.weighted_mean("l_discount", "l_quantity"), 6).alias("purity"))


@query(f"""WITH {IMG}, i AS (SELECT dataset, identity, count(*) AS identity_images FROM img WHERE identity <> '' GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY identity) - 1 AS label, row_number() OVER (ORDER BY dataset, identity) - 1 AS global_label FROM i)
SELECT image_id, dataset, identity, label, global_label, identity_images FROM img JOIN r USING (dataset, identity)""")
def ag_training_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG36-38."""
    return A.training_labels(images(spark, sf_dir).where("identity <> ''").select("image_id", "dataset", "identity"), "dataset", "identity")


@query("""WITH l AS (SELECT l_linenumber::BIGINT AS epoch, round(avg(l_quantity), 6) AS ari, round(avg(l_discount), 6) AS nmi FROM lineitem GROUP BY 1)
SELECT 'ari' AS metric, arg_max(ari, (ari, -epoch)) AS value, arg_max(epoch, (ari, -epoch)) AS epoch FROM l UNION ALL SELECT 'nmi', arg_max(nmi, (nmi, -epoch)), arg_max(epoch, (nmi, -epoch)) FROM l""")
def ag_best_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AG40, AG41."""
    log = table(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").cast("bigint").alias("epoch")).agg(F.round(F.avg("l_quantity"), 6).alias("ari"), F.round(F.avg("l_discount"), 6).alias("nmi"))
    return A.best_by_metric(log, ["ari", "nmi"], "epoch")


# --- sets ----------------------------------------------------------------------------------------------


@query("SELECT c_custkey, c_acctbal, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS state FROM customer")
def st_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST1, ST2, ST9."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit("old").alias("state"))
    return sets.upsert(c, c.where("c_custkey % 3 = 0").withColumn("state", F.lit("new")), ["c_custkey"])


@query("SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2")
def st_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST7."""
    return sets.last_wins(table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value"), ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query("SELECT s_suppkey, CASE WHEN s_nationkey = 3 THEN -1.0 ELSE s_acctbal END AS score FROM supplier")
def st_replaced_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST3, ST4."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("d"), F.col("s_nationkey").cast("string")).alias("dataset"), F.col("s_acctbal").alias("score"))
    return sets.replaced_slice(s, s.where("dataset = 'd3'").withColumn("score", F.lit(-1.0)), "dataset", "d3").drop("dataset")


@query(f"WITH {JDG}, m AS (SELECT DISTINCT pair_key FROM jdg WHERE label = 'yes'), a AS (SELECT DISTINCT pair_key FROM jdg WHERE label = 'no') SELECT pair_key, 'manual' AS origin FROM m UNION ALL SELECT pair_key, 'auto' FROM a WHERE pair_key NOT IN (SELECT pair_key FROM m)")
def st_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST5, ST6, ST8."""
    j = judgments(spark, sf_dir)
    pick = lambda label, origin: j.where(F.col("label") == label).select("pair_key").distinct().withColumn("origin", F.lit(origin))
    return sets.with_precedence(pick("yes", "manual"), pick("no", "auto"), ["pair_key"])


@query("""SELECT p_partkey, variant, variant_rank, path, p_partkey::VARCHAR || '__' || variant AS variant_id FROM (
SELECT p_partkey, 'brand' AS variant, 0::BIGINT AS variant_rank, p_brand AS path FROM part UNION ALL SELECT p_partkey, 'type', 1, p_type FROM part WHERE p_size > 25)""")
def st_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST10, ST13."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("a"), F.when(F.col("p_size") > 25, F.col("p_type")).alias("b"))
    return sets.variants(p, {"brand": "a", "type": "b"}, "p_partkey").select("p_partkey", "variant", F.col("variant_rank").cast("bigint").alias("variant_rank"), "path", "variant_id")


@query("""SELECT s_suppkey, recipe, s_acctbal > 0 AS enabled, '{"recipe":"' || recipe || '","strength":' || strength || '}' AS payload FROM supplier, (VALUES ('flip', '0.5'), ('blur', '0.25')) r(recipe, strength)""")
def st_recipes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST11, ST12, ST15: each row with a short literal list."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") > 0).alias("usable"))
    return sets.with_recipes(s, [("flip", 0.5), ("blur", 0.25)], "usable").select("s_suppkey", "recipe", "enabled", "payload")


@query("SELECT is_pseudo, count(*) AS n, count(quality) AS labeled FROM (SELECT doc_id, quality, false AS is_pseudo FROM labels UNION ALL SELECT doc_id, NULL, true FROM documents WHERE doc_id % 9 = 0) GROUP BY 1")
def st_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST14."""
    both = sets.mixed_frame(table(spark, sf_dir, "labels").select("doc_id", "quality"), table(spark, sf_dir, "documents").where("doc_id % 9 = 0").select("doc_id"))
    return both.groupBy("is_pseudo").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("labeled"))


@query("SELECT a.s_suppkey AS l, b.s_suppkey AS r FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey")
def st_group_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ST16, ST17, MT31."""
    return J.within_groups(table(spark, sf_dir, "supplier"), "s_suppkey", ["s_nationkey"]).select("l", "r")


# --- samples ---------------------------------------------------------------------------------------------


@query(f"""WITH {EMB}, i AS (SELECT dataset, label FROM emb GROUP BY 1, 2 HAVING count(*) >= 2), p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY md5('42:' || label::VARCHAR), label) AS place, count(*) OVER (PARTITION BY dataset) AS n FROM i)
SELECT id, dataset, label, CASE WHEN place <= least(greatest(1, round(n * 0.25)), n - 1) THEN 'val' ELSE 'fit' END AS role FROM emb LEFT JOIN p USING (dataset, label)""")
def sm_holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM1."""
    return S.holdout(items(spark, sf_dir).drop("v"), "dataset", "label", 0.25, 42)


@query("""WITH i AS (SELECT c_nationkey AS k, count(*) > 1 AS multi FROM customer GROUP BY 1), p AS (SELECT *, row_number() OVER (PARTITION BY multi ORDER BY md5('7:' || k::VARCHAR), k) AS place, count(*) OVER (PARTITION BY multi) AS n FROM i)
SELECT c_custkey, CASE WHEN place <= (CASE WHEN multi THEN greatest(5, round(n * 0.3)) ELSE round(n * 0.3) END) THEN 'calib' ELSE 'fit' END AS role FROM customer JOIN p ON k = c_nationkey""")
def sm_stratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM2."""
    return S.stratified_split(table(spark, sf_dir, "customer"), "c_nationkey", 0.3, 7, 5).select("c_custkey", "role")


@query("SELECT doc_id FROM documents WHERE lang = 'de' ORDER BY md5('1:' || doc_id::VARCHAR), doc_id LIMIT 20")
def sm_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM3, SM7."""
    return S.sample(table(spark, sf_dir, "documents").where("lang = 'de'").select("doc_id"), 20, 1, "doc_id")


@query("WITH g AS (SELECT source FROM documents GROUP BY 1 HAVING count(*) >= 2 ORDER BY md5('3:' || source), source LIMIT 6) SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('3:' || doc_id::VARCHAR), doc_id) AS n FROM documents WHERE source IN (SELECT source FROM g)) WHERE n <= 4")
def sm_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM4, SM8."""
    return S.sample_groups(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 2, 6, 4, 3).select("doc_id", "source")


@query("WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, event_type LIMIT 4) SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY md5('5:' || event_id::VARCHAR), event_id) AS n FROM events WHERE event_type IN (SELECT event_type FROM t)) WHERE n <= 3")
def sm_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM5."""
    return S.top_values(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_type", "event_id", 4, 3, 5).select("event_id", "event_type")


@query("SELECT doc_id, lang, source FROM (SELECT doc_id, lang, source, row_number() OVER (PARTITION BY lang, source ORDER BY md5('9:' || doc_id::VARCHAR), doc_id) AS n FROM documents) WHERE n <= 2")
def sm_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM6."""
    return S.sample_by(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), ["lang", "source"], 2, 9, "doc_id")


@query("""WITH s AS (SELECT count(*) FILTER (WHERE toxic = 1) AS ones, count(*) FILTER (WHERE toxic = 0) AS zeros FROM labels), p AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY md5('2:' || doc_id::VARCHAR), doc_id) AS place FROM labels)
SELECT doc_id, toxic::BIGINT AS toxic FROM p, s WHERE place <= CASE WHEN toxic = 1 THEN least(ones, greatest(100, 200 - least(zeros, 100))) ELSE 200 - least(ones, greatest(100, 200 - least(zeros, 100))) END""")
def sm_balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM9."""
    return S.balanced(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "toxic", "doc_id", 200, 2).select("doc_id", F.col("toxic").cast("bigint").alias("toxic"))


@query("""WITH z AS (SELECT o_custkey, count(*) AS images FROM orders GROUP BY 1), h AS (SELECT * FROM (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('4:' || o_orderkey::VARCHAR), o_orderkey) AS n FROM orders) WHERE n = 1),
b AS (SELECT o_orderkey, o_custkey, images, CASE WHEN images = 1 THEN 'singleton' WHEN images = 2 THEN 'pair' WHEN images <= 4 THEN 'small' ELSE 'large' END AS bucket FROM h JOIN z USING (o_custkey)), p AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY md5('4:' || o_orderkey::VARCHAR), o_orderkey) AS place FROM b)
SELECT o_orderkey, bucket, images FROM p ORDER BY (place > 10)::INT, md5('4:' || o_orderkey::VARCHAR), o_orderkey LIMIT 40""")
def sm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM10."""
    return S.bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "o_orderkey", 40, 4).select("o_orderkey", "bucket", "images")


@query("WITH c AS (SELECT toxic, count(*) AS c FROM labels GROUP BY 1) SELECT doc_id, round((SELECT sum(c) FROM c) / ((SELECT count(*) FROM c) * c), 6) AS weight, CASE WHEN quality = 1 THEN 3.0 ELSE 1.0 END::DOUBLE AS seed_weight FROM labels JOIN c USING (toxic)")
def sm_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SM11, SM12."""
    out = S.balanced_weights(table(spark, sf_dir, "labels"), "toxic").withColumn("seed", F.col("quality") == 1)
    return out.select("doc_id", F.round("weight", 6).alias("weight"), S.seed_weights("seed", 3.0).alias("seed_weight"))
