"""The driver's tables in the roles of the engine's: items with vectors, routes, images, judgments, registries; and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.functions.vectors import doubles, unit
from flockline.sources.tables import table


def plain(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint and fractions as double, as the SQL has them."""
    kinds = {"int": "bigint", "smallint": "bigint", "tinyint": "bigint", "float": "double"}
    return df.withColumns({c: F.col(c).cast(kinds[k]) for c, k in df.dtypes if k in kinds})


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, dataset, label, v."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("id"), F.concat(F.lit("d"), (F.col("vec_id") % 4).cast("string")).alias("dataset"), F.col("label").cast("bigint").alias("label"), doubles(F.col("embedding")).alias("v"))


def route(spark: SparkSession, sf_dir: str, half: str) -> DataFrame:
    """Items with the first or second half of their vectors, as unit vectors: two routes."""
    return items(spark, sf_dir).withColumn("v", unit(F.slice("v", 1 if half == "a" else 33, 32)))


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as image rows: image_id, dataset, split, identity, path, sha1, n_chars."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    split = F.when(F.col("doc_id") % 5 == 0, "test").otherwise("train")
    identity = F.when(F.col("quality").isNotNull(), F.concat(F.col("source"), F.lit("_"), F.col("quality").cast("string"))).otherwise("")
    return d.join(labels, "doc_id", "left").select(F.col("doc_id").alias("image_id"), F.col("lang").alias("dataset"), split.alias("split"), identity.alias("identity"), F.concat_ws("/", F.lit("img"), "source", F.format_string("%d.jpg", "doc_id")).alias("path"), F.sha1("text").alias("sha1"), "n_chars")


def judgments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as answers on pairs: judgment_id, ts, l, r, pair_key, label. Users stand for one end, the value's tens for the other."""
    e = table(spark, sf_dir, "events")
    other = (F.get_json_object("props", "$.k").cast("bigint") + 1000).alias("r")
    label = F.when(F.col("event_type").isin("purchase", "signup"), "yes").when(F.col("event_type") == "error", "no").otherwise("uncertain")
    return e.select(F.col("event_id").alias("judgment_id"), "ts", F.col("user_id").alias("l"), other, label.alias("label"), "value").withColumn("pair_key", F.concat_ws("|", F.least(F.col("l").cast("string"), F.col("r").cast("string")), F.greatest(F.col("l").cast("string"), F.col("r").cast("string"))))


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All supplies as constraints between parts (even ids) and suppliers (odd ids): l, r, constraint_type, support."""
    li = table(spark, sf_dir, "lineitem")
    g = li.groupBy((2 * F.col("l_partkey")).alias("l"), (2 * F.col("l_suppkey") + 1).alias("r")).agg(F.count(F.lit(1)).alias("support"), F.count_if(F.col("l_returnflag") == "R").alias("returns"))
    return g.select("l", "r", F.when(2 * F.col("returns") > F.col("support"), "cannot_link").otherwise("must_link").alias("constraint_type"), "support")


EMB = "emb AS (SELECT vec_id AS id, 'd' || (vec_id % 4)::VARCHAR AS dataset, label::BIGINT AS label, embedding::DOUBLE[] AS v FROM embeddings)"
PRS = f"{EMB}, prs AS (SELECT a.dataset, a.id AS l, b.id AS r, list_dot_product(a.v, b.v) AS score, a.label AS ll, b.label AS rl FROM emb a JOIN emb b ON a.dataset = b.dataset AND a.id < b.id)"
DIRS = f"{PRS}, dirs AS (SELECT dataset, l AS q, r AS nbr, score FROM prs UNION ALL SELECT dataset, r, l, score FROM prs)"


def top_sql(k: int, source: str = "dirs", name: str = "top") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, q ORDER BY score DESC, nbr) AS rank FROM {source}) WHERE rank <= {k})"


def half_sql(half: str) -> str:
    a, b = (1, 32) if half == "a" else (33, 64)
    return f"""raw_{half} AS (SELECT vec_id AS id, 'd' || (vec_id % 4)::VARCHAR AS dataset, label::BIGINT AS label, (embedding::DOUBLE[])[{a}:{b}] AS w FROM embeddings),
emb_{half} AS (SELECT id, dataset, label, list_transform(w, lambda x: x / sqrt(list_dot_product(w, w))) AS v FROM raw_{half}),
dirs_{half} AS (SELECT a.dataset, a.id AS q, b.id AS nbr, list_dot_product(a.v, b.v) AS score FROM emb_{half} a JOIN emb_{half} b ON a.dataset = b.dataset AND a.id <> b.id)"""


IMG = """img AS (SELECT doc_id AS image_id, lang AS dataset, CASE WHEN doc_id % 5 = 0 THEN 'test' ELSE 'train' END AS split,
CASE WHEN quality IS NOT NULL THEN source || '_' || quality::VARCHAR ELSE '' END AS identity, 'img/' || source || '/' || doc_id::VARCHAR || '.jpg' AS path, sha1(text) AS sha1, n_chars
FROM documents LEFT JOIN labels USING (doc_id))"""
JDG = """jdg AS (SELECT *, least(l::VARCHAR, r::VARCHAR) || '|' || greatest(l::VARCHAR, r::VARCHAR) AS pair_key FROM (SELECT event_id AS judgment_id, ts, user_id AS l, json_extract_string(props, '$.k')::BIGINT + 1000 AS r,
CASE WHEN event_type IN ('purchase', 'signup') THEN 'yes' WHEN event_type = 'error' THEN 'no' ELSE 'uncertain' END AS label, value FROM events))"""
WREG = """wreg AS (SELECT 2 * l_partkey AS l, 2 * l_suppkey + 1 AS r, CASE WHEN 2 * count(*) FILTER (WHERE l_returnflag = 'R') > count(*) THEN 'cannot_link' ELSE 'must_link' END AS constraint_type, count(*) AS support FROM lineitem GROUP BY 1, 2)"""


def comp_sql(nodes: str, edges: str, name: str = "comp", node: str = "id") -> str:
    """CTEs after WITH RECURSIVE: the least node reachable; edges has l and r."""
    return f"""both_{name} AS (SELECT l AS a, r AS b FROM {edges} UNION SELECT r, l FROM {edges}),
reach_{name} AS (SELECT {node} AS id, {node} AS c FROM {nodes} UNION SELECT e.b, x.c FROM reach_{name} x JOIN both_{name} e ON e.a = x.id),
{name} AS (SELECT id, min(c) AS component FROM reach_{name} GROUP BY id)"""
