"""The queries that apply the training-data operators to their whole tables, and their SQL where it can express them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flockline.llm import density_html, mcd, mixing, ordinal, pitman_yor, rendezvous, scaled_sketch, segjoin, urlglob, wordbpe
from flockline.llm.common import table


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mcd.judged(table(spark, sf_dir, "documents"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendezvous.shards(table(spark, sf_dir, "documents"), [1.0] * 8)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(table(spark, sf_dir, "documents"), vocabulary())


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scaled_sketch.fingerprints(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "copies", "first_shard")


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal.scored(docs, ordinal.trained(docs, table(spark, sf_dir, "labels")))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.scored(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return density_html.extracted(table(spark, sf_dir, "pages"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segjoin.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlglob.filtered(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sharding": op2_sharding,
        "op3_bpe": op3_bpe,
        "op4_fingerprints": op4_fingerprints,
        "op5_mixing": op5_mixing,
        "op6_quality_classifier": op6_quality_classifier,
        "op7_lm_scoring": op7_lm_scoring,
        "op8_html_extraction": op8_html_extraction,
        "op9_ngram_join": op9_ngram_join,
        "op10_url_filters": op10_url_filters,
    }


GAPS = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

MIXING = f"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{GAPS}'), lambda x: x <> ''))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS n FROM d GROUP BY source),
f AS (SELECT *, [1, 2, 3][(n % 3 + 1)::INT]::DOUBLE AS weight, source_size * 3::DOUBLE AS cap, source_size * 3::DOUBLE / [1, 2, 3][(n % 3 + 1)::INT]::DOUBLE AS fill FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER w, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER w, 0)) AS level FROM f WINDOW w AS (ORDER BY fill, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, (fill, n)) FROM l WHERE level <= fill)), 0)::DOUBLE AS target FROM f),
m AS (SELECT round(sum(target) / 512)::BIGINT AS seats FROM t),
q AS (SELECT source, {", ".join(f"count(*) FILTER (place <= seats * {k} // 8) AS q{k}" for k in range(1, 9))} FROM (SELECT source, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, source NULLS LAST) AS place FROM t, range((SELECT seats FROM m) + 1) r(k)), m WHERE place <= seats GROUP BY source),
p AS (SELECT t.source, source_size, target, greatest(ceil(source_size / 512), 1)::BIGINT AS blocks, list_transform([{", ".join(f"q{k}" for k in range(1, 9))}], lambda x: least(coalesce(x, 0), 3 * greatest(ceil(source_size / 512), 1)::BIGINT)) AS upto FROM t LEFT JOIN q ON t.source IS NOT DISTINCT FROM q.source),
x AS (SELECT doc_id, source, size, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/1/mix'), 1, 13))::BIGINT, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d),
b AS (SELECT p.*, k AS block, row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(coalesce(source, 'null') || '/1/' || k || '/block'), 1, 13))::BIGINT, k) - 1 AS rank FROM p, range((SELECT max(blocks) FROM p)) r(k) WHERE k < blocks),
c AS (SELECT *, (greatest(upto[8] - rank, 0) + blocks - 1) // blocks AS times, CASE WHEN rank < upto[8] THEN len(list_filter(upto, lambda n: n <= rank)) END AS shard FROM b),
z AS (SELECT id, sum((least(start + size, (block + 1) * 512) - greatest(start, block * 512)) * times) AS taken, max(CASE WHEN block = (start + size // 2) // 512 THEN times END) AS copies, max(CASE WHEN block = (start + size // 2) // 512 THEN shard END) AS shard
FROM x JOIN c ON x.source IS NOT DISTINCT FROM c.source AND block BETWEEN start // 512 AND (start + size - 1) // 512 WHERE size > 0 GROUP BY id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken, coalesce(copies, 0)::INTEGER AS copies, shard::INTEGER AS first_shard FROM x JOIN p ON x.source IS NOT DISTINCT FROM p.source LEFT JOIN z ON x.id = z.id"""

JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAPS}'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2])) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS grams FROM w),
g AS (SELECT doc_id, unnest(grams) AS gram FROM s),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM c JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * n >= 90 * (len(x.grams) + len(y.grams) - n)),
e AS (SELECT a, b FROM k UNION ALL SELECT b, a FROM k),
reach AS (SELECT doc_id AS id, doc_id AS c FROM s UNION SELECT e.b, r.c FROM reach r JOIN e ON e.a = r.id)
SELECT s.doc_id, len(grams)::BIGINT AS n_shingles, (SELECT min(c) FROM reach WHERE id = s.doc_id) AS component_id FROM s"""


def url_sql() -> str:
    def pattern(glob: str) -> str:
        return "".join({"**": r"[\s\S]*", "*": "[^/]*", "?": "[^/]"}.get(x, re.escape(x)) for x in re.findall(r"\*\*|[\s\S]", glob))

    ranked = sorted(urlglob.HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, v) for v, h, p in ranked]
    blocked = "|".join(map(pattern, urlglob.BLOCK_GLOBS))
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{urlglob.HOST}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{urlglob.PATH}', 1) AS path FROM pages)
SELECT page_id, host, path, CASE {" ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in fits)} END AS rule,
CASE {" ".join(f"WHEN {c} THEN '{v}'" for c, _, v in fits)} WHEN regexp_full_match(host || path, '{blocked}') THEN 'block' ELSE 'allow' END AS verdict FROM u"""


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": MIXING.strip(), "op9_ngram_join": JOIN.strip(), "op10_url_filters": url_sql().strip()}
