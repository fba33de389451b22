"""Document fingerprints: threshold-scaled sketches that keep every shingle hash below a fixed fraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.common import words

SHINGLE = 5


def sketch(text: Column, scale: int = 8, shingle: int = SHINGLE) -> Column:
    """Sorted distinct hashes of the text's shingles that lie in the lowest 1 / ``scale`` of all 64-bit hashes.

    A text with fewer words than a shingle is one shingle; without words, or null,
    its sketch is empty. Where no hash is below the bound the least one stays, so
    only texts without words have empty sketches.
    """
    hashed = F.transform(words(text), lambda w: F.xxhash64(w))
    bound = -(2**63) + 2**64 // scale

    def shingles(h: Column) -> Column:
        n = F.size(h)
        many = F.transform(F.sequence(F.lit(0), n - shingle), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(shingle)]))
        one = F.array(F.aggregate(h, F.lit(0).cast("long"), lambda a, x: F.xxhash64(a, x)))
        return F.when(n >= shingle, many).when(n > 0, one).otherwise(F.array().cast("array<long>"))

    def low(s: Column) -> Column:
        below = F.filter(s, lambda x: x < bound)
        return F.when((F.size(s) > 0) & (F.size(below) == 0), F.array(F.array_min(s))).otherwise(F.sort_array(F.array_distinct(below)))

    # One-element transforms bind a value that is used more than once.
    return F.get(F.transform(F.transform(F.array(hashed), shingles), low), 0)


def merged(a: Column, b: Column, scale: int = 8) -> Column:
    """The sketch of two texts' shingles together, from their sketches."""
    both = F.array_sort(F.array_union(a, b))
    below = F.filter(both, lambda x: x < -(2**63) + 2**64 // scale)
    return F.when((F.size(both) > 0) & (F.size(below) == 0), F.slice(both, 1, 1)).otherwise(below)


def containment(a: Column, b: Column) -> Column:
    """The share of a's shingles that b has, from the sketches; 1 where a is empty and b is too, else 0 for an empty a."""
    return F.when(F.size(a) > 0, F.size(F.array_intersect(a, b)) / F.size(a)).otherwise((F.size(b) == 0).cast("double"))


def likeness(a: Column, b: Column) -> Column:
    """The larger containment: how much of the shorter text's shingles the other has, 0 to 1."""
    return F.greatest(containment(a, b), containment(b, a))


def written_out(s: Column) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(s, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def followed(docs: DataFrame, scale: int, buckets: int) -> DataFrame:
    """Of doc_id and text: adds sketch, next_text and next_sketch, those of the next row in the order of descending doc_id.

    Null ids come last, rows of equal id in ascending order of text, and the first
    row follows the last. Ranges of doc_id, cut at approximate quantiles, are sorted
    each by itself; each range also gets a copy of the row that follows it (one
    row a range). Where the ranges are cut changes no result.
    """
    cuts = sorted({int(x) for x in docs.approxQuantile("doc_id", [k / buckets for k in range(1, buckets)], 0.2 / buckets)}) if buckets > 1 else []
    ids = F.col("doc_id")
    place = F.when(ids.isNull(), -1).otherwise(F.size(F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c < ids)))
    rows = docs.withColumn("__range", place)
    tops = rows.groupBy("__range").agg(F.max("doc_id").alias("__top"))
    order = Window.orderBy("__range")
    to = F.coalesce(F.lead("__range").over(order), F.first("__range").over(order))
    tops = tops.select("__top", to.alias("__to"))
    lent = rows.join(F.broadcast(tops), ids.eqNullSafe(F.col("__top"))).groupBy("__to", "doc_id").agg(F.min("text").alias("text"))
    lent = lent.select("doc_id", "text", F.col("__to").alias("__range"), F.lit(1).alias("__lent"))
    line = Window.partitionBy("__range").orderBy("__lent", F.col("doc_id").desc_nulls_last(), "text")
    out = rows.withColumn("__lent", F.lit(0)).unionByName(lent).withColumn("sketch", sketch(F.col("text"), scale))
    for c in ("text", "sketch"):
        out = out.withColumn(f"next_{c}", F.lead(c).over(line))
    return out.filter(F.col("__lent") == 0).drop("__range", "__lent")


def fingerprints(docs: DataFrame, scale: int = 8, buckets: int | None = None) -> DataFrame:
    """Every document's sketch, its edited text's sketch, and their likeness to each other and to the next document's.

    The edited text has its last floor(n_chars / 3) code points replaced by the
    first as many (or all) of the next document, in descending doc_id; see
    ``followed`` for nulls and ties. Null text counts as empty. Columns: doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next (``likeness``), jaccard_edited, jaccard_next. An empty table gives
    none. Each text is shuffled once, with its sketch, to the range of its id.
    """
    spark = docs.sparkSession
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    pairs = followed(own, scale, buckets or 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 3) as int))"), F.col("next_text").substr(F.lit(1), cut))
    pairs = pairs.withColumn("__edited", edited).withColumn("__es", sketch(F.col("__edited"), scale))

    def jaccard(a: str, b: str) -> Column:
        union = F.size(F.array_union(a, b))
        return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(1.0)

    return pairs.select(
        "doc_id", n.cast("long").alias("n_chars"), F.sha2("__edited", 256).alias("edited_sha256"), written_out(F.col("sketch")).alias("fingerprint"), written_out(F.col("__es")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("__es")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"),
        jaccard("sketch", "__es").alias("jaccard_edited"), jaccard("sketch", "next_sketch").alias("jaccard_next"),
    )
