"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flockline.llm.common import key52, n_words, running_total, written

def targets(sizes: DataFrame, weights: list[int], most: int) -> DataFrame:
    """source, source_size, weight, target: shares of the total by weight, at most ``most`` times a source's size.

    ``sizes`` has source and source_size, one row a source. The sources in order
    of code points, null last, weigh ``weights``, repeated. What lies above a
    source's limit goes to the others by weight until none is above: sources that
    reach their limit first in most * size / weight are those at the limit. The
    windows run over the table of sources, one row each.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__n", F.row_number().over(order) - 1).withColumn("weight", F.element_at(cycle, (F.col("__n") % len(weights) + 1).cast("int")))
    everything = Window.partitionBy()
    by_fill = Window.orderBy("__fill", "__n")
    earlier = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("__cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("__fill", F.col("__cap") / F.col("weight"))
        .withColumn("__all", F.sum("source_size").over(everything))
        .withColumn("__weights", F.sum("weight").over(everything))
        .withColumn("__level", (F.col("__all") - F.coalesce(F.sum("__cap").over(earlier), F.lit(0.0))) / (F.col("__weights") - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0))))
    )
    level = F.max(F.when(F.col("__level") <= F.col("__fill"), F.struct(-F.col("__fill"), -F.col("__n"), F.col("__level").alias("level")))).over(everything)["level"]
    return filled.withColumn("__final", level).select("source", "source_size", "weight", F.coalesce(F.least(F.col("__cap"), F.col("weight") * F.col("__final")), F.lit(0.0)).alias("target"))


def quotas(shares: DataFrame, seats: Column, n_shards: int) -> DataFrame:
    """Adds ``shard`` and ``quota``: how many of the ``seats`` blocks each shard takes from each source.

    Sainte-Lague gives seats one by one to the source with the highest quotient
    target / (2 k + 1). A divisor method is house-monotone, so shard s gets what
    the first seats * (s + 1) / n_shards seats give beyond the shard before. The
    quotients below target / T * (seats - n/2) rounded surely win, and those above
    target / T * (seats + n/2 + 1) surely lose, so at most 2 n + 2 quotients of n
    sources are ranked per shard, whatever the number of seats.
    """
    everything = Window.partitionBy()
    rows = (
        shares.withColumn("__n", F.count(F.lit(1)).over(everything)).withColumn("__total", F.sum("target").over(everything))
        .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))))
        .withColumn("__seats", F.floor(seats * (F.col("shard") + 1) / F.lit(n_shards)))
    )
    share = F.when(F.col("__total") > 0, F.col("target") / F.col("__total")).otherwise(0.0)
    low = F.floor(share * F.greatest(F.col("__seats") - F.col("__n") / 2, F.lit(0.0)) + 0.5)
    high = F.when(share > 0, F.floor(share * (F.col("__seats") + F.col("__n") / 2 + 1) + 0.5) + 1).otherwise(0)
    rows = rows.withColumn("__low", F.greatest(low - 1, F.lit(0))).withColumn("__high", F.greatest(high, F.lit(0)))
    asked = rows.withColumn("__k", F.explode_outer(F.when(F.col("__high") > F.col("__low"), F.sequence("__low", F.col("__high") - 1))))
    shard = Window.partitionBy("shard")
    asked = asked.withColumn("__sure", F.sum(F.when(F.col("__k").isNull() | (F.col("__k") == F.col("__low")), F.col("__low"))).over(shard))
    asked = asked.withColumn("__place", F.row_number().over(shard.orderBy((F.col("target") / (2 * F.col("__k") + 1)).desc_nulls_last(), F.col("source").asc_nulls_last())))
    won = F.sum((F.col("__k").isNotNull() & (F.col("__place") <= F.col("__seats") - F.col("__sure"))).cast("long"))
    upto = asked.groupBy("source", "source_size", "weight", "target", "shard").agg((F.first("__low") + won).alias("__upto"))
    before = F.coalesce(F.lag("__upto").over(Window.partitionBy("source").orderBy("shard")), F.lit(0))
    return upto.withColumn("quota", (F.col("__upto") - before).cast("long")).drop("__upto")


def mix(docs: DataFrame, weights: list[int] = (1, 2, 3), most: int = 3, block: int = 512, n_shards: int = 8, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """The mix of all documents and its quotas.

    First table, a row a document: doc_id, size (words), source_size, target,
    taken (words that the mix takes, repeats counted), copies (whole copies for
    a mix of whole documents) and first_shard. Second: source, source_size, weight, target, shard,
    quota (blocks).

    A source's documents, in the order of a seeded hash, are one line of words cut
    into N blocks of ``block`` words, and the blocks are ranked by a seeded hash of
    their own. The source's quotas, shard after shard, take the blocks in this order,
    again from the first after the last; so runs agree, no document is taken more than
    ``most`` times, and ``first_shard`` is the shard that first takes the document's
    middle word (null: none does). A quota above ``most`` times N, which only rounding
    gives, loses what is above. Null text has no words; null is a source of its own,
    after the others. Documents without words are taken 0 times. Rows with equal
    doc_id are documents of their own. An empty table gives two empty tables.
    """
    sizes = written(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("__crc")), "mix-sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    shares = targets(by_source, list(weights), most)
    shares = shares.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy()) / F.lit(block)).cast("long"))
    shared = written(quotas(shares, F.col("seats"), n_shards), "mix-quotas")
    # Of each source: after how many blocks each shard is full.
    plan = shared.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("shard", "quota"))).alias("__q"), *[F.first(c).alias(c) for c in ("source_size", "target")])
    blocks = F.greatest(F.ceil(F.col("source_size") / block), F.lit(1)).cast("long")
    full = F.transform(F.sequence(F.lit(1), F.lit(n_shards)), lambda k: F.least(F.aggregate(F.slice(F.col("__q"), F.lit(1), k), F.lit(0).cast("long"), lambda n, x: n + x["quota"]), blocks * most))
    plan = plan.select(F.col("source").alias("__s"), "source_size", "target", blocks.alias("__blocks"), full.alias("__full"))
    lines = running_total(sizes.withColumn("__key", key52(F.col("doc_id"), seed, "mix")), ["source"], "__key", [F.col("doc_id").asc_nulls_last(), F.col("__crc"), F.col("size")], F.col("size"), "__first")
    size, start, b = F.col("size"), F.col("__first"), F.col("__block")
    lines = written(lines.withColumn("__middle", F.floor((start + F.floor(size / 2)) / block)), "mix-lines")
    spans = lines.filter(size > 0).withColumn("__block", F.explode(F.sequence(F.floor(start / block), F.floor((start + size - 1) / block))))
    # Each block begins in one document.
    heads = spans.filter(b * block >= start).select("source", "__block").withColumn("__key", key52(F.col("source"), seed, b, "block"))
    ranks = running_total(heads, ["source"], "__key", [b], F.lit(1), "__rank").select(F.col("source").alias("__o"), F.col("__block").alias("__b"), "__rank")
    ranks = ranks.join(plan, F.col("__o").eqNullSafe(F.col("__s")))
    quota = F.element_at("__full", -1)
    times = F.floor((F.greatest(quota - F.col("__rank"), F.lit(0)) + F.col("__blocks") - 1) / F.col("__blocks"))
    first_shard = F.when(F.col("__rank") < quota, F.size(F.filter("__full", lambda n: n <= F.col("__rank"))))
    ranks = ranks.select("__o", "__b", times.alias("__times"), first_shard.alias("__shard"))
    middle = F.when(b == F.col("__middle"), F.col("__times"))
    words = F.least(start + size, (b + 1) * block) - F.greatest(start, b * block)
    row = ["doc_id", "source", "size", "__crc", "__first"]
    taken = spans.join(ranks, F.col("source").eqNullSafe(F.col("__o")) & (b == F.col("__b"))).groupBy(*row).agg(
        F.sum(words * F.col("__times")).cast("long").alias("taken"), F.max(middle).cast("int").alias("copies"), F.max(F.when(b == F.col("__middle"), F.col("__shard"))).cast("int").alias("first_shard")
    )
    nothing = lines.filter(size == 0).select(*row, F.lit(0).cast("long").alias("taken"), F.lit(0).alias("copies"), F.lit(None).cast("int").alias("first_shard"))
    out = taken.union(nothing).join(plan, F.col("source").eqNullSafe(F.col("__s")))
    return out.select("doc_id", "size", "source_size", "target", "taken", "copies", "first_shard", F.col("__crc").alias("text_crc32"), "source"), shared
