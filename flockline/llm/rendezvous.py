"""Sharding by weighted rendezvous hashing of stable record keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flockline.llm.common import key52, running_total


def shard_of(key: Column, weights: list[float], seed: str = "shard") -> Column:
    """The shard with the best score for this key; shards with weight w get w / sum(weights) of the keys.

    A shard's score depends on the key and that shard alone, so a further shard
    takes keys only into itself, and a shard that goes loses only its own keys.
    Equal weights compare the hashes as integers; others use -ln(u) / w. Ties
    go to the lower shard. A null key counts as the word null.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("each shard needs a weight above 0")
    even = len(set(weights)) == 1
    scores = []
    for shard, weight in enumerate(weights):
        hashed = key52(key, shard, seed)
        score = -hashed if even else -F.log((hashed + F.lit(0.5)) / F.lit(float(2**52))) / F.lit(float(weight))
        scores.append(F.struct(score.alias("score"), F.lit(shard).alias("shard")))
    best = F.least(*scores) if len(scores) > 1 else scores[0]
    return best["shard"]


def shards(docs: DataFrame, weights: list[float], key: str = "doc_id", text: str = "text", grown: list[float] | None = None) -> DataFrame:
    """Every row's shard and its place there: key, size, text_crc32, law, shard, slot, grown_shard.

    size is the UTF-8 bytes of the text plus 1. slot runs from 0 without gaps in
    each shard, in the order of a hash of the key, then key, checksum and size.
    grown_shard is the shard under the weights ``grown``, by default one more
    shard of the last one's weight. Null text counts as empty; rows with equal or
    null keys share a shard and have slots of their own; an empty table gives none.
    Text is read in one pass and never shuffled; ranges of the key hash number
    the slots, so no task holds a shard.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias(key),
        (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        shard_of(F.col(key), weights).alias("shard"),
        shard_of(F.col(key), grown or [*weights, weights[-1]]).alias("grown_shard"),
        key52(F.col(key), "slot").alias("__key"),
    )
    ties = [F.col(key).asc_nulls_last(), F.col("text_crc32"), F.col("size")]
    out = running_total(rows, ["shard"], "__key", ties, F.lit(1), "slot")
    return out.select(key, "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
