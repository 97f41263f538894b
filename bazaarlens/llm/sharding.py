"""Sharding by rendezvous hashing of stable record keys over weighted shards.

Every shard draws a score for every key from ``md5(key:shard)``; the highest score wins. A new shard
leaves the scores of the others as they are, so it only takes records for itself, and a shard of
weight w gets w parts of the whole. The choice needs no table, no state and no shuffle.

Slots number the records of a shard without gaps. They come from one range-partitioned sort of
narrow rows (no text), so a shard, or a key that repeats, is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bazaarlens.operators.ranking import dense_index
from bazaarlens.workspace import materialize

# The first 13 hex digits of an MD5 are 52 bits, which a double holds exactly.
_DIGITS, _SPAN = 13, float(1 << 52)


def rendezvous_shard(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..n-1 of a key; a null key counts as an empty one.

    A shard of weight 0 gets nothing. Equal scores (one pair in 2**52) go to the higher shard.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    text = F.coalesce(key.cast("string"), F.lit(""))

    def score(shard: int, weight: float) -> Column:
        digits = F.substring(F.md5(F.concat(text, F.lit(f":{shard}"))), 1, _DIGITS)
        uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / _SPAN
        return F.struct((F.lit(-float(weight)) / F.log(uniform)).alias("score"), F.lit(shard).alias("shard"))

    return F.array_max(F.array(*[score(s, w) for s, w in enumerate(weights) if w > 0]))["shard"]


def assign_shards(
    df: DataFrame, key: str, weights: Sequence[float], grown_weights: Sequence[float], text_col: str
) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``grown_weights`` are the weights after a change of the shards. Null texts are empty (size 1);
    rows that are equal in every way keep a slot each; an empty table has no rows. Slots follow the
    order of key, CRC, size; null keys come first.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    # Stored first: the sort below samples its input, and the texts should be read only once.
    narrow = materialize(
        df.select(
            F.col(key).alias("doc_id"),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            rendezvous_shard(F.col(key), weights).alias("shard"),
            rendezvous_shard(F.col(key), grown_weights).alias("grown_shard"),
        ),
        "shards",
    )
    order = ["shard", "doc_id", "text_crc32", "size", "__row"]
    placed = dense_index(
        narrow.withColumn("__row", F.monotonically_increasing_id()), [F.col(c) for c in order], "__position"
    )
    # One row per shard.
    first = placed.groupBy(F.col("shard").alias("__shard")).agg(F.min("__position").alias("__first"))
    return placed.join(F.broadcast(first), placed["shard"] == first["__shard"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("key").alias("law"),
        "shard",
        (F.col("__position") - F.col("__first")).alias("slot"),
        "grown_shard",
    )
