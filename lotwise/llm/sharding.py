"""Rows dealt out to weighted shards by rendezvous hashing of their keys.

Every (key, shard) pair has a hash in (0, 1); the shard of largest weight / -ln(hash) takes the row. Only the
key, the shards and their weights decide, so one more shard takes rows into itself and moves no other, and a
changed weight moves rows only to or from that shard. Key, size and shard travel; texts stay where they are.

A NULL key is hashed like a key of its own. Rows that repeat a key share its shard and have slots of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rows that get their slots in one task.
SLOT_ROWS = 50_000
# Fixed: the 53 bits of a hash that a double holds, and a half so that 0 never comes up.
UNIT = float(2**53)


def rendezvous(key: str, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key among shards of these weights; a shard of weight 0 takes nothing."""
    if not weights or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights are not negative, and one is positive")
    name = F.coalesce(F.col(key).cast("string"), F.lit("\0"))
    first = F.xxhash64(name)

    def claim(shard: int, weight: float) -> Column:
        mixed = F.shiftrightunsigned(F.xxhash64(first, F.lit(shard)), 11)
        return F.struct((F.lit(-float(weight)) / F.ln((mixed + 0.5) / UNIT)).alias("claim"), F.lit(-shard).alias("order"))

    claims = [claim(s, w) for s, w in enumerate(weights) if w > 0]
    best = claims[0] if len(claims) == 1 else F.greatest(*claims)
    return (-best["order"]).cast("int")


def with_slots(rows: DataFrame, shard: str, key: str, also: Sequence[str] = (), slot: str = "slot") -> DataFrame:
    """Numbers the rows of each shard from 0 without a gap, whatever its size.

    A shard's rows are cut by a hash of the key, and of the columns ``also``, into buckets of about ``SLOT_ROWS``; a bucket begins
    where those before it end. So rows that share a key but not these columns do not share a bucket. Keys order the rows of a bucket.
    """
    total = rows.count()
    buckets = max(1, -(-total // SLOT_ROWS))
    cut = rows.withColumn("__bucket", F.pmod(F.xxhash64(F.lit("slot"), key, *also), F.lit(buckets)).cast("int"))
    held = cut.groupBy(shard, "__bucket").agg(F.count(F.lit(1)).alias("__rows"))
    before = Window.partitionBy(shard).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    begins = held.select(
        F.col(shard).alias("__shard"), F.col("__bucket").alias("__at"), F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__first")
    )
    inside = Window.partitionBy(shard, "__bucket").orderBy(key, *also)
    numbered = cut.withColumn("__number", F.row_number().over(inside))
    placed = numbered.join(begins, (F.col(shard) == F.col("__shard")) & (F.col("__bucket") == F.col("__at")))
    return placed.withColumn(slot, F.col("__first") + F.col("__number") - 1).drop(
        "__bucket", "__shard", "__at", "__first", "__number"
    )


def sharded(docs: DataFrame, weights: Sequence[float], grown_weights: Sequence[float], key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every document.

    ``size`` is the text's UTF-8 bytes (NULL: none) plus 1, ``text_crc32`` its checksum (NULL: of no bytes),
    ``grown_shard`` the shard among ``grown_weights``.
    """
    whole = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    rows = docs.select(
        key,
        (F.length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole).alias("text_crc32"),
        rendezvous(key, weights).alias("shard"),
        rendezvous(key, grown_weights).alias("grown_shard"),
    )
    return with_slots(rows, "shard", key, ["text_crc32", "size"]).select(
        key, "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long"), "grown_shard"
    )
