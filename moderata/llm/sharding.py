"""Sharding by weighted rendezvous hashing.

Every pair (record key, shard) has a hash, read as a uniform number u; the
shard with the least ``-ln(u) / weight`` gets the record. A shard's share is
its weight's, the key and the list of shards decide alone, and a new shard
takes records only into itself. Built-in functions only; texts are read for
their size and checksum and never shuffled.

Slots number a shard's records without gaps. Shards are cut into bins by a hash
of the row, ranked inside a bin, and offset by the sizes of the bins before, so
no task sees a whole shard. Null texts have size 1 and the checksum of the
empty text; a null key is hashed as the empty string; rows that repeat a key
share its shard and have slots of their own. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN_ROWS = 10_000


def uniform(key: Column, shard: int) -> Column:
    """52 bits of a digest as a number in (0, 1)."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{shard}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def scores(key: Column, weights: Sequence[float]) -> Column:
    """(cost, shard) of every shard; the least cost wins, ties go to the lower number."""
    return F.array(*[
        F.struct((-F.log(uniform(key, i)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard"))
        for i, w in enumerate(weights)])


def shard(docs: DataFrame, weights: Sequence[float], grown_by: float = 1.0,
          key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, size, text_crc32, law, shard, slot, grown_shard) of every row.

    ``grown_shard`` is the shard when one more, of weight ``grown_by``, is added.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"))
    everything = [*weights, grown_by]
    rows = rows.withColumn("scored", scores(F.col("key"), everything)).select(
        "key", "size", "text_crc32",
        F.array_min(F.slice("scored", 1, len(weights)))["shard"].alias("shard"),
        F.array_min("scored")["shard"].alias("grown_shard"))
    bins = max(1, docs.count() // (BIN_ROWS * len(weights)))
    # Slots follow the digest of the row, and so do the bins.
    rows = rows.withColumn("digest", F.md5(F.concat_ws(":", "key", "text_crc32", "size").cast("binary")))
    rows = rows.withColumn("bin", (F.conv(F.substring("digest", 1, 8), 16, 10).cast("double") * bins / (1 << 32)).cast("int"))
    sizes = rows.groupBy("shard", "bin").count()
    before = Window.partitionBy("shard").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "bin", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "bin").orderBy("digest", "key")
    ranked = rows.withColumn("place", F.row_number().over(inside) - 1)
    return ranked.join(offsets, ["shard", "bin"]).select(
        F.col("key").alias(key), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("place") + F.col("offset")).alias("slot"), "grown_shard")
