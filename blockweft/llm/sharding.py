"""Placement of documents on shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read

#: Production parameters: shard count, and a prime table size of over a hundred slots for each shard.
SHARDS = 64
SLOTS = 8191


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The table: for each slot the index of its shard.

    Every shard prefers the slots in an order of its own, offset + j * skip modulo the prime size, which visits each
    slot once. The shards take turns, each claiming its most preferred free slot, so their shares differ by one slot
    at most, and a shard that leaves or joins moves few slots but its own.
    """
    if not shards or len(set(shards)) != len(shards) or slots < len(shards):
        raise ValueError("need one shard or more, of different names, and a slot for each")
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    at = [_number(f"offset:{s}") % slots for s in shards]
    skip = [_number(f"skip:{s}") % (slots - 1) + 1 for s in shards]
    table, left = [-1] * slots, slots
    while True:
        for k in range(len(shards)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + skip[k]) % slots
            table[at[k]] = k
            left -= 1
            if not left:
                return table


def slot_of(key: Column, slots: int) -> Column:
    """The slot of a key; a null key has the slot of the empty string."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % slots


def place(docs: DataFrame, shards: list[str], slots: int = SLOTS, key: str = "doc_id") -> DataFrame:
    """``docs`` with slot (long) and shard (int) added; former columns of these names are replaced.

    No row moves: the table, of a size fixed by ``slots``, is broadcast. Equal keys, null keys included, share a
    shard; texts are not looked at. An empty table stays empty.
    """
    spark = docs.sparkSession
    listed = F.split(F.lit(",".join(map(str, fill(shards, slots)))), ",").cast("array<int>")
    table = spark.range(1).select(F.posexplode(listed).alias("slot", "shard")).withColumn("slot", F.col("slot").cast("long"))
    rest = docs.drop("slot", "shard")
    return rest.withColumn("slot", slot_of(F.col(key), slots)).join(F.broadcast(table), "slot").select(*rest.columns, "slot", "shard")


def write_shards(placed: DataFrame, path: str) -> None:
    """One folder for each shard; large shards are split among tasks by their slots."""
    placed.repartition("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{k:04d}" for k in range(n)]


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place(read(spark, sf_dir, "documents").select("doc_id"), shard_names())


def op4_sql() -> str:
    table = ",".join(map(str, fill(shard_names())))
    return f"""
WITH placed AS (
  SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) % {SLOTS} AS slot
  FROM documents)
SELECT doc_id, slot, CAST(string_split('{table}', ',')[slot + 1] AS INTEGER) AS shard FROM placed
"""
