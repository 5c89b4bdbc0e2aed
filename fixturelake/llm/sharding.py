"""Sharding by a permutation-filled lookup table.

Each shard has its own permutation of the slots of a prime-sized table. Shards
take turns; at its turn a shard claims the first slot of its permutation that
is still free, until the table is full. A row is hashed to a slot and the slot
names its shard. Slot counts of two shards differ by one at most, and when a
shard leaves, few slots of the others change hands.

The table depends on the shard names and its size only, never on the data: it
is filled on the driver and broadcast with ``size`` rows (65,537 by default,
under 2 MB), so placement is one hash and one lookup per row, without shuffle.

Defined results: a null key is hashed with the row's text instead, so rows
without a key spread over the shards, or as the empty text when that is missing
too; equal keys always share a shard; an empty table gives no rows; columns
named like the new ones are replaced.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = 64


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str], size: int = SLOTS) -> list[int]:
    """Index of the shard that owns each slot.

    ``size`` must be prime, so that every skip gives a permutation of the slots.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shard names must be non-empty and distinct")
    if not _is_prime(size) or size < len(shards):
        raise ValueError("size must be a prime and at least the number of shards")
    start, skip = [], []
    for name in shards:
        digest = hashlib.sha256(name.encode()).digest()
        start.append(int.from_bytes(digest[:8], "big") % size)
        skip.append(int.from_bytes(digest[8:16], "big") % (size - 1) + 1)
    owner, at, free = [-1] * size, start[:], size
    while free:
        for i in range(len(shards)):
            slot = at[i]
            while owner[slot] >= 0:
                slot = (slot + skip[i]) % size
            owner[slot], at[i] = i, (slot + skip[i]) % size
            free -= 1
            if not free:
                break
    return owner


def table_frame(spark: SparkSession, shards: list[str], size: int = SLOTS) -> DataFrame:
    """The lookup table as rows (slot, shard, shard_name)."""
    owner = lookup_table(shards, size)
    listed = ",".join(map(str, owner))
    names = F.lit("\n".join(shards))
    return (
        spark.range(1)
        .select(F.posexplode(F.split(F.lit(listed), ",")).alias("slot", "owner"))
        .select(
            "slot",
            F.col("owner").cast("int").alias("shard"),
            F.split(names, "\n")[F.col("owner").cast("int")].alias("shard_name"),
        )
    )


def assign_shards(
    docs: DataFrame, key: str = "doc_id", shards: list[str] | int = SHARDS, size: int = SLOTS, text: str = "text"
) -> DataFrame:
    """Add slot, shard and shard_name to every row of docs."""
    names = [f"shard-{i:05d}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    kept = [c for c in docs.columns if c.lower() not in ("slot", "shard", "shard_name")]
    by = F.col(f"`{key}`").cast("string")
    if text in docs.columns:
        by = F.coalesce(by, F.col(f"`{text}`").cast("string"))
    slot = F.pmod(F.xxhash64(F.coalesce(by, F.lit(""))), F.lit(size)).cast("int")
    table = table_frame(docs.sparkSession, names, size)
    placed = docs.select(*[F.col(f"`{c}`") for c in kept], slot.alias("slot"))
    return placed.join(F.broadcast(table), "slot").select(*[F.col(f"`{c}`") for c in kept], "slot", "shard", "shard_name")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return assign_shards(docs).select("doc_id", "slot", "shard")
